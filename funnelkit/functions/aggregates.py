"""Aggregation building blocks.

Many analyses count *distinct* funnels or users under a dozen different
conditions.  Written as ``count_distinct(when(cond, id))`` Spark expands every
input row once per distinct expression before the shuffle.  ``FlagCounts``
instead aggregates once to one row per (keys, user, funnel) with 0/1 flags and
exact money sums (partial aggregation runs map-side, so a hot user or funnel
collapses before the shuffle), then derives the funnel counts, user counts and
sums from that small table in one chain, so the event table is scanned once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P



def any_flag(cond: Column) -> Column:
    """1 when any row of the group meets ``cond`` (null counts as false)."""
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


@dataclass
class FlagCounts:
    keys: list[str] = field(default_factory=list)
    by_funnel: dict[str, Column] = field(default_factory=dict)
    by_user: dict[str, Column] = field(default_factory=dict)
    # name -> condition (sums price_usd) or (condition, decimal amount)
    sums: dict = field(default_factory=dict)
    # name -> (by_funnel name, by_funnel name): funnels that meet *both*
    funnel_all: dict = field(default_factory=dict)
    funnel: str = "funnel_id"
    user: str = "distinct_id"

    def _grain(self) -> list[str]:
        g = list(self.keys)
        if self.by_user:
            g.append(self.user)
        if self.by_funnel or self.funnel_all:
            g.append(self.funnel)
        return g

    def fine(self, df: DataFrame) -> DataFrame:
        """One row per (keys, user, funnel) with flags and exact sums; the user
        or funnel key is left out when no count needs it."""
        aggs = [any_flag(c).alias(f"f__{n}") for n, c in self.by_funnel.items()]
        aggs += [any_flag(c).alias(f"u__{n}") for n, c in self.by_user.items()]
        for n, c in self.sums.items():
            cond, amount = c if isinstance(c, tuple) else (c, P.money("price_usd"))
            aggs.append(F.sum(F.when(cond, amount).otherwise(P.dec0())).alias(f"s__{n}"))
        return df.groupBy(*self._grain()).agg(*aggs)

    def derive(self, fine: DataFrame) -> DataFrame:
        """Counts and sums per ``keys`` from the fine table, in one chain of
        aggregates without branches, so the events are read once: where both
        funnels and users are counted, each fine row becomes one row of its
        funnel (with the sums) and one of its user.  (Expressions are given as
        SQL text: same plan, fewer round trips while building it.)"""
        E = F.expr
        funnels, users = bool(self.by_funnel or self.funnel_all), bool(self.by_user)
        f = [f"f__{n}" for n in self.by_funnel]
        u = [f"u__{n}" for n in self.by_user]
        s = [f"s__{n}" for n in self.sums]
        if funnels and users:
            kind = {x.name: x.dataType.simpleString() for x in fine.schema.fields}
            none = lambda c: f"CAST(NULL AS {kind[c]}) AS {c}"
            zero = lambda cs: [f"CAST(0 AS {kind[c]}) AS {c}" for c in cs]
            of_funnel = ", ".join([self.funnel, none(self.user), *f, *zero(u), *s])
            of_user = ", ".join([none(self.funnel), self.user, *zero(f), *u, *zero(s)])
            ids = fine.selectExpr(*self.keys, f"explode(array(struct(0 AS __kind, {of_funnel}), struct(1 AS __kind, {of_user}))) AS __id")
            ids = ids.selectExpr(*self.keys, "__id.*").groupBy(*self.keys, "__kind", self.funnel, self.user)
            fine = ids.agg(*[E(f"max({c})").alias(c) for c in f + u], *[E(f"sum({c})").alias(c) for c in s])
        flag = lambda c, i: f"CASE WHEN {i} IS NOT NULL THEN {c} ELSE 0 END"
        both = [(n, f"{flag(f'f__{a}', self.funnel)} * f__{b}") for n, (a, b) in self.funnel_all.items()]
        out = fine.groupBy(*self.keys).agg(
            *[E(f"sum({flag(f'f__{n}', self.funnel)})").alias(n) for n in self.by_funnel],
            *[E(f"sum({x})").alias(n) for n, x in both],
            *[E(f"sum({flag(f'u__{n}', self.user)})").alias(n) for n in self.by_user],
            *[E(f"sum(s__{n})").alias(n) for n in self.sums])
        # empty input: a global aggregate still yields one row of zeros
        fills = [f"CAST(coalesce({n}, 0) AS BIGINT) AS {n}"
                 for n in list(self.by_funnel) + list(self.funnel_all) + list(self.by_user)]
        fills += [f"CAST(coalesce({n}, CAST(0 AS DECIMAL(18,2))) AS DOUBLE) AS {n}" for n in self.sums]
        return out.selectExpr(*self.keys, *fills)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.derive(self.fine(df))
