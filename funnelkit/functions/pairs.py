"""Statistics over (earlier event, later event) pairs of a group without
emitting the pairs.

A18 asks, per day of an offer impression, for the mean and the median of
``t_continue - t_impression`` over *all* pairs of an impression and a later
continue click of the same funnel.  Enumerating them is quadratic in the size
of a funnel.  Here both sides are counted per time bucket first, in four
nested sizes (hour, minute, second, millisecond), and only buckets meet:

* count and mean: a pair is taken up at the coarsest size that puts its events
  in different buckets, so buckets join within one bucket of the next coarser
  size.  Numbers and sums of a bucket are enough for an exact mean.
* median: pairs are counted by the distance ``k`` of their buckets.  Events
  ``k`` buckets of size h apart differ by more than (k - 1)h and less than
  (k + 1)h, so the median's pair is among the distances k - 1 to k + 1 around
  the one where the running count reaches its rank; only those pairs are
  counted at the next finer size.  At one millisecond k is the median itself.

A bucket meets as many others as three buckets of the next coarser size hold
(180, at the last size 3,000; hours: those of the date span), however many
rows a funnel has, and every count is combined map-side.  The plan is lazy and
the same for inputs of every size; the result is exact, as ``percentile_disc``
over the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES_MS = (3_600_000, 60_000, 1_000, 1)
D38 = "decimal(38,0)"
BOTH = 10**18


def _div(c: str, size: int) -> Column:
    """``c`` divided by ``size``, rounded down.  Never null, so that a join on it adds no null test to the
    reader's filters: all readers of the counts keep the same plan."""
    return F.expr(f"coalesce((({c}) - pmod({c}, {size}L)) div {size}L, 0L)")


def _buckets(rows: DataFrame, n: str, key: str, by: list[str], prefix: str) -> DataFrame:
    """Per size, key and bucket: the next coarser bucket, number of events and sum of their times in the bucket."""
    levels = [F.struct(F.lit(i).alias("level"), (_div("t", SIZES_MS[i - 1]) if i else F.lit(0).cast("bigint")).alias("outer"),
                       _div("t", h).alias(f"{prefix}b"), F.expr(f"pmod(t, {h}L)").alias("rest"))
              for i, h in enumerate(SIZES_MS)]
    x = rows.select(key, *by, n, F.explode(F.array(*levels)).alias("x")).select(key, *by, n, "x.*")
    return x.groupBy("level", key, "outer", *by, f"{prefix}b").agg(
        F.sum(n).cast(D38).alias(f"{prefix}n"), F.sum(F.col("rest").cast(D38) * F.col(n)).alias(f"{prefix}s"))


def _totals(imp: DataFrame, later: DataFrame, group: str, key: str) -> DataFrame:
    """group, n_pairs, sum_ms over pairs with a later second event."""
    size = F.element_at(F.array(*[F.lit(h) for h in SIZES_MS]), F.col("level") + 1).cast(D38)
    c = F.col
    pairs = (_buckets(imp, "m", key, [group], "i").join(_buckets(later, "n", key, [], "l"), ["level", key, "outer"])
             .where(c("lb") > c("ib")))
    gap = c("in") * c("ln") * ((c("lb") - c("ib")).cast(D38) * size) + c("in") * c("ls") - c("ln") * c("is")
    return pairs.groupBy(group).agg(F.sum(c("in") * c("ln")).cast(D38).alias("n_pairs"), F.sum(gap).cast(D38).alias("sum_ms"))


def _nearest(counts: DataFrame, group: str, carried: list[str], name: str) -> DataFrame:
    """The distance ``name`` at which each group's running count reaches ``rank``; ``rank`` less what lies further below."""
    up_to = Window.partitionBy(group).orderBy("k")
    c = F.col
    run = counts.withColumn("cum", F.sum("n").over(up_to.rowsBetween(Window.unboundedPreceding, 0)))
    # all pairs at distances of k - 2 or less; distances without pairs have no row
    run = run.withColumn("below", F.coalesce(F.sum("n").over(up_to.rangeBetween(Window.unboundedPreceding, -2)), F.lit(0)))
    found = run.where((c("cum") >= c("rank")) & (c("cum") - c("n") < c("rank")))
    return found.select(group, *carried, (c("rank") - c("below")).cast(D38).alias("rank"), c("k").alias(name))


def pair_stats(rows: DataFrame, group: str = "event_date", key: str = "funnel_id") -> DataFrame:
    """Per ``group`` of the first event: number of (first, later) pairs of a key,
    mean and lower median of the time difference in seconds.  ``rows`` has
    ``key, t, group`` and booleans ``first`` and ``later``; rows with a null
    never pair; only groups with pairs.  Both numbers of an event are one sum
    (``m * BOTH + n``): whatever a reader needs of them it asks for the same
    aggregate, so all readers share one exchange and the rows are read once."""
    c = F.col
    # the null tests stand here, as those that the optimiser would add differ by reader
    events = rows.select(key, "t", group, "first", "later").where(
        (c("first") | c("later")) & c(key).isNotNull() & c("t").isNotNull() & c(group).isNotNull())
    both = F.when(c("first"), F.lit(BOTH).cast(D38)).otherwise(0) + c("later").cast("int").cast(D38)
    events = events.groupBy(key, "t", group).agg(F.sum(both.cast(D38)).cast(D38).alias("mn"))
    events = events.withColumns({"m": F.expr(f"mn div cast({BOTH} as {D38})"), "n": F.expr(f"cast(mn % cast({BOTH} as {D38}) as bigint)")})
    imp, later = events.where(c("m") > 0).select(key, "t", group, "m"), events.where(c("n") > 0).select(key, "t", "n")
    totals = _totals(imp, later, group, key)
    carried = ["n_pairs", "sum_ms"]
    state = None
    for i, h in enumerate(SIZES_MS):
        a = imp.groupBy(key, group, _div("t", h).alias("ib")).agg(F.sum("m").cast(D38).alias("in"))
        b = later.groupBy(key, _div("t", h).alias("lb")).agg(F.sum("n").cast(D38).alias("ln"))
        k = c("lb") - c("ib")
        if state is None:
            counts = a.join(b, key).where(k >= 0).groupBy(group, k.alias("k")).agg(F.sum(c("in") * c("ln")).cast(D38).alias("n"))
            # pairs of one hour whose second event is not later come first in the order of differences
            everything = F.sum("n").over(Window.partitionBy(group))
            counts = counts.withColumn("all", everything).join(totals, group).withColumn(
                "rank", c("all") - c("n_pairs") + F.ceil(c("n_pairs") / 2))
        else:
            kept = [f"k{j}" for j in range(i)]
            outer = SIZES_MS[i - 1] // h
            a = a.join(state, group).withColumn(
                "outer", F.explode(F.expr("sequence(-1L, 1L)"))).withColumn("outer", c("outer") + _div("ib", outer) + c(kept[-1]))
            pairs = a.join(b.withColumn("outer", _div("lb", outer)), [key, "outer"])
            for j, at in enumerate(kept[:-1]):
                f = SIZES_MS[j] // h
                pairs = pairs.where((_div("lb", f) - _div("ib", f)).between(c(at) - 1, c(at) + 1))
            hour = SIZES_MS[0] // h
            pairs = pairs.where(_div("lb", hour) >= _div("ib", hour))  # distances of hours start at 0
            carried = ["n_pairs", "sum_ms", *kept]
            counts = pairs.groupBy(group, "rank", *carried, k.alias("k")).agg(F.sum(c("in") * c("ln")).cast(D38).alias("n"))
        state = _nearest(counts, group, carried, f"k{i}")
    return state.select(group, c("n_pairs").cast("bigint").alias("n_pairs"),
                        (c("sum_ms").cast("double") / c("n_pairs").cast("double") / 1000.0).alias("avg_s"),
                        (c(f"k{len(SIZES_MS) - 1}") / 1000.0).alias("median_s"))
