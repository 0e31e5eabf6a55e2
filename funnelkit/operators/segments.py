"""Experiment segment assignment.

A user's segment is the tag on their *latest* configuration event in the
look-back window; ``test`` wins when both tags are in one tag string.  Date,
time, event id and segment are packed into one decimal whose ``max`` (or
``min``) is the latest (first) tagged row: a fixed-width buffer, so Spark plans
a hash aggregate with map-side partial aggregation, and a user with a third of
all config events still reduces to one row per map task before the shuffle.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import vocab as V
from funnelkit.functions import predicates as P
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables


# a packed tag: days since DAY0 (5 digits), time in ms (13), event id (19), segment (1); times and ids are not negative
DAY0 = "1900-01-01"
SEGMENT_CODES = {V.CONTROL: 1, V.TEST: 2}


def tagged_config(p: Params, lookback_days: int = 30) -> Column:
    """Configuration events of the look-back that carry a tag."""
    seg = F.col("segments")
    return ((F.col("event_name") == V.CONFIG_LOADED) & (F.col("date") >= F.lit(p.days_before(lookback_days)))
            & (seg.like(V.TEST_TAG) | seg.like(V.CONTROL_TAG)))


def packed_tag() -> Column:
    """(date, time, event_id, segment) of a tagged event as one decimal(38,0) that sorts like them."""
    code = f"CASE WHEN segments LIKE '{V.TEST_TAG}' THEN {SEGMENT_CODES[V.TEST]} ELSE {SEGMENT_CODES[V.CONTROL]} END"
    when = f"CAST(datediff(date, DATE'{DAY0}') * 10000000000000L + coalesce(time, 0L) AS DECIMAL(18,0))"
    rest = f"CAST(coalesce(event_id, 0L) AS DECIMAL(19,0)) * CAST(10 AS DECIMAL(2,0)) + {code}"
    return F.expr(f"CAST({when} * CAST(100000000000000000000BD AS DECIMAL(21,0)) + {rest} AS DECIMAL(38,0))")


def is_arm(segment: str, tag: str = "tag") -> Column:
    return F.expr(f"{tag} % 10") == SEGMENT_CODES[segment]


def user_segments(client: DataFrame, p: Params, lookback_days: int = 30, latest: bool = True) -> DataFrame:
    """One row per tagged user: ``distinct_id, segment, segment_date``.

    ``latest=False`` gives the *first* assignment instead (daily new users).
    """
    ev = client.where(tagged_config(p, lookback_days)).select("distinct_id", packed_tag().alias("tag"))
    pick = F.max if latest else F.min
    per_user = ev.groupBy("distinct_id").agg(pick("tag").alias("tag"))
    segment = F.when(is_arm(V.TEST), F.lit(V.TEST)).otherwise(F.lit(V.CONTROL))
    days = "CAST((tag div CAST(100000000000000000000BD AS DECIMAL(21,0))) div 10000000000000L AS INT)"
    return per_user.select("distinct_id", segment.alias("segment"),
                           F.expr(f"date_add(DATE'{DAY0}', {days})").alias("segment_date"))


def segment_users(t: Tables, p: Params, segment: str | None = None, home: bool = True,
                  lookback_days: int = 30) -> DataFrame:
    """A3: latest segment per user joined to the player dimension.

    Output: ``distinct_id, first_event_time, days_since_install, segment,
    segment_date``; restricted to home-market players when ``home``.
    """
    us = user_segments(t.client, p, lookback_days)
    if segment:
        us = us.where(F.col("segment") == segment)
    pl = t.players
    if home:
        pl = pl.where(F.col("first_country").isin(list(p.home_markets)))
    return (pl.join(us, "distinct_id")
            .select("distinct_id", "first_event_time",
                    F.date_diff(F.lit(p.as_of), F.to_date("first_event_time")).cast("bigint").alias("days_since_install"),
                    "segment", "segment_date"))


def cohort_users(t: Tables, p: Params, segment: str = V.TEST, home: bool = True) -> DataFrame:
    return segment_users(t, p, segment=segment, home=home).select("distinct_id")


def experiment_users(t: Tables, p: Params, segment: str = V.TEST) -> DataFrame:
    """Users of one arm by latest tag only (no player/home-market restriction),
    as used by the channel-analytics funnels."""
    ev = t.client.where(tagged_config(p)).select("distinct_id", packed_tag().alias("tag"))
    return ev.groupBy("distinct_id").agg(F.max("tag").alias("tag")).where(is_arm(segment)).select("distinct_id")


def available_versions(t: Tables, p: Params) -> DataFrame:
    """A1: distinct versions at or above the floor seen in the last 90 days."""
    c = t.client
    return (c.where(F.col("version_float").isNotNull() & P.version_floor(p)
                    & (F.col("date") >= F.lit(p.days_before(90))))
            .select("version_float").distinct().orderBy(F.col("version_float").desc()))


def available_countries(t: Tables, p: Params) -> DataFrame:
    """A2: distinct non-empty countries seen in the last 90 days."""
    seen = t.client.where(F.col("date") >= F.lit(p.days_before(90)))
    # with the country in its own table, only the users of the window are joined to it
    seen = seen.select("country" if "country" in seen.columns else "distinct_id").distinct()
    return (t.with_country(seen).where(P.nonempty("country"))
            .select(F.col("country")).distinct().orderBy("country"))


def _active_filters(p: Params):
    return (P.date_between(p.effective_start, p.end)
            & P.attribute_filters(p, countries=False))


def segment_stats(t: Tables, p: Params) -> DataFrame:
    """A4: active users per segment in the effective range, mean days since install."""
    elig = segment_users(t, p)
    active = t.client.where(_active_filters(p)).select("distinct_id").distinct()
    return (elig.join(active, "distinct_id", "left_semi")
            .groupBy("segment")
            .agg(F.count_distinct("distinct_id").alias("users"),
                 F.round(F.avg("days_since_install"), 1).alias("avg_days_since_install"))
            .orderBy("segment"))


def segment_daily_new_users(t: Tables, p: Params, days: int = 14) -> DataFrame:
    """A5: users by date of their first assignment, last ``days`` days."""
    first = user_segments(t.client, p, latest=False)
    return (first.where(F.col("segment_date") >= F.lit(p.days_before(days)))
            .groupBy("segment_date", "segment")
            .agg(F.count_distinct("distinct_id").alias("new_users"))
            .orderBy(F.col("segment_date").desc(), "segment"))


def segment_share(stats: DataFrame) -> DataFrame:
    """Test / control users and their share of the total (one row)."""
    s = stats.agg(
        F.coalesce(F.sum(F.when(F.col("segment") == V.TEST, F.col("users"))), F.lit(0)).cast("bigint").alias("test_users"),
        F.coalesce(F.sum(F.when(F.col("segment") == V.CONTROL, F.col("users"))), F.lit(0)).cast("bigint").alias("control_users"))
    total = F.col("test_users") + F.col("control_users")
    return s.select("test_users", "control_users", total.alias("total_users"),
                    P.safe_pct("test_users", total).alias("test_pct"),
                    P.safe_pct("control_users", total).alias("control_pct"))


def purchase_summary(t: Tables, p: Params) -> DataFrame:
    """Valid purchases of eligible (home-market, tagged) users in range.

    Revenue is summed per row; purchases are row counts here."""
    elig = segment_users(t, p).select("distinct_id")
    rows = (t.client
            .where((F.col("event_name") == V.PURCHASE_SUCCESSFUL) & _active_filters(p) & P.valid_purchase())
            .join(elig, "distinct_id", "left_semi"))
    direct = F.col("payment_platform") == V.DIRECT
    store = F.col("payment_platform").isin(*V.STORES)
    return rows.agg(
        P.money_sum().alias("total_revenue"),
        P.money_sum(direct).alias("direct_revenue"),
        P.money_sum(store).alias("store_revenue"),
        F.count(F.lit(1)).alias("total_purchases"),
        F.count(F.when(direct, 1)).alias("direct_purchases"),
        F.count(F.when(store, 1)).alias("store_purchases"))


def purchase_margin(summary: DataFrame, fee: float = 0.30) -> DataFrame:
    """Shares, fees, net revenue and effective margin of a purchase summary."""
    tot, d, s = F.col("total_revenue"), F.col("direct_revenue"), F.col("store_revenue")
    keep = 1.0 - fee
    net_total = d + s * keep
    return summary.select(
        "total_revenue", "direct_revenue", "store_revenue",
        P.safe_pct(d, tot).alias("direct_share_pct"),
        P.safe_pct(s, tot).alias("store_share_pct"),
        P.r6(d * fee).alias("direct_savings"),
        P.r6(s * fee).alias("store_fees"),
        P.r6(d).alias("net_direct"),
        P.r6(s * keep).alias("net_store"),
        P.r6(net_total).alias("net_total"),
        P.safe_pct(d, net_total).alias("net_direct_share_pct"),
        P.safe_pct(s * keep, net_total).alias("net_store_share_pct"),
        P.r6(tot - net_total).alias("fees_paid"),
        P.safe_pct(net_total, tot).alias("effective_margin_pct"))
