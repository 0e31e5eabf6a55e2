"""Payment-channel switching of the test cohort.

Everything is per-user state: first direct / first store purchase date, and
counts relative to the first store date.  Purchases are first reduced to one
row per (user, day, channel) with a partially aggregated ``groupBy`` (a heavy
purchaser collapses map-side), the per-user firsts are a second aggregate of
that, and the "after the switch" counts join the two small aggregates back on
the user key.  Ordered lists are whole; a limit is the caller's (per-partition top-k,
then a bounded merge) with ``distinct_id`` as the final tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.operators.segments import cohort_users
from funnelkit.plans.params import Params, limited
from funnelkit.sources.binding import Tables

CATEGORIES = ("direct_only", "store_only", "direct_then_store", "store_then_direct")  # fixed labels


def _start(p: Params):
    return p.switch_since or p.effective_start


def daily_channel_purchases(t: Tables, p: Params) -> DataFrame:
    """(user, date, channel) -> purchases, revenue, for the test cohort."""
    rows = (t.client
            .where(P.date_between(_start(p), p.end) & P.is_success()
                   & F.col("payment_platform").isin(*V.PLATFORMS) & P.attribute_filters(p, countries=False))
            .join(cohort_users(t, p), "distinct_id", "left_semi"))
    channel = F.when(P.on(V.DIRECT), F.lit("direct")).otherwise(F.lit("store"))
    return (rows.groupBy("distinct_id", "date", channel.alias("channel"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(P.money("price_usd")).alias("rev")))


def user_history(daily: DataFrame) -> DataFrame:
    d, s = F.col("channel") == "direct", F.col("channel") == "store"
    return daily.groupBy("distinct_id").agg(
        F.min(F.when(d, F.col("date"))).alias("first_direct_date"),
        F.min(F.when(s, F.col("date"))).alias("first_store_date"),
        F.coalesce(F.sum(F.when(d, F.col("n"))), F.lit(0)).cast("bigint").alias("direct_purchase_count"),
        F.coalesce(F.sum(F.when(s, F.col("n"))), F.lit(0)).cast("bigint").alias("store_purchase_count"),
        F.coalesce(F.sum(F.when(d, F.col("rev"))), P.dec0()).cast("double").alias("direct_revenue"),
        F.coalesce(F.sum(F.when(s, F.col("rev"))), P.dec0()).cast("double").alias("store_revenue"))


def _direct_then_store():
    fd, fs = F.col("first_direct_date"), F.col("first_store_date")
    return fd.isNotNull() & fs.isNotNull() & (fs >= fd)


def switchers(t: Tables, p: Params) -> DataFrame:
    """Users whose first store purchase is on or after their first direct one."""
    h = user_history(daily_channel_purchases(t, p)).where(_direct_then_store())
    return (h.select("distinct_id", "first_direct_date", "first_store_date", "direct_purchase_count",
                     "store_purchase_count", "direct_revenue", "store_revenue",
                     F.date_diff("first_store_date", "first_direct_date").cast("bigint").alias("days_between"))
            .orderBy(F.col("first_direct_date").desc(), F.col("distinct_id").asc())
            .transform(limited(p.switcher_limit)))


def switch_categories(t: Tables, p: Params) -> DataFrame:
    """Users per channel-order category, all four categories present."""
    h = user_history(daily_channel_purchases(t, p))
    fd, fs = F.col("first_direct_date"), F.col("first_store_date")
    conds = {
        "direct_only": fd.isNotNull() & fs.isNull(),
        "store_only": fd.isNull() & fs.isNotNull(),
        "direct_then_store": _direct_then_store(),
        "store_then_direct": fd.isNotNull() & fs.isNotNull() & (fs < fd),
    }
    counts = h.agg(*[F.count(F.when(conds[c], 1)).alias(c) for c in CATEGORIES])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("user_count")) for c in CATEGORIES])))


def _after_switch(t: Tables, p: Params) -> DataFrame:
    daily = daily_channel_purchases(t, p)
    users = user_history(daily).where(_direct_then_store()).select(
        "distinct_id", "first_direct_date", "first_store_date")
    after = F.col("date") > F.col("first_store_date")
    d, s = F.col("channel") == "direct", F.col("channel") == "store"
    return (users.join(daily, "distinct_id", "left")
            .groupBy("distinct_id", "first_direct_date", "first_store_date")
            .agg(F.coalesce(F.sum(F.when(d & (F.col("date") <= F.col("first_store_date")), F.col("n"))), F.lit(0))
                 .cast("bigint").alias("direct_before_store"),
                 F.coalesce(F.sum(F.when(d & after, F.col("n"))), F.lit(0)).cast("bigint").alias("direct_after_store"),
                 F.coalesce(F.sum(F.when(s & after, F.col("n"))), F.lit(0)).cast("bigint")
                 .alias("store_after_first_store"),
                 F.coalesce(F.sum(F.when(s, F.col("n"))), F.lit(0)).cast("bigint").alias("total_store"),
                 F.coalesce(F.sum(F.when(d, F.col("rev"))), P.dec0()).cast("double").alias("direct_revenue"),
                 F.coalesce(F.sum(F.when(s, F.col("rev"))), P.dec0()).cast("double").alias("store_revenue")))


def switch_return(t: Tables, p: Params) -> DataFrame:
    """Direct->store users who did / did not buy direct again later."""
    a = _after_switch(t, p)
    behavior = F.when(F.col("direct_after_store") > 0, F.lit("Returned to direct")) \
        .otherwise(F.lit("Never returned to direct"))
    return (a.groupBy(behavior.alias("behavior"))
            .agg(F.count_distinct("distinct_id").alias("users"),
                 F.sum("direct_after_store").cast("bigint").alias("direct_purchases_after_store"),
                 F.sum("store_after_first_store").cast("bigint").alias("store_purchases_after_first_store"))
            .orderBy("behavior"))


def switch_return_share(ret: DataFrame) -> DataFrame:
    """Share of direct->store users per behaviour."""
    total = F.sum("users").over(Window.partitionBy())  # over two rows
    return ret.withColumn("total_users", total).select("behavior", "users", P.safe_pct("users", "total_users").alias("pct"))


def switcher_details(t: Tables, p: Params) -> DataFrame:
    """Per direct->store user: purchases before / after the switch,
    revenue by channel, returned flag."""
    a = _after_switch(t, p)
    return (a.select("distinct_id", "first_direct_date", "first_store_date", "direct_before_store",
                     "direct_after_store", "total_store", F.round("direct_revenue", 2).alias("direct_revenue"),
                     F.round("store_revenue", 2).alias("store_revenue"),
                     F.when(F.col("direct_after_store") > 0, F.lit("Yes")).otherwise(F.lit("No"))
                     .alias("returned_to_direct"))
            .orderBy(F.col("direct_after_store").desc(), F.col("first_direct_date").asc(), F.col("distinct_id").asc())
            .transform(limited(p.switcher_limit)))
