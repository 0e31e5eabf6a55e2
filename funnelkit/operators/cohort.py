"""Test-arm cohort analyses (A30-A45): purchase funnel by channel, daily trend,
first vs repeat purchasers, purchase depth, value by purchase number, time to
first purchase, and the test-vs-control funnel.

Cohort = home-market users whose latest tag is ``test`` (``segments``).  Per-user
orderings (purchase number) are computed without putting a user's whole
history in one task: counts and minimum dates come from partially aggregated
``groupBy``s, and the only ranking, the first three purchases per user, is a
``row_number() <= 3`` filter that Spark plans as a WindowGroupLimit, which
trims each map partition to three rows per user before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.functions.aggregates import FlagCounts
from funnelkit.operators.segments import cohort_users, segment_users
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables


# keys that rows without a funnel are spread over in the gate's join
SPREAD = 1024


def cohort_events(t: Tables, p: Params, names=(V.PURCHASE_CLICK, V.PRE_PURCHASE_CLICK, V.PURCHASE_SUCCESSFUL),
                  start=None, segment: str = V.TEST) -> DataFrame:
    """Cohort rows in the effective range with the OS / version filters."""
    users = cohort_users(t, p, segment)
    return (t.client
            .where(P.date_between(start or p.effective_start, p.end) & F.col("event_name").isin(*names)
                   & P.attribute_filters(p, countries=False))
            .join(users, "distinct_id", "left_semi"))


def cohort_funnel(t: Tables, p: Params) -> DataFrame:
    """One row; store purchases only count funnels with a store continue."""
    counts = FlagCounts(
        by_funnel={
            "purchase_clicks": P.is_click(),
            "direct_continue": P.is_continue() & P.on(V.DIRECT),
            "apple_continue": P.is_continue() & P.on(V.APPLE),
            "google_continue": P.is_continue() & P.on(V.GOOGLEPLAY),
            "store_continue_any": P.is_continue() & P.on_store(),
            "direct_purchases": P.is_success() & P.on(V.DIRECT),
            "apple_purchases": P.is_success() & P.apple_ok(),
            "google_purchases": P.is_success() & P.google_ok(),
        },
        by_user={
            "purchase_click_users": P.is_click(),
            "direct_paying_users": P.is_success() & P.on(V.DIRECT),
            "apple_paying_users": P.is_success() & P.apple_ok(),
            "google_paying_users": P.is_success() & P.google_ok(),
        },
        sums={
            "direct_revenue": P.is_success() & P.on(V.DIRECT),
            "apple_revenue": P.is_success() & P.apple_ok(),
            "google_revenue": P.is_success() & P.google_ok(),
        })
    fine = counts.fine(cohort_events(t, p))
    # gate: the funnel had a store continue anywhere in the cohort rows
    gate = fine.where(F.col("funnel_id").isNotNull()).groupBy("funnel_id").agg(
        F.max("f__store_continue_any").alias("gate"), F.min(F.col("f__store_continue_any").cast("bigint") * 0).alias("spread"))
    # rows without a funnel never meet a gate: a second key spreads them over all tasks of the join (the gate's is an
    # aggregate, always 0, since a constant would be folded out of the join's keys)
    spread = F.when(F.col("funnel_id").isNull(), F.pmod(F.xxhash64("distinct_id"), F.lit(SPREAD - 1)) + 1).otherwise(F.lit(0)).alias("spread")
    gated = (fine.select(*fine.columns, spread).join(gate, ["funnel_id", "spread"], "left")
             .select(*fine.columns, F.coalesce("gate", F.lit(0)).alias("gate")))
    g = F.col("gate")
    replaced = {}
    for store in ("apple", "google"):
        replaced[f"f__{store}_purchases"] = F.col(f"f__{store}_purchases") * g
        replaced[f"u__{store}_paying_users"] = F.col(f"u__{store}_paying_users") * g
        replaced[f"s__{store}_revenue"] = F.when(g == 1, F.col(f"s__{store}_revenue")).otherwise(P.dec0())
    gated = gated.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in gated.columns])
    out = counts.derive(gated)
    return out.select("purchase_clicks", "purchase_click_users", "direct_continue", "apple_continue",
                      "google_continue", "direct_purchases", "apple_purchases", "google_purchases",
                      "direct_revenue", "apple_revenue", "google_revenue", "direct_paying_users",
                      "apple_paying_users", "google_paying_users")


def cohort_funnel_summary(funnel: DataFrame, fee: float = 0.30) -> DataFrame:
    """Totals, channel conversion and the margin block."""
    c = F.col
    store_cont = c("apple_continue") + c("google_continue")
    store_purch = c("apple_purchases") + c("google_purchases")
    store_rev = c("apple_revenue") + c("google_revenue")
    net = c("direct_revenue") + store_rev * (1.0 - fee)
    gross = c("direct_revenue") + store_rev
    return funnel.select(
        "purchase_clicks",
        (c("direct_purchases") + store_purch).alias("total_purchases"),
        P.r6(gross).alias("total_revenue"),
        "direct_continue", "direct_purchases", P.r6(c("direct_revenue")).alias("direct_revenue"),
        P.safe_pct("direct_purchases", "direct_continue").alias("direct_conversion_pct"),
        store_cont.alias("store_continue"), store_purch.alias("store_purchases"),
        P.r6(store_rev).alias("store_revenue"),
        P.safe_pct(store_purch, store_cont).alias("store_conversion_pct"),
        P.r6(c("direct_revenue") * fee).alias("direct_savings"),
        P.r6(store_rev * fee).alias("store_fees"),
        P.r6(net).alias("net_total"),
        P.safe_pct(net, gross).alias("effective_margin_pct"))


def prepurchase_choice(funnel: DataFrame) -> DataFrame:
    """Direct (default) vs store (switched) continue clicks with shares."""
    total = F.col("direct_continue") + F.col("apple_continue") + F.col("google_continue")
    long = funnel.select(
        total.alias("total"),
        F.inline(F.array(
            F.struct(F.lit(V.DIRECT).alias("choice"), F.col("direct_continue").alias("continue_clicks")),
            F.struct(F.lit("store").alias("choice"),
                     (F.col("apple_continue") + F.col("google_continue")).alias("continue_clicks")))))
    return long.select("choice", "continue_clicks", P.safe_pct("continue_clicks", "total").alias("pct"))


def channel_funnel_steps(funnel: DataFrame) -> DataFrame:
    """Click -> continue -> success per channel; zero steps dropped;
    percent of the channel's first remaining step."""
    c = F.col
    steps = []
    for ch, cont, purch in ((V.DIRECT, c("direct_continue"), c("direct_purchases")),
                            ("store", c("apple_continue") + c("google_continue"),
                             c("apple_purchases") + c("google_purchases"))):
        for order, (step, val) in enumerate((("purchase_click", c("purchase_clicks")),
                                             ("continue", cont), ("purchase_success", purch)), start=1):
            steps.append(F.struct(F.lit(ch).alias("channel"), F.lit(step).alias("step"),
                                  F.lit(order).alias("step_order"), val.cast("bigint").alias("value")))
    long = funnel.select(F.inline(F.array(*steps))).where(c("value") > 0)
    first = F.min_by("value", "step_order").over(Window.partitionBy("channel"))
    return long.select("channel", "step", "step_order", "value", P.safe_pct(c("value"), first).alias("pct_of_first"))


def cohort_daily(t: Tables, p: Params) -> DataFrame:
    """Daily clicks, continues, purchases and revenue per channel (ungated)."""
    store_ok = P.is_success() & (P.apple_ok() | P.google_ok())
    counts = FlagCounts(
        keys=["event_date"],
        by_funnel={
            "purchase_clicks": P.is_click(),
            "direct_continue": P.is_continue() & P.on(V.DIRECT),
            "direct_purchases": P.is_success() & P.on(V.DIRECT),
            "store_continue": P.is_continue() & P.on_store(),
            "store_purchases": store_ok,
        },
        sums={"direct_revenue": P.is_success() & P.on(V.DIRECT), "store_revenue": store_ok})
    ev = cohort_events(t, p).withColumnRenamed("date", "event_date")
    return counts(ev).select("event_date", "purchase_clicks", "direct_continue", "direct_purchases",
                             "direct_revenue", "store_continue", "store_purchases", "store_revenue")


def cohort_daily_conversion(daily: DataFrame) -> DataFrame:
    """Purchases per continue (%) per channel and day."""
    return daily.select("event_date",
                        P.safe_pct("direct_purchases", "direct_continue").alias("direct_conversion_pct"),
                        P.safe_pct("store_purchases", "store_continue").alias("store_conversion_pct"))


# --- purchase ordinals (direct channel, 365-day look-back) ---------------------

def direct_purchases(t: Tables, p: Params) -> DataFrame:
    from datetime import timedelta
    start = p.effective_start - timedelta(days=365)
    return (t.client
            .where(P.date_between(start, p.end) & P.is_success() & P.on(V.DIRECT) & P.attribute_filters(p, countries=False))
            .join(cohort_users(t, p), "distinct_id", "left_semi")
            .select("distinct_id", "date", "funnel_id", "time", "event_id", P.money("price_usd").alias("amount")))


def _in_range(p: Params, c="date"):
    return P.date_between(p.effective_start, p.end, c)


def first_vs_repeat(t: Tables, p: Params) -> DataFrame:
    """Per day, users making their first direct purchase and users making
    a repeat one (a user can be both on the day of their first purchase)."""
    daily = direct_purchases(t, p).groupBy("distinct_id", "date").agg(F.count(F.lit(1)).alias("n"))
    first = daily.groupBy("distinct_id").agg(F.min("date").alias("first_date"))
    d = daily.join(first, "distinct_id").where(_in_range(p))
    is_first = F.col("date") == F.col("first_date")
    is_repeat = (F.col("date") > F.col("first_date")) | (is_first & (F.col("n") >= 2))
    return (d.groupBy(F.col("date").alias("event_date"))
            .agg(F.count(F.when(is_first, 1)).alias("first_purchase_users"),
                 F.count(F.when(is_repeat, 1)).alias("repeat_purchase_users"))
            .orderBy("event_date"))


def purchase_depth(t: Tables, p: Params) -> DataFrame:
    """Users who reached their 1st, 2nd, 3rd, 4th+ direct purchase, among
    users purchasing in range (purchase number counts the look-back too)."""
    per_user = (direct_purchases(t, p).groupBy("distinct_id")
                .agg(F.count(F.lit(1)).alias("n"), F.max(_in_range(p).cast("int")).alias("active")))
    act = F.col("active") == 1
    return per_user.agg(*[F.count(F.when(act & (F.col("n") >= k), 1)).alias(name) for k, name in
                          ((1, "users_1st_purchase"), (2, "users_2nd_purchase"),
                           (3, "users_3rd_purchase"), (4, "users_4th_plus_purchase"))])


def purchase_retention(depth: DataFrame) -> DataFrame:
    """Step and cumulative retention between purchase numbers."""
    u1, u2, u3, u4 = (F.col(c) for c in ("users_1st_purchase", "users_2nd_purchase",
                                          "users_3rd_purchase", "users_4th_plus_purchase"))
    return depth.select("*",
                        P.safe_pct(u2, u1).alias("retention_1_to_2"),
                        P.safe_pct(u3, u2).alias("retention_2_to_3"),
                        P.safe_pct(u4, u3).alias("retention_3_to_4"),
                        P.safe_pct(u2, u1).alias("cumulative_2nd"),
                        P.safe_pct(u3, u1).alias("cumulative_3rd"),
                        P.safe_pct(u4, u1).alias("cumulative_4th"))


TIERS = {1: "1st Purchase", 2: "2nd Purchase", 3: "3rd Purchase", 4: "4th+ Purchase"}  # fixed labels


def atv_by_purchase_number(t: Tables, p: Params) -> DataFrame:
    """Count, revenue and mean value of in-range direct purchases by
    purchase number (ties on date and funnel broken by time, event id)."""
    rows = direct_purchases(t, p)
    w = Window.partitionBy("distinct_id").orderBy(
        F.col("date").asc(), F.col("funnel_id").asc_nulls_first(), F.col("time").asc(), F.col("event_id").asc())
    top = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 3).where(_in_range(p))
    first3 = top.groupBy("rn").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("rev"))
    total = rows.where(_in_range(p)).agg(F.count(F.lit(1)).alias("n_all"), F.sum("amount").alias("rev_all"))
    head = first3.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n3"), F.coalesce(F.sum("rev"), P.dec0()).alias("rev3"))
    rest = (total.crossJoin(head)
            .select(F.lit(4).alias("rn"), (F.col("n_all") - F.col("n3")).alias("n"),
                    (F.coalesce(F.col("rev_all"), P.dec0()) - F.col("rev3")).alias("rev"))
            .where(F.col("n") > 0))
    tiers = first3.select(F.col("rn").cast("int").alias("rn"), "n", "rev").unionByName(rest)
    label = F.element_at(F.create_map(*[x for k, v in TIERS.items() for x in (F.lit(k), F.lit(v))]), F.col("rn"))
    return (tiers.select(label.alias("purchase_tier"), F.col("rn").cast("bigint").alias("tier_order"),
                         F.col("n").cast("bigint").alias("num_purchases"),
                         F.col("rev").cast("double").alias("total_revenue"),
                         P.r6(F.col("rev").cast("double") / F.col("n")).alias("avg_transaction_value"))
            .orderBy("tier_order"))


# fixed bucket edges (days from install): label, order, low, high
BUCKETS = (("Day 0 (Same day)", 1, 0, 0), ("Day 1", 2, 1, 1), ("Day 2-3", 3, 2, 3), ("Day 4-7", 4, 4, 7),
           ("Day 8-14", 5, 8, 14), ("Day 15-30", 6, 15, 30))
LAST_BUCKET = ("Day 31+", 7)


def time_to_first_purchase(t: Tables, p: Params) -> DataFrame:
    """Users by days from install to first direct purchase (first purchase
    in range; negative or unknown day counts fall into the last bucket)."""
    return first_purchase_buckets(t, p).drop("known", "total_days").orderBy("bucket_order")


def first_purchase_buckets(t: Tables, p: Params) -> DataFrame:
    """A40 with the number and sum of known day counts, for averages over buckets."""
    first = (direct_purchases(t, p).groupBy("distinct_id").agg(F.min("date").alias("first_purchase_date"))
             .where(_in_range(p, "first_purchase_date")))
    inst = t.players.select("distinct_id", F.to_date("first_event_time").alias("install_date"))
    d = first.join(inst, "distinct_id").withColumn(
        "days", F.date_diff("first_purchase_date", "install_date"))
    label, order = F.lit(LAST_BUCKET[0]), F.lit(LAST_BUCKET[1])
    for name, o, lo, hi in reversed(BUCKETS):
        cond = F.col("days").between(lo, hi)
        label, order = F.when(cond, F.lit(name)).otherwise(label), F.when(cond, F.lit(o)).otherwise(order)
    return (d.groupBy(label.alias("days_bucket"), order.cast("bigint").alias("bucket_order"))
            .agg(F.count(F.lit(1)).alias("users"), P.r6(F.avg("days")).alias("avg_days"),
                 F.count("days").alias("known"), F.sum("days").alias("total_days")))


def time_to_first_stats(buckets: DataFrame) -> DataFrame:
    """Total users, weighted mean days, same-day and first-week shares."""
    total = F.sum("users")
    return buckets.agg(
        F.coalesce(total, F.lit(0)).cast("bigint").alias("total_users"),
        P.r6(F.coalesce(F.sum("total_days") / F.sum("known"), F.lit(0.0))).alias("avg_days"),
        P.safe_pct(F.coalesce(F.sum(F.when(F.col("bucket_order") == 1, F.col("users"))), F.lit(0)), total)
         .alias("day_0_pct"),
        P.safe_pct(F.coalesce(F.sum(F.when(F.col("bucket_order") <= 4, F.col("users"))), F.lit(0)), total)
         .alias("week_1_pct"))


def experiment_funnel(t: Tables, p: Params) -> DataFrame:
    """Clicks, purchases and revenue per arm (no OS/version filter)."""
    arms = (segment_users(t, p).select("distinct_id", F.initcap("segment").alias("segment")))
    ev = (t.client.where(P.date_between(p.effective_start, p.end)
                         & F.col("event_name").isin(V.PURCHASE_CLICK, V.PURCHASE_SUCCESSFUL))
          .join(arms, "distinct_id"))
    counts = FlagCounts(
        keys=["segment"],
        by_funnel={"purchase_clicks": P.is_click(), "total_purchases": P.is_success(),
                   "direct_purchases": P.is_success() & P.on(V.DIRECT), "store_purchases": P.is_success() & (P.apple_ok() | P.google_ok())},
        sums={"total_revenue": P.is_success()})
    return counts(ev).orderBy(F.col("segment").desc())


def experiment_funnel_rates(ef: DataFrame) -> DataFrame:
    """Purchase conversion per arm."""
    return ef.select("segment", "purchase_clicks", "total_purchases",
                     P.safe_pct("total_purchases", "purchase_clicks").alias("conversion_pct"))
