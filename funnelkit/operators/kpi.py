"""Channel-analytics panel: per-platform KPIs (A9) and daily adoption.

A9 computes the three platform rows in *one* pass over the filtered events:
each platform's rules (which OS counts as active, which purchases are valid,
which continue gates a purchase) become flag columns of one ``FlagCounts``
aggregate, and the one-row result is unpivoted into three rows with
``inline`` — no per-platform re-scan and no row replication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.functions.aggregates import FlagCounts
from funnelkit.functions.pairs import pair_stats
from funnelkit.operators.experiment import event_day
from funnelkit.operators.segments import experiment_users
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables

# fixed platform rules: OS that counts as active / for clicks, order id check
PLATFORM_RULES = {
    V.DIRECT: {"os": ("Apple", "Android"), "click_os": None},
    V.APPLE: {"os": ("Apple",), "click_os": "Apple"},
    V.GOOGLEPLAY: {"os": ("Android",), "click_os": "Android"},
}


def _valid(pl: str) -> Column:
    return {V.DIRECT: P.on(V.DIRECT), V.APPLE: P.apple_ok(), V.GOOGLEPLAY: P.google_ok()}[pl]


def panel_rows(t: Tables, p: Params) -> DataFrame:
    """Client rows of charts 1, 6, 7: window, all filter-panel predicates
    including the testing-country exclusion, version floor, test users."""
    rows = P.filtered_client(t, p, P.client_window(p), exclusions=True, floor=True)
    return rows.join(experiment_users(t, p), "distinct_id", "left_semi")


def platform_kpi(t: Tables, p: Params) -> DataFrame:
    """One row per payment platform with users, purchases, revenue and rates."""
    by_funnel, by_user, sums, both = {}, {}, {}, {}
    for pl, rule in PLATFORM_RULES.items():
        ok = P.is_success() & _valid(pl)
        click_os = F.lit(True) if rule["click_os"] is None else (F.col("os") == rule["click_os"])
        by_user[f"{pl}__active_users"] = F.col("os").isin(*rule["os"])
        by_user[f"{pl}__ppu"] = ok
        by_funnel[f"{pl}__total_purchases"] = ok
        by_funnel[f"{pl}__purchase_clicks"] = P.is_click() & click_os
        by_funnel[f"{pl}__pp_continue_clicks"] = P.is_continue() & P.on(pl) & click_os
        by_funnel[f"{pl}__interrupted_purchases"] = ok & (F.col("interrupted") == 1)
        # gate: the funnel also has a continue on this platform (any OS)
        by_funnel[f"{pl}__gate"] = P.is_continue() & P.on(pl)
        both[f"{pl}__pp_continue_purchases"] = (f"{pl}__total_purchases", f"{pl}__gate")
        sums[f"{pl}__gross"] = ok
    fc = FlagCounts(by_funnel=by_funnel, by_user=by_user, sums=sums, funnel_all=both)
    wide = fc(panel_rows(t, p))
    keep = F.lit("0.70").cast("decimal(3,2)")
    rows = []
    for pl in PLATFORM_RULES:
        g = F.col(f"{pl}__gross")
        net = g if pl == V.DIRECT else (g.cast("decimal(20,2)") * keep).cast("double")
        rows.append(F.struct(
            F.lit(pl).alias("payment_platform"),
            *[F.col(f"{pl}__{m}").alias(m) for m in ("active_users", "total_purchases")],
            g.alias("total_gross_revenue"), net.alias("total_net_revenue"),
            *[F.col(f"{pl}__{m}").alias(m) for m in ("ppu", "purchase_clicks", "pp_continue_clicks",
                                                      "pp_continue_purchases", "interrupted_purchases")]))
    long = wide.select(F.inline(F.array(*rows)))
    c = F.col
    return long.select(
        "payment_platform", "active_users", "total_purchases", P.r6(c("total_gross_revenue")).alias("total_gross_revenue"),
        P.r6(c("total_net_revenue")).alias("total_net_revenue"), "ppu",
        P.safe_pct("ppu", "active_users").alias("ppu_percentage"),
        P.safe_ratio("total_gross_revenue", "active_users").alias("arpdau"),
        P.safe_ratio("total_gross_revenue", "ppu").alias("arppu"),
        P.safe_ratio("total_gross_revenue", "total_purchases").alias("atv"),
        P.safe_pct("pp_continue_clicks", "purchase_clicks").alias("pp_continue_from_purchase_clicks_rate"),
        P.safe_pct("pp_continue_purchases", "pp_continue_clicks").alias("pp_purchase_continue_to_successful_rate"),
        "interrupted_purchases",
        P.safe_pct("interrupted_purchases", "total_purchases").alias("interrupted_purchases_rate"),
    ).orderBy("payment_platform")


def time_to_continue(rows: DataFrame) -> DataFrame:
    """Seconds from each offer impression to every later continue click
    of the same funnel, mean and (lower) median per impression day, over all
    such pairs, counted without emitting them (``functions.pairs``)."""
    events = rows.select("funnel_id", F.col("res_timestamp").alias("t"), "event_date",
                         F.coalesce(F.col("event_name") == V.OFFER_IMPRESSION, F.lit(False)).alias("first"),
                         F.coalesce(P.is_continue(), F.lit(False)).alias("later"))
    return pair_stats(events).select("event_date", "avg_s", "median_s")


def adoption_daily(t: Tables, p: Params) -> DataFrame:
    """Daily direct-channel share of purchases, revenue and payers,
    continue and success rates, and offer-to-continue time."""
    rows = panel_rows(t, p).withColumn("event_date", event_day())
    ok = P.is_success() & P.valid_purchase()
    direct_ok = P.is_success() & P.on(V.DIRECT)
    fc = FlagCounts(
        keys=["event_date"],
        by_funnel={"purchase_clicks": P.is_click(), "direct_purchases": direct_ok, "total_purchases": ok,
                   "direct_continues": P.is_continue() & P.on(V.DIRECT)},
        by_user={"direct_payers": direct_ok, "total_payers": ok},
        sums={"direct_revenue": direct_ok, "total_revenue": ok})
    dm = fc(rows)
    tm = time_to_continue(rows)
    c = F.col
    return (dm.join(tm, "event_date", "left")
            .select("event_date",
                    P.safe_pct("direct_purchases", "total_purchases").alias("direct_purchases_share"),
                    P.safe_pct("direct_revenue", "total_revenue").alias("direct_revenue_share"),
                    P.safe_pct("direct_payers", "total_payers").alias("direct_payers_share"),
                    P.safe_pct("direct_continues", "purchase_clicks").alias("pp_continue_from_purchase_clicks_rate"),
                    P.safe_pct("direct_purchases", "direct_continues").alias("pp_purchase_continue_to_successful_rate"),
                    P.r6_stable(F.coalesce(c("avg_s"), F.lit(0.0))).alias("avg_time_offer_to_continue"),
                    F.coalesce(c("median_s"), F.lit(0.0)).alias("median_time_offer_to_continue"))
            .orderBy("event_date"))


def time_to_continue_daily(t: Tables, p: Params) -> DataFrame:
    """A18 as a table over the panel rows."""
    rows = panel_rows(t, p).withColumn("event_date", event_day())
    return (time_to_continue(rows)
            .select("event_date", P.r6_stable("avg_s").alias("avg_time_offer_to_continue"),
                    F.col("median_s").alias("median_time_offer_to_continue"))
            .orderBy("event_date"))
