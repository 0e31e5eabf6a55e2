"""Experiment read-outs (A22-A29): daily KPI timelines per arm or purchaser
group, first-purchase dates, difference-in-differences and group comparisons.

The symmetric before/after window is computed in Python (``Params``) so the
date bounds reach the scan as literals.  The daily metric block uses
``FlagCounts`` (one fine aggregate, shared exchange) instead of nine
``count(distinct)`` expansions.  The difference-in-differences stays in the
same plan: KPIs are unpivoted to (kpi, arm, period, value) and averaged per
cell with conditional aggregates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.functions.aggregates import FlagCounts
from funnelkit.operators.segments import segment_users
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables

HISTORY_START = date(2020, 1, 1)

# --- fixed values: KPI names and labels, in display order -----------------------
KPI_LABELS = {
    "active_users": "Active Users",
    "total_purchases": "Total Purchases",
    "gross_revenue": "Gross Revenue ($)",
    "net_revenue": "Net Revenue ($)",
    "paying_users": "Paying Users",
    "ftd_users": "FTD Users",
    "ppu_percent": "PPU %",
    "ftd_percent": "FTD %",
    "arpdau": "ARPDAU ($)",
    "arpdau_net": "ARPDAU Net ($)",
    "arppu": "ARPPU ($)",
    "arppu_net": "ARPPU Net ($)",
    "atv": "ATV ($)",
    "atv_net": "ATV Net ($)",
    "purchase_to_continue_rate": "Purchase Click to Continue Rate (%)",
    "continue_to_purchase_rate": "Continue to Purchase Rate (%)",
    "interrupted_rate": "Interrupted Rate (%)",
    "interrupted_purchases": "Interrupted Purchases",
}
# gross and net difference-in-differences tables
DID_KPIS = ["active_users", "total_purchases", "gross_revenue", "net_revenue", "paying_users", "ftd_users",
            "ppu_percent", "ftd_percent", "arpdau", "arppu", "atv"]
DID_KPIS_NET = ["active_users", "total_purchases", "net_revenue", "paying_users", "ftd_users",
                "ppu_percent", "ftd_percent", "arpdau_net", "arppu_net", "atv_net"]
# chart menus of the experiment timeline (gross tab, net tab)
TIMELINE_MENU_1 = ["active_users", "total_purchases", "gross_revenue", "net_revenue", "paying_users",
                   "ftd_users", "arpdau", "arppu", "interrupted_rate"]
TIMELINE_MENU_2 = ["ppu_percent", "ftd_percent", "atv", "purchase_to_continue_rate",
                   "continue_to_purchase_rate", "interrupted_purchases"]
TIMELINE_MENU_1_NET = ["active_users", "total_purchases", "net_revenue", "paying_users", "ftd_users",
                       "arpdau_net", "arppu_net", "interrupted_rate"]
TIMELINE_MENU_2_NET = ["ppu_percent", "ftd_percent", "atv_net", "purchase_to_continue_rate",
                       "continue_to_purchase_rate", "interrupted_purchases"]
# purchaser comparison table and its chart menus
COMPARISON_KPIS = ["active_users", "total_purchases", "gross_revenue", "net_revenue", "paying_users",
                   "ftd_users", "ppu_percent", "ftd_percent", "arpdau", "arpdau_net", "arppu", "arppu_net",
                   "atv", "atv_net"]
COMPARISON_MENU_1 = ["active_users", "total_purchases", "gross_revenue", "net_revenue", "paying_users",
                     "ftd_users", "arpdau", "arppu", "interrupted_rate"]
COMPARISON_MENU_2 = ["ppu_percent", "ftd_percent", "atv", "arpdau_net", "arppu_net", "atv_net",
                     "purchase_to_continue_rate", "continue_to_purchase_rate"]
RAW = ["active_users", "total_purchases", "gross_revenue", "net_revenue", "paying_users",
       "interrupted_purchases", "purchase_clicks", "pp_continue_clicks", "ftd_users"]
DIRECT_PURCHASERS, STORE_ONLY_PURCHASERS = "Direct Purchasers", "Store-only Purchasers"


def _union(*menus) -> list[str]:
    out: list[str] = []
    for m in menus:
        out += [k for k in m if k not in out]
    return out


def event_day(c: str = "res_timestamp"):
    """Calendar day (UTC) of an epoch-millisecond column, independent of the
    session time zone."""
    return F.date_from_unix_date(F.expr(f"{c} div 86400000").cast("int"))


def first_purchase_date(t: Tables, users: DataFrame | None = None) -> DataFrame:
    """First day of a valid purchase per user (history since 2020), from the
    maintained table where there is one."""
    if t.first_purchases is not None:
        known = t.first_purchases.select("distinct_id", "first_purchase_date")
        return known if users is None else known.join(users, "distinct_id", "left_semi")
    rows = t.client.where(P.is_success() & (F.col("date") >= F.lit(HISTORY_START)) & P.valid_purchase())
    if users is not None:
        rows = rows.join(users, "distinct_id", "left_semi")
    return rows.groupBy("distinct_id").agg(F.min(event_day()).alias("first_purchase_date"))


def daily_kpis(rows: DataFrame, first: DataFrame, keep: float = 0.70, exact: bool = False) -> DataFrame:
    """Nine daily metrics and eleven KPIs per (event_date, segment).

    ``exact`` keeps full double precision (for the difference-in-differences,
    which averages the daily values); otherwise KPIs are rounded to 6 dp."""
    rows = rows.withColumn("event_date", event_day())
    valid = P.is_success() & P.valid_purchase()
    m = P.money("price_usd")
    net_amount = F.when(P.on(V.DIRECT), m).otherwise(m * F.lit(str(keep)).cast("decimal(3,2)"))
    counts = FlagCounts(
        keys=["event_date", "segment"],
        by_funnel={
            "total_purchases": valid,
            "interrupted_purchases": P.is_success() & (F.col("interrupted") == 1),
            "purchase_clicks": P.is_click(),
            "pp_continue_clicks": P.is_continue(),
        },
        by_user={
            "active_users": F.lit(True),
            "paying_users": valid,
            "ftd_users": valid,
        },
        sums={"gross_revenue": valid, "net_revenue": (valid, net_amount)})
    # whether a paying user's day is the first one depends on (user, day) alone
    fine = counts.fine(rows).join(first, "distinct_id", "left")
    ftd = F.when(F.col("first_purchase_date") == F.col("event_date"), F.col("u__ftd_users")).otherwise(0)
    d = counts.derive(fine.withColumn("u__ftd_users", ftd).drop("first_purchase_date"))
    c = F.col
    r = not exact

    def pct(n, dd):
        return P.safe_pct(n, dd, rounded=r)

    def ratio(n, dd):
        return P.safe_ratio(n, dd, rounded=r)
    out = d.select(
        "event_date", "segment", *RAW,
        pct("paying_users", "active_users").alias("ppu_percent"),
        pct("ftd_users", "active_users").alias("ftd_percent"),
        ratio("gross_revenue", "active_users").alias("arpdau"),
        ratio("net_revenue", "active_users").alias("arpdau_net"),
        ratio("gross_revenue", "paying_users").alias("arppu"),
        ratio("net_revenue", "paying_users").alias("arppu_net"),
        ratio("gross_revenue", "total_purchases").alias("atv"),
        ratio("net_revenue", "total_purchases").alias("atv_net"),
        pct("pp_continue_clicks", "purchase_clicks").alias("purchase_to_continue_rate"),
        pct("total_purchases", "pp_continue_clicks").alias("continue_to_purchase_rate"),
        pct("interrupted_purchases", "total_purchases").alias("interrupted_rate"))
    if exact:
        return out
    return out.withColumn("gross_revenue", P.r6(c("gross_revenue"))).withColumn("net_revenue", P.r6(c("net_revenue")))


def _timeline_columns(d: DataFrame, test_start: date, period) -> DataFrame:
    kpis = [k for k in d.columns if k not in ("event_date", "segment")]
    return d.select("event_date", "segment", F.lit(test_start).alias("test_start_date"),
                    period.alias("period"), *kpis).orderBy("event_date", "segment")


def experiment_timeline(t: Tables, p: Params, only_test: bool = False, exact: bool = False) -> DataFrame:
    """Day x arm KPIs over the symmetric window around the test start."""
    range_start, ts, range_end = p.experiment_window
    arms = segment_users(t, p).select("distinct_id", F.initcap("segment").alias("segment"))
    if only_test:
        arms = arms.where(F.col("segment") == "Test")
    rows = (t.client.where(P.date_between(range_start, range_end)
                           & P.attribute_filters(p, countries=False, floor=True))
            .join(arms, "distinct_id"))
    d = daily_kpis(rows, first_purchase_date(t, arms.select("distinct_id")), exact=exact)
    period = F.when(F.col("event_date") >= F.lit(ts), F.lit("After")).otherwise(F.lit("Before"))
    return _timeline_columns(d, ts, period)


def _kpi_long(timeline: DataFrame, kpis: list[str], group: str = "segment") -> DataFrame:
    return (timeline.selectExpr(group, "period", *[f"CAST({k} AS DOUBLE) AS {k}" for k in kpis])
            .unpivot([group, "period"], kpis, "kpi", "value"))


def _kpi_meta(df: DataFrame, kpis: list[str]) -> DataFrame:
    order = ", ".join(f"'{k}', {i + 1}" for i, k in enumerate(kpis))
    label = ", ".join(f"'{k}', '{KPI_LABELS[k]}'" for k in kpis)
    return df.select("*", F.expr(f"map({order})[kpi]").alias("kpi_order"),
                     F.expr(f"map({label})[kpi]").alias("label"))


def _cell(seg: str, period: str | None = None):
    cond = F.col("segment") == seg
    if period:
        cond = cond & (F.col("period") == period)
    return F.coalesce(F.avg(F.when(cond, F.col("value"))), F.lit(0.0))


def _pct_change(delta, base):
    return P.r6_stable(F.when(base != 0, delta / base * 100.0).otherwise(F.lit(0.0)))


def diff_in_diff(timeline: DataFrame, kpis: list[str]) -> DataFrame:
    """Per KPI, mean daily value of each arm x period (missing = 0),
    changes, difference-in-differences and its share of control-before.
    Pass a timeline built with ``exact=True`` so the means are not taken
    over rounded values."""
    g = (_kpi_long(timeline, kpis).groupBy("kpi")
         .agg(_cell("Test", "Before").alias("tb"), _cell("Test", "After").alias("ta"),
              _cell("Control", "Before").alias("cb"), _cell("Control", "After").alias("ca"),
              F.max((F.col("segment") == "Test").cast("int")).alias("has_t"),
              F.max((F.col("segment") == "Control").cast("int")).alias("has_c")))
    tb, ta, cb, ca = F.col("tb"), F.col("ta"), F.col("cb"), F.col("ca")
    did = (ta - tb) - (ca - cb)
    out = g.select("kpi", P.r6_stable(tb).alias("test_before"), P.r6_stable(ta).alias("test_after"),
                   _pct_change(ta - tb, tb).alias("test_change_pct"),
                   P.r6_stable(cb).alias("control_before"), P.r6_stable(ca).alias("control_after"),
                   _pct_change(ca - cb, cb).alias("control_change_pct"),
                   P.r6_stable(did).alias("diff_in_diff"), _pct_change(did, cb).alias("diff_in_diff_pct"),
                   (F.col("has_t") == 1).alias("has_test"), (F.col("has_c") == 1).alias("has_control"))
    return _kpi_meta(out, kpis)


def did_summary(timeline: DataFrame) -> DataFrame:
    """Difference-in-differences table of the gross KPIs."""
    return (diff_in_diff(timeline, DID_KPIS).drop("has_test", "has_control")
            .select("kpi_order", "kpi", "label", "test_before", "test_after", "test_change_pct",
                    "control_before", "control_after", "control_change_pct", "diff_in_diff",
                    "diff_in_diff_pct").orderBy("kpi_order"))


def did_summary_net(timeline: DataFrame) -> DataFrame:
    """Difference-in-differences table of the net KPIs."""
    return (diff_in_diff(timeline, DID_KPIS_NET).drop("has_test", "has_control")
            .select("kpi_order", "kpi", "label", "test_before", "test_after", "test_change_pct",
                    "control_before", "control_after", "control_change_pct", "diff_in_diff",
                    "diff_in_diff_pct").orderBy("kpi_order"))


def before_after(timeline: DataFrame) -> DataFrame:
    """Per-KPI before/after summary of every chart-menu KPI, with flags
    telling whether each arm has any rows."""
    kpis = _union(TIMELINE_MENU_1, TIMELINE_MENU_2, TIMELINE_MENU_1_NET, TIMELINE_MENU_2_NET)
    return diff_in_diff(timeline, kpis).orderBy("kpi_order")


def purchaser_groups(t: Tables, p: Params) -> DataFrame:
    """Test users (any test tag in 60 days, home market) split into users who
    bought direct at least once since the test start and store-only buyers."""
    ts = p.test_start or p.start
    tagged = (t.client.where((F.col("event_name") == V.CONFIG_LOADED) & (F.col("date") >= F.lit(p.days_before(60)))
                             & F.col("segments").like(V.TEST_TAG))
              .select("distinct_id").distinct())
    home = t.players.where(F.col("first_country").isin(list(p.home_markets))).select("distinct_id")
    users = home.join(tagged, "distinct_id", "left_semi")
    buys = (t.client.where(P.is_success() & (F.col("date") >= F.lit(ts)))
            .join(users, "distinct_id", "left_semi")
            .groupBy("distinct_id")
            .agg(F.max(P.on(V.DIRECT).cast("int")).alias("direct"),
                 F.max((P.on_store() & P.store_ok()).cast("int")).alias("store")))
    seg = F.when(F.col("direct") == 1, F.lit(DIRECT_PURCHASERS)).when(F.col("store") == 1, F.lit(STORE_ONLY_PURCHASERS))
    return buys.select("distinct_id", seg.alias("segment")).where(F.col("segment").isNotNull())


def purchaser_timeline(t: Tables, p: Params, exact: bool = False) -> DataFrame:
    """Day x purchaser-group KPIs since the test start."""
    ts = p.test_start or p.start
    groups = purchaser_groups(t, p)
    rows = (t.client.where(P.date_between(ts, p.as_of) & P.attribute_filters(p, countries=False, floor=True))
            .join(groups, "distinct_id"))
    d = daily_kpis(rows, first_purchase_date(t, groups.select("distinct_id")), exact=exact)
    return _timeline_columns(d, ts, F.lit("After"))


def purchaser_comparison(timeline: DataFrame) -> DataFrame:
    """Mean daily KPI of direct purchasers vs store-only purchasers,
    difference and difference %, for the table and chart-menu KPIs."""
    kpis = _union(COMPARISON_KPIS, COMPARISON_MENU_1, COMPARISON_MENU_2)
    g = (_kpi_long(timeline, kpis).groupBy("kpi")
         .agg(_cell(DIRECT_PURCHASERS).alias("a"), _cell(STORE_ONLY_PURCHASERS).alias("b"),
              F.max((F.col("segment") == DIRECT_PURCHASERS).cast("int")).alias("has_a"),
              F.max((F.col("segment") == STORE_ONLY_PURCHASERS).cast("int")).alias("has_b")))
    a, b = F.col("a"), F.col("b")
    out = g.select("kpi", P.r6_stable(a).alias("direct_purchasers"), P.r6_stable(b).alias("store_only_purchasers"),
                   P.r6_stable(a - b).alias("difference"), _pct_change(a - b, b).alias("difference_pct"),
                   (F.col("has_a") == 1).alias("has_direct"), (F.col("has_b") == 1).alias("has_store_only"))
    return _kpi_meta(out, kpis).orderBy("kpi_order")
