"""Step latency of purchase funnels.

Per funnel the step times are pivoted with ``max(when(step, ts))`` (one
partially aggregated ``groupBy``), server webform step times likewise, the two
are left-joined on the funnel id, and exact medians / means are taken per platform
(``functions.quantiles``).
Exclusions are anti joins: funnels whose transaction had a card edit (A21),
and optionally each user's first direct continue funnel (A20).

Faithful default: the server clock is in seconds but the original divided
webform deltas by 1000 as if they were milliseconds and subtracted server
seconds from client milliseconds; ``Params.fix_units=True`` converts properly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.functions.quantiles import exact_medians
from funnelkit.operators.enrich import client_metadata, enrich, server_filters, test_arm
from funnelkit.operators.funnels import metadata_ok
from funnelkit.operators.kpi import panel_rows
from funnelkit.operators.segments import experiment_users
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables


def card_edit_funnels(t: Tables, p: Params) -> DataFrame:
    """Transactions with a card-edit click -> their last non-null funnel
    id (by server time; ties go to the larger id)."""
    rows = t.server.where(P.date_between(p.start, p.end) & F.col("transaction_id").isNotNull())
    last = F.when(F.col("funnel_id").isNotNull(), _time_and_id("request_timestamp"))
    per = rows.groupBy("transaction_id").agg(F.max(F.when(F.col("event_name") == V.WF_ADD_CARD, F.lit(1))).alias("edited"),
                                             F.max(last).alias("last"))
    return per.where("edited = 1 AND last IS NOT NULL").select("transaction_id", _id_of("last").alias("funnel_id"))


def _time_and_id(time: str) -> Column:
    """(time, funnel id) as one decimal that sorts like them, a fixed-width buffer; ids are not negative."""
    return F.expr(f"CAST(CAST({time} AS DECIMAL(18,0)) * CAST(10000000000000000000BD AS DECIMAL(20,0)) + CAST(funnel_id AS DECIMAL(19,0)) AS DECIMAL(38,0))")


def _id_of(packed: str) -> Column:
    return F.expr(f"CAST({packed} % CAST(10000000000000000000BD AS DECIMAL(20,0)) AS BIGINT)")


def first_continue_funnels(t: Tables, p: Params) -> DataFrame:
    """Each user's first direct continue funnel in the date range (all users)."""
    rows = t.client.where(P.date_between(p.start, p.end) & P.on(V.DIRECT) & F.col("funnel_id").isNotNull()
                          & P.is_continue())
    return (rows.groupBy("distinct_id")
            .agg(F.min(_time_and_id("res_timestamp")).alias("first"))
            .select(_id_of("first").alias("funnel_id")))


def _excluded(t: Tables, p: Params, exclude_first: bool) -> DataFrame:
    ex = card_edit_funnels(t, p).select("funnel_id")
    if exclude_first:
        ex = ex.unionByName(first_continue_funnels(t, p))
    return ex.distinct()


def _server_times(t: Tables, p: Params) -> DataFrame:
    """Last time of each webform step per funnel, over rows that pass the panel's filters by client metadata."""
    ev, sts = F.col("event_name"), F.col("request_timestamp")
    steps = {"wf_impression_ts": ev == V.WF_IMPRESSION,
             "wf_click_ts": (ev == V.WF_CHECKOUT_CLICK) & (F.col("cta_name") == V.CTA_PAY),
             "wf_success_ts": ev.isin(V.WF_SUCCESS, V.WH_SUCCESS)}
    rows = t.server.where(P.server_window(p) & F.col("funnel_id").isNotNull())
    if p.enrich_mode != "user":
        users = experiment_users(t, p)
        rows = server_filters(enrich(rows.join(users, "distinct_id", "left_semi"), client_metadata(t, p, users), p.enrich_mode), p, t)
        return rows.groupBy("funnel_id").agg(*[F.max(F.when(c, sts)).alias(n) for n, c in steps.items()])
    # seconds since the window's start, plus 1 (0: none), nine digits each: one column, so that the users' latest
    # times and the funnels' steps share one aggregate and its exchange
    base = P.epoch_s_range(p.start, p.end)[0]
    packed = F.lit(0).cast("decimal(38,0)")
    for c in [F.lit(True), *steps.values()]:
        part = F.coalesce(F.max(F.when(c, sts)) - F.lit(base - 1), F.lit(0)).cast("decimal(9,0)")
        packed = (packed * F.lit(10**9).cast("decimal(10,0)") + part).cast("decimal(38,0)")
    server = rows.groupBy("distinct_id", "funnel_id").agg(packed.alias("packed"))
    part = lambda i: F.expr(f"(packed % CAST({10 ** (9 * (4 - i))}BD AS DECIMAL(38,0))) div CAST({10 ** (9 * (3 - i))}BD AS DECIMAL(38,0))")
    latest = server.groupBy("distinct_id").agg((F.max(part(0)) + F.lit(base - 1)).alias("latest"))
    arm = test_arm(t, p, latest, F.col("latest")).where(metadata_ok(t, p, exclusions=False)).select("distinct_id")
    times = [F.max(F.when(part(i) > 0, part(i) + F.lit(base - 1))).alias(n) for i, n in enumerate(steps, 1)]
    return server.join(arm, "distinct_id").groupBy("funnel_id").agg(*times)


def funnel_latency(t: Tables, p: Params, exclude_first: bool | None = None) -> DataFrame:
    """Per platform, median and mean seconds between funnel steps;
    webform deltas only for the direct platform."""
    exclude_first = p.exclude_first_purchase if exclude_first is None else exclude_first
    excluded = _excluded(t, p, exclude_first)
    # funnels left out here never meet server times: those are joined to the client's funnels
    client = (panel_rows(t, p).where(F.col("funnel_id").isNotNull())
              .join(excluded, "funnel_id", "left_anti"))
    ev, ts = F.col("event_name"), F.col("res_timestamp")
    fe = client.groupBy("funnel_id", "payment_platform").agg(
        F.max(F.when(P.is_continue(), ts)).alias("continue_ts"),
        F.max(F.when(ev == V.NATIVE_POPUP, ts)).alias("popup_ts"),
        F.max(F.when(P.is_success() & P.valid_purchase(), ts)).alias("success_ts"),
        F.max(F.when(ev == V.REWARDS, ts)).alias("rewards_ts"))
    we = _server_times(t, p)

    def gap(a, b):
        return F.col(a) - F.col(b)

    # whole milliseconds; the original takes the server's seconds for milliseconds
    wf = (lambda a, b: gap(a, b) * 1000) if p.fix_units else gap
    wf_client = F.col("success_ts") - F.col("wf_success_ts") * (1000 if p.fix_units else 1)
    deltas = {"continue_to_rewards": gap("rewards_ts", "continue_ts"), "continue_to_popup": gap("popup_ts", "continue_ts"),
              "popup_to_success": gap("success_ts", "popup_ts"), "success_to_rewards": gap("rewards_ts", "success_ts"),
              "wf_impression_to_click": wf("wf_click_ts", "wf_impression_ts"), "wf_click_to_success": wf("wf_success_ts", "wf_click_ts"),
              "wf_success_to_client_success": wf_client}
    client_deltas = list(deltas)[:4]
    d = (fe.join(we, "funnel_id", "left")
         .where(F.col("payment_platform").isin(*V.PLATFORMS) & (deltas["continue_to_rewards"] > 0))
         .select("payment_platform", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("v")) for n, v in deltas.items()]))))
    stats = exact_medians(d, ["payment_platform", "metric"])
    median = (F.col("median") / F.lit(1000.0)).alias("median")
    mean = (F.col("total").cast("double") / F.col("n") / F.lit(1000.0)).alias("avg")
    of = lambda n, c: F.max(F.when(F.col("metric") == n, F.col(c)))
    wide = (stats.select("payment_platform", "metric", median, mean).groupBy("payment_platform")
            .agg(*[of(n, "median").alias(f"median_{n}") for n in deltas], *[of(n, "avg").alias(f"avg_{n}") for n in deltas]))
    direct = F.col("payment_platform") == V.DIRECT
    out = [F.col("payment_platform")]
    out += [F.col(f"median_{n}") for n in client_deltas]
    out += [P.r6_stable(f"avg_{n}").alias(f"avg_{n}") for n in client_deltas]
    out += [F.when(direct, F.col(f"median_{n}")).alias(f"median_{n}") for n in deltas if n not in client_deltas]
    out += [F.when(direct, P.r6_stable(f"avg_{n}")).alias(f"avg_{n}") for n in deltas if n not in client_deltas]
    return wide.select(*out).orderBy("payment_platform")
