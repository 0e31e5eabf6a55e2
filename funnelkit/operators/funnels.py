"""Purchase funnels over client and payment-server events.

Each funnel is a strip of step counts: distinct users (A10), distinct funnel /
transaction ids (A12, A42) or distinct request ids (A14).  The original built
one scalar sub-query per step; here all steps of a source come from one
aggregate, and the log is read once per role rather than per step: server steps
and the users' latest server times share one aggregate, and arm, metadata (and,
by user, client steps) another.  The percentage views unpivot the strip with ``inline``
and divide by the first step; a zero base gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import predicates as P
from funnelkit.functions import vocab as V
from funnelkit.functions.aggregates import FlagCounts
from funnelkit.operators.enrich import client_metadata, enrich, server_filters, test_arm
from funnelkit.operators.segments import cohort_users, experiment_users
from funnelkit.plans.params import Params
from funnelkit.sources.binding import Tables


def _ev(name: str) -> Column:
    return F.col("event_name") == name


def _client_steps() -> dict[str, Column]:
    d = P.on(V.DIRECT)
    return {
        "purchase_click": P.is_click(),
        "changed_selection": _ev(V.PRE_PURCHASE_CLICK) & F.col("cta_name").isin(V.CTA_SELECT_DIRECT, V.CTA_SELECT_STORE),
        "direct_continue": P.is_continue() & d,
        "native_popup": _ev(V.NATIVE_POPUP) & d,
        "client_success": P.is_success() & d,
        "validation_request": _ev(V.VERIFY_REQUEST) & d,
        "validation_approval": _ev(V.VERIFY_APPROVAL) & d,
        "rewards": _ev(V.REWARDS) & d,
    }


def _server_steps(success_events=(V.WF_SUCCESS, V.WH_SUCCESS), add_card: bool = True) -> dict[str, Column]:
    steps = {"webform_impression": _ev(V.WF_IMPRESSION)}
    if add_card:
        steps["webform_add_card"] = _ev(V.WF_ADD_CARD)
    steps["webform_pay_click"] = _ev(V.WF_CHECKOUT_CLICK) & (F.col("cta_name") == V.CTA_PAY)
    steps["webform_success"] = F.col("event_name").isin(*success_events)
    return steps


# display order of the steps (fixed): user funnel and execution funnels differ
USER_FUNNEL_ORDER = ["purchase_click", "changed_selection", "direct_continue", "native_popup",
                     "webform_impression", "webform_add_card", "webform_pay_click", "webform_success",
                     "validation_request", "validation_approval", "client_success", "rewards"]
EXECUTION_ORDER = ["purchase_click", "changed_selection", "direct_continue", "native_popup",
                   "webform_impression", "webform_add_card", "webform_pay_click", "webform_success",
                   "client_success", "validation_request", "validation_approval", "rewards"]
BY_REQUEST_ORDER = [s for s in EXECUTION_ORDER if s != "webform_add_card"]


def panel_client_rows(t: Tables, p: Params, users: DataFrame) -> DataFrame:
    """Client rows of the channel-analytics panels: window, test users, OS /
    version / country / low-payer filters and the version floor."""
    rows = P.filtered_client(t, p, P.client_window(p), floor=True, exclusions=p.apply_exclusions_everywhere)
    return rows.join(users, "distinct_id", "left_semi")


def panel_server_rows(t: Tables, p: Params, users: DataFrame, id_col: str | None = None) -> DataFrame:
    """Server rows in the window for the users, enriched with client metadata
    and filtered through it."""
    rows = t.server.where(P.server_window(p)).join(users, "distinct_id", "left_semi")
    if id_col:
        rows = rows.where(F.col(id_col).isNotNull())
    return server_filters(enrich(rows, client_metadata(t, p, users), p.enrich_mode), p, t,
                          exclusions=p.apply_exclusions_everywhere)


def server_event_enrichment(t: Tables, p: Params, mode: str | None = None) -> DataFrame:
    """A16 as a table: the test users' server events of the window with the
    attached client version / country (before the metadata filters)."""
    users = experiment_users(t, p)
    rows = t.server.where(P.server_window(p)).join(users, "distinct_id", "left_semi")
    rows = rows.select("distinct_id", "request_id", "event_name", "transaction_id", "funnel_id", "cta_name",
                       "request_timestamp").distinct()
    return enrich(rows, client_metadata(t, p, users), mode or p.enrich_mode).select(
        "distinct_id", "request_id", "event_name", "transaction_id", "funnel_id", "cta_name",
        "request_timestamp", "client_version_float", "client_country_code")


def _strip(client: DataFrame, server: DataFrame, client_steps: dict, server_steps: dict,
           client_id: str, server_id: str, prefix: str, suffix: str) -> DataFrame:
    """One-row strip: client steps counted by ``client_id``, server steps by ``server_id``."""
    def counts(df, steps, id_col):
        if id_col == "distinct_id":
            fc = FlagCounts(by_user=steps)
        else:
            fc = FlagCounts(by_funnel=steps, funnel=id_col)
        return fc(df)
    return _row(counts(client, client_steps, client_id), counts(server, server_steps, server_id),
                client_steps, server_steps, prefix, suffix)


def _row(c: DataFrame, s: DataFrame, client_steps: dict, server_steps: dict, prefix: str, suffix: str) -> DataFrame:
    row = c.crossJoin(s)
    return row.select(*[F.col(k).alias(f"{prefix}{k}{suffix}") for k in list(client_steps) + list(server_steps)])


def packed_server(t: Tables, p: Params, steps: dict[str, Column], id_col: str | None = None) -> DataFrame:
    """Server rows of the window per user (and ``id_col``, not null): the latest time and a bit per step
    in one long.  As it is one column, every reader asks for the same aggregate and they share its exchange."""
    rows = t.server.where(P.server_window(p) if id_col is None else P.server_window(p) & F.col(id_col).isNotNull())
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(steps.values())), F.lit(0).cast("bigint"))
    keys = ["distinct_id"] if id_col is None else ["distinct_id", id_col]
    packed = F.shiftleft(F.max("request_timestamp"), len(steps)).bitwiseOR(F.bit_or(bits))
    return rows.groupBy(*keys).agg(packed.alias("packed"))


def _bit(i: int) -> Column:
    return F.expr(f"CAST(shiftright(packed, {i}) & 1 AS INT)")


def _panel(p: Params) -> Column:
    """The panel's row predicates, those on the country included (``low`` countries joined by the caller)."""
    cond = P.attribute_filters(p, countries=False, floor=True) & P.country_filters(p, exclusions=p.apply_exclusions_everywhere)
    return cond & F.col("__low") if p.low_payers_only else cond


def user_funnel(t: Tables, p: Params) -> DataFrame:
    """A10: distinct users reaching each of the 12 steps (test users).

    One read of each log: server steps by user are joined to the client rows, and one aggregate by user
    gives arm, client steps and metadata."""
    client_steps, server_steps = _client_steps(), _server_steps()
    if p.enrich_mode != "user":
        users = experiment_users(t, p)
        out = _strip(panel_client_rows(t, p, users), panel_server_rows(t, p, users),
                     client_steps, server_steps, "distinct_id", "distinct_id", "", "_users")
        return out.select(*[f"{s}_users" for s in USER_FUNNEL_ORDER])
    server = packed_server(t, p, server_steps)
    users = test_arm(t, p, server, F.shiftright("packed", len(server_steps)), {"packed": F.col("packed")},
                     _panel(p), client_steps)
    passed = metadata_ok(t, p)
    counts = [F.sum(n) for n in client_steps] + [F.sum(F.when(passed, _bit(i)).otherwise(F.lit(0))) for i in range(len(server_steps))]
    names = [f"{s}_users" for s in [*client_steps, *server_steps]]
    out = users.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(n) for c, n in zip(counts, names, strict=True)])
    return out.select(*[f"{s}_users" for s in USER_FUNNEL_ORDER])


def metadata_ok(t: Tables, p: Params, exclusions: bool | None = None) -> Column:
    """``server_filters`` as a flag of a ``test_arm`` row; ``low_ok`` there says the country has low payers."""
    exclusions = p.apply_exclusions_everywhere if exclusions is None else exclusions
    cond = P.attribute_filters(p, os=False, floor=True, exclusions=exclusions,
                               version_col="client_version_float", country_col="client_country_code")
    return cond & F.col("client_low") if p.low_payers_only else cond


def _execution(t: Tables, p: Params, server_steps: dict[str, Column], server_id: str, order: list[str]) -> DataFrame:
    """Client steps by funnel, server steps by ``server_id``; server rows are read once, for the
    users' latest times and for the strip."""
    users = experiment_users(t, p)
    client = panel_client_rows(t, p, users).where(F.col("funnel_id").isNotNull())
    if p.enrich_mode != "user":
        out = _strip(client, panel_server_rows(t, p, users, server_id), _client_steps(), server_steps,
                     "funnel_id", server_id, "funnels_", "")
        return out.select(*[f"funnels_{s}" for s in order])
    server = packed_server(t, p, server_steps, server_id)
    k = len(server_steps)
    latest = server.groupBy("distinct_id").agg(F.max(F.shiftright("packed", k)).alias("latest"))
    arm = test_arm(t, p, latest, F.col("latest")).where(metadata_ok(t, p)).select("distinct_id")
    per_id = server.join(arm, "distinct_id").groupBy(server_id).agg(F.bit_or("packed").alias("packed"))
    s = per_id.agg(*[F.coalesce(F.sum(_bit(i)), F.lit(0)).cast("bigint").alias(n) for i, n in enumerate(server_steps)])
    c = FlagCounts(by_funnel=_client_steps(), funnel="funnel_id")(client)
    out = _row(c, s, _client_steps(), server_steps, "funnels_", "")
    return out.select(*[f"funnels_{s}" for s in order])


def execution_funnel(t: Tables, p: Params) -> DataFrame:
    """Distinct funnels (client) / transactions (server) per step."""
    return _execution(t, p, _server_steps((V.WH_SUCCESS,)), "transaction_id", EXECUTION_ORDER)


def execution_funnel_by_request(t: Tables, p: Params) -> DataFrame:
    """The older 11-step variant counting server steps by request id."""
    return _execution(t, p, _server_steps(add_card=False), "request_id", BY_REQUEST_ORDER)


def cohort_execution_funnel(t: Tables, p: Params) -> DataFrame:
    """Execution funnel of the home-market test cohort in the effective
    range; OS / version filters on client rows, no metadata enrichment, no
    version floor."""
    users = cohort_users(t, p)
    client = (t.client.where(P.date_between(p.effective_start, p.end) & P.attribute_filters(p, countries=False)
                             & F.col("funnel_id").isNotNull())
              .join(users, "distinct_id", "left_semi"))
    server = (t.server.where(P.date_between(p.effective_start, p.end) & F.col("transaction_id").isNotNull())
              .join(users, "distinct_id", "left_semi"))
    out = _strip(client, server, _client_steps(), _server_steps((V.WH_SUCCESS,)),
                 "funnel_id", "transaction_id", "funnels_", "")
    return out.select(*[f"funnels_{s}" for s in EXECUTION_ORDER])


def funnel_pct(strip: DataFrame, order: list[str], prefix: str = "", suffix: str = "") -> DataFrame:
    """A11/A13/A15/A43 shape: one row per step with its count and percent of
    the first step; no rows when the first step is zero."""
    cols = [f"{prefix}{s}{suffix}" for s in order]
    long = strip.select(F.col(cols[0]).alias("base"), F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step_order"), F.lit(s).alias("step"), F.col(c).cast("bigint").alias("value"))
        for i, (s, c) in enumerate(zip(order, cols))])))
    return (long.where(F.col("base") > 0)
            .select("step_order", "step", "value", P.safe_pct("value", "base").alias("pct_of_base")))


def cohort_execution_rates(strip: DataFrame) -> DataFrame:
    """The 12 steps with % of purchase clicks, plus five chained rates."""
    steps = funnel_pct(strip, EXECUTION_ORDER, "funnels_")
    c = lambda s: F.col(f"funnels_{s}")
    rates = [("continue_rate", c("direct_continue"), c("purchase_click")),
             ("webform_rate", c("webform_impression"), c("direct_continue")),
             ("pay_click_rate", c("webform_pay_click"), c("webform_impression")),
             ("success_rate", c("client_success"), c("webform_pay_click")),
             ("overall_conversion", c("client_success"), c("purchase_click"))]
    rate_rows = strip.where(c("purchase_click") > 0).select(F.inline(F.array(*[
        F.struct(F.lit(len(EXECUTION_ORDER) + i + 1).alias("step_order"), F.lit(name).alias("step"),
                 F.lit(None).cast("bigint").alias("value"), P.safe_pct(n, d).alias("pct_of_base"))
        for i, (name, n, d) in enumerate(rates)])))
    return steps.unionByName(rate_rows)
