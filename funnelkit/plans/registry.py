"""Named analyses: ``key -> (spark, table_dir) -> DataFrame``.

Each key is one operator of the inventory run with the default parameters on
the canonical tables bound to ``table_dir``.  Derived operators (shares,
percentages, difference-in-differences) stay in the same Spark plan as the
aggregate they derive from.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from funnelkit.operators import cohort as C
from funnelkit.operators import experiment as X
from funnelkit.operators import funnels as FN
from funnelkit.operators import kpi as K
from funnelkit.operators import latency as L
from funnelkit.operators import promo as PR
from funnelkit.operators import segments as S
from funnelkit.operators import switching as SW
from funnelkit.plans.params import FILTERED, LOW_PAYERS, ONE_VERSION, Params, default_params
from funnelkit.sources.binding import Tables, load_tables

Op = Callable[[Tables, Params], DataFrame]

OPERATORS: dict[str, Op] = {
    "available_versions": S.available_versions,
    "available_countries": S.available_countries,
    "segment_users": lambda t, p: S.segment_users(t, p),
    "segment_stats": S.segment_stats,
    "segment_daily_new_users": lambda t, p: S.segment_daily_new_users(t, p),
    # the same operator over the whole 30-day assignment window (the 14-day
    # default is empty on the test data: every first assignment is early)
    "segment_daily_new_users_30d": lambda t, p: S.segment_daily_new_users(t, p, days=30),
    "segment_share": lambda t, p: S.segment_share(S.segment_stats(t, p)),
    "purchase_summary": S.purchase_summary,
    "purchase_margin": lambda t, p: S.purchase_margin(S.purchase_summary(t, p), p.store_fee),
    "cohort_funnel": C.cohort_funnel,
    "cohort_funnel_summary": lambda t, p: C.cohort_funnel_summary(C.cohort_funnel(t, p), p.store_fee),
    "prepurchase_choice": lambda t, p: C.prepurchase_choice(C.cohort_funnel(t, p)),
    "channel_funnel_steps": lambda t, p: C.channel_funnel_steps(C.cohort_funnel(t, p)),
    "cohort_daily": C.cohort_daily,
    "cohort_daily_conversion": lambda t, p: C.cohort_daily_conversion(C.cohort_daily(t, p)),
    "first_vs_repeat": C.first_vs_repeat,
    "purchase_depth": C.purchase_depth,
    "purchase_retention": lambda t, p: C.purchase_retention(C.purchase_depth(t, p)),
    "atv_by_purchase_number": C.atv_by_purchase_number,
    # all users first appear at the start of the data, so the range starts
    # there (no test start) to populate the early buckets
    "time_to_first_purchase": lambda t, p: C.time_to_first_purchase(t, p.replace(test_start=None)),
    "time_to_first_stats": lambda t, p: C.time_to_first_stats(
        C.first_purchase_buckets(t, p.replace(test_start=None))),
    "experiment_funnel": C.experiment_funnel,
    "experiment_funnel_rates": lambda t, p: C.experiment_funnel_rates(C.experiment_funnel(t, p)),
    "platform_kpi": K.platform_kpi,
    "adoption_daily": K.adoption_daily,
    "time_to_continue_daily": K.time_to_continue_daily,
    "funnel_latency": lambda t, p: L.funnel_latency(t, p, exclude_first=False),
    "funnel_latency_excl_first": lambda t, p: L.funnel_latency(t, p, exclude_first=True),
    "card_edit_funnels": L.card_edit_funnels,
    "user_funnel": FN.user_funnel,
    "user_funnel_pct": lambda t, p: FN.funnel_pct(FN.user_funnel(t, p), FN.USER_FUNNEL_ORDER, "", "_users"),
    "execution_funnel": FN.execution_funnel,
    "execution_funnel_pct": lambda t, p: FN.funnel_pct(FN.execution_funnel(t, p), FN.EXECUTION_ORDER, "funnels_"),
    "execution_funnel_by_request": FN.execution_funnel_by_request,
    "execution_funnel_by_request_pct": lambda t, p: FN.funnel_pct(
        FN.execution_funnel_by_request(t, p), FN.BY_REQUEST_ORDER, "funnels_"),
    "server_event_enrichment": lambda t, p: FN.server_event_enrichment(t, p, "user"),
    "server_event_enrichment_asof": lambda t, p: FN.server_event_enrichment(t, p, "event"),
    # the filter panel with values: lists, one version, low-payer countries
    "user_funnel_filtered": lambda t, p: FN.user_funnel(t, p.replace(**FILTERED)),
    "execution_funnel_filtered": lambda t, p: FN.execution_funnel(t, p.replace(**FILTERED)),
    "platform_kpi_filtered": lambda t, p: K.platform_kpi(t, p.replace(**FILTERED)),
    "execution_funnel_one_version": lambda t, p: FN.execution_funnel(t, p.replace(**ONE_VERSION)),
    "user_funnel_low_payers": lambda t, p: FN.user_funnel(t, p.replace(**LOW_PAYERS)),
    "execution_funnel_asof": lambda t, p: FN.execution_funnel(t, p.replace(enrich_mode="event")),
    "funnel_latency_fixed_units": lambda t, p: L.funnel_latency(t, p.replace(fix_units=True), exclude_first=False),
    "diff_in_diff": lambda t, p: X.diff_in_diff(X.experiment_timeline(t, p, exact=True), X.DID_KPIS),
    "cohort_execution_funnel": FN.cohort_execution_funnel,
    "cohort_execution_rates": lambda t, p: FN.cohort_execution_rates(FN.cohort_execution_funnel(t, p)),
    "first_purchase_date": lambda t, p: X.first_purchase_date(t),
    "experiment_timeline": X.experiment_timeline,
    "experiment_timeline_test_only": lambda t, p: X.experiment_timeline(t, p, only_test=True),
    "did_summary": lambda t, p: X.did_summary(X.experiment_timeline(t, p, exact=True)),
    "did_summary_net": lambda t, p: X.did_summary_net(X.experiment_timeline(t, p, exact=True)),
    "before_after": lambda t, p: X.before_after(X.experiment_timeline(t, p, exact=True)),
    "purchaser_timeline": X.purchaser_timeline,
    "purchaser_comparison": lambda t, p: X.purchaser_comparison(X.purchaser_timeline(t, p, exact=True)),
    "switchers": SW.switchers,
    "switch_categories": SW.switch_categories,
    "switch_return": SW.switch_return,
    "switch_return_share": lambda t, p: SW.switch_return_share(SW.switch_return(t, p)),
    "switcher_details": SW.switcher_details,
    "promo_segments": PR.promo_segments,
    "promo_user_details": PR.promo_user_details,
    "promo_outside_users": PR.promo_outside_users,
    "promo_verdict": lambda t, p: PR.promo_verdict(PR.promo_segments(t, p)),
}


def run(name: str, spark: SparkSession, sf_dir: str, p: Params | None = None) -> DataFrame:
    return OPERATORS[name](load_tables(spark, sf_dir), p or default_params())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, _n=name: run(_n, spark, sf_dir)) for name in OPERATORS}


@contextmanager
def shared_inputs(t: Tables, p: Params):
    """Cache the segment maps that most analyses of one dashboard session
    share (SURVEY R11), for the duration of the ``with`` block.

    Spark's cache matches on the logical plan, so every analysis run inside the
    block with the same tables and parameters reads the cached maps instead of
    re-scanning the configuration events.  Cached blocks live in executor
    memory / local disk and are rebuilt from lineage if an executor is lost.
    """
    from pyspark import StorageLevel

    from funnelkit.operators.segments import experiment_users, segment_users, user_segments

    shared = [user_segments(t.client, p), segment_users(t, p), experiment_users(t, p)]
    for df in shared:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield t
    finally:
        for df in shared:
            df.unpersist()
