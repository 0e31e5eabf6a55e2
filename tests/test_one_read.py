"""How often the plans read the event logs, and that hot users, seconds and null funnels don't gather in one task."""

import re

import numpy as np
import pytest
from fixtures import ev, srv, tables, tag
from pyspark.sql import functions as F

import __spark_entry__ as E
from funnelkit.functions.quantiles import exact_medians
from funnelkit.operators import cohort as C
from funnelkit.operators import enrich as EN
from funnelkit.operators import funnels as FN
from funnelkit.plans.params import default_params

SF_DIR = "/root/testdata/sf0.01"
P0 = default_params()


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def event_scans(df) -> int:
    return sum("FileScan parquet" in line and "events.parquet" in line for line in final_plan(df).splitlines())


@pytest.mark.parametrize(("key", "most"), [
    ("user_funnel", 2), ("user_funnel_pct", 2), ("execution_funnel", 4), ("execution_funnel_pct", 4),
    ("execution_funnel_by_request", 4), ("funnel_latency", 5), ("funnel_latency_excl_first", 6),
    ("adoption_daily", 4), ("time_to_continue_daily", 4), ("platform_kpi", 2)])
def test_event_scans(spark, key, most):
    assert event_scans(E.queries()[key](spark, SF_DIR)) <= most


@pytest.mark.parametrize("key", ["segment_users", "segment_daily_new_users", "user_funnel"])
def test_fixed_width_buffers(spark, key):
    plan = final_plan(E.queries()[key](spark, SF_DIR))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_exact_medians(spark):
    rng = np.random.default_rng(0)
    rows = [("a", int(x)) for x in rng.integers(-10**12, 10**12, 3001)] + [("b", int(x)) for x in rng.integers(-3, 3, 500)]
    rows += [("c", 7), ("c", -(2**62)), ("d", None), ("e", 2**62), ("e", 5)]
    got = {r.k: (r.n, int(r.total), r.median) for r in exact_medians(spark.createDataFrame(rows, "k string, v long"), ["k"]).collect()}
    want = {}
    for k in "abce":
        v = sorted(x for j, x in rows if j == k)
        want[k] = (len(v), sum(v), v[(len(v) - 1) // 2])
    assert got == want


def test_duplicate_server_rows_count_once(spark):
    server = [srv(1, 16, "wf_impression", transaction_id=3, funnel_id=7, sec=50)] * 3
    server += [srv(1, 16, "wf_checkout_click", cta_name="pay", transaction_id=3, funnel_id=7, sec=60)] * 2
    t = tables(spark, [tag(1, 2, "test"), ev(1, 16, "purchase_click", funnel_id=7), tag(2, 2, "control")], server)
    r = FN.execution_funnel(t, P0).first()
    assert (r.funnels_purchase_click, r.funnels_webform_impression, r.funnels_webform_pay_click) == (1, 1, 1)
    u = FN.user_funnel(t, P0).first()
    assert (u.purchase_click_users, u.webform_impression_users, u.webform_pay_click_users) == (1, 1, 1)


def test_metadata_after_the_last_server_event_does_not_count(spark):
    server = [srv(u, 16, "wf_impression", transaction_id=u, funnel_id=u, sec=50) for u in (1, 2, 3)]
    client = [tag(u, 2, "test") for u in (1, 2, 3)]
    client = [dict(r, version_float=0.0) for r in client]
    client += [ev(1, 16, "purchase_click", funnel_id=1, sec=49, version_float=0.378),   # before: passes
               ev(2, 16, "purchase_click", funnel_id=2, sec=51, version_float=0.378),   # after: unknown, fails the floor
               ev(3, 16, "purchase_click", funnel_id=3, sec=50, version_float=0.378),   # the same second
               ev(3, 16, "purchase_click", funnel_id=3, sec=50, version_float=0.1)]     # the larger of one time counts
    t = tables(spark, client, server)
    assert FN.user_funnel(t, P0).first().webform_impression_users == 2
    assert FN.execution_funnel(t, P0).first().funnels_webform_impression == 2


def test_asof_with_a_hot_user_hour(spark):
    """A million client rows of one user-hour: windows see one row a second; equal to the naive join."""
    n = 1_000_000
    meta = spark.range(n).select(
        F.lit(1).cast("long").alias("distinct_id"), (F.lit(1_704_067_200.0) + F.pmod(F.xxhash64("id"), F.lit(3_600_000)) / 1000.0).alias("ts_s"),
        F.when(F.col("id") % 3 != 0, (F.col("id") % 977) / 1000.0).alias("version"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("c"), F.col("id") % 11)).alias("country"))
    server = spark.range(300).select(F.lit(1).cast("long").alias("distinct_id"), (F.lit(1_704_067_000) + F.col("id") * 37).alias("request_timestamp"), F.col("id").alias("request_id"))
    got = {r.request_id: (r.client_version_float, r.client_country_code) for r in EN.enrich_event(server, meta).collect()}
    m = meta.orderBy("ts_s").toPandas()
    ts = m.ts_s.to_numpy()
    for r in server.collect():
        want = []
        for c in ("version", "country"):
            known = m[(ts <= r.request_timestamp) & m[c].notna().to_numpy()]
            want.append(known[known.ts_s == known.ts_s.max()][c].max() if len(known) else None)
        assert got[r.request_id] == tuple(want)
    plan = EN.enrich_event(server, meta)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window"):]
    assert re.search(r"Aggregate \[distinct_id#\d+L, sec#\d+L", below)  # windows stand on one row a user and second


def test_null_funnels_are_spread(spark):
    client = [tag(u, 2, "test") for u in range(1, 60)]
    client += [ev(u, 16, "purchase_successful", payment_platform="apple", purchase_id="p", price_usd=1.0) for u in range(1, 60)]  # no funnel
    client += [ev(1, 17, "pre_purchase_click", cta_name="continue", payment_platform="apple", funnel_id=9),
               ev(1, 17, "purchase_successful", payment_platform="apple", purchase_id="p", price_usd=2.0, funnel_id=9)]
    df = C.cohort_funnel(tables(spark, client), P0)
    r = df.first()
    assert (r.apple_purchases, r.apple_revenue, r.apple_paying_users, r.apple_continue) == (1, 2.0, 1, 1)
    assert re.search(r"Join.*\[funnel_id#\d+L, spread#\d+L\]", df._jdf.queryExecution().executedPlan().toString())
