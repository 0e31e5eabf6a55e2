"""Production layout: canonical tables written partitioned by date; analyses
read them with partition pruning and give the same results."""

import os
import re
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from funnelkit.operators import cohort as C
from funnelkit.operators import experiment as X
from funnelkit.operators import first_purchases as FP
from funnelkit.operators import segments as S
from funnelkit.plans.params import default_params
from funnelkit.sources.binding import Tables, load_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="fk-layout-"), "tables")
    load_tables(spark, SF).materialize(base)
    return Tables.from_parquet(spark, base)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_results_on_partitioned_layout(spark, stored):
    p = default_params()
    bound = load_tables(spark, SF)
    assert _rows(C.cohort_daily(stored, p)) == _rows(C.cohort_daily(bound, p))
    assert _rows(S.purchase_summary(stored, p)) == _rows(S.purchase_summary(bound, p))


def test_date_bounds_prune_partitions(spark, stored):
    df = C.cohort_daily(stored, default_params())
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "client_events" in ln]
    assert scans and all("PartitionFilters: [isnotnull(date" in ln for ln in scans)
    # the analysis window (effective start .. end) prunes directories
    assert any("(date#" in ln and ">= 2024-01-15)" in ln and "<= 2024-01-30)" in ln for ln in scans)


def test_a_heavy_day_gets_more_files(spark, tmp_path):
    t = load_tables(spark, SF)
    by_day = {str(r.date): r["count"] for r in t.client.groupBy("date").count().collect()}
    heavy = max(by_day, key=by_day.get)
    client = t.client.unionByName(t.client.where(F.col("date") == heavy)).unionByName(t.client.where(F.col("date") == heavy))
    replace(t, client=client).materialize(str(tmp_path), rows_per_file=max(by_day.values()))
    files = {d: len([f for f in os.listdir(tmp_path / "client_events" / f"date={d}") if f.endswith(".parquet")]) for d in by_day}
    assert files[heavy] > 1 and all(n == 1 for d, n in files.items() if d != heavy)
    assert Tables.from_parquet(spark, str(tmp_path)).client.count() == client.count()


def test_bucketed_tables_need_no_exchange_by_user(spark, tmp_path):
    load_tables(spark, SF).materialize_bucketed("fkb_", 4, str(tmp_path))
    names = ["client_events", "server_events", "dim_player", "dim_country", "tester_list"]
    t = Tables.from_tables(spark, *[f"fkb_{n}" for n in names])
    p = default_params()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S.segment_users(t, p)
        got = _rows(df)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning\(distinct_id", plan)
        assert got == _rows(S.segment_users(load_tables(spark, SF), p)) and got
        assert _rows(X.experiment_timeline(t, p)) == _rows(X.experiment_timeline(load_tables(spark, SF), p))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS fkb_{n}")


def test_maintained_first_purchases(spark, tmp_path):
    t = load_tables(spark, SF)
    p = default_params()
    whole = _rows(X.first_purchase_date(t))
    parts = [t.client.where(c) for c in ("date < '2024-01-10'", "date between '2024-01-10' and '2024-01-19' and event_id % 3 <> 0",
                                         "date >= '2024-01-20'", "date between '2024-01-10' and '2024-01-19' and event_id % 3 = 0")]
    version = 0
    for rows in parts:  # the last is a late file for days already seen
        version = FP.advance(spark, t, rows, str(tmp_path), version)
    state = FP.read(spark, str(tmp_path), version)
    assert _rows(state) == whole and version == 4
    again = FP.merged(state, FP.state_of(t, parts[0]))  # rows that come twice change nothing
    assert _rows(again) == whole
    kept = FP.bound(t, state)
    assert _rows(X.experiment_timeline(kept, p)) == _rows(X.experiment_timeline(t, p))
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("/events.parquet")
    assert scans(X.experiment_timeline(kept, p)) < scans(X.experiment_timeline(t, p))
