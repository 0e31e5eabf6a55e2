"""CSV sink, and analyses over a table that grows between two calls."""

import os
import tempfile

import __spark_entry__ as E
from funnelkit.sources.readers import write_csv

SF = "/root/testdata/sf0.001"


def test_csv_sink_roundtrip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="fk-csv-"), "daily")
    df = E.queries()["cohort_daily"](spark, SF)
    write_csv(df, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == df.count() and set(back.columns) == set(df.columns)


def test_appended_file_is_seen_by_the_next_call(spark):
    base = tempfile.mkdtemp(prefix="fk-grow-")
    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{base}/{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.where("event_id % 2 = 0").write.parquet(f"{base}/events.parquet")
    query = E.queries()["server_event_enrichment"]
    before = query(spark, base).count()
    events.where("event_id % 2 = 1").write.mode("append").parquet(f"{base}/events.parquet")
    assert query(spark, base).count() == query(spark, SF).count() > before
