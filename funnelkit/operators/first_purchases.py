"""Each user's first purchase day as a maintained table, advanced by new rows only (A23 at scale).

A user's first day is a minimum, so tables of it merge: the state of all rows seen so far and that of
new rows give the state of both, in whatever order and however often rows come.  A day of new data, or
a late file for an old day, costs its own rows and one join-free aggregate with the state, not a scan of
the history.  States are versions under a folder; a version is complete once Spark has committed it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.operators.experiment import first_purchase_date
from funnelkit.sources.binding import Tables

SCHEMA = "distinct_id long, first_purchase_date date"


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows that any of the states has seen."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("distinct_id").agg(F.min("first_purchase_date").alias("first_purchase_date"))


def state_of(t: Tables, rows: DataFrame) -> DataFrame:
    """The state of some client rows alone."""
    return first_purchase_date(replace(t, client=rows, first_purchases=None))


def read(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{folder}/v{version}")


def advance(spark: SparkSession, t: Tables, rows: DataFrame, folder: str, version: int) -> int:
    """Writes the next version: ``version`` (0: none yet) brought forward by ``rows``, new client rows of any day."""
    new = state_of(t, rows)
    state = merged(read(spark, folder, version), new) if version else new
    state.select("distinct_id", "first_purchase_date").write.parquet(f"{folder}/v{version + 1}")
    return version + 1


def bound(t: Tables, state: DataFrame) -> Tables:
    """``t`` whose analyses take first purchases from the state."""
    return replace(t, first_purchases=state)
