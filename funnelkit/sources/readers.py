"""Table readers and result sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Read one table of a directory of Parquet tables (``<base>/<name>.parquet``
    file or directory).  Column pruning and filter pushdown reach the scan
    because nothing is selected eagerly here."""
    path = os.path.join(base, f"{name}.parquet")
    if not os.path.exists(path) and os.path.isdir(os.path.join(base, name)):
        path = os.path.join(base, name)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV export of a result, header included, written in parallel.

    ``single_file`` draws a small result together into one file.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sink, optionally partitioned (e.g. by ``date``) for later pruning."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
