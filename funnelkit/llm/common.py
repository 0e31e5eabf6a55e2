"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from itertools import count
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may do without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    return [next(c for i in count() if (c := n + "_" * i).lower() not in taken) for n in names]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """Smaller Arrow batches for the jobs inside, as rows here are whole texts or sets."""
    want = {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": size}
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle() -> None:
    """At a task's start: frees what earlier tasks left in this Python worker, as code sent by value holds cycles.

    Later collections are rare: operators make millions of small objects, hardly any in cycles.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # the C library keeps freed memory unless it is asked for it
        ctypes.CDLL(None).malloc_trim(0)
    gc.set_threshold(500_000, 20, 20)


def kept(key: tuple, make: Callable[[], T]) -> T:
    """One object per worker process, made at its first use.

    Code sent by value is new in every task, so its modules can't hold what outlives one.
    """
    store = sys.__dict__.setdefault("_kept_between_tasks", {})
    if key not in store:
        store[key] = make()
    return store[key]


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes.

    ``bytes.lower`` changes ASCII letters only and ``bytes.split`` splits at exactly those six characters.
    """
    return text.encode().lower().split() if text else []


def spans(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive rows holding about ``chars`` characters, one row at least."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= chars:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str, chars: int = 1 << 20) -> Iterator[list[list]]:
    """The named columns of Arrow batches as Python lists, in runs of about ``chars`` bytes of the last one."""
    for batch in batches:
        held = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        texts = held[-1]
        if texts.type in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            a = total = 0
            for i, n in enumerate(sizes):
                total += n
                if total >= chars or i + 1 == len(sizes):
                    yield [c.slice(a, i + 1 - a).to_pylist() for c in held]
                    a, total = i + 1, 0
        elif len(texts):
            yield [c.to_pylist() for c in held]


def with_columns(docs: DataFrame, added: str, run) -> DataFrame:
    """``docs`` with columns that ``run()``, called once a task, gives a function from texts to Arrow arrays for.

    A column of the same name is replaced. ``text`` may hold nulls.
    """
    names = [f.split()[0] for f in added.split(", ")]
    kept = docs.drop(*names)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], added])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        function = run()
        for batch in batches:
            at = 0
            for (texts,) in rows_of(iter([batch]), "text"):
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.record_batch([*part.columns, *function(texts)], [*part.schema.names, *names])

    return kept.mapInArrow(each, schema)


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, where: str = "true") -> DataFrame:
    """``docs`` that have a label, ``rows`` at most (the first in an order by hash), so that the labels can be broadcast."""
    known = labels.filter(f"{column} is not null and doc_id is not null").filter(where)
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def forget(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``written`` made and nothing reads any more."""
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
