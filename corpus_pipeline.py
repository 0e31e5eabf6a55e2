"""From raw documents to packed training sequences, one Parquet table after each stage.

Edge cases are those of the operators: null and empty texts pass the filters, an empty table passes
through, further columns are carried along whatever their names. Rows are told apart by doc_id and text
together: of rows that repeat both one stays, rows of one doc_id with unlike texts are two documents, and
a null doc_id is like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelkit.llm import jaccard, packing, quality, secrets_scan, toxicity
from funnelkit.llm.common import fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "toxicity")
    return toxicity.scored(docs, model, score).filter(F.col(score) < 0.5).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = fresh(docs, *quality.NAMES)
    return quality.resampled(docs, model, tuple(names)).filter(F.col(names[-1])).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the text."""
    out = secrets_scan.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids; in workers that share an executor with what earlier stages left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=100_000, chars=1 << 19)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_copies),
    ("secret scans", redact_secrets),
    ("packing", pack),
]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
