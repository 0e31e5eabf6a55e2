"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Features of a text are n-grams of its words, of their shapes, and of flags that say whether a word or
its 5-gram was there before; each is hashed into a bucket. The raw model counts every document, the
target model documents labelled good. A document's log importance is the sum over its features of
log(target / raw), each bucket's ratio shrunk towards 1 by ``PRIOR`` expected counts. With Gumbel
noise added, the k largest are a sample without replacement in proportion to importance; k is the
number of documents at or above the level that parts good from bad labelled ones best.

Bounds: at most ``LABELS`` labelled rows are fitted on; counts have a fixed number of buckets. Edge
cases: a null or empty text has no features and log importance 0; repeated rows get the same
verdict; without labels of both kinds every document stays; an empty table gives no rows. Columns
beside doc_id and text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, rows_of, settle, small_batches, table, with_columns

LABELS, PRIOR, CACHE = 20_000, 8.0, 200_000
WORDS, SHAPES, FLAGS = 1 << 15, 1 << 13, 1 << 8
BUCKETS = 2 * WORDS + SHAPES + FLAGS
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Kinds of a word's characters, runs of one kind drawn together."""
    kinds = "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word])
    return _RUN.sub(r"\1\1", kinds)


class Featurizer:
    """Bucket numbers of all features of a text."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self._slot: dict[str, int] = {}
        self._word, self._shape = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self._slot) > CACHE:
            self._clear()
        cut = [t.split() if t else [] for t in texts]
        new = list(set().union(*cut) - self._slot.keys())
        self._slot.update(zip(new, range(len(self._slot), len(self._slot) + len(new)), strict=True))
        self._word = np.concatenate([self._word, np.array([xxhash.xxh3_64_intdigest(w.lower().encode()) for w in new], np.uint64)])
        self._shape = np.concatenate([self._shape, np.array([xxhash.xxh32_intdigest(shape(w).encode()) for w in new], np.int64)])
        return [self._one(np.fromiter(map(self._slot.__getitem__, c), np.int64, len(c))) for c in cut]

    def _one(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros(0, np.int64)
        w, s = self._word[at], self._shape[at]
        two = (w[:-1] * _A ^ w[1:]) * _B
        pairs = s[:-1] * 31 + s[1:] + 7
        again = np.zeros(len(at), np.int64)  # this word once more, and how much of what came before came again
        again[1:] = w[1:] == w[:-1]
        if len(at) > 4:
            five = (((two[:-3] * _A ^ two[2:-1]) * _B) ^ w[4:]) * _A
            _, first, whose = np.unique(five, return_index=True, return_inverse=True)
            again[4:] += 2 * (first[whose] != np.arange(len(five)))
        flags = again * 8 + np.minimum(7, np.log2(len(at)).astype(np.int64) // 2)
        return np.concatenate(
            [
                (w >> np.uint64(49)).astype(np.int64),
                WORDS + (two >> np.uint64(49)).astype(np.int64),
                2 * WORDS + np.concatenate([s, pairs]) % SHAPES,
                2 * WORDS + SHAPES + flags,
            ]
        )


class ImportanceModel:
    """log(target / raw) per bucket, and the level a document must reach with its Gumbel noise."""

    def __init__(self, ratio: np.ndarray, level: float):
        self.ratio, self.level = ratio, level


def gumbel(doc_id: str = "doc_id"):
    """Standard Gumbel noise that depends on the document's id alone."""
    uniform = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(9)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    return -F.log(-F.log(uniform))


def fit(docs: DataFrame, labels: DataFrame) -> ImportanceModel:
    known = labelled(docs, labels, "quality", LABELS)

    def counts(of: DataFrame) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features, total = Featurizer(), np.zeros(BUCKETS, np.int64)
            settle()
            for (texts,) in rows_of(batches, "text"):
                total += np.bincount(np.concatenate([np.zeros(0, np.int64), *features(texts)]), minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["b", "c"])

        out = np.zeros(BUCKETS)
        with small_batches(of.sparkSession):
            rows = of.select("text").mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect()
        for b, c in rows:
            out[b] = c
        return out

    target, raw = counts(known.filter("y = 1")), counts(docs)
    ends = [0, WORDS, 2 * WORDS, 2 * WORDS + SHAPES, BUCKETS]
    ratio = np.zeros(BUCKETS)
    for a, b in zip(ends[:-1], ends[1:], strict=True):  # each kind of feature has its own two models
        expected = raw[a:b] * (target[a:b].sum() / max(1.0, raw[a:b].sum()))
        ratio[a:b] = np.log((target[a:b] + PRIOR) / (expected + PRIOR))
    model = ImportanceModel(ratio.astype(np.float32), float("-inf"))
    with small_batches(docs.sparkSession):
        rows = scored(known, model).select("y", F.col("log_importance") + gumbel()).toPandas()
    y, key = rows.iloc[:, 0].to_numpy(), rows.iloc[:, 1].to_numpy()
    if not target.any() or not (y == 0).any():
        return model
    order = np.argsort(key)
    y, key = y[order], key[order]
    # rejecting everything below key[i]: how many bad ones go, less the good ones that go
    gain = np.concatenate([[0], np.cumsum(y == 0)[:-1]]) / (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 1)[:-1]]) / (y == 1).sum()
    model.level = float(key[np.flatnonzero(gain >= gain.max() - 0.005)[0]])
    return model


NAMES = ("log_importance", "sample_key", "kept")


def scored(docs: DataFrame, model: ImportanceModel, name: str = NAMES[0]) -> DataFrame:
    """``docs`` with the log importance as a column ``name``, in place of one of that name."""

    def run():
        features, ratio = Featurizer(), model.ratio
        return lambda texts: [pa.array([float(ratio[f].sum(dtype=np.float64)) for f in features(texts)], pa.float64())]

    return with_columns(docs, f"{name} double", run)


def resampled(docs: DataFrame, model: ImportanceModel, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``docs`` with log importance, sample key and kept (among the k largest keys) as columns of these names."""
    score, key, kept = names
    out = scored(docs, model, score).withColumn(key, F.col(score) + F.coalesce(gumbel(), F.lit(0.0)))
    return out.withColumn(kept, F.col(key) >= F.lit(model.level))


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampled(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
