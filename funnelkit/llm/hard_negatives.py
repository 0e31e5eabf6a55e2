"""Hard negatives of labelled vectors: exact integer scores by Strassen products of tiles, best rows in mergeable heaps.

Vectors become integers and are laid out as tiles: ``TILE`` candidates by all components, and
``ANCHORS`` anchors by all components. Every anchor tile meets every candidate tile once (the stated
queries against all rows, in blocks): candidate tiles are dealt to groups, and anchor tiles go to each
group. A task multiplies two tiles by Strassen's seven half-size products, padded with zeros to even
sizes, and keeps per anchor a heap of its best rows that later tiles are merged into; Spark merges the
heaps of the tasks. A first pass finds the positives, a second one the negatives within the window
that each positive's score opens.

Edge cases: rows with a null vec_id, label or vector, or with a null or non-finite component take no
part; of rows that repeat a vec_id the one of smallest label and vector counts; a shorter vector ends
in zeros, so an empty one scores 0; ties go to the smaller vec_id; fewer rows than asked for are all
returned, and an anchor without positives has no rows; where 64 bits may not hold a tile's products,
Python integers do, and a score past 64 bits counts as the largest or smallest one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, written

TILE, ANCHORS, LEAF, HELD = 4096, 512, 16, 100_000
_MOST = 2**63 - 1


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b. Sums may wrap on the way: they are taken modulo 2**64, so a product that fits is exact."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a, b = (np.pad(x, [(0, s % 2) for s in x.shape]) if any(s % 2 for s in x.shape) else x for x in (a, b))
    p, q, r = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:p, :q], a[:p, q:], a[p:, :q], a[p:, q:]
    b11, b12, b21, b22 = b[:q, :r], b[:q, r:], b[q:, :r], b[q:, r:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * p, 2 * r), a.dtype)
    out[:p, :r], out[:p, r:] = m1 + m4 - m5 + m7, m3 + m5
    out[p:, :r], out[p:, r:] = m2 + m4, m1 - m2 + m3 + m6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tiles of whole numbers held as doubles, as int64."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, [(0, 0), (0, width - x.shape[1])]) for x in (a, b))
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    bound = width * int(np.abs(a).max(initial=1)) * int(np.abs(b).max(initial=1))
    if bound <= _MOST:
        return strassen(a.astype(np.int64), np.ascontiguousarray(b.astype(np.int64).T))
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(strassen(whole(a).astype(object), whole(b.T).astype(object)), -_MOST, _MOST).astype(np.int64)


class Heaps:
    """The first k (score descending, then id) of every key; heaps of parts merge into those of the whole."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, key, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows of one tile, ids ascending."""
        if len(score) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            above = np.flatnonzero(score > least)
            take = np.concatenate([above, np.flatnonzero(score == least)[: self.k - len(above)]])
            score, ids = score[take], ids[take]
        if len(score):
            new = sorted(zip((-score).tolist(), ids.tolist(), strict=True))
            old = self.best.get(key)
            self.best[key] = list(islice(heapq.merge(old, new), self.k)) if old else new

    def rows(self) -> Iterator[tuple]:
        for key, found in self.best.items():
            for score, i in found:
                yield (*key, i, -score)
        self.best = {}


def usable(vectors: DataFrame, relabel: str) -> DataFrame:
    """vec_id, label, vec: whole numbers floor(256 * x) as an array of doubles."""
    ok = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))")
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").filter(ok)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.*")
    return rows.select("vec_id", F.expr(relabel).alias("label"), "embedding")


def tiles(rows: DataFrame, size: int, further: str = "") -> DataFrame:
    """Rows as tiles, each sorted by vec_id: tile, ids, labels, width, cells and the ``further`` column (arrays of longs) flattened."""

    def pack(held: list, tile: int) -> pa.RecordBatch:
        held.sort(key=lambda r: r[0])
        width = max(len(r[2]) for r in held)
        cells = np.zeros((len(held), width))
        with np.errstate(over="ignore"):
            for i, r in enumerate(held):
                cells[i, : len(r[2])] = np.floor(np.clip(256.0 * np.array(r[2], np.float64), -1e308, 1e308))
        longs = [np.array([r[k] for r in held], "<i8").tobytes() for k in (0, 1)]
        more = [np.array([r[3] for r in held], "<i8").tobytes()] if further else []
        row = [tile, *longs, width, cells.astype("<f8").tobytes(), *more]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=False)], ["tile", "ids", "labels", "width", "cells", "more"][: len(row)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        names, held, made, task = ["vec_id", "label", "embedding", *([further] if further else [])], [], 0, TaskContext.get().partitionId()
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                held.append(row)
                if len(held) == size:
                    yield pack(held, xxhash.xxh3_64_intdigest(f"{task} {made}") >> 1)
                    held, made = [], made + 1
        if held:
            yield pack(held, xxhash.xxh3_64_intdigest(f"{task} {made}") >> 1)

    return rows.mapInArrow(run, "tile long, ids binary, labels binary, width int, cells binary" + ", more binary" * bool(further))


def _paired(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every anchor tile beside every candidate tile: the latter dealt to groups, the former sent to each group."""
    spark = anchors.sparkSession
    groups = max(1, min(candidates.count(), 4 * spark.sparkContext.defaultParallelism))
    sent = anchors.drop("tile").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = candidates.withColumn("group", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
    dealt = dealt.select("group", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("width").alias("c_width"), F.col("cells").alias("c_cells"))
    return sent.join(dealt, "group").drop("group")


def _best(pairs: DataFrame, k: int, negatives: bool) -> DataFrame:
    """Heaps of the tile pairs as rows: anchor_id, positive_id, positive_score (null for positives), vec_id, score."""
    schema = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        heaps = Heaps(k)

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(heaps.rows())
            for at in range(0, len(rows), 50_000):
                columns = list(zip(*rows[at : at + 50_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                ids, labels, c_ids, c_labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "c_ids", "c_labels"))
                a, c = (np.frombuffer(row[x], "<f8").reshape(-1, w) if (w := row[y]) else np.zeros((n, 0)) for x, y, n in (("cells", "width", len(ids)), ("c_cells", "c_width", len(c_ids))))
                s = scores(a, c)
                wanted = np.frombuffer(row["more"], "<i8").reshape(len(ids), -1, 4) if negatives else None
                for x in range(len(ids)):
                    if not negatives:
                        at = np.flatnonzero((c_labels == labels[x]) & (c_ids != ids[x]))
                        heaps.add((int(ids[x]), None, None), s[x, at], c_ids[at])
                        continue
                    other = np.flatnonzero(c_labels != labels[x])
                    mine = s[x, other]
                    for positive, score, low, high in wanted[x].tolist():
                        if low <= high:
                            at = np.flatnonzero((mine >= low) & (mine <= high))
                            heaps.add((int(ids[x]), positive, score), mine[at], c_ids[other[at]])
                if len(heaps.best) > HELD:
                    yield from out()
        yield from out()

    return pairs.mapInArrow(run, schema)


def _merged(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: str = "vec_id % 100 = 0", relabel: str = "if(vec_id % 7 = 0, (label + 1) % 10, label)", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` picks the anchors, ``relabel`` gives the label; negatives score from ``low`` to
    ``high`` percent of the positive.
    """
    rows = written(usable(vectors, relabel), "vectors")
    candidates = written(tiles(rows, TILE), "candidates")
    chosen = rows.filter(anchors)
    first = _best(_paired(written(tiles(chosen, ANCHORS), "anchors"), candidates), positives, False)
    found = written(_merged(first, ["anchor_id"], positives).select("anchor_id", "vec_id", "score", "rank"), "positives")
    # the window in whole numbers: ceil(low * s / 100) to floor(high * s / 100), null places never open
    wide = F.col("score").cast("decimal(25,0)")
    bounds = found.withColumns({"x": F.ceil(wide * low / 100).cast("long"), "y": F.floor(wide * high / 100).cast("long")})
    lists = bounds.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct(F.col("rank").cast("long"), F.col("vec_id").alias("p"), "score", "x", "y")).alias("l"))
    empty = F.array(*[F.array(*[F.lit(v).cast("long") for v in (0, 0, 1, 0)])])
    flat = F.flatten(F.concat(F.transform("l", lambda e: F.array(e["p"], e["score"], e["x"], e["y"])), F.array_repeat(empty[0], F.greatest(F.lit(0), F.lit(positives) - F.size("l")))))
    asked = chosen.join(lists, "vec_id").select("vec_id", "label", "embedding", flat.alias("windows"))
    second = _best(_paired(written(tiles(asked, ANCHORS, "windows"), "asked"), candidates), negatives, True)
    out = _merged(second, ["anchor_id", "positive_id", "positive_score"], negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)::INTEGER AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
