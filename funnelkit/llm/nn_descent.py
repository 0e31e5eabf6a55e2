"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node. The first graph comes from ``TREES`` random hyperplane codes: nodes are
sorted by code and cut into blocks of ``BLOCK``, and a block is compared as a whole. NN-descent
then joins neighbours of neighbours: every node brings its best forward and backward neighbours
together, but for pairs that met there in the round before, and each keeps what is better than it
had. Rounds end when less than ``STOP`` of all list entries are new. A query starts at its own node
and greedily expands the best of its list until the list stays as it is. Every list has a fixed
length, so no step sees an unbounded group; hubs keep their best backward neighbours.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part;
equal vectors rank by id; repeated vec_ids count once; fewer candidates than asked for are all
returned; an empty table gives no rows. Extra columns are ignored. Vectors must be of one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

TREES, BLOCK, LIST, JOIN, STOP = 16, 4096, 32, 12, 0.001
EXPAND = 24
NODES, LISTS = "node long, vec binary", "node long, ids binary, scores binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec and the digest k1, k2 of every row that takes part."""
    e = F.col("embedding").cast("array<float>")
    ok = F.expr("size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = vectors.filter("vec_id is not null and embedding is not null").filter(ok).select("vec_id", e.alias("embedding")).dropDuplicates(["vec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.array(x, "<f4").tobytes() for x in b.column("embedding").to_pylist()]
            yield pa.record_batch([b.column("vec_id"), pa.array(data, pa.binary())], ["vec_id", "vec"])

    out = rows.mapInArrow(run, "vec_id long, vec binary")
    return out.withColumns({"k1": F.xxhash64("vec"), "k2": F.xxhash64("vec", F.lit(1))})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<f4").reshape(len(data), -1) if data else np.zeros((0, 1), np.float32)


def _best(node: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best distinct ids of each node, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, node))
    node, ids, scores = node[order], ids[order], scores[order]
    seen = np.lexsort((np.arange(len(node)), ids, node))
    first = np.ones(len(node), bool)
    same = (node[seen][1:] == node[seen][:-1]) & (ids[seen][1:] == ids[seen][:-1])
    first[seen[1:][same]] = False
    node, ids, scores = node[first], ids[first], scores[first]
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
    size = np.diff(start, append=len(node))
    take = np.arange(len(node)) - np.repeat(start, size) < k
    node, ids, scores = node[take], ids[take], scores[take]
    some, at = np.unique(node, return_index=True)
    ends = np.append(at[1:], len(node)) if len(node) else at
    pieces = [(ids[a:b].astype("<i8").tobytes(), scores[a:b].astype("<f8").tobytes()) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    return pa.record_batch([pa.array(some, pa.int64()), pa.array([p for p, _ in pieces], pa.binary()), pa.array([p for _, p in pieces], pa.binary())], ["node", "ids", "scores"])


def _by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups of rows that come sorted by ``key``; a group has a bounded number of rows."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = t.column(key).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k best per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "node"):
            ids = [np.frombuffer(x, "<i8") for x in t.column("ids").to_pylist()]
            scores = [np.frombuffer(x, "<f8") for x in t.column("scores").to_pylist()]
            node = np.repeat(t.column("node").to_numpy(), [len(x) for x in ids])
            yield _best(node, np.concatenate(ids), np.concatenate(scores), k)

    return lists.repartition("node").sortWithinPartitions("node").mapInArrow(run, LISTS)


def first_graph(nodes: DataFrame, count: int) -> DataFrame:
    """Lists from blocks of nodes with like hyperplane codes."""
    depth = max(0, math.ceil(math.log2(max(1, count) / BLOCK)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vec"))
            for t in range(TREES):
                planes = np.random.default_rng(1000 + t).standard_normal((x.shape[1], depth + 1)).astype(np.float32)
                side = x @ planes
                bits = ((side[:, :depth] > 0) << np.arange(depth)).sum(1) if depth else np.zeros(len(x))
                yield pa.record_batch([pa.array(np.full(len(x), t, np.int32)), pa.array(bits.astype(np.int64)), pa.array(side[:, depth]), b.column("node"), b.column("vec")], ["tree", "code", "line", "node", "vec"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def block(t: pa.Table) -> pa.RecordBatch:
            x, node = _matrix(t.column("vec")), t.column("node").to_numpy()
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            k = min(LIST, len(node) - 1)
            if k < 1:
                return _best(node[:0], node[:0], np.zeros(0), 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            return _best(np.repeat(node, k), node[top].ravel(), np.take_along_axis(s, top, 1).ravel().astype(np.float64), k)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            while t.num_rows:
                tree = t.column("tree").to_numpy()
                n = min(int(np.searchsorted(tree, tree[0], side="right")), BLOCK)
                if n == t.num_rows and n < BLOCK:
                    break
                yield block(t.slice(0, n))
                t = t.slice(n)
            rest = t
        if rest is not None and rest.num_rows:
            yield block(rest)

    coded = nodes.mapInArrow(code, "tree int, code long, line float, node long, vec binary")
    parts = max(TREES, TREES * count // (1 << 14))
    blocks = coded.repartitionByRange(parts, "tree", "code", "line").sortWithinPartitions("tree", "code", "line", "node")
    return merged(blocks.mapInArrow(compare, LISTS), LIST)


def edges(graph: DataFrame, k: int) -> DataFrame:
    """node, other, score of the k best of every list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, "<i8")[:k] for x in b.column("ids").to_pylist()]
            scores = [np.frombuffer(x, "<f8")[:k] for x in b.column("scores").to_pylist()]
            if ids:
                node = np.repeat(b.column("node").to_numpy(), [len(x) for x in ids])
                yield pa.record_batch([pa.array(node), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["node", "other", "score"])

    return graph.mapInArrow(run, "node long, other long, score double")


def meetings(graph: DataFrame) -> DataFrame:
    """node, other: the best forward and backward neighbours that each node brings together."""
    forward = edges(graph, JOIN)
    best = Window.partitionBy("other").orderBy(F.desc("score"), "node")
    backward = forward.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= JOIN)
    return forward.select("node", "other").unionByName(backward.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def descend(graph: DataFrame, nodes: DataFrame, pairs: DataFrame, before: DataFrame | None) -> DataFrame:
    """One round: neighbours that meet at a node (``pairs``) are compared, unless both were there in the round before."""
    flagged = pairs.withColumn("old", F.lit(False))
    if before is not None:
        flagged = pairs.join(before.withColumn("old", F.lit(True)), ["node", "other"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
        flagged = flagged.join(flagged.filter(~F.col("old")).select("node").distinct(), "node", "left_semi")
    met = flagged.join(nodes.select(F.col("node").alias("other"), "vec"), "other").select("node", "other", "vec", "old")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "node"):
            x, other, node, old = _matrix(t.column("vec")), t.column("other").to_numpy(), t.column("node").to_numpy(), t.column("old").to_numpy()
            bounds = np.append(np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])), len(node))
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                s = x[a:b] @ x[a:b].T
                np.fill_diagonal(s, -np.inf)
                s[np.outer(old[a:b], old[a:b])] = -np.inf
                k = min(JOIN, b - a - 1)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                scores = np.take_along_axis(s, top, 1).ravel()
                ok = scores > -np.inf
                out.append((np.repeat(other[a:b], k)[ok], other[a:b][top].ravel()[ok], scores[ok]))
            if out:
                who, ids, scores = (np.concatenate(c) for c in zip(*out, strict=True))
                yield _best(who, ids, scores.astype(np.float64), LIST)

    found = met.repartition("node").sortWithinPartitions("node").mapInArrow(run, LISTS)
    return merged(graph.unionByName(found), LIST)


def changed(before: DataFrame, after: DataFrame) -> float:
    """Share of list entries of ``after`` that ``before`` doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = total = 0
            for ids, was in zip(b.column("ids").to_pylist(), b.column("was").to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<i8")
                new += len(np.setdiff1d(ids, np.frombuffer(was or b"", "<i8")))
                total += len(ids)
            yield pa.record_batch([pa.array([new], pa.int64()), pa.array([total], pa.int64())], ["new", "total"])

    rows = after.select("node", "ids").join(before.select("node", F.col("ids").alias("was")), "node", "left")
    new, total = rows.select("ids", "was").mapInArrow(run, "new long, total long").agg(F.sum("new"), F.sum("total")).first()
    return new / total if total else 0.0


def build(nodes: DataFrame) -> DataFrame:
    """The neighbour graph (``LISTS``) over nodes (``NODES``)."""
    graph, before = written(first_graph(nodes, nodes.count()), "graph"), None
    while True:
        pairs = written(meetings(graph), "pairs")
        last, graph = graph, written(descend(graph, nodes, pairs, before), "graph")
        before = pairs
        if changed(last, graph) < STOP:
            return graph


def search(graph: DataFrame, nodes: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """Lists of the k best of each node in ``starts``, by greedy rounds from its own; scores are exact."""
    vec = starts.join(nodes, "node").select("node", "vec")
    # a node without a list, as where all vectors are equal, still starts at itself
    none = F.lit(b"").cast("binary")
    now = starts.join(graph, "node", "left").select("node", F.coalesce("ids", none).alias("ids"), F.coalesce("scores", none).alias("scores"))
    known = edges(now, LIST).select("node", "other")
    ended = []
    while True:
        steps = edges(now, EXPAND).select(F.col("node").alias("q"), F.col("other").alias("node"))
        reached = steps.join(graph, "node").select("q", "ids")

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = [np.frombuffer(x, "<i8") for x in b.column("ids").to_pylist()]
                if ids:
                    yield pa.record_batch([pa.array(np.repeat(b.column("q").to_numpy(), [len(x) for x in ids])), pa.array(np.concatenate(ids))], ["node", "other"])

        asked = reached.mapInArrow(flat, "node long, other long").unionByName(known).unionByName(starts.select("node", F.col("node").alias("other"))).distinct()
        rows = asked.join(nodes.select(F.col("node").alias("other"), "vec"), "other").select("node", "other", "vec", F.lit(1).alias("kind"))
        rows = rows.unionByName(vec.select("node", F.lit(-1).cast("long").alias("other"), "vec", F.lit(0).alias("kind")))

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _by_group(batches, "node"):
                x, node, other, kind = _matrix(t.column("vec")), t.column("node").to_numpy(), t.column("other").to_numpy(), t.column("kind").to_numpy()
                own = np.maximum.accumulate(np.where(kind == 0, np.arange(len(kind)), 0))
                at = np.flatnonzero(kind == 1)
                scores = np.concatenate([(x[p].astype(np.float64) * x[own[p]]).sum(1) for p in np.array_split(at, max(1, len(at) // 4096))])
                yield _best(node[at], other[at], scores, max(k, LIST))

        ranked = rows.repartition("node").sortWithinPartitions("node", "kind").mapInArrow(rank, LISTS)
        last, now = now.select("node", F.col("ids").alias("was")), written(ranked, "found")
        both = written(now.join(last, "node").withColumn("same", F.col("ids") == F.col("was")).drop("was"), "rounds")
        ended.append(both.filter("same").drop("same"))
        now = both.filter("not same").drop("same")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, ended)
        starts = now.select("node")
        vec = starts.join(nodes, "node").select("node", "vec")
        known = edges(now, max(k, LIST)).select("node", "other")


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vec_id in ``queries``."""
    rows = written(usable(vectors), "vectors")
    order = Window.partitionBy("k1", "k2").orderBy("vec_id")
    copies = rows.select("k1", "k2", "vec_id").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    heads = copies.filter("r = 1").select("k1", "k2", F.col("vec_id").alias("node"))
    copies = written(copies.join(heads, ["k1", "k2"]).select("node", "vec_id"), "copies")
    nodes = written(rows.join(heads.select(F.col("node").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("node"), "vec"), "nodes")
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id").select("k1", "k2", F.col("vec_id").alias("query_id")).join(heads, ["k1", "k2"])
    asked = written(asked.select("query_id", "node"), "queries")
    found = search(build(nodes), nodes, asked.select("node").distinct(), k + 1)
    each = edges(found, k + 1).withColumnRenamed("node", "q").withColumnRenamed("other", "node")
    each = each.join(copies, "node").select("q", "vec_id", "score")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    out = asked.join(each.withColumnRenamed("q", "node"), "node").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)
