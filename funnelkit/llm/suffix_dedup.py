"""Removal of byte strings of ``LENGTH`` bytes that start in two places, by a partitioned suffix array.

A suffix array over all bytes would be hundreds of times the input, so suffixes are sampled, and without
loss: every window of ``LENGTH`` bytes belongs to the place of the least 8-byte hash (the first of
several) among its first ``AHEAD`` bytes. Equal windows belong to equal places in them, so only suffixes
that start at such places, some 2 / ``AHEAD`` of all, need to meet, each with its windows: the bytes from
the start of its first to the end of its last window. They share ``LENGTH - AHEAD + 1`` leading bytes,
the head. Heads that occur once are left out at the start (counted by hash; a bit table of at most
``MAX_BITS`` bits takes the others to the texts, and where it errs it costs time only).

The other suffixes are range-partitioned by their leading bytes, Spark sampling the splitters; ties go
on to a hash of all bytes and then to the document, so that copies spread. A bucket is sorted by
multikey quicksort on words of 8 bytes. Neighbours' common prefixes then bound the runs of suffixes that
share enough bytes for a window at each distance before the place, and equal bytes before the place
within a run make equal windows. A bucket's first and last run of one head may go on in other buckets:
their windows that found no partner, and one of each kind that did, are compared by digest across
boundaries. Windows become spans of removed bytes, gathered by document.

Edge cases: a null text is empty; texts under ``LENGTH`` bytes stay whole; repeated rows are copies of each
other, so all their windows go; a null doc_id is a document like any other; an empty table gives no rows;
extra columns are ignored. 64-bit hashes of bytes before a place, and 128-bit digests of windows and
documents, are taken to differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, settle, small_batches, table, written

LENGTH, AHEAD, MAX_BITS, BUCKET = 400, 256, 1 << 27, 16 << 20
HEAD = LENGTH - AHEAD + 1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one integer; places past the end read zeros."""
    x = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    return x[: len(data)]


class Places:
    """Sampled places of some texts: text number, place, first and last start of its windows, all within ``data``."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(size) - size
        self.begin, self.data = begin, np.frombuffer(b"".join(texts), np.uint8)
        word = _words(self.data)
        least = word * _C[0]
        least = ((least ^ (least >> np.uint64(29))) * _C[1]) & np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(len(least), dtype=np.uint64)  # the first of equal hashes
        reach = 1
        while reach < AHEAD:
            least = np.minimum(least[:-reach], least[reach:]) if len(least) > reach else least[:0]
            reach *= 2
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), np.maximum(0, size - LENGTH + 1))
        windows = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(0, size - LENGTH + 1)) - np.maximum(0, size - LENGTH + 1), np.maximum(0, size - LENGTH + 1)) + begin[of]
        place = place[windows]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])])) if len(place) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(place)) - 1
        self.text, self.place, self.first, self.last = of[new], place[new], windows[new], windows[last] if len(new) else new
        head = np.zeros(len(new), np.uint64)
        at, left = self.place.copy(), HEAD
        while left > 0:
            w = word[at]
            if left < 8:
                w = w & np.uint64((1 << 8 * left) - 1)
            head = (head ^ (head >> np.uint64(31))) * _C[2] + (w ^ (w >> np.uint64(33))) * _C[3]
            at, left = at + 8, left - 8
        self.head = (head ^ (head >> np.uint64(32))) * _C[1]


def _texts(docs: DataFrame) -> DataFrame:
    """k1, k2 (digest of doc_id and text), text of the documents that hold a window."""
    return keyed(docs).filter(F.octet_length("text") >= LENGTH).select("k1", "k2", "text")


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})


def shared_heads(texts: DataFrame) -> DataFrame:
    """Hashes h of heads with two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for (t,) in rows_of(batches, "text"):
            h, n = np.unique(Places([x.encode() for x in t]).head, return_counts=True)
            yield pa.record_batch([h.view(np.int64), n.astype(np.int64)], ["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def bit_table(heads: DataFrame) -> np.ndarray:
    """Bits of all hashes h, some 16 a hash up to ``MAX_BITS``."""
    heads = written(heads, "heads")
    bits, many = 1 << 16, 16 * heads.count()
    while bits < min(many, MAX_BITS):
        bits *= 2
    at = heads.select(F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(bits - 1)).alias("b"))
    got = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint8)


#: A suffix: its document, place, first and last window; the bytes from the place on, and those before it backwards.
#: A span alone has no bytes and is a removed run [first, last).
_SUFFIXES = "k1 long, k2 long, place long, first long, last long, after binary, before binary"


def suffixes(texts: DataFrame, bits: np.ndarray) -> DataFrame:
    """Sampled suffixes whose heads are shared; one of those that are equal in a batch, the others as spans."""
    held = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        mask = np.uint64(8 * len(held.value) - 1)
        for k1, k2, t in rows_of(batches, "k1", "k2", "text"):
            raw = [x.encode() for x in t]
            p = Places(raw)
            at = (p.head >> np.uint64(20)) & mask
            take = np.flatnonzero((held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            if not len(take):
                continue
            text, place, first, last = p.text[take], p.place[take], p.first[take], p.last[take]
            base = p.begin[text]
            data = p.data.tobytes()
            whole = [(data[a : b + LENGTH], m - a) for a, b, m in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
            seen: dict[tuple, int] = {}
            twin = [seen.setdefault(w, i) for i, w in enumerate(whole)]
            once = np.array([twin[i] == i for i in range(len(twin))])
            copied = np.isin(np.arange(len(twin)), np.array(twin)[~once]) | ~once
            k1, k2 = np.array(k1, np.int64)[text], np.array(k2, np.int64)[text]
            new = np.flatnonzero(once)
            after = [whole[i][0][whole[i][1] :] for i in new]
            before = [whole[i][0][: whole[i][1]][::-1] for i in new]
            places = [pa.array((x - base)[new]) for x in (place, first, last)]
            yield pa.record_batch([pa.array(k1[new]), pa.array(k2[new]), *places, pa.array(after, pa.binary()), pa.array(before, pa.binary())], names)
            if len(gone := np.flatnonzero(copied)):
                none = pa.nulls(len(gone), pa.binary())
                yield pa.record_batch([pa.array(k1[gone]), pa.array(k2[gone]), pa.array((place - base)[gone]), pa.array((first - base)[gone]), pa.array((last - base)[gone] + LENGTH), none, none], names)

    names = [x.split()[0] for x in _SUFFIXES.split(", ")]
    return texts.mapInArrow(run, _SUFFIXES)


def multikey_quicksort(words: np.ndarray, strings: list[bytes], few: int = 24) -> np.ndarray:
    """Order of strings, given also as rows of big-endian words: ranges are split in three by one word at a time."""
    out, done = np.empty(len(words), np.int64), 0
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        while len(rows) > few and depth < words.shape[1]:
            key = words[rows, depth]
            pivot = np.sort(key[[0, len(key) // 2, len(key) - 1]])[1]
            below, above = key < pivot, key > pivot
            low, same, high = rows[below], rows[~below & ~above], rows[above]
            if len(high):
                stack.append((high, depth))
            if len(low):
                stack.append((same, depth + 1))
                rows = low
            else:
                rows, depth = same, depth + 1
        # few rows, or equal in all words: zeros that pad a word can't be told from zeros of the text, so by the strings
        rows = np.array(sorted(rows.tolist(), key=strings.__getitem__), np.int64)
        out[done : done + len(rows)] = rows
        done += len(rows)
    return out


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)


def _common(strings: list[bytes], cells: np.ndarray) -> np.ndarray:
    """Common prefix lengths of neighbours."""
    differ = cells[1:] != cells[:-1]
    size = np.array([len(s) for s in strings])
    return np.minimum(np.where(differ.any(1), differ.argmax(1), cells.shape[1]), np.minimum(size[1:], size[:-1]))


def compare(after: list[bytes], before: list[bytes], first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of sorted suffixes as (row, distance of the place from the window's start), and whether an equal one is among them.

    ``first`` and ``last`` are the greatest and least distances of a row's windows.
    """
    n = len(after)
    cells = _padded(after, LENGTH)
    common = _common(after, cells)
    back = _padded(before, AHEAD) if before else np.zeros((0, AHEAD), np.uint8)
    h = np.zeros(n, np.uint64)
    rows, far, equal = [], [], []
    for distance in range(AHEAD):
        if distance:  # hash of the bytes before the place, as many as the distance
            h = (h ^ (h >> np.uint64(29))) * _C[0] + (back[:, distance - 1].astype(np.uint64) + np.uint64(1)) * _C[1]
        has = np.flatnonzero((first >= distance) & (last <= distance))
        if not len(has):
            continue
        run = np.concatenate([[0], np.cumsum(common < LENGTH - distance)])[has]
        order = np.lexsort((h[has], run))
        new = np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (h[has][order][1:] != h[has][order][:-1])])
        group = np.cumsum(new) - 1
        rows.append(has[order].astype(np.int32))
        far.append(np.full(len(has), distance, np.int32))
        # 0: alone; 1: the first of several equal windows; 2: another of them
        many = np.bincount(group)[group] > 1
        equal.append(np.where(many, np.where(new, 1, 2), 0).astype(np.int8))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(far), np.concatenate(equal)


#: A removed run [a, b) of a document; or (d1, d2 set) a window that starts at a, b its state, to be compared across buckets.
_FOUND = "k1 long, k2 long, a long, b long, d1 long, d2 long"


def bucket_spans(sorted_by_range: DataFrame) -> DataFrame:
    """Removed runs found in each bucket, and windows of its outer heads to compare with other buckets'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held = pa.Table.from_batches(list(batches), schema=None) if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        after, before = held.column("after").to_pylist(), held.column("before").to_pylist()
        order = multikey_quicksort(_padded(after, LENGTH).view(">u8"), after)
        after, before = [after[i] for i in order], [before[i] for i in order]
        k1, k2, place, first, last = (held.column(c).to_numpy()[order] for c in ("k1", "k2", "place", "first", "last"))
        del held
        rows, far, equal = compare(after, before, place - first, place - last)
        # runs of equal distance steps become one span
        hit = np.flatnonzero(equal > 0)
        r, d = rows[hit], far[hit]
        o = np.lexsort((-d, r))
        r, start = r[o], place[r[o]] - d[o]
        if len(r):
            new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (start[1:] != start[:-1] + 1)]))
            end = start[np.append(new[1:], len(r)) - 1] + LENGTH
            none = pa.nulls(len(new), pa.int64())
            yield pa.record_batch([k1[r[new]], k2[r[new]], start[new], end, none, none], names)
        edge = np.array([a.startswith((after[0][:HEAD], after[-1][:HEAD])) for a in after])
        open_ = np.flatnonzero(edge[rows] & (equal < 2))
        for at in range(0, len(open_), 50_000):
            part = open_[at : at + 50_000]
            digest = [hashlib.blake2b(before[i][:j][::-1] + after[i][: LENGTH - j], digest_size=16).digest() for i, j in zip(rows[part].tolist(), far[part].tolist(), strict=True)]
            digest = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            i = rows[part]
            yield pa.record_batch([k1[i], k2[i], place[i] - far[part].astype(np.int64), equal[part].astype(np.int64), digest[:, 0].copy(), digest[:, 1].copy()], names)

    names = [x.split()[0] for x in _FOUND.split(", ")]
    return sorted_by_range.mapInArrow(run, _FOUND)


def removed(docs: DataFrame) -> DataFrame:
    """k1, k2, spans: for each document with repeated windows (by digest of doc_id and text), its removed runs, unmerged."""
    texts = _texts(docs)
    with small_batches(docs.sparkSession):
        bits = bit_table(shared_heads(texts))
    found = written(suffixes(texts, bits), "suffixes")
    rows = found.filter("after is not null")
    buckets = max(1, -(-rows.count() * (LENGTH + AHEAD) // BUCKET))
    leading = F.substring("after", 1, HEAD + 15)  # a short key, as the splitters' sample goes through the driver
    dealt = rows.repartitionByRange(buckets, leading, F.xxhash64("after", "before"), "k1", "place")
    spans = written(bucket_spans(dealt), "spans")
    across = spans.filter("d1 is not null")
    twice = across.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1")
    across = across.filter("b = 0").join(twice, ["d1", "d2"]).select("k1", "k2", "a", (F.col("a") + LENGTH).alias("b"))
    every = spans.filter("d1 is null").select("k1", "k2", "a", "b").unionByName(across)
    every = every.unionByName(found.filter("after is null").selectExpr("k1", "k2", "first a", "last b"))
    return every.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text (the remaining bytes, which may end within a character), spans (maximal removed runs [a, b)) and n_bytes."""
    rows = keyed(docs)
    gone = removed(docs)
    short = rows.filter(F.octet_length("text") < LENGTH).select("doc_id", "text", F.expr("cast(null as array<struct<a: bigint, b: bigint>>)").alias("spans"))
    long = rows.filter(F.octet_length("text") >= LENGTH).join(gone, ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for ids, spans, texts in rows_of(batches, "doc_id", "spans", "text"):
            left, runs, sizes = [], [], []
            for s, t in zip(spans, texts, strict=True):
                raw = t.encode()
                merged: list[list[int]] = []
                for x in sorted((x["a"], x["b"]) for x in s or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                ends = [0, *(b for _, b in merged)]
                left.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(raw)], strict=True)))
                runs.append([{"a": a, "b": b} for a, b in merged])
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(left, pa.binary()), pa.array(runs, kind), pa.array(sizes, pa.int64())], ["doc_id", "text", "spans", "n_bytes"])

    return short.unionByName(long).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, text binary, spans array<struct<a: bigint, b: bigint>>, n_bytes long")


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    gone = F.expr("aggregate(spans, 0L, (n, x) -> n + x.b - x.a)")
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (SELECT rid, i, md5(t[i + 1:i + 400]) AS k FROM (SELECT rid, t, unnest(range(0, octet_length(t) - 399)) AS i FROM d WHERE octet_length(t) >= 400)),
hits AS (SELECT rid, i FROM starts SEMI JOIN (SELECT k FROM starts GROUP BY k HAVING count(*) > 1) USING (k)),
fresh AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS run FROM fresh),
gone AS (SELECT rid, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM gone),
per AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(hex(t[before + 1:a]), '' ORDER BY a) AS kept FROM gaps JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN hex(t) ELSE kept || hex(t[last + 1:octet_length(t)]) END)) AS kept_sha256
FROM d LEFT JOIN per USING (rid)
"""
