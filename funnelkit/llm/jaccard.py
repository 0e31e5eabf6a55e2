"""N-gram Jaccard join: blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are classes of documents with the same set of 5-word shingles; columns are
64-bit shingle hashes. All shingles are put in one order (common ones last, by exact counts of 42 bits
of their hashes), and by the usual bound two sets with Jaccard >= 0.75 share a shingle among the first
quarter of each, so only that part of the incidence is multiplied. For the counts, items go by their
first bits to where they are counted, and those that other rows have too come back to their rows; a row
whose own items fill its first quarter has no links and drops out. It is dealt out by column: a task multiplies its block of columns, adds
up overlap counts per pair, and counts are summed over blocks. A pair whose count, with all that may
follow the counted part, can't reach the overlap its sizes ask for is discarded; the whole rows of
the others are multiplied, which decides exactly.

Only links matter, not all pairs of a group. A column of up to ``SMALL`` classes gives all its
pairs. A larger one gives each class with the next few and with the first; then rounds over ever
larger distances take up the columns whose classes are not yet in one component, and end when none
is left or every pair of such a column was looked at; a pair whose parity sketches differ in too many
bits can't link and goes no further. Very common columns are dealt out in blocks, and every row of them stays; the rounds join what the blocks keep
apart, also pairs that the first round's count, short of what other blocks hold, discarded. Nothing
is capped.

Edge cases: a null or empty text, or one without words, has an empty set and no links; with fewer
than five words its whole sequence is the one shingle; repeated doc_ids are one node; a null doc_id
links with nothing and its component is null; an empty table gives no rows. Extra columns of the
input are ignored. 64-bit hashes of distinct shingles are taken to differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, fresh, rows_of, settle, small_batches, table, words, written

SHINGLE, SMALL, NEAR, BLOCK = 5, 33, 3, 4096
SPLIT, ROWS, SKETCH, BITS, CACHE = 10, 1 << 16, 1024, 1 << 22, 200_000
_CHUNKS = "bucket int, chunk long, cols binary, at binary, more binary"
_CHUNK_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words, of the whole sequence if it is shorter."""
    k = min(size, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    z = np.full(n, np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1)))
    for i in range(k):  # each place has its own mixing, so order counts
        w = hashes[i : i + n] * _MIX[i % 5] + np.uint64(i // 5)
        z += (w ^ (w >> np.uint64(31))) * _MIX[(i + 1) % 5]
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(z ^ (z >> np.uint64(32)))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1, k2 (128-bit digest of the set), items (sorted uint64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        settle()
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            cut = [words(t) for t in texts]
            if len(seen) > CACHE:
                seen.clear()
            for w in set().union(*cut) - seen.keys():
                seen[w] = xxhash.xxh3_64_intdigest(w)
            items = [shingle_hashes(np.fromiter(map(seen.__getitem__, c), np.uint64, len(c))) for c in cut]
            data = [x.tobytes() for x in items]
            keys = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in data]), "<i8").reshape(-1, 2)
            n = pa.array([len(x) for x in items], pa.int32())
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), n, keys[:, 0], keys[:, 1], pa.array(data, pa.binary())], ["doc_id", "n", "k1", "k2", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, k1 long, k2 long, items binary")


def _bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def _bitmap(ids: DataFrame, column: str) -> DataFrame:
    """A bitmap of fixed size that has the hashes of all ids, and may have others': w, m (its words of 64 bits that aren't 0)."""
    bits = ids.select(_bit(column).alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("w"))
    return written(bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m")), "bitmap")


def _marked(sets: DataFrame, bitmap: DataFrame, want: bool) -> DataFrame:
    """Rows of ``sets`` whose doc_id's bit is set, or isn't; the bitmap that goes to tasks has at most BITS / 64 rows."""
    taken = {c.lower() for c in sets.columns}
    w, m = (next(n for i in count() if (n := f"{x}{i}") not in taken) for x in "wm")
    rows = sets.withColumn(w, F.shiftright(_bit("doc_id"), 6).cast("int"))
    rows = rows.join(F.broadcast(bitmap.toDF(w, m)), w, "left")
    is_set = F.expr(f"coalesce(shiftright({m}, cast(pmod(xxhash64(doc_id), {BITS}) & 63 as int)) & 1, 0) = 1")
    return rows.filter(is_set if want else ~is_set).select(*sets.columns)


def _dealt(sets: DataFrame) -> DataFrame:
    """Items of chunks of rows, dealt out by their first bits: 32 more bits of each, and its row as steps.

    Each chunk also has a row without ``cols`` that holds its doc ids and set sizes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        chunk = TaskContext.get().partitionId() << 32
        for doc_ids, sizes, data in rows_of(batches, "doc_id", "n", "items", chars=1 << 22):
            for k in range(0, len(data), ROWS):
                n = np.array(sizes[k : k + ROWS], np.int32)
                items = np.frombuffer(b"".join(data[k : k + ROWS]), np.uint64)
                bucket = (items >> np.uint64(64 - SPLIT)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                cols = (items >> np.uint64(32 - SPLIT)).astype(np.uint32)[order]
                row = np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
                bounds = np.searchsorted(bucket[order], np.arange((1 << SPLIT) + 1)).tolist()
                some = [(i, a, b) for i, (a, b) in enumerate(pairwise(bounds)) if a < b]
                out = [
                    pa.array([chunk & (1 << SPLIT) - 1, *(i for i, _, _ in some)], pa.int32()),
                    pa.array([chunk] * (len(some) + 1), pa.int64()),
                    pa.array([None, *(cols[a:b].tobytes() for _, a, b in some)], pa.binary()),
                    pa.array([np.array(doc_ids[k : k + ROWS], np.int64).tobytes(), *(np.diff(row[a:b], prepend=np.uint16(0)).tobytes() for _, a, b in some)], pa.binary()),
                    pa.array([n.tobytes(), *[None] * len(some)], pa.binary()),
                ]
                yield pa.record_batch(out, ["bucket", "chunk", "cols", "at", "more"])
                chunk += 1

    return sets.select("doc_id", "n", "items").mapInArrow(run, _CHUNKS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket: each chunk's items that other rows have too, with 4 * log2 of the number of rows that have them."""
    settle()
    for held in _runs(batches, "bucket"):
        cols = [np.frombuffer(x, np.uint32) for x in held["cols"] if x is not None]
        flat = np.concatenate(cols) if cols else np.zeros(0, np.uint32)
        order = np.argsort(flat)
        new = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]])) if len(flat) else np.zeros(0, np.int64)
        times = np.diff(new, append=len(flat))
        level = np.zeros(len(flat), np.uint8)
        level[order] = np.repeat(np.round(4 * np.log2(times)).astype(np.uint8), times)
        out, end = [], 0
        for bucket, chunk, x, at, more in zip(*held.values(), strict=True):
            if x is None:
                out.append((bucket, chunk, None, at, more))
                continue
            begin, end = end, end + len(x) // 4
            if len(take := np.flatnonzero(level[begin:end])):
                row = np.cumsum(np.frombuffer(at, np.uint16), dtype=np.uint16)[take]
                out.append((bucket, chunk, flat[begin:end][take].tobytes(), row.tobytes(), level[begin:end][take].tobytes()))
        for i in range(0, len(out), 1000):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[i : i + 1000], strict=True), _CHUNK_TYPES, strict=True)], ["bucket", "chunk", "cols", "at", "more"])


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Columns, as lists, of all rows of one key after the other, from batches sorted by it."""
    held: dict[str, list] = {}
    for batch in batches:
        keys = batch.column(key).to_numpy()
        bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
        for a, b in pairwise(bounds):
            part = batch.slice(a, b - a).to_pydict()
            if held and held[key][0] == part[key][0]:
                for c, x in part.items():
                    held[c] += x
            else:
                if held:
                    yield held
                held = part
    if held:
        yield held


def incidence(sets: DataFrame) -> DataFrame:
    """The counted part of the matrix: col, block, doc, n, near (may meet a larger set here), dealt (the column has several blocks).

    Items of one row only come first in a row's order, so a row whose first part holds no other has no link and no rows here.
    """
    blocks = 1 + np.exp2(np.minimum(np.arange(256), 160) / 4).astype(np.int64) // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for held in _runs(batches, "chunk"):
            which = [i for i, x in enumerate(held["cols"]) if x is not None]
            (own,) = (i for i, x in enumerate(held["cols"]) if x is None)
            docs, sizes = np.frombuffer(held["at"][own], np.int64), np.frombuffer(held["more"][own], np.int32).astype(np.int64)
            if not which:
                continue
            cols = np.concatenate([np.frombuffer(held["cols"][i], np.uint32).astype(np.int64) | held["bucket"][i] << 32 for i in which])
            row = np.concatenate([np.frombuffer(held["at"][i], np.uint16) for i in which])
            level = np.concatenate([np.frombuffer(held["more"][i], np.uint8) for i in which])
            alone = sizes - np.bincount(row, minlength=len(sizes))
            first = sizes - -(-3 * sizes // 4) + 1
            take = np.flatnonzero((alone < first)[row])
            order = take[np.lexsort((cols[take], level[take], row[take]))]
            row, cols, level = row[order], cols[order], level[order]
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
            place = alone[row] + np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
            at = np.flatnonzero(place < first[row])
            if not len(at):
                continue
            row, cols, parts = row[at], cols[at], blocks[level[at]]
            doc, n = docs[row], sizes[row]
            block = ((cols.view(np.uint64) * _MIX[0] ^ doc.view(np.uint64) * _MIX[1]) * _MIX[2] >> np.uint64(33)).astype(np.int64) % parts
            out = [cols, block.astype(np.int32), doc, n.astype(np.int32), place[at] < n - -(-6 * n // 7) + 1, parts > 1]
            yield pa.record_batch([pa.array(x) for x in out], ["col", "block", "doc", "n", "near", "dealt"])

    counted = _dealt(sets).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_counted, _CHUNKS)
    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(run, "col long, block int, doc long, n int, near boolean, dealt boolean")


#: c: counted shared columns; near: the smaller set has one of them in its own first part; big: one is of a large
#: column, not all of whose pairs come at once, so that the count decides nothing.
_PAIRS = "a long, b long, na int, nb int, c int, near int, big int"
_SHARED = "col long, block int, doc long, n int, near boolean, dealt boolean, size int"


def _fits(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows sorted by col and block, as runs of whole groups; a group is one block of a column, so bounded."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        col, block = batch.column("col").to_numpy(), batch.column("block").to_numpy()
        change = np.flatnonzero((col[1:] != col[:-1]) | (block[1:] != block[:-1])) + 1
        if rest:
            last = rest[-1]
            if len(col) and (last.column("col")[-1].as_py(), last.column("block")[-1].as_py()) != (col[0], block[0]):
                change = np.concatenate([[0], change])
        if len(change):
            yield _arrays([*rest, batch.slice(0, int(change[-1]))])
            rest = [batch.slice(int(change[-1]))]
        elif batch.num_rows:
            rest.append(batch)
    if rest:
        yield _arrays(rest)


def _arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches([b for b in batches if b.num_rows] or batches[:1])
    out = {c: t.column(c).to_numpy() for c in t.column_names if c != "sketch"}
    if "sketch" in t.column_names:
        data = t.column("sketch").to_pylist()
        out["known"] = np.array([x is not None for x in data])
        out["sketch"] = np.frombuffer(b"".join(x or bytes(SKETCH // 8) for x in data), np.uint64).reshape(-1, SKETCH // 64)
    return out


def _emit(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, big: int) -> pa.RecordBatch | None:
    """Pairs of rows i < j (in order of n, then doc) of one block that may link, their shared columns counted."""
    ok = _fits(a["n"][i], a["n"][j]) & (a["doc"][i] != a["doc"][j])
    if "comp" in a:
        ok &= a["comp"][i] != a["comp"][j]
    i, j = i[ok], j[ok]
    if "sketch" in a and len(i):
        differ = np.bitwise_count(a["sketch"][i] ^ a["sketch"][j]).sum(1, dtype=np.int64)
        ok = ~(a["known"][i] & a["known"][j]) | (7 * differ <= a["n"][i] + a["n"][j])
        i, j = i[ok], j[ok]
    if not len(i):
        return None
    x, y = a["doc"][i], a["doc"][j]
    order = np.lexsort((y, x))
    x, y, i, j = x[order], y[order], i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    count = np.diff(first, append=len(x))
    near = np.maximum.reduceat(a["near"][i].astype(np.int32), first)
    i, j = i[first], j[first]
    columns = [x[first], y[first], a["n"][i], a["n"][j], count.astype(np.int32), near, np.full(len(i), big, np.int32)]
    return pa.record_batch(columns, ["a", "b", "na", "nb", "c", "near", "big"])


def sketches(sets: DataFrame) -> DataFrame:
    """doc, n, sketch: per bit, whether an odd number of the set's items have it; null where a doc has several sets of that size.

    Each bit that differs between two sets stands for an item at least that one of them has alone, so sets whose sketches
    differ in more than a seventh of their sizes' sum can't link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for doc_ids, sizes, data in rows_of(batches, "doc_id", "n", "items"):
            bit = (np.frombuffer(b"".join(data), np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64)
            odd = np.bincount(np.repeat(np.arange(len(sizes)) * SKETCH, sizes) + bit, minlength=len(sizes) * SKETCH) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(-1, SKETCH), axis=1)
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary())], ["doc", "n", "sketch"])

    rows = sets.select("doc_id", "n", "items").mapInArrow(run, "doc long, n int, sketch binary")
    return rows.groupBy("doc", "n").agg(F.expr("if(count(*) = 1, first(sketch), null)").alias("sketch"))


def _starts(a: dict[str, np.ndarray]) -> np.ndarray:
    """Per row, where its group starts."""
    new = np.concatenate([[True], (a["col"][1:] != a["col"][:-1]) | (a["block"][1:] != a["block"][:-1])])
    return np.flatnonzero(new)[np.cumsum(new) - 1]


def product(rows: DataFrame) -> DataFrame:
    """First round over a dealt-out incidence: pairs with counts (``_PAIRS``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in _groups(batches):
            start = _starts(a)
            size = np.bincount(start, minlength=len(start))[start]
            for small in (True, False):
                at = np.flatnonzero((size <= SMALL) == small)
                for k in range(1, SMALL if small else NEAR + 1):
                    at = at[at + k < len(start)]
                    at = at[start[at + k] == start[at]]
                    if not len(at):
                        break
                    if (out := _emit(a, at, at + k, int(not small))) is not None:
                        yield out
                if not small and (out := _emit(a, start[size > SMALL], np.flatnonzero(size > SMALL), 1)) is not None:
                    yield out

    return rows.mapInArrow(run, _PAIRS)


def apart(rows: DataFrame, after: int, to: int) -> DataFrame:
    """A later round: classes of one column in different components at distances (after, to]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in _groups(batches):
            start = _starts(a)
            at = np.arange(len(start))
            for k in range(after + 1, to + 1):
                at = at[at + k < len(start)]
                at = at[start[at + k] == start[at]]
                if not len(at):
                    break
                if (out := _emit(a, at, at + k, 1)) is not None:
                    yield out

    return rows.mapInArrow(run, _PAIRS)


def _possible(pairs: DataFrame) -> DataFrame:
    """Distinct pairs whose counted overlap, with all that may follow, reaches the least overlap of their sizes."""
    total = pairs.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"), F.max("near").alias("near"), F.max("big").alias("big"))
    rest = F.expr("greatest(na - (na - ceil(0.75D * na) + 1), nb - (nb - ceil(0.75D * nb) + 1))")
    return total.filter((F.col("big") == 1) | ((F.col("near") == 1) & (7 * (F.col("c") + rest) >= 3 * (F.col("na") + F.col("nb")))))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole rows have 100 * intersection >= 75 * union."""
    pairs = written(_possible(pairs).select("a", "b"), "candidates")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    rows = _marked(sets.select("doc_id", "items"), _bitmap(ids, "doc_id"), True)
    left = rows.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = rows.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * both >= 75 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """doc, comp (smallest doc that links reach) of every doc with a link, by large-star and small-star rounds."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.*").filter("u <> v").distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    stars = now.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("doc"), "comp")
    return stars.unionByName(stars.select(F.col("comp").alias("doc"), "comp").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    sets = written(shingle_sets(docs), "shingles")
    small = sets.select("doc_id", "n", "k1", "k2")
    known = small.filter("n > 0 and doc_id is not null")
    reps = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    members = written(known.join(reps, ["k1", "k2"]).select("doc_id", "n", "rep").distinct(), "members")
    per_doc = members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.max(F.col("doc_id") == F.col("rep")).alias("first"))
    copies, joined = per_doc.filter("not first").select("doc_id"), per_doc.filter("a <> b").select("a", "b")
    bits = _bitmap(copies, "doc_id")
    usable = sets.filter("n > 0 and doc_id is not null").select("doc_id", "n", "items")
    rows = _marked(usable, bits, False).unionByName(_marked(usable, bits, True).join(copies, "doc_id", "left_anti"))
    dealt = incidence(rows).repartition("col", "block").sortWithinPartitions("col", "block", "n", "doc")
    shared = written(dealt.mapInArrow(_keep_shared, _SHARED), "incidence")
    own = links(product(_sorted(shared)), rows)
    own = written(own.unionByName(joined), "links")
    comps = written(components(own), "components")
    comps = _later_rounds(shared, rows, comps)
    found = members.select("doc_id", "rep").join(comps.select(F.col("doc").alias("rep"), "comp"), "rep", "left")
    found = found.select("doc_id", F.coalesce("comp", "rep").alias("comp")).groupBy("doc_id").agg(F.min("comp").alias("comp"))
    out = small.join(found, "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def _keep_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of columns with two classes or more in a block, with that number; rows of a dealt column all stay, as others may be in its other blocks."""
    for a in _groups(batches):
        start = _starts(a)
        size = np.bincount(start, minlength=len(start))[start]
        at = np.flatnonzero((size > 1) | a["dealt"])
        if len(at):
            names = ["col", "block", "doc", "n", "near", "dealt"]
            yield pa.record_batch([*(a[c][at] for c in names), size[at].astype(np.int32)], [*names, "size"])


def _sorted(shared: DataFrame) -> DataFrame:
    return shared.repartition("col", "block").sortWithinPartitions("col", "block", "n", "doc")


def _later_rounds(shared: DataFrame, rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rounds over columns too large for the first one until their classes are in one component or all were compared."""
    wide = shared.groupBy("col").agg(F.count("*").alias("m"), F.max("dealt").alias("dealt"), F.max("size").alias("size"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"))
    wide = wide.filter((F.col("size") > SMALL) | (F.col("dealt") & (F.col("m") > 1)))
    # columns with the same classes have the same pairs: one of them stands for all
    wide = written(wide.groupBy("m", "who").agg(F.min("col").alias("col")).select("col", "m"), "columns")
    most = wide.agg(F.max("m")).first()[0]
    if not most:
        return comps
    big = written(shared.join(wide, "col").drop("size", "dealt"), "wide")
    marks = written(sketches(_marked(rows, _bitmap(big.select("doc"), "doc"), True)), "sketches")
    after = 0
    while after < most - 1:
        to = max(32, after * 32)
        named = big.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        open_ = named.groupBy("col").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("m").alias("m"))
        open_ = open_.filter((F.col("x") != F.col("y")) & (F.col("m") > after + 1)).select("col")
        left = written(named.join(open_, "col", "left_semi").withColumn("block", F.lit(0)), "open")
        forget(big)
        if left.isEmpty():
            break
        pairs = apart(left.drop("m").join(marks, ["doc", "n"], "left").repartition("col").sortWithinPartitions("col", "n", "doc"), after, to)
        more = written(links(pairs, rows), "links")
        if not more.isEmpty():
            stars = comps.selectExpr("doc a", "comp b")
            comps = written(components(stars.unionByName(more)), "components")
        big, after = left.drop("comp"), to  # closed columns never open again
    return comps


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, the one of smallest doc_id (a null one last).

    A row's node is its doc_id and text together: of rows that repeat both one stays, and rows of one doc_id with unlike
    texts are two. Most rows are told apart by a bitmap of fixed size and never shuffled.
    """
    (name,) = fresh(docs, "own_id")
    rows = docs.withColumnRenamed("doc_id", name).withColumn("doc_id", F.xxhash64(name, "text"))
    found = written(near_duplicates(rows).select("doc_id", "component_id"), "groups")
    ids = rows.groupBy("doc_id").agg(F.min(name).alias("id"), F.count("*").alias("times"))
    nodes = written(found.distinct().join(ids, "doc_id"), "nodes")
    first = nodes.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("m"))
    gone = written(nodes.select("doc_id").join(first.select("m.doc_id"), "doc_id", "left_anti"), "gone")
    bits = _bitmap(gone.unionByName(nodes.filter("times > 1").select("doc_id")), "doc_id")
    doubtful = _marked(rows, bits, True).join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    out = _marked(rows, bits, False).unionByName(doubtful.select(*rows.columns))
    return out.drop("doc_id").withColumnRenamed(name, "doc_id").select(*docs.columns)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
reached AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reached JOIN links ON r = a),
least AS (SELECT d, min(r) AS component_id FROM reached GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN least ON d = doc_id
"""
