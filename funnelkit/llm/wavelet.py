"""Token ids in wavelet matrices: succinct bit-planes with rank and select, one compressed file a shard.

A shard holds whole documents. Level ``l`` of its matrix is the plane of bit ``bits - 1 - l`` of all
ids in that level's order; the next level has the ids with a 0 first, then those with a 1, in order.
With counts of ones per block of 512 bits, a token, the count of an id in a range and its k-th place
each take one step a level. A shard's bytes: magic, header, frames of document ids and token counts,
the counts of ones, and the planes in chunks of 8 KB, packed by themselves where that makes them
smaller; a look-up unpacks only the chunks it passes. Shards are rows of Parquet files, so that any
store that Spark writes to will do; a reader needs nothing but the one row.

Edge cases: a null or empty text is the end id alone; null doc_ids come first, repeated doc_ids in
the order of their texts; an empty table gives no shards; one very long document is one shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import rows_of, settle, shared_dir, table
from .tokens import library_encoder

MAGIC, SHARD_TOKENS, END_ID, BLOCK, CHUNK = b"WVM2", 1 << 20, 2, 512, 8192
SHARDS = "part long, before long, tokens long, payload binary"


class WaveletMatrix:
    """Access, rank and select over ids by their bit-planes.

    ``planes`` are arrays of bytes or anything else that gives bytes [a, b) of a plane as ``part(a, b)``;
    ``ones`` has per plane the number of ones before each block of ``BLOCK`` bits.
    """

    def __init__(self, planes: list, n: int, ones: list[np.ndarray] | None = None):
        self.planes, self.n, self.bits = planes, n, len(planes)
        self._ones = [_directory(p) for p in planes] if ones is None else ones
        self.zeros = [n - int(o[-1]) for o in self._ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for b in range(bits - 1, -1, -1):
            one = (now & now.dtype.type(1 << b)).astype(bool)
            planes.append(np.packbits(one))
            now = np.concatenate([now[np.flatnonzero(~one)], now[np.flatnonzero(one)]])  # places cost less than masks
        return cls(planes, len(ids))

    def _part(self, level: int, a: int, b: int) -> np.ndarray:
        plane = self.planes[level]
        return plane[a:b] if isinstance(plane, np.ndarray) else plane.part(a, b)

    def all(self) -> np.ndarray:
        """Every id in order."""
        now = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._part(level, 0, -(-self.n // 8)), count=self.n).view(bool)
            before = np.empty_like(now)
            before[np.flatnonzero(~one)] = now[: self.zeros[level]]
            before[np.flatnonzero(one)] = now[self.zeros[level] :] | now.dtype.type(1 << (self.bits - 1 - level))
            now = before
        return now.astype(np.uint32, copy=False)

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        a = block * BLOCK // 8
        here = self._part(level, a, i // 8 + 1)
        ones = int(self._ones[level][block]) + int(np.bitwise_count(here[: i // 8 - a]).sum())
        return ones + (int(here[i // 8 - a] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._part(level, i // 8, i // 8 + 1)[0] >> (7 - i % 8) & 1
            value = value << 1 | int(bit)
            i = self.zeros[level] + self._rank1(level, i) if bit else i - self._rank1(level, i)
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for level in range(self.bits):
            one_a, one_b = self._rank1(level, a), self._rank1(level, b)
            if value >> (self.bits - 1 - level) & 1:
                a, b = self.zeros[level] + one_a, self.zeros[level] + one_b
            else:
                a, b = a - one_a, b - one_b
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """How often ``value`` stands in [a, b)."""
        if value >> self.bits:
            return 0
        x, y = self._range(value, a, self.n if b is None else b)
        return y - x

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) ``bit`` of a plane."""
        blocks = self._ones[level]
        lows = blocks if bit else np.arange(len(blocks)) * BLOCK - blocks
        block = int(np.searchsorted(lows, k, side="right")) - 1
        a = block * BLOCK
        here = np.unpackbits(self._part(level, a // 8, min(a // 8 + BLOCK // 8, -(-self.n // 8))))
        return a + int(np.flatnonzero(here == bit)[k - int(lows[block])])

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, 0)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i


def _directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane, and in all of it."""
    width = BLOCK // 8
    padded = np.zeros(-(-len(plane) // width) * width + width, np.uint8)
    padded[: len(plane)] = plane
    return np.concatenate([[0], np.cumsum(np.bitwise_count(padded.reshape(-1, width)).sum(1, dtype=np.int64))]).astype("<u4")


class PackedPlane:
    """A plane in a shard's bytes, chunk by chunk; a chunk is unpacked when it is first asked for."""

    def __init__(self, payload: memoryview, offsets: np.ndarray):
        self._payload, self._offsets, self.opened = payload, offsets, {}

    def _chunk(self, i: int) -> np.ndarray:
        if i not in self.opened:
            raw = self._payload[int(self._offsets[i]) : int(self._offsets[i + 1])]
            self.opened[i] = np.frombuffer(raw[1:] if raw[0] == 0 else zstandard.decompress(raw[1:]), np.uint8)
        return self.opened[i]

    def part(self, a: int, b: int) -> np.ndarray:
        chunks = range(a // CHUNK, max(a // CHUNK + 1, -(-b // CHUNK)))
        some = [self._chunk(i)[max(0, a - i * CHUNK) : b - i * CHUNK] for i in chunks if i + 1 < len(self._offsets)]
        return some[0] if len(some) == 1 else np.concatenate([*some, np.zeros(0, np.uint8)])


def dump(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    """A shard's bytes: magic, n, bits, documents; frames of known doc_ids, doc_ids and token counts; the ranks; the chunks."""
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    pack = zstandard.ZstdCompressor(1).compress
    frames = [pack(f.tobytes()) for f in (known, np.array([d or 0 for d in doc_ids], "<i8"), sizes.astype("<i8"))]
    frames.append(np.concatenate(matrix._ones).tobytes())
    chunks = []
    for plane in matrix.planes:
        for a in range(0, len(plane), CHUNK):
            raw = plane[a : a + CHUNK]
            ones = np.bitwise_count(raw).sum() / (8 * len(raw))
            # the lower planes are as good as random; packing them would only cost time
            small = pack(raw.tobytes()) if not 0.25 < ones < 0.75 else raw.tobytes()
            chunks.append(b"\1" + small if len(small) < len(raw) else b"\0" + raw.tobytes())
    sizes_ = [len(x) for x in (*frames, *chunks)]
    return b"".join([MAGIC, struct.pack("<QIII", matrix.n, matrix.bits, len(doc_ids), len(chunks)), np.array(sizes_, "<u4").tobytes(), *frames, *chunks])


def load(payload: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix over a shard's bytes, which it reads as far as it is asked, its doc_ids and token counts."""
    if payload[:4] != MAGIC:
        raise ValueError("not a wavelet matrix shard")
    n, bits, _, many = struct.unpack_from("<QIII", payload, 4)
    at = 24 + np.concatenate([[0], np.cumsum(np.frombuffer(payload, "<u4", 4 + many, 24), dtype=np.int64)]) + 4 * (4 + many)
    view = memoryview(payload)
    known, ids, sizes = (zstandard.decompress(view[at[i] : at[i + 1]]) for i in range(3))
    ones = np.frombuffer(view[at[3] : at[4]], "<u4").reshape(bits, -1)
    each = many // bits
    planes = [PackedPlane(view, at[4 + i * each : 5 + (i + 1) * each]) for i in range(bits)]
    names = [d if k else None for d, k in zip(np.frombuffer(ids, "<i8").tolist(), known, strict=True)]
    return WaveletMatrix(planes, n, list(ones)), names, np.frombuffer(sizes, "<i8")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Writes the shards of ``docs`` in ascending doc_id order: ``part``, then ``before`` (ids of the part before the shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        encode, part, before = library_encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        ids, sizes = [], []

        def close() -> pa.RecordBatch:
            nonlocal names, ids, sizes, before
            flat = np.concatenate(ids)
            payload = dump(flat, names, np.concatenate(sizes))
            out = pa.record_batch([[part], [before], [len(flat)], pa.array([payload], pa.binary())], ["part", "before", "tokens", "payload"])
            names, ids, sizes, before = [], [], [], before + len(flat)
            return out

        held = 0
        for doc_ids, texts in rows_of(batches, "doc_id", "text", chars=1 << 22):
            new, n = encode(texts)
            ids.append(np.insert(new, np.cumsum(n), np.uint32(end_id)))
            sizes.append(n + 1)
            names += doc_ids
            held += len(ids[-1])
            if held >= SHARD_TOKENS:
                yield close()
                held = 0
        if names:
            yield close()

    parts = parts or max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents of written shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    ``ids`` are little-endian uint32; without them that column is null.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    # One number a partition of the writing job, so bounded by its partition count.
    totals = sorted(map(tuple, shards.groupBy("part").agg({"tokens": "sum"}).collect()))
    parts = dict(zip([p for p, _ in totals], np.cumsum([0, *[n for _, n in totals]]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "before", "payload")]
            for i in range(batch.num_rows):
                part, before, payload = (c[i].as_py() for c in columns)
                matrix, doc_ids, sizes = load(payload)
                ends = np.cumsum(sizes)
                data = matrix.all().astype("<u4", copy=False).tobytes()
                pieces = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(doc_ids, pa.int64()),
                        "start": pa.array(parts[part] + before + ends - sizes, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                        "ids": pa.array(pieces, pa.binary()) if ids else pa.nulls(len(pieces), pa.binary()),
                    }
                )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    return shards.select("part", "before", "payload").mapInArrow(run, schema)


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark, "wavelet")
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path, ids=False).drop("ids")
