"""Byte-level BPE on length-bucketed, padded numpy matrices.

Distinct matches of the pattern are rows of bytes' ids, bucketed by length and padded. Each round
every row merges its leftmost pair of least rank, found through a hashed table of pairs; rows without
a pair left are taken out (compaction). A match beyond ``WIDEST`` bytes, where a round a merge would
cost the square of its length, merges by the same rule through a heap.

Edge cases: a null or empty text has no ids and decodes to nothing; repeated rows give repeated
results; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import rows_of, settle, table
from .tokens import StretchEncoder

WIDEST, ROWS = 256, 1 << 15
NONE = np.int32(2**31 - 1)


class MatrixBPE:
    """Ids of byte strings by the ranks of a ``.tiktoken`` file, and back."""

    def __init__(self, path: str):
        with open(path, "rb") as file:  # a vocabulary installed on every executor
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self._byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self._shift = 64 - max(4, (4 * len(pairs)).bit_length())
        size = 1 << (64 - self._shift)
        self._keys, self._values = np.full(size, np.uint64(2**64 - 1)), np.full(size, NONE)
        slot = self._slot(keys)
        self._probes = 0
        while len(keys):  # open addressing: the first of those that want a free place gets it
            free = self._keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self._keys[slot[won]], self._values[slot[won]] = keys[won], values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + 1) & (size - 1)
            self._probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self._shift)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, NONE where there is none or either side is padding (-1)."""
        out = np.full(left.shape, NONE)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[at].astype(np.uint64) << np.uint64(32) | right.ravel()[at].astype(np.uint64)
        slot, flat, last = self._slot(keys), out.ravel(), len(self._keys) - 1
        for _ in range(self._probes):
            there = self._keys[slot]
            hit = there == keys
            flat[at[hit]] = self._values[slot[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            if not on.any():
                break
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & last
        return flat.reshape(left.shape)

    def _bucket(self, rows: list[bytes], width: int) -> list[list[int]]:
        n = len(rows)
        sizes = np.fromiter(map(len, rows), np.int64, n)
        data = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < sizes[:, None], self._byte[data], np.int32(-1))
        ranks = self.pair(ids[:, :-1], ids[:, 1:])
        whose, out = np.arange(n), [None] * n
        columns = np.arange(width)
        while len(whose):
            j = ranks.argmin(1)  # the leftmost of least rank
            row = np.arange(len(whose))
            best = ranks[row, j]
            done = best == NONE
            if done.any():
                for i, r, k in zip(whose[done].tolist(), ids[done].tolist(), (ids[done] >= 0).sum(1).tolist(), strict=True):
                    out[i] = r[:k]
                keep = ~done
                whose, ids, ranks, j, best = whose[keep], ids[keep], ranks[keep], j[keep], best[keep]
                if not len(whose):
                    break
                used = int((ids >= 0).sum(1).max())
                ids, ranks, columns = ids[:, :used], ranks[:, : used - 1], columns[:used]
                row = np.arange(len(whose))
            ids[row, j] = best
            after = columns[None, :-1] > j[:, None]
            ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if ranks.shape[1] > 1:
                ranks[:, :-1] = np.where(after[:, : ranks.shape[1] - 1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            right = np.minimum(j + 1, ids.shape[1] - 1)
            ranks[row, np.minimum(j, ranks.shape[1] - 1)] = np.where(j < ranks.shape[1], self.pair(best, np.where(j + 1 < ids.shape[1], ids[row, right], -1)), NONE)
            left = row[j > 0]
            if len(left):
                ranks[left, j[left] - 1] = self.pair(ids[left, j[left] - 1], best[left])
        return out

    def _long(self, piece: bytes) -> list[int]:
        ids: list[int] = self._byte[np.frombuffer(piece, np.uint8)].tolist()
        n, ranks, back = len(ids), self.ranks, self.bytes_of
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        look = lambda i: ranks.get(back[ids[i]] + back[ids[after[i]]]) if after[i] >= 0 else None
        heap = [(r, i) for i in range(n - 1) if (r := look(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or look(i) != r:
                continue
            gone = after[i]
            ids[i], after[i], alive[gone] = r, after[gone], False
            if after[i] >= 0:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := look(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return [x for x, a in zip(ids, alive, strict=True) if a]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; pieces are matches of the pattern."""
        out: list[list[int] | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif len(p) > WIDEST:
                out[i] = self._long(p)
            elif p:
                buckets.setdefault(max(2, -(-len(p) // 4) * 4), []).append(i)
            else:
                out[i] = []
        for width, rows in buckets.items():
            for a in range(0, len(rows), ROWS * 16 // max(16, width)):
                part = rows[a : a + ROWS * 16 // max(16, width)]
                for i, ids in zip(part, self._bucket([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def encoded(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian uint32) of every text, with ``decoded``, the bytes of those ids."""
    return _run(docs, ranks, lambda ids, back: {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(back, pa.binary())}, "ids binary, decoded binary")


def _run(docs: DataFrame, ranks: str, columns, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        bpe = MatrixBPE(ranks)
        encode = StretchEncoder(lambda pieces: bpe.encode([p.encode() for p in pieces]))
        for doc_ids, texts in rows_of(batches, "doc_id", "text", chars=1 << 21):
            ids, n = encode(texts)
            ends = np.cumsum(n)
            parts = [ids[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            out = columns([p.astype("<u4", copy=False).tobytes() for p in parts], [bpe.decode(p) for p in parts])
            yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), **out})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {schema}")


def op3_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    hexes = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows])
    return _run(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        lambda ids, back: {"ids_sha256": hexes(ids), "decoded_sha256": hexes(back)},
        "ids_sha256 string, decoded_sha256 string",
    )
