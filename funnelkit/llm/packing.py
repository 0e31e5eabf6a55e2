"""Packing of documents into training sequences by order-preserving dynamic programming.

Documents keep the order of their table. Within a stretch of the token stream the places to cut are
document ends (free), sentence ends (a small truncation penalty) and, where neither comes for long,
word-free places (a larger one). ``best[j] = min over i of best[i] + padding(j - i) + penalty(j)``;
as padding is ``length - (j - i)``, the minimum over the last ``length`` places is the head of a
monotone queue. A sequence whose size is a power of two is not padded.

Each partition of the input is packed by itself, block after block: no shuffle, and the state is one
block of tokens. Edge cases: a null or empty text is its end id alone; repeated rows are packed each
for itself; an empty table gives no rows; a document longer than a sequence is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import kept, rows_of, settle, spans, table
from .tokens import CACHE_ENTRIES, library_encoder, library_tokenizer

LENGTH, END_ID = 1024, 0
#: Penalties in padded tokens for a cut at a sentence end within a document, and at any other place.
SENTENCE, TORN = 1.0, 24.0
#: Where no sentence ends for so many tokens, places at this step are added.
STEP = 128
BLOCK = 1 << 19
CHARS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def places(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut places of a stream (the last one is its end) and the penalty of each."""
    kind = np.zeros(len(ids) + 1, np.uint8)
    kind[1:] = closing[ids]
    kind[ends] = 2
    at = np.flatnonzero(kind != 0)
    gaps = np.diff(at, prepend=0)
    for a, g in zip(at[gaps > 2 * STEP].tolist(), gaps[gaps > 2 * STEP].tolist(), strict=True):
        kind[a - g + STEP : a : STEP] = 3
    at = np.flatnonzero(kind != 0)
    return at, np.array([0.0, SENTENCE, 0.0, TORN])[kind[at]]


def cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """The chosen places, ascending, the stream's end last. Gaps between places are at most ``length``."""
    n = len(at)
    pos = [0, *at.tolist()]
    cost = [0.0, *penalty.tolist()]
    number = np.full(pos[-1] + 1, -1)
    number[at] = np.arange(1, n + 1)
    number[0] = 0
    whole: dict[int, list[int]] = {}  # starts of sequences that need no padding
    size = 1
    while size <= length:
        first = int(np.searchsorted(at, size))
        start = number[at[first:] - size]
        hit = np.flatnonzero(start >= 0)
        for k, i in zip((hit + first + 1).tolist(), start[hit].tolist(), strict=True):
            if k in whole:
                whole[k].append(i)
            else:
                whole[k] = [i]
        size *= 2
    best, back, keys = [0.0] * (n + 1), [0] * (n + 1), [0.0] * (n + 1)  # keys: best[i] + pos[i]
    queue, head, end = [0], 0, 1  # keys ascending from the head on
    for j in range(1, n + 1):
        p = pos[j]
        while p - pos[queue[head]] > length:
            head += 1
        i = queue[head]
        value = keys[i] + length - p
        if j in whole:
            for k in whole[j]:
                if best[k] < value:
                    value, i = best[k], k
        best[j] = value = value + cost[j]
        back[j] = i
        keys[j] = key = value + p
        while end > head and keys[queue[-1]] >= key:
            queue.pop()
            end -= 1
        queue.append(j)
        end += 1
    out, j = [], n
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


def _closing(path: str) -> np.ndarray:
    """Which ids close a sentence: they end in one of ``. ! ?`` or a line break."""
    vocabulary = library_tokenizer(path).get_vocab(with_added_tokens=True)
    closing = np.zeros(max(vocabulary.values()) + 1, bool)
    closing[[i for t, i in vocabulary.items() if t[-1:] in ".!?Ċ"]] = True
    return closing


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, cache: int = CACHE_ENTRIES, chars: int = CHARS) -> DataFrame:
    """One row per piece of a document in a sequence; ``ids`` holds the piece's ids (little-endian uint32).

    A worker keeps about ``cache`` stretches of text with their ids and encodes about ``chars`` characters at
    once; less of both takes less memory and more time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        encode, closing = library_encoder(tokenizer, cache), kept(("closing", tokenizer), lambda: _closing(tokenizer)).copy()
        closing[end_id] = False
        sequence = TaskContext.get().partitionId() << 40
        # Of the open stream: document ids, their token counts, how many of their ids were emitted, and ids.
        names, sizes, done, ids = [], np.zeros(0, np.int64), 0, np.zeros(0, np.uint32)

        def close(last: bool) -> pa.RecordBatch | None:
            nonlocal sequence, names, sizes, done, ids
            if not len(ids):
                return None
            ends = np.cumsum(sizes) - done
            at, penalty = places(ids, ends, closing)
            chosen = cuts(at, penalty, length)
            if last:  # what is left over needs no padding in pieces that are powers of two
                a, b = chosen[-2] if len(chosen) > 1 else 0, chosen[-1]
                while (b - a) & (b - a - 1) and length - (b - a) > TORN:
                    a += 1 << ((b - a).bit_length() - 1)
                    chosen.insert(-1, a)
            elif len(chosen) > 1:
                chosen.pop()  # the last sequence may go on with the next block
            bounds = np.union1d(chosen, ends[ends <= chosen[-1]])
            starts = np.concatenate([[0], bounds[:-1]])
            of = np.searchsorted(ends, starts, side="right")
            seq = np.searchsorted(chosen, starts, side="right")
            first = np.concatenate([[0], chosen])[seq]
            data = ids.tobytes()
            pieces = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), bounds.tolist(), strict=True)]
            out = pa.record_batch(
                {
                    "doc_id": pa.array([names[i] for i in of.tolist()], pa.int64()),
                    "start": pa.array(starts - (ends - sizes)[of], pa.int64()),
                    "length": pa.array(bounds - starts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                    "doc_tokens": pa.array(sizes[of], pa.int64()),
                    "sequence_id": pa.array(sequence + seq, pa.int64()),
                    "offset": pa.array(starts - first, pa.int64()),
                    "ids": pa.array(pieces, pa.binary()),
                }
            )
            sequence += len(chosen)
            gone = int(np.searchsorted(ends, chosen[-1], side="right"))
            done = int(chosen[-1] - (ends[gone - 1] if gone else -done)) if gone < len(names) else 0
            names, sizes, ids = names[gone:], sizes[gone:], ids[chosen[-1] :]
            return out

        for doc_ids, texts in rows_of(batches, "doc_id", "text", chars=CHARS):
            for a, b in spans(texts, chars):  # where a block ends doesn't depend on it
                new, n = encode(texts[a:b])
                sizes = np.concatenate([sizes, n + 1])
                ids = np.concatenate([ids, np.insert(new, np.cumsum(n), np.uint32(end_id))])
            names += doc_ids
            if len(ids) >= BLOCK:
                yield close(False)
        if (out := close(True)) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", ids binary")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
