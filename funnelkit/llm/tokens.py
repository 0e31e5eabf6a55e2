"""Token ids of whole texts, each distinct stretch of a text encoded once.

Byte-level BPE with ``public_tokenizers.PATTERN`` never joins a non-space character and a space that
follows it: no alternative of the pattern matches across that place, and what stands left of it is
split as if the text ended there; the same holds before and after a line break between two non-space
characters. So a text can be cut before every space that follows a non-space character and around such
line breaks, its stretches encoded one by one, and the ids joined. Running prose repeats its words, so
a cache of stretches saves most of the work; the ids are those of the whole text.
"""

from __future__ import annotations

import gc
import os
import re
import string
from collections.abc import Callable
from itertools import chain, compress, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Stretches in a worker's cache before it starts anew; a longer stretch is not kept.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 64
_SIGNS = string.punctuation
#: Bytes that are white space by themselves, and first bytes of longer white space.
_WHITE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_MAYBE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


def _after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space of two or three bytes ends before places; each has the end of a character before it."""
    out = np.zeros(len(at), bool)
    some = np.flatnonzero(data[at - 1] >= 128)
    z, y, x = (data[np.maximum(0, at[some] - k)] for k in (1, 2, 3))
    out[some] = (y == 0xC2) & ((z == 0x85) | (z == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
    out[some] |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | np.isin(z, [0xA8, 0xA9, 0xAF])) | (y == 0x81) & (z == 0x9F))
    return out


def stretches(column: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The stretches of texts without nulls, and where each text's begin among them (and the last one's end)."""
    _, ends, held = column.buffers()
    bounds = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(bounds[0]), int(bounds[-1])
    if first == last:
        return pa.array([], pa.large_string()), np.zeros(len(bounds), np.int64)
    data = np.frombuffer(held, np.uint8)[first:last]
    white = _WHITE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = (data[1:] == 32) & ~white[:-1]
    at = np.flatnonzero(begins)
    begins[at[_after_white(data, at)]] = False
    lines = np.flatnonzero(data[1:-1] == 10) + 1
    lines = lines[~white[lines - 1] & ~white[lines + 1] & ~_MAYBE[data[lines + 1]] & ~_after_white(data, lines)]
    begins[lines] = begins[lines + 1] = True
    begins[bounds[:-1][bounds[:-1] < last] - first] = True
    at = np.flatnonzero(begins)
    parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)) + first), held)
    return parts, np.searchsorted(at, bounds - first)


class StretchEncoder:
    """Ids of texts through a bounded cache of stretches.

    ``encode_pieces`` gives the ids of distinct matches of the pattern, each at most once a call.
    """

    def __init__(self, encode_pieces: Callable[[list[str]], list[list[int]]], entries: int = CACHE_ENTRIES):
        import public_tokenizers
        import regex

        self._pieces, self._entries, self._findall = encode_pieces, entries, regex.compile(public_tokenizers.PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self._slot: dict[str, int] = {}
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0
        self._at, self._n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._again = np.zeros(0, bool)

    def _shrink(self) -> None:
        """Keeps the stretches that came again since the last time; the others go."""
        at, ids, n = np.fromiter(self._slot.values(), np.int64, len(self._slot)), self._ids, self._n
        kept_, at = list(compress(self._slot, self._again[at].tolist())), at[self._again[at]]
        if 2 * len(at) > self._entries:
            return self._clear()
        n, start = n[at], self._at[at]
        ends = np.cumsum(n)
        flat = ids[np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._clear()
        self._slot = dict(zip(kept_, range(len(kept_)), strict=True))
        self._ids, self._used = np.concatenate([flat, np.zeros(1 << 16, np.uint32)]), len(flat)
        self._at, self._n, self._again = ends - n, n, np.zeros(len(n), bool)

    def _learn(self, new: pa.LargeStringArray, names: list[str]) -> None:
        """Adds stretches, given also as a list."""
        _, ends, held = new.buffers()
        ends = np.frombuffer(ends, np.int64)[new.offset : new.offset + len(new) + 1]
        data = np.frombuffer(held, np.uint8)
        words = pc.ascii_rtrim(new, _SIGNS)
        word_ends = ends[:-1] + pc.binary_length(words).to_numpy()
        bare = pc.ascii_ltrim(words, " ").to_numpy(zero_copy_only=False).tolist()
        # a space and a word is one match; so are the signs after it
        easy = np.fromiter(map(str.isalpha, bare), bool, len(bare)) & (data[ends[:-1]] == 32)
        easy[easy] = data[ends[:-1][easy] + 1] != 32
        signs = easy & (word_ends < ends[1:])
        halves = np.append(np.stack([ends[:-1], word_ends], 1).ravel(), ends[-1])
        halves = pa.LargeStringArray.from_buffers(2 * len(new), pa.py_buffer(halves), held).filter(pa.array(np.stack([easy, signs], 1).ravel()))
        rest = np.flatnonzero(~easy)
        found = [self._findall(names[i]) for i in rest.tolist()]
        pieces = pa.concat_arrays([halves, pa.array(chain.from_iterable(found), pa.large_string())]).dictionary_encode()
        which, pieces = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        order = np.concatenate([np.flatnonzero(easy), rest])  # of the stretches by their pieces
        per = np.concatenate([1 + signs[easy], np.fromiter(map(len, found), np.int64, len(found))])
        ids = self._pieces(pieces)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        ids = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        many, begin = size[which], (np.cumsum(size) - size)[which]
        ends = np.concatenate([[0], np.cumsum(many)])
        flat = ids[np.repeat(begin - ends[:-1], many) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(per)])]
        at, n = np.empty((2, len(new)), np.int64)
        at[order], n[order] = self._used + bounds[:-1], np.diff(bounds)
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._ids[self._used : self._used + len(flat)] = flat
        self._slot.update(zip(names, range(len(self._n), len(self._n) + len(new)), strict=True))
        self._at, self._n = np.concatenate([self._at, at]), np.concatenate([self._n, n])
        self._again = np.concatenate([self._again, np.zeros(len(n), bool)])
        self._used += len(flat)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (uint32), and the number of ids of each text."""
        collects = gc.isenabled()
        gc.disable()  # millions of small objects and no cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._n) > self._entries or self._used > 8 * self._entries:
            self._shrink()
        parts, offsets = stretches(pc.fill_null(pa.array(texts, pa.large_string()), ""))
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self._slot.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(places < 0)
        self._again[places[places >= 0]] = True
        new = [distinct[i] for i in unknown.tolist()]
        if new:
            places[unknown] = np.arange(len(self._n), len(self._n) + len(new))  # as _learn numbers them
            self._learn(coded.dictionary.take(pa.array(unknown)), new)
        slots = places[coded.indices.to_numpy()]
        n = self._n[slots]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[np.repeat(self._at[slots] - ends + n, n) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[offsets]
        for long in [s for s in new if len(s) > CACHE_CHARS]:
            del self._slot[long]
        return ids, np.diff(bounds)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE files write for each byte."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(same)]
    return {**{b: chr(b) for b in same}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class WithAddedTokens:
    """Ids of texts in which a file's added tokens stand for themselves; what is between them goes to ``encode``."""

    def __init__(self, encode: StretchEncoder, ids: dict[str, int]):
        self._encode, self._ids = encode, ids
        self._split = re.compile("(" + "|".join(sorted(map(re.escape, ids), key=len, reverse=True)) + ")").split

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if not any(t and x in t for x in self._ids for t in texts):
            return self._encode(texts)
        cut = [self._split(t or "") for t in texts]  # plain, token, plain, token, ..., plain
        ids, n = self._encode([p for c in cut for p in c[::2]])
        tokens = [self._ids[p] for c in cut for p in c[1::2]]
        size = np.array([len(c) // 2 + 1 for c in cut], np.int64)
        last = np.cumsum(size) - 1
        before_token = np.ones(len(n), bool)
        before_token[last] = False
        ids = np.insert(ids, np.cumsum(n)[before_token], np.array(tokens, np.uint32))
        return ids, np.diff(np.cumsum(n)[last], prepend=0) + size - 1


def library_encoder(path: str, entries: int = CACHE_ENTRIES) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    """Encoder by the tokenizers library from a byte-level BPE file, as its ``encode`` without special tokens added.

    The file's added tokens are recognised in texts, as the library does. One encoder serves all tasks of a worker;
    fewer ``entries`` of its cache save memory and cost time.
    """
    return kept(("encoder", path, entries), lambda: _library_encoder(path, entries))


def library_tokenizer(path: str):
    """The library's tokenizer of a file, read once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return kept(("tokenizer", path), lambda: Tokenizer.from_file(path))


def _library_encoder(path: str, entries: int) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]]:
    library = library_tokenizer(path)
    tokenize = library.model.tokenize
    letters = np.array([ord(x) for _, x in sorted(byte_letters().items())], "<u2")
    added = library.get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
        raise ValueError("added tokens that take in what stands beside them are not supported")

    def encode(pieces: list[str]) -> list[list[int]]:
        if not pieces:
            return []
        _, ends, data = pa.array(pieces, pa.large_string()).buffers()
        at = np.frombuffer(ends, np.int64)[: len(pieces) + 1].tolist()
        text = letters[np.frombuffer(data, np.uint8)[: at[-1]]].tobytes().decode("utf-16-le")  # a letter a byte
        return [[t.id for t in tokenize(text[a:b])] for a, b in pairwise(at)]

    plain = StretchEncoder(encode, entries)
    return WithAddedTokens(plain, {t.content: i for i, t in added.items()}) if added else plain
