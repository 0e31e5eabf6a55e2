"""Phrase mining, hard negatives and suffix dedup against brute force on small fixtures, with odd rows among them."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np
import pytest

from funnelkit.llm import collocations, hard_negatives, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """doc_id, text, lang, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, g, "x", 1.5, i) for i, (d, t, g) in enumerate(rows)], "doc_id long, text string, lang string, shard string, score double, h long")


def brute_collocations(rows, support=10):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    out = []
    for (lang, *w), a in found.items():
        if any(q[0] == lang and len(q) == len(w) + 2 and w in ([*q[1:3]], [*q[2:]]) and 100 * b >= 50 * a for q, b in found.items()):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[(lang, *w[:k])], f[(lang, *w[k:])]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank = collections.Counter()
    for r in out:
        rank[r[0]] += 1
        yield (r[0], rank[r[0]], *r[1:])


@pytest.mark.parametrize("shard", [4_000_000, 2_000])
def test_collocations(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD", shard)  # small shards: supports of 1, large ones: up to 10
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(1, None, "en"), (2, "", None), (3, " \t.,;:!? ", "en"), (4, "one", "fr"), (5, "À LA carte\tà la carte! " * 12, "fr"), (6, "New  York City " * 2000, "en")]
    for i in range(150):
        words = rng.choice(vocabulary, int(rng.integers(1, 80)), p=np.arange(40, 0, -1) / 820)
        text = "".join(w + str(rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b"])) for w in words)
        rows.append((10 + i, text.upper() if i % 7 == 0 else text, [None, "en", "de", "und"][i % 4]))
    rows += [rows[20]] * 15
    docs = frame(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs).collect())
    assert got == sorted(brute_collocations(rows))
    few = sorted(tuple(r) for r in collocations.collocations(docs, best=3).collect())
    assert few == [r for r in got if r[1] <= 3]


def test_collocations_empty(spark):
    for rows in ([], [(1, None, None)], [(1, "a b", "en")]):
        out = collocations.collocations(frame(spark, rows))
        assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_are_exact_beyond_64_bits(spark):
    n = 3_000_000_000_000
    got = spark.sql(f"select cast(cast({n} as decimal(19,0)) * cast({n} as decimal(19,0)) * cast(1000000 as decimal(7,0)) as decimal(38,0)) div cast(cast({n + 7} as decimal(19,0)) * cast({n + 1} as decimal(19,0)) as decimal(38,0)) as x").first()[0]
    assert got == 1_000_000 * n * n // ((n + 7) * (n + 1))


def test_strassen():
    rng = np.random.default_rng(2)
    for m, k, n in [(1, 1, 1), (17, 33, 65), (40, 64, 100), (129, 70, 51), (5, 200, 9)]:
        a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
        assert (hard_negatives.strassen(a, b) == a @ b).all()
    big = np.full((20, 20), 2.0**40)
    assert (hard_negatives.scores(big, big) == 2**63 - 1).all() and (hard_negatives.scores(big, -big) == -(2**63 - 1)).all()
    near = np.array([[2.0**31 + 1, -3.0]])
    assert hard_negatives.scores(near, near).item() == (2**31 + 1) ** 2 + 9


def brute_negatives(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, (label, v) in kept.items()}
    for a in sorted(i for i in whole if i % 100 == 0):
        label, v = whole[a]
        s = {i: sum(x * y for x, y in zip(v, u, strict=False)) for i, (_, u) in whole.items() if i != a}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if whole[i][0] == label][:5]:
            window = [i for i in order if whole[i][0] != label and 30 * s[p] <= 100 * s[i] <= 90 * s[p]]
            for rank, i in enumerate(window[:10], 1):
                yield a, p, rank, i, s[p], s[i]


@pytest.mark.parametrize("tile", [4096, 32])
def test_hard_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 19)).astype(np.float32) + 0.5
    x[200:330] = x[200]  # ties
    rows = [(i, [float(v) for v in x[i]], int(rng.integers(10))) for i in range(600)]
    rows += [(700, None, 1), (800, [], 1), (900, [float("nan")] * 19, 1), (1000, [None] + [1.0] * 18, 1), (1100, [1.0] * 19, None), (None, [1.0] * 19, 2), (1200, [2.0] * 5, 3), rows[7], (8, [9.0] * 19, 0)]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, tile string, rank int").repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(vectors).collect())
    want = sorted(brute_negatives(rows))
    assert got == want and len(want) > 100
    assert hard_negatives.hard_negatives(vectors.limit(0)).count() == 0


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        left = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        yield len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()


def texts_with_repeats():
    rng = np.random.default_rng(4)
    prose = lambda n: "".join(rng.choice(list("abcdefgh é\n"), n))
    passage, shared = prose(700), prose(399)
    texts = [None, "", "short", "x" * 3000, "x" * 400, "ab" * 900, "abc" * 300 + "b" * 500, passage, prose(399) + "é" * 250]
    texts += [prose(int(rng.integers(0, 900))) + passage[int(rng.integers(0, 300)) :] + prose(int(rng.integers(0, 600))) for _ in range(30)]
    texts += [prose(50) + shared + prose(50) for _ in range(5)]  # a byte too short
    whole = prose(2500)
    for i in range(25):  # near copies
        at = int(rng.integers(0, 2500))
        texts.append(whole[:at] + f"#{i}#" + whole[at:])
    return texts + [whole] * 12 + [prose(1200)] * 2 + [prose(30_000)]


@pytest.mark.parametrize("bucket", [16 << 20, 20_000])
def test_suffix_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)  # small buckets: heads go on across boundaries
    texts = texts_with_repeats()
    docs = frame(spark, [(i if i % 9 else None, t, "en") for i, t in enumerate(texts)]).repartition(5)
    out = suffix_dedup.deduplicated(docs)
    got = sorted((r.n_bytes, sum(x.b - x.a for x in r.spans), len(r.spans), hashlib.sha256(r.text).hexdigest()) for r in out.collect())
    assert got == sorted(brute_removed(texts, 400))
    ids = {r.doc_id: r.n_bytes for r in out.collect()}
    assert all(ids[i] == len((t or "").encode()) for i, t in enumerate(texts) if i % 9)
    assert suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(0, 3, int(rng.integers(0, 400))).astype(np.uint8)) for _ in range(500)] + [b"", b"\0", b"\0\0", b"a" * 400] * 30
    order = suffix_dedup.multikey_quicksort(suffix_dedup._padded(strings, 400).view(">u8"), strings)
    assert sorted(order.tolist()) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
