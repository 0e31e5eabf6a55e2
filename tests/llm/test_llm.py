"""Training-data operators against brute force on small fixtures, with odd rows among them."""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from funnelkit.llm import jaccard, matrix_bpe, maxent, nn_descent, packing, quality, registry, rules, secrets_scan, tokens, toxicity, wavelet
from funnelkit.llm.common import shared_dir

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "  two  spaces \n\n and\ttabs ", "a\x00 \x00b \x00", "x" * 3000, "é" * 400 + "  ö", "<|endoftext|> is text", "a <|endoftext|> b", " <|endoftext|><|endoftext|>  <|endof", "end\n<|endoftext|>", "don't 's 12 !!  ",
    "one two three four", "word " * 700, "The same line.\nThe same line.\n", "\x85 \x1c 　 z",
]
PROSE = "It was a bright cold day in April, and the clocks were striking thirteen. " * 3


def frame(spark, texts, first=1):
    """doc_id, text, and extra columns whose names operators use themselves."""
    rows = [(first + i, t, "x", 1.5, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, score double, row long")


@pytest.fixture(scope="module")
def docs(spark):
    texts = [*ODD, PROSE, PROSE, *[f"{PROSE} and one more sentence, number {i}." for i in range(5)], "quite different words stand in this text"]
    return frame(spark, texts).unionByName(frame(spark, [None], first=900).selectExpr("cast(null as long) doc_id", "'no id here' text", "base", "score", "row"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts_of(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_packing(spark, docs, library):
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in packing.pack(docs, JSON).collect():
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, t in texts_of(docs).items():
        ids = little([*library(t), 0])
        got = sorted(pieces[d])
        assert b"".join(p[2] for p in got) == ids and all(p[4] * 4 == len(ids) and zlib.crc32(p[2]) == p[3] for p in got)
        assert [p[0] for p in got] == [sum(q[1] for q in got[:i]) for i in range(len(got))]
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 1024
    assert packing.pack(docs.limit(0), JSON).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        at = np.cumsum(rng.integers(1, 7, 12))
        penalty = rng.integers(0, 4, 12).astype(float)
        pos = [0, *at.tolist()]
        pad = lambda n: 0 if n & (n - 1) == 0 else 10 - n
        best = [0.0] + [math.inf] * 12
        for j in range(1, 13):
            best[j] = min(best[i] + pad(pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= 10) + penalty[j - 1]
        chosen = [0, *packing.cuts(at, penalty, 10)]
        cost = sum(pad(b - a) + penalty[pos.index(b) - 1] for a, b in zip(chosen, chosen[1:], strict=False))
        assert cost == best[12]


def test_wavelet_files(spark, docs, library):
    path = shared_dir(spark, "test")
    wavelet.write(docs, path, JSON, parts=3)
    got = wavelet.read(spark, path).orderBy("start").collect()
    want = sorted(texts_of(docs).items(), key=lambda x: (x[0] is not None, x[0]))
    at = 0
    for r, (d, t) in zip(got, want, strict=True):
        ids = [*library(t), 2]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, at, len(ids), little(ids)) and r.ids_crc32 == zlib.crc32(little(ids))
        at += len(ids)


def test_wavelet_rank_and_select():
    x = np.random.default_rng(0).integers(0, 300, 3000).astype(np.uint32)
    w, names, sizes = wavelet.load(wavelet.dump(x, [5, None], np.array([1000, 2000])))
    assert names == [5, None] and sizes.tolist() == [1000, 2000] and (w.all() == x).all()
    assert [w.access(i) for i in range(0, 3000, 61)] == x[::61].tolist()
    for v in [0, 7, 299, 100_000]:
        at = np.flatnonzero(x == v)
        assert w.count(v) == len(at) and w.count(v, 100, 900) == ((at >= 100) & (at < 900)).sum()
        assert [w.select(v, k) for k in range(len(at))] == at.tolist()
    x = np.random.default_rng(1).integers(0, 40_000, 300_000).astype(np.uint32)
    w, _, _ = wavelet.load(wavelet.dump(x, [1], np.array([len(x)])))
    place = int(np.flatnonzero(x == x[77_777])[0])
    assert (w.access(77_777), w.select(int(x[77_777]), 0)) == (x[77_777], place)
    opened = [len(p.opened) for p in w.planes]
    assert max(opened) <= 4 < len(w.planes[0]._offsets) - 1  # a look-up unpacks the chunks it passes
    assert w.count(int(x[77_777])) == (x == x[77_777]).sum() and (w.all() == x).all()


@pytest.mark.parametrize("top", [1, 2, 65_535, 65_536, 2**20])
def test_wavelet_of_any_width(top):
    x = np.append(np.random.default_rng(2).integers(0, top, 5000), top).astype(np.uint32)
    got = wavelet.load(wavelet.dump(x, [1], np.array([len(x)])))[0].all()
    assert got.dtype == np.uint32 and (got == x).all()


def test_wavelet_costs_less_than_masks():
    x = np.random.default_rng(3).integers(0, 50_257, 1 << 18).astype(np.uint32)

    def masks():
        now, planes = x.astype(np.uint16), []
        for b in range(15, -1, -1):
            one = (now >> b) & 1 != 0
            planes.append(np.packbits(one))
            now = np.concatenate([now[~one], now[one]])
        now = np.zeros(len(x), np.uint32)
        for b, plane in enumerate(reversed(planes)):
            one = np.unpackbits(plane, count=len(x)).view(bool)
            before, zeros = np.empty_like(now), len(x) - int(one.sum())
            before[~one] = now[:zeros]
            before[one] = now[zeros:] | np.uint32(1 << b)
            now = before
        return now

    def seconds(f):
        began = time.thread_time()
        assert (f() == x).all()
        return time.thread_time() - began

    assert min(seconds(lambda: wavelet.WaveletMatrix.build(x).all()) for _ in range(7)) < 0.85 * min(seconds(masks) for _ in range(7))


def test_signs_after_words_need_no_pattern_and_stretches_one_look_up(library):
    class Slots(dict):
        looked = 0

        def get(self, *key):
            Slots.looked += 1
            return dict.get(self, *key)

        def __contains__(self, key):
            Slots.looked += 1
            return dict.__contains__(self, key)

        def __getitem__(self, key):
            Slots.looked += 1
            return dict.__getitem__(self, key)

    texts = ["a word### grün... it's 'tis rock''n'roll's. a'.'s b'?.s don't!!! x.'s y's,'t", "naïve— “quote”… 日本語。 5% .5 _a_ \x00?! ~", "", "é.\nB c...\n\nD"]
    encode = tokens._library_encoder(JSON, 1000)
    plain = getattr(encode, "_encode", encode)
    ids, n = encode(texts)
    assert n.tolist() == [len(library(t)) for t in texts] and ids.tolist() == [i for t in texts for i in library(t)]
    calls, findall = [], plain._findall
    plain._findall = lambda s: calls.append(s) or findall(s)
    plain._slot = Slots(plain._slot)
    ids, n = encode(["So wordy### mores... than (ever!!"])
    assert ids.tolist() == library("So wordy### mores... than (ever!!")
    assert calls == ["So", " (ever!!"] and Slots.looked == 5


def test_stretches_end_at_line_breaks(library):
    ends, heads = [f"last{c}." for c in "abcdefghij"], [f"First{c}" for c in "abcdefghij"]
    texts = [f"so {a}\n{b} on" for a in ends for b in heads]
    encode = tokens._library_encoder(JSON, 1000)
    plain, calls = getattr(encode, "_encode", encode), []
    findall = plain._findall
    plain._findall = lambda s: calls.append(s) or findall(s)
    ids, n = encode(texts)
    assert ids.tolist() == [i for t in texts for i in library(t)] and n.tolist() == [len(library(t)) for t in texts]
    assert len(plain._slot) == 23 and len(calls) == 12  # not each end with each head: so, on, a line break, ends and heads
    rng = np.random.default_rng(5)
    signs = [*"ab'.,!s \n\t\r_1", "  ", "\n\n", "\x00", "\x85", "\xa0", "é", "×", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "”", "日", "\u2080", "😀"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 12))) for _ in range(3000)]
    ids, n = encode([*texts, None])
    assert n.tolist() == [*(len(library(t)) for t in texts), 0] and ids.tolist() == [i for t in texts for i in library(t)]
    assert encode([None, ""])[1].tolist() == [0, 0] and encode([])[1].tolist() == []


def test_packing_keeps_few_stretches(spark, library, monkeypatch):
    texts = [" ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{i}." for k in range(300)) for i in range(40)]
    encode, most = tokens._library_encoder(JSON, 500), 0
    plain = getattr(encode, "_encode", encode)
    for t in texts:
        assert encode([t])[0].tolist() == library(t)
        most = max(most, len(plain._slot))
    assert most <= 500 + 300
    rows = [(i, t) for i, t in enumerate(texts)]
    pieces = collections.defaultdict(dict)
    few = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(few, JSON, cache=500, chars=4000).collect()
    assert got == packing.pack(few, JSON).collect()
    for r in got:
        pieces[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in pieces.items()} == {i: [*library(t), 0] for i, t in rows}
    given = {}
    monkeypatch.setattr(packing, "pack", lambda docs, path, **kw: given.update(kw))
    corpus_pipeline.pack(spark, None, "")
    assert given["cache"] < tokens.CACHE_ENTRIES and given["chars"] < packing.CHARS


def test_matrix_bpe(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in matrix_bpe.encoded(docs, ranks=RANKS).collect()}
    for d, t in texts_of(docs).items():
        assert got[d] == (little(library.encode_ordinary(t or "")), (t or "").encode())
    bpe = matrix_bpe.MatrixBPE(RANKS)
    rng = np.random.default_rng(1)
    for word in ["ab" * 200, "".join(rng.choice(list("abcdé"), 700)), "a" * 90]:
        assert bpe.encode([word.encode()]) == [library.encode_ordinary(word)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(sets):
    head = {d: d for d in sets}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.mark.parametrize("length", [64, 100])
def test_packing_cuts_cost_least(length):
    """Cut places against a plain dynamic programme over all pairs of places."""
    rng = np.random.default_rng(length)
    for _ in range(20):
        ids, closing = rng.integers(0, 30, int(rng.integers(1, 900))), np.arange(30) < rng.integers(2, 8)
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 5), len(ids)))
        at, penalty = packing.places(ids, ends, closing)
        assert {*ends.tolist(), *(np.flatnonzero(closing[ids]) + 1).tolist()} <= set(at.tolist()) and (penalty[np.isin(at, ends)] == 0).all()
        at, penalty = np.arange(1, len(ids) + 1), np.where(np.isin(np.arange(1, len(ids) + 1), at), 1.0, 24.0)
        padding = lambda n: 0 if n & (n - 1) == 0 else length - n
        price = dict(zip([0, *at.tolist()], [0.0, *penalty.tolist()], strict=True))
        best = {0: 0.0}
        for j in at.tolist():
            best[j] = price[j] + min(best[i] + padding(j - i) for i in range(max(0, j - length), j))
        chosen = packing.cuts(at, penalty, length)
        assert chosen[-1] == len(ids)
        assert sum(price[b] + padding(b - a) for a, b in itertools.pairwise([0, *chosen])) == best[len(ids)]


def test_jaccard_components(spark, docs):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    near = []
    for _ in range(60):  # one large group of near copies, wider than a column whose pairs all come
        w = list(base)
        w[int(rng.integers(60))] = f"q{rng.integers(1000)}"
        near.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(30))
    far = [" ".join([passage, *[f"u{k}x{i}" for i in range(int(rng.integers(3, 40)))]]) for k in range(50)]
    all_docs = docs.unionByName(frame(spark, near + far + near[:10], first=1000))
    got = jaccard.near_duplicates(all_docs).collect()
    sets = {d: shingles(t) for d, t in texts_of(all_docs).items() if d is not None}
    want = linked(sets)
    assert len(got) == all_docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == ((len(sets[r.doc_id]), want[r.doc_id]) if r.doc_id is not None else (1, None))
    kept = jaccard.deduplicated(all_docs)
    assert kept.columns == all_docs.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(set(want.values()))
    assert [r.text for r in rows if r.doc_id is None] == ["no id here"]


def test_deduplicated_rows_differ_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = frame(spark, [a, b, b, a, c, None]).selectExpr("case doc_id when 1 then 7 when 2 then 7 when 3 then 7 when 4 then null when 5 then null else 6 end doc_id", "text", "base own_id", "row OWN_ID_")
    got = sorted(((r.doc_id, r.text) for r in jaccard.deduplicated(docs).collect()), key=str)
    assert got == sorted([(7, a), (7, b), (None, c), (6, None)], key=str)


def test_jaccard_links_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 1)  # every column is dealt to two blocks or more
    texts = []
    for i in range(60):
        w = [f"d{i}w{k}" for k in range(11)]
        texts += [" ".join(w[:10]), " ".join(w)]
    texts += [texts[0]] * 40
    many = frame(spark, texts)
    want = linked({d: shingles(t) for d, t in texts_of(many).items()})
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(many).collect()} == want


def test_jaccard_unlinked_classes_of_wide_columns(spark, monkeypatch):
    """Classes that share much, but too little for a link, are told apart without reading their whole rows."""
    monkeypatch.setattr(jaccard, "SMALL", 8)
    verified, possible = [], jaccard._possible

    def counted(pairs):
        verified.append((out := possible(pairs)).count())
        return out

    monkeypatch.setattr(jaccard, "_possible", counted)
    base = [f"b{i}" for i in range(40)]
    texts = [" ".join([*base, *[f"v{k}x{i >> k & 1}w{j}" for k in range(5) for j in range(12)]]) for i in range(32)]
    texts += [f"{texts[5]} more", " ".join(base), " ".join([*base[:20], *texts[9].split()])]
    docs = frame(spark, texts)
    want = linked({d: shingles(t) for d, t in texts_of(docs).items()})
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    assert sum(verified[1:]) < 30  # in the rounds; of 496 pairs


def test_jaccard_incidence_orders_by_exact_counts(spark, monkeypatch):
    """A row whose first part holds items of its own only has no rows; items that most rows have come last in the others."""
    monkeypatch.setattr(jaccard, "ROWS", 3)  # chunks of three rows
    shared = " ".join(f"s{i}" for i in range(30))
    texts = [shared + " " + " ".join(f"u{k}x{i}" for i in range(16)) for k in range(12)] + [shared + " " + " ".join(f"t{i}" for i in range(10 + k)) for k in range(2)]
    rows = jaccard.incidence(jaccard.shingle_sets(frame(spark, texts))).collect()
    assert {r.doc for r in rows} == {13, 14}
    docs = {d: [r for r in rows if r.doc == d] for d in (13, 14)}
    for d, some in docs.items():
        n = len(shingles(texts[d - 1]))
        alone = d - 13  # the longer text has one shingle of its own
        assert len(some) == n - math.ceil(0.75 * n) + 1 - alone and {r.n for r in some} == {n}
    assert len({r.col for r in docs[13]} & {r.col for r in docs[14]}) >= 9


def test_jaccard_empty(spark, docs):
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["river", "stone", "green", "window", "paper", "music", "garden", "winter"]
    texts, marks = [], []
    for i in range(400):
        w = list(rng.choice(vocabulary, 20))
        if i % 4 == 0:
            w[int(rng.integers(20))] = "idiot"
            w[int(rng.integers(20))] = "moron"
        texts.append(" ".join(w))
        marks.append(int(i % 4 == 0))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i + 1, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    probe = frame(spark, ["you 1d10t river", "m o r o n of stone", "iiidiot garden", "i.d.i.o.t", "green window paper", None, "", "a " * 5000, "100% of $500, #1 1,000"])
    got = [r.toxicity >= 0.5 for r in toxicity.scored(probe, model).orderBy("doc_id").collect()]
    assert got == [True] * 4 + [False] * 5
    assert toxicity.scored(probe.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.toxicity for r in toxicity.scored(probe, none).collect()} == {0.0}


def test_decoder_against_all_readings():
    rng = np.random.default_rng(7)
    texts = ["the stone was green and the river was wide", "a moron and an idiot sat in the garden", "wind and winter"]
    s = toxicity._symbols("  ".join(["", *texts, ""]).encode())
    three = np.zeros((28, 28, 28))
    np.add.at(three, (s[:-2], s[1:-1], s[2:]), 1)
    model = np.log((three + 0.1) / (three + 0.1).sum(2, keepdims=True))
    code = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
    for token in ["1d10t", "m0r0n", "g@rd3n", "w!nd", "iiidiot", "a.n.d", "s a t", "$t0n3", *["".join(rng.choice(list("a1o0.t!"), 5)) for _ in range(15)]]:
        best = -math.inf
        for path in itertools.product(*toxicity.readings(token), [(" ", 0.0)]):
            text = "".join(t for t, _ in path)
            x, y, score = 0, 0, -sum(c for _, c in path)
            for c in text:
                score += model[x, y, code(c)]
                x, y = y, code(c)
            if score > best:
                best, likeliest = score, {text.strip()}
            elif score == best:
                likeliest.add(text.strip())
        assert toxicity.decode(token, model.ravel().tolist()) in likeliest


def test_character_model_does_not_depend_on_layout(spark):
    texts = [f"text number {i} of some {'long ' * (i % 5)}prose" for i in range(40)] + [None, "", "x"]
    one, many = (toxicity.character_model(frame(spark, texts).repartition(n)) for n in (1, 8))
    assert (one == many).all()


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (7, rows[7][1])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y, hit = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 400, 20))
    for q, found in got.items():
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:10]
        hit += len({i for i, _ in found} & set(want.tolist()))
        assert len(found) == 10 and all(abs(s[i] - v) < 1e-9 for i, v in found)
    assert hit >= 0.9 * 200
    assert nn_descent.nearest(vectors.limit(0), vectors.limit(0), 10).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<float>")
    equal = nn_descent.nearest(same, same.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in equal) == sorted((q, k + 1, v) for q in (0, 20, 40) for k, v in enumerate([i for i in range(60) if i != q][:20]))
    one = same.filter("vec_id = 0")
    assert nn_descent.nearest(one, one, 20).count() == 0


def test_nearest_neighbours_from_a_poor_graph(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "TREES", 2)
    monkeypatch.setattr(nn_descent, "BLOCK", 16)  # far below the table
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((100, 24))[np.arange(4000) % 100] + 0.7 * rng.standard_normal((4000, 24))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect():
        got[r.query_id].add(r.vec_id)
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    hits = [len(got[q] & set(np.argsort(-s[q])[:20].tolist())) for q in range(0, 4000, 20)]
    assert sum(hits) >= 0.95 * 20 * len(hits), sum(hits) / 20 / len(hits)


def test_rules(spark, docs):
    for r in rules.described(docs).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (r.text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), dup, len(repeat))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
    x = {"a": np.arange(300.0), "b": np.tile([0.0, 1.0, 2.0], 100)}
    bad = (x["a"] >= 200) & (x["b"] >= 1)
    learnt = rules.learn(x, bad)
    caught = np.any([rules.holds(r, x) for r in learnt], axis=0)
    assert (caught == bad).mean() > 0.98
    assert rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_secrets(spark, docs):
    key = base64.b64encode(hashlib.sha512(b"k").digest()).decode().rstrip("=")
    more = [f'PassWord: "{key[:20]}" é AKIA{"Q7" * 8} ok', "password=token: abcdefghijklmnop", "deadbeef" * 4 + " api-key='short'", f"see {key} there", "token=" + "a" * 5000]
    all_docs = docs.unionByName(frame(spark, more, first=100))
    assign = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in secrets_scan.scan(all_docs, "doc_id", "text").collect():
        t = r.text or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [(x.s, x.k, x.e) for x in r.base] == sorted(want)
    clean = secrets_scan.redacted(all_docs)
    assert clean.columns == all_docs.columns
    texts = texts_of(clean)
    assert texts[100] == '[secret]" é [secret] ok' and texts[1] is None and texts[2] == ""
    assert secrets_scan.scan(all_docs.limit(0), "doc_id").count() == 0


def test_random_tokens_of_many_lengths(spark):
    """Random tokens are added, words run together are not, among as many of either."""
    rng = np.random.default_rng(9)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    words = "the quick brown fox jumps over a lazy dog while every morning people in this quiet village walk to their market and buy some bread".split()
    rows, planted, plain = [], 0, 0
    for i in range(400):
        n = int(rng.integers(24, 65))
        if i % 2:
            rows.append("see " + "".join(rng.choice(alphabet, n)) + " there")
            planted += 1
        else:
            rows.append("see " + "".join(w.title() if rng.random() < 0.3 else w for w in rng.choice(words, 20))[:n] + " there")
            plain += 1
    found = {r.doc_id: len(r.added) for r in secrets_scan.scan(frame(spark, rows), "doc_id").collect()}
    hits = sum(found[i + 1] for i in range(400) if i % 2) / planted
    false = sum(found[i + 1] for i in range(400) if not i % 2) / max(1, sum(found.values()))
    assert hits >= 0.75 and false <= 0.05, (hits, false)  # 0.795 and 0.025


def test_quality(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(rng.choice([f"w{i}" for i in range(200)], 80)) for _ in range(150)]
    bad = [" | ".join(["BUY!!"] * 60) for _ in range(50)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i + 1, int(i < 150)) for i in range(200)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    kept = {r.doc_id for r in quality.resampled(docs, model).filter("kept").collect()}
    assert kept == set(range(1, 151))
    odd = frame(spark, [None, "", "x" * 100_000])
    assert [r.log_importance for r in quality.scored(odd, model).orderBy("doc_id").limit(2).collect()] == [0.0, 0.0]
    assert quality.fit(docs, labels.limit(0)).level == -math.inf


def test_language_model(spark, docs):
    got = {r.doc_id: r for r in maxent.score(docs).collect()}
    cut = {d: [*(t or "").encode().lower().split(), None] for d, t in texts_of(docs).items()}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d in cut}
    c = collections.Counter(w for d, t in cut.items() if not held[d] for w in t)
    total, size = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    for d, t in cut.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(c[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / size) for w in t))
        assert r.score <= 0
    group, member = maxent.predict(np.random.default_rng(0).standard_normal((maxent.FEATURES, maxent.GROUPS + maxent.CLASSES)), np.arange(50))
    assert np.allclose((group[:, :, None] * member).sum((1, 2)), 1)
    assert maxent.score(docs.limit(0)).count() == 0


def test_language_model_words_and_histories():
    index = maxent.Indexer(maxent.Lexicon({maxent.hashed(maxent.END): 0, maxent.hashed(b"the"): 1}, {maxent.hashed(b"the"): 5}))
    for _ in range(2):  # the second time all words are known
        texts = [*ODD, None, " \x0b\x0c\r the THE \u00c9\u2003x \x00\x1c", "the"]
        at, begin = index(texts)
        want = [[*(t or "").encode().lower().split(), maxent.END] for t in texts]
        assert np.diff(begin, append=len(at)).tolist() == [len(w) for w in want]
        flat = [w for x in want for w in x]
        assert index.h[at].tolist() == [maxent.hashed(w) for w in flat]
        classes = [0 if w == maxent.END else 1 if w == b"the" else maxent.spelling(w) for w in flat]
        assert index.cls[at].tolist() == classes
        assert [None if math.isnan(x) else x for x in index.log[at]] == [math.log10(5.1) if w == b"the" else None for w in flat]
        past = []
        for w, b in zip(want, begin, strict=True):
            own = [maxent.START, maxent.START, *classes[b : b + len(w)]]
            past += [x * (maxent.CLASSES + 1) + y for x, y in itertools.pairwise(own[:-1])]
        assert maxent.histories(np.array(classes), begin).tolist() == past
    assert [len(x) for x in index([])] == [0, 0]


def test_language_model_meets_each_history_once(spark, monkeypatch):
    rows = [(h, c, 1 + h * c % 7) for h in range(60) for c in range(128)]
    triples = spark.createDataFrame(rows, "history long, class long, n long").repartition(4, "class")
    seen, real = spark.sparkContext.accumulator(0), maxent.predict
    monkeypatch.setattr(maxent, "predict", lambda weights, history: (seen.add(len(history)), real(weights, history))[1])
    monkeypatch.setattr(maxent, "UPDATES", 1)
    weights = maxent.train(triples)
    # a batch may end within a history, so a few come twice
    assert 60 <= seen.value <= 60 + 8 and np.isfinite(weights).all() and weights.any()


def test_pipeline_keeps_columns_and_handles_odd_rows(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clash = {c: i for i, c in enumerate(["toxicity", "Kept", "log_importance", "sample_key", "y", "own_id", "lang", "n_chars"])}
    now = docs.selectExpr("*", *[f"cast({v} as long) `{c}`" for c, v in clash.items()])
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns
        assert name == "secret scans" or {r.Kept: r.toxicity for r in now.select("Kept", "toxicity").distinct().collect()} == {1: 0}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert packed.count() >= now.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "secret scans", "packing"]


def test_pipeline_end_to_end(spark, tmp_path, library):
    """``run`` over whole tables: toxic and bad documents go, one of each group stays, secrets are replaced, the rest is packed whole."""
    rng = np.random.default_rng(12)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(420):
        w = list(rng.choice(vocabulary, 70))
        if i % 6 == 0:
            w[5] = w[20] = "idiot"
        text = " | ".join(["BUY!!"] * 60) + f" {i}" if i % 7 == 3 else " ".join(w)
        rows.append((i, text))
        labels.append((i, int(i % 7 != 3), int(i % 6 == 0 and i % 7 != 3)))
    clean = [i for i, (_, q, x) in enumerate(labels) if q and not x]
    rows[clean[0]] = (clean[0], rows[clean[0]][1] + " token=abcdefghij0123456789 end")
    rows += [(1000, rows[clean[1]][1]), (1001, rows[clean[2]][1] + " tail"), (1002, "you 1d10t " + " ".join(rng.choice(vocabulary, 60)) + " m0ron")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = collections.defaultdict(dict)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id][r.start] = bytes(r.ids)
    assert not {1000, 1001, 1002} & pieces.keys() and not [i for i, _, x in labels if x and i in pieces]
    kept = set(pieces) & set(clean)
    assert len(kept) >= 0.95 * len(clean) and len(set(pieces) - kept) <= 0.05 * len(rows)
    texts = dict(rows)
    for d in kept:
        text = texts[d].replace("token=abcdefghij0123456789", "[secret]")
        assert b"".join(pieces[d][s] for s in sorted(pieces[d])) == little([*library(text), 0])


def test_registered():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES] == list(range(1, 14))
    assert isinstance(tokens.library_encoder(JSON)(["a b"])[0], np.ndarray)
