"""Phrase collocations by SON partitioning: shards mined completely at a lowered support, then exact global counts.

A shard is a run of texts of one language (about ``SHARD`` characters), kept as a table of word codes.
For each length in turn a shard reports every phrase that it holds at least ``ceil(support * share)``
times, ``share`` being its part of the language's words. A phrase that no shard reports occurs less
often than the support (the shards' lowered supports less one add up to less than it), so the union of
the reports has all frequent phrases; those that could still reach the support with what shards may
have kept back are the candidates. Shards with a lowered support above one then add what they kept
back of them, and the sums are exact. Before a shard mines a length it passes over phrases whose
parts are not frequent: a bit table of at most ``MAX_BITS`` bits tells them, and where it errs it
costs time only.

One shard, picked by hash, writes each frequent phrase out with the hashes of its parts. Counts of the
parts are joined; those of at least 1/``HOT`` of all words (at most ``HOT`` words and as many pairs) go
to every task, so no key of the shuffled joins has more than a small share of the rows.

Edge cases: null and empty texts have no words; a null lang is ``und``; repeated rows all count; a
piece of one word gives no phrase; an empty table gives no rows; extra columns are ignored; ties of
score and count go by the UTF-8 bytes of the phrase. 64-bit hashes of distinct phrases are taken to
differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table, written

SHARD, MAX_BITS, HOT = 4_000_000, 1 << 27, 10_000
_FIXED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_SHARDS = "shard long, lang string, n long, words binary, codes binary"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the phrase made of two phrases with these hashes; joining is not associative, so cuts stay distinct by use."""
    z = (a ^ (a >> np.uint64(29))) * _M1 + (b ^ (b >> np.uint64(31))) * _M2
    z ^= z >> np.uint64(32)
    return z * _M2


def shards(docs: DataFrame) -> DataFrame:
    """Texts as runs of one language: distinct words (space-joined) and the code of each word in order, -1 between pieces."""

    def cut(lang: str, texts: list[bytes], shard: int) -> list:
        # a break stands alone as a word of its own: "\n"
        flat = b" \n ".join(texts).translate(_FIXED).replace(b"\n", b" \n ")
        parts = pc.split_pattern(pa.array([flat], pa.large_binary()), b" ").values.dictionary_encode()
        names = np.array(parts.dictionary.to_pylist(), object)
        index = parts.indices.to_numpy()
        new = np.full(len(names), -2, np.int32)
        word = np.array([w not in (b"", b"\n") for w in names], bool)
        new[word] = np.arange(word.sum(), dtype=np.int32)
        new[names == b"\n"] = -1
        codes = new[index]
        codes = codes[codes != -2]
        codes = codes[(codes >= 0) | np.append(codes[1:] >= 0, False)]  # one break between pieces
        return [shard, lang, int((codes >= 0).sum()), b" ".join(names[word]), codes.astype("<i4").tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        task, made = TaskContext.get().partitionId(), 0

        def out(lang: str) -> pa.RecordBatch:
            nonlocal made
            made += 1
            row = cut(lang, held.pop(lang), xxhash.xxh3_64_intdigest(f"{task} {made}") >> 1)
            del size[lang]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row[:3]] + [pa.array([x], pa.binary()) for x in row[3:]], ["shard", "lang", "n", "words", "codes"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if text:
                    lang = "und" if lang is None else lang
                    held.setdefault(lang, []).append(text.encode())
                    size[lang] = size.get(lang, 0) + len(held[lang][-1])
                    if size[lang] >= SHARD:
                        yield out(lang)
                    elif sum(size.values()) >= 2 * SHARD:
                        yield out(max(size, key=size.__getitem__))
        for lang in list(held):
            yield out(lang)

    return docs.select("lang", "text").mapInArrow(run, _SHARDS).filter("n > 0")


class _Shard:
    """One shard's words and phrases as arrays; phrases of length k start at ``at`` and have the hashes ``h``."""

    def __init__(self, lang: str, words: bytes, codes: bytes):
        self.words = words.split(b" ")
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        self.codes = np.frombuffer(codes, "<i4").astype(np.int64)

    def counted(self, size: int, sieves: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, counts and a start of the distinct phrases of a length whose parts pass the sieves."""
        c = self.codes
        if size == 1:
            n = np.bincount(c[c >= 0], minlength=len(self.words))
            return self.hash, n, np.zeros(len(n), np.int64)
        ok = np.append(_has(sieves[0], self.hash), False)  # code -1, a break, is never in
        good = ok[c]
        at = np.flatnonzero(good[:-1] & good[1:])
        key, first, pair, n = np.unique(c[at] * len(self.words) + c[at + 1], return_index=True, return_inverse=True, return_counts=True)
        h = _mix(self.hash[key // len(self.words)], self.hash[key % len(self.words)])
        if size == 2:
            return h, n, at[first]
        fit = _has(sieves[1], h)[pair]
        last = np.flatnonzero(fit[:-1] & fit[1:] & (at[1:] == at[:-1] + 1))
        key, first, n = np.unique(pair[last] * len(self.words) + c[at[last] + 2], return_index=True, return_counts=True)
        return _mix(h[key // len(self.words)], self.hash[key % len(self.words)]), n, at[last[first]]


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(20)) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sieve(found: DataFrame) -> np.ndarray:
    """A table with the bits of all hashes h set, some 16 bits a hash up to ``MAX_BITS``."""
    bits = 1 << 16
    many = 16 * found.count()
    while bits < min(many, MAX_BITS):
        bits *= 2
    at = found.select((F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(bits - 1))).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint8)


def _mined(kept: DataFrame, size: int, sieves: list, reported: bool, candidates: np.ndarray | None = None) -> DataFrame:
    """h, c, pick (h combined with the shard) of a shard's phrases: those with its lowered support, or of the others the candidates."""
    bit_tables = kept.sparkSession.sparkContext.broadcast([*sieves, candidates])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        *held, wanted = bit_tables.value
        for b in batches:
            for r in b.to_pylist():
                h, n, _ = _Shard(r["lang"], r["words"], r["codes"]).counted(size, held)
                take = n >= r["lowered"] if reported else (n < r["lowered"]) & _has(wanted, h)
                h, n = h[take].view(np.int64), n[take]
                for i in range(0, len(h), 100_000):
                    x = h[i : i + 100_000]
                    slack = np.full(len(x), r["slack"], np.int64)
                    yield pa.record_batch([x, n[i : i + 100_000].astype(np.int64), slack, x ^ r["shard"]], ["h", "c", "slack", "pick"])

    return kept.mapInArrow(run, "h long, c long, slack long, pick long")


def frequent(kept: DataFrame, size: int, sieves: list, support: int, lowered: bool) -> DataFrame:
    """h, c, pick of all phrases of a length that occur ``support`` times, counted exactly."""
    sums = [F.sum("c").alias("c"), F.min("pick").alias("pick")]
    mined = _mined(kept, size, sieves, True)
    if lowered:
        mined = written(mined, f"mined{size}")
        union = mined.repartition("h").groupBy("h").agg(F.sum("c").alias("c"), F.max("slack").alias("slack")).filter(F.col("c") + F.col("slack") >= support)
        rest = _mined(kept.filter("lowered > 1"), size, sieves, False, sieve(written(union.select("h"), "union")))
        mined = mined.unionByName(rest)
    # a shard has each phrase once, so summing before the shuffle would only fill memory
    return written(mined.repartition("h").groupBy("h").agg(*sums).filter(F.col("c") >= support), f"frequent{size}")


def _described(kept: DataFrame, found: DataFrame, sieves: list) -> DataFrame:
    """Text, parts and count of each frequent phrase, each from the one shard that its ``pick`` names."""
    asked = found.select(F.col("pick").bitwiseXOR(F.col("h")).alias("of"), "h", "c", "size")
    asked = asked.groupBy("of").agg(F.collect_list(F.struct("h", "c", "size")).alias("asked"))
    rows = kept.join(asked, kept["shard"] == asked["of"]).select("lang", "words", "codes", "asked")
    bit_tables = kept.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for b in batches:
            for i in range(b.num_rows):
                lang, words, codes, asked = (b.column(c)[i] for c in ("lang", "words", "codes", "asked"))
                shard = _Shard(lang.as_py(), words.as_py(), codes.as_py())
                h, c, size = (asked.values.field(k).to_numpy() for k in range(3))
                for k in (2, 3):
                    mine = size == k
                    if not mine.any():
                        continue
                    known, _, start = shard.counted(k, bit_tables.value)
                    order = np.argsort(known)
                    at = start[order[np.searchsorted(known, h[mine].view(np.uint64), sorter=order)]]
                    w = [shard.hash[shard.codes[at + j]] for j in range(k)]
                    text = [b" ".join(shard.words[x] for x in shard.codes[s : s + k]).decode() for s in at]
                    parts = [w[0], w[1]] if k == 2 else [w[0], _mix(w[1], w[2]), _mix(w[0], w[1]), w[2]]
                    parts = [p.view(np.int64) for p in parts] + [np.zeros(len(at), np.int64)] * (4 - len(parts))
                    columns = [pa.array([lang.as_py()] * len(at), pa.string()), h[mine], pa.array(text, pa.string()), size[mine], c[mine], *parts]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["lang", "h", "phrase", "size", "a", "l1", "r1", "l2", "r2"])

    return rows.mapInArrow(run, "lang string, h long, phrase string, size int, a long, l1 long, r1 long, l2 long, r2 long")


def _looked_up(rows: DataFrame, key: str, counts: DataFrame, total: int, name: str) -> DataFrame:
    """``rows`` with the count of ``key``; keys with a large share of all words are few and go to every task."""
    hot = counts.filter(F.col("c") * HOT >= total).select(F.col("h").alias(key), F.col("c").alias(name))
    often = rows.join(F.broadcast(hot), key, "left")
    rest = counts.filter(F.col("c") * HOT < total).select(F.col("h").alias(key), F.col("c").alias(name))
    rare = often.filter(F.col(name).isNull()).drop(name).join(rest, key)
    return often.filter(F.col(name).isNotNull()).unionByName(rare)


def collocations(docs: DataFrame, support: int = 10, covered: int = 50, best: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 or 3 words that no longer phrase covers.

    ``covered``: a phrase goes if a longer one that holds it has that percentage of its occurrences;
    ``best``: rows a language (None: all).
    """
    cut = written(shards(docs), "shards")
    langs = cut.groupBy("lang").agg(F.sum("n").alias("total"))
    share = F.ceil(F.lit(support).cast("decimal(20,0)") * F.col("n") / F.col("total")).cast("long")
    sizes = cut.select("shard", "lang", "n").join(langs, "lang")
    sizes = sizes.withColumn("lowered", F.greatest(F.lit(1).cast("long"), share))
    langs = written(sizes.groupBy("lang").agg(F.max("total").alias("total"), F.sum(F.col("lowered") - 1).alias("slack"), F.max("lowered").alias("most")), "langs")
    total, most = langs.agg(F.sum("total"), F.max("most")).first()
    if not total:
        return cut.selectExpr("lang", "1 rank", "lang phrase", "n a", "n l", "n r", "n", "n score").limit(0)
    kept = cut.join(langs, "lang").withColumn("lowered", F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(support).cast("decimal(20,0)") * F.col("n") / F.col("total")).cast("long")))
    sieves: list[np.ndarray] = []
    found = []
    for size in (1, 2, 3):
        found.append(frequent(kept, size, sieves, support, most > 1))
        if size < 3:
            sieves.append(sieve(found[-1]))
    counts = found[0].unionByName(found[1]).select("h", "c")
    longer = found[1].withColumn("size", F.lit(2)).unionByName(found[2].withColumn("size", F.lit(3)))
    phrases = written(_described(kept, longer, sieves), "phrases")
    two = F.struct(F.lit(1).alias("k"), F.col("l1").alias("lh"), F.col("r1").alias("rh"))
    three = F.struct(F.lit(2).alias("k"), F.col("l2").alias("lh"), F.col("r2").alias("rh"))
    cuts = phrases.select("h", "a", F.explode(F.when(F.col("size") == 2, F.array(two)).otherwise(F.array(two, three))).alias("cut")).select("h", "a", "cut.*")
    cuts = _looked_up(_looked_up(cuts, "lh", counts, total, "l"), "rh", counts, total, "r")
    wide = {x: F.col(x).cast("decimal(19,0)") for x in "alr"}
    square = (wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    cuts = cuts.withColumns({"x": square, "y": (wide["l"] * wide["r"]).cast("decimal(38,0)")}).withColumn("score", F.expr("x div y"))
    least = cuts.groupBy("h").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("h", "cut.*")
    inside = phrases.filter("size = 3").select("a", F.explode(F.array("l2", "r1")).alias("h")).groupBy("h").agg(F.max("a").alias("longer"))
    out = phrases.select("lang", "h", "phrase", "a").join(least, "h").join(inside, "h", "left")
    out = out.filter(F.expr(f"longer is null or 100 * longer < {covered} * a"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if best is not None:
        out = out.filter(F.col("rank") <= best)
    out = out.join(langs.select("lang", F.col("total").alias("n")), "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_WORDS = "list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '')"
ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, {_WORDS} AS w FROM pieces),
runs AS (SELECT lang, w, len(w) AS n FROM words WHERE len(w) > 0),
one AS (SELECT lang, unnest(w) AS phrase FROM runs),
two AS (SELECT lang, unnest(list_transform(range(1, n), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM runs WHERE n >= 2),
three AS (SELECT lang, unnest(list_transform(range(1, n - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM runs WHERE n >= 3),
f AS (SELECT lang, phrase, len(string_split(phrase, ' ')) AS size, count(*)::HUGEINT AS a
      FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) GROUP BY 1, 2),
total AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY 1),
cuts AS (
  SELECT lang, phrase, size, a, k, list_aggregate(string_split(phrase, ' ')[1:k], 'string_agg', ' ') AS lp,
         list_aggregate(string_split(phrase, ' ')[k + 1:], 'string_agg', ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size >= 2 AND a >= 10)),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([list_aggregate(string_split(phrase, ' ')[1:2], 'string_agg', ' '), list_aggregate(string_split(phrase, ' ')[2:3], 'string_agg', ' ')]) AS part
    FROM least WHERE size = 3) GROUP BY 1, 2),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank, s.phrase, s.a, s.l, s.r, s.score
  FROM least s LEFT JOIN inside i ON i.lang = s.lang AND i.part = s.phrase WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a)
SELECT lang, rank::INTEGER AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
