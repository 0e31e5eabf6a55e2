"""Secret scans: patterns, and a battery of randomness tests, in Spark SQL functions alone.

Fixed kinds are found by their patterns, leftmost and non-overlapping. Beside them every long run of
token characters is a candidate. Its encoding is inferred from its characters, which gives the
alphabet of size k. Chi-squared of its symbol counts against a uniform alphabet says how random it
looks; a token whose halves of the alphabet alternate too rarely or too often (runs test), or whose
neighbours correlate (serial correlation), isn't random. Text repeats its symbols more: the number of
equal pairs in a text-like token of that length has a known mean and variance, and the chance that it is
as low as the token's falls with length, and within each stratum of encoding and length (powers of two) the
Benjamini-Hochberg rule over all documents' candidates fixes the level, so that about ``RATE`` of the
added spans are false. Levels are counted in steps of a tenth of a decade: a table of fixed size.

Edge cases: a null or empty text has no spans, and its digest is that of the empty string; repeated
rows give repeated results; an empty table gives no rows; a candidate that overlaps a pattern's span
is not added. Columns beside doc_id and text are ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Fixed patterns. ``access`` and ``hex`` hold their least length, as a shorter run can't hold a longer match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}", r"[A-Za-z0-9+/_=-]{20,}"
RATE, LARGEST = 0.01, 200
#: Sum of cubed shares of text's symbols, over the square of the sum of squared shares.
CUBES = 1.3
#: Encodings in order of trial: name, what it may hold, alphabet, and how far text in it is from uniform (sum of squared shares).
ENCODINGS = [
    ("hex", "^[0-9a-f]+$", "0123456789abcdef", 0.14),
    ("hexu", "^[0-9A-F]+$", "0123456789ABCDEF", 0.14),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    ("lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.065),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=", 0.065),
]
SPAN = "array<struct<s:int,k:int,e:int,t:string>>"


def spans(text: str, pattern: str, kind: int, least: tuple[int, int] | None = None) -> Column:
    """Matches of a pattern as structs (s, k, e, t); ``least`` = (group, length) drops matches whose group is shorter."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    keep = f", x -> length(x.g) >= {least[1]}" if least else ", x -> true"
    group = f"regexp_extract_all({text}, '{p}', {least[0] if least else 0})"
    return F.expr(f"""
        if(coalesce({text} rlike '{p}', false),
          transform(filter(aggregate(
            arrays_zip(regexp_extract_all({text}, '{p}', 0), slice(split({text}, '{p}', -1), 1, size(split({text}, '{p}', -1)) - 1), {group}),
            struct(0 as p, cast(array() as array<struct<s:int,e:int,t:string,g:string>>) as l),
            (a, x) -> struct(a.p + length(x.`1`) + length(x.`0`) as p,
              concat(a.l, array(struct(a.p + length(x.`1`) as s, a.p + length(x.`1`) + length(x.`0`) as e, x.`0` as t, x.`2` as g))) as l),
            a -> a.l){keep}), x -> struct(x.s as s, {kind} as k, x.e as e, x.t as t)),
          cast(array() as {SPAN}))""")


def _below(z: str) -> str:
    """Lower tail of the normal distribution, as SQL; close to exact in the far tail."""
    return f"if({z} < 0, exp(-({z}) * ({z}) / 2) / (1.64D * -({z}) + sqrt(0.76D * ({z}) * ({z}) + 4)), 1D)"


def battery(tokens: DataFrame) -> DataFrame:
    """Adds stratum (encoding and length) and level (-10 log10 p, whole) to rows with a token ``t``."""
    encoding = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        encoding = F.when(F.col("t").rlike(pattern), i).otherwise(encoding)
    pick = lambda values: F.array(*[F.lit(v) for v in values])[F.col("enc")]
    out = tokens.withColumn("enc", encoding).withColumn("alphabet", pick([a for _, _, a, _ in ENCODINGS]))
    out = out.withColumn("kk", F.length("alphabet").cast("double")).withColumn("share", pick([s for *_, s in ENCODINGS]))
    out = out.withColumn("n", F.length("t").cast("double"))
    out = out.withColumn("v", F.expr("transform(filter(split(t, ''), c -> c <> ''), c -> cast(locate(c, alphabet) as double))"))
    squares = F.expr("aggregate(array_distinct(split(t, '')), 0D, (a, c) -> a + if(c = '', 0D, power(length(t) - length(replace(t, c, '')), 2)))")
    out = out.withColumn("chi", F.col("kk") / F.col("n") * squares - F.col("n"))
    text_like = F.expr("(kk - 1) + (n - 1) * (kk * share - 1)")
    # of chi = kk / n * (2 * pairs of equal symbols + n) - n, whose pairs vary by themselves and through shared symbols
    pairs = "(n * (n - 1) / 2) * (share - share * share)"
    triples = f"n * (n - 1) * (n - 2) * {CUBES - 1} * share * share"
    spread = F.expr(f"2 * kk / n * sqrt({pairs} + {triples})")
    out = out.withColumn("z", (F.col("chi") - text_like) / spread)
    out = out.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    out = out.withColumn("high", F.expr("transform(v, x -> if(x > mean, 1, 0))"))
    out = out.withColumn("n1", F.expr("cast(aggregate(high, 0, (a, x) -> a + x) as double)")).withColumn("n2", F.col("n") - F.col("n1"))
    out = out.withColumn("runs", F.expr("1 + aggregate(zip_with(slice(high, 2, size(high) - 1), slice(high, 1, size(high) - 1), (a, b) -> if(a <> b, 1, 0)), 0, (a, x) -> a + x)"))
    out = out.withColumn("zr", F.expr("(runs - 1 - 2 * n1 * n2 / n) / sqrt(greatest(1e-9D, 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))))"))
    square = F.expr("greatest(1e-9D, aggregate(v, 0D, (a, x) -> a + power(x - mean, 2)))")
    across = F.expr("aggregate(zip_with(slice(v, 2, size(v) - 1), slice(v, 1, size(v) - 1), (a, b) -> (a - mean) * (b - mean)), 0D, (a, x) -> a + x)")
    out = out.withColumn("zs", across / square * F.sqrt("n"))
    mixed = F.expr("n1 > 1 and n2 > 1 and abs(zr) < 3.3 and abs(zs) < 3.3 and chi < kk - 1 + 5 * sqrt(2 * kk)")
    out = out.withColumn("p", F.when(mixed, F.expr(_below("z"))).otherwise(1.0))
    level = F.least(F.lit(LARGEST), F.floor(-10 * F.log10(F.greatest(F.col("p"), F.lit(1e-30)))).cast("int"))
    stratum = F.col("enc") * 64 + F.floor(F.log2("n")).cast("int")
    return out.select(*tokens.columns, stratum.alias("stratum"), F.greatest(F.lit(0), level).alias("level"))


def thresholds(candidates: DataFrame) -> dict[int, int]:
    """Least level per stratum by the Benjamini-Hochberg rule; at most 5 x 32 strata of 201 levels."""
    from pyspark.sql import Window

    counts = candidates.groupBy("stratum", "level").agg(F.count("*").alias("c"))
    down = Window.partitionBy("stratum").orderBy(F.desc("level"))
    rows = counts.select("stratum", "level", F.sum("c").over(down).alias("above"), F.sum("c").over(Window.partitionBy("stratum")).alias("m"))
    passed = rows.filter(F.pow(F.lit(10.0), -F.col("level") / 10) * F.col("m") <= RATE * F.col("above"))
    return {s: x for s, x in passed.groupBy("stratum").agg(F.min("level")).collect()}


def scan(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns with base (pattern spans) and added (random tokens): structs (s, k, e, t), k as in ``KINDS``."""
    found = docs.select(
        *columns,
        F.array_sort(F.concat(spans("text", ASSIGN, 0, (2, 12)), spans("text", ACCESS, 1), spans("text", HEX, 2))).alias("base"),
        spans("text", CANDIDATE, 3).alias("tokens"),
    )
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda y: (x.s < y.e) & (y.s < x.e)))
    found = written(found.select(*columns, "base", free.alias("tokens"), F.monotonically_increasing_id().alias("row")), "spans")
    tested = written(battery(found.select("row", F.explode("tokens").alias("x")).select("row", "x.*")), "tokens")
    least = thresholds(tested)
    if not least:
        return found.select(*columns, "base", F.expr(f"cast(array() as {SPAN})").alias("added"))
    limit = F.element_at(F.create_map(*[F.lit(v) for pair in least.items() for v in pair]), F.col("stratum"))
    added = tested.filter(F.col("level") >= limit).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "k", "e", "t"))).alias("added"))
    return found.join(added, "row", "left").select(*columns, "base", F.coalesce("added", F.expr(f"cast(array() as {SPAN})")).alias("added"))


KINDS = ("assign", "access", "hex", "random")


def listed(spans_: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(kinds, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans are one."""
    columns = docs.columns
    names = {"base": "secret_base", "added": "secret_added", "tokens": "secret_tokens", "row": "secret_row"}
    clash = {c: v for c, v in names.items() if c in columns}
    found = scan(docs.withColumnsRenamed(clash), *[clash.get(c, c) for c in columns])
    found = found.withColumn("secret_spans", F.array_sort(F.concat("base", "added"))).drop("base", "added")
    text = F.expr(f"""aggregate(secret_spans, struct(0 as p, '' as o),
        (a, x) -> struct(greatest(a.p, x.e) as p, if(x.s >= a.p, concat(a.o, substring(text, a.p + 1, x.s - a.p), '{mark}'), a.o) as o),
        a -> concat(a.o, substring(text, a.p + 1)))""")
    out = found.withColumn("text", F.when(F.size("secret_spans") > 0, text).otherwise(F.col("text"))).drop("secret_spans")
    return out.withColumnsRenamed({v: c for c, v in clash.items()}).select(*columns)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return scan(table(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
