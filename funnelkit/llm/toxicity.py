"""Toxicity by a noisy channel: Viterbi decoding of disguised words, then a score of the restored text.

A word that may be disguised (signs or digits among letters, a letter thrice or more, letters spaced
out or dotted) is a lattice of readings; the character trigram model of the corpus and a cost per
change choose the path. Plain words stand for themselves. The restored words of labelled training
rows give a lexicon (log odds of toxic against clean documents, those beyond chance), and a logistic
model of a document's lexicon hits gives the score.

Bounds: at most ``LABELS`` labelled rows are fitted on, and the lexicon holds words of theirs alone; the
character model counts all training documents. Edge cases: a null or empty text has no hits and gets
the score of a text without any; repeated rows score alike; without labels every score is 0; an
empty table gives no rows; columns beside doc_id and text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, rows_of, settle, small_batches, table, with_columns

LABELS, LEAST_Z, CACHE = 20_000, 5.0, 200_000
#: Signs and the letters they may stand for (fixed values).
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SPACERS, CHANGE, DROP = ".-_ ~'", 1.0, 0.5
_EDGE = ".,;:?\"'()[]{}<>«»…–—-_~!|"
_THRICE = re.compile(r"(.)\1\1")
_SIZE = 28


def training(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) != 0


def _symbols(text: bytes) -> np.ndarray:
    """0: a border, 1-26: a letter, 27: any other."""
    table_ = np.full(256, 27, np.int64)
    table_[list(b" \t\n\x0b\x0c\r.,;:!?")] = 0
    for i in range(26):
        table_[97 + i] = table_[65 + i] = i + 1
    return table_[np.frombuffer(text, np.uint8)]


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) over 28 symbols, from all texts of ``docs``; the counts have a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SIZE**3, np.int64)
        for (texts,) in rows_of(batches, "text"):
            # two borders around each text, so that no trigram spans two and the counts don't depend on batches
            s = _symbols("  ".join(["", *[t for t in texts if t], ""]).encode())
            if len(s) > 2:
                counts += np.bincount((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:], minlength=_SIZE**3)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(counts[at])], ["b", "c"])

    rows = docs.select("text").mapInArrow(run, "b int, c long").groupBy("b").agg(F.sum("c").alias("c")).collect()
    three = np.zeros(_SIZE**3)
    for b, c in rows:
        three[b] = c
    three = three.reshape(_SIZE, _SIZE, _SIZE)
    two = three.sum(0)
    one = (two.sum(0) + 1) / (two.sum() + _SIZE)
    p2 = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 20 * p2) / (three.sum(2, keepdims=True) + 20))


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice of a token: per character, its possible outputs and their costs."""
    out, i = [], 0
    while i < len(token):
        c = token[i]
        j = i
        while j < len(token) and token[j] == c:
            j += 1
        if c.isalpha() and j - i > 2:
            out.append([(c, DROP), (c * 2, DROP)])
            i = j
            continue
        if c in SPACERS:
            out.append([("", DROP), (" ", CHANGE)])
        elif c in SIGNS:
            out.append([*[(x, CHANGE) for x in SIGNS[c]], ("", 3 * CHANGE) if c in "*#%!|" else (c, 3 * CHANGE)])
        else:
            out.append([(c, 0.0)])
        i += 1
    return out


def decode(token: str, model: list[float]) -> str:
    """The likeliest reading of a token under the character model, by Viterbi over the last two characters."""
    code = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in [*readings(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in best.items():
            for text, cost in options:
                x, y, s = a, b, score - cost
                for c in text:
                    z = code(c)
                    s += model[(x * _SIZE + y) * _SIZE + z]
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (path, text))
        best = after
    _, path = max(best.values(), key=lambda v: v[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out)).strip()


class Restorer(dict):
    """Restored words by token, decoded on first sight while the cache lasts; ``among`` keeps only those words."""

    def __init__(self, model: np.ndarray, among: dict[str, float] | None = None):
        super().__init__()
        self._model, self._among = model.ravel().tolist(), among

    def __missing__(self, token: str) -> tuple[str, ...]:
        found = self._token(token)
        if self._among is not None:
            found = tuple([w for w in found if w in self._among])
        self[token] = found
        return found

    def _token(self, token: str) -> tuple[str, ...]:
        bare = token.strip(_EDGE)
        if not bare:
            return ()
        if bare.isalpha() and not _THRICE.search(bare):
            return (bare,)
        number = bare.strip("$#+%*")
        if not any("a" <= c <= "z" for c in bare) and (len(number) < 2 or not any(c in SIGNS and not c.isdigit() for c in number)):
            return (bare,)  # digits, a price, a share
        marks = token.strip(_EDGE.replace("!", "").replace("|", "").replace("(", "").replace("<", ""))
        return tuple(dict.fromkeys([*decode(bare, self._model).split(), *(decode(marks, self._model).split() if marks != bare and any(c in SIGNS for c in marks.rstrip("!|")) else ())]))

    def __call__(self, texts: list[str | None]) -> list[tuple[list[str], int]]:
        """Per text, its restored words in order and its number of tokens."""
        if len(self) > CACHE:
            self.clear()
        out = []
        for text in texts:
            tokens = text.lower().split() if text else []
            if list(map(len, tokens)).count(1) > 2:
                tokens = self._unspaced(tokens)
            out.append(([w for found in map(self.__getitem__, tokens) if found for w in found], len(tokens)))
        return out

    @staticmethod
    def _unspaced(tokens: list[str]) -> list[str]:
        """Runs of three or more single characters as one token, spaces kept as readings."""
        out, run = [], []
        for t in [*tokens, ""]:
            if len(t) == 1:
                run.append(t)
                continue
            out += [" ".join(run)] if len(run) > 2 and len(set(run)) > 1 else run
            run = []
            if t:
                out.append(t)
        return out


class ToxicityModel:
    """What scoring needs, of bounded size: character model, lexicon weights, logistic coefficients."""

    def __init__(self, characters: np.ndarray, lexicon: dict[str, float], coefficients: np.ndarray):
        self.characters, self.lexicon, self.coefficients = characters, lexicon, coefficients

    def features(self, restored: list[tuple[list[str], int]]) -> np.ndarray:
        out = np.zeros((len(restored), 5))
        for i, (found, tokens) in enumerate(restored):
            hits = [w for w in found if w in self.lexicon]
            weight = sum([self.lexicon[w] for w in set(hits)])
            out[i] = 1, min(1, len(hits)), np.log1p(len(hits)), weight, np.log1p(1000 * len(hits) / max(1, tokens))
        return out

    def scores(self, restored: list[tuple[list[str], int]]) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(restored))
        return 1 / (1 + np.exp(-np.clip(self.features(restored) @ self.coefficients, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, where: str = "pmod(crc32(cast(doc_id as string)), 5) != 0") -> ToxicityModel:
    """A model from the documents and labels whose doc_id meets ``where``."""
    with small_batches(docs.sparkSession):
        return _fitted(docs, labels, where)


def _fitted(docs: DataFrame, labels: DataFrame, where: str) -> ToxicityModel:
    characters = character_model(docs.filter(where))
    sample = labelled(docs, labels, "toxic", LABELS, where)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        restore = Restorer(characters)
        for ys, texts in rows_of(batches, "y", "text"):
            pairs = [(w, y) for y, tokens in zip(ys, restore(texts), strict=True) for w in set(tokens[0])]
            yield pa.record_batch([pa.array([w for w, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.int32())], ["w", "y"])

    total = labels.filter(f"toxic is not null and doc_id is not null and ({where})").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    total = total.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS).agg(F.count("*"), F.sum("y")).first()
    bad, good = int(total[1] or 0), int(total[0] - (total[1] or 0))
    if not bad or not good:
        return ToxicityModel(characters, {}, None)
    counts = sample.select("y", "text").mapInArrow(found, "w string, y int").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    odds = F.expr(f"ln((a + 0.5D) / ({bad} - a + 0.5D)) - ln((n - a + 0.5D) / ({good} - (n - a) + 0.5D))")
    part = "coalesce({0} * ln({0} / ({1} * {2} / {3}D)), 0D)"  # of the likelihood ratio of a word's four counts
    cells = [("a", "n", bad), ("(n - a)", "n", good), (f"({bad} - a)", f"({bad + good} - n)", bad), (f"({good} - n + a)", f"({bad + good} - n)", good)]
    z = F.expr("sqrt(2 * greatest(0D, " + " + ".join([part.format(c, n, t, bad + good) for c, n, t in cells]) + "))")
    chosen = counts.filter("a > 2").select("w", odds.alias("odds"), z.alias("z")).filter(f"z >= {LEAST_Z} and odds >= 2")
    lexicon = {w: float(o) for w, o, _ in chosen.orderBy(F.desc("z"), "w").collect()}
    model = ToxicityModel(characters, lexicon, None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        restore = Restorer(characters, lexicon)
        for ys, texts in rows_of(batches, "y", "text"):
            x = model.features(restore(texts))
            yield pa.record_batch([pa.array(ys, pa.int32()), *map(pa.array, x.T)], ["y", "x0", "x1", "x2", "x3", "x4"])

    data = sample.select("y", "text").mapInArrow(rows, "y int, x0 double, x1 double, x2 double, x3 double, x4 double").toPandas()
    x, y = data.iloc[:, 1:].to_numpy(), data.y.to_numpy(float)
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), x.T @ (p - y) + 0.5 * w)
    model.coefficients = w
    return model


def scored(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) as a column ``name``, in place of one of that name."""

    def run():
        restore = Restorer(model.characters, model.lexicon)
        return lambda texts: [pa.array(model.scores(restore(texts)))]

    return with_columns(docs, f"{name} double", run)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    held = ~training()
    return out.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
