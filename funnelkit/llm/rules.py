"""Quality rules: ordered decision lists learned by sequential covering, emitted as Spark conditions.

Statistics of each text are thresholded. A rule is a conjunction grown greedily (information gain on
two thirds of the labelled rows) and pruned backwards on the other third; rows that it covers leave,
and the next rule is sought until none is precise enough. The list becomes one ordered ``CASE``
expression over the statistics: the first rule that holds rejects the document, otherwise it stays.

Bounds: at most ``LABELS`` labelled rows are fitted on, at most ``RULES`` rules of ``TERMS`` terms.
Edge cases: a null or empty text has no words (and fails the base rule); repeated rows get the same
verdict; without labels the list is empty and every document that passes the base rule stays; an
empty table gives no rows. Columns beside doc_id and text play no part.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, table, with_columns

LABELS, RULES, TERMS, PRECISION = 20_000, 16, 3, 0.9
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SHARES = "upper_share double, digit_share double, symbol_share double, dup_share double, repeat_share double, same_share double, distinct_share double, mark_share double, word_length double"
FEATURES = [f.split()[0] for f in SHARES.split(", ")] + ["n_words"]
_WORD, _SYMBOL, _MARKS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]"), re.compile(r"!!|\*\*|##|\?\?|\|")


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(words) < 3:
        return 0
    number: dict[str, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    base = len(number)
    if base**3 < 2**62:
        window = (w[:-2] * base + w[1:-1]) * base + w[2:]
    else:
        _, two = np.unique(w[:-1] * base + w[1:], return_inverse=True)
        window = two[:-1].astype(np.int64) * base + w[2:]
    _, whose, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[whose] > 1
    mark = np.zeros(len(w), bool)
    for i in range(3):
        mark[i : i + len(again)] |= again
    return int(mark.sum())


def statistics_of(text: str | None) -> tuple:
    """The counts of ``COUNTS`` and the shares of ``SHARES``."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup, again, symbols = len(lines) - len(set(lines)), repeated_words(words), len(_SYMBOL.findall(text))
    chars, k = sum(map(len, words)), max(1, n)
    same = sum([a == b for a, b in pairwise(words)])
    upper = sum([w.isupper() for w in words])
    digits = sum([c.isdigit() for w in words if not w.isalpha() for c in w])
    marks = len(_MARKS.findall(text))
    shares = (upper / k, digits / max(1, chars), symbols / max(1, chars), dup / max(1, len(lines)), again / k, same / k, len(set(words)) / k, marks / k, chars / k)
    return (n, chars, symbols, dup, again, *shares)


def described(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and shares of each text."""

    def run():
        def each(texts):
            rows = list(zip(*map(statistics_of, texts), strict=True))
            return [pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(rows)] if rows else [pa.array([], pa.int64())] * 5 + [pa.array([], pa.float64())] * 9

        return each

    return with_columns(docs, f"{COUNTS}, {SHARES}", run)


Rule = list[tuple[str, bool, float]]  # terms (feature, at least?, threshold)


def holds(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for feature, least, at in rule:
        out &= x[feature] >= at if least else x[feature] <= at
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """An ordered list of rules that reject, by sequential covering."""
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), bool), []
    cuts = {f: np.unique(np.quantile(v, np.linspace(0.005, 0.995, 100))) if len(v) else [] for f, v in x.items()}
    while len(rules) < RULES and (left & bad).any():
        rule: Rule = []
        grow = left & part
        while len(rule) < TERMS:
            now = holds(rule, x) & grow
            p0, n0 = (now & bad).sum(), (now & ~bad).sum()
            if not n0 or not p0:
                break
            best = (1e-9, None)
            for f, v in x.items():
                order = np.argsort(v[now], kind="stable")
                value, is_bad = v[now][order], bad[now][order]
                cum = np.concatenate([[0], np.cumsum(is_bad)])
                for least in (True, False):
                    at = np.searchsorted(value, cuts[f], side="left" if least else "right")
                    p = p0 - cum[at] if least else cum[at]
                    m = len(value) - at if least else at
                    gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(m, 1)) - np.log2(p0 / (p0 + n0)))
                    i = int(np.argmax(np.where(m >= 3, gain, -1))) if len(gain) else 0
                    if len(gain) and gain[i] > best[0]:
                        best = (gain[i], (f, least, float(cuts[f][i])))
            if best[1] is None:
                break
            rule.append(best[1])
        prune = left & ~part

        def worth(r: Rule, prune=prune) -> float:
            now = holds(r, x) & prune
            return ((now & bad).sum() - 2 * (now & ~bad).sum()) / max(1, now.sum()) if now.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = holds(rule, x) & left
        if not rule or covered.sum() < 5 or (covered & bad).sum() < PRECISION * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: true if the document stays."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for feature, least, at in rule:
            test = test & ((F.col(feature) >= at) if least else (F.col(feature) <= at))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    data = described(labelled(docs, labels, "quality", LABELS)).select("y", *FEATURES).toPandas()
    return learn({f: data[f].to_numpy(float) for f in FEATURES}, data.y.to_numpy() == 0)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keep = verdict(fit(docs, table(spark, sf_dir, "labels")))
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return described(docs).select("doc_id", *counts, failed.alias("base_failed"), (~failed & keep).alias("kept"))
