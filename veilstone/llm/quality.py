"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees are grown on labelled rows; every path from a root is a conjunctive rule over statistics.
Lasso-penalised logistic regression over the rules and the (clipped, scaled) statistics keeps a few of
them, and what it keeps is compiled to one Spark column expression. Scoring is a single pass over the
documents without a shuffle: a task reads the statistics off the bytes of each text (one byte histogram
and one list of words), and generated code applies the rules.

Training takes at most ``most_rows`` labelled rows (a bounded sample, by a hash of the id); all rows
are scored. Statistics read whole texts. Labels, language, source and id are inputs of no score.

Null and empty texts have all statistics 0 and get a score like any other. Several labels of one
document count as their mean, rounded down. With no labels, or labels of one class, the score is a
constant: that class's share (0.5 without labels).
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, steady_heap

MOST_ROWS, PART_BYTES = 20_000, 1 << 20
STATISTICS = (
    "n_chars", "n_words", "word_length", "distinct_share", "repeat_share", "upper_share", "mark_share", "odd_mark_share",
    "digit_share", "bar_share", "exclaim_share", "line_length", "stop_share", "wide_share",
)
#: Frequent short words of four languages.
STOP_WORDS = frozenset(
    b"the and of to in is it that for with der die das und von zu mit den ist le la les de des et un une que el los las y en por con".split()
)


def _class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


HEADS = _class(lambda b: b & 0xC0 != 0x80)  # first bytes of UTF-8 characters
UPPER = _class(lambda b: 65 <= b <= 90)
MARKS = _class(lambda b: 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126)
ODD_MARKS = _class(lambda b: chr(b) in "#$%&*@^~<>{}=+_\\")
DIGITS = _class(lambda b: 48 <= b <= 57)


def text_statistics(text: bytes | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS. Classes of characters are those of ASCII;
    words are runs without ASCII white space, compared in lower case (A-Z)."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw, count = np.frombuffer(text, np.uint8), np.zeros(256, np.int64)
    for i in range(0, len(raw), PART_BYTES):
        count += np.bincount(raw[i : i + PART_BYTES], minlength=256)
    words = text.lower().split()
    chars, n = int(count[HEADS].sum()), len(words)
    per_char, per_word = 1.0 / max(1, chars), 1.0 / max(1, n)
    return [
        float(chars),
        float(n),
        chars * per_word if n else 0.0,
        len(set(words)) * per_word,
        sum(a == b for a, b in pairwise(words)) * per_word,
        int(count[UPPER].sum()) * per_char,
        int(count[MARKS].sum()) * per_char,
        int(count[ODD_MARKS].sum()) * per_char,
        int(count[DIGITS].sum()) * per_char,
        int(count[124]) * per_word if n else 0.0,
        int(count[33]) * per_word if n else 0.0,
        chars / (int(count[10]) + 1),
        sum(map(STOP_WORDS.__contains__, words)) * per_word,
        (len(text) - chars) * per_char,
    ]


def statistics(text: Column) -> Column:
    """The statistics of a text column as an array of doubles. It is called once a row: being marked as
    not deterministic keeps conditions on a score above it."""

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        steady_heap()
        rows = np.array([text_statistics(t) for t in byte_texts(texts)], np.float64).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, len(STATISTICS), dtype=np.int32)), pa.array(rows))

    return measured.asNondeterministic()(text)


# ---- fitting, on the bounded sample


def _tree(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> list[list[tuple[int, float, bool]]]:
    """Rules of a regression tree: every node below the root as its path of (statistic, cut, below)."""
    rules: list[list[tuple[int, float, bool]]] = []

    def grow(rows: np.ndarray, path: list, left: int) -> None:
        if path:
            rules.append(path)
        y = target[rows]
        if not left or len(rows) < 2 * least or np.ptp(y) == 0:
            return
        best = (1e-9, -1, 0.0)
        for j in rng.choice(x.shape[1], max(1, int(x.shape[1] * 0.6)), replace=False):
            order = np.argsort(x[rows, j], kind="stable")
            v, s = x[rows, j][order], np.cumsum(y[order])
            n = np.arange(1, len(rows))
            gain = s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(rows) - n) - s[-1] ** 2 / len(rows)
            gain[(v[1:] == v[:-1]) | (n < least) | (len(rows) - n < least)] = -1
            k = int(gain.argmax()) if len(gain) else -1
            if k >= 0 and gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return
        below = x[rows, best[1]] < best[2]
        grow(rows[below], [*path, (best[1], best[2], True)], left - 1)
        grow(rows[~below], [*path, (best[1], best[2], False)], left - 1)

    grow(np.arange(len(x)), [], depth)
    return rules


def _rules(x: np.ndarray, y: np.ndarray, seed: int, trees: int = 40, shrink: float = 0.1) -> list[tuple]:
    """Distinct rules of boosted trees of varied depth, each on half of the rows."""
    rng, f = np.random.default_rng(seed), np.full(len(y), np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        residue = y - 1 / (1 + np.exp(-f))
        rules = _tree(x[rows], residue[rows], rng, int(rng.integers(1, 4)), max(5, len(rows) // 200))
        for rule in rules:
            found[tuple(rule)] = None
            hit = _holds(x, rule)
            if len(rule) == max(map(len, rules)) and hit.any():
                f[hit] += shrink * residue[hit].mean() * 4
    return list(found)


def _holds(x: np.ndarray, rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, cut, below in rule:
        out &= (x[:, j] < cut) == below
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps; the bias is free."""
    n, w, b = len(y), np.zeros(z.shape[1]), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    u, c, t = w, b, 1.0
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-np.clip(z @ u + c, -40, 40))) - y) / n
        v = u - step * (z.T @ gap)
        w2, b2 = np.sign(v) * np.maximum(np.abs(v) - step * penalty, 0), c - step * gap.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


class RuleEnsemble:
    """Weighted rules and clipped statistics: ``score`` compiles them to a column."""

    def __init__(self, bias: float, rules: list[tuple[float, tuple]], linear: list[tuple[float, int, float, float]]):
        self.bias, self.rules, self.linear = bias, rules, linear

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 2e-3, seed: int = 7) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            return cls(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [], [])
        rules = _rules(x, y, seed)
        lo, hi = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        spread = np.where(hi > lo, np.clip(x, lo, hi).std(0), 1.0)
        spread[spread == 0] = 1.0
        z = np.concatenate([np.stack([_holds(x, r) for r in rules], 1).astype(float), 0.4 * (np.clip(x, lo, hi) - lo) / spread], 1)
        w, b = _lasso(z, y.astype(float), penalty)
        kept = [(float(v), r) for v, r in zip(w, rules) if v]
        linear = [(float(0.4 * v / s), j, float(a), float(c)) for j, (v, s, a, c) in enumerate(zip(w[len(rules) :], spread, lo, hi)) if v]
        return cls(float(b), kept, linear)

    def score(self, column: str) -> Column:
        """Probability of label 1 from the array column of statistics."""
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            test = F.lit(True)
            for j, cut, below in rule:
                value = F.element_at(column, j + 1)
                test = test & ((value < cut) if below else (value >= cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        for weight, j, lo, hi in self.linear:
            total = total + (F.greatest(F.lit(lo), F.least(F.lit(hi), F.element_at(column, j + 1))) - lo) * weight
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    """True for rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def with_statistics(docs: DataFrame, column: str = "__statistics") -> DataFrame:
    """``docs`` with an array of the statistics of ``text``."""
    return docs.withColumn(column, statistics(F.col("text")))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, label: str = "quality") -> RuleEnsemble:
    """Learn from at most ``most_rows`` labelled documents outside the held-out third."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.floor(F.avg("y")).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_statistics(own.join(F.broadcast(chosen), "doc_id")).select("doc_id", "y", "__statistics")
    # most_rows rows of 14 numbers; a document id that repeats counts once
    got = sorted({r[0]: (r[1], r[2]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "__statistics").limit(most_rows).collect()}.items())
    x = np.array([r[1][1] for r in got], float).reshape(-1, len(STATISTICS))
    return RuleEnsemble.fit(x, np.array([r[1][0] for r in got], int))


def scored(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5, else 0)."""
    model = fit(docs, labels, most_rows)
    names = [c for c in docs.columns if c not in ("score", "predicted", "__statistics")]
    out = with_statistics(docs.select(*names)).withColumn("score", model.score("__statistics"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("__statistics")
