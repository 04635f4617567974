"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark columns. Small boosted trees on a bounded sample propose rules, the conjunctions along their
paths; a logistic regression under an L1 penalty keeps few of them, and those are compiled to one column expression.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, read

FIT_DOCS = 6000
THRESHOLD = 0.3

Rule = tuple[tuple[int, bool, float], ...]  # statistic, whether above, bound


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text (null counts as empty); shares are of characters or of words and 0 for empty texts."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(F.lower(t), r"[ \t\n\x0B\f\r]+")
    lines = F.split(t, "\n")
    sentences = F.split(t, r"[.!?]\s")

    def share(chars: str) -> Column:
        return (F.length(t) - F.length(F.translate(t, chars, ""))) / n

    def distinct(parts: Column) -> Column:
        return F.size(F.array_distinct(parts)) / F.size(parts)

    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "chars_a_word": F.length(t) / F.size(words),
        "symbols": share("#$%&*!|<>{}[]=+^~_@\\"),
        "marks": share(".,;:?"),
        "digits": share("0123456789"),
        "capitals": share("ABCDEFGHIJKLMNOPQRSTUVWXYZÉÈÊÇÓÍÑÄÖÜ"),
        "distinct_words": distinct(words),
        "distinct_lines": distinct(lines),
        "distinct_sentences": distinct(sentences),
        "words_a_line": F.size(words) / F.size(lines),
    }


def _grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: set[Rule], out: np.ndarray, least: int) -> None:
    """One regression tree by gradient statistics; adds its paths to ``rules`` and its leaf values to ``out``."""
    best = (1e-6, None)
    G, H = g[rows].sum(), h[rows].sum()
    if depth:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = bins[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, k))
    if best[1] is None:
        out[rows] += 0.3 * G / (H + 1)
        return
    f, k = best[1]
    above = bins[rows, f] > k
    for side in (False, True):
        step = (*path, (f, side, float(edges[f][k])))
        rules.add(step)
        _grow(bins, edges, g, h, rows[above == side], depth - 1, step, rules, out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, least: int = 10) -> list[Rule]:
    """Paths, to inner nodes and leaves alike, of boosted trees; bounds are quantiles of the statistics."""
    edges = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 50))) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    edges = [e if len(e) > 1 or (len(e) and (x[:, i] > e[0]).any()) else e[:0] for i, e in enumerate(edges)]
    f, rules = np.zeros(len(y)), set()
    least = max(2, min(least, len(y) // 20))
    for i in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(np.random.default_rng(i).random(len(y)) < 0.7)
        if len(rows) > 2 * least:
            step = np.zeros(len(y))
            _grow(bins, edges, y - p, p * (1 - p), rows, depth, (), rules, step, least)
            f += step
    return sorted(rules, key=lambda r: (len(r), r))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [(x[:, f] > bound) == above for f, above, bound in rule])


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression under an L1 penalty, by accelerated proximal gradient steps."""
    n = max(1, len(y))
    rate = 4 * n / max(1e-9, np.linalg.norm(np.column_stack([r, np.ones(len(r))]), 2) ** 2)
    w, v, t = np.zeros(r.shape[1] + 1), np.zeros(r.shape[1] + 1), 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ v[:-1] + v[-1], -30, 30))) - y
        new = v - rate * np.append(r.T @ e, e.sum()) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, v = new, new + (last - 1) / t * (new - w)
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the bias; with one kind of label only, no rules and that kind's smoothed odds."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.all() or not y.any():
        return [], float(np.log(share / (1 - share)))
    rules = tree_rules(x, y)
    if not rules:
        return [], float(np.log(share / (1 - share)))
    w, bias = lasso(np.column_stack([holds(r, x) for r in rules]).astype(float), y, penalty)
    return [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6], bias


def compiled(rules: list[tuple[Rule, float]], bias: float, columns: list[Column]) -> Column:
    """The score, in 0 to 1, as a column expression."""
    total = F.lit(bias)
    for rule, weight in rules:
        met = reduce(Column.__and__, [columns[f] > bound if above else columns[f] <= bound for f, above, bound in rule])
        total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[list[tuple[Rule, float]], float]:
    """Rules from labelled documents whose fold (of 5) is not 0.

    Labels that are null or have no id do not count; a document labelled twice has quality if one label says so. The
    sample is bounded: the ``fit_docs`` labelled ids of least hash, with their whole texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = sample.select("y", *[c.alias(k) for k, c in statistics(F.col("text")).items()]).toPandas().to_numpy(float)
    return fit(got[:, 1:], (got[:, 0] > 0).astype(float)) if len(got) else fit(np.empty((0, 0)), np.empty(0))


def score(docs: DataFrame, rules: list[tuple[Rule, float]], bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row: repeated rows repeat, null ids stay null, null texts count as empty, no rows give none."""
    s = statistics(F.col("text"))
    used = {f for r, _ in rules for f, _, _ in r}
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    stats = d.select("id", *[c.alias(k) if i in used else F.lit(0.0).alias(k) for i, (k, c) in enumerate(s.items())])
    return stats.select("id", compiled(rules, bias, [F.col(k) for k in s]).alias("score"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``, learnt from ``labels``; odd rows as in ``train`` and ``score``."""
    docs = read(spark, sf_dir, "documents")
    d = score(docs, *train(docs, read(spark, sf_dir, "labels")))
    return d.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
