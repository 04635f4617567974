"""Toxicity by a linear-chain conditional random field over words.

Documents carry labels, words do not. A word of a toxic document is labelled offending if its type is far more common
in toxic than in clean documents of the fitting sample (a likelihood test); all others are labelled neutral.
A two-state chain is fitted to these sequences. Forward-backward marginals tag each word of a text; their noisy-or,
their sum and their share of the words are the text's evidence, scaled to a probability on the sample.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, mapped, offsets, read, release, rows

PUNCTUATION = string.punctuation.encode()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIT_DOCS = 2500
CHAIN_DOCS = 700


def tokens(text: bytes) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split()


def token_spans(text: str) -> list[tuple[int, int]]:
    """Code point spans of ``tokens`` of the text, in one pass over it."""
    return [m.span() for m in WORD.finditer(text) if m[0].encode().translate(None, PUNCTUATION)]


def _chain(k00: np.ndarray, k01: np.ndarray, k10: np.ndarray, k11: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """z[t] = K[t] z[t-1] from z = (1, 1)/2, scaled to sum 1, for a sequence of 2 x 2 matrices.

    The sequence is cut into about sqrt(n) pieces of that length. The pieces' products are formed side by side, then
    each piece's entry state, then all states side by side: exact, in 2 sqrt(n) vector operations.
    """
    n = len(k00)
    size = max(1, int(np.sqrt(n)))
    count = -(-n // size)
    k = np.zeros((4, count * size))
    k[0, n:] = k[3, n:] = 1
    k[:, :n] = k00, k01, k10, k11
    k = np.ascontiguousarray(k.reshape(4, count, size).transpose(2, 0, 1))
    p00, p01, p10, p11 = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for a, b, c, d in k:
        p00, p01, p10, p11 = a * p00 + b * p10, a * p01 + b * p11, c * p00 + d * p10, c * p01 + d * p11
        s = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / s, p01 / s, p10 / s, p11 / s
    x, y, enter = 0.5, 0.5, np.empty((2, count))
    for i, (a, b, c, d) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist(), strict=True)):
        enter[:, i] = x, y
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    (u, v), out = enter, np.empty((2, size, count))
    for t, (a, b, c, d) in enumerate(k):
        u, v = a * u + b * v, c * u + d * v
        s = u + v
        u, v = u / s, v / s
        out[0, t], out[1, t] = u, v
    z = out.transpose(0, 2, 1).reshape(2, -1)[:, :n]
    return z[0], z[1]


def marginals(unary: np.ndarray, a: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) at each position, and the expected number of each kind of step.

    ``unary``: log weight of state 1 against 0; ``a``: weights of steps (from, to); ``first``: where sequences begin.
    """
    e = np.exp(np.clip(unary, -30, 30))
    one = np.ones(len(e))
    f0, f1 = _chain(np.where(first, 1, a[0, 0]), np.where(first, 1, a[1, 0]), np.where(first, e, a[0, 1] * e), np.where(first, e, a[1, 1] * e))
    last = np.append(first[1:], True)
    after = np.append(e[1:], 1.0)
    back = [np.where(last, one, x)[::-1] for x in (a[0, 0] * one, a[0, 1] * after, a[1, 0] * one, a[1, 1] * after)]
    b0, b1 = (x[::-1] for x in _chain(*back))
    p1 = f1 * b1 / (f0 * b0 + f1 * b1)
    inner = np.flatnonzero(~first)
    x = np.stack([f0[inner - 1] * a[0, 0] * b0[inner], f0[inner - 1] * a[0, 1] * e[inner] * b1[inner], f1[inner - 1] * a[1, 0] * b0[inner], f1[inner - 1] * a[1, 1] * e[inner] * b1[inner]])
    return p1, (x / x.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class Model:
    """Log weights: of the words and word lengths for state 1, of the steps; and those of document evidence."""

    vocabulary: dict[bytes, int]
    word: np.ndarray
    length: np.ndarray
    step: np.ndarray
    scale: np.ndarray | None = None

    def unary(self, code: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.word[code] + self.length[size]

    def codes(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = sum(map(len, docs))
        get = self.vocabulary.get
        code = np.fromiter((get(w, 0) for ws in docs for w in ws), np.int64, n)
        size = np.minimum(np.fromiter((len(w) for ws in docs for w in ws), np.int64, n), len(self.length) - 1)
        return code, size, offsets(np.fromiter(map(len, docs), np.int64, len(docs)))

    def tags(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """P(offending) of every word of every document, and the documents' bounds."""
        code, size, at = self.codes(docs)
        if not len(code):
            return np.empty(0), at
        first = np.zeros(len(code), bool)
        first[at[:-1][np.diff(at) > 0]] = True
        return marginals(self.unary(code, size), np.exp(self.step), first)[0], at

    def evidence(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each document: log odds of the noisy-or of its words (within -14 and 14), logs of the sum and the share, 1."""
        none = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
        none = np.clip(none[at[1:]] - none[at[:-1]], -14, -1e-6)
        total = np.concatenate([[0.0], np.cumsum(p)])
        total = total[at[1:]] - total[at[:-1]]
        share = np.log(total / (np.diff(at) + 1) + 1e-4)
        return np.stack([np.log(-np.expm1(none)) - none, np.log1p(total), share, np.ones(len(total))], axis=1)

    def score(self, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(p, at) @ self.scale, -30, 30)))


class Types:
    """In how many toxic and clean documents of the sample each type occurs."""

    def __init__(self) -> None:
        self.df, self.docs = (Counter(), Counter()), [0, 0]

    def add(self, words: list[bytes], toxic: bool) -> None:
        self.df[toxic].update(set(words))
        self.docs[toxic] += 1

    def marks(self, least: float = 11.0, ratio: float = 4.0) -> set[bytes]:
        """Types that are at least ``ratio`` times as common in toxic documents, by evidence of ``least`` nats.

        The evidence is the binomial log likelihood ratio of a type's share of toxic documents against the sample's.
        """
        n0, n1 = self.docs
        q, found = n1 / (n0 + n1), set()
        for w, c1 in self.df[1].items():
            c0 = self.df[0][w]
            if c1 * n0 >= ratio * c0 * n1:
                p = c1 / (c1 + c0)
                if c1 * np.log(p / q) + (c0 * np.log((1 - p) / (1 - q)) if c0 else 0) >= least:
                    found.add(w)
        return found

    def common(self, least: int = 3) -> set[bytes]:
        return {w for w, c in (self.df[0] + self.df[1]).items() if c >= least}


def fit(docs: list[list[bytes]], toxic: np.ndarray, share: float, types: Types, steps: int = 60, l2: float = 1e-3) -> Model | None:
    """A model from labelled documents, of which a share of ``share`` is toxic outside the sample; None without both kinds."""
    if toxic.all() or not toxic.any():
        return None
    marks = types.marks()
    known = types.common() | marks
    m = Model({w: i for i, w in enumerate(sorted(known), 1)}, np.zeros(len(known) + 1), np.zeros(25), np.zeros((2, 2)))
    code, size, at = m.codes(docs)
    mark = np.zeros(len(known) + 1, bool)
    mark[[m.vocabulary[w] for w in marks]] = True
    y = mark[code] & np.repeat(toxic, np.diff(at))
    first = np.zeros(len(code), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    inner = np.flatnonzero(~first)
    pairs = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
    rate = np.log((y.sum() + 1) / (len(y) + 2))  # from which the penalty holds words back
    m.word[:] = np.where(mark, 2.0, rate)
    start = m.word.copy()
    params = (m.word, m.length, m.step)
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for i in range(1, steps + 1):
        p, expected = marginals(m.unary(code, size), np.exp(m.step), first)
        r = y - p
        grads = (np.bincount(code, r, len(m.word)) - l2 * (m.word - start), np.bincount(size, r, len(m.length)) - l2 * m.length, pairs - expected - l2 * m.step)
        for x, g, a, b in zip(params, grads, mean, square, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.3 * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-6)
    x = m.evidence(*m.tags(docs))
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    m.scale = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's steps under a light ridge
        p = 1 / (1 + np.exp(-np.clip(x @ m.scale, -30, 30)))
        g = x.T @ (weight * (toxic - p)) - 0.1 * m.scale
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        m.scale += np.clip(np.linalg.solve(h, g), -1, 1)
    return m


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, chain_docs: int = CHAIN_DOCS) -> tuple[Model | None, float]:
    """The model and the share of toxic documents among the labelled ones whose fold (of 4) is not 2.

    Labels that are null or have no id do not count; a document labelled twice is toxic if one label says so. The
    sample is bounded: the ``fit_docs`` toxic and twice as many clean documents of least id hash, with their whole
    texts. Word types are tested on all of them, the chain is fitted to the first ``chain_docs`` of each kind.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {bool(t): c for t, c in known.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    share = n.get(True, 0) / max(1, sum(n.values()))
    kinds = [known.select("doc_id", (F.col("toxic") > 0).alias("kind")).where(F.col("kind") == F.lit(kind)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for kind, most in ((True, fit_docs), (False, 2 * fit_docs))]
    chosen = kinds[0].unionByName(kinds[1])
    texted = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = texted.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    texts, toxic, types, words = [], [], Types(), []
    for x in got.select("kind", "text").toLocalIterator():
        words = tokens(x.text.encode())
        types.add(words, x.kind)
        if types.docs[x.kind] <= chain_docs:
            texts.append(words)
            toxic.append(x.kind)
    model = fit(texts, np.array(toxic, bool), share, types)
    del texts, types, words
    release()  # what fitting held stays with the driver otherwise
    return model, share


def score(docs: DataFrame, model: Model | None, share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """(id, score) for each row and, with ``spans``, the offending words as "start:end" joined by commas.

    The score is in 0 to 1; null and empty texts score as texts without offending words; without a model all rows
    score ``share``. Repeated rows repeat, null ids stay null, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for batch in rows(whole, 500):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                if m is None:
                    scores, where = np.full(len(texts), share), [""] * len(texts)
                else:
                    p, at = m.tags([tokens(t.encode()) for t in texts])
                    scores, where = m.score(p, at), [""] * len(texts)
                    tagged = np.flatnonzero(p >= 0.5)
                    for d in np.unique(np.searchsorted(at, tagged, "right") - 1).tolist() if spans else ():
                        found = token_spans(texts[d])
                        where[d] = ",".join("{}:{}".format(*found[i]) for i in np.flatnonzero(p[at[d] : at[d + 1]] >= 0.5))
                columns = [batch.column(0), pa.array(scores, pa.float64()), *([pa.array(where, pa.string())] * spans)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "spans"][: 2 + spans])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, score double" + ", spans string" * spans)


THRESHOLD = 0.3


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and offending spans of every whole text of ``documents``; odd rows as in ``train`` and ``score``."""
    docs = read(spark, sf_dir, "documents")
    d = score(docs, *train(docs, read(spark, sf_dir, "labels")), spans=True)
    return d.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that ``op5_toxicity`` would predict as toxic.

    Without labels of both kinds among these documents all rows score the toxic labels' share, so all stay or, where
    that is ``THRESHOLD`` or more, all go. Null and empty texts score as texts without offending words, repeated rows
    share their fate, null ids play no part, an empty table gives no rows.
    """
    model, share = train(docs, read(spark, sf_dir, "labels"))
    if model is None:
        return docs.where(F.lit(share < THRESHOLD))
    held, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for whole in batches:
            for batch in rows(whole, 500):
                s = m.score(*m.tags([tokens((t or "").encode()) for t in batch.column(at).to_pylist()]))
                yield batch.filter(pa.array(s < THRESHOLD))

    return mapped(docs, run, docs.schema)
