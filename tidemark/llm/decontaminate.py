"""Benchmark decontamination with spaced seeds.

Fixed masks look at some positions of a short span and ignore the rest, so that a seed survives substituted words.
Seeds of the benchmark are joined with those at every word of every document; around each hit the two texts are
compared word by word on the hit's diagonal, and a window with few enough substitutions counts as a leak.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import mapped, read, rows

# Each mask lists the positions that it looks at. Together they have a seed in every window of 13 words
# with up to three substitutions.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 6, 8, 9), (0, 1, 3, 4, 5))
WINDOW = 13
MATCH = 0.75
LEAST_WORDS = 5
LOOSE_WORDS = 8
BENCH_WORDS = 500_000

PUNCTUATION = string.punctuation.encode()
SPAN = max(m[-1] for m in MASKS) + 1
MULTIPLY = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(WINDOW)], np.uint64)


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words split at ASCII white space, without ASCII punctuation."""
    return (text or "").lower().encode().translate(None, PUNCTUATION).split()


def seeds(codes: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose masked words are all known (code over 0), and their hashes."""
    n = len(codes) - mask[-1]
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    known = codes > 0
    ok = known[:n].copy()
    for o in mask[1:]:
        ok &= known[o : o + n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for o in mask:
        h += codes[at + o].astype(np.uint64) * MULTIPLY[o]
    return at, h


def masks_for(lengths: set[int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(length, mask) for items of these lengths, ``SPAN`` standing for that many words and more.

    Items of ``LOOSE_WORDS`` to ``SPAN`` - 1 words have a mask that leaves out each position in turn, shorter ones are
    looked at in full.
    """
    for n in sorted({min(x, SPAN) for x in lengths}):
        if n == SPAN:
            yield from ((n, m) for m in MASKS)
        elif n >= LOOSE_WORDS:
            yield from ((n, tuple(i for i in range(n) if i != out)) for out in range(n))
        else:
            yield n, tuple(range(n))


class Index:
    """Seeds of one bounded part of the benchmark: (item_id, words) with at least ``LEAST_WORDS`` words each."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int, match: float) -> None:
        self.window, self.match = window, match
        self.codes_of = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.codes_of[w] for w in ws], np.int64) for _, ws in items]
        self.seeds = []
        for size, mask in masks_for({len(x) for x in self.items}):
            h, item, pos = [], [], []
            for k, codes in enumerate(self.items):
                if size == min(len(codes), SPAN):
                    at, x = seeds(codes, mask)
                    h.append(x)
                    item.append(np.full(len(at), k))
                    pos.append(at)
            if h:
                h, item, pos = map(np.concatenate, (h, item, pos))
                by = np.argsort(h, kind="stable")
                keys, first, count = np.unique(h[by], return_index=True, return_counts=True)
                self.seeds.append((mask, keys, first, count, item[by], pos[by]))

    def overlaps(self, docs: list[list[bytes]]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, item_id, document position, item position, words, matches): the best overlap for each leak."""
        gap = np.zeros(WINDOW, np.int64)
        get = self.codes_of.get
        codes, starts, at = [gap], [], len(gap)
        for ws in docs:
            starts.append(at)
            codes += [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)), gap]
            at += len(ws) + len(gap)
        flat, starts = np.concatenate(codes), np.array(starts, np.int64)
        pairs = []
        for mask, keys, first, count, item, pos in self.seeds:
            where, h = seeds(flat, mask)
            i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[i] == h if len(keys) else np.zeros(0, bool)
            i, where = i[hit], where[hit]
            n = count[i]
            of = np.repeat(first[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.stack([item[of], np.repeat(where, n) - pos[of], np.searchsorted(starts, np.repeat(where, n), "right") - 1]))
        best: dict[tuple[int, int], tuple] = {}
        for k, diagonal, doc in np.unique(np.concatenate([*pairs, np.empty((3, 0), np.int64)], axis=1), axis=1).T.tolist():
            x, begin, end = self.items[k], starts[doc], starts[doc] + len(docs[doc])
            a, b = max(0, begin - diagonal), min(len(x), end - diagonal)
            same = flat[diagonal + a : diagonal + b] == x[a:b]
            w = min(self.window, len(x))
            sums = np.concatenate([[0], np.cumsum(same)])
            need = -(-self.match * w // 1) if len(x) >= self.window else w - (w >= LOOSE_WORDS)
            good = np.flatnonzero(sums[w:] - sums[:-w] >= need) if len(same) >= w else []
            if len(good):
                p, q = int(good[0]), int(good[-1]) + w
                found = (int(sums[q] - sums[p]), -int(diagonal + a + p - begin), self.ids[k], int(a + p), q - p)
                best[doc, k] = max(best.get((doc, k), found), found)
        for (doc, _), (matches, neg, item_id, pos, n) in sorted(best.items()):
            yield doc, item_id, -neg, pos, n, matches


def indexes(benchmark: DataFrame, id_col: str, text_col: str, window: int, match: float, part_words: int) -> Iterator[Index]:
    """The benchmark in parts of about ``part_words`` words, each small enough for every executor to hold."""
    b = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = b.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    for p in range(parts):
        part = b.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == p).collect()
        items = [(i, ws) for i, t in part if len(ws := normal_words(t)) >= LEAST_WORDS]
        if items:
            yield Index(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])), window, match)


LEAKS = "doc_id long, item_id long, doc_pos long, item_pos long, n_words long, n_match long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, match: float = MATCH, part_words: int = BENCH_WORDS) -> DataFrame:
    """One row for each document row and benchmark item that overlap: where, over how many words, how many equal.

    An overlap is a run of windows of ``window`` words of which at least ``match`` are equal, position by position
    (items of 8 to 12 words: all but one of them, of 5 to 7: all). Items of fewer than five words prove nothing and take
    no part. Null
    and empty texts have no overlaps; a null id stays null; repeated rows repeat theirs; repeated benchmark rows count
    once. Empty tables give no rows. Texts are whole and other columns are not read. A benchmark beyond
    ``part_words`` words is matched part by part, with the same rows as a result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = spark.createDataFrame([], LEAKS)
    for index in indexes(benchmark, item_col, item_text, window, match, part_words):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in rows(whole, 250):
                    got = list(held.value.overlaps([normal_words(t) for t in batch.column(1).to_pylist()]))
                    if got:
                        doc, *rest = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in rest)], names=[x.split()[0] for x in LEAKS.split(", ")])

        found = found.unionByName(mapped(d, run, LEAKS))
    return found


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every whole text of ``documents`` with ``benchmark``; odd rows as in ``leaks``."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item.

    Null and empty texts overlap none and stay, repeated rows share their fate, an empty table gives no rows; an empty
    benchmark leaves all.
    """
    at = docs.columns.index("text")
    for index in indexes(read(spark, sf_dir, "benchmark"), "item_id", "text", WINDOW, MATCH, BENCH_WORDS):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in rows(whole, 250):
                    bad = {x[0] for x in held.value.overlaps([normal_words(t) for t in batch.column(at).to_pylist()])}
                    yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64()))

        docs = mapped(docs, run, docs.schema)
    return docs
