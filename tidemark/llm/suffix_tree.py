"""Language-model scores from a probabilistic suffix tree over words, whose empty context spells words out byte by byte.

A text is its lower-cased words, then an end mark that also opens the next text. States are the empty context and every
word after which the distribution of the next word diverges from that of the empty context; the test is the gain in
log likelihood of the training words when each is left out of the counts in turn, so chance repetitions do not pass. A
token is scored in the longest state that the text before it ends in. A word's distribution is its counts and
``WORD_KEEP`` more from that of the empty context. The empty context's is the words' counts, discounted by the ratio of
words met once and twice, and their spelling under a second suffix tree, over bytes, which is grown from the distinct
training words.

Counts are gathered over all training texts and grow with them: nothing of the word level is held by one machine. Texts
are cut to blocks; a block's distinct words, and later its distinct pairs of words, are dealt to shares, where each is
summed over all blocks, and the sums come back to (block, place in its list). Only distinct words and pairs of blocks
are shuffled. Pairs are dealt by their context, so that it can be tested as a whole; those of the few contexts that make
up a thousandth of all tokens or more are dealt by both words, and the gains of the parts are added up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bucketed, checkpointed, fold, mapped, offsets, packed, read, release, rows, share_count, text_bytes, unpacked, words
from .simhash import mixed

DEPTH = 5
P_MIN = 1e-5
LEAST = 20
DIVERGENCE = 0.01
KEEP = 8.0
WORD_KEEP = 50.0
HOT = 1000
GAIN = 10.0
BLOCK_WORDS = 1_000_000
BLOCK_BYTES = 16_000_000
GROUP_WORDS = 100_000
END = 10


def flat_bytes(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, end marks included, the texts' bounds and each byte's position in its text. NUL counts as 0x01."""
    texts = [b" ".join([*ws, b"\n"]) for ws in split]
    at = offsets(np.fromiter(map(len, texts), np.int64, len(texts)))
    flat = np.frombuffer(b"".join(texts).replace(b"\0", b"\1"), np.uint8)
    return flat, at, np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))


def before(flat: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The byte k places earlier in the same text, the opening mark just before it, 0 beyond."""
    out = np.zeros_like(flat)
    out[k:] = flat[: max(0, len(flat) - k)]
    out[place < k] = 0
    out[place == k - 1] = END
    return out


def grams(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each byte with the DEPTH bytes before it, the byte itself lowest."""
    code = flat.astype(np.int64)
    for k in range(1, DEPTH + 1):
        code |= before(flat, place, k).astype(np.int64) << (8 * k)
    return code


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


# kind 0: a share of a block's distinct words; 1: the share of each word; 2: positions of some texts' words
NAMES = ["block", "kind", "part", "n", "arrays", "ids"]
BLOCKS = "block long, kind int, part int, n long, arrays array<binary>, ids array<long>"
TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, TYPES, strict=True)], names=NAMES)


def _cut(shares: int, block_words: int):
    """Batches of (id, learn, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), count()

        def block(code: dict[bytes, int], ids: list, learn: list[bool], codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            at = (task << 32) + next(numbers)
            listed = sorted(code)
            first = np.fromiter(map(code.__getitem__, listed), np.int64, len(listed))
            code.clear()
            sizes, flat, learn = np.array([len(c) for c in codes], np.int64), np.concatenate(codes), np.array(learn, bool)
            codes.clear()
            order = np.argsort(-np.bincount(flat, minlength=len(listed))[first], kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[first[order]] = np.arange(len(order))
            flat = rank[flat]
            times = np.bincount(flat[np.repeat(learn, sizes)], minlength=len(order))
            listed = [listed[i] for i in order.tolist()]
            share = np.fromiter((zlib.crc32(w) % shares for w in listed), np.int64, len(listed))
            by = np.argsort(share, kind="stable")
            for mine in np.split(by, np.flatnonzero(np.diff(share[by])) + 1) if len(by) else ():
                own = [listed[i] for i in mine.tolist()]
                arrays = [packed(np.fromiter(map(len, own), np.int64, len(own))), zstandard.ZstdCompressor(level=3).compress(b"".join(own)), packed(times[mine])]
                yield _row(at, 0, int(share[mine[0]]), len(own), arrays, None)
            yield _row(at, 1, 0, len(share), [packed(share)], None)
            ends = offsets(sizes)
            group = ends[1:] // GROUP_WORDS + np.arange(len(ids)) // 2000
            for part, texts in enumerate(np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1)):
                a, b = int(texts[0]), int(texts[-1]) + 1
                yield _row(at, 2, part, int(learn[a:b].sum()), [packed(sizes[a:b]), packed(flat[ends[a] : ends[b]]), packed(learn[a:b])], ids[a:b])

        code, ids, learn, codes, n, size = defaultdict(count().__next__), [], [], [], 0, 0
        for whole in batches:
            for batch in rows(whole, 250):
                for i, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                    ws = words(text)
                    ids.append(i)
                    learn.append(train)
                    codes.append(np.fromiter(map(code.__getitem__, ws), np.int64, len(ws)))
                    n, size = n + len(ws), size + len(text)
                    if n >= block_words or size >= BLOCK_BYTES:
                        yield from block(code, ids, learn, codes)
                        code, ids, learn, codes, n, size = defaultdict(count().__next__), [], [], [], 0, 0
                        release()
        if ids:
            yield from block(code, ids, learn, codes)

    return run


class Share:
    """Distinct words of a share, numbered as they turn up, with their training counts over all blocks."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        code, self.packs, counts = defaultdict(count().__next__), [], []
        for batch in batches:
            for block, part, (sizes, data, times) in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "arrays")), strict=True):
                data = zstandard.ZstdDecompressor().decompress(data)
                own = [data[a:b] for a, b in pairwise(offsets(unpacked(sizes)).tolist())]
                self.packs.append((block, part, np.fromiter(map(code.__getitem__, own), np.uint32, len(own))))
                counts.append(unpacked(times))
        self.words, self.counts = list(code), np.zeros(len(code), np.int64)
        for (_, _, at), times in zip(self.packs, counts, strict=True):
            self.counts[at] += times  # a block's words are distinct

    def slices(self, known: bool, size: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``flat_bytes`` of the words, or of those met in training, each as a text."""
        listed = [w for w, n in zip(self.words, self.counts.tolist(), strict=True) if n] if known else self.words
        for at in range(0, len(listed), size):
            yield flat_bytes([[w] for w in listed[at : at + size]])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): kind 0: tokens, distinct words and words met once and twice of the share; 1: byte sequences of its training words."""
    share = Share(batches)
    keys = np.arange(4)
    totals = np.array([share.counts.sum(), (share.counts > 0).sum(), (share.counts == 1).sum(), (share.counts == 2).sum()])
    held = [_summed(code := grams(flat, place), np.ones(len(code), np.int64)) for flat, _, place in share.slices(True)]
    grown = _summed(*(np.concatenate(x) for x in zip(*held, strict=True))) if held else (np.empty(0, np.int64),) * 2
    for kind, (key, n) in enumerate(((keys, totals), grown)):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["kind", "key", "n"])


@dataclass
class Tree:
    """The trie of contexts, read backwards from the next byte: node 0 is nowhere, node 1 the empty context."""

    symbol: np.ndarray  # of each byte; 0 for bytes that training never met
    child: np.ndarray  # node, symbol -> node
    logp: np.ndarray  # node, symbol -> log10 probability of one byte of that symbol

    def score(self, flat: np.ndarray, place: np.ndarray) -> np.ndarray:
        node = np.ones(len(flat), np.int32)
        best = node
        width = self.child.shape[1]
        for k in range(1, DEPTH + 1):
            node = self.child.ravel().take(node * width + self.symbol[before(flat, place, k)])
            best = np.where(node > 0, node, best)
        return self.logp.ravel().take(best * np.int64(width) + self.symbol[flat]).astype(float)


def grow(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], divergence: float = DIVERGENCE, keep: float = KEEP) -> Tree:
    """The tree from, for each length, the candidate contexts' codes, next bytes and counts (suffixes included).

    A distribution is its counts and ``keep`` more from its suffix's distribution; the empty context has half a count
    of each byte. A context stays if it diverges by ``divergence`` bits from its suffix, or a context that extends it
    stays.
    """
    code, byte, n = levels[0]
    seen = np.unique(byte)
    symbol = np.zeros(256, np.uint8 if len(seen) < 255 else np.int32)
    symbol[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    root = np.full(width, 0.5)
    np.add.at(root, symbol[byte], n)
    p = [(root / (n.sum() + 128))[None]]
    codes, kept, parents = [np.zeros(1, np.int64)], [np.ones(1, bool)], [np.zeros(1, np.int64)]
    for k, (code, byte, n) in enumerate(levels[1:], 1):
        own = np.unique(code)
        counts = np.zeros((len(own), width))
        np.add.at(counts, (np.searchsorted(own, code), symbol[byte]), n)
        up = np.searchsorted(codes[-1], own & ((1 << (8 * (k - 1))) - 1))
        above = p[-1][up]
        total = counts.sum(axis=1, keepdims=True)
        raw = counts / total
        gain = np.where(counts > 0, raw * np.log2(np.maximum(raw, 1e-300) / above), 0).sum(axis=1)
        p.append((counts + keep * above) / (total + keep))
        codes.append(own)
        kept.append(gain >= divergence)
        parents.append(up)
    for k in range(len(codes) - 1, 0, -1):
        kept[k - 1][parents[k][kept[k]]] = True
    ids, at = [], 1
    for k in kept:
        ids.append(np.where(k, at + np.cumsum(k) - 1, 0))
        at += int(k.sum())
    child, logp = np.zeros((at, width), np.int32), np.zeros((at, width), np.float32)
    for k, (own, stay) in enumerate(zip(codes, kept, strict=True)):
        logp[ids[k][stay]] = np.log10(p[k][stay])
        if k:
            oldest = symbol[(own[stay] >> (8 * (k - 1))) & 255]
            child[ids[k - 1][parents[k][stay]], oldest] = ids[k][stay]
    child[0] = 0
    return Tree(symbol.astype(np.int32), child, logp)


def train(counts: DataFrame, p_min: float = P_MIN, least: int = LEAST) -> Tree | None:
    """The tree of byte contexts from ``_totals``; None without any.

    Candidates are contexts with at least a share ``p_min`` of all bytes, so there are at most 1 / p_min of each length
    and what reaches the driver is bounded.
    """
    code, byte = F.col("key"), F.col("key").bitwiseAND(F.lit(255))
    top = counts.where("kind = 1")
    total = top.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    each = F.array(*[F.when(F.shiftright(code, 8 * k).bitwiseAND(F.lit(255)) > 0, F.struct(F.lit(k).alias("k"), F.shiftright(code, 8).bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("ctx"))) for k in range(DEPTH + 1)])
    # the byte k places back is 0 where the text does not reach that far; for k = 0 it is the byte itself
    levels = top.select(F.explode(each).alias("e"), byte.alias("byte"), "n").where("e is not null").groupBy("e.k", "e.ctx", "byte").agg(F.sum("n").alias("n"))
    levels = checkpointed(levels.toDF("k", "ctx", "byte", "n"))
    common = levels.groupBy("k", "ctx").agg(F.sum("n").alias("total")).where(F.col("total") >= max(least, p_min * total))
    got = levels.join(common, ["k", "ctx"]).select("k", "ctx", "byte", "n").toArrow()
    k, ctx, b, n = (got.column(c).to_numpy() for c in ("k", "ctx", "byte", "n"))
    at = [k == i for i in range(DEPTH + 1)]
    return grow([(ctx[x], b[x], n[x].astype(float)) for x in at]) if at[0].any() else None


@dataclass
class Totals:
    """What all blocks share: training texts, tokens with end marks, distinct tokens, words met once and twice, shares."""

    texts: int
    tokens: int
    distinct: int
    once: int
    twice: int
    shares: int

    @property
    def discount(self) -> float:
        return self.once / max(1, self.once + 2 * self.twice)

    @property
    def hot(self) -> int:
        return max(1, -(-self.tokens // HOT))

    def empty(self, times: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Probability in the empty context, from counts and log10 probabilities of spellings.

        Each count yields the discount to the spellings, which share the sum, or one where that is less.
        """
        freed = self.discount * self.distinct
        return (np.maximum(times - self.discount, 0) + max(freed, 1.0) * 10.0**spelt) / (self.tokens - freed + max(freed, 1.0))


def spelling(tree: Tree | None, flat: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log10 probability of each text of ``flat_bytes``; without a tree bytes are uniform."""
    p = tree.score(flat, place) if tree is not None else np.full(len(flat), -np.log10(256.0))
    return np.add.reduceat(p, at[:-1])


def _answers(tree: Tree | None):
    """A share's words back to their places: number in the share, training count and spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = Share(batches)
        spelt = np.concatenate([*(spelling(tree, *x) for x in share.slices(False)), np.empty(0)]).astype("<f4")
        for block, part, at in share.packs:
            yield _row(block, 0, part, len(at), [packed(at), packed(share.counts[at], 8), packed(spelt[at].view("<u4"))], None)

    return run


class Block:
    """The tokens of a block's texts and its distinct pairs of a token and the one before it."""

    def __init__(self, texts: pa.Table, answers: list[dict], t: Totals, tree: Tree | None) -> None:
        texts = texts.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
        shares = unpacked(texts[0]["arrays"][0]).astype(np.int64)
        place, m = np.argsort(shares, kind="stable"), len(shares)
        at, times, spelt = ([unpacked(a["arrays"][i], width) for a in answers] for i, width in enumerate((4, 8, 4)))
        # the end mark is the last code; it is spelt as the word without letters
        self.word, self.times, self.spelt = np.zeros(m + 1, np.int64), np.full(m + 1, t.texts, np.int64), np.empty(m + 1)
        self.word[-1], self.spelt[-1] = t.shares << 40, spelling(tree, *flat_bytes([[]]))[0]
        if m:
            self.word[place] = (shares[place] << 40) + np.concatenate(at)
            self.times[place] = np.concatenate(times).astype(np.int64)
            self.spelt[place] = np.concatenate(spelt).view("<f4")
        self.p = t.empty(self.times, self.spelt)
        self.ids = [i for r in texts[1:] for i in r["ids"]]
        sizes, codes, learn = (np.concatenate([unpacked(r["arrays"][i]) for r in texts[1:]]).astype(np.int64) for i in range(3))
        self.bounds = offsets(sizes + 1)
        self.code = np.empty(int(self.bounds[-1]), np.int64)
        end = np.zeros(len(self.code), bool)
        end[self.bounds[1:] - 1] = True
        self.code[end], self.code[~end] = m, codes
        pairs, self.pair = np.unique(np.append(m, self.code[:-1]) * (m + 1) + self.code, return_inverse=True)
        self.before, self.after = pairs // (m + 1), pairs % (m + 1)
        self.learnt = np.bincount(self.pair, np.repeat(learn, sizes + 1), len(pairs)).astype(np.int64)
        # pairs whose first token occurs in training, by share, then by context; runs of one context
        asked = np.flatnonzero(self.times[self.before] > 0)
        a, b = (mixed(self.word[x[asked]].astype(np.uint64)) for x in (self.before, self.after))
        share = (np.where(self.times[self.before[asked]] >= t.hot, mixed(a ^ (b + np.uint64(1))), a) % np.uint64(t.shares)).astype(np.int64)
        order = np.lexsort((self.word[self.after[asked]], self.word[self.before[asked]], share))
        self.asked, self.share = asked[order], share[order]
        new = np.append(True, (np.diff(self.share) != 0) | (np.diff(self.before[self.asked]) != 0))[: len(self.asked)]
        self.run = np.flatnonzero(new)
        self.runs = np.diff(np.append(self.run, len(self.asked)))

    def asks(self, block: int) -> Iterator[pa.RecordBatch]:
        """For each share its contexts (words, counts, lengths of runs), next words, training counts and surprise in the empty context."""
        surprise = np.minimum(np.rint(-8 * np.log(self.p)), 65535)
        edges = np.append(np.flatnonzero(np.diff(self.share)) + 1, len(self.asked)) if len(self.asked) else ()
        a = 0
        for b in edges:
            mine, runs = self.asked[a:b], slice(*np.searchsorted(self.run, (a, b)))
            first = self.before[self.asked[self.run[runs]]]
            after = self.after[mine]
            arrays = [packed(self.word[first], 8), packed(self.times[first], 8), packed(self.runs[runs]), packed(self.word[after], 8), packed(self.learnt[mine]), packed(surprise[after])]
            yield _row(block, 1, int(self.share[a]), len(mine), arrays, None)
            a = b

    def scores(self, counts: list[np.ndarray], stays: list[np.ndarray], hot: dict[int, bool], t: Totals) -> pa.Table:
        times, stay = np.zeros(len(self.before)), np.zeros(len(self.before), bool)
        if len(self.asked):
            times[self.asked], stay[self.asked] = np.concatenate(counts), np.repeat(np.concatenate(stays) > 0, self.runs)
            common = np.flatnonzero(self.times[self.before] >= t.hot)
            stay[common] = [hot.get(w, False) for w in self.word[self.before[common]].tolist()]
        empty = self.p[self.after]
        p = np.where(stay, (times + WORD_KEEP * empty) / (self.times[self.before] + WORD_KEEP), empty)
        sums = [np.add.reduceat(x, self.bounds[:-1]) for x in (np.log10(p)[self.pair], np.log10(self.times + 0.1)[self.code], (self.times > 0).astype(np.int64)[self.code])]
        n = np.diff(self.bounds)
        base = sums[1] - n * np.log10(t.tokens + 0.1 * (t.distinct + 1))
        return pa.table([pa.array(self.ids, pa.int64()), pa.array(n), pa.array(sums[2]), pa.array(base), pa.array(sums[0])], names=["id", "n_tokens", "n_known", "base_score", "score"])


def _tested(t: Totals, gain: float):
    """A share of the pairs: counts over all blocks, and whether each context stays; for hot contexts the part of the gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, fields = [], ([], [], [], [], [], [])
        for batch in batches:
            for block, part, arrays in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "arrays")), strict=True):
                got = [unpacked(x, w) for x, w in zip(arrays, (8, 8, 4, 8, 4, 4), strict=True)]
                packs.append((block, part, len(got[2]), len(got[3])))
                for held, x in zip(fields, got, strict=True):
                    held.append(x)
        if not packs:
            return
        context, met, runs, after, learnt, surprise = map(np.concatenate, fields)
        contexts, first, at = np.unique(context, return_index=True, return_inverse=True)
        met = met[first].astype(float)
        nexts, after = np.unique(after, return_inverse=True)
        pairs, first, pair = np.unique(np.repeat(at, runs.astype(np.int64)) * len(nexts) + after, return_index=True, return_inverse=True)
        times = np.bincount(pair, learnt, len(pairs))
        log_p, of, some = surprise[first].astype(float) / -8, pairs // len(nexts), times > 0
        left = (times[some] - 1 + WORD_KEEP * np.exp(log_p[some])) / (met[of[some]] - 1 + WORD_KEEP)
        gains = np.bincount(of[some], times[some] * (np.log(left) - log_p[some]), len(contexts))
        stays, i, j = gains > gain, 0, 0
        for block, part, n_runs, n in packs:
            yield _row(block, 1, part, None, [packed(times[pair[j : j + n]], 8), packed(stays[at[i : i + n_runs]])], None)
            i, j = i + n_runs, j + n
        for k in np.flatnonzero(met >= t.hot).tolist():
            yield _row(-1, 2, 0, int(contexts[k]), [np.array(gains[k], "<f8").tobytes()], None)

    return run


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", shares: int | None = None, block_words: int = BLOCK_WORDS, gain: float = GAIN) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score, scores as log10.

    ``learn``: which rows to learn from (null: not). Null and blank texts are the end mark alone. The base is the
    smoothed count of each word and the end. Repeated rows repeat, null ids stay null; without training texts known
    counts are 0 and bytes are uniform; no documents give no rows; other columns are not read. A context stays if its
    gain is above ``gain`` nats. Blocks are written to the checkpoint folder; their size and ``shares`` change no result
    but for the last digits.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).cast("string").alias("text"))
    shares = shares or share_count(d)
    cut = bucketed(mapped(d, _cut(shares, block_words), BLOCKS), shares)
    dealt = cut.where("kind = 0").select("block", "part", "arrays").repartitionById(shares, F.col("part"))
    counts = checkpointed(mapped(dealt, _totals, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    texts = cut.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = {r.key: r.n for r in counts.where("kind = 0").collect()}  # four rows
    t = Totals(texts, got.get(0, 0) + texts, got.get(1, 0) + (texts > 0), got.get(2, 0), got.get(3, 0), shares)
    tree = train(counts)
    sent = docs.sparkSession.sparkContext.broadcast(tree)
    found = bucketed(mapped(dealt, lambda batches: _answers(sent.value)(batches), BLOCKS), shares)
    placed = cut.where("kind > 0")

    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(texts, answers.sort_by("part").to_pylist(), t, sent.value)
        out = pa.Table.from_batches(block.asks(texts.column("block")[0].as_py()), pa.schema(list(zip(NAMES, TYPES, strict=True))))
        release()
        return out

    asked = placed.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(ask, BLOCKS)
    tested = bucketed(mapped(asked.select("block", "part", "arrays").repartitionById(shares, F.col("part")), _tested(t, gain), BLOCKS), shares)
    part_gains = tested.where("kind = 2").select("n", F.col("arrays")[0].alias("x")).toArrow()  # at most HOT contexts a share
    hot: dict[int, float] = defaultdict(float)
    for w, x in zip(part_gains.column("n").to_pylist(), part_gains.column("x").to_pylist(), strict=True):
        hot[w] += np.frombuffer(x, "<f8")[0]
    hot = {w: bool(x > gain) for w, x in hot.items()}

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
        block = Block(texts, [a for a in answers if a["kind"] == 0], t, sent.value)
        pairs = [a["arrays"] for a in answers if a["kind"] == 1]
        out = block.scores([unpacked(x[0], 8) for x in pairs], [unpacked(x[1]) for x in pairs], hot, t)
        release()
        return out

    answers = found.unionByName(tested.where("kind = 1"))
    scored = placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("id", "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``, learnt from those of all folds but 0; odd rows as in ``score_texts``."""
    d = score_texts(read(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return d.select(F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
