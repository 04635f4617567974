"""BPE encoding and decoding by a table of distinct words.

Texts are cut where white space ends one word and begins the next: the tokenizer never merges across such a cut, so a
text's ids are its words' ids in order. A task turns its texts into blocks: the block's distinct words, most frequent
first, and for each text the positions of its words in that list. Distinct words are dealt by hash to the shares of the
word table, where each is encoded once; the ids come back to (block, place in the list) and are joined to the texts by
position. Only distinct words and packed positions are shuffled, so a very common word costs one entry a block. Decoding
joins ids with the table of pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LEVEL, bucketed, mapped, offsets, packed, ragged, read, release, rows, sha256, share_count, unpacked

TOKENIZER = "byte_bpe_50k.json"
BLOCK_WORDS = 2_000_000
BLOCK_CHARS = 16_000_000
GROUP_WORDS = 100_000

# Unicode white space, as the tokenizer's pattern has it.
WIDE = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SPACE = "\t\n\v\f\r " + "".join(WIDE)
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
# What a text that is cut at each space and line feed must not hold, WIDE apart: runs of white space, or other white space.
RUNS = ("  ", "\n\n", " \n", "\n ", "\0", "\t", "\v", "\f", "\r")


def units(text: str) -> list[str]:
    """The text cut at word boundaries; the parts joined give the text, and are encoded independently of each other.

    A single space belongs to the word that it precedes, other white space before a word to itself.
    """
    if any(x in text for x in RUNS) or not text.isascii() and any(x in text for x in WIDE):
        return UNIT.findall(text)
    return list(filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Words:
    """Splits texts at special tokens and word boundaries, and encodes words."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = special

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        if any(x in text for x in self.marks):
            return [u for i, x in enumerate(self.special.split(text)) if x for u in ([x] if i % 2 else units(x))]
        return units(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)] if words else []


def packed_words(words: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress("".join(words).encode())


# kind 0: a share of the block's distinct words; 1: the share of each word; 2: positions of some texts' words
BLOCKS = "block long, kind int, part int, sizes binary, data binary, ids array<long>"
NAMES = ["block", "kind", "part", "sizes", "data", "ids"]


def _row(*values) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=NAMES)


def _cut(path: str, shares: int, block_words: int):
    """Batches of (id, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, numbers = Words(path).split, TaskContext.get().partitionId(), count()

        def block(code: dict[str, int], ids: list, codes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            at = (task << 32) + next(numbers)
            listed = sorted(code)  # equally frequent words go by spelling, which packs well
            first = np.fromiter(map(code.__getitem__, listed), np.int64, len(listed))
            code.clear()
            ends, flat = offsets([len(c) for c in codes]), np.concatenate(codes)
            codes.clear()
            order = np.argsort(-np.bincount(flat, minlength=len(listed))[first], kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[first[order]] = np.arange(len(order), dtype=np.uint32)
            flat = rank[flat]
            listed = [listed[i] for i in order.tolist()]
            share = np.fromiter((zlib.crc32(w.encode()) % shares for w in listed), np.int64, len(listed))
            by = np.argsort(share, kind="stable")
            for mine in np.split(by, np.flatnonzero(np.diff(share[by])) + 1) if len(by) else ():
                own = [listed[i] for i in mine.tolist()]
                yield _row(at, 0, share[mine[0]], packed(np.fromiter(map(len, own), np.int64, len(own))), packed_words(own), None)
            yield _row(at, 1, 0, None, packed(share), None)
            group = ends[1:] // GROUP_WORDS + np.arange(len(ids)) // 2000
            for part, texts in enumerate(np.split(np.arange(len(ids)), np.flatnonzero(np.diff(group)) + 1)):
                a, b = int(texts[0]), int(texts[-1]) + 1
                yield _row(at, 2, part, packed(np.diff(ends[a : b + 1])), packed(flat[ends[a] : ends[b]]), ids[a:b])

        code, ids, codes, words, chars = defaultdict(count().__next__), [], [], 0, 0
        for whole in batches:
            for batch in rows(whole, 500):
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    text = text.as_py()
                    ws = split(text)
                    ids.append(i)
                    codes.append(np.fromiter(map(code.__getitem__, ws), np.uint32, len(ws)))
                    words, chars = words + len(ws), chars + len(text or "")
                    if words >= block_words or chars >= BLOCK_CHARS:
                        yield from block(code, ids, codes)
                        code, ids, codes, words, chars = defaultdict(count().__next__), [], [], 0, 0
                        release()
        if ids:
            yield from block(code, ids, codes)
        del batches, code, ids, codes
        release()

    return run


class Ids:
    """The ids of words, one after the other, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes, self.n, self.used = np.empty(1024, np.uint32), np.empty(1024, np.int64), np.empty(1024, np.uint32), 0, 0

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)])

    def add(self, found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total, n = int(sizes.sum()), self.n + len(found)
        self.flat, self.starts, self.sizes = self._room(self.flat, self.used + total), self._room(self.starts, n), self._room(self.sizes, n)
        self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.starts[self.n : n], self.sizes[self.n : n] = self.used + offsets(sizes)[:-1], sizes
        self.n, self.used = n, self.used + total

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[codes].astype(np.int64)
        return sizes, self.flat[ragged(self.starts[codes], sizes)]


def _share(path: str):
    """A share of the word table: every distinct word is encoded when it first turns up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, code, ids = Words(path), {}, Ids()
        for batch in batches:
            for block, part, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "sizes", "data")), strict=True):
                text = zstandard.ZstdDecompressor().decompress(data).decode()
                own = [text[a:b] for a, b in pairwise(offsets(unpacked(sizes)).tolist())]
                new = [w for w in own if w not in code]
                code.update(zip(new, range(len(code), len(code) + len(new)), strict=True))
                ids.add(words.encode(new))
                n, flat = ids.of(np.fromiter(map(code.__getitem__, own), np.int64, len(own)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([packed(n)], pa.binary()), pa.array([packed(flat)], pa.binary())], names=["block", "part", "sizes", "data"])

    return run


def _joined(texts: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
    """One block: its texts' positions and its distinct words' ids to (id, n_tokens, ids)."""
    words, texts = words.sort_by("part").to_pylist(), texts.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
    table = np.concatenate([*(unpacked(w["data"]) for w in words), np.empty(0, "<u4")])
    got = np.concatenate([*(unpacked(w["sizes"]) for w in words), np.empty(0, "<u4")]).astype(np.int64)
    ids = codes = None
    place = np.argsort(unpacked(texts[0]["data"]), kind="stable")  # shares keep the order of the block's list
    n, starts = np.empty_like(got), np.empty_like(got)
    n[place], starts[place] = got, offsets(got)[:-1]
    for row in texts[1:]:
        codes, ends = unpacked(row["data"]), offsets(unpacked(row["sizes"]))
        ids = table[ragged(starts[codes], n[codes])]
        cut = offsets(n[codes])[ends]
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.diff(cut)), pa.array([ids[a:b].tobytes() for a, b in pairwise(cut.tolist())], pa.binary())], names=ENCODED_NAMES)
    del table, ids, codes
    release()


ENCODED, ENCODED_NAMES = "id long, n_tokens long, ids binary", ["id", "n_tokens", "ids"]


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, shares: int | None, block_words: int, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Texts cut to blocks, distinct words encoded, and both joined by block; ``then`` is applied to a block's result.

    The blocks lie in bucketed files of the checkpoint folder, so that the positions, the larger part, are joined where
    they lie and only the words' ids are shuffled.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shares = shares or share_count(d)
    cut = bucketed(d.mapInArrow(_cut(path, shares, block_words), BLOCKS), shares)
    words = cut.where("kind = 0").select("block", "part", "sizes", "data").repartitionById(shares, F.col("part")).mapInArrow(_share(path), "block long, part int, sizes binary, data binary")
    texts = cut.where("kind > 0")

    def join(texts: pa.Table, words: pa.Table) -> pa.Table:
        return pa.Table.from_batches(then(_joined(texts, words)))

    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shares: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_tokens, ids): each whole text's token ids as little-endian unsigned 32-bit integers, in order.

    Null and empty texts have no ids. Repeated rows give repeated rows, null ids stay null, an empty table gives no
    rows and other columns are not read. ``path``: a byte-level BPE file of the tokenizers library. The cut texts are
    written to the session's checkpoint folder; ``shares`` is the number of tasks that hold the word table between them
    (one for 16 MB of input as Spark estimates it, or as many as shuffle partitions; 32 at least); any number gives the same rows.
    """
    return _encoded(docs, id_col, text_col, path or public_tokenizers.path(TOKENIZER), shares, block_words, lambda batches: batches, ENCODED)


def pieces(path: str) -> list[bytes]:
    """Each id's bytes. A byte-level vocabulary spells each byte as a printable character: itself, or 256 and up."""
    t = _tokenizer(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = []
    for i in range(t.get_vocab_size(with_added_tokens=True)):
        token = t.id_to_token(i) or ""
        out.append(bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode())
    return out


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece_id, piece), one row for each id of the vocabulary."""
    return spark.createDataFrame(pa.table({"piece_id": pa.array(range(len(p := pieces(path))), pa.int64()), "piece": pa.array(p, pa.binary())}))


ASKED, ASKED_NAMES = "piece_id long, " + ENCODED, ["piece_id", *ENCODED_NAMES]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Before each batch of (id, n_tokens, ids) a row for each distinct id in it, for the join with the pieces."""
    for whole in batches:
        for batch in rows(whole, 2000):
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4")
            ask = np.unique(flat).astype(np.int64)
            if len(ask):
                yield pa.RecordBatch.from_arrays([pa.array(ask), *(pa.nulls(len(ask), f.type) for f in batch.schema)], names=ASKED_NAMES)
            yield pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), *batch.columns], names=ASKED_NAMES)


def _spelt(digest: bool):
    """Joined rows, in order, to (id, n_tokens, ids, text), or to the hashes of the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, fresh = {}, True
        for batch in batches:
            asked = batch.column("piece_id").is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(asked)) + 1).tolist(), batch.num_rows]
            for a, b in pairwise(edges):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if asked[a]:
                    if not fresh:
                        piece, fresh = {}, True
                    piece.update(zip(part.column("piece_id").to_pylist(), part.column("piece").to_pylist(), strict=True))
                    continue
                fresh = False
                kept = [part.column("id"), part.column("n_tokens")]
                ids = part.column("ids").to_pylist()
                texts = [b"".join(map(piece.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in ids]
                if digest:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([sha256(x) for x in ids], pa.string()), pa.array([sha256(x.encode()) for x in texts], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([*kept, part.column("ids"), pa.array(texts, pa.string())], names=[*ENCODED_NAMES, "text"])

    return run


def _with_pieces(asked: DataFrame, path: str) -> DataFrame:
    """A join that keeps the order of rows: its other side has the vocabulary's size and is broadcast."""
    return asked.join(F.broadcast(piece_table(asked.sparkSession, path)), "piece_id", "left")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (id, n_tokens, ids) with the text of the ids, special tokens included.

    The distinct ids of each batch of rows are joined with the table of pieces. Bytes that are no UTF-8 are replaced
    as the library does; no ids give an empty text; null ids of rows stay null and repeated rows repeat.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    return _with_pieces(encoded.select(*ENCODED_NAMES).mapInArrow(_asked, ASKED), path).mapInArrow(_spelt(False), ENCODED + ", text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, shares: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_tokens and the hashes of ``encode``'s ids and of the text that ``decode`` makes of them.

    Odd rows as in ``encode``; the hashes of a null or empty text are those of no bytes.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    asked = _encoded(docs, id_col, text_col, path, shares, block_words, _asked, ASKED)
    return mapped(_with_pieces(asked, path), _spelt(True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text of ``documents``, one row a document; odd rows as in ``digests``."""
    return digests(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: token counts and digests of every document that is left; odd rows as in ``digests``."""
    return digests(docs)
