"""SimHash near-duplicate detection: fingerprints, pigeonhole blocks, Hamming check and connected components.

Two fingerprints that differ in d bits agree on all but d of any six blocks of their bits, so for d = 3 they agree on
three of the six. Each distinct fingerprint is filed under its 20 choices of three blocks (about 32 bits), and only
fingerprints filed together are compared. Inside a file no pairs are emitted: each of its components is reported as a
star around its least member. Files beyond ``solve`` fingerprints are cut into chunks, and pairs of chunks are dealt
out as tasks of their own.

Near copies by their shingles (``near_copies``) take these components as candidates, add those of MinHash bands for pairs
that no fingerprint of 64 bits brings within three, and check every link on the whole sets of shingles.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpointed, freed, mapped, masks, no_small_broadcasts, read, rows, signed, text_bytes, words

SEED = 42
PIECE = 1 << 16


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 ``hashes`` have each bit."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(tokens: list[bytes], shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64; no words give 0, fewer than ``shingle`` one shingle."""
    if not tokens:
        return 0
    n = max(1, len(tokens) - shingle + 1)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(shingle, len(tokens)) - 1 :].tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        ones += _ones(np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], ends[at : at + PIECE], strict=True)], "<u8"))
    return _majority(ones, n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows(whole):
                fps = [signed(fingerprint(words(t), shingle)) for t in text_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, fp long")


def components(fps: np.ndarray, bits: int) -> np.ndarray:
    """For each of the distinct uint64 ``fps`` the least member of its component under links of at most ``bits``.

    A breadth-first search that compares each frontier with what is not yet reached: a dense file ends after a few
    steps, a sparse one costs a comparison per pair, and no pair is kept.
    """
    out, left = fps.copy(), np.arange(len(fps))
    while len(left) > 1:
        found, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                rest = np.flatnonzero(~near)
                if not len(rest):
                    break
                near[rest] = (np.bitwise_count(fps[front[at : at + 64], None] ^ fps[None, left[rest]]) <= bits).any(axis=0)
            front, left = left[near], left[~near]
            found.append(front)
        members = np.concatenate(found)
        out[members] = fps[members].min()
    return out


def _stars(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    least = components(fps, bits)
    link = least != fps
    return fps[link], least[link]


def _files(bits: int, solve: int, chunk: int):
    """Rows sorted by (t, key, fp) to links (a, b), and chunks (t, key, i, n, fps) of files that are too large to solve here."""

    def out(a: list, b: list) -> pa.RecordBatch:
        a, b = (np.concatenate([*x, np.empty(0, np.uint64)]).view(np.int64) for x in (a, b))
        none = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=NAMES)

    def solved(fps: np.ndarray, runs: np.ndarray, first: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        """Whole files only: ``runs`` are their ends."""
        starts, sizes = np.concatenate([[0], runs[:-1]]), np.diff(runs, prepend=0)
        a, b = [], []
        for gap in range(1, 8):
            small = (sizes > gap) & (sizes <= 8)
            reach = (sizes - gap)[small]
            at = np.repeat(starts[small] - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
            x, y = fps[at], fps[at + gap]
            near = np.bitwise_count(x ^ y) <= bits
            a.append(np.maximum(x, y)[near])
            b.append(np.minimum(x, y)[near])
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
            x, y = _stars(fps[s : s + n], bits)
            a.append(x)
            b.append(y)
        yield out(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, large = np.empty(0, np.uint64), None, 0

        def chunks(x: np.ndarray, i: int) -> pa.RecordBatch:
            n = -(-len(x) // chunk)
            parts = [x[j * chunk : (j + 1) * chunk].tobytes() for j in range(n)]
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array([key[0]] * n, pa.int32()), pa.array([key[1]] * n, pa.int64()), pa.array(range(i, i + n), pa.int32()), pa.nulls(n, pa.int32()), pa.array(parts, pa.binary())], names=NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp"))
            fp = fp.astype(np.int64).view(np.uint64)
            ends = np.append(np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1, len(t))
            if key is not None and (int(t[0]), int(k[0])) != key:  # what is held is whole
                if large:
                    yield chunks(held, large - 1)
                else:
                    yield from solved(held, np.array([len(held)]), key)
                held, large = np.empty(0, np.uint64), 0
            fp = np.concatenate([held, fp])
            ends = ends + len(held)
            if large and len(ends) > 1:
                yield chunks(fp[: ends[0]], large - 1)
                ends, fp, large = ends[1:] - ends[0], fp[ends[0] :], 0
            done, key = ends[:-1], (int(t[-1]), int(k[-1]))
            cut = int(done[-1]) if len(done) else 0
            if cut:
                yield from solved(fp[:cut], done, key)
            held = fp[cut:]
            if len(held) > solve:
                full = len(held) // chunk * chunk
                yield chunks(held[:full], max(0, large - 1))
                large = max(0, large - 1) + full // chunk + 1
                held = held[full:]
        if key is not None:
            if large:
                yield chunks(held, large - 1)
            else:
                yield from solved(held, np.array([len(held)]), key)

    return run


NAMES = ["a", "b", "t", "key", "i", "n", "fps"]
SCHEMA = "a long, b long, t int, key long, i int, n int, fps binary"


def _chunk_pairs(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = _stars(np.unique(np.concatenate([np.frombuffer(p, np.uint64) for p in (x, y)])), bits)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(distinct_fps: DataFrame, bits: int = 3, width: int = 64, solve: int = 8192, chunk: int = 4096) -> DataFrame:
    """(a, b), enough links between distinct fingerprints (column fp) to connect what lies within ``bits`` of each other."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for t, m in enumerate(masks(width, 2 * bits, bits))])
    filed = distinct_fps.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp")
    found = checkpointed(filed.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(_files(bits, solve, chunk), SCHEMA))
    near = found.where(F.col("a").isNotNull()).select("a", "b")
    parts = found.where(F.col("fps").isNotNull()).select("t", "key", "i", "fps")
    return near.unionByName(chunk_pairs(parts).select("x", "y").mapInArrow(_chunk_pairs(bits), "a long, b long")).distinct()


def chunk_pairs(parts: DataFrame) -> DataFrame:
    """Each pair of chunks (t, key, i, fps) of a file, a chunk with itself included, spread over tasks pair by pair."""
    x, y = parts.withColumnRenamed("fps", "x"), parts.select("t", "key", F.col("i").alias("j"), F.col("fps").alias("y"))
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return x.join(y, ["t", "key"]).where("i <= j").repartition(tasks, "t", "key", "i", "j")


def connected(edges: DataFrame, limit: int = 200, free: bool = False) -> DataFrame:
    """(node, root) for each node of the links (a, b): nodes of a component share one root, its least node.

    Each round hooks every node to its least neighbour, redraws the links between those and drops what has become a
    loop. All groupings are partial sums first and joins have one row per key on one side, so hubs can be split.
    With ``free`` the driver collects its garbage after each round.
    """
    hooks, e = [], checkpointed(edges.select("a", "b").where("a <> b"))
    while not e.isEmpty():
        if len(hooks) == limit:
            raise RuntimeError(f"links still change after {limit} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")))
        a, b = (hook.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        e = checkpointed(e.join(a, "a").join(b, "b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).where("a <> b").distinct())
        hooks.append(hook)
        if free:
            del both, hook, a, b
            freed(edges.sparkSession)
    if not hooks:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = hooks[0].withColumnRenamed("to", "root")
    for hook in hooks[1:]:
        labels = labels.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return checkpointed(labels)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3, **sizes: int) -> DataFrame:
    """One row per document: id, fp (long), component_id, the smallest id reachable over links of ``bits`` or fewer.

    Null and blank texts have fingerprint 0 and link like any other. A row with a null id gets its group's smallest
    id, null if the group has none. Repeated rows give repeated rows; an empty table gives none; other columns of
    ``docs`` are not read.
    """
    f = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    firsts = f.groupBy("fp").agg(F.min("id").alias("first"))
    roots = connected(links(firsts.select("fp"), bits, **sizes))
    classes = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = checkpointed(classes.select("fp", "root", "first"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return f.join(classes.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(hashes: np.ndarray, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``shingle`` words, from its words' hashes; a shorter text is one run."""
    if not len(hashes):
        return hashes
    size = min(shingle, len(hashes))
    h = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - size + 1 + k]
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h))


def band_keys(x: np.ndarray, bands: int, width: int) -> np.ndarray:
    """For each band a hash of its number and its ``width`` MinHash values; none for an empty set."""
    if not len(x):
        return x
    salt = mixed(np.arange(1, 2 * bands * width + 1, dtype=np.uint64))
    a, b, least = salt[::2] | np.uint64(1), salt[1::2], np.full(bands * width, ~np.uint64(0))
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (x[at : at + 4096, None] * a + b).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for m in least.reshape(bands, width).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + m)
    return key


def shingled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bands: int = 20, width: int = 3, whole_sets: bool = False) -> DataFrame:
    """(id, h, cls, n, fp, keys) for each row: ``h`` is the text's hash, ``cls`` tells sets of shingles apart, ``n`` is a
    set's size, ``fp`` its SimHash fingerprint and ``keys`` are those of its MinHash bands; or (cls, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows(whole, 250):
                seen: dict[bytes, int] = {}
                cls, n, fp, found = [], [], [], []
                for text in text_bytes(batch.column(1)):
                    ws = words(text)
                    for w in set(ws).difference(seen):
                        seen[w] = xxhash.xxh64_intdigest(w, SEED)
                    x = shingle_set(np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws)), shingle)
                    cls.append(signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)))
                    n.append(len(x))
                    if whole_sets:
                        found.append(x.tobytes())
                    else:
                        fp.append(signed(_majority(_ones(x), len(x))))
                        found.append(band_keys(x, bands, width).view(np.int64))
                cls = pa.array(cls, pa.int64())
                if whole_sets:
                    yield pa.RecordBatch.from_arrays([cls, pa.array(found, pa.binary())], names=["cls", "shingles"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), cls, pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["id", "h", "cls", "n", "fp", "keys"])

    schema = "cls long, shingles binary" if whole_sets else "id long, h long, cls long, n long, fp long, keys array<long>"
    text = F.col(text_col).cast("string")
    return mapped(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h")), run, schema)


def _similar(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in rows(whole, 250):
                near = []
                for p, q in zip(batch.column("x"), batch.column("y"), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    near.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def shared_counts(sets: list[np.ndarray], dense: int = 32, width: int = 4096) -> np.ndarray:
    """For each pair of sets how many members they share: rare members by pairs of their holders, others by products."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    held = np.diff(np.append(first, len(flat)))
    many = np.repeat(held > dense, held)
    out = np.zeros(m * m, np.int64)
    e, r = flat[~many], row[~many]
    for gap in range(1, min(dense, int(held[held <= dense].max(initial=0)))):
        same = e[gap:] == e[:-gap]
        out += np.bincount(r[:-gap][same] * m + r[gap:][same], minlength=m * m)
    out = out.reshape(m, m)
    out += out.T
    column, r = np.repeat(np.cumsum(held > dense) - 1, held)[many], row[many]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        here = (column >= at) & (column < at + width)
        x = np.zeros((m, width), np.float32)
        x[r[here], column[here] - at] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def file_links(sets: list[np.ndarray], roots: np.ndarray, sides: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links between sets of different roots, stars of each component; with ``sides`` only across them."""
    n = np.array([len(x) for x in sets], np.int64)
    both = shared_counts(sets)
    near = (both >= threshold * (n[:, None] + n[None] - both) - 1e-9) & (roots[:, None] != roots[None])
    if sides is not None:
        near &= sides[:, None] != sides[None]
    a, b, left = [], [], near.any(axis=1)
    while left.any():
        start = int(left.argmax())
        found, front = np.zeros(len(n), bool), np.zeros(len(n), bool)
        found[start] = front[start] = True
        while front.any():
            front = near[front].any(axis=0) & ~found
            found |= front
        left &= ~found
        found[start] = False
        a.append(np.flatnonzero(found))
        b.append(np.full(int(found.sum()), start))
    return np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])


def _compared(threshold: float):
    """Rows sorted by (key, lo, hi) to links within each such group of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None

        def out() -> pa.RecordBatch:
            cls, roots, side, sets = zip(*held, strict=True)
            cls, split = np.array(cls, np.int64), len(set(side)) > 1 or group[1] != group[2]
            a, b = file_links([np.frombuffer(x, np.uint64) for x in sets], np.array(roots, np.int64), np.array(side) if split else None, threshold)
            return pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], names=["a", "b"])

        for batch in batches:
            for key, lo, hi, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "lo", "hi", "cls", "root", "part", "shingles")), strict=True):
                if (key, lo, hi) != group:
                    if len(held) > 1:
                        yield out()
                    held, group = [], (key, lo, hi)
                held.append(member)
        if len(held) > 1:
            yield out()

    return run


def within_files(open_: DataFrame, sets: DataFrame, threshold: float, members: int = 1024, shingles: int = 500_000) -> DataFrame:
    """(a, b): links between classes of different roots in each file of ``open_`` (key, cls, n, root), compared pair by pair.

    A file of more than ``members`` sets or ``shingles`` shingles is dealt into parts, and each pair of parts is a task's
    work of its own, so no file is too large and none is cut short.
    """
    sizes = open_.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / members, F.sum("n") / shingles)).cast("int").alias("parts"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    dealt = open_.join(sizes.select("key", "parts"), "key").withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "cls", "root")
    grouped = pairs.join(sets, "cls").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return mapped(grouped, _compared(threshold), "a long, b long")


def shingle_links(files: DataFrame, sets: DataFrame, threshold: float = 0.8, send: int = 1_000_000) -> DataFrame:
    """(a, b), enough links between the classes of ``files`` (cls, n, key) to connect pairs that share a key and are alike.

    ``sets`` (cls, shingles) may repeat; those in a file with others are kept, found without a shuffle of all sets
    where there are at most ``send`` of them.

    Every link is checked on the whole sets. Twice each file (sets of one key) is compared with one of its members
    alone; then what shares a file and is not yet connected is compared pair by pair. So a file of near copies gives
    no square of pairs, and no pair that a file holds is left out.
    """
    several = files.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key")
    files = checkpointed(files.join(several, "key"))
    wanted = checkpointed(files.select("cls").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= send else wanted
    held = checkpointed(sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]))
    x, y = held.toDF("a", "x"), held.toDF("b", "y")
    done = near = files.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    open_ = files.withColumn("root", F.col("cls"))
    for pick in (F.min, F.max):
        picked = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), pick(F.struct("cls", "n", "root")).alias("p")).where("lo < hi")
        pairs = open_.join(picked.select("key", "p.*").toDF("key", "cls2", "n2", "root2"), "key")
        fits = F.least("n", "n2") >= F.greatest("n", "n2") * threshold - 1e-9
        pairs = pairs.where((F.col("root") != F.col("root2")) & fits).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()
        pairs = checkpointed(pairs.join(done, ["a", "b"], "left_anti"))
        done = done.unionByName(pairs)
        near = checkpointed(near.unionByName(mapped(pairs.join(x, "a").join(y, "b"), _similar(threshold), "a long, b long")))
        roots = connected(near, free=True).withColumnRenamed("node", "cls")
        open_ = checkpointed(files.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")))
        del roots, pairs, picked
        freed(files.sparkSession)
    return near.unionByName(checkpointed(within_files(open_, held, threshold).distinct()))


def fingerprint_files(classes: DataFrame, bits: int = 3) -> DataFrame:
    """(cls, n, key) for each of the ``classes`` (cls, n, fp): a key for each component of fingerprints that link at ``bits``."""
    roots = connected(links(classes.select("fp").distinct(), bits), free=True).withColumnRenamed("node", "fp")
    files = checkpointed(classes.join(roots, "fp", "left").select("cls", "n", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")).alias("key")))
    del roots
    freed(files.sparkSession)
    return files


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bits: int = 3, bands: int = 20) -> DataFrame:
    """(id, h, root) for each row: its text's hash and its group of near copies, as ``near_copies`` has them."""
    with no_small_broadcasts(docs.sparkSession):
        f = checkpointed(shingled(docs, id_col, text_col, shingle, bands))
        each = f.groupBy("cls").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
        sets = shingled(docs, id_col, text_col, shingle, whole_sets=True)
        files = each.select("cls", "n", F.explode("keys").alias("key"))
        files = files.unionByName(fingerprint_files(f.where("n > 0").select("cls", "n", "fp").distinct(), bits))
        roots = connected(shingle_links(files, sets, threshold), free=True).withColumnRenamed("node", "cls")
    return f.select("id", "h", "cls").join(roots, "cls", "left").select("id", "h", F.coalesce("root", "cls").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, bits: int = 3, bands: int = 20) -> DataFrame:
    """One row per document: id, component_id, the smallest id reachable over pairs whose sets of shingles have a
    Jaccard similarity of ``threshold`` or more. Null and blank texts are alike; null ids as in ``near_duplicates``.

    Candidates are the components of SimHash fingerprints of the sets that differ in ``bits`` or fewer, found as in
    ``near_duplicates``. Sets at 0.8 differ in about 10 of 64 bits, so those that share one of the ``bands`` of three
    MinHash values are candidates too: of 20 a pair at 0.8 shares none in (1 - 0.8^3)^20 = 6 of 10 million cases, and
    every more similar pair in fewer.
    """
    with no_small_broadcasts(docs.sparkSession):
        g = checkpointed(copy_groups(docs, id_col, text_col, shingle, threshold, bits, bands))
    return g.join(g.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("id", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of ``documents``; odd rows as in ``near_duplicates``."""
    d = near_duplicates(read(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, send: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``: that of its smallest doc_id. The groups come from SimHash
    fingerprints, blocks of their bits, the Hamming check and components; bands add candidates, whole sets decide.

    Rows without an id come after all others of their group. Rows that share an id but belong to different groups are
    decided on each by itself; of a group's rows of that id the text of smallest hash stays, and of rows that repeat both
    id and text one stays. Null and blank texts are one group; an empty table gives no rows. Up to ``send`` ids that go
    are broadcast (a long and a number each); beyond that texts are shuffled by id, with the same result.
    """
    i, h, kept = (f"_{uuid.uuid4().hex}" for _ in range(3))  # no column of ``docs`` has these names
    def name(c: str) -> Column:
        return F.coalesce(F.col(c).cast("long").cast("string"), F.lit("none")).alias(i)

    with no_small_broadcasts(spark):
        each = checkpointed(copy_groups(docs).groupBy("root", "id", "h").agg(F.count("*").alias("n")))
        place = F.struct(F.col("id").isNull().alias("none"), "id", "h")
        firsts = checkpointed(each.groupBy("root").agg(F.min(place).alias("first")))  # apart, so that the join can split a large group
        ranked = each.withColumn("place", place).join(firsts, "root")
        # rows to look at: all that go, and those that repeat id and text, of which one stays
        marks = checkpointed(ranked.select(name("id"), F.col("h").alias(h), (F.col("place") == F.col("first")).alias(kept), "n").where(f"n > 1 OR NOT {kept}").drop("n"))
        size, repeats = marks.agg(F.count("*"), F.count_if(kept)).first()
    sent = F.broadcast if size <= send else lambda x: x
    marked = docs.select("*", name("doc_id"), F.xxhash64(F.col("text").cast("string")).alias(h))
    left = marked.join(sent(marks.select(i, h)), [i, h], "left_anti")
    if repeats:
        left = left.unionByName(marked.join(sent(marks.where(kept).select(i, h)), [i, h], "left_semi").dropDuplicates([i, h]))
    return left.select(docs.columns)
