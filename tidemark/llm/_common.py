"""What the operators of this subpackage share: reading tables, folds, checkpoints and word splitting."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % of, F.lit(0))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share.

    Where the session names none, a temporary one is made if driver and executors are one process; on a cluster that
    is an error, as its machines would not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


LEVEL = 6
SHARE_BYTES = 1 << 24
MOST_SHARES = 8192
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, size: str = "8m") -> AbstractContextManager[None]:
    """What runs in here sends rows to Python in batches of about ``size``, as buffers of wide rows add up."""
    return _setting(spark, BATCH, size)


def no_small_broadcasts(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs in here joins by shuffles unless it asks for a broadcast: each small table that Spark would send by
    itself is built in the driver, and a job of many small steps fills its heap with them."""
    return _setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there."""
    checkpoint_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint(eager=True)


def freed(spark: SparkSession) -> None:
    """Lets Spark remove shuffle and checkpoint files that nothing refers to any more, as it does when the driver's JVM
    collects garbage; a job of many small steps may end before that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task and would hold it idle."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose workers give freed memory back when a task ends."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def rows(batch: pa.RecordBatch, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that working arrays stay small."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Maximal runs without 0x20 and 0x09-0x0D, with A-Z in lower case."""
    return text.lower().split()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def packed(x: np.ndarray, width: int = 4) -> bytes:
    """Unsigned integers of ``width`` bytes, compressed: all lowest bytes, then the next ones, and so on."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())


def unpacked(x: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def share_count(df: DataFrame) -> int:
    """How many tasks are to hold what ``df`` has: one for 16 MB as Spark estimates it, or the shuffle partitions; 32 at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # beyond 2^60: not known
    return max(32, min(MOST_SHARES, size // SHARE_BYTES) if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written to the checkpoint folder in buckets of its column ``block``, so that joins by block find it in place."""
    spark, name = df.sparkSession, f"blocks_{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.bucketBy(buckets, "block").option("path", f"{checkpoint_dir(spark)}/{name}").option("compression", "uncompressed").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay
    return out


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0]+lengths[0]-1, then those of the next, and so on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def masks(bits: int, blocks: int, free: int) -> list[int]:
    """For each choice of ``blocks - free`` blocks of a ``bits``-wide word, the mask of their bits."""
    edges = [math.ceil(bits * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - free)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
