"""Exact top-k search by inner product with Fagin's threshold algorithm.

Candidates are dealt into bounded blocks, each with one sorted list per dimension. A block of queries reads the lists of
a block of candidates from both ends at once, scores rows as they turn up, and a query stops as soon as the bound on rows
not yet seen is below its kth score, which it carries from block to block. Parts of packed blocks meet part by part, read
from the checkpoint folder; what is shuffled is a part's k best per query, never copies of query blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, mapped, read

LONG = np.iinfo(np.int64)
CHUNK = 4096
TASKS = 2000


def scaled(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) for each component as long, saturating at the range of long.

    Rows with a null id, a null vector or a component that is null or not finite take no part. Rows that repeat an
    id count once, with the least vector.
    """
    ok = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ok)
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(vectors: list[pa.Array]) -> np.ndarray:
    """The vectors as rows, padded with zeros, as 16-bit integers where all fit."""
    length = np.concatenate([v.value_lengths().to_numpy(zero_copy_only=False) for v in vectors])
    flat = np.concatenate([v.flatten().to_numpy() for v in vectors])
    dim = int(length.max(initial=0))
    small = not len(flat) or -(2**15) <= flat.min() and flat.max() < 2**15
    out = np.zeros((len(length), dim), np.int16 if small else np.int64)
    out[np.arange(dim) < length[:, None]] = flat
    return out


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, v) sorted by block to a packed row per block."""
    block, ids, vs = None, [], []

    def out() -> pa.RecordBatch:
        m = _matrix(vs)
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "dim": pa.array([m.shape[1]], pa.int32()), "width": pa.array([m.itemsize], pa.int32()), "ids": pa.array([np.concatenate(ids).tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary())})

    for batch in batches:
        b = batch.column("block").to_numpy()
        for at, end in pairwise([0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)] if len(b) else []):
            if b[at] != block and ids:
                yield out()
                ids, vs = [], []
            block = int(b[at])
            ids.append(batch.column("id").to_numpy()[at:end])
            vs.append(batch.column("v").slice(at, end - at))
    if ids:
        yield out()


PACKED = "block long, dim int, width int, ids binary, m binary"


def blocks(df: DataFrame, n: int, parts: int) -> DataFrame:
    """``df`` of (id, v) as one packed row for each of ``n`` blocks, written in ``parts`` partitions."""
    dealt = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    return checkpointed(mapped(dealt.repartition(parts, "block").sortWithinPartitions("block"), _pack, PACKED).coalesce(parts))


def listed(m: np.ndarray, lists: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids and rows of ``m`` in the order in which the lists show them, read from both ends; each row's depth; the values
    that the lists have at each depth from the top and from the bottom."""
    n = len(ids)
    place = np.empty_like(lists)
    np.put_along_axis(place, lists, np.arange(n, dtype=lists.dtype)[None], axis=1)
    depth = np.minimum(place, n - 1 - place).min(axis=0, initial=n - 1)
    order, low = np.argsort(depth, kind="stable"), np.take_along_axis(m, lists.T, axis=0)
    return ids[order], m[order], depth[order], low[::-1], low


def _merge(best: list[np.ndarray], at: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Puts what ``scores`` (queries ``at`` by rows ``ids``) has among the k best of these queries into ``best``."""
    s, i = best
    some = np.flatnonzero(scores.max(axis=1) >= s[at, -1])
    x, y = np.nonzero(scores[some] >= s[at[some], -1:])
    x, found, vec = at[some][x], scores[some[x], y], ids[y]
    new = (vec != own[x]) & ((found > s[x, -1]) | (vec < i[x, -1]))
    x, found, vec = x[new], found[new], vec[new]
    qs, k = np.unique(x), s.shape[1]
    x, found, vec = np.concatenate([x, np.repeat(qs, k)]), np.concatenate([found, s[qs].ravel()]), np.concatenate([vec, i[qs].ravel()])
    order = np.lexsort((vec, -found, x))
    order = order[np.searchsorted(x[order], qs)[:, None] + np.arange(k)]
    s[qs], i[qs] = found[order], vec[order]


def threshold_search(q: np.ndarray, own: np.ndarray, best: list[np.ndarray], block: tuple[np.ndarray, ...], first: int = 64) -> int:
    """Brings ``best`` (scores and ids, a row of k for each query, best first) up to date with a block as ``listed`` has it.

    All numbers are floats that are exact integers, or Python integers. Rows may be unseen only while the bound is below
    the kth score, so ties are never missed. Returns how many scores were taken.
    """
    ids, m, depth, high, low = block
    at, p, step, taken = np.arange(len(q)), 0, first, 0
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    while p < len(ids):
        at = at[up[at] @ high[depth[p]] + down[at] @ low[depth[p]] >= best[0][at, -1]]
        if not len(at):
            break
        to = min(len(ids), p + step)
        _merge(best, at, own, q[at] @ m[p:to].T, ids[p:to])
        taken += len(at) * (to - p)
        p, step = to, min(2 * step, CHUNK)
    return taken


def _none(n: int, k: int) -> list[np.ndarray]:
    return [np.full((n, k), -np.inf), np.full((n, k), LONG.max)]


def _exact(score: np.ndarray) -> np.ndarray:
    """Python's integers for floats that are integers."""
    return np.array([[int(x) if np.isfinite(x) else x for x in row] for row in score], object).reshape(score.shape)


def threshold_topk(q: np.ndarray, own: int, m: np.ndarray, lists: np.ndarray, ids: np.ndarray, k: int, first: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k best rows of ``m`` for ``q``, ties to smaller ids; the row of id ``own`` is left out.

    ``lists``: for each dimension the rows in ascending order.
    """
    best = _none(1, k)
    best[0] = best[0].astype(m.dtype)
    threshold_search(q[None], np.array([own]), best, listed(m, lists, ids), first)
    there = (best[0][0] > -np.inf).astype(bool)
    place = np.argsort(ids, kind="stable")
    return place[np.searchsorted(ids[place], best[1][0][there])], best[0][0][there]


def _search(k: int):
    def load(batch: pa.RecordBatch, r: int, p: str) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(batch.column(p + "ids")[r].as_buffer(), np.int64)
        width, dim = (batch.column(p + c)[r].as_py() for c in ("width", "dim"))
        return ids, np.frombuffer(batch.column(p + "m")[r].as_buffer(), f"<i{width}").reshape(len(ids), dim)

    def most(m: np.ndarray) -> int:
        return max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, tuple] = {}
        block = None
        for batch in batches:
            for r, (b, of) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "q_block")), strict=True)):
                if of not in queries:
                    own, q = load(batch, r, "q_")
                    queries[of] = own.copy(), q.copy(), most(q), _none(len(own), k)
                if b != block:
                    block, (ids, m), kinds = b, load(batch, r, ""), {}
                    lists, largest = np.argsort(np.ascontiguousarray(m.T), axis=1, kind="stable"), most(m)
                own, q, q_largest, best = queries[of]
                dim = min(q.shape[1], m.shape[1])  # what one side lacks is zero
                top = dim * q_largest * largest
                kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else object  # beyond, floats are not exact
                if (kind, dim) not in kinds:
                    kinds[kind, dim] = listed(m[:, :dim].astype(kind), lists[:dim], ids)
                if kind is object and best[0].dtype != object:
                    best[0] = _exact(best[0])
                threshold_search(q[:, :dim].astype(kind), own, best, kinds[kind, dim])
        for own, _, _, (score, ids) in queries.values():
            there = (score > -np.inf).astype(bool)
            score = score[there] if score.dtype != object else np.array([min(max(x, LONG.min), LONG.max) for x in score[there]], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.repeat(own, there.sum(axis=1)), ids[there], score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return search


def topk_inner_product(candidates: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 8192, query_rows: int = 1024, group: int = 64) -> DataFrame:
    """The k candidates of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    Both inputs are (id long, v array<long>), one row per id. A candidate with the query's id is left out. Ties go to
    the smaller id; fewer than k candidates give fewer rows; an empty input gives none. Shorter vectors count as
    padded with zeros. Scores beyond long saturate. Every query block meets every candidate block: a query set
    against all rows. A task takes ``group`` candidate blocks and 16 query blocks, or more candidate blocks where that
    would give over ``TASKS`` tasks; it holds one candidate block at a time.
    """
    rows = candidates.count(), queries.count()
    n_c, n_q = (max(1, -(-n // size), min(16, -(-n // 512))) for n, size in zip(rows, (block_rows, query_rows), strict=True))
    q_parts = min(-(-n_q // 16), TASKS)
    c_parts = min(n_c, max(16, -(-n_c // group)), TASKS // q_parts)
    q = blocks(queries, n_q, q_parts)
    c = blocks(candidates, n_c, c_parts).hint("shuffle_replicate_nl")
    found = checkpointed(mapped(c.crossJoin(q.toDF(*(f"q_{x}" for x in q.columns))), _search(k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whose id is divisible by 50 against all embeddings, five best each."""
    v = scaled(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_inner_product(v, v.where(F.col("id") % 50 == 0))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
