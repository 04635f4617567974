"""Chat formatting after the collapse of cumulative snapshots.

Logs often hold a conversation several times, each time longer. A rolling hash names every prefix of turns; a
conversation whose own hash is a proper prefix of another is dropped by an anti-join, copies keep their smallest id,
and what is left is rendered. Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpointed, read


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): repeated rows once, null roles and texts as empty, rows without conv_id left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return t.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, last, a, b): for each turn the rolling hash (a, b) of all turns up to it, and whether it is the last.

    Turns are ordered by number (null first), role and digest; rows that repeat all three count once. The hash is the
    exclusive or of 120 bits of the MD5 of each turn's place and digest, so a conversation costs time in proportion to
    its turns and none of it is gathered.
    """
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    again = reduce(Column.__and__, [F.lag(c).over(w).eqNullSafe(F.col(c)) for c in ("turn", "role", "digest")]) & (F.row_number().over(w) > 1)
    t = turns.select("conv_id", "turn", "role", "digest").withColumn("again", again).where(~F.col("again"))
    t = t.withColumn("k", F.row_number().over(w).cast("long")).withColumn("last", F.lead("k").over(w).isNull())
    placed = F.md5(F.concat(F.col("k").cast("string"), F.lit(":"), F.col("digest")))
    halves = [F.conv(F.substring(placed, at, 15), 16, 10).cast("long") for at in (1, 16)]
    rolled = [F.bit_xor(h).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for h, name in zip(halves, "ab", strict=True)]
    return t.select("conv_id", "k", "last", *rolled)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that no other one extends; of equal ones that of the smallest id.

    Both sides of the anti-join are first reduced to one row per hash, so a first turn or a conversation that is very
    common costs one row.
    """
    p = checkpointed(prefixes(turns))
    unique = p.where("last").groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.first("k").alias("n_turns"))
    return unique.join(p.where("NOT last").select("a", "b").distinct(), ["a", "b"], "left_anti").select("conv_id", "n_turns")


def render(conversations: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """(conv_id, n_turns, text): each maximal conversation as one text, turns in order, each as its role, a newline and its text.

    Rows without conv_id take no part, repeated rows count once, null roles and texts are empty; ties of a turn number
    go by role and digest; other columns are not read and an empty table gives no rows. A rendered conversation is one
    row, like a document.
    """
    turns = _turns(conversations)
    kept = turns.join(maximal(turns), "conv_id")
    listed = kept.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "digest", "text"))).alias("t"))
    parts = F.transform("t", lambda x: F.concat(F.lit(opening), x["role"], F.lit("\n"), x["text"], F.lit(closing)))
    return listed.select("conv_id", "n_turns", F.concat_ws("", parts).alias("text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation of ``conversations`` as one text; odd rows as in ``render``."""
    return render(read(spark, sf_dir, "conversations"))


OP7_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT *, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest ROWS UNBOUNDED PRECEDING) AS h,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM t
), u AS (SELECT h, min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY h),
m AS (SELECT conv_id FROM u WHERE h NOT IN (SELECT h FROM p WHERE k < n))
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '' ORDER BY k) AS text
FROM p WHERE conv_id IN (SELECT conv_id FROM m) GROUP BY conv_id
"""
