"""Moving-block bootstrap over origins, with intervals, pairwise win shares and the share of inverted rankings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .leaderboard import rank_correlation


@dataclass(frozen=True)
class BootstrapConfig:
    n_resamples: int = 200
    block: int = 12
    confidence: float = 0.95
    seed: int | None = None  # none: starts from a hash of the resample and the block


def starts(spark: SparkSession, n_origins: int, config: BootstrapConfig) -> DataFrame:
    """(b, k, start): where block k of resample b begins; a block as long as the series repeats it whole."""
    if config.block >= n_origins:
        return spark.range(config.n_resamples).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("start"))
    blocks, most = -(-n_origins // config.block), n_origins - config.block + 1
    if config.seed is None:
        grid = spark.range(config.n_resamples).select(F.col("id").alias("b"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("k"))
        return grid.withColumn("start", F.expr(f"conv(substr(md5(concat(b, ':', k)), 1, 8), 16, 10) % {most}").cast("long"))
    rng = np.random.default_rng(config.seed)
    drawn = [(b, k, int(s)) for b in range(config.n_resamples) for k, s in enumerate(rng.integers(0, most, size=blocks))]
    return spark.createDataFrame(drawn, "b long, k long, start long")


def resample(panel: DataFrame, config: BootstrapConfig = BootstrapConfig(), metric: str = "mase") -> DataFrame:
    """(b, model, regime, mean): each resample's mean score over the origins that its blocks pick.

    The panel is first summed to one row for each origin, model and regime, so what meets the picks is small; sums of
    picks are partial before the shuffle. A model and regime that a resample lacks has no row, not a zero.
    """
    cells = panel.groupBy("origin", "model", "regime").agg(F.sum(metric).alias("total"), F.count("*").alias("n"))
    index = panel.select("origin").distinct().withColumn("i", F.row_number().over(Window.orderBy("origin")).cast("long") - 1)  # a row an origin
    n = panel.select("origin").distinct().count()
    length = min(config.block, n)
    place = F.explode(F.expr(f"sequence(0L, {length - 1}L)")).alias("o")
    picks = starts(panel.sparkSession, n, config).select("b", "k", "start", place).where(F.col("k") * length + F.col("o") < n)
    picks = picks.select("b", (F.col("start") + F.col("o")).alias("i")).groupBy("b", "i").agg(F.count("*").alias("times"))
    drawn = picks.join(index, "i").join(cells, "origin")
    return drawn.groupBy("b", "model", "regime").agg((F.sum(F.col("total") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"))


def intervals(draws: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(model, regime, lo, hi, n_usable): percentile intervals of the resampled means; null for fewer than two."""
    tail = (1 - confidence) / 2
    return draws.groupBy("model", "regime").agg(*[F.when(F.count("mean") >= 2, F.percentile("mean", F.lit(q))).alias(name) for name, q in (("lo", tail), ("hi", 1 - tail))], F.count("mean").alias("n_usable"))


def win_shares(draws: DataFrame) -> DataFrame:
    """(model, opponent, regime, p_beats, n_usable): how often a model's mean is strictly below an opponent's."""
    other = draws.select("b", "regime", F.col("model").alias("opponent"), F.col("mean").alias("theirs"))
    pairs = draws.join(other, ["b", "regime"]).where("model <> opponent")
    return pairs.groupBy("model", "opponent", "regime").agg(F.avg((F.col("mean") < F.col("theirs")).cast("double")).alias("p_beats"), F.count("*").alias("n_usable"))


def correlations(draws: DataFrame) -> DataFrame:
    """(b, n, rho): each resample's rank correlation between the regimes."""
    wide = draws.groupBy("b", "model").pivot("regime", ["clean", "shock"]).agg(F.first("mean"))
    return rank_correlation(wide, "clean", "shock", ["b"])


def inversion(draws: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row: share of resamples whose rank correlation is negative, its interval and how many are usable."""
    tail = (1 - confidence) / 2
    return correlations(draws).agg(F.avg(F.when(F.col("rho").isNotNull(), (F.col("rho") < 0).cast("double"))).alias("p_inversion"), F.percentile("rho", F.lit(tail)).alias("lo"), F.percentile("rho", F.lit(1 - tail)).alias("hi"), F.count("rho").alias("n_usable"))


def verdicts(deltas: DataFrame, shares: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Ablations in long form with the share of resamples that favour the treatment, and whether that settles it."""
    long = deltas.select("ablation", "treatment", "control", F.expr("stack(2, 'clean', delta_clean, 'shock', delta_shock) AS (regime, delta)"))
    s = shares.select(F.col("model").alias("treatment"), F.col("opponent").alias("control"), "regime", "p_beats")
    settled = (F.col("p_beats") >= confidence) | (1 - F.col("p_beats") >= confidence)
    return long.join(s, ["treatment", "control", "regime"], "left").withColumn("resolved", settled)


def assemble(parts: Sequence[DataFrame]) -> DataFrame:
    """Statistics of different shapes in one long table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
