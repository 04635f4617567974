"""Scores by regime and horizon, ranks, rank correlation and comparisons between arms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGIMES = ["clean", "shock"]


def per_regime(panel: DataFrame, metric: str = "mase", by: Sequence[str] = ()) -> DataFrame:
    """A row a model: mean score, count and rank (least first, ties share the least rank) in each regime."""
    means = panel.groupBy(*by, "model").pivot("regime", REGIMES).agg(F.avg(metric).alias("score"), F.count(F.lit(1)).alias("n"))
    table = means.select(*by, "model", *[F.col(f"{r}_score").alias(r) for r in REGIMES], *[F.coalesce(f"{r}_n", F.lit(0)).cast("long").alias(f"{r}_n") for r in REGIMES])
    ranks = {f"{r}_rank": F.when(F.col(r).isNotNull(), F.rank().over(Window.partitionBy(*by, F.col(r).isNull()).orderBy(r)).cast("long")) for r in REGIMES}
    return table.withColumns(ranks).withColumn("rank_change", F.col("shock_rank") - F.col("clean_rank"))


def counts(panel: DataFrame) -> DataFrame:
    """Forecasts by regime and window, in all and for each model."""
    models = panel.agg(F.countDistinct("model").alias("models"))
    n = panel.groupBy("regime", "shock_window").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(models)).select("regime", "shock_window", "n", F.floor(F.col("n") / F.col("models")).alias("n_a_model"))


def best(panel: DataFrame, metric: str = "mase") -> DataFrame:
    """The model of least mean score in each regime, ties to the name that sorts first."""
    means = panel.groupBy("regime", "model").agg(F.avg(metric).alias("score"))
    return means.groupBy("regime").agg(F.min(F.struct("score", "model")).alias("m")).select("regime", "m.model", "m.score")


def provenance(panel: DataFrame) -> DataFrame:
    """One row: distinct origins, horizons and models, first and last origin and target."""
    return panel.agg(F.countDistinct("origin").alias("n_origins"), F.countDistinct("horizon").alias("n_horizons"), F.countDistinct("model").alias("n_models"), F.min("origin").alias("first_origin"), F.max("origin").alias("last_origin"), F.min("target").alias("first_target"), F.max("target").alias("last_target"), F.count("*").alias("n"))


def errors(panel: DataFrame) -> DataFrame:
    """Mean absolute, root mean square, symmetric percentage and scaled errors by model and regime."""
    return panel.groupBy("model", "regime").agg(F.avg("ae").alias("mae"), F.sqrt(F.avg("se")).alias("rmse"), F.avg("smape").alias("smape"), F.avg("mase").alias("mase"))


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank among the rows of ``by``, ties sharing their mean rank."""
    least = F.rank().over(Window.partitionBy(*by).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return least + (ties - 1) / 2


def rank_correlation(table: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """(by, n, rho): Spearman's correlation over rows that have both scores; null for fewer than three or constant scores."""
    both = table.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.select(*by, average_rank(a, by).alias("ra"), average_rank(b, by).alias("rb"))
    rho = F.when((F.count("*") >= 3) & (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0), F.round(F.corr("ra", "rb"), 12))  # so that rounding does not decide the sign of a zero
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("rho"))


def p_value(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by Student's t with n - 2 degrees of freedom, by Simpson's rule."""
    import math

    if n < 3 or abs(rho) >= 1:
        return 0.0 if abs(rho) >= 1 else math.nan
    v = n - 2
    t = abs(rho) * math.sqrt(v / (1 - rho * rho))
    norm = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
    # the density over 0..t, with t = sqrt(v) tan(x)
    steps, to = 2000, math.atan(t / math.sqrt(v))
    f = [math.cos(to * i / steps) ** (v - 1) for i in range(steps + 1)]
    inside = norm * math.sqrt(v) * to / steps / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
    return max(0.0, 1 - 2 * inside)


def rank_moves(per_arm: DataFrame, baseline: str) -> DataFrame:
    """(arm, model, regime rank in the baseline and in the arm) where the two differ."""
    base = per_arm.where(F.col("arm") == baseline).select("model", F.col("clean_rank").alias("base_clean"), F.col("shock_rank").alias("base_shock"))
    moved = (F.col("clean_rank") != F.col("base_clean")) | (F.col("shock_rank") != F.col("base_shock"))
    return per_arm.where(F.col("arm") != baseline).join(base, "model").where(moved).select("arm", "model", "base_clean", "clean_rank", "base_shock", "shock_rank")


def ablations(table: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """For each (name, treatment, control): scores of both and treatment less control, in each regime."""
    spark = table.sparkSession
    p = F.broadcast(spark.createDataFrame(list(pairs), "ablation string, treatment string, control string"))
    t = table.select(F.col("model").alias("treatment"), *[F.col(r).alias(f"with_{r}") for r in REGIMES])
    c = table.select(F.col("model").alias("control"), *[F.col(r).alias(f"without_{r}") for r in REGIMES])
    deltas = [(F.col(f"with_{r}") - F.col(f"without_{r}")).alias(f"delta_{r}") for r in REGIMES]
    return p.join(t, "treatment").join(c, "control").select("ablation", "treatment", "control", *[f"{x}_{r}" for r in REGIMES for x in ("with", "without")], *deltas)


def winners(board: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each group's best model in either regime, with its rank in the other one; ties go to the name that sorts first.

    ``board``: ``per_regime`` of the same ``by``. A group without scores in a regime has nulls there.
    """
    def first(regime: str, other: str) -> list[Column]:
        m = F.min(F.when(F.col(regime).isNotNull(), F.struct(regime, "model", f"{other}_rank")))
        return [m["model"].alias(f"best_{regime}"), m[f"{other}_rank"].alias(f"best_{regime}_{other}_rank")]

    return board.groupBy(*by).agg(*first("clean", "shock"), *first("shock", "clean"), F.count("*").alias("n_models"))


def movement(per_arm: DataFrame, baseline: str) -> DataFrame:
    """(model, regime, n_arms, base_rank, least_rank, most_rank, holds_first): how a rank moves over the arms.

    ``holds_first``: first in the baseline and in every other arm.
    """
    long = per_arm.select("arm", "model", F.explode(F.array(*[F.struct(F.lit(r).alias("regime"), F.col(f"{r}_rank").alias("rank")) for r in REGIMES])).alias("r")).select("arm", "model", "r.regime", "r.rank").where("rank is not null")
    return long.groupBy("model", "regime").agg(F.count("*").alias("n_arms"), F.max(F.when(F.col("arm") == baseline, F.col("rank"))).alias("base_rank"), F.min("rank").alias("least_rank"), F.max("rank").alias("most_rank"), F.bool_and(F.col("rank") == 1).alias("holds_first"))


def headline(board: DataFrame, shares: DataFrame, challengers: int = 3) -> DataFrame:
    """(model, opponent, regime, p_beats): the comparisons that a report leads with.

    The best model of shock months meets the ``challengers`` best others of clean months, in shock months; the best of
    clean months meets it in clean months. ``board`` is a row a model, ``shares`` are the bootstrap's win shares.
    """
    lead = F.broadcast(winners(board).select("best_clean", "best_shock"))  # one row
    near = board.where("clean is not null").join(lead, F.col("model") != F.col("best_shock")).orderBy("clean", "model").limit(challengers)
    wanted = near.select(F.col("best_shock").alias("model"), F.col("model").alias("opponent"), F.lit("shock").alias("regime"))
    wanted = wanted.unionByName(lead.where("best_clean <> best_shock").select(F.col("best_clean").alias("model"), F.col("best_shock").alias("opponent"), F.lit("clean").alias("regime")))
    return wanted.join(shares, ["model", "opponent", "regime"]).select("model", "opponent", "regime", "p_beats")
