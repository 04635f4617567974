"""Rolling-origin panels: origins, horizons, closed-form forecasts, shared error scale and scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, RaggedPanel
from ..functions.metrics import absolute_error, scaled, smape, squared_error


@dataclass(frozen=True)
class PanelConfig:
    min_train: int = 24
    horizons: tuple[int, ...] = (1, 2, 3)
    step: int = 1
    season: int = 12

    def __post_init__(self) -> None:
        if not self.horizons or any(not isinstance(h, int) or h < 1 for h in self.horizons):
            raise ConfigError(f"horizons must be positive whole numbers: {self.horizons}")


def middle(values: Column) -> Column:
    """The median of an array; null for an empty one. Spark's own median takes no window frame."""
    v, n = F.array_sort(values), F.size(values)
    return (F.try_element_at(v, F.ceil((n + 1) / 2).cast("int")) + F.try_element_at(v, F.floor((n + 1) / 2).cast("int"))) / 2


def origins(series: DataFrame, config: PanelConfig = PanelConfig(), last: bool = False) -> DataFrame:
    """One row for each origin that can be scored at every horizon, with what closed forms need of its past.

    All columns come from one window over each series, so the panel costs a single shuffle by series_id. ``scale`` is
    the mean absolute seasonal difference of the training months; every forecaster of an origin is measured by it. With
    ``last``, each series' last month is its one origin, whatever it is too early to score.
    """
    w = Window.partitionBy("series_id").orderBy("month")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    m = config.season
    far = max(config.horizons)
    y = F.col("y").cast("double")
    cols = series.select("series_id", F.col("month").alias("origin"), F.col("y").cast("double").alias("y"), F.row_number().over(w).alias("pos"), F.count("*").over(Window.partitionBy("series_id")).alias("n"), F.abs(F.col("y") - F.lag("y", m).over(w)).cast("double").alias("step"), F.first(y).over(past).alias("first_y"), F.array(*[F.lead(y, h).over(w) for h in config.horizons]).alias("actuals"), F.array(*[F.lag(y, i).over(w) for i in range(m)]).alias("last_season"), middle(F.collect_list(y).over(w.rowsBetween(-5, 0))).alias("recent"), middle(F.collect_list(y).over(w.rowsBetween(-m - 5, -m))).alias("year_before"))
    scorable = (F.col("pos") <= F.col("n") - far) & ((F.col("pos") - config.min_train) % config.step == 0)
    keep = (F.col("pos") >= config.min_train) & ((F.col("pos") == F.col("n")) if last else scorable)
    return cols.withColumn("scale", F.avg("step").over(Window.partitionBy("series_id").orderBy("origin").rowsBetween(Window.unboundedPreceding, 0))).where(keep).drop("step")


CLOSED_FORMS = ("naive", "seasonal_naive", "drift", "level_shift")


def closed_forms(at: DataFrame, config: PanelConfig, models: Sequence[str]) -> DataFrame:
    """(series_id, origin, target, horizon, model, actual, predicted, mase_scale) for forecasters that have a formula."""

    def forecast(model: str, i: int, h: int):
        same_month = F.element_at("last_season", config.season - (h - 1) % config.season)
        return {
            "naive": F.col("y"),
            "seasonal_naive": same_month,
            "drift": F.col("y") + F.lit(h) * (F.col("y") - F.col("first_y")) / (F.col("pos") - 1),
            "level_shift": same_month + F.col("recent") - F.col("year_before"),
        }[model]

    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(m).alias("model"), F.element_at("actuals", i + 1).alias("actual"), forecast(m, i, h).cast("double").alias("predicted")) for i, h in enumerate(config.horizons) for m in models]
    out = at.select("series_id", "origin", F.col("scale").alias("mase_scale"), F.explode(F.array(*cells)).alias("c"))
    return out.select("series_id", "origin", F.add_months("origin", F.col("c.horizon")).alias("target"), "c.horizon", "c.model", "c.actual", "c.predicted", "mase_scale")


def score(panel: DataFrame) -> DataFrame:
    """The panel with ae, se, smape and mase."""
    a, p = F.col("actual"), F.col("predicted")
    return panel.withColumns({"ae": absolute_error(a, p), "se": squared_error(a, p), "smape": smape(a, p)}).withColumn("mase", scaled(F.col("ae"), F.col("mase_scale")))


def ragged(panel: DataFrame) -> DataFrame:
    """(model, n, missing): models whose cells are not those of the whole panel, with how many they lack."""
    cells = panel.select("series_id", "origin", "horizon").distinct()
    need = cells.agg(F.count("*").alias("cells"))
    have = panel.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("series_id", "origin", "horizon").alias("distinct_cells"))
    return have.join(F.broadcast(need)).where("n <> cells or distinct_cells <> cells").select("model", "n", (F.col("cells") - F.col("distinct_cells")).alias("missing"))


def check_rectangular(panel: DataFrame) -> DataFrame:
    bad = ragged(panel).orderBy("model").collect()
    if bad:
        raise RaggedPanel("; ".join(f"{r.model} has {r.n} cells and lacks {r.missing}" for r in bad))
    return panel


def union(panels: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, panels)
