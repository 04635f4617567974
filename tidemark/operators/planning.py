"""Error bands and the planning table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.metrics import days_in_month, requirement
from .kernels import kernel_panel
from .leaderboard import best
from .panel import CLOSED_FORMS, PanelConfig, closed_forms, origins

LEAST = 5
BEST_CLEAN = "best_clean"
# What a ratio may be a share of, and the column that holds it.
BASES = {"monthly_total": "forecast", "daily_mean": "daily_mean", "festival_day_total": "festival_day_load"}


@dataclass(frozen=True)
class Ratio:
    """A resource: one for each ``per`` of the basis, at least ``minimum``."""

    id: str
    per: float
    basis: str
    minimum: int = 0

    def __post_init__(self) -> None:
        if self.basis not in BASES or not self.per > 0:
            raise ConfigError(f"{self.id}: basis {self.basis!r}, per {self.per}")


def error_bands(panel: DataFrame, confidence: float = 0.9, least: int = LEAST) -> DataFrame:
    """(model, horizon, regime, n, lo, middle, hi): quantiles of actual less predicted, in units of the scale.

    Groups of fewer than ``least`` forecasts have no band.
    """
    tail = (1 - confidence) / 2
    e = (F.col("actual") - F.col("predicted")) / F.col("mase_scale")
    quantiles = {"lo": tail, "middle": 0.5, "hi": 1 - tail}
    return panel.groupBy("model", "horizon", "regime").agg(F.count("*").alias("n"), *[F.percentile(e, F.lit(q)).alias(k) for k, q in quantiles.items()]).where(F.col("n") >= least)


def choose_model(panel: DataFrame, declared: str = BEST_CLEAN) -> str:
    """The declared forecaster, which has to be in the panel, or the one of least mean scaled error in clean months."""
    if declared != BEST_CLEAN:
        if panel.where(F.col("model") == declared).isEmpty():
            raise ConfigError(f"the panel has no forecasts of {declared}, so its errors are not known")
        return declared
    found = best(panel).where("regime = 'clean'").first()
    if found is None:
        raise ConfigError("the panel has no clean months to choose by")
    return found.model


def forward(series: DataFrame, config: PanelConfig = PanelConfig(), model: str = "seasonal_naive", calendar: DataFrame | None = None, features: Sequence[str] = ()) -> DataFrame:
    """(series_id, month, horizon, forecast, scale): forecasts past each series' end, from its last month.

    A forecaster that cannot be fitted raises; no other one takes its place.
    """
    if model in CLOSED_FORMS:
        made = closed_forms(origins(series, config, last=True), config, [model]).withColumn("reason", F.lit("no past month to repeat"))
    else:
        made = kernel_panel(series, config, [model], calendar, features, last=True)
    reason = F.concat(F.lit(f"{model}: "), F.coalesce("reason", F.lit("no forecast")))
    forecast = F.when(F.col("predicted").isNotNull(), F.col("predicted")).otherwise(F.raise_error(reason).cast("double"))
    return made.select("series_id", F.col("target").alias("month"), "horizon", forecast.alias("forecast"), F.col("mase_scale").alias("scale"))


def planning_table(forecast: DataFrame, bands: DataFrame, model: str, ratio_per: float | None = None, minimum: int = 0) -> DataFrame:
    """Each month's forecast with its clean and shock bands, not below 0, its daily mean and, with ``ratio_per``, its need.

    A horizon without a band has nulls; the forecast itself is never changed.
    """
    wide = bands.where(F.col("model") == model).groupBy("horizon").pivot("regime", ["clean", "shock"]).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))

    def edge(name: str):
        return F.when(F.col(name).isNotNull(), F.greatest(F.lit(0.0), F.col("forecast") + F.col(name) * F.col("scale")))

    days = days_in_month(F.col("month"))
    out = forecast.join(wide, "horizon", "left").select("series_id", "month", "horizon", "forecast", edge("clean_lo").alias("lo"), edge("clean_hi").alias("hi"), edge("shock_lo").alias("shock_lo"), edge("shock_hi").alias("shock_hi"), days.alias("days_in_month"), (F.col("forecast") / days).alias("daily_mean"))
    return out if ratio_per is None else out.withColumn("need", F.greatest(F.lit(minimum).cast("long"), F.ceil(F.col("forecast") / ratio_per)))


def with_festivals(plan: DataFrame, days: DataFrame) -> DataFrame:
    """The plan with its months' festival days, their dates and names, and the load that they would carry as average days.

    ``days``: (date, festival_id), a row for each festival's day; they are summed to a row a month before they meet the plan.
    """
    per = days.groupBy(F.trunc("date", "month").alias("month")).agg(F.count("*").alias("festival_days"), F.concat_ws("; ", F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd")))).alias("festival_dates"), F.concat_ws("; ", F.array_sort(F.collect_set("festival_id"))).alias("festivals"))
    out = plan.join(per, "month", "left").fillna(0, ["festival_days"]).fillna("", ["festival_dates", "festivals"])
    return out.withColumn("festival_day_load", F.col("daily_mean") * F.col("festival_days"))


def with_needs(plan: DataFrame, ratios: Sequence[Ratio]) -> DataFrame:
    """The plan with a column need_<id> for each resource."""
    return plan.withColumns({f"need_{r.id}": requirement(F.col(BASES[r.basis]), r.per, r.minimum).cast("long") for r in ratios})
