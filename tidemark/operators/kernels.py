"""Forecasters that estimate parameters: NumPy kernels run side by side on Arrow batches, one row an origin.

Parameters minimise squared one-step errors by a deterministic search: a coarse grid, then ever smaller grids around
the best point. All points of a grid run through the recursion together, so a fit costs one pass over the months per
grid. One Holt-Winters fit per origin serves the forecast, the surprise scores and both switching rules.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, CoverageError
from .panel import PanelConfig, origins

M = 12
# Thresholds of the shock detector, in robust scale units, and its spans in months.
ENTER, ENTER_UP, EXIT, MIN_HISTORY, LEVEL_WINDOW = 2.5, 15.0, 1.0, 36, 6
DWELL = {"switching": 1, "switching_sticky": 6}


def search(loss: Callable[[np.ndarray], np.ndarray], lo: Sequence[float], hi: Sequence[float], points: int, rounds: int = 5) -> np.ndarray:
    """The best point of ``loss`` (of many points at once) in a box."""
    lo, hi = np.array(lo, float), np.array(hi, float)
    best, width = None, (hi - lo) / 2
    axes = [np.linspace(a, b, points) for a, b in zip(lo, hi, strict=True)]
    for _ in range(rounds):
        p = np.array(list(itertools.product(*axes)))
        if best is not None:
            p = np.vstack([best, p])
        values = loss(p)
        best = p[int(np.nanargmin(values))]
        width = width / 2.5
        axes = [np.clip([b - w, b, b + w], a, c) for a, b, c, w in zip(lo, best, hi, width, strict=True)]
    return best


def _smooth(y: np.ndarray, p: np.ndarray, multiplicative: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-step predictions (t, point) and final level, trend and seasons for each point (alpha, beta, gamma)."""
    a, b, g = p.T
    first, second = y[:M].mean(), y[M : 2 * M].mean()
    level, trend = np.full(len(p), first - (second - first) / M * (M - 1) / 2), np.full(len(p), (second - first) / M)
    line = level[0] + trend[0] * np.arange(M)
    season = np.repeat((y[:M] / np.maximum(line, 1e-9) if multiplicative else y[:M] - line)[:, None], len(p), 1)
    level = level - trend
    fitted = np.empty((len(y), len(p)))
    for t, x in enumerate(y):
        s, base = season[t % M], level + trend
        fitted[t] = base * s if multiplicative else base + s
        new = a * (x / s if multiplicative else x - s) + (1 - a) * base
        trend = b * (new - level) + (1 - b) * trend
        season[t % M] = g * (x / np.where(new == 0, 1e-9, new) if multiplicative else x - new) + (1 - g) * s
        level = new
    return fitted, level, trend, season


@dataclass
class Smoothing:
    fitted: np.ndarray
    level: float
    trend: float
    season: np.ndarray
    n: int
    multiplicative: bool

    @classmethod
    def fit(cls, y: np.ndarray, multiplicative: bool = False) -> Smoothing:
        if len(y) < 2 * M:
            raise ValueError(f"needs {2 * M} months, has {len(y)}")
        if multiplicative and (y <= 0).any():
            raise ValueError("multiplicative seasons need positive values")
        with np.errstate(all="ignore"):
            p = search(lambda q: ((_smooth(y, q, multiplicative)[0] - y[:, None]) ** 2).sum(0), (0.02, 0, 0), (0.98, 0.5, 0.9), 5)
            fitted, level, trend, season = _smooth(y, p[None], multiplicative)
        return cls(fitted[:, 0], level[0], trend[0], season[:, 0], len(y), multiplicative)

    def forecast(self, horizons: np.ndarray) -> np.ndarray:
        s = self.season[(self.n + horizons - 1) % M]
        base = self.level + horizons * self.trend
        return base * s if self.multiplicative else base + s


def theta(y: np.ndarray, horizons: np.ndarray) -> np.ndarray:
    """Seasons removed additively, then the mean of the trend line and exponential smoothing of twice the deviation."""
    kernel = np.r_[0.5, np.ones(M - 1), 0.5] / M
    trend = np.convolve(y, kernel, "valid")
    off = y[M // 2 : M // 2 + len(trend)] - trend
    season = np.array([off[(np.arange(len(off)) + M // 2) % M == i].mean() for i in range(M)])
    season -= season.mean()
    n = len(y)
    x = y - season[np.arange(n) % M]
    slope, start = np.polyfit(np.arange(n), x, 1)

    def level(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, sse = np.full(len(p), x[0]), np.zeros(len(p))
        for v in x[1:]:
            sse += (v - at) ** 2
            at = at + p[:, 0] * (v - at)
        return at, sse

    alpha = search(lambda p: level(p)[1], [0.01], [0.99], 25)
    a = alpha[0]
    drift = slope / 2 * (horizons - 1 + (1 - (1 - a) ** n) / a)
    return level(alpha[None])[0][0] + drift + season[(n + horizons - 1) % M]


def _residuals(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Conditional one-step errors (t, point) of the doubly differenced series."""
    f, q, F_, Q = p.T
    e = np.zeros((len(w) + M + 1, len(p)))
    x = np.concatenate([np.zeros(M + 1), w])
    for t in range(M + 1, len(x)):
        e[t] = x[t] - f * x[t - 1] - F_ * x[t - M] + f * F_ * x[t - M - 1] - q * e[t - 1] - Q * e[t - M] - q * Q * e[t - M - 1]
    return e[M + 1 :]


def sarima(y: np.ndarray, horizons: np.ndarray) -> np.ndarray:
    """(1,1,1)(1,1,1) with a season of 12 by conditional least squares."""
    if len(y) < 3 * M + 2:
        raise ValueError(f"needs {3 * M + 2} months, has {len(y)}")
    w = np.diff(y)
    w = w[M:] - w[:-M]
    scale = np.std(w) or 1.0
    w = w / scale
    p = search(lambda q: np.minimum((_residuals(w, q)[M:] ** 2).sum(0), 1e12), (-0.95,) * 4, (0.95,) * 4, 5)
    e = np.concatenate([np.zeros(M + 1), _residuals(w, p[None])[:, 0], np.zeros(max(horizons))])
    x = np.concatenate([np.zeros(M + 1), w])
    f, q, F_, Q = p
    path = list(y)
    for _ in range(max(horizons)):
        t = len(x)
        x = np.append(x, f * x[t - 1] + F_ * x[t - M] - f * F_ * x[t - M - 1] + q * e[t - 1] + Q * e[t - M] + q * Q * e[t - M - 1])
        path.append(path[-1] + path[-M] - path[-M - 1] + x[-1] * scale)
    return np.array(path)[len(y) - 1 + horizons]


def sarimax(y: np.ndarray, horizons: np.ndarray, past: np.ndarray, future: np.ndarray) -> np.ndarray:
    """``sarima`` of what a regression on calendar features, both doubly differenced, leaves over."""
    def double(a: np.ndarray) -> np.ndarray:
        d = np.diff(a, axis=0)
        return d[M:] - d[:-M]

    beta = np.linalg.lstsq(double(past), double(y), rcond=1e-9)[0]
    return sarima(y - past @ beta, horizons) + (future @ beta)[horizons - 1]


def surprises(y: np.ndarray, fit: Smoothing) -> np.ndarray:
    """One-step errors in robust scale units; all zero where their spread is lost in rounding."""
    r = y - fit.fitted
    centre = np.median(r)
    scale = 1.4826 * np.median(np.abs(r - centre))
    if not np.isfinite(scale) or scale <= 1e-4 * max(np.median(np.abs(y)), 1.0):
        return np.zeros_like(r)
    return (r - centre) / scale


def surprise_scores(series: DataFrame) -> DataFrame:
    """(series_id, month, score): ``surprises`` of an additive Holt-Winters fit to each whole series of two years or more."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("month")
        y = part["y"].to_numpy(float)
        if len(y) < 2 * M:
            return part.iloc[:0].rename(columns={"y": "score"}).astype({"score": float})
        return pd.DataFrame({"series_id": part["series_id"], "month": part["month"], "score": surprises(y, Smoothing.fit(y))})

    return series.select("series_id", "month", "y").groupBy("series_id").applyInPandas(run, "series_id string, month date, score double")


def in_shock(scores: np.ndarray, dwell: int) -> bool:
    """State after the last month: on below -ENTER or above ENTER_UP, off above -EXIT once ``dwell`` months have passed."""
    if len(scores) < MIN_HISTORY:
        return False
    since = None
    for t, s in enumerate(scores.tolist()):
        if since is None:
            since = t if s < -ENTER or s > ENTER_UP else None
        elif t - since >= dwell and s > -EXIT:
            since = None
    return since is not None


def level_shift(y: np.ndarray, horizons: np.ndarray) -> np.ndarray:
    return y[(horizons - 1) % M - M] + np.median(y[-LEVEL_WINDOW:]) - np.median(y[-LEVEL_WINDOW - M : -M])


KERNELS = ("theta", "holt_winters_add", "holt_winters_mul", "sarima", "sarimax_cal", "switching", "switching_sticky")


def forecasts(y: np.ndarray, horizons: np.ndarray, models: Sequence[str], past: np.ndarray | None = None, future: np.ndarray | None = None) -> Iterator[tuple[str, np.ndarray | None, str | None]]:
    """(model, predictions, None), or (model, None, reason) where a model cannot be fitted."""
    shared: list[Smoothing] = []

    def smoothing() -> Smoothing:
        shared or shared.append(Smoothing.fit(y))
        return shared[0]

    def switched(dwell: int) -> np.ndarray:
        fit = smoothing()
        return level_shift(y, horizons) if in_shock(surprises(y, fit), dwell) else fit.forecast(horizons)

    def with_calendar() -> np.ndarray:
        if past is None or future is None:
            raise CoverageError("sarimax_cal needs a calendar that covers training and forecast months")
        return sarimax(y, horizons, past, future)

    run = {"theta": lambda: theta(y, horizons), "holt_winters_add": lambda: smoothing().forecast(horizons), "holt_winters_mul": lambda: Smoothing.fit(y, True).forecast(horizons), "sarima": lambda: sarima(y, horizons), "sarimax_cal": with_calendar} | {k: (lambda d=d: switched(d)) for k, d in DWELL.items()}
    for m in models:
        try:
            out = run[m]()
            yield (m, out, None) if np.isfinite(out).all() else (m, None, "not finite")
        except (ValueError, np.linalg.LinAlgError, CoverageError) as e:
            yield m, None, str(e).splitlines()[0]


def kernel_panel(series: DataFrame, config: PanelConfig, models: Sequence[str], calendar: DataFrame | None = None, features: Sequence[str] = (), last: bool = False) -> DataFrame:
    """(series_id, origin, target, horizon, model, actual, predicted, mase_scale, reason) for fitted forecasters.

    Each origin is a row with its training months as an array and is dealt to tasks on its own, so many series and many
    origins spread alike. A model that cannot be fitted has null predictions and a reason. ``calendar``: (month, features),
    one row a month; a month that it lacks raises. With ``last``, forecasts leave from each series' last month only.
    """
    if unknown := set(models) - set(KERNELS):
        raise ConfigError(f"unknown forecasters: {', '.join(sorted(unknown))}")
    if "sarimax_cal" in models and calendar is None:
        raise CoverageError("sarimax_cal needs a calendar")
    far, h = max(config.horizons), np.array(config.horizons)
    w = Window.partitionBy("series_id").orderBy("month")
    train = series.select("series_id", F.col("month").alias("origin"), F.collect_list(F.col("y").cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("train"))
    at = origins(series, config, last).select("series_id", "origin", "actuals", "scale").join(train, ["series_id", "origin"])
    if calendar is not None:
        months = series.select("series_id", "month").unionByName(series.groupBy("series_id").agg(F.max("month").alias("m")).select("series_id", F.explode(F.expr(f"sequence(add_months(m, 1), add_months(m, {far}), interval 1 month)")).alias("month")))
        lacking = months.select("month").distinct().join(calendar.dropna(subset=list(features)), "month", "left_anti").orderBy("month").limit(24).collect()
        if lacking:
            raise CoverageError("the calendar lacks " + ", ".join(str(r.month) for r in lacking))
        x = months.join(F.broadcast(calendar.select("month", *features).join(months.select("month").distinct(), "month", "left_semi")), "month", "left").select("series_id", "month", F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
        wx = Window.partitionBy("series_id").orderBy("month")
        x = x.select("series_id", F.col("month").alias("origin"), F.collect_list("x").over(wx.rowsBetween(Window.unboundedPreceding, 0)).alias("past"), F.collect_list("x").over(wx.rowsBetween(1, far)).alias("future"))
        at = at.join(x, ["series_id", "origin"])
    with_features = calendar is not None
    schema = "series_id string, origin date, horizon int, model string, actual double, predicted double, mase_scale double, reason string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                past, future = (np.array(list(map(list, x)), float) for x in (r.past, r.future)) if with_features else (None, None)
                if past is not None and (np.isnan(past).any() or np.isnan(future).any()):
                    past = future = None
                for model, p, reason in forecasts(np.array(r.train, float), h, models, past, future):
                    out += [(r.series_id, r.origin, int(k), model, float(r.actuals[i]), None if p is None else float(p[i]), float(r.scale), reason) for i, k in enumerate(h)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    out = at.repartition("series_id", "origin").mapInPandas(run, schema)
    return out.withColumn("target", F.add_months("origin", F.col("horizon")))


def applicability(panel: DataFrame) -> DataFrame:
    """(model, origins, fittable, failed, first_failure, reason) of a kernel panel."""
    per = panel.groupBy("model", "series_id", "origin").agg(F.max("reason").alias("reason"))
    return per.groupBy("model").agg(F.count("*").alias("origins"), F.count_if(F.col("reason").isNull()).alias("fittable"), F.count("reason").alias("failed"), F.min(F.when(F.col("reason").isNotNull(), F.col("origin"))).alias("first_failure"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("origin"))).alias("reason"))


def inapplicable(status: DataFrame) -> DataFrame:
    """Rows of ``applicability`` whose model could not be fitted at every origin: an absence that a report has to show."""
    return status.where("failed > 0")


def detector(scores: DataFrame, dwell: int) -> DataFrame:
    """(series_id, in_shock) from rows (series_id, month, score): the detector as a fold over each ordered series."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("month", "score"))), lambda x: x["score"])
    start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("held"))

    def step(state, s):
        enter, held = (s < -ENTER) | (s > ENTER_UP), state["held"] + 1
        leave = (held >= dwell) & (s > -EXIT)
        return F.when(~state["on"], F.struct(enter.alias("on"), F.lit(0).alias("held"))).otherwise(F.struct((~leave).alias("on"), held.alias("held")))

    return scores.groupBy("series_id").agg(ordered.alias("s")).select("series_id", ((F.size("s") >= MIN_HISTORY) & F.aggregate("s", start, step)["on"]).alias("in_shock"))
