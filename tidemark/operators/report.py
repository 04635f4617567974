"""Text and figure data from results: small tables only, collected after they have been aggregated."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractViolation, MissingInput
from . import leaderboard as lb

MOST_ROWS = 2000


def markdown(df: DataFrame, order: Sequence[str], places: int = 3) -> str:
    """The table as Markdown. More than ``MOST_ROWS`` rows raise: a report shows aggregates."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ContractViolation(f"a report table has more than {MOST_ROWS} rows")

    def show(v: object) -> str:
        return "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)

    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(map(show, r))} |" for r in rows])


def check_one_config(panel: DataFrame, column: str = "config_hash") -> None:
    if panel.agg(F.countDistinct(column)).first()[0] > 1:
        raise ContractViolation(f"the panel mixes several values of {column}")


def check_labels_current(panel: DataFrame, stored: str, column: str = "shocks_hash") -> None:
    """The panel's label hash must be that of the window file."""
    if column not in panel.columns or {r[0] for r in panel.select(column).distinct().limit(2).collect()} != {stored}:
        raise ContractViolation("labels are not those of the window file; label the panel again")


def interval_verdict(lo: float | None, hi: float | None) -> str:
    if lo is None or hi is None:
        return "cannot be resampled"
    return "spans zero" if lo < 0 < hi else "lies below zero" if hi <= 0 else "lies above zero"


def render(panel: DataFrame, inversion: DataFrame | None = None, verdicts: DataFrame | None = None) -> str:
    """Sections on provenance, regimes, the leaderboard, horizons, inversion and ablations."""
    board = lb.per_regime(panel)
    parts = ["## Provenance", markdown(lb.provenance(panel), ["first_origin"]), "## Regimes", markdown(lb.counts(panel), ["regime", "shock_window"]), "## Leaderboard", markdown(board, ["clean", "model"]), "## By horizon", markdown(lb.per_regime(panel, by=["horizon"]), ["horizon", "clean", "model"])]
    first = {r.regime: r.model for r in lb.best(panel).collect()}
    if len(first) == 2:
        same = first["clean"] == first["shock"]
        parts.append(f"`{first['clean']}` is best in both regimes." if same else f"`{first['clean']}` is best in clean months, `{first['shock']}` in shock months.")
    if inversion is not None:
        r = inversion.first()
        parts += ["## Inversion", f"The ranking inverts in {100 * (r.p_inversion or 0):.1f}% of {r.n_usable} usable resamples; the interval of the rank correlation {interval_verdict(r.lo, r.hi)}."]
    if verdicts is not None:
        parts += ["## Ablations", markdown(verdicts, ["ablation", "regime"])]
    return "\n\n".join(parts) + "\n"


def splice(path: str, text: str, begin: str = "<!-- BEGIN RESULTS -->", end: str = "<!-- END RESULTS -->") -> None:
    """Replaces what stands between the markers; a file without both raises."""
    if not Path(path).exists():
        raise MissingInput(path)
    old = Path(path).read_text()
    if begin not in old or end not in old or old.index(begin) > old.index(end):
        raise ContractViolation(f"{path}: no block between {begin} and {end}")
    Path(path).write_text(old[: old.index(begin) + len(begin)] + "\n" + text + "\n" + old[old.index(end) :])


def people(value: float | None) -> str:
    """Large counts in lakh; a missing one is said to be missing, zero is a measurement."""
    return "not measurable" if value is None else f"{value / 1e5:.2f} lakh" if abs(value) >= 1e5 else f"{value:,.0f}"


def briefing(plan: DataFrame, model: str) -> str:
    """A line a month; a plan of more than ``MOST_ROWS`` rows is no briefing and raises."""
    lines = [f"# Planning briefing ({model})", ""]
    rows = plan.orderBy("series_id", "month").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ContractViolation(f"the plan has over {MOST_ROWS} rows")
    for r in rows:
        lines.append(f"- {r.month:%Y-%m}: {people(r.forecast)}, band {people(r.lo)} to {people(r.hi)}; in a shock {people(r.shock_lo)} to {people(r.shock_hi)}; {people(r.daily_mean)} a day")
    return "\n".join(lines) + "\n"


def horizon_profile(panel: DataFrame, metric: str = "mase") -> DataFrame:
    """The data of a profile plot: mean score by model, regime and horizon."""
    return panel.groupBy("model", "regime", "horizon").agg(F.avg(metric).alias("score"))


def forecast_and_actual(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """The data of a forecast plot: one actual a target, a column of predictions a model."""
    one = panel.where(F.col("horizon") == horizon)
    return one.select("series_id", "target", "actual", "model", "predicted", "regime")


def rank_pairs(panel: DataFrame) -> DataFrame:
    """The data of a slope plot and of a bar plot: each model's mean score and rank in both regimes."""
    return lb.per_regime(panel).select("model", "clean", "shock", "clean_rank", "shock_rank")


def series_and_windows(series: DataFrame, months: DataFrame) -> DataFrame:
    """The data of a series plot: each month's value and the window that shades it. ``months``: ``windows.month_labels``."""
    return series.join(F.broadcast(months.withColumnRenamed("target", "month")), "month", "left").select("series_id", "month", "y", "shock_window")


def write_metrics(panel: DataFrame, path: str) -> None:
    """Doubles at 12 significant digits, so that a run that changes nothing writes the same text."""
    kept = [F.format_string("%.12g", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in panel.dtypes]
    panel.select(kept).write.mode("errorifexists").option("header", True).csv(path)


# Columns of a panel's file that are not doubles.
TYPES = {"series_id": "string", "origin": "date", "target": "date", "horizon": "int", "model": "string", "shock_window": "string", "regime": "string", "reason": "string", "config_hash": "string", "shocks_hash": "string"}


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_metrics`` wrote, with its types; a path that is not there or has no columns raises."""
    try:
        raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    except Exception as e:
        raise MissingInput(f"{path}: {e}") from e
    if not raw.columns:
        raise MissingInput(f"{path}: nothing written there")
    return raw.select([F.col(c).cast(TYPES.get(c, "double")).alias(c) for c in raw.columns])


def write_calendar(days: DataFrame, path: str) -> None:
    """A calendar's rows as CSV, dates as YYYY-MM-DD."""
    kept = [F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in days.dtypes]
    days.select(kept).write.mode("errorifexists").option("header", True).csv(path)
