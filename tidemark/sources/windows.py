"""Declared shock windows: intervals of months with their sources, and labels by target month."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConfigError, ContractViolation, MissingCitation, MissingInput


@dataclass(frozen=True)
class ShockWindow:
    """Months ``start`` to ``end``, both included."""

    id: str
    start: dt.date
    end: dt.date
    label: str = ""
    rationale: str = ""
    verified: bool = False

    @property
    def n_months(self) -> int:
        return 12 * (self.end.year - self.start.year) + self.end.month - self.start.month + 1


def _month(value: object, where: str) -> dt.date:
    """A month from YYYY-MM, or from a date, of which the day is left out."""
    try:
        return dt.date.fromisoformat(f"{value}-01" if len(str(value)) == 7 else str(value)[:10] if isinstance(value, dt.datetime) else str(value)).replace(day=1)
    except ValueError:
        raise ConfigError(f"{where}: {value!r} is not a month as YYYY-MM") from None


def load_windows(path: str) -> list[ShockWindow]:
    """Windows of a YAML file: each has an id, a start not after its end, a rationale and a full citation."""
    if not Path(path).exists():
        raise MissingInput(path)
    entries = (yaml.safe_load(Path(path).read_text()) or {}).get("windows") or []
    if not entries:
        raise ConfigError(f"{path}: no windows")
    out = []
    for i, x in enumerate(entries):
        name = x.get("id") or ""
        if not name:
            raise ConfigError(f"{path}: window {i} has no id")
        source = x.get("source") or {}
        blank = [k for k in ("publisher", "title", "url", "accessed") if not str(source.get(k) or "").strip()]
        if blank or not str(x.get("rationale") or "").strip():
            raise MissingCitation(f"{name}: {', '.join(blank) or 'rationale'} is blank")
        w = ShockWindow(name, _month(x.get("start"), name), _month(x.get("end"), name), x.get("label", ""), x["rationale"], bool(x.get("verified")))
        if w.end < w.start:
            raise ConfigError(f"{name}: ends before it starts")
        out.append(w)
    return out


def fingerprint(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:12]


def window_table(spark: SparkSession, windows: Sequence[ShockWindow], arm: str | None = None) -> DataFrame:
    """(id, start_month, end_month, verified), and the arm's name if one is given."""
    df = spark.createDataFrame([(w.id, w.start, w.end, w.verified) for w in windows], "id string, start_month date, end_month date, verified boolean")
    return df if arm is None else df.withColumn("arm", F.lit(arm))


def overlaps(windows: DataFrame) -> DataFrame:
    """(id, next_id) of windows that the next one by start runs into; windows that touch do not."""
    w = Window.orderBy("start_month", "id")  # a declared table of a few rows
    follow = windows.select("id", "end_month", F.lead("id").over(w).alias("next_id"), F.lead("start_month").over(w).alias("next_start"))
    return follow.where("next_start <= end_month").select("id", "next_id")


def unverified(windows: DataFrame) -> DataFrame:
    """One row: n windows, how many have a citation that nobody has checked yet, and their names."""
    pending = ~F.coalesce("verified", F.lit(False))
    return windows.agg(F.count("*").alias("n"), F.count_if(pending).alias("n_unverified"), F.concat_ws(", ", F.array_sort(F.collect_list(F.when(pending, F.col("id"))))).alias("names"))


def check_disjoint(windows: DataFrame) -> DataFrame:
    bad = overlaps(windows).collect()
    if bad:
        raise ContractViolation("; ".join(f"{r.id} overlaps {r.next_id}" for r in bad))
    return windows


def month_labels(windows: DataFrame) -> DataFrame:
    """(target, shock_window), and arm if there: a row for each month of a window, so that labelling is an equi-join."""
    extra = [c for c in ("arm",) if c in windows.columns]
    return windows.select(*extra, F.explode(F.expr("sequence(start_month, end_month, interval 1 month)")).alias("target"), F.col("id").alias("shock_window"))


def label(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """The panel with shock_window (null outside) and regime, by its target month; earlier labels are replaced.

    Windows are declared by hand, a row each, so their months are small enough to broadcast.
    """
    bare = panel.drop("shock_window", "regime")
    return bare.join(F.broadcast(month_labels(windows)), "target", "left").withColumn("regime", F.when(F.col("shock_window").isNull(), "clean").otherwise("shock"))


def label_arms(panel: DataFrame, arms: DataFrame) -> DataFrame:
    """The panel labelled under every arm at once: an arm a copy, months joined by arm and target."""
    names = F.broadcast(arms.select("arm").distinct())
    months = F.broadcast(month_labels(arms))
    return panel.drop("shock_window", "regime").join(names).join(months, ["arm", "target"], "left").withColumn("regime", F.when(F.col("shock_window").isNull(), "clean").otherwise("shock"))
