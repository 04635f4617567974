"""Bringing foreign tables into the contract: profile, declared formats and units, all-or-nothing writing."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, ContractViolation, MissingInput
from ..functions.metrics import UNITS, scale_unit

# Strftime directives in Spark's date patterns.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%b": "MMM", "%B": "MMMM", "%d": "dd"}


@dataclass(frozen=True)
class TableSpec:
    month_column: str
    count_column: str
    month_format: str
    unit: str = "absolute"
    source_id: str = ""

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ConfigError(f"unknown unit {self.unit!r}; known are {', '.join(UNITS)}")
        if not self.month_format:
            raise ConfigError("month_format has to be declared")
        if "CHANGE ME" in f"{self.source_id}{self.month_column}{self.count_column}":
            raise ConfigError("a placeholder has not been filled in")


def spark_format(pattern: str) -> str:
    unknown = set(re.findall("%.", pattern)) - set(STRFTIME)
    if unknown:
        raise ConfigError(f"unsupported in a month format: {', '.join(sorted(unknown))}")
    return re.sub("%.", lambda m: STRFTIME[m[0]], pattern)


def slug(text: str) -> str:
    return re.sub("[^a-z0-9]+", "_", text.lower()).strip("_")


def profile(df: DataFrame) -> DataFrame:
    """(column, n, n_distinct, least, most) of each column, values as text; one pass over the table."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.countDistinct(c).alias("n_distinct"), F.min(F.col(c).cast("string")).alias("least"), F.max(F.col(c).cast("string")).alias("most")) for c in df.columns]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def read_any(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A CSV, Parquet or Excel table with every column as text; Excel files need pandas' reader to be installed."""
    kind = path.rsplit(".", 1)[-1].lower()
    try:
        if kind in ("xlsx", "xls", "xlsm"):
            import pandas as pd

            table = pd.read_excel(path, sheet_name=sheet or 0, dtype=str)
            return spark.createDataFrame(table.astype(object).where(table.notna(), None), ", ".join(f"`{c}` string" for c in table.columns))
        raw = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)
    except ImportError as e:
        raise ConfigError(f"{path}: {e}; export the sheet as CSV instead") from e
    except Exception as e:
        raise MissingInput(f"{path}: {e}") from e
    return raw.select([F.col(f"`{c}`").cast("string").alias(c) for c in raw.columns])


def guess(columns: Sequence[str], needles: Sequence[str]) -> str | None:
    """The first column, by order of the needles, whose name holds one."""
    return next((c for n in needles for c in columns if n in c.strip().lower()), None)


def inspect(df: DataFrame, samples: int = 3) -> str:
    """Columns with a few of their values, and a settings file to be edited; guessed names are never used unread."""
    head = df.limit(100).collect()
    lines = [f"{c}: {', '.join(str(r[c]) for r in [r for r in head if r[c] is not None][:samples]) or '(empty)'}" for c in df.columns]
    month = guess(df.columns, ("month", "date", "period")) or "CHANGE ME"
    count = guess(df.columns, ("pilgrim", "visitor", "count", "total")) or "CHANGE ME"
    lines += ["", "source: {id: CHANGE ME, publisher: CHANGE ME, title: CHANGE ME, accessed: CHANGE ME}", f"monthly: {{path: CHANGE ME, unit: CHANGE ME, month_format: CHANGE ME, columns: {{month: {month}, pilgrims: {count}}}}}", "annual: {path: CHANGE ME, unit: CHANGE ME, columns: {year: CHANGE ME, pilgrims: CHANGE ME}}"]
    return "\n".join(lines) + "\n"


def build(raw: DataFrame, spec: TableSpec) -> DataFrame:
    """(series_id, month, y, source_id); values that break the declared format or unit, and repeated months, raise."""
    text, value = F.col(spec.month_column).cast("string"), F.col(spec.count_column).cast("string")
    month = F.trunc(F.try_to_timestamp(text, F.lit(spark_format(spec.month_format))).cast("date"), "month")
    out = raw.select(text.alias("raw_month"), value.alias("raw_value"), month.alias("month"), scale_unit(value, spec.unit).alias("y"))
    bad = out.where("month is null or y is null").limit(5).collect()
    if bad:
        raise ContractViolation("; ".join(f"{r.raw_month!r}: {r.raw_value!r}" for r in bad))
    twice = out.groupBy("month").count().where("count > 1").orderBy("month").limit(5).collect()
    if twice:
        raise ContractViolation("repeated months: " + ", ".join(str(r.month) for r in twice))
    return out.select(F.lit("all").alias("series_id"), "month", "y", F.lit(spec.source_id).alias("source_id"))


def write(df: DataFrame, path: str) -> None:
    """Writes the table where nothing is yet."""
    df.write.mode("errorifexists").parquet(path)
