"""Monthly series from fact tables, and the contract that they must meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ContractViolation, MissingInput

SHOWN = 24


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_counts(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key string, value long, source_id) from a CSV file with exactly these columns; whatever is not a count raises."""
    try:
        raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    except Exception as e:
        raise MissingInput(f"{path}: {e}") from e
    expected = {key, value, "source_id"}
    if set(raw.columns) != expected:
        raise ContractViolation(f"{path}: columns are {sorted(raw.columns)}, not {sorted(expected)}")
    number = F.expr(f"try_cast(`{value}` AS DOUBLE)")
    rules = {"is missing": F.col(value).isNull(), "is not a number": number.isNull(), "is not a whole number": number % 1 != 0, "is negative": number < 0}
    reason = F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules.items()])
    bad = raw.select(key, reason.alias("reason")).where("reason is not null").orderBy(key).limit(SHOWN).collect()
    if bad:
        raise ContractViolation(f"{path}: " + "; ".join(f"{r[0]} {r.reason}" for r in bad))
    return raw.select(F.col(key), number.cast("long").alias(value), "source_id")


def monthly(fact: DataFrame, date_col: str, series: Column | None = None, value: Column | None = None) -> DataFrame:
    """(series_id, month, y): rows a month, or the sum of ``value``. Partial sums come before the one shuffle."""
    y = F.count("*") if value is None else F.sum(value)
    month = F.trunc(F.col(date_col).cast("date"), "month")
    return fact.where(F.col(date_col).isNotNull()).groupBy((F.lit("all") if series is None else series.cast("string")).alias("series_id"), month.alias("month")).agg(y.alias("y"))


def complete(series: DataFrame) -> DataFrame:
    """The series without each one's last month, which a running feed has not filled yet."""
    last = F.max("month").over(Window.partitionBy("series_id"))
    return series.withColumn("last", last).where("month < last").drop("last")


def spine(series: DataFrame) -> DataFrame:
    """(series_id, month): every month from each series' first to its last."""
    ends = series.groupBy("series_id").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    return ends.select("series_id", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


def gaps(series: DataFrame) -> DataFrame:
    """(series_id, month) of months that the spine has and the series lacks."""
    return spine(series).join(series.select("series_id", "month"), ["series_id", "month"], "left_anti")


def gap_summary(series: DataFrame) -> DataFrame:
    """Span, months present and missing, total, least and most of each series."""
    have = series.groupBy("series_id").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n_months"), F.sum("y").alias("total"), F.min("y").alias("least"), F.max("y").alias("most"))
    lacks = gaps(series).groupBy("series_id").agg(F.count("*").alias("n_missing"))
    return have.join(lacks, "series_id", "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)).cast("long"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(fact: DataFrame, fact_key: str, dimension: DataFrame, key: str) -> DataFrame:
    """Distinct fact keys that the dimension does not have."""
    return fact.select(F.col(fact_key).alias(key)).where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def reconciliation(series: DataFrame, annual: DataFrame) -> DataFrame:
    """For each published (series_id, year, total): months and sum found, and why they disagree (null if they agree).

    There is no tolerance. Years that are not published are not looked at.
    """
    found = series.groupBy("series_id", F.year("month").alias("year")).agg(F.count("*").alias("n_months"), F.sum("y").alias("found"))
    reason = F.when(F.col("n_months").isNull(), "no months").when(F.col("n_months") != 12, "not twelve months").when(F.col("found") != F.col("total"), "sum differs")
    return annual.join(found, ["series_id", "year"], "left").select("series_id", "year", "total", F.coalesce("n_months", F.lit(0)).cast("long").alias("n_months"), "found", reason.alias("reason"))


def check_series(series: DataFrame) -> DataFrame:
    """The series, if it has no duplicate, missing or negative months; otherwise an error that names the first offenders."""
    tests = {
        "duplicate months": duplicates(series, ["series_id", "month"]).select("series_id", "month"),
        "missing months": gaps(series),
        "missing or negative values": series.where("y is null or y < 0").select("series_id", "month"),
    }
    tagged = [df.withColumn("problem", F.lit(name)) for name, df in tests.items()]
    bad = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).orderBy("problem", "series_id", "month").limit(SHOWN).collect()
    if bad:
        raise ContractViolation("; ".join(f"{r.problem}: {r.series_id} {r.month}" for r in bad))
    return series


def check_reconciled(series: DataFrame, annual: DataFrame) -> None:
    bad = reconciliation(series, annual).where("reason is not null").orderBy("series_id", "year").limit(SHOWN).collect()
    if bad:
        raise ContractViolation("; ".join(f"{r.series_id} {r.year}: {r.reason} ({r.found} against {r.total})" for r in bad))


def check_references(fact: DataFrame, fact_key: str, dimension: DataFrame, key: str) -> None:
    bad = dangling(fact, fact_key, dimension, key).orderBy(key).limit(SHOWN).collect()
    if bad:
        raise ContractViolation(f"{fact_key} without a {key}: " + ", ".join(str(r[0]) for r in bad))


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_id, month, y, other) of months that two publications share and count differently."""
    return a.select("series_id", "month", "y").join(b.select("series_id", "month", F.col("y").alias("other")), ["series_id", "month"]).where(~F.col("y").eqNullSafe(F.col("other")))


def check_shared_months(a: DataFrame, b: DataFrame) -> None:
    bad = disagreements(a, b).orderBy("series_id", "month").limit(SHOWN).collect()
    if bad:
        raise ContractViolation("; ".join(f"{r.series_id} {r.month}: {r.y} against {r.other}" for r in bad))


def rounded_differences(annual: DataFrame, summary: DataFrame, tolerance: float = 0.01, unit: int = 100_000) -> DataFrame:
    """(year, total, lakh) of years whose exact total is not the rounded published one; exact decimals throughout."""
    off = F.abs(F.col("total").cast("decimal(20,0)") - F.col("lakh").cast("decimal(18,4)") * F.lit(unit))
    return annual.select("year", "total").join(summary.select("year", "lakh"), "year").where(off > F.lit(round(tolerance * unit)))


def check_rounded(annual: DataFrame, summary: DataFrame, most: int = 3) -> DataFrame:
    """The years that differ, if there are at most ``most``: a few are slips of the publisher, many a misread table."""
    found = rounded_differences(annual, summary)
    bad = found.orderBy("year").limit(SHOWN).collect()
    if len(bad) > most:
        raise ContractViolation("; ".join(f"{r.year}: {r.total} against {r.lakh} lakh" for r in bad))
    return found
