"""The engine's standard flow over the driver's tables: monthly lineitem counts to a scored, labelled panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import panel as pn
from ..sources import series as sr
from ..sources import windows as wd

CONFIG = pn.PanelConfig(min_train=24, horizons=(1, 2, 3))
MODELS = ("naive", "seasonal_naive", "drift", "level_shift")
# Windows invented for these tables.
DECLARED = (wd.ShockWindow("first", dt.date(1998, 1, 1), dt.date(1998, 6, 1)), wd.ShockWindow("second", dt.date(2000, 3, 1), dt.date(2000, 5, 1)))
REFINED = (wd.ShockWindow("first", dt.date(1998, 1, 1), dt.date(1998, 4, 1)), wd.ShockWindow("second", dt.date(2000, 3, 1), dt.date(2000, 8, 1)))


def lineitem_series(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    fact = sr.read_table(spark, sf_dir, "lineitem")
    return sr.complete(sr.monthly(fact, "l_shipdate", F.col(by) if by else None))


def panel(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    at = pn.origins(lineitem_series(spark, sf_dir, by), CONFIG)
    return pn.score(pn.closed_forms(at, CONFIG, MODELS))


def labelled(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    return wd.label(panel(spark, sf_dir, by), wd.window_table(spark, DECLARED))
