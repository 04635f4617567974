"""The stages of a project: observations and settings in, result tables, the report and the briefing out.

A project is a folder that driver and executors share: ``data/raw`` holds monthly.csv, annual.csv and sources.yaml,
``experiments/configs`` the settings, ``results`` what the stages write. Each stage reads what earlier ones wrote, so any
can be run again alone: ``python -m tidemark.plans.stages FOLDER STAGE...``, or ``all``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, ContractViolation, MissingInput
from ..operators import bootstrap as bs
from ..operators import kernels as kn
from ..operators import leaderboard as lb
from ..operators import lunisolar as ls
from ..operators import panel as pn
from ..operators import planning as pl
from ..operators import report
from ..sources import ingest
from ..sources import series as sr
from ..sources import windows as wd
from . import config as cf

FEATURES = ("festival_days", "lunar_drift_days")


class Project:
    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def raw(self, name: str) -> str:
        return str(self.root / "data/raw" / name)

    def config(self, name: str) -> str:
        return str(self.root / "experiments/configs" / name)

    def result(self, name: str) -> str:
        return str(self.root / "results" / name)

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        if not Path(self.result(name)).exists():
            raise MissingInput(f"{self.result(name)}: run the stage that writes it first")
        return spark.read.parquet(self.result(name))

    def write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.result(name))


def observations(spark: SparkSession, project: Project) -> DataFrame:
    """(series_id, month, y) of the project, once its files meet the contract and reconcile with the annual totals."""
    files = [project.raw(n) for n in ("monthly.csv", "annual.csv", "sources.yaml")]
    if missing := [f for f in files if not Path(f).exists()]:
        raise MissingInput(", ".join(missing))
    sources = yaml.safe_load(Path(files[2]).read_text()) or {}
    for name, about in sources.items() if isinstance(sources, dict) else [("file", None)]:
        if not isinstance(about, dict) or any(not about.get(k) for k in ("publisher", "title", "accessed")):
            raise ContractViolation(f"{files[2]}: {name} lacks a publisher, title or access date")
    known = spark.createDataFrame([(k,) for k in sources], "source_id string")
    monthly, annual = sr.read_counts(spark, files[0], "month", "pilgrims"), sr.read_counts(spark, files[1], "year", "pilgrims")
    for table in (monthly, annual):
        sr.check_references(table, "source_id", known, "source_id")
    month = F.try_to_timestamp(F.col("month"), F.lit("yyyy-MM")).cast("date")
    series = monthly.select(F.lit("all").alias("series_id"), month.alias("month"), F.col("pilgrims").alias("y"), F.col("month").alias("text"))
    if bad := series.where("month is null").limit(sr.SHOWN).collect():
        raise ContractViolation("not months: " + ", ".join(str(r.text) for r in bad))
    series = sr.check_series(series.drop("text"))
    sr.check_reconciled(series, annual.select(F.lit("all").alias("series_id"), F.col("year").cast("int").alias("year"), F.col("pilgrims").alias("total")))
    return series


def _windows(spark: SparkSession, project: Project, path: str = "shocks.yaml", arm: str | None = None) -> DataFrame:
    file = project.config(path) if "/" not in path else str(project.root / path)
    return wd.check_disjoint(wd.window_table(spark, wd.load_windows(file), arm))


def _calendar(spark: SparkSession, project: Project) -> DataFrame:
    file = project.config("calendar.yaml")
    return ls.features(spark, *cf.load_range(file), cf.load_festivals(file))


def _models(spark: SparkSession, project: Project, series: DataFrame, panel: pn.PanelConfig, models: tuple[str, ...]) -> DataFrame:
    """Forecasts of all the models in the shape of ``kernel_panel``."""
    fitted = [m for m in models if m in kn.KERNELS]
    out = []
    if closed := [m for m in models if m in pn.CLOSED_FORMS]:
        out.append(pn.closed_forms(pn.origins(series, panel), panel, closed).withColumn("reason", F.lit(None).cast("string")))
    if fitted:
        needs = set(fitted) & set(cf.NEEDS_CALENDAR)
        out.append(kn.kernel_panel(series, panel, fitted, *((_calendar(spark, project), FEATURES) if needs else ())))
    return pn.union(out)


def validate(spark: SparkSession, project: Project) -> None:
    report_on = wd.unverified(_windows(spark, project)).first()
    n = observations(spark, project).count()
    print(f"{n} months; {report_on.n} windows, unverified: {report_on.names or 'none'}")


def bring_in(spark: SparkSession, project: Project) -> None:
    """Foreign tables to data/raw; both are read and checked before anything is written, and nothing is overwritten."""
    files, source = cf.load_ingest(project.config("ingest.yaml"))
    made = {}
    for section, key in (("monthly", "month"), ("annual", "year")):
        f = files[section]
        table = ingest.build(ingest.read_any(spark, str(project.root / f.path), f.sheet), f.spec)
        form = "yyyy-MM" if key == "month" else "yyyy"
        made[section] = table.orderBy("month").select(F.date_format("month", form).alias(key), F.col("y").alias("pilgrims"), "source_id")
    if there := [n for n in ("monthly.csv", "annual.csv", "sources.yaml") if Path(project.raw(n)).exists()]:
        raise ContractViolation(f"already there: {', '.join(there)}")
    for k, table in made.items():  # a row a month: one file
        table.coalesce(1).write.mode("errorifexists").option("header", True).csv(project.raw(f"{k}.csv"))
    Path(project.raw("sources.yaml")).write_text(yaml.safe_dump({source.pop("id"): source}))


def calendar(spark: SparkSession, project: Project) -> None:
    file = project.config("calendar.yaml")
    project.write(_calendar(spark, project), "calendar")
    project.write(ls.occurrence_days(spark, *cf.load_range(file), cf.load_festivals(file)), "occurrences")


def backtest(spark: SparkSession, project: Project) -> None:
    """The scored panel; a forecaster that cannot be fitted somewhere stops the run."""
    c = cf.load_backtest(project.config("backtest.yaml"))
    project.write(_models(spark, project, observations(spark, project), c.panel, c.models), "forecasts")
    made = project.read(spark, "forecasts")
    if made.isEmpty():
        raise ContractViolation("the series is too short for one origin")
    if bad := made.where("predicted is null").orderBy("model", "origin").limit(5).collect():
        raise ContractViolation("; ".join(f"{r.model} at {r.origin}: {r.reason}" for r in bad))
    scored = pn.score(made.drop("reason"))
    project.write((pn.check_rectangular(scored) if c.rectangular else scored).withColumn("config_hash", F.lit(c.config_hash)), "panel")
    relabel(spark, project)


def relabel(spark: SparkSession, project: Project) -> None:
    labelled = wd.label(project.read(spark, "panel"), _windows(spark, project))
    project.write(labelled.withColumn("shocks_hash", F.lit(wd.fingerprint(project.config("shocks.yaml")))), "metrics")


def _metrics(spark: SparkSession, project: Project) -> DataFrame:
    panel = project.read(spark, "metrics")
    report.check_one_config(panel)
    report.check_labels_current(panel, wd.fingerprint(project.config("shocks.yaml")))
    return panel


def bootstrap(spark: SparkSession, project: Project) -> None:
    c = cf.load_backtest(project.config("backtest.yaml")).bootstrap
    project.write(bs.resample(_metrics(spark, project), c), "draws")
    draws = project.read(spark, "draws")
    parts = {"mean": bs.intervals(draws, c.confidence), "p_beats": bs.win_shares(draws).withColumnRenamed("p_beats", "point"), "p_inversion": bs.inversion(draws, c.confidence).withColumnRenamed("p_inversion", "point")}
    project.write(bs.assemble([p.select(F.lit(k).alias("statistic"), "*") for k, p in parts.items()]), "bootstrap")


def applicability(spark: SparkSession, project: Project) -> None:
    """Forecasters that the backtest leaves out, tried at every origin and the shortest horizon."""
    c = cf.load_backtest(project.config("backtest.yaml"))
    if models := [m for m in c.excluded if m in kn.KERNELS and (m not in cf.NEEDS_CALENDAR or Path(project.config("calendar.yaml")).exists())]:
        project.write(kn.applicability(_models(spark, project, observations(spark, project), c.panel, tuple(models))), "applicability")


def sensitivity(spark: SparkSession, project: Project) -> None:
    arms = cf.load_arms(project.config("backtest.yaml"), "shocks.yaml")
    table = pn.union([_windows(spark, project, path, name) for name, path in arms])
    board = lb.per_regime(wd.label_arms(project.read(spark, "panel"), table), by=["arm"])
    project.write(board, "sensitivity")
    if bad := project.read(spark, "sensitivity").groupBy("arm").agg(F.sum("shock_n").alias("n")).where("n = 0").collect():
        raise ContractViolation("no forecast falls into a shock window of " + ", ".join(r.arm for r in bad))


def write_report(spark: SparkSession, project: Project) -> None:
    panel = _metrics(spark, project)
    draws = project.read(spark, "draws")
    pairs = [a for a in cf.ABLATIONS if {a[1], a[2]} <= {r.model for r in panel.select("model").distinct().collect()}]
    shares = bs.win_shares(draws)
    verdicts = bs.verdicts(lb.ablations(lb.per_regime(panel), pairs), shares) if pairs else None
    text = report.render(panel, bs.inversion(draws), verdicts)
    text += "\n## Comparisons\n\n" + report.markdown(lb.headline(lb.per_regime(panel), shares), ["regime", "model", "opponent"])
    if Path(project.result("sensitivity")).exists():
        text += "\n\n## Window boundaries\n\n" + report.markdown(lb.movement(project.read(spark, "sensitivity"), "declared"), ["regime", "base_rank", "model"])
    if Path(project.result("applicability")).exists() and not (lost := kn.inapplicable(project.read(spark, "applicability"))).isEmpty():
        text += "\n\n## Models that cannot be fitted everywhere\n\n" + report.markdown(lost, ["model"])
    pending = wd.unverified(_windows(spark, project)).first()
    if pending.n_unverified:
        text += f"\n\n{pending.n_unverified} of {pending.n} windows have citations that are not verified: {pending.names}."
    report.splice(str(project.root / "README.md"), text)


def operations(spark: SparkSession, project: Project) -> None:
    """Forecasts past the end with bands, festival load and needs, as a table and as text."""
    o, b = cf.load_operations(project.config("operations.yaml")), cf.load_backtest(project.config("backtest.yaml"))
    panel, series = _metrics(spark, project), observations(spark, project)
    model = pl.choose_model(panel, o.model)
    more = (_calendar(spark, project), FEATURES) if model in cf.NEEDS_CALENDAR else ()
    ahead = pl.forward(series, pn.PanelConfig(b.panel.min_train, o.horizons, 1, b.panel.season), model, *more)
    plan = pl.planning_table(ahead, pl.error_bands(panel, o.confidence), model)
    days = project.read(spark, "occurrences") if Path(project.result("occurrences")).exists() else spark.createDataFrame([], "date date, festival_id string")
    project.write(pl.with_needs(pl.with_festivals(plan, days), o.ratios), "operations")
    Path(project.result("briefing.md")).write_text(report.briefing(project.read(spark, "operations"), model))


STAGES: dict[str, Callable[[SparkSession, Project], None]] = {
    "ingest": bring_in, "validate": validate, "calendar": calendar, "backtest": backtest, "relabel": relabel, "bootstrap": bootstrap,
    "applicability": applicability, "sensitivity": sensitivity, "report": write_report, "operations": operations,
}


def run(spark: SparkSession, root: str, names: list[str]) -> None:
    """The named stages in the order given; ``all`` is every stage but ingest, which changes the observations."""
    names = [s for n in names for s in ([k for k in STAGES if k != "ingest"] if n == "all" else [n])]
    if unknown := [n for n in names if n not in STAGES]:
        raise ConfigError(f"unknown stages {unknown}; known are {', '.join(STAGES)}")
    for n in names:
        STAGES[n](spark, Project(root))


if __name__ == "__main__":
    run(SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1], sys.argv[2:] or ["all"])
