"""A whole project, from files to the report, and what stops it."""

import math

import pytest

from tidemark.errors import ConfigError, ContractViolation, MissingInput
from tidemark.plans import stages

WINDOWS = "windows:\n- {id: w, start: 2004-03, end: %s, rationale: r, source: {publisher: p, title: t, url: u, accessed: a}}\n"
CALENDAR = "lunar_month_scheme: purnimanta\nrange: {start: 2000-01-01, end: 2006-12-31}\nfestivals:\n- {id: d, rule: {month: kartika, paksha: krishna, tithi: 30, observance: pradosha}, duration_days: 2}\n"


@pytest.fixture
def project(tmp_path):
    raw, configs = tmp_path / "data/raw", tmp_path / "experiments/configs"
    raw.mkdir(parents=True)
    configs.mkdir(parents=True)
    y = [round(1000 + 5 * t + 200 * math.sin(2 * math.pi * t / 12) + 37 * math.cos(t * t)) for t in range(72)]
    (raw / "monthly.csv").write_text("month,pilgrims,source_id\n" + "".join(f"{2000 + t // 12}-{t % 12 + 1:02d},{v},s\n" for t, v in enumerate(y)))
    (raw / "annual.csv").write_text("year,pilgrims,source_id\n" + "".join(f"{2000 + i},{sum(y[12 * i : 12 * i + 12])},s\n" for i in range(6)))
    (raw / "sources.yaml").write_text("s: {publisher: p, title: t, accessed: a}\n")
    (configs / "shocks.yaml").write_text(WINDOWS % "2004-08")
    (configs / "other.yaml").write_text(WINDOWS % "2004-11")
    (configs / "calendar.yaml").write_text(CALENDAR)
    (configs / "backtest.yaml").write_text("origins: {min_train_months: 40, step_months: 2}\nhorizons: [1, 2]\nmodels: [naive, seasonal_naive, drift, theta]\nseed: 3\nbootstrap: {n_resamples: 100, block_origins: 4}\nsensitivity: {arms: [{name: other, shocks: experiments/configs/other.yaml}]}\n")
    (configs / "operations.yaml").write_text("model: best_clean\nhorizons: [1, 2]\nplanning: {ratios: [{id: beds, per_pilgrims: 10, basis: daily_mean}]}\n")
    (tmp_path / "README.md").write_text("top\n<!-- BEGIN RESULTS -->\n<!-- END RESULTS -->\n")
    return tmp_path


def test_all_stages(spark, project):
    stages.run(spark, str(project), ["validate", "calendar", "backtest", "bootstrap", "sensitivity", "report", "operations"])
    p = stages.Project(str(project))
    metrics = p.read(spark, "metrics")
    assert metrics.groupBy("model").count().select("count").distinct().count() == 1 and metrics.select("model").distinct().count() == 4
    text = (project / "README.md").read_text()
    assert text.startswith("top") and all(x in text for x in ("Leaderboard", "Comparisons", "Window boundaries", "not verified: w"))
    plan = p.read(spark, "operations").orderBy("horizon").collect()
    assert [str(r.month) for r in plan] == ["2006-01-01", "2006-02-01"] and all(r.need_beds == math.ceil(r.daily_mean / 10) and r.lo <= r.hi for r in plan)
    assert "2006-01" in (project / "results/briefing.md").read_text()
    before = metrics.where("regime = 'shock'").count()
    (project / "experiments/configs/shocks.yaml").write_text(WINDOWS % "2004-11")
    with pytest.raises(ContractViolation, match="label"):
        stages.run(spark, str(project), ["report"])
    stages.run(spark, str(project), ["relabel"])
    assert p.read(spark, "metrics").where("regime = 'shock'").count() > before


def test_what_stops_a_project(spark, project):
    with pytest.raises(MissingInput):
        stages.run(spark, str(project), ["bootstrap"])
    with pytest.raises(ConfigError):
        stages.run(spark, str(project), ["nothing"])
    annual = project / "data/raw/annual.csv"
    good = annual.read_text()
    annual.write_text(good.replace("2003,", "2003,1"))
    with pytest.raises(ContractViolation, match="2003"):
        stages.run(spark, str(project), ["validate"])
    annual.write_text(good.replace(",s", ",unknown"))
    with pytest.raises(ContractViolation, match="unknown"):
        stages.run(spark, str(project), ["validate"])
    annual.unlink()
    (project / "data/raw/sources.yaml").unlink()
    with pytest.raises(MissingInput, match="annual.csv.*sources.yaml"):
        stages.run(spark, str(project), ["validate"])


def test_ingest(spark, project):
    raw = project / "data/raw"
    for name in ("monthly", "annual"):
        (raw / f"{name}.csv").rename(project / f"{name}.csv")
    (raw / "sources.yaml").unlink()
    (project / "experiments/configs/ingest.yaml").write_text("source: {id: s, publisher: p, title: t, accessed: a}\nmonthly: {path: monthly.csv, unit: absolute, month_format: '%Y-%m', columns: {month: month, pilgrims: pilgrims}}\nannual: {path: annual.csv, unit: absolute, columns: {year: year, pilgrims: pilgrims}}\n")
    stages.run(spark, str(project), ["ingest", "validate"])
    with pytest.raises(ContractViolation, match="already"):
        stages.run(spark, str(project), ["ingest"])
