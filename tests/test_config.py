import pytest

from tidemark.errors import ConfigError, MissingInput
from tidemark.plans import config

GOOD = "origins: {min_train_months: 24, step_months: 2}\nseed: 7\nhorizons: [1, 2]\nmodels: [naive, theta]\nbootstrap: {n_resamples: 10, block_origins: 4, metric: mase}\n"


def test_backtest_file(tmp_path):
    p = tmp_path / "b.yaml"
    p.write_text(GOOD)
    c = config.load_backtest(str(p))
    assert c.panel.min_train == 24 and c.models == ("naive", "theta") and c.bootstrap.block == 4 and c.panel.step == 2 and c.bootstrap.seed == 7 and len(c.config_hash) == 12
    assert "drift" in c.excluded and "naive" not in c.excluded
    for old, new in (("[1, 2]", "[0]"), ("[naive, theta]", "[other]"), ("models: [naive, theta]", "window: sliding"), ("metric: mase", "confidence: 2")):
        p.write_text(GOOD.replace(old, new))
        with pytest.raises(ConfigError):
            config.load_backtest(str(p))
    with pytest.raises(MissingInput):
        config.load_backtest(str(tmp_path / "none"))


def test_festivals_and_arms(tmp_path):
    p = tmp_path / "c.yaml"
    rule = "- {id: d, rule: {month: kartika, paksha: krishna, tithi: 30, observance: pradosha}, duration_days: 1}\n"
    p.write_text("lunar_month_scheme: purnimanta\nfestivals:\n" + rule)
    assert config.load_festivals(str(p))[0].amanta_month == "ashvina"
    for text in ("festivals:\n" + rule, "lunar_month_scheme: purnimanta\nfestivals:\n" + rule + rule):
        p.write_text(text)
        with pytest.raises(ConfigError):
            config.load_festivals(str(p))
    p.write_text("sensitivity: {arms: [{name: a, shocks: x}]}")
    assert config.load_arms(str(p), "w") == [("declared", "w"), ("a", "x")]
    for text in ("a: 1", "sensitivity: {arms: [{name: a, shocks: x}, {name: a, shocks: y}]}", "sensitivity: {arms: [{name: a}]}"):
        p.write_text(text)
        with pytest.raises(ConfigError):
            config.load_arms(str(p), "w")


def test_registry_rules():
    for bad in ({"registry": ("naive", "naive")}, {"needs_calendar": ("none",)}, {"ablations": (("a", "naive", "naive"),)}, {"ablations": (("calendar", "naive", "drift"),)}):
        with pytest.raises(ConfigError):
            config.check_registry(**bad)


def test_operations_file(tmp_path):
    p = tmp_path / "o.yaml"
    good = "model: theta\nhorizons: [2, 1]\nplanning: {ratios: [{id: beds, per_pilgrims: 10, basis: daily_mean, minimum: 3}]}\n"
    p.write_text(good)
    c = config.load_operations(str(p))
    assert c.model == "theta" and c.horizons == (1, 2) and c.confidence == 0.9 and c.ratios[0].minimum == 3
    for old, new in (("theta", "other"), ("[2, 1]", "[0]"), ("daily_mean", "yearly"), ("per_pilgrims: 10, ", ""), ("per_pilgrims: 10", "per_pilgrims: 0"), ("model", "confidence: 1\nmodel")):
        p.write_text(good.replace(old, new))
        with pytest.raises(ConfigError):
            config.load_operations(str(p))


def test_ingest_file(tmp_path):
    p = tmp_path / "i.yaml"
    good = "source: {id: s, publisher: p, title: t, accessed: a}\nmonthly: {path: m.csv, unit: lakh, month_format: '%b %Y', columns: {month: When, pilgrims: N}}\nannual: {path: y.csv, unit: absolute, columns: {year: Year, pilgrims: N}}\n"
    p.write_text(good)
    c, source = config.load_ingest(str(p))
    assert source["publisher"] == "p"
    assert c["monthly"].spec.unit == "lakh" and c["annual"].spec.month_column == "Year" and c["monthly"].path == "m.csv"
    for old, new in (("title: t", "title: CHANGE ME"), ("publisher: p, ", ""), ("unit: lakh", "unit: dozen"), ("month_format: '%b %Y', ", ""), ("annual", "yearly"), ("month: When", "day: When")):
        p.write_text(good.replace(old, new))
        with pytest.raises(ConfigError):
            config.load_ingest(str(p))
