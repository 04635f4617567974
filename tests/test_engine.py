"""Contract rules, panel invariants, kernels and the calendar, on small series of known shape."""

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, ContractViolation, CoverageError, MissingCitation, MissingInput, RaggedPanel
from tidemark.operators import bootstrap as bs
from tidemark.operators import kernels as kn
from tidemark.operators import leaderboard as lb
from tidemark.operators import lunisolar as ls
from tidemark.operators import panel as pn
from tidemark.operators import planning as pl
from tidemark.operators import report
from tidemark.sources import html, ingest
from tidemark.sources import series as sr
from tidemark.sources import windows as wd
from tidemark.streaming import events as ev

SMALL = pn.PanelConfig(24, (1, 2, 3))


def month(i, first=1990):
    return dt.date(first + i // 12, i % 12 + 1, 1)


def wave(n):
    return [1000 + 5 * t + 200 * math.sin(2 * math.pi * t / 12) for t in range(n)]


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, month(i), float(v)) for i, v in enumerate(values)], "series_id string, month date, y double")


def test_gaps_duplicates_and_negatives_raise(spark):
    s = series(spark, wave(24))
    assert sr.check_series(s).count() == 24
    for bad in (s.where("month <> '1990-05-01'"), s.unionByName(s.limit(1)), s.withColumn("y", -F.col("y"))):
        with pytest.raises(ContractViolation):
            sr.check_series(bad)


def test_counts_file_rules(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("month,n,source_id\n2000-01,5,x\n2000-02,7,x\n")
    assert sr.read_counts(spark, str(good), "month", "n").agg(F.sum("n")).first()[0] == 12
    for i, row in enumerate(("2000-03,,x", "2000-03,many,x", "2000-03,1.5,x", "2000-03,-1,x")):
        p = tmp_path / f"b{i}.csv"
        p.write_text(f"month,n,source_id\n{row}\n")
        with pytest.raises(ContractViolation, match="2000-03"):
            sr.read_counts(spark, str(p), "month", "n")
    with pytest.raises(ContractViolation, match="columns"):
        sr.read_counts(spark, str(good), "month", "other")
    with pytest.raises(MissingInput):
        sr.read_counts(spark, str(tmp_path / "none.csv"), "month", "n")


def test_reconciliation_names_the_year(spark):
    s = series(spark, [10] * 24)
    annual = spark.createDataFrame([("a", 1990, 120.0), ("a", 1991, 121.0), ("a", 1995, 1.0)], "series_id string, year int, total double")
    reasons = {r.year: r.reason for r in sr.reconciliation(s, annual).collect()}
    assert reasons == {1990: None, 1991: "sum differs", 1995: "no months"}
    with pytest.raises(ContractViolation, match="1991"):
        sr.check_reconciled(s, annual)


def test_origins_and_closed_forms(spark):
    y = wave(40)
    at = pn.origins(series(spark, y), SMALL)
    assert at.count() == 40 - 24 - 3 + 1
    got = {(r.origin, r.horizon, r.model): r for r in pn.score(pn.closed_forms(at, SMALL, ("naive", "seasonal_naive", "drift", "level_shift"))).collect()}
    for pos in (24, 30, 37):
        train = np.array(y[:pos])
        scale = np.abs(train[12:] - train[:-12]).mean()
        for h in (1, 2, 3):
            expected = {"naive": train[-1], "seasonal_naive": train[h - 13], "drift": train[-1] + h * (train[-1] - train[0]) / (pos - 1), "level_shift": kn.level_shift(train, np.array([h]))[0]}
            for m, p in expected.items():
                r = got[month(pos - 1), h, m]
                assert r.predicted == pytest.approx(p) and r.actual == pytest.approx(y[pos + h - 1]) and r.mase == pytest.approx(abs(p - y[pos + h - 1]) / scale)


def test_flat_series_has_no_scale(spark):
    with pytest.raises(Exception, match="not positive"):
        pn.score(pn.closed_forms(pn.origins(series(spark, [5] * 40), SMALL), SMALL, ("naive",))).collect()


def test_ragged_panel_raises(spark):
    p = pn.closed_forms(pn.origins(series(spark, wave(40)), SMALL), SMALL, ("naive", "drift"))
    assert pn.check_rectangular(p) is p
    with pytest.raises(RaggedPanel, match="drift"):
        pn.check_rectangular(p.where("NOT (model = 'drift' AND horizon = 2)"))
    with pytest.raises(ConfigError):
        pn.PanelConfig(horizons=(0,))


def test_labels_follow_the_target(spark):
    p = pn.closed_forms(pn.origins(series(spark, wave(40)), SMALL), SMALL, ("naive",))
    w = wd.window_table(spark, [wd.ShockWindow("w", month(26), month(27))])
    shock = {(r.origin, r.horizon) for r in wd.label(p, w).where("regime = 'shock'").collect()}
    assert shock == {(month(t - h), h) for t in (26, 27) for h in (1, 2, 3) if t - h >= 23}
    again = wd.label(wd.label(p, w), wd.window_table(spark, [wd.ShockWindow("v", month(0), month(1))]))
    assert again.where("regime = 'shock'").count() == 0


def test_windows_file(spark, tmp_path):
    entry = "windows:\n- {id: a, start: 2000-01, end: 2000-03, rationale: r, source: {publisher: p, title: t, url: u, accessed: d}}\n"
    p = tmp_path / "w.yaml"
    p.write_text(entry)
    assert wd.load_windows(str(p))[0].n_months == 3
    for old, new, error in (("rationale: r", "rationale: ''", MissingCitation), ("url: u", "url: ''", MissingCitation), ("end: 2000-03", "end: 1999-03", ConfigError), ("start: 2000-01", "start: soon", ConfigError)):
        p.write_text(entry.replace(old, new))
        with pytest.raises(error):
            wd.load_windows(str(p))
    touching = [wd.ShockWindow("a", month(0), month(2)), wd.ShockWindow("b", month(3), month(4))]
    assert wd.overlaps(wd.window_table(spark, touching)).count() == 0
    with pytest.raises(ContractViolation):
        wd.check_disjoint(wd.window_table(spark, [*touching, wd.ShockWindow("c", month(4), month(5))]))


def test_rank_correlation_with_ties_and_p(spark):
    t = spark.createDataFrame([("m1", 1.0, 9.0), ("m2", 2.0, 5.0), ("m3", 2.0, 4.0), ("m4", 7.0, 1.0)], "model string, clean double, shock double").withColumn("g", F.lit(1))
    assert lb.rank_correlation(t, "clean", "shock", ["g"]).first().rho == pytest.approx(-0.948683, abs=1e-6)
    assert lb.p_value(-0.383333, 9) == pytest.approx(0.308, abs=1e-3)


def test_bootstrap_is_the_direct_computation(spark):
    rows = [(month(i), m, "shock" if i % 5 == 0 else "clean", float((i * k) % 7 + k)) for i in range(40) for k, m in ((1, "a"), (2, "b"), (3, "c"))]
    panel = spark.createDataFrame(rows, "origin date, model string, regime string, mase double")
    config = bs.BootstrapConfig(n_resamples=5, block=6, seed=7)
    got = {(r.b, r.model, r.regime): r["mean"] for r in bs.resample(panel, config).collect()}
    rng = np.random.default_rng(7)
    for b in range(5):
        picks = np.concatenate([s + np.arange(6) for s in rng.integers(0, 35, size=7)])[:40]
        for m in "abc":
            for g in ("clean", "shock"):
                v = [x[3] for i in picks for x in rows[3 * i : 3 * i + 3] if x[1] == m and x[2] == g]
                assert got.get((b, m, g)) == (pytest.approx(np.mean(v)) if v else None)
    assert bs.win_shares(bs.resample(panel, config)).count() == 12


def test_kernels_on_known_series(spark):
    y, h = np.array(wave(120)), np.arange(1, 7)
    truth = np.array(wave(126))[120:]
    for model, p, reason in kn.forecasts(y, h, ["theta", "holt_winters_add", "holt_winters_mul", "sarima", "switching"]):
        assert reason is None and np.abs(p - truth).max() < (60 if model == "theta" else 40), model
    zeros = y.copy()
    zeros[50] = 0
    assert next(kn.forecasts(zeros, h, ["holt_winters_mul"]))[2].startswith("multiplicative")


def test_switching_reacts_to_a_collapse():
    y = np.array([1000 + 2 * t + 300 * math.sin(2 * math.pi * t / 12) for t in range(144)]) + np.random.default_rng(20260818).normal(0, 40, 144)
    h = np.arange(1, 4)
    calm = {m: p for m, p, _ in kn.forecasts(y, h, ["holt_winters_add", "switching"])}
    assert (calm["switching"] == calm["holt_winters_add"]).all()
    y[-2:] *= 0.1
    hit = {m: p for m, p, _ in kn.forecasts(y, h, ["holt_winters_add", "switching", "switching_sticky"])}
    assert (hit["switching_sticky"] == kn.level_shift(y, h)).all()


def test_detector_fold_is_the_loop(spark):
    rng = np.random.default_rng(3)
    scores = {name: rng.normal(0, 2.5, 60) for name in "abcdef"}
    df = spark.createDataFrame([(k, month(i), float(x)) for k, v in scores.items() for i, x in enumerate(v)], "series_id string, month date, score double")
    for dwell in (1, 6):
        assert {r.series_id: r.in_shock for r in kn.detector(df, dwell).collect()} == {k: kn.in_shock(v, dwell) for k, v in scores.items()}


def test_kernel_panel_and_calendar_routing(spark):
    s = series(spark, wave(60))
    config = pn.PanelConfig(48, (1, 2), step=4)
    p = kn.kernel_panel(s, config, ["theta", "holt_winters_add"])
    assert p.where("predicted is not null").count() == p.count() == 2 * 2 * 3
    with pytest.raises(CoverageError):
        kn.kernel_panel(s, config, ["sarimax_cal"])
    with pytest.raises(ConfigError):
        kn.kernel_panel(s, config, ["unknown"])
    short = spark.createDataFrame([(month(0), 1.0)], "month date, f double")
    with pytest.raises(CoverageError, match="1990-02"):
        kn.kernel_panel(s, config, ["sarimax_cal"], calendar=short, features=["f"])
    zero = series(spark, [0.0, *wave(59)])
    bad = kn.applicability(kn.kernel_panel(zero, config, ["holt_winters_mul"])).first()
    assert bad.failed == bad.origins == 3 and "positive" in bad.reason and bad.first_failure == month(47)


def test_festival_dates():
    got = {(d.year, f): d for d, f, _, _ in ls.occurrences(dt.date(2016, 1, 1), dt.date(2025, 12, 31))}
    known = {"diwali": ["2016-10-30", "2019-10-27", "2024-10-31"], "maha_shivaratri": ["2020-02-21", "2024-03-08"], "sharad_navratri": ["2020-10-17", "2023-10-15"], "chaitra_navratri": ["2021-04-13", "2025-03-30"], "raksha_bandhan": ["2019-08-15", "2024-08-19"]}
    for f, days in known.items():
        for d in map(dt.date.fromisoformat, days):
            assert got[d.year, f] == d
    with pytest.raises(ConfigError):
        ls.absolute_tithi("shukla", 16)
    assert ls.absolute_tithi("krishna", 14) == 29 and ls.absolute_tithi("krishna", 30) == 30


def test_calendar_features_conserve_days(spark):
    f = ls.features(spark, dt.date(2015, 1, 1), dt.date(2020, 12, 31)).collect()
    assert len(f) == 72 and sum(r.sharad_navratri_days for r in f) == 9 * 6 and all(r.lunar_drift_days is not None for r in f)


def test_planning_bands_and_report(spark):
    p = pn.score(pn.closed_forms(pn.origins(series(spark, wave(60)), SMALL), SMALL, ("naive", "seasonal_naive")))
    d = wd.label(p, wd.window_table(spark, [wd.ShockWindow("w", month(40), month(45))]))
    plan = pl.planning_table(pl.forward(series(spark, wave(60)), SMALL), pl.error_bands(d), "seasonal_naive", 500.0, 1)
    for r in plan.collect():
        assert r.lo <= r.hi and r.forecast == pytest.approx(wave(60)[47 + r.horizon]) and r.need == max(1, math.ceil(r.forecast / 500))
    text = report.render(d)
    assert "Leaderboard" in text and "seasonal_naive" in text and "band" in report.briefing(plan, "seasonal_naive")


def test_forward_by_any_forecaster(spark):
    s = series(spark, wave(60))
    flat = {r.horizon: r.forecast for r in pl.forward(s, SMALL, "naive").collect()}
    assert flat == {h: pytest.approx(wave(60)[-1]) for h in (1, 2, 3)}
    fitted = {r.horizon: (r.month, r.forecast) for r in pl.forward(s, SMALL, "holt_winters_add").collect()}
    assert all(fitted[h] == (month(59 + h), pytest.approx(wave(63)[59 + h], rel=0.05)) for h in (1, 2, 3))
    with pytest.raises(Exception, match="positive"):
        pl.forward(series(spark, [0.0, *wave(59)]), SMALL, "holt_winters_mul").collect()


def test_choice_of_the_planning_model(spark):
    p = pn.score(pn.closed_forms(pn.origins(series(spark, wave(60)), SMALL), SMALL, ("naive", "drift")))
    clean = wd.label(p, wd.window_table(spark, [wd.ShockWindow("w", month(40), month(45))]))
    assert pl.choose_model(clean, "naive") == "naive"
    assert pl.choose_model(clean) == min(lb.errors(clean).where("regime = 'clean'").collect(), key=lambda r: r.mase).model
    for panel, name in ((clean, "theta"), (clean.where("regime = 'shock'"), "best_clean")):
        with pytest.raises(ConfigError):
            pl.choose_model(panel, name)


def test_month_lists_and_summaries(spark):
    rows = [("<tr><td>1</td><td>Jan 2020</td><td>1,23,456</td></tr><tr><td>2</td><td>Sept. 2021</td><td>7</td></tr><tr><td>3</td><td>Janet 2020</td><td>7</td></tr><tr><td>4</td><td>2019</td><td>81.25</td></tr>",)]
    cells = html.table_cells(spark.createDataFrame([(1, f"<table>{x}</table>") for (x,) in rows], "page_id long, html string"))
    assert sorted((r.month, r.y) for r in html.month_list(cells).collect()) == [(dt.date(2020, 1, 1), 123456), (dt.date(2021, 9, 1), 7)]
    assert [(r.year, float(r.lakh)) for r in html.lakh_summary(cells).collect()] == [(2019, 81.25)]


def test_publications_have_to_agree(spark):
    s = series(spark, wave(12))
    sr.check_shared_months(s, s.limit(5))
    with pytest.raises(ContractViolation, match="1990-04"):
        sr.check_shared_months(s, s.withColumn("y", F.when(F.month("month") == 4, 1.0).otherwise(F.col("y"))))
    annual = spark.createDataFrame([(2000 + i, 8_000_000 + i) for i in range(6)], "year int, total long")
    published = spark.createDataFrame([(2000 + i, 80.02 if i < 3 else 80.01) for i in range(6)], "year int, lakh double")
    assert sr.check_rounded(annual, published).count() == 3
    with pytest.raises(ContractViolation, match="2005"):
        sr.check_rounded(annual, published.withColumn("lakh", F.lit(81.0)))


def test_metrics_survive_their_file(spark, tmp_path):
    p = wd.label(pn.score(pn.closed_forms(pn.origins(series(spark, wave(40)), SMALL), SMALL, ("naive",))), wd.window_table(spark, [wd.ShockWindow("w", month(30), month(31))]))
    path = str(tmp_path / "m")
    report.write_metrics(p, path)
    back = report.read_metrics(spark, path)
    assert dict(back.dtypes) == dict(p.dtypes)
    key = ("origin", "horizon")
    for a, b in zip(p.orderBy(*key).collect(), back.orderBy(*key).collect(), strict=True):
        assert a.mase == pytest.approx(b.mase) and (a.target, a.regime, a.shock_window) == (b.target, b.regime, b.shock_window)
    with pytest.raises(MissingInput):
        report.read_metrics(spark, str(tmp_path / "none"))


def test_any_table(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("Month,Visitor total\nJan 2020,007\n")
    t = ingest.read_any(spark, str(p))
    assert t.first()[1] == "007" and "007" in ingest.inspect(t) and "month: Month, pilgrims: Visitor total" in ingest.inspect(t)
    assert ingest.guess(["Total", "Visitors"], ("visitor", "total")) == "Visitors"
    with pytest.raises(MissingInput):
        ingest.read_any(spark, str(tmp_path / "none.csv"))


def test_splice(tmp_path):
    p = tmp_path / "r.md"
    p.write_text("a\n<!-- BEGIN RESULTS -->old<!-- END RESULTS -->\nb")
    report.splice(str(p), "new")
    assert "old" not in p.read_text() and "new" in p.read_text() and p.read_text().endswith("b")
    p.write_text("nothing")
    with pytest.raises(ContractViolation):
        report.splice(str(p), "new")


def test_html_tables(spark):
    page = "<table><tr><th>Year</th><th>Jan</th></tr><tr><td>2001</td><td>1,2&nbsp;3<b>4</b></td></tr></table><table></table>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    cells = {(r.table, r.row, r.cell): r.value for r in html.table_cells(df).collect()}
    assert cells[0, 1, 0] == "2001" and cells[0, 0, 1] == "Jan" and len(cells) == 4


def test_ingest(spark):
    raw = spark.createDataFrame([("Jan 2001", "1.5"), ("Feb 2001", "2")], "m string, c string")
    out = ingest.build(raw, ingest.TableSpec("m", "c", "%b %Y", "lakh", "s"))
    assert sorted(r.y for r in out.collect()) == [150000, 200000]
    with pytest.raises(ContractViolation):
        ingest.build(raw, ingest.TableSpec("m", "c", "%b %Y", "absolute", "s"))
    with pytest.raises(ConfigError):
        ingest.TableSpec("m", "c", "%b", "dozen")


def test_stream_and_batch_agree(spark, tmp_path, sf):
    src = tmp_path / "in"
    src.mkdir()
    sr.read_table(spark, sf, "events").coalesce(1).write.parquet(str(src / "e"))
    stream = ev.tumbling(ev.read_events(spark, str(src / "e")), late="60 days")
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ev.tumbling(sr.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    key = ["start", "event_type"]
    assert sorted(map(tuple, spark.table("hours").select(*key, "n").collect())) == sorted(map(tuple, batch.select(*key, "n").collect()))


def test_month_matrix_refuses_a_changed_page(spark):
    months = list("abcdefghijkl")

    def page(header, *rows):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in (header, *rows)) + "</table>"

    head, row = ["Year", *months, "Total"], ["2001", *map(str, range(12)), "66"]

    def parsed(text):
        return html.month_matrix(html.table_cells(spark.createDataFrame([(1, text)], "page_id long, html string")), months).collect()

    got = parsed(page(head, row, ["note"]))
    assert len(got) == 12 and (got[0].year, got[0].total) == (2001, "66") and sorted(r.value for r in got) == sorted(map(str, range(12)))
    for bad in (page(["Year", *months[::-1], "Total"], row), page(head, row[:-1])):
        with pytest.raises(Exception, match="page 1, table 0, row 1"):
            parsed(bad)


def test_months_of_windows_are_strict():
    assert wd._month("2020-01", "x") == wd._month(dt.date(2020, 1, 9), "x") == dt.date(2020, 1, 1)
    for bad in ("2020-01xyz", "2020", "2020-13", None):
        with pytest.raises(ConfigError):
            wd._month(bad, "x")


def test_surprise_scores_and_state_by_brute_force(spark):
    rng = np.random.default_rng(3)
    y = {"a": 1000 + 50 * np.sin(np.arange(60) * np.pi / 6) + rng.normal(0, 20, 60), "b": 1000 + rng.normal(0, 20, 60), "flat": np.full(40, 7.0), "short": np.arange(20.0)}
    y["b"][50:] *= 0.1
    rows = [(k, dt.date(2000 + i // 12, i % 12 + 1, 1), float(v)) for k, x in y.items() for i, v in enumerate(x)]
    scores = kn.surprise_scores(spark.createDataFrame(rows, "series_id string, month date, y double"))
    got = {}
    for r in scores.orderBy("month").collect():
        got.setdefault(r.series_id, []).append(r.score)
    assert set(got) == {"a", "b", "flat"} and set(got["flat"]) == {0.0}
    for k in ("a", "b"):
        r = y[k] - kn.Smoothing.fit(y[k]).fitted
        want = (r - np.median(r)) / (1.4826 * np.median(np.abs(r - np.median(r))))
        assert np.allclose(got[k], want)
    state = {r.series_id: r.in_shock for r in kn.detector(scores, 6).collect()}
    assert state == {k: kn.in_shock(np.array(v), 6) for k, v in got.items()} and len(set(state.values())) == 2


def test_hashed_starts_are_independent(spark):
    drawn = bs.starts(spark, 56, bs.BootstrapConfig(n_resamples=2000)).collect()
    picks = {}
    for r in drawn:
        assert r.start == int(hashlib.md5(f"{r.b}:{r.k}".encode()).hexdigest()[:8], 16) % 45
        picks.setdefault(r.b, []).append((r.k, r.start))
    assert len({tuple(sorted(x)) for x in picks.values()}) == 2000
