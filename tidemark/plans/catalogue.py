"""Registered queries of the time-series engine, by name, with the DuckDB SQL that gives the same rows.

Doubles are rounded on both sides, as sums may run in another order.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as mt
from ..operators import bootstrap as bs
from ..operators import kernels as kn
from ..operators import leaderboard as lb
from ..operators import lunisolar as ls
from ..operators import panel as pn
from ..operators import planning as pl
from ..operators import report
from ..sources import html, ingest
from ..sources import series as sr
from ..sources import windows as wd
from ..streaming import events as ev
from . import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6
BOOT = bs.BootstrapConfig(n_resamples=2000)
PAIRS = (("season", "seasonal_naive", "naive"), ("shift", "level_shift", "seasonal_naive"))


def register(name: str, sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = query(spark, sf_dir)
            return df.select([F.round(c, PLACES).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = rounded
        if sql:
            SQL[name] = sql
        return query

    return add


def _r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), {PLACES}) AS {name}"


def _windows(windows, arm: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{w.id}' AS id, DATE '{w.start}' AS start_month, DATE '{w.end}' AS end_month{f", '{arm}' AS arm" if arm else ''}" for w in windows)


def _flow(by: str = "'all'") -> str:
    """CTEs from the fact table to the scored panel ``sc`` and the labelled ``lab``."""
    return f"""
WITH m0 AS (SELECT CAST({by} AS VARCHAR) AS series_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(count(*) AS BIGINT) AS y FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
s AS (SELECT * FROM (SELECT *, max(month) OVER (PARTITION BY series_id) AS last FROM m0) WHERE month < last),
o0 AS (SELECT series_id, month, CAST(y AS DOUBLE) AS y, row_number() OVER w AS pos, count(*) OVER (PARTITION BY series_id) AS n, abs(y - lag(y, 12) OVER w) AS step,
  first_value(CAST(y AS DOUBLE)) OVER w AS first_y, median(y) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent,
  median(y) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 17 PRECEDING AND 12 PRECEDING) AS year_before
  FROM s WINDOW w AS (PARTITION BY series_id ORDER BY month)),
o AS (SELECT *, avg(step) OVER (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS scale FROM o0),
c AS (SELECT o.series_id, o.month AS origin, a.month AS target, CAST(h.h AS INTEGER) AS horizon, o.y, o.pos, o.first_y, o.recent, o.year_before, o.scale AS mase_scale, a.y AS actual, q.y AS same_month
  FROM o JOIN (SELECT unnest([1, 2, 3]) AS h) h ON o.pos >= 24 AND o.pos <= o.n - 3
  JOIN o a ON a.series_id = o.series_id AND a.pos = o.pos + h.h JOIN o q ON q.series_id = o.series_id AND q.pos = o.pos + h.h - 12),
f AS (SELECT *, 'naive' AS model, y AS predicted FROM c UNION ALL SELECT *, 'seasonal_naive', same_month FROM c
  UNION ALL SELECT *, 'drift', y + horizon * (y - first_y) / (pos - 1) FROM c UNION ALL SELECT *, 'level_shift', same_month + recent - year_before FROM c),
sc AS (SELECT series_id, origin, target, horizon, model, actual, predicted, mase_scale, abs(actual - predicted) AS ae, (actual - predicted) * (actual - predicted) AS se,
  CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0.0 ELSE 200.0 * abs(predicted - actual) / (abs(actual) + abs(predicted)) END AS smape, abs(actual - predicted) / mase_scale AS mase FROM f),
win AS ({_windows(flows.DECLARED)}),
lab AS (SELECT sc.*, win.id AS shock_window, CASE WHEN win.id IS NULL THEN 'clean' ELSE 'shock' END AS regime FROM sc LEFT JOIN win ON sc.target BETWEEN win.start_month AND win.end_month)"""


SERIES = "SELECT series_id, month, y FROM s"
BOARD = """
, w AS (SELECT {by} model, avg(mase) FILTER (regime = 'clean') AS clean, avg(mase) FILTER (regime = 'shock') AS shock,
  count(*) FILTER (regime = 'clean') AS clean_n, count(*) FILTER (regime = 'shock') AS shock_n FROM {src} GROUP BY ALL),
b AS (SELECT *, CASE WHEN clean IS NOT NULL THEN rank() OVER (PARTITION BY {by} clean IS NULL ORDER BY clean) END AS clean_rank,
  CASE WHEN shock IS NOT NULL THEN rank() OVER (PARTITION BY {by} shock IS NULL ORDER BY shock) END AS shock_rank FROM w)"""
BOARD_OUT = f"SELECT {{by}} model, {_r('clean', 'clean')}, {_r('shock', 'shock')}, clean_n, shock_n, clean_rank, shock_rank, shock_rank - clean_rank AS rank_change FROM b"
RHO = """
, rk AS (SELECT {by} rank() OVER (PARTITION BY {by} 1 ORDER BY clean) + (count(*) OVER (PARTITION BY {by} clean) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {by} 1 ORDER BY shock) + (count(*) OVER (PARTITION BY {by} shock) - 1) / 2.0 AS rb FROM {src} WHERE clean IS NOT NULL AND shock IS NOT NULL),
rh AS (SELECT {by} count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 12) END AS rho FROM rk GROUP BY ALL)"""
DRAWS = f"""
, cells AS (SELECT origin, model, regime, sum(mase) AS total, count(*) AS n FROM lab GROUP BY ALL),
ix AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS i FROM (SELECT DISTINCT origin FROM lab)),
sz AS (SELECT count(*) AS n FROM ix),
pk AS (SELECT b.b, CAST('0x' || substr(md5(b.b || ':' || k.k), 1, 8) AS BIGINT) % (sz.n - 12 + 1) + p.p AS i FROM sz, range({BOOT.n_resamples}) b(b), range(100) k(k), range(12) p(p) WHERE k.k * 12 + p.p < sz.n),
dr AS (SELECT b, model, regime, sum(total) / sum(cells.n) AS mean FROM pk JOIN ix USING (i) JOIN cells USING (origin) GROUP BY ALL)"""


@register("monthly_counts", _flow() + SERIES)
def monthly_counts(spark, sf):
    return flows.lineitem_series(spark, sf)


@register("monthly_by_flag", _flow("l_returnflag") + SERIES)
def monthly_by_flag(spark, sf):
    return flows.lineitem_series(spark, sf, "l_returnflag")


@register("order_value_by_month", "SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 4) AS y FROM orders GROUP BY 1, 2")
def order_value_by_month(spark, sf):
    d = sr.monthly(sr.read_table(spark, sf, "orders"), "o_orderdate", F.col("o_orderpriority"), F.col("o_totalprice"))
    return d.withColumn("y", F.round("y", 4))


def _holed(spark, sf):
    return flows.lineitem_series(spark, sf).where(~F.month("month").isin(3, 7))


@register("month_spine_gaps", _flow() + ", h AS (SELECT * FROM s WHERE month(month) NOT IN (3, 7)) SELECT 'all' AS series_id, CAST(x AS DATE) AS month FROM (SELECT unnest(generate_series((SELECT min(month) FROM h), (SELECT max(month) FROM h), INTERVAL 1 MONTH)) AS x) WHERE CAST(x AS DATE) NOT IN (SELECT month FROM h)")
def month_spine_gaps(spark, sf):
    return sr.gaps(_holed(spark, sf))


@register("gap_summary", _flow() + ", h AS (SELECT * FROM s WHERE month(month) NOT IN (3, 7)) SELECT series_id, min(month) AS first_month, max(month) AS last_month, count(*) AS n_months, CAST(sum(y) AS BIGINT) AS total, min(y) AS least, max(y) AS most, CAST(date_diff('month', min(month), max(month)) + 1 - count(*) AS BIGINT) AS n_missing FROM h GROUP BY series_id")
def gap_summary(spark, sf):
    return sr.gap_summary(_holed(spark, sf))


@register("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return sr.duplicates(sr.read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("dangling_fk", "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def dangling_fk(spark, sf):
    return sr.dangling(sr.read_table(spark, sf, "documents"), "doc_id", sr.read_table(spark, sf, "labels"), "doc_id")


@register("annual_reconciliation", _flow() + ", a AS (SELECT series_id, year(month) AS year, sum(y) + max(CASE WHEN year(month) = 1997 THEN 1 ELSE 0 END) AS total FROM s GROUP BY 1, 2), g AS (SELECT series_id, year(month) AS year, count(*) AS n_months, sum(y) AS found FROM s GROUP BY ALL) SELECT a.series_id, CAST(a.year AS INTEGER) AS year, CAST(total AS BIGINT) AS total, n_months, CAST(found AS BIGINT) AS found, CASE WHEN n_months <> 12 THEN 'not twelve months' WHEN found <> total THEN 'sum differs' END AS reason FROM a JOIN g ON a.series_id = g.series_id AND a.year = g.year")
def annual_reconciliation(spark, sf):
    s = flows.lineitem_series(spark, sf)
    annual = s.groupBy("series_id", F.year("month").alias("year")).agg(F.sum("y").alias("total")).withColumn("total", F.col("total") + F.when(F.col("year") == 1997, 1).otherwise(0))
    return sr.reconciliation(s, annual)


@register("mase_scale", _flow() + f"SELECT DISTINCT origin, {_r('mase_scale', 'scale')} FROM c")
def mase_scale(spark, sf):
    return pn.origins(flows.lineitem_series(spark, sf), flows.CONFIG).select("origin", "scale")


for _name in flows.MODELS:

    @register(f"forecast_{_name}", _flow() + f"SELECT origin, target, horizon, {_r('actual', 'actual')}, {_r('predicted', 'predicted')} FROM f WHERE model = '{_name}'".replace("SELECT origin, target", "SELECT origin, target"))
    def forecast(spark, sf, name=_name):
        at = pn.origins(flows.lineitem_series(spark, sf), flows.CONFIG)
        return pn.closed_forms(at, flows.CONFIG, [name]).select("origin", "target", "horizon", "actual", "predicted")


_SCORED = "series_id, origin, target, horizon, model, " + ", ".join(_r(c, c) for c in ("actual", "predicted", "mase_scale", "ae", "se", "smape", "mase"))


@register("scored_panel", _flow("l_returnflag") + f"SELECT {_SCORED} FROM sc")
def scored_panel(spark, sf):
    return flows.panel(spark, sf, "l_returnflag")


@register("regime_labels", _flow() + "SELECT DISTINCT target, shock_window, regime FROM lab")
def regime_labels(spark, sf):
    return flows.labelled(spark, sf).select("target", "shock_window", "regime").distinct()


@register("relabel", _flow().replace(_windows(flows.DECLARED), _windows(flows.REFINED)) + "SELECT origin, target, horizon, model, shock_window, regime FROM lab")
def relabel(spark, sf):
    return wd.label(flows.labelled(spark, sf), wd.window_table(spark, flows.REFINED)).select("origin", "target", "horizon", "model", "shock_window", "regime")


@register("regime_counts", _flow() + "SELECT regime, shock_window, count(*) AS n, CAST(count(*) // 4 AS BIGINT) AS n_a_model FROM lab GROUP BY ALL")
def regime_counts(spark, sf):
    return lb.counts(flows.labelled(spark, sf))


@register("panel_provenance", _flow() + "SELECT count(DISTINCT origin) AS n_origins, count(DISTINCT horizon) AS n_horizons, count(DISTINCT model) AS n_models, min(origin) AS first_origin, max(origin) AS last_origin, min(target) AS first_target, max(target) AS last_target, count(*) AS n FROM lab")
def panel_provenance(spark, sf):
    return lb.provenance(flows.labelled(spark, sf))


@register("per_regime_leaderboard", _flow() + BOARD.format(by="", src="lab") + BOARD_OUT.format(by=""))
def per_regime_leaderboard(spark, sf):
    return lb.per_regime(flows.labelled(spark, sf))


@register("horizon_leaderboard", _flow() + BOARD.format(by="horizon,", src="lab") + BOARD_OUT.format(by="horizon,"))
def horizon_leaderboard(spark, sf):
    return lb.per_regime(flows.labelled(spark, sf), by=["horizon"])


@register("series_leaderboard", _flow("l_returnflag") + BOARD.format(by="series_id,", src="lab") + BOARD_OUT.format(by="series_id,"))
def series_leaderboard(spark, sf):
    return lb.per_regime(flows.labelled(spark, sf, "l_returnflag"), by=["series_id"])


@register("error_summary", _flow() + f"SELECT model, regime, {_r('avg(ae)', 'mae')}, {_r('sqrt(avg(se))', 'rmse')}, {_r('avg(smape)', 'smape')}, {_r('avg(mase)', 'mase')} FROM lab GROUP BY ALL")
def error_summary(spark, sf):
    return lb.errors(flows.labelled(spark, sf))


@register("best_model_by_regime", _flow() + f"SELECT regime, model, {_r('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY score, model) AS k FROM (SELECT regime, model, avg(mase) AS score FROM lab GROUP BY ALL)) WHERE k = 1")
def best_model_by_regime(spark, sf):
    return lb.best(flows.labelled(spark, sf))


@register("rank_correlation", _flow() + BOARD.format(by="horizon,", src="lab") + RHO.format(by="horizon,", src="b") + f"SELECT horizon, n, {_r('rho', 'rho')} FROM rh")
def rank_correlation(spark, sf):
    return lb.rank_correlation(lb.per_regime(flows.labelled(spark, sf), by=["horizon"]), "clean", "shock", ["horizon"])


@register("block_bootstrap_means", _flow() + DRAWS + f"SELECT CAST(b AS BIGINT) AS b, model, regime, {_r('mean', 'mean')} FROM dr")
def block_bootstrap_means(spark, sf):
    return bs.resample(flows.labelled(spark, sf), BOOT)


@register("bootstrap_intervals", _flow() + DRAWS + f"SELECT model, regime, {_r('quantile_cont(mean, 0.025)', 'lo')}, {_r('quantile_cont(mean, 0.975)', 'hi')}, count(*) AS n_usable FROM dr GROUP BY ALL")
def bootstrap_intervals(spark, sf):
    return bs.intervals(bs.resample(flows.labelled(spark, sf), BOOT))


@register("pairwise_beats", _flow() + DRAWS + f"SELECT x.model, z.model AS opponent, x.regime, {_r('avg(CASE WHEN x.mean < z.mean THEN 1.0 ELSE 0.0 END)', 'p_beats')}, count(*) AS n_usable FROM dr x JOIN dr z ON x.b = z.b AND x.regime = z.regime AND x.model <> z.model GROUP BY ALL")
def pairwise_beats(spark, sf):
    return bs.win_shares(bs.resample(flows.labelled(spark, sf), BOOT))


@register("inversion_share", _flow() + DRAWS + ", wd AS (SELECT b, model, max(mean) FILTER (regime = 'clean') AS clean, max(mean) FILTER (regime = 'shock') AS shock FROM dr GROUP BY ALL)" + RHO.format(by="b,", src="wd") + f"SELECT {_r('avg(CASE WHEN rho < 0 THEN 1.0 WHEN rho IS NOT NULL THEN 0.0 END)', 'p_inversion')}, {_r('quantile_cont(rho, 0.025)', 'lo')}, {_r('quantile_cont(rho, 0.975)', 'hi')}, count(rho) AS n_usable FROM rh")
def inversion_share(spark, sf):
    return bs.inversion(bs.resample(flows.labelled(spark, sf), BOOT))


def _arms(spark, sf):
    arms = wd.window_table(spark, flows.DECLARED, "declared").unionByName(wd.window_table(spark, flows.REFINED, "refined"))
    return wd.label_arms(flows.panel(spark, sf), arms)


ARMS = ", ar AS (" + _windows(flows.DECLARED, "declared") + " UNION ALL " + _windows(flows.REFINED, "refined") + "), sl AS (SELECT sc.*, n.arm, CASE WHEN ar.id IS NULL THEN 'clean' ELSE 'shock' END AS regime FROM sc JOIN (SELECT DISTINCT arm FROM ar) n ON true LEFT JOIN ar ON ar.arm = n.arm AND sc.target BETWEEN ar.start_month AND ar.end_month)"


@register("sensitivity_arms", _flow() + ARMS + BOARD.format(by="arm,", src="sl") + BOARD_OUT.format(by="arm,"))
def sensitivity_arms(spark, sf):
    return lb.per_regime(_arms(spark, sf), by=["arm"])


@register("rank_changes", _flow() + ARMS + BOARD.format(by="arm,", src="sl") + "SELECT x.arm, x.model, d.clean_rank AS base_clean, x.clean_rank, d.shock_rank AS base_shock, x.shock_rank FROM b x JOIN b d ON d.arm = 'declared' AND x.arm <> 'declared' AND x.model = d.model AND (x.clean_rank <> d.clean_rank OR x.shock_rank <> d.shock_rank)")
def rank_changes(spark, sf):
    return lb.rank_moves(lb.per_regime(_arms(spark, sf), by=["arm"]), "declared")


ABLATE = ", ab AS (SELECT * FROM (VALUES " + ", ".join(map(str, PAIRS)) + ") v(ablation, treatment, control)), dl AS (SELECT ab.*, t.clean AS with_clean, k.clean AS without_clean, t.shock AS with_shock, k.shock AS without_shock, t.clean - k.clean AS delta_clean, t.shock - k.shock AS delta_shock FROM ab JOIN b t ON t.model = treatment JOIN b k ON k.model = control)"


@register("ablation_deltas", _flow() + BOARD.format(by="", src="lab") + ABLATE + "SELECT ablation, treatment, control, " + ", ".join(_r(c, c) for c in ("with_clean", "without_clean", "with_shock", "without_shock", "delta_clean", "delta_shock")) + " FROM dl")
def ablation_deltas(spark, sf):
    return lb.ablations(lb.per_regime(flows.labelled(spark, sf)), PAIRS)


@register("ablation_verdicts", _flow() + DRAWS + BOARD.format(by="", src="lab") + ABLATE + ", lg AS (SELECT ablation, treatment, control, 'clean' AS regime, delta_clean AS delta FROM dl UNION ALL SELECT ablation, treatment, control, 'shock', delta_shock FROM dl), pb AS (SELECT x.model, z.model AS opponent, x.regime, avg(CASE WHEN x.mean < z.mean THEN 1.0 ELSE 0.0 END) AS p FROM dr x JOIN dr z ON x.b = z.b AND x.regime = z.regime GROUP BY ALL) " + f"SELECT treatment, control, lg.regime, ablation, {_r('delta', 'delta')}, {_r('p', 'p_beats')}, p >= 0.95 OR 1 - p >= 0.95 AS resolved FROM lg LEFT JOIN pb ON pb.model = treatment AND pb.opponent = control AND pb.regime = lg.regime")
def ablation_verdicts(spark, sf):
    d = flows.labelled(spark, sf)
    return bs.verdicts(lb.ablations(lb.per_regime(d), PAIRS), bs.win_shares(bs.resample(d, BOOT)))


BANDS = ", bd AS (SELECT model, horizon, regime, count(*) AS n, quantile_cont((actual - predicted) / mase_scale, 0.05) AS lo, quantile_cont((actual - predicted) / mase_scale, 0.5) AS middle, quantile_cont((actual - predicted) / mase_scale, 0.95) AS hi FROM lab GROUP BY ALL HAVING count(*) >= 5)"


@register("error_bands", _flow() + BANDS + "SELECT model, horizon, regime, n, " + ", ".join(_r(c, c) for c in ("lo", "middle", "hi")) + " FROM bd")
def error_bands(spark, sf):
    return pl.error_bands(flows.labelled(spark, sf))


@register("planning_table", _flow() + BANDS + ", fw AS (SELECT l.series_id, CAST(l.month + to_months(CAST(h.h AS INTEGER)) AS DATE) AS month, CAST(h.h AS INTEGER) AS horizon, q.y AS forecast, l.scale FROM o l JOIN (SELECT unnest([1, 2, 3]) AS h) h ON l.pos = l.n JOIN o q ON q.pos = l.pos + h.h - 12) SELECT series_id, month, fw.horizon, forecast, " + ", ".join(_r(f"CASE WHEN {r}.{e} IS NOT NULL THEN greatest(0.0, forecast + {r}.{e} * scale) END", n) for r, e, n in (("c1", "lo", "lo"), ("c1", "hi", "hi"), ("c2", "lo", "shock_lo"), ("c2", "hi", "shock_hi"))) + f", CAST(day(last_day(month)) AS INTEGER) AS days_in_month, {_r('forecast / day(last_day(month))', 'daily_mean')}, CAST(greatest(2, ceil(forecast / 100.0)) AS BIGINT) AS need FROM fw LEFT JOIN bd c1 ON c1.horizon = fw.horizon AND c1.model = 'seasonal_naive' AND c1.regime = 'clean' LEFT JOIN bd c2 ON c2.horizon = fw.horizon AND c2.model = 'seasonal_naive' AND c2.regime = 'shock'")
def planning_table(spark, sf):
    d = flows.labelled(spark, sf)
    return pl.planning_table(pl.forward(flows.lineitem_series(spark, sf), flows.CONFIG), pl.error_bands(d), "seasonal_naive", 100.0, 2)


@register("horizon_winners", _flow() + BOARD.format(by="horizon,", src="lab") + "SELECT c.horizon, c.model AS best_clean, c.shock_rank AS best_clean_shock_rank, z.model AS best_shock, z.clean_rank AS best_shock_clean_rank, c.k AS n_models FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY clean, model) AS i, count(*) OVER (PARTITION BY horizon) AS k FROM b) c JOIN (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY shock, model) AS i FROM b) z ON z.horizon = c.horizon AND c.i = 1 AND z.i = 1")
def horizon_winners(spark, sf):
    return lb.winners(lb.per_regime(flows.labelled(spark, sf), by=["horizon"]), ["horizon"])


@register("sensitivity_movement", _flow() + ARMS + BOARD.format(by="arm,", src="sl") + ", lr AS (SELECT arm, model, 'clean' AS regime, clean_rank AS rank FROM b UNION ALL SELECT arm, model, 'shock', shock_rank FROM b) SELECT model, regime, count(*) AS n_arms, max(rank) FILTER (arm = 'declared') AS base_rank, min(rank) AS least_rank, max(rank) AS most_rank, bool_and(rank = 1) AS holds_first FROM lr WHERE rank IS NOT NULL GROUP BY ALL")
def sensitivity_movement(spark, sf):
    return lb.movement(lb.per_regime(_arms(spark, sf), by=["arm"]), "declared")


WINS = ", pb AS (SELECT x.model, z.model AS opponent, x.regime, avg(CASE WHEN x.mean < z.mean THEN 1.0 ELSE 0.0 END) AS p, count(*) AS n FROM dr x JOIN dr z ON x.b = z.b AND x.regime = z.regime AND x.model <> z.model GROUP BY ALL)"


@register("headline_comparisons", _flow() + DRAWS + WINS + BOARD.format(by="", src="lab") + ", ld AS (SELECT arg_min(model, clean) AS best_clean, arg_min(model, shock) AS best_shock FROM b), wt AS (SELECT best_shock AS model, model AS opponent, 'shock' AS regime FROM (SELECT best_shock, b.model, row_number() OVER (ORDER BY clean, b.model) AS i FROM b, ld WHERE b.model <> best_shock) WHERE i <= 3 UNION ALL SELECT best_clean, best_shock, 'clean' FROM ld WHERE best_clean <> best_shock) " + f"SELECT model, opponent, regime, {_r('p', 'p_beats')} FROM wt JOIN pb USING (model, opponent, regime)")
def headline_comparisons(spark, sf):
    d = flows.labelled(spark, sf)
    return lb.headline(lb.per_regime(d), bs.win_shares(bs.resample(d, BOOT)))


@register("bootstrap_report", _flow() + DRAWS + WINS + ", wd AS (SELECT b, model, max(mean) FILTER (regime = 'clean') AS clean, max(mean) FILTER (regime = 'shock') AS shock FROM dr GROUP BY ALL)" + RHO.format(by="b,", src="wd") + f", al AS (SELECT 'mean' AS statistic, model, CAST(NULL AS VARCHAR) AS opponent, regime, CAST(NULL AS DOUBLE) AS point, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, count(*) AS n_usable FROM dr GROUP BY ALL UNION ALL SELECT 'p_beats', model, opponent, regime, p, NULL, NULL, n FROM pb UNION ALL SELECT 'p_inversion', NULL, NULL, NULL, avg(CASE WHEN rho < 0 THEN 1.0 WHEN rho IS NOT NULL THEN 0.0 END), quantile_cont(rho, 0.025), quantile_cont(rho, 0.975), count(rho) FROM rh) SELECT statistic, model, opponent, regime, {_r('point', 'point')}, {_r('lo', 'lo')}, {_r('hi', 'hi')}, n_usable FROM al")
def bootstrap_report(spark, sf):
    """All statistics of one resampling in a long table. The draws, a few rows a resample, are cached for their three readers."""
    draws = bs.resample(flows.labelled(spark, sf), BOOT).cache()
    parts = {"mean": bs.intervals(draws), "p_beats": bs.win_shares(draws).withColumnRenamed("p_beats", "point"), "p_inversion": bs.inversion(draws).withColumnRenamed("p_inversion", "point")}
    return bs.assemble([p.select(F.lit(k).alias("statistic"), "*") for k, p in parts.items()]).select("statistic", "model", "opponent", "regime", "point", "lo", "hi", "n_usable")


@register("unverified_windows", f"SELECT count(*) AS n, count(*) AS n_unverified, string_agg(id, ', ' ORDER BY id) AS names FROM ({_windows(flows.DECLARED)})")
def unverified_windows(spark, sf):
    return wd.unverified(wd.window_table(spark, flows.DECLARED))


@register("series_and_windows", _flow() + "SELECT s.series_id, s.month, s.y, win.id AS shock_window FROM s LEFT JOIN win ON s.month BETWEEN win.start_month AND win.end_month")
def series_and_windows(spark, sf):
    return report.series_and_windows(flows.lineitem_series(spark, sf), wd.month_labels(wd.window_table(spark, flows.DECLARED)))


@register("rank_pairs", _flow() + BOARD.format(by="", src="lab") + f"SELECT model, {_r('clean', 'clean')}, {_r('shock', 'shock')}, clean_rank, shock_rank FROM b")
def rank_pairs(spark, sf):
    return report.rank_pairs(flows.labelled(spark, sf))


@register("shared_months", _flow("l_returnflag") + ", ot AS (SELECT series_id, month, y + CASE WHEN month(month) = 5 THEN 1 ELSE 0 END AS y FROM s) SELECT s.series_id, s.month, s.y, ot.y AS other FROM s JOIN ot USING (series_id, month) WHERE s.y <> ot.y")
def shared_months(spark, sf):
    s = flows.lineitem_series(spark, sf, "l_returnflag")
    return sr.disagreements(s, s.withColumn("y", F.col("y") + F.when(F.month("month") == 5, 1).otherwise(0)))


@register("rounded_totals", _flow() + ", an AS (SELECT year(month) AS year, CAST(sum(y) AS BIGINT) * 997 AS total FROM s GROUP BY 1), sm AS (SELECT year, CAST(total / 100000 AS BIGINT) AS lakh FROM an) SELECT CAST(year AS INTEGER) AS year, total, lakh FROM an JOIN sm USING (year) WHERE abs(total - lakh * 100000) > 1000")
def rounded_totals(spark, sf):
    annual = flows.lineitem_series(spark, sf).groupBy(F.year("month").alias("year")).agg((F.sum("y") * 997).alias("total"))
    return sr.rounded_differences(annual, annual.select("year", F.round(F.col("total") / 100_000).cast("long").alias("lakh")))


# Days invented for these tables.
HOLIDAYS = (("feast", dt.date(2001, 12, 30), 3), ("fair", dt.date(2002, 1, 1), 2), ("feast", dt.date(2002, 2, 10), 1), ("fair", dt.date(1999, 1, 5), 4))
RATIOS = (pl.Ratio("guides", 100, "monthly_total", 2), pl.Ratio("beds", 7, "daily_mean"), pl.Ratio("stalls", 5, "festival_day_total", 1))


def holidays(spark: SparkSession) -> DataFrame:
    """(date, festival_id), a row for each day."""
    df = spark.createDataFrame(list(HOLIDAYS), "festival_id string, first date, days int")
    return df.select(F.explode(F.expr("sequence(first, date_add(first, days - 1))")).alias("date"), "festival_id")


FORWARD = ", fp AS (SELECT l.series_id, CAST(l.month + to_months(CAST(h.h AS INTEGER)) AS DATE) AS month, CAST(h.h AS INTEGER) AS horizon, l.y + h.h * (l.y - l.first_y) / (l.pos - 1) AS forecast, l.scale FROM o l JOIN (SELECT unnest([1, 2, 3]) AS h) h ON l.pos = l.n)"
LOADED = ", hd AS (SELECT festival_id, CAST(unnest(generate_series(first, first + to_days(CAST(n - 1 AS INTEGER)), INTERVAL 1 DAY)) AS DATE) AS date FROM (VALUES " + ", ".join(f"('{f}', DATE '{d}', {n})" for f, d, n in HOLIDAYS) + ") v(festival_id, first, n)), hm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS k, string_agg(strftime(date, '%Y-%m-%d'), '; ' ORDER BY date) AS dates, string_agg(DISTINCT festival_id, '; ' ORDER BY festival_id) AS names FROM hd GROUP BY 1), fl AS (SELECT fp.*, coalesce(k, 0) AS k, coalesce(dates, '') AS dates, coalesce(names, '') AS names, forecast / day(last_day(fp.month)) AS daily FROM fp LEFT JOIN hm ON hm.month = fp.month)"


@register("forward_forecast", _flow("l_returnflag") + FORWARD + f"SELECT series_id, month, horizon, {_r('forecast', 'forecast')}, {_r('scale', 'scale')} FROM fp")
def forward_forecast(spark, sf):
    return pl.forward(flows.lineitem_series(spark, sf, "l_returnflag"), flows.CONFIG, "drift")


@register("planning_needs", _flow() + FORWARD + LOADED + f"SELECT series_id, month, horizon, {_r('forecast', 'forecast')}, {_r('daily', 'daily_mean')}, k AS festival_days, dates AS festival_dates, names AS festivals, {_r('daily * k', 'festival_day_load')}, CAST(greatest(2, ceil(forecast / 100.0)) AS BIGINT) AS need_guides, CAST(greatest(0, ceil(daily / 7.0)) AS BIGINT) AS need_beds, CAST(greatest(1, ceil(daily * k / 5.0)) AS BIGINT) AS need_stalls FROM fl")
def planning_needs(spark, sf):
    plan = pl.planning_table(pl.forward(flows.lineitem_series(spark, sf), flows.CONFIG, "drift"), pl.error_bands(flows.labelled(spark, sf)), "drift")
    needed = pl.with_needs(pl.with_festivals(plan, holidays(spark)), RATIOS)
    return needed.drop("lo", "hi", "shock_lo", "shock_hi", "days_in_month")


@register("forward_fitted")
def forward_fitted(spark, sf):
    """Forecasts past the end by a fitted forecaster with calendar features."""
    return pl.forward(flows.lineitem_series(spark, sf), pn.PanelConfig(48, (1, 2, 3)), "sarimax_cal", ls.features(spark, *SPAN), ["festival_days", "lunar_drift_days"])


@register("panel_rectangularity", _flow() + ", cut AS (SELECT * FROM sc WHERE NOT (model = 'drift' AND month(origin) = 5 AND horizon = 2)) SELECT model, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT origin, horizon FROM cut)) - count(*) AS missing FROM cut GROUP BY model HAVING count(*) <> (SELECT count(*) FROM (SELECT DISTINCT origin, horizon FROM cut))")
def panel_rectangularity(spark, sf):
    return pn.ragged(flows.panel(spark, sf).where("NOT (model = 'drift' AND month(origin) = 5 AND horizon = 2)"))


@register("window_overlaps", "WITH w AS (" + _windows(flows.DECLARED, "d") + " UNION ALL " + _windows(flows.REFINED, "r") + "), k AS (SELECT concat(arm, id) AS id, start_month, end_month FROM w), n AS (SELECT id, end_month, lead(id) OVER (ORDER BY start_month, id) AS next_id, lead(start_month) OVER (ORDER BY start_month, id) AS next_start FROM k) SELECT id, next_id FROM n WHERE next_start <= end_month")
def window_overlaps(spark, sf):
    both = wd.window_table(spark, flows.DECLARED, "d").unionByName(wd.window_table(spark, flows.REFINED, "r"))
    return wd.overlaps(both.withColumn("id", F.concat("arm", "id")))


@register("year_on_year", _flow() + f"SELECT series_id, month, {_r('y / lag(y, 12) OVER (PARTITION BY series_id ORDER BY month)', 'ratio')}, {_r('y / avg(y) OVER (PARTITION BY series_id, month(month))', 'of_month')} FROM s")
def year_on_year(spark, sf):
    from pyspark.sql import Window

    s = flows.lineitem_series(spark, sf)
    w = Window.partitionBy("series_id").orderBy("month")
    return s.select("series_id", "month", (F.col("y") / F.lag("y", 12).over(w)).alias("ratio"), (F.col("y") / F.avg("y").over(Window.partitionBy("series_id", F.month("month")))).alias("of_month"))


@register("unit_scaling", "SELECT p_partkey, CAST(CASE WHEN CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(28,9)) * 100000 = round(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(28,9)) * 100000, 0) THEN CAST(p_retailprice AS DECIMAL(18,2)) * 100000 END AS BIGINT) AS whole FROM part")
def unit_scaling(spark, sf):
    text = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return sr.read_table(spark, sf, "part").select("p_partkey", mt.scale_unit(text, "lakh").alias("whole"))


@register("months_touched", _flow("l_returnflag") + "SELECT series_id, count(*) FILTER (y <> 0) AS touched, count(*) AS n, bool_or(y <> 0) AS live FROM s GROUP BY 1")
def months_touched(spark, sf):
    return flows.lineitem_series(spark, sf, "l_returnflag").groupBy("series_id").agg(F.count_if(F.col("y") != 0).alias("touched"), F.count("*").alias("n"), F.bool_or(F.col("y") != 0).alias("live"))


@register("html_links", "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS BIGINT) AS n_links, CAST(len(regexp_extract_all(html, '(?i)<(td|th)[\\s>]')) AS BIGINT) AS n_cells FROM pages")
def html_links(spark, sf):
    return html.tag_counts(sr.read_table(spark, sf, "pages"))


@register("html_tables")
def html_tables(spark, sf):
    return html.table_cells(sr.read_table(spark, sf, "pages"))


@register("ingest_profile", "SELECT 'c_custkey' AS column, CAST(count(c_custkey) AS BIGINT) AS n, CAST(count(DISTINCT c_custkey) AS BIGINT) AS n_distinct, min(CAST(c_custkey AS VARCHAR)) AS least, max(CAST(c_custkey AS VARCHAR)) AS most FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment), count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer")
def ingest_profile(spark, sf):
    return ingest.profile(sr.read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))


@register("rolled_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rolled_counts(spark, sf):
    return sr.read_table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


SPAN = (dt.date(1995, 1, 1), dt.date(2002, 12, 31))


def _kernels(spark, sf, models, **more):
    config = pn.PanelConfig(horizons=(1, 2, 3))
    return kn.kernel_panel(flows.lineitem_series(spark, sf), config, models, **more)


for _name in ("theta", "holt_winters_add", "holt_winters_mul", "sarima", "switching", "switching_sticky"):

    @register(_name)
    def kernel(spark, sf, name=_name):
        return _kernels(spark, sf, [name])


@register("sarimax_cal")
def sarimax_cal(spark, sf):
    return _kernels(spark, sf, ["sarimax_cal"], calendar=ls.features(spark, *SPAN), features=["festival_days", "lunar_drift_days"])


@register("full_registry_leaderboard")
def full_registry_leaderboard(spark, sf):
    """All forecasters on one rectangular panel, by regime."""
    config = pn.PanelConfig(min_train=38, horizons=(1, 2, 3))  # the least that every forecaster can be fitted to
    s = flows.lineitem_series(spark, sf)
    fitted = kn.kernel_panel(s, config, kn.KERNELS, calendar=ls.features(spark, *SPAN), features=["festival_days", "lunar_drift_days"]).drop("reason")
    closed = pn.closed_forms(pn.origins(s, config), config, flows.MODELS)
    return lb.per_regime(wd.label(pn.score(closed.unionByName(fitted)), wd.window_table(spark, flows.DECLARED)))


@register("applicability")
def applicability(spark, sf):
    return kn.applicability(_kernels(spark, sf, ["holt_winters_mul", "sarima", "theta"]))


def _year_scores(series: DataFrame) -> DataFrame:
    """Seasonal differences less their median, in units of 1.4826 times their median absolute deviation; 0 below the floor."""
    from pyspark.sql import Window

    w = Window.partitionBy("series_id")
    d = series.withColumn("d", (F.col("y") - F.lag("y", 12).over(w.orderBy("month"))).cast("double")).withColumn("floor", 1e-4 * F.greatest(F.median(F.abs("y")).over(w), F.lit(1.0)))
    c = d.where("d is not null").withColumn("c", F.median("d").over(w))
    m = c.withColumn("m", F.lit(1.4826) * F.median(F.abs(F.col("d") - F.col("c"))).over(w))
    return m.select("series_id", "month", F.when(F.col("m") <= F.col("floor"), F.lit(0.0)).otherwise((F.col("d") - F.col("c")) / F.nullif("m", F.lit(0.0))).alias("score"))


SCORES = """
, sd AS (
  SELECT *, 1e-4 * greatest(median(abs(y)) OVER (PARTITION BY series_id), 1.0) AS least
  FROM (SELECT series_id, month, y, CAST(y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY month) AS DOUBLE) AS d FROM s)
),
sm AS (SELECT *, median(d) OVER (PARTITION BY series_id) AS c FROM sd WHERE d IS NOT NULL),
sq AS (SELECT *, 1.4826 * median(abs(d - c)) OVER (PARTITION BY series_id) AS m FROM sm),
ss AS (SELECT series_id, month, CASE WHEN m <= least THEN 0.0 ELSE (d - c) / nullif(m, 0.0) END AS score FROM sq)
"""


@register("seasonal_difference_scores", _flow("l_returnflag") + SCORES + f"SELECT series_id, month, {_r('score', 'score')} FROM ss")
def seasonal_difference_scores(spark, sf):
    """A score that needs no fit; ``surprise_scores`` is the one that the switching forecasters use."""
    return _year_scores(flows.lineitem_series(spark, sf, "l_returnflag"))


@register("seasonal_difference_state", _flow("l_returnflag").replace("WITH m0", "WITH RECURSIVE m0") + SCORES + """
, nb AS (SELECT series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY month) AS k, count(*) OVER (PARTITION BY series_id) AS n FROM ss),
st AS (
  SELECT series_id, CAST(0 AS BIGINT) AS k, false AS shock, 0 AS held FROM nb WHERE k = 1
  UNION ALL
  SELECT nb.series_id, nb.k, CASE WHEN st.shock THEN NOT (st.held + 1 >= 6 AND nb.score > -1.0) ELSE nb.score < -2.5 OR nb.score > 15.0 END,
    CASE WHEN st.shock THEN st.held + 1 ELSE 0 END
  FROM st JOIN nb ON nb.series_id = st.series_id AND nb.k = st.k + 1
)
SELECT st.series_id, shock AS in_shock FROM st JOIN nb ON nb.series_id = st.series_id AND nb.k = st.k AND nb.k = nb.n""")
def seasonal_difference_state(spark, sf):
    return kn.detector(_year_scores(flows.lineitem_series(spark, sf, "l_returnflag")), 6)


@register("surprise_scores")
def surprise_scores(spark, sf):
    return kn.surprise_scores(flows.lineitem_series(spark, sf, "l_returnflag"))


@register("shock_state_fsm")
def shock_state_fsm(spark, sf):
    return kn.detector(kn.surprise_scores(flows.lineitem_series(spark, sf, "l_returnflag")), 6)


@register("festival_days")
def festival_days(spark, sf):
    return ls.occurrence_days(spark, *SPAN)


@register("calendar_features")
def calendar_features(spark, sf):
    return ls.features(spark, *SPAN)


@register("daily_means", _flow() + "SELECT series_id, month, y, CAST(day(last_day(month)) AS INTEGER) AS days_in_month, round(y / day(last_day(month)), 6) AS daily_mean FROM s")
def daily_means(spark, sf):
    s = flows.lineitem_series(spark, sf)
    return s.select("series_id", "month", "y", mt.days_in_month(F.col("month")).alias("days_in_month"), (F.col("y") / mt.days_in_month(F.col("month"))).alias("daily_mean"))


@register("horizon_profile", _flow() + f"SELECT model, regime, horizon, {_r('avg(mase)', 'score')} FROM lab GROUP BY ALL")
def horizon_profile(spark, sf):
    return report.horizon_profile(flows.labelled(spark, sf))


@register("forecast_and_actual", _flow() + "SELECT series_id, target, actual, model, round(predicted, 6) AS predicted, regime FROM lab WHERE horizon = 1")
def forecast_and_actual(spark, sf):
    return report.forecast_and_actual(flows.labelled(spark, sf))


@register("events_by_hour", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark, sf):
    e = sr.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.tumbling(e).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@register("user_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY user_id, k")
def user_sessions(spark, sf):
    e = sr.read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.sessions(e).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
