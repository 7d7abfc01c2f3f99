"""Queries on the predictions table: metrics, thresholds, bands, drift, blends and gates, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import scalars as s
from barloom.operators import losses, policies, ranks, reports
from barloom.operators import metrics as m
from barloom.operators.asof import asof
from barloom.plans.bar_queries import r, rs
from barloom.plans.tables import USED, bars, bars_cte, preds, preds_cte

R = s.rounded
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ALL = ("control", "alpha", "beta")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P = f"WITH {preds_cte()}"
P3 = f"WITH {preds_cte(ALL)}"
KEYS = ["profile", "fold"]


def test_rows(spark, d, profiles=("control",), only=None):
    return preds(spark, d, profiles, only).where("split = 'test'")


RANKS = """, t AS (SELECT * FROM preds WHERE split = 'test'),
k AS (SELECT *, rank() OVER (PARTITION BY profile, fold ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, fold, prob_long) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY profile, fold ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, fold, forward_return) - 1) / 2 AS ry FROM t),
ic AS (SELECT profile, fold, CASE WHEN count(*) >= 3 THEN coalesce(corr(rx, ry), 0) ELSE 0 END AS rank_ic, count(*) AS n FROM k GROUP BY ALL)"""


@query("a08_rank_ic", P3 + RANKS + f" SELECT profile, fold, n, {r('rank_ic', 'rank_ic')} FROM ic")
def _(spark, d):
    return m.rank_ic(test_rows(spark, d, ALL), KEYS).select("profile", "fold", "n", *rs("rank_ic"))


F1 = """count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


F1_COLS = f"tp, fp, fn, tn, {r(ratio('tp', 'tp + fp'), 'precision')}, {r(ratio('tp', 'tp + fn'), 'recall')}, {r(ratio('2 * tp', '2 * tp + fp + fn'), 'f1')}, {r(ratio('tp + fp', 'tp + fp + fn + tn'), 'pred_rate')}"


@query("a09_f1_at_threshold", P3 + f", q AS (SELECT profile, fold, split, {F1} FROM (SELECT *, prob_long >= 0.5 AS p, label = 1 AS y FROM preds) GROUP BY ALL) SELECT profile, fold, split, {F1_COLS} FROM q")
def _(spark, d):
    agg = m.at_threshold("prob_long", "label", F.lit(0.5))
    return preds(spark, d, ALL).groupBy("profile", "fold", "split").agg(*[x.alias(k) if k in ("tp", "fp", "fn", "tn") else R(x).alias(k) for k, x in agg.items()])


STEPS = """, s0 AS (SELECT profile, fold, split, prob_long AS threshold, count(*) AS n, sum(label) AS pos FROM preds GROUP BY ALL),
st AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cpos, sum(n) OVER (PARTITION BY profile, fold, split) AS all_n, sum(pos) OVER (PARTITION BY profile, fold, split) AS all_pos FROM s0
  WINDOW w AS (PARTITION BY profile, fold, split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""
BY = ["profile", "fold", "split"]


@query("a10_average_precision", P3 + STEPS + f" SELECT profile, fold, split, {r('CASE WHEN max(all_pos) = max(all_n) THEN 0 ELSE sum(pos / all_pos * cpos / cn) END', 'average_precision')} FROM st WHERE all_pos > 0 GROUP BY ALL")
def _(spark, d):
    return m.average_precision(preds(spark, d, ALL), BY).select(*BY, *rs("average_precision"))


@query("d10_best_f1_threshold", P3 + STEPS + f", b AS (SELECT *, round(2 * cpos / (cn + all_pos), 12) AS f1 FROM st) SELECT profile, fold, split, threshold, {r('f1', 'f1')} FROM b QUALIFY row_number() OVER (PARTITION BY profile, fold, split ORDER BY f1 DESC, threshold) = 1")
def _(spark, d):
    return m.best_f1(preds(spark, d, ALL), BY).select(*BY, "threshold", *rs("f1"))


CONSTRAINED = STEPS + """, b AS (SELECT *, round(2 * cpos / (cn + all_pos), 12) AS f1, round(cpos / cn, 12) AS precision, cn / all_n AS rate FROM st),
plain AS (SELECT profile, fold, split, threshold, f1 FROM b QUALIFY row_number() OVER (PARTITION BY profile, fold, split ORDER BY f1 DESC, threshold) = 1),
con AS (SELECT profile, fold, split, threshold, f1 FROM b WHERE rate <= 0.35 AND precision >= 0.25 QUALIFY row_number() OVER (PARTITION BY profile, fold, split ORDER BY f1 DESC, precision DESC, rate, threshold DESC) = 1),
chosen AS (SELECT p.profile, p.fold, p.split, coalesce(c.threshold, p.threshold) AS threshold, coalesce(c.f1, p.f1) AS f1, c.f1 IS NOT NULL AS constrained FROM plain p LEFT JOIN con c USING (profile, fold, split))"""


@query("d11_constrained_threshold", P3 + CONSTRAINED + f" SELECT profile, fold, split, threshold, {r('f1', 'f1')}, constrained, CASE WHEN constrained THEN '' ELSE 'no_threshold_satisfies_pred_rate_precision' END AS reject_reason FROM chosen")
def _(spark, d):
    return m.constrained_f1(preds(spark, d, ALL), BY, 0.35, 0.25).select(*BY, "threshold", *rs("f1"), "constrained", "reject_reason")


TRANSFER = CONSTRAINED + f""", v AS (SELECT profile, fold, threshold, f1 AS val_f1 FROM chosen WHERE split = 'val'),
q AS (SELECT profile, fold, any_value(threshold) AS threshold, any_value(val_f1) AS val_f1, {F1}
  FROM (SELECT t.profile, t.fold, v.threshold, v.val_f1, (t.prob_long >= v.threshold) AS p, (t.label = 1) AS y FROM preds t JOIN v ON t.profile = v.profile AND t.fold = v.fold WHERE t.split = 'test') GROUP BY profile, fold)"""


@query("d12_threshold_transfer", P3 + TRANSFER + f" SELECT profile, fold, threshold, {r('val_f1', 'val_f1')}, {F1_COLS} FROM q")
def _(spark, d):
    t = reports.threshold_transfer(preds(spark, d, ALL), KEYS, 0.35, 0.25)
    return t.select("profile", "fold", "threshold", *rs("val_f1"), "tp", "fp", "fn", "tn", *rs("precision", "recall", "f1", "pred_rate"))


@query("d14_threshold_summary", P3 + TRANSFER + f", u AS (SELECT profile, unnest([{{'metric': 'f1', 'v': {ratio('2 * tp', '2 * tp + fp + fn')}}}, {{'metric': 'precision', 'v': {ratio('tp', 'tp + fp')}}}, {{'metric': 'threshold', 'v': threshold}}]) AS x FROM q) SELECT profile, x.metric AS metric, {r('avg(x.v)', 'mean')}, {r('stddev_pop(x.v)', 'std')}, {r('min(x.v)', 'min')}, {r('quantile_cont(x.v, 0.25)', 'p25')}, {r('quantile_cont(x.v, 0.5)', 'median')}, {r('quantile_cont(x.v, 0.75)', 'p75')}, {r('max(x.v)', 'max')} FROM u GROUP BY ALL")
def _(spark, d):
    t = reports.threshold_transfer(preds(spark, d, ALL), KEYS, 0.35, 0.25)
    x = t.select("profile", F.expr("stack(3, 'f1', f1, 'precision', precision, 'threshold', threshold) as (metric, v)"))
    q = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = x.groupBy("profile", "metric").agg(R(F.avg("v")).alias("mean"), R(F.stddev_pop("v")).alias("std"), R(F.min("v")).alias("min"), q.alias("q"), R(F.max("v")).alias("max"))
    return g.select("profile", "metric", "mean", "std", "min", *[R(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("p25", "median", "p75"))], "max")


@query("a11_regime_confusion", P + f", q AS (SELECT profile, fold, CASE WHEN regime_prob_0 >= greatest(regime_prob_1, regime_prob_2) THEN 0 WHEN regime_prob_1 >= regime_prob_2 THEN 1 ELSE 2 END AS regime, prob_long >= 0.5 AS p, label = 1 AS y FROM preds WHERE split = 'test'), a AS (SELECT profile, fold, regime, {F1} FROM q GROUP BY ALL) SELECT profile, fold, regime, {F1_COLS} FROM a")
def _(spark, d):
    t = test_rows(spark, d).withColumn("regime", m.dominant("regime_prob_", 3))
    agg = m.at_threshold("prob_long", "label", F.lit(0.5))
    return t.groupBy("profile", "fold", "regime").agg(*[x.alias(k) if k in ("tp", "fp", "fn", "tn") else R(x).alias(k) for k, x in agg.items()])


@query("a07_quantiles", P3 + f" SELECT profile, fold, {', '.join(r(f'quantile_cont(prob_long, {q})', f'p{int(q * 100)}') for q in (0.1, 0.25, 0.5, 0.75, 0.9))}, {r('quantile_cont(prob_long, 0.75) - quantile_cont(prob_long, 0.25)', 'iqr')} FROM preds GROUP BY ALL")
def _(spark, d):
    qs = (0.1, 0.25, 0.5, 0.75, 0.9)
    g = preds(spark, d, ALL).groupBy(*KEYS).agg(F.percentile("prob_long", F.array(*[F.lit(q) for q in qs])).alias("q"))
    at = lambda i: F.get("q", F.lit(i))
    return g.select(*KEYS, *[R(at(i)).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)], R(at(3) - at(1)).alias("iqr"))


KS = """, v AS (SELECT profile, fold, prob_long AS x, count(*) FILTER (split = 'val') AS a, count(*) FILTER (split = 'test') AS b FROM preds GROUP BY ALL),
g AS (SELECT profile, fold, abs(sum(a) OVER u / sum(a) OVER (PARTITION BY profile, fold) - sum(b) OVER u / sum(b) OVER (PARTITION BY profile, fold)) AS gap FROM v WINDOW u AS (PARTITION BY profile, fold ORDER BY x ROWS UNBOUNDED PRECEDING))"""


@query("a12_ks_distance", P3 + KS + f" SELECT profile, fold, {r('max(gap)', 'ks')} FROM g GROUP BY ALL")
def _(spark, d):
    return m.ks(preds(spark, d, ALL), KEYS, "prob_long", F.col("split") == "val").select(*KEYS, *rs("ks"))


PSI = """, e AS (SELECT profile, fold, list_sort(list_distinct(quantile_cont(prob_long, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS edges FROM preds WHERE split = 'val' GROUP BY ALL),
n AS (SELECT p.profile, p.fold, len(list_filter(edges, lambda v: v <= prob_long)) AS bin, count(*) FILTER (split = 'val') AS e, count(*) FILTER (split = 'test') AS a FROM preds p JOIN e USING (profile, fold) GROUP BY ALL),
grid AS (SELECT profile, fold, unnest(range(len(edges) + 1)) AS bin FROM e),
f AS (SELECT g.profile, g.fold, greatest(coalesce(n.e, 0) / sum(coalesce(n.e, 0)) OVER w, 1e-6) AS e, greatest(coalesce(n.a, 0) / sum(coalesce(n.a, 0)) OVER w, 1e-6) AS a FROM grid g LEFT JOIN n USING (profile, fold, bin) WINDOW w AS (PARTITION BY g.profile, g.fold))"""


@query("a13_psi", P3 + PSI + f" SELECT profile, fold, {r('sum((a - e) * ln(a / e))', 'psi')} FROM f GROUP BY ALL")
def _(spark, d):
    return m.psi(preds(spark, d, ALL), KEYS, "prob_long", F.col("split") == "val").select(*KEYS, *rs("psi"))


CAL = ", c AS (SELECT profile, fold, greatest(ceil(prob_long * 10) - 1, 0)::INT AS bin, count(*) AS n, avg(prob_long) AS mp, avg(label) AS rate FROM preds WHERE split = 'test' GROUP BY ALL)"


@query("a14_calibration_error", P3 + CAL + f" SELECT profile, fold, {r('sum(abs(mp - rate) * n) / sum(n)', 'ece')}, {r('max(abs(mp - rate))', 'mce')} FROM c GROUP BY ALL")
def _(spark, d):
    return m.calibration_error(test_rows(spark, d, ALL), KEYS).select(*KEYS, *rs("ece", "mce"))


@query("a15_probability_quality", P3 + f", q AS (SELECT *, least(greatest(prob_long, 1e-6), 1 - 1e-6) AS q FROM preds WHERE split = 'test') SELECT profile, fold, {r('avg((prob_long - label) * (prob_long - label))', 'brier')}, {r('avg(-(label * ln(q) + (1 - label) * ln(1 - q)))', 'log_loss')}, {r('avg(-(q * ln(q) + (1 - q) * ln(1 - q)))', 'entropy')}, {r('avg(prob_long * (1 - prob_long))', 'sharpness')}, {r('stddev_pop(prob_long)', 'prob_std')} FROM q GROUP BY ALL")
def _(spark, d):
    return test_rows(spark, d, ALL).groupBy(*KEYS).agg(*[R(x).alias(k) for k, x in m.probability_quality().items()])


QCUT = "CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((rn - 1) * least(10, n) / (n - 1)) - 1, 0) END::INT"
BINNED = f", r0 AS (SELECT *, row_number() OVER (PARTITION BY profile, fold ORDER BY prob_long, row_pos) AS rn, count(*) OVER (PARTITION BY profile, fold) AS n FROM preds WHERE split = 'test'), binned AS (SELECT *, {QCUT} AS bin FROM r0)"


@query("d03_calibration_table", P3 + BINNED + f" SELECT profile, fold, bin, count(*) AS n, {r('avg(prob_long)', 'mean_prob')}, {r('avg(label)', 'rate')} FROM binned GROUP BY ALL")
def _(spark, d):
    return m.calibration_table(test_rows(spark, d, ALL), KEYS).select(*KEYS, "bin", "n", *rs("mean_prob", "rate"))


@query("a14_equal_count_error", P3 + BINNED + f", c AS (SELECT profile, fold, bin, count(*) AS n, avg(prob_long) AS mp, avg(label) AS rate FROM binned GROUP BY ALL) SELECT profile, fold, {r('sum(abs(mp - rate) * n) / sum(n)', 'ece')}, {r('max(abs(mp - rate))', 'mce')} FROM c GROUP BY ALL")
def _(spark, d):
    return m.calibration_error(test_rows(spark, d, ALL), KEYS, equal_count=True).select(*KEYS, *rs("ece", "mce"))


@query("w09_quantile_bins", P3 + BINNED + f" SELECT profile, fold, bin, count(*) AS n, {r('avg(prob_long)', 'mean_prob')}, {r('avg(label)', 'rate')} FROM binned GROUP BY ALL")
def _(spark, d):
    b = ranks.quantile_bin(test_rows(spark, d, ALL), [F.col("prob_long"), F.col("row_pos")], 10, KEYS)
    return b.groupBy(*KEYS, "bin").agg(F.count("*").alias("n"), R(F.avg("prob_long")).alias("mean_prob"), R(F.avg("label")).alias("rate"))


@query("d07_score_lift", P3 + BINNED + f", b AS (SELECT profile, fold, avg(label) AS base FROM binned GROUP BY ALL) SELECT profile, fold, bin, count(*) AS n, {r('avg(label)', 'rate')}, {r('avg(label) / any_value(base)', 'lift')}, {r('avg(forward_return)', 'mean_return')}, bin = 9 AS is_top FROM binned JOIN b USING (profile, fold) GROUP BY ALL")
def _(spark, d):
    return reports.score_lift(test_rows(spark, d, ALL), KEYS).select(*KEYS, "bin", "n", *rs("rate", "lift", "mean_return"), "is_top")


BAND_LIST = [("top_10", 9, 9), ("top_30", 7, 9), ("mid", 3, 6), ("bottom_30", 0, 2)]
BANDS = BINNED + ", bands(band, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in BAND_LIST) + f"""), base AS (SELECT profile, fold, avg(label) AS base, sum(label) AS positives FROM binned GROUP BY ALL),
bs AS (SELECT profile, fold, band, count(*) AS n, avg(label) AS precision, sum(label) / any_value(positives) AS recall, avg(label) / any_value(base) AS lift, avg(forward_return) AS mean_return FROM binned JOIN bands ON bin BETWEEN lo AND hi JOIN base USING (profile, fold) GROUP BY ALL)"""


@query("d08_score_bands", P3 + BANDS + f" SELECT profile, fold, band, n, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('lift', 'lift')}, {r('mean_return', 'mean_return')} FROM bs")
def _(spark, d):
    return reports.score_bands(test_rows(spark, d, ALL), KEYS, BAND_LIST).select(*KEYS, "band", "n", *rs("precision", "recall", "lift", "mean_return"))


@query("d08_band_summary", P3 + BANDS + f" SELECT profile, band, count(*) AS folds, {r('avg(lift)', 'mean_lift')}, {r('avg(coalesce(round(lift, 12) > 1, false)::INT)', 'lift_above_one')}, {r('avg(coalesce(round(mean_return, 12) > 0, false)::INT)', 'return_positive')}, {r('min(precision)', 'worst_precision')} FROM bs GROUP BY ALL")
def _(spark, d):
    b = reports.score_bands(test_rows(spark, d, ALL), KEYS, BAND_LIST)
    return b.groupBy("profile", "band").agg(F.count("*").alias("folds"), R(F.avg("lift")).alias("mean_lift"), R(F.avg(policies.above(F.col("lift"), 1.0))).alias("lift_above_one"), R(F.avg(policies.above(F.col("mean_return"), 0.0))).alias("return_positive"), R(F.min("precision")).alias("worst_precision"))


FT = RANKS + STEPS + """, ap AS (SELECT profile, fold, CASE WHEN max(all_pos) = max(all_n) THEN 0 ELSE sum(pos / all_pos * cpos / cn) END AS prauc FROM st WHERE all_pos > 0 AND split = 'test' GROUP BY ALL),
f0 AS (SELECT profile, fold, avg(label) AS label_rate, avg(prob_long) AS mean_prob, stddev_pop(prob_long) AS prob_std, avg(forward_return) AS mean_return, stddev_pop(forward_return) AS return_std, min(ts) AS first_ts, max(ts) AS last_ts, avg((prob_long >= 0.5)::INT) AS pred_rate, quantile_cont(prob_long, 0.1) AS prob_p10, quantile_cont(prob_long, 0.5) AS prob_p50, quantile_cont(prob_long, 0.9) AS prob_p90,
  coalesce(2 * count(*) FILTER (prob_long >= 0.5 AND label = 1) / nullif(2 * count(*) FILTER (prob_long >= 0.5 AND label = 1) + count(*) FILTER (prob_long >= 0.5 AND label = 0) + count(*) FILTER (prob_long < 0.5 AND label = 1), 0), 0) AS long_f1 FROM t GROUP BY ALL),
ft AS (SELECT f0.*, ic.rank_ic, ic.n, coalesce(ap.prauc, 0) AS prauc FROM f0 JOIN ic USING (profile, fold) LEFT JOIN ap USING (profile, fold))"""
FT_COLUMNS = ["rank_ic", "long_f1", "prauc", "label_rate", "pred_rate", "mean_prob", "prob_std", "prob_p10", "prob_p50", "prob_p90", "mean_return", "return_std"]


@query("d04_fold_diagnostics", P3 + FT + f" SELECT profile, fold, n, first_ts, last_ts, {', '.join(r(c, c) for c in FT_COLUMNS)} FROM ft")
def _(spark, d):
    return reports.fold_table(test_rows(spark, d, ALL, USED), KEYS).select(*KEYS, "n", "first_ts", "last_ts", *rs(*FT_COLUMNS))


@query("d05_recent_folds", P3 + FT + ", k2 AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY fold DESC) AS back FROM ft), u AS (SELECT profile, fold, back, unnest([" + ", ".join(f"{{'metric': '{c}', 'v': {c}::DOUBLE}}" for c in reports.FOLD_METRICS) + f"]) AS x FROM k2) SELECT profile, x.metric AS metric, {r('avg(x.v)', 'all_mean')}, {r('avg(x.v) FILTER (back <= 5)', 'recent_mean')}, {r('avg(x.v) FILTER (back <= 5) - avg(x.v)', 'recent_minus_all')}, {r('min(x.v) FILTER (back <= 5)', 'recent_min')}, {r('max(x.v) FILTER (back <= 5)', 'recent_max')}, string_agg(fold::VARCHAR, ',' ORDER BY fold) FILTER (back <= 5) AS recent_folds FROM u GROUP BY ALL")
def _(spark, d):
    x = reports.recent_folds(reports.fold_table(test_rows(spark, d, ALL, USED), KEYS))
    return x.select("profile", "metric", *rs("all_mean", "recent_mean", "recent_minus_all", "recent_min", "recent_max"), "recent_folds")


#: The random scores of the test tables have rank correlations near zero; the operators' own bounds are 0.10 and -0.08.
GOOD, BAD = 0.01, -0.01
FOLDS_OF = ", ".join(f"coalesce(string_agg(fold::VARCHAR, ',' ORDER BY fold) FILTER ({cond}), '') AS {k}_folds, count(*) FILTER ({cond}) AS {k}_fold_count" for k, cond in (("good", f"rank_ic >= {GOOD}"), ("bad", f"rank_ic <= {BAD}")))


@query("d06_good_bad_folds", P3 + RANKS + f" SELECT profile, {FOLDS_OF} FROM ic GROUP BY profile")
def _(spark, d):
    return reports.good_bad_summary(m.rank_ic(test_rows(spark, d, ALL), KEYS), GOOD, BAD)


@query("d01_phase_report", P3 + FT + f""", g AS (SELECT profile, count(*) AS folds, avg(rank_ic) AS mi, stddev_pop(rank_ic) AS si, avg((rank_ic > 0)::INT) AS pf, avg(long_f1) AS mf, avg(prauc) AS mp FROM ft GROUP BY profile),
sp AS (SELECT profile, avg(prob_long) FILTER (label = 1) - avg(prob_long) FILTER (label = 0) AS sep FROM t GROUP BY profile)
SELECT profile, folds, {r('mi', 'mean_ic')}, {r('si', 'std_ic')}, {r('pf', 'positive_fraction')}, {r('mf', 'mean_f1')}, {r('mp', 'mean_prauc')}, {r('sep', 'separation')}, mi > 0.03 AS ic_ok, si < 0.03 AS std_ok, pf > 0.75 AS positive_ok, mf > 0.45 AS f1_ok, sep > 0 AS separation_ok, mi > 0.03 AND si < 0.03 AND pf > 0.75 AND mf > 0.45 AND sep > 0 AS passed, concat_ws(';', CASE WHEN abs(mi) <= 0.01 THEN 'rank_ic_near_random' END, CASE WHEN mi >= 0.2 THEN 'rank_ic_suspiciously_high' END) AS alerts FROM g JOIN sp USING (profile)""")
def _(spark, d):
    x = reports.phase_report(test_rows(spark, d, ALL, USED))
    return x.select("profile", "folds", *rs("mean_ic", "std_ic", "positive_fraction", "mean_f1", "mean_prauc", "separation"), "ic_ok", "std_ok", "positive_ok", "f1_ok", "separation_ok", "passed", "alerts")


@query("a17_tail_means", P3 + RANKS + f", k2 AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rank_ic, fold) AS up, count(*) OVER (PARTITION BY profile) AS folds FROM ic) SELECT profile, {r('avg(rank_ic) FILTER (up <= 3)', 'worst_3')}, {r('avg(rank_ic) FILTER (up <= ceil(0.2 * folds))', 'cvar_20')}, count(*) FILTER (rank_ic < 0) AS negative, {r('avg((rank_ic < 0)::INT)', 'negative_fraction')} FROM k2 GROUP BY profile")
def _(spark, d):
    return reports.tails(m.rank_ic(test_rows(spark, d, ALL), KEYS), 3).select("profile", *rs("worst_3", "cvar_20"), "negative", *rs("negative_fraction"))


@query("d16_regime_table", P3 + f", q AS (SELECT *, CASE WHEN regime_prob_0 >= greatest(regime_prob_1, regime_prob_2) THEN 0 WHEN regime_prob_1 >= regime_prob_2 THEN 1 ELSE 2 END AS regime FROM preds WHERE split = 'test') SELECT profile, regime, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY profile)', 'share')}, {r('avg(label)', 'label_rate')}, {r('avg(forward_return)', 'mean_return')} FROM q GROUP BY profile, regime")
def _(spark, d):
    g = test_rows(spark, d, ALL).withColumn("regime", m.dominant("regime_prob_", 3)).groupBy("profile", "regime").agg(F.count("*").alias("n"), F.avg("label").alias("label_rate"), F.avg("forward_return").alias("mean_return"))
    return g.select("profile", "regime", "n", R(F.col("n") / F.sum("n").over(Window.partitionBy("profile"))).alias("share"), *rs("label_rate", "mean_return"))


FORENSICS = RANKS + """, u AS (SELECT profile, fold, unnest([{'feature': 'f_quantity', 'v': f_quantity}, {'feature': 'f_price', 'v': f_price}, {'feature': '4h_tax', 'v': "4h_tax"}]) AS x, forward_return FROM t),
uk AS (SELECT profile, fold, x.feature AS feature, x.v AS v, rank() OVER (PARTITION BY profile, fold, x.feature ORDER BY x.v) + (count(*) OVER (PARTITION BY profile, fold, x.feature, x.v) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY profile, fold, x.feature ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, fold, x.feature, forward_return) - 1) / 2 AS ry FROM u),
fi AS (SELECT profile, fold, feature, coalesce(corr(rx, ry), 0) AS feature_ic, avg(v) AS mean_v, stddev_pop(v) AS std_v FROM uk GROUP BY ALL)"""


COHORTS = RANKS + f""", q AS (SELECT profile, fold, rank_ic, CASE WHEN rank_ic >= {GOOD} THEN 'good' WHEN rank_ic <= {BAD} THEN 'bad' ELSE 'neutral' END AS quality FROM ic),
co AS (SELECT t.*, quality, CASE WHEN quality = 'bad' THEN t.fold END AS cohort FROM t JOIN q USING (profile, fold) WHERE quality <> 'neutral'),
cu AS (SELECT profile, fold, quality, cohort, unnest([{{'feature': 'f_quantity', 'v': f_quantity}}, {{'feature': 'f_price', 'v': f_price}}, {{'feature': '4h_tax', 'v': "4h_tax"}}]) AS x, forward_return FROM co),
ck AS (SELECT profile, cohort, x.feature AS feature, x.v AS v, rank() OVER (PARTITION BY profile, cohort, x.feature ORDER BY x.v) + (count(*) OVER (PARTITION BY profile, cohort, x.feature, x.v) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY profile, cohort, x.feature ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, cohort, x.feature, forward_return) - 1) / 2 AS ry FROM cu),
ci AS (SELECT profile, cohort, feature, coalesce(corr(rx, ry), 0) AS ic_, avg(v) AS mv, var_pop(v) AS vv, count(*) AS n FROM ck GROUP BY ALL HAVING count(*) >= 3),
ff AS (SELECT b.profile, b.cohort AS bad_fold, q.rank_ic AS bad_fold_rank_ic, b.feature, CASE WHEN b.feature[1:3] = '4h_' THEN '4h' ELSE '1h' END AS timeframe, 'other' AS family, g.ic_ AS good_ic, b.ic_ AS bad_ic, b.ic_ - g.ic_ AS delta,
  abs(g.ic_) >= 0.02 AND abs(b.ic_) >= 0.02 AND sign(g.ic_) <> sign(b.ic_) AS reversal, g.mv AS good_mean, b.mv AS bad_mean, b.mv - g.mv AS gap,
  coalesce(abs(b.mv - g.mv) / nullif(sqrt((b.n * b.vv + g.n * g.vv) / (b.n + g.n) + b.n * g.n * (b.mv - g.mv) * (b.mv - g.mv) / ((b.n + g.n) * (b.n + g.n))), 0), 0) AS shift
  FROM ci b JOIN q ON q.profile = b.profile AND q.fold = b.cohort JOIN ci g ON g.profile = b.profile AND g.feature = b.feature AND g.cohort IS NULL WHERE b.cohort IS NOT NULL)"""
FEATURES = ["f_quantity", "f_price", "4h_tax"]


def forensics(spark, d):
    return reports.feature_forensics(test_rows(spark, d, ALL, (*USED, *FEATURES)), FEATURES, GOOD, BAD)


@query("d17_feature_forensics", P3 + COHORTS + f" SELECT profile, bad_fold, {r('bad_fold_rank_ic', 'bad_fold_rank_ic')}, feature, timeframe, family, {r('good_ic', 'good_feature_ic')}, {r('bad_ic', 'bad_feature_ic')}, {r('delta', 'delta_ic')}, reversal AS signal_reversal, {r('good_mean', 'good_mean')}, {r('bad_mean', 'bad_mean')}, {r('gap', 'mean_diff')}, {r('shift', 'abs_standardized_diff')} FROM ff")
def _(spark, d):
    return forensics(spark, d).select("profile", "bad_fold", *rs("bad_fold_rank_ic"), "feature", "timeframe", "family", *rs("good_feature_ic", "bad_feature_ic", "delta_ic"), "signal_reversal", *rs("good_mean", "bad_mean", "mean_diff", "abs_standardized_diff"))


WATCH = "count(DISTINCT bad_fold) >= {n} AND ({rev} >= {least_rev} OR {d} >= {least_d})"


@query("d17_forensics_watchlist", P3 + COHORTS + f" SELECT profile, feature, timeframe, family, count(DISTINCT bad_fold) AS bad_fold_count, string_agg(bad_fold::VARCHAR, ',' ORDER BY bad_fold) AS bad_folds, {r('avg(delta)', 'mean_delta_ic')}, {r('avg(abs(delta))', 'mean_abs_delta_ic')}, {r('avg(reversal::INT)', 'signal_reversal_rate')}, {r('avg(shift)', 'mean_abs_standardized_diff')}, CASE WHEN {WATCH.format(n=2, rev='avg(reversal::INT)', least_rev=0.34, d='avg(abs(delta))', least_d=0.05)} THEN 'ablate_or_bound' ELSE 'monitor' END AS recommended_action FROM ff GROUP BY profile, feature, timeframe, family")
def _(spark, d):
    g = reports.forensics_watchlist(forensics(spark, d), ["feature", "timeframe", "family"], 2, 0.34, 0.05, "ablate_or_bound")
    return g.select("profile", "feature", "timeframe", "family", "bad_fold_count", "bad_folds", *rs("mean_delta_ic", "mean_abs_delta_ic", "signal_reversal_rate", "mean_abs_standardized_diff"), "recommended_action")


def tops(by: str, name: str) -> str:
    return f"array_to_string((list(feature ORDER BY round({by}, 9) DESC, feature))[1:5], ',') AS {name}"


GROUPED = COHORTS + f", gf AS (SELECT profile, bad_fold, bad_fold_rank_ic, timeframe, family, count(DISTINCT feature) AS feature_count, avg(good_ic) AS gi, avg(bad_ic) AS bi, avg(delta) AS di, avg(abs(delta)) AS ad, avg(reversal::INT) AS rr, avg(shift) AS sh, {tops('abs(delta)', 'top_delta_features')}, {tops('shift', 'top_shifted_features')} FROM ff GROUP BY profile, bad_fold, bad_fold_rank_ic, timeframe, family)"


@query("d18_group_forensics", P3 + GROUPED + f" SELECT profile, bad_fold, {r('bad_fold_rank_ic', 'bad_fold_rank_ic')}, timeframe, family, feature_count, {r('gi', 'mean_good_feature_ic')}, {r('bi', 'mean_bad_feature_ic')}, {r('di', 'mean_delta_ic')}, {r('ad', 'mean_abs_delta_ic')}, {r('rr', 'signal_reversal_rate')}, {r('sh', 'mean_abs_standardized_diff')}, top_delta_features, top_shifted_features FROM gf")
def _(spark, d):
    g = reports.group_forensics(forensics(spark, d))
    return g.select("profile", "bad_fold", *rs("bad_fold_rank_ic"), "timeframe", "family", "feature_count", *rs("mean_good_feature_ic", "mean_bad_feature_ic", "mean_delta_ic", "mean_abs_delta_ic", "signal_reversal_rate", "mean_abs_standardized_diff"), "top_delta_features", "top_shifted_features")


@query("d18_group_watchlist", P3 + GROUPED + f" SELECT profile, timeframe, family, count(DISTINCT bad_fold) AS bad_fold_count, string_agg(bad_fold::VARCHAR, ',' ORDER BY bad_fold) AS bad_folds, {r('avg(di)', 'mean_delta_ic')}, {r('avg(ad)', 'mean_abs_delta_ic')}, {r('avg(rr)', 'signal_reversal_rate')}, {r('avg(sh)', 'mean_abs_standardized_diff')}, CASE WHEN {WATCH.format(n=2, rev='avg(rr)', least_rev=0.25, d='avg(ad)', least_d=0.05)} THEN 'ablate_or_split' ELSE 'monitor' END AS recommended_action FROM gf GROUP BY profile, timeframe, family")
def _(spark, d):
    g = reports.forensics_watchlist(reports.group_forensics(forensics(spark, d)), ["timeframe", "family"], 2, 0.25, 0.05, "ablate_or_split")
    return g.select("profile", "timeframe", "family", "bad_fold_count", "bad_folds", *rs("mean_delta_ic", "mean_abs_delta_ic", "signal_reversal_rate", "mean_abs_standardized_diff"), "recommended_action")


@query("d19_feature_audit", P3 + COHORTS + f""", v AS (SELECT profile, x.feature AS feature, x.v AS v, count(*) FILTER (quality = 'good') AS a, count(*) FILTER (quality = 'bad') AS b FROM cu GROUP BY ALL),
gp AS (SELECT profile, feature, abs(sum(a) OVER u / nullif(sum(a) OVER k, 0) - sum(b) OVER u / nullif(sum(b) OVER k, 0)) AS gap FROM v WINDOW u AS (PARTITION BY profile, feature ORDER BY v ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY profile, feature)),
ks AS (SELECT profile, feature, max(gap) AS ks FROM gp GROUP BY ALL),
au AS (SELECT profile, x.feature AS feature, avg(x.v) FILTER (quality = 'good') AS gm, avg(x.v) FILTER (quality = 'bad') AS bm, stddev_pop(x.v) AS sd FROM cu GROUP BY ALL HAVING count(*) FILTER (quality = 'good') >= 3 AND count(*) FILTER (quality = 'bad') >= 3),
rk AS (SELECT *, coalesce(abs(gm - bm) / nullif(sd, 0), 0) AS shift FROM au JOIN ks USING (profile, feature))
SELECT profile, feature, {r('gm', 'good_mean')}, {r('bm', 'bad_mean')}, {r('gm - bm', 'mean_diff')}, {r('shift', 'abs_standardized_diff')}, {r('ks', 'ks')}, row_number() OVER (PARTITION BY profile ORDER BY round(ks, 9) DESC, round(shift, 9) DESC, feature) AS place FROM rk""")
def _(spark, d):
    a = reports.feature_audit(test_rows(spark, d, ALL, (*USED, *FEATURES)), FEATURES, GOOD, BAD)
    return a.select("profile", "feature", *rs("good_mean", "bad_mean", "mean_diff", "abs_standardized_diff", "ks"), F.col("place").cast("long").alias("place"))


@query("d16_regime_by_fold", P3 + RANKS + f""", w AS (SELECT *, CASE WHEN regime_prob_0 >= greatest(regime_prob_1, regime_prob_2) THEN 0 WHEN regime_prob_1 >= regime_prob_2 THEN 1 ELSE 2 END AS regime FROM t),
wk AS (SELECT *, rank() OVER (PARTITION BY profile, fold, regime ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, fold, regime, prob_long) - 1) / 2 AS rx, rank() OVER (PARTITION BY profile, fold, regime ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, fold, regime, forward_return) - 1) / 2 AS ry FROM w)
SELECT profile, fold, regime, count(*) AS n, {r('any_value(i.rank_ic)', 'fold_rank_ic')}, any_value(i.rank_ic) <= {BAD} AS is_bad_fold, {r('CASE WHEN count(*) >= 3 THEN coalesce(corr(wk.rx, wk.ry), 0) ELSE 0 END', 'rank_ic')}, {r('avg(label)', 'label_rate')}, {r('avg((prob_long >= 0.5)::INT)', 'pred_rate')}, {r('avg(forward_return)', 'mean_return')}, {r('coalesce(2 * count(*) FILTER (prob_long >= 0.5 AND label = 1) / nullif(2 * count(*) FILTER (prob_long >= 0.5 AND label = 1) + count(*) FILTER (prob_long >= 0.5 AND label = 0) + count(*) FILTER (prob_long < 0.5 AND label = 1), 0), 0)', 'f1')} FROM wk JOIN ic i USING (profile, fold) GROUP BY profile, fold, regime""")
def _(spark, d):
    x = reports.regime_by_fold(test_rows(spark, d, ALL, (*USED, *[f"regime_prob_{i}" for i in range(3)])), 3, BAD)
    return x.select(*KEYS, "regime", "n", *rs("fold_rank_ic"), "is_bad_fold", *rs("rank_ic", "label_rate", "pred_rate", "mean_return", "f1"))


HTF = f"WITH {bars_cte()}, {bars_cte('htf', 14400)}, h AS (SELECT symbol, ts AS source_ts, ts + INTERVAL 4 HOUR AS available_ts FROM htf), j AS (SELECT 'available' AS variant, b.symbol, b.ts, h.source_ts, h.available_ts FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.available_ts UNION ALL SELECT 'bar_start', b.symbol, b.ts, h.source_ts, h.available_ts FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.source_ts)"


@query("d20_mtf_leakage", HTF + ", q AS (SELECT variant, count(*) AS n, count(source_ts) AS matched, count(*) FILTER (available_ts > ts) AS available_late, count(*) FILTER (available_ts <> source_ts + INTERVAL 4 HOUR) AS available_wrong FROM j GROUP BY variant) SELECT *, available_late = 0 AND available_wrong = 0 AS passed FROM q")
def _(spark, d):
    """The as-of join on the time a four-hour bar is available, and one on its start, which looks ahead."""
    b = bars(spark, d).select("symbol", "ts")
    h = bars(spark, d, 14400).select("symbol", F.col("ts").alias("source_ts"), F.expr("ts + interval 4 hours").alias("available_ts"))
    joined = [asof(b, h.withColumn("ts", F.col(c)), prefix="h_").withColumn("variant", F.lit(v)) for v, c in (("available", "available_ts"), ("bar_start", "source_ts"))]
    return reports.mtf_leakage(joined[0].unionByName(joined[1]), ["variant"], "ts", "h_source_ts", "h_available_ts")


@query("w11_percent_rank", P3 + f" SELECT profile, row_pos, {r('(rank() OVER (PARTITION BY profile, fold, split ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, fold, split, prob_long) - 1) / 2) / count(*) OVER (PARTITION BY profile, fold, split)', 'pct')} FROM preds")
def _(spark, d):
    return ranks.average_rank(preds(spark, d, ALL), BY, "prob_long", "pct", share=True).select("profile", "row_pos", *rs("pct"))


BLENDS = reports.all_blends(list(ALL), {"tilted": (0.5, 0.3, 0.2)})


def blends_sql() -> str:
    parts = []
    for name, (members, weights) in BLENDS.items():
        total = sum(weights) if weights else len(members)
        weight = "CASE profile " + " ".join(f"WHEN '{p}' THEN {(weights[i] if weights else 1) / total}" for i, p in enumerate(members)) + " END"
        for kind, x in (("prob", "prob_long"), ("rank", "rk")):
            parts.append(f"SELECT '{name}' AS blend, '{kind}_{'weighted' if weights else 'mean'}' AS method, row_pos, fold, split, round(sum({x} * {weight}), 12) AS score, stddev_samp({x}) AS sd, min({x}) AS lo, max({x}) AS hi, count(*) AS profiles FROM rk WHERE profile IN ({', '.join(repr(p) for p in members)}) GROUP BY ALL HAVING count(*) = {len(members)}")
    return "rk AS (SELECT *, (rank() OVER (PARTITION BY profile, fold, split ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, fold, split, prob_long) - 1) / 2) / count(*) OVER (PARTITION BY profile, fold, split) AS rk FROM preds), bl AS (" + " UNION ALL ".join(parts) + ")"


@query("e06_blends", P3 + ", " + blends_sql() + f" SELECT blend, method, row_pos, fold, split, {r('score', 'score')}, {r('sd', 'profile_std')}, {r('lo', 'profile_min')}, {r('hi', 'profile_max')}, profiles FROM bl")
def _(spark, d):
    b = reports.blends(preds(spark, d, ALL, only=("row_pos", "fold", "split")), BLENDS, ["row_pos", "fold", "split"], ["fold", "split"])
    return b.select("blend", "method", "row_pos", "fold", "split", *rs("score", "profile_std", "profile_min", "profile_max"), "profiles")


@query("e09_profile_delta", P3 + RANKS + f" SELECT c.profile AS profile, c.fold, {r('c.rank_ic', 'rank_ic')}, {r('o.rank_ic', 'control_ic')}, {r('c.rank_ic - o.rank_ic', 'delta')}, c.rank_ic > o.rank_ic AS improved FROM ic c JOIN ic o ON c.fold = o.fold AND o.profile = 'control' WHERE c.profile <> 'control'")
def _(spark, d):
    return reports.profile_delta(m.rank_ic(test_rows(spark, d, ALL), KEYS), "control").select(*KEYS, *rs("rank_ic", "control_ic", "delta"), "improved")


@query("e08_seed_stability", P3 + RANKS + f" SELECT fold, count(*) AS seeds, {r('avg(rank_ic)', 'mean_ic')}, {r('stddev_samp(rank_ic)', 'std_ic')}, {r('min(rank_ic)', 'min_ic')}, {r('max(rank_ic)', 'max_ic')} FROM ic GROUP BY fold")
def _(spark, d):
    ic = m.rank_ic(test_rows(spark, d, ALL), KEYS)
    return ic.groupBy("fold").agg(F.count("*").alias("seeds"), R(F.avg("rank_ic")).alias("mean_ic"), R(F.stddev_samp("rank_ic")).alias("std_ic"), R(F.min("rank_ic")).alias("min_ic"), R(F.max("rank_ic")).alias("max_ic"))


@query("a19_prior_folds", P3 + TRANSFER + f" SELECT profile, fold, threshold, lag(threshold) OVER (PARTITION BY profile ORDER BY fold) AS last_threshold, {r('avg(threshold) OVER (PARTITION BY profile ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'prior_mean')}, {r('quantile_cont(threshold, 0.5) OVER (PARTITION BY profile ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'prior_median')}, {r('list_reduce(list(threshold) OVER (PARTITION BY profile ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda a, v: 0.65 * a + 0.35 * v)', 'prior_ewm')} FROM v")
def _(spark, d):
    return reports.prior_thresholds(preds(spark, d, ALL), 0.35, 0.25).select(*KEYS, "threshold", "last_threshold", *rs("prior_mean", "prior_median", "prior_ewm"))


@query("e13_score_separation", P3 + f", v AS (SELECT profile, fold, prob_long AS x, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM preds WHERE split = 'test' GROUP BY ALL), g AS (SELECT profile, fold, abs(sum(a) OVER u / sum(a) OVER (PARTITION BY profile, fold) - sum(b) OVER u / sum(b) OVER (PARTITION BY profile, fold)) AS gap FROM v WINDOW u AS (PARTITION BY profile, fold ORDER BY x ROWS UNBOUNDED PRECEDING)), k AS (SELECT profile, fold, max(gap) AS ks FROM g GROUP BY ALL), q AS (SELECT profile, fold, avg(prob_long) FILTER (label = 1) - avg(prob_long) FILTER (label = 0) AS mean_gap, quantile_cont(prob_long, 0.5) FILTER (label = 1) - quantile_cont(prob_long, 0.5) FILTER (label = 0) AS median_gap FROM preds WHERE split = 'test' GROUP BY ALL) SELECT profile, fold, {r('ks', 'ks')}, {r('mean_gap', 'mean_gap')}, {r('median_gap', 'median_gap')} FROM k JOIN q USING (profile, fold)")
def _(spark, d):
    t = test_rows(spark, d, ALL)
    on, off = F.when(F.col("label") == 1, F.col("prob_long")), F.when(F.col("label") == 0, F.col("prob_long"))
    g = t.groupBy(*KEYS).agg((F.avg(on) - F.avg(off)).alias("mean_gap"), (F.percentile(on, 0.5) - F.percentile(off, 0.5)).alias("median_gap"))
    return m.ks(t, KEYS, "prob_long", F.col("label") == 1).join(g, KEYS).select(*KEYS, *rs("ks", "mean_gap", "median_gap"))


@query("e18_payoff_alignment", P3 + BANDS + f", h AS (SELECT profile, band, avg((forward_return > 0)::INT) AS hit FROM binned JOIN bands ON bin BETWEEN lo AND hi GROUP BY ALL), g AS (SELECT profile, band, corr(precision, mean_return) AS c, avg(mean_return) AS mr, count(*) AS folds FROM bs GROUP BY ALL) SELECT profile, band, folds, {r('hit', 'hit_rate')}, {r('mr', 'mean_return')}, {r('c', 'precision_return_corr')} FROM g JOIN h USING (profile, band)")
def _(spark, d):
    return reports.payoff_alignment(test_rows(spark, d, ALL), KEYS, BAND_LIST).select("profile", "band", "folds", *rs("hit_rate", "mean_return", "precision_return_corr"))


@query("e19_policy_over_windows", P3 + f", win(name, a, b) AS (VALUES ('early', TIMESTAMP '1995-01-01', TIMESTAMP '1998-01-01'), ('late', TIMESTAMP '1997-07-01', TIMESTAMP '2001-12-31')) SELECT profile, name AS window_name, count(*) AS n, {r('avg(label)', 'precision')}, {r('avg(forward_return)', 'mean_return')} FROM preds JOIN win ON ts BETWEEN a AND b WHERE prob_long >= 0.7 GROUP BY ALL")
def _(spark, d):
    windows = [("early", "1995-01-01", "1998-01-01"), ("late", "1997-07-01", "2001-12-31")]
    return reports.policy_over_windows(preds(spark, d, ALL), windows, 0.7).select("profile", "window_name", "n", *rs("precision", "mean_return"))


@query("j12_missing_profiles", P3 + """, want AS (SELECT DISTINCT profile, fold FROM (SELECT unnest(['control', 'alpha', 'beta']) AS profile), (SELECT DISTINCT fold FROM preds)),
strong AS (SELECT DISTINCT profile, fold FROM preds WHERE split = 'test' AND label = 1 AND prob_long > 0.999)
SELECT profile, fold, 'missing' AS side FROM want ANTI JOIN strong USING (profile, fold) UNION ALL SELECT profile, fold, 'there' FROM want SEMI JOIN strong USING (profile, fold)""")
def _(spark, d):
    """Folds of each profile with and without a surely right call: anti and semi join."""
    p = preds(spark, d, ALL)
    want = p.select("fold").distinct().withColumn("profile", F.explode(F.array(*map(F.lit, ALL))))
    strong = p.where("split = 'test' AND label = 1 AND prob_long > 0.999").select("profile", "fold").distinct()
    sides = [want.join(strong, KEYS, how).withColumn("side", F.lit(name)) for how, name in (("left_anti", "missing"), ("left_semi", "there"))]
    return sides[0].unionByName(sides[1]).select("profile", "fold", "side")


@query("a05_mode_counts", P + ", q AS (SELECT fold, CASE WHEN prob_long >= 0.5 AND label = 0 THEN 'false_long' WHEN prob_long < 0.5 AND label = 1 THEN 'missed' ELSE 'right' END AS issue, count(*) AS n FROM preds WHERE split = 'test' GROUP BY ALL) SELECT fold, (list(issue ORDER BY n DESC, issue))[1] AS mode, sum(n)::BIGINT AS n FROM q GROUP BY fold")
def _(spark, d):
    issue = F.when((F.col("prob_long") >= 0.5) & (F.col("label") == 0), "false_long").when((F.col("prob_long") < 0.5) & (F.col("label") == 1), "missed").otherwise("right")
    q = test_rows(spark, d).groupBy("fold", issue.alias("issue")).agg(F.count("*").alias("n"))
    return q.groupBy("fold").agg(F.get(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "issue"))), F.lit(0))["issue"].alias("mode"), F.sum("n").alias("n"))


@query("a06_first_in_group", f"{P} SELECT fold, split, arg_min(prob_long, row_pos) AS first_prob, arg_min(row_pos, row_pos) AS first_row FROM preds GROUP BY ALL")
def _(spark, d):
    return preds(spark, d).groupBy("fold", "split").agg(F.min_by("prob_long", "row_pos").alias("first_prob"), F.min("row_pos").alias("first_row"))


@query("a04_distinct_scores", f"{P3} SELECT profile, fold, count(DISTINCT prob_long) AS scores, count(DISTINCT ts) AS days FROM preds GROUP BY ALL")
def _(spark, d):
    return preds(spark, d, ALL).groupBy(*KEYS).agg(F.countDistinct("prob_long").alias("scores"), F.countDistinct("ts").alias("days"))


LOGIT = "ln(p / (1 - p))"


@query("m10_loss_values", P3 + f""", q AS (SELECT *, least(greatest(prob_long, 1e-6), 1 - 1e-6) AS p FROM preds WHERE split = 'test'),
f AS (SELECT profile, fold, avg(CASE WHEN label = 1 THEN -0.6 * pow(1 - p, 2) * ln(p) ELSE -0.4 * pow(p, 2) * ln(1 - p) END) AS focal, -corr(prob_long, forward_return) AS ic_loss FROM q GROUP BY ALL),
g AS (SELECT profile, fold, row_pos // 256 AS batch, {LOGIT} AS z, label FROM q),
pr AS (SELECT a.profile, a.fold, a.batch, avg(ln(1 + exp(0.25 - (a.z - b.z)))) AS m FROM g a JOIN g b ON a.profile = b.profile AND a.fold = b.fold AND a.batch = b.batch AND a.label = 1 AND b.label = 0 GROUP BY ALL),
bt AS (SELECT profile, fold, batch, count(*) AS n FROM g GROUP BY ALL),
mg AS (SELECT bt.profile, bt.fold, avg(CASE WHEN n >= 3 THEN coalesce(m, 0) ELSE 0 END) AS margin FROM bt LEFT JOIN pr USING (profile, fold, batch) GROUP BY ALL)
SELECT profile, fold, {r('focal', 'focal')}, {r('ic_loss', 'ic_loss')}, {r('margin', 'margin')}, {r('focal + 0.2 * ic_loss + 0.1 * margin', 'loss')} FROM f JOIN mg USING (profile, fold)""")
def _(spark, d):
    x = losses.loss_values(test_rows(spark, d, ALL), KEYS, F.floor(F.col("row_pos") / 256), ic_weight=0.2, margin_weight=0.1)
    return x.select(*KEYS, *rs("focal", "ic_loss", "margin", "loss"))


@query("m16_fold_model_means", P3 + f" SELECT row_pos, fold, {r('avg(prob_long)', 'prob_long')}, count(DISTINCT profile) AS models FROM preds GROUP BY row_pos, fold")
def _(spark, d):
    models = sum((F.coalesce(F.max(F.when(F.col("profile") == p, 1)), F.lit(0)) for p in ALL), F.lit(0)).cast("long")
    return preds(spark, d, ALL).groupBy("row_pos", "fold").agg(R(F.avg("prob_long")).alias("prob_long"), models.alias("models"))


@query("m17_isotonic_calibration")
def _(spark, d):
    return reports.isotonic(preds(spark, d, ALL), KEYS).select("profile", "row_pos", *rs("calibrated"))


@query("m17_platt_calibration")
def _(spark, d):
    return reports.platt(preds(spark, d, ALL), KEYS).select("profile", "row_pos", *rs("calibrated"))
