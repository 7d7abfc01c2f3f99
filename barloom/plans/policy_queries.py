"""Queries of threshold grids, policies, gates, fold stability, drift and the out-of-sample monitor, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import drift, policies, reports, review, rules
from barloom.operators import metrics as m
from barloom.plans.bar_queries import r, rs
from barloom.plans.prediction_queries import ALL, BINNED, F1, FEATURES, RANKS, STEPS, ratio
from barloom.plans.review_queries import START, held_from, summary_sql, thresholds_sql
from barloom.plans.tables import USED, preds, preds_cte
from barloom.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P3 = f"WITH {preds_cte(ALL)}"
KEYS = ["profile", "fold"]
#: The usual bounds of the gates are for models; these let some of the test tables' random scores through.
TARGETS = review.Targets(rank_ic=0.0, rank_ic_std=0.02, positive_ic=0.5, long_f1=0.35, most_rate=0.7, least_precision=0.2)
TARGET, BAD = 0.01, -0.02
POLICY = rules.rebound(rules.POLICY, precision=0.2, positive_lift_fold_rate=0.4, positive_forward_return_fold_rate=0.4)
TRIAGE = rules.rebound(rules.TRIAGE, mean_rank_ic_delta=0.0, std_rank_ic=0.02, top_10_lift_global=0.99, top_10_positive_lift_fold_rate=0.4)
FULL = rules.rebound(rules.FULL, mean_rank_ic_delta=-0.001, std_rank_ic=0.01, top_10_lift_global_delta=-0.05)
RELIABLE = rules.rebound(rules.RELIABLE, accepted_fold_count=3)
REGIME_FOLD = rules.rebound(rules.REGIME_FOLD, test_f1=0.3, test_precision=0.2)
REGIME_POLICY = rules.rebound(rules.REGIME_POLICY, test_f1=0.3, f1_delta_vs_official=0.0, policy_pass_fold_rate=0.1)
BAND_LIST = [("top_10", 9, 9), ("top_20", 8, 9), ("top_30", 7, 9), ("upper_half", 5, 9), ("mid_upper_40_90", 4, 8)]
CAPS = (0.2, 0.35, 0.5)
LEAST = 0.25


def rows(spark, d, *more):
    return preds(spark, d, ALL, only=(*USED, *more))


def test_rows(spark, d, *more):
    return rows(spark, d, *more).where("split = 'test'")


QCUT = "CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((rn - 1) * least(10, n) / (n - 1)) - 1, 0) END::INT"
BANDED = BINNED + ", bands(band, lo, hi) AS (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in BAND_LIST) + """), base AS (SELECT profile, fold, avg(label) AS base, sum(label) AS positives, count(*) AS total FROM binned GROUP BY ALL),
bs AS (SELECT profile, fold, band, count(*) AS n, avg(label) AS precision, sum(label) / any_value(positives) AS recall, 2 * sum(label) / (count(*) + any_value(positives)) AS f1, count(*) / any_value(total) AS selection_rate, avg(label) / any_value(base) AS lift, avg(forward_return) AS mean_return
  FROM binned JOIN bands ON bin BETWEEN lo AND hi JOIN base USING (profile, fold) GROUP BY ALL)"""
BSUM = """, bm AS (SELECT profile, band, count(DISTINCT fold) AS folds, avg(selection_rate) AS mean_selection_rate, avg(precision) AS mean_precision, avg(recall) AS mean_recall, avg(f1) AS mean_f1, avg(lift) AS mean_lift_vs_base, quantile_cont(lift, 0.5) AS median_lift_vs_base,
  avg(coalesce(round(lift, 12) > 1, false)::INT) AS positive_lift_fold_rate, avg(mean_return) AS mean_forward_return, avg(coalesce(round(mean_return, 12) > 0, false)::INT) AS positive_forward_return_fold_rate FROM bs GROUP BY ALL)"""
BSUM_COLUMNS = ["mean_selection_rate", "mean_precision", "mean_recall", "mean_f1", "mean_lift_vs_base", "median_lift_vs_base", "positive_lift_fold_rate", "mean_forward_return", "positive_forward_return_fold_rate"]


@query("d08_band_fold_rates", P3 + BANDED + BSUM + f" SELECT profile, band, folds, {', '.join(r(c, c) for c in BSUM_COLUMNS)} FROM bm")
def _(spark, d):
    b = policies.band_summary(reports.score_bands(test_rows(spark, d), KEYS, BAND_LIST))
    return b.select("profile", "band", "folds", *rs(*BSUM_COLUMNS))


@query("d08_bands_by_fold", P3 + BANDED + f""", bk AS (SELECT profile, fold, band, rank() OVER (PARTITION BY profile, fold, band ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, fold, band, prob_long) - 1) / 2 AS rx, rank() OVER (PARTITION BY profile, fold, band ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, fold, band, forward_return) - 1) / 2 AS ry FROM binned JOIN bands ON bin BETWEEN lo AND hi),
bi AS (SELECT profile, fold, band, CASE WHEN count(*) >= 3 THEN coalesce(corr(rx, ry), 0) ELSE 0 END AS ric FROM bk GROUP BY ALL)
SELECT profile, fold, band, n, {', '.join(r(c, c) for c in ('selection_rate', 'precision', 'recall', 'f1', 'lift', 'mean_return'))}, {r('ric', 'rank_ic_within_band')} FROM bs JOIN bi USING (profile, fold, band)""")
def _(spark, d):
    """Every band of a fold with its F1, selection rate and the rank correlation inside it."""
    t = test_rows(spark, d)
    b = reports.score_bands(t, KEYS, BAND_LIST).join(reports.band_ic(t, KEYS, BAND_LIST), [*KEYS, "band"])
    return b.select(*KEYS, "band", "n", *rs("selection_rate", "precision", "recall", "f1", "lift", "mean_return", "rank_ic_within_band"))


@query("d07_lift_by_fold", P3 + BINNED + f""", b AS (SELECT profile, fold, bin, count(*) AS n, avg(label) AS rate, avg(forward_return) AS mr FROM binned GROUP BY ALL),
w AS (SELECT *, sum(rate * n) OVER (PARTITION BY profile, fold) / sum(n) OVER (PARTITION BY profile, fold) AS base, rank() OVER (PARTITION BY profile, fold ORDER BY round(rate, 12)) + (count(*) OVER (PARTITION BY profile, fold, round(rate, 12)) - 1) / 2 AS rk FROM b)
SELECT profile, fold, sum(n)::BIGINT AS n, {r('arg_min(rate, bin)', 'bottom_rate')}, {r('arg_max(rate, bin)', 'top_rate')}, {r('arg_max(rate / base, bin)', 'top_lift')}, {r('arg_max(rate, bin) - arg_min(rate, bin)', 'rate_spread')}, {r('arg_max(mr, bin) - arg_min(mr, bin)', 'return_spread')}, {r('CASE WHEN min(round(rate, 12)) < max(round(rate, 12)) THEN corr(bin, rk) END', 'rate_spearman')} FROM w GROUP BY profile, fold""")
def _(spark, d):
    return reports.lift_by_fold(test_rows(spark, d), KEYS).select(*KEYS, "n", *rs("bottom_rate", "top_rate", "top_lift", "rate_spread", "return_spread", "rate_spearman"))


GRID = STEPS + f""", sb AS (SELECT *, round(2 * cpos / (cn + all_pos), 12) AS f1, round(cpos / cn, 12) AS precision, cn / all_n AS rate FROM st),
hv AS (SELECT profile, fold, max((split = 'val')::INT) AS has_val, max((split = 'test')::INT) AS has_test FROM preds GROUP BY ALL),
so AS (SELECT sb.*, has_val FROM sb JOIN hv USING (profile, fold) WHERE has_test = 1 AND (split = 'val' OR (has_val = 0 AND split = 'test'))),
cp(cap) AS (VALUES {', '.join(f'({c}::DOUBLE)' for c in CAPS)}),
pl AS (SELECT profile, fold, split, has_val, threshold FROM so QUALIFY row_number() OVER (PARTITION BY profile, fold ORDER BY f1 DESC, threshold) = 1),
co AS (SELECT profile, fold, cap, threshold FROM so, cp WHERE rate <= cap AND precision >= {LEAST} QUALIFY row_number() OVER (PARTITION BY profile, fold, cap ORDER BY f1 DESC, precision DESC, rate, threshold DESC) = 1),
th AS (SELECT pl.profile, pl.fold, pl.split AS source, cap, coalesce(co.threshold, pl.threshold) AS threshold, co.threshold IS NOT NULL AS ok, has_val FROM pl CROSS JOIN cp LEFT JOIN co USING (profile, fold, cap)),
sg AS (SELECT t.profile, t.fold, t.cap, {F1} FROM (SELECT th.profile, th.fold, th.cap, prob_long >= threshold AS p, label = 1 AS y FROM preds JOIN th ON preds.profile = th.profile AND preds.fold = th.fold AND preds.split = th.source) t GROUP BY ALL),
tg AS (SELECT t.profile, t.fold, t.cap, {F1}, avg(y::INT) AS base_rate, avg(forward_return) FILTER (p) AS mr FROM (SELECT th.profile, th.fold, th.cap, prob_long >= threshold AS p, label = 1 AS y, forward_return FROM preds JOIN th ON preds.profile = th.profile AND preds.fold = th.fold AND preds.split = 'test') t GROUP BY ALL),
tgrid AS (SELECT th.profile, th.fold, th.cap, th.threshold, th.ok AS constraints_satisfied, CASE WHEN th.ok THEN '' ELSE 'no_threshold_satisfies_pred_rate_precision' END AS reject_reason, CASE WHEN has_val = 1 THEN 'val' ELSE 'same_split_oracle' END AS threshold_source,
  {', '.join(f"{ratio(e.format('sg'), f.format('sg'))} AS source_{n}, {ratio(e.format('tg'), f.format('tg'))} AS test_{n}" for n, e, f in (('f1', '2 * {0}.tp', '(2 * {0}.tp + {0}.fp + {0}.fn)'), ('precision', '{0}.tp', '({0}.tp + {0}.fp)'), ('recall', '{0}.tp', '({0}.tp + {0}.fn)'), ('pred_rate', '{0}.tp + {0}.fp', '({0}.tp + {0}.fp + {0}.fn + {0}.tn)')))},
  tg.tp + tg.fp AS selected_count, base_rate, tg.tp / nullif(tg.tp + tg.fp, 0) AS selected_long_rate, tg.tp / nullif(tg.tp + tg.fp, 0) / nullif(base_rate, 0) AS lift_vs_base, mr AS mean_forward_return FROM th JOIN sg USING (profile, fold, cap) JOIN tg USING (profile, fold, cap))"""
GRID_COLUMNS = [f"{s}_{c}" for s in ("source", "test") for c in ("f1", "precision", "recall", "pred_rate")] + ["base_rate", "selected_long_rate", "lift_vs_base", "mean_forward_return"]
GSUM = """, gs AS (SELECT profile, cap, count(DISTINCT fold) AS folds, avg(threshold) AS threshold_mean, avg(constraints_satisfied::INT) AS constraints_satisfied_fold_rate, avg(source_f1) AS mean_source_f1, avg(source_precision) AS mean_source_precision, avg(source_recall) AS mean_source_recall, avg(source_pred_rate) AS mean_source_pred_rate,
  avg(test_f1) AS mean_f1, avg(test_precision) AS mean_precision, avg(test_recall) AS mean_recall, avg(test_pred_rate) AS mean_selection_rate, avg(lift_vs_base) AS mean_lift_vs_base, avg(coalesce(round(lift_vs_base, 12) > 1, false)::INT) AS positive_lift_fold_rate, avg(mean_forward_return) AS mean_forward_return, avg(coalesce(round(mean_forward_return, 12) > 0, false)::INT) AS positive_forward_return_fold_rate FROM tgrid GROUP BY ALL)"""
GSUM_COLUMNS = ["threshold_mean", "constraints_satisfied_fold_rate", "mean_source_f1", "mean_source_precision", "mean_source_recall", "mean_source_pred_rate", "mean_f1", "mean_precision", "mean_recall", "mean_selection_rate", "mean_lift_vs_base", "positive_lift_fold_rate", "mean_forward_return", "positive_forward_return_fold_rate"]


@query("d13_threshold_grid", P3 + GRID + f" SELECT profile, fold, cap, threshold, threshold_source, constraints_satisfied, reject_reason, selected_count, {', '.join(r(c, c) for c in GRID_COLUMNS)} FROM tgrid")
def _(spark, d):
    g = policies.threshold_grid(rows(spark, d), CAPS, LEAST)
    return g.select(*KEYS, "cap", "threshold", "threshold_source", "constraints_satisfied", "reject_reason", "selected_count", *rs(*GRID_COLUMNS))


@query("d13_threshold_grid_summary", P3 + GRID + GSUM + f" SELECT profile, cap, folds, {', '.join(r(c, c) for c in GSUM_COLUMNS)} FROM gs")
def _(spark, d):
    return policies.threshold_grid_summary(policies.threshold_grid(rows(spark, d), CAPS, LEAST)).select("profile", "cap", "folds", *rs(*GSUM_COLUMNS))


@query("d09_score_policy", P3 + BANDED + BSUM + GRID + GSUM + f""", r1 AS (SELECT profile, prob_long, label, row_number() OVER (PARTITION BY profile ORDER BY prob_long, row_pos) AS rn, count(*) OVER (PARTITION BY profile) AS n FROM preds WHERE split = 'test'),
r2 AS (SELECT *, {QCUT} AS bin FROM r1), g0 AS (SELECT profile, avg(label) AS base, sum(label) AS positives, count(*) AS total FROM r2 GROUP BY ALL),
gb AS (SELECT profile, band, count(*) / any_value(total) AS selection_rate, avg(label) AS precision, sum(label) / any_value(positives) AS recall, 2 * sum(label) / (count(*) + any_value(positives)) AS f1, avg(label) / any_value(base) AS lift_vs_base FROM r2 JOIN bands ON bin BETWEEN lo AND hi JOIN g0 USING (profile) GROUP BY ALL),
pg AS (SELECT profile, 'score_band' AS policy_type, band AS policy_name, folds, NULL::DOUBLE AS threshold_mean, selection_rate, precision, recall, f1, lift_vs_base, positive_lift_fold_rate, mean_forward_return, positive_forward_return_fold_rate FROM bm JOIN gb USING (profile, band)
  UNION ALL SELECT profile, 'threshold_cap', printf('threshold_cap_%.2f', cap), folds, threshold_mean, mean_selection_rate, mean_precision, mean_recall, mean_f1, mean_lift_vs_base, positive_lift_fold_rate, mean_forward_return, positive_forward_return_fold_rate FROM gs),
pr AS (SELECT *, {rules.reasons_sql(POLICY)} AS reject_reason FROM pg),
pk AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY reject_reason = '' DESC, round(mean_forward_return, 9) DESC NULLS LAST, round(positive_forward_return_fold_rate, 9) DESC NULLS LAST, round(lift_vs_base, 9) DESC NULLS LAST, round(f1, 9) DESC NULLS LAST, round(selection_rate, 9), policy_type, policy_name) AS policy_rank FROM pr)
SELECT profile, policy_type, policy_name, folds, {', '.join(r(c, c) for c in ['threshold_mean', *policies.POLICY_COLUMNS])}, reject_reason, reject_reason = '' AS policy_pass, policy_rank, policy_rank = 1 AS selected FROM pk""")
def _(spark, d):
    g = policies.select_policy(policies.policy_grid(rows(spark, d), BAND_LIST, CAPS, LEAST), POLICY)
    return g.select("profile", "policy_type", "policy_name", "folds", *rs("threshold_mean", *policies.POLICY_COLUMNS), "reject_reason", "policy_pass", F.col("policy_rank").cast("long").alias("policy_rank"), "selected")


def top_bands(p):
    return reports.score_bands(p.where("split = 'test'"), KEYS, BAND_LIST).where("band = 'top_10'")


RELATIVE = sorted({x.metric for x in (*TRIAGE, *FULL) if x.against})


@query("e04_gates", P3 + summary_sql(t=TARGETS) + BANDED + f""", tr AS (SELECT profile, avg(coalesce(round(lift, 12) > 1, false)::INT) AS top_10_positive_lift_fold_rate FROM bs WHERE band = 'top_10' GROUP BY profile),
gj AS (SELECT sm.*, tr.top_10_positive_lift_fold_rate, 1.0 AS mtf_leakage_passed, 1.0 AS stationarity_policy_passed, {', '.join(f'c.{x} AS control_{x}' for x in RELATIVE)} FROM sm JOIN tr USING (profile) CROSS JOIN (SELECT * FROM sm WHERE profile = 'control') c WHERE sm.profile <> 'control'),
gr AS (SELECT *, {rules.reasons_sql(TRIAGE)} AS triage_reject_reason, CASE WHEN passed THEN '' ELSE {rules.reasons_sql(FULL)} END AS full_reject_reason FROM gj)
SELECT profile, {', '.join(r(c, c) for c in ('mean_rank_ic', 'std_rank_ic', 'top_10_lift', 'top_10_positive_lift_fold_rate'))}, triage_reject_reason, full_reject_reason,
  triage_reject_reason = '' AND row_number() OVER (PARTITION BY triage_reject_reason = '' ORDER BY round(mean_rank_ic, 9) DESC, round(top_10_lift, 9) DESC, round(worst_rank_ic, 9) DESC, round(top_10_positive_lift_fold_rate, 9) DESC, profile) <= 1 AS auto_full FROM gr""")
def _(spark, d):
    """The trial and full gates of every profile against the control, and which one goes on to a full run."""
    p = rows(spark, d)
    g = policies.gated(review.summary(p, TARGETS), top_bands(p), "control", F.lit(True), F.lit(True), TRIAGE, FULL, most=1)
    return g.select("profile", *rs("mean_rank_ic", "std_rank_ic", "top_10_lift", "top_10_positive_lift_fold_rate"), "triage_reject_reason", "full_reject_reason", "auto_full")


STABILITY = RANKS + thresholds_sql(t=TARGETS) + BANDED


@query("e10_fold_stability", P3 + STABILITY + f""", v AS (SELECT ic.profile, ic.fold, rank_ic, td.test_f1_constrained AS f1, td.test_pred_rate_constrained AS rate, bs.lift, bs.mean_return, avg(rank_ic) OVER p AS mu, coalesce(stddev_samp(rank_ic) OVER p, 0) AS sd FROM ic LEFT JOIN td USING (profile, fold) LEFT JOIN bs ON bs.profile = ic.profile AND bs.fold = ic.fold AND bs.band = 'top_10' WINDOW p AS (PARTITION BY ic.profile)),
u AS (SELECT *, CASE WHEN round(sd, 12) > 0 THEN (rank_ic - mu) / sd END AS zz, (rank_ic - mu) * (rank_ic - mu) AS sq FROM v),
x AS (SELECT *, sq / nullif(sum(sq) OVER (PARTITION BY profile), 0) AS share, row_number() OVER (PARTITION BY profile ORDER BY round(sq, 12) DESC, fold) AS rk,
  CASE WHEN round(rank_ic, 12) <= {BAD} THEN 'bad_rank_ic' WHEN round(rank_ic, 12) < 0 THEN 'negative_rank_ic' WHEN round(rank_ic, 12) < {TARGET} THEN 'below_target_rank_ic' WHEN round(abs(zz), 9) >= 1 AND rank_ic >= mu THEN 'variance_driver_high_side' WHEN round(abs(zz), 9) >= 1 THEN 'variance_driver_low_side' WHEN round(f1, 12) < 0.42 THEN 'official_threshold_f1' WHEN round(rate, 12) > 0.7 THEN 'official_threshold_pred_long_rate' WHEN round(mean_return, 12) <= 0 THEN 'top_10_payoff' ELSE 'ok' END AS issue FROM u)
SELECT profile, fold, {r('rank_ic', 'rank_ic')}, {r('mu', 'rank_ic_mean')}, {r('sd', 'rank_ic_std')}, {r('zz', 'zscore')}, {r('share', 'variance_share')}, CASE WHEN share IS NOT NULL THEN rk END AS driver_rank, {r('f1', 'official_f1')}, {r('lift', 'top_10_lift')}, {r('mean_return', 'top_10_return')}, issue,
  CASE WHEN issue IN ('official_threshold_f1', 'official_threshold_pred_long_rate', 'top_10_payoff', 'ok') THEN 'rank_ic_ok' ELSE issue END AS bucket,
  CASE WHEN issue LIKE 'official%' THEN 'threshold_calibration' WHEN issue = 'top_10_payoff' THEN 'score_band_policy' WHEN issue = 'ok' THEN 'monitor' ELSE 'fold_stability' END AS track FROM x""")
def _(spark, d):
    p = rows(spark, d)
    official = review.threshold_diagnostics(p, TARGETS.most_rate, TARGETS.least_precision)
    f = policies.fold_stability(m.rank_ic(p.where("split = 'test'"), KEYS), official, top_bands(p), TARGET, BAD, 0.42, 0.7)
    return f.select(*KEYS, *rs("rank_ic", "rank_ic_mean", "rank_ic_std", "zscore", "variance_share"), F.col("driver_rank").cast("long").alias("driver_rank"), *rs("official_f1", "top_10_lift", "top_10_return"), "issue", "bucket", "track")


PRIOR = "OVER (PARTITION BY profile ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("e11_transfer_review", P3 + thresholds_sql(t=TARGETS) + f""", pt AS (SELECT profile, fold, con AS own_validation, lag(con) OVER (PARTITION BY profile ORDER BY fold) AS last_fold, avg(con) {PRIOR} AS prior_mean, quantile_cont(con, 0.5) {PRIOR} AS prior_median, list_reduce(list(con) {PRIOR}, lambda a, v: 0.65 * a + 0.35 * v) AS prior_ewm FROM ch),
un AS (UNPIVOT pt ON own_validation, last_fold, prior_mean, prior_median, prior_ewm INTO NAME policy VALUE threshold),
tf AS (SELECT un.profile, un.fold, policy, any_value(threshold) AS threshold, avg(forward_return) FILTER (p.prob_long >= threshold) AS mr, count(*) FILTER (p.prob_long >= threshold AND label = 1) AS tp, count(*) FILTER (p.prob_long >= threshold AND label = 0) AS fp, count(*) FILTER (p.prob_long < threshold AND label = 1) AS fn, count(*) AS n FROM un JOIN preds p ON p.profile = un.profile AND p.fold = un.fold AND p.split = 'test' GROUP BY un.profile, un.fold, policy),
am AS (SELECT *, {ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1, {ratio('tp', '(tp + fp)')} AS precision, {ratio('tp', '(tp + fn)')} AS recall, (tp + fp) / n AS rate FROM tf)
SELECT a.profile, a.fold, a.policy, {r('a.threshold', 'threshold')}, {r('a.f1', 'f1')}, {r('a.precision', 'precision')}, {r('a.recall', 'recall')}, {r('a.rate', 'pred_rate')}, {r('a.mr', 'mean_return')}, {r('a.f1 - o.f1', 'f1_delta')}, {r('a.rate - o.rate', 'rate_delta')} FROM am a JOIN am o ON o.profile = a.profile AND o.fold = a.fold AND o.policy = 'own_validation'""")
def _(spark, d):
    """Thresholds that earlier folds alone suggest, on each fold's test rows."""
    t = policies.transferred(rows(spark, d), TARGETS.most_rate, TARGETS.least_precision)
    return t.select(*KEYS, "policy", *rs("threshold", "f1", "precision", "recall", "pred_rate", "mean_return", "f1_delta", "rate_delta"))


REGIME = "CASE WHEN regime_prob_0 >= greatest(regime_prob_1, regime_prob_2) THEN 0 WHEN regime_prob_1 >= regime_prob_2 THEN 1 ELSE 2 END"
LEAST_ROWS = dict(least_val=60, least_test=40, least_longs=5)
REGIMES = thresholds_sql(t=TARGETS) + f""", pq AS (SELECT *, {REGIME} AS regime FROM preds),
rn AS (SELECT profile, fold, regime, count(*) FILTER (split = 'val') AS vn, count(*) FILTER (split = 'val' AND label = 1) AS vp, count(*) FILTER (split = 'test') AS tn FROM pq GROUP BY ALL),
en AS (SELECT profile, fold, regime FROM rn WHERE vn >= 60 AND tn >= 40 AND vp >= 5),
vq AS (SELECT pq.profile, pq.fold, pq.regime, prob_long, label FROM pq JOIN en USING (profile, fold, regime) WHERE split = 'val'),
v0 AS (SELECT profile, fold, regime, prob_long AS threshold, count(*) AS n, sum(label) AS pos FROM vq GROUP BY ALL),
vs AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cpos FROM v0 WINDOW w AS (PARTITION BY profile, fold, regime ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
vt AS (SELECT profile, fold, regime, sum(n) AS all_n, sum(pos) AS all_pos FROM v0 GROUP BY ALL),
vx AS (SELECT profile, fold, regime, unnest(list_concat(quantile_cont(prob_long, [0.5, 0.6, 0.7, 0.8, 0.9]), [0.5::DOUBLE, max(prob_long) + 1e-9, min(prob_long) - 1e-9])) AS c FROM vq GROUP BY profile, fold, regime),
va AS (SELECT profile, fold, regime, c AS threshold, coalesce(max(cn) FILTER (threshold >= c), 0) AS cn, coalesce(max(cpos) FILTER (threshold >= c), 0) AS cpos FROM (SELECT DISTINCT * FROM vx) JOIN vs USING (profile, fold, regime) GROUP BY ALL),
vu AS (SELECT profile, fold, regime, threshold, cn, cpos FROM vs UNION ALL SELECT * FROM va),
vm AS (SELECT *, round(coalesce(2 * cpos / nullif(cn + all_pos, 0), 0), 12) AS f1, round(coalesce(cpos / nullif(cn, 0), 0), 12) AS precision, round(cn / all_n, 12) AS rate FROM vu JOIN vt USING (profile, fold, regime)),
vc AS (SELECT profile, fold, regime, threshold FROM vm QUALIFY row_number() OVER (PARTITION BY profile, fold, regime ORDER BY CASE WHEN rate <= 0.7 AND precision >= 0.2 THEN 2 WHEN rate <= 0.7 THEN 1 ELSE 0 END DESC, f1 DESC, precision DESC, rate, threshold) = 1),
us AS (SELECT rn.profile, rn.fold, rn.regime, vc.threshold AS own, coalesce(vc.threshold, td.constrained_threshold) AS used FROM rn LEFT JOIN vc USING (profile, fold, regime) JOIN td ON td.profile = rn.profile AND td.fold = rn.fold),
ug AS (SELECT profile, fold, split, {F1}, avg(forward_return) FILTER (p) AS mr, count(DISTINCT regime) AS regimes FROM (SELECT pq.*, prob_long >= used AS p, label = 1 AS y FROM pq JOIN us USING (profile, fold, regime)) GROUP BY ALL),
um AS (SELECT *, {ratio('2 * tp', '(2 * tp + fp + fn)')} AS f1, {ratio('tp', '(tp + fp)')} AS precision, {ratio('tp', '(tp + fn)')} AS recall, {ratio('tp + fp', '(tp + fp + fn + tn)')} AS pred_rate FROM ug),
uc AS (SELECT profile, fold, count(own) AS regime_threshold_count FROM us GROUP BY ALL),
rt AS (SELECT v.profile, v.fold, t.regimes AS regime_count, regime_threshold_count, td.constrained_threshold AS fallback_threshold, {', '.join(f'{s}.{c} AS {n}_{c}' for s, n in (('v', 'val'), ('t', 'test')) for c in ('f1', 'precision', 'recall', 'pred_rate'))}, t.mr AS test_mean_return, td.test_f1_constrained AS official_f1, td.test_pred_rate_constrained AS official_pred_rate, t.f1 - td.test_f1_constrained AS f1_delta
  FROM um v JOIN um t ON t.profile = v.profile AND t.fold = v.fold AND t.split = 'test' JOIN uc ON uc.profile = v.profile AND uc.fold = v.fold JOIN td ON td.profile = v.profile AND td.fold = v.fold WHERE v.split = 'val'),
rg AS (SELECT *, {rules.reasons_sql(REGIME_FOLD)} AS reject_reason FROM rt)"""
REGIME_COLUMNS = ["fallback_threshold", *[f"{s}_{c}" for s in ("val", "test") for c in ("f1", "precision", "recall", "pred_rate")], "test_mean_return", "official_f1", "official_pred_rate", "f1_delta"]


def regime_folds(spark, d):
    p = rows(spark, d, *[f"regime_prob_{i}" for i in range(3)])
    counts = policies.regime_counts(p, 3)
    steps = written(m.steps_of_counts(counts.select(*KEYS, "split", "regime", "threshold", "n", "pos"), [*KEYS, "split"]), "score-steps")
    official = review.threshold_diagnostics(p, TARGETS.most_rate, TARGETS.least_precision, steps)
    return policies.regime_thresholds(p, 3, official, most_rate=0.7, least_precision=0.2, gates=REGIME_FOLD, counts=counts, **LEAST_ROWS)


@query("e12_regime_thresholds", P3 + REGIMES + f" SELECT profile, fold, regime_count, regime_threshold_count, {', '.join(r(c, c) for c in REGIME_COLUMNS)}, reject_reason, reject_reason = '' AS passed_fold FROM rg")
def _(spark, d):
    return regime_folds(spark, d).select(*KEYS, "regime_count", "regime_threshold_count", *rs(*REGIME_COLUMNS), "reject_reason", "passed_fold")


RSUM = ["test_f1", "test_precision", "test_pred_rate", "test_mean_return", "official_f1", "official_pred_rate", "f1_delta", "regime_threshold_count"]


@query("e12_regime_threshold_summary", P3 + REGIMES + f""", rs AS (SELECT profile, count(DISTINCT fold) AS fold_count, {', '.join(f'avg({c}) AS {c}_mean' for c in RSUM)}, avg((reject_reason = '')::INT) AS passed_fold_rate, avg(coalesce(round(test_mean_return, 12) > 0, false)::INT) AS positive_return_fold_rate FROM rg GROUP BY profile),
rr AS (SELECT *, {rules.reasons_sql(REGIME_POLICY)} AS reject_reason FROM rs)
SELECT profile, fold_count, {', '.join(r(f'{c}_mean', f'{c}_mean') for c in RSUM)}, {r('passed_fold_rate', 'passed_fold_rate')}, {r('positive_return_fold_rate', 'positive_return_fold_rate')}, reject_reason, CASE WHEN reject_reason = '' THEN 'pre_register_regime_threshold_policy_for_future_oos_review' ELSE 'diagnostic_only_do_not_promote' END AS next_action FROM rr""")
def _(spark, d):
    s = policies.regime_threshold_summary(regime_folds(spark, d), REGIME_POLICY)
    return s.select("profile", "fold_count", *rs(*[f"{c}_mean" for c in RSUM], "passed_fold_rate", "positive_return_fold_rate"), "reject_reason", "next_action")


@query("e14_feature_drift", P3 + RANKS + f""", dq AS (SELECT profile, fold, round(rank_ic, 12) AS ric, max((round(rank_ic, 12) < 0)::INT) OVER (PARTITION BY profile) AS neg FROM ic),
dc AS (SELECT *, CASE WHEN ric < CASE WHEN neg = 1 THEN 0 ELSE {TARGET} END THEN 'bad' WHEN ric >= {TARGET} THEN 'good' END AS cohort FROM dq),
df AS (SELECT profile, CASE WHEN max(neg) = 1 THEN 'negative_rank_ic' ELSE 'rank_ic_below_target_{TARGET:.3f}' END AS bad_definition, count(*) FILTER (cohort = 'bad') AS bad_fold_count, string_agg(fold::VARCHAR, ',' ORDER BY fold) FILTER (cohort = 'bad') AS bad_fold_ids, count(*) FILTER (cohort = 'good') AS good_fold_count, string_agg(fold::VARCHAR, ',' ORDER BY fold) FILTER (cohort = 'good') AS good_fold_ids FROM dc WHERE cohort IS NOT NULL GROUP BY profile),
du AS (SELECT t.profile, cohort, label, forward_return, unnest([{{'feature': 'f_quantity', 'v': f_quantity}}, {{'feature': 'f_price', 'v': f_price}}, {{'feature': '4h_tax', 'v': "4h_tax"}}]) AS x FROM t JOIN dc USING (profile, fold) WHERE cohort IS NOT NULL),
dk AS (SELECT profile, cohort, x.feature AS feature, x.v AS v, label, rank() OVER (PARTITION BY profile, cohort, x.feature ORDER BY x.v) + (count(*) OVER (PARTITION BY profile, cohort, x.feature, x.v) - 1) / 2 AS rx, rank() OVER (PARTITION BY profile, cohort, x.feature ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, cohort, x.feature, forward_return) - 1) / 2 AS ry FROM du),
ds AS (SELECT profile, cohort, feature, avg(v) AS mv, stddev_pop(v) AS sv, count(*) AS n, avg(v) FILTER (label = 1) - avg(v) FILTER (label = 0) AS gap, CASE WHEN count(*) >= 4 THEN corr(rx, ry) END AS fic FROM dk GROUP BY ALL),
dj AS (SELECT b.profile, b.feature, b.mv AS bad_mean, g.mv AS good_mean, b.sv AS bad_std, g.sv AS good_std, b.n AS bad_count, g.n AS good_count, b.fic AS bad_ic, g.fic AS good_ic, b.gap AS bad_gap, g.gap AS good_gap, (b.mv - g.mv) / nullif(round(sqrt((b.sv * b.sv + g.sv * g.sv) / 2), 12), 0) AS drift_effect, b.fic - g.fic AS ic_delta, b.gap - g.gap AS gap_delta FROM ds b JOIN ds g ON g.profile = b.profile AND g.feature = b.feature AND b.cohort = 'bad' AND g.cohort = 'good'),
dr AS (SELECT *, coalesce(round(bad_ic, 9) * round(good_ic, 9) < 0 AND round(abs(bad_ic), 9) >= 0.02 AND round(abs(good_ic), 9) >= 0.02, false) AS ic_reversal, coalesce(round(bad_gap, 9) * round(good_gap, 9) < 0 AND round(abs(bad_gap), 9) >= 0.03 AND round(abs(good_gap), 9) >= 0.03, false) AS gap_reversal, coalesce(round(abs(drift_effect), 9) >= 0.5, false) AS drift_flag FROM dj)
SELECT profile, feature, CASE WHEN feature = 'f_quantity' THEN 'other' WHEN feature = 'f_price' THEN 'other' ELSE '4h_other' END AS family, bad_definition, bad_fold_count, good_fold_count, bad_fold_ids, good_fold_ids, bad_count, good_count, {', '.join(r(c, c) for c in ('bad_mean', 'good_mean', 'bad_std', 'good_std', 'drift_effect', 'bad_ic', 'good_ic', 'ic_delta', 'bad_gap', 'good_gap', 'gap_delta'))}, ic_reversal, gap_reversal, drift_flag,
  {r('least(coalesce(abs(drift_effect), 0), 3) + least(coalesce(abs(ic_delta), 0), 2) + 0.5 * least(coalesce(abs(gap_delta), 0), 2) + CASE WHEN ic_reversal THEN 1 ELSE 0 END + CASE WHEN gap_reversal THEN 0.75 ELSE 0 END + CASE WHEN drift_flag THEN 0.5 ELSE 0 END', 'suspect_score')},
  CASE WHEN ic_reversal AND gap_reversal THEN 'feature_signal_and_label_gap_reversal' WHEN ic_reversal THEN 'feature_return_ic_reversal' WHEN gap_reversal THEN 'feature_label_gap_reversal' WHEN drift_flag THEN 'bad_fold_distribution_drift' WHEN round(ic_delta, 9) < -0.08 THEN 'bad_fold_feature_return_ic_degrades' ELSE 'monitor' END AS issue FROM dr JOIN df USING (profile)""")
def _(spark, d):
    x = drift.feature_drift(test_rows(spark, d, *FEATURES), FEATURES, TARGET)
    n = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return x.select("profile", "feature", "family", "bad_definition", *n("bad_fold_count", "good_fold_count"), "bad_fold_ids", "good_fold_ids", *n("bad_count", "good_count"), *rs("bad_mean", "good_mean", "bad_std", "good_std", "drift_effect", "bad_ic", "good_ic", "ic_delta", "bad_gap", "good_gap", "gap_delta"), "ic_reversal", "gap_reversal", "drift_flag", *rs("suspect_score"), "issue")


SHIFT = RANKS + f""", sf AS (SELECT profile, fold, rank_ic, round(rank_ic, 12) >= {TARGET} AS good FROM ic),
sp AS (SELECT a.profile, a.fold, b.fold AS other, b.good, max(b.good) OVER (PARTITION BY a.profile, a.fold) AS has_good FROM sf a JOIN sf b ON a.profile = b.profile AND a.fold <> b.fold),
sr AS (SELECT profile, fold, other, has_good FROM sp WHERE good OR NOT has_good),
sx AS (SELECT profile, fold, prob_long AS x, 'own' AS side FROM t UNION ALL SELECT sr.profile, sr.fold, t.prob_long, 'ref' FROM sr JOIN t ON t.profile = sr.profile AND t.fold = sr.other),
sn AS (SELECT profile, fold, any_value(has_good) AS has_good, count(*) AS ref_folds FROM sr GROUP BY ALL),
sq AS (SELECT *, least(greatest(x, 1e-6), 1 - 1e-6) AS q FROM sx),
sa AS (SELECT profile, fold, side, avg(x) AS mean, stddev_pop(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg(-(q * ln(q) + (1 - q) * ln(1 - q))) AS h, min(x) AS lo, max(x) AS hi FROM sq GROUP BY ALL),
kv AS (SELECT profile, fold, x, count(*) FILTER (side = 'own') AS a, count(*) FILTER (side = 'ref') AS b FROM sx GROUP BY ALL),
kg AS (SELECT profile, fold, abs(sum(a) OVER u / sum(a) OVER k - sum(b) OVER u / sum(b) OVER k) AS gap FROM kv WINDOW u AS (PARTITION BY profile, fold ORDER BY x ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY profile, fold)),
kk AS (SELECT profile, fold, max(gap) AS ks FROM kg GROUP BY ALL),
pe AS (SELECT profile, fold, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS es FROM sx WHERE side = 'ref' GROUP BY ALL),
pi AS (SELECT profile, fold, es[2:len(es) - 1] AS inn FROM pe),
pn AS (SELECT sx.profile, sx.fold, len(list_filter(inn, lambda v: v <= x)) AS bin, count(*) FILTER (side = 'own') AS a, count(*) FILTER (side = 'ref') AS e FROM sx JOIN pi USING (profile, fold) GROUP BY ALL),
pg AS (SELECT profile, fold, unnest(range(len(inn) + 1)) AS bin FROM pi),
pf AS (SELECT pg.profile, pg.fold, greatest(coalesce(a, 0) / sum(coalesce(a, 0)) OVER w, 1e-6) AS a, greatest(coalesce(e, 0) / sum(coalesce(e, 0)) OVER w, 1e-6) AS e FROM pg LEFT JOIN pn USING (profile, fold, bin) WINDOW w AS (PARTITION BY pg.profile, pg.fold)),
ps AS (SELECT profile, fold, sum((a - e) * ln(a / e)) AS psi FROM pf GROUP BY ALL),
sh AS (SELECT sf.profile, sf.fold, rank_ic, CASE WHEN round(rank_ic, 12) < 0 THEN 'negative_rank_ic' WHEN round(rank_ic, 12) < {TARGET} THEN 'below_target_rank_ic' ELSE 'rank_ic_ok' END AS bucket, CASE WHEN has_good THEN 'other_folds_rank_ic_ge_{TARGET:.3f}' ELSE 'all_other_folds' END AS reference, ref_folds, ks, psi, o.mean AS mean_prob, f.mean AS ref_mean_prob, o.mean - f.mean AS mean_delta, o.sd AS prob_std, o.sd / nullif(f.sd, 0) AS std_ratio, o.iqr AS iqr, f.iqr AS ref_iqr, o.h - f.h AS entropy_delta,
  CASE WHEN round(psi, 9) >= 0.25 THEN 'major_score_distribution_shift' WHEN round(ks, 9) >= 0.2 THEN 'large_score_distribution_ks_shift' WHEN round(abs(o.h - f.h), 9) >= 0.05 THEN 'score_uncertainty_shift' ELSE 'monitor' END AS issue
  FROM sf JOIN sn USING (profile, fold) JOIN kk USING (profile, fold) JOIN ps USING (profile, fold) JOIN sa o ON o.profile = sf.profile AND o.fold = sf.fold AND o.side = 'own' JOIN sa f ON f.profile = sf.profile AND f.fold = sf.fold AND f.side = 'ref')"""
SHIFT_COLUMNS = ["rank_ic", "ks", "psi", "mean_prob", "ref_mean_prob", "mean_delta", "prob_std", "std_ratio", "iqr", "ref_iqr", "entropy_delta"]


@query("e16_leave_one_out_shift", P3 + SHIFT + f" SELECT profile, fold, bucket, reference, ref_folds, {', '.join(r(c, c) for c in SHIFT_COLUMNS)}, issue FROM sh")
def _(spark, d):
    return drift.score_shift(test_rows(spark, d), TARGET).select(*KEYS, "bucket", "reference", "ref_folds", *rs(*SHIFT_COLUMNS), "issue")


@query("e16_shift_summary", P3 + SHIFT + f""", su AS (SELECT profile, count(*) AS fold_count, count(*) FILTER (round(rank_ic, 12) < {TARGET}) AS bad_fold_count, avg(ks) AS mean_ks, max(ks) AS max_ks, avg(psi) AS mean_psi, max(psi) AS max_psi, avg(psi) FILTER (round(rank_ic, 12) < {TARGET}) AS bad_psi_mean, avg(psi) FILTER (round(rank_ic, 12) >= {TARGET}) AS good_psi_mean, count(*) FILTER (round(psi, 9) >= 0.25 OR round(ks, 9) >= 0.2) AS high_shift_folds, coalesce(string_agg(fold::VARCHAR, ',' ORDER BY fold) FILTER (round(psi, 9) >= 0.25 OR round(ks, 9) >= 0.2), '') AS high_shift_fold_ids FROM sh GROUP BY profile)
SELECT profile, fold_count, bad_fold_count, {', '.join(r(c, c) for c in ('mean_ks', 'max_ks', 'mean_psi', 'max_psi', 'bad_psi_mean', 'good_psi_mean'))}, high_shift_folds, high_shift_fold_ids, CASE WHEN high_shift_folds > 0 AND coalesce(round(bad_psi_mean - good_psi_mean, 9) > 0.05, false) THEN 'bad_folds_show_score_distribution_shift' WHEN high_shift_folds > 0 THEN 'score_distribution_shift_not_specific_to_bad_folds' ELSE 'monitor' END AS issue FROM su""")
def _(spark, d):
    s = drift.score_shift_summary(drift.score_shift(test_rows(spark, d), TARGET), TARGET)
    return s.select("profile", "fold_count", "bad_fold_count", *rs("mean_ks", "max_ks", "mean_psi", "max_psi", "bad_psi_mean", "good_psi_mean"), "high_shift_folds", "high_shift_fold_ids", "issue")


GATES_SQL = " UNION ALL ".join(f"SELECT *, '{name}' AS gate, {rules.reasons_sql(own)} = '' AS gate_passed FROM rv" for name, own in rules.RELIABILITY.items())
RELIABLE_SQL = RANKS + thresholds_sql(t=TARGETS) + BANDED + f""", vk AS (SELECT *, rank() OVER (PARTITION BY profile, fold ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, fold, prob_long) - 1) / 2 AS rx, rank() OVER (PARTITION BY profile, fold ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, fold, forward_return) - 1) / 2 AS ry FROM preds WHERE split = 'val'),
va AS (SELECT profile, fold, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END AS val_rank_ic, avg(prob_long) FILTER (label = 1) - avg(prob_long) FILTER (label = 0) AS val_score_gap, avg(label) AS val_label_rate, stddev_pop(prob_long) AS val_prob_std, avg((prob_long >= 0.5)::INT) AS val_pred_rate_050, count(DISTINCT prob_long) > 1 AND avg(label) > 0 AND avg(label) < 1 AS two FROM vk GROUP BY ALL),
vv AS (SELECT profile, fold, prob_long AS x, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM vk GROUP BY ALL),
vg AS (SELECT profile, fold, abs(sum(a) OVER u / nullif(sum(a) OVER k, 0) - sum(b) OVER u / nullif(sum(b) OVER k, 0)) AS gap FROM vv WINDOW u AS (PARTITION BY profile, fold ORDER BY x ROWS UNBOUNDED PRECEDING), k AS (PARTITION BY profile, fold)),
vs AS (SELECT profile, fold, max(gap) AS val_score_ks FROM vg GROUP BY ALL),
vp AS (SELECT profile, fold, sum(pos / all_pos * cpos / cn) AS ap FROM st WHERE split = 'val' AND all_pos > 0 GROUP BY ALL),
rv AS (SELECT va.* EXCLUDE (two), val_score_ks, CASE WHEN two THEN ap END AS val_average_precision, ic.rank_ic AS test_rank_ic, td.test_f1_constrained AS test_official_f1, td.test_pred_rate_constrained AS test_official_rate, bs.lift AS test_top_10_lift, bs.mean_return AS test_top_10_return FROM va JOIN vs USING (profile, fold) LEFT JOIN vp USING (profile, fold) JOIN ic ON ic.profile = va.profile AND ic.fold = va.fold LEFT JOIN td ON td.profile = va.profile AND td.fold = va.fold LEFT JOIN bs ON bs.profile = va.profile AND bs.fold = va.fold AND bs.band = 'top_10'),
rd AS ({GATES_SQL})"""
RELIABLE_COLUMNS = ["val_rank_ic", "val_score_gap", "val_score_ks", "val_average_precision", "val_label_rate", "val_prob_std", "val_pred_rate_050", "test_rank_ic", "test_official_f1", "test_official_rate", "test_top_10_lift", "test_top_10_return"]


def reliability(spark, d):
    p = rows(spark, d)
    return policies.reliability_gates(p, review.threshold_diagnostics(p, TARGETS.most_rate, TARGETS.least_precision), top_bands(p))


@query("e17_reliability_gates", P3 + RELIABLE_SQL + f" SELECT profile, fold, gate, gate_passed, {', '.join(r(c, c) for c in RELIABLE_COLUMNS)} FROM rd")
def _(spark, d):
    return reliability(spark, d).select(*KEYS, "gate", "gate_passed", *rs(*RELIABLE_COLUMNS))


RELSUM = ["accepted_fraction", "all_rank_ic_mean", "all_rank_ic_std", "accepted_rank_ic_mean", "accepted_rank_ic_std", "accepted_positive_ic_fraction", "accepted_f1_mean", "accepted_top_10_return_mean", "rejected_negative_capture_rate", "false_reject_positive_rate", "accepted_mean_delta", "accepted_std_delta", "accepted_f1_delta"]


@query("e17_reliability_summary", P3 + RELIABLE_SQL + f""", rs AS (SELECT profile, gate, count(*) AS folds, count(*) FILTER (gate_passed) AS accepted_folds, count(*) FILTER (gate_passed) / count(*) AS accepted_fraction, avg(test_rank_ic) AS all_rank_ic_mean, stddev_samp(test_rank_ic) AS all_rank_ic_std, avg(test_rank_ic) FILTER (gate_passed) AS accepted_rank_ic_mean, stddev_samp(test_rank_ic) FILTER (gate_passed) AS accepted_rank_ic_std, avg((test_rank_ic > 0)::INT) FILTER (gate_passed) AS accepted_positive_ic_fraction, avg(test_official_f1) FILTER (gate_passed) AS accepted_f1_mean, avg(test_top_10_return) FILTER (gate_passed) AS accepted_top_10_return_mean,
  count(*) FILTER (NOT gate_passed AND test_rank_ic < 0) / nullif(count(*) FILTER (test_rank_ic < 0), 0) AS rejected_negative_capture_rate, count(*) FILTER (NOT gate_passed AND test_rank_ic > 0) / nullif(count(*) FILTER (test_rank_ic > 0), 0) AS false_reject_positive_rate, avg(test_official_f1) AS f1 FROM rd GROUP BY profile, gate),
ru AS (SELECT *, accepted_rank_ic_mean - all_rank_ic_mean AS accepted_mean_delta, accepted_rank_ic_std - all_rank_ic_std AS accepted_std_delta, accepted_f1_mean - f1 AS accepted_f1_delta FROM rs)
SELECT profile, gate, folds, accepted_folds, {', '.join(r(c, c) for c in RELSUM)}, {rules.reasons_sql(RELIABLE)} AS reject_reason FROM ru""")
def _(spark, d):
    return policies.reliability_summary(reliability(spark, d), RELIABLE).select("profile", "gate", "folds", "accepted_folds", *rs(*RELSUM), "reject_reason")


@query("e21_oos_monitor", P3 + f", g AS (SELECT profile, max(ts) AS latest_data_end, TIMESTAMP '{START}' AS anchor_data_end FROM preds WHERE profile <> 'beta' OR ts < TIMESTAMP '{START}' + INTERVAL 9 DAY GROUP BY profile), n AS (SELECT *, greatest(0, floor(epoch(latest_data_end - anchor_data_end) / 3600))::BIGINT AS new_bars FROM g) SELECT *, greatest(0, 720 - new_bars) AS least_bars_remaining, greatest(0, 20000 - new_bars) AS preferred_bars_remaining, new_bars >= 720 AS ready, new_bars >= 20000 AS preferred_ready, true AS roll_forward_locked, CASE WHEN new_bars >= 720 THEN 'future_oos_window_available' ELSE 'wait_for_new_unseen_bars' END AS next_action FROM n")
def _(spark, d):
    """Bars of time since the holdout's start; one profile's data end soon after it."""
    p = rows(spark, d).where((F.col("profile") != "beta") | (F.col("ts") < held_from() + F.expr("interval 9 days")))
    return policies.oos_monitor(p, held_from(), 720, 20000, status="retired after review")
