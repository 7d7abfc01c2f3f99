"""Queries of threshold choice, profile summaries, comparison, blends, holdout and readiness, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.functions.scalars import rounded as R
from barloom.operators import bars as ops
from barloom.operators import chunks, ranks, reports, review
from barloom.operators.asof import asof
from barloom.plans.bar_queries import r, rs
from barloom.plans.prediction_queries import ALL, BLENDS, P, RANKS, blends_sql
from barloom.plans.tables import USED, bars, bars_cte, preds, preds_cte, read

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
#: Targets at which the random scores of the test tables differ from each other.
TARGETS = review.Targets(rank_ic=0.0, rank_ic_std=0.02, positive_ic=0.5, long_f1=0.35, most_rate=0.9, least_precision=0.2)


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def at_sql(t: str, name: str) -> str:
    tp, fp, fn = (f"count(*) FILTER (prob_long {o} {t} AND label = {y})" for o, y in ((">=", 1), (">=", 0), ("<", 1)))
    parts = (("f1", ratio(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})")), ("precision", ratio(tp, f"({tp} + {fp})")), ("recall", ratio(tp, f"({tp} + {fn})")), ("pred_rate", ratio(f"{tp} + {fp}", "count(*)")))
    return ", ".join(f"{x} AS test_{c}_{name}" for c, x in parts)


def thresholds_sql(table: str = "preds", t: review.Targets = TARGETS) -> str:
    """td: threshold diagnostics of a predictions table."""
    return f""", s0 AS (SELECT profile, fold, split, prob_long AS threshold, count(*) AS n, sum(label) AS pos FROM {table} GROUP BY ALL),
st AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cpos, sum(n) OVER (PARTITION BY profile, fold, split) AS all_n, sum(pos) OVER (PARTITION BY profile, fold, split) AS all_pos FROM s0 WINDOW w AS (PARTITION BY profile, fold, split ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
sb AS (SELECT *, round(2 * cpos / (cn + all_pos), 12) AS f1, round(cpos / cn, 12) AS precision, cn / all_n AS rate FROM st),
plain AS (SELECT profile, fold, split, threshold, f1 FROM sb QUALIFY row_number() OVER (PARTITION BY profile, fold, split ORDER BY f1 DESC, threshold) = 1),
con AS (SELECT profile, fold, split, threshold, f1 FROM sb WHERE rate <= {t.most_rate} AND precision >= {t.least_precision} QUALIFY row_number() OVER (PARTITION BY profile, fold, split ORDER BY f1 DESC, precision DESC, rate, threshold DESC) = 1),
ch AS (SELECT p.profile, p.fold, p.threshold AS sel, p.f1 AS sel_f1, coalesce(c.threshold, p.threshold) AS con, coalesce(c.f1, p.f1) AS con_f1, c.f1 IS NOT NULL AS ok FROM plain p LEFT JOIN con c USING (profile, fold, split) WHERE p.split = 'val'),
td AS (SELECT t.profile, t.fold, {at_sql('sel', 'selected')}, {at_sql('con', 'constrained')}, {at_sql('0.5', '050')}, any_value(sel) AS selected_threshold, any_value(sel_f1) AS source_best_f1, any_value(con) AS constrained_threshold, any_value(con_f1) AS source_constrained_f1, any_value(ok) AS constraints_satisfied, any_value(o.threshold) AS oracle_threshold, any_value(o.f1) AS oracle_f1
  FROM {table} t JOIN ch ON t.profile = ch.profile AND t.fold = ch.fold JOIN plain o ON o.profile = t.profile AND o.fold = t.fold AND o.split = 'test' WHERE t.split = 'test' GROUP BY t.profile, t.fold)"""


TD = [f"test_{c}_{n}" for n in ("selected", "constrained", "050") for c in ("f1", "precision", "recall", "pred_rate")]


@query("d12_threshold_diagnostics", P3 + thresholds_sql() + " SELECT profile, fold, 'val' AS threshold_source, selected_threshold, constrained_threshold, oracle_threshold, constraints_satisfied, " + ", ".join(r(c, c) for c in [*TD, "source_best_f1", "source_constrained_f1", "oracle_f1"]) + " FROM td")
def _(spark, d):
    t = review.threshold_diagnostics(preds(spark, d, ALL), TARGETS.most_rate, TARGETS.least_precision)
    return t.select("profile", "fold", "threshold_source", "selected_threshold", "constrained_threshold", "oracle_threshold", "constraints_satisfied", *rs(*TD, "source_best_f1", "source_constrained_f1", "oracle_f1"))


def ranks_sql(table: str) -> str:
    return RANKS.replace("FROM preds", f"FROM {table}")


def summary_sql(table: str = "preds", t: review.Targets = TARGETS) -> str:
    """sm: one row a profile of a predictions table."""
    own = "guarded_reason = ''"
    core = f"mean_rank_ic > {t.rank_ic} AND std_rank_ic < {t.rank_ic_std} AND positive_ic_fraction > {t.positive_ic} AND separation > 0"
    return ranks_sql(table) + thresholds_sql(table, t) + f""", fo AS (SELECT profile, count(*) AS folds, avg(rank_ic) AS mean_rank_ic, stddev_pop(rank_ic) AS std_rank_ic, avg((rank_ic > 0)::INT) AS positive_ic_fraction, avg(rank_ic) FILTER (up <= 5) AS worst_rank_ic FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY rank_ic, fold) AS up FROM ic) GROUP BY profile),
me AS (SELECT profile, {', '.join(f'avg({c}) AS {c}' for c in [*TD, 'selected_threshold', 'constrained_threshold', 'oracle_f1'])} FROM td GROUP BY profile),
wh AS (SELECT profile, avg(prob_long) FILTER (label = 1) - avg(prob_long) FILTER (label = 0) AS separation, avg(label) AS label_rate, min(ts) AS data_start, max(ts) AS data_end FROM t GROUP BY profile),
bi AS (SELECT profile, label, CASE WHEN n = 1 THEN 0 ELSE greatest(ceil((rn - 1) * least(10, n) / (n - 1)) - 1, 0) END::INT AS bin FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY prob_long, row_pos) AS rn, count(*) OVER (PARTITION BY profile) AS n FROM t)),
tp AS (SELECT profile, avg(label) AS top_rate FROM bi WHERE bin = 9 GROUP BY profile),
s1 AS (SELECT fo.*, me.* EXCLUDE (profile), wh.* EXCLUDE (profile, label_rate), top_rate / label_rate AS top_10_lift FROM fo JOIN me USING (profile) JOIN wh USING (profile) JOIN tp USING (profile)),
s2 AS (SELECT *, concat_ws(';', CASE WHEN test_pred_rate_selected > {t.most_rate} THEN 'selected_threshold_pred_long_rate_above_guardrail' END, CASE WHEN test_precision_selected < {t.least_precision} THEN 'selected_threshold_precision_below_minimum' END, CASE WHEN test_f1_selected <= {t.long_f1} THEN 'selected_threshold_f1_below_target' END) AS guarded_reason FROM s1),
s3 AS (SELECT *, CASE WHEN {own} THEN 'validation_selected_threshold' ELSE 'validation_constrained_threshold' END AS guarded_source, CASE WHEN {own} THEN selected_threshold ELSE constrained_threshold END AS guarded_threshold, {', '.join(f'CASE WHEN {own} THEN test_{c}_selected ELSE test_{c}_constrained END AS guarded_{c}' for c in ('f1', 'precision', 'recall', 'pred_rate'))} FROM s2),
sm AS (SELECT *, {core} AND test_f1_050 > {t.long_f1} AS passed, {core} AND guarded_f1 > {t.long_f1} AND guarded_precision >= {t.least_precision} AND guarded_pred_rate <= {t.most_rate} AS passed_guarded FROM s3)"""


NUMBERS = ["mean_rank_ic", "std_rank_ic", "positive_ic_fraction", "worst_rank_ic", "separation", "top_10_lift", "selected_threshold", "constrained_threshold", "oracle_f1", "test_f1_selected", "test_f1_constrained", "test_f1_050", "guarded_threshold", "guarded_f1", "guarded_precision", "guarded_recall", "guarded_pred_rate"]
TEXTS = ["data_start", "data_end", "guarded_reason", "guarded_source", "passed", "passed_guarded"]


@query("d15_profile_summary", P3 + summary_sql() + f" SELECT profile, folds, {', '.join(TEXTS)}, {', '.join(r(c, c) for c in NUMBERS)} FROM sm")
def _(spark, d):
    """One row a profile with the guarded threshold choice (D15, D24)."""
    return review.summary(preds(spark, d, ALL, only=USED), TARGETS).select("profile", "folds", *TEXTS, *rs(*NUMBERS))


DELTAS = ["mean_rank_ic", "std_rank_ic", "positive_ic_fraction", "top_10_lift", "worst_rank_ic"]
COMPARED = f""", cp AS (SELECT s.*, s.profile = 'control' AS is_control, {', '.join(f's.{c} - c.{c} AS {c}_delta' for c in DELTAS)} FROM sm s, sm c WHERE c.profile = 'control'),
pl AS (SELECT *, CASE WHEN NOT is_control THEN row_number() OVER (PARTITION BY is_control ORDER BY passed DESC, round(mean_rank_ic, 9) DESC, round(top_10_lift, 9) DESC, round(worst_rank_ic, 9) DESC, profile) END AS place FROM cp)"""


@query("e05_comparison", P3 + summary_sql() + COMPARED + f" SELECT profile, is_control, passed, place, {', '.join(r(c, c) for c in ['mean_rank_ic', *[f'{c}_delta' for c in DELTAS]])} FROM pl")
def _(spark, d):
    c = review.comparison(review.summary(preds(spark, d, ALL, only=USED), TARGETS), "control")
    return c.select("profile", "is_control", "passed", F.col("place").cast("long").alias("place"), *rs("mean_rank_ic", *[f"{x}_delta" for x in DELTAS]))


def leaders_sql() -> str:
    out = []
    for role, (gates, order) in review.ROLES.items():
        why = "concat_ws(';', " + ", ".join(f"CASE WHEN {c} {'<' if op == '>=' else '>'} {b} THEN '{c}' END" for c, op, b in gates) + ")"
        by = ", ".join(f"round({c.lstrip('-')}, 9) {'DESC' if c[0] == '-' else 'ASC'}" for c in order)
        out.append(f"{why} AS {role}_reject_reason, {why} = '' AND row_number() OVER (PARTITION BY {why} = '' ORDER BY {by}, profile) = 1 AS {role}_leader")
    return ", ".join(out)


#: Blends as profiles: their scores with the rows' labels, beside the control.
BLENDED = ", " + blends_sql() + ", bp AS (SELECT blend || ':' || method AS profile, p.* EXCLUDE (profile, prob_long), b.score AS prob_long FROM bl b JOIN preds p ON p.row_pos = b.row_pos AND p.fold = b.fold AND p.split = b.split AND p.profile = 'control' UNION ALL BY NAME SELECT * FROM preds WHERE profile = 'control')"


def blended(spark, d):
    keys, own = ["row_pos", "fold", "split"], ["ts", "label", "forward_return"]
    p = preds(spark, d, ALL, only=USED)
    beside = reports.side_by_side(p, sorted(ALL), keys, ["fold", "split"], {"control": own})
    has = beside.where(F.col(f"n_{sorted(ALL).index('control')}") > 0)
    b = reports.blended(has, sorted(ALL), BLENDS, keys)
    b = b.select(F.concat_ws(":", "blend", "method").alias("profile"), *keys, F.col("score").alias("prob_long"), *own)
    # kept as rows of the blends: their rounded scores are not made anew at each reading
    return ranks.settled(b.unionByName(p.where("profile = 'control'").select(*b.columns)), "blend-predictions")


@query("e07_blend_review", P3 + BLENDED + summary_sql("bp") + COMPARED + f", lr AS (SELECT *, {leaders_sql()} FROM pl WHERE NOT is_control) SELECT profile, balanced_reject_reason, tail_lift_reject_reason, stability_reject_reason, concat_ws(',', CASE WHEN balanced_leader THEN 'balanced' END, CASE WHEN tail_lift_leader THEN 'tail_lift' END, CASE WHEN stability_leader THEN 'stability' END) AS leader_roles, {r('mean_rank_ic', 'mean_rank_ic')}, {r('top_10_lift', 'top_10_lift')} FROM lr")
def _(spark, d):
    b = review.blend_review(review.comparison(review.summary(blended(spark, d), TARGETS), "control"))
    return b.select("profile", *[f"{x}_reject_reason" for x in review.ROLES], "leader_roles", *rs("mean_rank_ic", "top_10_lift"))


START = "1998-01-01"
PARTS = f", sel AS (SELECT * FROM preds WHERE ts < TIMESTAMP '{START}'), hold AS (SELECT * FROM preds WHERE ts >= TIMESTAMP '{START}')"
def held_from():
    return F.expr(f"timestamp_ntz'{START}'")



@query("e20_boundary_audit", P3 + f", e AS (SELECT profile || '_before' AS profile, ts FROM preds WHERE ts < TIMESTAMP '{START}' UNION ALL SELECT profile, ts FROM preds) SELECT profile, min(ts) AS data_start, max(ts) AS data_end, TIMESTAMP '{START}' AS holdout_start, max(ts) < TIMESTAMP '{START}' AS passed, CASE WHEN max(ts) < TIMESTAMP '{START}' THEN '' ELSE 'entry_data_end_reaches_reserved_holdout' END AS reason FROM e GROUP BY profile")
def _(spark, d):
    p = preds(spark, d, ALL).select("profile", "ts")
    before = p.where(F.col("ts") < held_from()).withColumn("profile", F.concat("profile", F.lit("_before")))
    return review.boundary_audit(before.unionByName(p), held_from())


EVALUATED = summary_sql("sel") + f""", he AS (SELECT h.*, sm.guarded_threshold, sm.mean_rank_ic AS cv_rank_ic, sm.guarded_f1 AS cv_f1 FROM hold h JOIN sm USING (profile)),
hk AS (SELECT *, rank() OVER (PARTITION BY profile ORDER BY prob_long) + (count(*) OVER (PARTITION BY profile, prob_long) - 1) / 2 AS hx, rank() OVER (PARTITION BY profile ORDER BY forward_return) + (count(*) OVER (PARTITION BY profile, forward_return) - 1) / 2 AS hy,
  row_number() OVER (PARTITION BY profile ORDER BY prob_long, row_pos) AS rn, count(*) OVER (PARTITION BY profile) AS hn FROM he),
hv AS (SELECT profile, any_value(cv_rank_ic) AS cv_rank_ic, any_value(cv_f1) AS cv_f1, any_value(guarded_threshold) AS guarded_threshold, coalesce(corr(hx, hy), 0) AS holdout_rank_ic, count(*) AS holdout_rows, {at_sql('guarded_threshold', 'h')}, avg(label) FILTER (greatest(ceil((rn - 1) * least(10, hn) / (hn - 1)) - 1, 0) = 9) / avg(label) AS holdout_lift FROM hk GROUP BY profile),
hr AS (SELECT *, concat_ws(';', CASE WHEN holdout_rank_ic <= 0 THEN 'rank_ic_not_positive' END, CASE WHEN NOT holdout_lift > 1 THEN 'lift_not_above_one' END) AS signal_reject_reason, concat_ws(';', CASE WHEN test_f1_h <= {TARGETS.long_f1} THEN 'f1_below_target' END, CASE WHEN test_precision_h < {TARGETS.least_precision} THEN 'precision_below_minimum' END, CASE WHEN test_pred_rate_h > {TARGETS.most_rate} THEN 'pred_rate_above_guardrail' END) AS threshold_reject_reason FROM hv)"""


@query("e20_holdout_evaluation", P3 + PARTS + EVALUATED + f" SELECT profile, holdout_rows, signal_reject_reason, threshold_reject_reason, CASE WHEN signal_reject_reason = '' AND threshold_reject_reason = '' THEN 'review_threshold_and_policy' WHEN signal_reject_reason = '' THEN 'review_policy_only' ELSE 'keep_control_profile' END AS action, {r('cv_rank_ic', 'cv_rank_ic')}, {r('cv_f1', 'cv_f1')}, {r('guarded_threshold', 'guarded_threshold')}, {r('holdout_rank_ic', 'holdout_rank_ic')}, {r('holdout_lift', 'holdout_lift')}, {r('test_f1_h', 'holdout_f1')}, {r('test_precision_h', 'holdout_precision')}, {r('test_pred_rate_h', 'holdout_pred_rate')} FROM hr")
def _(spark, d):
    e = review.holdout_evaluation(review.holdout_split(preds(spark, d, ALL, only=USED), held_from()), TARGETS)
    return e.select("profile", "holdout_rows", "signal_reject_reason", "threshold_reject_reason", "action", *rs("cv_rank_ic", "cv_f1", "guarded_threshold", "holdout_rank_ic", "holdout_lift", "holdout_f1", "holdout_precision", "holdout_pred_rate"))


def gap_sql() -> str:
    parts = []
    for i, (metric, name, above, blocker) in enumerate(review.CHECKS):
        goal = getattr(TARGETS, name)
        parts.append(f"SELECT profile, '{metric}' AS metric, {metric} AS value, {goal}::DOUBLE AS target, {f'{goal} - {metric}' if above else f'{metric} - {goal}'} AS gap, {metric} {'>' if above else '<'} {goal} AS met, {i + 1} AS priority, '{blocker}' AS blocker FROM sm")
    return ", gp AS (" + " UNION ALL ".join(parts) + ")"


@query("e22_performance_gap", P3 + summary_sql() + gap_sql() + f" SELECT profile, metric, {r('value', 'value')}, target, {r('gap', 'gap')}, met, priority, blocker FROM gp")
def _(spark, d):
    g = review.performance_gap(review.summary(preds(spark, d, ALL, only=USED), TARGETS), TARGETS)
    return g.select("profile", "metric", *rs("value"), "target", *rs("gap"), "met", "priority", "blocker")


@query("e23_readiness", P3 + summary_sql() + gap_sql() + ", ms AS (SELECT profile, list(blocker ORDER BY priority) AS bl FROM gp WHERE NOT met GROUP BY profile), al AS (SELECT profile, list_filter(list_concat(coalesce(bl, []), [CASE WHEN NOT separation > 0 THEN 'calibration_separation_not_positive' END, CASE WHEN folds < 7 THEN 'future_unseen_oos_not_ready' END]), lambda x: x IS NOT NULL) AS bl FROM sm LEFT JOIN ms USING (profile)) SELECT profile, array_to_string(bl, ';') AS blockers, len(bl)::INT AS blocker_count, len(bl) = 0 AS ready FROM al")
def _(spark, d):
    return review.readiness(review.summary(preds(spark, d, ALL, only=USED), TARGETS), F.lit(True), F.col("folds") >= 7, TARGETS)


# --- smaller operators ------------------------------------------------------------------------


@query("j03_funding_asof", f"WITH {bars_cte()}, t AS (SELECT 'S' || (user_id % 8) AS symbol, ts, event_id AS tick, value AS rate FROM events WHERE event_type = 'purchase'), j AS (SELECT b.symbol, b.ts, t.ts AS m_ts, t.rate FROM bars b ASOF LEFT JOIN t ON b.symbol = t.symbol AND b.ts >= t.ts) SELECT symbol, ts, CASE WHEN ts - m_ts <= INTERVAL 540 MINUTE THEN rate END AS funding_rate, CASE WHEN ts - m_ts <= INTERVAL 540 MINUTE THEN 0.0 ELSE 1.0 END::DOUBLE AS funding_missing FROM j")
def _(spark, d):
    e = read(spark, d, "events").where("event_type = 'purchase'")
    f = e.select(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("rate"))
    j = asof(bars(spark, d).select("symbol", "ts"), f, tolerance_seconds=540 * 60, prefix="f_")
    return j.select("symbol", "ts", F.col("f_rate").alias("funding_rate"), F.col("f_rate").isNull().cast("double").alias("funding_missing"))


@query("w16_rolling_label_mean", f"{P} SELECT profile, row_pos, {r('CASE WHEN count(label) OVER o = 168 THEN avg(label) OVER o END', 'label_mean')} FROM preds WINDOW o AS (PARTITION BY profile, fold ORDER BY ts, row_pos ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    at = w.W.partitionBy("key").orderBy("ts", "row_pos").rowsBetween(-167, 0)
    full = F.when(F.count("label").over(at) == 168, F.avg("label").over(at))
    p = preds(spark, d).select("profile", "row_pos", "ts", "label", F.concat_ws(":", "profile", "fold").alias("key"))
    build = lambda x: x.withColumn("label_mean", R(full))
    made = build(p) if ranks.ranges_for(p) == 1 else chunks.in_chunks(p, build, 167, key="key", time=["ts", "row_pos"])
    return made.select("profile", "row_pos", "label_mean")


@query("u05_intersect_except", f"{P3}, a AS (SELECT DISTINCT fold, ts FROM preds WHERE label = 1), b AS (SELECT DISTINCT fold, ts FROM preds WHERE label = 0) SELECT 'both' AS side, fold, ts FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_long', fold, ts FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def _(spark, d):
    p = preds(spark, d, ALL).select("fold", "ts", "label")
    a, b = p.where("label = 1").select("fold", "ts"), p.where("label = 0").select("fold", "ts")
    return a.intersect(b).select(F.lit("both").alias("side"), "fold", "ts").unionByName(a.subtract(b).select(F.lit("only_long").alias("side"), "fold", "ts"))


@query("o01_best_and_worst_folds", P3 + RANKS + f" SELECT profile, fold, {r('rank_ic', 'rank_ic')}, CASE WHEN best <= 2 THEN 'best' ELSE 'worst' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY round(rank_ic, 12) DESC, fold) AS best, row_number() OVER (PARTITION BY profile ORDER BY round(rank_ic, 12), fold DESC) AS worst FROM ic) WHERE best <= 2 OR worst <= 2")
def _(spark, d):
    from barloom.operators import metrics as m

    ic = m.rank_ic(preds(spark, d, ALL).where("split = 'test'"), ["profile", "fold"])
    x = F.round("rank_ic", 12)
    at = lambda *o: F.row_number().over(w.W.partitionBy("profile").orderBy(*o))
    sided = ic.withColumns({"best": at(F.desc(x), "fold"), "worst": at(F.asc(x), F.desc("fold"))}).where("best <= 2 OR worst <= 2")
    return sided.select("profile", "fold", *rs("rank_ic"), F.when(F.col("best") <= 2, "best").otherwise("worst").alias("side"))


@query("w08_expanding_statistics", f"WITH {bars_cte()}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars) SELECT symbol, ts, n, {r('avg(close) OVER o', 'mean_so_far')}, {r('stddev_pop(close) OVER o', 'std_so_far')}, {r('(close - avg(close) OVER o) / nullif(stddev_pop(close) OVER o, 0)', 'z_so_far')} FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    o = w.ordered().rowsBetween(w.W.unboundedPreceding, 0)
    mean, sd = F.avg("close").over(o), F.stddev_pop("close").over(o)
    b = ops.positioned(bars(spark, d))
    return b.select("symbol", "ts", (F.col("pos") + 1).cast("long").alias("n"), R(mean).alias("mean_so_far"), R(sd).alias("std_so_far"), R(F.try_divide(F.col("close") - mean, F.nullif(sd, F.lit(0.0)))).alias("z_so_far"))
