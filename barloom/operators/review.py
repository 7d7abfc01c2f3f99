"""One row a profile, and what follows from it: threshold choice, comparison, leaders, holdout, readiness.

Everything up to the summary is grouped by profile and fold; what follows works on rows of one a
profile, so its windows over all profiles are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import flag
from barloom.operators import metrics as m
from barloom.operators import ranks, reports
from barloom.sources.shared import written

KEYS = ["profile", "fold"]


@dataclass(frozen=True)
class Targets:
    """What a profile must reach."""

    rank_ic: float = 0.03
    rank_ic_std: float = 0.03
    positive_ic: float = 0.75
    long_f1: float = 0.45
    most_rate: float = 0.70
    least_precision: float = 0.30


def threshold_diagnostics(preds: DataFrame, most_rate: float = 0.70, least_precision: float = 0.30, steps: DataFrame | None = None) -> DataFrame:
    """Per profile and fold: the best and the constrained threshold of the val rows applied to the test rows, beside
    0.5 and the best that the test rows allow. A fold without val rows takes its thresholds from the test rows.

    All of it follows from one table of score steps by profile, fold and split, which is made of preds if not given."""
    steps = steps if steps is not None else written(m.score_steps(preds, [*KEYS, "split"]), "score-steps")
    sides = steps.groupBy(*KEYS).agg(F.max(flag(F.col("split") == "val")).alias("_has_val"))
    sided = steps.join(sides, KEYS)
    source = sided.where((F.col("split") == "val") | ((F.col("_has_val") == 0) & (F.col("split") == "test")))
    test = sided.where("split = 'test'")
    best = m.best_of(source, KEYS).select(*KEYS, F.col("threshold").alias("selected_threshold"), F.col("f1").alias("source_best_f1"))
    con = m.constrained_of(source, KEYS, F.lit(most_rate), least_precision).select(*KEYS, F.col("threshold").alias("constrained_threshold"), F.col("f1").alias("source_constrained_f1"), F.col("constrained").alias("constraints_satisfied"))
    oracle = m.best_of(test, KEYS).select(*KEYS, F.col("threshold").alias("oracle_threshold"), F.col("f1").alias("oracle_f1"))
    thresholds = written(best.join(con, KEYS).join(oracle, KEYS).join(sides, KEYS), "fold-thresholds")  # a row a fold
    at = m.at_steps(test, thresholds, KEYS, {"selected": "selected_threshold", "constrained": "constrained_threshold", "050": F.lit(0.5)})
    kept = [F.col(f"{x}_{name}").alias(f"test_{x}_{name}") for name in ("selected", "constrained", "050") for x in ("f1", "precision", "recall", "pred_rate")]
    t = at.select(*KEYS, *kept).join(thresholds, KEYS)
    return t.withColumn("threshold_source", F.when(F.col("_has_val") == 1, "val").otherwise("same_split_oracle")).drop("_has_val")


def summary(preds: DataFrame, targets: Targets = Targets(), worst: int = 5) -> DataFrame:
    """One row a profile: correlation over folds with its tails, F1, lift, separation, thresholds and the guarded choice.

    The selected threshold counts if its mean F1, precision and prediction rate on test rows are in bounds, else the
    constrained one, with the reasons."""
    used = [c for c in ("profile", "fold", "split", "row_pos", "ts", "prob_long", "label", "forward_return") if c in preds.columns]
    preds = ranks.settled(preds.select(*used), "review-predictions")
    test = preds.where("split = 'test'")
    ic = m.rank_ic(test, KEYS)
    up = F.row_number().over(Window.partitionBy("profile").orderBy("rank_ic", "fold"))  # a row a fold
    x = F.col("rank_ic")
    folds = ic.withColumn("_up", up).groupBy("profile").agg(F.count("*").alias("folds"), F.avg(x).alias("mean_rank_ic"), F.stddev_pop(x).alias("std_rank_ic"), F.avg(flag(x > 0)).alias("positive_ic_fraction"), F.avg(F.when(F.col("_up") <= worst, x)).alias("worst_rank_ic"))
    t = threshold_diagnostics(preds, targets.most_rate, targets.least_precision)
    names = [c for c in t.columns if c.startswith("test_")] + ["selected_threshold", "constrained_threshold", "oracle_f1"]
    means = t.groupBy("profile").agg(*[F.avg(c).alias(c) for c in names])
    on, off = F.avg(F.when(F.col("label") == 1, F.col("prob_long"))), F.avg(F.when(F.col("label") == 0, F.col("prob_long")))
    whole = test.groupBy("profile").agg((on - off).alias("separation"), F.avg("label").alias("label_rate"), F.min("ts").alias("data_start"), F.max("ts").alias("data_end"))
    sums = {"pos": F.col("label"), "labelled": flag(F.col("label").isNotNull())}
    top = ranks.bin_sums(test.select("profile", "row_pos", "prob_long", "label"), [F.col("prob_long"), F.col("row_pos")], 10, ["profile"], sums).where("bin = 9").select("profile", F.try_divide("pos", "labelled").alias("top_rate"))
    s = folds.join(means, "profile").join(whole, "profile").join(top, "profile").withColumn("top_10_lift", F.try_divide(F.col("top_rate"), F.col("label_rate"))).drop("top_rate", "label_rate")
    return guarded(s, targets)


def guarded(s: DataFrame, targets: Targets) -> DataFrame:
    """Summary rows plus the guarded threshold and whether the profile passes with it."""
    # fixed values: the names of reasons and sources
    why = reports.reasons(
        ("selected_threshold_pred_long_rate_above_guardrail", F.col("test_pred_rate_selected") > targets.most_rate),
        ("selected_threshold_precision_below_minimum", F.col("test_precision_selected") < targets.least_precision),
        ("selected_threshold_f1_below_target", F.col("test_f1_selected") <= targets.long_f1),
    )
    s = s.withColumn("guarded_reason", why)
    own = F.col("guarded_reason") == ""
    s = s.withColumn("guarded_source", F.when(own, "validation_selected_threshold").otherwise("validation_constrained_threshold"))
    s = s.withColumn("guarded_threshold", F.when(own, F.col("selected_threshold")).otherwise(F.col("constrained_threshold")))
    s = s.withColumns({f"guarded_{c}": F.when(own, F.col(f"test_{c}_selected")).otherwise(F.col(f"test_{c}_constrained")) for c in ("f1", "precision", "recall", "pred_rate")})
    core = (F.col("mean_rank_ic") > targets.rank_ic) & (F.col("std_rank_ic") < targets.rank_ic_std) & (F.col("positive_ic_fraction") > targets.positive_ic) & (F.col("separation") > 0)
    good = (F.col("guarded_f1") > targets.long_f1) & (F.col("guarded_precision") >= targets.least_precision) & (F.col("guarded_pred_rate") <= targets.most_rate)
    return s.withColumns({"passed": core & (F.col("test_f1_050") > targets.long_f1), "passed_guarded": core & good})


def comparison(s: DataFrame, control: str) -> DataFrame:
    """Summary rows beside the control's: differences, and the place among candidates (the best first; NULL for the control)."""
    every = Window.partitionBy(F.lit(0))
    of = lambda c: F.max(F.when(F.col("profile") == control, F.col(c))).over(every)
    cols = ["mean_rank_ic", "std_rank_ic", "positive_ic_fraction", "top_10_lift", "worst_rank_ic"]
    c = s.withColumns({f"{x}_delta": F.col(x) - of(x) for x in cols}).withColumn("is_control", F.col("profile") == control)
    order = Window.partitionBy("is_control").orderBy(F.desc("passed"), *[F.desc(F.round(x, 9)) for x in ("mean_rank_ic", "top_10_lift", "worst_rank_ic")], "profile")
    return c.withColumn("place", F.when(~F.col("is_control"), F.row_number().over(order)))


#: What a leader of each role must reach against the control, and what leaders are ordered by.
ROLES = {
    "balanced": ([("mean_rank_ic_delta", ">=", 0.0), ("std_rank_ic_delta", "<=", 0.0), ("top_10_lift", ">=", 1.0)], ["-mean_rank_ic", "std_rank_ic", "-positive_ic_fraction", "-top_10_lift", "-worst_rank_ic"]),
    "tail_lift": ([("top_10_lift_delta", ">=", 0.0)], ["-top_10_lift", "-mean_rank_ic", "-worst_rank_ic"]),
    "stability": ([("worst_rank_ic_delta", ">=", 0.0), ("std_rank_ic_delta", "<=", 0.0)], ["-mean_rank_ic", "-worst_rank_ic", "std_rank_ic", "-positive_ic_fraction"]),
}


def blend_review(compared: DataFrame, roles: dict = ROLES) -> DataFrame:
    """Candidates with the gates they fail in each role, and the leader of each role."""
    out = compared.where(~F.col("is_control"))
    for role, (gates, order) in roles.items():
        fails = [(name, F.col(name) < bound if op == ">=" else F.col(name) > bound) for name, op, bound in gates]
        out = out.withColumn(f"{role}_reject_reason", reports.reasons(*fails))
        by = [F.desc(F.round(c[1:], 9)) if c[0] == "-" else F.asc(F.round(c, 9)) for c in order]
        rank = F.row_number().over(Window.partitionBy(F.col(f"{role}_reject_reason") == "").orderBy(*by, "profile"))
        out = out.withColumn(f"{role}_leader", (F.col(f"{role}_reject_reason") == "") & (rank == 1))
    return out.withColumn("leader_roles", F.concat_ws(",", *[F.when(F.col(f"{r}_leader"), r) for r in roles]))


def holdout_split(preds: DataFrame, start: Column) -> DataFrame:
    """preds plus part: selection before start, holdout from it on."""
    return preds.withColumn("part", F.when(F.col("ts") >= start, "holdout").otherwise("selection"))


def boundary_audit(selection: DataFrame, start: Column) -> DataFrame:
    """Whether each profile's selection rows end before the reserved holdout."""
    g = selection.groupBy("profile").agg(F.min("ts").alias("data_start"), F.max("ts").alias("data_end"), start.alias("holdout_start"))
    ok = F.coalesce(F.col("data_end") < F.col("holdout_start"), F.lit(False))
    return g.withColumns({"passed": ok, "reason": F.when(F.col("data_end").isNull(), "missing_entry_data_end").when(~ok, "entry_data_end_reaches_reserved_holdout").otherwise("")})


def holdout_evaluation(parts: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Each profile's holdout rows under the mean guarded threshold of its selection rows: signal and threshold verdicts."""
    chosen = summary(parts.where("part = 'selection'"), targets).select("profile", F.col("mean_rank_ic").alias("cv_rank_ic"), "guarded_threshold", F.col("guarded_f1").alias("cv_f1"))
    chosen = written(chosen, "holdout-thresholds")  # a row a profile
    held = parts.where("part = 'holdout'").select("profile", "row_pos", "prob_long", "label", "forward_return").join(chosen, "profile")
    held = ranks.settled(held, "holdout-rows")
    ic = m.rank_ic(held, ["profile"]).select("profile", F.col("rank_ic").alias("holdout_rank_ic"), F.col("n").alias("holdout_rows"))
    at = m.at_threshold("prob_long", "label", F.col("guarded_threshold"))
    g = held.groupBy("profile").agg(*[at[c].alias(f"holdout_{c}") for c in ("f1", "precision", "pred_rate")], F.avg("label").alias("_rate"))
    top = ranks.quantile_bin(held.select("profile", "row_pos", "prob_long", "label"), [F.col("prob_long"), F.col("row_pos")], 10, ["profile"]).where("bin = 9").groupBy("profile").agg(F.avg("label").alias("_top"))
    e = chosen.join(ic, "profile").join(g, "profile").join(top, "profile").withColumn("holdout_lift", F.try_divide(F.col("_top"), F.col("_rate"))).drop("_rate", "_top")
    signal = reports.reasons(("rank_ic_not_positive", F.col("holdout_rank_ic") <= 0), ("lift_not_above_one", ~(F.col("holdout_lift") > 1)))
    limits = reports.reasons(("f1_below_target", F.col("holdout_f1") <= targets.long_f1), ("precision_below_minimum", F.col("holdout_precision") < targets.least_precision), ("pred_rate_above_guardrail", F.col("holdout_pred_rate") > targets.most_rate))
    e = e.withColumns({"signal_reject_reason": signal, "threshold_reject_reason": limits})
    return e.withColumn("action", F.when((F.col("signal_reject_reason") == "") & (F.col("threshold_reject_reason") == ""), "review_threshold_and_policy").when(F.col("signal_reject_reason") == "", "review_policy_only").otherwise("keep_control_profile"))


#: (metric, target of Targets, whether it must be above, blocker) in order of priority.
CHECKS = (
    ("mean_rank_ic", "rank_ic", True, "mean_rank_ic_below_target"),
    ("std_rank_ic", "rank_ic_std", False, "rank_ic_std_above_target"),
    ("positive_ic_fraction", "positive_ic", True, "positive_ic_fraction_below_target"),
    ("guarded_f1", "long_f1", True, "long_f1_below_target"),
)


def performance_gap(s: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """profile, metric, value, target, gap (positive where missed), met, priority, blocker: one row a check."""
    rows = []
    for i, (metric, name, above, blocker) in enumerate(CHECKS):
        goal, value = F.lit(float(getattr(targets, name))), F.col(metric).cast("double")
        rows.append(F.struct(F.lit(metric).alias("metric"), value.alias("value"), goal.alias("target"), (goal - value if above else value - goal).alias("gap"), F.coalesce(value > goal if above else value < goal, F.lit(False)).alias("met"), F.lit(i + 1).alias("priority"), F.lit(blocker).alias("blocker")))
    return s.select("profile", F.explode(F.array(*rows)).alias("x")).select("profile", "x.*")


def readiness(s: DataFrame, leakage_passed: Column, holdout_ready: Column, targets: Targets = Targets()) -> DataFrame:
    """One row a profile: every blocker in order of priority, and the decision."""
    gaps = performance_gap(s, targets).where(~F.col("met"))
    missed = gaps.groupBy("profile").agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "blocker"))), lambda b: b["blocker"]).alias("_gaps"))
    more = F.array_compact(F.array(F.when(~(F.col("separation") > 0), "calibration_separation_not_positive"), F.when(~leakage_passed, "mtf_leakage_check_failed"), F.when(~holdout_ready, "future_unseen_oos_not_ready")))
    r = s.join(missed, "profile", "left").withColumn("_all", F.concat(F.coalesce("_gaps", F.array().cast("array<string>")), more))
    return r.select("profile", F.array_join("_all", ";").alias("blockers"), F.size("_all").alias("blocker_count"), (F.size("_all") == 0).alias("ready"))
