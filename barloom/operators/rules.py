"""Decision rules as data: what a metric must reach, in the order in which reasons are told.

A rule names a metric of a one-row-a-key table, the side it must be on, and a bound that may be relative to the
control's value of the same metric. All rules of a set are evaluated by one expression, so that gates of any kind
(promotion, policy, reliability, thresholds) are tables of rules and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Whether a value is on the right side of its bound.
SIDES = {
    ">": lambda x, b: x > b,
    ">=": lambda x, b: x >= b,
    "<": lambda x, b: x < b,
    "<=": lambda x, b: x <= b,
}


class Rule(NamedTuple):
    #: What is told where the rule isn't met.
    reason: str
    metric: str
    side: str
    bound: float = 0.0
    #: "" or the prefix of the columns that the bound is added to: control_ makes it relative to control_<metric>.
    against: str = ""
    #: Whether a missing value meets the rule.
    missing_meets: bool = False
    #: The bound is never below this.
    least: float | None = None


def met(rule: Rule, digits: int = 9) -> Column:
    """Whether a row meets the rule. Values are compared as rounded, so that a sum that is zero but for the order of
    its terms is zero."""
    bound = F.lit(float(rule.bound))
    if rule.against:
        bound = bound + F.col(f"{rule.against}{rule.metric}").cast("double")
    if rule.least is not None:
        bound = F.greatest(bound, F.lit(float(rule.least)))
    x = F.col(rule.metric).cast("double")
    ok = SIDES[rule.side](F.round(x, digits), F.round(bound, digits))
    return F.coalesce(F.when(~F.isnan(x), ok), F.lit(rule.missing_meets))


def reasons(rules: Iterable[Rule]) -> Column:
    """Reasons of the rules that aren't met, in order, each once, joined by semicolons."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(~met(x), F.lit(x.reason)) for x in rules]))), ";")


def beside_control(df: DataFrame, control: str, metrics: Iterable[str], by: list[str] | None = None, key: str = "profile") -> DataFrame:
    """df plus control_<metric>: the control's row, of the same `by`. One row a profile and `by`, so windows are small."""
    every = Window.partitionBy(*(by or [F.lit(0)]))
    own = lambda c: F.max(F.when(F.col(key) == control, F.col(c).cast("double"))).over(every)
    return df.withColumns({f"control_{c}": own(c) for c in metrics})


# The sets below are fixed values: reasons, metrics, bounds and their order.

#: A profile's trial against the control before a full run, with the usual bounds.
TRIAGE = (
    Rule("mean_rank_ic_delta", "mean_rank_ic", ">=", 0.005, "control_"),
    Rule("std_rank_ic", "std_rank_ic", "<=", 0.005, "control_"),
    Rule("positive_ic_fraction", "positive_ic_fraction", ">=", 0.0, "control_"),
    Rule("top_10_lift_global", "top_10_lift", ">=", 1.05),
    Rule("top_10_positive_lift_fold_rate", "top_10_positive_lift_fold_rate", ">=", 0.55),
    Rule("mtf_leakage", "mtf_leakage_passed", ">=", 1.0),
    Rule("stationarity_policy", "stationarity_policy_passed", ">=", 1.0),
)

#: The same after a full run, of profiles that don't pass the first phase by themselves.
FULL = (
    Rule("mean_rank_ic_delta", "mean_rank_ic", ">=", 0.005, "control_"),
    Rule("positive_ic_fraction", "positive_ic_fraction", ">=", 0.0, "control_", least=0.75),
    Rule("std_rank_ic", "std_rank_ic", "<=", 0.0, "control_"),
    Rule("official_pred_long_rate", "guarded_pred_rate", "<=", 0.70, missing_meets=True),
    Rule("top_10_lift_global_delta", "top_10_lift", ">=", 0.05, "control_"),
    Rule("mtf_leakage", "mtf_leakage_passed", ">=", 1.0),
    Rule("stationarity_policy", "stationarity_policy_passed", ">=", 1.0),
)

#: A score policy (a band, or a threshold under a cap) that may be chosen.
POLICY = (
    Rule("selection_rate", "selection_rate", "<=", 0.70),
    Rule("precision", "precision", ">=", 0.30),
    Rule("lift_vs_base", "lift_vs_base", ">", 1.0),
    Rule("mean_forward_return", "mean_forward_return", ">", 0.0),
    Rule("positive_lift_fold_rate", "positive_lift_fold_rate", ">=", 0.55, missing_meets=True),
    Rule("positive_forward_return_fold_rate", "positive_forward_return_fold_rate", ">=", 0.55, missing_meets=True),
)

#: Gates on a fold's validation rows alone: name -> rules.
RELIABILITY = {
    "val_rank_ic_positive": (Rule("min_val_rank_ic", "val_rank_ic", ">=", 0.0),),
    "val_score_gap_positive": (Rule("min_val_score_gap", "val_score_gap", ">=", 0.0),),
    "val_rank_ic_and_score_gap_positive": (Rule("min_val_rank_ic", "val_rank_ic", ">=", 0.0), Rule("min_val_score_gap", "val_score_gap", ">=", 0.0)),
    "val_rank_ic_score_gap_and_ks": (Rule("min_val_rank_ic", "val_rank_ic", ">=", 0.0), Rule("min_val_score_gap", "val_score_gap", ">=", 0.0), Rule("min_val_score_ks", "val_score_ks", ">=", 0.08)),
}

#: What the folds that a gate accepts must be like.
RELIABLE = (
    Rule("accepted_fold_count", "accepted_folds", ">=", 12),
    Rule("accepted_fraction", "accepted_fraction", ">=", 0.50),
    Rule("accepted_positive_ic_fraction", "accepted_positive_ic_fraction", ">=", 0.75),
    Rule("accepted_rank_ic_std", "accepted_rank_ic_std", "<=", 0.06),
    Rule("accepted_official_f1_delta", "accepted_f1_delta", ">=", 0.0),
    Rule("does_not_reduce_rank_ic_std", "accepted_std_delta", "<", 0.0, missing_meets=True),
)

#: A fold's thresholds by regime against its own constrained threshold.
REGIME_FOLD = (
    Rule("test_f1", "test_f1", ">=", 0.45),
    Rule("test_precision", "test_precision", ">=", 0.30),
    Rule("test_pred_long_rate", "test_pred_rate", "<=", 0.70),
    Rule("f1_not_above_official", "f1_delta", ">", 0.0, missing_meets=True),
    Rule("selected_forward_return", "test_mean_return", ">", 0.0, missing_meets=True),
)

#: The same over a profile's folds.
REGIME_POLICY = (
    Rule("test_f1", "test_f1_mean", ">=", 0.45),
    Rule("test_pred_long_rate", "test_pred_rate_mean", "<=", 0.70),
    Rule("f1_delta_vs_official", "f1_delta_mean", ">=", 0.01),
    Rule("policy_pass_fold_rate", "passed_fold_rate", ">=", 0.55),
    Rule("positive_forward_return_fold_rate", "positive_return_fold_rate", ">=", 0.55),
)


def rebound(rules: Iterable[Rule], **bounds: float) -> tuple[Rule, ...]:
    """The rules with other bounds, by reason."""
    rules = tuple(rules)
    if unknown := set(bounds) - {x.reason for x in rules}:
        raise ValueError(f"no rule is called {', '.join(sorted(unknown))}")
    return tuple(x._replace(bound=bounds[x.reason]) if x.reason in bounds else x for x in rules)


def reasons_sql(rules: Iterable[Rule], digits: int = 9) -> str:
    """The same as a DuckDB expression."""
    parts = []
    for x in rules:
        bound = f"{float(x.bound)!r}::DOUBLE" + (f" + {x.against}{x.metric}::DOUBLE" if x.against else "")
        bound = f"greatest({bound}, {x.least})" if x.least is not None else bound
        parts.append(f"CASE WHEN NOT coalesce(round({x.metric}::DOUBLE, {digits}) {x.side} round({bound}, {digits}), {'true' if x.missing_meets else 'false'}) THEN '{x.reason}' END")
    return f"concat_ws(';', {', '.join(parts)})"
