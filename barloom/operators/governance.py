"""Driver-side rules: feature profiles, promotion decisions and holdout policy.

These work on names, settings and one-row summaries, never on data rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from copy import deepcopy
from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = {"symbol", "ts", "timestamp", "open", "high", "low", "close", "volume", "quote_volume", "num_trades", "close_time", "taker_buy_base_vol", "taker_buy_quote_vol", "pos"}
LABELS = {"label", "hit_type", "exit_bar", "exit_ts", "tb_return"}


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns that are no raw, label, fold, prediction or regime column, sorted."""
    def is_feature(f) -> bool:
        return isinstance(f.dataType, T.NumericType) and f.name not in RAW | LABELS and not f.name.startswith(("pred_", "regime_", "fold", "fwd_return"))

    return sorted(f.name for f in df.schema if is_feature(f))


def merged(base: dict, over: dict) -> dict:
    """Deep merge; the second wins."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def resolved_profile(name: str, profiles: dict[str, dict], seen: tuple[str, ...] = ()) -> dict:
    """A profile with its parents: includes add up, own excludes replace the parent's, appended excludes
    add to them, overrides merge. Unknown names and circles raise."""
    if name in seen:
        raise ValueError(f"profiles inherit in a circle: {' > '.join([*seen, name])}")
    if name not in profiles:
        raise ValueError(f"unknown profile: {name}")
    p = profiles[name]
    parent = resolved_profile(p["inherits"], profiles, (*seen, name)) if p.get("inherits") else {"include": [], "exclude": [], "overrides": {}}
    exclude = list(p.get("exclude") if p.get("exclude") is not None else parent["exclude"]) + list(p.get("append_exclude", []))
    return {"include": list(dict.fromkeys([*parent["include"], *p.get("include", [])])), "exclude": list(dict.fromkeys(exclude)), "overrides": merged(parent["overrides"], p.get("overrides", {}))}


def profile_columns(columns: list[str], profile: dict) -> list[str]:
    """Columns that match an include pattern (all, if there is none) and no exclude pattern; none left raises."""
    include = profile["include"] or ["*"]
    out = [c for c in columns if any(fnmatch(c, p) for p in include) and not any(fnmatch(c, p) for p in profile["exclude"])]
    if not out:
        raise ValueError("the profile leaves no feature")
    return out


#: Raw order-flow columns that a stable-only profile leaves out, with their slower twins.
RAW_FLOW = ("orderflow_efficiency", "absorption_pressure", "cvd_price_divergence", "signed_large_trade_pressure", "cvd_pressure")


def without_raw_flow(columns: list[str], stable_only: bool) -> list[str]:
    """columns without raw order-flow ones (and their windows), if only their stable forms count."""
    raw = lambda c: any(re.fullmatch(rf"(4h_)?{p}(_\d+(_minus_\d+)?)?", c) for p in RAW_FLOW)
    return [c for c in columns if not raw(c)] if stable_only else columns


def availability_columns(features: list[str], regime: list[str], atr: str, present: list[str]) -> list[str]:
    """What must be there before a row counts: model features, regime inputs and the range column, once each."""
    wanted = list(dict.fromkeys([*features, *regime, atr]))
    if absent := [c for c in wanted if c not in present]:
        raise ValueError(f"missing columns: {absent}")
    return wanted


def renamed(columns: list[str], aliases: dict[str, str]) -> dict[str, str]:
    """old -> new names by the first pattern that matches a whole name; two columns of one name raise."""
    out = {c: next((re.sub(p, new, c) for p, new in aliases.items() if re.fullmatch(p, c)), c) for c in columns}
    if len(set(out.values())) < len(out):
        raise ValueError("aliases give two columns one name")
    return out


def signature(settings: dict) -> str:
    """Hash of settings that does not depend on key order."""
    return hashlib.sha256(json.dumps(json_safe(settings), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def json_safe(x):
    """Numbers that JSON lacks become null; dates and other objects become text."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [json_safe(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else x.isoformat() if hasattr(x, "isoformat") else str(x)


def holdout_start(rows: int, holdout_rows: int, frozen: int | None = None, locked: bool = False) -> dict:
    """Where the holdout begins: its frozen anchor while roll-forward is locked, else the latest rows."""
    start = frozen if locked and frozen is not None else max(0, rows - holdout_rows)
    return {"start": start, "rows": rows - start, "mode": "frozen" if locked and frozen is not None else "rolling"}


def decision(candidate: dict, control: dict, holdout: dict | None, least_ic: float = 0.03, most_std: float = 0.03, least_positive: float = 0.75) -> dict:
    """Whether a candidate may be promoted, and every reason against it."""
    why = []
    if candidate["mean_ic"] <= max(least_ic, control["mean_ic"]):
        why.append("mean_ic")
    if candidate["std_ic"] >= most_std:
        why.append("std_ic")
    if candidate["positive_fraction"] <= least_positive:
        why.append("positive_fraction")
    if holdout is None:
        why.append("no_holdout")
    elif holdout["rank_ic"] <= 0 or holdout["lift"] <= 1:
        why.append("holdout")
    return {"promote": not why, "reject_reason": ";".join(why)}


def latest_run(runs: DataFrame, signature_hash: str | None = None) -> DataFrame:
    """The newest run, or the newest of one signature."""
    r = runs if signature_hash is None else runs.where(F.col("signature_hash") == signature_hash)
    return r.agg(F.max("run_id").alias("run_id"))


def write_report(table: DataFrame, path: str, most_rows: int = 100_000) -> None:
    """A small report table as CSV, JSON lines and markdown; a larger one is a data set and raises."""
    n = table.limit(most_rows + 1).count()
    if n > most_rows:
        raise ValueError("a report has too many rows; write it as a table")
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    table.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    text = table.sparkSession.createDataFrame([(markdown(table, n),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/md")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report's rows from its JSON lines; a missing or empty report has no rows."""
    try:
        return spark.read.schema(schema).json(f"{path}/json")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_predictions(preds: DataFrame, path: str) -> None:
    """Prediction rows as parquet by profile and fold, so that a fold is read alone; a rerun replaces only its own."""
    preds.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile", "fold").parquet(path)


def summary_markdown(report: dict, folds: DataFrame, most: int = 5) -> str:
    """A profile's report, then its best and worst folds by correlation."""
    lines = ["# Summary", "", *(f"- {k}: {json_safe(v)}" for k, v in report.items())]
    for title, order in (("Best", F.desc("rank_ic")), ("Worst", F.asc("rank_ic"))):
        lines += ["", f"## {title} folds", "", markdown(folds.orderBy(order, "fold"), most)]
    return "\n".join(lines)


def markdown(table: DataFrame, rows: int = 20) -> str:
    """The first rows of a sorted report as a markdown table."""
    head = table.limit(rows).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns), *("| " + " | ".join(map(show, r)) + " |" for r in head)])
