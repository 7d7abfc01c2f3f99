"""Queries on bars, as-of joins, labels and folds, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import scalars as s
from barloom.functions import windows as w
from barloom.operators import bars as ops
from barloom.operators import chunks, labels, ranks
from barloom.operators.asof import asof
from barloom.operators.ewm import adx, with_ewm
from barloom.plans.tables import bars, bars_cte, ticks

R = s.rounded
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(expr: str, name: str) -> str:
    """A rounded SQL column without a negative zero."""
    return f"round({expr}, 6) + 0.0 AS {name}"


def rs(*names: str) -> list:
    return [R(F.col(n)).alias(n) for n in names]


B = f"WITH {bars_cte()}"
#: bars with row number and the frames' shorthand
P = f"{B}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos, 2 * taker_buy_base_vol - volume AS cvd FROM bars)"


def over(n: int, lo: int = 0) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(x: str, n: int, value: str) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {value} END"


def z(x: str, n: int) -> str:
    return full(x, n, f"({x} - avg({x}) {over(n)}) / CASE WHEN stddev_pop({x}) {over(n)} > 1e-12 THEN stddev_pop({x}) {over(n)} END")


def cvd(spark, d):
    return ops.positioned(bars(spark, d)).withColumn("cvd", 2 * F.col("taker_buy_base_vol") - F.col("volume"))


for _name, _sec in (("s00_bars_15m", 900), ("s00_bars_1h", 3600), ("s00_bars_4h", 14400)):
    QUERIES[_name] = lambda spark, d, n=_sec: bars(spark, d, n).select("symbol", "ts", "open", "high", "low", "close", "num_trades", *rs("volume", "quote_volume", "taker_buy_base_vol", "taker_buy_quote_vol"))
    SQL[_name] = f"WITH {bars_cte(seconds=_sec)} SELECT symbol, ts, open, high, low, close, num_trades, {r('volume', 'volume')}, {r('quote_volume', 'quote_volume')}, {r('taker_buy_base_vol', 'taker_buy_base_vol')}, {r('taker_buy_quote_vol', 'taker_buy_quote_vol')} FROM bars"


@query("w01_rolling_mean_sum", f"{P} SELECT symbol, ts, {r(full('volume', 12, f'avg(volume) {over(12)}'), 'mean_12')}, {r(full('quote_volume', 12, f'sum(quote_volume) {over(12)}'), 'sum_12')} FROM b")
def _(spark, d):
    return bars(spark, d).select("symbol", "ts", R(w.mean(F.col("volume"), 12)).alias("mean_12"), R(w.total(F.col("quote_volume"), 12)).alias("sum_12"))


@query("w02_rolling_zscore", f"{P} SELECT symbol, ts, {r('cvd', 'cvd')}, {r(z('cvd', 24), 'cvd_zscore')} FROM b")
def _(spark, d):
    return cvd(spark, d).select("symbol", "ts", *rs("cvd"), R(w.zscore(F.col("cvd"), 24)).alias("cvd_zscore"))


@query("w03_mid_rank", f"{P}, l AS (SELECT *, list(close) {over(24)} AS seen FROM b) SELECT symbol, ts, {r('CASE WHEN len(seen) = 24 THEN 2 * (len(list_filter(seen, lambda v: v < close)) + 0.5 * len(list_filter(seen, lambda v: v = close))) / 24 - 1 END', 'rank_24')} FROM l")
def _(spark, d):
    return bars(spark, d).select("symbol", "ts", R(w.mid_rank(F.col("close"), 24)).alias("rank_24"))


@query("w04_rolling_slope", f"{P} SELECT symbol, ts, {r(full('close', 24, f'regr_slope(close, pos) {over(24)}'), 'slope_24')} FROM b")
def _(spark, d):
    return cvd(spark, d).select("symbol", "ts", R(w.slope(F.col("close"), 24)).alias("slope_24"))


@query("w05_group_slope", f"{P} SELECT symbol, count(*) AS n, {r('CASE WHEN count(*) >= 2 THEN regr_slope(volume, pos) END', 'slope')} FROM b GROUP BY symbol")
def _(spark, d):
    return cvd(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), R(F.when(F.count("*") >= 2, F.regr_slope("volume", F.col("pos").cast("double")))).alias("slope"))


@query("w06_rolling_median", f"{P} SELECT symbol, ts, {r(full('close', 24, f'quantile_cont(close, 0.5) {over(24)}'), 'median_24')} FROM b")
def _(spark, d):
    return bars(spark, d).select("symbol", "ts", R(w.median(F.col("close"), 24)).alias("median_24"))


@query("w07_lag_lead", f"{P} SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before, lead(close, 3) OVER (PARTITION BY symbol ORDER BY ts) AS ahead_3, {r('close - lag(close) OVER (PARTITION BY symbol ORDER BY ts)', 'diff')} FROM b")
def _(spark, d):
    o = w.ordered()
    return bars(spark, d).select("symbol", "ts", F.lag("close").over(o).alias("before"), F.lead("close", 3).over(o).alias("ahead_3"), R(F.col("close") - F.lag("close").over(o)).alias("diff"))


@query("w08_cumulative_sum", f"{P} SELECT symbol, ts, {r('sum(cvd) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'cvd_cumulative')} FROM b")
def _(spark, d):
    return cvd(spark, d).select("symbol", "ts", R(F.sum("cvd").over(w.ordered().rowsBetween(w.W.unboundedPreceding, 0))).alias("cvd_cumulative"))


#: Folds the prefix list; for small tables only, and so only as the oracle.
EWM = "list_reduce(list_transform(list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda v: v::DOUBLE), lambda a, v: a * (1 - {a}) + v * {a})"


@query("w10_ewm", f"{P}, e AS (SELECT symbol, ts, pos, {EWM.format(x='close', a='2.0/15')} AS y FROM b) SELECT symbol, ts, {r('CASE WHEN pos >= 13 THEN y END', 'ema_14')} FROM e")
def _(spark, d):
    return with_ewm(bars(spark, d), {"ema_14": ("close", 2 / 15, 14)}).select("symbol", "ts", *rs("ema_14"))


def wilder(x: str) -> str:
    """The recursion with alpha 1/14 over a symbol's values so far, missing ones before the first left out; NULL under 14."""
    seen = f"list({x}) FILTER ({x} IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN len({seen}) >= 14 THEN list_reduce({seen}, lambda a, v: a * (1 - 1.0 / 14) + v / 14.0) END"


def ADX() -> str:
    move = lambda a, b: f"CASE WHEN {a} > {b} AND {a} > 0 THEN {a} ELSE 0.0 END"
    return f"""{PRICE}, a0 AS (SELECT *, high - lag(high) OVER o AS up, lag(low) OVER o - low AS down FROM p0 WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
a1 AS (SELECT *, ({move('up', 'down')})::DOUBLE AS pm, ({move('down', 'up')})::DOUBLE AS mm FROM a0),
a2 AS (SELECT symbol, ts, {wilder('true_range::DOUBLE')} AS tr, {wilder('pm')} AS sp, {wilder('mm')} AS sm FROM a1),
a3 AS (SELECT *, 100 * sp / nullif(tr, 0) AS plus_di, 100 * sm / nullif(tr, 0) AS minus_di FROM a2),
a4 AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM a3)
SELECT symbol, ts, {r('plus_di', 'plus_di')}, {r('minus_di', 'minus_di')}, {r(wilder('dx'), 'adx')} FROM a4"""


@query("x05_adx")
def _(spark, d):
    return adx(ops.price_features(bars(spark, d))).select("symbol", "ts", *rs("plus_di", "minus_di", "adx"))


@query("w14_forward_fill", f"{P}, g AS (SELECT symbol, ts, pos, CASE WHEN num_trades >= 3 THEN close END AS x FROM b) SELECT symbol, ts, last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled, coalesce(x, 0) AS neutral FROM g WHERE pos >= 0")
def _(spark, d):
    x = F.when(F.col("num_trades") >= 3, F.col("close"))
    return bars(spark, d).select("symbol", "ts", F.last(x, ignorenulls=True).over(w.ordered().rowsBetween(w.W.unboundedPreceding, 0)).alias("filled"), F.coalesce(x, F.lit(0.0)).alias("neutral"))


@query("w17_sequences", f"{P}, q AS (SELECT symbol, ts, list(close) {over(8)} AS seq FROM b) SELECT symbol, ts, {r('list_sum(seq)', 'seq_sum')}, seq[1] AS seq_first FROM q WHERE len(seq) = 8")
def _(spark, d):
    seq = bars(spark, d).withColumn("seq", F.collect_list("close").over(w.last(8))).where(F.size("seq") == 8)
    return seq.select("symbol", "ts", R(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)).alias("seq_sum"), F.get("seq", F.lit(0)).alias("seq_first"))


@query("x01_safe_divide", f"{P} SELECT symbol, ts, {r('CASE WHEN volume - taker_buy_base_vol <> 0 THEN taker_buy_base_vol / (volume - taker_buy_base_vol) END', 'ratio')}, {r('coalesce(CASE WHEN volume - taker_buy_base_vol <> 0 THEN taker_buy_base_vol / (volume - taker_buy_base_vol) END, 0.5)', 'ratio_or_half')} FROM b")
def _(spark, d):
    sell = F.col("volume") - F.col("taker_buy_base_vol")
    return bars(spark, d).select("symbol", "ts", R(s.safe_div(F.col("taker_buy_base_vol"), sell)).alias("ratio"), R(s.safe_div(F.col("taker_buy_base_vol"), sell, 0.5)).alias("ratio_or_half"))


LAGC = "lag(close) OVER (PARTITION BY symbol ORDER BY ts)"


def pl(x: str) -> str:
    """The log of a positive number, else NULL."""
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


PRICE = f"""{P}, p00 AS (SELECT *, {LAGC} AS before FROM b), p0 AS (SELECT *, {pl('close')} - {pl('before')} AS log_return, greatest(high - low, abs(high - before), abs(low - before)) AS true_range,
  CASE WHEN least(open, high, low, close) > 0 THEN greatest(0.5 * pow({pl('high')} - {pl('low')}, 2) - (2 * ln(2.0) - 1) * pow({pl('close')} - {pl('open')}, 2), 0) END AS gk FROM p00),
p1 AS (SELECT *, {full('log_return', 14, f'stddev_pop(log_return) {over(14)}')} AS realized_vol_14, sqrt({full('gk', 14, f'avg(gk) {over(14)}')}) AS gk_vol_14,
  {full('true_range', 14, f'avg(true_range) {over(14)}')} AS atr_14, {full('quote_volume', 24, f'sum(quote_volume) {over(24)}')} / {full('volume', 24, f'sum(volume) {over(24)}')} AS vwap FROM p0)"""


@query("x04_price_features", PRICE + f" SELECT symbol, ts, {r('log_return', 'log_return')}, {r('true_range', 'true_range')}, {r('realized_vol_14', 'realized_vol_14')}, {r('gk_vol_14', 'gk_vol_14')}, {r('atr_14', 'atr_14')}, {r('atr_14 / nullif(close, 0)', 'atr_14_pct')}, {r('(close - vwap) / nullif(atr_14, 0)', 'vwap_dist_atr')} FROM p1")
def _(spark, d):
    return ops.price_features(bars(spark, d)).select("symbol", "ts", *rs("log_return", "true_range", "realized_vol_14", "gk_vol_14", "atr_14", "atr_14_pct", "vwap_dist_atr"))


FLOW = f"""{P}, f0 AS (SELECT *, taker_buy_base_vol / volume AS taker_buy_ratio, volume / num_trades AS vpt, sum(cvd) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cum FROM b),
f1 AS (SELECT *, {z('cvd', 24)} AS cvd_z, {z('vpt', 24)} AS vpt_z, {full('cum', 24, f'regr_slope(cum, pos) {over(24)}')} AS rate FROM f0),
f2 AS (SELECT *, CASE WHEN vpt_z > 2 THEN volume ELSE 0 END AS large FROM f1)"""


SQL["x05_adx"] = ADX()


@query(
    "x09_flow_features",
    FLOW + f" SELECT symbol, ts, {r('taker_buy_ratio', 'taker_buy_ratio')}, {r('cvd_z', 'true_cvd_zscore')}, {r('vpt_z', 'vpt_zscore')}, {r('rate', 'cvd_cumulative_rate')}, coalesce(vpt_z > 2 AND taker_buy_ratio > 0.55, false)::INT::DOUBLE AS whale_buy_flag, coalesce(vpt_z > 2 AND taker_buy_ratio < 0.45, false)::INT::DOUBLE AS whale_sell_flag, {r('coalesce(' + full('large', 24, f'sum(large) {over(24)}') + ' / ' + full('volume', 24, f'sum(volume) {over(24)}') + ', 0)', 'large_trade_ratio')} FROM f2",
)
def _(spark, d):
    return ops.flow_features(bars(spark, d)).select("symbol", "ts", *rs("taker_buy_ratio", "true_cvd_zscore", "vpt_zscore", "cvd_cumulative_rate"), "whale_buy_flag", "whale_sell_flag", *rs("large_trade_ratio"))


CLIP = "least(greatest({x}, -10), 10)"
ORDERFLOW = FLOW + f""", p00 AS (SELECT *, {LAGC} AS before FROM f2), p0 AS (SELECT *, {pl("close")} - {pl("before")} AS lr FROM p00), p1 AS (SELECT *, {full('lr', 14, f'stddev_pop(lr) {over(14)}')} AS rv FROM p0),
o0 AS (SELECT *, 2 * taker_buy_ratio - 1 AS imb, CASE WHEN coalesce(lr / nullif(rv, 0), 0) > 10 THEN 10 WHEN coalesce(lr / nullif(rv, 0), 0) < -10 THEN -10 ELSE coalesce(lr / nullif(rv, 0), 0) END AS nr, cvd / {full('volume', 24, f'avg(volume) {over(24)}')} AS cn FROM p1),
o1 AS (SELECT *, CASE WHEN nr / (abs(cn) + 0.001) IS NULL THEN 0 ELSE least(greatest(nr / (abs(cn) + 0.001), -10), 10) END AS eff, least(greatest(-nr * imb, -10), 10) AS absorb, CASE WHEN cn IS NOT NULL THEN least(greatest(cn - nr, -10), 10) END AS diverge FROM o0)"""


@query("x12_orderflow", ORDERFLOW + f" SELECT symbol, ts, {r('imb', 'taker_imbalance')}, {r('nr', 'normalized_return')}, {r('eff', 'orderflow_efficiency')}, {r('absorb', 'absorption_pressure')}, {r('diverge', 'cvd_price_divergence')}, {r(full('cn', 12, f'sum(cn) {over(12)}'), 'cvd_pressure_12')}, {r(full('cn', 12, f'sum(cn) {over(12)}') + ' - ' + full('cn', 6, f'sum(cn) {over(6)}'), 'cvd_pressure_12_minus_6')}, {r(full('cn', 24, f'sum(cn) {over(24)}') + ' - ' + full('cn', 12, f'sum(cn) {over(12)}'), 'cvd_pressure_24_minus_12')}, {r(full('absorb', 3, f'avg(absorb) {over(3)}'), 'absorption_pressure_3')} FROM o1")
def _(spark, d):
    x = ops.orderflow_features(ops.price_features(ops.flow_features(bars(spark, d))))
    return x.select("symbol", "ts", *rs("taker_imbalance", "normalized_return", "orderflow_efficiency", "absorption_pressure", "cvd_price_divergence", "cvd_pressure_12", "cvd_pressure_12_minus_6", "cvd_pressure_24_minus_12", "absorption_pressure_3"))


STATIONARY = FLOW + f""", s0 AS (SELECT *, ln(1 + greatest(volume, 0)) AS lv, ln(1 + greatest(vpt, 0)) AS lt, {full('volume', 24, f'avg(volume) {over(24)}')} AS mv FROM f2)"""


@query("x11_stationary_features", STATIONARY + f" SELECT symbol, ts, {r(z('lv', 24), 'volume_log_zscore')}, {r(z('lt', 24), 'vol_per_trade_log_zscore')}, {r('cvd / nullif(mv, 0)', 'true_cvd_delta_norm')}, {r('rate / nullif(mv, 0)', 'cvd_cumulative_rate_norm')} FROM s0")
def _(spark, d):
    x = ops.stationary_features(ops.price_features(ops.flow_features(bars(spark, d))))
    return x.select("symbol", "ts", *rs("volume_log_zscore", "vol_per_trade_log_zscore", "true_cvd_delta_norm", "cvd_cumulative_rate_norm"))


@query("x13_stable_transforms", f"{P}, s AS (SELECT *, {z('cvd', 24)} AS zz, list(cvd) {over(24)} AS seen FROM b) SELECT symbol, ts, {r('CASE WHEN zz IS NOT NULL THEN least(greatest(zz, -5), 5) END', 'cvd_stable_zscore')}, {r('CASE WHEN len(seen) = 24 THEN 2 * (len(list_filter(seen, lambda v: v < cvd)) + 0.5 * len(list_filter(seen, lambda v: v = cvd))) / 24 - 1 END', 'cvd_stable_rank')}, {r('tanh(zz / 2)', 'cvd_stable_tanh')} FROM s")
def _(spark, d):
    t = ops.stable(F.col("cvd"), 24)
    return cvd(spark, d).select("symbol", "ts", *[R(x).alias(f"cvd_stable_{k}") for k, x in t.items()])


@query("x14_interactions", f"{P}, i AS (SELECT *, CASE WHEN {z('cvd', 24)} IS NOT NULL THEN least(greatest({z('cvd', 24)}, -1), 1) END AS a, CASE WHEN {z('close', 24)} IS NOT NULL THEN least(greatest({z('close', 24)}, -1), 1) END AS c FROM b) SELECT symbol, ts, {r('a * c', 'signed')}, {r('a * CASE WHEN c IS NOT NULL THEN greatest(c, 0) END', 'high')}, {r('a * CASE WHEN c IS NOT NULL THEN greatest(-c, 0) END', 'low')} FROM i")
def _(spark, d):
    t = cvd(spark, d).withColumns({"a": w.zscore(F.col("cvd"), 24), "c": w.zscore(F.col("close"), 24)})
    return t.select("symbol", "ts", *[R(x).alias(k) for k, x in ops.interactions(F.col("a"), F.col("c")).items()])


@query("x15_open_interest", f"WITH {bars_cte()} SELECT symbol, ts, {r('ln(volume) - lag(ln(volume)) OVER (PARTITION BY symbol ORDER BY ts)', 'oi_log_return')}, {r('ln(volume) - lag(ln(volume), 12) OVER (PARTITION BY symbol ORDER BY ts)', 'oi_change_12')}, {r('CASE WHEN taker_buy_base_vol > 0 AND volume > 0 THEN ln(taker_buy_base_vol / volume) END', 'log_ratio')} FROM bars")
def _(spark, d):
    oi, o = s.positive_log(F.col("volume")), w.ordered()
    return bars(spark, d).select("symbol", "ts", R(oi - F.lag(oi).over(o)).alias("oi_log_return"), R(oi - F.lag(oi, 12).over(o)).alias("oi_change_12"), R(s.positive_log(s.safe_div(F.col("taker_buy_base_vol"), F.col("volume")))).alias("log_ratio"))


@query("x16_funding", f"{P}, f AS (SELECT *, CASE WHEN quote_volume <> 0 THEN least(greatest(cvd / quote_volume, -0.05), 0.05) END AS rate FROM b) SELECT symbol, ts, {r('rate', 'funding_rate')}, {r('rate - lag(rate) OVER (PARTITION BY symbol ORDER BY ts)', 'funding_delta')}, {r(full('rate', 3, f'sum(rate) {over(3)}'), 'funding_sum_3')}, {r(full('rate', 12, f'avg(rate) {over(12)}'), 'funding_mean_12')} FROM f")
def _(spark, d):
    f = cvd(spark, d).withColumn("rate", s.clip(s.safe_div(F.col("cvd"), F.col("quote_volume")), -0.05, 0.05))
    x = F.col("rate")
    return f.select("symbol", "ts", R(x).alias("funding_rate"), R(x - F.lag(x).over(w.ordered())).alias("funding_delta"), R(w.total(x, 3)).alias("funding_sum_3"), R(w.mean(x, 12)).alias("funding_mean_12"))


def halves(expr: str, name: str) -> str:
    return ", ".join(expr.format(f=f) + f" AS {name}{k}" for k, f in (("", ""), ("_e", " FILTER (early)"), ("_l", " FILTER (NOT early)")))


def move_sql(k: str) -> str:
    span = f"((hi{k} - lo{k}) / CASE WHEN o{k} > 0 THEN o{k} END)"
    return f"CASE WHEN {span} > 0 AND c{k} > 0 THEN least(greatest((ln(c{k}) - ln(o{k})) / ({span} + 1e-12), -1), 1) END AS m{k}"


def up_sql(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0) END)"


@query("a01_intrahour", f"""WITH {bars_cte(seconds=900)}, q AS (SELECT *, date_trunc('hour', ts) AS hour, taker_buy_base_vol / volume AS ratio, 2 * taker_buy_base_vol / volume - 1 AS imb, 2 * taker_buy_base_vol - volume AS cvd, volume / num_trades AS vpt,
  row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, date_trunc('hour', ts)) AS n FROM bars),
h AS (SELECT *, i < greatest(1, n // 2) AS early, sum(cvd) OVER (PARTITION BY symbol, hour ORDER BY ts ROWS UNBOUNDED PRECEDING) AS running FROM q WHERE n >= 2),
a AS (SELECT symbol, hour AS ts, count(*) AS bar_count, avg(imb) AS imb_mean, arg_max(imb, i) AS imb_last, avg(imb) FILTER (NOT early) - avg(imb) FILTER (early) AS imb_lme, regr_slope(imb, i) AS imb_slope, regr_slope(running, i) AS cvd_slope, max(ratio) - min(ratio) AS rng,
  arg_max(volume, i) AS vl, arg_max(num_trades, i) AS tl, arg_max(taker_buy_base_vol, i) AS bl, sum(taker_buy_base_vol) AS buy, arg_max(vpt, i) AS vpt_last, avg(vpt) AS vpt_mean, max(vpt) AS vpt_max,
  {halves('sum(cvd){f}', 'cvd')}, {halves('sum(volume){f}', 'v')}, {halves('sum(num_trades){f}', 't')}, {halves('max(high){f}', 'hi')}, {halves('min(low){f}', 'lo')}, {halves('arg_min(open, i){f}', 'o')}, {halves('arg_max(close, i){f}', 'c')} FROM h GROUP BY 1, 2),
m AS (SELECT *, {move_sql('')}, {move_sql('_e')}, {move_sql('_l')}, cvd / v AS f, cvd_e / v AS f_e, cvd_l / v AS f_l FROM a),
x AS (SELECT *, {up_sql('f')} * {up_sql('-m')} AS ba, {up_sql('-f')} * {up_sql('m')} AS sa, {up_sql('f_l')} * {up_sql('-m_l')} AS lba, {up_sql('-f_l')} * {up_sql('m_l')} AS lsa FROM m)
SELECT symbol, ts, bar_count, {r('bar_count / 4', 'coverage')}, {r('imb_mean', 'imb_mean')}, {r('imb_last', 'imb_last')}, {r('imb_lme', 'imb_late_minus_early')}, {r('imb_slope', 'imb_slope')}, {r('rng', 'buy_ratio_range')}, {r('f', 'cvd_pressure_norm')}, {r('f_l - f_e', 'cvd_pressure_late_minus_early_norm')}, {r('cvd_slope / v', 'cvd_slope_norm')},
  {r('m', 'price_move_norm')}, {r('sign(f) * m', 'flow_price_alignment')}, {r('ba', 'buy_absorption')}, {r('sa', 'sell_absorption')}, {r('ba - sa', 'absorption_imbalance')}, {r('lba', 'late_buy_absorption')}, {r('lsa', 'late_sell_absorption')}, {r('lba - lsa', 'late_absorption_imbalance')},
  {r('coalesce(CASE WHEN f_e <> 0 THEN ' + up_sql('-sign(f_e) * f_l') + ' END, 0)', 'late_flow_reversal')}, {r('coalesce(CASE WHEN m_e <> 0 THEN ' + up_sql('-sign(m_e) * m_l') + ' END, 0)', 'late_price_reversal')}, {r('sign(f_l) * m_l', 'late_flow_price_alignment')},
  {r('vl / v', 'volume_share_last')}, {r('v_l / v', 'volume_share_late')}, {r('tl / t', 'trade_share_last')}, {r('vpt_last / (v / t) - 1', 'vpt_last_vs_hour')}, {r('(v_l / t_l) / (v_e / t_e) - 1', 'vpt_late_vs_early')}, {r('vpt_max / vpt_mean - 1', 'large_trade_concentration')},
  {r('bl / nullif(buy, 0)', 'buy_volume_share_last')}, {r('greatest(imb_last, 0) * vl / v', 'aggressive_buy_burst')}, {r('greatest(-imb_last, 0) * vl / v', 'aggressive_sell_burst')} FROM x""")
def _(spark, d):
    h = ops.intrahour(bars(spark, d, 900), least=2)
    return h.select("symbol", "ts", "bar_count", *rs(*[c for c in h.columns if c not in ("symbol", "ts", "bar_count")]))


@query("j01_asof_htf", f"WITH {bars_cte()}, {bars_cte('htf', 14400)}, h AS (SELECT symbol, ts AS source_ts, ts + INTERVAL 4 HOUR AS ts, close AS htf_close FROM htf) SELECT b.symbol, b.ts, b.close, h.htf_close, h.source_ts AS htf_source_ts, h.ts AS htf_available_ts FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.ts")
def _(spark, d):
    h = bars(spark, d, 14400).select("symbol", F.col("ts").alias("source_ts"), F.expr("ts + interval 4 hours").alias("ts"), F.col("close").alias("close"))
    j = asof(bars(spark, d).select("symbol", "ts", "close"), h, prefix="h_")
    return j.select("symbol", "ts", "close", F.col("h_close").alias("htf_close"), F.col("h_source_ts").alias("htf_source_ts"), F.col("h_ts").alias("htf_available_ts"))


@query("j02_asof_tolerance", f"WITH {bars_cte()}, t AS (SELECT 'S' || (user_id % 8) AS symbol, ts, event_id AS tick, value AS price FROM events WHERE event_type = 'view'), j AS (SELECT b.symbol, b.ts, t.ts AS m_ts, t.price, t.tick FROM bars b ASOF LEFT JOIN t ON b.symbol = t.symbol AND b.ts >= t.ts) SELECT symbol, ts, CASE WHEN ts - m_ts <= INTERVAL 90 MINUTE THEN price END AS metric, CASE WHEN ts - m_ts <= INTERVAL 90 MINUTE THEN tick END AS metric_tick, CASE WHEN ts - m_ts <= INTERVAL 90 MINUTE THEN 0.0 ELSE 1.0 END::DOUBLE AS metric_missing FROM j")
def _(spark, d):
    from barloom.plans.tables import read

    e = read(spark, d, "events").where("event_type = 'view'")
    m = e.select(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string")).alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tick"))
    j = asof(bars(spark, d).select("symbol", "ts"), m, tolerance_seconds=90 * 60, prefix="m_")
    return j.select("symbol", "ts", F.col("m_price").alias("metric"), F.col("m_tick").alias("metric_tick"), s.all_missing("m_price").alias("metric_missing"))


@query("j04_hour_left_join", f"WITH {bars_cte()}, {bars_cte('q', 900)}, h AS (SELECT symbol, date_trunc('hour', ts) AS ts, count(*) AS n FROM q GROUP BY ALL HAVING count(*) >= 2) SELECT b.symbol, b.ts, h.n AS bar_count, CASE WHEN h.n IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS ih15_missing FROM bars b LEFT JOIN h ON b.symbol = h.symbol AND b.ts = h.ts")
def _(spark, d):
    j = bars(spark, d).select("symbol", "ts").join(ops.intrahour(bars(spark, d, 900), least=2).select("symbol", "ts", "bar_count"), ["symbol", "ts"], "left")
    return j.withColumn("ih15_missing", s.all_missing("bar_count"))


@query("v02_duplicate_ts", "SELECT 'S' || (user_id % 8) AS symbol, date_trunc('minute', ts) AS ts, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    t = ticks(spark, d).select("symbol", ops.bucket("ts", 60).alias("ts"))
    return t.groupBy("symbol", "ts").agg(F.count("*").alias("n")).where("n > 1")


@query("v04_gaps", f"{B}, g AS (SELECT symbol, epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts))::BIGINT AS gap FROM bars WHERE volume > 0 AND num_trades > 0) SELECT symbol, count(*) AS bars, count(*) FILTER (gap > 3600) AS gap_count_gt_expected, max(gap) AS max_gap_seconds FROM g GROUP BY symbol")
def _(spark, d):
    from barloom.operators.validation import gap_summary

    return gap_summary(bars(spark, d), 3600)


@query("v05_taker_bounds", f"{B} SELECT symbol, {r('sum(abs(taker_buy_base_vol))', 'taker_sum')}, count(*) FILTER (taker_buy_base_vol < 0 OR taker_buy_base_vol > volume) AS base_out, count(*) FILTER (taker_buy_quote_vol < 0 OR taker_buy_quote_vol > quote_volume + 1e-9) AS quote_out, count(*) FILTER (volume <= 0 OR num_trades <= 0) AS zero_volume FROM bars GROUP BY symbol")
def _(spark, d):
    from barloom.operators.validation import taker_summary

    return taker_summary(bars(spark, d)).withColumn("taker_sum", R(F.col("taker_sum")))


LABELS = PRICE + """, l0 AS (SELECT *, close + 2 * atr_14 AS tp, close - 5 * atr_14 AS sl, list({'pos': pos, 'high': high, 'low': low, 'close': close, 'ts': ts}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS ahead FROM p1),
l1 AS (SELECT *, list_filter(ahead, lambda x: x.high >= tp OR x.low <= sl)[1] AS hit FROM l0 WHERE len(ahead) = 10 AND atr_14 > 0),
l2 AS (SELECT *, CASE WHEN hit IS NULL THEN 'time' WHEN hit.high >= tp AND hit.low <= sl THEN 'both_sl_first' WHEN hit.low <= sl THEN 'sl' ELSE 'tp' END AS hit_type FROM l1)"""


@query("l01_triple_barrier", LABELS + f" SELECT symbol, ts, hit_type, (hit_type = 'tp')::INT AS label, coalesce(hit.pos, ahead[10].pos) AS exit_bar, coalesce(hit.ts, ahead[10].ts) AS exit_ts, {r('((CASE hit_type WHEN ' + chr(39) + 'time' + chr(39) + ' THEN ahead[10].close WHEN ' + chr(39) + 'tp' + chr(39) + ' THEN tp ELSE sl END) - close) / nullif(close, 0)', 'tb_return')} FROM l2")
def _(spark, d):
    return labels.triple_barrier(ops.price_features(bars(spark, d)), "atr_14").select("symbol", "ts", "hit_type", "label", "exit_bar", "exit_ts", *rs("tb_return"))


@query("l04_forward_return", f"{B} SELECT symbol, ts, {r('lead(close, 10) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1', 'fwd_return_10h')} FROM bars")
def _(spark, d):
    return labels.forward_return(bars(spark, d)).select("symbol", "ts", *rs("fwd_return_10h"))


@query("l05_label_quality", LABELS + f", f AS (SELECT symbol, ts, lead(close, 10) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS fr FROM bars) SELECT l2.symbol, count(*) AS n, {r('avg((hit_type = ' + chr(39) + 'tp' + chr(39) + ')::INT)', 'long_share')}, {r('avg(fr) FILTER (hit_type = ' + chr(39) + 'tp' + chr(39) + ')', 'long_return')}, {r('avg(fr) FILTER (hit_type <> ' + chr(39) + 'tp' + chr(39) + ')', 'other_return')} FROM l2 JOIN f ON l2.symbol = f.symbol AND l2.ts = f.ts GROUP BY l2.symbol")
def _(spark, d):
    b = labels.triple_barrier(labels.forward_return(ops.price_features(bars(spark, d))), "atr_14")
    fr = F.col("fwd_return_10h")
    return b.groupBy("symbol").agg(F.count("*").alias("n"), R(F.avg("label")).alias("long_share"), R(F.avg(F.when(F.col("label") == 1, fr))).alias("long_return"), R(F.avg(F.when(F.col("label") == 0, fr))).alias("other_return"))


#: As many folds as a symbol's bars fill.
FOLDS = "nf AS (SELECT symbol, CASE WHEN count(*) >= 230 THEN (count(*) - 230) // 60 + 1 ELSE 0 END AS folds FROM b GROUP BY symbol), fs AS (SELECT symbol, unnest(range(folds)) AS f FROM nf), folds AS (SELECT symbol, f::INT AS fold, role, f * 60 + lo AS lo, f * 60 + hi AS hi FROM fs, (VALUES ('train', 0, 120), ('val', 144, 184), ('test', 190, 230)) x(role, lo, hi))"
WALK = labels.Folds(120, 40, 40, 60)


@query("m01_walk_forward", f"{P}, {FOLDS} SELECT symbol, fold, role, lo, hi FROM folds")
def _(spark, d):
    return labels.walk_forward(bars(spark, d), WALK)


@query("j09_rows_to_folds", f"{P}, {FOLDS} SELECT b.symbol, fold, role, count(*) AS n, {r('avg(close)', 'mean_close')} FROM b JOIN folds ON b.symbol = folds.symbol AND pos >= lo AND pos < hi GROUP BY ALL")
def _(spark, d):
    rows = labels.with_folds(ops.positioned(bars(spark, d)).select("symbol", "pos", "close"), WALK)
    return rows.groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), R(F.avg("close")).alias("mean_close"))


@query("m02_holdout_tail", f"{P} SELECT symbol, ts, close FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM b) WHERE pos >= n - 48")
def _(spark, d):
    n = F.count("*").over(w.W.partitionBy("symbol"))
    return ops.positioned(bars(spark, d)).withColumn("n", n).where(F.col("pos") >= F.col("n") - 48).select("symbol", "ts", "close")


@query("a16_robust_scale", f"{P}, t AS (SELECT symbol, quantile_cont(volume, 0.5) AS med, quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25) AS iqr FROM b WHERE pos < 100 GROUP BY symbol) SELECT b.symbol, ts, {r('(volume - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END', 'volume_scaled')} FROM b JOIN t ON b.symbol = t.symbol")
def _(spark, d):
    b = ops.positioned(bars(spark, d))
    t = b.where("pos < 100").groupBy("symbol").agg(F.percentile("volume", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    iqr = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    return b.join(t, "symbol").select("symbol", "ts", R((F.col("volume") - F.get("q", F.lit(1))) / F.when(iqr == 0, 1.0).otherwise(iqr)).alias("volume_scaled"))


@query("p10_time_range", f"{B} SELECT symbol, ts, close FROM bars WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, d):
    return bars(spark, d).where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-12'").select("symbol", "ts", "close")


@query("p12_warmup", f"{P} SELECT symbol, ts, pos, close FROM b WHERE pos >= 24")
def _(spark, d):
    return ops.positioned(bars(spark, d)).where("pos >= 24").select("symbol", "ts", F.col("pos").cast("long").alias("pos"), "close")


@query("u02_union_keep_last", f"{B}, {bars_cte('c', 14400)}, u AS (SELECT symbol, ts, close, 0 AS src FROM c UNION ALL SELECT symbol, ts, close, 1 FROM bars) SELECT symbol, ts, arg_max(close, src) AS close, count(*) AS n FROM u GROUP BY symbol, ts")
def _(spark, d):
    u = bars(spark, d, 14400).withColumn("src", F.lit(0)).unionByName(bars(spark, d).withColumn("src", F.lit(1)))
    return u.groupBy("symbol", "ts").agg(F.max_by("close", "src").alias("close"), F.count("*").alias("n"))


@query("s10_months_and_days", "WITH e AS (SELECT 'S' || (user_id % 8) AS symbol, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events GROUP BY ALL), d AS (SELECT symbol, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS d FROM e) SELECT symbol, strftime(d, '%Y-%m') AS month, d::DATE AS day FROM d")
def _(spark, d):
    """The months and days that each symbol's ticks span: what an archive must hold of it."""
    span = ticks(spark, d).groupBy("symbol").agg(F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi"))
    days = span.select("symbol", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))
    return days.select("symbol", F.date_format("day", "yyyy-MM").alias("month"), "day")


@query("s01_klines_typed", f"{B} SELECT symbol, ts, open, high, low, close, num_trades FROM bars")
def _(spark, d):
    from barloom.sources.klines import typed_klines

    b = bars(spark, d)
    ms = F.expr(f"timestampdiff(MICROSECOND, {ops.EPOCH}, ts) div 1000")
    raw = b.select("symbol", ms.cast("string").alias("open_time"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")], (ms + 3_599_999).cast("string").alias("close_time"), *[F.col(c).cast("string").alias(c) for c in ("quote_volume", "num_trades", "taker_buy_base_vol", "taker_buy_quote_vol")], F.lit("0").alias("ignore"))
    return typed_klines(raw).select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "num_trades")


@query("s06_metrics_keep_first", "WITH m AS (SELECT 'S' || (user_id % 8) AS symbol, date_trunc('hour', ts) AS ts, value, event_id FROM events) SELECT symbol, ts, arg_min(value, event_id) AS sum_open_interest FROM m GROUP BY ALL")
def _(spark, d):
    from barloom.sources.klines import keep_first

    t = ticks(spark, d).select("symbol", ops.bucket("ts", 3600).alias("ts"), F.col("price").alias("sum_open_interest"), "tick")
    return keep_first(t, ["symbol", "ts"], ["tick"]).select("symbol", "ts", "sum_open_interest")


# --- the same in chunks of a few days, so that a symbol is spread over tasks; their SQL is that of the whole history ------


def in_chunks_of(name: str, like: str):
    SQL[name] = SQL[like]
    return query(name)


def price_chunks(spark, d):
    return chunks.in_chunks(bars(spark, d), ops.price_features, before=40, rows=48)


def flow_chunks(spark, d, build=ops.flow_features, before=48, rows=48):
    return chunks.in_chunks(bars(spark, d), build, before, rows=rows, running={"cvd_cumulative": 2 * F.col("taker_buy_base_vol") - F.col("volume")})


@in_chunks_of("x04_price_features_in_chunks", "x04_price_features")
def _(spark, d):
    return price_chunks(spark, d).select("symbol", "ts", *rs("log_return", "true_range", "realized_vol_14", "gk_vol_14", "atr_14", "atr_14_pct", "vwap_dist_atr"))


@in_chunks_of("x09_flow_features_in_chunks", "x09_flow_features")
def _(spark, d):
    return flow_chunks(spark, d).select("symbol", "ts", *rs("taker_buy_ratio", "true_cvd_zscore", "vpt_zscore", "cvd_cumulative_rate"), "whale_buy_flag", "whale_sell_flag", *rs("large_trade_ratio"))


@in_chunks_of("w03_mid_rank_in_chunks", "w03_mid_rank")
def _(spark, d):
    return chunks.in_chunks(bars(spark, d), lambda b: b.withColumn("rank_24", w.mid_rank(F.col("close"), 24)), 23, rows=36).select("symbol", "ts", *rs("rank_24"))


@in_chunks_of("w07_lag_lead_in_chunks", "w07_lag_lead")
def _(spark, d):
    o = w.ordered()
    moves = lambda b: b.withColumns({"before": F.lag("close").over(o), "ahead_3": F.lead("close", 3).over(o)})
    return chunks.in_chunks(bars(spark, d), moves, 1, 3, rows=24).select("symbol", "ts", "before", "ahead_3", R(F.col("close") - F.col("before")).alias("diff"))


@in_chunks_of("w08_cumulative_sum_in_chunks", "w08_cumulative_sum")
def _(spark, d):
    b = bars(spark, d).withColumn("cvd", 2 * F.col("taker_buy_base_vol") - F.col("volume"))
    return ranks.cumulative(b, ["symbol"], [F.col("ts")], {"cvd_cumulative": "cvd"}, ranges=8).select("symbol", "ts", *rs("cvd_cumulative"))


@in_chunks_of("w10_ewm_in_chunks", "w10_ewm")
def _(spark, d):
    return with_ewm(bars(spark, d), {"ema_14": ("close", 2 / 15, 14)}, chunk_seconds=2 * 86400).select("symbol", "ts", *rs("ema_14"))
