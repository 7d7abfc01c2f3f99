"""Ranks, windows, joins and filters that hold no key in one task give what the one-task forms give."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import windows as w
from barloom.operators import bars as ops
from barloom.operators import chunks, ranks, regime
from barloom.operators.asof import asof
from barloom.operators.ewm import with_ewm
from barloom.operators import metrics as m
from barloom.streaming.bars import late_ticks, stream_weights

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def scored(spark):
    """Two keys, one of them with most rows, a null key, ties and nulls."""
    rng = np.random.default_rng(1)
    rows = [(["a", "a", "a", "b", None][i % 5], float(rng.integers(0, 300)) if i % 11 else None, i, int(rng.integers(0, 2))) for i in range(6000)]
    return spark.createDataFrame(rows, "k string, x double, row_pos int, label int").repartition(7)


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("ranges", [2, 13])
def test_ranks_over_ranges_are_those_of_windows(scored, ranges):
    cols = ["k", "x", "row_pos"]
    for share in (False, True):
        one, many = (got(ranks.average_rank(scored, ["k"], "x", "r", share, n), *cols, "r") for n in (1, ranges))
        assert one == many
    one, many = (got(ranks.quantile_bin(scored, [F.col("x"), F.col("row_pos")], 10, ["k"], ranges=n), *cols, "bin") for n in (1, ranges))
    assert one == many
    sums = dict(sums={"c": F.lit(1), "s": "label"}, totals={"all": "c"})
    one, many = (got(ranks.cumulative(scored, ["k"], [F.desc("x"), F.col("row_pos")], ranges=n, **sums), *cols, "c", "s", "all") for n in (1, ranges))
    assert one == many


def test_a_million_rows_of_one_key_are_ranked_over_ranges(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("k"), ((F.col("id") * 7919) % 1_000_003).alias("x"), F.col("id").alias("row_pos"))
    binned = ranks.numbered(df, ["k"], [F.col("x")], "r", "n", ranges=200)
    # x are distinct: a row's number is one more than how many are below it, so that numbers rise with x and leave no gap
    far = binned.agg(F.min("r"), F.max("r"), F.countDistinct("r"), F.corr("x", "r"), F.max("n")).first()
    assert tuple(far)[:3] == (1, 1_000_000, 1_000_000) and far[3] > 0.999999 and far[4] == 1_000_000
    plan = binned._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan


def test_quantiles_from_steps(spark, scored):
    steps = m.score_steps(scored.withColumn("k", F.coalesce("k", F.lit("none"))), ["k"], "x")
    mine = {r["k"]: [r["a"], r["b"], r["c"]] for r in steps.groupBy("k").agg(m.quantile_of(0.5).alias("a"), m.quantile_of(0.1).alias("b"), m.quantile_of(1.0).alias("c")).collect()}
    pdf = scored.toPandas()
    for k, part in pdf.assign(k=pdf.k.fillna("none")).groupby("k"):
        assert mine[k] == pytest.approx([part.x.quantile(q) for q in (0.5, 0.1, 1.0)])


@pytest.fixture(scope="module")
def history(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, n in (("S0", 301), ("S1", 40), ("S2", 7)):
        price = 100.0
        for i in range(n):
            price *= math.exp(rng.normal(0, 0.01))
            o, c = price * 1.001, price * 0.999
            # hours are missing now and then: frames count rows, not time
            rows.append((s, START + dt.timedelta(hours=i + i // 9), o, max(o, c) * 1.002, min(o, c) * 0.998, c, float(rng.integers(1, 90)), float(rng.integers(100, 9000)), int(rng.integers(1, 20)), float(rng.integers(0, 40)), 10.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, quote_volume double, num_trades long, taker_buy_base_vol double, taker_buy_quote_vol double")


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (u is not None and v is not None and u == pytest.approx(v, abs=1e-7)), (x, y)


@pytest.mark.parametrize("rows", [96, 100, 301, 10_000])
def test_features_in_chunks_are_those_of_the_history(history, rows):
    build = lambda b: ops.orderflow_features(ops.price_features(ops.flow_features(b)))
    whole = build(history)
    cut = chunks.in_chunks(history, build, 96, rows=rows, running={"cvd_cumulative": 2 * F.col("taker_buy_base_vol") - F.col("volume")}, ranges=3)
    cols = ["symbol", "ts", *sorted(set(whole.columns) - {"symbol", "ts"})]
    assert set(cut.columns) == set(whole.columns)
    near(got(cut, *cols), got(whole, *cols))


def test_chunks_look_ahead_too(history):
    o = w.ordered()
    build = lambda b: b.withColumns({"ahead": F.lead("close", 3).over(o), "back": F.lag("close", 2).over(o)})
    for rows in (3, 5, 50):
        near(got(chunks.in_chunks(history, build, 2, 3, rows=rows), "symbol", "ts", "ahead", "back"), got(build(history), "symbol", "ts", "ahead", "back"))
    with pytest.raises(ValueError, match="guests"):
        chunks.in_chunks(history, build, 9, rows=8)


@pytest.mark.parametrize("seconds", [3600, 20 * 3600, 10**9])
def test_asof_over_chunks(spark, history, seconds):
    left = history.select("symbol", "ts", "close").unionByName(spark.createDataFrame([("S9", START, 1.0)], "symbol string, ts timestamp_ntz, close double"))
    rows = [("S0", START + dt.timedelta(hours=h), float(h)) for h in (5, 5, 6, 120)] + [("S1", START - dt.timedelta(days=400), -1.0), ("S2", START + dt.timedelta(days=300), 9.0)]
    right = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double")
    for tolerance in (None, 7 * 3600):
        mine = got(asof(left, right, tolerance_seconds=tolerance, chunk_seconds=seconds), "symbol", "ts", "close", "r_ts", "r_v")
        a, b = (x.toPandas().sort_values("ts", kind="stable") for x in (left, right))
        want = pd.merge_asof(a, b.assign(r_ts=b.ts).rename(columns={"v": "r_v"}), on="ts", by="symbol", tolerance=pd.Timedelta(seconds=tolerance) if tolerance is not None else None)
        want = sorted(((s, t.to_pydatetime(), c, None if pd.isna(q) else q.to_pydatetime(), None if pd.isna(v) else v) for s, t, c, q, v in want[["symbol", "ts", "close", "r_ts", "r_v"]].itertuples(index=False)), key=str)
        assert mine == want


def test_ewm_over_short_chunks(history):
    spec = {"y": ("close", 0.2, 3)}
    near(got(with_ewm(history, spec, chunk_seconds=7200), "symbol", "ts", "y"), got(with_ewm(history, spec), "symbol", "ts", "y"))


def model(k=3, d=2, seed=0):
    rng = np.random.default_rng(seed)
    move = rng.random((k, k)) + 2 * np.eye(k)
    return regime.Hmm(np.array([0.2, 0.5, 0.3]), move / move.sum(axis=1, keepdims=True), rng.normal(0, 1, (k, d)), np.array([np.eye(d) * (0.5 + i) for i in range(k)]))


def test_a_model_as_numbers_comes_back():
    h = model()
    back = regime.from_numbers(np.array(regime.as_numbers(h)))
    for a, b in ((h.start, back.start), (h.move, back.move), (h.means, back.means), (h.covs, back.covs)):
        assert a.shape == b.shape and (a == b).all()


@pytest.mark.parametrize("seconds", [3600, 50_000, 10**9])
def test_filter_as_a_scan_is_the_filter(spark, history, seconds):
    """For any cut, starting afresh at each key; far outliers and missing inputs included."""
    h = model()
    x = history.select("symbol", "ts", F.when(F.hour("ts") == 3, None).when(F.hour("ts") == 5, 1e6).otherwise(F.col("close") - 100).alias("u"), (F.col("volume") / 50).alias("v"))
    x = x.withColumn("part", F.when(F.dayofmonth("ts") > 6, "test").otherwise("train")).withColumn("key", F.concat_ws(":", "symbol", "part"))
    x = x.withColumn("model", F.array(*[F.lit(v) for v in regime.as_numbers(h)]))
    rows = regime.filtered(x, "model", ["u", "v"], 3, key="key", chunk_seconds=seconds).toPandas().sort_values(["key", "ts"])
    assert len(rows) == 348
    for _, part in rows.groupby("key"):
        want = regime.forward_filter(h, np.nan_to_num(part[["u", "v"]].to_numpy(float)))
        assert np.abs(part[[f"regime_prob_{i}" for i in range(3)]].to_numpy() - want).max() < 1e-9


def plain_filter(h, x):
    """Row by row, by the definition."""
    start, move = np.maximum(h.start, 1e-12), np.maximum(h.move, 1e-12)
    start, move = start / start.sum(), move / move.sum(axis=1, keepdims=True)
    out = []
    for t, row in enumerate(x):
        b = []
        for k in range(len(start)):
            c, diff = h.covs[k] + 1e-6 * np.eye(len(row)), row - h.means[k]
            b.append(max(math.exp(max(-700, -0.5 * diff @ np.linalg.inv(c) @ diff)) / math.sqrt((2 * math.pi) ** len(row) * np.linalg.det(c)), 1e-300))
        a = (start if t == 0 else out[-1] @ move) * np.array(b)
        out.append(a / a.sum())
    return np.array(out)


def test_filter_by_definition():
    x = np.random.default_rng(5).normal(0, 2, (60, 2))
    assert np.abs(regime.forward_filter(model(), x) - plain_filter(model(), x)).max() < 1e-9


def weights_loop(gammas, floor=0.02, share=0.08, ratio=15.0):
    n, out = [1.0, 1.0, 1.0], []
    for g in gammas:
        g = [max(x, floor) for x in g]
        n = [a + b / sum(g) for a, b in zip(n, g)]
        total = sum(n)
        low = [i for i in range(3) if n[i] / total < share]
        hit = []
        if max(n) / max(min(n), 1e-12) > ratio or low:
            hit = low
            n = [max(a, total * share) if i in low else a for i, a in enumerate(n)]
        out.append((*n, ",".join(map(str, hit))))
    return out


@pytest.fixture(scope="module")
def starving(spark):
    """A table whose states starve: long spells in one of them."""
    rng = np.random.default_rng(4)
    rows = []
    for s in range(3):
        for i in range(400):
            p = rng.dirichlet([30, 0.05, 0.4] if (i // 90) % 2 == s % 2 else [0.05, 20, 1])
            rows.append((f"S{s}", START + dt.timedelta(hours=i), *map(float, p)))
    rng.shuffle(rows)
    return [(str(r[0]), r[1], *map(float, r[2:])) for r in rows], "symbol string, ts timestamp, regime_prob_0 double, regime_prob_1 double, regime_prob_2 double"


def expected_weights(rows):
    want = {}
    for s in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for i, (r, v) in enumerate(zip(own, weights_loop([r[2:] for r in own]))):
            want[s, r[1]] = (*v[:3], i + 1, v[3])
    return want


COLS = ["state_weight_0", "state_weight_1", "state_weight_2", "bars_since_start", "restored"]


def same_weights(found, want):
    assert len(found) == len(want)
    for r in found:
        x = want[r["symbol"], r["ts"]]
        assert [r[c] for c in COLS[:3]] == pytest.approx(x[:3], abs=1e-9) and (r["bars_since_start"], r["restored"]) == x[3:]


def test_online_weights_restore_what_starves(spark, starving):
    rows, schema = starving
    want = expected_weights(rows)
    assert sum(v[4] != "" for v in want.values()) > 50
    same_weights(regime.online_weights(spark.createDataFrame(rows, schema).repartition(5), 3).collect(), want)
    assert regime.online_weights(spark.createDataFrame([], schema), 3).collect() == []


def test_online_weights_of_a_stream(spark, starving, tmp_path):
    rows, schema = starving
    for i in range(4):  # four batches in the order of time
        part = [r for r in rows if START + dt.timedelta(hours=100 * i) <= r[1] < START + dt.timedelta(hours=100 * (i + 1))]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        (next((tmp_path / "in" / str(i)).glob("*.parquet"))).rename(tmp_path / f"{i}.parquet")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
    q = stream_weights(source, 3).writeStream.format("memory").queryName("weights").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    same_weights(spark.table("weights").collect(), expected_weights(rows))


def test_late_ticks_and_bars_are_the_whole(spark):
    ticks = spark.createDataFrame([("a", START + dt.timedelta(minutes=x), i) for i, x in enumerate([1, 2, 61, 62, 63, 130])], "symbol string, ts timestamp, tick int")
    bars = spark.createDataFrame([("a", START, 2), ("a", START + dt.timedelta(hours=1), 1)], "symbol string, ts timestamp, num_trades long")
    late = {(r["ts"] - START).total_seconds() / 3600: (r["late"], r["all_trades"]) for r in late_ticks(ticks, bars).collect()}
    assert late == {1.0: (2, 3), 2.0: (1, 1)}


@pytest.mark.parametrize("seconds", [50_000, 10**9])
def test_baum_welch_over_chunks_is_the_fit_of_all_rows(spark, history, seconds):
    from barloom.operators import baumwelch

    x = history.select("symbol", "ts", (F.log("close") - 4.6).alias("u"), F.when(F.hour("ts") == 3, None).otherwise(F.col("volume") / 50).alias("v"))
    got = {r["symbol"]: regime.from_numbers(np.array(r["model"])) for r in baumwelch.fit_by_key(x, ["u", "v"], 3, 4, chunk_seconds=seconds).collect()}
    assert sorted(got) == ["S0", "S1"]  # S2 has too few rows
    pdf = x.toPandas().sort_values(["symbol", "ts"]).fillna(0.0)
    for s, h in got.items():
        want = regime.fit(pdf[pdf.symbol == s][["u", "v"]].to_numpy(), 3, 4)
        for a, b in ((h.start, want.start), (h.move, want.move), (h.means, want.means), (h.covs, want.covs)):
            assert np.abs(a - b).max() < 1e-7
