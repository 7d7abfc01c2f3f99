"""Steps that many reports share: with every input taken for a large one, results stay and the rows are not made or ordered again."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import chunks, policies, ranks, reports, review, scoring
from barloom.operators import metrics as m
from barloom.plans import QUERIES, policy_queries, tables
from barloom.sources import shared

SF = "/root/testdata/sf0.001"
N = 6000


@pytest.fixture
def large(monkeypatch):
    """All inputs are large; names and tables that are written are listed."""
    made = []

    def written(df, name):
        made.append((name, shared.written(df, name)))
        return made[-1][1]

    monkeypatch.setattr(ranks, "LOCAL_BYTES", 0)
    monkeypatch.setattr(ranks, "written", written)
    return made


def scored(spark):
    i = F.col("id")
    return spark.range(N).select(F.lit("p").alias("profile"), (i % 2).alias("fold"), i.alias("row_pos"), ((i * 7919) % 53 / 53.0).alias("prob_long"), ((i * 31) % 11 / 10.0).alias("forward_return"), (i % 3 == 0).cast("int").alias("label"), (i * 17 % 101).cast("double").alias("f"))


def counted(spark, df):
    """df behind a task that counts how often its rows are made."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


def values(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_band_totals_move_only_rows_of_cut_values(spark, large):
    df = scored(spark).withColumn("label", F.when(F.col("row_pos") % 7 > 0, (F.col("row_pos") % 3 == 0).cast("int"))).withColumn("forward_return", F.when(F.col("row_pos") % 5 > 0, F.col("forward_return")))
    df, seen = counted(spark, df)
    r = F.col("forward_return")
    order, by = [F.col("prob_long"), F.col("row_pos")], ["profile", "fold"]
    got = values(reports.bin_totals(df, by, 10))
    # rows are made once, and none is moved but those whose value a cut goes through, at most 9 values of 53 a fold
    assert seen.value == N
    assert max(t.count() for name, t in large if name != "band-rows") < N / 3
    plain = ranks.numbered(df, by, order, "_r", "_rows", 1).withColumn("bin", ranks.bin_of(F.col("_r"), 10))
    want = values(plain.groupBy(*by, "bin").agg(F.count("*"), F.sum("label"), F.sum(r), F.count(r).cast("double"), F.count_if(r > 0).cast("double")))
    assert got == want and len(got) == 20


def test_bins_order_values_not_rows(spark, large):
    df, by, order = scored(spark), ["profile", "fold"], [F.col("prob_long"), F.col("row_pos")]
    got = values(ranks.quantile_bin(df, order, 10, by).select("row_pos", "bin"))
    ordered = [t.count() for name, t in large if name == "ranges"]
    assert sum(ordered) < N / 2  # the values' counts, and the rows of values that a cut goes through
    assert got == values(ranks.quantile_bin(df, order, 10, by, ranges=1).select("row_pos", "bin"))


def test_bins_of_one_common_value(spark, large):
    df = scored(spark).withColumn("prob_long", F.lit(0.5))
    order = [F.col("prob_long"), F.col("row_pos")]
    assert values(ranks.quantile_bin(df, order, 10, ["profile"]).select("row_pos", "bin")) == values(ranks.quantile_bin(df, order, 10, ["profile"], ranges=1).select("row_pos", "bin"))


def test_correlation_makes_its_rows_once(spark, large, monkeypatch):
    df, seen = counted(spark, scored(spark).withColumn("fold", F.when(F.col("fold") == 0, 0)))  # a null key
    got = values(m.rank_ic(df, ["profile", "fold"]).select(F.coalesce("fold", F.lit(9)), "rank_ic", "n"))
    assert seen.value == N
    rows = [r.asDict() for r in scored(spark).collect()]
    for fold, ic, n in got:
        own = [r for r in rows if r["fold"] == (0 if fold == 0 else 1)]
        rank = lambda c: {v: sum(x[c] < v for x in own) + (sum(x[c] == v for x in own) - 1) / 2 for v in {x[c] for x in own}}
        a, b, mid = rank("prob_long"), rank("forward_return"), (len(own) - 1) / 2
        x, y = [a[r["prob_long"]] - mid for r in own], [b[r["forward_return"]] - mid for r in own]
        assert n == len(own) and ic == pytest.approx(sum(i * j for i, j in zip(x, y)) / (sum(i * i for i in x) * sum(j * j for j in y)) ** 0.5, abs=1e-9)


def test_blends_are_made_of_one_row_a_key(spark, large):
    df = scored(spark).withColumn("profile", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    combos = reports.all_blends(["a", "b", "c"], {"w": (0.5, 0.3, 0.2)})
    plan = reports.blends(df, combos, ["row_pos", "fold"], ["fold"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Aggregate")  # blends come after the exchange of rows


def test_importance_numbers_rows_before_its_variants(spark, large, monkeypatch):
    score = lambda d: d["f"] / 100 + d["prob_long"]
    df, seen = counted(spark, scored(spark))
    got = values(scoring.permutation_importance(df, score, ["f", "prob_long", ("f", "prob_long")], ["profile", "fold"]))
    assert seen.value == N
    assert sum(t.count() for name, t in large if name == "ranges" and "row_pos" in t.columns) == 3 * N  # places, and two repeats
    monkeypatch.setattr(ranks, "LOCAL_BYTES", 64 << 20)
    assert got == values(scoring.permutation_importance(scored(spark), score, ["f", "prob_long", ("f", "prob_long")], ["profile", "fold"]))


def test_rolling_label_mean_in_chunks(spark, monkeypatch):
    plain = values(QUERIES["w16_rolling_label_mean"](spark, SF).where("label_mean IS NOT NULL"))
    monkeypatch.setattr(ranks, "LOCAL_BYTES", 0)
    deal, rows = chunks.in_chunks, []
    monkeypatch.setattr(chunks, "in_chunks", lambda *a, **k: rows.append(1) or deal(*a, **(k | {"rows": 200})))
    assert values(QUERIES["w16_rolling_label_mean"](spark, SF).where("label_mean IS NOT NULL")) == plain and rows


def test_fold_models_are_counted_in_one_exchange(spark):
    plan = QUERIES["m16_fold_model_means"](spark, SF)._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2  # lines, then rows: no exchange for distinct profiles


def test_predictions_are_hashed_not_sorted(spark, tmp_path):
    """A line's least flag decides its label, as the least of strings would, but no string is aggregated."""
    flags = [["R"], ["A", "R"], ["R", "S"], [None, "R"], [None], ["N"], ["R", "R"], ["RA", "R"], ["", "R"], ["S"]]
    rows = [(i, 1, 3, 4, 9.0, 10.0, 0.05, 0.0, f, date(1995, 1, 1)) for i, fs in enumerate(flags) for f in fs]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    p = tables.preds(spark, str(tmp_path))
    got = [r["label"] for r in p.orderBy("row_pos").collect()]
    assert got == [None if min((f for f in fs if f is not None), default=None) is None else int(min(f for f in fs if f is not None) == "R") for fs in flags]
    assert "SortAggregate" not in p._jdf.queryExecution().executedPlan().toString()


def test_reliability_passes_val_rows_once_for_scores(spark, monkeypatch):
    """Gap, rates, deviation, KS and average precision follow from one table of distinct scores, whatever the rows."""
    rows = [("c", 0, "val", i, (i * 7 % 11) / 10, None if i % 13 == 0 else int(i * 5 % 7 < 3), 0.01 * (i % 5 - 2)) for i in range(200)]
    rows += [("c", 0, "test", 1000 + i, (i * 3 % 10) / 9, i % 2, 0.01 * (i % 3 - 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "profile string, fold int, split string, row_pos long, prob_long double, label int, forward_return double")
    official = spark.createDataFrame([("c", 0, 0.5, 0.4)], "profile string, fold int, test_f1_constrained double, test_pred_rate_constrained double")
    top = spark.createDataFrame([("c", 0, 1.0, 0.0)], "profile string, fold int, lift double, mean_return double")
    kept, real = [], policies.written
    monkeypatch.setattr(policies, "written", lambda d, name: kept.append(name) or real(d, name))
    got = policies.reliability_gates(df, official, top).first()
    assert kept == ["val-steps"]
    x = np.array([(r[4], r[5]) for r in rows if r[2] == "val" and r[5] is not None])
    on, off = x[x[:, 1] == 1, 0], x[x[:, 1] == 0, 0]
    ks = max(abs((on >= t).mean() - (off >= t).mean()) for t in x[:, 0])
    assert [got[c] for c in ("val_score_gap", "val_label_rate", "val_prob_std", "val_pred_rate_050", "val_score_ks")] == pytest.approx([on.mean() - off.mean(), x[:, 1].mean(), x[:, 0].std(), (x[:, 0] >= 0.5).mean(), ks], abs=1e-12)


def test_regime_thresholds_pass_rows_once(spark, large, monkeypatch):
    """The official thresholds and those of regimes come from one table of counts."""
    i = F.col("id")
    df = scored(spark).withColumn("id", F.col("row_pos")).withColumn("split", F.when(i % 5 < 2, "val").otherwise("test")).withColumns({f"regime_prob_{k}": ((i * (k + 2)) % 7).cast("double") for k in range(3)})
    rows, seen = counted(spark, df.select("profile", "fold", "split", "prob_long", "label", "forward_return", *[f"regime_prob_{k}" for k in range(3)]))
    monkeypatch.setattr(policy_queries, "rows", lambda *_: rows)
    got = values(policy_queries.regime_folds(spark, SF))
    assert seen.value == N
    steps = m.score_steps(df, ["profile", "fold", "split"])
    again = m.steps_of_counts(policies.regime_counts(df, 3).select("profile", "fold", "split", "regime", "threshold", "n", "pos"), ["profile", "fold", "split"])
    assert values(again.select(*steps.columns)) == values(steps)
    targets = policy_queries.TARGETS
    official = review.threshold_diagnostics(df, targets.most_rate, targets.least_precision)
    plain = policies.regime_thresholds(df, 3, official, most_rate=0.7, least_precision=0.2, gates=policy_queries.REGIME_FOLD, **policy_queries.LEAST_ROWS)
    assert len(got) == 2 and got == values(plain)
