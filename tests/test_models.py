"""Fits of many keys at once against one fit a key."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from barloom.operators import labels, logistic, scoring
from barloom.operators import metrics as m

COLUMNS = ["u", "v", "w"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    out = []
    for k in range(5):
        x = rng.normal(0, [1, 5, 0.1], (300, 3))
        p = 1 / (1 + np.exp(-(x @ (rng.normal(0, 1, 3) / [1, 5, 0.1]) + rng.normal())))
        y = rng.random(300) < p if k < 4 else np.zeros(300)  # the last key has one class
        out += [(k, i, *map(float, a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    out.append((0, 999, None, 1.0, 1.0, 1))
    return spark.createDataFrame(out, "k int, i int, u double, v double, w double, label int")


def test_all_keys_in_one_fit_are_those_of_one_fit_each(spark, rows):
    mine = {r["k"]: r["beta"] for r in logistic.fit(rows, ["k"], COLUMNS).collect()}
    assert sorted(mine) == [0, 1, 2, 3]
    vector = VectorAssembler(inputCols=COLUMNS, outputCol="x").transform(rows.na.drop())
    for k in mine:
        one = LogisticRegression(featuresCol="x", regParam=0.01, maxIter=500, tol=1e-13).fit(vector.where(F.col("k") == k))
        assert mine[k] == pytest.approx([*one.coefficients, one.intercept], abs=1e-5)


def test_weights_are_repeats(rows):
    weighted = rows.withColumn("times", F.col("i") % 3)
    repeated = weighted.where("times > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("times"))))
    a, b = ({r["k"]: r["beta"] for r in x.collect()} for x in (logistic.fit(weighted, ["k"], COLUMNS, weight="times"), logistic.fit(repeated, ["k"], COLUMNS)))
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-8)


def test_bootstrap_weights_are_poisson_and_stay(spark):
    d = spark.range(60_000).select("id", logistic.poisson(["id"], F.lit(3)).alias("n"))
    share = {r["n"]: r["c"] / 60_000 for r in d.groupBy("n").agg(F.count("*").alias("c")).collect()}
    for n, p in ((0, 0.3679), (1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert share[n] == pytest.approx(p, abs=0.01)
    assert d.exceptAll(spark.range(60_000).repartition(9).select("id", logistic.poisson(["id"], F.lit(3)).alias("n"))).count() == 0


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    out = []
    for s in ("a", "b"):
        x = rng.normal(0, 1, (400, 2))
        y = (x[:, 0] + rng.normal(0, 1, 400) > 0).astype(int)
        out += [(s, i, int(y[i]), float(x[i, 0] * 0.1), *map(float, x[i])) for i in range(400)]
    return spark.createDataFrame(out, "symbol string, pos long, label int, ret double, u double, v double")


def test_walk_forward_scores_one_fold_after_another(spark, series):
    folds = labels.Folds(150, 50, 50, 80)
    got = scoring.walk_forward_scores(series, folds, ["u", "v"])
    placed = labels.with_folds(series, folds)
    scaled = scoring.robust_scaled(placed, placed.where("role = 'train'"), ["u", "v"])
    vector = VectorAssembler(inputCols=["u", "v"], outputCol="x").transform(scaled)
    want = {}
    for fold in sorted(r["fold"] for r in vector.select("fold").distinct().collect()):
        mine = vector.where(F.col("fold") == fold)
        fitted = LogisticRegression(featuresCol="x", regParam=0.01, maxIter=500, tol=1e-13).fit(mine.where("role = 'train'"))
        for r in fitted.transform(mine.where("role <> 'train'")).collect():
            want[r["symbol"], r["pos"], fold, r["role"]] = r["probability"][1]
    have = {(r["symbol"], r["pos"], r["fold"], r["split"]): r["prob_long"] for r in got.collect()}
    assert have.keys() == want.keys() and len(have) > 300
    assert max(abs(have[k] - want[k]) for k in have) < 1e-6


def test_seeds_are_fits_of_their_own(series):
    folds = labels.Folds(150, 50, 50, 80)
    s = scoring.seed_scores(series, folds, ["u", "v"], 3, ["symbol", "pos"])
    audit = {r["fold"]: r for r in scoring.seed_audit(s, ["symbol", "pos"], "ret").collect()}
    pdf = s.where("split = 'test'").toPandas()
    spearman = lambda x: x.prob_long.rank().corr(x.ret.rank())
    for fold, part in pdf.groupby("fold"):
        ics = [spearman(x) for _, x in part.groupby("seed")]
        mean = part.groupby(["symbol", "pos"]).agg(prob_long=("prob_long", "mean"), ret=("ret", "first"))
        r = audit[fold]
        assert r["seeds"] == 3 and r["mean_ic"] == pytest.approx(np.mean(ics), abs=1e-9) and r["std_ic"] == pytest.approx(np.std(ics, ddof=1), abs=1e-9)
        assert r["ensemble_ic"] == pytest.approx(spearman(mean), abs=1e-9) and r["mean_seed_spread"] > 0
    again = scoring.seed_scores(series.repartition(5), folds, ["u", "v"], 3, ["symbol", "pos"]).where("split = 'test'").toPandas()
    keys = ["symbol", "pos", "fold", "seed"]
    assert np.abs(pdf.sort_values(keys).prob_long.to_numpy() - again.sort_values(keys).prob_long.to_numpy()).max() < 1e-9


def test_permutation_importance_by_hand(spark):
    """Values dealt out anew within a key by the rank of a hash, columns of a group together."""
    rng = np.random.default_rng(5)
    rows = [("p", int(f), i, *map(float, rng.normal(0, 1, 3))) for f in range(2) for i in range(120)]
    df = spark.createDataFrame(rows, "profile string, fold int, row_pos long, a double, b double, e double").withColumn("forward_return", F.col("a") + 0.5 * F.col("b") + F.col("e"))
    score = lambda d: d["a"] + d["b"]
    groups = [("a",), ("b",), ("a", "b")]
    got = {(r["fold"], r["feature"]): (r["mean_drop"], r["std_drop"]) for r in scoring.permutation_importance(df, score, ["a", "b", ("a", "b")], ["profile", "fold"], repeats=3, seed=7).collect()}
    hashed = df.withColumns({f"h{r}": F.xxhash64("row_pos", F.lit(7), F.lit(r)) for r in range(3)}).toPandas()
    ic = lambda s, y: s.rank().corr(y.rank())
    for fold, part in hashed.groupby("fold"):
        own = part.sort_values("row_pos").reset_index(drop=True)
        base = ic(own.a + own.b, own.forward_return)
        for g in groups:
            drops = []
            for r in range(3):
                dealt = own.sort_values([f"h{r}", "row_pos"]).reset_index(drop=True)
                moved = own.assign(**{c: dealt[c] for c in g})
                drops.append(base - ic(moved.a + moved.b, moved.forward_return))
            assert got[fold, "+".join(g)] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)


def test_infinite_features_do_not_end_a_fit(spark):
    """A row with an infinite feature counts as little as one with a null; its key and the others have their models."""
    rows = [(k, int((i * 7 + k) % 5 < 2 + i % 2), float(i % 11), float(i * 3 % 7)) for k in range(2) for i in range(60)]
    plain = spark.createDataFrame(rows, "fold int, label int, a double, b double")
    odd = spark.createDataFrame([(0, 1, float("inf"), 1.0), (0, 0, 1.0, float("-inf")), (0, 1, float("nan"), 2.0), (0, 1, None, 2.0)], plain.schema)
    beta = lambda df: [r["beta"] for r in logistic.fit(df, ["fold"], ["a", "b"]).orderBy("fold").collect()]
    want, got = beta(plain), beta(plain.unionByName(odd))
    assert len(got) == 2 and [x for b in got for x in b] == pytest.approx([x for b in want for x in b], abs=1e-9)
