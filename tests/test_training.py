import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerline.catalog import model_queries as MQ
from ledgerline.operators import tree_paths as TP
from ledgerline.operators import tree_stages as TS
from ledgerline.operators.folds import stratified_folds
from ledgerline.operators.rank_metrics import metric_bounds_of
from ledgerline.plans import scoring as SC
from ledgerline.plans import training as TR
from ledgerline.session import materialize

COLUMNS = ["x", "y"]
PARAMS = {"maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 5, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(1)
    n = 600
    x, y = rng.normal(size=n), rng.normal(size=n)
    target = (x + 0.5 * y + rng.normal(scale=0.7, size=n) > 0.6).astype("int32")
    pdf = pd.DataFrame({"customer_ID": [f"c{i}" for i in range(n)], "target": target, "x": x, "y": y})
    df = spark.createDataFrame(pdf).withColumn("y", F.when(F.col("y") < -1.2, None).otherwise(F.col("y")))
    return materialize(stratified_folds(df, k=2), "folded")


@pytest.fixture(scope="module")
def fitted(folded):
    inputs = TR.fit_inputs(folded, COLUMNS)
    return TR.fit_boosted(folded.where("fold != 0"), folded.where("fold = 0"), inputs, PARAMS, 6)


def test_missing_values_are_filled_and_flagged(folded):
    inputs = TR.fit_inputs(folded, COLUMNS)
    assert inputs.names == ["x", "y", "x_missing", "y_missing"]
    rows = inputs.assemble(folded).select("y", vector_to_array("features").alias("v")).collect()
    assert any(r["y"] is None for r in rows)
    assert all(r["v"][3] == (1.0 if r["y"] is None else 0.0) for r in rows)
    assert all(r["v"][1] == pytest.approx(inputs.means["y"]) for r in rows if r["y"] is None)


def test_stage_scores_and_paths_equal_the_model(folded, fitted):
    ready = fitted.inputs.assemble(folded.where("fold = 0"))
    flat = TP.flatten_trees(folded.sparkSession, fitted.path)
    assert [len(t.value[t.feature < 0]) for t in flat] == [len(v) for v in fitted.values.values]
    own = TS.with_leaves(fitted.model, TP.path_contributions(ready, flat, 4))
    scores = [fitted.values.score(F.col(TS.LEAVES), n).alias(f"m{n}") for n in (1, 3, 6)]
    plain = fitted.model.setLeafCol("")
    out = plain.transform(own).select("paths", *scores, vector_to_array("probability").alias("p")).collect()
    for r in out:
        assert 1 / (1 + np.exp(-2 * r["m6"])) == pytest.approx(r["p"][1], abs=1e-9)
        assert sum(r["paths"]) == pytest.approx(r["m6"], abs=1e-9)
    # one tree alone: its leaves are the only margins
    assert {round(r["m1"], 12) for r in out} <= {round(v, 12) for v in fitted.values.values[0]}


def stopped(metrics, patience):
    """Best stage seen before ``patience`` stages without progress, one metric after the other."""
    best, at = -np.inf, 0
    for i, m in enumerate(metrics):
        if m > best:
            best, at = m, i
        elif i - at >= patience:
            break
    return at + 1


def test_bounds_settle_the_search_like_all_metrics():
    rng = np.random.default_rng(2)
    assert TS.settled_best({i: (m, m) for i, m in enumerate([0.1, 0.3, 0.2, 0.25, 0.9])}, 2, None) == 2
    assert TS.settled_best({i: (m, m) for i, m in enumerate([0.1, 0.3, 0.2, 0.25, 0.9])}, 10, None) == 5
    assert TS.settled_best({0: (0.3, 0.3), 1: (0.3, 0.3)}, 10, None) == 1
    ranked = 0
    for _ in range(300):
        n = int(rng.integers(1, 40))
        metrics = np.round(np.cumsum(rng.normal(0.005, 0.02, n)), 3)
        slack = rng.choice([0, 0.001, 0.01, 0.2], size=(2, n))
        asked = []

        def exact(stages):
            asked.extend(stages)
            return {i: float(metrics[i]) for i in stages}

        bounds = {i: (metrics[i] - slack[0, i], metrics[i] + slack[1, i]) for i in range(n)}
        patience = int(rng.integers(1, 12))
        assert TS.settled_best(bounds, patience, exact, batch=int(rng.integers(1, 9))) == stopped(metrics, patience)
        assert len(asked) == len(set(asked))
        ranked += len(asked)
    assert ranked < 300 * 15


@pytest.mark.parametrize("family", ["boosted", "forest"])
def test_best_number_of_trees_equals_ranking_every_stage(spark, folded, family):
    """Few and many cells: the bounds change what is ranked, never the result."""
    inputs = TR.fit_inputs(folded, COLUMNS)
    params = PARAMS if family == "boosted" else {"maxDepth": 3}
    fit = TR.fit_boosted if family == "boosted" else TR.fit_forest
    train, valid = folded.where("fold != 0"), folded.where("fold = 0")
    scorer = fit(train, valid, inputs, params, 14, patience=3)
    leafed = TS.with_leaves(scorer.model, inputs.assemble(valid))
    every = TS.exact_metrics(leafed, scorer.values, "customer_ID", "target", range(14))
    metrics = [every[i] for i in range(14)]
    assert scorer.trees == stopped(metrics, 3)
    ready = inputs.assemble(valid)
    for bins in (8, 4_096):
        assert TS.best_stage(scorer.model, scorer.values, ready, "customer_ID", "target", 3, bins) == stopped(metrics, 3)
    bounds = {r["stage"]: r for r in metric_bounds_of(TS.stage_counts(leafed, scorer.values, "target", range(14), 64), ["stage"]).collect()}
    assert all(bounds[i]["lo"] - 1e-9 <= m <= bounds[i]["hi"] + 1e-9 for i, m in enumerate(metrics))


def test_planted_best_stage_is_found(spark, folded, fitted):
    """Trees whose first two order the rows by the label, and whose later ones undo it."""
    rows = spark.createDataFrame(
        [(f"c{i}", i % 2, [float(i % 2), float(i % 4 // 2), float(i % 2), float(i % 2)]) for i in range(200)], "customer_ID string, target int, leaves array<double>")
    values = TS.LeafValues(((-1.0, 1.0), (-0.1, 0.1), (5.0, -5.0), (5.0, -5.0)), False)
    bounds = {r["stage"]: (r["lo"], r["hi"]) for r in metric_bounds_of(TS.stage_counts(rows, values, "target", range(4)), ["stage"]).collect()}
    exact = lambda stages: TS.exact_metrics(rows, values, "customer_ID", "target", stages)
    assert TS.settled_best(bounds, 10, exact) == stopped([exact(range(4))[i] for i in range(4)], 10) <= 2


def test_fold_models_come_back_from_files(spark, folded, tmp_path):
    inputs = TR.fit_inputs(folded, ["y", "x"])
    cv = TR.cross_validate(folded, lambda t, v: TR.fit_boosted(t, v, inputs, PARAMS, 5, patience=2), k=2, metadata={"k": 2})
    TR.save_folds(cv, spark, str(tmp_path / "folds"))
    back = TR.load_folds(spark, str(tmp_path / "folds"))
    assert [(s.trees, s.inputs.columns, s.values) for s in back] == [(s.trees, s.inputs.columns, s.values) for s in cv.scorers]
    again = TR.out_of_fold(folded, back).orderBy("customer_ID").collect()
    assert again == cv.oof.orderBy("customer_ID").collect()
    assert TR.predict_mean(folded, back).orderBy("customer_ID").collect() == TR.predict_mean(folded, cv.scorers).orderBy("customer_ID").collect()
    row = spark.read.schema(TR.MANIFEST).json(str(tmp_path / "folds" / "manifest")).orderBy("fold").first()
    assert row["seed"] == TR.SEED and row["family"] == "boosted" and [i["name"] for i in row["inputs"]] == ["y", "x"]


def test_out_of_fold_is_rebuilt_from_the_models(folded):
    inputs = TR.fit_inputs(folded, COLUMNS)
    cv = TR.cross_validate(folded, lambda t, v: TR.fit_boosted(t, v, inputs, PARAMS, 4), k=2, metadata={"k": 2})
    first = cv.oof.orderBy("customer_ID").collect()
    assert len(first) == 600
    assert TR.out_of_fold(folded, cv.scorers).orderBy("customer_ID").collect() == first
    row = TR.run_summary(cv).first()
    assert row["cv_oof_metric"] > 0.3 and len(row["fold_scores"]) == 2
    assert row["mean_fold_metric"] == pytest.approx(np.mean(row["fold_scores"]))
    assert row["std_fold_metric"] == pytest.approx(np.std(row["fold_scores"]))
    mean = TR.predict_mean(folded, cv.scorers)
    one = [s.transform(folded, "p").select("customer_ID", "p").toPandas().set_index("customer_ID").p for s in cv.scorers]
    got = mean.toPandas().set_index("customer_ID").prediction
    assert np.allclose(got.sort_index(), ((one[0] + one[1]) / 2).sort_index())
    gains = TR.feature_importance(folded.sparkSession, cv.scorers).collect()
    assert gains[0]["feature"] == "x" and sum(g["gain"] for g in gains) == pytest.approx(1.0)


def test_evaluator(folded):
    judge = TR.RankMetricEvaluator("x")
    assert judge.isLargerBetter() and 0 < judge.evaluate(folded) < 1


def test_drawn_params_repeat():
    assert TR.draw_params(3) == TR.draw_params(3) != TR.draw_params(3, seed=1)
    assert all(0.01 <= p["stepSize"] <= 0.05 and 3 <= p["maxDepth"] <= 7 for p in TR.draw_params(20))


def pav(x, y):
    """Isotonic fit by pooling, one point per distinct x."""
    blocks = []
    for v in np.unique(x):
        blocks.append([y[x == v].mean(), (x == v).sum(), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.unique(x), np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def test_isotonic_equals_pooling(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random(300), 2)
    y = (rng.random(300) < x).astype("int32")
    df = spark.createDataFrame(pd.DataFrame({"customer_ID": [f"c{i}" for i in range(300)], "target": y, "p": x}))
    model = TR.fit_isotonic(df, "p")
    fx, fy = pav(x, y)
    ask = spark.createDataFrame(pd.DataFrame({"p": [-1.0, 0.005, 0.333, 0.5, 2.0]}))
    got = [r["c"] for r in TR.apply_isotonic(model, ask, "p", "c").orderBy("p").collect()]
    assert np.allclose(got, np.interp([-1.0, 0.005, 0.333, 0.5, 2.0], fx, fy))
    kx, ky = TR.isotonic_knots(model)
    assert all(b > a for a, b in zip(kx, kx[1:])) and all(b >= a for a, b in zip(ky, ky[1:]))
    both = TR.cross_calibrate(df, "p")
    assert both.count() == 300 and both.where("calibrated < 0 OR calibrated > 1").count() == 0


def test_serving_model_survives_a_round_trip(spark, folded, tmp_path):
    model = TR.train_serving(folded.drop("fold"), COLUMNS, PARAMS, 4)
    TR.save_serving(model, spark, str(tmp_path / "m"))
    back = TR.load_serving(spark, str(tmp_path / "m"))
    assert back.metadata["best_iteration"] == model.metadata["best_iteration"] == len(back.scorer.model.trees)
    run = lambda m: SC.score_features(m.scorer.explain(folded), "customer_ID", SC.ScoringModel(m.scorer, m.knots), True)
    a, b = (run(m).orderBy("customer_id").collect() for m in (model, back))
    assert a == b and any(r["top_reason_codes"] for r in a)


def test_sequence_model(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        y = i % 2
        rows.append((f"c{i}", y, 2, [[float(v), float(y)] for v in rng.normal(size=2)] + [[0.0, 0.0]] * 11))
    df = spark.createDataFrame(rows, "customer_ID string, target int, length int, seq array<array<float>>")
    scorer = TR.fit_sequence_model(df, 2, hidden=4, rounds=30)
    out = scorer.transform(df, "p")
    assert TR.RankMetricEvaluator("p").evaluate(out) > 0.5


def test_adaptive_search_beats_random_draws_and_repeats():
    """On a smooth objective, over several seeds; a failed trial (NaN) does not stop it."""
    def worth(p):
        return -abs(math.log(p["stepSize"] / 0.02)) - abs(p["maxDepth"] - 6) / 4 - abs(p["subsamplingRate"] - 0.6) * 2

    gains = []
    for seed in range(8):
        found = TR.search(lambda settings: [worth(p) for p in settings], 40, seed, startup=10, batch=2)
        assert found == TR.search(lambda settings: [worth(p) for p in settings], 40, seed, startup=10, batch=2) and len(found) == 40
        for params, _ in found:
            assert 0.01 <= params["stepSize"] <= 0.05 and 3 <= params["maxDepth"] <= 7 and 10 <= params["minInstancesPerNode"] <= 150
            assert 0.2 <= float(params["featureSubsetStrategy"]) <= 0.6 and 0.5 <= params["subsamplingRate"] <= 1
        later = [s for _, s in found[20:]]
        gains.append(sum(later) / len(later) - sum(worth(p) for p in TR.draw_params(20, seed)) / 20)
    assert min(gains) > 0 and sum(gains) / len(gains) > 0.2
    assert len(TR.search(lambda settings: [float("nan")] * len(settings), 7, startup=3)) == 7


@pytest.mark.parametrize("use", ["folds", "search", "serving"])
def test_training_rows_are_dealt_over_tasks(folded, monkeypatch, use):
    """However few partitions the stored table has; a small table stays as it is."""
    one = materialize(folded.coalesce(1), "one")
    inputs, sizes, fit = TR.fit_inputs(folded, COLUMNS), [], TR.fit_boosted

    def seen(train, valid, *rest):
        sizes.append([r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()])
        return fit(train, valid, *rest)

    monkeypatch.setattr(TR, "fit_boosted", seen)
    run = {
        "folds": lambda: TR.cross_validate(one, lambda t, v: TR.fit_boosted(t, v, inputs, PARAMS, 1), k=2),
        "search": lambda: TR.tune(one, inputs, 1, 1),
        "serving": lambda: TR.train_serving(one.drop("fold"), COLUMNS, PARAMS, 1)}[use]
    run()
    assert all(len(s) == 1 for s in sizes)
    sizes.clear()
    monkeypatch.setattr(TR, "ROWS_PER_TASK", 60)
    run()
    rows = {"folds": 300, "search": 300, "serving": 539}[use]
    assert sizes and all(abs(sum(s) - rows) <= 1 and max(s) < 110 for s in sizes)


def test_features_are_computed_once_for_the_folds(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(x):
        rows.add(1)
        return x

    # two columns of a task's rows: a plan read again would count again
    features = spark.range(50, numPartitions=1).select(F.col("id").cast("string").alias("customer_ID"), F.udf(seen, "long")("id").alias("x"))
    labels = spark.range(50).select(F.col("id").cast("string").alias("customer_ID"), (F.col("id") % 2).cast("int").alias("target"))
    assert TR.folded_training_set(features, labels, 5).count() == 50 and rows.value == 50


def test_rounds_are_added_until_patience_runs_out(spark, folded, monkeypatch):
    """The trees kept are those of one fit of all rounds."""
    inputs = TR.fit_inputs(folded, COLUMNS)
    train, valid = folded.where("fold != 0"), folded.where("fold = 0")
    asked, saved = [], TR.saved_scorer
    monkeypatch.setattr(TR, "saved_scorer", lambda model, *rest: asked.append(model.getNumTrees) or saved(model, *rest))
    sampled = {**PARAMS, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.5"}
    whole = TR.fit_boosted(train, valid, inputs, sampled, 10, 1)
    monkeypatch.setattr(TR, "FIRST_ROUNDS", 2)
    grown = TR.fit_boosted(train, valid, inputs, sampled, 10, 1)
    assert asked == [10, 2, 4, 8, 10][: len(asked)] and (asked[-1] == 10 or grown.trees + 1 <= asked[-1])
    assert grown.trees == whole.trees and grown.values.values[: grown.trees] == whole.values.values[: whole.trees]
    asked.clear()
    assert len(TR.fit_boosted(train, valid, inputs, sampled, 5, 100).values.values) == 5 and asked == [2, 4, 5]
    assert spark.sparkContext.getCheckpointDir() is not None


def test_stage_scores_equal_the_column_form(folded, fitted):
    leafed = TS.with_leaves(fitted.model, fitted.inputs.assemble(folded.where("fold = 0")))
    for values in (fitted.values, TS.LeafValues(fitted.values.values, True)):
        scores = [values.score(F.col(TS.LEAVES), n).alias(f"m{n}") for n in (2, 6)]
        wanted = {(r["customer_ID"], r["target"], n - 1): r[f"m{n}"] for r in leafed.select("customer_ID", "target", *scores).collect() for n in (2, 6)}
        out = TS.stage_scores(leafed, values, "customer_ID", "target", [5, 1]).collect()
        assert {(r["key"], r["target"], r["stage"]): r["score"] for r in out} == wanted and len(out) == len(wanted)


def test_cv_oof_asks_for_the_whole_training(spark, tmp_path, monkeypatch):
    """1,500 rounds at most, patience 100, trees of 128 leaves at a rate of 0.03; the check rebuilds that run."""
    orders = spark.range(240).selectExpr(
        "id AS o_orderkey", "id % 60 AS o_custkey", "CAST(DATE_ADD(DATE'1996-01-01', CAST(id AS INT)) AS TIMESTAMP_NTZ) AS o_orderdate",
        "CAST(id * 37 % 1000 AS DOUBLE) AS o_totalprice", "ELT(CAST(id % 3 AS INT) + 1, '1-URGENT', '2-HIGH', '5-LOW') AS o_orderpriority", "ELT(CAST(id % 2 AS INT) + 1, 'F', 'P') AS o_orderstatus")
    lineitem = spark.range(480).selectExpr(
        "id % 240 AS l_orderkey", "0.05D AS l_discount", "CAST(id % 50 AS DOUBLE) AS l_quantity", "0.02D AS l_tax", "CAST(id * 13 % 700 AS DOUBLE) AS l_extendedprice", "CAST(id % 6 AS INT) AS l_linenumber")
    customer = spark.range(60).selectExpr("id AS c_custkey", "IF(id % 3 = 0, 1000D, 2000D) AS c_acctbal", "'BUILDING' AS c_mktsegment")
    for name, df in (("orders", orders), ("lineitem", lineitem), ("customer", customer)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    asked, fit = [], TR.fit_boosted

    def short(train, valid, inputs, params, rounds, patience):
        asked.append(({**TR.MODEL_A, **params}, rounds, patience))
        return fit(train, valid, inputs, {**params, "maxDepth": 2}, 2, patience)

    monkeypatch.setattr(TR, "fit_boosted", short)
    assert MQ.cv_oof(spark, str(tmp_path)).count() == 60
    assert len(asked) == 5 and all(rounds == 1500 and patience == 100 for _, rounds, patience in asked)
    assert all(p["stepSize"] == 0.03 and 2 ** p["maxDepth"] == 128 and p["minInstancesPerNode"] == 40 for p, _, _ in asked)
    check = MQ.cv_oof_check(spark, str(tmp_path)).collect()
    assert len(asked) == 5 and len(check) == 60 and all(r["in_range"] and r["same_from_files"] for r in check)
