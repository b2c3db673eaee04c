from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scores as S
from ledgerline.functions.calibrate import LITERAL_KNOTS, calibrate
from ledgerline.functions.describe import describe_feature
from ledgerline.operators.contributions import LinearScore, reason_codes
from ledgerline.operators.features import customer_features
from ledgerline.operators.presets import pick_presets
from ledgerline.operators.rank_metrics import rank_metric
from ledgerline.plans import blending as B
from ledgerline.plans import scoring as SC
from ledgerline.roles import Roles

ROLES = Roles(categoricals=())
SCORE = LinearScore({"P_2_last": -4.0, "D_39_max": 0.8, "statement_count": 0.1}, {"P_2_last": 0.5}, 0.2)
MODEL = SC.ScoringModel(SCORE, ([0.1, 0.5, 0.9], [0.05, 0.4, 0.95]))


def portfolio(spark, customers=("cust_a", "cust_b", "cust_c")):
    rows = []
    for c in customers:
        for day, p, d in ((datetime(2018, 1, 31), 0.6, 0.0), (datetime(2018, 2, 28), 0.4, 0.5), (datetime(2018, 3, 31), 0.1, 2.0)):
            rows.append((c, day, p, d))
    return spark.createDataFrame(rows, "customer_ID string, S_2 timestamp_ntz, P_2 double, D_39 double")


def test_batch_contract(spark):
    out = SC.score_portfolio(portfolio(spark).repartition(5), ROLES, MODEL).collect()
    assert {r["customer_id"] for r in out} == {"cust_a", "cust_b", "cust_c"} and len(out) == 3
    assert all(0 <= r["probability_of_default"] <= 1 for r in out)
    assert all(r["risk_band"] in {"very low", "low", "medium", "high", "very high"} for r in out)


def test_empty_portfolio(spark):
    assert SC.score_portfolio(portfolio(spark).where("P_2 > 9"), ROLES, MODEL).count() == 0


def test_reasons(spark):
    row = SC.score_portfolio(portfolio(spark), ROLES, MODEL, with_reasons=True).first()
    reasons = row["top_reason_codes"]
    assert [r["feature"] for r in reasons] == ["D_39_max", "P_2_last", "statement_count"]
    assert reasons[1]["description"] == "most recent payment (P_2)" and reasons[1]["contribution"] == 1.6


def test_reasons_skip_negative_and_nonfinite(spark):
    df = spark.createDataFrame([(float("inf"), -1.0, 0.5, 0.5)], "a double, b double, c double, d double")
    parts = {f"{n.upper()}_1_last": F.col(n) for n in "abcd"}
    got = df.select(reason_codes(parts, 4).alias("r")).first()["r"]
    assert [x["feature"] for x in got] == ["C_1_last", "D_1_last"]


def test_what_if(spark):
    out = SC.what_if_scores(portfolio(spark), ROLES, MODEL, {"as_is": {}, "pays": {"P_2": 2.0}}).toPandas()
    assert len(out) == 6
    wide = out.pivot(index="customer_id", columns="scenario", values="probability_of_default")
    assert (wide["pays"] < wide["as_is"]).all()


@pytest.mark.parametrize("many", [False, True])
def test_calibration_equals_interp(spark, many):
    rng = np.random.default_rng(4)
    m = LITERAL_KNOTS + 50 if many else 152
    x, y = np.sort(rng.random(m)), np.sort(rng.random(m))
    p = np.concatenate([[-1.0, 0.0, 2.0, x[0], x[-1], x[3]], rng.random(300)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(p)), "p": p}))
    got = calibrate(df, "p", x.tolist(), y.tolist(), "c").orderBy("i").toPandas()
    assert np.allclose(got.c, np.interp(p, x, y), atol=1e-12)


def test_calibration_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,)], "p double")
    got = [r["c"] for r in calibrate(df, "p", [0.0, 1.0], [0.0, 1.0], "c").collect()]
    assert got == [None, None, 0.5]


def test_bands_use_strict_limits(spark):
    df = spark.createDataFrame([(0.04999,), (0.05,), (0.2,), (0.5,), (0.8,)], "p double")
    assert [r[0] for r in df.select(S.risk_band(F.col("p"))).collect()] == ["very low", "low", "medium", "high", "very high"]


def test_clean_nonfinite(spark):
    df = spark.createDataFrame([(float("inf"), [1.0, float("nan")])], "x double, a array<double>")
    assert S.clean_nonfinite(df).first() == (None, [1.0, None])


def test_descriptions(spark):
    names = {"P_2_last": "most recent payment (P_2)", "D_39_last_mean_diff": "recent deviation in delinquency (D_39)",
             "S_3_last_first_diff": "trend in spend (S_3)", "B_30_nunique": "number of distinct balance (B_30)",
             "Z_1_weird": "weird account (Z_1)", "statement_count": "statement count", "history_days": "length of history"}
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert {r[0]: r[1] for r in df.select("f", describe_feature(F.col("f"))).collect()} == names


def test_presets_without_replacement(spark):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.9)], "customer_id string, probability_of_default double")
    got = pick_presets(df, targets={"x": 0.1, "y": 0.12, "z": 0.11}).collect()
    assert [(r["label"], r["customer_id"]) for r in got] == [("x", "a"), ("y", "b"), ("z", "c")]


def models(spark, n=700):
    rng = np.random.default_rng(8)
    y = (rng.random(n) < 0.3).astype("int32")
    pdf = pd.DataFrame({"customer_ID": [f"c{i}" for i in range(n)], "target": y})
    for name, noise in (("a", 1.0), ("b", 1.3), ("c", 1.6)):
        pdf[name] = 1 / (1 + np.exp(-(2 * y - 1 + rng.normal(scale=noise, size=n))))
    return spark.createDataFrame(pdf)


def test_grids():
    assert len(B.three_way_grid()) == 847 and len(B.three_way_grid(exact=True)) == 861
    assert B.two_way_grid()[0] == [1.0, 0.0] and len(B.two_way_grid()) == 52


def test_bounds_hold_and_search_is_exact(spark):
    df = models(spark)
    grid = B.three_way_grid(11)
    ids = list(range(len(grid)))
    exact = {r["weight_id"]: r["metric"] for r in B.evaluate_weights(df, ["a", "b", "c"], grid, ids).collect()}
    for bins in (4, 64, 2_048):
        bounds = B.metric_bounds(df, ["a", "b", "c"], grid, ids, "target", 0.0, 1.0, bins).collect()
        assert len(bounds) == len(grid)
        assert all(b["lo"] - 1e-12 <= exact[b["weight_id"]] <= b["hi"] + 1e-12 for b in bounds)
    best = B.blend_search(df, ["a", "b", "c"], grid, passes=(16, 256)).first()
    top = max(exact.values())
    first = next(i for i in ids if exact[i] == top)
    assert best["metric"] == top
    assert [best["w_a"], best["w_b"], best["w_c"]] == [round(w, 3) for w in grid[first]]


def test_search_start_value_wins_ties(spark):
    df = models(spark).withColumn("b", F.col("a"))
    best = B.blend_search(df, ["a", "b"], B.two_way_grid()).first()
    assert best["w_a"] == 1.0
    assert best["metric"] == rank_metric(df, score="a").first()["metric"]


def test_run_portfolio(spark, tmp_path):
    stats = SC.run_portfolio(portfolio(spark), ROLES, MODEL, str(tmp_path / "scores"))
    assert stats["customers"] == 3 and stats["customers_per_second"] > 0
    assert spark.read.parquet(str(tmp_path / "scores")).columns[0] == "customer_id"


def test_constant_class_histogram(spark):
    from ledgerline.operators.profile import density_histogram

    df = spark.createDataFrame([("a", 2.0)] * 4 + [("b", 0.0), ("b", 10.0), ("b", None)], "g string, x double")
    got = {(r["g"], r["bin"]): (r["left_edge"], r["rows"], r["density"]) for r in density_histogram(df, "x", "g", 10).collect()}
    want = np.histogram([2.0] * 4, 10, density=True)
    assert got[("a", 5)] == (pytest.approx(2.0), 4, pytest.approx(want[0][5]))
    assert got[("b", 0)] == (0.0, 1, 0.5) and got[("b", 9)] == (9.0, 1, 0.5)


def test_what_if_features_equal_those_of_overridden_statements(spark):
    """One statement only, gaps, equal rows, no date, an override that brings a new extreme."""
    data = [("a", datetime(2018, 1, 1), 0.5, 3.0, "x"), ("a", datetime(2018, 2, 1), None, 1.0, None), ("a", datetime(2018, 3, 1), 0.7, None, "y"),
            ("b", datetime(2018, 1, 1), None, 2.0, "x"), ("c", datetime(2018, 1, 1), 0.1, 1.0, "x"),
            ("c", datetime(2018, 2, 1), 0.4, 9.0, "z"), ("c", datetime(2018, 2, 1), 0.4, 9.0, "z"), ("d", None, 0.3, 0.3, "x"),
            (None, datetime(2018, 1, 1), 0.2, 1.0, "x")]
    source = spark.createDataFrame(data, "customer_ID string, S_2 timestamp_ntz, P_2 double, B_1 float, D_63 string")
    roles = Roles(categoricals=("D_63",))
    scenarios = {"as_is": {}, "low": {"P_2": -1.0}, "both": {"P_2": 0.45, "B_1": 50.0}}
    got = SC.what_if_features(source, roles, scenarios).toPandas()
    each = SC.what_if_statements(source, roles, scenarios)
    for name in scenarios:
        want = customer_features(each.where(F.col("scenario") == name).drop("scenario"), roles).toPandas()
        mine = got[got["scenario"] == name].drop(columns="scenario")
        pd.testing.assert_frame_equal(
            mine.sort_values("customer_ID", ignore_index=True), want.sort_values("customer_ID", ignore_index=True), rtol=1e-9)
    assert SC.what_if_features(source.limit(0), roles, scenarios).count() == 0
