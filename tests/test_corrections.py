"""Edge cases: missing scores, integer codes, repeated keys, rows without a customer, infinities."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import encode as E
from ledgerline.operators import features as FT
from ledgerline.operators import joins as J
from ledgerline.operators.ordered import exact_quantiles
from ledgerline.plans import blending as B
from ledgerline.roles import Roles


def test_bounds_hold_with_missing_scores(spark):
    rows = [(f"c{i}", int(i * 7 % 10 < 3), None if i % 4 == 0 else (i * 37 % 101) / 101, (i * 53 % 97) / 97) for i in range(400)]
    df = spark.createDataFrame(rows, "customer_ID string, target int, a double, b double")
    grid = [[w / 10, 1 - w / 10] for w in range(11)]
    ids = list(range(11))
    bounds = {r["weight_id"]: r for r in B.metric_bounds(df, ["a", "b"], grid, ids, "target", 0.0, 1.0, 64).collect()}
    for r in B.evaluate_weights(df, ["a", "b"], grid, ids).collect():
        assert bounds[r["weight_id"]]["lo"] - 1e-9 <= r["metric"] <= bounds[r["weight_id"]]["hi"] + 1e-9


def test_integer_codes_meet_the_float_dictionary(spark):
    train = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "x float")
    dictionary = E.fit_dictionary(train, ["x"])
    test = spark.createDataFrame([(0,), (2,), (7,), (None,)], "x int")
    assert sorted(r.x for r in E.apply_dictionary(test, dictionary, ["x"]).collect()) == [-1, -1, 0, 2]


def test_repeated_keys_are_not_aligned(spark):
    a = spark.createDataFrame([("k", 1, 0.5), ("l", 0, 0.1)], "customer_ID string, target int, oof_pred double")
    b = spark.createDataFrame([("k", 1, 0.5), ("k", 1, 0.6), ("l", 0, 0.1)], "customer_ID string, target int, oof_pred double")
    aligned = J.align_predictions({"a": a, "b": b})
    assert J.misaligned(aligned, ["a", "b"]).first()["n_unmatched"] == 1
    with pytest.raises(Exception, match="not aligned"):
        J.check_aligned(aligned, ["a", "b"]).collect()


STATEMENTS = "customer_ID string, S_2 date, seq long, P_2 double, D_63 string"


@pytest.mark.parametrize("categoricals", [(), ("D_63",)])
def test_rows_without_customer_are_left_out(spark, categoricals):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-01', 1L, 2D, 'x'), (NULL, DATE'2020-01-01', 2L, 3D, 'y') AS t(customer_ID, S_2, seq, P_2, D_63)")
    roles = Roles(tie="seq", categoricals=categoricals, not_features=() if categoricals else ("D_63",))
    assert [r.customer_ID for r in FT.customer_features(df, roles).collect()] == ["a"]


def test_one_latest_row_without_tie(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-01', 1D), ('a', DATE'2020-02-01', 2D), ('a', DATE'2020-02-01', 3D) AS t(customer_ID, S_2, P_2)")
    assert FT.mark_latest(df, Roles()).where("is_latest").count() == 1


def test_unused_categorical_block_leaves_the_plan(spark):
    df = spark.range(20).select(
        F.col("id").cast("string").alias("customer_ID"), F.current_date().alias("S_2"), F.col("id").alias("seq"),
        F.rand().alias("P_2"), F.lit("x").alias("D_63"))
    used = FT.customer_features(df, Roles(tie="seq", categoricals=("D_63",))).select("customer_ID", "P_2_mean")
    assert "Join" not in used._jdf.queryExecution().optimizedPlan().toString()


def test_large_ties_fall_back_to_a_struct(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2020-01-01', 9000000000000000L, 1D), ('a', DATE'2020-01-01', -5L, 2D) AS t(customer_ID, S_2, seq, P_2)")
    row = FT.numeric_aggregates(df, Roles(tie="seq", day_grain=True), ["P_2"]).first()
    assert (row.P_2_first, row.P_2_last) == (2.0, 1.0)


def test_quantiles_with_minus_infinity(spark):
    df = spark.createDataFrame([(float("-inf"),)] * 3 + [(float(i),) for i in range(4)], "v double")
    assert exact_quantiles(df, "v", [0.0, 1.0]).first()["q"] == [-math.inf, 3.0]


def test_lookup_join_runs_no_job_for_a_small_stored_lookup(spark, tmp_path):
    """The size comes from the statistics of the stored table, not from a count."""
    spark.range(100).selectExpr("id AS k").write.parquet(str(tmp_path / "keys"))
    spark.range(1_000).selectExpr("id % 200 AS k", "id").write.parquet(str(tmp_path / "rows"))
    keys = spark.read.schema("k long").parquet(str(tmp_path / "keys"))
    rows = spark.read.schema("k long, id long").parquet(str(tmp_path / "rows"))
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    joined = J.lookup_join(rows, keys, ["k"], "left_semi")
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert joined.count() == 500


def test_skew_check_compares_texts(spark):
    left = spark.createDataFrame([("a", "x", 1.0), ("b", None, 2.0)], "k string, t string, v double")
    right = spark.createDataFrame([("a", "y", 1.0), ("b", None, 2.0)], "k string, t string, v double")
    got = {r["feature"]: (r["null_mismatches"], r["max_abs_diff"], r["matches"]) for r in FT.skew_check(left, right, "k", ["t", "v"]).collect()}
    assert got == {"t": (0, 1.0, False), "v": (0, 0.0, True)}


def test_whole_codes_beyond_doubles_stay_apart(spark):
    big = 2**53
    values = [-big - 2, -big - 1, -5, 7, big, big + 1, big + 2, 2**63 - 2, 2**63 - 1]
    train = spark.createDataFrame([(v,) for v in [*values, None]], "x long")
    dictionary = E.fit_dictionary(train, ["x"])
    assert E.dictionary_as_lists(dictionary)["x"] == ["-5.0" if v == -5 else "7.0" if v == 7 else str(v) for v in values]
    again = E.apply_dictionary(train.withColumn("v", F.col("x")), dictionary, ["x"])
    assert {r.v: r.x for r in again.collect()} == {v: i for i, v in enumerate(values)} | {None: -1}
    floats = spark.createDataFrame([(float(big + 2),), (7.0,), (float("nan"),), (1e300,)], "x double")
    assert sorted(r.x for r in E.apply_dictionary(floats, dictionary, ["x"]).collect()) == [-1, -1, 3, 6]
    exact = train.select(F.col("x").cast("decimal(25,2)").alias("x"))
    assert sorted(r.x for r in E.apply_dictionary(exact, dictionary, ["x"]).collect()) == [-1, *range(len(values))]
