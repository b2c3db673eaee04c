"""Statement features against pandas, and the edge cases of missing values and order."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import encode as E
from ledgerline.operators import features as FT
from ledgerline.operators import joins as J
from ledgerline.operators import sequences as SQ
from ledgerline.operators import wide_features as WF
from ledgerline.roles import Roles

PACKED = Roles(tie="seq", day_grain=True, tie_bits=42, categoricals=("B_30", "D_63"))
STRUCT = Roles(tie="seq", categoricals=("B_30", "D_63"))
DATE_ONLY = Roles(categoricals=("B_30", "D_63"), not_features=("seq",))


def sample(n_customers=60, seed=3, hot=0):
    rng = np.random.default_rng(seed)
    rows = []
    seq = 0
    for c in range(n_customers):
        size = int(rng.integers(1, 25)) if not (hot and c == 0) else hot
        for _ in range(size):
            seq += 1
            rows.append({
                "customer_ID": f"c{c}", "S_2": datetime(2018, 1, 1) + timedelta(days=int(rng.integers(0, 400))),
                "seq": seq, "P_2": None if rng.random() < 0.3 else float(rng.integers(0, 1000)),
                "B_1": None if c == 5 else float(rng.integers(0, 50)),
                "B_30": None if rng.random() < 0.2 else float(rng.integers(0, 3)),
                "D_63": None if rng.random() < 0.2 else str(rng.choice(["CL", "CO", "CR"])),
            })
    rng.shuffle(rows)
    return pd.DataFrame(rows)


SCHEMA = "customer_ID string, S_2 timestamp_ntz, seq long, P_2 double, B_1 double, B_30 float, D_63 string"


def statements(spark, pdf, parts=7):
    rows = [tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)]
    rows = [(*r[:1], r[1].to_pydatetime(), *r[2:]) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def by_pandas(pdf):
    s = pdf.sort_values(["customer_ID", "S_2", "seq"])
    g = s.groupby("customer_ID")
    out = pd.DataFrame(index=sorted(s.customer_ID.unique()))
    for c in ("P_2", "B_1"):
        s[c] = s[c].astype(float)
        agg = s.groupby("customer_ID")[c].agg(["mean", "std", "min", "max", "first", "last"])
        for k in agg:
            out[f"{c}_{k}"] = agg[k]
        out[f"{c}_last_mean_diff"] = agg["last"] - agg["mean"]
        out[f"{c}_last_first_diff"] = agg["last"] - agg["first"]
        out[f"{c}_range"] = agg["max"] - agg["min"]
    for c in ("B_30", "D_63"):
        out[f"{c}_last"], out[f"{c}_nunique"], out[f"{c}_count"] = g[c].last(), g[c].nunique(), g[c].count()
    out["statement_count"] = g["S_2"].count()
    out["history_days"] = (g["S_2"].max() - g["S_2"].min()).dt.days
    return out


@pytest.mark.parametrize("roles", [PACKED, STRUCT])
@pytest.mark.parametrize("scattered", [False, True])
def test_features_equal_pandas(spark, roles, scattered):
    pdf = sample()
    got = FT.customer_features(statements(spark, pdf), roles, scattered).toPandas().set_index("customer_ID").sort_index()
    want = by_pandas(pdf)
    assert set(got.columns) == set(want.columns) and len(got) == len(want)
    for c in want:
        if c == "D_63_last":
            assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist()
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_one_huge_customer(spark):
    pdf = sample(40, hot=400)
    got = FT.customer_features(statements(spark, pdf), PACKED).toPandas().set_index("customer_ID")
    want = by_pandas(pdf)
    assert got.loc["c0", "P_2_last"] == want.loc["c0", "P_2_last"]
    assert got.loc["c0", "statement_count"] == 400


def test_single_statement_has_no_deviation(spark):
    pdf = sample(1).head(1)
    pdf["P_2"] = 4.0
    row = FT.customer_features(statements(spark, pdf), PACKED).first()
    assert row["P_2_std"] is None and row["P_2_last_mean_diff"] == 0.0 and row["history_days"] == 0


def test_numeric_block_stays_a_hash_aggregate(spark):
    plan = FT.numeric_aggregates(statements(spark, sample(5)), PACKED)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_packed_order_refuses_what_does_not_fit(spark):
    pdf = sample(2)
    pdf["seq"] = 2**60
    with pytest.raises(Exception, match="packed order key"):
        FT.numeric_aggregates(statements(spark, pdf), PACKED, ["P_2"]).collect()


def test_align_and_sink(spark):
    f = FT.numeric_aggregates(statements(spark, sample(4)), PACKED, ["P_2"])
    out = FT.to_float_sink(FT.align_columns(f, ["P_2_max", "nothing"], "customer_ID"), ["customer_ID"])
    assert out.dtypes == [("customer_ID", "string"), ("P_2_max", "float"), ("nothing", "float")]
    assert out.where("nothing IS NOT NULL").count() == 0


def test_missing_to_null(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string")
    assert [r["x"] for r in FT.missing_to_null(df).orderBy("s").collect()] == [None, 1.0]


def test_override_touches_only_the_latest(spark):
    pdf = sample(20)
    got = FT.override_latest(statements(spark, pdf), PACKED, {"P_2": -5.0}).toPandas().set_index("seq").sort_index()
    last = pdf.sort_values(["customer_ID", "S_2", "seq"]).groupby("customer_ID").tail(1).seq
    assert len(got) == len(pdf)
    assert (got.loc[last, "P_2"] == -5.0).all() and (got.drop(last).P_2 != -5.0).all()


def test_dictionary_codes(spark):
    train = statements(spark, sample(30))
    f = FT.categorical_aggregates(train, PACKED)
    d = E.fit_last_dictionary(f, ["B_30", "D_63"])
    assert E.dictionary_as_lists(d) == {"B_30": ["0.0", "1.0", "2.0"], "D_63": ["CL", "CO", "CR"]}
    new = spark.createDataFrame([("x", "CO", 2.0), ("y", "??", None), ("z", None, 9.0)], "customer_ID string, D_63_last string, B_30_last float")
    got = {r[0]: (r[1], r[2]) for r in E.encode_last(new, d, ["B_30", "D_63"]).collect()}
    assert got == {"x": (1, 2), "y": (-1, -1), "z": (-1, -1)}


def test_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([(10.0,), (9.0,), (-1.0,)], "x double")
    assert E.dictionary_as_lists(E.fit_dictionary(df, ["x"])) == {"x": ["-1.0", "9.0", "10.0"]}


@pytest.mark.parametrize("max_rows", [1_000, 0])
def test_lookup_join_both_ways(spark, max_rows):
    """One key holds 60 % of the rows, some keys are missing."""
    key = F.when(F.col("id") < 300, 0).when(F.col("id") >= 480, None).otherwise(F.col("id"))
    left = spark.range(500).select(key.alias("k"), "id")
    right = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = J.lookup_join(left, right, ["k"], "left", max_rows, share=10).toPandas()
    assert sorted(got.id) == list(range(500))
    assert got[got.k < 400].v.tolist() == (got[got.k < 400].k * 2).tolist()
    assert got[~(got.k < 400)].v.isna().all()
    assert J.lookup_join(left, right, ["k"], "inner", max_rows, share=10).count() == 400
    assert J.lookup_join(left, right, ["k"], "left_semi", max_rows, share=10).count() == 400
    assert J.lookup_join(left, right, ["k"], "left_anti", max_rows, share=10).count() == 100


def test_hot_keys(spark):
    left = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in J.hot_keys(left, ["k"], 10).collect()] == [0]


def test_missing_label_fails(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "customer_ID string")
    labels = spark.createDataFrame([("a", 1)], "customer_ID string, target int")
    with pytest.raises(Exception, match="no label for b"):
        J.labels_for_all(ids, labels).collect()


def test_alignment_fails_loudly(spark):
    a = spark.createDataFrame([("a", 1, 0.1), ("b", 0, 0.2)], "customer_ID string, target int, oof_pred double")
    b = spark.createDataFrame([("a", 1, 0.3), ("c", 0, 0.4)], "customer_ID string, target int, oof_pred double")
    with pytest.raises(Exception, match="not aligned"):
        J.check_aligned(J.align_predictions({"m": a, "n": b}), ["m", "n"]).collect()


def test_sequences(spark):
    pdf = sample(30).fillna({"P_2": 0.0, "B_1": 0.0})
    df = statements(spark, pdf)
    got = {r["customer_ID"]: r for r in SQ.padded_sequences(df, PACKED, ["P_2", "B_1"]).collect()}
    for c, part in pdf.sort_values(["S_2", "seq"]).groupby("customer_ID"):
        kept = part.tail(13)[["P_2", "B_1"]].astype(float).values.tolist()
        assert got[c]["length"] == len(kept)
        assert got[c]["seq"] == kept + [[0.0, 0.0]] * (13 - len(kept))


def test_sequence_cut_happens_before_the_shuffle(spark):
    plan = SQ.sequence_positions(statements(spark, sample(5)), PACKED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_standardize(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 5.0), ("c", None, 5.0), ("d", 1e9, 5.0)], "k string, x double, y double")
    stats = SQ.stats_as_dict(SQ.norm_stats(df.where("k IN ('a', 'b')"), ["x", "y"]))
    assert stats["x"] == (2.0, 1.0) and stats["y"] == (5.0, pytest.approx(1e-6))
    got = {r["k"]: (r["x"], r["y"]) for r in SQ.standardize_rows(df, stats, ["k"]).collect()}
    assert got == {"a": (-1.0, 0.0), "b": (1.0, 0.0), "c": (0.0, 0.0), "d": (10.0, 0.0)}


def test_skew_check_finds_differences(spark):
    a = spark.createDataFrame([("a", 1.0, 2.0), ("b", None, 1.0)], "customer_ID string, x double, y double")
    b = spark.createDataFrame([("a", 1.0005, 2.0), ("b", 3.0, 1.5)], "customer_ID string, x double, y double")
    got = {r["feature"]: r for r in FT.skew_check(a, b, "customer_ID", ["x", "y"]).collect()}
    assert got["x"]["null_mismatches"] == 1 and not got["x"]["matches"]
    assert got["y"]["max_abs_diff"] == 0.5 and not got["y"]["matches"]
    assert all(r["matches"] for r in FT.skew_check(a, a, "customer_ID", ["x", "y"]).collect())


def test_wide_features_equal_the_aggregates(spark):
    """Gaps, one-statement and undated customers, a customer over many batches, narrow types."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        who = "big" if i % 3 == 0 else None if i % 50 == 1 else f"c{rng.integers(0, 120)}"
        value = lambda: None if rng.random() < 0.3 else float(rng.integers(0, 1000))
        date = None if rng.random() < 0.05 else datetime(2020, 1, 1) + timedelta(days=int(rng.integers(0, 90)))
        rows.append((who, date, i, value(), value(), int(rng.integers(0, 9)), None if rng.random() < 0.2 else str(rng.integers(0, 4))))
    rows.append(("empty", None, 2_000, None, float("nan"), None, None))
    df = spark.createDataFrame(rows, "customer_ID string, S_2 timestamp_ntz, seq long, w double, f float, k int, D_63 string")
    df = FT.missing_to_null(df.repartition(4))
    roles = Roles(tie="seq", day_grain=True, tie_bits=42, categoricals=("D_63",))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        wide = WF.wide_features(df, roles)
        got = wide.orderBy("customer_ID").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plain = FT.customer_features(df, roles)
    assert wide.dtypes == plain.dtypes
    want = plain.orderBy("customer_ID").collect()
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for name, x, y in zip(wide.columns, a, b, strict=True):
            assert x == y or (isinstance(x, float) and x == pytest.approx(y, rel=1e-6)), (a[0], name, x, y)
    some = ["D_63_last", "f_last", "statement_count", "w_std"]
    part = WF.wide_features(df, roles, some)
    assert part.columns == ["customer_ID", "w_std", "f_last", "D_63_last", "statement_count"]
    kept = [c for c in part.columns if c != "w_std"]
    assert part.select(kept).orderBy("customer_ID").collect() == plain.select(kept).orderBy("customer_ID").collect()
    assert WF.wide_features(df, roles, ["k_max"]).columns == ["customer_ID", "k_max"]
    assert WF.wide_features(df.limit(0), roles).collect() == []
    with pytest.raises(ValueError):
        WF.wide_features(df, Roles(tie="seq", categoricals=("D_63",)))


def test_interleaved_customers_leave_one_wide_state_each(spark, monkeypatch):
    """Many batches in one task, every customer in each of them."""
    roles = Roles(categoricals=())
    data = [(f"c{i % 10}", datetime(2018, 1, 1 + i // 20), float(i), None if i % 3 else i / 7) for i in range(400)]
    df = spark.createDataFrame(data, "customer_ID string, S_2 timestamp_ntz, P_2 double, B_1 double").withColumn("P_2", F.col("P_2") % 31).coalesce(1)
    made, states = [], WF.partial_states
    monkeypatch.setattr(WF, "partial_states", lambda *a: made.append(states(*a)) or made[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        wide = WF.wide_features(df, roles)
        assert made[0].count() == 10
        assert wide.select("customer_ID", "P_2_mean", "B_1_max", "statement_count").orderBy("customer_ID").collect() == FT.customer_features(df, roles).select(
            "customer_ID", "P_2_mean", "B_1_max", "statement_count").orderBy("customer_ID").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
