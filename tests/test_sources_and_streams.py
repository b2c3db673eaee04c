from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import drift as D
from ledgerline.operators import evaluation as EV
from ledgerline.operators import features as FT
from ledgerline.operators.contributions import LinearScore
from ledgerline.plans import scoring as SC
from ledgerline.roles import Roles
from ledgerline.session import materialize, scratch_dir
from ledgerline.sources import ingest as I
from ledgerline.sources import statement_json as SJ
from ledgerline.streaming import customer_state as CS
from ledgerline.streaming import scoring_stream as ST

ROLES = Roles(categoricals=("D_63",))
MODEL = SC.ScoringModel(LinearScore({"P_2_last": -4.0}, {"P_2_last": 0.5}))


def rows(spark):
    data = [(f"c{i % 9}", datetime(2018, 1 + i // 9, 3), i / 40, ["CL", None, "CO"][i % 3]) for i in range(36)]
    return spark.createDataFrame(data, "customer_ID string, S_2 timestamp_ntz, P_2 double, D_63 string")


def test_csv_to_parquet(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        "customer_ID,S_2,P_2,D_63,D_39\na,2017-03-09,0.5,CL,\nb,2017-04-01,NaN,,3\n"
    )
    I.csv_to_parquet(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("customer_ID")
    assert out.dtypes == [("customer_ID", "string"), ("S_2", "timestamp_ntz"), ("P_2", "float"), ("D_63", "string"), ("D_39", "float")]
    a, b = out.collect()
    assert a["S_2"] == datetime(2017, 3, 9) and a["D_39"] is None and b["P_2"] is None and b["D_63"] is None
    assert any(f.name.endswith(".snappy.parquet") for f in (tmp_path / "out").iterdir())


def test_malformed_csv_fails(spark, tmp_path):
    (tmp_path / "in.csv").write_text("customer_ID,S_2,P_2\na,2017-03-09,many\n")
    with pytest.raises(Exception):
        I.read_csv(spark, str(tmp_path / "in.csv")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "customer_ID string, prediction double")
    I.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns
    I.write_json(df, str(tmp_path / "json"))
    back = I.read_json(spark, str(tmp_path / "json"), df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    report = spark.createDataFrame([("ks", 0.5), ("auc", 0.9)], "metric string, value double")
    assert I.report_lines(report).splitlines()[2] == "| auc | 0.90000 |"


def test_json_statements(spark, tmp_path):
    body = '[{"customer_ID":"a","S_2":"2018-01-31","P_2":0.55,"unknown":1},{"customer_ID":"a","S_2":"2018-02-28"}]'
    df = spark.createDataFrame([(body,)], "body string")
    got = SJ.parse_statements(df, "body", ["P_2", "B_1"]).orderBy("S_2").collect()
    assert [r["S_2"] for r in got] == [datetime(2018, 1, 31), datetime(2018, 2, 28)]
    assert got[0]["P_2"] == pytest.approx(0.55) and got[1]["P_2"] is None and got[0]["B_1"] is None
    (tmp_path / "x.json").write_text('{"customer_ID":"a","S_2":"2018-01-31","P_2":1}\n')
    assert SJ.read_statements(spark, str(tmp_path / "x.json"), ["P_2"]).count() == 1


@pytest.mark.parametrize("body", ['[{"S_2":"2018-01-31"}]', '[{"customer_ID":"a","S_2":"soon"}]'])
def test_json_statement_without_required_fields_fails(spark, body):
    df = spark.createDataFrame([(body,)], "body string")
    with pytest.raises(Exception, match="statement without a valid"):
        SJ.parse_statements(df, "body", ["P_2"]).collect()


def test_materialize_uses_the_shared_folder(spark):
    df = materialize(spark.range(5), "numbers")
    assert df.count() == 5 and scratch_dir(spark) in df.inputFiles()[0]


def test_stream_equals_batch_and_replays_cleanly(spark, tmp_path):
    source = rows(spark)
    src = tmp_path / "src"
    # a customer's statements arrive together
    for i in range(3):
        source.where(F.pmod(F.xxhash64("customer_ID"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    score = lambda b: SC.score_portfolio(b, ROLES, MODEL)
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    last = ST.finish(ST.score_stream(stream, score, log, check))
    assert last == 2
    logged = spark.read.parquet(log)
    want = score(source)
    assert sorted(logged.select(*want.columns).collect()) == sorted(want.collect())
    assert "scored_at" in logged.columns
    ST.finish(ST.score_stream(stream, score, log, check))  # nothing new
    assert spark.read.parquet(log).count() == want.count()


def test_closed_windows_only(spark, tmp_path):
    scored = spark.createDataFrame(
        [(0.04, datetime(2024, 1, 1, 0, 5)), (0.6, datetime(2024, 1, 1, 0, 50)), (0.9, datetime(2024, 1, 1, 1, 10)),
         (0.2, datetime(2024, 1, 1, 9, 0))],
        "pd double, at timestamp_ntz",
    )
    scored.coalesce(1).write.parquet(str(tmp_path / "src"))
    stream = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "src"))
    ST.finish(ST.append_counters(ST.pd_counters(stream, "pd", "at"), str(tmp_path / "out"), str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["scored"], r["le_0_05"], r["le_0_7"], r["le_1_0"]) for r in got] == [
        (0, 2, 1, 2, 2), (1, 1, 0, 0, 1)]


def test_train_and_serve_agree(spark):
    """Features of a few customers alone equal those of the whole table."""
    source = rows(spark)
    some = source.where("customer_ID IN ('c1', 'c2')")
    a = FT.customer_features(source, ROLES).where("customer_ID IN ('c1', 'c2')")
    b = FT.customer_features(some, ROLES)
    names = [c for c in a.columns if c not in ("customer_ID", "D_63_last")]
    assert all(r["matches"] for r in FT.skew_check(a, b, "customer_ID", names).collect())


def test_state_carries_customers_over_batches(spark, tmp_path):
    """Three batches in an order that is not that of the dates; customers lie in all of them."""
    roles = Roles(categoricals=())
    source = rows(spark).drop("D_63").withColumn("B_1", F.when(F.col("P_2") > 0.5, F.col("P_2") * 3))
    source = source.unionByName(spark.createDataFrame([(None, datetime(2018, 2, 1), 0.1, 0.2), ("c0", None, 0.7, None)], source.schema))
    src = tmp_path / "src"
    for i in (2, 0, 1):
        source.where(F.coalesce(F.month("S_2") % 3, F.lit(1)) == i).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    features = CS.running_features(stream, roles)
    last = ST.finish(ST.score_stream(features, lambda f: f, log, check, output_mode="update"))
    assert last == 2
    got = CS.latest_rows(spark.read.parquet(log).drop("scored_at"), "customer_ID").toPandas().sort_values("customer_ID", ignore_index=True)
    want = FT.customer_features(source, roles).toPandas().sort_values("customer_ID", ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=False, rtol=1e-12)
    ST.finish(ST.score_stream(features, lambda f: f, log, check, output_mode="update"))  # nothing new
    assert spark.read.parquet(log).select("batch").distinct().count() == 3


def test_drift_counters_equal_the_batch_result_and_late_rows_are_counted(spark, tmp_path):
    def scores(day, values):
        return [(v, datetime(2024, 1, day, 5)) for v in values]

    schema = "pd double, at timestamp_ntz"
    reference = spark.createDataFrame(scores(1, [i / 50 for i in range(50)]), schema)
    # a batch's late rows are judged by the watermark the batch before it worked with
    batches = [scores(2, [i / 100 for i in range(50)]) + scores(3, [None, 0.5]), scores(9, [0.9]), scores(9, [0.8])]
    later = spark.createDataFrame(sum(batches, []), schema)
    for part in (*batches, scores(2, [0.99]) + scores(10, [0.2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    edges, base = D.reference_bins(reference, "pd")
    assert sum(base) == 50 and len(edges) == 9
    stream = spark.readStream.schema(reference.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src"))
    counters = ST.drift_counters(stream, "pd", "at", edges)
    query = ST.append_counters(counters, str(tmp_path / "out"), str(tmp_path / "check"))
    ST.finish(query)
    assert ST.late_rows(query) == 1
    got = {r[0].day: r[1] for r in D.psi_of_counters(spark.read.parquet(str(tmp_path / "out")), "window_start", base).collect()}
    want = D.windowed_psi(reference, later.withColumn("day", F.dayofmonth("at")), "pd", "day")
    # the windows that the watermark has closed
    assert got == pytest.approx({r[0]: r[1] for r in want.collect() if r[0] in (2, 3, 9)})
    assert D.reference_bins(reference.limit(0), "pd") is None


def test_splits_are_converted_train_first(spark, tmp_path):
    for name, head in (("train", "customer_ID,S_2,P_2"), ("test", "customer_ID,S_2,P_2"), ("odd", "customer_ID,P_2,S_2")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\na,2017-03-09,0.5\n")
    paths = {n: (str(tmp_path / f"{n}.csv"), str(tmp_path / n)) for n in ("test", "train", "odd")}
    with pytest.raises(ValueError, match="odd"):
        I.convert_splits(spark, paths)
    assert not (tmp_path / "train").exists()
    with pytest.raises(ValueError, match="train"):
        I.convert_splits(spark, {"test": paths["test"]})
    I.convert_splits(spark, {n: paths[n] for n in ("test", "train")})
    done = [(tmp_path / n / "_SUCCESS").stat().st_mtime_ns for n in ("train", "test")]
    assert done[0] < done[1] and spark.read.parquet(paths["test"][1]).count() == 1


def test_skew_check_sees_moved_columns(spark):
    left = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "k string, x double, y double, z double")
    got = {r["feature"]: (r["same_place"], r["matches"]) for r in FT.skew_check(left, left.select("k", "y", "x", "z"), "k", ["x", "y", "z"]).collect()}
    assert got == {"x": (False, False), "y": (False, False), "z": (True, True)}


def test_full_report_has_every_section(spark):
    df = spark.createDataFrame([(f"c{i}", int(i % 7 in (0, i % 3)), i / 60, i * i / 3600) for i in range(60)], "customer_ID string, target int, prediction double, calibrated double")
    report = EV.full_report(df)
    sizes = {r["section"]: r["n"] for r in report.groupBy("section").agg(F.count_distinct("item").alias("n")).collect()}
    assert sizes == {"headline": 0, "bands": 10, "raw_curve": 20, "calibrated_curve": 20, "approval": 3}
    text = I.report_document(report)
    assert text.count("## ") == 5 and "| 0.7 | " in text and "| 10 | " in text
    assert EV.full_report(df.limit(0)).where("section IN ('bands', 'approval')").count() == 0


def test_running_state_needs_no_python_per_customer(spark, tmp_path):
    """The state is one of Spark's aggregations; missing values and values that tie in everything but order stay right."""
    roles = Roles(tie="seq", day_grain=True, tie_bits=42, categoricals=())
    day = datetime(2018, 3, 1)
    data = [("a", day, 2, float("nan")), ("a", day, 1, 0.25), ("a", datetime(2018, 2, 1), 9, None), ("b", day, 3, None), (None, day, 4, 1.0)]
    source = spark.createDataFrame(data, "customer_ID string, S_2 timestamp_ntz, seq long, P_2 double")
    src = str(tmp_path / "src")
    source.coalesce(1).write.parquet(src)
    features = CS.running_features(spark.readStream.schema(source.schema).parquet(src), roles)
    plan = features._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Aggregate" in plan
    ST.finish(ST.score_stream(features, lambda f: f, str(tmp_path / "log"), str(tmp_path / "check"), output_mode="update"))
    got = {r["customer_ID"]: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert set(got) == {"a", "b"} and got["b"]["P_2_mean"] is None and got["b"]["statement_count"] == 1
    assert (got["a"]["P_2_mean"], got["a"]["P_2_last"], got["a"]["P_2_std"], got["a"]["statement_count"], got["a"]["history_days"]) == (0.25, 0.25, None, 3, 28)
