"""Ordered prefix and exact quantiles against NumPy, with buckets and hot values forced."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.operators.ordered import _splits, exact_quantiles, ordered_prefix


def frame(spark, values, groups=None):
    rows = pd.DataFrame({"k": [f"c{i}" for i in range(len(values))], "v": values, "g": groups if groups is not None else 0})
    return spark.createDataFrame(rows)


def plain(df, descending=False):
    """The same by one plain sort."""
    import hashlib

    pdf = df.toPandas()
    pdf["h"] = [hashlib.md5(k.encode()).hexdigest() for k in pdf.k]
    pdf["o"] = pdf.v.fillna(-math.inf)
    pdf = pdf.sort_values(["g", "o", "h"], ascending=[True, not descending, True])
    pdf["rank"] = pdf.groupby("g").cumcount() + 1
    pdf["cum"] = pdf.groupby("g").cumcount() * 3 + 3
    return pdf.set_index("k").sort_index()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows_per_bucket", [10_000, 40, 7])
def test_prefix_matches_plain_sort(spark, descending, rows_per_bucket):
    rng = np.random.default_rng(5)
    values = rng.normal(size=600)
    values[:220] = 0.25          # one value holds more than a third of the rows
    values[220:260] = np.nan     # missing scores
    df = frame(spark, values, rng.integers(0, 3, 600))
    out = ordered_prefix(df, "v", "k", {"x": F.lit(3)}, ["g"], descending, rows_per_bucket)
    got = out.toPandas().set_index("k").sort_index()
    want = plain(df, descending)
    assert (got["rank"] == want["rank"]).all()
    assert (got["cum_x"] == want["cum"]).all()
    assert (got["n"] == want.groupby("g")["rank"].transform("max")).all()
    assert (got["tot_x"] == 3 * got["n"]).all()


def test_all_values_tied_are_cut_into_pieces(spark):
    df = frame(spark, np.full(500, 0.5))
    out = ordered_prefix(df, "v", "k", rows_per_bucket=50)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 501))
    plan = ordered_prefix(df, "v", "k", rows_per_bucket=50)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan


def test_splits_isolate_a_frequent_value():
    splits, pieces = _splits([0.1, 0.5, 0.5, 0.5, 0.9])
    assert splits[0] == -math.inf and splits[-1] == math.inf
    assert splits == sorted(set(splits)) and len(pieces) == len(splits) - 1
    at = splits.index(0.5)
    assert pieces[at] == 3 and splits[at + 1] == math.nextafter(0.5, math.inf)


def test_empty_input(spark):
    df = frame(spark, np.array([1.0])).where("v > 2")
    assert ordered_prefix(df, "v", "k").count() == 0
    assert exact_quantiles(df, "v", [0.5]).count() == 0


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(1)
    probs = np.linspace(0, 1, 11)
    a, b = rng.exponential(size=3_000), np.round(rng.normal(size=2_001), 1)
    b[:900] = 0.0
    df = spark.createDataFrame(
        pd.DataFrame({"g": ["a"] * len(a) + ["b"] * len(b) + ["c"], "v": np.concatenate([a, b, [7.0]])})
    )
    got = {r["g"]: r for r in exact_quantiles(df, "v", probs.tolist(), ["g"], accuracy).collect()}
    assert got["a"]["q"] == np.quantile(a, probs).tolist()
    assert got["b"]["q"] == np.quantile(b, probs).tolist()
    assert got["c"]["q"] == [7.0] * 11 and got["c"]["n"] == 1


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = exact_quantiles(df, "v", [0.5]).first()
    assert row["n"] == 2 and row["q"] == [2.0]
