"""Metrics against straightforward NumPy versions."""

import numpy as np
import pandas as pd
import pytest

from ledgerline.operators import evaluation as EV
from ledgerline.operators import rank_metrics as R


def defined_metric(y, p):
    """From the definitions: good rows weigh 20, bad ones 1. Capture counts the bad rows met before
    4 % of all weight is used up; the Gini is an area under steps, as a share of the best one."""
    pairs = sorted(zip(p.tolist(), y.tolist()), key=lambda pair: -pair[0])
    bad = sum(t for _, t in pairs)
    total = bad + 20 * (len(pairs) - bad)

    def area(targets):
        seen = used = inside = 0
        for t in targets:
            weight = 1 if t else 20
            seen, used = seen + t, used + weight
            inside += weight * (seen * total - used * bad)
        return inside

    used = caught = 0
    for _, t in pairs:
        used += 1 if t else 20
        if 100 * used <= 4 * total:
            caught += t
    gini = area(t for _, t in pairs) / area([1] * bad + [0] * (len(pairs) - bad))
    return caught / bad, gini, (caught / bad + gini) / 2


def data(n=2_000, seed=11):
    """A skewed share of bad rows; scores without ties, since ties go by a hash of the key."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.13).astype(int)
    p = rng.beta(2 + 3 * y, 6, n)
    return y, p


def frame(spark, y, p):
    return spark.createDataFrame(
        pd.DataFrame({"customer_ID": [f"c{i}" for i in range(len(y))], "target": y.astype("int32"), "prediction": p})
    )


@pytest.mark.parametrize("rows_per_bucket", [100_000, 150])
def test_rank_metric(spark, rows_per_bucket):
    y, p = data()
    row = R.rank_metric(frame(spark, y, p), rows_per_bucket=rows_per_bucket).first()
    captured, gini, metric = defined_metric(y, p)
    assert row["capture"] == pytest.approx(captured, abs=1e-12)
    assert row["gini"] == pytest.approx(gini, abs=1e-9)
    assert row["metric"] == pytest.approx(metric, abs=1e-9)


def test_best_and_worst_order(spark):
    y = np.array([1] * 30 + [0] * 170)
    falling = np.linspace(0.9, 0.1, 200)
    assert R.rank_metric(frame(spark, y, falling)).first()["gini"] == pytest.approx(1.0, abs=1e-9)
    worst = falling[::-1].copy()
    assert R.rank_metric(frame(spark, y, worst)).first()["gini"] == pytest.approx(defined_metric(y, worst)[1], abs=1e-9)


def test_one_class_only_is_null(spark):
    y = np.zeros(50, int)
    row = R.rank_metric(frame(spark, y, np.linspace(0, 1, 50))).first()
    assert row["metric"] is None
    assert R.ks_statistic(frame(spark, y, np.linspace(0, 1, 50))).first()["ks"] is None
    assert R.auc_gini(frame(spark, y, np.linspace(0, 1, 50))).first()["auc"] is None


def test_empty_input(spark):
    y, p = data(10)
    empty = frame(spark, y, p).where("target > 5")
    assert R.rank_metric(empty).first()["metric"] is None


@pytest.mark.parametrize("rows_per_bucket", [100_000, 60])
def test_auc_and_ks_with_ties(spark, rows_per_bucket):
    y, p = data(700)
    p = np.round(p, 2)
    bad, good = p[y == 1], p[y == 0]
    wins = (bad[:, None] > good[None, :]).mean() + 0.5 * (bad[:, None] == good[None, :]).mean()
    df = frame(spark, y, p)
    assert R.auc_gini(df, rows_per_bucket=rows_per_bucket).first()["auc"] == pytest.approx(wins, abs=1e-12)
    ks = max(abs((bad <= x).mean() - (good <= x).mean()) for x in np.unique(p))
    assert R.ks_statistic(df, rows_per_bucket=rows_per_bucket).first()["ks"] == pytest.approx(ks, abs=1e-12)


def test_all_scores_tied(spark):
    y, _ = data(300)
    df = frame(spark, y, np.full(300, 0.5))
    assert R.auc_gini(df).first()["auc"] == pytest.approx(0.5)
    assert R.ks_statistic(df).first()["ks"] == pytest.approx(0.0)


def test_band_sizes_of_the_published_table():
    # 458,913 customers: 45,892 in bands 1, 6 and 10, otherwise 45,891
    n = 458_913
    r = np.arange(1, n + 1)
    bin_ = np.maximum(1, np.ceil((r - 1) * 10 / (n - 1))).astype(int)
    sizes = pd.Series(11 - bin_).value_counts().sort_index()
    assert [b for b, s in sizes.items() if s == 45_892] == [1, 6, 10]
    assert set(sizes) == {45_891, 45_892}


@pytest.mark.parametrize("rows_per_bucket", [100_000, 70])
def test_score_bands_equal_qcut(spark, rows_per_bucket):
    y, p = data(993)
    got = EV.score_bands(frame(spark, y, p), rows_per_bucket=rows_per_bucket).orderBy("band").toPandas()
    pdf = pd.DataFrame({"y": y, "p": p})
    pdf["band"] = pd.qcut(pdf.p.rank(method="first"), 10, labels=range(10, 0, -1)).astype(int)
    want = pdf.groupby("band").agg(n=("y", "size"), d=("y", "sum"), m=("p", "mean")).sort_index()
    assert got.customers.tolist() == want.n.tolist()
    assert got.defaults.tolist() == want.d.tolist()
    assert np.allclose(got.avg_pred, want.m) and got.cum_defaults.iloc[-1] == 1.0


def test_single_row_band(spark):
    rows = EV.score_bands(frame(spark, np.array([1]), np.array([0.3]))).collect()
    assert len(rows) == 1 and rows[0]["customers"] == 1


def test_approval_points(spark):
    y, p = data(501)
    df = frame(spark, y, p)
    got = {r["approved"]: r["bad_rate"] for r in EV.approval_points(EV.approval_curve(df)).collect()}
    ys = y[np.argsort(p)]
    for a in (0.5, 0.7, 0.9):
        i = int(a * 501)
        assert got[a] == pytest.approx(ys[:i].mean())


def test_reliability_bins(spark):
    y, p = data(400)
    got = EV.calibration_curve(frame(spark, y, p)).orderBy("bin").toPandas()
    edges = np.percentile(p, np.linspace(0, 1, 21) * 100)
    ids = np.searchsorted(edges[1:-1], p)
    want = pd.DataFrame({"i": ids, "y": y, "p": p}).groupby("i").agg(m=("p", "mean"), o=("y", "mean"))
    assert np.allclose(got.mean_pred, want.m) and np.allclose(got.observed_rate, want.o)
