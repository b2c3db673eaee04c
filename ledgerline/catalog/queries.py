"""Queries over the given tables: one entry per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.catalog import views as V
from ledgerline.functions import scores as S
from ledgerline.functions.calibrate import calibrate
from ledgerline.functions.describe import describe_feature
from ledgerline.operators import contributions as C
from ledgerline.operators import drift as D
from ledgerline.operators import encode as E
from ledgerline.operators import evaluation as EV
from ledgerline.operators import features as FT
from ledgerline.operators import folds as FO
from ledgerline.operators import joins as J
from ledgerline.operators import presets as P
from ledgerline.operators import profile as PR
from ledgerline.operators import rank_metrics as R
from ledgerline.operators import sequences as SQ
from ledgerline.operators import wide_features as WF
from ledgerline.plans import blending as B
from ledgerline.plans import scoring as SC
from ledgerline.session import materialize
from ledgerline.sources import ingest
from ledgerline.sources import statement_json as SJ

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROLES = V.ROLES
KEY = ROLES.key
NUMERIC, CATEGORICAL = V.NUMERIC, V.CATEGORICAL
FEATURES = FT.feature_names(NUMERIC, CATEGORICAL)
# columns of the sequences; the text columns among them are coded
TEXTS = ["D_63", "D_64"]
SEQ_COLUMNS = [*NUMERIC, *CATEGORICAL]

# A fixed-coefficient logistic score and a calibration curve for the checks.
COEFFICIENTS = {
    "P_2_last": -4.1357913e-6, "D_39_max": 0.0613579135, "B_1_last": 0.0041357913, "S_3_range": 2.1371933e-6,
    "R_1_min": -0.1513579137, "statement_count": 0.0513579131, "history_days": -3.1357913e-4,
}
MEANS = {
    "P_2_last": 250000.0, "D_39_max": 35.0, "B_1_last": 100.0, "S_3_range": 300000.0,
    "R_1_min": 2.0, "statement_count": 10.0, "history_days": 2000.0,
}
LOGIT = C.LinearScore(COEFFICIENTS, MEANS, -0.4)
KNOTS_X = [0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95]
KNOTS_Y = [0.01, 0.08, 0.2, 0.45, 0.7, 0.9, 0.99]
MODEL = SC.ScoringModel(LOGIT, (KNOTS_X, KNOTS_Y))
SCENARIOS = {"as_is": {}, "low_payment": {"P_2": 1000.0}, "late": {"D_39": 90.0, "B_1": 250.0}}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _features(statements: DataFrame) -> DataFrame:
    """Features with deviations rounded, since engines differ in their last digits."""
    wide = FT.customer_features(statements, ROLES)
    return wide.withColumns({f"{c}_std": F.round(f"{c}_std", 4) for c in NUMERIC})


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as a stored table, the way a model run leaves them."""
    return materialize(V.predictions(spark, sf_dir), "predictions")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.score_portfolio(V.statements(spark, sf_dir), ROLES, MODEL)


# --- scans, sources, sinks -----------------------------------------------------------


@query
def ingest_cast(spark, sf_dir):
    """Statements written as CSV, then read back with the schema built from the header."""
    source = V.statements(spark, sf_dir).drop("seq")
    return ingest.roundtrip_csv(source, ROLES)


@query
def sample_head(spark, sf_dir):
    return PR.sample_head(V.statements(spark, sf_dir), 500, [KEY, "S_2", "seq"])


@query
def semi_key_filter(spark, sf_dir):
    return J.keep_keys(V.statements(spark, sf_dir), V.stmt_labels(spark, sf_dir)).select(KEY, "S_2", "seq", "P_2")


@query
def anti_key_filter(spark, sf_dir):
    return J.drop_keys(V.statements(spark, sf_dir), V.stmt_labels(spark, sf_dir)).select(KEY, "S_2", "seq", "P_2")


@query
def json_statements(spark, sf_dir):
    return SJ.parse_events(V.table(spark, sf_dir, "events"))


@query
def clean_nonfinite(spark, sf_dir):
    """Ratios that divide by zero, cleaned, alone and inside an array."""
    o = V.statements(spark, sf_dir)
    ratio = F.when(F.col("D_39") == 0, F.lit(float("inf"))).otherwise(F.col("B_1") / F.nullif("D_39", F.lit(0.0)))
    raw = o.select("seq", ratio.alias("ratio"), F.array(ratio, F.lit(float("nan")), F.col("B_1")).alias("cells"))
    out = S.clean_nonfinite(raw)
    return out.select("seq", "ratio", *[F.col("cells")[i].alias(f"cell_{i}") for i in range(3)])


@query
def risk_report(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return EV.risk_report(p, "target", "p_a", "p_c").select("metric", F.round("value", 8).alias("value"))


@query
def full_report(spark, sf_dir):
    """Headline metrics, bands, curves before and after calibration, and approval points."""
    out = EV.full_report(_predictions(spark, sf_dir), "target", "p_a", "p_c")
    return out.select("section", "item", "metric", F.round("value", 8).alias("value"))


# --- projections -----------------------------------------------------------------------


@query
def feature_groups(spark, sf_dir):
    return PR.feature_groups(spark, ROLES.feature_columns(V.statements(spark, sf_dir)))


@query
def align_columns(spark, sf_dir):
    f = FT.numeric_aggregates(V.statements(spark, sf_dir), ROLES, ["P_2"])
    names = ["P_2_last", "Z_9_mean", "P_2_min"]
    return FT.align_columns(f, names, KEY, {"Z_9_mean": "double"})


@query
def portfolio_stats(spark, sf_dir):
    stats = S.portfolio_stats(_scored(spark, sf_dir))
    return stats.select("customers", "share_high_risk", F.round("mean_pd", 8).alias("mean_pd"))


@query
def risk_bands(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    return p.select(KEY, "p_a", S.risk_band(F.col("p_a")).alias("risk_band"))


@query
def psi_status(spark, sf_dir):
    """Shares over all features; the verdict also takes the drift of the scores."""
    p = _predictions(spark, sf_dir)
    score_psi = D.psi_score(p.select("p_a"), p.select(F.col("p_c").alias("p_a")), "p_a").first()["score_psi"]
    return D.status_shares(_psi_table(spark, sf_dir), score_psi)


@query
def missing_buckets(spark, sf_dir):
    s = V.statements(spark, sf_dir)
    return PR.missing_buckets(PR.missing_rates(s, ROLES.feature_columns(s)))


@query
def recover_component(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    blend = S.linear_blend([(0.86, F.col("p_a")), (1 - 0.86, F.col("p_b"))])
    out = p.withColumn("blend", blend)
    back = S.recover_component(F.col("blend"), F.col("p_a"))
    return out.select(KEY, F.round("blend", 12).alias("blend"), F.round(back, 9).alias("p_b"))


@query
def blend_apply(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    parts = [(0.60, F.col("p_a")), (0.08, F.col("p_b")), (0.32, F.col("p_c"))]
    return p.select(KEY, S.linear_blend(parts).alias("prediction"))


@query
def describe_features(spark, sf_dir):
    """Names of the long contribution table, described."""
    f = FT.customer_features(V.statements(spark, sf_dir), ROLES)
    rates = PR.missing_rates(f, FEATURES)
    return rates.select("feature", describe_feature(F.col("feature")).alias("description"), "missing_rate")


# --- joins -----------------------------------------------------------------------------


@query
def features_labels(spark, sf_dir):
    f = FT.numeric_aggregates(V.statements(spark, sf_dir), ROLES, ["P_2", "B_1"])
    return J.with_labels(f, V.stmt_labels(spark, sf_dir)).select(KEY, "target", "P_2_last", "B_1_max", "P_2_mean")


@query
def last_value_by_target(spark, sf_dir):
    return PR.last_value_by_target(V.statements(spark, sf_dir), V.stmt_labels(spark, sf_dir), ROLES, "P_2")


def _oof_tables(spark, sf_dir, names=("p_a", "p_b", "p_c")):
    p = _predictions(spark, sf_dir)
    return {n: p.select(KEY, "target", F.col(n).alias("oof_pred")) for n in names}


@query
def oof_align(spark, sf_dir):
    tables = _oof_tables(spark, sf_dir)
    return J.check_aligned(J.align_predictions(tables), list(tables))


@query
def oof_duplicates(spark, sf_dir):
    """Every key of one model whose score is high comes twice."""
    p = _predictions(spark, sf_dir)
    one = p.select(KEY, "target", F.col("p_a").alias("oof_pred"))
    tables = {"a": one, "b": one.unionByName(one.where("oof_pred > 0.9"))}
    return J.misaligned(J.align_predictions(tables), ["a", "b"])


@query
def oof_misaligned(spark, sf_dir):
    """Two tables that do not match: one lacks some customers, some labels are flipped."""
    tables = _oof_tables(spark, sf_dir, ("p_a", "p_b"))
    tables["p_b"] = tables["p_b"].where(F.col("oof_pred") >= 0.05).withColumn(
        "target", F.when(F.col("oof_pred") > 0.95, 1 - F.col("target")).otherwise(F.col("target"))
    )
    return J.misaligned(J.align_predictions(tables), list(tables))


@query
def label_lookup(spark, sf_dir):
    p = V.predictions(spark, sf_dir).select(KEY, "p_a")
    return J.labels_for_all(p, V.stmt_labels(spark, sf_dir))


@query
def encode_last(spark, sf_dir):
    """Dictionary fitted on the training period, applied to the later one."""
    train = FT.categorical_aggregates(V.train_statements(spark, sf_dir), ROLES)
    test = FT.categorical_aggregates(V.test_statements(spark, sf_dir), ROLES)
    dictionary = materialize(E.fit_last_dictionary(train, CATEGORICAL), "dictionary")
    return E.encode_last(test, dictionary, CATEGORICAL)


@query
def encode_integer_codes(spark, sf_dir):
    """A category stored as a float when the dictionary was fitted, as an integer later."""
    dictionary = materialize(E.fit_dictionary(V.train_statements(spark, sf_dir), ["B_30"]), "dictionary")
    later = V.test_statements(spark, sf_dir).select("seq", F.col("B_30").cast("int").alias("B_30"))
    return E.apply_dictionary(later, dictionary, ["B_30"])


@query
def customer_features(spark, sf_dir):
    return _features(V.statements(spark, sf_dir))


@query
def calibrate_interp(spark, sf_dir):
    p = V.predictions(spark, sf_dir).select(KEY, "p_a")
    out = calibrate(p, "p_a", KNOTS_X, KNOTS_Y, "pd")
    return out.select(KEY, "p_a", F.round("pd", 10).alias("pd"))


@query
def nearest_score(spark, sf_dir):
    """Nearest customer to each target, each target on its own."""
    near = P.nearest_candidates(V.predictions(spark, sf_dir), KEY, "p_a", P.PRESETS, 1)
    return near.select("label", "wanted", KEY, "p_a")


@query
def preset_customers(spark, sf_dir):
    """Presets without replacement, and how many statements each of them brings."""
    picked = P.pick_presets(_predictions(spark, sf_dir), KEY, "p_a")
    theirs = J.keep_keys(V.statements(spark, sf_dir), picked).groupBy(KEY).agg(F.count(F.lit(1)).alias("statements"))
    return picked.join(theirs, KEY)


# --- aggregations ------------------------------------------------------------------------


@query
def numeric_aggs(spark, sf_dir):
    out = FT.numeric_aggregates(V.statements(spark, sf_dir), ROLES, NUMERIC)
    return out.withColumns({f"{c}_std": F.round(f"{c}_std", 4) for c in NUMERIC})


@query
def trend_features(spark, sf_dir):
    out = FT.add_trends(FT.numeric_aggregates(V.statements(spark, sf_dir), ROLES, NUMERIC), NUMERIC)
    return out.select(KEY, *[f"{c}_{s}" for c in NUMERIC for s in FT.TREND_STATS])


@query
def categorical_aggs(spark, sf_dir):
    return FT.categorical_aggregates(V.statements(spark, sf_dir), ROLES, CATEGORICAL)


@query
def date_features(spark, sf_dir):
    return FT.date_features(V.statements(spark, sf_dir), ROLES)


@query
def fit_category_map(spark, sf_dir):
    train = FT.categorical_aggregates(V.train_statements(spark, sf_dir), ROLES)
    return E.fit_last_dictionary(train, CATEGORICAL)


@query
def fit_seq_map(spark, sf_dir):
    return E.fit_dictionary(V.train_statements(spark, sf_dir), TEXTS)


def _coded(spark, sf_dir):
    """Train and all statements with codes of the training period in place of texts."""
    dictionary = materialize(fit_seq_map(spark, sf_dir), "dictionary")
    return [E.apply_dictionary(s(spark, sf_dir), dictionary, TEXTS) for s in (V.train_statements, V.statements)]


@query
def norm_stats(spark, sf_dir):
    out = SQ.norm_stats(_coded(spark, sf_dir)[0], SEQ_COLUMNS)
    return out.select("feature", "mean", F.round("std", 4).alias("std"))


@query
def customer_dates(spark, sf_dir):
    return PR.customer_dates(V.statements(spark, sf_dir), ROLES)


@query
def last_month_hist(spark, sf_dir):
    return PR.month_histogram(PR.customer_dates(V.statements(spark, sf_dir), ROLES))


@query
def statements_per_customer(spark, sf_dir):
    return PR.statements_per_customer(V.statements(spark, sf_dir), KEY)


@query
def statements_describe(spark, sf_dir):
    sizes = V.statements(spark, sf_dir).groupBy(KEY).agg(F.count(F.lit(1)).alias("statements"))
    out = PR.describe(sizes, "statements")
    return out.withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query
def profile_categoricals(spark, sf_dir):
    return PR.profile_categoricals(V.statements(spark, sf_dir), CATEGORICAL)


@query
def profile_table(spark, sf_dir):
    return PR.profile_table(V.statements(spark, sf_dir), ROLES)


@query
def dtype_counts(spark, sf_dir):
    s = V.statements(spark, sf_dir)
    return PR.dtype_counts(s, ROLES.feature_columns(s))


@query
def missing_rates(spark, sf_dir):
    s = V.statements(spark, sf_dir)
    return PR.missing_rates(s, ROLES.feature_columns(s))


@query
def target_distribution(spark, sf_dir):
    return PR.target_distribution(V.stmt_labels(spark, sf_dir))


@query
def density_hist(spark, sf_dir):
    last = PR.last_value_by_target(V.statements(spark, sf_dir), V.stmt_labels(spark, sf_dir), ROLES, "P_2")
    out = PR.density_histogram(last, "P_2_last", "target")
    return out.select(
        "target", "bin", F.round("left_edge", 3).alias("left_edge"), "rows", F.round("density", 12).alias("density")
    )


@query
def score_bands(spark, sf_dir):
    out = EV.score_bands(_predictions(spark, sf_dir), score="p_a")
    return out.withColumn("avg_pred", F.round("avg_pred", 8))


@query
def calibration_curve(spark, sf_dir):
    out = EV.calibration_curve(_predictions(spark, sf_dir), score="p_b")
    return out.withColumn("mean_pred", F.round("mean_pred", 8))


@query
def brier(spark, sf_dir):
    out = EV.brier(V.predictions(spark, sf_dir), "target", ["p_a", "p_c"])
    verdict = EV.calibration_verdict(F.col("brier_p_a"), F.col("brier_p_c"))
    return out.select(
        F.round("brier_p_a", 9).alias("brier_p_a"), F.round("brier_p_c", 9).alias("brier_p_c"), verdict.alias("verdict")
    )


@query
def auc_gini(spark, sf_dir):
    out = R.auc_gini(_predictions(spark, sf_dir), score="p_b")
    return out.select(F.round("auc", 9).alias("auc"), F.round("gini", 9).alias("gini"))


@query
def psi_feature(spark, sf_dir):
    """One raw column between the two periods."""
    a = D.stack_values(V.train_statements(spark, sf_dir), ["P_2"])
    b = D.stack_values(V.test_statements(spark, sf_dir), ["P_2"])
    return D.psi(a, b, ["feature"]).select("feature", F.round("psi", 9).alias("psi"))


def _psi_table(spark, sf_dir):
    """All features; categories as codes fitted on the training period."""
    train = materialize(_features(V.train_statements(spark, sf_dir)), "train")
    dictionary = materialize(E.fit_last_dictionary(train, CATEGORICAL), "dictionary")
    test = _features(V.test_statements(spark, sf_dir))
    coded = [materialize(E.encode_last(f, dictionary, CATEGORICAL), "coded") for f in (train, test)]
    return D.psi_features(*coded, FEATURES)


@query
def psi_all(spark, sf_dir):
    return _psi_table(spark, sf_dir).select("feature", F.round("psi", 8).alias("psi"))


@query
def psi_score(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    a, c = (p.select(F.col(n).alias("s")) for n in ("p_a", "p_c"))
    return D.psi_score(a, c, "s").select(F.round("score_psi", 9).alias("score_psi"))


def _long_predictions(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return p.unpivot([KEY, "target"], ["p_a", "p_b", "p_c"], "model", "prediction")


@query
def fold_summary(spark, sf_dir):
    """Rank metric per fold, its mean and population deviation, and the overall metric."""
    p = materialize(FO.stratified_folds(_predictions(spark, sf_dir)), "folds")
    folds = R.rank_metric(p, score="p_a", by=["fold"])
    whole = R.rank_metric(p, score="p_a").first()["metric"]
    return folds.agg(
        F.count(F.lit(1)).alias("folds"),
        F.round(F.avg("metric"), 8).alias("mean_metric"),
        F.round(F.stddev_pop("metric"), 8).alias("std_metric"),
        F.round(F.lit(whole), 8).alias("oof_metric"),
    )


@query
def ensemble_mean(spark, sf_dir):
    p = V.predictions(spark, sf_dir)
    mean = S.ensemble_mean([F.col("p_a"), F.col("p_b"), F.col("p_c")])
    return p.select(KEY, F.round(mean, 12).alias("prediction"))


@query
def ensemble_mean_long(spark, sf_dir):
    """The same from a long table of fold predictions."""
    long = _long_predictions(spark, sf_dir)
    return long.groupBy(KEY).agg(F.round(F.avg("prediction"), 12).alias("prediction"))


@query
def global_drivers(spark, sf_dir):
    f = FT.customer_features(V.statements(spark, sf_dir), ROLES)
    out = C.global_drivers(f, LOGIT.contributions(), 5)
    return out.select("feature", F.round("mean_abs", 8).alias("mean_abs"))


@query
def pd_histogram(spark, sf_dir):
    out = V.predictions(spark, sf_dir).agg(*S.pd_histogram(F.col("p_a")))
    return out.withColumn("pd_sum", F.round("pd_sum", 5))


@query
def prediction_stats(spark, sf_dir):
    out = S.prediction_stats(V.predictions(spark, sf_dir), "p_a")
    return out.withColumn("mean", F.round("mean", 8))


# --- ordered ---------------------------------------------------------------------------


@query
def capture_at_4pct(spark, sf_dir):
    return R.rank_metric(_predictions(spark, sf_dir), score="p_a").select("capture")


@query
def weighted_gini(spark, sf_dir):
    return R.rank_metric(_predictions(spark, sf_dir), score="p_b").select(F.round("gini", 9).alias("gini"))


@query
def rank_metric(spark, sf_dir):
    out = R.rank_metric(_long_predictions(spark, sf_dir), by=["model"])
    return out.select(
        "model", "capture", F.round("gini", 9).alias("gini"), F.round("metric", 9).alias("metric")
    )


@query
def ks_statistic(spark, sf_dir):
    return R.ks_statistic(_predictions(spark, sf_dir), score="p_b").select(F.round("ks", 9).alias("ks"))


@query
def approval_curve(spark, sf_dir):
    return EV.approval_curve(_predictions(spark, sf_dir), score="p_a")


@query
def approval_points(spark, sf_dir):
    return EV.approval_points(EV.approval_curve(_predictions(spark, sf_dir), score="p_b"))


@query
def quantile_bins(spark, sf_dir):
    out = EV.quantile_bins(_predictions(spark, sf_dir).select(KEY, "p_b"), "p_b", KEY)
    return out.select(KEY, "p_b", "rank", "bin")


@query
def sequence_positions(spark, sf_dir):
    out = SQ.sequence_positions(V.statements(spark, sf_dir), ROLES)
    return out.select(KEY, "seq", "S_2", "pos", "length")


@query
def reason_codes(spark, sf_dir):
    """Top positive reasons, one row each."""
    f = FT.customer_features(V.statements(spark, sf_dir), ROLES)
    reasons = C.reason_codes(LOGIT.contributions())
    each = f.select(KEY, F.posexplode(reasons).alias("at", "reason"))
    return each.select(
        KEY, (F.col("at") + 1).alias("position"), "reason.feature", "reason.description",
        F.round("reason.contribution", 4).alias("contribution"),
    )


@query
def what_if_rows(spark, sf_dir):
    out = FT.override_latest(V.statements(spark, sf_dir), ROLES, {"P_2": 1000.0, "D_39": 90.0})
    return out.select(KEY, "S_2", "seq", "P_2", "D_39")


@query
def stratified_folds(spark, sf_dir):
    return FO.stratified_folds(V.stmt_labels(spark, sf_dir))


@query
def stratified_holdout(spark, sf_dir):
    return FO.stratified_holdout(V.stmt_labels(spark, sf_dir))


@query
def half_split(spark, sf_dir):
    return FO.random_halves(V.stmt_labels(spark, sf_dir))


# --- sorts, samples, sets ---------------------------------------------------------------


@query
def top_missing(spark, sf_dir):
    s = V.statements(spark, sf_dir)
    return PR.top_missing(PR.missing_rates(s, ROLES.feature_columns(s)), 5)


@query
def mostly_missing(spark, sf_dir):
    f = FT.customer_features(V.train_statements(spark, sf_dir), ROLES)
    return PR.mostly_missing(PR.missing_rates(f, FEATURES), 0.1)


@query
def top_drift(spark, sf_dir):
    return D.top_drift(_psi_table(spark, sf_dir), 10).select("feature", F.round("psi", 8).alias("psi"))


@query
def riskiest_customers(spark, sf_dir):
    f = FT.customer_features(V.statements(spark, sf_dir), ROLES)
    out = C.riskiest_customers(f, LOGIT.logit(), KEY, 20)
    return out.select(KEY, F.round("logit", 8).alias("logit"))


@query
def riskiest_reasons(spark, sf_dir):
    """What drives the three riskiest customers."""
    f = FT.customer_features(V.statements(spark, sf_dir), ROLES)
    return C.riskiest_reasons(f, LOGIT.logit(), LOGIT.contributions(), KEY)


@query
def score_histogram(spark, sf_dir):
    """Score densities of two prediction sets, each over its own range."""
    long = _long_predictions(spark, sf_dir)
    out = PR.density_histogram(long, "prediction", "model")
    return out.select("model", "bin", "rows", F.round("density", 6).alias("density"))


@query
def seeded_sample(spark, sf_dir):
    return PR.seeded_sample(V.stmt_labels(spark, sf_dir), 100, KEY)


@query
def oof_union(spark, sf_dir):
    """Per-fold outputs put back together: each fold scored by its own column."""
    p = materialize(FO.stratified_folds(_predictions(spark, sf_dir)), "folds")
    names = ["p_a", "p_b", "p_c", "p_a", "p_b"]
    out = None
    for i, n in enumerate(names):
        part = p.where(F.col("fold") == i).select(KEY, "target", "fold", F.col(n).alias("oof_pred"))
        out = part if out is None else out.unionByName(part)
    return out


# --- scalars -----------------------------------------------------------------------------


@query
def logit_to_pd(spark, sf_dir):
    f = FT.customer_features(V.statements(spark, sf_dir), ROLES)
    return LOGIT.transform(f, "raw").select(KEY, F.round("raw", 9).alias("raw"))


def _standardized(spark, sf_dir):
    train, every = _coded(spark, sf_dir)
    stats = SQ.stats_as_dict(SQ.norm_stats(train, SEQ_COLUMNS))
    return SQ.standardize_rows(every, stats, [KEY, "S_2", "seq"])


@query
def standardize_rows(spark, sf_dir):
    out = _standardized(spark, sf_dir)
    return out.select(KEY, "seq", *[F.round(c, 7).alias(c) for c in SEQ_COLUMNS])


@query
def trajectory(spark, sf_dir):
    return PR.trajectory(V.statements(spark, sf_dir), ROLES, "P_2")


@query
def padded_sequences(spark, sf_dir):
    """Every cell of the padded sequences of coded, standardized columns."""
    out = SQ.padded_sequences(_standardized(spark, sf_dir), ROLES, SEQ_COLUMNS)
    each = out.select(KEY, "length", F.posexplode("seq").alias("pos", "x"))
    return each.select(
        KEY, "length", "pos", *[F.round(F.col("x")[i].cast("double"), 4).alias(c) for i, c in enumerate(SEQ_COLUMNS)]
    )


# --- scoring -------------------------------------------------------------------------------


@query
def score_portfolio(spark, sf_dir):
    return _scored(spark, sf_dir).withColumn("raw_score", F.round("raw_score", 6))


@query
def what_if_score(spark, sf_dir):
    return SC.what_if_scores(V.statements(spark, sf_dir), ROLES, MODEL, SCENARIOS)


@query
def skew_check(spark, sf_dir):
    """All features against those of the last 13 statements only."""
    s = V.statements(spark, sf_dir)
    cut = SQ.sequence_positions(s, ROLES).select(*s.columns)
    out = FT.skew_check(_features(s), _features(cut), KEY, FEATURES)
    return out.withColumn("max_abs_diff", F.round("max_abs_diff", 4))


@query
def blend2_search(spark, sf_dir):
    out = B.blend_search(_predictions(spark, sf_dir), ["p_a", "p_b"], B.two_way_grid())
    return out.withColumn("metric", F.round("metric", 9))


@query
def blend3_search(spark, sf_dir):
    out = B.blend_search(_predictions(spark, sf_dir), ["p_a", "p_b", "p_c"], B.three_way_grid())
    return out.withColumn("metric", F.round("metric", 9))


WIDE_FEATURES = FT.feature_names(V.WIDE_NUMERIC, V.WIDE_CATEGORICAL)
# every numeric feature carries a little weight, so a score reads the full width
WIDE_COEFFICIENTS = {f"{c}_{s}": 0.01 for c in V.WIDE_NUMERIC for s in ("mean", "last_mean_diff", "range")}
WIDE_MEANS = {f"{c}_{s}": m + (3.0 * i if s == "mean" else 0.0) for i, c in enumerate(V.WIDE_NUMERIC) for s, m in (("mean", 100.0), ("last_mean_diff", 0.0), ("range", 50.0))}
WIDE_SCALE = 1e5


def wide_table(spark, sf_dir):
    return WF.wide_features(V.wide_statements(spark, sf_dir), V.WIDE_ROLES)


@query
def wide_features(spark, sf_dir):
    """All 1,628 features of a portfolio at full width: 177 numeric and 11 categorical columns."""
    f = wide_table(spark, sf_dir)
    rounded = {f"{c}_std" for c in V.WIDE_NUMERIC}
    return f.select(KEY, *[F.round(c, 4).alias(c) if c in rounded else F.col(c) for c in WIDE_FEATURES])


@query
def wide_portfolio(spark, sf_dir):
    """The portfolio scored at full width by a linear model over 531 of its features."""
    logit = C.LinearScore({f: w / WIDE_SCALE for f, w in WIDE_COEFFICIENTS.items()}, WIDE_MEANS, -0.4)
    model = SC.ScoringModel(logit, (KNOTS_X, KNOTS_Y))
    return SC.score_portfolio(V.wide_statements(spark, sf_dir), V.WIDE_ROLES, model, build=partial(WF.wide_features, only=logit.features))
