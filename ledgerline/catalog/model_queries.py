"""Training, calibration, explanation and streaming queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ledgerline.catalog import views as V
from ledgerline.catalog.queries import FEATURES, MODEL, NUMERIC, SEQ_COLUMNS, _predictions, _standardized, query
from ledgerline.functions import scores as S
from ledgerline.operators import drift as D
from ledgerline.operators import encode as E
from ledgerline.operators import features as FT
from ledgerline.operators import sequences as SQ
from ledgerline.operators import tree_stages as TS
from ledgerline.plans import scoring as SC
from ledgerline.plans import training as TR
from ledgerline.session import materialize, scratch_path
from ledgerline.streaming import customer_state as CS
from ledgerline.streaming import scoring_stream as ST

ROLES = V.ROLES
KEY = ROLES.key
COLUMNS = FEATURES
# patience lies below the rounds, so that early stopping can end a search
ROUNDS, PATIENCE = 16, 4
PARAMS = {"maxDepth": 3, "stepSize": 0.1}
FOREST_PARAMS = {"maxDepth": 4}
# the whole job of cv_oof: the reference's most rounds, with its patience and rate as the trainer has them, and its 128 leaves
FULL_ROUNDS, FULL_PARAMS = 1_500, {"maxDepth": 7}
# the search goes on after its random trials
TRIALS, STARTUP = 5, 3
# folder of the fold models trained in this application, by tables and family
_STORES: dict[tuple[str, str, str], str] = {}


def _encoded(spark, sf_dir, which="train"):
    """Features with category codes, the dictionary always from the training period."""
    train = FT.customer_features(V.train_statements(spark, sf_dir), ROLES)
    cats = list(ROLES.categoricals)
    dictionary = materialize(E.fit_last_dictionary(train, cats), "dictionary")
    features = train if which == "train" else FT.customer_features(V.test_statements(spark, sf_dir), ROLES)
    return E.encode_last(features, dictionary, cats)


def _training(spark, sf_dir):
    return TR.folded_training_set(_encoded(spark, sf_dir), V.stmt_labels(spark, sf_dir))


def _fold_models(spark, sf_dir, family="boosted"):
    """Folder with the training table, the fold models, their manifest and out-of-fold predictions.

    Trained by the first query that asks; every query works on the files.
    """
    key = (spark.sparkContext.applicationId, sf_dir, family)
    if key not in _STORES:
        path = scratch_path(spark, f"{family}-folds")
        _training(spark, sf_dir).write.parquet(f"{path}/training")
        folded = spark.read.parquet(f"{path}/training")
        inputs = TR.fit_inputs(folded, COLUMNS)
        if family == "tuned":
            cv = TR.tune_and_refit(folded, inputs, TRIALS, 5, ROUNDS, PATIENCE, parallelism=3, startup=STARTUP)
        else:
            fit, params, rounds, patience = {
                "full": (TR.fit_boosted, FULL_PARAMS, FULL_ROUNDS, TR.PATIENCE),
                "boosted": (TR.fit_boosted, PARAMS, ROUNDS, PATIENCE),
                "forest": (TR.fit_forest, FOREST_PARAMS, ROUNDS, PATIENCE)}[family]
            cv = TR.cross_validate(
                folded, lambda t, v: fit(t, v, inputs, params, rounds, patience), parallelism=5, metadata={**params, "rounds": rounds, "patience": patience})
        cv.oof.write.parquet(f"{path}/oof")
        TR.save_folds(cv, spark, path)
        _STORES[key] = path
    return _STORES[key]


def _oof_check(spark, path):
    """Out-of-fold predictions rebuilt from the files next to those of the training run."""
    rebuilt = TR.out_of_fold(spark.read.parquet(f"{path}/training"), TR.load_folds(spark, path))
    trained = spark.read.parquet(f"{path}/oof").select(KEY, F.col("oof_pred").alias("trained"))
    return rebuilt.join(trained, KEY, "full_outer").select(
        KEY, "target", "fold", F.col("oof_pred").between(0, 1).alias("in_range"),
        F.coalesce(F.abs(F.col("oof_pred") - F.col("trained")) <= 1e-12, F.lit(False)).alias("same_from_files"))


@query
def cv_oof(spark, sf_dir):
    """Boosted trees: every labelled customer with its out-of-fold prediction."""
    return spark.read.parquet(f"{_fold_models(spark, sf_dir, 'full')}/oof")


@query
def cv_oof_check(spark, sf_dir):
    """Every labelled customer is predicted once, by the saved model of its fold, as in the training run."""
    return _oof_check(spark, _fold_models(spark, sf_dir, "full"))


@query
def cv_summary(spark, sf_dir):
    path = _fold_models(spark, sf_dir)
    oof = spark.read.parquet(f"{path}/oof")
    metrics = TR.rank_metric(oof, "target", "oof_pred", KEY, ["fold"])
    params = spark.read.schema(TR.MANIFEST).json(f"{path}/manifest").first()["params"]
    return TR.run_summary(TR.CrossValidation(oof, (), metrics, json.loads(params)))


@query
def cv_stages_check(spark, sf_dir):
    """Per fold: the number of trees kept is the one that ranking after every tree gives, and its metric is the manifest's."""
    path = _fold_models(spark, sf_dir)
    folded = spark.read.parquet(f"{path}/training")
    manifest = {r["fold"]: r for r in spark.read.schema(TR.MANIFEST).json(f"{path}/manifest").collect()}  # one row per fold
    rows = []
    for fold, scorer in enumerate(TR.load_folds(spark, path)):
        leafed = materialize(TS.with_leaves(scorer.model, scorer.inputs.assemble(folded.where(F.col("fold") == fold))).select(KEY, "target", TS.LEAVES), "leaves")
        metrics = TS.exact_metrics(leafed, scorer.values, KEY, "target", range(len(scorer.values.values)))
        kept = TS.settled_best({i: (m, m) for i, m in metrics.items()}, PATIENCE, None)
        known = manifest[fold]["metric"]
        rows.append((fold, len(metrics), kept == scorer.trees, abs(metrics[scorer.trees - 1] - known) < 1e-9))
    return spark.createDataFrame(rows, "fold int, trees int, kept_is_best boolean, metric_matches boolean")


@query
def cv_oof_forest(spark, sf_dir):
    """The second model family on the same folds."""
    return spark.read.parquet(f"{_fold_models(spark, sf_dir, 'forest')}/oof")


@query
def cv_oof_forest_check(spark, sf_dir):
    return _oof_check(spark, _fold_models(spark, sf_dir, "forest"))


@query
def cv_oof_sequence(spark, sf_dir):
    """The sequence model on padded, standardized statements, same folds."""
    sequences = SQ.padded_sequences(_standardized(spark, sf_dir), ROLES, SEQ_COLUMNS)
    folded = TR.folded_training_set(sequences, V.stmt_labels(spark, sf_dir))
    fit = lambda t, v: TR.fit_sequence_model(t, len(SEQ_COLUMNS), 8, 15)
    return TR.cross_validate(folded, fit, parallelism=5).oof


@query
def cv_oof_sequence_check(spark, sf_dir):
    """The same customers, labels and folds as the other families, probabilities in range."""
    return cv_oof_sequence(spark, sf_dir).select(KEY, "target", "fold", F.col("oof_pred").between(0, 1).alias("in_range"))


@query
def tune_best(spark, sf_dir):
    """Adaptive search on one split; the trials, best first."""
    folded = _training(spark, sf_dir)
    trials = TR.tune(folded, TR.fit_inputs(folded, COLUMNS), TRIALS, 5, parallelism=3, startup=STARTUP, patience=PATIENCE)
    rows = [(i, str(sorted(p.items())), float(s)) for i, (p, s) in enumerate(trials)]
    return spark.createDataFrame(rows, "place int, params string, metric double")


@query
def tune_refit_check(spark, sf_dir):
    """The best settings of the search on all folds: every labelled customer predicted once, by the saved model of its fold."""
    return _oof_check(spark, _fold_models(spark, sf_dir, "tuned"))


@query
def batch_inference(spark, sf_dir):
    """The later period scored by the average of the saved fold models."""
    return TR.predict_mean(_encoded(spark, sf_dir, "test"), TR.load_folds(spark, _fold_models(spark, sf_dir)))


@query
def batch_inference_check(spark, sf_dir):
    """One pass over all fold models gives each customer the mean of the models run one by one."""
    scorers = TR.load_folds(spark, _fold_models(spark, sf_dir))
    features = materialize(_encoded(spark, sf_dir, "test"), "later_features")
    alone = None
    for scorer in scorers:
        part = scorer.transform(features, "p").select(KEY, "p")
        alone = part if alone is None else alone.unionByName(part)
    mean = alone.groupBy(KEY).agg(F.count("p").alias("models"), F.avg("p").alias("mean"), F.min("p").alias("low"), F.max("p").alias("high"))
    return TR.predict_mean(features, scorers).join(mean, KEY).select(
        KEY, "models", (F.abs(F.col("prediction") - F.col("mean")) <= 1e-12).alias("is_mean"),
        ((F.col("low") >= 0) & (F.col("high") <= 1) & F.col("prediction").between(0, 1)).alias("in_range"))


@query
def feature_importance(spark, sf_dir):
    return TR.feature_importance(spark, TR.load_folds(spark, _fold_models(spark, sf_dir)))


@query
def importance_check(spark, sf_dir):
    """Every input has one mean gain, none below zero, and they add up to one."""
    gains = feature_importance(spark, sf_dir)
    return gains.agg(
        F.count_distinct("feature").alias("inputs"), (F.min("gain") >= 0).alias("none_negative"), (F.abs(F.sum("gain") - 1) < 1e-9).alias("sums_to_one"))


@query
def cross_calibrate(spark, sf_dir):
    p = _predictions(spark, sf_dir).select(KEY, "target", "p_a")
    return TR.cross_calibrate(p, "p_a").withColumn("calibrated", F.round("calibrated", 8))


def _served(spark, sf_dir):
    """The serving model as trained, and as loaded from its files."""
    labelled = _encoded(spark, sf_dir).join(V.stmt_labels(spark, sf_dir), KEY)
    path = scratch_path(spark, "serving")
    trained = TR.train_serving(labelled, COLUMNS, PARAMS, ROUNDS, PATIENCE)
    TR.save_serving(trained, spark, path)
    return trained, TR.load_serving(spark, path)


@query
def serving_model(spark, sf_dir):
    """Train, save, load, and score the whole portfolio with the loaded model and reasons."""
    _, served = _served(spark, sf_dir)
    explained = served.scorer.explain(_encoded(spark, sf_dir, "test"))
    model = SC.ScoringModel(served.scorer, served.knots)
    out = SC.score_features(explained, KEY, model, with_reasons=True)
    return out.withColumn("top_reason_codes", F.to_json("top_reason_codes"))


@query
def serving_check(spark, sf_dir):
    """Trained and loaded model give each customer the same row: a probability, and the band it lies in."""
    features = materialize(_encoded(spark, sf_dir, "test"), "later_features")
    a, b = (SC.score_features(features, KEY, SC.ScoringModel(m.scorer, m.knots)) for m in _served(spark, sf_dir))
    pd = F.col("a.probability_of_default")
    # the band is that of the unrounded probability
    near = [S.risk_band(pd + step) == F.col("a.risk_band") for step in (-5e-7, 0.0, 5e-7)]
    return a.alias("a").join(b.alias("b"), "customer_id").select(
        F.col("customer_id"), pd.between(0, 1).alias("in_range"), (near[0] | near[1] | near[2]).alias("band_fits"),
        ((pd == F.col("b.probability_of_default")) & (F.col("a.raw_score") == F.col("b.raw_score")) & (F.col("a.risk_band") == F.col("b.risk_band"))).alias("same_from_files"))


# --- streaming ---------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query
def stream_score(spark, sf_dir):
    """Orders arrive as a stream of statements; the prediction log is the result."""

    def score(batch):
        # only the line items of the batch's orders are read further
        lineitem = V.table(batch.sparkSession, sf_dir, "lineitem").join(
            batch.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
        return SC.score_portfolio(V.statements_from(batch, lineitem), ROLES, MODEL)

    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "stream")
    ST.finish(ST.score_stream(_stream(spark, sf_dir, "orders"), score, log, checkpoint))
    logged = spark.read.parquet(log)
    return logged.select("customer_id", "probability_of_default", "raw_score", "risk_band")


@query
def stream_running_scores(spark, sf_dir):
    """Statements arrive in batches by date, a customer's over several of them; the newest score of each customer."""
    arrived = scratch_path(spark, "arrived")
    V.statements(spark, sf_dir).repartitionByRange(4, "S_2").write.parquet(arrived)
    source = spark.read.parquet(arrived)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "stream")
    features = CS.running_features(stream, ROLES, NUMERIC)
    ST.finish(ST.score_stream(features, lambda f: SC.score_features(f, KEY, MODEL), log, checkpoint, output_mode="update"))
    newest = CS.latest_rows(spark.read.parquet(log), "customer_id")
    return newest.select("customer_id", "probability_of_default", "raw_score", "risk_band")


def _event_scores(events):
    pd = F.col("value") / (F.col("value") + 50.0)
    return events.select(F.col("user_id").cast("string").alias(KEY), pd.alias("pd"), F.col("ts"))


@query
def stream_pd_hist(spark, sf_dir):
    """Hourly counters of a stream of scores, as they stand after the last batch."""
    counters = ST.pd_counters(_event_scores(_stream(spark, sf_dir, "events")), "pd", "ts")
    path, checkpoint = scratch_path(spark, "counters"), scratch_path(spark, "stream")
    last = ST.finish(ST.replace_counters(counters, path, checkpoint))
    out = spark.read.parquet(f"{path}/state={last}")
    return out.withColumn("pd_sum", F.round("pd_sum", 8))


@query
def windowed_psi(spark, sf_dir):
    """Daily drift of logged scores against the first seven days."""
    scored = _event_scores(V.table(spark, sf_dir, "events")).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    reference = scored.where(F.col("day") < F.to_timestamp_ntz(F.lit("2024-01-08")))
    out = D.windowed_psi(reference, scored, "pd", "day")
    return out.select("day", F.round("psi", 8).alias("psi"))


@query
def stream_windowed_psi(spark, sf_dir):
    """The same drift from bin counters that a stream of scores keeps per day."""
    scored = _event_scores(V.table(spark, sf_dir, "events"))
    edges, base = D.reference_bins(scored.where(F.col("ts") < F.to_timestamp_ntz(F.lit("2024-01-08"))), "pd")
    counters = ST.drift_counters(_event_scores(_stream(spark, sf_dir, "events")), "pd", "ts", edges)
    path, checkpoint = scratch_path(spark, "drift"), scratch_path(spark, "stream")
    last = ST.finish(ST.replace_counters(counters, path, checkpoint))
    out = D.psi_of_counters(spark.read.parquet(f"{path}/state={last}"), "window_start", base)
    return out.select(F.col("window_start").alias("day"), F.round("psi", 8).alias("psi"))


@query
def stream_late_counters(spark, sf_dir):
    """The production form: closed windows only, in append mode."""
    counters = ST.pd_counters(_event_scores(_stream(spark, sf_dir, "events")), "pd", "ts")
    path, checkpoint = scratch_path(spark, "closed"), scratch_path(spark, "stream")
    ST.finish(ST.append_counters(counters, path, checkpoint))
    return spark.read.schema(counters.schema).parquet(path).withColumn("pd_sum", F.round("pd_sum", 8))
