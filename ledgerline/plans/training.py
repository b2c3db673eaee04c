"""Train, cross-validate, tune and save classifiers with the rank metric in charge."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.contributions import REASONS, reason_codes
from ledgerline.operators.folds import random_halves, stratified_folds, stratified_holdout
from ledgerline.operators.rank_metrics import rank_metric
from ledgerline.operators.sequences import MAX_STATEMENTS
from ledgerline.operators.tree_paths import flatten_trees, named_paths, path_contributions
from ledgerline.operators.tree_stages import LEAVES, LeafValues, best_stage, read_leaf_values, with_leaves
from ledgerline.roles import FOLDS, SEED
from ledgerline.session import materialize, scratch_path

KEY, TARGET = "customer_ID", "target"
# The settings of the two tree models, as far as the library has them.
MODEL_A = {"stepSize": 0.03, "minInstancesPerNode": 40, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.4"}
MODEL_B = {"maxDepth": 7, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.4", "minInstancesPerNode": 8}
PATIENCE = 100
ROWS_PER_TASK = 100_000
FIRST_ROUNDS = 200


class RankMetricEvaluator(Evaluator):
    """The rank metric as an evaluator, for use wherever one is accepted."""

    def __init__(self, score: str = "prediction", target: str = TARGET, key: str = KEY):
        super().__init__()
        self.score, self.target, self.key = score, target, key

    def _evaluate(self, dataset: DataFrame) -> float:
        value = rank_metric(dataset, self.target, self.score, self.key).first()["metric"]
        return float("nan") if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True


# --- input -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Inputs:
    """Feature columns with the training means that stand in for missing values."""

    columns: Sequence[str]
    means: Mapping[str, float]

    @property
    def names(self) -> list[str]:
        return [*self.columns, *[f"{c}_missing" for c in self.columns]]

    def assemble(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Trees here take no missing values: fill by the mean and flag what was filled."""
        filled = {f"_f_{i}": F.coalesce(F.col(c).cast("double"), F.lit(float(self.means[c]))) for i, c in enumerate(self.columns)}
        flags = {f"_m_{i}": F.col(c).isNull().cast("double") for i, c in enumerate(self.columns)}
        ready = df.withColumns({**filled, **flags})
        assembler = VectorAssembler(inputCols=[*filled, *flags], outputCol=out)
        return assembler.transform(ready).drop(*filled, *flags)


def fit_inputs(train: DataFrame, columns: Sequence[str]) -> Inputs:
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return Inputs(list(columns), {c: row[c] if row[c] is not None else 0.0 for c in columns})


@contextmanager
def dealt(rows: DataFrame) -> Iterator[DataFrame]:
    """Stored training rows in tasks of about ``ROWS_PER_TASK``; up to that many stay as they are stored.

    The library holds a task's rows in memory for all rounds, several times as large as in the file: a file of one row group
    would put them all into one task. A fit passes its input a few times, so they are dealt once and kept on the executors' disks for
    the fits; a block lost with its executor is dealt again.
    """
    tasks = math.ceil(rows.count() / ROWS_PER_TASK)
    if tasks <= 1:
        yield rows
        return
    parts = rows.repartition(tasks, KEY).persist(StorageLevel.DISK_ONLY)
    try:
        yield parts
    finally:
        parts.unpersist()


def positive_probability(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array("probability")[1])


# --- boosted trees with early stopping on the rank metric --------------------------------


@dataclass(frozen=True)
class TreeScorer:
    """A saved tree ensemble cut to its best number of trees, usable by the scoring plan.

    ``path`` holds the library's own form of the model; ``values`` are its leaves.
    """

    model: Model
    inputs: Inputs
    trees: int
    values: LeafValues
    path: str

    def transform(self, features: DataFrame, out: str = "raw") -> DataFrame:
        leafed = with_leaves(self.model, self.inputs.assemble(features))
        return leafed.withColumn(out, self.values.probability(F.col(LEAVES), self.trees)).drop("features", LEAVES)

    def explain(self, features: DataFrame, n: int = REASONS) -> DataFrame:
        """Adds ``contributions``: the top reasons, from the path shares of the boosted trees kept."""
        names = self.inputs.names
        trees = flatten_trees(features.sparkSession, self.path)[: self.trees]
        ready = path_contributions(self.inputs.assemble(features), trees, len(names))
        return ready.withColumn("contributions", reason_codes(named_paths(names), n)).drop("features", "paths")


def saved_scorer(model, inputs: Inputs, valid: DataFrame | None, patience: int, path: str | None = None) -> TreeScorer:
    """Writes the fitted ensemble and picks its number of trees on the validation rows (all of them without any)."""
    path = path or scratch_path(model_session(), "model")
    model.write().overwrite().save(path)
    values = read_leaf_values(model_session(), path, isinstance(model, RandomForestClassificationModel))
    kept = len(values.values)
    if valid is not None:
        kept = best_stage(model, values, inputs.assemble(valid).select(KEY, TARGET, "features"), KEY, TARGET, patience)
    return TreeScorer(model, inputs, kept, values, path)


def model_session() -> SparkSession:
    return SparkSession.active()


def fit_boosted(train: DataFrame, valid: DataFrame, inputs: Inputs, params: Mapping, rounds: int, patience: int = PATIENCE, seed: int = SEED) -> TreeScorer:
    """Boosted trees, ``rounds`` at most, cut where the rank metric of ``valid`` stops rising.

    The library neither stops on this metric nor goes on from a fitted model, but a longer fit begins with the trees of a
    shorter one. So ``FIRST_ROUNDS`` are fitted, then twice as many, until ``patience`` stages without progress lie
    within the fit or all rounds do: the trees kept are those of one fit of all rounds.
    """
    ready = inputs.assemble(train).select("features", TARGET)
    fitted = min(rounds, FIRST_ROUNDS)
    if rounds > fitted:
        cut_lineage(train.sparkSession)
    while True:
        settings = {**MODEL_A, "maxIter": fitted, "seed": seed, **params}
        scorer = saved_scorer(GBTClassifier(featuresCol="features", labelCol=TARGET, **settings).fit(ready), inputs, valid, patience)
        if fitted == rounds or scorer.trees + patience <= fitted:
            return scorer
        fitted = min(rounds, 2 * fitted)


def cut_lineage(spark: SparkSession) -> None:
    """A round's errors build on those of the round before; the library stores them now and then where the context has a
    checkpoint folder, else a task would carry the whole chain."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))


def fit_forest(train: DataFrame, valid: DataFrame, inputs: Inputs, params: Mapping, rounds: int, patience: int = PATIENCE, seed: int = SEED) -> TreeScorer:
    """A second tree family on the same folds, ``rounds`` trees at most, cut the same way."""
    settings = {**MODEL_B, "numTrees": rounds, "seed": seed, **params}
    estimator = RandomForestClassifier(featuresCol="features", labelCol=TARGET, **settings)
    return saved_scorer(estimator.fit(inputs.assemble(train).select("features", TARGET)), inputs, valid, patience)


# --- the sequence model ------------------------------------------------------------------


@dataclass(frozen=True)
class SequenceScorer:
    model: Model

    def transform(self, sequences: DataFrame, out: str = "raw") -> DataFrame:
        scored = positive_probability(self.model.transform(flatten_sequences(sequences)), out)
        return scored.drop("features", "rawPrediction", "probability", "prediction")


def flatten_sequences(sequences: DataFrame) -> DataFrame:
    """Padded sequence and its length as one vector."""
    cells = F.concat(
        F.transform(F.flatten("seq"), lambda x: x.cast("double")),
        F.array(F.col("length").cast("double") / MAX_STATEMENTS),
    )
    return sequences.withColumn("features", array_to_vector(cells))


def fit_sequence_model(train: DataFrame, width: int, hidden: int = 16, rounds: int = 30, seed: int = SEED) -> SequenceScorer:
    layers = [MAX_STATEMENTS * width + 1, hidden, 2]
    estimator = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol=TARGET, layers=layers, maxIter=rounds, seed=seed
    )
    return SequenceScorer(estimator.fit(flatten_sequences(train).select("features", TARGET)))


# --- cross-validation ----------------------------------------------------------------------


@dataclass(frozen=True)
class CrossValidation:
    oof: DataFrame
    scorers: Sequence
    fold_metrics: DataFrame
    metadata: Mapping = field(default_factory=dict)


Fit = Callable[[DataFrame, DataFrame], object]


def cross_validate(folded: DataFrame, fit: Fit, k: int = FOLDS, parallelism: int = 2, metadata: Mapping | None = None) -> CrossValidation:
    """One model per fold; every row is scored by the model that has not seen it.

    ``folded`` is a stored table with a ``fold`` column.
    """
    with dealt(folded) as rows, ThreadPool(parallelism) as pool:
        scorers = pool.map(lambda i: fit(rows.where(F.col("fold") != i), folded.where(F.col("fold") == i)), range(k))
    oof = materialize(out_of_fold(folded, scorers), "oof")
    fold_metrics = rank_metric(oof, TARGET, "oof_pred", KEY, ["fold"])
    return CrossValidation(oof, scorers, fold_metrics, dict(metadata or {}))


def out_of_fold(folded: DataFrame, scorers: Sequence) -> DataFrame:
    """Out-of-fold predictions rebuilt from fold models."""
    out = None
    for i, scorer in enumerate(scorers):
        part = scorer.transform(folded.where(F.col("fold") == i), "oof_pred").select(KEY, TARGET, "fold", "oof_pred")
        out = part if out is None else out.unionByName(part)
    return out


MANIFEST = "fold int, family string, trees int, seed int, metric double, params string, inputs array<struct<name: string, mean: double>>"


def save_folds(cv: CrossValidation, spark: SparkSession, path: str, seed: int = SEED) -> None:
    """Fold models with a manifest: fold, family, trees kept, seed, metric, parameters, and the inputs in their order."""
    metrics = {r["fold"]: r["metric"] for r in cv.fold_metrics.collect()}  # one row per fold
    rows = []
    for fold, scorer in enumerate(cv.scorers):
        scorer.model.write().overwrite().save(f"{path}/fold-{fold}")
        inputs = [(c, float(scorer.inputs.means[c])) for c in scorer.inputs.columns]
        family = "forest" if scorer.values.averaged else "boosted"
        rows.append((fold, family, scorer.trees, seed, metrics.get(fold), json.dumps(dict(cv.metadata), sort_keys=True), inputs))
    # written last: a folder with a manifest is complete
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_folds(spark: SparkSession, path: str) -> list[TreeScorer]:
    """The fold models of a folder, fold 0 first."""
    scorers = []
    for row in spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy("fold").collect():  # one row per fold
        place = f"{path}/fold-{row['fold']}"
        averaged = row["family"] == "forest"
        model = (RandomForestClassificationModel if averaged else GBTClassificationModel).load(place)
        inputs = Inputs([i["name"] for i in row["inputs"]], {i["name"]: i["mean"] for i in row["inputs"]})
        scorers.append(TreeScorer(model, inputs, row["trees"], read_leaf_values(spark, place, averaged), place))
    return scorers


def predict_mean(features: DataFrame, scorers: Sequence, key: str = KEY) -> DataFrame:
    """Average prediction of the fold models: one pass, one column per model."""
    scored = features
    for i, scorer in enumerate(scorers):
        scored = scorer.transform(scored, f"_p{i}")
    total = sum((F.col(f"_p{i}") / len(scorers) for i in range(1, len(scorers))), F.col("_p0") / len(scorers))
    return scored.select(key, total.alias("prediction"))


def run_summary(cv: CrossValidation) -> DataFrame:
    """Run metadata as one row: overall metric, fold metrics, mean and population deviation."""
    overall = rank_metric(cv.oof, TARGET, "oof_pred", KEY).select(F.col("metric").alias("cv_oof_metric"))
    slots = F.array_sort(F.collect_list(F.struct("fold", "metric")))  # one entry per fold
    folds = cv.fold_metrics.agg(
        F.transform(slots, lambda s: s["metric"]).alias("fold_scores"),
        F.avg("metric").alias("mean_fold_metric"),
        F.stddev_pop("metric").alias("std_fold_metric"),
    )
    meta = F.lit(json.dumps(dict(cv.metadata), sort_keys=True)).alias("params")
    row = overall.first()
    return folds.select(F.lit(row["cv_oof_metric"]).alias("cv_oof_metric"), "*", meta)


def feature_importance(spark, scorers: Sequence) -> DataFrame:
    """Mean importance over the fold models, ranked: one row per model input."""
    names = scorers[0].inputs.names
    total = [0.0] * len(names)
    for s in scorers:
        for i, v in enumerate(s.model.featureImportances.toArray()):
            total[i] += float(v) / len(scorers)
    rows = list(zip(names, total))
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


# --- tuning -----------------------------------------------------------------------------------


# Search ranges (kind, low, high) of the boosted model.
SEARCH_SPACE = {
    "stepSize": ("log", 0.01, 0.05),
    "maxDepth": ("int", 3, 7),
    "minInstancesPerNode": ("int", 10, 150),
    "featureSubsetStrategy": ("share", 0.2, 0.6),
    "subsamplingRate": ("float", 0.5, 1.0),
    "minInfoGain": ("log", 1e-6, 1e-2),
}


STARTUP = 10
GOOD_SHARE, CANDIDATES = 0.25, 24


def _setting(kind: str, low: float, high: float, u: float):
    """The value at place ``u`` of a range, 0 to 1; a log range is even in the logarithm."""
    if kind == "int":
        return min(int(low + u * (high - low + 1)), int(high))
    if kind == "log":
        return min(max(math.exp(math.log(low) + u * math.log(high / low)), low), high)
    value = low + u * (high - low)
    return f"{value:.3f}" if kind == "share" else value


def settings_at(places: Mapping[str, float], space: Mapping = SEARCH_SPACE) -> dict:
    return {name: _setting(*space[name], u) for name, u in places.items()}


def draw_params(n: int, seed: int = SEED, space: Mapping = SEARCH_SPACE) -> list[dict]:
    """``n`` seeded random settings."""
    rng = random.Random(seed)
    return [settings_at({name: rng.random() for name in space}, space) for _ in range(n)]


def suggest(history: Sequence[tuple[Mapping[str, float], float]], rng: random.Random, space: Mapping = SEARCH_SPACE) -> dict[str, float]:
    """The next place to try, parameter by parameter, by tree-structured Parzen estimators.

    The best quarter of the trials and the rest each give a density over the range, a mixture of normal kernels and the
    uniform prior. Of a few draws from the good density the one where it stands highest over the other is taken.
    Without a trial that has a score the place is random.
    """
    scored = sorted((h for h in history if h[1] == h[1]), key=lambda h: -h[1])
    if not scored:
        return {name: rng.random() for name in space}
    failed = [h for h in history if h[1] != h[1]]
    cut = max(1, math.ceil(GOOD_SHARE * len(scored)))
    out = {}
    for name in space:
        good, rest = ([places[name] for places, _ in part] for part in (scored[:cut], [*scored[cut:], *failed]))
        draws = [_draw_kernel(good, rng) for _ in range(CANDIDATES)]
        out[name] = max(draws, key=lambda u: math.log(_density(u, good)) - math.log(_density(u, rest)))
    return out


def _width(points: Sequence[float]) -> float:
    return max(0.05, 0.5 / math.sqrt(1 + len(points)))


def _draw_kernel(points: Sequence[float], rng: random.Random) -> float:
    at = rng.randrange(len(points) + 1)
    if at == len(points):
        return rng.random()
    return min(max(rng.gauss(points[at], _width(points)), 0.0), 1.0)


def _density(u: float, points: Sequence[float]) -> float:
    w = _width(points)
    kernels = sum(math.exp(-0.5 * ((u - p) / w) ** 2) for p in points) / (w * math.sqrt(2 * math.pi))
    return (1.0 + kernels) / (1 + len(points))


def search(judge: Callable[[list[dict]], list[float]], trials: int, seed: int = SEED, startup: int = STARTUP, batch: int = 2, space: Mapping = SEARCH_SPACE):
    """(settings, score) of every trial in order: random ones first, then suggested ones, ``batch`` at a time.

    A trial's random numbers depend on the seed and its number, so a search can be repeated.
    """
    history: list[tuple[dict[str, float], float]] = []
    while len(history) < trials:
        left = min(batch, trials - len(history))
        if len(history) < startup:
            left = min(left, startup - len(history))
            places = [{n: r.random() for n in space} for r in (random.Random(f"{seed}-{len(history) + i}") for i in range(left))]
        else:
            places = [suggest(history, random.Random(f"{seed}-{len(history) + i}"), space) for i in range(left)]
        history += zip(places, judge([settings_at(p, space) for p in places]), strict=True)
    return [(settings_at(p, space), s) for p, s in history]


def tune(
    folded: DataFrame, inputs: Inputs, trials: int, rounds: int, seed: int = SEED, parallelism: int = 2, startup: int = STARTUP, patience: int = PATIENCE
) -> list[tuple[dict, float]]:
    """Adaptive search on one fixed split (fold 0 held out), best first; ties keep the earlier trial.

    ``parallelism`` trials are suggested from the same history and run side by side.
    """
    train, valid = folded.where(F.col("fold") != 0), folded.where(F.col("fold") == 0)
    judge = RankMetricEvaluator("raw")

    def one(params: dict) -> float:
        scorer = fit_boosted(rows, valid, inputs, params, rounds, patience)
        return judge.evaluate(scorer.transform(valid, "raw").select(KEY, TARGET, "raw"))

    with dealt(train) as rows, ThreadPool(parallelism) as pool:
        found = search(lambda settings: pool.map(one, settings), trials, seed, startup, parallelism)
    order = sorted(range(trials), key=lambda i: (-(found[i][1] if found[i][1] == found[i][1] else -math.inf), i))
    return [found[i] for i in order]


def tune_and_refit(
    folded: DataFrame, inputs: Inputs, trials: int, search_rounds: int, rounds: int, patience: int = PATIENCE, seed: int = SEED, parallelism: int = 2,
    startup: int = STARTUP,
) -> CrossValidation:
    """The best settings of a search, fitted again on every fold; settings, trials and the search's best score in its metadata."""
    best, score = tune(folded, inputs, trials, search_rounds, seed, parallelism, startup, patience)[0]
    about = {**best, "rounds": rounds, "patience": patience, "trials": trials, "search_metric": score}
    return cross_validate(folded, lambda t, v: fit_boosted(t, v, inputs, best, rounds, patience, seed), parallelism=parallelism, metadata=about)


# --- calibration and the serving model -----------------------------------------------------------


def fit_isotonic(df: DataFrame, score: str, target: str = TARGET):
    """Isotonic fit of the label on the score. Equal scores are pooled first, as weights."""
    pooled = df.groupBy(F.col(score).cast("double").alias("_x")).agg(
        F.avg(F.col(target).cast("double")).alias("_y"), F.count(F.lit(1)).cast("double").alias("_w")
    )
    return IsotonicRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(pooled)


def isotonic_knots(model) -> tuple[list[float], list[float]]:
    """Knots with strictly increasing x."""
    xs, ys = [], []
    for x, y in zip(model.boundaries.toArray(), model.predictions.toArray()):
        if xs and x <= xs[-1]:
            ys[-1] = float(y)
        else:
            xs.append(float(x))
            ys.append(float(y))
    return xs, ys


def apply_isotonic(model, df: DataFrame, score: str, out: str) -> DataFrame:
    return model.transform(df.withColumn("_x", F.col(score).cast("double"))).withColumnRenamed("prediction", out).drop("_x")


def cross_calibrate(df: DataFrame, score: str, out: str = "calibrated", seed: int = SEED) -> DataFrame:
    """Fit on one random half, apply to the other, and swap."""
    halves = materialize(random_halves(df, KEY, seed), "halves")
    parts = []
    for i in (0, 1):
        model = fit_isotonic(halves.where(F.col("half") == 1 - i), score)
        parts.append(apply_isotonic(model, halves.where(F.col("half") == i), score, out))
    return parts[0].unionByName(parts[1]).select(*df.columns, "half", out)


@dataclass(frozen=True)
class ServingModel:
    scorer: TreeScorer
    knots: tuple[list[float], list[float]]
    metadata: Mapping


def train_serving(labelled: DataFrame, columns: Sequence[str], params: Mapping, rounds: int, patience: int = PATIENCE) -> ServingModel:
    """Hold out 10 % for the best iteration and the calibrator, then refit on everything."""
    # the holdout reads its input three times
    split = materialize(stratified_holdout(materialize(labelled, "labelled")), "holdout")
    train, hold = split.where(~F.col("is_holdout")), split.where(F.col("is_holdout"))
    with dealt(train) as rows:
        first = fit_boosted(rows, hold, fit_inputs(train, columns), params, rounds, patience)
    scored = materialize(first.transform(hold, "raw").select(KEY, TARGET, "raw"), "holdout_scores")
    knots = isotonic_knots(fit_isotonic(scored, "raw"))
    metric = RankMetricEvaluator("raw").evaluate(scored)
    inputs = fit_inputs(split, columns)
    settings = {**MODEL_A, "seed": SEED, **params, "maxIter": first.trees}
    with dealt(split) as rows:
        final = GBTClassifier(featuresCol="features", labelCol=TARGET, **settings).fit(
            inputs.assemble(rows).select("features", TARGET)
        )
    scorer = saved_scorer(final, inputs, None, patience)
    totals = split.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(TARGET).cast("double")).alias("rate")).first()
    metadata = {
        "n_features": len(columns), "best_iteration": first.trees, "holdout_metric": metric,
        "default_rate": totals["rate"], "trained_rows": totals["n"],
    }
    return ServingModel(scorer, knots, metadata)


def save_serving(model: ServingModel, spark, path: str) -> None:
    """Model, inputs, calibrator knots and metadata under one folder."""
    model.scorer.model.write().overwrite().save(f"{path}/model")
    rows = [(c, float(model.scorer.inputs.means[c]), i) for i, c in enumerate(model.scorer.inputs.columns)]
    spark.createDataFrame(rows, "feature string, mean double, position int").write.mode("overwrite").json(f"{path}/inputs")
    spark.createDataFrame(list(zip(*model.knots)), "x double, y double").write.mode("overwrite").json(f"{path}/calibrator")
    spark.createDataFrame([(json.dumps(dict(model.metadata)),)], "metadata string").write.mode("overwrite").text(f"{path}/metadata")


def load_serving(spark, path: str) -> ServingModel:
    model = GBTClassificationModel.load(f"{path}/model")
    inputs = spark.read.schema("feature string, mean double, position int").json(f"{path}/inputs").orderBy("position").collect()
    knots = spark.read.schema("x double, y double").json(f"{path}/calibrator").orderBy("x").collect()
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    fitted = Inputs([r["feature"] for r in inputs], {r["feature"]: r["mean"] for r in inputs})
    values = read_leaf_values(spark, f"{path}/model", False)
    return ServingModel(
        TreeScorer(model, fitted, len(values.values), values, f"{path}/model"), ([k["x"] for k in knots], [k["y"] for k in knots]), metadata
    )


def folded_training_set(features: DataFrame, labels: DataFrame, k: int = FOLDS) -> DataFrame:
    """Labelled features with folds, stored once for all models."""
    # the folds read their input three times
    labelled = materialize(features.join(labels, KEY), "labelled")
    return materialize(stratified_folds(labelled, KEY, TARGET, k), "training")
