"""Score a portfolio: statements to calibrated probability, band and reasons."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calibrate import calibrate
from ledgerline.functions.scores import finite_or, portfolio_stats, risk_band
from ledgerline.operators.contributions import REASONS, reason_codes
from ledgerline.operators.encode import encode_last
from ledgerline.operators.features import align_columns, customer_features, mark_latest
from ledgerline.roles import Roles


class Scorer(Protocol):
    def transform(self, features: DataFrame, out: str = "raw") -> DataFrame: ...


Features = Callable[[DataFrame, Roles], DataFrame]


@dataclass(frozen=True)
class ScoringModel:
    """What a scoring run needs: model, calibration knots, and the fitted inputs."""

    scorer: Scorer
    knots: tuple[Sequence[float], Sequence[float]] | None = None
    dictionary: DataFrame | None = None
    feature_order: Sequence[str] | None = None


def model_features(statements: DataFrame, roles: Roles, model: ScoringModel, build: Features = customer_features) -> DataFrame:
    """The feature row per customer, exactly as in training; ``build`` may be ``wide_features`` for wide tables."""
    features = build(statements, roles)
    cats = roles.categorical_columns(statements)
    if model.dictionary is not None and cats:
        features = encode_last(features, model.dictionary, cats)
    if model.feature_order:
        features = align_columns(features, model.feature_order, roles.key)
    return features


def score_features(
    features: DataFrame, key: str, model: ScoringModel, with_reasons: bool = False, n_reasons: int = REASONS
) -> DataFrame:
    """Calibrated probability (6 decimals), raw score, band; reasons on request.

    The band is taken from the unrounded probability. Non-finite values become 0.
    """
    scored = model.scorer.transform(features, "raw")
    if not with_reasons:
        scored = scored.select(key, "raw")
    if model.knots:
        scored = calibrate(scored, "raw", *model.knots, "_pd")
    else:
        scored = scored.withColumn("_pd", F.col("raw"))
    pd = finite_or(F.col("_pd"), 0.0)
    out = [
        F.col(key).alias("customer_id"),
        F.round(pd, 6).alias("probability_of_default"),
        F.round(finite_or(F.col("raw"), 0.0), 6).alias("raw_score"),
        risk_band(pd).alias("risk_band"),
    ]
    if with_reasons:
        if "contributions" in scored.columns:
            out.append(F.col("contributions").alias("top_reason_codes"))
        else:
            out.append(reason_codes(model.scorer.contributions(), n_reasons).alias("top_reason_codes"))
    return scored.select(*out)


def score_portfolio(
    statements: DataFrame, roles: Roles, model: ScoringModel, with_reasons: bool = False, n_reasons: int = REASONS,
    build: Features = customer_features,
) -> DataFrame:
    """One output row per customer, wherever its statements lie in the input."""
    features = model_features(statements, roles, model, build)
    return score_features(features, roles.key, model, with_reasons, n_reasons)


def what_if_statements(
    statements: DataFrame, roles: Roles, scenarios: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Every statement once per scenario, with the latest one overridden.

    ``scenarios`` is a short list of named overrides. Column ``scenario`` is added.
    """
    marked = mark_latest(statements, roles, "_is_latest")
    touched = sorted({c for values in scenarios.values() for c in values})
    options = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                *[F.lit(values.get(c)).cast("double").alias(f"_new_{c}") for c in touched],
            )
            for name, values in scenarios.items()
        ]
    )
    each = marked.select("*", F.inline(options))
    types = dict(statements.dtypes)
    replaced = [
        F.when(F.col("_is_latest") & F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}").cast(types[c]))
        .otherwise(F.col(c))
        .alias(c)
        if c in touched
        else F.col(c)
        for c in statements.columns
    ]
    return each.select("scenario", *replaced)


def what_if_features(
    statements: DataFrame, roles: Roles, scenarios: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Feature row of every customer under every scenario; numeric columns only.

    Statements are read once, not once per scenario: each customer's statistics without the latest
    statement meet the new values, and only the finished row is repeated. A customer whose latest
    statement has no date or tie keeps its features, as in ``what_if_statements``.
    """
    touched = sorted({c for values in scenarios.values() for c in values})
    types = dict(statements.dtypes)
    known = statements.where(F.col(roles.key).isNotNull())
    marked = mark_latest(known, roles, "_is_latest")
    aggs = [F.count_if("_is_latest").alias("_latest")]
    for i, c in enumerate(touched):
        x = F.when(~F.col("_is_latest"), F.col(c))
        at = F.when(x.isNotNull(), F.col("_ord"))
        aggs += [
            F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_mean{i}"), F.var_pop(x).alias(f"_var{i}"),
            F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}"), F.min_by(x, at).alias(f"_first{i}"),
        ]
    rest = marked.withColumn("_ord", roles.order_key(marked)).groupBy(roles.key).agg(*aggs)
    options = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), *[F.lit(values.get(c)).cast(types[c]).alias(f"_new{i}") for i, c in enumerate(touched)])
            for name, values in scenarios.items()
        ]
    )
    features = customer_features(known, roles)
    each = features.join(rest, roles.key).select("*", F.inline(options))
    changed = {}
    for i, c in enumerate(touched):
        new = _with_latest(i)
        for stat, value in new.items():
            name = f"{c}_{stat}"
            applies = (F.col("_latest") > 0) & F.col(f"_new{i}").isNotNull()
            changed[name] = F.when(applies, value).otherwise(F.col(name)).alias(name)
    return each.select("scenario", *[changed.get(c, F.col(c)) for c in features.columns])


def _with_latest(i: int) -> dict[str, Column]:
    """Statistics of touched column ``i`` once its latest value is the new one."""
    new = F.col(f"_new{i}")
    v, k = new.cast("double"), F.col("_latest")
    n, mean, var, low, high, first = (F.col(f"_{s}{i}") for s in ("n", "mean", "var", "min", "max", "first"))
    old = F.coalesce(mean, F.lit(0.0))
    total = n + k
    average = (n * old + k * v) / total
    apart = n * F.coalesce(var, F.lit(0.0)) + n * k / total * (v - old) * (v - old)
    out = {
        "mean": average,
        "std": F.when(total > 1, F.sqrt(apart / F.nullif(total - 1, F.lit(0)))),
        "min": F.least(low, new), "max": F.greatest(high, new),
        "first": F.coalesce(first, new), "last": new,
    }
    return out | {
        "last_mean_diff": new - average, "last_first_diff": new - out["first"], "range": out["max"] - out["min"],
    }


def what_if_scores(
    statements: DataFrame, roles: Roles, model: ScoringModel, scenarios: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Scores of every customer under every scenario.

    Overrides of numeric columns multiply one row per customer; others multiply its statements.
    """
    who, keyed = F.struct("scenario", roles.key), replace(roles, key="_who")
    if {c for values in scenarios.values() for c in values} <= set(roles.numeric_columns(statements)):
        def build(rows: DataFrame, _: Roles) -> DataFrame:
            return what_if_features(rows, roles, scenarios).withColumn("_who", who).drop("scenario", roles.key)

        scored = score_portfolio(statements, keyed, model, build=build)
    else:
        each = what_if_statements(statements, roles, scenarios)
        scored = score_portfolio(each.withColumn("_who", who).drop("scenario", roles.key), keyed, model)
    return scored.select(
        F.col("customer_id.scenario").alias("scenario"),
        F.col(f"customer_id.{roles.key}").alias("customer_id"),
        *[c for c in scored.columns if c != "customer_id"],
    )


def run_portfolio(statements: DataFrame, roles: Roles, model: ScoringModel, path: str, mode: str = "errorifexists") -> dict:
    """Score a portfolio into Parquet; returns customers, seconds, throughput and the high-risk share."""
    start = time.monotonic()
    score_portfolio(statements, roles, model).write.mode(mode).parquet(path)
    seconds = time.monotonic() - start
    stats = portfolio_stats(statements.sparkSession.read.parquet(path)).first()
    return {
        "customers": stats["customers"],
        "seconds": seconds,
        "customers_per_second": stats["customers"] / seconds if seconds else None,
        "share_high_risk": stats["share_high_risk"],
    }
