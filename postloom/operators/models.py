"""Classifiers on Spark ML, their search, and a registry of fitted models."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import fixed_values as fixed
from postloom.functions.columns import hash_unit, log_grid
from postloom.operators.boosting import BoostedModel, Settings, fit_trees
from postloom.operators.features import balanced_weights
from postloom.operators.penalty import search
from postloom.session import local_table


MAX_ITER = 5_000  # the fits stop before by their tolerance
TOLERANCE = 1e-10


def iterations(model: PipelineModel | BoostedModel) -> int | None:
    """Iterations a fit has used; None for trees and for models read back from disk."""
    if isinstance(model, BoostedModel):
        return None
    last = model.stages[-1]
    return last.summary.totalIterations if getattr(last, "hasSummary", False) else None


def _logit(label: str, max_iter: int, **params) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="w", standardization=False, maxIter=max_iter, tol=TOLERANCE, **params
    )


def fit_plain_logit(train: DataFrame, label: str, max_iter: int = MAX_ITER) -> PipelineModel:
    """Balanced logistic regression without a penalty."""
    return _as_pipeline(_logit(label, max_iter, regParam=0.0).fit(_weighted(train, label)))


def fit_l1_logit(train: DataFrame, label: str, c: float = 1.0, max_iter: int = MAX_ITER) -> PipelineModel:
    """Balanced logistic regression with an L1 penalty of inverse strength ``c``.

    The objective here averages over rows where ``c`` refers to a sum, and the
    balanced weights sum to the number of rows, hence ``1 / (c * n)``.
    """
    n = train.count()
    model = _logit(label, max_iter, elasticNetParam=1.0, regParam=1.0 / (c * n))
    return _as_pipeline(model.fit(_weighted(train, label)))


def fit_boosted(train: DataFrame, label: str, trees: int = 100, seed: int = 42, key: str = "post_id", **settings) -> BoostedModel:
    """Balanced boosted trees of depth 4 with row and column sampling, L1 and L2 on leaves and Hessian child weights."""
    return fit_trees(train, label, key, Settings(trees=trees, seed=seed, **settings))


def _weighted(train: DataFrame, label: str) -> DataFrame:
    return balanced_weights(train, label).withColumn(label, F.col(label).cast("double"))


def _as_pipeline(model) -> PipelineModel:
    return PipelineModel(stages=[model])


def search_l1_penalty(
    train: DataFrame, label: str, key: str, grid: Sequence[float] | None = None, folds: int = 5
) -> tuple[float | None, DataFrame]:
    """Best inverse penalty by mean AUROC over stratified folds, and the mean of each value.

    The whole path is solved at once. A mean with ``slack`` 0 is exact; others, which cannot be the largest, are
    within their slack.
    """
    values = list(grid) if grid is not None else log_grid(*fixed.C_GRID)
    best, facts, _, _ = search(train, label, key, values, folds)
    return best, facts.groupBy("c").agg(F.avg("auroc").alias("auroc"), F.avg("slack").alias("slack"))


def best_of_grid(fold_scores: DataFrame, value: str, score: str) -> DataFrame:
    """Mean score per grid value over the folds, and the value with the largest mean."""
    means = fold_scores.groupBy(value).agg(F.avg(score).alias("mean_score"))
    # ties go to the smallest grid value
    top = F.max(F.struct(F.col("mean_score"), (-F.col(value)).alias("v")))
    return means.agg(top.alias("t")).select((-F.col("t.v")).alias(value), F.col("t.mean_score").alias("mean_score"))


def random_baseline(df: DataFrame, key: str, label: str, train: str = "train", seed: int = 0) -> DataFrame:
    """Random prediction at the train success rate, reproducible by key."""
    rate = df.filter(F.col(train)).agg(F.avg(F.col(label).cast("double"))).scalar()
    return df.withColumn("prediction", (hash_unit(F.lit(seed), F.col(key)) < rate).cast("int"))


def score(model: PipelineModel | BoostedModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Positive-class probability and prediction for new rows; those of linear models may be a stream."""
    if isinstance(model, BoostedModel):
        names = [f"_{i}" for i in range(len(keep))]
        named = df.select(*[(F.col(k) if isinstance(k, str) else k) for k in keep])
        kept = df.select(*[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keep, names, strict=True)], "features")
        out = model.scores(kept, names)
        return out.select(*[F.col(n).alias(k) for n, k in zip(names, named.columns, strict=True)], "p", "pred")
    out = model.transform(df)
    return out.select(*keep, vector_to_array("probability")[1].alias("p"), F.col("prediction").cast("int").alias("pred"))


FITTERS = {"logit_base": fit_plain_logit, "logit": fit_l1_logit, "xgb": fit_boosted}


@dataclass
class Registry:
    """Fitted models and their feature tables below one folder.

    A model is named ``<feature set>_<classifier>``; an index table keeps which
    feature set belongs to which model.
    """

    spark: SparkSession
    root: str

    def _at(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    def save_features(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at("features", name))
        return self.features(name)

    def features(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at("features", name))

    def save_model(self, name: str, feature_set: str, model: PipelineModel | BoostedModel) -> None:
        if isinstance(model, BoostedModel):
            model.save(self.spark, self._at("models", name))
        else:
            model.write().overwrite().save(self._at("models", name))
        kind = "trees" if isinstance(model, BoostedModel) else "pipeline"
        entry = local_table(self.spark, [(name, feature_set, kind)], "model string, feature_set string, kind string")
        entry.write.mode("overwrite").parquet(self._at("index", f"model={name}"))

    def index(self) -> DataFrame:
        return self.spark.read.parquet(self._at("index")).select("model", "feature_set", "kind")

    def load(self, name: str) -> tuple[PipelineModel | BoostedModel, DataFrame]:
        """The model and the features it was trained on."""
        found = self.index().filter(F.col("model") == name).first()
        if found is None:
            raise KeyError(name)
        path = self._at("models", name)
        model = BoostedModel.load(self.spark, path) if found.kind == "trees" else PipelineModel.load(path)
        return model, self.features(found.feature_set)


def train_grid(
    registry: Registry, feature_sets: dict[str, DataFrame], label: str, classifiers: Sequence[str] = ("logit", "xgb"),
    train: str = "train", tuned: dict[str, float] | None = None, **options,
) -> list[str]:
    """Fit every classifier on every feature set and register the models."""
    tuned = fixed.TUNED_C if tuned is None else tuned
    names = []
    for feature_set, df in feature_sets.items():
        rows = registry.save_features(feature_set, df)
        fit_rows = rows.filter(F.col(train)).cache()
        for kind in classifiers:
            extra = {"c": tuned.get(feature_set, 1.0)} if kind == "logit" else {}
            model = FITTERS[kind](fit_rows, label, **extra, **options.get(kind, {}))
            name = f"{feature_set}_base" if kind == "logit_base" else f"{feature_set}_{kind}"
            registry.save_model(name, feature_set, model)
            names.append(name)
        fit_rows.unpersist()
    return names


def score_table(registry: Registry, names: Sequence[str], key: str, label: str) -> DataFrame:
    """Scores of all models on both splits as one long table."""
    parts = []
    for name in names:
        model, df = registry.load(name)
        split = F.when(F.col("train"), "train").when(F.col("test"), "test")
        rows = df.withColumn("split", split).filter(F.col("split").isNotNull())
        parts.append(
            score(model, rows, [key, "split", F.col(label).cast("int").alias("y")]).withColumn("model", F.lit(name))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_probabilities(scores: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Wide table of train probabilities, one column per model that is no baseline."""
    kept = [n for n in names if not n.startswith("baseline")]
    rows = scores.filter((F.col("split") == "train") & F.col("model").isin(kept))
    return rows.groupBy(key).pivot("model", kept).agg(F.first("p"))
