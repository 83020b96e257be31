"""The model ladder on the distributed learners of the platform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortry.functions.columns import keyed_md5, uniform


def fit_logit(train: DataFrame, c: float = 1.0, label: str = "y", features: str = "features", max_iter: int = 100):
    """L2 logistic model on standardised features; ``c`` is the inverse penalty over the whole sample."""
    n = train.count()
    return LogisticRegression(labelCol=label, featuresCol=features, maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=True).fit(train)


def fit_gbt(train: DataFrame, key: str, seed: int, label: str = "y", features: str = "features", max_iter: int = 500, depth: int = 3, hold_out: float = 0.15):
    """Boosted trees with early stopping on a keyed hold-out of the training rows.

    The learner's own seed only matters with subsampling, so a seed changes both the hold-out and
    the subsample.
    """
    rows = train.withColumn("_held", uniform(keyed_md5(seed, "holdout", F.col(key))) < hold_out)
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=max_iter, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed, validationIndicatorCol="_held").fit(rows)


def scored(model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Kept columns and the positive-class probability."""
    return model.transform(rows).select(*keep, F.round(vector_to_array("probability")[1], 12).alias("score"))


def staged(model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Score after every boosting round: prefix sums over the trees, one row per (row, round)."""
    out = rows
    names = []
    for i, tree in enumerate(model.trees):
        name = f"_t{i}"
        names.append(name)
        out = tree.copy().setFeaturesCol("features").setPredictionCol(name).transform(out)
    terms = F.array(*[F.col(n) * F.lit(float(w)) for n, w in zip(names, model.treeWeights)])
    rounds = F.transform(F.sequence(F.lit(1), F.lit(len(names))), lambda r: F.struct(
        r.alias("round"), F.round(F.aggregate(F.slice("_terms", F.lit(1), r), F.lit(0.0), lambda a, b: a + b), 12).alias("score")))
    return out.withColumn("_terms", terms).select(*keep, F.explode(rounds).alias("_r")).select(*keep, "_r.round", "_r.score")
