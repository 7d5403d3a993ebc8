"""Fitted experts on Spark ML, and the seam for scoring with anything else."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifespan.config import Boosting
from lifespan.fixed_values import MEMBER_SEEDS
from lifespan.functions.scalar import clip_unit


def as_vectors(df: DataFrame, features: str, label: str | None = None, rmax: float = 1.0) -> DataFrame:
    """Vector column for Spark ML; the label is scaled by the life scale."""
    out = df.withColumn("__x", array_to_vector(F.col(features)))
    return out if label is None else out.withColumn("__y", F.col(label) / F.lit(rmax))


def _booster(trees: int, leaves: int, bins: int, min_leaf: int, rate: float, seed: int, share: float = 1.0):
    return GBTRegressor(
        featuresCol="__x",
        labelCol="__y",
        predictionCol="__p",
        lossType="squared",
        maxIter=trees,
        maxDepth=max(1, math.ceil(math.log2(leaves))),
        maxBins=bins,
        minInstancesPerNode=min_leaf,
        stepSize=rate,
        seed=seed,
        subsamplingRate=share,
        maxMemoryInMB=1024,
        checkpointInterval=10,
    )


def fit_tree_expert(train: DataFrame, features: str, label: str, rmax: float, b: Boosting, seed: int = 17) -> Model:
    """Squared-loss boosted trees.  Depth stands in for the leaf limit."""
    data = as_vectors(train, features, label, rmax).select("__x", "__y")
    return _booster(b.trees, b.leaves, b.bins, b.min_leaf, b.rate, seed).fit(data)


def fit_direct_expert(
    train: DataFrame,
    val: DataFrame | None,
    features: str,
    label: str,
    rmax: float,
    seed: int,
    rounds: int,
    rate: float = 0.1,
    leaves: int = 8,
    share: float = 0.8,
) -> Model:
    """One member on the direct features; with ``val`` the rounds stop early, else they are fixed."""
    data = as_vectors(train, features, label, rmax).select("__x", "__y", F.lit(False).alias("__val"))
    booster = _booster(rounds, leaves, 64, 5, rate, seed, share)
    if val is not None:
        held = as_vectors(val, features, label, rmax).select("__x", "__y", F.lit(True).alias("__val"))
        booster = booster.setValidationIndicatorCol("__val")
        booster.set(booster.validationTol, 1e-4)
        data = data.unionByName(held)
    return booster.fit(data)


def fit_shared_expert(source: DataFrame, features: str, label: str, rmax: float, l2: float = 1e-3) -> Model:
    """Linear expert on invariant features of source windows; joins the blend by its weight."""
    data = as_vectors(source, features, label, rmax).select("__x", "__y")
    return LinearRegression(
        featuresCol="__x", labelCol="__y", predictionCol="__p", regParam=l2, solver="l-bfgs", maxIter=50
    ).fit(data)


def score(df: DataFrame, model: Model, features: str, name: str) -> DataFrame:
    """Score of a Spark ML model as one more column."""
    return model.transform(as_vectors(df, features)).withColumnRenamed("__p", name).drop("__x")


def score_external(df: DataFrame, predict: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Score with any function over Arrow batches (a model loaded on the executor)."""
    return df.mapInPandas(predict, schema)


@dataclass
class Members:
    """Everything needed to score: one tree model and one direct model per seed."""

    tree: Model
    direct: dict[int, Model]
    shared: Model | None = None
    shared_weight: float = 0.0

    def predictor(self, tree_features: str, direct_features: str, invariant_features: str | None = None):
        """Predictor for ``plans.scoring``: adds ``tree_<seed>`` and ``direct_<seed>``."""

        def run(windowed: DataFrame) -> DataFrame:
            out = score(windowed, self.tree, tree_features, "__tree")
            use_shared = self.shared is not None and self.shared_weight > 0 and invariant_features
            if use_shared:
                out = score(out, self.shared, invariant_features, "__shared")
            for seed, model in self.direct.items():
                out = score(out, model, direct_features, f"__direct_{seed}")
                value = F.col(f"__direct_{seed}")
                if use_shared:
                    value = (1.0 - self.shared_weight) * value + self.shared_weight * F.col("__shared")
                out = out.withColumn(f"direct_{seed}", clip_unit(value)).withColumn(f"tree_{seed}", F.col("__tree"))
            return out

        return run


def select_rounds(
    train: DataFrame, val: DataFrame, features: str, label: str, rmax: float, rounds: int
) -> tuple[dict[int, int], int]:
    """Rounds each seed stops at on the validation units, and their median."""
    chosen = {
        seed: fit_direct_expert(train, val, features, label, rmax, seed, rounds).getNumTrees for seed in MEMBER_SEEDS
    }
    return chosen, sorted(chosen.values())[len(chosen) // 2]


def refit_plan(
    train: DataFrame,
    val: DataFrame,
    direct_features: str,
    tree_features: str,
    label: str,
    rmax: float,
    boosting: Boosting,
    rounds: int,
) -> tuple[Members, Members, dict[int, int]]:
    """Members fitted on train alone, then on train and validation with frozen rounds.

    The windows are read once per boosting round, so both parts are written to the
    shared folder first.
    """
    from lifespan.sources.storage import cut_lineage

    train, val = cut_lineage(train), cut_lineage(val)
    chosen, frozen = select_rounds(train, val, direct_features, label, rmax, rounds)
    selection = Members(
        fit_tree_expert(train, tree_features, label, rmax, boosting),
        {s: fit_direct_expert(train, None, direct_features, label, rmax, s, n) for s, n in chosen.items()},
    )
    union = train.unionByName(val)
    final = Members(
        fit_tree_expert(union, tree_features, label, rmax, boosting),
        {s: fit_direct_expert(union, None, direct_features, label, rmax, s, frozen) for s in MEMBER_SEEDS},
    )
    return selection, final, chosen
