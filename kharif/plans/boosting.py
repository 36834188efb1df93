"""Boosting in stages with a patience, and several fits at once (M3, M5, M7).

Spark's own early stopping ends at the first tree that gains too little.  Here
the ensemble grows in stages of ``stage_trees`` trees: each stage is a
``GBTRegressor`` fitted to what the stages before left over, and
``evaluateEachIteration`` gives the error of the held rows after every tree.
Growth ends when the best tree lies ``patience`` trees back; trees after the
best one go (the stage that holds it is fitted again with as many trees, from
the same seed and rows).  What a stage leaves over is a written table, so a lost
executor costs at most the stage at work, and plans do not grow with the trees.
As in Spark's boosting the first tree of a stage enters whole, the others at
the learning rate.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.session import cut_lineage

K, V = TypeVar("K", bound=Hashable), TypeVar("V")


def regressor(params, trees: int, seed: int, label: str) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=label, predictionCol="prediction",
        maxIter=trees, stepSize=params.step_size, maxDepth=params.max_depth, subsamplingRate=params.subsample,
        featureSubsetStrategy=params.feature_subset, maxBins=params.max_bins, seed=seed,
    )


def grow(rows: DataFrame, label: str, held: str, params) -> tuple[list[GBTRegressionModel], list[float]]:
    """(stages, squared error of the held rows after each tree grown, those
    dropped later included).  ``rows`` has ``features``; where ``held`` is not
    true a row is learned from.  Without held rows all trees are grown."""
    left = rows.select("features", F.col(label).cast("double").alias("__left"), F.coalesce(F.col(held), F.lit(False)).alias("__held"))
    left = cut_lineage(left, "boosting")
    if left.where("__held").isEmpty():
        return [regressor(params, params.max_iter, params.seed, "__left").fit(left)], []
    frames, stages, errors, best = [], [], [], 0
    while True:
        frames.append(left)
        size = min(params.stage_trees, params.max_iter - len(errors))
        stage = regressor(params, size, params.seed + len(errors), "__left").fit(left.where("not __held"))
        stages.append(stage)
        errors += stage.evaluateEachIteration(left.where("__held"), "squared")
        best = min(range(len(errors)), key=errors.__getitem__)
        if len(errors) >= params.max_iter or len(errors) - 1 - best >= params.patience:
            break
        rest = (F.col("__left") - F.col("prediction")).alias("__left")
        left = cut_lineage(stage.transform(left).select("features", rest, "__held"), "boosting")
    last, trees = divmod(best, params.stage_trees)
    stages = stages[: last + 1]
    if stages[last].getNumTrees > trees + 1:
        first = params.seed + last * params.stage_trees
        stages[last] = regressor(params, trees + 1, first, "__left").fit(frames[last].where("not __held"))
    return stages, errors


def fit_all(spark: SparkSession, fits: dict[K, Callable[[], V]], parallelism: int = 4) -> dict[K, V]:
    """The results of ``fits``, up to ``parallelism`` of them run at once, each
    in a scheduler pool of its own.  The first error is raised."""

    def one(key: K) -> V:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{key}")
        return fits[key]()

    if not fits:
        return {}
    with ThreadPoolExecutor(max_workers=min(parallelism, len(fits))) as pool:
        return dict(zip(fits, pool.map(inheritable_thread_target(spark)(one), fits)))
