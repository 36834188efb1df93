"""Retraining from a path, and publishing whole models only.

``retrain`` loads observations by the contract, trains the asked model type,
writes the model below ``versions``, reads it back and compares its scores with
those of the model in memory, and only then appends one row to the pointer
table ``published``.  Readers take the row of the highest number, so they never
see half a model; a run that fails anywhere before leaves the pointer as it was.
"""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.plans import jobs, model
from kharif.schema import TARGET
from kharif.sources import io

POINTER = "sequence long, version string, model_type string, data_path string, rmse double, published_at timestamp"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The pointer table, one row a published version; empty if there is none."""
    try:
        return spark.read.schema(POINTER).parquet(os.path.join(root, "published"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def current(spark: SparkSession, root: str) -> model.TrainedModel:
    """The published model; raises where none is."""
    row = published(spark, root).orderBy(F.desc("sequence"), F.desc("version")).first()
    if row is None:
        raise LookupError(f"no published model below {root}")
    return model.load_model(spark, os.path.join(root, "versions", row["version"]))


def stage(result: jobs.TrainingResult, root: str) -> str:
    """The model and its run summary as a new version; its name."""
    version = uuid.uuid4().hex
    path = os.path.join(root, "versions", version)
    model.save_model(result.model, path)
    jobs.write_summary(result, os.path.join(path, "summary"))
    return version


def check(spark: SparkSession, result: jobs.TrainingResult, root: str, version: str) -> float:
    """RMSE of the version as read back, on the test rows; raises if there are
    none or a score differs from that of the model in memory."""
    loaded = model.load_model(spark, os.path.join(root, "versions", version))
    both = model.score(loaded, result.test_scored.withColumnRenamed("prediction", "__own"))
    same = F.abs(F.col("prediction") - F.col("__own")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("__own"))
    told = both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("bad"),
        F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(TARGET), 2))).alias("rmse"),
    ).first()
    if not told["n"] or told["bad"]:
        raise ValueError(f"version {version} is not published: {told['bad']} of {told['n']} test rows score unlike the trained model")
    return told["rmse"]


def publish(spark: SparkSession, root: str, version: str, model_type: str, data_path: str, rmse: float) -> None:
    """Append the pointer row, one file that is there whole or not at all."""
    last = published(spark, root).agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last")).first()["last"]
    row = spark.createDataFrame([(last + 1, version, model_type, data_path, rmse)], POINTER.rsplit(",", 1)[0])
    row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(os.path.join(root, "published"))


def retrain(spark: SparkSession, data_path: str, root: str, model_type: str = "gbt", fmt: str = "csv",
            params: model.GBTParams | None = None) -> jobs.TrainingResult:
    """Load, train, stage, check, publish.  An unknown type is refused before
    anything is read."""
    model.trainer(model_type)
    result = jobs.training_job(io.load_observations(spark, data_path, fmt), params, model_type=model_type)
    version = stage(result, root)
    publish(spark, root, version, model_type, data_path, check(spark, result, root, version))
    return result
