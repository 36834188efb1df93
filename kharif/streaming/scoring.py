"""Continuous request scoring with Structured Streaming.

New request files land in a directory; each micro-batch is normalised,
validated, joined (stream-static, left outer) with the latest feature rows
and expanded into weekly forecast rows.  The operator is stateless, so no
watermark is needed and output mode is append.  Progress is kept in a
checkpoint location under the shared folder, so a restarted query resumes
where it stopped.

``run_batches`` writes forecasts and rejected requests of each micro-batch under
the batch's number, so a batch that runs again after a failure replaces what it
wrote before: accepted and rejected requests together are the input, once.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.operators import forecast
from kharif.plans import jobs
from kharif.plans.model import TrainedModel
from kharif.schema import FORECAST_REQUEST_SCHEMA


def request_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet request files arriving in ``directory`` (schema fixed); a limit
    a trigger only where the caller sets one."""
    reader = spark.readStream.schema(FORECAST_REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def score_requests(requests: DataFrame, anchors: DataFrame, run_date: str) -> tuple[DataFrame, DataFrame]:
    """(forecast rows, rejected requests).  ``anchors`` is a static frame with
    one row per (market, crop, feature_date) and an ``anchor_price`` column."""
    validated = forecast.validate_requests(forecast.normalise_requests(requests), run_date)
    acc = forecast.accepted(validated).select("request_id", "market", "state", "crop", "variety", "horizon_weeks", "as_of")
    joined = forecast.asof_join(acc, anchors, ["market", "crop"], "as_of", "feature_date")
    return forecast.with_fallback(forecast.forecast_weeks(forecast.with_price_anchors(joined))), forecast.rejected(validated)


def score_stream(requests: DataFrame, anchors: DataFrame, run_date: str) -> DataFrame:
    """Streaming forecast rows of the accepted requests."""
    rows, _ = score_requests(requests, anchors, run_date)
    return rows.select(
        "request_id", "week", "forecast_date", "modal_price", "min_price", "max_price",
        F.col("confidence_interval.lower").alias("ci_lower"), F.col("confidence_interval.upper").alias("ci_upper"), "source",
    )


Scorer = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def model_scorer(feature_rows: DataFrame, model: TrainedModel, run_date: str) -> Scorer:
    """The forecast job (M12) as the scorer of a micro-batch."""

    def scorer(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows, _, rejected = jobs.forecast_job(requests, feature_rows, model, run_date)
        return rows, rejected

    return scorer


def write_batch(score: Scorer, output: str) -> Callable[[DataFrame, int], None]:
    """The sink of a micro-batch: overwrites ``accepted/batch=n`` and
    ``rejected/batch=n`` below ``output``."""

    def write(batch: DataFrame, number: int) -> None:
        rows, rejected = score(batch)
        for name, part in (("accepted", rows), ("rejected", rejected)):
            part.write.mode("overwrite").parquet(os.path.join(output, name, f"batch={number}"))

    return write


def run_batches(requests: DataFrame, score: Scorer, output: str, checkpoint: str) -> None:
    """Score everything available now, batch by batch, then stop."""
    sink = write_batch(score, output)
    requests.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accepted_rows(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(os.path.join(output, "accepted"))


def rejected_rows(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(os.path.join(output, "rejected"))


def run_to_table(stream_rows: DataFrame, output_path: str, checkpoint_path: str) -> None:
    """Process everything available now into Parquet files, then stop."""
    q = (
        stream_rows.writeStream.format("parquet")
        .option("path", output_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
