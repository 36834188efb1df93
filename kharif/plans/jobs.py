"""Batch jobs: training (M11 with S6, S8) and forecasting.

Stages that later branches read more than once are written to the shared
checkpoint folder (``cut_lineage``): the observation table and the weekly
feature table.  Everything between is one lazy plan.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kharif.operators import clean, evaluate, features, forecast, rollup, split
from kharif.operators.joins import null_safe_join
from kharif.plans.feature_chain import ONE_HOT, FeatureChain, FeatureChainModel
from kharif.plans.model import GBTParams, TrainedModel, score, trainer, with_validation_flag
from kharif.schema import TARGET
from kharif.session import cut_lineage, fitted

SERIES_ID = ["date", "market", "crop", "variety", "state", "district"]


@dataclass
class TrainingResult:
    model: TrainedModel
    frame: DataFrame          # prepared features with ``split``
    test_scored: DataFrame    # test rows with ``prediction`` and ``naive``
    metrics: DataFrame        # A12 on the test rows per crop, of the model and of the lag-1 forecast
    summary: DataFrame        # S8 stage counts, observed while the stages were written


def train_cutoff(obs: DataFrame, train_fraction: float = 0.8, freq: str = "weekly") -> DataFrame:
    """(crop, cutoff_day): the date quantile of each crop's periodic rows, found
    before anything is fitted (cleaning keeps all rows and dates)."""
    label = rollup.period_label(freq)
    rows = obs.select(*[c for c in SERIES_ID if c != "date"], label.alias("date")).distinct()
    return fitted(rows.groupBy("crop").agg(F.percentile(F.unix_date("date"), train_fraction).alias("cutoff_day")), "cutoff")


def with_split(rows: DataFrame, cutoff: DataFrame, day=None) -> DataFrame:
    day = F.unix_date("date") if day is None else day
    met = null_safe_join(rows, cutoff, ["crop"], how="left")
    return met.withColumn("split", F.when(day <= F.col("cutoff_day"), "train").otherwise("test"))


def prepare_model_frame(obs: DataFrame, train_fraction: float | None = 0.8, exclude_current: bool = True, warmup: str = "drop") -> tuple[DataFrame, list[str], FeatureChainModel]:
    """A written observation table -> model rows with ``split`` and one-hot
    indexes, their numeric columns, and the chain that made them.

    The chain is fitted on the train rows alone (caps, medians, codes,
    vocabulary) and then applied to all; ``train_fraction`` None fits it on all
    rows.  Models of the current price need ``exclude_current``: a rolling mean
    over the row's own price would give its target away."""
    chain = FeatureChain(excludeCurrent=exclude_current, warmup=warmup)
    if train_fraction is None:
        fitted_chain, rows = chain.fit_rows(obs, stored=True)
    else:
        cutoff = train_cutoff(obs, train_fraction)
        known = with_split(obs, cutoff, F.unix_date(rollup.period_label("weekly"))).where("split = 'train'").select(*obs.columns)
        fitted_chain, _ = chain.fit_rows(known)
        rows = with_split(clean.drop_null_target(fitted_chain.transform(obs)), cutoff)
    cols = features.feature_columns(rows)
    return fitted_chain.indexed(rows), cols, fitted_chain


def training_job(
    obs: DataFrame,
    params: GBTParams | None = None,
    split_mode: str = "temporal",
    validation_fraction: float = 0.1,
    model_type: str = "gbt",
) -> TrainingResult:
    """Observations -> features -> split -> model (GBT with early stopping
    on a frame cut from the train range, or another of ``MODEL_TYPES``) -> test
    metrics and run summary."""
    train_model = trainer(model_type)
    read, made = Observation("observations"), Observation("model-frame")
    obs = cut_lineage(obs.observe(read, *counted()), "observations")
    if split_mode == "temporal":
        mf, cols, chain = prepare_model_frame(obs)
        framed = mf.drop("cutoff_day")
    elif split_mode == "positional":
        # Split by market order, which no observation shows before the chain has run.
        mf, cols, chain = prepare_model_frame(obs, None)
        framed = split.positional_split(mf).drop("row_index", "group_rows")
    else:
        raise ValueError("split_mode must be 'temporal' or 'positional'")
    framed = cut_lineage(framed.observe(made, *counted(True)), "model-frame")
    train = framed.where(F.col("split") == "train")
    test = framed.where(F.col("split") == "test")
    vcol = None
    if validation_fraction > 0:
        train = with_validation_flag(train, validation_fraction)
        vcol = "is_validation"
    model = train_model(train, cols, TARGET, params, vcol, chain)
    test_scored = score(model, test).withColumn("naive", F.col("lag_1"))
    metrics = None
    for name, pred in (("gbt", "prediction"), ("lag_1", "naive")):
        told = evaluate.error_metrics(test_scored.select("crop", F.col(TARGET).alias("y_true"), F.col(pred).alias("y_pred")), ("crop",))
        told = told.withColumn("forecast", F.lit(name))
        metrics = told if metrics is None else metrics.unionByName(told)
    summary = run_summary(framed.sparkSession, read.get, made.get, made.get)
    return TrainingResult(model, framed, test_scored, metrics, summary)


def counted(split: bool = False) -> list:
    """Aggregates to ``observe`` while a stage is written."""
    parts = [F.count_if(F.col("split") == name).alias(name) for name in ("train", "test")] if split else []
    return [F.count(F.lit(1)).alias("records"), *parts]


def run_summary(spark, read: dict, processed: dict, framed: dict) -> DataFrame:
    """(stage, records) from what was observed of the written observations,
    processed rows and model frame; no scan of its own."""
    rows = [
        ("original_records", read["records"]), ("processed_records", processed["records"]),
        ("train_samples", framed["train"]), ("test_samples", framed["test"]),
    ]
    return spark.createDataFrame(rows, "stage string, records long")


def write_summary(result: TrainingResult, path: str) -> DataFrame:
    """One JSON document of the run: date, settings, records by stage,
    features and the models trained.  Returns it as read back."""
    spark, m = result.frame.sparkSession, result.model
    info = F.map_from_entries(F.collect_list(F.struct("stage", "records"))).alias("data_info")  # four rows
    names = F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("n")  # one document by nature
    doc = result.summary.agg(info).crossJoin(m.names(spark).agg(names)).select(
        F.lit(m.trained_at).alias("training_date"),
        F.struct(*[F.lit(v).alias(k) for k, v in asdict(m.params).items()], F.lit(m.target).alias("target")).alias("config"),
        F.struct(*[F.col("data_info")[k].alias(k) for k in ("original_records", "processed_records", "train_samples", "test_samples")]).alias("data_info"),
        F.struct(F.size("n").alias("total_features"), F.col("n.feature").alias("feature_list")).alias("feature_info"),
        F.array(F.lit(m.model_type)).alias("models_trained"),
    )
    doc.coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema(doc.schema).json(path)


# -------------------------------------------------------------------------- M12
def forecast_job(
    requests_raw: DataFrame,
    feature_rows: DataFrame,
    model: TrainedModel,
    run_date: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests -> validation -> as-of features -> model anchor -> weekly
    rows with bands (rule fallback) -> nested responses.

    Returns (flat rows, nested responses, rejected requests)."""
    validated = forecast.validate_requests(forecast.normalise_requests(requests_raw), run_date)
    acc = forecast.accepted(validated).select(
        "request_id", "market", "state", "crop", "variety", "horizon_weeks", "as_of"
    )
    cols = [*model.feature_columns, *([f"{c}_index" for c in ONE_HOT] if model.chain is not None else [])]
    joined = forecast.asof_features(acc, feature_rows, cols)
    have = joined.where(F.col("feature_date").isNotNull())
    scored = score(model, have).withColumnRenamed("prediction", "anchor_price")
    missing = joined.where(F.col("feature_date").isNull()).withColumn("anchor_price", F.lit(None).cast("double"))
    keep = ["request_id", "market", "state", "crop", "variety", "horizon_weeks", "as_of", "feature_date", "anchor_price"]
    anchored = scored.select(*keep).unionByName(missing.select(*keep))
    rows = forecast.with_fallback(forecast.forecast_weeks(forecast.with_price_anchors(anchored)))
    return rows, forecast.nest_response(rows), forecast.rejected(validated)
