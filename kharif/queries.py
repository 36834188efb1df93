"""

Each query takes ``(spark, sf_dir)``, reads the driver's tables through the
domain views and returns a DataFrame whose double columns are passed through
``present`` (4-decimal rounding off exact ties) so results compare across
engines.  Library operators themselves never round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from kharif.functions.numeric import present
from kharif.functions import pricing
from kharif.functions.calendar import is_weekend
from kharif.operators import clean, evaluate, features, forecast, quality, reports, rollup, split
from kharif.plans import chain
from kharif.session import cut_lineage, shared_path
from kharif.plans import jobs, model, registry
from kharif.plans.feature_chain import FeatureChain
from kharif.sources import io
from kharif.streaming import scoring
from kharif.schema import FEATURE_ORDER, FLAG_COLS, MEDIAN_FILL_COLS, PRICE_COLS, REQUIRED_COLUMNS
from kharif.sources import dims, fixtures
from kharif.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn

    return deco


KEYS6 = ["date", "state", "district", "market", "crop", "variety"]


def obs(spark, sf_dir):
    """Lazy observation view: single-use queries keep filter / column pushdown."""
    return fixtures.observations(spark, sf_dir)


def obs_table(spark, sf_dir):
    """Observation view written once to the shared checkpoint folder.

    Chains read it several times (series fills, quantile bounds, encoder and
    median fits); without the cut each branch would rescan and rejoin the
    line items."""
    return cut_lineage(fixtures.observations(spark, sf_dir))


def daily_clean(spark, sf_dir):
    return chain.clean_daily(obs_table(spark, sf_dir), stored=True)


def weekly(spark, sf_dir):
    return chain.weekly_table(obs_table(spark, sf_dir), stored=True)


def targets(spark, sf_dir):
    """Weekly rows that have a target: the rows of the model frame, without its
    fitted features."""
    return clean.drop_null_target(weekly(spark, sf_dir))


def weekly_features(spark, sf_dir):
    o = obs_table(spark, sf_dir)
    return chain.series_features(chain.weekly_table(o, stored=True), sizes_from=o)


# ------------------------------------------------------------------ sources
@query("s1_load_observations")
def s1(spark, sf_dir):
    """Observation table with the 15-column contract."""
    return obs(spark, sf_dir)


# ------------------------------------------------------------------ cleaning
@query("w1_fill_prices")
def w1(spark, sf_dir):
    """Forward then backward fill of prices per (market, crop, variety)."""
    return clean.impute(obs(spark, sf_dir)).select(*KEYS6, *PRICE_COLS)


@query("a4_group_medians")
def a4(spark, sf_dir):
    """Median of arrivals, rain, temperature, acreage per series."""
    return clean.series_medians(obs(spark, sf_dir)).withColumnsRenamed({f"__med_{c}": c for c in MEDIAN_FILL_COLS})


@query("j7_median_fill")
def j7(spark, sf_dir):
    """Series medians broadcast back to fill NULL arrivals, rain, temperature, acreage."""
    return clean.impute(obs(spark, sf_dir)).select(*KEYS6, *MEDIAN_FILL_COLS)


@query("p6_winsorize")
def p6(spark, sf_dir):
    """Prices capped at per-crop q05/q95 +- 1.5 x range, after imputation."""
    return daily_clean(spark, sf_dir).select(*KEYS6, *PRICE_COLS)


@query("p6_winsorize_report")
def p6_report(spark, sf_dir):
    """Bounds of the modal price per crop and the rows that they cap."""
    imputed = cut_lineage(clean.impute(obs_table(spark, sf_dir), stored=True), "imputed")
    return clean.winsorize_report(imputed, ["modal_price"], ("crop",), stored=True)


# ------------------------------------------------------------------ roll-up
@query("a1_weekly_rollup")
def a1(spark, sf_dir):
    return weekly(spark, sf_dir)


@query("a2_monthly_rollup")
def a2(spark, sf_dir):
    return chain.weekly_table(obs_table(spark, sf_dir), freq="monthly", stored=True)


@query("a3_daily_passthrough")
def a3(spark, sf_dir):
    return rollup.rollup(daily_clean(spark, sf_dir), "daily")


# ------------------------------------------------------------------ windows
SERIES_ID = ["date", "market", "crop", "variety", "state", "district"]


@query("w2_target_lags")
def w2(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "lag_1", "lag_2", "lag_4", "lag_12")


@query("w3_arrival_lags")
def w3(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "arrival_lag_1", "arrival_lag_2", "arrival_lag_4", "arrival_lag_12")


@query("w4_rolling_mean")
def w4(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "rolling_mean_4", "rolling_mean_12")


@query("w5_rolling_std")
def w5(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "rolling_std_4", "rolling_std_12")


@query("w6_arrival_rolling_mean")
def w6(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "arrival_rolling_mean_4", "arrival_rolling_mean_12")


# ------------------------------------------------------------------ checks
@query("s2_schema_contract")
def s2(spark, sf_dir):
    """Observation frame after the required-column check (raises when one is missing)."""
    return quality.check_schema(obs(spark, sf_dir)).select(*REQUIRED_COLUMNS)


@query("s3_violations")
def s3(spark, sf_dir):
    return quality.violations(obs(spark, sf_dir))


@query("a5_quality_profile")
def a5(spark, sf_dir):
    return quality.quality_profile(obs_table(spark, sf_dir), stored=True)


@query("a6_load_profile")
def a6(spark, sf_dir):
    return quality.load_profile(obs(spark, sf_dir))


# ------------------------------------------------------------------ filters / fills
@query("p1_filter_crop")
def p1(spark, sf_dir):
    return clean.require_crop(obs(spark, sf_dir), "rice")


@query("p2_fill_flags")
def p2(spark, sf_dir):
    return clean.fill_flags(obs(spark, sf_dir)).select(*KEYS6, *FLAG_COLS)


@query("p3_zero_fill_report")
def p3(spark, sf_dir):
    """NULLs left after the series fills, i.e. the values the zero fill replaces."""
    imputed = clean.impute(obs(spark, sf_dir), zero_fill=False)
    return clean.null_counts(imputed, clean.numeric_columns(imputed))


@query("p4_replace_infinite")
def p4(spark, sf_dir):
    """A ratio that is infinite for zero-tax line items, with +-inf -> 0."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_tax")
    ratio = li.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("tax_ratio"),
    )
    return clean.replace_infinite(ratio, ["tax_ratio"])


@query("p5_drop_null_target")
def p5(spark, sf_dir):
    return clean.require_rows(clean.drop_null_target(obs(spark, sf_dir))).select(*KEYS6, "modal_price")


def mixed_text(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "props")
    text = (
        F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string"))
        .when(F.col("event_id") % 3 == 1, F.col("event_type"))
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" ")))
    )
    return ev.select("event_id", text.alias("reading"), F.col("props"))


@query("p7_coerce_numeric")
def p7(spark, sf_dir):
    return clean.coerce_numeric(mixed_text(spark, sf_dir), ["reading", "props"])


@query("p8_median_fill")
def p8(spark, sf_dir):
    """Warm-up NULLs of lags and rolling std filled with the crop's column median."""
    cols = ["lag_1", "lag_12", "arrival_lag_4", "rolling_std_4", "rolling_std_12"]
    f = weekly_features(spark, sf_dir).select(*SERIES_ID, *cols)
    return clean.fill_median(f, cols, group_keys=("crop",))


# ------------------------------------------------------------------ exploratory
@query("o1_sorted_output")
def o1(spark, sf_dir):
    return reports.sort_for_output(obs(spark, sf_dir))


@query("o3_sample_market")
def o3(spark, sf_dir):
    return reports.first_market(obs(spark, sf_dir))


@query("a14_price_by_date")
def a14a(spark, sf_dir):
    return reports.price_by_date_for_sample(obs_table(spark, sf_dir))


@query("a14_price_by_month")
def a14b(spark, sf_dir):
    return reports.price_by_month(obs(spark, sf_dir))


@query("a14_price_by_state")
def a14c(spark, sf_dir):
    return reports.price_by_state(obs(spark, sf_dir))


@query("a15_price_histogram")
def a15(spark, sf_dir):
    return reports.histogram(obs_table(spark, sf_dir))


@query("a17_crop_comparison")
def a17(spark, sf_dir):
    return reports.crop_comparison(weekly(spark, sf_dir))


@query("a18_market_trend")
def a18(spark, sf_dir):
    return reports.market_trend(weekly(spark, sf_dir))


# ------------------------------------------------------------------ calendar / encoders
@query("f1_calendar_parts")
def f1(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "year", "month", "quarter")


@query("f2_iso_week_weekday")
def f2(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "week_of_year", "day_of_week")


@query("f3_cyclic_month")
def f3(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "month_sin", "month_cos")


@query("f10_weekend_flag")
def f10(spark, sf_dir):
    return obs(spark, sf_dir).select(*KEYS6, is_weekend("date").alias("weekend_flag"))


@query("j1_harvest_flag")
def j1(spark, sf_dir):
    return weekly_features(spark, sf_dir).select(*SERIES_ID, "is_harvest_month")


@query("a7_target_encoder_fit")
def a7(spark, sf_dir):
    wk = weekly(spark, sf_dir)
    m = features.fit_target_encoder(wk, "market").withColumn("encoded_column", F.lit("market"))
    s = features.fit_target_encoder(wk, "state").withColumn("encoded_column", F.lit("state"))
    return m.unionByName(s)


@query("j2_target_encode")
def j2(spark, sf_dir):
    rows = cut_lineage(weekly_features(spark, sf_dir), "weekly-features")
    enc = chain.encode(rows, vocabulary=[])
    return enc.select(*SERIES_ID, "market_encoded", "state_encoded")


@query("a8_variety_vocabulary")
def a8(spark, sf_dir):
    return features.category_vocabulary(weekly(spark, sf_dir), "variety")


@query("m1_one_hot_variety")
def m1(spark, sf_dir):
    """One-hot columns checked as (active position, width, row sum)."""
    wk = weekly(spark, sf_dir)
    vocab = features.collect_vocabulary(wk, "variety")
    oh = features.one_hot(wk, "variety", vocab)
    cols = [f"variety_{v}" for v in vocab]
    position = F.lit(0)
    for i, c in enumerate(cols, start=1):
        position = F.when(F.col(c) == 1.0, F.lit(i)).otherwise(position)
    total = F.lit(0.0)
    for c in cols:
        total = total + F.col(c)
    return oh.select(*SERIES_ID, position.alias("onehot_position"), F.lit(len(cols)).alias("onehot_width"), total.alias("onehot_sum"))


@query("a9_frequency_table")
def a9(spark, sf_dir):
    return clean.frequency_table(obs_table(spark, sf_dir), "variety")


@query("j3_frequency_encode")
def j3(spark, sf_dir):
    o = obs_table(spark, sf_dir)
    return clean.frequency_encode(o, "variety", out="variety_frequency").select(*KEYS6, "variety_frequency")


def model_frame(spark, sf_dir):
    """Keys + prepared feature columns (without one-hot) + target, the chain
    fitted on the same rows; its numeric columns; the fitted chain."""
    fitted_chain, rows = FeatureChain().fit_rows(obs_table(spark, sf_dir), stored=True)
    return rows, features.feature_columns(rows), fitted_chain


@query("p9_feature_columns")
def p9(spark, sf_dir):
    """Selected feature names with their position: the numeric ones from the
    schema of an unfitted chain, then one for each variety."""
    o = obs(spark, sf_dir)
    names = features.feature_columns(chain.unfitted_schema(o))
    words = features.category_vocabulary(o, "variety").select(
        (F.row_number().over(Window.orderBy("variety")) + len(names)).alias("position"), F.concat(F.lit("variety_"), "variety").alias("column_name"))
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position int, column_name string").unionByName(words)


@query("a10_feature_summary")
def a10(spark, sf_dir):
    mf, cols, _ = model_frame(spark, sf_dir)
    return features.feature_summary(mf, cols)


@query("a11_scaler_fit")
def a11(spark, sf_dir):
    _, cols, fitted_chain = model_frame(spark, sf_dir)
    return features.scaler_table(fitted_chain.state["scaler"], cols, ("crop",))


@query("m2_apply_scaler")
def m2(spark, sf_dir):
    mf, cols, fitted_chain = model_frame(spark, sf_dir)
    scaled = features.apply_scaler(mf, cols, fitted_chain.state["scaler"], ("crop",))
    return scaled.select(*SERIES_ID, "lag_1", "rolling_mean_4", "arrival_qty", "market_encoded", "day_of_week")


@query("m10_feature_pipeline")
def m10(spark, sf_dir):
    """Feature chain fitted on the observations, and the rows it makes of them
    (S6 saves and loads a chain): keys, prepared features, target."""
    return model_frame(spark, sf_dir)[0]


# ------------------------------------------------------------------ horizons / splits
@query("w7_horizon_targets")
def w7(spark, sf_dir):
    return split.horizon_targets(targets(spark, sf_dir).select(*SERIES_ID, "modal_price")).select(*SERIES_ID, "horizon", "target_future")


@query("w8_sequences")
def w8(spark, sf_dir):
    rows = weekly_features(spark, sf_dir).select(*SERIES_ID, "modal_price", "arrival_qty", "lag_1")
    mf = chain.prepare_training(rows, ["arrival_qty", "lag_1"])
    seq = split.sequences(mf, ["modal_price", "arrival_qty", "lag_1"], 12)
    return seq.select(*SERIES_ID, "target", F.posexplode("sequence").alias("step", "row")).select(
        *SERIES_ID, "target", "step", *[F.col("row")[i].alias(c) for i, c in enumerate(("price", "arrivals", "lag_1"))])


@query("w9_latest_window")
def w9(spark, sf_dir):
    last = split.latest_window(weekly(spark, sf_dir), "modal_price", 12)
    return last.select("market", "crop", "points", "complete", F.posexplode("values").alias("place", "price"))


@query("w11_positional_split")
def w11(spark, sf_dir):
    return split.positional_split(targets(spark, sf_dir).select(*SERIES_ID)).select(*SERIES_ID, "row_index", "split")


@query("w12_temporal_split")
def w12(spark, sf_dir):
    return split.temporal_split(targets(spark, sf_dir).select(*SERIES_ID)).select(*SERIES_ID, "split")


@query("w13_expanding_folds")
def w13(spark, sf_dir):
    idx = split.with_row_index(targets(spark, sf_dir).select(*SERIES_ID), ("market", *FEATURE_ORDER))
    return split.expanding_folds(idx, 5).select(*SERIES_ID, "fold", "role")


# ------------------------------------------------------------------ evaluation
def scored(spark, sf_dir):
    return evaluate.persistence_forecasts(weekly(spark, sf_dir))


@query("j9_align_actuals")
def j9(spark, sf_dir):
    return scored(spark, sf_dir).select(*SERIES_ID, "horizon", "target_date", "y_pred", "y_true")


@query("f11_residuals")
def f11(spark, sf_dir):
    return evaluate.with_residual(scored(spark, sf_dir)).select(*SERIES_ID, "horizon", "residual")


@query("a12_error_metrics")
def a12(spark, sf_dir):
    return evaluate.error_metrics(scored(spark, sf_dir), ("crop", "horizon"))


@query("a13_metric_spread")
def a13(spark, sf_dir):
    per_series = evaluate.error_metrics(scored(spark, sf_dir), ("crop", "market", "horizon"))
    return evaluate.metric_spread(per_series, "rmse", ("crop", "horizon"))


# ------------------------------------------------------------------ requests / forecasts
RUN_DATE = "2024-10-01"


def requests(spark, sf_dir, towns=False):
    raw = fixtures.forecast_requests(spark, sf_dir, towns=towns)
    return forecast.validate_requests(forecast.normalise_requests(raw), RUN_DATE)


ANCHOR_COLS = ["modal_price", "lag_1", "rolling_mean_4"]


def anchored(spark, sf_dir):
    acc = forecast.accepted(requests(spark, sf_dir)).select(*REQ_OUT)
    feats = weekly_features(spark, sf_dir)
    return forecast.asof_features(acc, feats, ANCHOR_COLS)


def forecast_input(spark, sf_dir):
    a = anchored(spark, sf_dir).withColumnRenamed("modal_price", "anchor_price")
    return forecast.forecast_weeks(forecast.with_price_anchors(a))


def forecast_rows(spark, sf_dir):
    return forecast.with_fallback(forecast_input(spark, sf_dir))


REQ_OUT = ["request_id", "market", "state", "crop", "variety", "horizon_weeks", "as_of"]
ROW_OUT = ["request_id", "week", "forecast_date", "modal_price", "min_price", "max_price"]


@query("p10_normalise_requests")
def p10(spark, sf_dir):
    return forecast.normalise_requests(fixtures.forecast_requests(spark, sf_dir))


@query("p11_validate_requests")
def p11(spark, sf_dir):
    return requests(spark, sf_dir).select(*REQ_OUT, "status", "reason")


@query("p12_snap_horizon")
def p12(spark, sf_dir):
    raw = fixtures.forecast_requests(spark, sf_dir)
    return raw.select("request_id", "horizon_weeks", pricing.snap_horizon("horizon_weeks").alias("snapped_horizon"))


@query("p13_confidence_class")
def p13(spark, sf_dir):
    return forecast.spread_stats(forecast_rows(spark, sf_dir)).select("request_id", "confidence", "confidence_class")


@query("p14_volatility_class")
def p14(spark, sf_dir):
    acc = forecast.accepted(requests(spark, sf_dir)).select("request_id", "crop")
    return forecast.with_volatility_class(acc)


@query("j4_price_anchors")
def j4(spark, sf_dir):
    r = requests(spark, sf_dir, towns=True).select("request_id", "market", "crop")
    return forecast.with_price_anchors(r)


@query("j5_market_lookup")
def j5(spark, sf_dir):
    r = requests(spark, sf_dir, towns=True).select("request_id", "market", "crop")
    return forecast.with_market_info(r).drop("is_major_crop")


@query("j6_major_crop")
def j6(spark, sf_dir):
    r = requests(spark, sf_dir, towns=True).select("request_id", "market", "crop")
    return forecast.with_market_info(r).select("request_id", "market", "crop", "is_major_crop")


@query("j8_asof_features")
def j8(spark, sf_dir):
    return anchored(spark, sf_dir).select("request_id", "market", "crop", "as_of", "feature_date", *ANCHOR_COLS)


@query("j10_forecast_fallback")
def j10(spark, sf_dir):
    return forecast_rows(spark, sf_dir).select(*ROW_OUT, "source")


@query("f4_forecast_dates")
def f4(spark, sf_dir):
    acc = forecast.accepted(requests(spark, sf_dir)).select("request_id", "as_of", "horizon_weeks")
    return forecast.forecast_weeks(acc).select("request_id", "week", "forecast_date")


@query("f5_seasonal_forecast")
def f5(spark, sf_dir):
    fi = forecast_input(spark, sf_dir).where(F.col("anchor_price").isNotNull())
    return fi.select("request_id", "week", pricing.seasonal_factor(F.month("forecast_date")).alias("seasonal_factor"),
                     pricing.seasonal_price("anchor_price", F.month("forecast_date")).alias("modal_price"))


@query("f6_price_bands")
def f6(spark, sf_dir):
    fi = forecast_input(spark, sf_dir).where(F.col("anchor_price").isNotNull())
    rows = forecast.model_rows(fi)
    return rows.select(*ROW_OUT, F.col("confidence_interval.lower").alias("ci_lower"), F.col("confidence_interval.upper").alias("ci_upper"))


@query("f7_rule_forecast")
def f7(spark, sf_dir):
    r = forecast.accepted(requests(spark, sf_dir, towns=True)).select(*REQ_OUT)
    rows = forecast.rule_rows(forecast.forecast_weeks(forecast.with_price_anchors(r)))
    return rows.select(*ROW_OUT)


@query("f9_price_spread")
def f9(spark, sf_dir):
    w = weekly(spark, sf_dir)
    return w.select(*SERIES_ID, pricing.price_spread("max_price", "min_price").alias("price_spread"),
                    pricing.spread_pct("max_price", "min_price", "modal_price").alias("spread_pct"))


@query("w10_pct_change")
def w10(spark, sf_dir):
    return forecast.with_pct_change(forecast_rows(spark, sf_dir)).select("request_id", "week", "price_change_pct")


@query("a16_forecast_headline")
def a16(spark, sf_dir):
    return forecast.headline(forecast_rows(spark, sf_dir))


@query("a19_spread_stats")
def a19(spark, sf_dir):
    return forecast.spread_stats(forecast_rows(spark, sf_dir))


@query("a20_nested_response")
def a20(spark, sf_dir):
    nested = forecast.nest_response(forecast_rows(spark, sf_dir))
    return nested.select("request_id", "market", "crop", "horizon_weeks", F.posexplode("predictions").alias("place", "p")).select(
        "request_id", "market", "crop", "horizon_weeks", "place", "p.week", F.col("p.date").alias("forecast_day"), "p.modal_price", "p.min_price", "p.max_price",
        F.col("p.confidence_interval.lower").alias("ci_lower"), F.col("p.confidence_interval.upper").alias("ci_upper"))


# ------------------------------------------------------------------ models (Spark ML)
QUERY_GBT = model.GBTParams(max_iter=10, max_depth=4, seed=42)


def trained(spark, sf_dir):
    return jobs.training_job(obs(spark, sf_dir), QUERY_GBT)


@query("m3_gbt_train")
def m3(spark, sf_dir):
    """GBT trained on the temporal train split (early stopping on the last
    10% of the train range), scored on the test rows."""
    r = trained(spark, sf_dir)
    return r.test_scored.select(*SERIES_ID, "modal_price", "prediction")


@query("m4_batch_scoring")
def m4(spark, sf_dir):
    r = trained(spark, sf_dir)
    return model.score(r.model, r.frame).select(*SERIES_ID, "split", "prediction")


def horizon_frames(spark, sf_dir):
    r_obs = cut_lineage(obs(spark, sf_dir), "observations")
    mf, cols, fitted_chain = jobs.prepare_model_frame(r_obs)
    long = split.horizon_targets(cut_lineage(mf.drop("cutoff_day", "split"), "model-rows"))
    long = cut_lineage(split.horizon_split(long), "horizon-frame")
    return long, cols, fitted_chain


@query("m5_multi_horizon")
def m5(spark, sf_dir):
    """One model per horizon (1, 2, 4, 12 weeks) on the lead-h target."""
    long, cols, fitted_chain = horizon_frames(spark, sf_dir)
    models = model.train_multi_horizon(long.where(F.col("split") == "train"), cols, (1, 2, 4, 12), QUERY_GBT, chain=fitted_chain)
    rows = [(h, sum(e.getNumTrees for e in model.ensembles(m)), model.ensembles(m)[-1].numFeatures) for h, m in sorted(models.items())]
    counts = long.where(F.col("split") == "train").groupBy("horizon").agg(F.count(F.lit(1)).alias("train_rows"))
    info = spark.createDataFrame(rows, "horizon int, trees int, features int")
    return info.join(counts, "horizon")


@query("m6_horizon_evaluation")
def m6(spark, sf_dir):
    """Test errors of each horizon's model, and of the current price as forecast."""
    long, cols, fitted_chain = horizon_frames(spark, sf_dir)
    models = model.train_multi_horizon(long.where(F.col("split") == "train"), cols, (1, 2, 4, 12), QUERY_GBT, chain=fitted_chain)
    test = long.where(F.col("split") == "test")
    naive = evaluate.error_metrics(test.select("horizon", F.col("target_future").alias("y_true"), F.col("modal_price").alias("y_pred")), ("horizon",))
    return model.evaluate_horizons(models, test).withColumn("forecast", F.lit("gbt")).unionByName(naive.withColumn("forecast", F.lit("persistence")))


@query("m7_cross_validation")
def m7(spark, sf_dir):
    """Expanding-window CV (5 folds) over the model frame."""
    r_obs = cut_lineage(obs(spark, sf_dir), "observations")
    mf, cols, fitted_chain = jobs.prepare_model_frame(r_obs, None)
    idx = split.with_row_index(mf, ("date", "market", "variety", "state", "district"))
    return model.cross_validate(idx, cols, 5, params=QUERY_GBT, chain=fitted_chain)


@query("m8_feature_importance")
def m8(spark, sf_dir):
    return model.feature_importance(trained(spark, sf_dir).model, spark)


@query("o2_top_importance")
def o2(spark, sf_dir):
    return model.top_n(model.feature_importance(trained(spark, sf_dir).model, spark), 15)


@query("m9_permutation_importance")
def m9(spark, sf_dir):
    """RMSE increase per permuted feature on the test rows."""
    r = trained(spark, sf_dir)
    return model.permutation_importance(r.model, r.frame.where(F.col("split") == "test"), SERIES_ID)


@query("m11_retrain_job")
def m11(spark, sf_dir):
    """Retrain from a CSV path, publish the checked model, report its metrics."""
    data, root = shared_path(spark, "observations-csv"), shared_path(spark, "models")
    io.write_csv(obs(spark, sf_dir), data)
    r = registry.retrain(spark, data, root, params=QUERY_GBT)
    version = registry.published(spark, root).select("version").first()["version"]
    meta = model.read_metadata(spark, f"{root}/versions/{version}")
    return r.metrics.crossJoin(meta.select("model_type", "feature_count"))


@query("m11_retrain_forest")
def m11_forest(spark, sf_dir):
    """The second model type: published, taken from the pointer table, and
    scoring raw observations with its own feature chain."""
    data, root = shared_path(spark, "observations-csv"), shared_path(spark, "models")
    o = obs_table(spark, sf_dir)
    io.write_csv(o, data)
    registry.retrain(spark, data, root, "forest", params=QUERY_GBT)
    return model.score_observations(registry.current(spark, root), o).select(*SERIES_ID, "modal_price", "prediction")


@query("m12_forecast_job")
def m12(spark, sf_dir):
    """Requests -> as-of features -> GBT anchor -> weekly rows with bands."""
    r = trained(spark, sf_dir)
    raw = fixtures.forecast_requests(spark, sf_dir)
    rows, _, _ = jobs.forecast_job(raw, r.frame, r.model, RUN_DATE)
    return rows.select(*ROW_OUT, "source")


@query("s6_model_save_load")
def s6(spark, sf_dir):
    """A saved and reloaded model, with its reloaded feature chain, scores raw
    observations as the model in memory scores its own test rows."""
    o = obs_table(spark, sf_dir)
    r = jobs.training_job(o, QUERY_GBT)
    path = shared_path(spark, "model")
    model.save_model(r.model, path)
    a = model.score(r.model, r.frame.where(F.col("split") == "test")).select(*SERIES_ID, F.col("prediction").alias("prediction_saved"))
    b = model.score_observations(model.load_model(spark, path), o).select(*SERIES_ID, F.col("prediction").alias("prediction_loaded"))
    return a.join(b, SERIES_ID)


@query("s7_model_metadata")
def s7(spark, sf_dir):
    r = trained(spark, sf_dir)
    path = shared_path(spark, "model")
    model.save_model(r.model, path)
    return model.metadata_features(model.read_metadata(spark, path))


@query("s8_run_summary")
def s8(spark, sf_dir):
    """Records per stage of the training run (no model needed), observed while
    the stages are written."""
    read, made, cut = Observation("observations"), Observation("weekly"), Observation("frame")
    o = cut_lineage(obs(spark, sf_dir).observe(read, *jobs.counted()), "observations")
    wk = rollup.rollup(clean.impute(o, stored=True), "weekly").select(*SERIES_ID, "modal_price")
    wk = cut_lineage(wk.observe(made, *jobs.counted()), "weekly")
    cut_lineage(split.temporal_split(clean.drop_null_target(wk)).observe(cut, *jobs.counted(True)), "frame")
    return jobs.run_summary(spark, read.get, made.get, cut.get)


@query("s8_summary_document")
def s8_document(spark, sf_dir):
    """The run's summary document, written and read back: records, settings,
    one row a feature."""
    doc = jobs.write_summary(trained(spark, sf_dir), shared_path(spark, "summary"))
    return doc.select("data_info.*", "config.max_iter", "config.target", F.col("models_trained")[0].alias("model_type"),
                      F.posexplode("feature_info.feature_list").alias("place", "feature"))


# ------------------------------------------------------------------ files / wire formats / stream
@query("s4_write_csv")
def s4(spark, sf_dir):
    """Weekly table written as CSV and read back with the fixed schema."""
    path = shared_path(spark, "weekly-csv")
    io.write_csv(weekly(spark, sf_dir), path)
    schema = "date date, market string, crop string, variety string, state string, district string, " \
        "min_price double, max_price double, modal_price double, arrival_qty double, acreage_estimate double, " \
        "rainfall_mm double, temp_c double, govt_policy_flag int, holiday_flag int"
    return spark.read.option("header", True).schema(schema).csv(path)


@query("s1_csv_roundtrip")
def s1_csv(spark, sf_dir):
    """Observation CSV written, then loaded with the contract reader (S1 + S2)."""
    path = shared_path(spark, "observations-csv")
    rows = obs(spark, sf_dir)
    io.write_csv(rows.select(*reversed(rows.columns)), path)  # columns go by name, not by place
    return io.load_observations(spark, path)


@query("s1_quarantine")
def s1_quarantine(spark, sf_dir):
    """Lines loaded, and lines rejected by reason, of observation files in
    which prices of the 13th of a month are texts and lines of the 17th end early."""
    path, day = shared_path(spark, "observation-lines"), F.dayofmonth("date")
    text = {c: F.col(c).cast("string") for c in REQUIRED_COLUMNS}
    text["modal_price"] = F.when(day == 13, F.lit("n/a")).otherwise(text["modal_price"])
    line = lambda names: F.to_csv(F.struct(*[text[c].alias(c) for c in names]))
    lines = obs(spark, sf_dir).select(F.when(day == 17, line(REQUIRED_COLUMNS[:3])).otherwise(line(REQUIRED_COLUMNS)).alias(",".join(REQUIRED_COLUMNS)))
    lines.write.option("header", True).option("sep", "\u0001").csv(path)
    loaded, rejected = io.quarantine(spark, path)
    return loaded.groupBy(F.lit("loaded").alias("reason")).agg(F.count(F.lit(1)).alias("lines")).unionByName(
        rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")))


@query("s5_export_forecasts")
def s5(spark, sf_dir):
    """Forecast rows exported as CSV (flat) and read back."""
    path = shared_path(spark, "forecast-csv")
    rows = forecast_rows(spark, sf_dir).select(*ROW_OUT, "confidence_interval", "source")
    io.export_forecasts(rows, path, "csv")
    schema = "request_id bigint, week int, forecast_date date, modal_price double, min_price double, " \
        "max_price double, source string, ci_lower double, ci_upper double"
    return spark.read.option("header", True).schema(schema).csv(path)


@query("s5_export_json")
def s5_json(spark, sf_dir):
    """Nested responses exported as JSON lines and read back."""
    path = shared_path(spark, "forecast-json")
    io.export_forecasts(forecast.nest_response(forecast_rows(spark, sf_dir)), path, "json")
    item = "week int, date string, modal_price double, min_price double, max_price double"
    back = spark.read.schema(f"request_id bigint, predictions array<struct<{item.replace(' ', ':').replace(',:', ',')}>>").json(path)
    return back.select("request_id", F.explode("predictions").alias("p")).select("request_id", "p.week", F.to_date("p.date").alias("forecast_date"), "p.modal_price", "p.min_price", "p.max_price")


@query("s9_response_json")
def s9_response(spark, sf_dir):
    """Response documents rendered as JSON text and parsed again."""
    docs = io.render_responses(forecast.nest_response(forecast_rows(spark, sf_dir)))
    body = F.from_json("response", "crop string, horizon_weeks int, model_version string, predictions array<struct<week:int,modal_price:double>>")
    return docs.select("request_id", body.alias("r")).select("request_id", "r.crop", "r.horizon_weeks", "r.model_version", F.explode("r.predictions").alias("p")).select(
        "request_id", "crop", "horizon_weeks", "model_version", "p.week", "p.modal_price")


@query("s9_request_json")
def s9(spark, sf_dir):
    """Requests serialised to JSON documents and parsed back into typed rows."""
    raw = fixtures.forecast_requests(spark, sf_dir)
    return io.parse_requests(io.requests_to_json(raw))


def stream_anchors(spark, sf_dir):
    feats = weekly_features(spark, sf_dir)
    anchors = forecast.last_per_date(feats, ["market", "crop"], "date", ["modal_price"], ["variety", "state", "district"])
    return cut_lineage(anchors.select("market", "crop", F.col("date").alias("feature_date"), F.col("modal_price").alias("anchor_price")), "anchors")


def streamed(spark, sf_dir, score=None):
    """(forecast rows, rejected requests) of all requests, streamed from files."""
    src, out, ck = (shared_path(spark, f"stream-{x}") for x in ("requests", "out", "ckpt"))
    fixtures.forecast_requests(spark, sf_dir).write.parquet(src)
    if score is None:
        r = trained(spark, sf_dir)
        score = scoring.model_scorer(r.frame, r.model, RUN_DATE)
    scoring.run_batches(scoring.request_stream(spark, src), score, out, ck)
    return scoring.accepted_rows(spark, out), scoring.rejected_rows(spark, out)


@query("r1_stream_scoring")
def r1(spark, sf_dir):
    """Requests streamed from files, scored against the static as-of anchors."""
    src = shared_path(spark, "request-stream")
    raw = fixtures.forecast_requests(spark, sf_dir)
    raw.write.parquet(src)
    anchors = stream_anchors(spark, sf_dir)
    out, ck = shared_path(spark, "stream-out"), shared_path(spark, "stream-ckpt")
    scoring.run_to_table(scoring.score_stream(scoring.request_stream(spark, src), anchors, RUN_DATE), out, ck)
    return spark.read.parquet(out)


@query("r1_stream_model")
def r1_model(spark, sf_dir):
    """Requests streamed from files and scored with the trained model; the
    forecast rows of all batches."""
    return streamed(spark, sf_dir)[0].select(*ROW_OUT, "source")


@query("r1_stream_rejected")
def r1_rejected(spark, sf_dir):
    """Requests the stream rejects, with their reasons (anchors as model)."""
    anchors = stream_anchors(spark, sf_dir)
    score = lambda batch: scoring.score_requests(batch, anchors, RUN_DATE)
    return streamed(spark, sf_dir, score)[1].select("request_id", "reason")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
