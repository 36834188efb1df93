"""Observation contract and column groups."""

from __future__ import annotations

from pyspark.sql import types as T

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("state", T.StringType()),
        T.StructField("district", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("crop", T.StringType()),
        T.StructField("variety", T.StringType()),
        T.StructField("min_price", T.DoubleType()),
        T.StructField("max_price", T.DoubleType()),
        T.StructField("modal_price", T.DoubleType()),
        T.StructField("arrival_qty", T.DoubleType()),
        T.StructField("acreage_estimate", T.DoubleType()),
        T.StructField("rainfall_mm", T.DoubleType()),
        T.StructField("temp_c", T.DoubleType()),
        T.StructField("govt_policy_flag", T.IntegerType()),
        T.StructField("holiday_flag", T.IntegerType()),
    ]
)

REQUIRED_COLUMNS = tuple(f.name for f in OBSERVATION_SCHEMA.fields)
CRITICAL_COLUMNS = ("date", "market", "crop", "modal_price")

PRICE_COLS = ("min_price", "max_price", "modal_price")
MEDIAN_FILL_COLS = ("arrival_qty", "rainfall_mm", "temp_c", "acreage_estimate")
FLAG_COLS = ("govt_policy_flag", "holiday_flag")
TARGET = "modal_price"

# Imputation series: one row per date; ties broken by the remaining keys.
IMPUTE_KEYS = ("market", "crop", "variety")
IMPUTE_ORDER = ("date", "state", "district")
# Roll-up grain.
ROLLUP_KEYS = ("market", "crop", "variety", "state", "district")
# Lag / rolling series mixes varieties of the same (market, crop); the
# total order makes the position of every row deterministic.
FEATURE_KEYS = ("market", "crop")
FEATURE_ORDER = ("date", "variety", "state", "district")

FORECAST_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("market", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("crop", T.StringType()),
        T.StructField("variety", T.StringType()),
        T.StructField("horizon_weeks", T.IntegerType()),
        T.StructField("as_of_date", T.StringType()),
    ]
)
