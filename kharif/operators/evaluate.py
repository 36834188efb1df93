"""Forecast evaluation: alignment with actuals, residuals, error metrics and
their spread (J9, F11, A12, A13)."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kharif.functions.pricing import residual
from kharif.operators.quantiles import group_quantiles
from kharif.schema import FEATURE_KEYS, FEATURE_ORDER, TARGET

EPS = sys.float_info.epsilon  # MAPE denominator floor, as in scikit-learn


# --------------------------------------------------------------------------- J9
def with_position(df: DataFrame, keys: Sequence[str] = FEATURE_KEYS, order: Sequence[str] = FEATURE_ORDER) -> DataFrame:
    """1-based row position within the series (bounded by the series' calendar)."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def align_forecasts(
    forecasts: DataFrame,
    actuals: DataFrame,
    keys: Sequence[str] = FEATURE_KEYS,
    target: str = TARGET,
) -> DataFrame:
    """Join forecasts made at series position p for horizon h to the actual
    at position p + h of the same series (equi-join, no range condition).

    ``forecasts``: keys, position, horizon, y_pred (+ extra columns).
    ``actuals``: keys, position, target, date.
    """
    a = actuals.select(
        *[F.col(k).alias(f"__a_{k}") for k in keys],
        F.col("position").alias("__a_pos"),
        F.col(target).alias("y_true"),
        F.col("date").alias("target_date"),
    )
    cond = forecasts["position"] + forecasts["horizon"] == a["__a_pos"]
    for k in keys:
        cond = cond & (forecasts[k] == a[f"__a_{k}"])
    return forecasts.join(a, cond).drop(*[f"__a_{k}" for k in keys], "__a_pos")


def persistence_forecasts(
    features: DataFrame,
    horizons: Sequence[int] = (1, 2, 4, 12),
    target: str = TARGET,
    keys: Sequence[str] = FEATURE_KEYS,
    order: Sequence[str] = FEATURE_ORDER,
) -> DataFrame:
    """Scored frame of the naive forecast (the price now, for every horizon),
    aligned with actuals: the lag-h forecast of each row."""
    pos = with_position(features, keys, order)
    fc = pos.select(
        *keys, *[c for c in order if c not in keys], "position",
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
        F.col(target).alias("y_pred"),
    )
    return align_forecasts(fc, pos, keys, target)


# --------------------------------------------------------------------------- F11
def with_residual(scored: DataFrame) -> DataFrame:
    return scored.withColumn("residual", residual("y_true", "y_pred"))


# --------------------------------------------------------------------------- A12
def error_metrics(scored: DataFrame, group_keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """RMSE, MAE, MAPE x 100 (denominator max(|y|, eps)), R^2 and count."""
    e = F.col("y_true") - F.col("y_pred")
    agg = scored.groupBy(*group_keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.greatest(F.abs("y_true"), F.lit(EPS))) * 100.0).alias("mape"),
        F.sum(e * e).alias("__ssr"),
        (F.var_pop("y_true") * F.count(F.lit(1))).alias("__sst"),
        F.count(F.lit(1)).alias("n"),
    )
    r2 = F.when(F.col("__sst") == 0, F.lit(None).cast("double")).otherwise(1.0 - F.col("__ssr") / F.col("__sst"))
    return agg.withColumn("r2", r2).drop("__ssr", "__sst")


# --------------------------------------------------------------------------- A13
def metric_spread(
    metrics: DataFrame, metric: str = "rmse", group_keys: Sequence[str] = ("horizon",)
) -> DataFrame:
    """Five-number summary of a metric across series / folds per group."""
    names = ["min", "q1", "median", "q3", "max"]
    q = group_quantiles(metrics, [metric], [0.0, 0.25, 0.5, 0.75, 1.0], group_keys)
    members = metrics.groupBy(*group_keys).agg(F.count(F.lit(1)).alias("members"))
    return members.join(q, list(group_keys)).select(
        *group_keys, "members", *[F.col(f"__q{i}_{metric}").alias(f"{metric}_{n}") for i, n in enumerate(names)]
    )
