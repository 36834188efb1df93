"""The data chain as one lazy plan: observations -> clean -> roll-up -> features.

The reference runs it on one crop at a time.  Here every crop runs in the
same job with ``crop`` as a group key wherever the reference computes a
frame-wide statistic (quantile bounds, encoder priors, medians, scaler), so
the result for each crop equals the reference's single-crop run while the
work spreads over all series at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.operators import clean, features, rollup
from kharif.schema import FEATURE_KEYS, IMPUTE_KEYS, TARGET
from kharif.session import cut_lineage

CROP_GROUP = ("crop",)


def clean_daily(obs: DataFrame, group_keys: Sequence[str] = CROP_GROUP, approx_bounds: bool = False, stored: bool = False) -> DataFrame:
    """Impute per series, then cap prices to per-crop quantile bounds.  The
    imputed table is written once: bounds and output read it."""
    imputed = cut_lineage(clean.impute(obs, stored=stored), "imputed")
    return clean.winsorize(imputed, group_keys=group_keys, approx=approx_bounds, stored=True)


def weekly_table(obs: DataFrame, freq: str = "weekly", group_keys: Sequence[str] = CROP_GROUP, stored: bool = False) -> DataFrame:
    """Clean and roll up; ``stored`` says that ``obs`` is a table."""
    return rollup.rollup(clean_daily(obs, group_keys, stored=stored), freq)


def series_features(periodic: DataFrame, exclude_current: bool = False, sizes_from: DataFrame | None = None, shard_rows: int | None = None) -> DataFrame:
    """Calendar, harvest, lag and rolling features; rolling ones of earlier
    rows only with ``exclude_current``."""
    return features.add_series_features(features.add_time_features(periodic), exclude_current=exclude_current, sizes_from=sizes_from, shard_rows=shard_rows)


def encode(df: DataFrame, vocabulary: Sequence[str] | None, group_keys: Sequence[str] = CROP_GROUP) -> DataFrame:
    """Target codes for market and state (fit on ``df``), one-hot variety."""
    out = df
    for col in ("market", "state"):
        enc = features.fit_target_encoder(df, col, group_keys=group_keys)
        out = features.apply_target_encoder(out, col, enc, group_keys=group_keys)
    if vocabulary is None:
        vocabulary = features.collect_vocabulary(df, "variety")
    return features.one_hot(out, "variety", vocabulary)


def unfitted_schema(obs: DataFrame) -> DataFrame:
    """A frame with the columns of the feature table; nothing is fitted or run."""
    rows = features.add_time_features(rollup.rollup(obs, "weekly"))
    rows = rows.select("*", *features.lag_columns(), *features.rolling_columns())
    return rows.withColumns({f"{c}_encoded": F.lit(0.0) for c in ("market", "state")})


def feature_table(obs: DataFrame, vocabulary: Sequence[str] | None = None, freq: str = "weekly") -> DataFrame:
    """Weekly feature table with keys, all feature columns and the target."""
    return encode(series_features(weekly_table(obs, freq)), vocabulary)


def prepare_training(
    df: DataFrame,
    cols: Sequence[str],
    target: str = TARGET,
    group_keys: Sequence[str] = CROP_GROUP,
    warmup: str = "median",
) -> DataFrame:
    """Median fill (warm-up lag NULLs included), zero fill, +-inf -> 0, drop
    rows without a target.  ``warmup='drop'`` removes rows whose longest lag
    is still NULL instead of filling them."""
    out = df
    if warmup == "drop":
        longest = max((c for c in cols if c.startswith("lag_")), key=lambda c: int(c.split("_")[1]), default=None)
        if longest:
            out = out.where(F.col(longest).isNotNull())
    elif warmup != "median":
        raise ValueError("warmup must be 'median' or 'drop'")
    out = clean.fill_median(out, list(cols), group_keys=group_keys)
    out = clean.fill_zero(out, list(cols))
    out = clean.replace_infinite(out, list(cols))
    return clean.drop_null_target(out, target)


__all__ = [
    "CROP_GROUP", "FEATURE_KEYS", "IMPUTE_KEYS",
    "clean_daily", "weekly_table", "series_features", "encode", "feature_table", "prepare_training",
]
