"""Data checks and profiles.

Each profile is a single aggregate over the frame (one pass, partial
aggregation on the map side); long forms are produced with ``stack`` on the
one-row result, never on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kharif.operators.quantiles import group_medians
from kharif.schema import CRITICAL_COLUMNS, REQUIRED_COLUMNS, TARGET


# --------------------------------------------------------------------------- S2
def missing_columns(df: DataFrame, expected: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    """Required columns absent from the frame (schema only, no job)."""
    have = set(df.columns)
    return [c for c in expected if c not in have]


def check_schema(df: DataFrame, expected: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """Raise on missing required columns; extra columns are tolerated."""
    missing = missing_columns(df, expected)
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


# --------------------------------------------------------------------------- S3
def violations(df: DataFrame, critical: Sequence[str] = CRITICAL_COLUMNS, price: str = TARGET) -> DataFrame:
    """Long table (check_name, observed, violated) from one aggregate:
    NULLs in critical columns, empty table, non-positive prices."""
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in critical]
    aggs += [F.count(F.lit(1)).alias("row_count"), F.count_if(F.col(price) <= 0).alias(f"nonpositive_{price}")]
    wide = df.agg(*aggs)
    parts = [f"'null_{c}', null_{c}, null_{c} > 0" for c in critical]
    parts += ["'empty_table', row_count, row_count = 0", f"'nonpositive_{price}', nonpositive_{price}, nonpositive_{price} > 0"]
    return wide.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) as (check_name, observed, violated)")


# --------------------------------------------------------------------------- A5
def quality_profile(df: DataFrame, price: str = TARGET, stored: bool = False) -> DataFrame:
    """One row: counts, date range, NULLs per column, distinct markets /
    crops / states, price min, max, mean, median.  ``stored``: ``df`` is a table."""
    aggs = [
        F.count(F.lit(1)).alias("total_records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_distinct("market").alias("markets"),
        F.count_distinct("crop").alias("crops"),
        F.count_distinct("state").alias("states"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        F.avg(price).alias("mean_price"),
    ]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in df.columns]
    med = group_medians(df, [price], stored=stored).select(F.col(f"__med_{price}").alias("median_price"))
    out = df.agg(*aggs).crossJoin(med)
    first = ["total_records", "start_date", "end_date", "markets", "crops", "states", "min_price", "max_price", "mean_price", "median_price"]
    return out.select(*first, *[c for c in out.columns if c not in first])


# --------------------------------------------------------------------------- A6
def load_profile(df: DataFrame) -> DataFrame:
    """One row: records, date range, distinct markets, sorted crop list
    (as text; the set of crops is small by nature)."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count_distinct("market").alias("markets"),
        F.array_join(F.sort_array(F.collect_set("crop")), ",").alias("crops"),
    )
