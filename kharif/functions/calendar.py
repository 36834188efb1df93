"""Calendar column expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_ending_monday(date) -> Column:
    """Weekly bucket label: weeks run Tuesday..Monday, labelled by the Monday."""
    return F.next_day(F.date_sub(_c(date), 1), "Mon")


def month_end(date) -> Column:
    return F.last_day(_c(date))


def monday0_weekday(date) -> Column:
    """Day of week with Monday = 0 (Spark's ``dayofweek`` has Sunday = 1)."""
    return F.weekday(_c(date))


def iso_week(date) -> Column:
    return F.weekofyear(_c(date))


def month_sin(month) -> Column:
    return F.sin(2 * math.pi * _c(month) / 12.0)


def month_cos(month) -> Column:
    return F.cos(2 * math.pi * _c(month) / 12.0)


def is_weekend(date) -> Column:
    """Holiday flag rule: Saturday or Sunday."""
    return F.when(monday0_weekday(date).isin(5, 6), 1).otherwise(0)


def calendar_columns(date="date") -> list[Column]:
    """year (calendar), month, quarter, ISO week, Monday-0 weekday."""
    d = _c(date)
    return [
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.quarter(d).alias("quarter"),
        iso_week(d).alias("week_of_year"),
        monday0_weekday(d).alias("day_of_week"),
    ]
