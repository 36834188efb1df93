"""Numeric helpers that evaluate identically in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_up(col, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in double precision.

    Python's ``round`` looks at the exact binary value instead, so the two
    differ where the product rounds up to a tie: 2.675 gives 2.68 here and
    2.67 in Python, 1.115 gives 1.12 and 1.11."""
    scale = float(10**digits)
    return F.floor(_c(col) * scale + 0.5) / scale


def stable4(col) -> Column:
    """Presentation rounding for compared outputs: 4 decimals with the
    boundary moved off exact ties, so engines that sum in a different order
    still print the same digits."""
    return F.floor(_c(col) * 1e4 + 0.5001) / 1e4


def present(df, digits_fn=stable4):
    """Apply ``stable4`` to every double column, keep the column order."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(digits_fn(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def safe_ratio(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL (never NaN or an error)."""
    d = _c(den)
    return F.when(d.isNull() | (d == 0), F.lit(None).cast("double")).otherwise(_c(num) / d)


def is_infinite(col) -> Column:
    c = _c(col)
    return (c == float("inf")) | (c == float("-inf"))
