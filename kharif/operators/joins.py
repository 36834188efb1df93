"""Equi-joins in which a NULL key equals a NULL key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], more: str | None = None, how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b`` where ``keys`` are equal or both NULL
    (and ``more``, an SQL condition, holds)."""
    b = b.withColumnsRenamed({k: f"{k}__" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{k}__`")) for k in keys], F.lit(True))
    return a.join(b, on & F.expr(more) if more else on, how).drop(*[f"{k}__" for k in keys])
