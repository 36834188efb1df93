"""Blocks of vectors and tiles (pairs of blocks), shared by the embedding
operators.  A block is one row: its ids and its matrix as binaries, of a
bounded number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, on average.
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Not NULL, not empty, and no component NULL or non-finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd, F.lit(False))


def packed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` (block, size, v array, and ``columns`` of long or double) -> one
    row a block: each column and the matrix ``v`` as binaries, rows in the
    order of the first column."""
    first = next(iter(columns))
    kind = {"double": np.float64, "float": np.float32, "long": np.int64}
    wide = rows.schema["v"].dataType.elementType.typeName()
    wide = wide if wide in kind else "double"

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(first, kind="stable")
        out = {"block": [group["block"].iloc[0]], "size": [group["size"].iloc[0]]}
        out |= {c: [group[c].to_numpy(kind[t]).tobytes()] for c, t in columns.items()}
        return pd.DataFrame(out | {"v": [np.stack(group["v"].to_numpy()).astype(kind[wide]).tobytes()]})

    schema = "block long, size int, " + ", ".join(f"{c} binary" for c in columns) + ", v binary"
    return rows.select("block", "size", *columns, "v").groupBy("block", "size").applyInPandas(pack, schema)


def blocks_needed(rows: int, block: int = BLOCK) -> int:
    return max(1, -(-rows // block))

