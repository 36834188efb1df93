"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.operators.quality import check_schema
from kharif.schema import FORECAST_REQUEST_SCHEMA, OBSERVATION_SCHEMA, REQUIRED_COLUMNS
from kharif.session import cut_lineage


# --------------------------------------------------------------------------- S1
def load_observations(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Observation files by the names in their header (any column order; all
    files of a folder must agree on it), cast to the fixed schema; ISO dates.
    Extra columns are dropped, missing ones raise (S2).  A value that does not
    parse is NULL; ``unreadable`` counts them."""
    return _typed(check_schema(_raw(spark, path, fmt)))


def unreadable(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(column_name, unreadable): values that are there but do not parse."""
    raw = check_schema(_raw(spark, path, fmt)).select(*REQUIRED_COLUMNS)
    bad = [F.count_if(F.col(c).isNotNull() & _cast(raw, c).isNull()).alias(c) for c in REQUIRED_COLUMNS]
    pairs = ", ".join(f"'{c}', `{c}`" for c in REQUIRED_COLUMNS)
    return raw.agg(*bad).selectExpr(f"stack({len(REQUIRED_COLUMNS)}, {pairs}) as (column_name, unreadable)")


def quarantine(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(observations, rejected lines) of CSV files: together every line with
    content, once.  A line is rejected if its number of fields is not the
    header's or a field of the contract does not parse; it is kept with file, raw
    text and reason (the names of the fields that do not parse, or ``fields``
    where all that are there do).  Both are parts of
    one written table, so the files are read once.  Missing columns raise (S2)."""
    names = check_schema(_raw(spark, path, "csv")).columns
    known = {f.name: f.dataType for f in OBSERVATION_SCHEMA}
    typed = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    line, file = "__line", "__file"
    reader = spark.read.option("header", True).option("enforceSchema", False).option("dateFormat", "yyyy-MM-dd").option("columnPruning", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line)
    rows = reader.schema(typed.add(line, T.StringType())).csv(path).withColumn(file, F.col("_metadata.file_path"))
    rows = cut_lineage(rows.select(*REQUIRED_COLUMNS, line, file), "read-lines")
    bad = rows.where(F.col(line).isNotNull()).select(file, line, F.from_csv(line, F.lit(", ".join(f"`{n}` string" for n in names))).alias("t"), *REQUIRED_COLUMNS)
    wrong = F.concat_ws(",", *[F.when(F.col(f"t.`{c}`").isNotNull() & F.col(c).isNull(), F.lit(c)) for c in REQUIRED_COLUMNS])
    rejected = bad.select(F.col(file).alias("file"), F.col(line).alias("line"), F.when(wrong == "", F.lit("fields")).otherwise(wrong).alias("reason"))
    return rows.where(F.col(line).isNull()).select(*REQUIRED_COLUMNS), rejected


def _raw(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        # Texts under the header's names; a file with another header raises.
        names = spark.read.option("header", True).csv(path).schema
        return spark.read.option("header", True).option("enforceSchema", False).schema(names).csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def _cast(df: DataFrame, name: str) -> Column:
    kind = OBSERVATION_SCHEMA[name].dataType
    if isinstance(kind, T.DateType) and isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_date(F.col(name), "yyyy-MM-dd")
    return F.col(name).try_cast(kind)


def _typed(df: DataFrame) -> DataFrame:
    return df.select(*[_cast(df, c).alias(c) for c in REQUIRED_COLUMNS])


# --------------------------------------------------------------------------- S4
def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """CSV with header, one directory of part files (written in parallel)."""
    w = df.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)
    return path


# --------------------------------------------------------------------------- S5
def export_forecasts(rows: DataFrame, path: str, fmt: str = "csv") -> str:
    """Flat forecast rows as CSV, or nested responses as JSON lines."""
    if fmt == "csv":
        flat = rows.select(
            *[c for c in rows.columns if c != "confidence_interval"],
            *([F.col("confidence_interval.lower").alias("ci_lower"), F.col("confidence_interval.upper").alias("ci_upper")]
              if "confidence_interval" in rows.columns else []),
        )
        return write_csv(flat, path)
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
        return path
    raise ValueError(f"unsupported format {fmt!r}")


# --------------------------------------------------------------------------- S9
def requests_to_json(df: DataFrame) -> DataFrame:
    """One JSON document per request (the wire form)."""
    cols = [c for c in FORECAST_REQUEST_SCHEMA.fieldNames() if c in df.columns]
    return df.select(F.to_json(F.struct(*cols)).alias("body"))


def parse_requests(df: DataFrame, col: str = "body") -> DataFrame:
    """Typed request rows from JSON text; malformed documents give NULL fields
    and are rejected later by validation."""
    return df.select(F.from_json(F.col(col), FORECAST_REQUEST_SCHEMA).alias("r")).select("r.*")


def render_responses(nested: DataFrame, model_version: str = "1.0.0") -> DataFrame:
    """Response JSON per request: predictions array plus identifiers."""
    doc = F.struct(
        F.col("predictions"), F.lit(model_version).alias("model_version"),
        F.col("market"), F.col("crop"), F.col("horizon_weeks"),
    )
    return nested.select("request_id", F.to_json(doc).alias("response"))


RESPONSE_ITEM = T.StructType(
    [
        T.StructField("week", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("modal_price", T.DoubleType()),
        T.StructField("min_price", T.DoubleType()),
        T.StructField("max_price", T.DoubleType()),
        T.StructField("confidence_interval", T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])),
    ]
)
