"""The feature chain as a Spark ML estimator whose fitted state is tables.

``FeatureChain.fit`` learns from one observation table, ``FeatureChainModel``
turns any observation table into model rows with what was learnt, be it the rows
it was fitted on or new ones.  The state is a set of tables, written once when
fitted, saved beside the model as Parquet and read back by ``load``; none of it
is collected, so its size is not bounded by the driver:

* ``series``   median arrivals, rain, temperature and acreage per series;
* ``bounds``   price caps per group;
* ``codes``    target codes per group, column (market, state) and category, and
               the group's prior in the row without a category;
* ``medians``  medians of the feature columns per group;
* ``scaler``   mean and population deviation of the prepared columns per group;
* ``vocabulary`` values of the one-hot columns with their position.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kharif.operators import clean, features, rollup
from kharif.operators.joins import null_safe_join
from kharif.operators.quantiles import group_medians
from kharif.schema import TARGET
from kharif.session import cut_lineage, fitted

SERIES_ID = ["date", "market", "crop", "variety", "state", "district"]
ENCODED, ONE_HOT = ("market", "state"), ("variety", "crop")
TABLES = ("series", "bounds", "codes", "medians", "scaler", "vocabulary")


class _ChainParams(Params):
    freq = Param(Params._dummy(), "freq", "weekly, monthly or daily", TypeConverters.toString)
    groupKeys = Param(Params._dummy(), "groupKeys", "columns whose groups have statistics of their own", TypeConverters.toListString)
    excludeCurrent = Param(Params._dummy(), "excludeCurrent", "rolling statistics of earlier rows only", TypeConverters.toBoolean)
    warmup = Param(Params._dummy(), "warmup", "median: fill the NULLs of a series' first rows; drop: drop those rows", TypeConverters.toString)
    scale = Param(Params._dummy(), "scale", "standardise the feature columns", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(freq="weekly", groupKeys=["crop"], excludeCurrent=False, warmup="median", scale=False)

    def _of(self, name: str):
        return self.getOrDefault(getattr(self, name))

    # Stages that fit and transform share.
    def _clean(self, obs: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
        imputed = clean.impute(obs, medians=state["series"], stored=True)
        return imputed if "bounds" not in state else clean.winsorize(imputed, group_keys=self._of("groupKeys"), bounds=state["bounds"])

    def _features(self, daily: DataFrame, obs: DataFrame) -> DataFrame:
        periodic = features.add_time_features(rollup.rollup(daily, self._of("freq")))
        return features.add_series_features(periodic, exclude_current=self._of("excludeCurrent"), sizes_from=obs)

    def _encode(self, rows: DataFrame, codes: DataFrame) -> DataFrame:
        groups = self._of("groupKeys")
        prior = codes.where("category is null")
        for col in ENCODED:
            own = codes.where(F.col("column_name") == col)
            own, top = own.where("category is not null"), prior.where(F.col("column_name") == col)
            rows = null_safe_join(rows, own.select(*groups, F.col("category").alias(col), F.col("code").alias("__code")), [*groups, col], how="left")
            rows = null_safe_join(rows, top.select(*groups, F.col("code").alias("__prior")), groups, how="left") if groups else rows.crossJoin(F.broadcast(top.select(F.col("code").alias("__prior"))))
            rows = rows.withColumn(f"{col}_encoded", F.coalesce("__code", "__prior")).drop("__code", "__prior")
        return rows

    def _prepare(self, rows: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
        cols, groups = features.feature_columns(rows), self._of("groupKeys")
        if self._of("warmup") == "drop":
            rows = rows.where(F.col(f"lag_{max(features.LAGS)}").isNotNull())
        rows = clean.fill_median(rows, cols, groups, state["medians"])
        rows = clean.replace_infinite(clean.fill_zero(rows, cols), cols)
        if "scaler" in state and self._of("scale"):
            rows = features.apply_scaler(rows, cols, state["scaler"], groups)
        return rows.select(*SERIES_ID, *cols, TARGET)


class FeatureChain(_ChainParams, Estimator, MLReadable, MLWritable):
    """Unfitted chain: observations to model rows."""

    @keyword_only
    def __init__(self, *, freq: str = "weekly", groupKeys: Sequence[str] = ("crop",), excludeCurrent: bool = False, warmup: str = "median", scale: bool = False) -> None:
        super().__init__()
        given = {k: list(v) if k == "groupKeys" else v for k, v in self._input_kwargs.items()}
        if given.get("warmup", "median") not in ("median", "drop"):
            raise ValueError("warmup must be 'median' or 'drop'")
        self._set(**given)

    def _fit(self, obs: DataFrame) -> FeatureChainModel:
        return self.fit_rows(obs)[0]

    def fit_rows(self, obs: DataFrame, stored: bool = False) -> tuple[FeatureChainModel, DataFrame]:
        """The fitted model and the rows it makes of ``obs``, from one pass over
        the chain.  ``stored`` says that ``obs`` is a table."""
        groups, state = self._of("groupKeys"), {}
        obs = obs if stored else cut_lineage(obs, "chain-input")
        state["series"] = clean.series_medians(obs, stored=True)
        imputed = cut_lineage(self._clean(obs, state), "imputed")
        state["bounds"] = fitted(clean.outlier_bounds(imputed, group_keys=groups, stored=True), "bounds")
        capped = clean.winsorize(imputed, group_keys=groups, bounds=state["bounds"])
        rows = cut_lineage(self._features(capped, obs), "feature-rows")
        state["codes"] = fitted(target_codes(rows, ENCODED, groups), "codes")
        state["vocabulary"] = fitted(vocabulary(rows, ONE_HOT), "vocabulary")
        rows = self._encode(rows, state["codes"])
        cols = features.feature_columns(rows)
        state["medians"] = fitted(group_medians(rows, cols, groups), "medians")
        made = cut_lineage(self._prepare(rows, state), "model-rows")
        state["scaler"] = fitted(features.fit_scaler(made, cols, groups), "scaler")
        model = self._copyValues(FeatureChainModel(state))
        scaled = features.apply_scaler(made, cols, state["scaler"], groups) if self._of("scale") else made
        return model, clean.drop_null_target(scaled)

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class FeatureChainModel(_ChainParams, Model, MLReadable, MLWritable):
    """Fitted chain.  ``state`` holds the tables named in ``TABLES``."""

    def __init__(self, state: dict[str, DataFrame] | None = None) -> None:
        super().__init__()
        self.state = state or {}

    def _transform(self, obs: DataFrame) -> DataFrame:
        """Model rows of any observations: codes, bounds and medians are the
        fitted ones; an unseen category has its group's prior, a series without a
        median 0.  Lags reach back within ``obs`` only, so pass enough history.
        Rows without a target stay."""
        obs = cut_lineage(obs, "chain-input")
        return self._prepare(self._encode(self._features(self._clean(obs, self.state), obs), self.state["codes"]), self.state)

    def indexed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``<column>_index``, the position of each one-hot value;
        unknown and NULL values come after all known ones."""
        for col in ONE_HOT:
            own = self.state["vocabulary"].where(F.col("column_name") == col)
            size = F.broadcast(own.agg(F.count("value").alias("__size")))
            own = own.where("value is not null").select(F.col("value").alias("__v"), F.col("position").alias("__p"))
            rows = rows.join(own, rows[col] == own["__v"], "left").crossJoin(size)
            rows = rows.withColumn(f"{col}_index", F.coalesce(F.col("__p") - 1, F.col("__size")).cast("double")).drop("__v", "__p", "__size")
        return rows

    def write(self) -> MLWriter:
        return _ChainWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ChainReader(cls)


class _ChainWriter(MLWriter):
    def __init__(self, model: FeatureChainModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        for name, table in self.model.state.items():
            table.write.mode("overwrite").parquet(os.path.join(path, "state", name))


class _ChainReader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FeatureChainModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls({name: self.sparkSession.read.parquet(os.path.join(path, "state", name)) for name in TABLES})
        DefaultParamsReader.getAndSetParams(model, meta)
        return model


def target_codes(rows: DataFrame, cols: Sequence[str], groups: Sequence[str], target: str = TARGET, min_samples_leaf: int = 20, smoothing: float = 10.0) -> DataFrame:
    """(groups, column_name, category, n, code) of all columns by one aggregate;
    the row without a category is the group's prior, the mean of the target.
    A category's code moves from the prior to its mean as it has more rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category")) for c in cols]))
    long = rows.where(F.col(target).isNotNull()).select(*groups, pairs.alias("x"), F.col(target).alias("__y")).select(*groups, "x.*", "__y")
    sums = long.groupBy(*groups, "column_name", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("__s"))
    all_ = Window.partitionBy(*groups, "column_name")  # one row a category
    sums = fitted(sums, "code-sums").withColumn("prior", F.sum("__s").over(all_) / F.sum("n").over(all_))
    weight = 1.0 / (1.0 + F.exp(-(F.col("n") - min_samples_leaf) / smoothing))
    code = F.col("prior") * (1.0 - weight) + F.col("__s") / F.col("n") * weight
    own = sums.where("category is not null").select(*groups, "column_name", "category", "n", code.alias("code"))
    top = sums.groupBy(*groups, "column_name").agg(F.sum("n").alias("n"), F.max("prior").alias("code"))
    return own.unionByName(top.select(*groups, "column_name", F.lit(None).cast("string").alias("category"), "n", "code"))


def vocabulary(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, position from 1): the distinct non-NULL values of each
    column by name."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in cols]))
    found = rows.select(pairs.alias("x")).select("x.*").where("value is not null").distinct()
    return found.withColumn("position", F.row_number().over(Window.partitionBy("column_name").orderBy("value")))


def feature_names(chain: FeatureChainModel, columns: Sequence[str]) -> DataFrame:
    """(position, feature) of the assembled vector: ``columns``, then a name for
    each one-hot value."""
    spark = SparkSession.getActiveSession()
    fixed = spark.createDataFrame([(i + 1, c) for i, c in enumerate(columns)], "position int, feature string")
    words, upto = chain.state["vocabulary"], F.lit(len(columns))
    parts = fixed
    for col in ONE_HOT:
        own = words.where(F.col("column_name") == col)
        prefix = F.lit("variety_" if col == "variety" else f"{col}_is_")
        ahead = words.where(F.col("column_name") == ONE_HOT[0]).count() if col != ONE_HOT[0] else 0
        parts = parts.unionByName(own.select((F.col("position") + upto + ahead).cast("int").alias("position"), F.concat(prefix, "value").alias("feature")))
    return parts
