"""Price models with Spark ML.

Boosted trees come from ``pyspark.ml.regression.GBTRegressor``: tree
learning is distributed (per-node statistics are aggregated across
partitions), so the feature table never has to fit on one machine.  A model
is a ``PipelineModel`` (assembler + stages of trees, plans/boosting.py) plus a
small metadata document.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kharif.operators import evaluate, split
from kharif.plans.boosting import fit_all, grow, regressor
from kharif.plans.feature_chain import ONE_HOT, FeatureChainModel, feature_names
from kharif.schema import TARGET
from kharif.session import cut_lineage, fitted


@dataclass
class GBTParams:
    """Boosting settings.  The defaults are the production values (1000 trees at
    most, ended 50 trees after the best one, rate 0.1, depth 8, row and column
    sampling 0.8); jobs that want fewer trees say so.  Spark samples columns per node (``featureSubsetStrategy``)
    and has no L1/L2 terms."""

    max_iter: int = 1000
    step_size: float = 0.1
    max_depth: int = 8
    subsample: float = 0.8
    feature_subset: str = "0.8"
    max_bins: int = 32
    stage_trees: int = 50
    patience: int = 50
    seed: int = 42


@dataclass
class TrainedModel:
    """``feature_columns`` are the numeric columns; with a fitted ``chain`` the
    vector also holds its one-hot values, and observations can be scored."""

    model: PipelineModel
    feature_columns: list[str]
    target: str = TARGET
    params: GBTParams = field(default_factory=GBTParams)
    trained_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())
    model_type: str = "gbt"
    chain: FeatureChainModel | None = None

    def names(self, spark: SparkSession) -> DataFrame:
        """(position, feature) of the feature vector."""
        if self.chain is not None:
            return feature_names(self.chain, self.feature_columns)
        return spark.createDataFrame([(i + 1, c) for i, c in enumerate(self.feature_columns)], "position int, feature string")


# --------------------------------------------------------------------------- M3
def one_hot_stages(chain: FeatureChainModel) -> list:
    """Fitted encoders of the chain's index columns: a sparse vector as wide as
    the vocabulary, all zero for an unknown value."""
    stages = []
    for col in ONE_HOT:
        known = chain.state["vocabulary"].where(F.col("column_name") == col).select((F.col("position") - 1).cast("double").alias(f"{col}_index"))
        stages.append(OneHotEncoder(inputCol=f"{col}_index", outputCol=f"{col}_onehot", handleInvalid="keep", dropLast=True).fit(known))
    return stages


def preparation(cols: Sequence[str], chain: FeatureChainModel | None = None) -> list:
    """Stages that make ``features`` of model rows; nothing in them is fitted."""
    first = one_hot_stages(chain) if chain is not None else []
    return [*first, VectorAssembler(inputCols=[*cols, *[s.getOutputCol() for s in first]], outputCol="features", handleInvalid="keep")]


def with_validation_flag(train: DataFrame, fraction: float = 0.1, group_keys: Sequence[str] = ("crop",)) -> DataFrame:
    """Mark the latest ``fraction`` of each group's training dates as the
    early-stopping frame (cut from the train range, never from the test rows)."""
    day = F.unix_date("date")
    cut = train.groupBy(*group_keys).agg(F.percentile(day, 1.0 - fraction).alias("__vcut"))
    return train.join(cut, list(group_keys), "left").withColumn("is_validation", day > F.col("__vcut")).drop("__vcut")


def train_gbt(train: DataFrame, cols: Sequence[str], target: str = TARGET, params: GBTParams | None = None,
              validation_col: str | None = None, chain: FeatureChainModel | None = None) -> TrainedModel:
    """Boosted trees; with a validation column they grow in stages and end by
    the patience of ``params``, without one all trees are grown."""
    p = params or GBTParams()
    first = preparation(cols, chain)
    rows = PipelineModel(first).transform(train)
    if validation_col is None:
        stages = [regressor(p, p.max_iter, p.seed, target).fit(rows)]
    else:
        stages, _ = grow(rows, target, validation_col, p)
    if len(stages) > 1:
        parts = [f"__part_{i}" for i in range(len(stages))]
        stages = [s.setPredictionCol(c) for s, c in zip(stages, parts)]
        stages.append(SQLTransformer(statement=f"SELECT *, {' + '.join(parts)} AS prediction FROM __THIS__"))
    return TrainedModel(PipelineModel([*first, *stages]), list(cols), target, p, chain=chain)


def train_forest(train: DataFrame, cols: Sequence[str], target: str = TARGET, params: GBTParams | None = None,
                 validation_col: str | None = None, chain: FeatureChainModel | None = None) -> TrainedModel:
    """A random forest of ``max_iter`` trees (sampling, depth, bins and seed of
    ``params``); it learns from the validation rows too."""
    p = params or GBTParams()
    first = preparation(cols, chain)
    forest = RandomForestRegressor(
        featuresCol="features", labelCol=target, predictionCol="prediction", numTrees=p.max_iter, maxDepth=p.max_depth,
        subsamplingRate=p.subsample, featureSubsetStrategy=p.feature_subset, maxBins=p.max_bins, seed=p.seed,
    )
    return TrainedModel(PipelineModel([*first, forest.fit(PipelineModel(first).transform(train))]), list(cols), target, p, model_type="forest", chain=chain)


#: Model types by name; each trainer takes what ``train_gbt`` takes.
MODEL_TYPES = {"gbt": train_gbt, "forest": train_forest}


def trainer(model_type: str):
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unknown model type {model_type!r}; known: {', '.join(MODEL_TYPES)}")
    return MODEL_TYPES[model_type]


def ensembles(model: TrainedModel) -> list:
    """The fitted tree ensembles of a model, in order."""
    return [s for s in model.model.stages if hasattr(s, "treeWeights")]


# --------------------------------------------------------------------------- M4
def score(model: TrainedModel, df: DataFrame) -> DataFrame:
    """Batch scoring of model rows: adds ``prediction``; vectors are dropped."""
    parts = [s.getPredictionCol() for s in ensembles(model) if s.getPredictionCol() != "prediction"]
    return model.model.transform(df).drop("features", *[f"{c}_onehot" for c in ONE_HOT], *parts)


def score_observations(model: TrainedModel, obs: DataFrame) -> DataFrame:
    """Batch scoring of raw observations with the model's own fitted chain."""
    if model.chain is None:
        raise ValueError("the model was trained without a feature chain")
    return score(model, model.chain.indexed(model.chain.transform(obs)))


# --------------------------------------------------------------------------- M5
def train_multi_horizon(long: DataFrame, cols: Sequence[str], horizons: Sequence[int],
                        params: GBTParams | None = None, min_rows: int = 100,
                        chain: FeatureChainModel | None = None) -> dict[int, TrainedModel]:
    """One model per horizon on the ``horizon_targets`` frame (label
    ``target_future``); horizons with fewer than ``min_rows`` rows are
    skipped.  Each fit is a distributed job; the horizons are fitted at once."""
    counts = {r["horizon"]: r["n"] for r in long.groupBy("horizon").agg(F.count(F.lit(1)).alias("n")).collect()}

    def fit(h: int):
        return lambda: train_gbt(long.where(F.col("horizon") == h), cols, "target_future", params, chain=chain)

    return fit_all(long.sparkSession, {h: fit(h) for h in horizons if counts.get(h, 0) >= min_rows})


# --------------------------------------------------------------------------- M6
def evaluate_horizons(models: dict[int, TrainedModel], long_test: DataFrame, group_keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Score each horizon's rows with its model and compute A12 metrics."""
    parts = []
    for h, m in models.items():
        s = score(m, long_test.where(F.col("horizon") == h))
        parts.append(s.select(*group_keys, F.col("target_future").alias("y_true"), F.col("prediction").alias("y_pred")))
    if not parts:
        raise ValueError("no horizon model was trained")
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return evaluate.error_metrics(scored, group_keys)


# --------------------------------------------------------------------------- M7
def cross_validate(indexed: DataFrame, cols: Sequence[str], n_splits: int = 5, target: str = TARGET,
                   params: GBTParams | None = None, chain: FeatureChainModel | None = None) -> DataFrame:
    """Expanding-window CV over a frame with ``row_index`` and ``group_rows``:
    metrics of each fold's test rows.  The vectors are written once; a fold is
    a range of positions over that table (no row is copied), and the folds are
    fitted at once."""
    p = params or GBTParams()
    vectors = PipelineModel(preparation(cols, chain)).transform(indexed)
    frame = cut_lineage(vectors.select("features", F.col(target).alias("y_true"), "row_index", "group_rows"), "folds")
    if frame.isEmpty():
        raise ValueError("no rows to validate on")

    def fit(k: int):
        role = split.fold_role(F.lit(k), n_splits)
        return lambda: regressor(p, p.max_iter, p.seed, "y_true").fit(frame.where(role == "train"))

    models = fit_all(indexed.sparkSession, {k: fit(k) for k in range(n_splits)})
    scored = None
    for k, m in models.items():
        s = m.transform(frame.where(split.fold_role(F.lit(k), n_splits) == "test")).select(F.lit(k).alias("fold"), "y_true", F.col("prediction").alias("y_pred"))
        scored = s if scored is None else scored.unionByName(s)
    return evaluate.error_metrics(scored, ("fold",))


# ------------------------------------------------------------------------ M8 O2
def feature_importance(model: TrainedModel, spark: SparkSession) -> DataFrame:
    """Impurity-based importances (one number a feature) with their names; those
    of several stages count by their numbers of trees."""
    told: dict[int, float] = {}
    parts = ensembles(model)
    trees = sum(p.getNumTrees for p in parts)
    for p in parts:
        imp = p.featureImportances
        for i in map(int, imp.indices):
            told[i] = told.get(i, 0.0) + float(imp[i]) * p.getNumTrees / trees
    used = spark.createDataFrame([(i + 1, v) for i, v in sorted(told.items())], "position int, importance double")
    return model.names(spark).join(used, "position", "left").select("position", "feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def top_n(importance: DataFrame, n: int = 15) -> DataFrame:
    """Top-n by importance (ties by name); a TakeOrderedAndProject plan."""
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


# --------------------------------------------------------------------------- M9
def permutation_importance(
    model: TrainedModel,
    rows: DataFrame,
    key: Sequence[str],
    target: str = TARGET,
    seed: int = 42,
) -> DataFrame:
    """Increase in RMSE when one feature's values are permuted across ``rows``.

    Rows are ranked by a seeded hash of their ``key`` (range partitions, no
    one-task sort; ties by the key itself).  Feature f takes its value from the
    row a seeded number of ranks further on, around the end: a permutation, the
    same for the same seed and rows.  The feature number is exploded on the map
    side and one join on the rank brings all permuted values, whatever the number
    of features; all are scored in one ``transform`` and one aggregate."""
    from kharif.operators.split import with_row_index

    cols = [*model.feature_columns, *([f"{c}_index" for c in ONE_HOT] if model.chain is not None else [])]
    names = [*model.feature_columns, *(ONE_HOT if model.chain is not None else [])]
    slim = rows.select(*key, *[F.col(c).cast("double").alias(c) for c in cols], target)
    slim = slim.withColumn("__h", F.xxhash64(F.lit(seed), *key))
    ranked = cut_lineage(with_row_index(slim, ("__h", *key), group_keys=(), out="__rank"), "ranked")
    # 0 stands for the rows as they are; the offset is one of 1 .. n - 1.
    which = F.explode(F.sequence(F.lit(0), F.lit(len(cols))))
    offset = 1 + F.pmod(F.xxhash64(F.lit(seed), F.col("__f")), F.greatest(F.col("group_rows") - 1, F.lit(1)))
    moved = ranked.withColumn("__f", which)
    moved = moved.withColumn("__from", F.pmod(F.col("__rank") + F.when(F.col("__f") > 0, offset).otherwise(0), F.col("group_rows")))
    given = ranked.select(F.col("__rank").alias("__from"), F.array(*cols).alias("__given"))
    met = moved.join(given, "__from")
    met = met.withColumns({c: F.when(F.col("__f") == i, F.col("__given")[i - 1]).otherwise(F.col(c)) for i, c in enumerate(cols, start=1)})
    feature = F.element_at(F.array(F.lit("__baseline"), *[F.lit(n) for n in names]), F.col("__f") + 1)
    scored = score(model, met.drop("__given")).select(feature.alias("feature"), F.col(target).alias("y_true"), F.col("prediction").alias("y_pred"))
    rm = fitted(evaluate.error_metrics(scored, ("feature",)).select("feature", "rmse"), "permuted")
    base = rm.where("feature = '__baseline'").select(F.col("rmse").alias("baseline_rmse"))  # one row
    out = rm.where("feature <> '__baseline'").withColumnRenamed("rmse", "permuted_rmse").crossJoin(F.broadcast(base))
    return out.withColumn("importance", F.col("permuted_rmse") - F.col("baseline_rmse"))


# ------------------------------------------------------------------------ S6 S7
_CONFIG = T.StructType(
    [
        T.StructField("gbt", T.StructType([T.StructField(f.name, {"int": T.LongType(), "float": T.DoubleType()}.get(f.type, T.StringType())) for f in fields(GBTParams)])),
        T.StructField("target", T.StringType()),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("more", T.MapType(T.StringType(), T.StringType())),
    ]
)
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("model_type", T.StringType()),
        T.StructField("training_date", T.StringType()),
        T.StructField("config", _CONFIG),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("feature_count", T.IntegerType()),
    ]
)


def save_model(model: TrainedModel, path: str, config: dict | None = None) -> str:
    """Pipeline under ``path/model``, the feature chain's tables under
    ``path/chain``, one JSON document under ``path/metadata``."""
    spark = SparkSession.getActiveSession()
    model.model.write().overwrite().save(os.path.join(path, "model"))
    if model.chain is not None:
        model.chain.write().overwrite().save(os.path.join(path, "chain"))
    settings = (asdict(model.params), model.target, list(model.feature_columns), {k: str(v) for k, v in (config or {}).items()})
    fixed = spark.createDataFrame([(model.model_type, model.trained_at, settings)], T.StructType(METADATA_SCHEMA.fields[:3]))
    names = model.names(spark).agg(F.array_sort(F.collect_list(F.struct("position", "feature"))).alias("n"))  # one document by nature
    doc = fixed.crossJoin(names).select("model_type", "training_date", "config", F.col("n.feature").alias("feature_columns"), F.size("n").alias("feature_count"))
    doc.coalesce(1).write.mode("overwrite").json(os.path.join(path, "metadata"))
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Nested metadata document, on one line or indented, as one typed row."""
    return spark.read.schema(METADATA_SCHEMA).option("multiLine", True).json(os.path.join(path, "metadata"))


def metadata_features(meta: DataFrame) -> DataFrame:
    """One row per feature with its 1-based position."""
    return meta.select("model_type", F.posexplode("feature_columns").alias("pos", "feature")).select(
        "model_type", (F.col("pos") + 1).alias("position"), "feature"
    )


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """The saved model with its target, settings and feature chain; raises on
    another type."""
    meta = read_metadata(spark, path).first()
    if meta is None or meta["model_type"] not in MODEL_TYPES:
        raise ValueError(f"cannot load a model of type {meta and meta['model_type']!r} from {path}")
    config = meta["config"]
    pipeline = PipelineModel.load(os.path.join(path, "model"))
    chained = any(isinstance(s, OneHotEncoderModel) for s in pipeline.stages)
    return TrainedModel(
        pipeline,
        list(config["columns"]),
        target=config["target"],
        params=GBTParams(**{k: v for k, v in config["gbt"].asDict().items() if v is not None}),
        trained_at=meta["training_date"],
        model_type=meta["model_type"],
        chain=FeatureChainModel.load(os.path.join(path, "chain")) if chained else None,
    )
