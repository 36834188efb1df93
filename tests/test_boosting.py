"""Stages, patience and fits that run at once."""

import random

import pytest
from pyspark.sql import functions as F

from kharif.operators import evaluate, split
from kharif.plans import model
from kharif.plans.boosting import fit_all, grow
from kharif.session import shared_path


def _rows(spark, n=600, noise=0.3):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        a, b = draw.uniform(-2, 2), draw.uniform(-2, 2)
        rows.append((i, a, b, a * a + (b if a > 0 else -b) + draw.gauss(0, noise), i % 5 == 0))
    return spark.createDataFrame(rows, "id long, a double, b double, modal_price double, is_validation boolean")


def test_growth_ends_by_patience_and_keeps_the_best_tree(spark):
    df = _rows(spark, 300, noise=1.0).coalesce(1)
    p = model.GBTParams(max_iter=60, step_size=0.5, max_depth=3, stage_trees=4, patience=6, seed=3)
    told = model.PipelineModel(model.preparation(["a", "b"])).transform(df)
    stages, errors = grow(told, "modal_price", "is_validation", p)
    best = min(range(len(errors)), key=errors.__getitem__)
    assert len(errors) < 60 and len(errors) - 1 - best >= 6
    assert sum(s.getNumTrees for s in stages) == best + 1
    # one partition: the same rows in the same order give the same trees again
    fitted = model.train_gbt(df, ["a", "b"], params=p, validation_col="is_validation")
    assert [e.getNumTrees for e in model.ensembles(fitted)] == [s.getNumTrees for s in stages]
    held = model.score(fitted, df).where("is_validation")
    assert set(held.columns) == {*df.columns, "prediction"}
    mse = held.agg(F.avg(F.pow(F.col("modal_price") - F.col("prediction"), 2))).first()[0]
    assert mse == pytest.approx(errors[best], rel=1e-6)


def test_several_stages_score_as_their_sum(spark):
    df = _rows(spark, 300, noise=0.01).coalesce(1)
    p = model.GBTParams(max_iter=6, max_depth=2, stage_trees=2, patience=6, seed=3)
    fitted = model.train_gbt(df, ["a", "b"], params=p, validation_col="is_validation")
    assert len(model.ensembles(fitted)) == 3 and set(model.score(fitted, df).columns) == {*df.columns, "prediction"}
    loaded = model.load_model(spark, model.save_model(fitted, shared_path(spark, "model")))
    assert model.score(loaded, df).orderBy("id").collect() == model.score(fitted, df).orderBy("id").collect()
    one = model.train_gbt(df.where("not is_validation"), ["a", "b"], params=model.GBTParams(max_iter=2, max_depth=2, seed=3))
    error = lambda m: model.score(m, df.where("is_validation")).agg(F.avg(F.pow(F.col("modal_price") - F.col("prediction"), 2))).first()[0]
    assert error(fitted) < error(one)
    got = {r["feature"]: r["importance"] for r in model.feature_importance(fitted, spark).collect()}
    assert set(got) == {"a", "b"} and sum(got.values()) == pytest.approx(1.0)


def test_without_held_rows_all_trees_grow(spark):
    df = _rows(spark, 80).withColumn("is_validation", F.lit(None).cast("boolean"))
    fitted = model.train_gbt(df, ["a", "b"], params=model.GBTParams(max_iter=4, max_depth=2), validation_col="is_validation")
    assert [e.getNumTrees for e in model.ensembles(fitted)] == [4]


def test_folds_are_ranges_and_equal_the_copied_folds(spark):
    df = _rows(spark, 240).withColumns({"row_index": F.col("id"), "group_rows": F.lit(240).cast("long")})
    p = model.GBTParams(max_iter=2, max_depth=2, subsample=1.0, feature_subset="all")
    got = {r["fold"]: r for r in model.cross_validate(df, ["a", "b"], 3, params=p).collect()}
    folds = split.expanding_folds(df, 3)
    for k in range(3):
        own = folds.where(F.col("fold") == k)
        m = model.train_gbt(own.where("role = 'train'"), ["a", "b"], params=p)
        scored = model.score(m, own.where("role = 'test'")).select(F.col("modal_price").alias("y_true"), F.col("prediction").alias("y_pred"))
        assert got[k]["rmse"] == pytest.approx(evaluate.error_metrics(scored, ()).first()["rmse"])
    with pytest.raises(ValueError, match="no rows"):
        model.cross_validate(df.limit(0), ["a", "b"], 3, params=p)


def test_fits_run_at_once_and_errors_are_raised(spark):
    assert fit_all(spark, {k: (lambda k=k: spark.range(k).count()) for k in (3, 1, 2)}) == {3: 3, 1: 1, 2: 2}
    assert fit_all(spark, {}) == {}

    def bad():
        raise RuntimeError("no fit")

    with pytest.raises(RuntimeError, match="no fit"):
        fit_all(spark, {1: bad, 2: lambda: 2})


def test_forest_is_a_second_type(spark):
    df = _rows(spark, 200)
    p = model.GBTParams(max_iter=3, max_depth=3)
    fitted = model.trainer("forest")(df, ["a", "b"], params=p)
    loaded = model.load_model(spark, model.save_model(fitted, shared_path(spark, "model")))
    assert loaded.model_type == "forest" and model.score(loaded, df).orderBy("id").collect() == model.score(fitted, df).orderBy("id").collect()
    with pytest.raises(ValueError, match="lstm"):
        model.trainer("lstm")
