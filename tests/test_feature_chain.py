"""The fitted feature chain: state as tables, saved, loaded, applied to new rows."""

import pytest
from pyspark.sql import functions as F

from kharif.operators import features
from kharif.plans import jobs, model
from kharif.plans.feature_chain import SERIES_ID, TABLES, FeatureChain, FeatureChainModel
from kharif.session import cut_lineage, shared_path
from kharif.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def obs(spark):
    return cut_lineage(fixtures.observations(spark, SF), "observations")


@pytest.fixture(scope="module")
def result(obs):
    return jobs.training_job(obs, model.GBTParams(max_iter=12, max_depth=4))


def told(df):
    return sorted(map(str, df.collect()))


def test_state_comes_from_the_fitted_rows_and_survives_saving(spark, obs):
    old = obs.where("date < '1999-01-01'")
    fitted, rows = FeatureChain(excludeCurrent=True, warmup="drop").fit_rows(old)
    assert set(fitted.state) == set(TABLES)
    path = shared_path(spark, "chain")
    fitted.write().save(path)
    loaded = FeatureChainModel.load(path)
    assert loaded.getOrDefault("warmup") == "drop" and loaded.getOrDefault("excludeCurrent")
    for name in TABLES:
        assert told(loaded.state[name]) == told(fitted.state[name])
    # The rows it was fitted on, then unseen ones with a category nobody has seen.
    assert told(loaded.transform(old)) == told(rows)
    new = obs.where("date >= '1998-06-01'").withColumn("market", F.when(F.col("market") == "NATION_3", "elsewhere").otherwise(F.col("market")))
    a, b = fitted.transform(new), loaded.transform(new)
    assert a.count() > 0 and told(a) == told(b)
    prior = loaded.state["codes"].where("category is null and column_name = 'market'").select("crop", F.col("code").alias("prior"))
    odd = b.where("market = 'elsewhere'").join(prior, "crop")
    assert odd.count() == odd.where("market_encoded = prior").count()
    assert b.where(F.col("lag_12").isNull()).count() == 0


def test_saved_model_scores_raw_observations(spark, obs, result):
    path = shared_path(spark, "model")
    model.save_model(result.model, path)
    loaded = model.load_model(spark, path)
    assert loaded.params == result.model.params and loaded.feature_columns == result.model.feature_columns
    test = result.frame.where("split = 'test'")
    want = model.score(result.model, test).select(*SERIES_ID, F.round("prediction", 6).alias("p"))
    got = model.score_observations(loaded, obs).select(*SERIES_ID, F.round("prediction", 6).alias("p")).join(test.select(*SERIES_ID), SERIES_ID)
    assert told(got) == told(want)
    names = [r["feature"] for r in model.metadata_features(model.read_metadata(spark, path)).orderBy("position").collect()]
    varieties = [r[0] for r in features.category_vocabulary(obs, "variety").collect()]
    assert names[: len(loaded.feature_columns)] == loaded.feature_columns
    assert set(names[len(loaded.feature_columns) :]) <= {f"variety_{v}" for v in varieties} | {f"crop_is_{c[0]}" for c in obs.select("crop").distinct().collect()}
    assert loaded.model.stages[-1].numFeatures == len(names)


def test_model_beats_the_last_price(result):
    errors = {(r["crop"], r["forecast"]): r["rmse"] for r in result.metrics.collect()}
    crops = {c for c, _ in errors}
    assert sum(errors[c, "gbt"] < errors[c, "lag_1"] for c in crops) > len(crops) / 2


def test_permutation_is_stable_and_one_join(result):
    test = result.frame.where("split = 'test'")
    a = model.permutation_importance(result.model, test, SERIES_ID)
    b = model.permutation_importance(result.model, test.repartition(3), SERIES_ID)
    key = lambda df: sorted((r["feature"], round(r["permuted_rmse"], 6)) for r in df.collect())
    assert key(a) == key(b) and a.count() == len(result.model.feature_columns) + 2
    assert model.permutation_importance(result.model, test, SERIES_ID, seed=1).first()["baseline_rmse"] == pytest.approx(a.first()["baseline_rmse"])
