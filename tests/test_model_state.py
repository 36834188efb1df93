"""Saved models and the gap of the horizon split."""

import datetime as dt
import json
import os

import pytest

from kharif.operators import split
from kharif.plans import model
from kharif.session import shared_path


def test_loaded_model_has_target_and_params(spark):
    rows = [(float(i), float(i % 7), 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, target_future double")
    params = model.GBTParams(max_iter=2, max_depth=2, seed=7)
    fitted = model.train_gbt(df, ["a", "b"], "target_future", params)
    path = model.save_model(fitted, shared_path(spark, "model"))
    loaded = model.load_model(spark, path)
    assert (loaded.target, loaded.params, loaded.feature_columns) == ("target_future", params, ["a", "b"])
    assert model.score(loaded, df).collect() == model.score(fitted, df).collect()


def test_indented_metadata_and_unknown_type(spark, tmp_path):
    path = str(tmp_path)
    os.makedirs(os.path.join(path, "metadata"))
    doc = {"model_type": "other", "training_date": "x", "config": {"gbt": {"max_iter": 3}}, "feature_columns": ["a"], "feature_count": 1}
    with open(os.path.join(path, "metadata", "part.json"), "w") as f:
        json.dump(doc, f, indent=4)
    assert [tuple(r) for r in model.metadata_features(model.read_metadata(spark, path)).collect()] == [("other", 1, "a")]
    with pytest.raises(ValueError, match="other"):
        model.load_model(spark, path)


def test_horizon_split_leaves_a_gap(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day + dt.timedelta(7 * i), "m", "rice", "v", "s", "d", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "date date, market string, crop string, variety string, state string, district string, modal_price double")
    long = split.horizon_split(split.horizon_targets(df, (1, 4), min_rows=1)).collect()
    train_end = max(r.date for r in long if r.split != "test")
    assert all(r.target_date <= train_end for r in long if r.split == "train")
    assert sum(r.split == "gap" for r in long) == 1 + 4
