"""Quarantined lines, published models, idempotent micro-batches, run summary."""

import pytest
from pyspark.sql import functions as F

from kharif.operators import forecast
from kharif.plans import jobs, model, registry
from kharif.queries import RUN_DATE
from kharif.schema import REQUIRED_COLUMNS
from kharif.session import cut_lineage, shared_path
from kharif.sources import fixtures, io
from kharif.streaming import scoring

SF = "/root/testdata/sf0.001"
SMALL = model.GBTParams(max_iter=12, max_depth=4)


@pytest.fixture(scope="module")
def obs(spark):
    return cut_lineage(fixtures.observations(spark, SF), "observations")


@pytest.fixture(scope="module")
def result(obs):
    return jobs.training_job(obs, SMALL)


def _value(i, c):
    return {"date": f"2024-01-{i + 1:02d}", "holiday_flag": "1", "govt_policy_flag": "0"}.get(c, f"{i}" if c.endswith(("price", "qty", "mm", "_c", "estimate")) else f"{c}{i}")


def test_loaded_and_rejected_lines_are_all_lines(spark, tmp_path):
    names = ["note", *reversed(REQUIRED_COLUMNS)]
    line = lambda i, **own: ",".join(own.get(c, _value(i, c)) for c in names)
    lines = [line(0), line(1, modal_price="n/a"), line(2, date="7 Jan", temp_c="x"), "x,1,0", line(4) + ",more", line(5, modal_price=""), "", line(6, note='"a, b"')]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), *lines]) + "\n")
    loaded, rejected = io.quarantine(spark, str(tmp_path))
    assert {(r["state"], r["modal_price"]) for r in loaded.collect()} == {("state0", 0.0), ("state5", None), ("state6", 6.0)}
    assert loaded.columns == list(REQUIRED_COLUMNS)
    told = {r["line"]: (r["reason"], r["file"].rsplit("/", 1)[1]) for r in rejected.collect()}
    assert told == {lines[1]: ("modal_price", "a.csv"), lines[2]: ("date,temp_c", "a.csv"), lines[3]: ("fields", "a.csv"), lines[4]: ("fields", "a.csv")}
    (tmp_path / "a.csv").write_text("date,state\n2024-01-01,x\n")
    with pytest.raises(ValueError, match="Missing columns"):
        io.quarantine(spark, str(tmp_path))


def test_model_beats_the_lag_1_forecast_and_summary_is_observed(spark, result):
    told = result.metrics.groupBy("forecast").agg(F.avg("rmse").alias("rmse"))
    rmse = {r["forecast"]: r["rmse"] for r in told.collect()}
    assert rmse["gbt"] < rmse["lag_1"]
    doc = jobs.write_summary(result, shared_path(spark, "summary")).first()
    by = {k: result.frame.where(F.col("split") == k).count() for k in ("train", "test")}
    assert (doc["data_info"]["train_samples"], doc["data_info"]["test_samples"]) == (by["train"], by["test"])
    assert doc["data_info"]["processed_records"] == result.frame.count() < doc["data_info"]["original_records"]
    assert list(doc["models_trained"]) == ["gbt"] and doc["config"]["max_iter"] == 12
    assert doc["feature_info"]["total_features"] == len(doc["feature_info"]["feature_list"]) == result.model.names(spark).count()


def test_only_checked_models_are_published(spark, obs, monkeypatch):
    data, root = shared_path(spark, "csv"), shared_path(spark, "models")
    io.write_csv(obs, data)
    with pytest.raises(ValueError, match="lstm"):
        registry.retrain(spark, "/no/such/path", root, "lstm")
    with pytest.raises(LookupError):
        registry.current(spark, root)
    registry.retrain(spark, data, root, "forest", params=model.GBTParams(max_iter=3, max_depth=3))
    assert registry.current(spark, root).model_type == "forest"
    real = model.load_model

    def other(*args):
        loaded = real(*args)
        loaded.model.stages[-1].setPredictionCol("lost")
        loaded.model.stages.append(model.SQLTransformer(statement="SELECT *, lost + 1 AS prediction FROM __THIS__"))
        return loaded

    monkeypatch.setattr(registry.model, "load_model", other)
    with pytest.raises(ValueError, match="not published"):
        registry.retrain(spark, data, root, params=model.GBTParams(max_iter=2, max_depth=2))
    monkeypatch.undo()
    assert registry.published(spark, root).count() == 1 and registry.current(spark, root).model_type == "forest"
    registry.retrain(spark, data, root, params=model.GBTParams(max_iter=2, max_depth=2))
    assert registry.current(spark, root).model_type == "gbt"
    assert [r["sequence"] for r in registry.published(spark, root).orderBy("sequence").collect()] == [1, 2]


def test_a_batch_that_fails_half_way_is_written_once(spark, result):
    src, out, ck = (shared_path(spark, x) for x in ("requests", "out", "ckpt"))
    raw = fixtures.forecast_requests(spark, SF)
    raw.repartition(3, "request_id").write.parquet(src)
    score = scoring.model_scorer(result.frame, result.model, RUN_DATE)
    calls = []

    def fails_in_the_second(batch):
        rows, rejected = score(batch)
        calls.append(1)
        # the second batch: forecasts are written, the rejects fail
        return (rows, rejected.withColumn("reason", F.raise_error(F.lit("lost")))) if len(calls) == 2 else (rows, rejected)

    stream = lambda: scoring.request_stream(spark, src, 1)
    with pytest.raises(Exception, match="lost"):
        scoring.run_batches(stream(), fails_in_the_second, out, ck)
    scoring.run_batches(stream(), score, out, ck)
    rows, rejected = scoring.accepted_rows(spark, out), scoring.rejected_rows(spark, out)
    ids = [r[0] for r in rows.select("request_id").distinct().collect()] + [r[0] for r in rejected.select("request_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in raw.select("request_id").collect()) and rejected.count() > 0
    assert rows.select("batch").distinct().count() == 3
    batch, _, refused = jobs.forecast_job(raw, result.frame, result.model, RUN_DATE)
    told = lambda df: sorted(map(str, df.select("request_id", "week", "modal_price", "source").collect()))
    assert told(rows) == told(batch)
    assert sorted(map(str, rejected.select("request_id", "reason").collect())) == sorted(map(str, refused.select("request_id", "reason").collect()))
    assert forecast.rejected(forecast.validate_requests(forecast.normalise_requests(raw), RUN_DATE)).count() == rejected.count()
