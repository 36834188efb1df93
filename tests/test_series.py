"""One series holds half of all rows: time shards give the windows' results."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kharif.operators import clean, features, series

KEYS = ["market", "crop"]
ID = ["date", "state", "district", "market", "crop", "variety"]


@pytest.fixture(scope="module")
def rows(spark):
    draw, out = random.Random(7), []
    some = lambda v, p=0.3: None if draw.random() < p else v
    for market, days, varieties in (("hot", 400, "ab"), ("m1", 150, "a"), ("m2", 250, "ab"), (None, 100, "a"), ("m3", 3, "b")):
        for d in range(days):
            for v in varieties:
                # Some dates hold many rows, so cuts are uneven; the first weeks have no price.
                for k in range(9 if d % 61 == 60 else 1):
                    price = None if d < 30 else some(100.0 + draw.random() * 50)
                    out.append((dt.date(2020, 1, 1) + dt.timedelta(d), "s", f"d{k}", market, "rice", v, price, some(price), price, some(draw.random() * 9), 1.0, some(2.0), some(3.0), some(1), None))
    names = "date date, state string, district string, market string, crop string, variety string, min_price double, max_price double, modal_price double, arrival_qty double, acreage_estimate double, rainfall_mm double, temp_c double, govt_policy_flag int, holiday_flag int"
    return spark.createDataFrame(out, names).repartition(4).cache()


def told(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("rows_a_shard", [7, 40])
def test_fills_are_equal(rows, rows_a_shard):
    assert told(clean.impute(rows, shard_rows=rows_a_shard)) == told(clean.impute(rows))


@pytest.mark.parametrize("rows_a_shard", [5, 40])
@pytest.mark.parametrize("exclude", [False, True])
def test_lags_and_rolling_statistics_are_equal(rows, rows_a_shard, exclude):
    rounded = lambda df: df.withColumns({c: F.round(c, 6) for c in df.columns if "rolling" in c})
    whole = features.add_series_features(rows, exclude_current=exclude)
    parts = features.add_series_features(rows, exclude_current=exclude, shard_rows=rows_a_shard)
    assert parts.columns == whole.columns and told(rounded(parts)) == told(rounded(whole))


def test_the_largest_task_is_small(rows):
    """No key of the window's exchange has a tenth of the rows, halos included."""
    big = series.large_series(rows, KEYS, 40)
    cut = series.in_shards(rows, series.shard_map(rows, big, KEYS, "date", 40, halo=12), KEYS)
    most = cut.groupBy(*KEYS, series.SHARD).count().agg(F.max("count")).first()[0]
    assert most < rows.count() / 10 < rows.groupBy(*KEYS).count().agg(F.max("count")).first()[0]
    assert cut.where(~F.col(series.HALO)).count() == rows.count()
