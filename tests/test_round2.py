"""Loading by name, rounding, vectors without a cap, the shared folder."""

import pytest
from pyspark.sql import functions as F

from kharif.functions.numeric import round_half_up
from kharif.operators import features
from kharif.schema import REQUIRED_COLUMNS
from kharif.sources import io

ROW = {
    "date": "2024-01-07", "state": "S", "district": "D", "market": "M", "crop": "rice", "variety": "V", "min_price": "90",
    "max_price": "110", "modal_price": "100.5", "arrival_qty": "5", "acreage_estimate": "1", "rainfall_mm": "0", "temp_c": "20",
    "govt_policy_flag": "0", "holiday_flag": "1",
}


def _csv(folder, names, row=ROW, name="a.csv"):
    (folder / name).write_text(",".join(names) + "\n" + ",".join(row.get(n, "x") for n in names) + "\n")
    return str(folder)


def test_csv_columns_go_by_name(spark, tmp_path):
    got = io.load_observations(spark, _csv(tmp_path, ["extra", *reversed(REQUIRED_COLUMNS)])).collect()
    assert got[0]["min_price"] == 90.0 and got[0]["max_price"] == 110.0 and got[0]["crop"] == "rice" and got[0]["variety"] == "V"
    assert list(got[0].asDict()) == list(REQUIRED_COLUMNS) and got[0]["holiday_flag"] == 1


def test_csv_missing_column_raises(spark, tmp_path):
    with pytest.raises(ValueError, match="min_price"):
        io.load_observations(spark, _csv(tmp_path, [c for c in REQUIRED_COLUMNS if c != "min_price"]))


def test_csv_unreadable_values_are_counted(spark, tmp_path):
    path = _csv(tmp_path, list(REQUIRED_COLUMNS), ROW | {"date": "7 Jan", "modal_price": "n/a"})
    row = io.load_observations(spark, path).first()
    assert row["date"] is None and row["modal_price"] is None and row["max_price"] == 110.0
    bad = {r["column_name"]: r["unreadable"] for r in io.unreadable(spark, path).collect()}
    assert {c for c, n in bad.items() if n} == {"date", "modal_price"}


def test_rounding_is_by_double_product(spark):
    got = spark.sql("select 2.675D a, 1.115D b").select(round_half_up("a"), round_half_up("b")).first()
    assert tuple(got) == (2.68, 1.12) and (round(2.675, 2), round(1.115, 2)) == (2.67, 1.11)


def test_one_hot_vector_has_no_cap(spark):
    df = spark.range(2000).select(F.format_string("v%04d", "id").alias("variety"))
    model = features.fit_one_hot_vector(df)
    new = spark.createDataFrame([("v0000",), ("v1999",), ("unseen",), (None,)], "variety string")
    got = [r["variety_onehot"] for r in features.one_hot_vector(new, model).collect()]
    assert [v.size for v in got] == [2000] * 4
    assert [list(v.indices) for v in got] == [[0], [1999], [], []]
