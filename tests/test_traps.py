"""Hand-made frames with literal expectations for the semantic traps of
"""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kharif.functions import pricing
from kharif.functions.calendar import month_end, week_ending_monday
from kharif.operators import clean, evaluate, features, forecast, rollup, split
from kharif.schema import OBSERVATION_SCHEMA

D = dt.date


def obs_rows(spark, rows):
    """rows: dicts with a subset of the observation columns."""
    cols = [f.name for f in OBSERVATION_SCHEMA.fields]
    full = [tuple(r.get(c) for c in cols) for r in rows]
    return spark.createDataFrame(full, OBSERVATION_SCHEMA)


def base(date, **kw):
    r = dict(date=date, state="S", district="M", market="M", crop="rice", variety="V")
    r.update(kw)
    return r


# --------------------------------------------------------------------- T1 T2
def test_week_label_ends_on_monday(spark):
    df = spark.createDataFrame([(D(2024, 1, 7),), (D(2024, 1, 8),), (D(2024, 1, 9),)], "d date")
    got = [r[0] for r in df.select(week_ending_monday("d")).collect()]
    assert got == [D(2024, 1, 8), D(2024, 1, 8), D(2024, 1, 15)]


def test_month_label_is_month_end(spark):
    df = spark.createDataFrame([(D(2024, 2, 3),), (D(2023, 2, 28),)], "d date")
    assert [r[0] for r in df.select(month_end("d")).collect()] == [D(2024, 2, 29), D(2023, 2, 28)]


def test_unknown_frequency_raises(spark):
    df = obs_rows(spark, [base(D(2024, 1, 1), modal_price=1.0)])
    with pytest.raises(ValueError):
        rollup.rollup(df, "hourly")


# --------------------------------------------------------------------- T13 T14
def test_calendar_year_with_iso_week_and_monday_zero(spark):
    df = spark.createDataFrame([(D(2021, 1, 3),), (D(2024, 1, 8),)], "date date")
    rows = df.select(*__import__("kharif.functions.calendar", fromlist=["x"]).calendar_columns("date")).collect()
    assert (rows[0]["year"], rows[0]["week_of_year"], rows[0]["day_of_week"]) == (2021, 53, 6)
    assert rows[1]["day_of_week"] == 0


# --------------------------------------------------------------------- W1 T7 T9 A4
def test_forward_then_back_fill_per_series(spark):
    rows = [
        base(D(2024, 1, 1), modal_price=None),
        base(D(2024, 1, 2), modal_price=10.0),
        base(D(2024, 1, 3), modal_price=None),
        base(D(2024, 1, 4), modal_price=20.0),
        base(D(2024, 1, 5), modal_price=None),
        base(D(2024, 1, 1), variety="W", modal_price=None),  # all-NULL series -> 0
        base(D(2024, 1, 1), market=None, modal_price=None, arrival_qty=None),  # NULL key -> 0
    ]
    out = clean.impute(obs_rows(spark, rows)).orderBy("market", "variety", "date").collect()
    v = [(r["market"], r["variety"], r["modal_price"]) for r in out]
    assert v == [
        (None, "V", 0.0),
        ("M", "V", 10.0), ("M", "V", 10.0), ("M", "V", 10.0), ("M", "V", 20.0), ("M", "V", 20.0),
        ("M", "W", 0.0),
    ]
    assert all(r["govt_policy_flag"] == 0 for r in out)


def test_group_median_fill(spark):
    rows = [base(D(2024, 1, i), modal_price=1.0, arrival_qty=a) for i, a in enumerate([1.0, None, 3.0, 10.0], start=1)]
    out = clean.impute(obs_rows(spark, rows)).orderBy("date").collect()
    assert [r["arrival_qty"] for r in out] == [1.0, 3.0, 3.0, 10.0]


def test_no_null_numeric_after_imputation(spark):
    rows = [base(D(2024, 1, i), modal_price=None if i % 2 else float(i), rainfall_mm=None) for i in range(1, 8)]
    out = clean.impute(obs_rows(spark, rows))
    nulls = out.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in clean.numeric_columns(out)]).first()
    assert all(v == 0 for v in nulls)


# --------------------------------------------------------------------- P6 T10
def test_winsorize_bounds_match_linear_quantiles(spark):
    vals = [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 100.0, -50.0, 2.2, 2.8]
    rows = [base(D(2024, 1, i + 1), modal_price=v, min_price=v, max_price=v) for i, v in enumerate(vals)]
    df = obs_rows(spark, rows)
    q1, q3 = np.percentile(vals, 5), np.percentile(vals, 95)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    b = clean.outlier_bounds(df).first()
    assert math.isclose(b["modal_price_lower"], lo) and math.isclose(b["modal_price_upper"], hi)
    got = sorted(r[0] for r in clean.winsorize(df).select("modal_price").collect())
    assert got == sorted(float(np.clip(v, lo, hi)) for v in vals)


# --------------------------------------------------------------------- A1 T11
def test_weekly_rollup_measures(spark):
    rows = [
        base(D(2024, 1, 2), modal_price=10.0, arrival_qty=1.0, acreage_estimate=5.0, govt_policy_flag=0),
        base(D(2024, 1, 3), modal_price=20.0, arrival_qty=2.0, acreage_estimate=7.0, govt_policy_flag=1),
        base(D(2024, 1, 4), modal_price=30.0, arrival_qty=3.0, acreage_estimate=None, govt_policy_flag=0),
        base(D(2024, 1, 9), modal_price=40.0, arrival_qty=4.0, acreage_estimate=9.0),
    ]
    out = rollup.rollup(obs_rows(spark, rows), "weekly").orderBy("date").collect()
    assert [r["date"] for r in out] == [D(2024, 1, 8), D(2024, 1, 15)]
    first = out[0]
    assert first["modal_price"] == 20.0 and first["arrival_qty"] == 6.0
    assert first["acreage_estimate"] == 7.0  # last non-null in date order
    assert first["govt_policy_flag"] == 1


def test_rollup_preserves_arrival_total(spark):
    rows = [base(D(2024, 1, 1) + dt.timedelta(days=i), modal_price=1.0, arrival_qty=float(i)) for i in range(40)]
    df = obs_rows(spark, rows)
    total = df.agg(F.sum("arrival_qty")).first()[0]
    for freq in ("weekly", "monthly"):
        assert rollup.rollup(df, freq).agg(F.sum("arrival_qty")).first()[0] == total


# --------------------------------------------------------------------- W2-W6 T4-T6
def test_lags_and_rolling_stay_in_series(spark):
    rows = []
    for m, offset in (("A", 0.0), ("B", 100.0)):
        for i in range(5):
            rows.append(base(D(2024, 1, 1) + dt.timedelta(days=7 * i), market=m, modal_price=offset + i, arrival_qty=1.0))
    out = features.add_series_features(obs_rows(spark, rows)).orderBy("market", "date").collect()
    b0 = [r for r in out if r["market"] == "B"][0]
    assert b0["lag_1"] is None and b0["rolling_std_4"] is None and b0["rolling_mean_4"] == 100.0
    a = [r for r in out if r["market"] == "A"]
    assert [r["lag_1"] for r in a] == [None, 0.0, 1.0, 2.0, 3.0]
    assert a[4]["rolling_mean_4"] == pytest.approx(np.mean([1, 2, 3, 4]))
    assert a[4]["rolling_std_4"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


# --------------------------------------------------------------------- A7 J2 T21
def test_target_encoder_smoothing_and_unseen(spark):
    rows = [base(D(2024, 1, i + 1), market="A", modal_price=10.0) for i in range(30)]
    rows += [base(D(2024, 1, i + 1), market="B", modal_price=40.0) for i in range(10)]
    df = obs_rows(spark, rows)
    enc = features.fit_target_encoder(df, "market")
    prior = (30 * 10 + 10 * 40) / 40
    codes = {r["category"]: r["code"] for r in enc.collect()}
    for m, n, mean in (("A", 30, 10.0), ("B", 10, 40.0)):
        w = 1 / (1 + math.exp(-(n - 20) / 10))
        assert codes[m] == pytest.approx(prior * (1 - w) + mean * w)
    new = obs_rows(spark, [base(D(2024, 2, 1), market="Z", modal_price=1.0)])
    got = features.apply_target_encoder(new, "market", enc).first()["market_encoded"]
    assert got == pytest.approx(prior)


# --------------------------------------------------------------------- M1
def test_one_hot_unknown_is_all_zero(spark):
    df = spark.createDataFrame([("a",), ("b",), ("zz",)], "variety string")
    out = features.one_hot(df, "variety", ["a", "b"]).orderBy("variety").collect()
    assert [(r["variety_a"], r["variety_b"]) for r in out] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]


# --------------------------------------------------------------------- P9 T12 (golden)
GOLDEN_34 = [
    "arrival_qty", "acreage_estimate", "rainfall_mm", "temp_c", "govt_policy_flag", "holiday_flag",
    "year", "month", "quarter", "week_of_year", "day_of_week", "is_harvest_month", "month_sin", "month_cos",
    "lag_1", "arrival_lag_1", "lag_2", "arrival_lag_2", "lag_4", "arrival_lag_4", "lag_12", "arrival_lag_12",
    "rolling_mean_4", "rolling_std_4", "arrival_rolling_mean_4", "rolling_mean_12", "rolling_std_12",
    "arrival_rolling_mean_12", "market_encoded", "state_encoded",
    "variety_Basmati", "variety_PR 126", "variety_Sona Masoori", "variety_Swarna",
]


def test_feature_columns_match_saved_model(spark):
    from kharif.plans import chain

    varieties = ["Basmati", "PR 126", "Sona Masoori", "Swarna"]
    rows = [
        base(D(2024, 1, 1) + dt.timedelta(days=7 * i), variety=v, modal_price=1.0 + i, arrival_qty=1.0,
             min_price=1.0, max_price=2.0, acreage_estimate=1.0, rainfall_mm=1.0, temp_c=20.0,
             govt_policy_flag=0, holiday_flag=0)
        for i in range(3) for v in varieties
    ]
    wk = rollup.rollup(obs_rows(spark, rows), "weekly")
    ft = chain.encode(chain.series_features(wk), vocabulary=None)
    cols = features.feature_columns(ft)
    assert cols == GOLDEN_34
    assert len(set(cols)) == 34


# --------------------------------------------------------------------- A11 M2 T20
def test_scaler_population_std_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    sc = features.fit_scaler(df, ["x", "c"])
    out = features.apply_scaler(df, ["x", "c"], sc).orderBy("x").collect()
    sd = np.std([1, 2, 3])
    assert [r["x"] for r in out] == pytest.approx([(v - 2) / sd for v in (1, 2, 3)])
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]


# --------------------------------------------------------------------- P12 P13 P14
def test_snap_horizon_ties_to_smaller(spark):
    df = spark.createDataFrame([(h,) for h in (0, 1, 3, 5, 8, 9, 100)] + [(None,)], "h int")
    got = [r[0] for r in df.select(pricing.snap_horizon("h")).collect()]
    assert got == [1, 1, 2, 4, 4, 12, 12, None]


def test_classes(spark):
    df = spark.createDataFrame([(90.0, 0.15), (80.0, 0.1), (70.0, 0.05)], "c double, v double")
    rows = df.select(pricing.confidence_class("c"), pricing.volatility_class("v")).collect()
    assert [tuple(r) for r in rows] == [("High", "high"), ("Medium", "medium"), ("Low", "low")]


# --------------------------------------------------------------------- P10 P11
def test_request_validation(spark):
    rows = [
        (1, " Kolkata ", "West Bengal", " Rice ", None, None, "2024-10-01"),
        (2, "Delhi", "Delhi", "wheat", "x", 8, "2024-1-5"),
        (3, "Delhi", None, None, "x", 4, "2024-13-45"),
        (4, "Pune", "Maharashtra", "maize", "x", 12, "string"),
    ]
    df = spark.createDataFrame(rows, "request_id long, market string, state string, crop string, variety string, horizon_weeks int, as_of_date string")
    out = {r["request_id"]: r for r in forecast.validate_requests(forecast.normalise_requests(df), "2030-01-01").collect()}
    assert out[1]["status"] == "accepted" and out[1]["crop"] == "rice" and out[1]["variety"] == "PR 126" and out[1]["horizon_weeks"] == 4
    assert out[1]["market"] == "Kolkata"
    assert out[2]["reason"] == "bad_horizon" and out[2]["as_of"] == D(2024, 1, 5)
    assert out[3]["reason"] == "missing_state,bad_date"
    assert out[4]["status"] == "accepted" and out[4]["as_of"] == D(2030, 1, 1)


# --------------------------------------------------------------------- F5 F6 F7
def test_seasonal_price_and_bands(spark):
    df = spark.createDataFrame([(2000.0, 6, 4), (500.0, 6, 12)], "p double, m int, h int")
    r = df.select(
        pricing.seasonal_price("p", "m").alias("x"),
        *pricing.price_band(F.col("p")),
        pricing.confidence_interval(F.col("p"), F.col("h")).alias("ci"),
    ).collect()
    assert r[0]["x"] == 2000.0 and r[1]["x"] == 1000.0  # floor at 1000
    assert tuple(r[0])[1:3] == (1700.0, 2300.0)
    assert (r[0]["ci"]["lower"], r[0]["ci"]["upper"]) == (1840.0, 2160.0)
    assert r[1]["ci"]["lower"] == 500.0  # floor


def test_rule_forecast_first_week(spark):
    df = spark.createDataFrame([(2200.0, 0.08, 1)], "rule_base_price double, volatility double, week int")
    r = forecast.rule_rows(df).first()
    modal = max(2200 * 0.5, 2200 + 0 + 2200 * 0.02)
    assert r["modal_price"] == round(modal, 2)
    assert r["min_price"] == round(max(modal * 0.7, modal - modal * 0.08 * 0.8), 2)


# --------------------------------------------------------------------- A16 W10
def test_headline_ties_and_pct_change(spark):
    rows = [(1, w, p, 4) for w, p in ((1, 100.0), (2, 120.0), (3, 120.0), (4, 90.0))]
    rows += [(2, w, 50.0, 2) for w in (1, 2)]
    df = spark.createDataFrame(rows, "request_id long, week int, modal_price double, horizon_weeks int")
    h = {r["request_id"]: r for r in forecast.headline(df).collect()}
    assert (h[1]["peak_week"], h[1]["trough_week"]) == (2, 4)
    assert h[1]["total_change_pct"] == pytest.approx(-10.0)
    assert h[2]["std_price"] == 0.0
    pc = {(r["request_id"], r["week"]): r["price_change_pct"] for r in forecast.with_pct_change(df).collect()}
    assert pc[(1, 1)] == 0.0 and pc[(1, 2)] == pytest.approx(20.0) and pc[(2, 2)] == 0.0


# --------------------------------------------------------------------- W11 W13
def test_row_index_and_folds(spark):
    df = spark.createDataFrame([("g", i) for i in range(9)] + [("h", i) for i in range(4)], "crop string, k int")
    idx = split.with_row_index(df, ("k",))
    got = {(r["crop"], r["k"]): (r["row_index"], r["group_rows"]) for r in idx.collect()}
    assert got[("g", 0)] == (0, 9) and got[("g", 8)] == (8, 9) and got[("h", 3)] == (3, 4)
    folds = split.expanding_folds(idx.where(F.col("crop") == "g"), 2).collect()
    by = {}
    for r in folds:
        by.setdefault((r["fold"], r["role"]), []).append(r["k"])
    assert sorted(by[(0, "train")]) == [0, 1, 2] and sorted(by[(0, "test")]) == [3, 4, 5]
    assert sorted(by[(1, "train")]) == [0, 1, 2, 3, 4, 5] and sorted(by[(1, "test")]) == [6, 7, 8]


def test_positional_split_counts(spark):
    df = spark.createDataFrame([("g", i) for i in range(10)], "crop string, k int")
    out = split.positional_split(df, ("k",)).collect()
    assert sorted(r["k"] for r in out if r["split"] == "train") == list(range(8))


# --------------------------------------------------------------------- J8 vs brute force
def test_asof_join_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    right = []
    for s in ("A", "B"):
        days = sorted(set(rng.integers(0, 120, 25).tolist()))
        right += [(s, D(2024, 1, 1) + dt.timedelta(days=int(d)), float(d)) for d in days]
    left = [(i, s, D(2024, 1, 1) + dt.timedelta(days=int(rng.integers(-5, 140)))) for i, s in enumerate(["A", "B", "C"] * 30)]
    r = spark.createDataFrame(right, "market string, feature_date date, v double")
    l_ = spark.createDataFrame(left, "id long, market string, as_of date")
    got = {row["id"]: row["v"] for row in forecast.asof_join(l_, r, ["market"], "as_of", "feature_date").collect()}
    for i, s, d in left:
        cands = [v for (m, fd, v) in right if m == s and fd <= d]
        want = max(cands, key=lambda v: v) if cands else None
        best = max(((fd, v) for (m, fd, v) in right if m == s and fd <= d), default=(None, None))[1]
        assert got[i] == best, (i, s, d, got[i], want)


# --------------------------------------------------------------------- A12 W7 J9
def test_error_metrics_match_formulas(spark):
    y = [100.0, 110.0, 90.0, 105.0]
    p = [98.0, 115.0, 95.0, 100.0]
    df = spark.createDataFrame([(1, a, b) for a, b in zip(y, p)], "horizon int, y_true double, y_pred double")
    m = evaluate.error_metrics(df).first()
    e = np.array(y) - np.array(p)
    assert m["rmse"] == pytest.approx(np.sqrt(np.mean(e**2)))
    assert m["mae"] == pytest.approx(np.mean(np.abs(e)))
    assert m["mape"] == pytest.approx(np.mean(np.abs(e) / np.abs(y)) * 100)
    assert m["r2"] == pytest.approx(1 - np.sum(e**2) / np.sum((np.array(y) - np.mean(y)) ** 2))


def test_horizon_targets_stay_in_series(spark):
    rows = [(m, "rice", D(2024, 1, 1) + dt.timedelta(days=7 * i), "V", "S", "D", float(i) + (100 if m == "B" else 0))
            for m in ("A", "B") for i in range(6)]
    df = spark.createDataFrame(rows, "market string, crop string, date date, variety string, state string, district string, modal_price double")
    out = split.horizon_targets(df, (1, 2), min_rows=1).collect()
    for r in out:
        assert r["target_future"] - r["modal_price"] == r["horizon"]
    assert len(out) == 2 * (5 + 4)

