"""Oracle SQL per registered query (DuckDB dialect)."""

from __future__ import annotations

from oracles.sql import (
    ASOF,
    DIMS,
    ENCODED,
    FEATURES30,
    INT_FEATURES,
    FORECAST,
    MODEL_FRAME,
    RH,
    requests_chain,
    rule_rows_cte,
    town_sql,
    DAILY_CLEAN,
    KEYS6,
    MEASURES,
    MEDIANS,
    OBS,
    PRICES,
    R,
    WEEKLY,
    WEEKLY_FEATURES,
    chain,
    impute_cte,
    present,
    rollup_cte,
)

SQL: dict[str, str] = {}
DOUBLE_MEASURES = {"min_price", "max_price", "modal_price", "arrival_qty", "acreage_estimate", "rainfall_mm", "temp_c"}
SERIES_ID = ["date", "market", "crop", "variety", "state", "district"]


def sel(prefix: list[str], cols: list[str], doubles: set[str], src: str) -> str:
    return f"{chain(*prefix)}\nSELECT {present(cols, doubles)} FROM {src}"


SQL["s1_load_observations"] = sel([OBS], KEYS6 + MEASURES, DOUBLE_MEASURES, "obs")
SQL["w1_fill_prices"] = sel([OBS, impute_cte()], KEYS6 + PRICES, set(PRICES), "imp")
SQL["a4_group_medians"] = chain(OBS) + "\nSELECT market, crop, variety, " + ", ".join(
    R(f"median({c})", c) for c in MEDIANS
) + " FROM obs GROUP BY market, crop, variety"
SQL["j7_median_fill"] = sel([OBS, impute_cte()], KEYS6 + MEDIANS, set(MEDIANS), "imp")
SQL["p6_winsorize"] = sel(DAILY_CLEAN, KEYS6 + PRICES, set(PRICES), "win")
_q = "quantile_cont(modal_price, 0.05E0) AS a, quantile_cont(modal_price, 0.95E0) AS b"
SQL["p6_winsorize_report"] = chain(
    OBS, impute_cte(), f"q AS (SELECT crop, {_q} FROM imp GROUP BY crop)", "l AS (SELECT crop, a - 1.5E0 * (b - a) AS lo, b + 1.5E0 * (b - a) AS hi FROM q)",
) + "\nSELECT i.crop, " + R("any_value(lo)", "modal_price_lower") + ", " + R("any_value(hi)", "modal_price_upper") + \
    ", count(*) FILTER (WHERE modal_price < lo OR modal_price > hi) AS modal_price_capped FROM imp i JOIN l ON i.crop = l.crop GROUP BY i.crop"
SQL["a1_weekly_rollup"] = sel(WEEKLY, SERIES_ID + MEASURES, DOUBLE_MEASURES, "wk")
SQL["a2_monthly_rollup"] = sel(DAILY_CLEAN + [rollup_cte(freq="monthly")], SERIES_ID + MEASURES, DOUBLE_MEASURES, "wk")
SQL["a3_daily_passthrough"] = sel(DAILY_CLEAN, KEYS6 + MEASURES, DOUBLE_MEASURES, "win")

_lag = ["lag_1", "lag_2", "lag_4", "lag_12"]
_alag = ["arrival_lag_1", "arrival_lag_2", "arrival_lag_4", "arrival_lag_12"]
SQL["w2_target_lags"] = sel(WEEKLY_FEATURES, SERIES_ID + _lag, set(_lag), "ft")
SQL["w3_arrival_lags"] = sel(WEEKLY_FEATURES, SERIES_ID + _alag, set(_alag), "ft")
SQL["w4_rolling_mean"] = sel(WEEKLY_FEATURES, SERIES_ID + ["rolling_mean_4", "rolling_mean_12"], {"rolling_mean_4", "rolling_mean_12"}, "ft")
SQL["w5_rolling_std"] = sel(WEEKLY_FEATURES, SERIES_ID + ["rolling_std_4", "rolling_std_12"], {"rolling_std_4", "rolling_std_12"}, "ft")
SQL["w6_arrival_rolling_mean"] = sel(
    WEEKLY_FEATURES, SERIES_ID + ["arrival_rolling_mean_4", "arrival_rolling_mean_12"],
    {"arrival_rolling_mean_4", "arrival_rolling_mean_12"}, "ft",
)



SQL["s2_schema_contract"] = SQL["s1_load_observations"]

_checks = [("null_date", "date"), ("null_market", "market"), ("null_crop", "crop"), ("null_modal_price", "modal_price")]
SQL["s3_violations"] = chain(OBS, "w AS (SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {n}" for n, c in _checks)
    + ", count(*) AS row_count, count(*) FILTER (WHERE modal_price <= 0) AS nonpositive_modal_price FROM obs)") + "\n" + " UNION ALL ".join(
    [f"SELECT '{n}' AS check_name, {n} AS observed, {n} > 0 AS violated FROM w" for n, _ in _checks]
    + ["SELECT 'empty_table', row_count, row_count = 0 FROM w", "SELECT 'nonpositive_modal_price', nonpositive_modal_price, nonpositive_modal_price > 0 FROM w"])

SQL["a5_quality_profile"] = chain(OBS) + "\nSELECT count(*) AS total_records, min(date) AS start_date, max(date) AS end_date, " \
    "count(DISTINCT market) AS markets, count(DISTINCT crop) AS crops, count(DISTINCT state) AS states, " \
    f"{R('min(modal_price)', 'min_price')}, {R('max(modal_price)', 'max_price')}, {R('avg(modal_price)', 'mean_price')}, {R('median(modal_price)', 'median_price')}, " \
    + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}" for c in KEYS6 + MEASURES) + " FROM obs"

SQL["a6_load_profile"] = chain(OBS) + "\nSELECT count(*) AS records, min(date) AS start_date, max(date) AS end_date, " \
    "count(DISTINCT market) AS markets, array_to_string(list_sort(list(DISTINCT crop)), ',') AS crops FROM obs"

SQL["p1_filter_crop"] = chain(OBS) + f"\nSELECT {present(KEYS6 + MEASURES, DOUBLE_MEASURES)} FROM obs WHERE crop = 'rice'"
SQL["p2_fill_flags"] = chain(OBS) + "\nSELECT " + ", ".join(KEYS6) + ", COALESCE(govt_policy_flag, 0) AS govt_policy_flag, COALESCE(holiday_flag, 0) AS holiday_flag FROM obs"
SQL["p3_zero_fill_report"] = chain(OBS, impute_cte(zero=False)) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM imp" for c in MEASURES)
SQL["p4_replace_infinite"] = """SELECT l_orderkey, l_linenumber, l_partkey,
 CASE WHEN isinf(x) THEN 0.0E0 ELSE """ + R("x") + """ END AS tax_ratio
 FROM (SELECT *, CASE WHEN l_tax = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax END AS x FROM lineitem)"""
SQL["p5_drop_null_target"] = chain(OBS) + f"\nSELECT {', '.join(KEYS6)}, {R('modal_price', 'modal_price')} FROM obs WHERE modal_price IS NOT NULL"
SQL["p7_coerce_numeric"] = """SELECT event_id,
 TRY_CAST(CASE WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR) WHEN event_id % 3 = 1 THEN event_type
   ELSE ' ' || CAST(user_id AS VARCHAR) || ' ' END AS DOUBLE) AS reading,
 TRY_CAST(props AS DOUBLE) AS props FROM events"""
_p8 = ["lag_1", "lag_12", "arrival_lag_4", "rolling_std_4", "rolling_std_12"]
SQL["p8_median_fill"] = chain(*WEEKLY_FEATURES) + "\nSELECT " + ", ".join(SERIES_ID) + ", " + ", ".join(
    R(f"COALESCE({c}, median({c}) OVER (PARTITION BY crop))", c) for c in _p8) + " FROM ft"

SQL["o1_sorted_output"] = SQL["s1_load_observations"] + " ORDER BY market, crop, date"
SQL["o3_sample_market"] = chain(OBS) + "\nSELECT crop, min(market) AS sample_market FROM obs GROUP BY crop"
SQL["a14_price_by_date"] = chain(OBS, "s AS (SELECT crop, min(market) AS sample_market FROM obs GROUP BY crop)") + \
    f"\nSELECT o.crop, o.market, o.date, {R('avg(o.modal_price)', 'mean_price')} FROM obs o JOIN s ON o.crop = s.crop AND o.market = s.sample_market GROUP BY 1, 2, 3"
SQL["a14_price_by_month"] = chain(OBS) + f"\nSELECT crop, CAST(month(date) AS INTEGER) AS month, {R('avg(modal_price)', 'mean_price')} FROM obs GROUP BY 1, 2"
SQL["a14_price_by_state"] = chain(OBS, "a AS (SELECT crop, state, avg(modal_price) AS m FROM obs GROUP BY crop, state)") + \
    f"\nSELECT crop, state, {R('m', 'mean_price')}, CAST(row_number() OVER (PARTITION BY crop ORDER BY m, state) AS INTEGER) AS position FROM a"
SQL["a15_price_histogram"] = chain(
    OBS,
    "r AS (SELECT crop, min(modal_price) AS lo, max(modal_price) AS hi FROM obs GROUP BY crop)",
    "b AS (SELECT o.crop, CAST(CASE WHEN r.hi - r.lo = 0 THEN 25 ELSE least(floor((o.modal_price - r.lo) / (r.hi - r.lo) * 50), 49) END + 1 AS INTEGER) AS bin, r.lo, r.hi "
    "FROM obs o JOIN r ON o.crop = r.crop WHERE o.modal_price IS NOT NULL)",
) + f"\nSELECT crop, bin, {R('lo + (hi - lo) * (bin - 1) / 50', 'bin_start')}, {R('lo + (hi - lo) * bin / 50', 'bin_end')}, count(*) AS count FROM b GROUP BY crop, bin, lo, hi"
SQL["a17_crop_comparison"] = chain(*WEEKLY, "c AS (SELECT market, crop, avg(modal_price) AS mean_price, min(modal_price) AS min_price, max(modal_price) AS max_price, stddev_samp(modal_price) AS std_price FROM wk GROUP BY market, crop)") + \
    f"\nSELECT market, crop, {R('mean_price', 'mean_price')}, {R('min_price', 'min_price')}, {R('max_price', 'max_price')}, {R('std_price', 'std_price')}, " \
    f"{R('max_price - min_price', 'spread')}, {R('std_price / mean_price', 'cv')}, CAST(rank() OVER (PARTITION BY market ORDER BY mean_price DESC) AS INTEGER) AS rank_in_market FROM c"
SQL["a18_market_trend"] = chain(*WEEKLY, "d AS (SELECT market, crop, date, avg(modal_price) AS p FROM wk GROUP BY market, crop, date)",
    "t AS (SELECT market, crop, regr_slope(p, (date - DATE '1970-01-01') / 7.0E0) AS s, arg_min(p, date) AS f, arg_max(p, date) AS l, count(*) AS points FROM d GROUP BY market, crop)") + \
    f"\nSELECT market, crop, {R('s', 'slope_per_week')}, {R('f', 'first_price')}, {R('l', 'last_price')}, points, {R('(l - f) / f * 100.0E0', 'change_pct')}, " \
    "CASE WHEN l > f THEN 'bullish' ELSE 'bearish' END AS trend FROM t"

SQL["f1_calendar_parts"] = chain(*WEEKLY_FEATURES) + "\nSELECT " + ", ".join(SERIES_ID) + ", year, month, quarter FROM ft"
SQL["f2_iso_week_weekday"] = chain(*WEEKLY_FEATURES) + "\nSELECT " + ", ".join(SERIES_ID) + ", week_of_year, day_of_week FROM ft"
SQL["f3_cyclic_month"] = chain(*WEEKLY_FEATURES) + "\nSELECT " + ", ".join(SERIES_ID) + f", {R('month_sin', 'month_sin')}, {R('month_cos', 'month_cos')} FROM ft"
SQL["f10_weekend_flag"] = chain(OBS) + "\nSELECT " + ", ".join(KEYS6) + ", CASE WHEN isodow(date) IN (6, 7) THEN 1 ELSE 0 END AS weekend_flag FROM obs"
SQL["j1_harvest_flag"] = chain(*WEEKLY_FEATURES) + "\nSELECT " + ", ".join(SERIES_ID) + ", CAST(is_harvest_month AS INTEGER) AS is_harvest_month FROM ft"

_enc_fit = []
for _col in ("market", "state"):
    _enc_fit.append(f"""SELECT s.crop, s.{_col} AS category, s.n, {R('p.prior', 'prior')},
 {R(f"p.prior * (1.0E0 - 1.0E0 / (1.0E0 + exp(-(s.n - 20) / 10.0E0))) + s.mean * (1.0E0 / (1.0E0 + exp(-(s.n - 20) / 10.0E0)))", 'code')},
 '{_col}' AS encoded_column
 FROM (SELECT crop, {_col}, count(*) AS n, avg(modal_price) AS mean FROM wk WHERE {_col} IS NOT NULL AND modal_price IS NOT NULL GROUP BY crop, {_col}) s
 JOIN (SELECT crop, avg(modal_price) AS prior FROM wk GROUP BY crop) p ON s.crop IS NOT DISTINCT FROM p.crop""")
SQL["a7_target_encoder_fit"] = chain(*WEEKLY) + "\n" + "\nUNION ALL\n".join(_enc_fit)
SQL["j2_target_encode"] = chain(*ENCODED) + "\nSELECT " + ", ".join(SERIES_ID) + f", {R('market_encoded', 'market_encoded')}, {R('state_encoded', 'state_encoded')} FROM enc"
SQL["a8_variety_vocabulary"] = chain(*WEEKLY) + "\nSELECT DISTINCT variety FROM wk WHERE variety IS NOT NULL"
SQL["m1_one_hot_variety"] = chain(*WEEKLY, "v AS (SELECT variety, CAST(row_number() OVER (ORDER BY variety) AS INTEGER) AS pos FROM (SELECT DISTINCT variety FROM wk WHERE variety IS NOT NULL))") + \
    "\nSELECT " + ", ".join(f"w.{c}" for c in SERIES_ID) + ", COALESCE(v.pos, 0) AS onehot_position, " \
    "(SELECT CAST(count(*) AS INTEGER) FROM v) AS onehot_width, CASE WHEN v.pos IS NULL THEN 0.0E0 ELSE 1.0E0 END AS onehot_sum FROM wk w LEFT JOIN v ON w.variety = v.variety"
SQL["a9_frequency_table"] = chain(OBS) + f"\nSELECT variety AS value, {R('count(*) / (SELECT count(variety) FROM obs)', 'frequency')} FROM obs WHERE variety IS NOT NULL GROUP BY variety"
SQL["j3_frequency_encode"] = chain(OBS, "fq AS (SELECT variety AS value, count(*) / (SELECT count(variety) FROM obs) AS frequency FROM obs WHERE variety IS NOT NULL GROUP BY variety)") + \
    "\nSELECT " + ", ".join(f"o.{c}" for c in KEYS6) + f", {R('COALESCE(fq.frequency, 0.0E0)', 'variety_frequency')} FROM obs o LEFT JOIN fq ON o.variety = fq.value"

SQL["p9_feature_columns"] = chain(*WEEKLY) + "\nSELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate(FEATURES30)) + \
    ") t(position, column_name) UNION ALL SELECT CAST(30 + row_number() OVER (ORDER BY variety) AS INTEGER), 'variety_' || variety FROM (SELECT DISTINCT variety FROM wk WHERE variety IS NOT NULL)"
SQL["a10_feature_summary"] = chain(*MODEL_FRAME) + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {'true' if c == 'modal_price' else 'false'} AS is_target, {R(f'avg({c})', 'mean')}, {R(f'stddev_samp({c})', 'std')}, "
    f"{R(f'min({c})', 'min')}, {R(f'max({c})', 'max')}, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM mf"
    for c in FEATURES30 + ["modal_price"])
SQL["a11_scaler_fit"] = chain(*MODEL_FRAME) + "\n" + "\nUNION ALL\n".join(
    f"SELECT crop, '{c}' AS column_name, {R(f'avg({c})', 'mean')}, {R(f'stddev_pop({c})', 'std')} FROM mf GROUP BY crop" for c in FEATURES30)
_m2 = ["lag_1", "rolling_mean_4", "arrival_qty", "market_encoded", "day_of_week"]
SQL["m2_apply_scaler"] = chain(*MODEL_FRAME) + "\nSELECT " + ", ".join(SERIES_ID) + ", " + ", ".join(
    R(f"({c} - avg({c}) OVER (PARTITION BY crop)) / CASE WHEN stddev_pop({c}) OVER (PARTITION BY crop) IS NULL OR stddev_pop({c}) OVER (PARTITION BY crop) = 0 THEN 1.0E0 ELSE stddev_pop({c}) OVER (PARTITION BY crop) END", c)
    for c in _m2) + " FROM mf"
SQL["m10_feature_pipeline"] = chain(*MODEL_FRAME) + "\nSELECT " + present(SERIES_ID + FEATURES30 + ["modal_price"], (set(FEATURES30) - INT_FEATURES) | {"modal_price"}) + " FROM mf"

_SER = "PARTITION BY market, crop ORDER BY date, variety, state, district"
SQL["w7_horizon_targets"] = chain(
    *MODEL_FRAME,
    "x AS (" + " UNION ALL ".join(
        f"SELECT {', '.join(SERIES_ID)}, {h} AS horizon, lead(modal_price, {h}) OVER ({_SER}) AS target_future FROM mf" for h in (1, 2, 4, 12)) + ")",
    "y AS (SELECT * FROM x WHERE target_future IS NOT NULL)",
    "k AS (SELECT crop, horizon FROM y GROUP BY crop, horizon HAVING count(*) >= 100)",
) + "\nSELECT " + ", ".join(f"y.{c}" for c in SERIES_ID) + f", y.horizon, {R('y.target_future', 'target_future')} FROM y JOIN k ON y.crop = k.crop AND y.horizon = k.horizon"
_back = "row_number() OVER (PARTITION BY market, crop ORDER BY date DESC, variety DESC, state DESC, district DESC)"
SQL["w9_latest_window"] = chain(
    *WEEKLY, f"b AS (SELECT market, crop, modal_price, {_back} AS rn, count(*) OVER (PARTITION BY market, crop) AS n FROM wk)",
) + "\nSELECT market, crop, CAST(least(n, 12) AS INTEGER) AS points, n >= 12 AS complete, CAST(least(n, 12) - rn AS INTEGER) AS place, " + R("modal_price", "price") + " FROM b WHERE rn <= 12"
SQL["w8_sequences"] = chain(
    *WEEKLY_FEATURES,
    "s AS (SELECT *, COALESCE(lag_1, median(lag_1) OVER (PARTITION BY crop)) AS lag1, row_number() OVER (PARTITION BY market, crop ORDER BY date, variety, state, district) AS rn FROM ft)",
) + "\nSELECT " + ", ".join("t." + c for c in SERIES_ID) + ", " + R("t.modal_price", "target") + ", CAST(12 - (t.rn - p.rn) AS INTEGER) AS step, " + \
    R("p.modal_price", "price") + ", " + R("p.arrival_qty", "arrivals") + ", " + R("p.lag1", "lag_1") + \
    " FROM s t JOIN s p ON t.market = p.market AND t.crop = p.crop AND p.rn BETWEEN t.rn - 12 AND t.rn - 1 WHERE t.rn > 12"
_idx = "row_number() OVER (PARTITION BY crop ORDER BY market, date, variety, state, district) - 1"
SQL["w11_positional_split"] = chain(*MODEL_FRAME, f"i AS (SELECT {', '.join(SERIES_ID)}, {_idx} AS row_index, count(*) OVER (PARTITION BY crop) AS n FROM mf)") + \
    "\nSELECT " + ", ".join(SERIES_ID) + ", row_index, CASE WHEN row_index < floor(0.8E0 * n) THEN 'train' ELSE 'test' END AS split FROM i"
SQL["w12_temporal_split"] = chain(*MODEL_FRAME, "c AS (SELECT crop, quantile_cont(date - DATE '1970-01-01', 0.8E0) AS cut FROM mf GROUP BY crop)") + \
    "\nSELECT " + ", ".join(f"m.{c}" for c in SERIES_ID) + ", CASE WHEN (m.date - DATE '1970-01-01') <= c.cut THEN 'train' ELSE 'test' END AS split FROM mf m LEFT JOIN c ON m.crop = c.crop"
SQL["w13_expanding_folds"] = chain(
    *MODEL_FRAME,
    f"i AS (SELECT {', '.join(SERIES_ID)}, {_idx} AS row_index, count(*) OVER (PARTITION BY crop) AS n FROM mf)",
    "f AS (SELECT i.*, CAST(fold AS INTEGER) AS fold, n - (5 - fold) * (n // 6) AS st, n // 6 AS sz FROM i, range(0, 5) t(fold))",
) + "\nSELECT " + ", ".join(SERIES_ID) + ", fold, CASE WHEN row_index < st THEN 'train' ELSE 'test' END AS role FROM f WHERE row_index < st + sz"

_SCORED = WEEKLY + [
    "sc AS (" + " UNION ALL ".join(
        f"SELECT {', '.join(SERIES_ID)}, {h} AS horizon, lead(date, {h}) OVER ({_SER}) AS target_date, modal_price AS y_pred, lead(modal_price, {h}) OVER ({_SER}) AS y_true "
        f"FROM wk QUALIFY lead(1, {h}) OVER ({_SER}) IS NOT NULL" for h in (1, 2, 4, 12)) + ")",
]
SQL["j9_align_actuals"] = chain(*_SCORED) + "\nSELECT " + ", ".join(SERIES_ID) + f", horizon, target_date, {R('y_pred', 'y_pred')}, {R('y_true', 'y_true')} FROM sc"
SQL["f11_residuals"] = chain(*_SCORED) + "\nSELECT " + ", ".join(SERIES_ID) + f", horizon, {R('y_true - y_pred', 'residual')} FROM sc"


def _metrics(group: str) -> str:
    return (f"SELECT {group}, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae, "
            "avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) * 100.0E0 AS mape, "
            "CASE WHEN var_pop(y_true) * count(*) = 0 THEN NULL ELSE 1.0E0 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) END AS r2, "
            f"count(*) AS n FROM sc GROUP BY {group}")


SQL["a12_error_metrics"] = chain(*_SCORED, f"m AS ({_metrics('crop, horizon')})") + \
    f"\nSELECT crop, horizon, {R('rmse', 'rmse')}, {R('mae', 'mae')}, {R('mape', 'mape')}, {R('r2', 'r2')}, n FROM m"
SQL["a13_metric_spread"] = chain(*_SCORED, f"m AS ({_metrics('crop, market, horizon')})") + \
    "\nSELECT crop, horizon, count(*) AS members, " + ", ".join(
        R(f"quantile_cont(rmse, {q}E0)", f"rmse_{n}") for q, n in [(0.0, "min"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "max")]) + " FROM m GROUP BY crop, horizon"

# ------------------------------------------------------------------ requests / forecasts
_REQ = ["request_id", "market", "state", "crop", "variety", "horizon_weeks", "as_of"]
SQL["p10_normalise_requests"] = chain(*requests_chain()) + "\nSELECT * FROM nrm"
SQL["p11_validate_requests"] = chain(*requests_chain()) + "\nSELECT " + ", ".join(_REQ) + ", status, reason FROM val"
SQL["p12_snap_horizon"] = chain(requests_chain()[0]) + """
SELECT request_id, horizon_weeks, CAST(CASE WHEN horizon_weeks IS NULL THEN NULL WHEN horizon_weeks <= 1 THEN 1
 WHEN horizon_weeks <= 3 THEN 2 WHEN horizon_weeks <= 8 THEN 4 ELSE 12 END AS INTEGER) AS snapped_horizon FROM raw"""
_FC = WEEKLY_FEATURES + DIMS + FORECAST
_SD = RH("stddev_pop(modal_price)", 9)
_SPREAD = f"""st AS (SELECT request_id, horizon_weeks, {RH(f'{_SD} * 0.7E0')} AS sd_x07, {RH(f'{_SD} * 0.5E0')} AS sd_x05,
 {RH(f'{_SD} / avg(modal_price) * 100.0E0')} AS cv_pct, {RH('0.9E0 - horizon_weeks * 0.03E0')} AS confidence
 FROM rows GROUP BY request_id, horizon_weeks)"""
_CLASS = "CASE WHEN confidence * 100.0E0 > 85 THEN 'High' WHEN confidence * 100.0E0 > 75 THEN 'Medium' ELSE 'Low' END"
SQL["p13_confidence_class"] = chain(*_FC, _SPREAD) + f"\nSELECT request_id, {R('confidence', 'confidence')}, {_CLASS} AS confidence_class FROM st"
SQL["a19_spread_stats"] = chain(*_FC, _SPREAD) + f"\nSELECT request_id, horizon_weeks, {R('sd_x07', 'sd_x07')}, {R('sd_x05', 'sd_x05')}, {R('cv_pct', 'cv_pct')}, {R('confidence', 'confidence')}, {_CLASS} AS confidence_class FROM st"
SQL["p14_volatility_class"] = chain(*requests_chain(), *DIMS) + """
SELECT a.request_id, a.crop, """ + R("COALESCE(cp.volatility, 0.1E0)", "volatility") + """,
 CASE WHEN COALESCE(cp.volatility, 0.1E0) > 0.12E0 THEN 'high' WHEN COALESCE(cp.volatility, 0.1E0) > 0.08E0 THEN 'medium' ELSE 'low' END AS volatility_class
 FROM acc a LEFT JOIN crop_price cp ON a.crop = cp.crop"""
SQL["j4_price_anchors"] = chain(*requests_chain(towns=True), *DIMS) + """
SELECT v.request_id, v.market, v.crop, """ + R("COALESCE(cp.volatility, 0.1E0)", "volatility") + ", " + \
    R("COALESCE(cp.base_price, 2000.0E0) * COALESCE(mp.multiplier, 1.0E0)", "rule_base_price") + ", " + \
    R("COALESCE(sm.base_price, 2000.0E0) * COALESCE(sc.multiplier, 1.0E0)", "serving_base_price") + """
 FROM val v LEFT JOIN crop_price cp ON v.crop = cp.crop LEFT JOIN market_price mp ON v.market = mp.market
 LEFT JOIN serving_market sm ON v.market = sm.market LEFT JOIN serving_crop sc ON v.crop = sc.crop"""
SQL["j5_market_lookup"] = chain(*requests_chain(towns=True), *DIMS) + """
SELECT v.request_id, v.market, v.crop, m.market_state, m.region, array_to_string(m.major_crops, ', ') AS major_crops_text
 FROM val v LEFT JOIN mdim m ON v.market = m.market"""
SQL["j6_major_crop"] = chain(*requests_chain(towns=True), *DIMS) + """
SELECT v.request_id, v.market, v.crop, COALESCE(list_contains(m.major_crops, v.crop), false) AS is_major_crop
 FROM val v LEFT JOIN mdim m ON v.market = m.market"""
SQL["j8_asof_features"] = chain(*WEEKLY_FEATURES, *requests_chain(), ASOF) + \
    f"\nSELECT request_id, market, crop, as_of, feature_date, {R('modal_price', 'modal_price')}, {R('lag_1', 'lag_1')}, {R('rolling_mean_4', 'rolling_mean_4')} FROM an"
_ROW = ["request_id", "week", "forecast_date", "modal_price", "min_price", "max_price"]
_ROWD = {"modal_price", "min_price", "max_price"}
SQL["j10_forecast_fallback"] = chain(*_FC) + "\nSELECT " + present(_ROW, _ROWD) + ", source FROM rows"
SQL["f4_forecast_dates"] = chain(*requests_chain()) + """
SELECT request_id, CAST(k AS INTEGER) AS week, CAST(as_of + CAST(7 * k AS INTEGER) AS DATE) AS forecast_date
 FROM (SELECT request_id, as_of, unnest(generate_series(1, horizon_weeks)) AS k FROM acc)"""
SQL["f5_seasonal_forecast"] = chain(*_FC) + f"\nSELECT request_id, week, {R('seasonal_factor', 'seasonal_factor')}, {R('modal_price', 'modal_price')} FROM mr"
SQL["f6_price_bands"] = chain(*_FC) + "\nSELECT " + present(_ROW + ["ci_lower", "ci_upper"], _ROWD | {"ci_lower", "ci_upper"}) + " FROM mr"
_towns_fw = [
    "an AS (SELECT acc.*, NULL::DOUBLE AS modal_price FROM acc)",
    """anc AS (
 SELECT an.*, NULL::DOUBLE AS anchor_price,
  COALESCE(cp.base_price, 2000.0E0) * COALESCE(mp.multiplier, 1.0E0) AS rule_base_price,
  COALESCE(cp.volatility, 0.1E0) AS volatility
 FROM an LEFT JOIN crop_price cp ON an.crop = cp.crop LEFT JOIN market_price mp ON an.market = mp.market)""",
    """fw AS (
 SELECT * EXCLUDE (k), CAST(k AS INTEGER) AS week, CAST(as_of + CAST(7 * k AS INTEGER) AS DATE) AS forecast_date
 FROM (SELECT anc.*, unnest(generate_series(1, horizon_weeks)) AS k FROM anc))""",
    rule_rows_cte(where="true"),
]
SQL["f7_rule_forecast"] = chain(*requests_chain(towns=True), *DIMS, *_towns_fw) + "\nSELECT " + present(_ROW, _ROWD) + " FROM rr"
_season = "CASE WHEN o.crop = 'rice' AND month(o.date) IN (10, 11) THEN 0.85E0 WHEN o.crop = 'rice' AND month(o.date) IN (6, 7) THEN 1.15E0 ELSE 1.0E0 END"
SQL["f9_price_spread"] = chain(*WEEKLY) + "\nSELECT " + ", ".join(SERIES_ID) + f", {R('max_price - min_price', 'price_spread')}, " + \
    R("CASE WHEN modal_price IS NULL OR modal_price = 0 THEN NULL ELSE (max_price - min_price) / modal_price END * 100.0E0", "spread_pct") + " FROM wk"
SQL["w10_pct_change"] = chain(*_FC) + "\nSELECT request_id, week, " + R(
    "COALESCE((modal_price - lag(modal_price) OVER (PARTITION BY request_id ORDER BY week)) / lag(modal_price) OVER (PARTITION BY request_id ORDER BY week) * 100.0E0, 0.0E0)",
    "price_change_pct") + " FROM rows"
SQL["a16_forecast_headline"] = chain(*_FC, "x AS (SELECT *, max(modal_price) OVER (PARTITION BY request_id) AS mx, min(modal_price) OVER (PARTITION BY request_id) AS mn FROM rows)",
    "h AS (SELECT request_id, arg_min(modal_price, week) AS f, arg_max(modal_price, week) AS l, avg(modal_price) AS m, stddev_pop(modal_price) AS s, "
    "min(week) FILTER (WHERE modal_price = mx) AS peak_week, min(week) FILTER (WHERE modal_price = mn) AS trough_week FROM x GROUP BY request_id)") + \
    f"\nSELECT request_id, {R('f', 'first_price')}, {R('l', 'last_price')}, {R('m', 'mean_price')}, {R('s', 'std_price')}, peak_week, trough_week, {R('(l - f) / f * 100.0E0', 'total_change_pct')} FROM h"

SQL["s4_write_csv"] = SQL["a1_weekly_rollup"]
SQL["s1_csv_roundtrip"] = SQL["s1_load_observations"]
SQL["s1_quarantine"] = chain(OBS) + "\nSELECT CASE day(date) WHEN 17 THEN 'fields' WHEN 13 THEN 'modal_price' ELSE 'loaded' END AS reason, count(*) AS lines FROM obs GROUP BY 1"
SQL["s5_export_forecasts"] = chain(*_FC) + "\nSELECT " + present(_ROW, _ROWD) + ", source, " + R("ci_lower", "ci_lower") + ", " + R("ci_upper", "ci_upper") + " FROM rows"
_NEST = "SELECT r.request_id, a.market, a.crop, r.horizon_weeks, CAST(r.week - 1 AS INTEGER) AS place, r.week, strftime(r.forecast_date, '%Y-%m-%d') AS forecast_day, "
SQL["a20_nested_response"] = chain(*_FC) + "\n" + _NEST + ", ".join(R(f"r.{c}", c) for c in ("modal_price", "min_price", "max_price", "ci_lower", "ci_upper")) + \
    " FROM rows r JOIN acc a ON r.request_id = a.request_id"
SQL["s5_export_json"] = chain(*_FC) + "\nSELECT request_id, week, forecast_date, " + ", ".join(R(c, c) for c in ("modal_price", "min_price", "max_price")) + " FROM rows"
SQL["s9_response_json"] = chain(*_FC) + "\nSELECT r.request_id, a.crop, r.horizon_weeks, '1.0.0' AS model_version, r.week, " + R("r.modal_price", "modal_price") + \
    " FROM rows r JOIN acc a ON r.request_id = a.request_id"
SQL["r1_stream_scoring"] = SQL["s5_export_forecasts"]
SQL["r1_stream_rejected"] = chain(*requests_chain()) + "\nSELECT request_id, reason FROM val WHERE status = 'rejected'"
SQL["s9_request_json"] = chain(requests_chain()[0]) + "\nSELECT * FROM raw"
SQL["s8_run_summary"] = chain(*MODEL_FRAME, "c AS (SELECT crop, quantile_cont(date - DATE '1970-01-01', 0.8E0) AS cut FROM mf GROUP BY crop)",
    "sp AS (SELECT CASE WHEN (m.date - DATE '1970-01-01') <= c.cut THEN 'train' ELSE 'test' END AS split FROM mf m LEFT JOIN c ON m.crop = c.crop)") + """
SELECT 'original_records' AS stage, count(*) AS records FROM obs
UNION ALL SELECT 'processed_records', count(*) FROM mf
UNION ALL SELECT 'train_samples', count(*) FILTER (WHERE split = 'train') FROM sp
UNION ALL SELECT 'test_samples', count(*) FILTER (WHERE split = 'test') FROM sp"""

SQL = {k: v for k, v in SQL.items() if v is not None}

def oracle_sql() -> dict[str, str]:
    return dict(SQL)
