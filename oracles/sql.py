"""DuckDB SQL building blocks mirroring the Spark operators.

The SQL is written independently from the DataFrame code (window functions,
``quantile_cont``, ``arg_max``, ``ASOF`` joins) and composed as CTEs over the
driver's pre-registered views.  Doubles are written as ``xE0`` so DuckDB
never switches to DECIMAL arithmetic.
"""

from __future__ import annotations

from kharif.sources import dims

KEYS6 = ["date", "state", "district", "market", "crop", "variety"]
PRICES = ["min_price", "max_price", "modal_price"]
MEDIANS = ["arrival_qty", "rainfall_mm", "temp_c", "acreage_estimate"]
FLAGS = ["govt_policy_flag", "holiday_flag"]
MEASURES = ["min_price", "max_price", "modal_price", "arrival_qty", "acreage_estimate", "rainfall_mm", "temp_c", "govt_policy_flag", "holiday_flag"]
NUMERIC_OBS = MEASURES


def R(expr: str, alias: str | None = None) -> str:
    """Presentation rounding, same as kharif.functions.numeric.stable4."""
    out = f"floor(({expr}) * 1e4 + 0.5001E0) / 1e4"
    return f"{out} AS {alias}" if alias else out


def RH(expr: str, digits: int = 2) -> str:
    """round_half_up."""
    scale = f"{10**digits}.0E0"
    return f"floor(({expr}) * {scale} + 0.5E0) / {scale}"


def present(cols: list[str], doubles: set[str], src: str = "") -> str:
    pre = f"{src}." if src else ""
    return ", ".join(R(f"{pre}{c}", c) if c in doubles else f"{pre}{c}" for c in cols)


OBS = """obs AS (
 SELECT CAST(l_shipdate AS DATE) AS date, r_name AS state, n_name AS district, n_name AS market,
  CASE p_type WHEN 'SMALL' THEN 'rice' WHEN 'LARGE' THEN 'wheat' WHEN 'ECONOMY' THEN 'maize' WHEN 'MEDIUM' THEN 'pulses'
              WHEN 'STANDARD' THEN 'cotton' ELSE 'sugarcane' END AS crop,
  SUBSTR(p_name,1,INSTR(p_name,' ')-1) AS variety,
  AVG(CASE WHEN (l_orderkey*7+l_linenumber)%10=0 THEN NULL ELSE l_extendedprice/l_quantity*(0.98E0-l_discount) END) AS min_price,
  AVG(CASE WHEN (l_orderkey*7+l_linenumber)%10=0 THEN NULL ELSE l_extendedprice/l_quantity*(1.02E0+l_tax) END) AS max_price,
  AVG(CASE WHEN (l_orderkey*7+l_linenumber)%10=0 THEN NULL ELSE l_extendedprice/l_quantity END) AS modal_price,
  SUM(CASE WHEN (l_orderkey+l_linenumber)%11=0 THEN NULL ELSE l_quantity END) AS arrival_qty,
  MAX(p_size*1000.0E0) AS acreage_estimate, SUM((l_partkey%400)/10.0E0) AS rainfall_mm, AVG(18.0E0+(l_suppkey%20)) AS temp_c,
  CAST(MAX(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS INTEGER) AS govt_policy_flag,
  CAST(MAX(CASE WHEN EXTRACT(DAY FROM l_shipdate)%7=0 THEN 1 ELSE 0 END) AS INTEGER) AS holiday_flag
 FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey
  JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey
 GROUP BY 1,2,3,4,5,6)"""


def impute_cte(src: str = "obs", name: str = "imp", zero: bool = True) -> str:
    keyed = "market IS NOT NULL AND crop IS NOT NULL AND variety IS NOT NULL"
    part = "PARTITION BY market, crop, variety"
    order = "ORDER BY date, state, district"
    cols = []
    for c in PRICES:
        f = (
            f"COALESCE(last_value({c} IGNORE NULLS) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
            f" first_value({c} IGNORE NULLS) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
        )
        z = (lambda e: f"COALESCE({e}, 0.0E0)") if zero else (lambda e: e)
        cols.append(f"{z(f'CASE WHEN {keyed} THEN {f} ELSE {c} END')} AS {c}")
    for c in ["arrival_qty", "acreage_estimate", "rainfall_mm", "temp_c"]:
        z = (lambda e: f"COALESCE({e}, 0.0E0)") if zero else (lambda e: e)
        cols.append(f"{z(f'CASE WHEN {keyed} THEN COALESCE({c}, median({c}) OVER ({part})) ELSE {c} END')} AS {c}")
    for c in FLAGS:
        cols.append(f"COALESCE({c}, 0) AS {c}")
    return f"{name} AS (SELECT {', '.join(KEYS6)}, {', '.join(cols)} FROM {src})"


def winsor_cte(src: str = "imp", name: str = "win", group: bool = True) -> str:
    g = "crop" if group else ""
    qs = []
    for c in PRICES:
        qs += [f"quantile_cont({c}, 0.05E0) AS {c}_q1", f"quantile_cont({c}, 0.95E0) AS {c}_q3"]
    grp = f"SELECT {g + ', ' if g else ''}{', '.join(qs)} FROM {src}{' GROUP BY crop' if g else ''}"
    b = []
    for c in PRICES:
        b += [f"{c}_q1 - 1.5E0 * ({c}_q3 - {c}_q1) AS {c}_lo", f"{c}_q3 + 1.5E0 * ({c}_q3 - {c}_q1) AS {c}_hi"]
    bounds = f"SELECT {g + ', ' if g else ''}{', '.join(b)} FROM ({grp})"
    sel = []
    for c in ["date", "state", "district", "market", "crop", "variety"]:
        sel.append(f"s.{c}")
    for c in MEASURES:
        if c in PRICES:
            sel.append(f"CASE WHEN s.{c} < b.{c}_lo THEN b.{c}_lo WHEN s.{c} > b.{c}_hi THEN b.{c}_hi ELSE s.{c} END AS {c}")
        else:
            sel.append(f"s.{c}")
    join = "LEFT JOIN bnd b ON s.crop IS NOT DISTINCT FROM b.crop" if g else "CROSS JOIN bnd b"
    return f"bnd AS ({bounds}), {name} AS (SELECT {', '.join(sel)} FROM {src} s {join})"


def week_label(d: str) -> str:
    return f"CAST(date_trunc('week', {d} - INTERVAL 1 DAY) + INTERVAL 7 DAY AS DATE)"


def month_label(d: str) -> str:
    return f"last_day({d})"


def rollup_cte(src: str = "win", name: str = "wk", freq: str = "weekly") -> str:
    label = week_label("d") if freq == "weekly" else month_label("d")
    return f"""{name} AS (
 SELECT {label} AS date, market, crop, variety, state, district,
  avg(min_price) AS min_price, avg(max_price) AS max_price, avg(modal_price) AS modal_price,
  sum(arrival_qty) AS arrival_qty,
  arg_max(acreage_estimate, CASE WHEN acreage_estimate IS NOT NULL THEN d END) AS acreage_estimate,
  sum(rainfall_mm) AS rainfall_mm, avg(temp_c) AS temp_c,
  max(govt_policy_flag) AS govt_policy_flag, max(holiday_flag) AS holiday_flag
 FROM (SELECT * EXCLUDE (date), date AS d FROM {src})
 GROUP BY 1,2,3,4,5,6)"""


def harvest_case(crop: str = "crop", month: str = "month(date)") -> str:
    arms = " ".join(
        f"WHEN {crop} = '{c}' AND {month} IN ({', '.join(str(m) for m in ms)}) THEN 1"
        for c, ms in dims.HARVEST_MONTHS.items()
    )
    return f"CASE {arms} ELSE 0 END"


SERIES = "PARTITION BY market, crop ORDER BY date, variety, state, district"


def features_cte(src: str = "wk", name: str = "ft") -> str:
    """Calendar + lags + rolling over the weekly table."""
    cal = (
        "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, "
        "CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, "
        f"{harvest_case()} AS is_harvest_month, "
        "sin(2E0 * pi() * month(date) / 12.0E0) AS month_sin, cos(2E0 * pi() * month(date) / 12.0E0) AS month_cos"
    )
    lags = []
    for n in (1, 2, 4, 12):
        lags += [f"lag(modal_price, {n}) OVER ({SERIES}) AS lag_{n}", f"lag(arrival_qty, {n}) OVER ({SERIES}) AS arrival_lag_{n}"]
    roll = []
    for n in (4, 12):
        fr = f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        roll += [
            f"avg(modal_price) OVER {fr} AS rolling_mean_{n}",
            f"stddev_samp(modal_price) OVER {fr} AS rolling_std_{n}",
            f"avg(arrival_qty) OVER {fr} AS arrival_rolling_mean_{n}",
        ]
    return f"{name} AS (SELECT *, {cal}, {', '.join(lags)}, {', '.join(roll)} FROM {src})"


def encoders_cte(src: str = "ft", name: str = "enc") -> str:
    """Target codes for market and state per crop; one-hot of variety."""
    out = []
    for col in ("market", "state"):
        out.append(
            f"""{col}_stats AS (
 SELECT crop, {col}, count(*) AS n, avg(modal_price) AS mean FROM {src}
 WHERE {col} IS NOT NULL AND modal_price IS NOT NULL GROUP BY crop, {col}),
{col}_prior AS (SELECT crop, avg(modal_price) AS prior FROM {src} GROUP BY crop),
{col}_code AS (
 SELECT s.crop, s.{col}, p.prior * (1.0E0 - 1.0E0 / (1.0E0 + exp(-(s.n - 20) / 10.0E0)))
   + s.mean * (1.0E0 / (1.0E0 + exp(-(s.n - 20) / 10.0E0))) AS code
 FROM {col}_stats s JOIN {col}_prior p ON s.crop IS NOT DISTINCT FROM p.crop)"""
        )
    vocab = f"vocab AS (SELECT DISTINCT variety FROM {src} WHERE variety IS NOT NULL)"
    body = f"""{name} AS (
 SELECT f.*, COALESCE(mc.code, mp.prior) AS market_encoded, COALESCE(sc.code, sp.prior) AS state_encoded
 FROM {src} f
 LEFT JOIN market_code mc ON f.crop IS NOT DISTINCT FROM mc.crop AND f.market = mc.market
 LEFT JOIN market_prior mp ON f.crop IS NOT DISTINCT FROM mp.crop
 LEFT JOIN state_code sc ON f.crop IS NOT DISTINCT FROM sc.crop AND f.state = sc.state
 LEFT JOIN state_prior sp ON f.crop IS NOT DISTINCT FROM sp.crop)"""
    return ",\n".join(out + [vocab, body])


def chain(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# Common prefixes.
DAILY_CLEAN = [OBS, impute_cte(), winsor_cte()]
WEEKLY = DAILY_CLEAN + [rollup_cte()]
WEEKLY_FEATURES = WEEKLY + [features_cte()]
ENCODED = WEEKLY_FEATURES + [encoders_cte()]


# ----------------------------------------------------------------- model frame
FEATURES30 = [
    "arrival_qty", "acreage_estimate", "rainfall_mm", "temp_c", "govt_policy_flag", "holiday_flag",
    "year", "month", "quarter", "week_of_year", "day_of_week", "is_harvest_month", "month_sin", "month_cos",
    "lag_1", "arrival_lag_1", "lag_2", "arrival_lag_2", "lag_4", "arrival_lag_4", "lag_12", "arrival_lag_12",
    "rolling_mean_4", "rolling_std_4", "arrival_rolling_mean_4", "rolling_mean_12", "rolling_std_12", "arrival_rolling_mean_12",
    "market_encoded", "state_encoded",
]


INT_FEATURES = {"govt_policy_flag", "holiday_flag", "year", "month", "quarter", "week_of_year", "day_of_week", "is_harvest_month"}


def prepare_cte(src: str = "enc", name: str = "mf") -> str:
    """Median fill per crop, zero fill, inf -> 0, drop NULL targets."""
    cols = []
    for c in FEATURES30:
        if c in INT_FEATURES:
            # Calendar parts of a non-NULL date and zero-filled flags: never NULL.
            cols.append(f"CAST({c} AS INTEGER) AS {c}")
            continue
        e = f"COALESCE(COALESCE({c}, median({c}) OVER (PARTITION BY crop)), 0.0E0)"
        cols.append(f"CASE WHEN isinf({e}) THEN 0.0E0 ELSE {e} END AS {c}")
    inner = f"SELECT {', '.join(SERIES_ID_COLS)}, {', '.join(cols)}, modal_price FROM {src}"
    return f"{name} AS (SELECT * FROM ({inner}) WHERE modal_price IS NOT NULL)"


SERIES_ID_COLS = ["date", "market", "crop", "variety", "state", "district"]
MODEL_FRAME = ENCODED + [prepare_cte()]


# ----------------------------------------------------------------- requests
def _case_sql(key: str, pairs, default: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in pairs)
    return f"CASE {key} {arms} ELSE {default} END"


def town_sql(key: str = "n_nationkey", name: str = "n_name") -> str:
    towns = list(dims.MARKETS)
    arms = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(towns))
    return f"CASE {key} % 14 {arms} ELSE {name} END"


def requests_raw_cte(towns: bool = False, name: str = "raw") -> str:
    crop = _case_sql("o_orderkey % 8", [(0, "' Rice '"), (1, "'wheat'"), (2, "'MAIZE'"), (3, "'pulses'"), (4, "'cotton'"), (5, "'sugarcane'"), (6, "'soybean'")], "NULL")
    horizon = _case_sql("o_orderkey % 6", [(0, 1), (1, 2), (2, 4), (3, 12), (4, 8)], "NULL")
    market = town_sql() if towns else "n_name"
    return f"""{name} AS (
 SELECT o_orderkey AS request_id, {market} AS market, r_name AS state, {crop} AS crop,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'red' END AS variety,
  CAST({horizon} AS INTEGER) AS horizon_weeks,
  CASE WHEN o_orderkey % 50 = 0 THEN 'string' WHEN o_orderkey % 50 = 1 THEN '2024-13-45'
       ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS as_of_date
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


NORM = """nrm AS (SELECT request_id, trim(market) AS market, trim(state) AS state, lower(trim(crop)) AS crop,
 trim(variety) AS variety, horizon_weeks, trim(as_of_date) AS as_of_date FROM raw)"""


def validate_cte(run_date: str = "2024-10-01") -> str:
    return f"""val0 AS (
 SELECT request_id, market, state, COALESCE(crop, 'rice') AS crop, COALESCE(variety, 'PR 126') AS variety,
  CAST(COALESCE(horizon_weeks, 4) AS INTEGER) AS horizon_weeks,
  CASE WHEN as_of_date = 'string' THEN DATE '{run_date}' ELSE CAST(try_strptime(as_of_date, '%Y-%m-%d') AS DATE) END AS as_of
 FROM nrm),
val AS (
 SELECT *, CASE WHEN reason0 = '' THEN NULL ELSE reason0 END AS reason,
  CASE WHEN reason0 = '' THEN 'accepted' ELSE 'rejected' END AS status
 FROM (SELECT v.*, concat_ws(',',
   CASE WHEN market IS NULL OR market = '' THEN 'missing_market' END,
   CASE WHEN state IS NULL OR state = '' THEN 'missing_state' END,
   CASE WHEN horizon_weeks NOT IN ({', '.join(str(h) for h in dims.ALLOWED_HORIZONS)}) THEN 'bad_horizon' END,
   CASE WHEN as_of IS NULL THEN 'bad_date' END) AS reason0 FROM val0 v)),
acc AS (SELECT request_id, market, state, crop, variety, horizon_weeks, as_of FROM val WHERE status = 'accepted')"""


def requests_chain(towns: bool = False) -> list[str]:
    return [requests_raw_cte(towns), NORM, validate_cte()]


def _values(name: str, cols: str, rows) -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        if isinstance(v, float):
            return f"{v!r}E0" if "e" not in repr(v) else repr(v)
        return str(v)

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) t({cols}))"


DIMS = [
    _values("crop_price", "crop, base_price, volatility", [(c, float(dims.CROP_BASE_PRICE[c]), float(dims.CROP_VOLATILITY[c])) for c in dims.CROP_BASE_PRICE]),
    _values("market_price", "market, multiplier", [(m, float(v)) for m, v in dims.MARKET_MULTIPLIER.items()]),
    _values("serving_market", "market, base_price", [(m, float(v)) for m, v in dims.SERVING_MARKET_BASE.items()]),
    _values("serving_crop", "crop, multiplier", [(c, float(v)) for c, v in dims.SERVING_CROP_MULTIPLIER.items()]),
    _values("mdim", "market, market_state, region, major_crops", [(m, s, r, c) for m, (s, r, c) in dims.MARKETS.items()]),
]


ASOF = """fl AS (
 SELECT market, crop, date AS feature_date, modal_price, lag_1, rolling_mean_4 FROM ft
 QUALIFY row_number() OVER (PARTITION BY market, crop, date ORDER BY variety DESC, state DESC, district DESC) = 1),
an AS (
 SELECT a.*, f.feature_date, f.modal_price, f.lag_1, f.rolling_mean_4
 FROM acc a ASOF LEFT JOIN fl f ON a.market = f.market AND a.crop = f.crop AND a.as_of >= f.feature_date)"""

ANCHORED = """anc AS (
 SELECT an.*, an.modal_price AS anchor_price,
  COALESCE(cp.base_price, 2000.0E0) * COALESCE(mp.multiplier, 1.0E0) AS rule_base_price,
  COALESCE(cp.volatility, 0.1E0) AS volatility
 FROM an LEFT JOIN crop_price cp ON an.crop = cp.crop LEFT JOIN market_price mp ON an.market = mp.market),
fw AS (
 SELECT * EXCLUDE (k), CAST(k AS INTEGER) AS week, CAST(as_of + CAST(7 * k AS INTEGER) AS DATE) AS forecast_date
 FROM (SELECT anc.*, unnest(generate_series(1, horizon_weeks)) AS k FROM anc))"""


def model_rows_cte(src: str = "fw", name: str = "mr") -> str:
    season = "(1.0E0 + 0.1E0 * sin(2E0 * pi() * (month(forecast_date) - 6) / 12.0E0))"
    p = "px"
    return f"""{name}0 AS (SELECT *, {RH(f'greatest(1000.0E0, anchor_price * {season})')} AS px,
  {season} AS seasonal_factor FROM {src} WHERE anchor_price IS NOT NULL),
{name} AS (
 SELECT request_id, week, forecast_date, horizon_weeks, seasonal_factor, {p} AS modal_price,
  {RH(f'greatest(500.0E0, {p} - {p} * 0.15E0)')} AS min_price, {RH(f'{p} + {p} * 0.15E0')} AS max_price,
  {RH(f'greatest(500.0E0, {p} - {p} * 0.08E0 * (horizon_weeks / 4.0E0))')} AS ci_lower,
  {RH(f'{p} + {p} * 0.08E0 * (horizon_weeks / 4.0E0)')} AS ci_upper, 'model' AS source
 FROM {name}0)"""


def rule_rows_cte(src: str = "fw", name: str = "rr", where: str = "anchor_price IS NULL") -> str:
    i = "(week - 1)"
    b = "rule_base_price"
    modal = f"greatest({b} * 0.5E0, {b} * (1.0E0 + {i} * 0.012E0) + sin({i} * 0.5E0) * {b} * 0.03E0 + cos({i} * 0.3E0) * {b} * 0.02E0)"
    return f"""{name}0 AS (SELECT *, {modal} AS m FROM {src} WHERE {where}),
{name} AS (
 SELECT request_id, week, forecast_date, horizon_weeks, NULL::DOUBLE AS seasonal_factor, {RH('m')} AS modal_price,
  {RH('greatest(m * 0.7E0, m - m * volatility * 0.8E0)')} AS min_price, {RH('m + m * volatility * 0.8E0')} AS max_price,
  NULL::DOUBLE AS ci_lower, NULL::DOUBLE AS ci_upper, 'rule' AS source
 FROM {name}0)"""


FORECAST = (
    requests_chain() + [ASOF.replace("fl AS", "fl AS", 1)] + [ANCHORED, model_rows_cte(), rule_rows_cte(),
    "rows AS (SELECT * FROM mr UNION ALL SELECT * FROM rr)"]
)
