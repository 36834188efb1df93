"""Domain views derived from the driver's TPC-H style tables.

The driver's tables carry no market-price schema, so these views map them
onto it (see FIXTURES.md).  Every view is a plain star join plus aggregate
and grows with the underlying tables.

Scale notes
-----------
* ``nation`` and ``region`` have a fixed size (25 and 5 rows), so they are
  broadcast explicitly.  ``part``, ``supplier`` and ``customer`` grow with the
  data; their join strategy is left to Catalyst and AQE (broadcast below the
  size threshold, sort-merge above, skew splitting on hot keys).
* The observation view aggregates line items to the daily series grain
  (one row per date x market x crop x variety).  The aggregate is partial on
  the map side, so a hot key is collapsed before the shuffle and every later
  window partition is bounded by calendar length, not by data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kharif.sources import dims
from kharif.sources.tables import read_table

# part type -> crop used by the fixture mapping.
CROP_OF_TYPE = [
    ("SMALL", "rice"),
    ("LARGE", "wheat"),
    ("ECONOMY", "maize"),
    ("MEDIUM", "pulses"),
    ("STANDARD", "cotton"),
]
OTHER_CROP = "sugarcane"


def _case(key: Column, pairs, default) -> Column:
    expr = None
    for k, v in pairs:
        expr = F.when(key == F.lit(k), F.lit(v)) if expr is None else expr.when(key == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily observations, one row per (date, state, district, market, crop, variety)."""
    li = read_table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size")
    supp = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")

    # Each dimension joins the line-item stream directly, so Catalyst sizes
    # supplier and part from their files (broadcast below the threshold,
    # sort-merge with AQE skew splitting above); nation and region are fixed.
    joined = (
        li.join(supp, li.l_suppkey == supp.s_suppkey)
        .join(F.broadcast(nation), F.col("s_nationkey") == nation.n_nationkey)
        .join(F.broadcast(region), F.col("n_regionkey") == region.r_regionkey)
        .join(part, li.l_partkey == part.p_partkey)
        .withColumnRenamed("r_name", "state")
        .withColumnRenamed("n_name", "market")
    )

    price_hole = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 == 0
    arrival_hole = (F.col("l_orderkey") + F.col("l_linenumber")) % 11 == 0
    unit = F.col("l_extendedprice") / F.col("l_quantity")

    def holed(cond: Column, value: Column) -> Column:
        return F.when(cond, F.lit(None)).otherwise(value)

    return (
        joined.groupBy(
            F.to_date("l_shipdate").alias("date"),
            F.col("state"),
            F.col("market"),
            _case(F.col("p_type"), CROP_OF_TYPE, OTHER_CROP).alias("crop"),
            F.expr("substring(p_name, 1, instr(p_name, ' ') - 1)").alias("variety"),
        )
        .agg(
            F.avg(holed(price_hole, unit * (0.98 - F.col("l_discount")))).alias("min_price"),
            F.avg(holed(price_hole, unit * (1.02 + F.col("l_tax")))).alias("max_price"),
            F.avg(holed(price_hole, unit)).alias("modal_price"),
            F.sum(holed(arrival_hole, F.col("l_quantity"))).alias("arrival_qty"),
            F.max(F.col("p_size") * 1000.0).alias("acreage_estimate"),
            F.sum((F.col("l_partkey") % 400) / 10.0).alias("rainfall_mm"),
            F.avg(18.0 + (F.col("l_suppkey") % 20)).alias("temp_c"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("govt_policy_flag"),
            F.max(F.when(F.dayofmonth("l_shipdate") % 7 == 0, 1).otherwise(0)).alias("holiday_flag"),
        )
        .select(
            "date", "state", F.col("market").alias("district"), "market", "crop", "variety",
            "min_price", "max_price", "modal_price", "arrival_qty", "acreage_estimate",
            "rainfall_mm", "temp_c", "govt_policy_flag", "holiday_flag",
        )
    )


REQUEST_CROPS = [(0, " Rice "), (1, "wheat"), (2, "MAIZE"), (3, "pulses"), (4, "cotton"), (5, "sugarcane"), (6, "soybean")]
REQUEST_HORIZONS = [(0, 1), (1, 2), (2, 4), (3, 12), (4, 8)]


def town_of_nation(nationkey: Column, name: Column) -> Column:
    """Map nation key k to the k-th of the 12 towns (k % 14 < 12), else keep the nation name."""
    towns = F.array(*[F.lit(t) for t in dims.MARKETS])
    k = nationkey % 14
    return F.when(k < 12, F.element_at(towns, (k + 1).cast("int"))).otherwise(name)


def forecast_requests(spark: SparkSession, sf_dir: str, towns: bool = False) -> DataFrame:
    """Raw forecast requests (untrimmed crops, bad horizons and dates included)."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    j = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("o_orderkey")
    market = town_of_nation(F.col("n_nationkey"), F.col("n_name")) if towns else F.col("n_name")
    return j.select(
        key.alias("request_id"),
        market.alias("market"),
        F.col("r_name").alias("state"),
        _case(key % 8, REQUEST_CROPS, F.lit(None).cast("string")).alias("crop"),
        F.when(key % 5 == 0, F.lit(None).cast("string")).otherwise(F.lit("red")).alias("variety"),
        _case(key % 6, REQUEST_HORIZONS, F.lit(None).cast("int")).alias("horizon_weeks"),
        F.when(key % 50 == 0, F.lit("string"))
        .when(key % 50 == 1, F.lit("2024-13-45"))
        .otherwise(F.to_date("o_orderdate").cast("string"))
        .alias("as_of_date"),
    )
