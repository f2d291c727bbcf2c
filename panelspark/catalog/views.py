"""The panel and its side tables, derived from the benchmark tables.

Events become an hourly target per series, customers become clients, suppliers
become weather stations and line items become weather readings. The number of
series, stations and readings grows with the source tables. Money is counted in
whole cents and readings in whole units, so sums are exact in any order.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.lags import dense_panel
from panelspark.session import land
from panelspark.sources.schema import HISTORY_WHOLE_NUMBERS, SERIES_KEYS

START = "2024-01-01 00:00:00"
HOURS = 720
DAYS = 30

USERS_PER_COUNTY = 32
CUSTOMERS_PER_COUNTY = 320
SUPPLIERS_PER_COUNTY = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start():
    return F.lit(START).cast("timestamp_ntz")


def _plus_hours(hours):
    return _start() + F.make_dt_interval(F.lit(0), hours)


def cents(col):
    return F.round(col * 100).cast("long")


def series_events(events: DataFrame) -> DataFrame:
    """Every event with its series and instant."""
    return events.select(
        F.floor(F.col("user_id") / USERS_PER_COUNTY).cast("int").alias("county"),
        (F.col("user_id") % 2).cast("int").alias("is_business"),
        (F.floor(F.col("user_id") / 2) % 4).cast("int").alias("product_type"),
        (F.col("event_id") % 2).cast("int").alias("is_consumption"),
        "ts",
        cents(F.col("value")).alias("cents"),
        "event_id",
    )


def hourly_events(events: DataFrame) -> DataFrame:
    """Every event with its series and hour."""
    return series_events(events).select(
        *SERIES_KEYS, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"), "cents"
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series at every hour; a few targets are unknown."""
    events = hourly_events(read(spark, sf_dir, "events"))
    hour_idx = (
        F.datediff("datetime", F.lit(START).cast("date")) * 24 + F.hour("datetime")
    ).cast("long")
    zeros = dense_panel(
        events, SERIES_KEYS, "datetime", _start(), _plus_hours(F.lit(HOURS - 1))
    ).withColumn("cents", F.lit(0).cast("long"))
    # zeros make the panel dense, one aggregation fills in the events
    filled = events.unionByName(zeros).groupBy(*SERIES_KEYS, "datetime").agg(
        F.sum("cents").alias("cents")
    )
    unknown = (F.col("county") % 4 == 3) & (hour_idx % 97 == 0)
    row_id = (
        ((F.col("county").cast("long") * HOURS + hour_idx) * 2 + F.col("is_business")) * 8
        + F.col("product_type") * 2
        + F.col("is_consumption")
    )
    return filled.select(
        *SERIES_KEYS,
        "datetime",
        F.when(~unknown, F.col("cents").cast("double")).alias("target"),
        row_id.alias("row_id"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "customer").groupBy(
        F.floor(F.col("c_custkey") / CUSTOMERS_PER_COUNTY).cast("int").alias("county"),
        (F.col("c_custkey") % 2).cast("int").alias("is_business"),
        (F.floor(F.col("c_custkey") / 2) % 4).cast("int").alias("product_type"),
    ).agg(
        F.count("*").alias("n"), F.sum(cents(F.abs("c_acctbal"))).alias("balance")
    )
    days = F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))).alias("d")
    return groups.select("*", days).select(
        "county",
        "is_business",
        "product_type",
        F.date_add(F.lit(START).cast("date"), F.col("d")).alias("date"),
        (F.col("n") + F.col("d")).cast("int").alias("eic_count"),
        (F.col("balance") + F.col("d")).cast("double").alias("installed_capacity"),
    )


def gas(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("o_orderkey") % DAYS).cast("int")
    return read(spark, sf_dir, "orders").groupBy(
        F.date_add(F.lit(START).cast("date"), day).alias("forecast_date")
    ).agg(
        F.min(cents(F.col("o_totalprice"))).cast("double").alias("lowest_price_per_mwh"),
        F.max(cents(F.col("o_totalprice"))).cast("double").alias("highest_price_per_mwh"),
    )


def electricity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = (F.col("l_orderkey") % HOURS).cast("int")
    return read(spark, sf_dir, "lineitem").groupBy(
        _plus_hours(hour).alias("forecast_date")
    ).agg(F.max(cents(F.col("l_extendedprice"))).cast("double").alias("euros_per_mwh"))


def _latitude(key):
    return F.round(F.lit(57.0) + (key % 40) / 10, 1)


def _longitude(key):
    return F.round(F.lit(21.0) + F.floor(key / 40) / 10, 1)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per supplier; every eighth has no county."""
    key = F.col("s_suppkey")
    county = F.floor(key / SUPPLIERS_PER_COUNTY).cast("int")
    return read(spark, sf_dir, "supplier").select(
        _latitude(key).alias("latitude"),
        _longitude(key).alias("longitude"),
        F.when(key % 8 != 7, county).alias("county"),
    )


# some variables, for queries whose cost grows with their number
FORECAST_COLUMNS = ["temperature", "surface_solar_radiation_downwards", "cloudcover_total"]
HISTORY_COLUMNS = ["temperature", "cloudcover_total", "rain"]

# every variable of a reading, each with values of its own, all whole numbers
FORECAST_READINGS = {
    "temperature": "max(l_quantity) - 20",
    "dewpoint": "min(l_quantity) - 25",
    "cloudcover_high": "min({cents_discount})",
    "cloudcover_low": "max(l_linenumber) * 10",
    "cloudcover_mid": "min(l_linenumber) * 10 + 1",
    "cloudcover_total": "max({cents_discount})",
    "10_metre_u_wind_component": "max(l_partkey % 23) - 11",
    "10_metre_v_wind_component": "min(l_partkey % 29) - 14",
    "direct_solar_radiation": "min(floor(l_extendedprice))",
    "surface_solar_radiation_downwards": "max(floor(l_extendedprice))",
    "snowfall": "max({cents_tax})",
    "total_precipitation": "sum({cents_tax})",
}
HISTORY_READINGS = {
    "temperature": "max(l_quantity) - 20",
    "dewpoint": "min(l_quantity) - 25",
    "rain": "max({cents_tax})",
    "snowfall": "min({cents_tax})",
    "surface_pressure": "max(l_linenumber) + 1000",
    "cloudcover_total": "max({cents_discount})",
    "cloudcover_low": "min({cents_discount})",
    "cloudcover_mid": "max(l_linenumber) * 10",
    "cloudcover_high": "min(l_linenumber) * 10 + 1",
    "windspeed_10m": "max(l_partkey % 31)",
    "winddirection_10m": "max(l_partkey % 360)",
    "shortwave_radiation": "max(floor(l_extendedprice / 100))",
    "direct_solar_radiation": "min(floor(l_extendedprice / 100))",
    "diffuse_radiation": "max(l_orderkey % 500)",
}
# SQL that both engines read alike
CENTS_OF = {f"cents_{c}": f"CAST(round(l_{c} * 100) AS BIGINT)" for c in ("discount", "tax")}


def _readings(formulas: dict[str, str], whole: dict[str, str] = {}) -> list:
    return [
        F.expr(f"CAST({formula.format(**CENTS_OF)} AS {'INT' if name in whole else 'DOUBLE'})").alias(name)
        for name, formula in formulas.items()
    ]


def forecast_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("l_orderkey") % DAYS).cast("int")
    return read(spark, sf_dir, "lineitem").groupBy(
        _latitude(F.col("l_suppkey")).alias("latitude"),
        _longitude(F.col("l_suppkey")).alias("longitude"),
        (1 + F.col("l_partkey") % 48).cast("int").alias("hours_ahead"),
        (_start() + F.make_dt_interval(day)).alias("origin_datetime"),
    ).agg(*_readings(FORECAST_READINGS))


def historical_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = (F.col("l_orderkey") % HOURS).cast("int")
    return read(spark, sf_dir, "lineitem").groupBy(
        _latitude(F.col("l_suppkey")).alias("latitude"),
        _longitude(F.col("l_suppkey")).alias("longitude"),
        _plus_hours(hour).alias("datetime"),
    ).agg(*_readings(HISTORY_READINGS, HISTORY_WHOLE_NUMBERS))


def all_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every input table. The panel is written out once, as a source file would be."""
    main = land(panel(spark, sf_dir), spark, "panel")
    return {
        "train": main,
        "target": main.drop("row_id"),
        "client": clients(spark, sf_dir),
        "gas": gas(spark, sf_dir),
        "electricity": electricity(spark, sf_dir),
        "forecast_weather": forecast_weather(spark, sf_dir),
        "historical_weather": historical_weather(spark, sf_dir),
        "location": stations(spark, sf_dir),
    }
