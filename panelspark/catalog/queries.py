"""One query per operator, each over whole benchmark tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame. Numbers that come out of
logarithms, sines or standard deviations are rounded, all others are exact.
"""

import functools
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.catalog import views as V
from panelspark.functions import calendar as C
from panelspark.ml import explain as X
from panelspark.ml import job as J
from panelspark.ml import registry
from panelspark.ml import score as S
from panelspark.ml import train as M
from panelspark.ml.features import vector_names
from panelspark.ml.store import load as load_models
from panelspark.operators import aggregates as A
from panelspark.operators import align, folds, lags, ratios, upsert
from panelspark.operators.lags import clock_micros
from panelspark.plans import build
from panelspark.plans import features as P
from panelspark.session import land, scratch_dir
from panelspark.sources import landing
from panelspark.sources import tables as io
from panelspark.sources.schema import (
    SCHEMAS,
    SERIES_KEYS,
    TABLE_KEYS,
    TABLE_TIME,
    table_schema,
)
from panelspark.streaming import events as live_events
from panelspark.streaming import live, replay, store

N = 14
OFFSETS = list(range(2, N + 1))
STATS = ("avg", "sum", "min", "max", "std")
K = 5
EMBARGO = 30
MODEL_FOLDS, EMBARGO_DAYS = 3, 2

QUERIES = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a date leaves a query as its midnight, which every engine prints alike
        df = fn(spark, sf_dir)
        return df.selectExpr(*[
            f"CAST(`{c}` AS timestamp_ntz) AS `{c}`" if kind == "date" else f"`{c}`" for c, kind in df.dtypes
        ])

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, digits: int, *parts: str) -> DataFrame:
    """Round the double columns whose name contains one of ``parts``."""
    return rounded_by(df, {p: digits for p in parts})


def exact_round(c: str, digits: int) -> str:
    """SQL for ``round`` of a double, which goes by way of its decimal text, at a fraction of the time.

    Up to 1e9 units of the last digit a product is off by less than 1e-6 of a unit, so that
    what is further than 1e-5 from the middle of two units rounds alike, and a whole number
    over a power of ten is the double nearest to the decimal. The rest takes ``round``.
    """
    units = f"`{c}` * 1e{digits}D"
    clear = f"abs(`{c}`) < 1e{9 - digits}D AND abs({units} - floor({units}) - 0.5D) > 1e-5D"
    return f"CASE WHEN {clear} THEN floor({units} + 0.5D) / 1e{digits}D ELSE round(`{c}`, {digits}) END"


def rounded_by(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the double columns whose name contains a part, by the first part that it contains."""
    def one(c, kind):
        found = next((n for part, n in digits.items() if part in c), None) if kind == "double" else None
        return f"`{c}`" if found is None else f"{exact_round(c, found)} AS `{c}`"

    return df.selectExpr(*[one(c, kind) for c, kind in df.dtypes])


# ---------------------------------------------------------------- sources

@query
def conform_types(spark, d):
    """Half of the rows come as text, as from a CSV file."""
    narrow = table_schema(
        l_orderkey="long", l_linenumber="short", l_quantity="short",
        l_extendedprice="int", l_shipdate="date",
    )
    lines = V.read(spark, d, "lineitem").select(*narrow.fieldNames())
    whole = [F.floor(c).alias(c) if c in ("l_quantity", "l_extendedprice") else F.col(c) for c in lines.columns]
    typed, text = lines.filter("l_orderkey % 2 = 0"), lines.filter("l_orderkey % 2 = 1").select(*whole)
    text = text.select(*[F.col(c).cast("string").alias(c) for c in text.columns])
    return io.conform(typed, narrow).union(io.conform(text, narrow))


@query
def landed_csv(spark, d):
    """Line items and the panel written as CSV, landed by month, and read back, the second time from Parquet.

    Planted: columns in another order and one more, whole numbers written as decimals, and records that do not fit.
    """
    lines = V.read(spark, d, "lineitem")
    schema = table_schema(l_orderkey="long", l_linenumber="short", l_suppkey="int", l_quantity="double", l_shipdate="timestamp")
    text = lines.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"),
        F.when(F.col("l_orderkey") % 50 == 7, F.lit("many")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.col("l_returnflag"),
        F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 3 == 0, ".0").otherwise("")).alias("l_orderkey"),
        F.when(F.col("l_orderkey") % 50 == 9, F.lit("1.5")).otherwise(F.col("l_suppkey").cast("string")).alias("l_suppkey"),
        "l_linenumber",
    )
    source, folder = f"{scratch_dir(spark, 'csv')}/lines.csv", scratch_dir(spark, "landed")
    text.write.option("header", True).csv(source)
    landing.landed(spark, "lines", source, folder, schema, "l_shipdate")
    good, bad = landing.landed(spark, "lines", source, folder, schema, "l_shipdate")
    panel = V.panel(spark, d)
    train = f"{scratch_dir(spark, 'csv')}/train.csv"
    panel.select("row_id", "datetime", "target", *reversed(SERIES_KEYS)).write.option("header", True).csv(train)
    main = io.read_table(spark, "train", train, folder)
    return (
        good.groupBy(F.lit("lines").alias("what"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
            F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("keys"), F.sum("l_quantity").alias("amount"))
        .union(bad.select(F.lit("bad"), F.lit("none")).groupBy("bad", "none").agg(F.count("*"), F.lit(0), F.lit(0.0)))
        .union(main.groupBy(F.lit("train"), F.date_format("datetime", "yyyy-MM")).agg(F.count("*"), F.sum("row_id"), F.sum("target")))
    )


@query
def parse_epoch_or_iso(spark, d):
    events = V.read(spark, d, "events")
    micros = clock_micros(F.col("ts"))
    text = F.when(
        F.col("event_id") % 2 == 0, F.concat(micros.cast("string"), F.lit("000"))
    ).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return events.select("event_id", io.parse_epoch_or_iso(text).alias("parsed"))


# ---------------------------------------------------------------- filters and alignment

@query
def lookback_filter(spark, d):
    asked = align.since(V.read(spark, d, "orders"), "o_orderdate", "2001-07-01 00:00:00")
    limits = align.lookback_bounds(asked, "o_orderdate", N)
    return align.lookback(V.read(spark, d, "lineitem"), "l_shipdate", limits).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )


@query
def time_bounds(spark, d):
    years = V.read(spark, d, "orders").agg(
        F.min("o_orderdate").alias("min_time"), F.max("o_orderdate").alias("max_time"),
        F.min(F.year("o_orderdate")).alias("min_year"), F.max(F.year("o_orderdate")).alias("max_year"),
    )
    return years


@query
def publish_alignment(spark, d):
    rows = V.read(spark, d, "events").select("event_id", "ts")
    rows = align.publish_shift(rows, "ts", 2, "known_after_two_days")
    rows = align.publish_shift(rows, "ts", 1, "day_of_use", to_date=True)
    return rows.withColumn("day", align.to_day(F.col("ts")))


@query
def history_publish_date(spark, d):
    history = V.historical_weather(spark, d).select("latitude", "longitude", "datetime")
    return align.publish_shift_by_hour(history, "datetime", "date")


@query
def station_to_county(spark, d):
    return align.station_to_county(V.forecast_weather(spark, d), V.stations(spark, d))


@query
def duplicate_key_report(spark, d):
    return align.duplicate_keys(V.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- calendar

def _timed_orders(spark, d):
    hour = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return V.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") + hour).alias("datetime"))


@query
def calendar_features(spark, d):
    return C.calendar(_timed_orders(spark, d), "datetime")


@query
def cyclic_features(spark, d):
    rows = C.cyclic(C.calendar(_timed_orders(spark, d), "datetime")).select(
        "o_orderkey", "sin(ordinal_day)", "cos(ordinal_day)", "sin(hour)", "cos(hour)"
    )
    return rows.select("o_orderkey", *[
        (F.round(F.col(c), 6) + 0.0).alias(n)
        for c, n in [("sin(ordinal_day)", "sin_day"), ("cos(ordinal_day)", "cos_day"),
                     ("sin(hour)", "sin_hour"), ("cos(hour)", "cos_hour")]
    ])


@query
def date_index(spark, d):
    return C.date_index(V.read(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query
def holiday_flag(spark, d):
    return V.read(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"),
        C.is_holiday(F.to_date("o_orderdate")).alias("holiday"),
    )


# ---------------------------------------------------------------- aggregates

@query
def daily_stats(spark, d):
    rows = V.panel(spark, d).withColumn("date", F.to_date("datetime"))
    return rounded(A.stats(rows, [*SERIES_KEYS, "date"], "target", "day_target"), 3, "std_")


@query
def marginal_stats(spark, d):
    return rounded(A.marginal_stats(V.panel(spark, d), SERIES_KEYS, "datetime", "target"), 3, "std_")


@query
def client_features(spark, d):
    return rounded(P.client_features(V.clients(spark, d)), 6, "log1p")


@query
def gas_features(spark, d):
    daily = V.read(spark, d, "orders").groupBy("o_custkey", F.col("o_orderdate").alias("forecast_date")).agg(
        F.min(V.cents(F.col("o_totalprice"))).cast("double").alias("lowest_price_per_mwh"),
        F.max(V.cents(F.col("o_totalprice"))).cast("double").alias("highest_price_per_mwh"),
    )
    return P.gas_features(daily)


@query
def weather_pivot(spark, d):
    return rounded(
        P.forecast_weather_features(V.forecast_weather(spark, d), V.stations(spark, d)), 3, "_std",
    )


@query
def history_daily_mean(spark, d):
    return P.historical_weather_features(V.historical_weather(spark, d), V.stations(spark, d))


@query
def hours_ago_rank(spark, d):
    located = P.located_history(V.historical_weather(spark, d), V.stations(spark, d))
    return P.hours_ago(located).select("latitude", "longitude", "date", "datetime", "hours_ago")


# ---------------------------------------------------------------- lags

@query
def dense_panel(spark, d):
    events = V.hourly_events(V.read(spark, d, "events"))
    lo, hi = align.bounds(events, "datetime")
    return lags.dense_panel(events, SERIES_KEYS, "datetime", lo, hi, pad_days=2)


def _target_lags(spark, d):
    return lags.exact_lag(
        V.panel(spark, d).select(*SERIES_KEYS, "datetime", "target"),
        SERIES_KEYS, "datetime", ["target"], OFFSETS,
    )


def _complete_lags(spark, d):
    return lags.complete_only(_target_lags(spark, d), [f"target_lag_{o}" for o in OFFSETS])


@query
def exact_lag_hourly(spark, d):
    return rounded(lags.logged_lags(_target_lags(spark, d), N), 6, "log1p")


@query
def exact_lag_future(spark, d):
    """Lags for instants that have no row yet: the days after the panel ends."""
    rows = V.panel(spark, d).select(*SERIES_KEYS, "datetime", "target")
    future = rows.select(*SERIES_KEYS, (F.col("datetime") + F.make_dt_interval(F.lit(10))).alias("datetime"))
    return lags.exact_lag(rows, SERIES_KEYS, "datetime", ["target"], OFFSETS, at=future)


@query
def exact_lag_daily(spark, d):
    rows = V.panel(spark, d).withColumn("date", F.to_date("datetime"))
    daily = A.stats(rows, [*SERIES_KEYS, "date"], "target", "day_target")
    cols = [f"{s}_day_target" for s in STATS]
    return rounded(
        lags.exact_lag(daily, SERIES_KEYS, "date", cols, OFFSETS, unit="day"), 3, "std_"
    ).drop(*cols)


@query
def exact_lag_marginal(spark, d):
    stacked = A.marginal_stats(V.panel(spark, d), SERIES_KEYS, "datetime", "target")
    cols = [f"{s}_target" for s in STATS]
    return rounded(
        lags.exact_lag(
            stacked.select("over_key", *SERIES_KEYS, "datetime", *cols),
            ["over_key", *SERIES_KEYS], "datetime", cols, OFFSETS,
        ), 3, "std_",
    ).drop(*cols)


@query
def lag_complete(spark, d):
    return _complete_lags(spark, d)


@query
def lag_diffs(spark, d):
    rows = lags.lag_diffs(lags.logged_lags(_complete_lags(spark, d), N), N)
    kept = [c for c in rows.columns if c.endswith("_diff")]
    return rounded(rows.select(*SERIES_KEYS, "datetime", *kept), 6, "log1p")


def _list_stats(spark, d):
    return lags.lag_list_stats(lags.lag_diffs(lags.logged_lags(_complete_lags(spark, d), N), N), N)


@query
def lag_list_stats(spark, d):
    rows = _list_stats(spark, d)
    kept = [c for c in rows.columns if "_all_lag" in c]
    return rounded(rows.select(*SERIES_KEYS, "datetime", *kept), 6, "log1p")


@query
def lag_ratios(spark, d):
    rows = lags.lag_ratios(_list_stats(spark, d))
    kept = [c for c in rows.columns if "_vs_" in c]
    return rows.select(*SERIES_KEYS, "datetime", *kept)


@query
def target_features(spark, d):
    """Every lag feature of the panel."""
    panel = land(V.panel(spark, d), spark, "panel")  # as a source file would be
    return rounded_by(P.target_features(panel, N), {"log1p": 6, "std_": 3})


# ---------------------------------------------------------------- joins

@query
def join_client(spark, d):
    rows = V.panel(spark, d).withColumn("date", F.to_date("datetime"))
    joined = align.left_join_unique(
        rows, P.client_features(V.clients(spark, d)), ["county", "is_business", "product_type", "date"]
    )
    return rounded(joined, 6, "log1p")


@query
def join_prices(spark, d):
    rows = V.panel(spark, d).withColumn("date", F.to_date("datetime"))
    rows = align.left_join_unique(rows, P.electricity_features(V.electricity(spark, d)), ["datetime"])
    return align.left_join_unique(rows, P.gas_features(V.gas(spark, d)), ["date"])


def _assembled(spark, d):
    tables = V.all_tables(spark, d)
    return build.feature_rows(
        tables["train"], tables, N, True, V.FORECAST_COLUMNS, V.HISTORY_COLUMNS
    )


def _comparable(rows):
    """Logarithms, angles and deviations to the digits in which two engines agree."""
    return rounded_by(rows, {"production_capacity_log1p": 4, "log1p": 6, "sin(": 6, "cos(": 6, "std_": 3, "_std": 3})


@query
def assemble_features(spark, d):
    """The whole feature table of the panel."""
    return _comparable(_assembled(spark, d))


@query
def scoring_features(spark, d):
    """The same features for the hours two days after the panel ends."""
    tables = V.all_tables(spark, d)
    asked = tables["train"].select(
        *SERIES_KEYS, (F.col("datetime") + F.make_dt_interval(F.lit(V.DAYS - 14))).alias("datetime"), "row_id"
    )
    rows = build.scoring_table(
        asked, tables, N, forecast_variables=V.FORECAST_COLUMNS, history_variables=V.HISTORY_COLUMNS,
    )
    return _comparable(rows)


SOME_WEATHER = {"forecast_variables": V.FORECAST_COLUMNS, "history_variables": V.HISTORY_COLUMNS}


def _training_table(spark, d, **weather):
    """The labelled table written by month and read back."""
    tables = V.all_tables(spark, d)
    guard = build.guarded(tables)
    rows = build.training_table(tables, N, EMBARGO_DAYS, MODEL_FOLDS, guard=guard, **weather)
    path = scratch_dir(spark, "training")
    io.write_features(rows, path, guard=guard)
    return io.read_features(spark, path)


@query
def training_table(spark, d):
    """The whole training table, 1,674 columns, written and read back."""
    return _comparable(_training_table(spark, d))


def _client_lags(spark, d):
    rows = _complete_lags(spark, d).withColumn("date", F.to_date("datetime"))
    return align.left_join_unique(
        rows, P.client_features(V.clients(spark, d)), ["county", "is_business", "product_type", "date"]
    )


@query
def per_capacity_ratios(spark, d):
    return _client_lags(spark, d).selectExpr(*SERIES_KEYS, "datetime", *ratios.per_capacity(N))


@query
def production_proxy(spark, d):
    forecast = P.forecast_weather_features(
        V.forecast_weather(spark, d), V.stations(spark, d), ["temperature", "surface_solar_radiation_downwards"]
    )
    rows = align.left_join_unique(P.client_features(V.clients(spark, d)), forecast, ["date", "county"])
    proxies = ratios.production_proxy(
        range(22, 46), "surface_solar_radiation_downwards_hours_ahead_{h}", "temperature_hours_ahead_{h}"
    )
    return rounded(
        rows.selectExpr("county", "is_business", "product_type", "date", *proxies), 4, "log1p"
    )


# ---------------------------------------------------------------- folds

def _indexed_orders(spark, d):
    rows = V.read(spark, d, "orders").select(
        "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("target")
    )
    return C.date_index(rows, "o_orderdate", "step")


def _labelled_orders(spark, d, mode="rows", start=0):
    return folds.time_folds(_indexed_orders(spark, d), "step", K, EMBARGO, mode, start)


@query
def fold_boundaries(spark, d):
    return folds.fold_boundaries(_indexed_orders(spark, d), "step", K)


@query
def fold_labels(spark, d):
    return _labelled_orders(spark, d).select("o_orderkey", "step", "fold_info")


@query
def fold_labels_dates(spark, d):
    return _labelled_orders(spark, d, "dates", 100).select("o_orderkey", "step", "fold_info")


@query
def fold_sizes(spark, d):
    return folds.fold_sizes(_labelled_orders(spark, d))


@query
def fold_leakage(spark, d):
    """Ship dates on both sides of folds that were cut by order date."""
    shipped = V.read(spark, d, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"))
    rows = _labelled_orders(spark, d).join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    return folds.leakage(rows, "date", K)


# ---------------------------------------------------------------- upsert

@query
def upsert_latest(spark, d):
    """Line items appended to their orders' first lines; the newest line wins."""
    lines = V.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"
    )
    old = lines.filter(F.col("l_linenumber") <= 3)
    new = lines.filter(F.col("l_linenumber") > 3)
    return upsert.merge_by_key(old, new, ["l_orderkey"], ["l_linenumber", "l_shipdate"])


@query
def dedupe_keys(spark, d):
    readings = V.read(spark, d, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"
    )
    return upsert.dedupe(readings, ["l_suppkey", "l_shipdate"], ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- scores and importance

@query
def clip_nonnegative(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", S.clip(F.col("c_acctbal") - 1000).alias("prediction"))


@query
def score_or_zero(spark, d):
    orders = V.read(spark, d, "orders")
    asked = orders.select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "O").alias("currently_scored")
    )
    predictions = orders.filter(F.col("o_orderkey") % 3 != 0).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("prediction")
    )
    return S.score_or_zero(asked, predictions)


@query
def mae_by_fold(spark, d):
    """Error of repeating the value of two days ago, per validation fold."""
    rows = C.date_index(_complete_lags(spark, d), "datetime", "step")
    rows = folds.time_folds(rows, "step", 3, 2)
    long = rows.select(
        "target", "target_lag_2",
        F.posexplode(F.array(*[folds.fold_of(i) for i in range(3)])).alias("fold", "label"),
    ).filter("label = 'v'")
    return X.mae(long, ["fold"], "target", "target_lag_2")


def _curve(spark, d):
    """Quantities as rounds and line numbers as folds of a learning curve."""
    return V.read(spark, d, "lineitem").groupBy(
        F.col("l_linenumber").alias("fold"), F.col("l_quantity").cast("int").alias("round")
    ).agg(F.avg(V.cents(F.col("l_extendedprice"))).alias("error"))


@query
def learning_curve(spark, d):
    return rounded(X.curves(_curve(spark, d)), 3, "error")


@query
def best_round(spark, d):
    return rounded(X.best_round(_curve(spark, d)), 3, "best_")


NOUNS = ["small", "ring", "bolt", "red", "plate", "gear", "o"]


def _importance(spark, d):
    """Parts as features, line numbers as folds, ordered quantity as importance."""
    parts = V.read(spark, d, "part").select(
        "p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("feature")
    )
    lines = V.read(spark, d, "lineitem").groupBy("l_partkey", F.col("l_linenumber").alias("fold")).agg(
        F.sum("l_quantity").alias("importance")
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("feature", "fold", "importance")


@query
def importance_mean(spark, d):
    return X.importance_mean(_importance(spark, d), 7)


@query
def base_feature_match(spark, d):
    names = V.read(spark, d, "part").select(
        "p_partkey", F.concat_ws("_", F.lower("p_type"), "p_name").alias("feature")
    )
    return X.base_feature(names, NOUNS)


@query
def importance_by_base(spark, d):
    return rounded(X.importance_by_base(X.importance_mean(_importance(spark, d), 7), NOUNS), 4, "average")


@query
def average_rank(spark, d):
    rows = V.read(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return A.average_rank(rows, "quantity", "rank")


@query
def top_features(spark, d):
    return X.top_n(X.importance_mean(_importance(spark, d), 7), 50)


# ---------------------------------------------------------------- models

MODEL_FEATURES = [
    *SERIES_KEYS, "hour", "weekday", "holiday", "eic_count", "installed_capacity",
    "euros_per_mwh", "mean_price_per_mwh", "temperature_hours_ago_mean",
    "temperature_hours_ahead_22", "surface_solar_radiation_downwards_hours_ahead_33",
    "target_lag_2", "target_lag_7", "target_mean_all_lag", "avg_day_target_lag_2",
    "avg_county_target_lag_2", "target_lag_2_vs_mean_all", "target_lag_2_vs_eic",
]


MODEL_PARAMS = {"maxIter": 3, "maxDepth": 4, "subsamplingRate": 0.8, "stepSize": 0.1}


def _model_table(spark, d):
    kept = [*dict.fromkeys(["row_id", "date", "datetime", "target", "fold_info", *MODEL_FEATURES])]
    return _training_table(spark, d, **SOME_WEATHER).select(*kept)


def _fitted(table):
    return M.fit_folds(
        table, MODEL_FEATURES, {"maxIter": 3, "maxDepth": 4, "subsamplingRate": 0.8, "stepSize": 0.1}, MODEL_FOLDS
    )


@query
def gbt_cv(spark, d):
    """Validation error per fold and boosting round."""
    return M.curve_table(spark, _fitted(_model_table(spark, d)).curve)


@query
def gbt_score(spark, d):
    """Blended predictions of the fold models for every row of the panel."""
    table = _model_table(spark, d)
    return S.blend(table, _fitted(table))


@query
def gbt_importance(spark, d):
    """Gain importance of the fold models, averaged."""
    fitted = _fitted(_model_table(spark, d))
    return X.importance_mean(X.importance(spark, fitted.models, vector_names(fitted.encoding)), MODEL_FOLDS)


@query
def train_job(spark, d):
    """What must hold of the whole training job: rows of each fold's parts, rounds, importance, and scored rows."""
    out = scratch_dir(spark, "job")
    rows = land(_model_table(spark, d), spark, "model-table")
    params = {"maxIter": 3, "maxDepth": 4, "subsamplingRate": 0.8, "stepSize": 0.1}
    J.train_and_explain(spark, rows, f"{out}/first", params, MODEL_FOLDS)
    J.train_and_explain(spark, rows, f"{out}/second", params, MODEL_FOLDS, f"{out}/first/importance", 8)
    fitted = load_models(spark, f"{out}/second/models")
    scored = S.blend(rows, fitted)
    facts = spark.createDataFrame([(i,) for i in range(MODEL_FOLDS)], "fold int")
    parts = rows.filter("target IS NOT NULL").select(
        F.posexplode(F.array(*[folds.fold_of(i) for i in range(MODEL_FOLDS)])).alias("fold", "part")
    ).groupBy("fold").agg(F.count_if(F.col("part") == "t").alias("n_train"), F.count_if(F.col("part") == "v").alias("n_valid"))
    shares = X.importance(spark, fitted.models, vector_names(fitted.encoding)).groupBy("fold").agg(
        F.round(F.sum("importance"), 6).alias("importance")
    )
    good = scored.agg(F.count_if(F.col("prediction") >= 0).alias("n_scored"))
    return facts.join(parts, "fold").join(shares, "fold").join(F.broadcast(good))  # one row


# ---------------------------------------------------------------- streaming

def _arrivals(df, spark, name, by):
    """Rows written as files, in ranges of ``by``, for a stream to pick up."""
    path = scratch_dir(spark, name)
    df.repartitionByRange(by).write.parquet(path)
    return path


def _event_batches(spark, d):
    events = V.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    path = _arrivals(events, spark, "arrivals", F.col("ts"))
    stream = replay.read_stream(spark, path, events.schema, files_per_batch=2)
    table = scratch_dir(spark, "events")
    replay.run(stream, replay.upsert_sink(table), scratch_dir(spark, "progress"))
    return table, events.schema


@query
def stream_ingest(spark, d):
    """All events after they came in as micro-batches."""
    table, schema = _event_batches(spark, d)
    return replay.stored(spark, table, schema).drop(replay.BATCH)


@query
def stream_upsert(spark, d):
    """The latest event of each user and type after all micro-batches."""
    table, schema = _event_batches(spark, d)
    return replay.current(spark, table, schema, ["user_id", "event_type"], ["ts", "event_id"])


@query
def stream_score(spark, d):
    """New rows scored batch by batch against a table that came in as a stream.

    The stand-in model repeats the mean of the known lags; a quarter of the
    rows is not to be scored.
    """
    tables = V.all_tables(spark, d)
    schema = tables["target"].schema
    history = replay.read_stream(
        spark, _arrivals(tables["target"], spark, "target_in", F.col("datetime")), schema, files_per_batch=4
    )
    stored = scratch_dir(spark, "target")
    replay.run(history, replay.upsert_sink(stored), scratch_dir(spark, "progress"))
    tables["target"] = replay.current(spark, stored, schema, TABLE_KEYS["target"])

    asked = tables["train"].select(
        *SERIES_KEYS, (F.col("datetime") + F.make_dt_interval(F.lit(V.DAYS - 14))).alias("datetime"),
        "row_id", (F.col("row_id") % 4 != 0).alias("currently_scored"),
    )
    stream = replay.read_stream(
        spark, _arrivals(asked, spark, "asked", F.col("datetime")), asked.schema, files_per_batch=4
    )
    out = scratch_dir(spark, "scores")

    def predict(features):
        return features.select("row_id", S.clip(F.col("target_mean_all_lag")).alias("prediction"))

    sink = replay.score_sink(
        lambda span: tables, predict, out, N,
        forecast_variables=V.FORECAST_COLUMNS, history_variables=V.HISTORY_COLUMNS,
    )
    replay.run(stream, sink, scratch_dir(spark, "progress"))
    scored = table_schema(row_id="long", target="double")
    return replay.stored(spark, out, scored).drop(replay.BATCH)


@query
def live_loop(spark, d):
    """All tables come in as streams, then rows are asked for in two turns, the second after a restart.

    The first turn trains the fold models on the stored tables through the training job and publishes them.
    Every asked row is given with whether its score is as it must be: zero where it is not to be scored,
    else a number that is not negative. Beside them are two stored tables and the number of models.
    """
    tables = V.all_tables(spark, d)
    arrivals = {
        n: (_arrivals(tables[n], spark, f"in-{n}", F.col(TABLE_TIME[n])), tables[n].schema) for n in live.STORED
    }
    kept, progress, out, models, jobs = (scratch_dir(spark, n) for n in ("store", "progress", "scores", "models", "jobs"))
    live.collect(spark, arrivals, kept, progress, compact_every=2, files_per_batch=4)

    def fit(stored):
        rows = land(build.training_table(
            stored | {"train": stored["target"]}, N, EMBARGO_DAYS, MODEL_FOLDS, **SOME_WEATHER), spark, "live-training")
        used = rows.select(*dict.fromkeys(["date", "datetime", "target", "fold_info", *MODEL_FEATURES]))
        return J.train_and_explain(spark, used, jobs, MODEL_PARAMS, MODEL_FOLDS)

    asked = tables["train"].select(
        *SERIES_KEYS, (F.col("datetime") + F.make_dt_interval(F.lit(V.DAYS - 14))).alias("prediction_datetime"),
        "row_id", (F.col("row_id") % 4 != 0).alias("currently_scored"),
    )
    folder = scratch_dir(spark, "asked")
    for turn in range(2):
        asked.filter(F.dayofmonth("prediction_datetime") % 2 == turn).write.mode("append").parquet(folder)
        live.serve(
            spark, (folder, asked.schema), kept, io.conform(tables["location"], SCHEMAS["location"]), models, fit,
            out, progress, N, **SOME_WEATHER,
        )
    now = live.tables(spark, kept, tables["location"])
    scores = replay.stored(spark, out, table_schema(row_id="long", target="double"))
    right = F.when(F.col("row_id") % 4 == 0, F.col("target") == 0).otherwise(F.col("target") >= 0)
    hour = (clock_micros(F.col("forecast_date")) / 3_600_000_000).cast("long")
    fitted = spark.range(1).select(F.lit("models"), F.lit(registry.published(spark, models)[0]).cast("long"), F.lit(1.0))
    return (
        scores.select(F.lit("score").alias("what"), F.col("row_id").alias("id"), right.cast("double").alias("value"))
        .union(now["electricity"].select(F.lit("electricity"), hour, F.col("euros_per_mwh").cast("double")))
        .union(now["gas"].select(F.lit("gas"), F.datediff("forecast_date", F.lit("1970-01-01")).cast("long"), F.col("lowest_price_per_mwh").cast("double")))
        .union(fitted)
    )


TURNS, TURN_DAYS = 6, 5


def _turn():
    """The five days that an event falls into."""
    return F.floor(F.datediff("ts", F.lit(V.START).cast("date")) / TURN_DAYS).cast("int")


def _in_turns(spark, rows, name):
    """Yields a folder after each turn's rows have arrived in it."""
    rows = land(rows.filter(F.col("turn") < TURNS), spark, f"{name}-turns")
    folder = scratch_dir(spark, name)
    for turn in range(TURNS):
        rows.filter(F.col("turn") == turn).drop("turn").write.mode("append").parquet(folder)
        yield folder


@query
def stream_dedupe(spark, d):
    """Events of five days at a time, each turn after a restart of the stream, repeats remembered for six days.

    Planted: repeats in the same turn and in the next, events that first arrive three turns late, and
    events that come again after twenty days.
    """
    events = V.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    late, own = F.col("event_id") % 11 == 3, _turn()
    again = events.filter(F.col("event_id") % 13 == 5).select(
        "event_id", (F.col("ts") + F.make_dt_interval(F.lit(20))).alias("ts"), "user_id", "event_type", "value", (own + 4).alias("turn"))
    arrived = (
        events.withColumn("turn", F.when(late, own + 3).otherwise(own))
        .union(events.filter(~late & (F.col("event_id") % 5 == 0)).withColumn("turn", own))
        .union(events.filter(~late & (F.col("event_id") % 7 == 0)).withColumn("turn", own + 1))
        .union(again)
    )
    table, progress = scratch_dir(spark, "deduped"), scratch_dir(spark, "progress")
    for folder in _in_turns(spark, arrived, "repeats"):
        stream = replay.read_stream(spark, folder, events.schema)
        replay.run(live_events.dedupe_within(stream, ["event_id"], "ts", "6 days"), replay.upsert_sink(table), progress)
    return replay.stored(spark, table, events.schema).drop(replay.BATCH)


@query
def stream_hourly_panel(spark, d):
    """The hours of each series that are over, rolled up from events of five days at a time, and how many came too late.

    Planted: events that arrive two turns late, under a delay of two days.
    """
    events = V.read(spark, d, "events")
    late, own = F.col("event_id") % 11 == 3, _turn()
    arrived = V.series_events(events).select(*SERIES_KEYS, "ts", "cents", F.when(late, own + 2).otherwise(own).alias("turn"))
    schema = arrived.drop("turn").schema
    table, progress = scratch_dir(spark, "hours"), scratch_dir(spark, "progress")
    for folder in _in_turns(spark, arrived, "events-in"):
        stream = replay.read_stream(spark, folder, schema)
        hours = live_events.hourly_panel(stream, SERIES_KEYS, "ts", {"cents": F.sum("cents")}, "2 days")
        replay.run(hours, replay.upsert_sink(table), progress)
    panel = replay.stored(spark, table, hours.schema).drop(replay.BATCH)
    dropped = live_events.late_rows(spark, spark.read.schema(schema).parquet(folder).count(), panel, progress)
    return panel.withColumn("n_late", F.lit(dropped).cast("long"))


@query
def store_versions(spark, d):
    """Line items as they stand in a versioned store: batches by line number, compacted on the way, and read for two months.

    Each key is changed by later batches; a reader from before the last compaction still sees its version.
    """
    lines = V.read(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_orderkey", "l_quantity")
    lines = upsert.dedupe(lines, ["l_suppkey", "l_shipdate", "l_linenumber"], ["l_orderkey", "l_quantity"])
    keys, path = ["l_suppkey", "l_shipdate"], scratch_dir(spark, "versions")
    lines = land(lines, spark, "line-batches")
    readers = []
    for batch in range(1, 8):
        store.append(lines.filter(F.col("l_linenumber") == batch), batch, path, "l_shipdate")
        if batch in (2, 5):
            store.compact(spark, path, lines.schema, keys, "l_shipdate", keep=3)
        if batch in (4, 7):
            readers.append(store.current(spark, path, lines.schema, keys))
    store.compact(spark, path, lines.schema, keys, "l_shipdate", keep=3)
    readers.append(store.current(spark, path, lines.schema, keys, (datetime(1996, 3, 1), datetime(1996, 4, 30))))
    parts = [df.withColumn("reader", F.lit(i)) for i, df in enumerate(readers)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
