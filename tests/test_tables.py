"""Sources, whole feature tables, streaming and models."""

from datetime import date, datetime

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from panelspark.catalog import views as V
from panelspark.ml import explain, score, store, train
from panelspark.ml.features import learn_encoding, select_features
from panelspark.operators import align
from panelspark.plans import build
from panelspark.plans import features as P
from panelspark.session import scratch_dir
from panelspark.sources import tables as io
from panelspark.sources.schema import (
    FORECAST_VARIABLES,
    HISTORY_VARIABLES,
    SCHEMAS,
    SERIES_KEYS,
    TABLE_KEYS,
)
from panelspark.streaming import replay


# ---------------------------------------------------------------- sources

def test_csv_tables_are_projected_and_typed(spark, tmp_path):
    (tmp_path / "train.csv").write_text(
        "county,is_business,product_type,target,is_consumption,datetime,data_block_id,row_id,prediction_unit_id\n"
        "0,0,1,0.713,0,2021-09-01 00:00:00,0,0,0\n0,0,1,,1,2021-09-01 00:00:00,0,1,0\n")
    df = io.read_table(spark, "train", str(tmp_path / "train.csv"))
    assert df.schema.simpleString() == SCHEMAS["train"].simpleString()
    assert rows(df)[0][3:6] == (0.713, 0, datetime(2021, 9, 1))
    assert df.filter("target is null").count() == 1


def test_station_hours_are_read_once(spark, tmp_path):
    head = ",".join(SCHEMAS["historical_weather"].fieldNames())
    line = "2021-09-01 00:00:00," + ",".join("1" for _ in HISTORY_VARIABLES) + ",57.6,21.7"
    (tmp_path / "historical_weather.csv").write_text(f"{head}\n{line}\n{line}\n")
    assert io.read_table(spark, "historical_weather", str(tmp_path / "historical_weather.csv")).count() == 1


def test_a_value_that_does_not_fit_raises(spark):
    df = spark.createDataFrame([("70000",)], "hours_ahead string")
    from panelspark.sources.schema import table_schema
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        io.conform(df, table_schema(hours_ahead="short")).collect()


def test_epoch_and_iso_text(spark):
    df = spark.createDataFrame([("1630454400000000000",), ("2021-09-01",), ("2021-09-01 00:00:00",), ("-1000",)], "s string")
    got = [r[0] for r in df.select(io.parse_epoch_or_iso(F.col("s"))).collect()]
    assert got == [datetime(2021, 9, 1)] * 3 + [datetime(1969, 12, 31, 23, 59, 59, 999999)]


def test_live_batch_takes_the_stored_form(spark):
    batch = spark.createDataFrame(
        [(5, True, 2, False, "2023-05-28 01:00:00", 9, True)],
        "county int, is_business boolean, product_type int, is_consumption boolean, prediction_datetime string, row_id int, currently_scored boolean")
    got = io.conform_batch(batch, "test")
    assert got.schema.simpleString() == SCHEMAS["test"].simpleString()
    assert rows(got) == [(5, 1, 2, 0, datetime(2023, 5, 28, 1), 9)]


# ---------------------------------------------------------------- whole tables

def full_tables(spark):
    """The derived tables with every declared weather variable."""
    tables = V.all_tables(spark, SF)
    for name, variables in (("forecast_weather", FORECAST_VARIABLES), ("historical_weather", HISTORY_VARIABLES)):
        df = tables[name]
        tables[name] = df.select("*", *[
            F.col("temperature").alias(v) for v in variables if v not in df.columns])
    return tables


@pytest.fixture(scope="module")
def trained(spark):
    tables = full_tables(spark)
    df = build.training_table(tables, 14, 2, 3)
    path = scratch_dir(spark, "features")
    io.write_features(io.compact_types(df), path)
    return tables, df, path


def test_training_table_is_complete(spark, trained):
    tables, df, path = trained
    assert len(df.columns) == len(set(df.columns)) == 1674
    assert len(select_features(df.columns)) == 1667
    stored = io.read_features(spark, path)
    assert sorted(stored.columns) == sorted(df.columns)
    assert stored.count() == tables["train"].count()
    assert dict(stored.dtypes)["target"] == "double" and dict(stored.dtypes)["target_lag_2"] == "float"
    part = stored.filter(F.col("target_lag_2").isNull())
    lag_names = P.target_features(tables["train"], 14).columns
    blank = [c for c in lag_names if c not in tables["train"].columns]
    assert part.select(F.sum(sum(F.col(f"`{c}`").isNotNull().cast("int") for c in blank))).first()[0] == 0
    assert len(blank) == 399


def test_scoring_equals_training_on_known_rows(spark, trained):
    tables, _, path = trained
    asked = tables["train"].drop("target").filter(F.col("datetime") >= datetime(2024, 1, 28))
    got = build.scoring_table(asked, tables, 14)
    assert "date_order_kfold" not in got.columns and len(got.columns) == 1674 - 3
    names = ["row_id", "target_lag_2", "sum_county_target_lag_5", "temperature_hours_ahead_30",
             "rain_hours_ago_mean", "eic_count", "euros_per_mwh", "holiday", "target_argmax_all_lag"]
    want = io.read_features(spark, path).filter(F.col("datetime") >= datetime(2024, 1, 28))
    assert rows(io.compact_types(got.select(names))) == rows(want.select(names))


def test_repeated_side_rows_are_refused(spark):
    tables = V.all_tables(spark, SF)
    tables["gas"] = tables["gas"].unionByName(tables["gas"])
    with pytest.raises(ValueError, match="gas"):
        build.check_inputs(tables)


def test_wide_rows_are_written_plain_and_not_sorted_by_month(spark, monkeypatch, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import DataFrameWriter

    written, seen, before = DataFrameWriter.parquet, [], spark.conf.get(io.OPEN_FILES)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.append(spark.conf.get(io.OPEN_FILES)), written(self, *a, **b))[1])
    df = spark.range(0, 300, 1, 1).selectExpr("id", "date_add(DATE '2024-01-15', CAST(id % 6 AS INT) * 30) AS date", "id / 7 AS x")
    io.write_features(df, str(tmp_path / "t"))
    assert seen == [str(io.OPEN_MONTHS)] and spark.conf.get(io.OPEN_FILES) == before
    assert rows(io.read_features(spark, str(tmp_path / "t"))) == rows(df)  # six months, more than are kept open
    column = pq.ParquetFile(next((tmp_path / "t" / "date_month=2024-01").glob("*.parquet"))).metadata.row_group(0).column(2)
    assert column.compression == "ZSTD" and not column.has_dictionary_page


def test_large_weather_tables_are_shuffled_not_broadcast(spark, monkeypatch):
    left = spark.range(100).select((F.col("id") % 7).alias("county"), F.lit(date(2024, 1, 1)).alias("date"), "id")
    weather = spark.range(7).select(F.col("id").alias("county"), F.lit(date(2024, 1, 1)).alias("date"), F.rand(1).alias("w"))
    small = P.with_weather(left, weather)
    monkeypatch.setattr(P, "fits_broadcast", lambda df, unjudged=None: False)
    large = P.with_weather(left, weather)
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().toString()
    assert rows(small.select("id", "w")) == rows(large.select("id", "w"))


# ---------------------------------------------------------------- streaming

KEYED = "k int, at timestamp_ntz, v double"


def _small_tables(spark):
    """Twelve series of two counties and one unknown at every hour of 20 days across a block's end, with their side tables."""
    hours = spark.sql("SELECT timestamp_ntz '2023-12-25 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS datetime, id AS h FROM range(480)")
    series = spark.sql(
        "SELECT IF(id < 8, CAST(id % 2 AS INT), NULL) AS county, CAST(id DIV 2 % 2 AS INT) AS is_business,"
        " CAST(id DIV 4 AS INT) AS product_type, CAST(id % 3 AS INT) AS is_consumption, id AS s FROM range(12)")
    train = series.crossJoin(hours).selectExpr(
        *SERIES_KEYS, "datetime", "IF(h % 89 = 7, NULL, CAST((h * 7 + s * 13) % 101 AS DOUBLE)) AS target", "h * 12 + s AS row_id")
    days = hours.selectExpr("to_date(datetime) AS date").distinct()
    stations = spark.createDataFrame([(57.6, 23.2, 0), (57.9, 23.2, 1), (58.2, 23.7, None)], "latitude double, longitude double, county int")
    weather = stations.crossJoin(hours)
    forecast = weather.crossJoin(spark.range(20, 25)).filter("h % 24 = 0 AND h < 400").selectExpr(
        "latitude", "longitude", "CAST(id AS INT) AS hours_ahead", "datetime AS origin_datetime",
        *[f"CAST(h % 17 + id + {i} AS DOUBLE) AS `{v}`" for i, v in enumerate(V.FORECAST_COLUMNS)])
    history = weather.selectExpr(
        "latitude", "longitude", "datetime", *[f"CAST(h % 13 + {i} AS DOUBLE) AS `{v}`" for i, v in enumerate(V.HISTORY_COLUMNS)])
    client = series.filter("is_consumption = 0 AND county IS NOT NULL").select("county", "is_business", "product_type").distinct().crossJoin(days)
    return {
        "train": train, "target": train.drop("row_id"), "location": stations, "forecast_weather": forecast, "historical_weather": history,
        "client": client.selectExpr("*", "CAST(day(date) AS INT) AS eic_count", "CAST(day(date) * 3 AS DOUBLE) AS installed_capacity"),
        "electricity": hours.selectExpr("datetime AS forecast_date", "CAST(h % 5 AS DOUBLE) AS euros_per_mwh"),
        "gas": days.selectExpr("date AS forecast_date", "CAST(day(date) AS DOUBLE) AS lowest_price_per_mwh", "CAST(day(date) + 2 AS DOUBLE) AS highest_price_per_mwh"),
    }


@pytest.mark.parametrize("training", [True, False])
def test_wide_rows_do_not_move_for_a_large_forecast(spark, monkeypatch, training):
    tables = _small_tables(spark)
    asked = tables["train"].filter("day(datetime) % 2 = 0")
    asked = asked if training else asked.selectExpr(*SERIES_KEYS, "datetime + interval 5 days AS datetime", "row_id")

    def features():
        rows_in = tables["train"] if training else asked
        return build.feature_rows(rows_in, tables, 3, training, V.FORECAST_COLUMNS, V.HISTORY_COLUMNS, hours=(21, 24))

    small = features()
    monkeypatch.setattr(P, "fits_broadcast", lambda df, unjudged=None: unjudged is None)
    large = features()
    assert large.columns == small.columns
    assert rows(large) == rows(small)
    assert large.filter("temperature_hours_ahead_22 IS NOT NULL AND target_lag_3 IS NOT NULL").count() > 500
    plan = large._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan
    # no exchange above the lags' windows
    ready = large._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in ready[: ready.index("Window")]


def test_a_crowded_county_is_spread_for_a_large_forecast(spark, monkeypatch):
    tables = _small_tables(spark)
    few = P.packed_forecast(tables["forecast_weather"], tables["location"], V.FORECAST_COLUMNS, (21, 24))
    monkeypatch.setattr(P, "fits_broadcast", lambda df, unjudged=None: False)
    assert P.placed_near(few, tables["train"], 3) == ["county"]
    monkeypatch.setattr(P, "hot_keys", lambda df, on, total=None: align.hot_keys(df, on, rows_per_task=50))
    assert P.placed_near(few, tables["train"], 3) is None


def test_a_batch_written_twice_counts_once(spark):
    path = scratch_dir(spark, "table")
    batch = spark.createDataFrame([(1, datetime(2024, 1, 1), 1.0)], KEYED)
    replay.append_batch(batch, 0, path)
    replay.append_batch(batch.withColumn("v", F.lit(2.0)), 1, path)
    replay.append_batch(batch.withColumn("v", F.lit(3.0)), 1, path)
    assert replay.stored(spark, path, batch.schema).count() == 2
    assert rows(replay.current(spark, path, batch.schema, ["k", "at"])) == [(1, datetime(2024, 1, 1), 3.0)]


def test_batches_are_gated_and_training_happens_once(spark):
    source, out = scratch_dir(spark, "in"), []
    for i, scored in enumerate((False, True, True)):
        spark.createDataFrame([(i, scored)], "row_id int, currently_scored boolean").write.mode("append").parquet(source)
    state = {"trained": 0}

    def train_once():
        state["trained"] += 1

    each = replay.bootstrap(
        lambda: state["trained"] > 0, train_once,
        lambda b, i: out.append("collect"), lambda b, i: out.append("score"))
    stream = replay.read_stream(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    replay.run(stream, each, scratch_dir(spark, "progress"))
    assert state["trained"] == 1
    assert out.count("collect") >= out.count("score") >= 2


# ---------------------------------------------------------------- models

def model_rows(spark):
    df = spark.range(1200).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("county"),
        (F.col("id") % 60).cast("int").alias("step"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 13).cast("double")).alias("x"))
    df = df.withColumn("target", F.col("county") * 10 + F.coalesce("x", F.lit(50.0)))
    from panelspark.operators.folds import time_folds
    return time_folds(df.withColumn("date", F.date_add(F.lit(date(2024, 1, 1)), F.col("step"))), "step", 3, 2)


def test_fold_models_learn_and_survive_saving(spark):
    df = model_rows(spark)
    fitted = train.fit_folds(df, ["county", "x"], {"maxIter": 6, "maxDepth": 4, "stepSize": 0.5}, 3)
    assert fitted.encoding.categories == ["county"] and fitted.encoding.flags == ["x"]
    assert fitted.encoding.fill["x"] == -1.0
    curve = explain.curves(train.curve_table(spark, fitted.curve)).orderBy("round").collect()
    assert len(curve) == 6 and curve[-1]["average_error"] < curve[0]["average_error"]
    path = scratch_dir(spark, "model")
    store.save(spark, fitted, path)
    again = store.load(spark, path)
    assert again.best_round == fitted.best_round and again.curve == fitted.curve
    one, two = score.blend(df, fitted), score.blend(df, again)
    assert one.count() == 1200 and rows(one) == rows(two)
    assert one.filter("prediction < 0").isEmpty()

    names = ["county", "x", "x"]
    table = explain.importance_mean(explain.importance(spark, fitted.models, names), 3)
    assert {r["feature"] for r in table.collect()} == {"county", "x"}
    ranked = scratch_dir(spark, "ranked")
    store.save_importance(table, ranked)
    assert len(store.load_feature_list(spark, ranked, 1)) == 1


def test_one_model_on_all_rows(spark):
    df = model_rows(spark)
    fitted = train.fit_all(df, ["county", "x"], {"maxDepth": 3}, 2)
    assert score.single(df, fitted).count() == 1200


def test_a_leaking_fold_is_refused(spark):
    df = model_rows(spark).withColumn("date", F.lit(date(2024, 1, 1)))
    with pytest.raises(ValueError, match="fold"):
        train.fit_folds(df, ["county"], {"maxIter": 1}, 3)
    with pytest.raises(ValueError, match="target"):
        train.fit_folds(df, ["target"], {"maxIter": 1}, 3)


def test_categories_stay_categories_however_many(spark):
    df = spark.range(5000).select(F.col("id").cast("int").alias("county"))
    enc = learn_encoding(df, ["county"])
    assert enc.categories == ["county"] and enc.fill == {} and enc.max_bins == 5002


def test_text_integers_are_exact(spark):
    from panelspark.sources.schema import table_schema
    text = spark.createDataFrame([("9007199254740993",), ("3.0",), ("True",), (None,), ("-7",)], "i string")
    assert rows(io.conform(text, table_schema(i="long"))) == sorted([(9007199254740993,), (3,), (1,), (None,), (-7,)], key=repr)
    for bad in ("3.7", "x", "9223372036854775808"):
        with pytest.raises(Exception):
            io.conform(spark.createDataFrame([(bad,)], "i string"), table_schema(i="long")).collect()


def test_a_batch_can_keep_its_gate(spark):
    batch = spark.createDataFrame(
        [(5, True, 2, False, "2023-05-28 01:00:00", 9, False)],
        "county int, is_business boolean, product_type int, is_consumption boolean, prediction_datetime string, row_id int, currently_scored boolean")
    assert rows(io.conform_batch(batch, "test", keep_gate=True)) == [(5, 1, 2, 0, datetime(2023, 5, 28, 1), 9, False)]


def test_scratch_of_a_scope_is_removed(spark):
    import os
    from panelspark.session import land, scratch_scope, shared_folder
    with scratch_scope(spark):
        assert land(spark.range(3), spark, "scoped").count() == 3
    assert not [f for f in os.listdir(shared_folder(spark)) if f.startswith("scoped-")]


def test_no_local_scratch_off_local_mode():
    from types import SimpleNamespace
    from panelspark.session import shared_folder
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context))


def test_best_round_is_the_earliest_least(spark):
    curve = [(f, r, e) for f in (0, 1) for r, e in enumerate([3.0, 1.0, 1.0])]
    assert explain.best_round(train.curve_table(spark, curve)).first()["best_round"] == 2


def test_feature_lists():
    columns = [*SERIES_KEYS, "row_id", "target", "fold_info", "date", "a", "year"]
    assert select_features(columns) == [*SERIES_KEYS, "a"]
    assert select_features(columns, ["a", "county", "b"], 2) == ["a", "county", "is_business", "product_type", "is_consumption"]


def test_missing_predictions_become_zero(spark):
    asked = spark.createDataFrame([(1, True), (2, False), (3, True)], "row_id int, currently_scored boolean")
    pred = spark.createDataFrame([(1, 4.0), (2, 5.0)], "row_id int, prediction double")
    assert rows(score.score_or_zero(asked, pred)) == [(1, 4.0), (2, 0.0), (3, 0.0)]


def test_table_keys_are_declared_columns():
    for name, keys in TABLE_KEYS.items():
        assert set(keys) <= set(SCHEMAS[name].fieldNames()), name
