import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from dateutil.easter import easter
from pyspark.sql import functions as F

from panelspark.functions import calendar as C
from panelspark.functions.text import first_contained
from panelspark.operators import aggregates as A
from panelspark.operators import align, folds, pivot, ratios, upsert
from panelspark.plans import features as P


# ---------------------------------------------------------------- alignment

def test_history_is_used_one_or_two_days_later(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 10, 59),), (datetime(2024, 1, 1, 11),)], "t timestamp_ntz")
    got = [r["d"] for r in align.publish_shift_by_hour(df, "t", "d").orderBy("t").collect()]
    assert got == [date(2024, 1, 2), date(2024, 1, 3)]


def test_lookback_keeps_both_ends(spark):
    asked = spark.createDataFrame([(datetime(2024, 3, 1, 5),), (datetime(2024, 3, 2, 5),)], "datetime timestamp_ntz")
    limits = align.lookback_bounds(asked, "datetime", 14)
    assert limits == (datetime(2024, 1, 16, 5), datetime(2024, 4, 16, 5))
    times = [limits[0] - timedelta(hours=1), limits[0], limits[1], limits[1] + timedelta(hours=1)]
    hours = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert align.lookback(hours, "t", limits).count() == 2
    days = spark.createDataFrame([(date(2024, 1, 16),), (date(2024, 1, 17),), (date(2024, 4, 16),), (date(2024, 4, 17),)], "d date")
    # a day is its midnight: 16 January lies before 05:00 of that day
    assert [r["d"] for r in align.lookback(days, "d", limits).orderBy("d").collect()] == [date(2024, 1, 17), date(2024, 4, 16)]
    assert align.lookback(days, "d", None).count() == 0


def test_lookback_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    limits = (datetime(2001, 1, 1), datetime(2001, 2, 1))
    plan = align.lookback(df, "l_shipdate", limits)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual" in plan


def test_stations_match_in_either_float_width(spark):
    weather = spark.createDataFrame([(57.6, 21.7, 1), (58.2, 22.2, 2), (59.0, 23.0, 3)], "latitude float, longitude float, v int")
    stations = spark.createDataFrame([(57.6, 21.7, 0), (58.2, 22.2, None)], "latitude double, longitude double, county int")
    assert rows(align.station_to_county(weather, stations).select("v", "county")) == [(1, 0)]


def test_hot_keys_are_spread_without_changing_the_result(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = align.hot_keys(left, ["k"], rows_per_task=500)
    assert rows(hot) == [(0, 4)]
    plain = align.left_join_unique(left, right, ["k"])
    spread = align.left_join_unique(left, right, ["k"], hot=hot)
    assert spread.count() == 5000
    assert rows(spread.select("k", "id", "v")) == rows(plain.select("k", "id", "v"))


def test_repeated_join_keys_are_found(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert rows(align.duplicate_keys(df, ["k"])) == [(1, 2)]
    with pytest.raises(ValueError):
        align.assert_unique(df, ["k"], "df")


# ---------------------------------------------------------------- aggregates

def test_std_of_one_row_is_null(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 1.0), (2, 3.0)], "k int, v double")
    got = {r["k"]: r for r in A.stats(df, ["k"], "v", "v").collect()}
    assert got[1]["std_v"] is None and got[1]["avg_v"] == 4.0
    assert got[2]["std_v"] == pytest.approx(2 ** 0.5)


def test_stacked_marginals_equal_separate_groupings(spark):
    rng = random.Random(3)
    data = [(rng.randrange(3), rng.randrange(2), datetime(2024, 1, 1, rng.randrange(4)), float(rng.randrange(9))) for _ in range(200)]
    df = spark.createDataFrame(data, "a int, b int, t timestamp_ntz, v double")
    stacked = A.marginal_stats(df, ["a", "b"], "t", "v")
    for key, other in (("a", "b"), ("b", "a")):
        one = A.marginals(df, ["a", "b"], "t", "v")[key]
        part = stacked.filter(F.col("over_key") == key).select(
            other, "t", *[F.col(f"{s}_v").alias(f"{s}_{key}_v") for s in ("avg", "sum", "min", "max")])
        assert rows(part) == rows(one.select(part.columns))


def test_group_means_return_to_every_row(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 5.0), (None, 1.0), (None, 3.0)], "k int, v double")
    got = rows(A.window_mean(df, ["k"], {"m": F.avg("v"), "w": F.avg("v").cast("int")}))
    assert got == sorted([(1, 2.0, 3.5, 3), (1, 5.0, 3.5, 3), (None, 1.0, 2.0, 2), (None, 3.0, 2.0, 2)], key=repr)


@pytest.mark.parametrize("partitions", [1, 8, 2000])
@pytest.mark.parametrize("kind", ["double", "date", "string"])
def test_average_rank(spark, partitions, kind):
    rng = random.Random(5)
    values = [rng.randrange(40) for _ in range(300)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    of_kind = {"double": F.col("v"), "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("v").cast("int")), "string": F.format_string("%05.1f", "v")}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["i"]: r["rank"] for r in A.average_rank(df.withColumn("v", of_kind[kind]), "v", "rank").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    count = Counter(values)
    for i, v in enumerate(values):
        below = sum(n for w, n in count.items() if w < v)
        assert got[i] == below + (count[v] + 1) / 2


def test_means_are_truncated_to_whole_numbers(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0)], "k int, a int, b double")
    assert rows(A.mean_as(df, ["k"], {"a": "short", "b": None})) == [(1, 2, 1.5)]


def test_hours_ago_counts_back_from_the_last_hour(spark):
    df = spark.createDataFrame([(1.0, 2.0, date(2024, 1, 2), datetime(2024, 1, 1, h)) for h in range(5)],
                               "latitude double, longitude double, date date, datetime timestamp_ntz")
    got = {r["datetime"].hour: r["hours_ago"] for r in P.hours_ago(df).collect()}
    assert got == {4: 0, 3: 1, 2: 2, 1: 3, 0: 4}


def test_pivot_against_conditional_aggregates(spark):
    rng = random.Random(9)
    df = spark.createDataFrame(
        [(rng.randrange(3), rng.randrange(21, 25), float(rng.randrange(50)), float(rng.randrange(50))) for _ in range(120)],
        "k int, h int, a double, b double")
    got = pivot.pivot_stats(df, ["k"], "h", [22, 23], ["a", "b"])
    want = df.groupBy("k").agg(*[
        F.expr(f"{fn}(CASE WHEN h = {h} THEN {v} END)").alias(f"{v}_hours_ahead_{h}{s}")
        for fn, s in (("avg", ""), ("min", "_min"), ("max", "_max")) for v in "ab" for h in (22, 23)])
    assert rows(got.select(want.columns)) == rows(want)
    one = pivot.pivot_stats(df, ["k"], "h", [22], ["a"], stats=("mean",))
    assert one.columns == ["k", "a_hours_ahead_22"]


def test_forecast_band_ends(spark):
    stations = spark.createDataFrame([(1.0, 1.0, 5)], "latitude double, longitude double, county int")
    weather = spark.createDataFrame(
        [(1.0, 1.0, h, datetime(2024, 1, 1, 2), float(h)) for h in (21, 22, 45, 46)],
        "latitude double, longitude double, hours_ahead int, origin_datetime timestamp_ntz, temperature double")
    out = P.forecast_weather_features(weather, stations, ["temperature"]).first()
    assert out["date"] == date(2024, 1, 2) and out["county"] == 5
    assert out["temperature_hours_ahead_22"] == 22.0 and out["temperature_hours_ahead_45_max"] == 45.0
    assert out["temperature_hours_ahead_22_std"] is None and out["temperature_hours_ahead_30"] is None


def test_production_proxy_at_absolute_zero(spark):
    df = spark.createDataFrame([(2.0, 1.0, 10.0, -273.15), (2.0, 1.0, 10.0, 0.0)], "installed_capacity double, installed_capacity_log1p double, r_22 double, t_22 double")
    got = df.selectExpr(*ratios.production_proxy(range(22, 23), "r_{h}", "t_{h}")).collect()
    assert got[0]["production_capacity_temperature_22"] is None
    assert got[1]["production_capacity_temperature_22"] == pytest.approx(20 / 273.15)


def test_client_features(spark):
    df = spark.createDataFrame([(1, 0, 1, 3, 9.0, date(2024, 1, 30)), (1, 0, 1, 4, 3.0, date(2024, 1, 30))],
                               "product_type int, county int, is_business int, eic_count int, installed_capacity float, date date")
    out = P.client_features(df).orderBy("eic_count").collect()
    assert [r["date"] for r in out] == [date(2024, 2, 1)] * 2
    assert [r["eic_count_mean_date"] for r in out] == [3, 3]
    assert [r["installed_capacity_mean_date"] for r in out] == [6.0, 6.0]


# ---------------------------------------------------------------- calendar

def test_iso_weeks_around_new_year(spark):
    days = [datetime(2020, 12, 31), datetime(2021, 1, 3), datetime(2021, 1, 4), datetime(2024, 12, 30, 23)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    for r in C.calendar(df, "t").collect():
        _, week, weekday = r["t"].isocalendar()
        assert (r["week"], r["weekday"]) == (week, weekday)
        assert (r["hour"], r["day"], r["ordinal_day"]) == (r["t"].hour, r["t"].day, r["t"].timetuple().tm_yday)


def test_easter_of_every_year(spark):
    got = spark.range(1900, 2100).select("id", C.easter_sunday(F.col("id").cast("int")).alias("e")).collect()
    assert all(r["e"] == easter(r["id"]) for r in got)


def test_holidays_of_a_year(spark):
    got = [r["date"] for r in C.holidays(spark, 2023, 2023).orderBy("date").collect()]
    assert got == [date(2023, m, d) for m, d in (
        (1, 1), (2, 24), (4, 7), (4, 9), (5, 1), (5, 28), (6, 23), (6, 24), (8, 20), (12, 24), (12, 25), (12, 26))]


def test_first_contained_follows_the_list(spark):
    df = spark.createDataFrame([("target_lag_2_vs_eic_count",), ("nothing",)], "s string")
    got = [r[0] for r in df.select(first_contained(F.col("s"), ["eic_count", "target"])).collect()]
    assert got == ["eic_count", None]


# ---------------------------------------------------------------- folds

def brute_folds(steps, k, embargo, mode="rows", start=0):
    """Labels by plain loops over the rows' steps."""
    eras = sorted(set(steps))
    count = Counter(steps)
    if mode == "rows":
        share, seen = {}, 0
        for e in eras:
            seen += count[e]
            share[e] = seen / len(steps)
        cuts = [next(e for e in eras if share[e] >= (1 / k) * i) for i in range(k)]
        valid = [[e for e in eras if (cuts[i] if i else eras[0]) <= e <= (cuts[i + 1] if i < k - 1 else eras[-1])] for i in range(k)]
    else:
        n = (len(eras) - start) // k
        valid = [eras[start + i * n: start + (i + 1) * n if i < k - 1 else len(eras)] for i in range(k)]
    labels = {}
    for e in eras:
        one = []
        for v in valid:
            lo, hi = min(v), max(v)
            if not lo <= e <= hi and abs(e - hi) > embargo and abs(e - lo) > embargo:
                one.append("t")
            else:
                one.append("v" if e in v else "n")
        labels[e] = ", ".join(one)
    return labels


@pytest.mark.parametrize("mode,start", [("rows", 0), ("dates", 0), ("dates", 7)])
def test_folds_against_loops(spark, mode, start):
    rng = random.Random(11)
    steps = [int(60 * rng.random() ** 2) for _ in range(700)]
    df = spark.createDataFrame([(s,) for s in steps], "step int")
    got = {r["step"]: r["fold_info"] for r in folds.time_folds(df, "step", 5, 4, mode, start).distinct().collect()}
    assert got == brute_folds(steps, 5, 4, mode, start)


def test_one_step_with_most_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 3).otherwise(F.col("id") % 10).cast("int").alias("step"))
    steps = [r["step"] for r in df.collect()]
    got = {r["step"]: r["fold_info"] for r in folds.time_folds(df, "step", 3, 1).distinct().collect()}
    assert got == brute_folds(steps, 3, 1)


def test_folds_do_not_leak(spark):
    df = spark.range(900).select((F.col("id") % 90).cast("int").alias("step"), F.lit(1.0).alias("target"))
    labelled = folds.time_folds(df, "step", 4, 3)
    assert folds.leakage(labelled, "step", 4).isEmpty()
    sizes = {(r["fold"], r["label"]): r["n_rows"] for r in folds.fold_sizes(labelled).collect()}
    assert sum(n for (f, _), n in sizes.items() if f == 0) == 900
    assert folds.split(labelled, 0, "v").count() == sizes[0, "v"]
    long = folds.fold_steps(labelled, "step", 4)
    assert long.count() == 90 * 4


# ---------------------------------------------------------------- upsert

def test_newest_row_wins_and_ties_are_settled(spark):
    old = spark.createDataFrame([(1, 0, 5.0), (2, 0, 6.0)], "k int, version int, v double")
    new = spark.createDataFrame([(1, 1, 4.0), (3, 1, 1.0), (3, 1, 2.0), (2, 1, None)], "k int, version int, v double")
    assert rows(upsert.merge_by_key(old, new, ["k"], ["version"])) == [(1, 1, 4.0), (2, 1, None), (3, 1, 2.0)]


def test_dedupe(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, o int, v string")
    assert upsert.dedupe(df, ["k"]).count() == 2
    assert rows(upsert.dedupe(df, ["k"], ["o"])) == [(1, 2, "b"), (2, 1, "c")]


def test_a_hot_null_key_is_spread_too(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = align.hot_keys(left, ["k"], rows_per_task=1000)
    assert rows(hot) == [(None, 2)]
    plain = align.left_join_unique(left, right, ["k"], null_safe=True)
    spread = align.left_join_unique(left, right, ["k"], null_safe=True, hot=hot)
    assert rows(spread.select("k", "id", "n")) == rows(plain.select("k", "id", "n"))
    assert spread.filter("n is null").isEmpty()


def test_hot_keys_need_many_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert align.hot_keys(df, ["k"]) is None
    assert rows(align.hot_keys(df, ["k"], rows_per_task=100)) == [(0, 4)]


def test_a_key_of_many_tasks_is_cut_into_as_many(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 5000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.col("k") + 1)
    hot = align.hot_keys(left, ["k"], rows_per_task=100)
    assert rows(hot) == [(0, 50)]
    assert rows(align.left_join_unique(left, right, ["k"], hot=hot).select("k", "id", "v")) == rows(left.withColumn("v", F.col("k") + 1))


def test_newest_rows_of_a_period_are_filtered_in_the_scan(spark):
    from panelspark.session import scratch_dir
    path = scratch_dir(spark, "t")
    spark.createDataFrame([(1, datetime(2024, 1, 1), 0, 1.0)], "k int, t timestamp_ntz, b int, v double").write.parquet(path)
    current = upsert.newest_by_key(spark.read.parquet(path), ["k", "t"], ["b"])
    cut = align.lookback(current, "t", (datetime(2024, 1, 1), datetime(2024, 1, 2)))
    assert "GreaterThanOrEqual(t" in cut._jdf.queryExecution().executedPlan().toString()
    assert cut.count() == 1


def test_lags_of_all_columns_take_one_shuffle(spark):
    from panelspark.operators import lags as L
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value", "event_id")
    plan = L.exact_lag(df, ["user_id"], "ts", ["value", "event_id"], list(range(2, 15)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Window [") == 1


def test_rounding_by_units_equals_the_decimal_one(spark):
    from panelspark.catalog.queries import exact_round

    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 0.0005, -1.0005, 2.675, 1e12 + 0.0005, -1e-20, 0.4999995, 123456.7895, 1.0000005, 5e-324]
    some = [(i - 5000) * 7919.0 / d for i in range(10000) for d in (1e3, 2e4, 3e6, 2e6)]
    df = spark.createDataFrame([(v,) for v in [*odd, *some]], "x double")
    for digits in (3, 4, 6):
        both = df.selectExpr("x", f"round(x, {digits}) AS a", f"{exact_round('x', digits)} AS b")
        assert both.filter("CAST(a AS STRING) IS DISTINCT FROM CAST(b AS STRING)").count() == 0
