import math
import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from panelspark.operators import lags as L

T0 = datetime(2024, 1, 1)


def panel(spark, seed=1, days=9):
    """Two full series, one that starts late, gaps, and missing targets."""
    rng = random.Random(seed)
    out = []
    for key, first in ((1, 0), (2, 0), (3, 100)):
        for h in range(first, days * 24):
            if rng.random() < 0.05:
                continue
            value = None if rng.random() < 0.05 else float(rng.randrange(100))
            out.append((key, T0 + timedelta(hours=h), value))
    return spark.createDataFrame(out, "k int, t timestamp_ntz, v double"), out


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_exact_lag_against_brute_force(spark, blocks):
    df, data = panel(spark)
    at = {(k, t): v for k, t, v in data}
    got = rows(L.exact_lag(df, ["k"], "t", ["v"], [1, 2, 3], blocks=blocks))
    want = sorted(
        ((k, t, v, *[at.get((k, t - timedelta(days=d))) for d in (1, 2, 3)]) for k, t, v in data), key=repr
    )
    assert got == want


def test_one_very_long_series(spark):
    """A series much longer than a block is cut, and nothing is lost at the cuts."""
    df = spark.range(24 * 400).select(
        F.lit(1).alias("k"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("t"),
        F.col("id").cast("double").alias("v"),
    )
    out = L.exact_lag(df, ["k"], "t", ["v"], [2, 14])
    wrong = out.filter(
        (F.coalesce(F.col("v_lag_2"), F.lit(-1.0)) != F.when(F.col("v") >= 48, F.col("v") - 48).otherwise(-1.0))
        | (F.coalesce(F.col("v_lag_14"), F.lit(-1.0)) != F.when(F.col("v") >= 336, F.col("v") - 336).otherwise(-1.0))
    )
    assert out.count() == 24 * 400
    assert wrong.count() == 0


def test_lags_for_future_rows_match_the_fanout(spark):
    df, data = panel(spark)
    future = df.select("k", (F.col("t") + F.make_dt_interval(F.lit(2))).alias("t")).withColumn("id", F.lit(7))
    got = L.exact_lag(df, ["k"], "t", ["v"], [2, 3], at=future).drop("id")
    fan = L.exact_lag_fanout(df, ["k"], "t", ["v"], [2, 3])
    want = future.drop("id").join(fan, ["k", "t"], "left")
    assert rows(got) == rows(want.select(got.columns))


def test_daily_lags(spark):
    df = spark.createDataFrame(
        [(1, date(2023, 12, 30), 5.0), (1, date(2024, 1, 1), 7.0), (1, date(2024, 1, 2), 9.0)], "k int, d date, v double"
    )
    got = rows(L.exact_lag(df, ["k"], "d", ["v"], [1, 2, 3], unit="day"))
    assert got == sorted([
        (1, date(2023, 12, 30), 5.0, None, None, None),
        (1, date(2024, 1, 1), 7.0, None, 5.0, None),
        (1, date(2024, 1, 2), 9.0, 7.0, None, 5.0),
    ], key=repr)


def test_session_time_zone_does_not_move_lags(spark):
    """Over a clock change in the session zone a day is still 24 hours."""
    df = spark.createDataFrame(
        [(1, datetime(2024, 3, 30, 3), 1.0), (1, datetime(2024, 3, 31, 3), 2.0), (1, datetime(2024, 4, 1, 3), 3.0)],
        "k int, t timestamp_ntz, v double",
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/Tallinn")
    try:
        got = [r["v_lag_1"] for r in L.exact_lag(df, ["k"], "t", ["v"], [1]).orderBy("t").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [None, 1.0, 2.0]


def test_lag_zero_is_refused(spark):
    with pytest.raises(ValueError):
        L.exact_lag(panel(spark)[0], ["k"], "t", ["v"], [0])


def test_dense_panel_has_every_hour_and_no_join(spark):
    df = panel(spark)[0]
    dense = L.dense_panel(df, ["k"], "t", F.lit(T0), F.lit(T0 + timedelta(hours=5)), pad_days=1)
    assert dense.count() == 3 * (6 + 48)
    assert "Join" not in dense._jdf.queryExecution().toString()


def test_list_statistics(spark):
    names = [f"target_lag_{d}" for d in range(2, 8)]
    df = spark.createDataFrame([(5.0, 9.0, 1.0, 9.0, 1.0, 20.0)], names)
    out = L.lag_ratios(L.lag_list_stats(L.lag_diffs(L.logged_lags(df, 7), 7), 7)).first()
    assert out["target_argmax_all_lag"] == 5 and out["target_argmax_all_lag_2_4"] == 1
    assert out["target_argmin_all_lag"] == 2 and out["target_argmin_all_lag_2_4"] == 2
    assert out["target_sum_all_lag"] == 45.0 and out["target_sum_all_lag_2_4"] == 24.0
    assert out["target_mean_all_lag_2_4"] == 6.0
    assert out["target_mean_shift_all_lag"] == pytest.approx((5 - 20) / 5)
    assert out["target_mean_shift_all_lag_2_4"] == pytest.approx((5 - 1) / 4)
    assert out["target_log1p_mean_shift_all_lag"] == pytest.approx((math.log1p(5) - math.log1p(20)) / 5)
    assert out["target_lag_2_vs_min_all"] == 2.5
    assert out["target_lag_2_vs_sum_all_2_4"] == pytest.approx(5 / 25)


def test_zero_denominator_gives_null(spark):
    df = spark.createDataFrame([(-1.0, -1.0, -1.0)], ["target_lag_2", "target_lag_3", "target_lag_4"])
    out = L.lag_ratios(L.lag_list_stats(L.lag_diffs(L.logged_lags(df, 4), 4), 4)).first()
    assert out["target_lag_2_vs_mean_all"] is None
    assert out["target_lag_2_vs_sum_all"] == pytest.approx(0.5)


def test_instants_match_to_the_microsecond(spark):
    from datetime import datetime, timedelta
    from panelspark.operators import lags as L
    at = datetime(2024, 1, 5, 0, 0, 0, 250_000)
    df = spark.createDataFrame(
        [("a", at, 1.0), ("a", at + timedelta(days=2), 2.0), ("a", at + timedelta(days=2, microseconds=1), 3.0), ("a", at + timedelta(days=2, microseconds=650_000), 4.0)],
        "k string, t timestamp_ntz, v double",
    )
    got = {r["v"]: r["v_lag_2"] for r in L.exact_lag(df, ["k"], "t", ["v"], [2]).collect()}
    assert got == {1.0: None, 2.0: 1.0, 3.0: None, 4.0: None}
