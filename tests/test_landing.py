"""Text read once, joins guarded by the run itself, and both ways to the same statistics."""

import os
from datetime import datetime

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from panelspark.catalog import views as V
from panelspark.operators import align, pivot
from panelspark.plans import build
from panelspark.plans import features as P
from panelspark.session import scratch_dir
from panelspark.sources import landing
from panelspark.sources import tables as io
from panelspark.sources.schema import table_schema

SCHEMA = table_schema(k="short", at="timestamp", x="double", n="long")


def csv(spark, lines, name="t.csv"):
    folder = scratch_dir(spark, "csv")
    os.makedirs(folder)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(["extra,n,at,k,x", *lines]) + "\n")
    return f"{folder}/{name}"


LINES = [
    "a,9007199254740993,2024-01-31 23:00:00,1,0.5",
    "b,3.0,2024-02-01 00:00:00,-2.0,",
    ",,,,",
    "c,1.5,2024-02-01 00:00:00,1,1",       # a fraction
    "d,1,2024-02-01 00:00:00,40000,1",     # beyond the type
    "e,1,yesterday,1,1",                   # no time
    "f,1,2024-02-01 00:00:00,1,much",      # no number
]


def test_typed_scan_keeps_what_does_not_fit(spark):
    read = landing.read_typed(spark, csv(spark, LINES), SCHEMA)
    good = read.filter(F.col(landing.BAD).isNull()).drop(landing.BAD)
    assert good.schema == SCHEMA
    assert rows(good) == sorted([
        (1, datetime(2024, 1, 31, 23), 0.5, 9007199254740993), (-2, datetime(2024, 2, 1), None, 3), (None, None, None, None),
    ], key=repr)
    assert sorted(r[0][0] for r in read.filter(F.col(landing.BAD).isNotNull()).select(landing.BAD).collect()) == ["c", "d", "e", "f"]


def test_a_missing_column_raises(spark):
    with pytest.raises(ValueError, match="no columns"):
        landing.read_typed(spark, csv(spark, LINES), table_schema(k="short", z="int"))


def test_a_file_is_parsed_once_until_it_changes(spark, monkeypatch):
    path, folder, parsed = csv(spark, LINES), scratch_dir(spark, "landed"), []
    real = landing.read_typed
    monkeypatch.setattr(landing, "read_typed", lambda *a: parsed.append(1) or real(*a))
    for _ in range(3):
        good, bad = landing.landed(spark, "t", path, folder, SCHEMA, "at")
        assert (good.count(), bad.count()) == (3, 4)
    assert len(parsed) == 1
    assert sorted({f.split("month=")[1][:7] for f in good.inputFiles()}) >= ["2024-01", "2024-02"]
    with open(path, "a") as f:
        f.write("g,7,2024-03-01 00:00:00,1,1\n")
    good, bad = landing.landed(spark, "t", path, folder, SCHEMA, "at")
    assert (good.count(), len(parsed)) == (4, 2)


def test_bad_records_of_a_declared_table_raise(spark):
    folder = scratch_dir(spark, "csv")
    os.makedirs(folder)
    with open(f"{folder}/gas_prices.csv", "w") as f:
        f.write("forecast_date,lowest_price_per_mwh,highest_price_per_mwh\n2024-01-01,1.5,2.5\n2024-01-02,low,3\n")
    with pytest.raises(ValueError, match="gas"):
        io.read_table(spark, "gas", f"{folder}/gas_prices.csv", scratch_dir(spark, "landed"))
    with open(f"{folder}/gas_prices.csv", "w") as f:
        f.write("forecast_date,lowest_price_per_mwh,highest_price_per_mwh\n2024-01-01,1.5,2.5\n")
    got = io.read_tables(spark, folder, ("gas",), scratch_dir(spark, "landed"))["gas"]
    assert rows(got) == [(datetime(2024, 1, 1), 1.5, 2.5)]


# ---------------------------------------------------------------- fan-out within the run

WEATHER = {"forecast_variables": V.FORECAST_COLUMNS, "history_variables": V.HISTORY_COLUMNS}


@pytest.mark.parametrize("repeated", [None, "gas"])
def test_multiplied_rows_are_noticed_after_the_write(spark, monkeypatch, repeated):
    tables = V.all_tables(spark, SF)
    if repeated:
        tables[repeated] = tables[repeated].unionByName(tables[repeated].limit(1))
    checked = []
    real = align.assert_unique
    monkeypatch.setattr(align, "assert_unique", lambda *a: checked.append(a[2]) or real(*a))
    monkeypatch.setattr(build, "assert_unique", lambda *a: pytest.fail("a job before the write"))
    guard = build.guarded(tables)
    table = build.training_table(tables, 3, 2, 3, guard=guard, **WEATHER)
    path = scratch_dir(spark, "guarded")
    if repeated is None:
        io.write_features(table, path, guard=guard)
        n = tables["train"].count()
        assert guard.counts == (n, n) and io.read_features(spark, path).count() == n and checked == []
    else:
        with pytest.raises(ValueError, match="gas"):
            io.write_features(table, path, guard=guard)
        assert guard.counts[1] > guard.counts[0] and not os.path.exists(path)


# ---------------------------------------------------------------- statistics

def test_crowded_instants_give_the_same_statistics(spark, monkeypatch):
    panel = V.panel(spark, SF)
    windowed = P.with_marginals(panel)
    assert "Join" not in windowed._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[0]
    monkeypatch.setattr(P, "hot_keys", lambda df, on, total=None: align.hot_keys(df, on, rows_per_task=6))
    joined = P.with_marginals(panel).select(*windowed.columns)

    def near(df):
        return df.selectExpr(*[f"round({c}, 6) AS {c}" if k == "double" else c for c, k in df.dtypes])

    assert near(windowed).exceptAll(near(joined)).isEmpty() and near(joined).exceptAll(near(windowed)).isEmpty()


def test_the_panel_moves_at_most_three_times(spark):
    from panelspark.session import land
    panel = land(V.panel(spark, SF), spark, "panel")
    plan = P.target_features(panel, 14)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan


def test_packed_statistics_open_to_the_pivot(spark):
    df = spark.createDataFrame([(1, 22, 1.0), (1, 22, 3.0), (1, 24, 5.0), (2, None, 7.0), (3, 23, None)], "k int, h int, a double")
    packed = pivot.pack_stats(df, ["k"], "h", ["a"], types={"a": "int"})
    assert {r["k"]: {h: tuple(s) for h, s in r[pivot.PACKED].items()} for r in packed.collect()} == {
        1: {22: (2, 1, 3, 1), 24: (5, 5, 5, None)}, 2: {}, 3: {23: (None, None, None, None)},
    }
    wide = pivot.pivot_stats(df, ["k"], "h", [22, 23], ["a"])
    assert wide.columns == ["k", *[f"a_hours_ahead_{h}{s}" for s in ("", "_min", "_max", "_std") for h in (22, 23)]]
    assert {r["k"]: (r["a_hours_ahead_22"], r["a_hours_ahead_23"]) for r in wide.collect()} == {1: (2.0, None), 2: (None, None), 3: (None, None)}
