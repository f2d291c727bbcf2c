"""Grouped statistics, leave-one-key-out statistics, ranks and running totals."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.align import hot_keys, left_join_unique
from panelspark.session import land

STATISTICS = {"avg": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}


def stat_columns(col: str, label: str, stats=tuple(STATISTICS)) -> list[Column]:
    """``avg_<label>, sum_<label>, ...`` of ``col``; std of a single value is null."""
    return [F.expr(f"{STATISTICS[s]}(`{col}`) AS `{s}_{label}`") for s in stats]


def stats(df: DataFrame, keys: list[str], col: str, label: str, stats=tuple(STATISTICS)) -> DataFrame:
    return df.groupBy(*keys).agg(*stat_columns(col, label, stats))


def mean_as(df: DataFrame, keys: list[str], cols: dict[str, str | None], suffix: str = "_mean") -> DataFrame:
    """Mean of each column; a named type truncates the mean to it."""
    return df.groupBy(*keys).agg(*[
        (F.avg(c) if kind is None else F.avg(c).cast(kind)).alias(f"{c}{suffix}")
        for c, kind in cols.items()
    ])


def marginals(df: DataFrame, keys: list[str], time: str, col: str) -> dict[str, DataFrame]:
    """Statistics over each key in turn, at every combination of the others.

    ``result["county"]`` has one row per remaining keys and ``time``, with
    columns ``avg_county_target`` and so on. The four are separate groupings:
    each reduces its rows before the shuffle, and each arrives at its join
    already partitioned on that join's keys.
    """
    return {
        key: stats(df, [*[k for k in keys if k != key], time], col, f"{key}_{col}") for key in keys
    }


def marginal_stats(df: DataFrame, keys: list[str], time: str, col: str) -> DataFrame:
    """All leave-one-key-out statistics stacked in one pass over the rows;
    ``over_key`` names the key left out, which is null in that row."""
    sets = [[F.col(k) for k in keys if k != out] + [F.col(time)] for out in keys]
    # grouping_id() has a 1 bit for each grouping column that a set leaves out
    bit = {out: 1 << (len(keys) - i) for i, out in enumerate(keys)}
    over = F.lit(None).cast("string")
    grouped = df.groupingSets(sets, *[F.col(k) for k in keys], F.col(time)).agg(
        F.grouping_id().alias("__gid"), *stat_columns(col, col)
    )
    for out in keys:
        over = F.when(F.col("__gid") == bit[out], F.lit(out)).otherwise(over)
    return grouped.select(over.alias("over_key"), *keys, time, *[f"{s}_{col}" for s in STATISTICS])


def window_mean(df: DataFrame, keys: list[str], means: dict[str, Column]) -> DataFrame:
    """Each row with the mean over its group, by aggregate and join back.

    A window would bring every row of a group into one task; here the groups
    are reduced before the shuffle and only their means travel back.
    """
    means_by_key = df.groupBy(*keys).agg(*[c.alias(name) for name, c in means.items()])
    return left_join_unique(df, means_by_key, keys, null_safe=True, hot=hot_keys(df, keys))


def row_index(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """0-based position inside the group. Groups must be bounded, as the hours
    of one station and day are once duplicates are gone."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window) - 1)


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Cumulative sum of ``value`` in the order of ``order``, whose values are distinct.

    Rows are cut into ranges of the order, one a task. Each range sums on its own
    and starts from the total of the ranges before it.
    """
    ranged = df.repartitionByRange(order).withColumn("__bucket", F.spark_partition_id())
    # written out, so that every use sees the same ranges
    ranged = land(ranged, df.sparkSession, "ranges")
    totals = ranged.groupBy("__bucket").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__bucket", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # starts has one row per shuffle partition
    return (
        ranged.join(F.broadcast(starts), "__bucket")
        .withColumn(out, F.col("__start") + F.sum(value).over(inside))
        .drop("__bucket", "__start")
    )


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ascending rank from 1; equal values share the mean of their ranks.

    Values are counted first, so ties never meet in one task as rows.
    """
    counted = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("__n"))
    ranked = running_total(counted, col, "__n", "__upto").select(
        col, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out)
    )
    return left_join_unique(df, ranked, [col], hot=hot_keys(df, [col]))
