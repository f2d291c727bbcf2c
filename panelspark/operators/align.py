"""Publication delays, bounded look-back, and joins that add columns to rows.

Left joins here promise to keep the row count: the right side holds at most one
row per key. Which physical join runs is left to the optimizer, which knows the
measured size of each side; a join key that holds a large share of the rows is
spread over several tasks first.
"""

import threading
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_SALT = "__salt"
_SALTS = "__salts"


def publish_shift(df: DataFrame, col: str, days: int, out: str, to_date: bool = False) -> DataFrame:
    """``out`` = ``col`` plus whole days, the moment the row becomes usable."""
    moved = F.col(col) + F.make_dt_interval(F.lit(days))
    return df.withColumn(out, moved.cast("date") if to_date else moved)


def publish_shift_by_hour(
    df: DataFrame, col: str, out: str, cutoff: int = 11, before: int = 1, after: int = 2
) -> DataFrame:
    """Date of use: ``before`` days later for hours under ``cutoff``, else ``after``."""
    days = F.when(F.hour(col) < cutoff, F.lit(before)).otherwise(F.lit(after))
    return df.withColumn(out, F.date_add(F.to_date(col), days))


def to_day(col: Column) -> Column:
    return F.to_date(col)


def bounds(df: DataFrame, col: str) -> tuple:
    """Smallest and largest value, as two scalars on the driver."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return row["lo"], row["hi"]


def lookback_bounds(rows: DataFrame, col: str, n_lags: int, margin: int = 31) -> tuple:
    """The time range that rows to score can possibly need."""
    lo, hi = bounds(rows, col)
    if lo is None:
        return None
    reach = timedelta(days=n_lags + margin)
    return lo - reach, hi + reach


def lookback(df: DataFrame, col: str, limits: tuple | None) -> DataFrame:
    """Rows inside the range, both ends included. The limits are literals, so
    the filter reaches the scan; without limits nothing can be needed."""
    if limits is None:
        return df.filter(F.lit(False))
    lo, hi = (F.lit(v).cast("timestamp_ntz") for v in limits)
    if dict(df.dtypes)[col] == "date":
        # a day counts from its midnight: the first whole day at or after lo
        first = F.when(lo == F.date_trunc("day", lo).cast("timestamp_ntz"), F.to_date(lo)).otherwise(
            F.date_add(F.to_date(lo), 1)
        )
        return df.filter(F.col(col).between(first, F.to_date(hi)))
    return df.filter(F.col(col).between(lo, hi))


def since(df: DataFrame, col: str, start: str = "2022-01-01 00:00:00") -> DataFrame:
    return df.filter(F.col(col) >= F.lit(start).cast("timestamp_ntz"))


def coordinate_key(col: Column, scale: int = 1_000) -> Column:
    """Whole-number key of a coordinate, equal for 57.6 in either float width."""
    return F.round(col * scale).cast("int")


def station_to_county(df: DataFrame, stations: DataFrame) -> DataFrame:
    """Add ``county`` by coordinates; rows of unmapped stations are dropped."""
    mapped = stations.filter(F.col("county").isNotNull()).select(
        coordinate_key(F.col("latitude")).alias("__lat"),
        coordinate_key(F.col("longitude")).alias("__lon"),
        "county",
    )
    keyed = df.select(
        "*",
        coordinate_key(F.col("latitude")).alias("__lat"),
        coordinate_key(F.col("longitude")).alias("__lon"),
    )
    return keyed.join(mapped, ["__lat", "__lon"]).drop("__lat", "__lon")


def hot_keys(df: DataFrame, on: list[str], rows_per_task: int = 1_000_000, total: int | None = None) -> DataFrame | None:
    """Keys that hold more than ``rows_per_task`` rows, and over how many tasks to spread each.

    There is at most one such key for every ``rows_per_task`` rows of ``df``.
    ``total`` is its number of rows, if known; none can be hot if it is no larger.
    """
    if (df.count() if total is None else total) <= rows_per_task:
        return None
    counts = df.groupBy(*on).agg(F.count("*").alias("__count")).filter(F.col("__count") > rows_per_task)
    return counts.select(*on, F.ceil(F.col("__count") / rows_per_task).cast("int").alias(_SALTS))


def fits_broadcast(df: DataFrame, max_bytes: int = 128 << 20, unjudged: int | None = None) -> bool:
    """Whether the rows of ``df``, counted now, stay under ``max_bytes`` in memory.

    Meant for a table just written, where counting reads file footers only. ``unjudged``
    is the size of its columns of open length in a row; a table that has such columns
    does not fit where it is not given.
    """
    sizes = {"double": 8, "bigint": 8, "timestamp_ntz": 8, "timestamp": 8, "int": 8, "smallint": 8,
             "tinyint": 8, "float": 8, "date": 8, "boolean": 8}
    # rows are held in 8-byte words; anything of open length is not judged here
    open_length = any(kind not in sizes for _, kind in df.dtypes)
    if open_length and unjudged is None:
        return False
    per_row = 16 + sum(sizes.get(kind, 0) for _, kind in df.dtypes) + len(df.columns) // 8 + (unjudged or 0)
    return df.count() * per_row <= max_bytes


def left_join_unique(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    null_safe: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join to a side with at most one row per key, keeping the row count.

    ``hot`` (from ``hot_keys``) lists keys too frequent for one task: their left
    rows are spread over as many tasks as it says, their right row copied to each.
    """
    if hot is not None:
        hot = F.broadcast(hot)  # a row for every rows_per_task rows at most
        salts = F.coalesce(F.col(_SALTS), F.lit(1))
        left = _left_join(left, hot, on, null_safe).select(
            *left.columns, F.pmod(F.xxhash64(*left.columns), salts).cast("int").alias(_SALT)
        )
        right = _left_join(right, hot, on, null_safe).select(
            *right.columns, F.explode(F.sequence(F.lit(0), salts - 1)).alias(_SALT)
        )
        return _left_join(left, right, [*on, _SALT], null_safe).drop(_SALT)
    return _left_join(left, right, on, null_safe)


def left_join_placed(left: DataFrame, right: DataFrame, placed: list[str], day: str) -> DataFrame:
    """Left join to a side with at most one row per ``placed`` and ``day``, where the rows of
    ``left`` are partitioned by ``placed`` already: they stay where they are, in their order.

    ``placed`` alone are the keys of a hash join, whose table holds one partition of
    ``right``; ``day`` is compared row by row, so a value of ``placed`` must have few days.
    """
    names = {k: f"__r_{k}" for k in [*placed, day]}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns]).hint("shuffle_hash")
    # an equality of two columns would become a key
    match = [*[F.col(k) == F.col(names[k]) for k in placed], F.datediff(F.col(day), F.col(names[day])) == 0]
    return left.join(renamed, match, "left").drop(*names.values())


def _left_join(left: DataFrame, right: DataFrame, on: list[str], null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, on, "left")
    names = {k: f"__r_{k}" for k in on}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    match = [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()]
    return left.join(renamed, match, "left").drop(*names.values())


def duplicate_keys(df: DataFrame, on: list[str]) -> DataFrame:
    """Keys with more than one row, which would multiply rows in a left join."""
    return df.groupBy(*on).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


class FanoutGuard:
    """Counts rows before and after a chain of joins while the result is written, without a job of its own.

    ``sides`` are the joined tables with the keys that must be unique in each. After the
    write, ``check`` compares the two counts. Only if they differ are the sides looked
    through, and one that has a key twice is an error; tasks that ran twice may count
    rows twice, which is none. A guard serves one write.

    Spark never delivers a count whose part of the plan it dropped while it ran, as
    when the other side of a join turns out empty, or that another session wrote. So
    ``check`` waits ``WAIT`` seconds for the counts, and then looks through the sides.
    """

    WAIT = 60

    def __init__(self, sides: dict[str, tuple[DataFrame, list[str]]]):
        self.sides = sides
        self._in, self._out = Observation(), Observation()

    def enter(self, df: DataFrame) -> DataFrame:
        return df.observe(self._in, F.count(F.lit(1)).alias("rows"))

    def leave(self, df: DataFrame) -> DataFrame:
        return df.observe(self._out, F.count(F.lit(1)).alias("rows"))

    @property
    def counts(self) -> tuple[int, int]:
        return self._in.get["rows"], self._out.get["rows"]

    def check(self) -> None:
        found = []
        waiting = threading.Thread(target=lambda: found.append(self.counts), daemon=True)
        waiting.start()
        waiting.join(self.WAIT)
        self.compare(*(found[0] if found else (None, 0)))

    def compare(self, before: int | None, after: int) -> None:
        """Look through the sides if the numbers of rows differ."""
        if before != after:
            for name, (df, on) in self.sides.items():
                assert_unique(df, on, name)


def assert_unique(df: DataFrame, on: list[str], name: str) -> None:
    if not duplicate_keys(df, on).isEmpty():
        raise ValueError(f"{name} has more than one row for some {on}")
