"""Exact-offset lags over a panel, and the statistics built on them.

A lag is looked up by instant, never by row position: the value of a series
``d`` days before ``t`` is the value of the row at exactly ``t - d`` days, and
null when there is none. All lags of all columns come out of one shuffle. The
time axis is cut into blocks a few times longer than the longest lag, and rows
near the end of a block are copied into the next one, so a task never holds
more than one block of one series however long that series is.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
BLOCK = "__block"
NEAR_TASKS = 3
_TICK = "__tick"
_ROW = "__answer"
_VALUES = "__values"


def clock_micros(time: Column) -> Column:
    """Microseconds on the wall clock since 1970-01-01; no time zone is involved."""
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.date_part(F.lit("SECOND"), time) * 1_000_000).cast("long")
    return days * DAY_MICROS + (F.hour(time) * 60 + F.minute(time)).cast("long") * 60_000_000 + second


def day_block(date: Column, offsets: list[int], blocks: int = 4) -> Column:
    """The block of ``lag_structs`` (``unit`` hour) that a day's rows are in."""
    days = F.datediff(date, F.lit("1970-01-01").cast("date"))
    return F.floor(days / F.lit(blocks * max(offsets))).cast("long")


def _ticks(time: str, unit: str) -> Column:
    if unit == "day":
        return F.datediff(F.col(time), F.lit("1970-01-01").cast("date")).cast("long")
    return clock_micros(F.col(time))


def _step(unit: str) -> int:
    return 1 if unit == "day" else DAY_MICROS


def exact_lag(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    offsets: list[int],
    unit: str = "hour",
    at: DataFrame | None = None,
    name: str = "{col}_lag_{d}",
    blocks: int = 4,
) -> DataFrame:
    """Add ``cols`` as they were ``d`` days earlier, for each ``d`` in ``offsets``.

    ``unit`` is the grain of ``time``: ``"hour"`` for timestamps, ``"day"`` for
    dates; offsets are days either way. By default the rows of ``df`` get the
    lags. With ``at`` the rows of ``at`` (which may lie in the future) get them
    instead, keep all their columns and ``df`` only supplies values. If an
    instant occurs twice in a series the row with the greater values is used.
    """
    own = (df if at is None else at).columns
    found = lag_structs(df, keys, time, cols, offsets, unit, at, blocks)
    return found.selectExpr(
        *quoted(own),
        *[f"{lagged(d, c)} AS `{name.format(col=c, d=d)}`" for d in offsets for c in cols],
    )


def quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def lagged(d: int, col: str) -> str:
    """SQL for one value of the row ``d`` days earlier, out of ``lag_structs``.

    Tables of hundreds of columns are written as SQL expressions throughout:
    a select then reaches the JVM as one call instead of thousands.
    """
    return f"`__lag_{d}`.`{col}`"


def lag_structs(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    offsets: list[int],
    unit: str = "hour",
    at: DataFrame | None = None,
    blocks: int = 4,
    daily: dict[str, str] | None = None,
    near: list[str] | None = None,
) -> DataFrame:
    """``exact_lag`` with the columns of each earlier row still packed together,
    as ``__lag_<d>``: cheaper to carry until they are needed one by one.

    ``daily`` names SQL aggregates over each series' rows of a day (``unit`` hour).
    They are looked up like ``cols``, and worked out after the shuffle: a block is
    made of whole days, and a day's rows are copied together.

    With ``near``, some of ``keys``, the result is partitioned by these and its column
    ``BLOCK``, which then stays: a table of one row per these keys and day can be joined
    without moving the rows again (``left_join_placed``). A task holds all series of
    such a key's block, so those must not be too many.
    """
    daily = daily or {}
    placing = [F.col(c) for c in [*(near or keys), BLOCK]]
    if near:
        # fewer and larger keys deal evenly only over more tasks
        placing = [NEAR_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *placing]
    longest = max(offsets) * _step(unit)
    shortest = min(offsets) * _step(unit)
    if shortest <= 0:
        raise ValueError("offsets must be positive")
    length = blocks * longest

    tick = _ticks(time, unit)

    def block(t: Column) -> Column:
        return F.floor(t / F.lit(length)).cast("long")

    if at is None:
        carried = [c for c in df.columns]
        source = df.select("*", tick.alias(_TICK)).select(
            "*", F.explode(F.sequence(block(F.col(_TICK)), block(F.col(_TICK) + longest))).alias(BLOCK)
        )
        rows = source.withColumn(_ROW, F.col(BLOCK) == block(F.col(_TICK)))
    else:
        carried = [c for c in at.columns]
        values = [F.col(c).alias(f"__v_{c}") for c in cols]
        history = df.select(*keys, tick.alias(_TICK), *values).select(
            "*",
            F.explode(
                F.sequence(block(F.col(_TICK) + shortest), block(F.col(_TICK) + longest))
            ).alias(BLOCK),
            F.lit(False).alias(_ROW),
        )
        asked = at.select("*", tick.alias(_TICK)).select(
            "*", block(F.col(_TICK)).alias(BLOCK), F.lit(True).alias(_ROW)
        )
        rows = history.unionByName(asked, allowMissingColumns=True)

    # rows of ``at`` have no values of their own
    held = [c if at is None else f"__v_{c}" for c in cols]
    by_block = quoted([*keys, BLOCK])
    if daily:
        # one exchange for the days and the lags
        day = f"PARTITION BY {', '.join(by_block)}, {_TICK} DIV {_step(unit)}"
        source = {c: f"`{h}`" for c, h in zip(cols, held)}
        rows = rows.repartition(*placing).selectExpr(
            "*", *[f"{sql.format(**source)} OVER ({day}) AS `{name}`" for name, sql in daily.items()]
        )
    packed = "named_struct(" + ", ".join(f"'{c}', `{h}`" for c, h in zip([*cols, *daily], [*held, *daily])) + ")"
    if at is not None:
        packed = f"IF({_ROW}, NULL, {packed})"
    # of rows at one instant the greatest comes first; the window takes this order as it is
    placed = rows if daily else rows.repartition(*placing)
    placed = placed.selectExpr("*", f"{packed} AS {_VALUES}").sortWithinPartitions(
        *keys, BLOCK, _TICK, F.col(_VALUES).desc_nulls_last()
    )
    over = f"PARTITION BY {', '.join(by_block)} ORDER BY {_TICK}"
    return placed.selectExpr(
        *quoted([*carried, BLOCK] if near else carried),
        _ROW,
        *[
            f"first({_VALUES}) OVER ({over} RANGE BETWEEN {d * _step(unit)} PRECEDING"
            f" AND {d * _step(unit)} PRECEDING) AS __lag_{d}"
            for d in offsets
        ],
    ).filter(_ROW).drop(_ROW)


def exact_lag_fanout(
    df: DataFrame,
    keys: list[str],
    time: str,
    cols: list[str],
    offsets: list[int],
    unit: str = "hour",
    name: str = "{col}_lag_{d}",
) -> DataFrame:
    """The same lags for every instant any of them reaches, known or future.

    Each row is sent to the instants it is a lag of and one aggregation gathers
    them, so instants without a row of their own are answered too. It moves
    ``len(offsets)`` copies of the input; group sizes stay at that number.
    """
    shift = "__d"
    moment = F.date_add(F.col(time), F.col(shift)) if unit == "day" else (
        F.col(time) + F.make_dt_interval(F.col(shift))
    )
    sent = (
        df.select(*keys, time, *cols, F.explode(F.array(*[F.lit(d) for d in offsets])).alias(shift))
        .withColumn(time, moment)
    )
    return sent.groupBy(*keys, time).agg(*[
        F.max(F.when(F.col(shift) == d, F.col(c))).alias(name.format(col=c, d=d))
        for d in offsets
        for c in cols
    ])


def spine(lo: Column, hi: Column, step: str = "1 hour", pad_days: int = 0) -> Column:
    """The instants from ``lo`` to ``hi``, widened by ``pad_days`` at both ends."""
    pad = F.make_dt_interval(F.lit(pad_days))
    return F.sequence(lo - pad, hi + pad, F.expr(f"interval {step}"))


def dense_panel(
    series: DataFrame, keys: list[str], time: str, lo, hi, step: str = "1 hour", pad_days: int = 0
) -> DataFrame:
    """One row per distinct series and instant of the spine.

    Each series generates its own instants, so nothing is joined or broadcast.
    """
    instants = spine(F.lit(lo), F.lit(hi), step, pad_days)
    return series.select(*keys).distinct().select(*keys, F.explode(instants).alias(time))


def complete_only(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows in which every one of ``cols`` is present."""
    return df.dropna(how="any", subset=cols)


def lag_diffs(df: DataFrame, n: int, prefixes=("target_lag", "target_log1p_lag")) -> DataFrame:
    """Differences of neighbouring lags, ``lag_d - lag_(d+1)`` for d = 2..n-1."""
    return df.selectExpr(
        "*", *[f"{p}_{d} - {p}_{d + 1} AS {p}_{d}_diff" for p in prefixes for d in range(2, n)]
    )


def _total(cols: list[str]) -> str:
    return f"({' + '.join(cols)})"


def _mean(cols: list[str]) -> str:
    return f"{_total(cols)} / {len(cols)}"


def _extreme(fn: str, cols: list[str]) -> str:
    return f"{fn}({', '.join(cols)})" if len(cols) > 1 else cols[0]


def _first_at(fn: str, cols: list[str]) -> str:
    """0-based position of the first of ``cols`` that is the extreme one."""
    return f"CAST(array_position(array({', '.join(cols)}), {_extreme(fn, cols)}) - 1 AS INT)"


def lag_list_stats(df: DataFrame, n: int) -> DataFrame:
    """Row-wise statistics over the lags and their differences.

    Columns ending in ``_2_4`` use the first four entries of their list. All
    entries of a row must be present (see ``complete_only``).
    """
    lags = [f"target_lag_{d}" for d in range(2, n + 1)]
    diffs = [f"target_lag_{d}_diff" for d in range(2, n)]
    log_diffs = [f"target_log1p_lag_{d}_diff" for d in range(2, n)]
    wanted = {
        "target_log1p_mean_shift": (log_diffs, _mean),
        "target_mean_shift": (diffs, _mean),
        "target_sum": (lags, _total),
        "target_argmax": (lags, lambda cols: _first_at("greatest", cols)),
        "target_argmin": (lags, lambda cols: _first_at("least", cols)),
        "target_mean": (lags, _mean),
        "target_min": (lags, lambda cols: _extreme("least", cols)),
        "target_max": (lags, lambda cols: _extreme("greatest", cols)),
    }
    return df.selectExpr("*", *[
        f"{fn(cols[:first])} AS {name}_all_lag{suffix}"
        for name, (cols, fn) in wanted.items()
        for first, suffix in ((None, ""), (4, "_2_4"))
    ])


def lag_ratios(df: DataFrame) -> DataFrame:
    """The latest lag over one plus each row-wise statistic; null when that is zero."""
    names = {
        "target_lag_2_vs_mean_all": "target_mean_all_lag",
        "target_lag_2_vs_mean_all_lag_2_4": "target_mean_all_lag_2_4",
        "target_lag_2_vs_min_all": "target_min_all_lag",
        "target_lag_2_vs_min_all_lag_2_4": "target_min_all_lag_2_4",
        "target_lag_2_vs_max_all": "target_max_all_lag",
        "target_lag_2_vs_max_all_lag_2_4": "target_max_all_lag_2_4",
        "target_lag_2_vs_sum_all": "target_sum_all_lag",
        "target_lag_2_vs_sum_all_2_4": "target_sum_all_lag_2_4",
    }
    return df.selectExpr(
        "*", *[f"try_divide(target_lag_2, 1 + {stat}) AS {name}" for name, stat in names.items()]
    )


def logged_lags(df: DataFrame, n: int) -> DataFrame:
    """``log1p`` of each target lag."""
    return df.selectExpr(
        "*", *[f"log1p(target_lag_{d}) AS target_log1p_lag_{d}" for d in range(2, n + 1)]
    )
