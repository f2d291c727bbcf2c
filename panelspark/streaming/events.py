"""Event streams with bounded state: repeats dropped and hours rolled up under a watermark.

Both keep state for as long as ``delay`` says and no longer, whatever the stream's
length. Times without a zone are read as UTC for the watermark and returned as they were.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TIME, _HOUR, _ROWS = "__event_time", "__hour", "n_events"


def _watched(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """The stream with a zoned copy of its time under a watermark ``delay`` behind the latest."""
    return stream.withColumn(_TIME, F.col(time).cast("timestamp")).withWatermark(_TIME, delay)


def dedupe_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first arrival of each key.

    A key is remembered at least until the watermark has passed its first arrival's time
    by ``delay``, and a repeat that arrives until then is dropped. It is forgotten at the
    end of the first micro-batch that starts with such a watermark; what arrives after
    that counts as new. Rows older than the watermark of the micro-batch before are dropped.
    """
    return _watched(stream, time, delay).dropDuplicatesWithinWatermark(keys).drop(_TIME)


def hourly_panel(stream: DataFrame, keys: list[str], time: str, values: dict[str, Column], delay: str) -> DataFrame:
    """One row for each series and hour with events: ``keys``, ``datetime``, ``n_events`` and ``values``.

    For append mode: an hour appears once the watermark has passed its end, with all
    events that arrived until then. Events of an hour that was over for the micro-batch
    before are dropped; see ``late_rows``.
    """
    rolled = _watched(stream, time, delay).groupBy(F.window(_TIME, "1 hour").alias(_HOUR), *keys).agg(
        F.count(F.lit(1)).alias(_ROWS), *[value.alias(name) for name, value in values.items()]
    )
    hour = F.col(f"{_HOUR}.start").cast("timestamp_ntz").alias("datetime")
    return rolled.select(*keys, hour, _ROWS, *values)


def open_rows(spark: SparkSession, checkpoint: str) -> int:
    """Events in hours that an ``hourly_panel`` has not yet given out, read from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).load()
    # the count is the first thing the roll-up keeps of an hour
    counted = state.schema["value"].dataType.fieldNames()[0]
    return state.agg(F.sum(F.col("value").getField(counted))).first()[0] or 0


def late_rows(spark: SparkSession, arrived: int, panel: DataFrame, checkpoint: str) -> int:
    """Events dropped for lateness: those that arrived but are neither in ``panel`` nor in an open hour.

    Spark's own counter sees late rows after they are partly aggregated and so counts too few.
    """
    given = panel.agg(F.sum(_ROWS)).first()[0] or 0
    return arrived - given - open_rows(spark, checkpoint)
