"""Which rows may have an id of a set, told by a bitmap of bounded size.

Each id of the set marks one of n bits, by its hash. A row whose bit is not marked has
none of the ids for sure; of the others a few are let through wrongly, so an exact join
follows, over far fewer rows. The bitmap has sixteen megabytes at most, however many ids
there are, and may therefore be sent to every task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LARGEST = 1 << 27  # bits
BITS_AN_ID = 64
IN_BUCKET = 1 << 15  # bits that one bitmap of Spark's holds


class Members:
    """The bitmap of the ids in a table of one column, which is counted first."""

    def __init__(self, ids: DataFrame):
        column = F.col(ids.columns[0])
        wanted = max(IN_BUCKET, BITS_AN_ID * ids.count())
        self.bits = min(LARGEST, 1 << (wanted - 1).bit_length())
        self.bitmaps = F.broadcast(
            ids.select(self._bit(column).alias("bit"))
            .select(F.floor(F.col("bit") / IN_BUCKET).alias("bucket"), (F.col("bit") % IN_BUCKET).alias("place"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("marked"))
        )

    def _bit(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    def _joined(self, rows: DataFrame, name: str, how: str) -> DataFrame:
        bit = self._bit(F.col(name))
        place = (bit % IN_BUCKET).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("marked"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
        return rows.join(self.bitmaps, (F.floor(bit / IN_BUCKET) == F.col("bucket")) & marked, how)

    def possible(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows whose column ``name`` may be one of the ids."""
        return self._joined(rows, name, "left_semi")

    def impossible(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows whose column ``name`` is none of the ids."""
        return self._joined(rows, name, "left_anti")
