"""Text files read once, with declared types, and kept as Parquet by month.

A CSV file is parsed in one typed scan: a record that does not fit its table's types is
kept as text in a column of its own and left out of the table, not dropped unseen. What
was read lands in ``<folder>/<table>/<version>/month=2024-01``; a pointer names the
version and what the file was when it was read, so the next reader opens the Parquet,
and a file that changed is read again.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import discard
from panelspark.sources import pointer
from panelspark.sources.schema import SCHEMAS, TABLE_TIME

BAD = "bad_record"
MONTH = "month"
WHOLE = (T.ShortType, T.IntegerType, T.LongType)
# whole numbers may be written as "3.0": read as decimals, they stay exact
_AS_WRITTEN = T.DecimalType(38, 18)


def header(spark: SparkSession, path: str) -> list[str]:
    """Names of the columns of a CSV file, or of the files in a folder, in their order."""
    return spark.read.option("header", True).csv(path).columns


def read_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The declared columns with their types, and the records that do not fit as text in ``bad_record``.

    Columns may stand in any order, and others beside them, which are not looked at.
    Whole numbers may be written with a fraction of zero; any other fraction, and a
    number beyond the type, makes the record a bad one.
    """
    declared = {f.name: f.dataType for f in schema}
    names = header(spark, path)
    missing = [n for n in declared if n not in names]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    written = T.StructType([
        T.StructField(n, _AS_WRITTEN if isinstance(declared.get(n), WHOLE) else declared.get(n, T.StringType())) for n in names
    ] + [T.StructField(BAD, T.StringType())])
    scanned = (
        spark.read.schema(written).option("header", True).option("enforceSchema", False)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(path)
    )
    whole = [n for n, kind in declared.items() if isinstance(kind, WHOLE)]
    broken = F.lit(False)
    for n in whole:
        broken = broken | (F.col(f"`{n}`").isNotNull() & ((F.col(f"`{n}`") % 1 != 0) | F.col(f"`{n}`").try_cast(declared[n]).isNull()))
    bad = F.when(F.col(BAD).isNotNull(), F.col(BAD)).when(
        broken, F.concat_ws(",", *[F.col(f"`{n}`").cast("string") for n in names]))
    return scanned.select(
        *[F.col(f"`{n}`").try_cast(kind).alias(n) if n in whole else F.col(f"`{n}`") for n, kind in declared.items()],
        bad.alias(BAD),
    )


def _month(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("none"))


def landed(spark: SparkSession, name: str, path: str, folder: str, schema: T.StructType | None = None, time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Table ``name`` and its bad records, out of Parquet; the file at ``path`` is parsed if it was not, or has changed.

    ``schema`` and ``time`` are those declared for the table, where they are not given.
    """
    schema = schema or SCHEMAS[name]
    time = time or TABLE_TIME.get(name, "datetime" if "datetime" in schema.fieldNames() else None)
    place = f"{folder}/{name}"
    source = pointer.fingerprint(spark, path)
    found = pointer.latest(spark, f"{place}/versions")
    if found is None or found[1]["source"] != source:
        version = uuid.uuid4().hex
        rows = read_typed(spark, path, schema)
        if time:
            # a month's rows together, so that each gets few files; many are split over tasks
            rows = rows.withColumn(MONTH, _month(F.col(time))).hint("rebalance", MONTH)
            rows.write.partitionBy(MONTH).parquet(f"{place}/{version}")
        else:
            rows.write.parquet(f"{place}/{version}")
        pointer.switch(spark, f"{place}/versions", (found[0] if found else 0) + 1, {"version": version, "source": source})
        if found:
            discard(spark, f"{place}/{found[1]['version']}")
        found = pointer.latest(spark, f"{place}/versions")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(full).parquet(f"{place}/{found[1]['version']}").select(*full.fieldNames())
    good = rows.filter(F.col(BAD).isNull()).drop(BAD)
    return good, rows.filter(F.col(BAD).isNotNull()).select(BAD)
