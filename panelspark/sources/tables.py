"""Reading, conforming and writing the declared tables."""

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators.align import FanoutGuard
from panelspark.operators.upsert import dedupe
from panelspark.session import discard
from panelspark.sources.landing import landed
from panelspark.sources.schema import BATCH_RENAMES, SCHEMAS, TABLE_KEYS

# --- fixed values: file name of each table in a folder of CSV files ---
CSV_FILES = {
    "location": "weather_station_to_county_mapping.csv",
    "client": "client.csv",
    "train": "train.csv",
    "electricity": "electricity_prices.csv",
    "gas": "gas_prices.csv",
    "forecast_weather": "forecast_weather.csv",
    "historical_weather": "historical_weather.csv",
}
# --- end of fixed values ---

OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_MONTHS, ROW_GROUP = 4, 64 << 20  # an open file holds a row group in memory
GATE = "currently_scored"  # marks the rows of a live batch that are to be scored


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header as text columns; ``conform`` gives them types.

    Files may hold more columns than declared, in any order. Unused columns are
    never parsed: the select in ``conform`` prunes them in the scan.
    """
    return spark.read.option("header", True).csv(path)


def read_table(spark: SparkSession, name: str, path: str, landing: str | None = None) -> DataFrame:
    """One declared table from Parquet or CSV, projected and cast.

    ``path`` is a ``.csv`` file, or a Parquet file or folder. With a folder ``landing``
    a CSV file is parsed once and read from there afterwards; a bad record raises.
    """
    if landing and path.endswith(".csv"):
        table, bad = landed(spark, name, path, landing)
        example = bad.first()
        if example is not None:
            raise ValueError(f"{path} has records that do not fit {name}, such as {example[0]!r}")
    else:
        table = conform(read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path), SCHEMAS[name])
    if name == "historical_weather":
        # the published file repeats some station hours
        table = dedupe(table, TABLE_KEYS[name])
    return table


def read_tables(spark: SparkSession, folder: str, names=tuple(CSV_FILES), landing: str | None = None) -> dict[str, DataFrame]:
    """All tables of a folder of CSV files, and the target taken from ``train``."""
    tables = {n: read_table(spark, n, f"{folder.rstrip('/')}/{CSV_FILES[n]}", landing) for n in names}
    if "train" in tables:
        tables["target"] = project(tables["train"], "target")
    return tables


def project(df: DataFrame, name: str) -> DataFrame:
    """Only the declared columns of table ``name``, in declared order."""
    return df.select(*SCHEMAS[name].fieldNames())


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns cast to declared types; a value that does not fit raises."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_cast(F.col(f"`{f.name}`"), kinds[f.name], f.dataType).alias(f.name) for f in schema])


def _cast(col: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return col
    if isinstance(want, T.TimestampNTZType) and isinstance(have, T.StringType):
        return parse_epoch_or_iso(col)
    if isinstance(want, T.DateType) and isinstance(have, T.StringType):
        return F.to_date(parse_epoch_or_iso(col))
    if isinstance(want, (T.ShortType, T.IntegerType, T.LongType)) and isinstance(have, T.StringType):
        # whole numbers may be written as "3.0" and flags as "True"
        flag = F.when(F.lower(col) == "true", F.lit("1")).when(F.lower(col) == "false", F.lit("0"))
        number = F.coalesce(flag, col).cast("decimal(38,18)")
        broken = F.raise_error(F.concat(F.lit("not a whole number: "), col)).cast(want)
        return F.when(number.isNull() | (number == F.floor(number)), number.cast(want)).otherwise(broken)
    if isinstance(have, T.BooleanType) and isinstance(want, T.NumericType):
        return col.cast("int").cast(want)
    return col.cast(want)


def parse_epoch_or_iso(col: Column) -> Column:
    """Text to a zone-free timestamp: whole numbers are nanoseconds since 1970,
    anything else is read as a date or timestamp."""
    micros = (F.try_divide(col.try_cast("decimal(20,0)"), F.lit(1_000_000_000))).cast("decimal(20,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    from_epoch = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)"))
    return F.when(col.rlike(r"^-?\d+$"), from_epoch).otherwise(col.cast("timestamp_ntz"))


def conform_batch(df: DataFrame, name: str, keep_gate: bool = False) -> DataFrame:
    """A live batch brought to the stored table's names, order and types.

    With ``keep_gate`` the flag of the rows to score is kept, last, where a batch has it.
    """
    for old, new in BATCH_RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    schema = SCHEMAS[name]
    if keep_gate and GATE in df.columns and GATE not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(GATE, T.BooleanType())])
    return conform(df, schema)


def compact_types(df: DataFrame, keep: tuple[str, ...] = ("target",)) -> DataFrame:
    """Doubles narrowed to floats, for storage."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("float").alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in keep
        else F.col(f"`{f.name}`")
        for f in df.schema
    ])


@contextmanager
def _setting(spark: SparkSession, key: str, value: int):
    """A setting of the session, put back afterwards."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_features(
    df: DataFrame, path: str, mode: str = "errorifexists", by_month: bool = True, rebalance: bool = False,
    guard: FanoutGuard | None = None,
) -> None:
    """The feature table as Parquet, one folder per month of ``date``.

    A ``guard`` that the table was built with is asked once it is written; if a join
    multiplied rows, the table is removed again and an error raised.

    Tasks of the lag step hold a few months each and so write few files.
    ``rebalance`` shuffles once more to even out the files; large months are
    split over several tasks.

    Hundreds of columns of doubles outgrow their dictionaries, whose look-ups take almost half
    of the time of writing: values are written plain, and Zstandard finds the repeats.
    A task with up to ``OPEN_MONTHS`` months keeps their files open; only one with more
    sorts its wide rows by month, which spills them.
    """
    plain = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": ROW_GROUP}
    if by_month:
        df = df.withColumn("date_month", F.date_format("date", "yyyy-MM"))
        if rebalance:
            df = df.hint("rebalance", "date_month")
        with _setting(df.sparkSession, OPEN_FILES, OPEN_MONTHS):
            df.write.mode(mode).options(**plain).partitionBy("date_month").parquet(path)
    else:
        df.write.mode(mode).options(**plain).parquet(path)
    if guard is not None:
        try:
            guard.check()
        except ValueError:
            discard(df.sparkSession, path)
            raise


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("date_month")
