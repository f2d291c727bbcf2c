"""Session defaults and the shared scratch folder."""

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Parquet is some four times smaller on disk than in memory: without this a
    # side is judged small enough to broadcast by its compressed size
    "spark.sql.sources.fileCompressionFactor": "4",
}

SCRATCH_SETTING = "spark.checkpoint.dir"
_scopes: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults that can be set on a running session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the driver is the one executor (a local master) may it be unset;
    anywhere else a folder of one machine would lose rows, so that is an error.
    """
    base = spark.conf.get(SCRATCH_SETTING, None) or spark.sparkContext.getConf().get(SCRATCH_SETTING)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {SCRATCH_SETTING} to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "panelspark", spark.sparkContext.applicationId)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def land(df, spark: SparkSession, name: str):
    """Write a table to the shared scratch folder and read it back: the lineage
    ends there, and a lost executor costs no recomputation."""
    path = scratch_dir(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables that are landed inside are removed at its end."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder, in whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
