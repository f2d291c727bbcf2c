"""A registry of fitted models: written whole, then published by a pointer.

    models/<name>/          one fit, as ``ml.store`` saves it
    published/00000002      the pointer: which of them is in use

A reader gets a whole model or the one before it. A fit that was interrupted is never
published; two that finish at a time cannot both become the same number.
"""

import uuid

from pyspark.sql import SparkSession

from panelspark.ml import store
from panelspark.ml.train import FoldModels
from panelspark.sources import pointer


def published(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the model in use, if there is one."""
    found = pointer.latest(spark, f"{path}/published")
    return (found[0], f"{path}/models/{found[1]['model']}") if found else None


def publish(spark: SparkSession, fitted: FoldModels, path: str) -> int:
    """Save a fit beside the others and put it in use; its number."""
    before = published(spark, path)
    number, name = (before[0] if before else 0) + 1, uuid.uuid4().hex
    store.save(spark, fitted, f"{path}/models/{name}")
    pointer.switch(spark, f"{path}/published", number, {"model": name})
    return number


def load(spark: SparkSession, path: str) -> FoldModels:
    """The model in use."""
    found = published(spark, path)
    if found is None:
        raise LookupError(f"{path}: no model is published")
    return store.load(spark, found[1])
