"""Arrow lists of numbers as numpy matrices."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """A vector that is there, has a component, and only finite ones."""
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, value), F.lit(False))


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
