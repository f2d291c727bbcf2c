"""Small text functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_contained(col: Column, candidates: list[str]) -> Column:
    """The first of ``candidates`` that occurs in the text, null if none does."""
    found = F.lit(None).cast("string")
    for text in reversed(candidates):
        found = F.when(col.contains(text), F.lit(text)).otherwise(found)
    return found
