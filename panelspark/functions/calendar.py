"""Calendar parts, cyclic encodings, holidays and the dense date index."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: public holidays of Estonia ---
FIXED_HOLIDAYS = [
    # month, day, first year
    (1, 1, 0),
    (2, 24, 0),
    (5, 1, 0),
    (6, 23, 0),
    (6, 24, 0),
    (8, 20, 1998),
    (12, 24, 2005),
    (12, 25, 0),
    (12, 26, 0),
]
# Good Friday, Easter Sunday, Pentecost: days from Easter Sunday
EASTER_HOLIDAYS = [-2, 0, 49]
# --- end of fixed values ---


def calendar(df: DataFrame, time: str) -> DataFrame:
    """date, year, quarter, month, ISO week, hour, day, ordinal_day and weekday (Monday 1)."""
    t = F.col(time)
    return df.select(
        "*",
        F.to_date(t).alias("date"),
        F.year(t).alias("year"),
        F.quarter(t).alias("quarter"),
        F.month(t).alias("month"),
        F.weekofyear(t).alias("week"),
        F.hour(t).alias("hour"),
        F.dayofmonth(t).alias("day"),
        F.dayofyear(t).alias("ordinal_day"),
        (F.weekday(t) + 1).alias("weekday"),
    )


def cyclic(df: DataFrame) -> DataFrame:
    """Position in the year and in the day on a circle."""
    year_angle = F.lit(math.pi) * F.col("ordinal_day") / 183
    day_angle = F.lit(math.pi) * F.col("hour") / 12
    return df.select(
        "*",
        F.sin(year_angle).alias("sin(ordinal_day)"),
        F.cos(year_angle).alias("cos(ordinal_day)"),
        F.sin(day_angle).alias("sin(hour)"),
        F.cos(day_angle).alias("cos(hour)"),
    )


def easter_sunday(year: Column) -> Column:
    """Western Easter, valid for 1900-2099 (Gauss's rule with its century constants)."""
    lunar = F.pmod(19 * F.pmod(year, F.lit(19)) + 24, F.lit(30))
    solar = F.pmod(
        2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) + 6 * lunar + 5, F.lit(7)
    )
    late = (lunar == 29) & (solar == 6)
    late_too = (lunar == 28) & (solar == 6) & (F.pmod(year, F.lit(19)) > 10)
    days = lunar + solar - F.when(late | late_too, 7).otherwise(0)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), days.cast("int"))


def is_holiday(date: Column) -> Column:
    """1 on a public holiday, else 0; plain column arithmetic, no lookup table."""
    year = F.year(date)
    rule = F.lit(False)
    for month, day, first in FIXED_HOLIDAYS:
        rule = rule | ((F.month(date) == month) & (F.dayofmonth(date) == day) & (year >= first))
    from_easter = F.datediff(date, easter_sunday(year))
    return F.when(rule | from_easter.isin(EASTER_HOLIDAYS), 1).otherwise(0)


def holidays(spark, first_year: int, last_year: int) -> DataFrame:
    """The holiday dates of a range of years as a table."""
    days = spark.range(1).select(
        F.explode(F.sequence(
            F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
            F.make_date(F.lit(last_year), F.lit(12), F.lit(31)),
        )).alias("date")
    )
    return days.filter(is_holiday(F.col("date")) == 1)


def date_index(
    df: DataFrame, date: str, out: str = "date_order_kfold", among: DataFrame | None = None
) -> DataFrame:
    """Dense 0-based index of each date among the dates that occur in ``df``.

    ``among`` names a cheaper table with the same dates in the same column, for
    a ``df`` that took work to build and would be built twice otherwise.

    The window orders distinct calendar days only, and those days are what is
    broadcast: 366 rows per year of data however many rows the data has.
    """
    day = F.to_date(F.col(date))
    days = (df if among is None else among).select(day.alias("__day")).distinct()
    numbered = days.select("__day", (F.row_number().over(Window.orderBy("__day")) - 1).alias(out))
    return (
        df.withColumn("__day", day)
        .join(F.broadcast(numbered), "__day", "left")
        .drop("__day")
    )
