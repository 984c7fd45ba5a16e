"""Names in the order of Portuguese, and names that are the same without case and accents.

Collated strings sort, group and join by the rules of ICU: letters first, then accents, then case
(lower before upper), whatever their code points. They are for the keys of sorts, windows, groups and
joins; the columns that are shown stay plain strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Portuguese, and Portuguese without case and accents. Spark knows the language, not the country.
ORDER, FOLDED = "pt", "pt_CI_AI"


def in_order(name: Column) -> Column:
    """A key that sorts as Portuguese does."""
    return F.collate(name, ORDER)


def same_name(name: Column) -> Column:
    """A key that is equal for names that differ in case and accents only."""
    return F.collate(name, FOLDED)


def first_by_name(rows: DataFrame, group: list[str], name: str, key: str, n: int) -> DataFrame:
    """The first n rows of each group by name, ties by key, with ``place``. Places are cut before the shuffle, so no group sends more than n rows a task."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(in_order(F.col(name)), name, key))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def count_names(rows: DataFrame, name: str) -> DataFrame:
    """(name, spellings, rows): each name once whatever its case and accents, spelt as its first form by order, with the number of different spellings."""
    held = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("spelt")).agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by("spelt", F.struct(in_order(F.col("spelt")), "spelt"))
    return held.groupBy(same_name(F.col("spelt")).alias("_same")).agg(first.alias("name"), F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows")).select("name", "spellings", "rows")


def join_by_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, how: str = "inner") -> DataFrame:
    """Rows whose names are the same without case and accents."""
    return left.join(right, same_name(F.col(left_name)) == same_name(F.col(right_name)), how)
