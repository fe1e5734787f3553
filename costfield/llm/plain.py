"""Texts with their words apart by single spaces, without a regular expression where none is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_single_spaces(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` and the column ``name``: the words of ``text`` (null: none), runs without white space, with one space between them."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\v\f\r", F.coalesce(text, F.lit("")))
    rows = rows.withColumn(name, spaced)
    single = F.when(F.contains(name, F.lit("  ")), F.regexp_replace(name, " +", " ")).otherwise(F.col(name))
    return rows.withColumn(name, F.trim(single))


def count_words(flat: Column) -> Column:
    """The number of words of a text with single spaces."""
    return F.when(flat == "", 0).otherwise(F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "))) + 1).cast("long")
