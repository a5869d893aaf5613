"""Shared values as column expressions: a row's dictionary in order of first occurrence, and each value's key in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dictionary(values: Column) -> Column:
    return F.array_distinct(values)


def keys(values: Column) -> Column:
    """Each value's place in the dictionary, which is made once a row; a null value has none."""
    placed = F.transform(F.array(dictionary(values)), lambda d: F.transform(values, lambda x: (F.array_position(d, x) - 1).cast("int")))
    return F.get(placed, F.lit(0))


def resolve(keys_: Column, dictionary_: Column) -> Column:
    return F.transform(keys_, lambda k: F.get(dictionary_, k))
