"""Joins against a reduced key set that stay divisible when one key is hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _apart(keys: Sequence[str]) -> Column:
    """0 for every row, computed from the keys.

    Grouping by the keys and this column gives the same groups, but leaves the
    result partitioned by more than the join key. The join then shuffles both
    sides itself, and AQE splits a hot key only on sides shuffled for the join.
    """
    return F.pmod(F.xxhash64(*keys), F.lit(1)).alias("_apart")


def key_set(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of ``df``, combined map-side."""
    return df.select(*keys, _apart(keys)).distinct().select(*keys)


def one_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key (the smallest), combined map-side."""
    return df.groupBy(key, _apart([key])).agg(F.min(value).alias(value)).select(key, value)


def rows_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``; never repeats a row."""
    return df.join(key_set(other, keys), list(keys), "left_semi")


def rows_not_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    return df.join(key_set(other, keys), list(keys), "left_anti")
