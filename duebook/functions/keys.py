"""Joins on reference columns where 0 stands for "refers to nothing"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free_or_matched(
    free: DataFrame, bound: DataFrame, key: str, others: DataFrame
) -> DataFrame:
    """The ``free`` rows, whose ``key`` is 0, and those ``bound`` rows whose key is found
    in the same column of ``others`` (see ``Tables.split``).

    The 0 rows can be most of the table and would all hash to one join partition; as a
    branch of their own they never enter the shuffle. Only real references are joined, as
    a semi join; a heavily used one is left to AQE's skew split, which may cut the left
    side of a semi join.
    """
    return free.unionByName(bound.join(others.select(key), key, "left_semi"))


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Key values held by more than one row, with their count."""
    return rows.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")
