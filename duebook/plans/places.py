"""The place of each row in a sorted report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.session import new_folder

_IN_RANGE = (1 << 33) - 1


def with_places(rows: DataFrame, name: str = "position", path: str | None = None) -> DataFrame:
    """``rows``, sorted by ``orderBy``, with the place of each from 1 on.

    A sort leaves rows in ranges, one per task, and a row's number within its range is known there. The
    rows are written once, to ``path`` or a folder of their own below the session's shared one, so the
    ranges stay as they are; what the ranges before hold is a running sum over one row per range, at most
    as many as there are shuffle partitions. No row is moved for it.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    path = path or new_folder(spark, "places")
    numbered.write.parquet(path)
    numbered = spark.read.schema(numbered.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    counts = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit(_IN_RANGE)) + F.col("_before") + 1
    # One row per range: as many as the sort had tasks, 16 bytes each.
    return numbered.join(F.broadcast(before), "_range").withColumn(name, place).drop("_at", "_range", "_before")
