"""What has been published below a path: folders in order, each made valid by one committed file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

_ENTRY = "number long, folder string"


def _numbered(spark: SparkSession, path: str) -> list:
    try:
        return sorted(spark.read.schema(_ENTRY).parquet(f"{path}/manifest").collect())  # one row per publication
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing.getCondition()):
            raise
        return []


def entries(spark: SparkSession, path: str) -> list[str]:
    """The folders, oldest first; of writers at the same time, by name."""
    return [entry.folder for entry in _numbered(spark, path)]


def add_entry(spark: SparkSession, path: str, folder: str) -> None:
    """Publish a folder that is whole. The entry is one file, which Spark's writer commits at once."""
    number = max((entry.number for entry in _numbered(spark, path)), default=0) + 1
    spark.createDataFrame([(number, folder)], _ENTRY).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
