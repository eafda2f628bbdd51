"""Tables laid out by the keys that reports join on, in the session's catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.params import AsOf, Period
from duebook.schema import TABLES
from duebook.sources.base import ON_COMPLETE_WORK, ON_OPEN_PLAN, Reference, Tables

#: The keys a table is kept by, a copy for each; the first is the one for sums per patient.
COPIES: Mapping[str, Sequence[str]] = {
    "procedurelog": ("patnum", "procnum"), "claimproc": ("patnum", "procnum"),
    "adjustment": ("patnum", "procnum"), "paysplit": ("patnum", "procnum"), "patient": ("patnum",),
}
#: References settled when the tables are written: a column of each copy says whether they hold.
SETTLED: Mapping[Reference, str] = {ON_COMPLETE_WORK: "on_complete_work", ON_OPEN_PLAN: "on_open_plan"}
#: How many times the mean a bucket's rows may be, where the mean is over so many rows.
UNEVEN, FEW = 4, 100_000


def _table(name: str, key: str | None) -> str:
    return f"{name}_by_{key}" if key else name


def _settled(tables: Tables, rows: DataFrame, reference: Reference, column: str) -> DataFrame:
    """``rows`` with a column that says whether they refer to nothing or the reference holds. Rows that
    refer to nothing stay out of the join."""
    key = reference.key
    held = reference.held(tables).select(key).distinct().withColumn("_held", F.lit(True))
    bound = rows.filter(f"{key} != 0").join(held, key, "left")
    other = rows.filter(f"{key} = 0 OR {key} IS NULL").withColumn("_held", F.expr(f"{key} <=> 0"))
    return other.unionByName(bound).withColumn(column, F.coalesce("_held", F.lit(False))).drop("_held")


def _referring(rows: DataFrame, name: str, key: str) -> DataFrame:
    """The rows of a copy. References to nothing are one value by design; they never meet a join by
    that key and are in the first copy."""
    own = key == next(iter(TABLES[name])) or key == COPIES[name][0]
    return rows if own else rows.filter(f"{key} != 0")


def hot_buckets(rows: DataFrame, key: str, buckets: int, uneven: float = UNEVEN, few: int = FEW) -> list[int]:
    """Buckets that would hold more than so many times the mean: one task would read all of one."""
    counts = rows.groupBy(F.expr(f"pmod(hash({key}), {buckets})").alias("bucket")).agg(F.count("*").alias("n"))
    sizes = {r.bucket: r.n for r in counts.collect()}  # one row per bucket
    most = uneven * max(few, sum(sizes.values()) / buckets)
    return sorted(b for b, n in sizes.items() if n > most)


def write_buckets(
    tables: Tables, spark: SparkSession, database: str, buckets: int, path: str | None = None,
    uneven: float = UNEVEN, few: int = FEW,
) -> None:
    """Write all tables to a database for ``BucketedTables``, those of COPIES in ``buckets`` buckets by
    each of their keys, with the references in SETTLED settled. The copies belong together: they
    are written from one state of the tables, and anew when that changes.

    A bucket is read by one task and can't be split. Where one key holds so many rows that its
    bucket is ``uneven`` times the mean, this raises before anything is written; such a source is
    for ``write_tables``, where joins shuffle and AQE splits the hot key.
    """
    sources = {name: tables.read(name, *columns) for name, columns in TABLES.items()}
    for name, keys in COPIES.items():
        for key in keys:
            hot = hot_buckets(_referring(sources[name], name, key), key, buckets, uneven, few)
            if hot:
                raise ValueError(f"{name} by {key}: buckets {hot[:10]} hold over {uneven} times the mean")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, rows in sources.items():
        for reference, column in SETTLED.items():
            if reference.name == name:
                rows = _settled(tables, rows, reference, column)
        for key in COPIES.get(name, (None,)):
            writer = rows.write
            if key:  # one file per bucket
                writer = _referring(rows, name, key).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
            if path:
                writer = writer.option("path", f"{path.rstrip('/')}/{_table(name, key)}")
            writer.mode("overwrite").format("parquet").saveAsTable(f"{database}.{_table(name, key)}")


class BucketedTables(Tables):
    """What ``write_buckets`` wrote. Joins and sums by a copy's key move no row of it, and settled
    references are a filter instead of a join."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database

    def frame(self, name: str, columns: Sequence[str], by: str | None = None) -> DataFrame:
        keys = COPIES.get(name, (None,))
        return self.spark.table(f"{self.database}.{_table(name, by if by in keys else keys[0])}")

    def read(
        self, name: str, *columns: str, by: str | None = None, scope: AsOf | Period | None = None
    ) -> DataFrame:
        return self._typed(name, self.frame(name, columns, by), columns)

    def referring(
        self, reference: Reference, *columns: str, where: str = "true", scope: AsOf | Period | None = None
    ) -> DataFrame:
        if reference not in SETTLED:
            return super().referring(reference, *columns, where=where)
        rows = self.frame(reference.name, columns).filter(SETTLED[reference])
        return self._typed(reference.name, rows, columns).filter(where)
