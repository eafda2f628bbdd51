"""Table sources. Operators name the columns they read, so every scan is as narrow as
its use and a source that assembles a table can leave out what nobody asked for."""

from __future__ import annotations

import uuid
import warnings
from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from duebook.functions.keys import free_or_matched
from duebook.params import AsOf, Period
from duebook.schema import COMPLETE, DATES, TABLES
from duebook.sources.manifest import add_entry, entries


# Options of the text formats. With FAILFAST a value that can't be read raises.
_TEXT = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}}


@dataclass(frozen=True)
class Reference:
    """A reference of table ``name`` by ``key`` to the same column of ``target``, which holds where
    ``condition`` on the target's ``column`` does."""

    name: str
    key: str
    target: str
    column: str
    condition: str

    def held(self, tables: Tables) -> DataFrame:
        return tables.read(self.target, self.key, self.column, by=self.key).filter(self.condition)


#: Claim lines on completed work, and payments outside plans or on an open one.
ON_COMPLETE_WORK = Reference("claimproc", "procnum", "procedurelog", "procstatus", f"procstatus = {COMPLETE}")
ON_OPEN_PLAN = Reference("paysplit", "payplannum", "payplan", "isclosed", "isclosed = 0")


class Tables(ABC):
    @abstractmethod
    def frame(self, name: str, columns: Sequence[str]) -> DataFrame:
        """The table, holding at least ``columns``."""

    def read(
        self, name: str, *columns: str, by: str | None = None, scope: AsOf | Period | None = None
    ) -> DataFrame:
        """``columns`` of a table in their contract types. The cast is a no-op, and
        predicates still reach the files, where the stored type already agrees. ``by`` names the
        column that the rows are joined on, for a source that has them laid out by it; rows that refer
        to nothing by it may then be left out. So may rows whose own date (see ``DATES``) the
        ``scope`` doesn't cover; a caller that gives one tests that date itself."""
        return self._typed(name, self.frame(name, columns), columns)

    def among(self, name: str, key: str, wanted: DataFrame, *columns: str) -> DataFrame:
        """Rows whose ``key`` is found in the column of that name, the only one, of ``wanted``. A source
        that joins something to the table may do so afterwards, to the rows that are left."""
        return self.read(name, *columns, by=key).join(wanted, key, "left_semi")

    @staticmethod
    def _typed(name: str, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        types = TABLES[name]
        if rows.sparkSession.conf.get("spark.sql.ansi.enabled") != "true":
            warnings.warn("spark.sql.ansi.enabled is off: sums that overflow wrap", stacklevel=3)
        return rows.selectExpr(*(f"CAST({c} AS {types[c]}) AS {c}" for c in columns))

    def split(
        self, name: str, key: str, *columns: str, scope: AsOf | Period | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """The table in two: rows that refer to nothing (``key`` is 0), and the others."""
        rows = self.read(name, *columns, scope=scope)
        return rows.filter(f"{key} = 0"), rows.filter(f"{key} != 0")

    def referring(
        self, reference: Reference, *columns: str, where: str = "true", scope: AsOf | Period | None = None
    ) -> DataFrame:
        """Rows that meet ``where`` and refer to nothing, or to a row that the reference holds for."""
        free, bound = self.split(reference.name, reference.key, *columns, scope=scope)
        return free_or_matched(free.filter(where), bound.filter(where), reference.key, reference.held(self))


class StoredTables(Tables):
    """One file set per table below ``path``.

    CSV and JSON columns are found by name: a CSV file's header may have them in any order,
    and one that lacks a column raises; without a header (``header="false"``) the contract's
    order is taken. A value that isn't of its column's type raises too, unless another ``mode``
    is given.
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet", **options: str):
        self.spark, self.path, self.fmt, self.options = spark, path.rstrip("/"), fmt, options
        self._schemas: dict[str, StructType | str] = {}

    def frame(self, name: str, columns: Sequence[str]) -> DataFrame:
        reader = self.spark.read.format(self.fmt).options(**{**_TEXT.get(self.fmt, {}), **self.options})
        path = f"{self.path}/{name}"
        if name not in self._schemas:  # finding it touches the files: once will do
            if self.fmt in _TEXT:  # text formats carry no types of their own
                types, names = TABLES[name], list(TABLES[name])
                if self.fmt == "csv" and str(self._option("header")).lower() == "true":
                    header = self.spark.read.format("csv").options(**self.options).option("header", "true")
                    names = [c.lower() for c in header.load(path).columns]
                    missing = sorted(set(types) - set(names))
                    if missing:
                        raise ValueError(f"{path} has no column {', '.join(missing)}")
                self._schemas[name] = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in names)
            else:
                self._schemas[name] = reader.load(path).schema
        return reader.schema(self._schemas[name]).load(path)


    def _option(self, name: str) -> str | None:
        given = {k.lower(): v for k, v in {**_TEXT.get(self.fmt, {}), **self.options}.items()}
        return given.get(name)


class CatalogTables(Tables):
    """Tables or views of the session catalog."""

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.prefix = spark, f"{database}." if database else ""

    def frame(self, name: str, columns: Sequence[str]) -> DataFrame:
        return self.spark.table(self.prefix + name)


class FrameTables(Tables):
    """DataFrames handed in by the caller."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self.frames = dict(frames)

    def frame(self, name: str, columns: Sequence[str]) -> DataFrame:
        return self.frames[name]


def write_tables(
    tables: Tables, path: str, names: Sequence[str] = tuple(TABLES), files: int | None = None
) -> None:
    """Write tables as parquet for ``StoredTables``, so that a costly source is assembled
    once. Rows are laid out by the date the reports cut on, so a date filter skips the
    files and row groups outside it; the unique key after the date lets the writer cut a
    day that holds a large share of the rows into several files. ``files`` is the number
    of parts per table; by default the session's shuffle partitions, merged by AQE."""
    for name in names:
        rows = tables.read(name, *TABLES[name])
        if name in DATES:
            order = [DATES[name], next(iter(TABLES[name]))]
            parts = [files] if files else []
            rows = rows.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


class PublishedTables(StoredTables):
    """The set of tables that was last published below ``path``. It is looked up once: a reader
    keeps to one set, whatever is published meanwhile."""

    def __init__(self, spark: SparkSession, path: str):
        published = entries(spark, path.rstrip("/"))
        if not published:
            raise ValueError(f"nothing has been published below {path}")
        super().__init__(spark, f"{path.rstrip('/')}/{published[-1]}")


def publish_tables(
    tables: Tables, spark: SparkSession, path: str, names: Sequence[str] = tuple(TABLES), files: int | None = None
) -> str:
    """Write a set of tables beside the published ones and switch to it when it is whole, for
    ``PublishedTables``. The switch is one entry of the manifest; a failure before leaves the old
    set in force and a folder nobody reads. Returns the folder. Old sets stay until the caller
    deletes them: a reader may be at work on one."""
    folder = f"set-{uuid.uuid4().hex}"
    write_tables(tables, f"{path.rstrip('/')}/{folder}", names, files)
    add_entry(spark, path.rstrip("/"), folder)
    return folder
