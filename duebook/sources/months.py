"""Tables in one folder per month, so that a report over a window lists and reads its months only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.params import AsOf, Period
from duebook.schema import DATES, TABLES
from duebook.sources.base import StoredTables, Tables

#: The folders' column: the month of the table's own date, as 202401.
MONTH = "own_month"


def write_months(
    tables: Tables, path: str, names: Sequence[str] = tuple(TABLES), files: int | None = None
) -> None:
    """Write tables for ``MonthTables``. Dated tables (see ``DATES``) go into a folder per month, rows
    without a date into one of their own. Rows are dealt by date and key first, as in ``write_tables``:
    a task writes to few months, and a month that holds much of the table is cut into several files."""
    for name in names:
        rows = tables.read(name, *TABLES[name])
        if name not in DATES:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
            continue
        date, key = DATES[name], next(iter(TABLES[name]))
        dealt = rows.repartitionByRange(*([files] if files else []), date, key)
        dealt.withColumn(MONTH, F.expr(f"year({date}) * 100 + month({date})")).sortWithinPartitions(
            MONTH, date, key).write.partitionBy(MONTH).mode("overwrite").parquet(f"{path}/{name}")


class MonthTables(StoredTables):
    """What ``write_months`` wrote. A read for a window, or up to a report day, is cut to its months;
    their folders are chosen before any file is opened. Reads without a scope, such as of the
    procedures that claim lines refer to, see the whole table."""

    def read(
        self, name: str, *columns: str, by: str | None = None, scope: AsOf | Period | None = None
    ) -> DataFrame:
        rows = self.frame(name, columns)
        if scope is not None and name in DATES:
            rows = rows.filter(scope.months(MONTH))
        return self._typed(name, rows, columns)
