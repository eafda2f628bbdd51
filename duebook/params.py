"""Report parameters: an as-of date (or a series of them) and a closed date window.

Conditions are SQL text, as everywhere in the package: one expression string costs one
call into the JVM, a tree of Column objects one per node.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


def _day(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def _literal(day: dt.date) -> str:
    return f"DATE'{day.isoformat()}'"


def _month(day: dt.date) -> int:
    return day.year * 100 + day.month


@dataclass(frozen=True)
class AsOf:
    """Report date. ``inclusive`` says whether rows dated on the day itself count.

    Made with several days (``AsOf.series``) every operator yields one set of rows per
    day, told apart by an ``as_of`` column that then joins each grouping key.

    In the ``moving`` form of a series rows aren't repeated per day. They carry the dates they count
    with: on each report day that covers ``since`` (empty: on all) and doesn't cover ``until``
    (empty: to the end). Reports that sum the rows take that form (see operators/totals.py).
    """

    days: tuple[dt.date, ...]
    inclusive: bool = True
    many: bool = False
    moves: bool = False

    @classmethod
    def on(cls, day: dt.date | str, inclusive: bool = True) -> AsOf:
        return cls((_day(day),), inclusive)

    @classmethod
    def series(cls, days: Iterable[dt.date | str], inclusive: bool = True) -> AsOf:
        return cls(tuple(sorted({_day(d) for d in days})), inclusive, many=True)

    def moving(self) -> AsOf:
        return replace(self, moves=True) if self.many else self

    @property
    def keys(self) -> list[str]:
        if self.moves:
            return ["since", "until"]
        return ["as_of"] if self.many else []

    @property
    def literals(self) -> str:
        return f"array({', '.join(map(_literal, self.days))})"

    @property
    def date(self) -> str:
        return "as_of" if self.many else _literal(self.days[0])

    def covers(self, column: str) -> str:
        """The date in ``column`` is not after the report date."""
        return self._reached(column, self.date)

    def _reached(self, column: str, until: str) -> str:
        return f"({column} {'<=' if self.inclusive else '<'} {until})"

    not_after = covers

    def spread(self, rows: DataFrame) -> DataFrame:
        """For a series, repeat each row once per report day."""
        if not self.many:
            return rows
        if self.moves:
            return self.from_date(rows, "CAST(NULL AS DATE)")
        return rows.selectExpr("*", f"explode({self.literals}) AS as_of")

    def from_date(self, rows: DataFrame, since: str) -> DataFrame:
        """Rows of a moving series that count from a date on."""
        return rows.selectExpr("*", f"{since} AS since", "CAST(NULL AS DATE) AS until")

    def ever(self, column: str) -> str:
        """The date in ``column`` is covered by the last report day."""
        return self._reached(column, _literal(self.days[-1]))

    @property
    def counting(self) -> str:
        """Whether a row of the moving form counts on the one report day."""
        return f"(since IS NULL OR {self.covers('since')}) AND NOT (until IS NOT NULL AND {self.covers('until')})"

    def months(self, column: str) -> str:
        """The month in ``column``, as 202401, may hold a covered date."""
        return f"({column} <= {_month(self.days[-1])})"

    def days_until(self, date: str) -> str:
        """The number of report days up to a date, that day included; NULL for no date."""
        first, last = self.days[0], self.days[-1]
        counts, passed = [], 0
        for offset in range((last - first).days):
            passed += first + dt.timedelta(offset) == self.days[passed]
            counts.append(str(passed))
        within = f"element_at(array({', '.join(counts)}), datediff({date}, {_literal(first)}) + 1)" if counts else "0"
        return f"CASE WHEN {date} < {_literal(first)} THEN 0 WHEN {date} >= {_literal(last)} THEN {len(self.days)} " \
               f"WHEN {date} IS NOT NULL THEN {within} END"

    def first_covering(self, column: str) -> str:
        """The place in the series, from 0 on, of the first day that covers a date; the number of
        days where none does."""
        return self.days_until(f"date_sub({column}, 1)" if self.inclusive else column)

    def select(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows whose dates in all ``columns`` are covered, per report day."""
        if self.many:  # rows past the last day fit no day: drop them before repeating
            rows = rows.filter(" AND ".join(map(self.ever, columns)))
        if self.moves:
            return self.from_date(rows, columns[0] if len(columns) == 1 else f"greatest({', '.join(columns)})")
        return self.spread(rows).filter(" AND ".join(map(self.covers, columns)))


    def due(self, rows: DataFrame, column: str, ahead: int) -> DataFrame:
        """Rows dated up to some days past the report date, that day included."""
        if self.moves:
            rows = rows.filter(f"{column} <= date_add({_literal(self.days[-1])}, {ahead})")
            return self.from_date(rows, f"date_sub({column}, {ahead if self.inclusive else ahead + 1})")
        return self.spread(rows).filter(f"{column} <= date_add({self.date}, {ahead})")


@dataclass(frozen=True)
class Period:
    """Window of days, both ends included."""

    start: dt.date
    end: dt.date

    keys = ()
    many = False

    @classmethod
    def between(cls, start: dt.date | str, end: dt.date | str) -> Period:
        return cls(_day(start), _day(end))

    def covers(self, column: str) -> str:
        return f"({column} BETWEEN {_literal(self.start)} AND {_literal(self.end)})"

    def not_after(self, column: str) -> str:
        return f"({column} <= {_literal(self.end)})"

    def months(self, column: str) -> str:
        """The month in ``column``, as 202401, may hold a covered date."""
        return f"({column} BETWEEN {_month(self.start)} AND {_month(self.end)})"

    def select(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.filter(" AND ".join(map(self.covers, columns)))
