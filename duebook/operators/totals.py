"""Sums of a ledger per key and report day.

For one day they are one aggregation. For a series no row is repeated per day: a row is turned into
the changes that it makes, one when it begins to count, one each time it gets older than the edge of a
bucket, one when it ceases to count. Most rows of a long ledger are old on the first day already and
make one change. Changes are summed per key and day, and what goes on from day to day are running totals
of those few sums.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.buckets import age_bucket, sums_by_age
from duebook.functions.money import ZERO
from duebook.params import AsOf


@dataclass(frozen=True)
class Ages:
    """Amounts summed by the age of a row's ``day``: bucket names, youngest first, by amount.
    With ``cut`` a row has no age, and the ``reached`` amounts are zero, before its day."""

    day: str
    edges: Sequence[int]
    buckets: Mapping[str, Sequence[str]]
    cut: bool = False
    reached: Mapping[str, str] = field(default_factory=dict)


def totals(
    ledger: DataFrame, as_of: AsOf, keys: Sequence[str], amounts: Mapping[str, str],
    ages: Ages | None = None,
) -> DataFrame:
    """``amounts`` (expressions by name) and ``ages`` summed per report day and ``keys``. A key has
    a row on each day on which one of its rows counts. The ledger is that of ``as_of.moving()``."""
    reached = dict(ages.reached) if ages else {}
    aged = {f"_aged{i}": (a, names) for i, (a, names) in enumerate(ages.buckets.items())} if ages else {}
    columns = {**amounts, **reached, **{c: a for c, (a, _) in aged.items()}}
    used = [*keys, *(f"{e} AS {c}" for c, e in columns.items())]
    if not as_of.many:
        return _on_one_day(ledger, as_of, keys, amounts, ages, reached, aged, used)
    changes = _changes(ledger.selectExpr(
        *used, *as_of.moving().keys, *([f"{ages.day} AS _day"] if ages else [])), as_of, ages)
    sums = {
        "_rows": "sum(e.came)",
        **{c: f"sum({c} * e.came)" for c in amounts},
        **{c: f"sum({c} * e.turned)" for c in reached},
        **{name: f"sum(if(e.new = {i}, {c}, {ZERO}) - if(e.old = {i}, {c}, {ZERO}))"
           for c, (_, names) in aged.items() for i, name in enumerate(names)},
    }
    summed = changes.groupBy(*keys, F.expr("e.at AS at")).agg(*(F.expr(f"{s} AS {n}") for n, s in sums.items()))
    return _on_each_day(summed, as_of, keys, list(sums))


def _on_one_day(ledger, as_of, keys, amounts, ages, reached, aged, used) -> DataFrame:
    if ages:
        age, there = age_bucket(ages.day, as_of.date, ages.edges), as_of.covers(ages.day)
        used = [*used, f"if({there}, {age}, NULL) AS _age" if ages.cut else f"{age} AS _age"]
        used += [f"{there} AS _reached"] if reached else []
    sums = [
        *(f"sum({c}) AS {c}" for c in amounts),
        *(f"sum(if(_reached, {c}, {ZERO})) AS {c}" for c in reached),
        *(s for c, (_, names) in aged.items() for s in sums_by_age("_age", c, names)),
    ]
    return ledger.selectExpr(*used).groupBy(*keys).agg(*map(F.expr, sums))


def _changes(rows: DataFrame, as_of: AsOf, ages: Ages | None) -> DataFrame:
    """The rows' changes as ``e``: the place of the day in the series, what the change adds to the
    rows that count (``came``) and to those whose day is reached (``turned``), and the ages before and
    after, -1 for none."""
    count = len(as_of.days)
    edges = [f"_edge{i}" for i in range(len(ages.edges))] if ages else []
    passed = [f"{as_of.days_until(f'date_add(_day, {e})')} AS {c}" for e, c in zip(ages.edges, edges)] if ages else []
    day = as_of.first_covering("_day") if ages and ages.cut else None
    rows = rows.selectExpr(
        "*", f"coalesce({as_of.first_covering('since')}, 0) AS _from",
        f"coalesce({as_of.first_covering('until')}, {count}) AS _to", *passed,
        *([f"coalesce({day}, {count}) AS _on"] if day else []),
    ).filter("_from < _to")
    rows = rows.selectExpr("*", "least(greatest(_on, _from), _to) AS _there") if day else rows.selectExpr(
        "*", "_from AS _there")

    def age(at: str) -> str:
        return f"if({edges[0]} IS NULL, -1, {' + '.join(f'if({c} <= {at}, 1, 0)' for c in edges)})" if edges else "-1"

    def change(at: str, came: str, turned: str, old: str, new: str) -> str:
        return f"named_struct('at', {at}, 'came', {came}, 'turned', {turned}, 'old', {old}, 'new', {new})"

    rows = rows.selectExpr("*", change(
        "_from", "1", "if(_there = _from, 1, 0)", "-1", f"if(_there = _from, {age('_from')}, -1)") + " AS _first")
    later = [f"if({c} > _there AND {c} < _to, {change(c, '0', '0', str(i), str(i + 1))}, NULL)"
             for i, c in enumerate(edges)]
    if day:
        later.append(f"if(_there > _from AND _there < _to, {change('_there', '0', '1', '-1', age('_there'))}, NULL)")
    later.append(f"if(_to < {count}, {change('_to', '-1', 'if(_there < _to, -1, 0)', f'if(_there < _to, {age('_to - 1')}, -1)', '-1')}, NULL)")
    settled = " AND ".join([f"_to = {count}", "_there = _from", *([f"coalesce({edges[-1]}, 0) <= _from"] if edges else [])])
    changes = f"if({settled}, array(_first), array(_first, {', '.join(later)}))"
    return rows.selectExpr("*", f"explode({changes}) AS e").filter("e IS NOT NULL")


def _on_each_day(sums: DataFrame, as_of: AsOf, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Running totals over the days of a change, each handed on until the next change."""
    of_key = f"PARTITION BY {', '.join(keys)} ORDER BY at"
    rows = sums.selectExpr(
        *keys, "at", *(f"sum({n}) OVER ({of_key} ROWS UNBOUNDED PRECEDING) AS {n}" for n in names),
        f"lead(at, 1, {len(as_of.days)}) OVER ({of_key}) AS _next",
    ).filter("_rows > 0")
    return rows.selectExpr(
        f"explode(slice({as_of.literals}, at + 1, _next - at)) AS as_of", *keys,
        *(n for n in names if n != "_rows"))
