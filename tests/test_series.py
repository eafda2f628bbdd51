"""A series of report days against its days one by one."""

from __future__ import annotations

import datetime as dt

import pytest

from duebook import AsOf
from duebook.operators import ledgers
from duebook.operators.totals import Ages, _changes
from duebook.plans import aging, production, receivables
from duebook.schema import AR_EDGES
from tests.ledger_rows import random_tables, stored

REPORTS = [
    receivables.receivables_by_patient, receivables.receivables_by_clinic_and_patient,
    receivables.receivables_by_clinic, production.production_by_patient, aging.aging_charges,
    aging.aging_balances, aging.aging_of_receivables, aging.custom_aging_charges, aging.custom_aging,
]
START = dt.date(2001, 1, 1)
DAYS = {
    "close and far": [START + dt.timedelta(d) for d in (0, 1, 2, 40, 41, 130, 131, 181, 700)],
    "before anything": [dt.date(1990, 1, 1), dt.date(1990, 3, 1), dt.date(2001, 6, 30)],
    "one": [dt.date(2001, 6, 30)],
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return stored(spark, random_tables(seed=6, size=80, gaps=0.06, fine=0.3), tmp_path_factory.mktemp("series"))


CASES = [(r, "close and far", True) for r in REPORTS] + [
    (receivables.receivables_by_clinic_and_patient, "close and far", False),
    (aging.aging_charges, "close and far", False), (aging.custom_aging_charges, "close and far", False),
    (receivables.receivables_by_patient, "before anything", True), (aging.aging_charges, "one", True),
]


@pytest.mark.parametrize("report, days, inclusive", CASES, ids=lambda v: getattr(v, "__name__", str(v)))
def test_a_series_is_its_days(tables, report, days, inclusive):
    series = report(tables, AsOf.series(DAYS[days], inclusive))
    column = "ar_date" if "ar_date" in series.columns else "as_of"
    found: dict = {day: [] for day in DAYS[days]}
    for row in series.collect():
        found[row[column]].append(tuple(v for c, v in row.asDict().items() if c != "as_of"))
    for day in DAYS[days][1::5] + DAYS[days][-1:]:
        one = report(tables, AsOf.on(day, inclusive))
        assert sorted(map(str, found[day])) == sorted(map(str, map(tuple, one.collect()))), day


def test_rows_are_not_repeated_per_day(tables):
    """Ninety days make no more of a row than its change of buckets does."""
    start = dt.date(2001, 12, 31)
    days = AsOf.series(start + dt.timedelta(d) for d in range(90))
    ledger = ledgers.receivable(tables, days.moving())
    ages = Ages("procdate", AR_EDGES, {})
    changes = _changes(ledger.selectExpr("since", "until", "procdate AS _day", "trantype"), days, ages)
    rows, made = ledger.count(), changes.count()
    assert 0 < made < 4 * rows
    old = changes.where(f"_day < date_sub(DATE'{start}', 121) AND trantype = 'Proc'")
    assert old.count() == ledger.where(f"procdate < date_sub(DATE'{start}', 121) AND trantype = 'Proc'").count() > 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_places_of_days(spark, inclusive):
    days = AsOf.series([START, START + dt.timedelta(3), START + dt.timedelta(4), START + dt.timedelta(40)], inclusive)
    rows = spark.range(-3, 50).selectExpr(f"date_add(DATE'{START}', CAST(id AS INT)) AS day").unionAll(
        spark.sql("SELECT CAST(NULL AS DATE)"))
    for row in rows.selectExpr("day", f"{days.days_until('day')} AS n", f"{days.first_covering('day')} AS place").collect():
        if row.day is None:
            assert row.n is None and row.place is None
        else:
            assert row.n == sum(d <= row.day for d in days.days)
            assert row.place == sum(not (row.day <= d if inclusive else row.day < d) for d in days.days)
