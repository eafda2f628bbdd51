"""Tables in one folder per month."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from duebook import AsOf, MonthTables, Period
from duebook.operators import charges, claims, splits
from duebook.schema import DATES, TABLES
from duebook.sources import write_months
from duebook.sources.months import MONTH
from tests.ledger_rows import random_tables, stored
from tests.test_plans import plan

BUILDS = contract.builds()


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    return stored(spark, random_tables(seed=12, gaps=0.05), tmp_path_factory.mktemp("plain"))


@pytest.fixture
def months(spark, source, tmp_path):
    write_months(source, str(tmp_path))
    return MonthTables(spark, str(tmp_path))


def test_reports_are_the_same(source, months):
    for name in ("l04_claim_month", "l21_patpay_month", "r01_ar_detailed", "r07_prod_month_detailed", "r08_prod_month_totals",
                 "r09_transactions", "r12_aging_of_ar", "r13_custom_aging", "r14_ar_series"):
        matching = [n for n in BUILDS if n.split("_")[0] == name.split("_")[0]]
        assert matching, name
        for n in matching:
            want, got = BUILDS[n](source), BUILDS[n](months)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), n


def test_tables_are_whole(source, months):
    """Rows without a date too."""
    for name, columns in TABLES.items():
        want, got = source.read(name, *columns), months.read(name, *columns)
        assert got.exceptAll(want).isEmpty() and got.count() == want.count(), name


def _windowed(tables, scope):
    found = [charges.procedure_charges(tables, scope, with_clinic=True),
             charges.adjustments_by_service(tables, scope, with_clinic=True)]
    if isinstance(scope, Period):
        found.append(splits.splits_in_period(tables, scope))
    else:
        found += [splits.splits_listed(tables, scope), splits.splits_paid(tables, scope), claims.claim_events(tables, scope)]
    return found


@pytest.mark.parametrize("kind", ["period", "day", "exclusive"])
def test_other_months_are_not_read(source, months, tmp_path, kind):
    """Their files are spoilt here: a task that opened one would fail."""
    dates = [r[0] for r in source.read("procedurelog", "procdate").filter("procdate IS NOT NULL").distinct().sort("procdate").collect()]
    middle = dates[len(dates) // 2]
    first = middle.replace(day=1)
    scope = {"period": Period.between(first, middle), "day": AsOf.on(middle), "exclusive": AsOf.on(middle, inclusive=False)}[kind]
    want = [sorted(map(str, rows.collect())) for rows in _windowed(source, scope)]
    assert any(want)
    for name in DATES:
        months.frame(name, ())  # its schema, from a file
    kept, spoilt = middle.year * 100 + middle.month, 0
    for file in tmp_path.glob(f"*/{MONTH}=*/*.parquet"):
        month = re.search(rf"{MONTH}=(\w+)", str(file)).group(1)
        outside = not month.isdigit() or int(month) > kept or (kind == "period" and int(month) < kept)
        if outside and file.parts[-3] != "payplan":
            Path(file).write_bytes(b"spoilt")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            spoilt += 1
    assert spoilt > 3
    assert [sorted(map(str, rows.collect())) for rows in _windowed(months, scope)] == want


def test_a_window_is_a_partition_filter(months):
    text = plan(claims.claims_paid(months, Period.between("2024-02-01", "2024-03-31"), with_clinic=True))
    lines = [x for x in text.splitlines() if "PartitionFilters" in x and MONTH in x]
    assert lines and all("202402" in x and "202403" in x for x in lines)
