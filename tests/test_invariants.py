"""What must hold between the reports, over the test tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest

import __spark_entry__ as contract
from duebook import AsOf, FrameTables
from trade_tables import TradeTables
from duebook.functions.buckets import age_bucket, allocate_oldest_first
from duebook.functions.keys import duplicate_keys
from duebook.plans import aging, listing, production, receivables
from duebook.schema import TABLES
from tests.ledger_rows import random_tables, stored

Q = dt.date(2001, 6, 30)


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    def pandas(name):
        return contract.queries()[name](spark, sf_dir).toPandas()

    return {n: pandas(n) for n in (
        "r01_ar_detailed", "r02_ar_summary", "r03_ar_detailed_clinic", "r04_ar_summary_clinic",
        "r05_prod_detailed", "r06_prod_summary", "r07_prod_month_detailed",
        "r08_prod_month_summary",
    )}


@pytest.mark.parametrize("detail, total", [
    ("r01_ar_detailed", "r02_ar_summary"), ("r03_ar_detailed_clinic", "r04_ar_summary_clinic"),
    ("r05_prod_detailed", "r06_prod_summary"),
    ("r07_prod_month_detailed", "r08_prod_month_summary"),
])
def test_totals_add_up_their_detail(frames, detail, total):
    rows = frames[detail].rename(columns={"PatPaymts": "PayPaymts"})
    measures = [c for c in frames[total].columns if c in rows and rows[c].dtype == float
                and c.lower() != "clinicnum"]
    assert len(measures) > 8
    for measure in measures:
        assert rows[measure].sum() == pytest.approx(frames[total][measure].sum(), abs=0.01)


def test_receivable_identities(frames):
    rows = frames["r01_ar_detailed"]
    ins = rows[["InsOver120", "Ins_91_120", "Ins_61_90", "Ins_31_60", "Ins_0_30"]].sum(axis=1)
    assert (ins - rows.InsPayEst - rows.InsWoEst).abs().max() < 0.005


def test_production_identities(frames):
    rows = frames["r05_prod_detailed"]
    assert (rows.PatAR + rows.PatAP - (rows.TotBalance - rows.InsAR)).abs().max() < 0.005


def test_the_reports_differ_by_the_write_offs_of_plan_claims(spark, sf_dir, frames):
    ar = frames["r01_ar_detailed"]
    ar_total = (ar.TotalArBalance + ar.TotalApBalance).sum()
    claims = contract.queries()["s02_claimproc"](spark, sf_dir)
    work = contract.queries()["s01_procedurelog"](spark, sf_dir).filter("procstatus = 2")
    plan_claims = claims.filter(
        f"payplannum != 0 AND status IN (1, 4, 5, 7) AND datecp <= DATE'{Q}' "
        f"AND procdate <= DATE'{Q}'"
    ).join(work, "procnum", "left_semi")
    lost = plan_claims.groupBy().sum("writeoff").collect()[0][0]
    assert lost > 0
    assert frames["r05_prod_detailed"].TotBalance.sum() - ar_total == pytest.approx(lost, abs=0.01)


def test_inclusive_day_equals_exclusive_next_day(spark, sf_dir):
    columns = ["patnum", "TotalArBalance", "TotalApBalance", "TotalPayPlan", "InsPayEst", "InsWoEst"]
    tables = TradeTables(spark, sf_dir)
    on = receivables.receivables_by_patient(tables, AsOf.on(Q))
    before = receivables.receivables_by_patient(
        tables, AsOf.on(Q + dt.timedelta(days=1), inclusive=False)
    )
    assert sorted(on.select(columns).collect()) == sorted(before.select(columns).collect())


def test_series_equals_single_days(spark, sf_dir):
    days = [dt.date(2000, 12, 31), dt.date(2001, 3, 31), Q]
    tables = TradeTables(spark, sf_dir)
    series = production.production_total(tables, AsOf.series(days))
    by_day = {r["as_of"]: tuple(r)[1:] for r in series.collect()}
    for day in days:
        assert by_day[day] == tuple(production.production_total(tables, AsOf.on(day)).collect()[0])


@pytest.mark.parametrize("report", [
    receivables.receivables_by_clinic, listing.transactions, aging.aging_of_receivables,
    aging.aging_day_groups, aging.custom_aging, aging.custom_aging_charges,
])
def test_series_of_any_report(spark, tmp_path, report):
    days = [dt.date(2001, 5, 31), Q]
    tables = stored(spark, random_tables(seed=4, size=60), tmp_path)
    series = report(tables, AsOf.series(days))
    column = "ar_date" if "ar_date" in series.columns else "as_of"
    for day in days:
        one = report(tables, AsOf.on(day))
        part = series.filter(f"{column} = DATE'{day}'").select(
            *(f"`{c}`" for c in one.columns)
        )
        assert sorted(map(str, part.collect())) == sorted(map(str, one.collect()))


def test_keys_are_unique(spark, sf_dir):
    tables = TradeTables(spark, sf_dir)
    for name, columns in TABLES.items():
        key = next(iter(columns))
        assert duplicate_keys(tables.read(name, key), key).isEmpty(), name
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "clinicnum long, description string")
    twice = FrameTables({"clinic": rows}).read("clinic", "clinicnum")
    assert [tuple(r) for r in duplicate_keys(twice, "clinicnum").collect()] == [(1, 2)]


def literal_rule(buckets, pay):
    """The allocation told bucket by bucket (oldest first)."""
    result, older = [], 0
    for position, bucket in enumerate(buckets):
        spent = pay < older if position >= len(buckets) - 2 else pay <= older
        if position and spent:
            result.append(bucket)
        elif older + bucket <= pay:
            result.append(0)
        else:
            result.append(older + bucket - pay)
        older += bucket
    return result


@pytest.mark.parametrize("count", [4, 5])
def test_allocation(spark, count):
    r = random.Random(count)
    cases = [[r.randint(-9, 9) for _ in range(count)] for _ in range(3000)]
    cases = [(*c, r.choice([sum(c[:r.randint(0, count)]), r.randint(-9, 40)])) for c in cases]
    names = [f"b{i}" for i in range(count)]
    rows = spark.createDataFrame(cases, ", ".join(f"{n} long" for n in [*names, "pay"]))
    got = rows.selectExpr("*", *(
        f"{e} AS o{i}" for i, e in enumerate(allocate_oldest_first("pay", names))
    )).collect()
    for row in got:
        buckets, pay, result = row[:count], row[count], list(row[count + 1:])
        assert result == literal_rule(buckets, pay), (buckets, pay)
        if min(buckets) >= 0 and pay >= 0:
            assert sum(result) == max(0, sum(buckets) - pay)


def test_allocation_leaves_a_young_negative_bucket(spark):
    rows = spark.sql("SELECT 3L a, 5L b, 7L c, 2L d, -8L e, 16L pay")
    exprs = allocate_oldest_first("pay", list("abcde"))
    assert list(rows.selectExpr(*exprs).collect()[0]) == [0, 0, 0, 1, -8]


def test_buckets_cover_every_day_once(spark):
    bucket = age_bucket("day", f"DATE'{Q}'", (30, 60, 90, 120))
    rows = spark.range(-5, 400).selectExpr("id", f"date_sub(DATE'{Q}', CAST(id AS INT)) AS day")
    for row in rows.selectExpr("id", f"{bucket} AS bucket").collect():
        assert row.bucket == max(0, min(4, (row.id - 1) // 30))


def test_totals_of_the_larger_tables(spark):
    """Sums stated in FIXTURES.md for sf0.01."""
    row = contract.queries()["r02_ar_summary"](spark, "/root/testdata/sf0.01").collect()[0]
    assert row.TotalArBalance == 728020038.86 and row.TotalApBalance == -19510155.22
    assert row.PatOver120 == 533281827.09 and row.Pat_0_30 == 12986405.06
    assert row.InsOver120 == 148625260.26 and row.TotalPayPlan == -11009874.17
    assert row.InsPayEst == 133775065.01 and row.InsWoEst == 24322740.96
