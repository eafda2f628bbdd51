"""Hand-worked cases, one patient each, read off the reports."""

from __future__ import annotations

import datetime as dt

import pytest

from duebook import AsOf, Period
from duebook.functions.money import DOLLAR
from duebook.operators import balances, claims, ledgers, linked, splits
from duebook.plans import aging, listing, production, receivables
from tests.ledger_rows import Q, arrow_tables, stored

AGES = [0, 30, 31, 60, 61, 90, 91, 120, 121, -1]


def ago(days: int) -> dt.date:
    return Q - dt.timedelta(days=days)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    procedures = [dict(patnum=1, procdate=ago(a), procfee=2**i) for i, a in enumerate(AGES)] + [
        dict(procnum=104, patnum=4),
        dict(procnum=107, patnum=7, procdate=ago(100)),
        dict(procnum=109, patnum=9, procfee=5),
        dict(procnum=110, patnum=10, clinicnum=1),
        dict(procnum=112, patnum=12, procfee=80, unitqty=2, baseunits=1),
        dict(procnum=113, patnum=13, procstatus=1),
        dict(procnum=199, patnum=99, procfee=10),
    ]
    rows = arrow_tables(
        procedurelog=procedures,
        claimproc=[
            dict(patnum=2, inspayest=50),
            dict(patnum=3, datecp=ago(-1), inspayest=30, writeoff=5),
            dict(patnum=3, datecp=ago(-1), inspayest=70, status=4),
            dict(patnum=4, procnum=104, payplannum=9, inspayamt=40, writeoff=10),
            dict(patnum=12, procnum=112, inspayamt=25, writeoff=15),
            dict(patnum=13, procnum=113, inspayamt=60),
            dict(patnum=14, procnum=500, status=0, inspayest=8, writeoff=3),
            dict(patnum=14, procnum=501, status=0, inspayest=8, insesttotaloverride=6,
                 writeoffest=2),
            dict(patnum=14, procnum=502, status=5, inspayamt=9, writeoff=9, inspayest=4,
                 writeoffestoverride=0),
        ],
        claimsnapshot=[dict(claimprocnum=7, writeoff=-1), dict(claimprocnum=8, writeoff=11)],
        adjustment=[
            dict(patnum=7, procnum=107, procdate=ago(100), adjamt=-30),
            dict(patnum=7, procnum=107, procdate=ago(100), adjamt=10),
            dict(patnum=12, procnum=0, adjamt=4),
            dict(patnum=12, procnum=0, adjamt=-1),
        ],
        payplan=[
            dict(payplannum=1, patnum=6, payplandate=Q, completedamt=100),
            dict(payplannum=2, patnum=6, payplandate=Q, completedamt=50, isclosed=1),
        ],
        paysplit=[
            dict(patnum=5, paynum=1, splitamt=20),
            dict(patnum=5, paynum=77, splitamt=21),
            dict(patnum=6, paynum=2, payplannum=1, splitamt=30),
            dict(patnum=6, paynum=2, payplannum=2, splitamt=7),
            dict(patnum=10, paynum=2, clinicnum=2, splitamt=60),
            dict(patnum=12, paynum=2, splitamt=33, unearnedtype=301),
        ],
        payment=[dict(paynum=1, dateentry=ago(-1)), dict(paynum=2)],
        patient=[
            dict(patnum=n, fname=f"F{n}", lname=f"L{n}", middlei=None if n == 9 else "M",
                 clinicnum=3)
            for n in range(1, 15)
        ],
        clinic=[dict(clinicnum=1, description="One")],
    )
    return stored(spark, rows, tmp_path_factory.mktemp("cases"))


def by_patient(rows, *columns):
    return {
        r["patnum"]: tuple(float(r[c]) for c in columns) for r in rows.collect()
    }


PAT = ("Pat_0_30", "Pat_31_60", "Pat_61_90", "Pat_91_120", "PatOver120")
BALANCE = ("TotalArBalance", "TotalApBalance")


@pytest.fixture(scope="module")
def receivable(tables):
    rows = receivables.receivables_by_patient(tables, AsOf.on(Q)).cache()
    yield rows
    rows.unpersist()


@pytest.fixture(scope="module")
def produced(tables):
    rows = production.production_by_patient(tables, AsOf.on(Q)).cache()
    yield rows
    rows.unpersist()


def test_each_date_falls_in_one_bucket(receivable):
    assert by_patient(receivable, *PAT)[1] == (3, 12, 48, 192, 256)


def test_exclusive_date_moves_the_rows_not_the_cut_offs(tables):
    rows = receivables.receivables_by_patient(tables, AsOf.on(Q, inclusive=False))
    assert by_patient(rows, *PAT)[1] == (2, 12, 48, 192, 256)
    next_day = receivables.receivables_by_patient(
        tables, AsOf.on(ago(-1), inclusive=False)
    )
    assert by_patient(next_day, *PAT)[1] == (1, 2 + 4, 8 + 16, 32 + 64, 128 + 256)


def test_claim_that_comes_to_nothing_is_no_row(receivable, produced):
    assert 2 not in by_patient(receivable) and 2 not in by_patient(produced)


def test_only_plain_received_lines_wait_for_a_later_date(receivable):
    found = by_patient(receivable, "InsPayEst", "InsWoEst", "Ins_0_30", *BALANCE)
    assert found[3] == (30, 5, 35, 0, 0)


def test_plan_claim_loses_its_write_off_in_receivables_only(receivable, produced):
    assert by_patient(receivable, *BALANCE)[4] == (90, 0)
    assert by_patient(produced, "TotBalance", "TotWo", "TotInsPaymt")[4] == (100, 0, 0)


def test_late_or_missing_payment_entry(tables, receivable, produced):
    assert 5 not in by_patient(receivable) and 5 not in by_patient(produced)
    month = production.production_by_month_and_patient(tables, Period.between(ago(29), Q))
    assert by_patient(month, "PatPaymts")[5] == (-41,)
    listed = listing.transactions(tables, AsOf.on(ago(-1), inclusive=False))
    assert listed.filter("patnum = 5").count() == 2


def test_closed_plan_payments_count_only_where_plans_are_not_looked_up(tables, receivable):
    assert by_patient(receivable, "TotalPayPlan", *BALANCE)[6] == (70, 0, -150)
    aged = splits.splits_paid(tables, AsOf.on(Q)).filter("patnum = 6")
    assert sorted(r.payplanamount for r in aged.collect()) == [-30 * DOLLAR, -7 * DOLLAR]


def test_attached_credit_takes_the_day_of_its_procedure(tables):
    sums = aging.aging_charges(tables, AsOf.on(Q))
    assert by_patient(sums, "ChargesOver90", "Charges_0_30", "TotalCredits")[7] == (80, 0, 0)


def test_sums_over_groups_equal_sums_over_the_shorter_way(tables):
    as_of = AsOf.on(Q)
    ledger = ledgers.aging(tables, as_of)
    grouped = balances.charge_sums(balances.day_groups(ledger), as_of)
    direct = balances.aged_sums(ledger, as_of)
    assert sorted(grouped.collect()) == sorted(direct.collect())


def test_receivable_sums_skip_the_procedure_step(tables, receivable):
    """One level of sums equals procedures first, patients after."""
    ledger = ledgers.receivable(tables, AsOf.on(Q))
    twice = balances.procedure_summary(ledger).groupBy("patnum").sum("tranamount").collect()
    once = ledger.groupBy("patnum").sum("tranamount").collect()
    assert sorted(twice) == sorted(once)


def test_missing_middle_initial_leaves_no_name(tables):
    rows = aging.aging_of_receivables(tables, AsOf.on(Q)).collect()
    assert [r.patName for r in rows if r.baltotal == 5] == [None]
    named = [r.patName for r in rows if r.patName]
    assert named == sorted(named, key=str.lower) and "L7, F7 M" in named


def test_payments_stay_within_their_clinic(tables):
    rows = receivables.receivables_by_clinic_and_patient(tables, AsOf.on(Q))
    found = {
        r.clinicnum: (r.Pat_0_30, r.TotalApBalance)
        for r in rows.filter("patnum = 10").collect()
    }
    assert found == {1: (100, 0), 2: (0, -60)}


def test_unknown_patients(tables):
    day = AsOf.on(Q)
    assert 99 not in by_patient(aging.custom_aging(tables, day))
    listed = listing.transactions(tables, day).filter("patnum = 99").collect()
    assert [(r.pat_name, r.PriKey) for r in listed] == [(None, 199)]


def test_production_measures(produced):
    found = by_patient(
        produced, "RawProduction", "TotWo", "PosAdj", "NegAdj", "NetProduction", "TotInsPaymt",
        "PatPaymts", "NetCollections", "TotBalance",
    )
    assert found[12] == (240, -15, 4, -1, 228, -25, -33, -58, 170)


def test_claims_need_a_completed_procedure(produced):
    assert 13 not in by_patient(produced)


def test_claim_money_per_procedure(tables):
    rows = {r.procnum: (r.inspay, r.writeoff) for r in linked.claims_by_procedure(tables).collect()}
    assert (rows[500], rows[501], rows[502]) == (
        (-8 * DOLLAR, 0), (-6 * DOLLAR, -2 * DOLLAR), (-4 * DOLLAR, 0))


def test_write_off_estimates_need_a_set_snapshot(tables):
    rows = claims.writeoff_estimates(tables, AsOf.on(Q)).collect()
    assert [(r.prikey, r.tranamount) for r in rows] == [(8, -11 * DOLLAR)]


def test_unearned_types_are_a_parameter(tables):
    day = AsOf.on(Q)
    assert splits.splits_earned(tables, day).filter("patnum = 12").count() == 0
    assert splits.splits_earned(tables, day, unearned=[7]).filter("patnum = 12").count() == 1


def test_listing_of_one_clinic(tables):
    rows = listing.transactions(tables, AsOf.on(Q), clinic=2).collect()
    assert [(r.patnum, r.clinicnum) for r in rows] == [(10, 2)]


def test_clinic_without_a_name(tables):
    rows = receivables.receivables_by_clinic(tables, AsOf.on(Q)).collect()
    assert {r.clinicnum: r.ClinicName for r in rows}[1] == "One"
    assert {r.clinicnum: r.ClinicName for r in rows}[2] is None


def test_parts_of_a_cent_are_rounded_after_the_sum(spark, tmp_path):
    """A thousand fees of 0.004 are 4.00; one is below what any report shows."""
    tables = stored(spark, arrow_tables(
        procedurelog=[dict(patnum=1, procfee=0.004) for _ in range(1000)] + [
            dict(patnum=2, procfee=0.004), dict(patnum=3, procfee=0.0045), dict(patnum=4, procfee=0.005)],
        patient=[dict(patnum=i, fname=f"F{i}", lname=f"L{i}") for i in (1, 2, 3, 4)],
    ), tmp_path)
    day = AsOf.on(Q)
    owed = {r.patnum: r.TotalArBalance for r in receivables.receivables_by_patient(tables, day).collect()}
    assert {k: float(v) for k, v in owed.items()} == {1: 4.0, 4: 0.01}
    made = {r.patnum: float(r.RawProduction) for r in production.production_by_patient(tables, day).collect()}
    assert made == {1: 4.0, 2: 0.0, 3: 0.0, 4: 0.01}
    aged = {r.patName.split(",")[0]: float(r.bal_0_30) for r in aging.aging_of_receivables(tables, day).collect()}
    assert aged == {"L1": 4.0, "L3": 0.005, "L4": 0.005}


def test_an_empty_procedure_is_kept_in_the_aging(spark, tmp_path):
    tables = stored(spark, arrow_tables(adjustment=[
        dict(patnum=1, procnum=None, adjamt=40), dict(patnum=1, procnum=0, adjamt=7),
        dict(patnum=1, procnum=None, adjamt=-5, procdate=ago(200)),
    ]), tmp_path)
    day = AsOf.on(Q)
    ledger = ledgers.aging(tables, day)
    whole = balances.charge_sums(balances.day_groups(ledger), day).collect()
    assert balances.aged_sums(ledger, day).collect() == whole
    assert whole[0].BalTotal == 42 * DOLLAR and whole[0].Charges_0_30 == 42 * DOLLAR
