"""Accounts receivable: who owes what, by age, as of a date or a series of dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.money import dollars, in_dollars, wide_sum
from duebook.operators import ledgers
from duebook.operators.balances import (
    INS_BUCKETS, PAT_BUCKETS, open_receivables, receivable_sums,
)
from duebook.params import AsOf
from duebook.sources.base import Tables

AMOUNTS = (
    *reversed(INS_BUCKETS), *reversed(PAT_BUCKETS), "TotalArBalance", "TotalApBalance",
    "TotalPayPlan", "InsPayEst", "InsWoEst",
)
_TOTALS = [f"{dollars(wide_sum(a))} AS {a}" for a in AMOUNTS]


def _per_patient(tables: Tables, as_of: AsOf, by_clinic: bool = False) -> DataFrame:
    place = ["clinicnum"] if by_clinic else []
    ledger = ledgers.receivable(tables, as_of.moving(), with_clinic=by_clinic)
    return open_receivables(receivable_sums(ledger, as_of, place), [*as_of.keys, *place])


def receivables_by_patient(tables: Tables, as_of: AsOf) -> DataFrame:
    return in_dollars(_per_patient(tables, as_of), *AMOUNTS)


def receivables_total(tables: Tables, as_of: AsOf) -> DataFrame:
    """One row of totals, or one per day of a series."""
    return _per_patient(tables, as_of).groupBy(*as_of.keys).agg(*map(F.expr, _TOTALS))


def receivables_by_clinic_and_patient(tables: Tables, as_of: AsOf) -> DataFrame:
    """Payments meet charges within the same clinic only."""
    return _per_patient(tables, as_of, by_clinic=True).selectExpr(
        f"{as_of.date} AS ar_date", "clinicnum", "patnum",
        *(f"{dollars(a)} AS {a}" for a in AMOUNTS),
    )


def receivables_by_clinic(tables: Tables, as_of: AsOf) -> DataFrame:
    """Totals per clinic. The name is looked up once per clinic, after the summing."""
    rows = _per_patient(tables, as_of, by_clinic=True)
    totals = rows.groupBy(*as_of.keys, "clinicnum").agg(*map(F.expr, _TOTALS))
    clinics = tables.read("clinic", "clinicnum", "description")
    return totals.join(clinics, "clinicnum", "left").selectExpr(
        f"{as_of.date} AS ar_date", "clinicnum", "description AS ClinicName", *AMOUNTS
    )
