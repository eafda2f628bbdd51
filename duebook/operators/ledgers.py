"""The transaction ledgers: every source a report counts, one row per transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duebook.operators import charges, claims, installments, splits
from duebook.operators.rows import union_all
from duebook.params import AsOf, Period
from duebook.schema import INS_PAY
from duebook.sources.base import Tables


def receivable(tables: Tables, as_of: AsOf, with_clinic: bool = False) -> DataFrame:
    return union_all([
        charges.procedure_charges(tables, as_of, with_clinic),
        claims.claims_receivable(tables, as_of, with_clinic),
        charges.adjustments_by_service(tables, as_of, with_clinic),
        installments.plan_totals(tables, as_of, with_clinic),
        splits.splits_entered(tables, as_of, with_clinic),
    ])


def production(tables: Tables, as_of: AsOf) -> DataFrame:
    return union_all([
        charges.procedure_charges(tables, as_of),
        claims.claims_production(tables, as_of),
        charges.adjustments_by_service(tables, as_of),
        installments.plan_totals(tables, as_of),
        splits.splits_entered(tables, as_of),
    ])


def month(tables: Tables, period: Period) -> DataFrame:
    return union_all([
        charges.procedure_charges(tables, period, with_clinic=True),
        claims.claims_paid(tables, period, with_clinic=True),
        charges.adjustments_by_service(tables, period, with_clinic=True),
        installments.plan_totals(tables, period, with_clinic=True),
        splits.splits_in_period(tables, period, with_clinic=True),
    ])


def listing(tables: Tables, as_of: AsOf) -> list[DataFrame]:
    """The sources one by one, each as its table is laid out."""
    return [
        charges.procedure_charges(tables, as_of, with_clinic=True),
        claims.claims_paid(tables, as_of, with_clinic=True, tag=INS_PAY),
        charges.adjustments_by_service(tables, as_of, with_clinic=True),
        splits.splits_listed(tables, as_of),
    ]


def aging(tables: Tables, as_of: AsOf) -> DataFrame:
    return union_all([
        charges.procedure_charges(tables, as_of, dated=False),
        claims.claims_aging(tables, as_of),
        charges.adjustments_by_entry(tables, as_of),
        splits.splits_paid(tables, as_of),
        installments.plan_charges(tables, as_of),
        installments.plans_completed(tables, as_of),
    ])


def custom_aging(tables: Tables, as_of: AsOf) -> DataFrame:
    return union_all([
        charges.procedure_charges(tables, as_of),
        claims.claim_events(tables, as_of),
        claims.writeoff_estimates(tables, as_of),
        charges.adjustments_by_entry(tables, as_of, dated=True),
        installments.plan_entries(tables, as_of),
        installments.linked_production(tables, as_of, discounted=True),
        splits.splits_earned(tables, as_of),
    ])
