"""Completed procedures and adjustments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duebook.functions.money import units
from duebook.operators.rows import ledger_rows, place
from duebook.params import AsOf, Period
from duebook.schema import ADJ, COMPLETE, PROC
from duebook.sources.base import Tables

# Fee in money units times the units billed.
GROSS_FEE = f"{units('procfee')} * (unitqty + baseunits)"


def procedure_charges(
    tables: Tables, scope: AsOf | Period, with_clinic: bool = False, dated: bool = True
) -> DataFrame:
    """Completed procedures with a fee. Undated, rows after the report date stay in and
    are cut where the amounts are summed."""
    rows = tables.read(
        "procedurelog", "procnum", "patnum", *place(with_clinic), "procdate", "procfee",
        "unitqty", "baseunits", "procstatus", scope=scope if dated else None,
    ).filter(f"procstatus = {COMPLETE} AND procfee != 0")
    rows = scope.select(rows, "procdate") if dated else scope.spread(rows)
    return ledger_rows(
        rows, [*scope.keys, *place(with_clinic)], PROC,
        prikey="procnum", patnum="patnum", trandate="procdate", procdate="procdate",
        tranamount=GROSS_FEE,
    )


def adjustments_by_service(
    tables: Tables, scope: AsOf | Period, with_clinic: bool = False
) -> DataFrame:
    """Adjustments dated by the procedure they belong to."""
    rows = tables.read(
        "adjustment", "adjnum", "procnum", "patnum", *place(with_clinic), "procdate", "adjamt", scope=scope
    ).filter("adjamt != 0")
    return ledger_rows(
        scope.select(rows, "procdate"), [*scope.keys, *place(with_clinic)], ADJ,
        prikey="adjnum", procnum="procnum", patnum="patnum", trandate="procdate",
        procdate="procdate", tranamount=units("adjamt"),
    )


def adjustments_by_entry(tables: Tables, as_of: AsOf, dated: bool = False) -> DataFrame:
    """Adjustments dated by their own day; the procedure travels along as the aged one."""
    rows = tables.read(
        "adjustment", "adjnum", "procnum", "patnum", "adjdate", "procdate", "adjamt"
    ).filter("adjamt != 0")
    rows = as_of.select(rows, "adjdate") if dated else as_of.spread(rows)
    return ledger_rows(
        rows, as_of.keys, ADJ,
        prikey="adjnum", procnum="procnum", patnum="patnum", trandate="adjdate",
        procdate="procdate", tranamount=units("adjamt"), agedprocnum="procnum",
        agedprocdate="procdate",
    )
