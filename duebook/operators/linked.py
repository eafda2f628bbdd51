"""Money per procedure or adjustment, summed before it is joined to a plan link. ``among``
restricts the rows to the keys of a frame before they are grouped: the few that plans link
to, out of all facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.money import ZERO, units
from duebook.schema import CAP_COMPLETE, PREAUTH, RECEIVED, SUPPLEMENTAL, UNSET
from duebook.sources.base import Tables

# Statuses whose actual amounts stand in place of estimates.
SETTLED = (RECEIVED, SUPPLEMENTAL, CAP_COMPLETE)


def adjustment_by_procedure(tables: Tables) -> DataFrame:
    """Adjustments per procedure, patient, provider and clinic."""
    where = ("procnum", "patnum", "provnum", "clinicnum")
    rows = tables.read("adjustment", *where, "adjamt")
    return rows.groupBy(*where).agg(F.expr(f"sum({units('adjamt')}) AS adjamt"))


def _restricted(rows: DataFrame, key: str, among: DataFrame | None) -> DataFrame:
    return rows if among is None else rows.join(among.select(key), key, "left_semi")


def _settled_or(actual: str, guess: str) -> str:
    return f"coalesce(if(status IN {SETTLED}, {actual}, {guess}), 0)"


def _if_set(amount: str) -> str:
    return f"nullif({amount}, {UNSET})"


def claims_by_procedure(tables: Tables, among: DataFrame | None = None) -> DataFrame:
    """Insurance money per procedure, negative: actual amounts of settled lines, for the
    others the override, else the estimate."""
    rows = tables.read(
        "claimproc", "procnum", "status", "inspayamt", "inspayest", "writeoff",
        "insesttotaloverride", "writeoffest", "writeoffestoverride", by=None if among is None else "procnum",
    ).filter(f"status != {PREAUTH}")
    pay = _settled_or("inspayamt", f"coalesce({_if_set('insesttotaloverride')}, inspayest)")
    writeoff = _settled_or(
        "writeoff", f"coalesce({_if_set('writeoffestoverride')}, {_if_set('writeoffest')})"
    )
    return _restricted(rows, "procnum", among).groupBy("procnum").agg(
        F.expr(f"sum(-{units(pay)}) AS inspay"), F.expr(f"sum(-{units(writeoff)}) AS writeoff")
    )


def splits_by(tables: Tables, key: str, among: DataFrame | None = None) -> DataFrame:
    """Payments outside plans per procedure (``procnum``) or adjustment (``adjnum``),
    negative."""
    rows = tables.read("paysplit", key, "payplannum", "splitamt", by=None if among is None else key).filter("payplannum = 0")
    return _restricted(rows, key, among).groupBy(key).agg(
        F.expr(f"sum(-coalesce({units('splitamt')}, {ZERO})) AS splitamt")
    )
