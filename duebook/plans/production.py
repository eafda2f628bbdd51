"""Production, adjustments and collections, over all time or by month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.money import dollars, in_dollars, wide_sum
from duebook.operators import ledgers
from duebook.operators.measures import production_measures
from duebook.params import AsOf, Period
from duebook.sources.base import Tables

MEASURES = (
    "RawProduction", "TotWo", "PosAdj", "NegAdj", "NetProduction", "TotInsPaymt", "PatPaymts",
    "NetCollections", "TotBalance", "InsAR", "PatAR", "PatAP", "PPOwed",
)
MONTH_MEASURES = tuple(m for m in MEASURES if m not in ("InsAR", "PatAR", "PatAP"))
# Fixed value: the totals spell the patient payments column PayPaymts.
_TOTAL_NAMES = {m: "PayPaymts" if m == "PatPaymts" else m for m in MEASURES}


def _totals(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    sums = (f"{dollars(wide_sum(m))} AS {_TOTAL_NAMES[m]}" for m in measures)
    return rows.groupBy(*keys).agg(*map(F.expr, sums))


def _per_patient(tables: Tables, as_of: AsOf) -> DataFrame:
    rows = production_measures(ledgers.production(tables, as_of.moving()), as_of, ["patnum"])
    return rows.select(*as_of.keys, "patnum", *MEASURES)


def production_by_patient(tables: Tables, as_of: AsOf) -> DataFrame:
    return in_dollars(_per_patient(tables, as_of), *MEASURES)


def production_total(tables: Tables, as_of: AsOf) -> DataFrame:
    """One row of totals, or one per day of a series."""
    return _totals(_per_patient(tables, as_of), as_of.keys, MEASURES)


def _per_month(tables: Tables, period: Period) -> DataFrame:
    keys = ["TranMonth", "clinicnum", "patnum"]
    ledger = ledgers.month(tables, period).selectExpr(
        "*", "date_format(trandate, 'yyyy-MM') AS TranMonth"
    )
    measures = production_measures(ledger, period, keys, net_of_rounded=False)
    return measures.select(*keys, *MONTH_MEASURES)


def production_by_month_and_patient(tables: Tables, period: Period) -> DataFrame:
    return in_dollars(_per_month(tables, period), *MONTH_MEASURES)


def production_by_month(tables: Tables, period: Period) -> DataFrame:
    """Totals per month and clinic. The name is looked up after the summing."""
    totals = _totals(_per_month(tables, period), ["TranMonth", "clinicnum"], MONTH_MEASURES)
    clinics = tables.read("clinic", "clinicnum", "description")
    return totals.join(clinics, "clinicnum", "left").selectExpr(
        "TranMonth", "clinicnum AS ClinicNum", "description AS ClinicName",
        *(_TOTAL_NAMES[m] for m in MONTH_MEASURES),
    )
