"""Patient payments, split over what they pay for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from duebook.functions.money import ZERO, units
from duebook.operators.rows import ledger_rows, place
from duebook.params import AsOf, Period
from duebook.schema import PAT_PAY, UNEARNED_TYPES
from duebook.sources.base import ON_OPEN_PLAN, Tables


_SPLIT = ("splitnum", "patnum", "payplannum", "datepay", "procdate", "splitamt")


def _splits(tables: Tables, scope: AsOf, *more: str) -> DataFrame:
    return tables.read("paysplit", *_SPLIT, *more, scope=scope).filter("splitamt != 0")


def _on_open_plan(tables: Tables, scope: AsOf | Period, *more: str) -> DataFrame:
    """Splits outside plans or on a plan that is still open."""
    return tables.referring(ON_OPEN_PLAN, *_SPLIT, *more, where="splitamt != 0", scope=scope)


def _rows(splits: DataFrame, keys: Sequence[str], apart: bool = True) -> DataFrame:
    """Ledger rows; ``apart`` keeps payments on plans out of the ordinary amount."""
    paid = f"-{units('splitamt')}"
    return ledger_rows(
        splits, keys, PAT_PAY,
        prikey="splitnum", patnum="patnum", trandate="datepay", procdate="procdate",
        tranamount=f"if(payplannum = 0, {paid}, {ZERO})" if apart else paid,
        payplanamount=f"if(payplannum != 0, {paid}, {ZERO})" if apart else ZERO,
    )


def splits_entered(tables: Tables, as_of: AsOf, with_clinic: bool = False) -> DataFrame:
    """Splits paid, and their payment entered, by the report date; closed plans left out.
    Splits of no payment never match one, so they don't enter the join."""
    splits = _on_open_plan(tables, as_of, "paynum", *place(with_clinic)).filter("paynum != 0").join(
        tables.read("payment", "paynum", "dateentry", scope=as_of), "paynum"
    )
    return _rows(
        as_of.select(splits, "datepay", "dateentry"), [*as_of.keys, *place(with_clinic)]
    )


def splits_in_period(tables: Tables, period: Period, with_clinic: bool = True) -> DataFrame:
    """Splits paid within the window; closed plans left out."""
    splits = _on_open_plan(tables, period, *place(with_clinic))
    return _rows(period.select(splits, "datepay"), place(with_clinic))


def splits_listed(tables: Tables, as_of: AsOf) -> DataFrame:
    """All splits paid by the report date, plans included."""
    splits = as_of.select(_splits(tables, as_of, "clinicnum"), "datepay")
    return _rows(splits, [*as_of.keys, "clinicnum"], apart=False)


def splits_paid(tables: Tables, as_of: AsOf) -> DataFrame:
    """Splits paid by the report date, payments on open and closed plans apart."""
    return _rows(as_of.select(_splits(tables, as_of), "datepay"), as_of.keys)


def splits_earned(
    tables: Tables, as_of: AsOf, unearned: Sequence[int] = UNEARNED_TYPES
) -> DataFrame:
    """Splits paid by the report date that are not of the given unearned-income types."""
    types = ", ".join(map(str, unearned))
    splits = _splits(tables, as_of, "unearnedtype").filter(f"unearnedtype NOT IN ({types})")
    return _rows(as_of.select(splits, "datepay"), as_of.keys, apart=False)
