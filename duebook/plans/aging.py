"""The two aging reports: open balances by age per patient, sorted by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duebook.functions.money import DOLLAR, dollars, in_dollars, rounded
from duebook.operators import ledgers
from duebook.operators.balances import (
    CHARGE_BUCKETS, OPEN_BUCKETS, aged_sums, charge_sums, clamped, day_groups, open_balances, signed_sums,
)
from duebook.params import AsOf
from duebook.schema import LEDGER_MONEY
from duebook.sources.base import Tables

_ESTIMATES = ("BalTotal", "InsWoEst", "InsPayEst", "PayPlanDue")


# Fixed value: half a cent, from which a bucket is shown.
_MATERIAL = DOLLAR * 5 // 1000


def _any_bucket(test: str) -> str:
    return " OR ".join(f"{b} {test}" for b in OPEN_BUCKETS)


def _by_name(rows: DataFrame, as_of: AsOf) -> DataFrame:
    return rows.selectExpr("*", "lower(lname) AS l", "lower(fname) AS f").orderBy(
        *as_of.keys, "l", "f", "patnum"
    )


def aging_ledger(tables: Tables, as_of: AsOf) -> DataFrame:
    """The transactions behind the A/R aging."""
    return in_dollars(ledgers.aging(tables, as_of), *LEDGER_MONEY)


def aging_day_groups(tables: Tables, as_of: AsOf) -> DataFrame:
    """The transactions per patient, day and kind."""
    groups = day_groups(ledgers.aging(tables, as_of), as_of.keys)
    return in_dollars(groups, "tranamount", "payplanamount", "inswoest", "inspayest")


def aging_charges(tables: Tables, as_of: AsOf, clamp: bool = False) -> DataFrame:
    """Charges by age and credits per patient, negative buckets kept or turned to credit."""
    sums = aged_sums(ledgers.aging(tables, as_of.moving()), as_of)
    sums = clamped(sums) if clamp else sums
    return in_dollars(sums, *CHARGE_BUCKETS, "TotalCredits", *_ESTIMATES)


def _aged(tables: Tables, as_of: AsOf) -> DataFrame:
    return _opened(aged_sums(ledgers.aging(tables, as_of.moving()), as_of), as_of)


def _opened(sums: DataFrame, as_of: AsOf) -> DataFrame:
    return open_balances(clamped(sums)).selectExpr(
        *as_of.keys, "patnum", *reversed(OPEN_BUCKETS),
        *(f"{rounded(e, 3)} AS {e}" for e in _ESTIMATES),
    )


def _aged_groups(groups: DataFrame, as_of: AsOf) -> DataFrame:
    """The same from day groups that say since when and until when they count."""
    return _opened(charge_sums(groups if as_of.many else groups.filter(as_of.counting), as_of), as_of)


def aging_balances(tables: Tables, as_of: AsOf) -> DataFrame:
    """Open balances by age per patient, before names and the materiality test."""
    return in_dollars(_aged(tables, as_of), *OPEN_BUCKETS, *_ESTIMATES)


def balances_of(groups: DataFrame, as_of: AsOf) -> DataFrame:
    return in_dollars(_aged_groups(groups, as_of), *OPEN_BUCKETS, *_ESTIMATES)


def aging_of_receivables(tables: Tables, as_of: AsOf) -> DataFrame:
    """Patients with at least half a cent open in some bucket."""
    return _shown(_aged(tables, as_of), tables, as_of)


def receivables_of(groups: DataFrame, tables: Tables, as_of: AsOf) -> DataFrame:
    return _shown(_aged_groups(groups, as_of), tables, as_of)


def _shown(balances: DataFrame, tables: Tables, as_of: AsOf) -> DataFrame:
    people = tables.read("patient", "patnum", "lname", "fname", "middlei", by="patnum")
    rows = balances.filter(_any_bucket(f">= {_MATERIAL}")).join(people, "patnum")
    shown = (*OPEN_BUCKETS, "BalTotal", "InsWoEst", "InsPayEst")
    return _by_name(rows, as_of).selectExpr(
        *as_of.keys, "concat(lname, ', ', fname, ' ', middlei) AS patName",
        *(f"{dollars(c)} AS {c.lower()}" for c in shown),
        f"{dollars('BalTotal - InsPayEst - InsWoEst')} AS `$pat`",
    )


def custom_aging_charges(tables: Tables, as_of: AsOf) -> DataFrame:
    """Charges and credits by age per patient, known patients only."""
    sums = signed_sums(ledgers.custom_aging(tables, as_of.moving()), as_of)
    known = sums.join(tables.read("patient", "patnum"), "patnum", "left_semi")
    return in_dollars(known, *(c for c in sums.columns if c not in (*as_of.keys, "patnum")))


def custom_aging(tables: Tables, as_of: AsOf) -> DataFrame:
    """Patients who owe money on balance, with some bucket open. Names are joined to the
    summed rows; that join also drops transactions of unknown patients."""
    sums = signed_sums(ledgers.custom_aging(tables, as_of.moving()), as_of)
    total = rounded("TotalCharges - TotalCredits", 3)
    rows = open_balances(sums).filter(f"({_any_bucket('!= 0')}) AND {total} > 0")
    people = tables.read("patient", "patnum", "fname", "lname")
    return _by_name(rows.join(people, "patnum"), as_of).selectExpr(
        *as_of.keys, "fname", "lname", "patnum",
        *(f"{dollars(b)} AS {b}" for b in OPEN_BUCKETS),
        f"{dollars(total)} AS BalTotal",
    )
