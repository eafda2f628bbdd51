"""Production and collection measures of a ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from duebook.functions.buckets import owed, owing
from duebook.functions.money import ZERO, rounded
from duebook.operators.totals import totals
from duebook.params import AsOf, Period
from duebook.schema import ADJ, CLAIM, PAT_PAY, PLAN_OFFSET, PROC


def _where(condition: str) -> str:
    return f"if({condition}, tranamount, {ZERO})"


def production_measures(
    ledger: DataFrame, scope: AsOf | Period, keys: Sequence[str], net_of_rounded: bool = True
) -> DataFrame:
    """Production, write-offs, adjustments, collections and balances per key, each rounded to
    cents after its sum. The net amounts add up what was rounded, or else are rounded once."""
    adjustment = f"trantype = '{ADJ}'"
    sums = {
        "RawProduction": _where(f"trantype IN ('{PROC}', '{PLAN_OFFSET}')"),
        "TotWo": "woamount",
        "PosAdj": _where(f"{adjustment} AND tranamount > 0"),
        "NegAdj": _where(f"{adjustment} AND tranamount < 0"),
        "TotInsPaymt": _where(f"trantype = '{CLAIM}'"),
        "PatPaymts": _where(f"trantype = '{PAT_PAY}'"),
        "TotBalance": "tranamount",
        "InsAR": "instotest",
        "PPOwed": "payplanamount",
    }
    rows = totals(ledger, scope, keys, sums)
    rows = rows.selectExpr(*(f"{c} + TotWo AS {c}" if c == "TotBalance" else c for c in rows.columns))
    nets = {
        "NetProduction": ["RawProduction", "TotWo", "PosAdj", "NegAdj"],
        "NetCollections": ["TotInsPaymt", "PatPaymts"],
    }
    shown = {name: rounded(name, 2) for name in sums}
    for name, parts in nets.items():
        shown[name] = (" + ".join(rounded(p, 2) for p in parts) if net_of_rounded
                       else rounded(" + ".join(parts), 2))
    account = rounded("TotBalance - InsAR", 2)
    shown["PatAR"], shown["PatAP"] = owed(account), owing(account)
    return rows.selectExpr(*scope.keys, *keys, *(f"{e} AS {name}" for name, e in shown.items()))
