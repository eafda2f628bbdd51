"""Sums of a ledger per patient, aged into buckets. Every sum is a plain aggregation over
the ledger, so tasks combine their rows before the shuffle and a patient, clinic or day
with a large share of the rows arrives as one partial row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.buckets import allocate_oldest_first, owed, owing
from duebook.functions.money import ZERO, rounded
from duebook.operators.rows import union_all
from duebook.operators.totals import Ages, totals
from duebook.params import AsOf
from duebook.schema import (
    ADJ, AGING_EDGES, AR_EDGES, CLAIM, PAT_PAY, PLAN_OFFSET, PROC, PROC_AND_DATE, PROC_SUM,
    WRITEOFF_ORIG,
)

# Bucket names, youngest first as age_bucket counts them.
INS_BUCKETS = ("Ins_0_30", "Ins_31_60", "Ins_61_90", "Ins_91_120", "InsOver120")
PAT_BUCKETS = ("Pat_0_30", "Pat_31_60", "Pat_61_90", "Pat_91_120", "PatOver120")
CHARGE_BUCKETS = ("Charges_0_30", "Charges_31_60", "Charges_61_90", "ChargesOver90")
CREDIT_BUCKETS = ("Credits_0_30", "Credits_31_60", "Credits_61_90", "CreditsOver90")
OPEN_BUCKETS = ("Bal_0_30", "Bal_31_60", "Bal_61_90", "BalOver90")


# True or false for every row, a NULL procedure included.
_UNATTACHED = "agedprocnum <=> 0"


def _sums(rows: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*map(F.expr, sums))


def procedure_summary(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The receivable ledger per patient, service day and procedure, the charge, claim and
    adjustment rows of a procedure taken together."""
    together = f"trantype IN ('{PROC}', '{CLAIM}') OR trantype = '{ADJ}' AND procnum != 0"
    amounts = ("tranamount", "payplanamount", "instotest", "inspayest", "inswoest")
    rows = ledger.selectExpr(
        *keys, "patnum", "procdate", "procnum", *amounts,
        f"if({together}, '{PROC_SUM}', trantype) AS trantype",
    )
    return _sums(
        rows, [*keys, "patnum", "procdate", "trantype", "procnum"],
        [f"sum({a}) AS {a}" for a in amounts],
    )


def receivable_sums(ledger: DataFrame, as_of: AsOf, keys: Sequence[str] = ()) -> DataFrame:
    """Expected insurance money and patient charges by age, payments, balance and plan
    money per patient. The sums are linear and their tests read only what a procedure's
    rows share, so they are taken straight from the ledger, without the step above."""
    charged = f"trantype IN ('{PROC}', '{CLAIM}', '{ADJ}', '{PLAN_OFFSET}')"
    amounts = {
        "TotalPayments": f"if(trantype = '{PAT_PAY}', -tranamount, {ZERO})",
        "TotalBalance": "tranamount", "TotalPayPlan": "payplanamount", "InsPayEst": "inspayest",
        "InsWoEst": "inswoest",
    }
    ages = Ages("procdate", AR_EDGES, {
        "instotest": INS_BUCKETS, f"if({charged}, tranamount - instotest, {ZERO})": PAT_BUCKETS,
    })
    sums = totals(ledger, as_of, [*keys, "patnum"], amounts, ages)
    return sums.selectExpr(
        *as_of.keys, *keys, "patnum", *INS_BUCKETS, *PAT_BUCKETS, "TotalPayments",
        f"{rounded('TotalBalance', 2)} AS TotalBalance", "TotalPayPlan", "InsPayEst", "InsWoEst",
    )


def open_receivables(sums: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Patients with something open, their payments applied to the oldest charges first."""
    kept = sums.filter("TotalBalance != 0 OR InsPayEst + InsWoEst != 0 OR TotalPayPlan != 0")
    return kept.selectExpr(
        *keys, "patnum", *reversed(INS_BUCKETS),
        *_allocated(PAT_BUCKETS, PAT_BUCKETS, "TotalPayments", 2),
        f"{owed('TotalBalance')} AS TotalArBalance",
        f"{owing('TotalBalance')} AS TotalApBalance",
        "TotalPayPlan", "InsPayEst", "InsWoEst",
    )


def day_groups(ledger: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The aging ledger per patient, day and kind of row; rows attached to a procedure are
    put together per procedure and day. Where such a group comes to a credit it takes the
    day of the procedure, which only the finished sum can tell. A NULL procedure is not
    "none": its rows make a group of their own, which keeps its day."""
    amounts = ("tranamount", "payplanamount", "inswoest", "inspayest")
    rows = ledger.selectExpr(
        *keys, "patnum", "agedprocnum", "agedprocdate", "trandate", *amounts,
        f"if({_UNATTACHED}, trantype, '{PROC_AND_DATE}') AS trantype",
        f"if({_UNATTACHED}, if(tranamount < 0, -1, 1), 0) AS side",
    )
    groups = _sums(
        rows, [*keys, "patnum", "agedprocnum", "trandate", "trantype", "side"],
        [*(f"sum({a}) AS {a}" for a in amounts), "min(agedprocdate) AS agedprocdate"],
    )
    shifted = "agedprocnum != 0 AND tranamount < 0"
    return groups.selectExpr(
        *keys, "trantype", f"{ZERO} AS prikey", "patnum",
        f"if({shifted}, agedprocdate, trandate) AS trandate", *amounts,
    )


def aged_sums(ledger: DataFrame, as_of: AsOf) -> DataFrame:
    """Charges by age, credits, balance and estimates per patient over the day groups.

    Rows attached to nothing keep their day, and a group of them holds one sign only, so
    summing the rows equals summing their groups. Only the attached adjustments go
    through the grouping; the bulk of the ledger is shuffled once, as partial sums.
    """
    free = ledger.filter(_UNATTACHED)
    marks = as_of.moving().keys
    attached = day_groups(ledger.filter(f"NOT ({_UNATTACHED})"), marks)
    used = [*marks, "trantype", "patnum", "trandate", "tranamount", "payplanamount", "inswoest",
            "inspayest"]
    return charge_sums(union_all([free.select(*used), attached.select(*used)]), as_of)


def charge_sums(groups: DataFrame, as_of: AsOf) -> DataFrame:
    """Charges by age, credits, balance and estimates per patient."""
    whole = f"trantype IN ('{WRITEOFF_ORIG}', '{PROC_AND_DATE}')"
    estimates = {"InsWoEst": "inswoest", "InsPayEst": "inspayest", "PayPlanDue": "payplanamount"}
    ages = Ages(
        "trandate", AGING_EDGES,
        {f"if(tranamount > 0 OR {whole}, tranamount, {ZERO})": CHARGE_BUCKETS}, cut=True,
        reached={"TotalCredits": f"if(tranamount < 0 AND NOT {whole}, -tranamount, {ZERO})",
                 "BalTotal": "tranamount"},
    )
    return totals(groups, as_of, ["patnum"], estimates, ages).select(
        *as_of.keys, "patnum", *CHARGE_BUCKETS, "TotalCredits", "BalTotal", *estimates)


def clamped(sums: DataFrame) -> DataFrame:
    """Buckets no lower than zero; what was below counts as credit."""
    below = " + ".join(f"least({b}, {ZERO})" for b in CHARGE_BUCKETS)
    computed = {
        "TotalCredits": f"TotalCredits - ({below})",
        **{b: f"greatest({b}, {ZERO})" for b in CHARGE_BUCKETS},
    }
    return sums.selectExpr(*(f"{computed.get(c, c)} AS {c}" for c in sums.columns))


def open_balances(sums: DataFrame) -> DataFrame:
    """Credits applied to the oldest charges first."""
    return sums.selectExpr("*", *_allocated(CHARGE_BUCKETS, OPEN_BUCKETS, "TotalCredits", 3))


def signed_sums(ledger: DataFrame, as_of: AsOf) -> DataFrame:
    """Positive rows as charges and negative ones as credits, by age, per patient. The
    rows are cut at the report date already; a later one counts as the youngest."""
    charge, credit = f"greatest(tranamount, {ZERO})", f"greatest(-tranamount, {ZERO})"
    ages = Ages("trandate", AGING_EDGES, {charge: CHARGE_BUCKETS, credit: CREDIT_BUCKETS})
    sums = {"TotalCharges": charge, "TotalCredits": credit, "BalTotal": "tranamount"}
    return totals(ledger, as_of, ["patnum"], sums, ages).select(
        *as_of.keys, "patnum", *CHARGE_BUCKETS, "TotalCharges", *CREDIT_BUCKETS, "TotalCredits", "BalTotal")


def _allocated(
    buckets: Sequence[str], names: Sequence[str], payment: str, places: int
) -> list[str]:
    """Named expressions for what stays open, oldest bucket first, to so many places."""
    open_amounts = allocate_oldest_first(payment, list(reversed(buckets)))
    return [
        f"{rounded(amount, places)} AS {name}"
        for amount, name in zip(open_amounts, reversed(names))
    ]
