"""Insurance claim lines: paid amounts, write-offs and what is still expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.money import ZERO, units
from duebook.operators.rows import each_entry, ledger_rows, place
from duebook.params import AsOf, Period
from duebook.schema import (
    CLAIM, CLAIM_STATUSES, INS_EST, INS_PAY, NOT_RECEIVED, PAID_STATUSES, RECEIVED,
    UNSET, WRITEOFF, WRITEOFF_EST,
)
from duebook.sources.base import ON_COMPLETE_WORK, Tables

_LINE = ("claimprocnum", "procnum", "patnum", "procdate", "datecp", "status", "inspayamt",
         "writeoff", "payplannum")


def _on_complete_work(
    tables: Tables, columns: Sequence[str], condition: str, scope: AsOf | Period | None = None
) -> DataFrame:
    """Lines that meet ``condition`` and are paid by total (no procedure) or on a completed
    procedure."""
    return tables.referring(ON_COMPLETE_WORK, *columns, where=condition, scope=scope)


def _on_the_day(lines: DataFrame, as_of: AsOf, dated: bool) -> DataFrame:
    """Whether a line is received, or still waiting for service done by then: not received by the
    report date; only plain lines wait once they have a date."""
    received, served = f"status != {NOT_RECEIVED}", as_of.covers("procdate")
    if dated:
        lines, served = as_of.select(lines, "procdate"), "true"
        received = f"{received} AND {as_of.covers('datecp')}"
    else:
        lines = as_of.spread(lines)
    waiting = f"status = {NOT_RECEIVED} OR (status = {RECEIVED} AND NOT {as_of.covers('datecp')})"
    return lines.selectExpr("*", f"({received}) AS received", f"({served} AND ({waiting})) AS pending")


def _in_turns(lines: DataFrame, as_of: AsOf, dated: bool) -> DataFrame:
    """The same for a moving series, a row for each turn of a line: it waits from its service on,
    until it has a date, and counts as received from that date on, or where the amounts are
    cut in the sums, all along."""
    served, none = as_of.ever("procdate"), "CAST(NULL AS DATE)"
    received, since = f"status != {NOT_RECEIVED}", none
    if dated:
        received = f"{received} AND {served} AND {as_of.ever('datecp')}"
        since = "greatest(procdate, datecp)"
    waiting = f"status = {NOT_RECEIVED} OR (status = {RECEIVED} AND datecp IS NOT NULL)"
    turns = each_entry(lines, [
        (received, {"received": "true", "since": since, "until": none}),
        (f"{served} AND ({waiting})", {
            "received": "false", "since": "procdate", "until": f"if(status = {RECEIVED}, datecp, {none})"}),
    ])
    return turns.selectExpr(*lines.columns, "entry.received AS received", "NOT entry.received AS pending",
                            "entry.since AS since", "entry.until AS until")


def _claim_lines(
    tables: Tables, as_of: AsOf, with_clinic: bool, amount: str, writeoff: str, counts: str,
    dated: bool = True,
) -> DataFrame:
    """Claim lines that are received and count for something, or pending with something to
    expect. The tests and amounts are columns of their own, made once per
    line: repeated in place they would grow the generated method past what the JVM
    compiles."""
    columns = [*_LINE, "inspayest", *place(with_clinic)]
    lines = _on_complete_work(tables, columns, f"status IN {CLAIM_STATUSES}")
    lines = (_in_turns if as_of.moves else _on_the_day)(lines, as_of, dated).filter(
        f"received AND ({counts}) OR pending AND (inspayest != 0 OR writeoff != 0)"
    )
    lines = lines.selectExpr(
        "*", f"{units('inspayamt')} AS paid", f"{units('writeoff')} AS off",
        f"{units('inspayest')} AS expected",
    )
    return ledger_rows(
        lines, [*as_of.keys, *place(with_clinic)], CLAIM,
        prikey="claimprocnum", procnum="procnum", patnum="patnum", trandate="datecp",
        procdate="procdate",
        tranamount=f"if(received, {amount}, {ZERO})",
        woamount=f"if(received, {writeoff}, {ZERO})",
        instotest=f"if(pending, expected + off, {ZERO})",
        inspayest=f"if(pending, expected, {ZERO})",
        inswoest=f"if(pending, off, {ZERO})",
    )


_ONE_AMOUNT = {
    "amount": f"if(payplannum = 0, -paid, {ZERO}) - off",
    "writeoff": ZERO,
    "counts": "if(payplannum = 0, inspayamt, 0) + writeoff != 0",
}
_TWO_AMOUNTS = {
    "amount": f"if(payplannum = 0, -paid, {ZERO})",
    "writeoff": f"if(payplannum = 0, -off, {ZERO})",
    "counts": "payplannum = 0 AND (inspayamt != 0 OR writeoff != 0)",
}


def claims_receivable(tables: Tables, as_of: AsOf, with_clinic: bool = False) -> DataFrame:
    """Claim lines with payment and write-off in one amount; a plan line still loses its
    write-off."""
    return _claim_lines(tables, as_of, with_clinic, **_ONE_AMOUNT)


def claims_production(tables: Tables, as_of: AsOf, with_clinic: bool = False) -> DataFrame:
    """Claim lines with payment and write-off apart; a plan line loses neither."""
    return _claim_lines(tables, as_of, with_clinic, **_TWO_AMOUNTS)


def claims_aging(tables: Tables, as_of: AsOf) -> DataFrame:
    """Claim lines as the A/R aging takes them: amounts without a date test (they are cut
    in the sums), estimates for service up to the report date."""
    return _claim_lines(tables, as_of, False, **_ONE_AMOUNT, dated=False)


def claims_paid(
    tables: Tables, scope: AsOf | Period, with_clinic: bool = False, tag: str = CLAIM
) -> DataFrame:
    """Claim lines paid within the scope, payment and write-off apart, no estimates.

    Lines off the scope, unreceived or on a plan amount to nothing and nothing is kept
    of them, so those tests go to the scan and the join sees one window of lines only.
    """
    counted = f"status IN {PAID_STATUSES} AND payplannum = 0 AND (inspayamt != 0 OR writeoff != 0)"
    lines = _on_complete_work(tables, [*_LINE, *place(with_clinic)], counted, scope)
    lines = scope.select(lines, "datecp").filter(scope.not_after("procdate"))
    return ledger_rows(
        lines, [*scope.keys, *place(with_clinic)], tag,
        prikey="claimprocnum", procnum="procnum", patnum="patnum", trandate="datecp",
        procdate="procdate", tranamount=f"-{units('inspayamt')}",
        woamount=f"-{units('writeoff')}",
    )


def claim_events(
    tables: Tables, as_of: AsOf, kinds: Sequence[str] = (INS_PAY, WRITEOFF, INS_EST)
) -> DataFrame:
    """Payments and write-offs of received lines and estimates of waiting ones, each a row
    of its own, dated by the claim. All kinds come out of one scan."""
    paid, waiting = f"status IN {PAID_STATUSES}", f"status = {NOT_RECEIVED}"
    sources = {
        INS_PAY: (f"{paid} AND payplannum = 0", "inspayamt"),
        WRITEOFF: (paid, "writeoff"),
        INS_EST: (waiting, "inspayest"),
    }
    chosen = [(kind, *sources[kind]) for kind in kinds]
    entries = [
        (f"{test} AND {amount} != 0", {"kind": f"'{kind}'", "amount": f"-{units(amount)}"})
        for kind, test, amount in chosen
    ]
    lines = tables.read(
        "claimproc", "claimprocnum", "patnum", "datecp", "status", "payplannum",
        *(amount for _, _, amount in chosen), scope=as_of,
    )
    return ledger_rows(
        each_entry(as_of.select(lines, "datecp"), entries), as_of.keys, "entry.kind",
        prikey="claimprocnum", patnum="patnum", trandate="datecp", tranamount="entry.amount",
    )


def writeoff_estimates(tables: Tables, as_of: AsOf) -> DataFrame:
    """Write-offs expected for waiting claim lines, from the snapshot taken when the claim
    was sent. A line without one, or with an unset or zero one, has nothing to expect."""
    sent = (
        tables.read("claimsnapshot", "claimprocnum", "writeoff")
        .groupBy("claimprocnum")
        .agg(F.expr("max(writeoff) AS writeoff"))
        .filter(f"writeoff != {UNSET} AND writeoff != 0")
    )
    lines = tables.read("claimproc", "claimprocnum", "patnum", "datecp", "status")
    lines = lines.filter(f"status = {NOT_RECEIVED}").join(sent, "claimprocnum")
    return ledger_rows(
        as_of.select(lines, "datecp"), as_of.keys, WRITEOFF_EST,
        prikey="claimprocnum", patnum="patnum", trandate="datecp", tranamount=f"-{units('writeoff')}",
    )
