"""Projection of source rows onto the ledger."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from duebook.schema import LEDGER, NO_DATE

_BLANKS = {"bigint": "0L", "date": f"DATE'{NO_DATE}'"}


def place(with_clinic: bool) -> list[str]:
    """The clinic column where a report asks for it."""
    return ["clinicnum"] if with_clinic else []


def ledger_rows(rows: DataFrame, keys: Sequence[str], tag: str, **fields: str) -> DataFrame:
    """Ledger rows from ``rows``, with its columns ``keys`` in front. ``fields`` gives an
    expression per ledger column; the others are blank, and cost nothing where no report
    reads them. ``procnum`` falls back to the row's own key. ``tag`` is the transaction
    tag, or a struct field that holds it."""
    given = {
        "procnum": fields["prikey"],
        "clinicnum": "clinicnum" if "clinicnum" in keys else "NULL",
        "trantype": tag if "." in tag else f"'{tag}'",
        **fields,
    }
    return rows.selectExpr(
        *(k for k in keys if k not in LEDGER),
        *(f"CAST({given.get(f, _BLANKS.get(t))} AS {t}) AS {f}" for f, t in LEDGER.items()),
    )


def each_entry(rows: DataFrame, entries: Sequence[tuple[str, dict[str, str]]]) -> DataFrame:
    """One output row per entry whose condition holds, its fields under ``entry``: several
    kinds of transaction out of one scan. ``rows`` that yield none are dropped first."""
    rows = rows.filter(" OR ".join(f"({condition})" for condition, _ in entries))
    options = []
    for condition, fields in entries:
        named = ", ".join(f"'{name}', {value}" for name, value in fields.items())
        options.append(f"if({condition}, named_struct({named}), NULL)")
    if len(options) == 1:
        return rows.selectExpr("*", f"{options[0]} AS entry")
    return rows.selectExpr("*", f"explode(array({', '.join(options)})) AS entry").filter(
        "entry IS NOT NULL"
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
