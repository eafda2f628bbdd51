"""Hand-written SQL answers that the Spark queries are checked against.

The SQL follows the plain reading of each report, step by step (outer joins, filters on
computed amounts, one summing level after the other), where the Spark side takes the
equivalent form that is cheaper on a cluster. The two share no text.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from oracle.answers import ANSWERS, BY_DAY, DAYS
from oracle.relations import RELATIONS


def _needed(text: str, found: dict[str, str], given: dict[str, str]) -> None:
    for name in given:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(given[name], found, given)
            found[name] = given[name]


def sql(given_tables: Collection[str] = ()) -> dict[str, str]:
    """Query name -> one self-contained statement over the test tables. Ledger tables named
    in ``given_tables`` are taken as they lie in the database instead of derived."""
    steps = {n: t for n, t in RELATIONS.items() if n not in given_tables}
    texts = {name: _statement(body, scope, steps) for name, (scope, body) in ANSWERS.items()}
    for name, report in BY_DAY.items():
        days = (
            (d, _statement(ANSWERS[report][1], f"SELECT DATE '{d}' AS q, DATE '{d}' AS upto", steps))
            for d in DAYS
        )
        texts[name] = "\nUNION ALL\n".join(
            f"SELECT DATE '{d}' AS as_of, * FROM (\n{text}\n)" for d, text in days)
    return texts


def _statement(body: str, scope: str, steps: dict[str, str]) -> str:
    given, found = {**steps, "report_day": scope}, {}
    _needed(body, found, given)
    parts = ",\n".join(f"{n} AS (\n{t.strip()}\n)" for n, t in found.items())
    return f"WITH {parts}\n{body.strip()}" if parts else body.strip()
