"""Money as whole units of a ten-thousandth.

Amounts are read with four decimals and kept so through every sum; each report rounds once, to
the places it shows, after the sum. Spark adds DECIMAL columns through BigDecimal objects, but
BIGINT in generated code on primitive longs. Amounts are only added, negated or multiplied by
unit counts, so units are exact. A BIGINT sum that overflows raises under ANSI mode instead of
wrapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ZERO = "0L"
PLACES = 4
#: Units in a dollar.
DOLLAR = 10**PLACES


def units(column: str) -> str:
    """DECIMAL column of four places as a BIGINT number of units."""
    return f"CAST({column} * {DOLLAR} AS BIGINT)"


def rounded(amount: str, places: int) -> str:
    """BIGINT units rounded to so many places of a dollar, halves away from zero."""
    return f"round({amount}, {places - PLACES})"


def dollars(amount: str) -> str:
    """BIGINT or wide units as DECIMAL dollars."""
    return f"CAST(CAST({amount} AS DECIMAL(30,0)) * 0.0001BD AS DECIMAL(30,{PLACES}))"


def in_dollars(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.selectExpr(
        *(f"{dollars(c)} AS `{c}`" if c in columns else f"`{c}`" for c in rows.columns)
    )


def wide_sum(column: str) -> str:
    """Grand total of units; DECIMAL, as one group may add up a whole practice chain."""
    return f"sum(CAST({column} AS DECIMAL(20,0)))"
