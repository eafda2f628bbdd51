"""Age buckets, the oldest-first allocation of payments, and balance splits."""

from __future__ import annotations

from collections.abc import Sequence

from duebook.functions.money import ZERO


def age_bucket(day: str, as_of: str, edges: Sequence[int]) -> str:
    """Index of the bucket ``day`` falls in: 0 is the youngest, len(edges) the oldest."""
    steps = [f"WHEN {day} >= date_sub({as_of}, {age}) THEN {i}" for i, age in enumerate(edges)]
    oldest = f"WHEN {day} < date_sub({as_of}, {edges[-1]}) THEN {len(edges)}"
    return f"CASE {' '.join(steps)} {oldest} END"


def sum_where(condition: str, amount: str) -> str:
    return f"sum(if({condition}, {amount}, {ZERO}))"


def sums_by_age(age: str, amount: str, names: Sequence[str]) -> list[str]:
    """One conditional sum per bucket, named youngest first."""
    return [f"{sum_where(f'{age} = {i}', amount)} AS {name}" for i, name in enumerate(names)]


def allocate_oldest_first(payment: str, buckets: Sequence[str]) -> list[str]:
    """What stays open in each bucket (oldest first) once ``payment`` is used up.

    ``left`` is the money no older bucket has taken. Where it is spent, a bucket stays
    as it is; otherwise it is paid down to zero at most. The two youngest buckets count
    as reached when the money runs out exactly on their doorstep, the middle ones do
    not, which shows only for a bucket that is itself negative.
    """
    left, open_amounts = payment, []
    for position, bucket in enumerate(buckets):
        paid_down = f"greatest({bucket} - ({left}), {ZERO})"
        if position == 0:
            open_amounts.append(paid_down)
        else:
            spent = "<" if position >= len(buckets) - 2 else "<="
            open_amounts.append(f"if({left} {spent} 0, {bucket}, {paid_down})")
        left = f"{left} - {bucket}"
    return open_amounts


def owed(balance: str) -> str:
    """The part of a balance owed to the practice."""
    return f"greatest({balance}, {ZERO})"


def owing(balance: str) -> str:
    """The part of a balance the practice owes back (zero or negative)."""
    return f"least({balance}, {ZERO})"
