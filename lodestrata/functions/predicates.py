"""Field predicates with the null and falsy rules of property lookups."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("eq", "ne", "contains", "starts_with", "ends_with", "in", "not_in", "gt", "lt")


def _there(c: Column, numeric: bool) -> Column:
    """Present and not falsy: null, '' and 0 never satisfy an ordering or substring test."""
    return c.isNotNull() & (c != 0 if numeric else c != "")


def where(field: str, op: str, value: Any) -> Column:
    """The predicate field op value, never null.

    A missing field equals nothing but differs from every value, so ne and not_in hold for it. contains,
    starts_with, ends_with, gt and lt are false for null, empty and zero fields. Case matters.
    """
    c = F.col(field)
    if op == "eq":
        return c.eqNullSafe(F.lit(value))
    if op == "ne":
        return ~c.eqNullSafe(F.lit(value))
    if op in ("in", "not_in"):
        values: Sequence[Any] = [v for v in value if v is not None]
        hit = F.coalesce(c.isin(values), F.lit(False)) if values else F.lit(False)
        if None in value:
            hit = hit | c.isNull()
        return hit if op == "in" else ~hit
    if op in ("gt", "lt"):
        return F.coalesce(_there(c, not isinstance(value, str)) & (c > value if op == "gt" else c < value), F.lit(False))
    s = c.cast("string")
    test = {"contains": s.contains, "starts_with": s.startswith, "ends_with": s.endswith}
    if op not in test:
        raise ValueError(f"unknown operator {op!r}; one of {', '.join(OPERATORS)}")
    return F.coalesce(_there(s, False) & test[op](value), F.lit(False))
