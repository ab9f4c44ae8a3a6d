"""Helpers for expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ordered(*fields: str) -> Column:
    """The group's rows as an array of structs in the order of the fields."""
    return F.sort_array(F.collect_list(F.struct(*fields)))


def joined(fields: list[str], text: str, sep: str = " ") -> Column:
    """The group's texts, in the order of the fields, put together."""
    return F.array_join(F.transform(ordered(*fields, text), lambda x: x[text]), sep)


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def half_up(x: Column) -> Column:
    """Six decimals, halves up: what lies within 1e-12 under a half counts as one, so the order in which a sum was made does not decide."""
    return F.floor(x * 1e6 + 0.500001) / 1e6
