"""Expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def sized(v: Column | str, dim: int) -> Column:
    """The vector ``v``, refused if it doesn't have ``dim`` numbers."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.format_string("a vector of %d numbers, not of %d", F.lit(dim), F.size(v))))


def mean_of(v: Column | str, dim: int) -> Column:
    """The mean vector of a group, all of ``dim`` numbers."""
    return F.array(*[F.avg(x) for x in numbers(v, dim)])


def numbers(v: Column | str, dim: int) -> list[Column]:
    """The numbers of a vector; the first refuses a vector that doesn't have ``dim``."""
    return [F.get(v if i else sized(v, dim), F.lit(i)) for i in range(dim)]
