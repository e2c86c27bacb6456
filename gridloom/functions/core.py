"""Column helpers used across operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Catalyst inlines aliases of cheap-looking projections, so an expression
    used k times is computed k times; a one-element transform binds it.
    """
    return F.transform(F.array(value), body)[0]


def half_even(x: Column, digits: int) -> Column:
    """Round half to even at ``digits`` decimals: scale, ``rint``, unscale."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)
