"""Evaluate a costly expression once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column named twice in a conditional is computed twice. As the variable of a one-element
    ``transform`` it is not, and inside other lambdas it is not computed per element either.
    """
    return F.transform(F.array(value), use)[0]
