"""A value that is used many times within an expression, computed once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with the value bound to a variable. Written out in place, the value would be computed again at each use,
    and within a function over an array for each element."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)
