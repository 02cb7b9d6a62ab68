"""Bind a value once inside an expression.

Spark evaluates an expression used inside a lambda anew for every array
element, which turns a mean over n lines into n means. ``let`` binds the value
to a lambda variable first, so it is computed once per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
