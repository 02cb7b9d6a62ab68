"""Filter on a computed value without computing it twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions.binding import let


def filter_map(df: DataFrame, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Add the fields of ``value`` (a struct) to the rows whose struct passes ``keep``.

    A filter above a projection is pushed below it and evaluates the projected
    expression a second time; a generator is not crossed, so text work in
    ``value`` runs once per row.
    """
    return df.select("*", F.inline(let(value, lambda s: F.when(keep(s), F.array(s)))))
