"""Joins of per-group results, where "no group" means one row on either side and NULL is a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Inner or left join on ``by`` where NULL equals NULL; the key columns are those of ``left``."""
    named = right.withColumnsRenamed({c: f"_g_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"_g_{c}"]) for c in by])
    return left.join(named, same, how).drop(*(f"_g_{c}" for c in by))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on ``by``; without group columns ``right`` is a single row, set beside every left row."""
    return join_null_safe(left, right, by, how) if by else left.crossJoin(F.broadcast(right))
