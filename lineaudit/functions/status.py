"""The five ways a raw status string is read. They disagree on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail(s: Column) -> Column:
    return F.substring_index(F.upper(s), ".", -1)


def verbatim(s: Column) -> Column:
    """Upper-cased text after the last dot, otherwise untouched."""
    return _tail(s)


def fail_first(s: Column) -> Column:
    t = _tail(s)
    return F.when(t.rlike("FAIL|ERR"), "FAIL").when(t.rlike("PASS|OK"), "PASS").otherwise("UNKNOWN")


def pass_first(s: Column) -> Column:
    t = _tail(s)
    return F.when(t.rlike("PASS|OK"), "PASS").when(t.rlike("FAIL|ERR"), "FAIL").otherwise("UNKNOWN")


def by_suffix(s: Column) -> Column:
    u = F.upper(s)
    return (
        F.when(u.endswith("PASS") | u.endswith("OK"), "PASS")
        .when(u.endswith("FAIL") | u.endswith("ERR"), "FAIL")
        .otherwise("UNKNOWN")
    )


def trajectory(s: Column) -> Column:
    return F.when(s == "success", "PASS").when(s.isin("error", "timeout"), "FAIL").otherwise("UNKNOWN")
