"""Line diffs in the Ratcliff-Obershelp sense, which no built-in expresses.

Arrow-batched; callers filter rows before they reach these functions.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import functions as F

ROWS = 64


def changed_in_first(a: list[str], b: list[str]) -> list[int]:
    """Lines of ``a`` that were replaced or deleted on the way to ``b``."""
    ops = difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
    return [i for tag, i1, i2, _, _ in ops if tag in ("replace", "delete") for i in range(i1, i2)]


def changed_in_second(a: list[str], b: list[str]) -> list[int]:
    """Lines of ``b`` that differ from ``a``; a deletion marks the line it happened at."""
    ops = difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
    out: set[int] = set()
    for tag, _, _, j1, j2 in ops:
        if tag == "delete":
            out.add(max(0, min(j1, len(b) - 1)))
        elif tag != "equal":
            out.update(range(j1, j2))
    return sorted(out)


def _per_row(fn):
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        # Lines become Python texts for a few rows at a time; a batch may hold 10,000 long texts.
        for i in range(0, len(a), ROWS):
            out += [None if x is None or y is None else fn(x, y)
                    for x, y in zip(a.slice(i, ROWS).to_pylist(), b.slice(i, ROWS).to_pylist())]
        return pa.array(out, pa.list_(pa.int32()))
    return run


def first_side():
    """Column function (array<string>, array<string>) -> array<int>."""
    def first(a: pa.Array, b: pa.Array) -> pa.Array:
        return _per_row(changed_in_first)(a, b)
    # "Nondeterministic" keeps filters on the result from running the diff twice.
    return F.arrow_udf(first, "array<int>").asNondeterministic()


def second_side():
    def second(a: pa.Array, b: pa.Array) -> pa.Array:
        return _per_row(changed_in_second)(a, b)
    return F.arrow_udf(second, "array<int>").asNondeterministic()
