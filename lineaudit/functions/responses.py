"""Readers for free-text model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let

# How answers are searched when they are not one JSON object.
LISTED_LINES = r"(?s)\{[^{}]*?top_lines[^{}]*?\[([^\]]*)\][^{}]*?\}"
INTEGER = r"-?\d+"
VERDICT = r'(?i)"verdict"\s*:\s*"(pass|fail)"'
FAIL_PROBABILITY = r'"p_fail"\s*:\s*([0-9.]+)'


def _ints(s: Column) -> Column:
    return F.transform(F.regexp_extract_all(s, F.lit(INTEGER), F.lit(0)), lambda x: x.try_cast("bigint"))


def _object(content: Column) -> Column:
    """The answer as a variant if it is a JSON object, else NULL."""
    v = F.try_parse_json(content)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def ranked_lines(content: Column, n_lines: Column, k: int = 5) -> Column:
    """Ranked line numbers of an answer: in range, without repeats, at most k.

    A JSON object is taken at its word; otherwise a ``top_lines`` list is
    looked for in the text, and failing that the first k integers are read.
    """
    listed = F.transform(
        F.try_variant_get(_object(content), "$.top_lines", "array<string>"),
        lambda x: x.try_cast("double").try_cast("bigint"))
    loose = F.when(content.rlike(LISTED_LINES), _ints(F.regexp_extract(content, LISTED_LINES, 1))).otherwise(
        F.slice(_ints(content), 1, k))
    found = F.when(_object(content).isNotNull(), F.coalesce(listed, F.array().cast("array<bigint>"))).otherwise(loose)
    kept = let(n_lines, lambda n: F.filter(found, lambda i: (i >= 0) & (i < n)))
    return F.transform(F.slice(F.array_distinct(kept), 1, k), lambda i: i.cast("int"))


def verdict(content: Column) -> Column:
    """struct(verdict, p_fail) of a pass/fail answer; missing parts are NULL."""
    obj = _object(content)
    said = F.lower(T.strip(F.try_variant_get(obj, "$.verdict", "string")))
    number = F.when(
        F.schema_of_variant(F.try_variant_get(obj, "$.p_fail", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
        F.try_variant_get(obj, "$.p_fail", "double"))
    loose_v = F.nullif(F.lower(F.regexp_extract(content, VERDICT, 1)), F.lit(""))
    loose_p = F.regexp_extract(content, FAIL_PROBABILITY, 1).try_cast("double")
    is_obj = obj.isNotNull()
    return F.struct(
        F.when(is_obj, F.when(said.isin("pass", "fail"), said)).otherwise(loose_v).alias("verdict"),
        let(F.when(is_obj, number).otherwise(loose_p), lambda p: F.when(
            p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))).alias("p_fail"))


def verdict_energy(v: Column) -> Column:
    """p_fail itself, else 1/0 by verdict, else one half."""
    return F.coalesce(
        v["p_fail"], F.when(v["verdict"] == "fail", 1.0).when(v["verdict"] == "pass", 0.0), F.lit(0.5))
