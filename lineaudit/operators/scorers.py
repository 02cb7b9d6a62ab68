"""Lexical baseline scorers: implementations in, evaluation records out.

One pass over the implementations yields the records of all scorers; nothing
is shuffled because a record's lines never leave its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import text as T

Scorer = Callable[[Column, Column], Column]  # (scorable texts, impl_id) -> energies


def length(texts: Column, _id: Column) -> Column:
    return F.transform(texts, lambda t: F.char_length(T.strip(t)).cast("double"))


def raw_length(texts: Column, _id: Column) -> Column:
    return F.transform(texts, lambda t: F.char_length(t).cast("double"))


def _hits(t: Column, vocabulary) -> Column:
    total = F.lit(0)
    for word in vocabulary:
        total = total + t.contains(word).cast("int")
    return total


def keyword(vocabulary, weight: float = 1e-4, stripped: bool = True) -> Scorer:
    """Vocabulary hits, ties broken by a small multiple of the line length."""
    def score(texts: Column, _id: Column) -> Column:
        return F.transform(texts, lambda t: _hits(t, vocabulary).cast("double")
                           + F.lit(weight) * F.char_length(T.strip(t) if stripped else t))
    return score


def hashed(texts: Column, impl_id: Column) -> Column:
    """Uniform pseudo-random energies that depend only on the content."""
    return F.transform(texts, lambda t: F.conv(F.substring(F.sha1(F.encode(
        F.concat(t, F.lit("|"), impl_id), "UTF-8")), 1, 4), 16, 10).cast("double") / 65536.0)


SCORERS: dict[str, Scorer] = {
    "length": length,
    "keyword": keyword(T.DSL_KEYWORDS),
    "marker": keyword(T.MARKER_KEYWORDS),
    "random": hashed,
}
LINE_KEYWORD: Scorer = keyword(T.DSL_KEYWORDS, weight=0.001, stripped=False)


def score(impls: DataFrame, scorers: dict[str, Scorer] | None = None, lines: Column | None = None) -> DataFrame:
    """Evaluation records, one per implementation and scorer (column ``run``).

    Blank implementations and ones without a scorable line yield no record.
    The whole-implementation energy is the largest line energy.
    """
    scorers = scorers or SCORERS
    lines = T.splitlines(F.col("impl_text")) if lines is None else lines
    keep = [c for c in ("impl_id", "spec_id", "source", "status") if c in impls.columns]
    base = impls.select(*keep, "buggy_lines", lines.alias("_lines"))
    base = base.select(*keep, T.scorable_texts(F.col("_lines")).alias("scorable_line_texts"), T.to_sentinel_space(
        F.col("buggy_lines"), T.scorable_line_indices(F.col("_lines"))).alias("_labels"))
    texts = F.col("scorable_line_texts")
    # Labels travel through the generator so that filters on them stay above it
    # and do not make the line work run twice; no lines, no rows.
    runs = F.when(F.size(texts) > 0, F.array(*[
        F.struct(F.lit(name).alias("run"), fn(texts, F.col("impl_id")).alias("per_line_energies"),
                 F.col("_labels").alias("buggy_line_indices"))
        for name, fn in scorers.items()]))
    out = base.select(*keep, "scorable_line_texts", F.inline(runs))
    return out.select(
        "run", *keep, F.array_max("per_line_energies").alias("whole_impl_energy"), "per_line_energies",
        "buggy_line_indices", "scorable_line_texts")


def skip_counts(impls: DataFrame) -> DataFrame:
    """How many implementations the scorers skip, and why."""
    lines = T.splitlines(F.col("impl_text"))
    blank = T.is_blank(F.col("impl_text"))
    none = F.size(T.scorable_texts(lines)) == 0
    return impls.agg(
        F.count("*").alias("n_total"),
        F.count_if(blank).alias("n_blank"),
        F.count_if(~blank & none).alias("n_without_scorable"),
        F.count_if(~blank & ~none).alias("n_scored"))


def rank_to_energies(top: Column, n: Column) -> Column:
    """Ranked line positions to energies 5,4,3,2,1; unranked lines get 0."""
    from lineaudit.functions.binding import let
    return let(top, lambda t: F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.when(
        F.array_position(t, i).between(1, 5), 6 - F.array_position(t, i)).otherwise(0).cast("double")))
