"""Where models and tokenizers plug in, and what is computed around them.

A tokenizer is a function text -> ids, a scorer a function (spec, impl) ->
(line energies, whole energy). Both are built once per Python worker and fed
Arrow batches; everything before and after them is column work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.functions.reducers import total
from lineaudit.plans.emit import filter_map


ROWS = 256


def _encoder(make: Callable[[], Callable[[str], list[int]]]):
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            # Ids leave some rows at a time; a batch may hold 10,000 long texts.
            for i in range(0, len(texts), ROWS):
                yield texts.iloc[i:i + ROWS].map(lambda t: None if t is None else list(run(t)))

    # The type hints above are strings at run time; give Spark the real ones.
    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, "array<int>").asNondeterministic()


def tokenize(examples: DataFrame, make_encoder: Callable[[], Callable[[str], list[int]]], sentinel_id: int,
             max_length: int, sentinel: str = T.SENTINEL) -> DataFrame:
    """Token ids with sentinel positions; drops examples that are too long, have
    no scorable line or whose sentinels the tokenizer did not keep whole."""
    lines = T.splitlines(F.col("impl_text"))
    encode = _encoder(make_encoder)
    rows = filter_map(examples, let(lines, lambda ls: F.struct(
        T.insert_sentinels(ls, sentinel).alias("_marked"), T.scorable_line_indices(ls).alias("_sc"))),
        lambda s: F.size(s["_sc"]) > 0)
    rows = rows.withColumn("_spec", encode(F.concat(T.rstrip(F.col("spec_text")), F.lit("\n")))).withColumn(
        "_impl", encode(F.regexp_replace("_marked", r"^\n+", "")))
    ids = F.concat("_spec", "_impl")
    rows = rows.withColumns({"input_ids": ids, "spec_token_count": F.size("_spec")})
    rows = rows.withColumn("sentinel_positions", T.indices_where(F.col("input_ids"), lambda t: t == sentinel_id))
    rows = rows.withColumn("buggy_line_indices", T.to_sentinel_space(F.col("buggy_lines"), F.col("_sc")))
    kept = (F.size("input_ids") <= max_length) & (F.size("sentinel_positions") == F.size("_sc"))
    return rows.filter(kept).drop("_marked", "_sc", "_spec", "_impl")


def line_surprisal(log_probs: Column, sentinels: Column, spec_tokens: Column) -> Column:
    """Mean negative log-probability of the tokens between sentinels; empty stretches give 0.

    ``log_probs[i]`` belongs to token i. A line runs from just after the last
    sentinel (or the spec) up to its own sentinel.
    """
    def energies(p):
        def one(s, i):
            first = F.when(i == 0, p["spec"]).otherwise(F.get(p["at"], i - 1) + 1)
            return let(first, lambda a: let(F.slice(p["lp"], a + 1, F.greatest(s - a, F.lit(0))), lambda part: F.when(
                F.size(part) > 0, -total(part) / F.size(part)).otherwise(F.lit(0.0))))

        return F.transform(p["at"], one)

    return let(F.struct(log_probs.alias("lp"), sentinels.alias("at"), spec_tokens.alias("spec")), energies)


def surprisal_records(scored: DataFrame) -> DataFrame:
    """Records from token log-probabilities: columns impl_id, log_probs, sentinel_positions, spec_token_count kept."""
    e = line_surprisal(F.col("log_probs"), F.col("sentinel_positions"), F.col("spec_token_count"))
    rows = scored.withColumn("per_line_energies", e)
    return rows.withColumn("whole_impl_energy", F.when(
        F.size("per_line_energies") > 0, total(F.col("per_line_energies")) / F.size("per_line_energies")).otherwise(F.lit(0.0)))


def run_scorer(examples: DataFrame, make_scorer: Callable[[], Callable[[str, str], tuple[list[float], float]]]) -> DataFrame:
    """(impl_id, per_line_energies, whole_impl_energy) from a model behind a factory."""
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_scorer()
        for pdf in batches:
            out = [model(s, t) for s, t in zip(pdf["spec_text"], pdf["impl_text"])]
            yield pd.DataFrame({
                "impl_id": pdf["impl_id"], "per_line_energies": [list(map(float, e)) for e, _ in out],
                "whole_impl_energy": [float(w) for _, w in out]})

    return examples.select("impl_id", "spec_text", "impl_text").mapInPandas(
        score, "impl_id string, per_line_energies array<double>, whole_impl_energy double")
