"""Outcome tables of repair experiments and model usage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaudit.functions import statistics as S
from lineaudit.plans.ordered import halo_chunks
from lineaudit.sources.records import last_per_key


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def arm_summary(results: DataFrame, arms: list[str], original: str | None = None) -> DataFrame:
    """One row: successes and rates per arm, union and intersection of all arms."""
    n = F.greatest(F.count("*"), F.lit(1))
    anyof, allof = F.lit(False), F.lit(True)
    cols = [F.count("*").alias("n")]
    for a in arms:
        cols += [F.count_if(_yes(a)).alias(f"{a}_n"), (F.count_if(_yes(a)) / n).alias(f"{a}_rate")]
        anyof, allof = anyof | _yes(a), allof & _yes(a)
    if original:
        cols += [F.count_if(_yes(original)).alias("original_n"), (F.count_if(_yes(original)) / n).alias("original_rate")]
    cols += [(F.count_if(anyof) / n).alias("union_rate"), (F.count_if(allof) / n).alias("intersection_rate")]
    return results.agg(*cols)


def pairwise(results: DataFrame, arms: list[str]) -> DataFrame:
    """Discordant counts and exact two-sided p for every pair of arms."""
    pairs = [(a, b) for i, a in enumerate(arms) for b in arms[i + 1:]]
    one = results.agg(F.array(*[F.struct(
        F.lit(a).alias("arm1"), F.lit(b).alias("arm2"), F.count_if(_yes(a) & ~_yes(b)).alias("only_arm1"),
        F.count_if(_yes(b) & ~_yes(a)).alias("only_arm2")) for a, b in pairs]).alias("_p"))
    rows = one.select(F.inline("_p"))
    log_p = S.binomial_half_log_p(F.col("only_arm1"), F.col("only_arm2"))
    return rows.withColumn("_log", log_p).withColumns({"p": F.exp("_log"), "log10_p": S.log10_of(F.col("_log"))}).drop("_log")


def merge_rerun(rows: DataFrame, rerun: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the given columns where a rerun exists; other rows pass through."""
    new = rerun.select("impl_id", F.lit(True).alias("_again"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = rows.join(new, "impl_id", "left")
    return out.withColumns({
        c: F.when(F.col("_again"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns
    }).drop("_again", *[f"_n_{c}" for c in columns])


def scored_with_text(scored: DataFrame, raw: DataFrame) -> DataFrame:
    """Scored records joined with the last raw row of their id; empty texts are dropped."""
    last = last_per_key(raw, "impl_id", F.col("ord")).drop("ord").filter("spec_text <> '' AND impl_text <> ''")
    return scored.join(last, "impl_id")


def with_texts(records: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach line texts by id, cut to the number of energies; unknown ids get none."""
    found = records.join(texts.select("impl_id", F.col("scorable_line_texts").alias("_t")), "impl_id", "left")
    return found.withColumn("scorable_line_texts", F.slice(
        F.coalesce("_t", F.array().cast("array<string>")), 1, F.size("per_line_energies"))).drop("_t")


def usage_totals(answers: DataFrame) -> DataFrame:
    """Tokens and outcomes per model."""
    return answers.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if("failed").alias("n_failed"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))


def verdict_accuracy(answers: DataFrame, by: list[str]) -> DataFrame:
    """Share of readable verdicts that equal the status."""
    rows = answers.filter(F.col("verdict").isNotNull())
    return rows.groupBy(*by).agg(
        F.avg((F.upper("verdict") == F.col("status")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def plateau(history: DataFrame, window: int, by: list[str], order: list[str]) -> DataFrame:
    """Has the mean loss of the last ``window`` steps stopped falling between its halves?"""
    half = window // 2
    rows = halo_chunks(history, by, order, window)
    w = Window.partitionBy(*by, "_chunk").orderBy("position")
    first = F.avg("loss").over(w.rowsBetween(-(window - 1), -(window - half)))
    second = F.avg("loss").over(w.rowsBetween(-(window - half - 1), 0))
    rows = rows.withColumns({"first_half": first, "second_half": second}).filter("_own")
    full = F.col("position") >= window - 1
    return rows.select(
        *history.columns, F.when(full, F.col("first_half")).alias("first_half"),
        F.when(full, F.col("second_half")).alias("second_half"),
        (full & (F.col("second_half") >= 0.98 * F.col("first_half"))).alias("plateau"))


def learning_rate_factor(step: Column, total: int, warmup_share: float, end_share: float) -> Column:
    """Linear warm-up to 1, then a cosine down to ``end_share``."""
    warmup = max(1, int(warmup_share * total))
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    cosine = F.lit(end_share) + F.lit((1.0 - end_share) * 0.5) * (1.0 + F.cos(F.lit(math.pi) * done))
    return F.when(step < warmup, step / float(warmup)).otherwise(cosine)


def temperature(step: Column, total: int, start: float, end: float) -> Column:
    if total <= 0:
        return F.lit(end)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / float(total)))
    return F.lit(start) + F.lit(end - start) * share
