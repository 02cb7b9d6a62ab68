"""Where labelled and predicted lines sit inside their implementation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import ranking as R
from lineaudit.functions.binding import let
from lineaudit.operators import metrics as M
from lineaudit.plans.joins import join_groups
from lineaudit.plans.ordered import order_statistics


def _e() -> Column:
    return F.col("per_line_energies")


def quartile_cuts() -> dict[str, Column]:
    """Index quantiles: the element at n//4, n//2 and 3n//4 of the sorted values."""
    n = F.col("n")
    return {"q25": F.floor(n / 4), "q50": F.floor(n / 2), "q75": F.floor(3 * n / 4)}


def label_positions(records: DataFrame, min_lines: int = 1) -> DataFrame:
    """Relative position of every in-range label."""
    n = F.size(_e())
    rows = M.labelled_fail(records).filter(n >= min_lines)
    return rows.withColumn("_i", F.explode(R.in_range(F.col("buggy_line_indices"), n))).withColumn(
        "position", F.col("_i") / F.greatest(n - 1, F.lit(1))).drop("_i")


def predicted_positions(records: DataFrame, min_lines: int = 1) -> DataFrame:
    """Relative position of the most suspicious line of every labelled record."""
    n = F.size(_e())
    return M.labelled_fail(records).filter(n >= min_lines).withColumn(
        "position", R.argmax(_e()) / F.greatest(n - 1, F.lit(1)))


def position_quartiles(records: DataFrame, by: list[str]) -> DataFrame:
    kinds = label_positions(records).select(*by, F.lit("label").alias("kind"), "position").unionByName(
        predicted_positions(records).select(*by, F.lit("predicted").alias("kind"), "position"))
    return order_statistics(kinds, [*by, "kind"], "position", quartile_cuts())


def position_density(positions: DataFrame, by: list[str], bins: int = 20) -> DataFrame:
    """Density histogram on [0, 1]; the last bin is closed on the right."""
    cell = F.least(F.floor(F.col("position") * bins), F.lit(bins - 1)).cast("int")
    counts = positions.groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    # bins rows per group: both sides are small whatever the input.
    return join_groups(counts, totals, by).select(*by, "bin", "c", (F.col("c") / F.col("n") * bins).alias("density"))


def spearman(energies: Column) -> Column:
    """Rank correlation of energy and line number; ties ranked by line number."""
    n = F.size(energies)
    mid = (n - 1) / 2.0
    den = n.cast("double") * (n.cast("double") * n - 1) / 12.0

    def cov(r):
        pairs = F.transform(r, lambda x, i: F.struct(x.alias("r"), i.alias("i")))
        return let(mid, lambda m: F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["r"] - m) * (p["i"] - m)))

    return F.when(n >= 3, let(R.ordinal_ranks(energies), cov) / den)


def spearman_position(records: DataFrame, by: list[str]) -> DataFrame:
    # The size tells which records have a value, so the ranking is computed once.
    rows = records.filter(F.size(_e()) >= 3).withColumn("_rho", spearman(_e()))
    return rows.groupBy(*by).agg(F.avg("_rho").alias("rho"), F.count("_rho").alias("n"))
