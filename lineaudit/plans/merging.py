"""Aggregates that merge: every step is a plain sum or extreme, combined before each shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exponents are summed in cells this wide: e^-(2 * 256) is still a normal double, and what lies more than
#: a whole cell above cannot be seen beside it.
CELL = 256.0
_FAR = 1e15


def log_sum_exp_by(df: DataFrame, by: list[str], value: Column, name: str, **sums: Column) -> DataFrame:
    """``log(sum(exp(value)))`` per group as ``name``, next to further sums or counts of the same rows.

    A row adds ``exp(value - top of its cell)`` to the sum of its cell, so no exponent can overflow; a group then
    reads the sum of its highest cell, into which the one below was added. Groups need no array and no second look at
    the rows. NULL values are left out of the sum; a group without any gives NULL, one with NaN gives NaN, and
    infinite values act as in exact arithmetic, as do values beyond 2.5e17 in either direction, which count as infinite.
    """
    top = F.when(F.isnan("_v"), F.lit(_FAR)).when(F.col("_v").isNull(), F.lit(-_FAR)).otherwise(
        F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), F.ceil(F.col("_v") / CELL).cast("double"))))
    rows = df.withColumn("_v", value.cast("double")).withColumn("_cell", top)
    scaled = F.when(F.abs("_v") == float("inf"), F.exp("_v")).otherwise(F.exp(F.col("_v") - F.col("_cell") * CELL))
    cells = rows.groupBy(*by, "_cell").agg(F.sum(scaled).alias("_s"), *[c.alias(k) for k, c in sums.items()])
    # Every cell also enters the one above; only cells with rows of their own may be a group's highest.
    own = F.struct(F.col("_cell").alias("_to"), F.col("_s").alias("_part"), F.lit(True).alias("_own"), *sums)
    above = F.struct((F.col("_cell") + 1).alias("_to"), (F.col("_s") * F.exp(F.lit(-CELL))).alias("_part"), F.lit(False).alias("_own"),
                     *[F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in sums])
    met = cells.select(*by, F.inline(F.array(own, above))).groupBy(*by, "_to").agg(
        F.sum("_part").alias("_part"), F.bool_or("_own").alias("_own"), *[F.sum(k).alias(k) for k in sums])
    highest = F.max_by("_part", F.when(F.col("_own"), F.col("_to")))
    level = F.max(F.when(F.col("_own"), F.col("_to"))) * CELL
    out = F.when(highest == 0, F.lit(-float("inf"))).otherwise(F.log(highest) + level)
    return met.groupBy(*by).agg(out.alias(name), *[F.sum(k).alias(k) for k in sums])


def moments(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """One row: ``n`` usable vectors, their ``mean`` and their covariance as the upper triangle ``cov``, row by row.

    Usable is a vector of exactly ``dim`` finite components. A partition is folded batch by batch into one row of
    about dim^2 / 2 sums, taken around zero; those rows are added entry by entry, so the shuffle sees partitions
    times dim^2 / 2 numbers whatever the table holds. An empty table gives n = 0 and NULL elsewhere.
    """
    upper = np.triu_indices(dim)

    def fold(batches):
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        sums = np.concatenate([[float(n)], s, q[upper]])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["sums"])

    used = df.filter(usable(F.col(vector), dim)).select(F.col(vector).cast("array<double>").alias("v"))
    parts = used.mapInArrow(fold, "sums array<double>").select(F.posexplode("sums").alias("i", "x"))
    added = parts.groupBy("i").agg(F.sum("x").alias("x"))
    # One entry per moment: 1 + dim + dim (dim + 1) / 2 of them.
    row = added.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("m"))
    n = F.coalesce(F.get("m", F.lit(0)), F.lit(0.0))
    mean = F.transform(F.slice("m", 2, dim), lambda x: x / n)
    row = row.select(n.cast("long").alias("n"), F.when(n > 0, mean).alias("mean"), F.slice("m", 2 + dim, len(upper[0])).alias("q"))

    def entry(i, j):
        # Row i of the triangle starts behind the i rows before it, of dim, dim - 1, … entries.
        at = i * dim - (i * (i - 1) / 2).cast("int") + j - i
        return F.try_divide(F.get("q", at), F.col("n")) - F.get("mean", i) * F.get("mean", j)

    cov = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.transform(
        F.sequence(i, F.lit(dim - 1)), lambda j: entry(i, j))))
    return row.select("n", "mean", F.when(F.col("n") > 0, cov).alias("cov"))


def usable(vector: Column, dim: int) -> Column:
    """Has the vector exactly ``dim`` components, all of them finite numbers?"""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))
