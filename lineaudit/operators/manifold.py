"""The two tables behind a map of implementations and lines, and their layout for lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit.operators.field import page, project_2d
from lineaudit.operators.siblings import pass_sibling_flag
from lineaudit.session import stable


def mean_of(vectors: Column, dim: int) -> Column:
    """Element-wise mean of an array of vectors of ``dim`` entries; NULL without vectors."""
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), dim), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def tables(records: DataFrame, impls: DataFrame, vectors: str = "line_vectors", dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(implementations, lines) of one run of scored records.

    ``records`` holds a vector of ``dim`` entries per scored line in ``vectors``, ``impls`` the texts; both have unique ids.
    Implementations carry the mean vector of their lines, the number of lines, whether another implementation of the
    spec passes, and both texts; either table has its position (x, y) on its own two principal axes. A record without an
    implementation is left out. Lines never leave their row before they are written: a shuffle sees implementations only.
    """
    # The axes, the ranges and the writer of either table read them: texts are scored and encoded once.
    records = stable(records)
    sizes = F.least(F.size("per_line_energies"), F.size(vectors))
    lines = records.select("impl_id", "spec_id", F.col("status").alias("impl_status"), F.inline(F.transform(
        F.filter(F.sequence(F.lit(0), sizes), lambda i: i < sizes), lambda i: F.struct(
            i.alias("line_idx"), F.get("scorable_line_texts", i).alias("line_text"), F.get("per_line_energies", i).alias("energy"),
            F.array_contains("buggy_line_indices", i).alias("is_buggy"), F.get(vectors, i).alias("vector")))))
    own = records.select("impl_id", "whole_impl_energy", sizes.alias("n_lines"), mean_of(F.slice(F.col(vectors), 1, sizes), dim).alias("vector"))
    # Siblings count among the implementations that have a record.
    texts = impls.select("impl_id", "spec_id", "status", "spec_text", "impl_text")
    return (project_2d(stable(pass_sibling_flag(texts.join(own, "impl_id"))), "vector", dim),
            project_2d(lines, "vector", dim))


def write(impls: DataFrame, lines: DataFrame, folder: str, rows_per_group: int = 20_000) -> None:
    """Both tables as Parquet below ``folder``, dealt by ranges of ``impl_id`` and sorted, with small row groups and a Bloom
    filter, so that a lookup reads the groups that hold its id. A large implementation may cross ranges by its line numbers."""
    def lay(rows: DataFrame, name: str, keys: list[str]) -> None:
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option(
            "parquet.block.row.count.limit", rows_per_group).option("parquet.bloom.filter.enabled#impl_id", "true").parquet(f"{folder}/{name}")

    lay(impls, "impls", ["impl_id"])
    lay(lines, "lines", ["impl_id", "line_idx"])


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


LIGHT = {"impls": ["impl_id", "spec_id", "status", "whole_impl_energy", "n_lines", "has_pass_sibling", "x", "y"],
         "lines": ["impl_id", "line_idx", "line_text", "energy", "is_buggy", "impl_status", "x", "y"]}


def light(spark: SparkSession, folder: str, name: str, limit: int = 0, offset: int = 0) -> DataFrame:
    """The columns that a map draws, whole or one page in the order of ids; vectors and texts stay on disk."""
    rows = read(spark, folder, name).select(*LIGHT[name])
    return rows if limit == 0 else page(rows, ["impl_id"] if name == "impls" else ["impl_id", "line_idx"], limit, offset)


def detail(spark: SparkSession, folder: str, impl_id: str) -> tuple[DataFrame, DataFrame]:
    """The implementation (no row if unknown) and its lines in order; the filter reaches the scan of either table."""
    impl = read(spark, folder, "impls").filter(F.col("impl_id") == impl_id).select(
        "impl_id", "spec_id", "status", "whole_impl_energy", "spec_text", "impl_text")
    lines = read(spark, folder, "lines").filter(F.col("impl_id") == impl_id).select(
        "line_idx", "line_text", "energy", "is_buggy", "x", "y")
    return impl, lines.orderBy("line_idx")
