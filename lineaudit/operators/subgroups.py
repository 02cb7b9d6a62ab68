"""Recall broken down by bug kind, label count and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import ranking as R
from lineaudit.operators import metrics as M
from lineaudit.plans.ordered import order_statistics, row_positions
from lineaudit.session import stable

# Bug kinds by the first pattern found in the labelled line, in this order.
BUG_PATTERNS = (
    ("assert", r"\bassert\b"),
    ("ensures", r"\bensures\b"),
    ("invariant", r"\binvariant\b"),
    ("decreases", r"\bdecreases\b"),
    ("requires", r"\brequires\b"),
    ("forall", r"\bforall\b|\bexists\b"),
)


def bug_type(line: Column) -> Column:
    kind = F.when(F.lit(False), F.lit(""))
    for name, pattern in BUG_PATTERNS:
        kind = kind.when(line.rlike(pattern), name)
    return kind.otherwise("other")


def _hits(records: DataFrame, k: int) -> DataFrame:
    return records.withColumn("_hit", R.hit(
        R.rank_order(F.col("per_line_energies")), F.col("buggy_line_indices"), k).cast("int"))


def by_bug_type(records: DataFrame, k: int = 3, by: list[str] | None = None) -> DataFrame:
    by = by or []
    first = F.array_min("buggy_line_indices")
    rows = M.aligned(records).filter(first < F.size("scorable_line_texts"))
    rows = rows.withColumn("bug_type", bug_type(F.get("scorable_line_texts", first)))
    return _hits(rows, k).groupBy(*by, "bug_type").agg(F.count("*").alias("n"), F.avg("_hit").alias("topk"))


def by_label_count(records: DataFrame, k: int = 3) -> DataFrame:
    """Buckets of one, two and more labels; all three are always present."""
    b = F.size(F.array_distinct("buggy_line_indices"))
    names = ["|B|=1", "|B|=2", "|B|>=3"]
    bucket = F.when(b == 1, names[0]).when(b == 2, names[1]).otherwise(names[2])
    cells = [(F.when(bucket == name, F.lit(1)), F.when(bucket == name, F.col("_hit")), name) for name in names]
    one = _hits(M.labelled_fail(records), k).agg(F.array(*[
        F.struct(F.lit(name).alias("bucket"), F.count(flag).alias("n"),
                 F.coalesce(F.avg(h), F.lit(0.0)).alias("topk")) for flag, h, name in cells]).alias("_rows"))
    return one.select(F.inline("_rows"))


def by_length_tertile(records: DataFrame, by: list[str], key: str = "impl_id", k: int = 3) -> DataFrame:
    """Thirds of the records in length order, cut at n//3 and 2n//3."""
    n_lines = F.size("per_line_energies")
    # Narrow rows, written once: placing and summarizing read them several times.
    rows = stable(_hits(M.labelled_fail(records), k).select(*by, key, n_lines.alias("n_lines"), "_hit"))
    placed = row_positions(rows, by, ["n_lines", key])
    n = F.col("position_total")
    third = (
        F.when(F.col("position") < F.floor(n / 3), "short")
        .when(F.col("position") < F.floor(2 * n / 3), "medium").otherwise("long"))
    placed = placed.withColumn("tertile", third)
    keys = [*by, "tertile"]
    stats = placed.groupBy(*keys).agg(
        F.avg("_hit").alias("topk"), F.min("n_lines").alias("min_lines"), F.max("n_lines").alias("max_lines"))
    middle = order_statistics(placed, keys, "n_lines", {"p50_lines": F.floor(F.col("n") / 2)})
    return stats.join(middle, keys)
