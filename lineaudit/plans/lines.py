"""Between nested records and the normalized line table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let


def explode_lines(impls: DataFrame) -> DataFrame:
    """One row per source line with both index spaces; ``sent_idx`` is NULL where not scorable."""
    def rows_of(lines):
        def row(src, sent):
            return F.struct(
                src.alias("src_idx"), sent.cast("int").alias("sent_idx"), F.get(lines, src).alias("line_text"),
                F.array_contains("buggy_lines", src).alias("buggy"))

        scored = F.transform(T.scorable_line_indices(lines), lambda src, k: row(src, k))
        other = T.indices_where(lines, lambda x: ~T.is_scorable(x))
        # The row's arrays stay behind: each line leaves with its own values only.
        return F.concat(scored, F.transform(other, lambda src: row(src, F.lit(None))))

    return impls.select("impl_id", "spec_id", "status", F.inline(let(T.splitlines(F.col("impl_text")), rows_of)))


def explode_records(records: DataFrame, keep=("run", "impl_id", "spec_id", "status")) -> DataFrame:
    """One row per scored line of each record."""
    cols = [c for c in keep if c in records.columns]
    rows = F.transform("per_line_energies", lambda e, i: F.struct(
        i.alias("sent_idx"), e.alias("energy"), F.get("scorable_line_texts", i).alias("line_text"),
        F.array_contains("buggy_line_indices", i).alias("is_buggy")))
    return records.select(*cols, F.inline(rows))


def implode_records(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Line rows back to nested records. A group is one record's lines."""
    packed = F.array_sort(F.collect_list(F.struct("sent_idx", "energy", "line_text", "is_buggy")))
    rows = lines.groupBy(*keys).agg(packed.alias("_s"))
    return rows.select(
        *keys, F.array_max("_s.energy").alias("whole_impl_energy"), F.col("_s.energy").alias("per_line_energies"),
        F.transform(F.filter("_s", lambda s: s["is_buggy"]), lambda s: s["sent_idx"]).alias("buggy_line_indices"),
        F.col("_s.line_text").alias("scorable_line_texts"))
