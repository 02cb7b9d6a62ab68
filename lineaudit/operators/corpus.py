"""Audits of raw corpora before they become examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import diffs
from lineaudit.functions import ranking as R
from lineaudit.functions import status as ST
from lineaudit.functions import text as T
from lineaudit.operators import metrics as M
from lineaudit.plans.ordered import order_statistics, row_positions
from lineaudit.session import stable


def status_census(rows: DataFrame) -> DataFrame:
    """Rows by each reading of the raw status (column ``raw``)."""
    read = rows.select(
        ST.verbatim(F.col("raw")).alias("verbatim"), ST.fail_first(F.col("raw")).alias("fail_first"),
        ST.pass_first(F.col("raw")).alias("pass_first"), ST.by_suffix(F.col("raw")).alias("by_suffix"),
        ST.trajectory(F.col("raw")).alias("trajectory"), "raw")
    return read.groupBy("raw", "verbatim", "fail_first", "pass_first", "by_suffix", "trajectory").agg(
        F.count("*").alias("n"))


def log_availability(rows: DataFrame) -> DataFrame:
    """Per raw status: rows, empty logs, mean and maximum length of the others."""
    n = F.coalesce(F.char_length("log"), F.lit(0))
    return rows.groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(n == 0).alias("n_empty"),
        (100 * F.count_if(n == 0) / F.count("*")).alias("empty_pct"),
        F.coalesce(F.avg(F.when(n > 0, n)), F.lit(0.0)).alias("nonempty_mean"), F.max(n).alias("max_len"))


def log_verdict(rows: DataFrame) -> DataFrame:
    failed = rows.filter(F.col("status").isin("error", "timeout"))
    out = failed.agg(F.count("*").alias("n_fail"), F.count_if(
        F.coalesce(F.char_length("log"), F.lit(0)) > 0).alias("n_with_log"))
    return out.withColumn("verdict", F.when(F.col("n_fail") == 0, "no failures")
                          .when(F.col("n_with_log") == 0, "structurally unavailable").otherwise("inspect"))


def trajectory_classes(rows: DataFrame) -> DataFrame:
    """Specs by outcome mix; failing specs also by whether their attempts differ.

    NULL is a value of its own when attempts are compared.
    """
    status = ST.trajectory(F.coalesce("status", F.lit("")))
    output = F.coalesce(F.char_length(F.from_json("original_item", "output string")["output"]), F.lit(0))

    def distinct(c: Column) -> Column:
        return F.count_distinct(c) + F.max(c.isNull().cast("int"))

    specs = rows.groupBy("spec").agg(
        F.bool_or(status == "PASS").alias("any_pass"), F.bool_or(status == "FAIL").alias("any_fail"),
        F.bool_and(status == "PASS").alias("all_pass"), F.bool_and(status == "FAIL").alias("all_fail"),
        ((distinct(F.col("return_code")) > 1) | (distinct(F.col("status")) > 1) | (F.count_distinct(output) > 1))
        .alias("differs"))
    kind = (
        F.when(F.col("any_pass") & F.col("any_fail"), "mixed").when(F.col("all_pass"), "all_pass")
        .when(F.col("all_fail"), "all_fail").otherwise("other"))
    return specs.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(F.col("all_fail") & F.col("differs")).alias("n_differential"))


def first_and_last(rows: DataFrame) -> DataFrame:
    """Per spec with two attempts or more: line diff of its first and last attempt.

    Needs columns spec, repetition, ord and code; of equal repetitions the
    first row opens and the last row closes.
    """
    key = F.struct(F.coalesce("repetition", F.lit(0)), F.col("ord"))
    ends = rows.groupBy("spec").agg(
        F.min_by("code", key).alias("a"), F.max_by("code", key).alias("b"), F.count("*").alias("n_rep"))
    ends = ends.filter("n_rep >= 2 AND a <> '' AND b <> ''")
    la = T.splitlines(F.col("a"))
    return ends.select("spec", F.size(la).alias("n_lines"), F.size(
        diffs.first_side()(la, T.splitlines(F.col("b")))).alias("n_changed"))


def trajectory_diff(rows: DataFrame) -> DataFrame:
    changes = first_and_last(rows).withColumn("share", F.col("n_changed") / F.greatest("n_lines", F.lit(1)))
    n = F.col("n")
    counts = order_statistics(changes, [], "n_changed", {
        "changed_p50": F.floor(n / 2), "changed_p90": F.floor(0.9 * n), "changed_p99": F.floor(0.99 * n),
        "changed_max": n - 1})
    shares = order_statistics(changes, [], "share", {
        "share_p25": F.floor(n / 4), "share_p50": F.floor(n / 2), "share_p75": F.floor(3 * n / 4)}).drop("n")
    near = changes.agg(F.count_if(F.col("share") <= 0.05).alias("n_near_identical"))
    # Three one-row frames side by side.
    return counts.crossJoin(F.broadcast(shares)).crossJoin(F.broadcast(near))


def pair_scan(raw: DataFrame) -> DataFrame:
    """How many raw pairs carry a code block, an error block, or make a debugging candidate."""
    inp, out = F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))
    flags = raw.select(
        T.nonempty(T.rust_block(inp)).isNotNull().alias("block"), T.error_block(inp).isNotNull().alias("err"),
        (T.nonempty(T.rust_block(out)).isNotNull() | (T.strip(out) != "")).alias("fixed"))
    block, err, fixed = F.col("block"), F.col("err"), F.col("fixed")
    res = flags.agg(F.count("*").alias("n_seen"), F.count_if(block).alias("n_with_code"),
                  F.count_if(err).alias("n_with_error"), F.count_if(block & err & fixed).alias("n_candidates"))
    return res.withColumn("candidate_share", F.col("n_candidates") / F.col("n_seen"))


def diff_size_quantiles(diffed: DataFrame, max_lines: int = 3) -> DataFrame:
    """Quantiles of the diff size (column ``n_changed``) and the share within 1..max_lines."""
    n = F.col("n")
    # Both results read the sizes, the quantiles more than once; the diffs behind them run once.
    diffed = stable(diffed.select("n_changed"))
    q = order_statistics(diffed, [], "n_changed", {
        "p25": F.floor(n / 4), "p50": F.floor(n / 2), "p75": F.floor(3 * n / 4), "p99": F.floor(0.99 * n)})
    small = diffed.agg(F.avg(F.col("n_changed").between(1, max_lines).cast("int")).alias("small_share"))
    return q.crossJoin(F.broadcast(small))


def usable_estimate(scan: DataFrame, quantiles: DataFrame, total_rows: int = 6_900_000) -> DataFrame:
    one = scan.crossJoin(F.broadcast(quantiles))
    share = F.col("candidate_share") * F.col("small_share")
    return one.withColumns({
        "usable_share": share, "usable_estimate": F.floor(share * total_rows),
        "worthwhile": (F.col("small_share") > 0.5) & (F.col("candidate_share") > 0.05)})


def line_count_percentiles(examples: DataFrame, by: list[str], ps=(10, 50, 90, 99)) -> DataFrame:
    """Percentiles at position int(p/100*(n-1)) of the implementation line counts."""
    rows = examples.select(*by, F.size(T.splitlines(F.col("impl_text"))).alias("n_lines"))
    last = F.col("n") - 1
    cuts = {f"p{p}": F.least(F.greatest(F.floor(F.lit(p / 100.0) * last), F.lit(0)), last) for p in ps}
    return order_statistics(rows, by, "n_lines", cuts)


def status_pivot(examples: DataFrame) -> DataFrame:
    return examples.groupBy("source").pivot("status", ["PASS", "FAIL", "UNKNOWN"]).agg(F.count(F.lit(1))).na.fill(0)


def spec_mix(examples: DataFrame) -> DataFrame:
    """Specs that have passing and failing examples, only passing, only failing."""
    specs = examples.groupBy("spec_id").agg(
        F.bool_or(F.col("status") == "PASS").alias("p"), F.bool_or(F.col("status") == "FAIL").alias("f"))
    kind = F.when(F.col("p") & F.col("f"), "mixed").when(F.col("p"), "all_pass").when(F.col("f"), "all_fail").otherwise("none")
    return specs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def drop_reasons(examples: DataFrame, token_count: Column, max_length: int) -> DataFrame:
    """Why examples would not reach a trainer."""
    scorable = F.size(T.scorable_texts(T.splitlines(F.col("impl_text"))))
    reason = F.when(scorable == 0, "no_scorable_lines").when(token_count > max_length, "over_max_length").otherwise("kept")
    return examples.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def first_per_group(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in order; a report's sample, hence the limit."""
    placed = row_positions(rows, by, order)
    return placed.filter(F.col("position") < n).drop("position_total")


def tractable() -> Column:
    """One label, 2 to 20 scorable lines, at most 25 text lines."""
    text = F.col("impl_text")
    scorable = F.size(T.scorable_texts(T.splitlines(text)))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (F.size("buggy_lines") == 1) & scorable.between(2, 20) & (newlines + 1 <= 25)


def heatmap_pools(records: DataFrame) -> DataFrame:
    """Records fit for a heat map, split by whether the top line is labelled."""
    e = F.col("per_line_energies")
    rows = M.labelled_fail(records).filter(F.size(e).between(5, 35))
    return rows.withColumn("pool", F.when(
        F.array_contains("buggy_line_indices", R.argmax(e)), "correct").otherwise("wrong"))
