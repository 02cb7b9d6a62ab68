"""Writers. All of them write from the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.sources import named_files

RECORD_COLUMNS = (
    "impl_id", "spec_id", "source", "source_file", "test_name", "status", "whole_impl_energy",
    "per_line_energies", "buggy_line_indices", "scorable_line_texts")


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines with the fixed key set; absent columns become explicit nulls."""
    have = set(records.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in RECORD_COLUMNS]
    records.select(*cols).write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def _no_zeros(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as its rounded value and the error of that rounding (Dekker's splitting)."""
    def halves(x):
        c = x * 134217729.0
        top = c - (c - x)
        return top, x - top

    (ah, al), (bh, bl), p = halves(a), halves(b), a * b
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def _off_tie(x: Column, digits: int) -> Column:
    """``x``, or where its shortest form lies halfway between two numbers of so many digits, the one that the binary value
    is nearer to (the even one if that value is the halfway point itself). Powers of ten up to 22 are exact; beyond
    them the halfway form is rounded up."""
    text = F.format_string(f"%.{digits}e", F.abs(x))
    whole = F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit("")).try_cast("long")
    power = F.substring_index(text, "e", -1).try_cast("int") - digits
    tie = (text.try_cast("double") == F.abs(x)) & (whole % 10 == 5) & F.abs(power).between(0, 22)

    def nearer(s):
        m, q, size = s["m"], s["q"], F.abs(s["x"])
        scale = F.pow(F.lit(10.0), F.abs(q))
        left, left_error = _product(F.when(q > 0, m.cast("double")).otherwise(size), scale)
        right = F.when(q > 0, size).otherwise(m.cast("double"))
        side = ((left - right) + left_error) * F.when(q > 0, -1.0).otherwise(1.0)
        low = F.floor(m / 10)
        up = (side > 0) | ((side == 0) & (low % 2 == 1))
        value = F.concat((low + up.cast("int")).cast("string"), F.lit("e"), (q + 1).cast("string")).try_cast("double")
        return value * F.signum(s["x"])

    return F.when(tie, let(F.struct(whole.alias("m"), power.alias("q"), x.alias("x")), nearer)).otherwise(x)


def fixed(c: Column, places: int) -> Column:
    """A number with so many decimal places, rounded by its binary value as C's %f does (the even one of two equally near);
    for numbers below 1e9."""
    def body(x):
        form, scale = f"%.{places}f", 10.0 ** (places + 1)
        size = F.abs(x)
        m = F.round(size * scale).cast("long")
        tie = (m / F.lit(scale) == size) & (m % 10 == 5)
        p, error = _product(size, F.lit(scale))
        side, low = (p - m) + error, F.floor(m / 10)
        up = (side > 0) | ((side == 0) & (low % 2 == 1))
        return F.format_string(form, F.when(tie, (low + up.cast("int")) / F.lit(10.0 ** places) * F.signum(x)).otherwise(x))

    return let(c.cast("double"), body)


def _significant(c: Column, digits: int) -> Column:
    """A number with so many significant digits and no trailing zeros, as C's %g prints it."""
    def body(x):
        scientific = F.format_string(f"%.{digits - 1}e", x)
        # The exponent after rounding to the wanted digits.
        exponent = F.substring_index(scientific, "e", -1).try_cast("int")
        plain = F.format_string(f"%.{digits + 4}f", scientific.try_cast("double"))
        short = F.concat(_no_zeros(F.substring_index(scientific, "e", 1)), F.lit("e"),
                         F.substring_index(scientific, "e", -1))
        return (
            F.when(F.isnan(x), F.lit("nan")).when(x == 0, F.lit("0"))
            .when(F.abs(x) == math.inf, F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when((exponent < -4) | (exponent >= digits), short).otherwise(_no_zeros(plain)))

    return let(c.cast("double"), lambda v: let(_off_tie(v, digits), body))


def csv_table(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles printed with ``digits`` significant digits, NaN as ``nan``."""
    return df.select(*[
        _significant(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    csv_table(df).write.option("header", True).csv(path)


def _latex_p(c: str) -> Column:
    x = F.col(c)
    power = F.concat(
        F.lit("$"), F.substring_index(F.format_string("%.2e", x), "e", 1), F.lit(r"\times 10^{"),
        F.substring_index(F.format_string("%.2e", x), "e", -1).cast("int").cast("string"), F.lit("}$"))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("---")).when(x < 1e-4, F.lit(r"$<10^{-4}$"))
        .when(x < 1e-3, power).otherwise(F.format_string("$%.3f$", x)))


def _latex_pair(base: str, target: str) -> Column:
    """Baseline against target, the target bold where it wins; a missing one is a dash."""
    def number(c):
        return F.when(F.col(c).isNull(), F.lit("---")).otherwise(F.format_string("%.3f", F.col(c)))

    t, b = number(target), number(base)
    bold = F.when(F.col(target) > F.col(base), F.concat(F.lit(r"\textbf{"), t, F.lit("}"))).otherwise(t)
    return F.concat(b, F.lit(" vs "), bold)


def _latex_name() -> Column:
    return F.replace(F.replace("run", F.lit("_records"), F.lit("")), F.lit("_"), F.lit(" "))


def latex_rows(table: DataFrame) -> DataFrame:
    """One table line per baseline: baseline against target, the target bold where it wins."""
    cells = F.concat_ws(
        " & ", _latex_name(), F.col("n_paired").cast("string"), _latex_pair("baseline_topk", "target_topk"), _latex_p("p_mcnemar"),
        _latex_pair("auc_b", "auc_a"), _latex_p("p"))
    return table.select("run", F.concat(cells, F.lit(r" \\")).alias("line"))


def latex_document(table: DataFrame, ks: tuple[int, ...] = (1, 3), caption: str = "Paired significance tests.",
                   label: str = "tab:significance", interval: bool = False) -> DataFrame:
    """(position, run, line): the whole LaTeX table of a ``significance_by_k`` result, in the order of ``position``, then ``run``.

    Every baseline has its rate pair and p-value for each k, its AUROC pair and p-value and, with ``interval``, the resampled
    95 % interval of the difference of the areas. ``run`` is NULL on the lines around the rows; missing values are dashes.
    """
    cells = [_latex_name(), F.col("n_paired").cast("string")]
    for k in ks:
        cells += [_latex_pair(f"baseline_top{k}", f"target_top{k}"), _latex_p(f"p_mcnemar_top{k}")]
    cells += [_latex_pair("auc_b", "auc_a"), _latex_p("p")]
    if interval:
        cells.append(F.when(F.col("diff_lo").isNull(), F.lit("---")).otherwise(
            F.format_string("[%.3f, %.3f]", F.col("diff_lo"), F.col("diff_hi"))))
    names = [f"top-{k}" for k in ks] + ["AUROC"]
    end = r" \\"
    head = [r"\begin{table}[t]", r"\centering", r"\small", rf"\caption{{{caption}}}", rf"\label{{{label}}}",
            rf"\begin{{tabular}}{{l{'r' * (len(cells) - 1)}}}", r"\toprule",
            "Baseline & $n$ & " + " & ".join(rf"\multicolumn{{2}}{{c}}{{{n}}}" for n in names) + (" & 95 \\% of the difference" if interval else "") + end,
            " & & " + " & ".join(["rate & $p$"] * len(ks) + ["val & $p$"]) + (" & " if interval else "") + end, r"\midrule"]
    foot = [r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    around = [(i, line) for i, line in enumerate(head)] + [(len(head) + 1 + i, line) for i, line in enumerate(foot)]
    fixed = table.sparkSession.createDataFrame(around, "position int, line string").select(
        "position", F.lit(None).cast("string").alias("run"), "line")
    return fixed.unionByName(table.select(F.lit(len(head)).alias("position"), "run", F.concat(F.concat_ws(" & ", *cells), F.lit(end)).alias("line")))


# -- one file per implementation --------------------------------------------------------

def impl_payloads(impls: DataFrame, lines: DataFrame) -> DataFrame:
    """(impl_id, file_name, payload): an implementation and its lines as one JSON text.

    The grouping is bounded by the lines of one implementation.
    """
    grouped = lines.groupBy("impl_id").agg(F.array_sort(F.collect_list(F.struct(
        "line_idx", "line_text", "energy", "is_buggy"))).alias("lines"))
    rows = impls.join(grouped, "impl_id")
    body = F.to_json(F.struct(F.struct(*[c for c in impls.columns]).alias("impl"), "lines"))
    return rows.select("impl_id", F.concat(T.file_safe(F.col("impl_id")), F.lit(".json")).alias("file_name"),
                       body.alias("payload"))


def write_payloads(payloads: DataFrame, folder: str) -> DataFrame:
    """Write the files under ``folder``; returns the manifest (impl_id, file_name). File names are unique."""
    named_files.register(payloads.sparkSession)
    payloads.select("file_name", "payload").write.format("named_files").mode("append").save(folder)
    return payloads.select("impl_id", "file_name")


def read_payloads(manifest: DataFrame, folder: str) -> DataFrame:
    """(file_name, content) of the files that ``write_payloads`` has written."""
    return named_files.read(manifest, folder)


def summary_json(row: DataFrame) -> DataFrame:
    """A one-row frame as one JSON text."""
    return row.select(F.to_json(F.struct("*")).alias("summary"))

