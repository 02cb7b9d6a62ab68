"""Raw corpora to labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit import schemas
from lineaudit.functions import diffs
from lineaudit.functions import status as ST
from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.plans.emit import filter_map
from lineaudit.plans.ordered import row_positions
from lineaudit.session import stable
from lineaudit.sources.arrays import read_arrays
from lineaudit.sources.records import with_file_order

# The label limit, the macro a corpus file must open, tags and id prefixes of the corpora.
MAX_DIFF_LINES = 3
MACRO_LINE = r"(?m)^[ \t]*verus!"
TRAJECTORY, REPAIR, TASK = "system_trajectory", "sft_safe", "humanevalpack_rust"
TRAJECTORY_ID, REPAIR_ID, TASK_ID = "traj-", "safe-", "hep-"
_NO_LABELS = "array<int>"


def read_trajectories(spark: SparkSession, path) -> DataFrame:
    return parse_trajectories(spark.read.schema(schemas.TRAJECTORY).json(path))


def original_item(c: Column) -> Column:
    """struct(input, output) of a JSON text; unreadable text yields NULL fields."""
    return F.from_json(c, "input string, output string")


def parse_trajectories(raw: DataFrame) -> DataFrame:
    """Attempts with a readable implementation; undecided attempts are dropped first."""
    rows = raw.withColumn("status", ST.trajectory(F.coalesce("status", F.lit("")))).filter("status <> 'UNKNOWN'")
    failed = let(original_item(F.col("original_item")), lambda item: F.coalesce(
        T.nonempty(T.rust_block(item["output"])), T.nonempty(T.rust_block(item["input"]))))
    code = F.when(F.col("status") == "PASS", T.nonempty(F.col("verified_code"))).otherwise(failed)
    parts = let(code, lambda c: F.when(c.isNotNull(), T.spec_impl(c)))
    rows = filter_map(rows, parts, lambda p: p.isNotNull() & ~T.is_blank(p["impl"]))
    rows = rows.withColumnsRenamed({"spec": "spec_text", "impl": "impl_text"})
    spec = F.concat(F.lit(TRAJECTORY_ID), F.coalesce(F.col("original_index").cast("string"), F.lit("NA")))
    rep = F.coalesce(F.col("repetition").cast("string"), F.lit("NA"))
    return rows.select(
        F.lit(TRAJECTORY).alias("source"), spec.alias("spec_id"),
        F.concat(spec, F.lit("-rep"), rep).alias("impl_id"), "spec_text", "impl_text", "status",
        F.array().cast(_NO_LABELS).alias("buggy_lines"), F.col("repetition").alias("rep_index"),
        F.col("log").alias("verifier_log"), F.lit(None).cast("string").alias("sibling_impl_id"))


def read_repair_pairs(spark: SparkSession, path, tolerate_truncation: bool = False) -> DataFrame:
    """Broken/fixed pairs from a JSON array (or from JSON lines).

    The strict reader parses a whole array in one task per file. The tolerant one reads a file by ranges of
    bytes in many tasks and stops quietly where a cut-off file ends.
    """
    if tolerate_truncation:
        return parse_repair_pairs(read_arrays(spark, path, schemas.REPAIR_PAIR), ["_path", "_pos"])
    raw = with_file_order(spark.read.schema(schemas.REPAIR_PAIR).option("multiLine", True).json(path))
    return parse_repair_pairs(raw, ["_file_order"])


def debugging_candidates(raw: DataFrame) -> DataFrame:
    """Rows with a broken block and a fixed text; adds ``_broken`` and ``_fixed``."""
    inp, out = F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))
    fixed = F.coalesce(T.nonempty(T.rust_block(out)), T.nonempty(T.strip(out)))
    both = F.struct(T.nonempty(T.rust_block(inp)).alias("_broken"), fixed.alias("_fixed"))
    return filter_map(raw, both, lambda s: s["_broken"].isNotNull() & s["_fixed"].isNotNull())


def with_diff(rows: DataFrame) -> DataFrame:
    """Split both sides and add ``buggy_lines``: changed lines of the broken side."""
    parts = let(T.spec_impl(F.col("_broken")), lambda b: let(T.spec_impl(F.col("_fixed")), lambda f: F.struct(
        b["spec"].alias("b_spec_text"), b["impl"].alias("b_impl_text"), f["impl"].alias("f_impl_text"))))
    rows = filter_map(
        rows, parts, lambda p: ~T.is_blank(p["b_impl_text"]) & ~T.is_blank(p["f_impl_text"]))
    return rows.withColumn("buggy_lines", diffs.first_side()(
        T.splitlines(F.col("b_impl_text")), T.splitlines(F.col("f_impl_text"))))


def parse_repair_pairs(raw: DataFrame, order: list[str], max_diff_lines: int = MAX_DIFF_LINES) -> DataFrame:
    """Two examples per kept pair; pairs are numbered in file order after filtering."""
    rows = with_diff(debugging_candidates(raw)).filter(F.size("buggy_lines").between(1, max_diff_lines))
    rows = rows.withColumn("_log", T.error_block(F.coalesce("input", F.lit("")))).select(
        *order, "_log", "b_spec_text", "b_impl_text", "f_impl_text", "buggy_lines")
    # Numbering looks at the kept pairs three times; the diffs behind them run once.
    rows = row_positions(stable(rows), [], order, "_pair")
    spec = F.concat(F.lit(REPAIR_ID), T.text_hash(F.col("b_spec_text"), 16))
    number = F.col("_pair").cast("string")
    broken, fixed = F.concat(spec, F.lit("-broken-"), number), F.concat(spec, F.lit("-fixed-"), number)
    twins = F.array(
        F.struct(broken.alias("impl_id"), F.col("b_impl_text").alias("impl_text"), F.lit("FAIL").alias("status"),
                 F.col("buggy_lines"), F.col("_log").alias("verifier_log"), fixed.alias("sibling_impl_id")),
        F.struct(fixed.alias("impl_id"), F.col("f_impl_text").alias("impl_text"), F.lit("PASS").alias("status"),
                 F.array().cast(_NO_LABELS).alias("buggy_lines"), F.lit(None).cast("string").alias("verifier_log"),
                 broken.alias("sibling_impl_id")))
    return rows.select(
        F.lit(REPAIR).alias("source"), spec.alias("spec_id"), F.col("b_spec_text").alias("spec_text"),
        F.inline(twins))


def load_all(trajectories: list[DataFrame], pairs: list[DataFrame]) -> DataFrame:
    """Union of all parsed corpora, trajectories first; ``src_ord`` keeps their order."""
    out = None
    for i, df in enumerate([*trajectories, *pairs]):
        df = df.withColumn("src_ord", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# -- mutation-style tasks with a canonical and a broken solution ------------------------

def task_spec(docstring: Column, declaration: Column) -> Column:
    doc = T.strip(F.coalesce(docstring, F.lit("")))
    decl = T.rstrip(F.coalesce(declaration, F.lit("")))
    commented = F.array_join(F.transform(F.split(doc, "\n"), lambda x: F.when(
        x == "", F.lit("//")).otherwise(F.concat(F.lit("// "), x))), "\n")
    return F.when(doc == "", decl).otherwise(T.strip(F.concat(commented, F.lit("\n"), decl)))


def parse_tasks(tasks: DataFrame) -> DataFrame:
    """A passing and a failing example per task with both solutions present."""
    spec = task_spec(F.col("docstring"), F.col("declaration"))
    good, bad = F.coalesce("canonical_solution", F.lit("")), F.coalesce("buggy_solution", F.lit(""))
    sides = F.struct(good.alias("_good"), bad.alias("_bad"))
    rows = filter_map(tasks.withColumn("spec_text", spec), sides,
                      lambda s: ~T.is_blank(s["_good"]) & ~T.is_blank(s["_bad"]))
    rows = rows.withColumn("_diff", diffs.second_side()(T.splitlines(F.col("_good")), T.splitlines(F.col("_bad"))))
    stem = F.concat(F.lit(TASK_ID), F.replace("task_id", F.lit("/"), F.lit("-")))

    def short(kind, c):
        return F.concat(stem, F.lit(f"-{kind}-"), T.text_hash(c, 12))

    def side(kind, text, labels, bug, symptoms):
        return F.struct(
            short(kind, F.concat("spec_text", text)).alias("impl_id"), F.col(text).alias("impl_text"),
            F.lit(kind.upper()).alias("status"), labels.alias("buggy_lines"), F.lit(kind.upper()).alias("outcome"),
            bug.alias("bug_type"), symptoms.alias("failure_symptoms"))

    none = F.lit(None).cast("string")
    both = F.array(
        side("pass", "_good", F.array().cast(_NO_LABELS), none, none),
        side("fail", "_bad", F.col("_diff"), F.col("bug_type"), F.col("failure_symptoms")))
    return rows.select(
        F.lit(TASK).alias("source"), F.col("task_id").alias("source_file"),
        F.coalesce("entry_point", F.lit("")).alias("test_name"), short("spec", F.col("spec_text")).alias("spec_id"),
        "spec_text", F.inline(both))


# -- corpus size ---------------------------------------------------------------------------

def corpus_size(files: DataFrame, pattern: str = MACRO_LINE) -> DataFrame:
    """Files (repo, content) holding the macro: count and bytes per repository."""
    hit = F.col("content").rlike(pattern)
    return files.groupBy("repo").agg(
        F.count_if(hit).alias("n_files"), F.coalesce(F.sum(F.when(hit, F.octet_length("content"))), F.lit(0)).alias("n_bytes"))


def corpus_verdict(sizes: DataFrame) -> DataFrame:
    total = sizes.agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))
    mb = F.floor(F.col("n_bytes") / 1_000_000)
    return total.withColumn("verdict", F.when(mb < 2, "skip").when(mb < 20, "skip unless early").otherwise("worthwhile"))


def read_source_files(spark: SparkSession, path) -> DataFrame:
    """One row per file: (repo, content); the repository is the first folder below path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.rs")
    parts = F.split(F.replace(F.col("_metadata.file_path"), F.lit(path.rstrip("/") + "/"), F.lit("\x00")), "\x00")
    return files.select(F.substring_index(F.element_at(parts, -1), "/", 1).alias("repo"), F.col("value").alias("content"))
