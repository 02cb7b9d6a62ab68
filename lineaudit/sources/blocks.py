"""Labelled examples from verifier test files: one macro block per test case."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.plans.emit import filter_map

# The head of a test block, tag and id prefix of its examples.
_HEAD = re.compile(
    r"test_verify_one_file!\s*\{\s*(?:#\[(?:test|cfg|ignore)[^\]]*\]\s*)*(?:#\[test\]\s*)?"
    r"(?P<name>[A-Za-z_][A-Za-z0-9_]*)\s+verus_code!\s*\{", re.DOTALL)
SOURCE, ID_PREFIX = "verus_real", "verus-real-"

_BRACE = re.compile(r"[{}]")


def closing_brace(text: str, start: int) -> int | None:
    """Index of the brace closing the block that is open at ``start``."""
    depth = 1
    for m in _BRACE.finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return None


def blocks(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(ordinal, name, body, tail) of each balanced block; tail is the text between it and the next block."""
    heads = list(_HEAD.finditer(text))
    for n, m in enumerate(heads):
        end = closing_brace(text, m.end())
        if end is not None:
            following = next((h.start() for h in heads[n + 1:] if h.start() > end), len(text))
            yield n, m["name"], text[m.end():end], text[end + 1:following]


def _blocks_udf():
    def find(col: pd.Series) -> pd.Series:
        return pd.Series([
            [{"ord": n, "name": name, "body": body, "tail": _outcome_window(tail)} for n, name, body, tail in blocks(t or "")]
            for t in col])
    return F.pandas_udf(find, "array<struct<ord:int,name:string,body:string,tail:string>>")


def _outcome_window(tail: str) -> str:
    """What follows the first arrow."""
    arrow = re.search(r"=>\s*", tail)
    return tail[arrow.end():].lstrip()[:3] if arrow else ""


def parse_blocks(files: DataFrame) -> DataFrame:
    """(source_file, ord, name, body, outcome) from (source_file, content)."""
    found = files.select("source_file", F.inline(_blocks_udf()(F.col("content"))))
    outcome = F.when(F.col("tail").startswith("Ok"), "Ok").when(F.col("tail").startswith("Err"), "Err")
    return found.withColumn("outcome", outcome).filter("outcome IS NOT NULL").drop("tail")


def pair_blocks(found: DataFrame) -> DataFrame:
    """First failing and first passing block per file and base name."""
    base = F.regexp_replace("name", "(_fails|_fail|_FAILS)$", "")
    # A repeated name keeps its first place but its last content.
    same = found.withColumn("base", base).groupBy("source_file", "base", "name").agg(
        F.min("ord").alias("ord"), F.max_by(F.struct("body", "outcome"), "ord").alias("b"))

    def first(outcome):
        hit = F.col("b.outcome") == outcome
        return F.min_by(F.when(hit, F.struct("name", F.col("b.body").alias("body"))),
                        F.when(hit, F.col("ord")))

    pairs = same.groupBy("source_file", "base").agg(
        F.min("ord").alias("ord"), first("Err").alias("f"), first("Ok").alias("p"))
    return pairs.filter("f IS NOT NULL")


def examples(files: DataFrame) -> DataFrame:
    """Labelled examples: a failing side per pair, and its passing side if there is one."""
    pairs = pair_blocks(parse_blocks(files)).select(
        "source_file", "ord", F.col("f.name").alias("f_name"), F.col("f.body").alias("f_body"),
        F.col("p.name").alias("p_name"), F.col("p.body").alias("p_body"))
    def labelled(f, p):
        return F.struct(
            f["spec"].alias("f_spec"), f["impl"].alias("f_impl"), p["spec"].alias("p_spec"), p["impl"].alias("p_impl"),
            T.fails_line_indices(T.splitlines(f["impl"])).alias("_bugs"))

    cut = let(T.heuristic_spec_impl(F.col("f_body")), lambda f: let(
        T.heuristic_spec_impl(F.col("p_body")), lambda p: labelled(f, p)))
    rows = filter_map(pairs, cut, lambda s: (F.size(s["_bugs"]) > 0) | ~T.is_blank(s["f_impl"]))
    # Pairs of one file are numbered in order of first appearance; a file's
    # pairs came out of one text cell, so the array is bounded by it.
    numbered = rows.groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct(
        "ord", "f_name", "f_spec", "f_impl", "p_name", "p_spec", "p_impl", "_bugs"))).alias("_all"))
    rows = numbered.select("source_file", F.posexplode("_all").alias("_n", "x")).select("source_file", "_n", "x.*")
    spec_id = F.concat(
        F.lit(ID_PREFIX), F.regexp_replace("source_file", r"\.rs$", ""), F.lit("-"),
        T.squeeze_hash(F.col("f_spec"), 12))

    def side(kind, p, labels, outcome):
        return F.struct(
            F.col(f"{p}name").alias("test_name"),
            F.concat(spec_id, F.lit(f"-{kind}-"), F.col(f"{p}name"), F.lit("-"), F.col("_n").cast("string")).alias("impl_id"),
            F.col(f"{p}spec").alias("spec_text"), F.col(f"{p}impl").alias("impl_text"),
            F.lit(kind.upper()).alias("status"), labels.alias("buggy_lines"), F.lit(outcome).alias("outcome"))

    both = F.array(
        side("fail", "f_", F.col("_bugs"), "Err"), side("pass", "p_", F.array().cast("array<int>"), "Ok"))
    kept = F.filter(both, lambda s: s["test_name"].isNotNull())
    return rows.select(F.lit(SOURCE).alias("source"), "source_file", spec_id.alias("spec_id"), F.inline(kept))


def read_test_files(spark: SparkSession, path) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.rs")
    return files.select(
        F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("source_file"), F.col("value").alias("content"))


def decode_listing(rows: DataFrame) -> DataFrame:
    """(source_file, content) from files stored as base64 text, as a code host's API returns them."""
    return rows.select("source_file", F.decode(F.unbase64("content_b64"), "UTF-8").alias("content"))
