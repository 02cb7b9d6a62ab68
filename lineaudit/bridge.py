"""Views of the test tables in the shape of the engine's own inputs.

Prose has no keywords, comments or markers, so lines picked by a digest of
their own text get one. Everything is a function of the row: no shuffle beyond
the join that attaches the labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.operators import scorers as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rehash an input that has fewer splits than cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _decorate(x: Column, i: Column) -> Column:
    """struct(line, buggy) for one raw line, decided by two hex digits of its digest."""
    digest = F.sha1(F.encode(F.concat(x, F.lit("#"), i.cast("string")), "UTF-8"))

    def body(h):
        d, m = F.substring(h, 1, 1), F.substring(h, 2, 1)
        line = (
            F.when(d == "0", F.concat(F.lit("// "), x))
            .when(d == "1", F.concat(F.lit("    assert "), x))
            .when(d == "2", F.concat(F.lit("  ensures "), x))
            .when(d == "3", F.concat(F.lit("invariant "), x, F.lit(" forall")))
            .otherwise(x))
        marked = F.when(m.isin("0", "1"), F.lit("// FAILS")).when(m == "2", F.lit("// TODO"))
        return F.struct(
            F.when(x == "", x).when(marked.isNotNull(), let(line, lambda v: T.inject_marker(v, marked)))
            .otherwise(line).alias("line"),
            ((x != "") & m.isin("0", "1", "3")).alias("buggy"))

    return let(digest, body)


def impls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as implementations: quality is the status, source and language the spec."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("impl_id"),
        F.concat_ws("-", "source", "lang").alias("spec_id"), "source",
        F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL").otherwise("UNKNOWN").alias("status"),
        F.substring_index("text", "\n", 1).alias("spec_text"),
        F.transform(T.splitlines(F.col("text")), _decorate).alias("_d"))
    return rows.select(
        "impl_id", "spec_id", "source", "status", "spec_text",
        T.join_lines(F.col("_d.line")).alias("impl_text"),
        T.indices_where(F.col("_d.buggy"), lambda b: b).alias("buggy_lines"))


def records(spark: SparkSession, sf_dir: str, *runs: str) -> DataFrame:
    picked = {r: S.SCORERS[r] for r in runs} if runs else S.SCORERS
    return S.score(impls(spark, sf_dir), picked)


# The same views as DuckDB text, written with joins and windows instead of arrays.


def _hits(words) -> str:
    return "(" + " + ".join(f"contains(line_text, '{w}')::int" for w in words) + ")"


SQL_LINES = """
raw as (
  select 'doc-' || d.doc_id as impl_id, d.source || '-' || d.lang as spec_id, d.source,
         case l.quality when 1 then 'PASS' when 0 then 'FAIL' else 'UNKNOWN' end as status,
         string_split(d.text, chr(10)) as parts, split_part(d.text, chr(10), 1) as spec_text
  from documents d left join labels l on l.doc_id = d.doc_id),
cut as (
  select impl_id, spec_id, source, status, unnest(parts) as x, generate_subscripts(parts, 1) - 1 as src_idx,
         len(parts) as n_parts from raw),
kept as (select *, sha1(x || '#' || src_idx) as h from cut where not (x = '' and src_idx = n_parts - 1)),
body as (
  select *, case substr(h, 1, 1) when '0' then '// ' || x when '1' then '    assert ' || x
         when '2' then '  ensures ' || x when '3' then 'invariant ' || x || ' forall' else x end as b from kept),
lines as (
  select impl_id, spec_id, source, status, src_idx,
         case when x = '' then x
              when substr(h, 2, 1) in ('0', '1') then rtrim(b) || case when contains(rtrim(b), '//') then ' ' else '  ' end || '// FAILS'
              when substr(h, 2, 1) = '2' then rtrim(b) || case when contains(rtrim(b), '//') then ' ' else '  ' end || '// TODO'
              else b end as line_text,
         x <> '' and substr(h, 2, 1) in ('0', '1', '3') as buggy from body),
sc as (
  select *, row_number() over (partition by impl_id order by src_idx) - 1 as sent_idx,
         count(*) over (partition by impl_id) as n_lines
  from lines where trim(line_text) <> '' and not starts_with(ltrim(line_text), '//')
       and not starts_with(ltrim(line_text), '/*') and not starts_with(ltrim(line_text), '*'))"""

SQL_ENERGY = {
    "length": "length(trim(line_text))::double",
    "keyword": f"{_hits(T.DSL_KEYWORDS)}::double + 1e-4 * length(trim(line_text))",
    "marker": f"{_hits(T.MARKER_KEYWORDS)}::double + 1e-4 * length(trim(line_text))",
    "random": "('0x' || substr(sha1(line_text || '|' || impl_id), 1, 4))::int / 65536.0::double",
}


def sql_scored(*runs: str) -> str:
    """``scored``: one row per run and scorable line, with its rank in the record;
    ``rec``: one row per run and record."""
    parts = " union all ".join(f"select '{r}' as run, *, {SQL_ENERGY[r]} as energy from sc" for r in (runs or SQL_ENERGY))
    return SQL_LINES + f""",
scored as (
  select *, row_number() over (partition by run, impl_id order by energy desc, sent_idx) as rk from ({parts})),
rec as (
  select run, impl_id, any_value(spec_id) as spec_id, any_value(source) as source, any_value(status) as status,
         max(energy) as whole, count(*) as n_lines, count(*) filter (where buggy) as n_bug,
         min(case when buggy then rk end) as best_rank
  from scored group by run, impl_id)"""
