"""Registered queries: tables that go to files and come back, maps, rendered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineaudit import bridge
from lineaudit.catalog.comparisons import (
    _CHI, _DELONG, _P_EXACT, _erfc, _latex_p, _latex_pair, _pairs, _target_and_baselines)
from lineaudit.catalog.ranking import r6
from lineaudit.catalog.surfaces import _axis, _record_digests
from lineaudit.functions.binding import let
from lineaudit.operators import manifold as N
from lineaudit.operators import presentation as V
from lineaudit.operators import significance as G
from lineaudit.session import scratch
from lineaudit.sources import blocks as B
from lineaudit.sources import records as R
from lineaudit.sources import sinks as W

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


@query("records_from_json", f"""with {bridge.sql_scored('random')}
select impl_id, spec_id, source, status, round(max(energy), 6) as whole_impl_energy, count(*) as n_lines,
  sha256(string_agg(line_text, chr(10) order by sent_idx)) as lines_sha256, round(sum((sent_idx + 1) * energy), 4) as energy_moment,
  coalesce(string_agg(sent_idx::varchar, ',' order by sent_idx) filter (where buggy), '') as buggy
from scored group by all""")
def records_from_json(spark, d):
    """Records written as JSON lines and read back, the last record of each id."""
    folder = scratch(spark, "records")
    W.write_records(bridge.records(spark, d, "random"), folder)
    back = R.read_keyed_records(spark, folder)
    out = back.select("impl_id", "spec_id", "source", "status", "whole_impl_energy",
                      F.size("per_line_energies").cast("long").alias("n_lines"), *_record_digests())
    return r6(out, "whole_impl_energy").withColumn("energy_moment", F.round("energy_moment", 4))


@query("history_from_json", """
select event_id, coalesce(nullif(case when event_id % 3 = 0 then 0 when event_id % 3 = 1 then user_id end, 0), nullif(event_id // 2, 0), 0) as step,
  round(value, 6) as loss from events""")
def history_from_json(spark, d):
    """Training history written as JSON lines: the step of the trainer, else the logger's, else 0."""
    e, folder = F.col("event_id"), scratch(spark, "history")
    rows = bridge.table(spark, d, "events").select(
        F.when(e % 3 == 0, F.lit(0).cast("long")).when(e % 3 == 1, F.col("user_id")).alias("train/step"),
        F.floor(e / 2).alias("_step"), F.col("value").alias("train/loss"), e.alias("eval/step"))
    rows.write.option("ignoreNullFields", True).json(folder)
    back = R.read_history(spark, folder)
    return r6(back.select(F.col("`eval/step`").alias("event_id"), "step", F.col("`train/loss`").alias("loss")), "loss")


@query("decoded_listing", """
select 'doc-' || doc_id || '.rs' as source_file, length(text) as n_chars, sha256(text) as sha256 from documents""")
def decoded_listing(spark, d):
    """File contents that arrive as base64 text."""
    rows = bridge.table(spark, d, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("source_file"),
        F.base64(F.encode("text", "UTF-8")).alias("content_b64"))
    out = B.decode_listing(rows)
    return out.select("source_file", F.char_length("content").cast("long").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query("html_lines", f"""with {bridge.sql_scored('random')},
z as (select impl_id, sent_idx, line_text, (energy - avg(energy) over w) / coalesce(nullif(stddev_pop(energy) over w, 0), 1) as z
      from scored window w as (partition by impl_id)),
h as (select *, round(120 * (1 - (greatest(-2, least(2, z)) + 2) / 4), 8) as hue from z)
select impl_id, sent_idx::int as sent_idx, '<div style="background:hsl(' || printf('%.1f', hue) || ',70%,85%)">'
  || replace(replace(replace(line_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</div>' as html from h""")
def html_lines(spark, d):
    rows = V.html_rows(F.col("scorable_line_texts"), F.col("per_line_energies"))
    return bridge.records(spark, d, "random").select("impl_id", F.posexplode(rows).alias("sent_idx", "html"))


_FRAME = {0: r"\begin{table}[t]", 1: r"\centering", 2: r"\small", 3: r"\caption{Paired significance tests.}", 4: r"\label{tab:significance}",
          5: r"\begin{tabular}{lrrrrrrr}", 6: r"\toprule",
          7: r"Baseline & $n$ & \multicolumn{2}{c}{top-1} & \multicolumn{2}{c}{top-3} & \multicolumn{2}{c}{AUROC} \\",
          8: r" & & rate & $p$ & rate & $p$ & val & $p$ \\", 9: r"\midrule", 11: r"\bottomrule", 12: r"\end{tabular}", 13: r"\end{table}"}


@query("latex_document", _pairs("[1, 3]") + f", {_DELONG}," + f"""
w as (select run, k, n_paired, tt, bb, case when nd < 25 then {_P_EXACT} else {_erfc('cx')} end as pm from (select *, {_CHI} as cx from e)),
q as (select w.run, any_value(n_paired) as n, max(tt) filter (where k = 1) as t1, max(bb) filter (where k = 1) as b1, max(pm) filter (where k = 1) as p1,
        max(tt) filter (where k = 3) as t3, max(bb) filter (where k = 3) as b3, max(pm) filter (where k = 3) as p3,
        any_value(auc_a) as auc_a, any_value(auc_b) as auc_b, any_value({_erfc('az')}) as pa
      from w join (select *, abs(auc_a - auc_b) / sqrt(2 * var) as az from dl) using (run) group by w.run)
select 10 as position, run, run || ' & ' || n || ' & ' || {_latex_pair('b1', 't1')} || ' & ' || {_latex_p('p1')} || ' & ' || {_latex_pair('b3', 't3')}
  || ' & ' || {_latex_p('p3')} || ' & ' || {_latex_pair('auc_b', 'auc_a')} || ' & ' || {_latex_p('pa')} || ' \\\\' as line from q
""" + "".join(f"union all select {i}, null, '{line}'\n" for i, line in _FRAME.items()))
def latex_document(spark, d):
    return W.latex_document(G.significance_by_k(*_target_and_baselines(spark, d), ks=(1, 3), iters=20))


# -- map of implementations and lines ------------------------------------------------------------

_DIM = 8


def _with_vectors(records):
    """A vector per line, as an encoder would give it: digits of the digest of its text."""
    def vector(text):
        return let(F.sha1(F.encode(text, "UTF-8")), lambda h: F.array(*[
            F.conv(F.substring(h, i + 1, 1), 16, 10).cast("double") * (_DIM - i) for i in range(_DIM)]))

    return records.withColumn("line_vectors", F.transform("scorable_line_texts", vector))


def _map(spark, d):
    folder = scratch(spark, "map")
    impls, lines = N.tables(_with_vectors(bridge.records(spark, d, "random")), bridge.impls(spark, d), dim=_DIM)
    N.write(impls, lines, folder)
    return folder


def _plane(points: str) -> str:
    """x and y of ``points(id, v)`` on their two principal axes, as ``pos(id, x, y)``."""
    n = _DIM
    return f"""
u as (select id, unnest(v) as x, generate_subscripts(v, 1) as i from {points}),
mu as (select i, avg(x) as m from u group by i),
ij as (select a.i, b.i as j, avg(a.x * b.x) - any_value(ma.m * mb.m) as c from u a join u b using (id) join mu ma on ma.i = a.i
       join mu mb on mb.i = b.i group by a.i, b.i),
rw as (select i, list(c order by j) as r from ij group by i),
first_in as (select list(r order by i) as m from rw), {_axis("first", "m", n)},
second_in as (
  select [[m[i][j] - l * v[i] * v[j] for j in range(1, {n + 1})] for i in range(1, {n + 1})] as m
  from (select m, v, list_inner_product([list_inner_product(r, v) for r in m], v) as l from first_in, first)), {_axis("second", "m", n)},
pos as (select id, list_inner_product(c, first.v) as x, list_inner_product(c, second.v) as y from (
  select id, list(x - m order by i) as c from u join mu using (i) group by id), first, second)"""


_VECTOR = "[" + ", ".join(f"('0x' || substr(sha1(line_text), {i + 1}, 1))::int * {_DIM - i}::double" for i in range(_DIM)) + "]"
_POINTS = f"with recursive {bridge.sql_scored('random').removeprefix('with ')}, lv as (select impl_id, sent_idx, {_VECTOR} as v from scored)"


@query("map_lines", _POINTS + ", pt as (select {'i': impl_id, 's': sent_idx} as id, v from lv)," + _plane("pt") + """
select impl_id, sent_idx::int as line_idx, line_text, round(energy, 6) as energy, buggy as is_buggy, status as impl_status,
  round(x, 5) as x, round(y, 5) as y from scored join pos on pos.id.i = impl_id and pos.id.s = sent_idx""")
def map_lines(spark, d):
    out = r6(N.light(spark, _map(spark, d), "lines"), "energy")
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("x", "y")})


@query("map_impls", _POINTS + """,
ex as (select impl_id, unnest(v) as x, generate_subscripts(v, 1) as i from lv),
pt as (select impl_id as id, list(m order by i) as v from (select impl_id, i, avg(x) as m from ex group by all) group by impl_id),""" + _plane("pt") + """,
sib as (select spec_id, count(*) filter (where status = 'PASS') as n from rec group by spec_id)
select impl_id, rec.spec_id, status, round(whole, 6) as whole_impl_energy, n_lines::int as n_lines, n - (status = 'PASS')::int > 0 as has_pass_sibling,
  round(x, 5) as x, round(y, 5) as y from rec join pos on id = impl_id join sib on sib.spec_id = rec.spec_id""")
def map_impls(spark, d):
    out = r6(N.light(spark, _map(spark, d), "impls"), "whole_impl_energy")
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("x", "y")})
