"""Registered queries: surfaces, heat maps, repair tables, resampling, batches, writers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lineaudit import bridge
from lineaudit.catalog.ranking import r6
from lineaudit.functions import ranking as R
from lineaudit.functions import text as T
from lineaudit.operators import field as D
from lineaudit.operators import metrics as M
from lineaudit.operators import presentation as V
from lineaudit.operators import repair as Q
from lineaudit.operators import sampling as Z
from lineaudit.operators import significance as G
from lineaudit.plans.lines import explode_records, implode_records
from lineaudit.plans.ordered import order_statistics
from lineaudit.sources import sinks as W
from lineaudit.sources.records import last_per_key
from lineaudit.session import scratch, stable, written
from lineaudit.streaming import records as SR

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _points(spark, d):
    e = bridge.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"),
                    F.get("embedding", F.lit(1)).cast("double").alias("y"), F.col("label").cast("double").alias("energy"))


_G = 24
_FIELD = f"""with p as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, label::double as energy from embeddings),
b as (select min(x) - 0.05 * (max(x) - min(x)) as x0, max(x) + 0.05 * (max(x) - min(x)) as x1,
        min(y) - 0.05 * (max(y) - min(y)) as y0, max(y) + 0.05 * (max(y) - min(y)) as y1 from p),
nn as (select f.id, sqrt((f.x - p.x) ** 2 + (f.y - p.y) ** 2) as dist,
         row_number() over (partition by f.id order by sqrt((f.x - p.x) ** 2 + (f.y - p.y) ** 2), p.id) as r from p f, p),
h as (select median(dist) * 1.2 as h from nn where r between 2 and 6),
c as (select iy, ix, x0 + (x1 - x0) * ix / {_G - 1} as gx, y0 + (y1 - y0) * iy / {_G - 1} as gy
      from b, (select unnest(range({_G})) as iy), (select unnest(range({_G})) as ix)),
k as (select c.*, sqrt((x - gx) ** 2 + (y - gy) ** 2) as dist, energy,
        row_number() over (partition by iy, ix order by sqrt((x - gx) ** 2 + (y - gy) ** 2), id) as r from c, p),
fl as (select iy::int as iy, ix::int as ix, gx, gy, sum(exp(-dist * dist / (2 * h * h)) * energy)
         / greatest(sum(exp(-dist * dist / (2 * h * h))), 1e-8) as energy from k, h where r <= 20 group by all)"""


@query("energy_field", _FIELD + """
select iy, ix, round(gx, 6) as gx, round(gy, 6) as gy, round(energy, 6) as energy from fl""")
def energy_field(spark, d):
    return r6(D.energy_field(_points(spark, d), _G), "gx", "gy", "energy")


@query("field_gradient", _FIELD + """,
g as (select *, lag(energy) over (partition by iy order by ix) as a, lead(energy) over (partition by iy order by ix) as b,
   lag(energy) over (partition by ix order by iy) as c, lead(energy) over (partition by ix order by iy) as d from fl)
select iy, ix, round(case when a is null then b - energy when b is null then energy - a else (b - a) / 2 end, 6) as ex,
  round(case when c is null then d - energy when d is null then energy - c else (d - c) / 2 end, 6) as ey from g""")
def field_gradient(spark, d):
    return r6(D.gradient(D.energy_field(_points(spark, d), _G)).select("iy", "ix", "ex", "ey"), "ex", "ey")


_GRAD = """,
g0 as (select *, lag(energy) over (partition by iy order by ix) as a, lead(energy) over (partition by iy order by ix) as b,
   lag(energy) over (partition by ix order by iy) as c, lead(energy) over (partition by ix order by iy) as d from fl),
g as (select iy, ix, gx, gy, case when a is null then b - energy when b is null then energy - a else (b - a) / 2 end as ex,
  case when c is null then d - energy when d is null then energy - c else (d - c) / 2 end as ey from g0)"""


@query("field_arrows", _FIELD + _GRAD + """,
s as (select greatest(max(abs(ex)), max(abs(ey)), 1e-8) as top, 0.8 * greatest((max(gx) - min(gx)) / 8, (max(gy) - min(gy)) / 8) as len from g)
select iy, ix, round(gx, 6) as x0, round(gy, 6) as y0, round(gx - ex / top * len, 6) as x1, round(gy - ey / top * len, 6) as y1
from g, s where ix % 3 = 0 and iy % 3 = 0""")
def field_arrows(spark, d):
    return r6(D.arrows(D.energy_field(_points(spark, d), _G), _G, 8), "x0", "y0", "x1", "y1")


@query("field_color_range", _FIELD + """
select round(quantile_cont(energy, 0.05), 6) as energy_min, round(quantile_cont(energy, 0.95), 6) as energy_max from fl""")
def field_color_range(spark, d):
    return r6(D.color_range(D.energy_field(_points(spark, d), _G)), "energy_min", "energy_max")


@query("field_bilinear", _FIELD + f""",
bx as (select min(gx) as x0, max(gx) as x1, min(gy) as y0, max(gy) as y1 from fl),
q0 as (select id, (x - x0) / (x1 - x0) * {_G - 1} as u, (y - y0) / (y1 - y0) * {_G - 1} as v from p, bx),
q as (select *, greatest(0, least({_G - 2}, floor(u)))::int as u0, greatest(0, least({_G - 2}, floor(v)))::int as v0 from q0)
select id as qid, round(sum(energy * (case when fl.ix = u0 then 1 - (u - u0) else u - u0 end)
   * (case when fl.iy = v0 then 1 - (v - v0) else v - v0 end)), 6) as energy
from q join fl on fl.ix in (u0, u0 + 1) and fl.iy in (v0, v0 + 1) group by id""")
def field_bilinear(spark, d):
    pts = _points(spark, d)
    out = D.bilinear(D.energy_field(pts, _G), pts.select(F.col("id").alias("qid"), "x", "y"), _G)
    return r6(out, "energy")


@query("field_blur", _FIELD + f""",
kn as (select o, exp(-0.5 * o * o) as w from (select unnest(range(-4, 5)) as o)),
kw as (select o, w / (select sum(w) from kn) as w from kn),
sp as (select iy, ix, w, case when m < {_G} then m else {2 * _G - 1} - m end as t
       from (select iy, ix, w, (ix + o + {2 * _G}) % {2 * _G} as m from fl, kw)),
bx as (select sp.iy, sp.ix, sum(w * fl.energy) as energy from sp join fl on fl.iy = sp.iy and fl.ix = sp.t group by all),
sy as (select iy, ix, w, case when m < {_G} then m else {2 * _G - 1} - m end as t
       from (select iy, ix, w, (iy + o + {2 * _G}) % {2 * _G} as m from fl, kw))
select sy.iy, sy.ix, round(sum(w * bx.energy), 6) as energy from sy join bx on bx.ix = sy.ix and bx.iy = sy.t group by all""")
def field_blur(spark, d):
    return r6(D.gaussian_blur(D.energy_field(_points(spark, d), _G), _G, 1.0), "energy")


@query("point_thinning", """
with o as (select vec_id as id, row_number() over (order by vec_id) - 1 as p, count(*) over () as n from embeddings),
s as (select distinct floor(i * (select max(n) - 1 from o) / 99.0)::bigint as p from (select unnest(range(100)) as i))
select id from o where n <= 100 or p in (select p from s)""")
def point_thinning(spark, d):
    return D.thin(_points(spark, d), ["id"], 100).select("id")


@query("index_color_range", """
with o as (select embedding[1]::double as v, row_number() over (order by embedding[1]) - 1 as i, count(*) over () as n from embeddings)
select max(n) as n, round(max(case when i = floor(0.05::double * n) then v end), 6) as lo, round(max(case when i = floor(0.95::double * n) then v end), 6) as hi from o""")
def index_color_range(spark, d):
    return r6(order_statistics(_points(spark, d), [], "x", D.index_color_cuts()), "lo", "hi")


@query("mean_embedding", """
select label, i - 1 as dim, round(avg(embedding[i]::double), 6) as mean from embeddings, (select unnest(range(1, 65)) as i) group by all""")
def mean_embedding(spark, d):
    rows = D.mean_vectors(bridge.table(spark, d, "embeddings"), ["label"], "embedding")
    out = rows.select("label", F.posexplode("embedding").alias("dim", "mean")).withColumn("dim", F.col("dim").cast("long"))
    return r6(out, "mean")


@query("embedding_surgery", """
with m as (select i, avg(embedding[i]::double) as m from embeddings, (select unnest(range(1, 65)) as i) where vec_id in (10, 11, 12) group by i)
select vec_id as id, i - 1 as dim, round(case when vec_id in (1, 2) then m else embedding[i]::double end, 6) as value from embeddings, m""")
def embedding_surgery(spark, d):
    rows = bridge.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = D.mean_row_surgery(rows, [1, 2], [10, 11, 12]).select("id", F.posexplode("vec").alias("dim", "value"))
    return r6(out.withColumn("dim", F.col("dim").cast("long")), "value")


def _axis(name: str, matrix: str, n: int = 64) -> str:
    """Strongest direction of a symmetric matrix: squared until only that direction is left, then one of its rows."""
    return f"""
{name}_p as (
  select 0 as step, {matrix} as p from {name}_in
  union all
  select step + 1, [[x / t for x in r] for r in q] from (
    select step, q, list_sum([q[i][i] for i in range(1, {n + 1})]) as t from (
      select step, [[list_inner_product(r, c) for c in p] for r in p] as q from {name}_p where step < 30))),
{name}_r as (select p, list_position([p[i][i] for i in range(1, {n + 1})], list_max([p[i][i] for i in range(1, {n + 1})])) as peak
  from {name}_p where step = 30),
{name} as (select [x / sqrt(list_inner_product(p[peak], p[peak])) for x in p[peak]] as v from {name}_r)"""


_AXES = f"""with recursive e as (select vec_id, [x::double for x in embedding] as v from embeddings),
u as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from e),
mu as (select i, avg(x) as m from u group by i),
d as (select vec_id, i, x - m as x from u join mu using (i)),
ij as (select a.i, b.i as j, avg(a.x * b.x) as c from d a join d b using (vec_id) group by all),
rw as (select i, list(c order by j) as r from ij group by i),
first_in as (select list(r order by i) as m from rw), {_axis("first", "m")},
second_in as (
  select [[m[i][j] - l * v[i] * v[j] for j in range(1, 65)] for i in range(1, 65)] as m
  from (select m, v, list_inner_product([list_inner_product(r, v) for r in m], v) as l from first_in, first)), {_axis("second", "m")}"""


@query("projection_2d", _AXES + """,
c as (select vec_id, list(x order by i) as x from d group by vec_id)
select vec_id, round(list_inner_product(x, first.v), 6) as x, round(list_inner_product(x, second.v), 6) as y from c, first, second""")
def projection_2d(spark, d):
    out = D.project_2d(bridge.table(spark, d, "embeddings"), "embedding")
    return r6(out.select("vec_id", "x", "y"), "x", "y")


@query("top_features", """
with u as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings),
r as (select *, row_number() over (partition by vec_id order by v desc, i) as r from u)
select vec_id, i::int as idx, round(v, 6) as contrib from r where r <= 10""")
def top_features(spark, d):
    rows = bridge.table(spark, d, "embeddings").select("vec_id", F.inline(R.top_features(
        F.col("embedding").cast("array<double>"), 10)))
    return r6(rows, "contrib")


# -- heat maps and overlays -----------------------------------------------------------------

@query("heat_cells", f"""with {bridge.sql_scored('random')},
z as (select impl_id, sent_idx, (energy - avg(energy) over w) / coalesce(nullif(stddev_pop(energy) over w, 0), 1) as z
      from scored window w as (partition by impl_id))
select impl_id, sent_idx::int as sent_idx, round(z, 6) as z, round(120 * (1 - (greatest(-2, least(2, z)) + 2) / 4), 6) as hue from z""")
def heat_cells(spark, d):
    rows = bridge.records(spark, d, "random").select(
        "impl_id", F.posexplode(V.heat(F.col("per_line_energies"))).alias("sent_idx", "h"))
    return r6(rows.select("impl_id", "sent_idx", "h.z", "h.hue"), "z", "hue")


@query("min_max_energies", f"""with {bridge.sql_scored('random')},
z as (select impl_id, sent_idx, energy, min(energy) over w as lo, max(energy) over w as hi from scored window w as (partition by impl_id))
select impl_id, sent_idx::int as sent_idx, round(case when hi > lo then (energy - lo) / (hi - lo) else energy end, 6) as e from z""")
def min_max_energies(spark, d):
    rows = bridge.records(spark, d, "random").select(
        "impl_id", F.posexplode(R.min_max(F.col("per_line_energies"))).alias("sent_idx", "e"))
    return r6(rows, "e")


_TXT = """t as (select l.impl_id, any_value(l.spec_id) as spec_id, any_value(l.status) as status, count(*) as n,
   string_agg(line_text, chr(10) order by src_idx) as t,
   string_agg(regexp_replace(line_text, '(?i)\\s*//\\s*(FAILS|FIXME|fails[-_].*|expected[-_]fail.*)\\b.*$', ''), chr(10) order by src_idx) as c
   from lines l group by l.impl_id)"""


@query("corruption_variants", f"""with {bridge.SQL_LINES}, {_TXT},
f as (select spec_id, arg_min(t, (n, impl_id)) as t, arg_min(c, (n, impl_id)) as c from t where status = 'FAIL' group by 1),
p as (select spec_id, arg_min(t, (n, impl_id)) as t from t where status = 'PASS' group by 1)
select spec_id, 'fail_original' as kind, sha1(f.t) as digest from f join p using (spec_id)
union all select spec_id, 'fail_marker_stripped', sha1(f.c) from f join p using (spec_id) where f.c <> f.t
union all select spec_id, 'pass_sibling', sha1(p.t) from f join p using (spec_id)""")
def corruption_variants(spark, d):
    rows = bridge.impls(spark, d).filter(F.col("impl_text") != "")
    return V.corruption_variants(rows).select("spec_id", "kind", F.sha1(F.encode("impl_text", "UTF-8")).alias("digest"))


@query("variant_overlay", f"""with {bridge.SQL_LINES}, {_TXT},
f as (select spec_id, arg_min(impl_id, (n, impl_id)) as id, arg_min(t, (n, impl_id)) as t, arg_min(c, (n, impl_id)) as c from t where status = 'FAIL' group by 1),
p as (select spec_id, arg_min(t, (n, impl_id)) as t from t where status = 'PASS' group by 1),
v as (select spec_id, 'fail_original' as kind, f.t as x from f join p using (spec_id)
  union all select spec_id, 'fail_marker_stripped', f.c from f join p using (spec_id) where f.c <> f.t
  union all select spec_id, 'pass_sibling', p.t from f join p using (spec_id)),
n as (select *, len(string_split(x, chr(10))) as nl from v),
ln as (select spec_id, kind, unnest(string_split(x, chr(10))) as text, generate_subscripts(string_split(x, chr(10)), 1) - 1 as i from v),
lg as (select spec_id, arg_max(kind, (nl, kind)) as kind from n group by 1),
tm as (select ln.spec_id, ln.i, ln.text from ln join lg using (spec_id, kind)),
e as (select spec_id, kind, trim(text) as t, arg_max(length(trim(text))::double, i) as energy from ln
      where trim(text) <> '' and not starts_with(trim(text), '//') and not starts_with(trim(text), '/*') and not starts_with(trim(text), '*') group by all)
select tm.spec_id as example, tm.i::int as row, tm.text, e.kind, e.energy from tm left join e on e.spec_id = tm.spec_id and e.t = trim(tm.text)""")
def variant_overlay(spark, d):
    from lineaudit.operators import scorers as S
    rows = bridge.impls(spark, d).filter(F.col("impl_text") != "")
    v = V.corruption_variants(rows).select("spec_id", "kind", "impl_text").withColumn(
        "lines", T.splitlines(F.col("impl_text"))).withColumn("scorable_line_texts", T.scorable_texts(F.col("lines")))
    v = v.withColumn("per_line_energies", S.length(F.col("scorable_line_texts"), F.col("kind")))
    return V.overlay(v.withColumnRenamed("spec_id", "example"))


@query("top_lines", f"""with {bridge.sql_scored('random')}
select impl_id, sent_idx::int as sent_idx, round(energy, 6) as energy from scored
order by scored.energy desc, impl_id, sent_idx limit 30""")
def top_lines(spark, d):
    rows = explode_records(bridge.records(spark, d, "random"))
    return r6(rows.orderBy(F.desc("energy"), "impl_id", "sent_idx").limit(30).select("impl_id", "sent_idx", "energy"), "energy")


@query("line_page", f"""with {bridge.sql_scored('random')}
select impl_id, sent_idx::int as sent_idx from scored order by impl_id, sent_idx limit 50 offset 100""")
def line_page(spark, d):
    rows = explode_records(bridge.records(spark, d, "random")).select("impl_id", "sent_idx")
    return D.page(rows, ["impl_id", "sent_idx"], 50, 100)


# -- interchange forms --------------------------------------------------------------------------

@query("exploded_records", f"""with {bridge.sql_scored()}
select run, impl_id, sent_idx::int as sent_idx, round(energy, 6) as energy, buggy as is_buggy from scored""")
def exploded_records(spark, d):
    return r6(explode_records(bridge.records(spark, d)).select("run", "impl_id", "sent_idx", "energy", "is_buggy"), "energy")


def _record_digests():
    """Texts, energies and labels of a record, each with its order, in three columns."""
    weighted = F.transform("per_line_energies", lambda e, i: e * (i + 1))
    return [F.sha2(F.array_join("scorable_line_texts", "\n"), 256).alias("lines_sha256"),
            F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x).alias("energy_moment"),
            F.array_join("buggy_line_indices", ",").alias("buggy")]


@query("imploded_records", f"""with {bridge.sql_scored('random', 'keyword')}
select run, impl_id, spec_id, status, round(max(energy), 6) as whole_impl_energy, count(*) as n_lines, count(*) filter (where buggy) as n_bug,
  sha256(string_agg(line_text, chr(10) order by sent_idx)) as lines_sha256, round(sum((sent_idx + 1) * energy), 4) as energy_moment,
  coalesce(string_agg(sent_idx::varchar, ',' order by sent_idx) filter (where buggy), '') as buggy
from scored group by run, impl_id, spec_id, status""")
def imploded_records(spark, d):
    rows = explode_records(bridge.records(spark, d, "random", "keyword"))
    out = implode_records(rows, ["run", "impl_id", "spec_id", "status"])
    return r6(out.select("run", "impl_id", "spec_id", "status", "whole_impl_energy",
                         F.size("per_line_energies").cast("long").alias("n_lines"),
                         F.size("buggy_line_indices").cast("long").alias("n_bug"), *_record_digests()),
              "whole_impl_energy").withColumn("energy_moment", F.round("energy_moment", 4))


@query("payload_files", f"""with {bridge.sql_scored('random')}
select impl_id, spec_id, status, replace(replace(impl_id, '/', '__'), chr(92), '__') || '.json' as file_name, count(*) as n_lines,
  sha256(string_agg(sent_idx || ':' || buggy || ':' || line_text, chr(10) order by sent_idx)) as lines_sha256,
  round(sum(energy), 6) as energy, round(max(energy), 6) as whole from scored group by impl_id, spec_id, status""")
def payload_files(spark, d):
    """Written to files and read back from them."""
    recs = written(bridge.records(spark, d, "random"), scratch(spark, "scored"))
    impls = recs.select("impl_id", "spec_id", "status", "whole_impl_energy")
    folder = scratch(spark, "payloads")
    manifest = W.write_payloads(W.impl_payloads(impls, D.line_points(recs)), folder)
    files = W.read_payloads(manifest, folder).select("file_name", F.from_json(F.decode("content", "UTF-8"), """
        impl struct<impl_id: string, spec_id: string, status: string, whole_impl_energy: double>,
        lines array<struct<line_idx: int, line_text: string, energy: double, is_buggy: boolean>>""").alias("p"))
    text = F.array_join(F.transform("p.lines", lambda x: F.concat_ws(":", x["line_idx"], x["is_buggy"], x["line_text"])), "\n")
    out = files.select("p.impl.impl_id", "p.impl.spec_id", "p.impl.status", "file_name", F.size("p.lines").cast("long").alias("n_lines"),
                       F.sha2(text, 256).alias("lines_sha256"), F.aggregate("p.lines.energy", F.lit(0.0), lambda a, x: a + x).alias("energy"),
                       F.col("p.impl.whole_impl_energy").alias("whole"))
    return r6(out, "energy", "whole")


@query("csv_numbers", "select event_id, " + ", ".join(f"case when {x} = 0 then '0' else printf('%.6g', {x}) end as {c}" for c, x in {
    "value": "value", "third": "(value / 3)", "large": "(value * 123457.0)", "small": "(value / 12345700.0)", "log_value": "ln(value + 0.001)"}.items()) + " from events")
def csv_numbers(spark, d):
    v = F.col("value")
    return W.csv_table(bridge.table(spark, d, "events").select(
        "event_id", "value", (v / 3).alias("third"), (v * 123457.0).alias("large"), (v / 12345700.0).alias("small"),
        F.log(v + 0.001).alias("log_value")))


@query("summary_json")
def summary_json(spark, d):
    return W.summary_json(Q.arm_summary(_arms(spark, d), _ARMS, "original"))


# -- repair experiment ------------------------------------------------------------------------------

_ARMS = ["arm_a", "arm_b", "arm_c"]


def _arms(spark, d):
    h = F.sha1(F.encode("impl_id", "UTF-8"))

    def yes(at, digits):
        return F.substring(h, at, 1).isin(*digits)

    return bridge.impls(spark, d).select(
        "impl_id", yes(1, "0123").alias("arm_a"), F.when(~yes(5, "f"), yes(2, "01234")).alias("arm_b"),
        yes(3, "012345").alias("arm_c"), yes(4, "0").alias("original"))


_ARM_SQL = """with h as (select 'doc-' || doc_id as impl_id, sha1('doc-' || doc_id) as h from documents),
a as (select impl_id, substr(h, 1, 1) in ('0', '1', '2', '3') as a,
   coalesce(case when substr(h, 5, 1) <> 'f' then substr(h, 2, 1) in ('0', '1', '2', '3', '4') end, false) as b,
   substr(h, 3, 1) in ('0', '1', '2', '3', '4', '5') as c, substr(h, 4, 1) = '0' as o from h)"""


ORACLE["summary_json"] = _ARM_SQL + """
select to_json({'n': count(*), 'arm_a_n': count(*) filter (where a), 'arm_a_rate': avg(a::int), 'arm_b_n': count(*) filter (where b),
  'arm_b_rate': avg(b::int), 'arm_c_n': count(*) filter (where c), 'arm_c_rate': avg(c::int), 'original_n': count(*) filter (where o),
  'original_rate': avg(o::int), 'union_rate': avg((a or b or c)::int), 'intersection_rate': avg((a and b and c)::int)})::varchar as summary from a"""


@query("repair_summary", _ARM_SQL + """
select count(*) as n, count(*) filter (where a) as arm_a_n, round(avg(a::int), 6) as arm_a_rate, count(*) filter (where b) as arm_b_n,
  round(avg(b::int), 6) as arm_b_rate, count(*) filter (where c) as arm_c_n, round(avg(c::int), 6) as arm_c_rate,
  count(*) filter (where o) as original_n, round(avg(o::int), 6) as original_rate,
  round(avg((a or b or c)::int), 6) as union_rate, round(avg((a and b and c)::int), 6) as intersection_rate from a""")
def repair_summary(spark, d):
    out = Q.arm_summary(_arms(spark, d), _ARMS, "original")
    return r6(out, *[c for c in out.columns if c.endswith("_rate")])


@query("repair_pairwise", _ARM_SQL + """,
p as (
select 'arm_a' as arm1, 'arm_b' as arm2, count(*) filter (where a and not b) as only_arm1, count(*) filter (where b and not a) as only_arm2 from a
union all select 'arm_a', 'arm_c', count(*) filter (where a and not c), count(*) filter (where c and not a) from a
union all select 'arm_b', 'arm_c', count(*) filter (where b and not c), count(*) filter (where c and not b) from a),
t as (select *, only_arm1 + only_arm2 as n, list_transform(range(least(only_arm1, only_arm2) + 1), lambda i:
  lgamma(only_arm1 + only_arm2 + 1) - lgamma(i + 1) - lgamma(only_arm1 + only_arm2 - i + 1) - (only_arm1 + only_arm2 - 1) * ln(2)) as logs from p),
l as (select *, case when n = 0 then 0.0 else least(0.0, list_max(logs) + ln(list_sum([exp(x - list_max(logs)) for x in logs]))) end as log_p from t)
select arm1, arm2, only_arm1, only_arm2, round(exp(log_p), 6) as p, round(log_p / ln(10), 5) as log10_p from l""")
def repair_pairwise(spark, d):
    out = r6(Q.pairwise(_arms(spark, d), _ARMS), "p")
    return out.withColumn("log10_p", F.round("log10_p", 5) + F.lit(0.0))


@query("repair_rerun_merge", _ARM_SQL + """
select impl_id, case when o then true else b end as arm_b from a""")
def repair_rerun_merge(spark, d):
    rows = _arms(spark, d).withColumn("arm_b", F.coalesce("arm_b", F.lit(False)))
    rerun = rows.filter("original").select("impl_id", F.lit(True).alias("arm_b"))
    return Q.merge_rerun(rows, rerun, ["arm_b"]).select("impl_id", "arm_b")


@query("usage_totals", """
select event_type as model, count(*) as n, count(*) filter (where value < 2) as n_failed,
  sum(json_extract_string(props, '$.k')::bigint)::bigint as tokens_in, sum(user_id)::bigint as tokens_out from events group by event_type""")
def usage_totals(spark, d):
    ev = bridge.table(spark, d, "events")
    return Q.usage_totals(ev.select(
        F.col("event_type").alias("model"), (F.col("value") < 2).alias("failed"),
        F.from_json("props", "k bigint")["k"].alias("tokens_in"), F.col("user_id").alias("tokens_out")))


@query("verdict_accuracy", """
select source, round(avg((quality = 1)::int), 6) as accuracy, count(*) as n from documents join labels using (doc_id) group by source""")
def verdict_accuracy(spark, d):
    rows = bridge.impls(spark, d).withColumn("verdict", F.when(F.col("status") != "UNKNOWN", F.lit("pass")))
    return r6(Q.verdict_accuracy(rows, ["source"]), "accuracy")


@query("scored_with_text", """
with o as (select user_id, event_type, props, row_number() over (partition by user_id order by event_id desc) as r from events)
select user_id::varchar as impl_id, event_type as spec_text, props as impl_text, c_name as name
from customer join o on user_id = c_custkey where r = 1 and event_type <> '' and props <> ''""")
def scored_with_text(spark, d):
    raw = bridge.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("impl_id"), F.col("event_type").alias("spec_text"),
        F.col("props").alias("impl_text"), F.col("event_id").alias("ord"))
    scored = bridge.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("impl_id"), F.col("c_name").alias("name"))
    return Q.scored_with_text(scored, raw)


@query("last_record_per_key", """
with o as (select *, row_number() over (partition by user_id order by event_id desc) as r from events)
select user_id, event_id, event_type from o where r = 1""")
def last_record_per_key(spark, d):
    ev = bridge.table(spark, d, "events")
    return last_per_key(ev, "user_id", F.col("event_id")).select("user_id", "event_id", "event_type")


@query("streamed_last_records", """
with o as (select *, row_number() over (partition by user_id order by event_id desc) as r from events where user_id is not null and ts is not null)
select user_id, event_id, event_type, value from o where r = 1""")
def streamed_last_records(spark, d):
    """The same from a stream of four micro-batches, a file for each core, through keyed state and the batch-wise sink."""
    source, made, marks = scratch(spark, "events"), scratch(spark, "latest"), scratch(spark, "marks")
    events = bridge.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "ts", "event_id").write.parquet(source)
    files = len(spark.read.schema(events.schema).parquet(source).inputFiles())
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).parquet(source)
    SR.upsert(SR.latest_updates(stream, "user_id", "event_id", "ts", "365 days"), made, marks).awaitTermination()
    return SR.read_latest(spark, made, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("sibling_twins")
def sibling_twins(spark, d):
    """Mutual links between the two sides of a repair pair."""
    from lineaudit.catalog.texts import _raw_pairs
    from lineaudit.sources.corpora import parse_repair_pairs
    rows = parse_repair_pairs(_raw_pairs(spark, d), ["ord"]).select("impl_id", "sibling_impl_id", "status")
    other = rows.select(F.col("impl_id").alias("sibling_impl_id"), F.col("sibling_impl_id").alias("back"),
                        F.col("status").alias("sibling_status"))
    return rows.join(other, "sibling_impl_id").filter(F.col("back") == F.col("impl_id")).select(
        "impl_id", "sibling_impl_id", "status", "sibling_status")


# -- resampling, augmentation, batches ----------------------------------------------------------------

def draw_sql(key: str, rep: str) -> str:
    return f"(('0x' || substr(sha1({key} || '|' || {rep} || '|0'), 1, 8))::bigint / 4294967296.0::double)"


COUNT_SQL = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(i))!r})::int" for i in range(1, 16))


@query("bootstrap_recall", f"""with {bridge.sql_scored('random', 'keyword')},
f as (select run, impl_id, (best_rank <= 1)::int as hit from rec where status = 'FAIL' and n_bug > 0),
u as (select *, {draw_sql('impl_id', 'rep')} as u from f, (select unnest(range(50)) as rep)),
m as (select run, rep, sum(hit * c) / sum(c) as m from (select *, {COUNT_SQL} as c from u) group by all)
select run, round(median(m), 6) as median, round(quantile_cont(m, 0.025), 6) as lo, round(quantile_cont(m, 0.975), 6) as hi,
  count(m) as n from m group by run""")
def bootstrap_recall(spark, d):
    recs = bridge.records(spark, d, "random", "keyword")
    hits = M.labelled_fail(recs).select("run", "impl_id", G.row_hits(recs, 1).alias("hit"))
    return r6(Z.linear_interval(Z.bootstrap_means(hits, "hit", "impl_id", ["run"], 50), "mean", ["run"]), "median", "lo", "hi")


_BOOT = f"""with {bridge.sql_scored('random')},
y as (select impl_id, status = 'FAIL' as y, whole from rec where status <> 'UNKNOWN'),
u as (select *, {draw_sql('impl_id', 'rep')} as u from y, (select unnest(range(20)) as rep)),
s as (select rep, whole, coalesce(sum(c) filter (where y), 0) as p, coalesce(sum(c) filter (where not y), 0) as n
      from (select *, {COUNT_SQL} as c from u) where c > 0 group by all),
q as (select rep, p, n, coalesce(sum(n) over (partition by rep order by whole rows between unbounded preceding and 1 preceding), 0) as b from s)
select rep::int as rep, round(sum(p * (b + n / 2.0)) / (sum(p) * sum(n)), 6) as auc from q group by rep"""


@query("bootstrap_auroc", _BOOT)
def bootstrap_auroc(spark, d):
    recs = bridge.records(spark, d, "random")
    out = Z.bootstrap_auroc(recs, ["whole_impl_energy"], M.fail_label(), "impl_id", [], 20)
    return r6(out.select("rep", "auc"), "auc")


@query("bootstrap_interval", f"""
select n, round(a[n // 2 + 1], 6) as median, round(a[floor(0.025 * n)::int + 1], 6) as lo, round(a[floor(0.975 * n)::int + 1], 6) as hi
from (select count(auc) as n, list_sort(list(auc)) as a from ({_BOOT}))""")
def bootstrap_interval(spark, d):
    recs = bridge.records(spark, d, "random")
    out = Z.bootstrap_auroc(recs, ["whole_impl_energy"], M.fail_label(), "impl_id", [], 20)
    return r6(Z.index_interval(out, "auc", []), "median", "lo", "hi")


@query("paired_auroc_interval", f"""with {bridge.sql_scored('random', 'keyword')},
y as (select run, impl_id, status = 'FAIL' as y, whole from rec where status <> 'UNKNOWN'),
u as (select *, {draw_sql('impl_id', 'rep')} as u from y, (select unnest(range(20)) as rep)),
s as (select run, rep, whole, coalesce(sum(c) filter (where y), 0) as p, coalesce(sum(c) filter (where not y), 0) as n
      from (select *, {COUNT_SQL} as c from u) where c > 0 group by all),
q as (select *, coalesce(sum(n) over (partition by run, rep order by whole rows between unbounded preceding and 1 preceding), 0) as b from s),
a as (select run, rep, sum(p * (b + n / 2.0)) / (sum(p) * sum(n)) as auc from q group by all),
d as (select rep, max(auc) filter (where run = 'random') - max(auc) filter (where run = 'keyword') as d from a group by rep)
select round(median(d), 6) as median, round(quantile_cont(d, 0.025), 6) as lo, round(quantile_cont(d, 0.975), 6) as hi, count(d) as n from d""")
def paired_auroc_interval(spark, d):
    recs = bridge.records(spark, d, "random", "keyword")
    rows = recs.groupBy("impl_id").agg(
        F.max("status").alias("status"), F.max(F.when(F.col("run") == "random", F.col("whole_impl_energy"))).alias("a"),
        F.max(F.when(F.col("run") == "keyword", F.col("whole_impl_energy"))).alias("b"))
    auc = Z.bootstrap_auroc(rows, ["a", "b"], M.fail_label(), "impl_id", [], 20)
    delta = auc.groupBy("rep").agg((F.max(F.when(F.col("score") == "a", F.col("auc")))
                                    - F.max(F.when(F.col("score") == "b", F.col("auc")))).alias("delta"))
    return r6(Z.linear_interval(delta, "delta", []), "median", "lo", "hi")


@query("seeded_sample", """
select impl_id from (select 'doc-' || doc_id as impl_id from documents)
order by ('0x' || substr(sha1(impl_id || '|7'), 1, 8))::bigint, impl_id limit 40""")
def seeded_sample(spark, d):
    return Z.seeded_sample(bridge.impls(spark, d).select("impl_id"), ["impl_id"], 40, 7)


@query("random_energies", f"""with {bridge.SQL_LINES}
select impl_id, sent_idx::int as sent_idx, round(('0x' || substr(sha1(impl_id || '|' || sent_idx || '|0'), 1, 8))::bigint / 4294967296.0::double, 6) as e from sc""")
def random_energies(spark, d):
    rows = bridge.impls(spark, d).select("impl_id", F.posexplode(Z.uniform_energies(
        F.size(T.scorable_texts(T.splitlines(F.col("impl_text")))), F.col("impl_id"))).alias("sent_idx", "e"))
    return r6(rows, "e")


def _draw(name: str) -> str:
    return f"('0x' || substr(sha1('0|' || impl_id || '|' || copy || '|{name}'), 1, 8))::bigint / 4294967296.0::double"


def _placed(lines: str, go: str, share: float, at: str, markers: tuple[str, ...], name: str) -> str:
    """One marker behind one drawn line, in SQL."""
    pool = "[" + ", ".join(f"'{m}'" for m in markers) + "]"
    put = (f"rtrim(x) || case when contains(rtrim(x), '//') then ' ' else '  ' end || {pool}[floor({_draw(name)} * {len(markers)})::bigint + 1]")
    return (f"case when {_draw(go)} < {share} then list_transform({lines}, lambda x, i: "
            f"case when i - 1 = floor({_draw(at)} * len({lines})) then {put} else x end) else {lines} end")


@query("marker_augmentation", f"""with {bridge.SQL_LINES},
t as (select impl_id, string_agg(line_text, chr(10) order by src_idx) as txt from lines group by impl_id),
p as (select impl_id, copy, case when parts is not null then coalesce(txt, '') end as txt
      from raw left join t using (impl_id), (select unnest(range(3)) as copy)),
s as (select *, string_split(txt, chr(10)) as c from p),
l as (select *, case when c[-1] = '' then c[:-2] else c end as l0 from s),
m as (select *, {_placed('l0', 'go', 0.5, 'line', T.NEGATIVE_MARKERS + T.POSITIVE_MARKERS, 'marker')} as l1 from l),
n as (select *, {_placed('l1', 'go2', 0.3, 'line2', T.POSITIVE_MARKERS, 'marker2')} as l2 from m)
select impl_id, copy::int as copy, sha1(case when copy > 0 and txt <> '' then array_to_string(l2, chr(10)) else txt end) as digest from n""")
def marker_augmentation(spark, d):
    rows = Z.augment(bridge.impls(spark, d), 3)
    return rows.select("impl_id", "copy", F.sha1(F.encode("impl_text", "UTF-8")).alias("digest"))


def _mixed(spark, d):
    recs = bridge.records(spark, d, "random")
    even = F.substring("source", 4, 10).cast("int") % 2 == 0
    return recs.withColumn("source", F.when(even, "system_trajectory").otherwise("sft_safe"))


@query("viable_specs", f"""with {bridge.sql_scored('random')},
g as (select case when substr(source, 4)::int % 2 = 0 then 'system_trajectory' else 'sft_safe' end as source, spec_id,
   bool_or(status = 'PASS') as p, bool_or(status = 'FAIL') as f, bool_or(status = 'FAIL' and n_bug > 0) as l from rec group by all)
select source, spec_id from g where (source = 'system_trajectory' and p and f) or (source = 'sft_safe' and l)""")
def viable_specs(spark, d):
    return Z.viable_specs(_mixed(spark, d))


_VIABLE = f"""with {bridge.sql_scored('random')},
g as (select case when substr(source, 4)::int % 2 = 0 then 'system_trajectory' else 'sft_safe' end as source, spec_id,
   bool_or(status = 'PASS') as p, bool_or(status = 'FAIL') as f, bool_or(status = 'FAIL' and n_bug > 0) as l from rec group by all),
v as (select source, spec_id from g where (source = 'system_trajectory' and p and f) or (source = 'sft_safe' and l)),
o as (select *, case when source = 'sft_safe' then 4 else 2 end as per, count(*) over (partition by source) as n,
        row_number() over (partition by source order by ('0x' || substr(sha1(source || '|' || spec_id || '|0'), 1, 8))::bigint, spec_id) - 1 as i from v),
mb as (select source, spec_id, i // per as batch from o where i < n // per * per)"""


@query("mixed_batches", _VIABLE + " select source, spec_id, batch from mb")
def mixed_batches(spark, d):
    # The SQL has whole blocks only.
    return Z.mixed_batches(Z.viable_specs(_mixed(spark, d))).where("not short").drop("short")


@query("collated_batches", _VIABLE + """,
rs as (select r.*, case when substr(source, 4)::int % 2 = 0 then 'system_trajectory' else 'sft_safe' end as src from rec r),
w as (select impl_id, max(n_lines) as n_lines from sc group by 1),
j as (select mb.batch, rs.*, row_number() over (partition by mb.batch order by rs.impl_id) as r
      from rs join mb on mb.source = rs.src and mb.spec_id = rs.spec_id),
k as (select * from j where r <= 16),
gr as (select batch, spec_id from k where src = 'system_trajectory' group by all
       having bool_or(status = 'PASS') and bool_or(status = 'FAIL')),
gc as (select batch, count(*) as n from gr group by 1)
select batch, count(*)::int as n, max(n_lines)::int as width, coalesce(any_value(gc.n), 0)::int as n_groups,
  count(*) filter (where src = 'sft_safe' and status = 'FAIL' and n_bug > 0)::int as n_labelled
from k left join gc using (batch) group by batch""")
def collated_batches(spark, d):
    recs = _mixed(spark, d)
    # The SQL has whole blocks only, and of a batch the first part.
    planned = Z.mixed_batches(Z.viable_specs(recs)).where("not short").drop("short")
    rows = recs.join(planned, ["source", "spec_id"]).select(
        "batch", F.col("impl_id").alias("ord"), "source", "spec_id", "status", "buggy_line_indices",
        F.transform("scorable_line_texts", lambda t: F.char_length(t)).alias("input_ids"))
    out = Z.collate(rows, 16).where("part = 0")
    return out.select("batch", "n", F.size(F.get("input_ids", F.lit(0))).alias("width"),
                      F.size("groups").alias("n_groups"), F.size("labelled_failing").alias("n_labelled"))


@query("keep_counts", f"""with {bridge.sql_scored('random')}
select source, count(*) as n_in, count(*) filter (where n_bug > 0 or status <> 'FAIL') as n_kept from rec group by source""")
def keep_counts(spark, d):
    recs = bridge.records(spark, d, "random")
    return Z.keep_counts(recs, (F.col("status") != "FAIL") | (F.size("buggy_line_indices") > 0))
