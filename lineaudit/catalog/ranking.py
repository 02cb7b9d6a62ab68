"""Registered queries: recall, separation, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineaudit import bridge
from lineaudit.functions import text as T
from lineaudit.operators import metrics as M
from lineaudit.operators import scorers as S

QUERIES, ORACLE = {}, {}


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


_STRIPPED = "rtrim(split_part(line_text, '// FAILS', 1))"
_MARK = " + ".join(f"contains(t, '{w}')::int" for w in T.MARKER_KEYWORDS)


@query("strip_marker_audit", f"""with {bridge.SQL_LINES},
v as (select 'w' as v, *, line_text as t from sc
      union all select 's', *, case when contains(line_text, '// FAILS') then {_STRIPPED} else line_text end from sc),
r as (select *, row_number() over (partition by v, impl_id order by
        ({_MARK})::double + 1e-4 * length(trim(t)) desc, sent_idx) as rk from v where status = 'FAIL'),
b as (select v, impl_id, min(case when buggy then rk end) as best from r group by all having best is not null),
a as (select k, avg((best <= k)::int) filter (where v = 'w') as w, avg((best <= k)::int) filter (where v = 's') as s,
        count(*) filter (where v = 'w') as n from b, (select unnest([1, 3, 5]) as k) group by k)
select k, round(w, 6) as with_markers, round(s, 6) as stripped, n as n_fail, round(w - s, 6) as delta,
  (select case when abs(w - s) <= 0.05 then 'marker-INVARIANT' when w > s then 'marker-RELIANT' else 'marker-AVERSE' end
   from a where k = 1) as verdict from a""")
def strip_marker_audit(spark, d):
    rows = bridge.impls(spark, d)
    lines = T.splitlines(F.col("impl_text"))
    marker = {"marker": S.SCORERS["marker"]}
    out = M.marker_audit(S.score(rows, marker), S.score(rows, marker, T.strip_fails(lines)))
    return r6(out, "with_markers", "stripped", "delta").orderBy("k")


@query("topk_recall_by_scorer", f"""with {bridge.sql_scored()},
f as (select * from rec where status = 'FAIL' and n_bug > 0),
u as (select run, k, (best_rank <= k)::int as hit,
        1 - list_reduce(list_prepend(1.0::double, list_transform(range(least(k, n_lines)),
            lambda i: greatest(n_lines - n_bug - i, 0)::double / (n_lines - i))), lambda a, b: a * b) as u
      from f, (select unnest([1, 3, 5]) as k))
select run, k, round(avg(hit), 6) as recall, count(*) as n, round(avg(u), 6) as uniform,
       round(avg(hit) / nullif(avg(u), 0), 6) as lift from u group by run, k""")
def topk_recall_by_scorer(spark, d):
    return r6(M.topk_recall(bridge.records(spark, d), by=["run"]), "recall", "uniform", "lift")


@query("topk_curve", f"""with {bridge.sql_scored()}
select run, k, round(avg((best_rank <= k)::int), 6) as recall, count(*) as n
from rec, (select unnest(range(1, 11))::int as k) where status = 'FAIL' and n_bug > 0 group by run, k""")
def topk_curve(spark, d):
    return r6(M.topk_curve(bridge.records(spark, d), ["run"]), "recall")


def sql_auc(src: str, by: str, score: str = "whole", extra: str = "status in ('PASS', 'FAIL')") -> str:
    """Mann-Whitney by midranks over the rows of a CTE."""
    return f"""
m as (select {by}, status = 'FAIL' as y, rank() over (partition by {by} order by {score})
        + (count(*) over (partition by {by}, {score}) - 1) / 2.0 as r from {src} where {extra}),
auc as (select {by}, count(*) filter (where y) as n_pos, count(*) filter (where not y) as n_neg,
        (sum(r) filter (where y) - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0) as auc from m group by {by})"""


@query("auroc_by_scorer", f"""with {bridge.sql_scored()}, {sql_auc('rec', 'run')}
select run, round(auc, 6) as auc, n_pos, n_neg from auc""")
def auroc_by_scorer(spark, d):
    return r6(M.auroc(bridge.records(spark, d), "whole_impl_energy", M.fail_label(), ["run"]), "auc")


@query("within_spec_ranking", f"""with {bridge.sql_scored()},
g as (select run, spec_id, max(whole) filter (where status = 'PASS') as p, min(whole) filter (where status = 'FAIL') as f
      from rec group by all)
select run, round(avg((p < f)::int), 6) as accuracy, count(*) as n_specs from g
where p is not null and f is not null group by run""")
def within_spec_ranking(spark, d):
    return r6(M.within_spec_ranking(bridge.records(spark, d), ["run"]), "accuracy")


@query("eval_bundle", f"""with {bridge.sql_scored()}, {sql_auc('rec', 'run')},
g as (select run, spec_id, max(whole) filter (where status = 'PASS') as p, min(whole) filter (where status = 'FAIL') as f
      from rec group by all),
w as (select run, avg((p < f)::int) as accuracy, count(*) as n_specs from g where p is not null and f is not null group by run),
b as (select run, count(*) as n_impls, avg(whole) filter (where status = 'PASS') as mean_pass,
        avg(whole) filter (where status = 'FAIL') as mean_fail,
        stddev_pop(whole) filter (where status <> 'UNKNOWN') as std_energy,
        avg((best_rank <= 1)::int) filter (where status = 'FAIL' and n_bug > 0) as t1,
        avg((best_rank <= 3)::int) filter (where status = 'FAIL' and n_bug > 0) as t3,
        count(*) filter (where status = 'FAIL' and n_bug > 0) as n_with_labels from rec group by run)
select run, n_impls, round(mean_pass, 6) as mean_pass, round(mean_fail, 6) as mean_fail, round(std_energy, 6) as std_energy,
  round(auc, 6) as auc, n_pos as n_fail, n_neg as n_pass, round(t1, 6) as per_line_top1, round(t3, 6) as per_line_top3,
  n_with_labels, round(accuracy, 6) as accuracy, n_specs
from b left join auc using (run) left join w using (run)""")
def eval_bundle(spark, d):
    out = M.eval_bundle(bridge.records(spark, d), ["run"])
    return r6(out, "mean_pass", "mean_fail", "std_energy", "auc", "per_line_top1", "per_line_top3", "accuracy")


_SWEEP = f"""with {bridge.sql_scored('random')},
s as (select impl_id, any_value(status) as status, avg(energy) as mean, max(energy) as mx, min(energy) as mn,
        arg_max(energy, sent_idx) as last, sum(energy) as sum, sum(ln(1 + exp(least(20, energy)))) as sp,
        avg(energy) filter (where rk <= 3) as t3, stddev_pop(energy) as sd,
        avg(energy) filter (where rk <= 1) as t1, avg(energy) filter (where rk <= 2) as t2,
        avg(energy) filter (where rk <= 5) as t5 from scored group by impl_id),
l as (select status, unnest({{names}}) as reducer, round(unnest({{values}}), 9) as score from s),"""


@query("aggregator_sweep", _SWEEP.format(
    names="['mean','max','min','last','sum','softplus_sum','ms_max','ms_top3','ms_top1_minus_min']",
    values="[mean, mx, mn, last, sum, sp, mx - mean, t3 - mean, mx - mn]") + sql_auc("l", "reducer", "score")
    + " select reducer, round(auc, 6) as auc, n_pos, n_neg from auc")
def aggregator_sweep(spark, d):
    return r6(M.reducer_sweep(bridge.records(spark, d, "random")), "auc")


@query("zscore_sweep", _SWEEP.format(
    names="['z_top1','z_top2','z_top3','z_top5','max']",
    values="[(t1 - mean) / z, (t2 - mean) / z, (t3 - mean) / z, (t5 - mean) / z, mx]").replace(
        "from s)", "from (select *, coalesce(nullif(sd, 0), 1) as z from s))") + sql_auc("l", "reducer", "score")
    + " select reducer, round(auc, 6) as auc, n_pos, n_neg from auc")
def zscore_sweep(spark, d):
    return r6(M.z_sweep(bridge.records(spark, d, "random")), "auc")


@query("roc_curve", f"""with {bridge.sql_scored()},
p as (select run, impl_id, sum((status = 'FAIL')::int) over w as tp, sum((status = 'PASS')::int) over w as fp,
        count(*) filter (where status = 'FAIL') over (partition by run) as np,
        count(*) filter (where status = 'PASS') over (partition by run) as nn
      from rec where status <> 'UNKNOWN'
      window w as (partition by run order by whole desc, impl_id rows unbounded preceding))
select run, impl_id, tp::bigint as tp, fp::bigint as fp, round(tp / np, 6) as tpr, round(fp / nn, 6) as fpr from p
union all select distinct run, '', 0, 0, 0.0, 0.0 from p""")
def roc_curve(spark, d):
    return r6(M.roc_curve(bridge.records(spark, d), ["run"]), "tpr", "fpr")


@query("by_source", f"""with {bridge.sql_scored('keyword')}, {sql_auc('rec', 'source', extra='true')},
c as (select source, count(*) as n, count(*) filter (where status = 'PASS') as n_pass,
        count(*) filter (where status = 'FAIL') as n_fail,
        avg((best_rank <= 3)::int) filter (where status = 'FAIL' and n_bug > 0) as topk from rec group by source)
select source as src, n, n_pass, n_fail, round(auc, 6) as auc, round(topk, 6) as topk from c left join auc using (source)""")
def by_source(spark, d):
    return r6(M.by_source(bridge.records(spark, d, "keyword")), "auc", "topk")


@query("line_keyword_recall", f"""with {bridge.SQL_LINES},
e as (select *, row_number() over (partition by impl_id order by
        ({' + '.join(f"contains(line_text, '{w}')::int" for w in T.DSL_KEYWORDS)}) + 0.001::double * length(line_text) desc, sent_idx) as rk
      from sc where status = 'FAIL'),
f as (select impl_id, count(*) as n_lines, count(*) filter (where buggy) as n_bug, min(case when buggy then rk end) as best
      from e group by impl_id having n_bug > 0),
u as (select k, (best <= k)::int as hit, 1 - list_reduce(list_prepend(1.0::double, list_transform(range(least(k, n_lines)),
        lambda i: greatest(n_lines - n_bug - i, 0)::double / (n_lines - i))), lambda a, b: a * b) as u
      from f, (select unnest([1, 3, 5]) as k))
select k, round(avg(hit), 6) as recall, count(*) as n, round(avg(u), 6) as uniform,
       round(avg(hit) / nullif(avg(u), 0), 6) as lift from u group by k""")
def line_keyword_recall(spark, d):
    recs = S.score(bridge.impls(spark, d), {"line_keyword": S.LINE_KEYWORD})
    return r6(M.topk_recall(recs), "recall", "uniform", "lift")
