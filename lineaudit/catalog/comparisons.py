"""Registered queries: positions, subgroups, paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineaudit import bridge
from lineaudit.catalog.ranking import r6, sql_auc
from lineaudit.catalog.surfaces import COUNT_SQL, draw_sql
from lineaudit.operators import metrics as M
from lineaudit.operators import positions as P
from lineaudit.operators import scorers as S
from lineaudit.operators import significance as G
from lineaudit.operators import subgroups as U
from lineaudit.sources import sinks as W

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


_POS = f"""with {bridge.sql_scored('random', 'length')},
p as (select s.run, 'label' as kind, sent_idx / greatest(n_lines - 1, 1)::double as position, s.n_lines
      from scored s where buggy and status = 'FAIL'
      union all
      select s.run, 'predicted', sent_idx / greatest(s.n_lines - 1, 1)::double, s.n_lines
      from scored s join rec r using (run, impl_id) where rk = 1 and r.n_bug > 0 and s.status = 'FAIL'),"""


@query("position_quartiles", _POS + """
o as (select *, row_number() over (partition by run, kind order by position) - 1 as i,
        count(*) over (partition by run, kind) as n from p)
select run, kind, max(n) as n, round(max(case when i = n // 4 then position end), 6) as q25,
  round(max(case when i = n // 2 then position end), 6) as q50,
  round(max(case when i = (3 * n) // 4 then position end), 6) as q75 from o group by run, kind""")
def position_quartiles(spark, d):
    return r6(P.position_quartiles(bridge.records(spark, d, "random", "length"), ["run"]), "q25", "q50", "q75")


@query("position_density", _POS + """
h as (select run, kind, least(floor(position * 20), 19)::int as bin, count(*) as c from p where n_lines >= 2 group by all)
select run, kind, bin, c, round(c / sum(c) over (partition by run, kind) * 20, 6) as density from h""")
def position_density(spark, d):
    recs = bridge.records(spark, d, "random", "length")
    rows = P.label_positions(recs, 2).select("run", F.lit("label").alias("kind"), "position").unionByName(
        P.predicted_positions(recs, 2).select("run", F.lit("predicted").alias("kind"), "position"))
    return r6(P.position_density(rows, ["run", "kind"]), "density")


@query("spearman_position", f"""with {bridge.sql_scored()},
r as (select run, impl_id, sent_idx, n_lines, row_number() over (partition by run, impl_id order by energy, sent_idx) - 1 as r
      from scored where n_lines >= 3),
g as (select run, impl_id, sum((r - (n_lines - 1) / 2.0) * (sent_idx - (n_lines - 1) / 2.0))
        / (n_lines * (n_lines * n_lines - 1) / 12.0) as rho from r group by run, impl_id, n_lines)
select run, round(avg(rho), 6) as rho, count(*) as n from g group by run""")
def spearman_position(spark, d):
    return r6(P.spearman_position(bridge.records(spark, d), ["run"]), "rho")


@query("by_bug_type", f"""with {bridge.sql_scored('random', 'length')},
f as (select run, impl_id, arg_min(line_text, sent_idx) filter (where buggy) as t, min(case when buggy then rk end) as best
      from scored where status = 'FAIL' group by run, impl_id having best is not null)
select run, case when regexp_matches(t, '\\bassert\\b') then 'assert' when regexp_matches(t, '\\bensures\\b') then 'ensures'
  when regexp_matches(t, '\\binvariant\\b') then 'invariant' when regexp_matches(t, '\\bdecreases\\b') then 'decreases'
  when regexp_matches(t, '\\brequires\\b') then 'requires' when regexp_matches(t, '\\b(forall|exists)\\b') then 'forall'
  else 'other' end as bug_type, count(*) as n, round(avg((best <= 3)::int), 6) as topk from f group by all""")
def by_bug_type(spark, d):
    return r6(U.by_bug_type(bridge.records(spark, d, "random", "length"), by=["run"]), "topk")


@query("by_label_count", f"""with {bridge.sql_scored('random')},
b as (select case n_bug when 1 then '|B|=1' when 2 then '|B|=2' else '|B|>=3' end as bucket, (best_rank <= 3)::int as hit
      from rec where status = 'FAIL' and n_bug > 0)
select x.bucket, count(hit) as n, round(coalesce(avg(hit), 0), 6) as topk
from (values ('|B|=1'), ('|B|=2'), ('|B|>=3')) x(bucket) left join b using (bucket) group by x.bucket""")
def by_label_count(spark, d):
    return r6(U.by_label_count(bridge.records(spark, d, "random")), "topk")


@query("by_length_tertile", f"""with {bridge.sql_scored('random', 'length')},
o as (select run, n_lines, (best_rank <= 3)::int as hit, row_number() over (partition by run order by n_lines, impl_id) - 1 as i,
        count(*) over (partition by run) as n from rec where status = 'FAIL' and n_bug > 0),
t as (select *, case when i < n // 3 then 'short' when i < (2 * n) // 3 then 'medium' else 'long' end as tertile from o),
q as (select *, row_number() over (partition by run, tertile order by n_lines) - 1 as j,
        count(*) over (partition by run, tertile) as m from t)
select run, tertile, max(m) as n, round(avg(hit), 6) as topk, min(n_lines)::int as min_lines, max(n_lines)::int as max_lines,
  max(case when j = m // 2 then n_lines end)::int as p50_lines from q group by all""")
def by_length_tertile(spark, d):
    return r6(U.by_length_tertile(bridge.records(spark, d, "random", "length"), ["run"]), "topk")


_PMF = """list_transform(range(least(n01, n10) + 1), lambda i:
          exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2)))"""


def _pairs(ks: str) -> str:
    return f"""with {bridge.sql_scored()},
f as (select run, impl_id, best_rank from rec where status = 'FAIL' and n_bug > 0),
p as (select b.run, k, (t.best_rank <= k)::int as t, (b.best_rank <= k)::int as b
      from f t join f b using (impl_id), (select unnest({ks}) as k) where t.run = 'random' and b.run <> 'random'),
c as (select run, k, count(*) as n_paired, count(*) filter (where t = 1 and b = 1) as n11, count(*) filter (where t = 1 and b = 0) as n01,
        count(*) filter (where t = 0 and b = 1) as n10, count(*) filter (where t = 0 and b = 0) as n00,
        avg(t) as tt, avg(b) as bb from p group by run, k),
e as (select *, n01 + n10 as nd, least(n01, n10) as lo, {_PMF} as pmf from c)"""


_PAIR = _pairs("[1]")
_P_EXACT = "case when nd = 0 then 1.0 else least(1.0, 2 * list_sum(pmf)) end"
_P_MID = "case when nd = 0 then 1.0 else least(1.0, 2 * (list_sum(pmf) - 0.5 * pmf[-1])) end"


def _target_and_baselines(spark, d):
    # Two scans, but each scores only the runs it hands on.
    return bridge.records(spark, d, "random"), bridge.records(spark, d, *[r for r in S.SCORERS if r != "random"])


def _erfc(x: str) -> str:
    """Complementary error function by its power series, good to 1e-9 below 4.5."""
    term = f"(case when i % 2 = 0 then 1 else -1 end) * exp((2 * i + 1) * ln({x}) - lgamma(i + 1)) / (2 * i + 1)"
    return (f"(case when {x} < 1e-12 then 1.0 when {x} > 4.5 then 0.0 else 1 - 2 / sqrt(pi()) * "
            f"list_sum(list_transform(range(120), lambda i: {term})) end)")


_CHI = "sqrt((abs(n01 - n10) - 1) ** 2 / nullif(n01 + n10, 0) / 2.0)"


def _log10_erfc(x: str) -> str:
    """log10 of the complementary error function: the power series below 2, a continued fraction above, in any size."""
    fraction = f"list_reduce(list_prepend({x}::double, list_transform(range(80, 0, -1), lambda i: i / 2.0)), lambda t, i: {x} + i / t)"
    return f"(case when {x} < 2 then log10({_erfc(x)}) else (-{x} * {x} - ln(sqrt(pi())) - ln({fraction})) / ln(10) end)"


_P_LOGS = f"""round(case when nd < 25 then log10({_P_EXACT}) else {_log10_erfc('cx')} end, 5) as log10_p_mcnemar,
  round(log10({_P_EXACT}), 5) as log10_p_exact, round(log10({_P_MID}), 5) as log10_p_mid"""
_LOGS = ["log10_p_mcnemar", "log10_p_exact", "log10_p_mid"]


def r5(df, *names):
    """Logarithms of p-values, with a plain zero."""
    return df.withColumns({n: F.round(F.col(n), 5) + F.lit(0.0) for n in names})


@query("mcnemar_tests", _PAIR + f"""
select run, n_paired, n11, n01, n10, n00, round(tt, 6) as target_topk, round(bb, 6) as baseline_topk,
  round(case when nd < 25 then {_P_EXACT} else {_erfc('cx')} end, 6) as p_mcnemar,
  round({_P_EXACT}, 6) as p_exact, round({_P_MID}, 6) as p_mid, {_P_LOGS} from (select *, {_CHI} as cx from e)""")
def mcnemar_tests(spark, d):
    out = G.mcnemar_table(G.paired_hits(*_target_and_baselines(spark, d), 1), ["run"])
    return r5(r6(out, "target_topk", "baseline_topk", "p_mcnemar", "p_exact", "p_mid"), *_LOGS)


_DELONG = """
pr as (select b.run, t.status = 'FAIL' as y, t.whole as a, b.whole as b from rec t join rec b using (impl_id)
       where t.run = 'random' and b.run <> 'random' and t.status <> 'UNKNOWN'),
mr as (select run, y,
    rank() over (partition by run order by a) + (count(*) over (partition by run, a) - 1) / 2.0 as ra,
    rank() over (partition by run, y order by a) + (count(*) over (partition by run, y, a) - 1) / 2.0 as sa,
    rank() over (partition by run order by b) + (count(*) over (partition by run, b) - 1) / 2.0 as rb,
    rank() over (partition by run, y order by b) + (count(*) over (partition by run, y, b) - 1) / 2.0 as sb,
    count(*) filter (where y) over (partition by run) as np, count(*) filter (where not y) over (partition by run) as nn from pr),
v as (select run, y, case when y then (ra - sa) / nn else 1 - (ra - sa) / np end as va,
        case when y then (rb - sb) / nn else 1 - (rb - sb) / np end as vb from mr),
dl as (select run, avg(va) filter (where y) as auc_a, avg(vb) filter (where y) as auc_b,
        count(*) filter (where y) as n_pos, count(*) filter (where not y) as n_neg,
        (var_samp(va) filter (where y) + var_samp(vb) filter (where y) - 2 * covar_samp(va, vb) filter (where y)) / n_pos
        + (var_samp(va) filter (where not y) + var_samp(vb) filter (where not y)
           - 2 * covar_samp(va, vb) filter (where not y)) / n_neg as var from v group by run)"""


@query("delong_tests", f"with {bridge.sql_scored()}, {_DELONG}" + """
select run, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, n_pos, n_neg, round(auc_a - auc_b, 6) as diff,
  round(var, 9) as var, round((auc_a - auc_b) / sqrt(var), 5) as z, round(PVAL, 6) as p, round(PVAL, 6) as p_or_nan,
  round(LOGP, 5) as log10_p from (select *, abs(auc_a - auc_b) / sqrt(2 * var) as az from dl)""".replace("PVAL", _erfc("az")).replace("LOGP", _log10_erfc("az")))
def delong_tests(spark, d):
    out = G.delong(G.paired_scores(*_target_and_baselines(spark, d)), ["run"])
    return r5(r6(out, "auc_a", "auc_b", "diff", "p", "p_or_nan"), "log10_p").withColumns({"var": F.round("var", 9), "z": F.round("z", 5)})


_JOINT = _PAIR + f", {_DELONG}, " + f"""
x as (select *, (auc_a - auc_b) / sqrt(var) as z from dl),
j as (select e.*, x.auc_a, x.auc_b, x.n_pos, x.n_neg, x.var, x.z, abs(x.z) / sqrt(2) as az, {_CHI} as cx from e join x using (run))"""


@query("significance_table", _JOINT + f"""
select run, n_paired, n11, n01, n10, n00, round(tt, 6) as target_topk, round(bb, 6) as baseline_topk,
  round(case when nd < 25 then {_P_EXACT} else {_erfc('cx')} end, 6) as p_mcnemar,
  round({_P_EXACT}, 6) as p_exact, round({_P_MID}, 6) as p_mid, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b,
  n_pos, n_neg, round(var, 9) as auc_var, round(auc_a - auc_b, 6) as diff, round(z, 5) as z, round({_erfc('az')}, 6) as p,
  round({_erfc('az')}, 6) as p_or_nan, {_P_LOGS}, round({_log10_erfc('az')}, 5) as log10_p from j""")
def significance_table(spark, d):
    out = G.significance_table(*_target_and_baselines(spark, d))
    out = r6(out, "p_mcnemar", "p_exact", "p_mid", "target_topk", "baseline_topk", "auc_a", "auc_b", "diff", "p", "p_or_nan")
    return r5(out, *_LOGS, "log10_p").withColumns({"auc_var": F.round("auc_var", 9), "z": F.round("z", 5)})


def _latex_p(x: str) -> str:
    digits = f"format('{{:.2e}}', {x})"
    return (f"case when {x} is null or isnan({x}) then '---' when {x} < 1e-4 then '$<10^{{-4}}$' when {x} < 1e-3 then '$' || "
            f"split_part({digits}, 'e', 1) || '\\times 10^{{' || split_part({digits}, 'e', 2)::int || '}}$' "
            f"else '$' || printf('%.3f', round({x}, 3)) || '$' end")


def _latex_pair(base: str, target: str) -> str:
    t = f"printf('%.3f', round({target}, 3))"
    return (f"printf('%.3f', round({base}, 3)) || ' vs ' || "
            f"case when {target} > {base} then '\\textbf{{' || {t} || '}}' else {t} end")


@query("latex_table", _JOINT + f""",
q as (select *, case when nd < 25 then {_P_EXACT} else {_erfc('cx')} end as pm, {_erfc('az')} as pa from j)
select run, run || ' & ' || n_paired || ' & ' || {_latex_pair('bb', 'tt')} || ' & ' || {_latex_p('pm')} || ' & '
  || {_latex_pair('auc_b', 'auc_a')} || ' & ' || {_latex_p('pa')} || ' \\\\' as line from q""")
def latex_table(spark, d):
    return W.latex_rows(G.significance_table(*_target_and_baselines(spark, d)))


_KS = (1, 3, 5)
#: Resamples behind the interval of `significance_by_k`.
_ITERS = 500


def _resampled(rows: str, iters: int = 20) -> str:
    """Resampled AUROC ``ra(run, side, rep, auc)`` of ``rows(run, impl_id, y, side, score)``."""
    return f"""
ru as (select *, {draw_sql('impl_id', 'rep')} as u from {rows}, (select unnest(range({iters})) as rep)),
rs as (select run, side, rep, score, coalesce(sum(c) filter (where y), 0) as p, coalesce(sum(c) filter (where not y), 0) as n
       from (select *, {COUNT_SQL} as c from ru) where c > 0 group by all),
rq as (select *, coalesce(sum(n) over (partition by run, side, rep order by score rows between unbounded preceding and 1 preceding), 0) as below from rs),
ra as (select run, side, rep, sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) as auc from rq group by all)"""


@query("significance_by_k", _pairs(str(list(_KS))) + f", {_DELONG}," + """
bs as (select run, impl_id, y, s.side, s.score from (
         select b.run, impl_id, t.status = 'FAIL' as y, unnest([{'side': 'a', 'score': t.whole}, {'side': 'b', 'score': b.whole}]) as s
         from rec t join rec b using (impl_id) where t.run = 'random' and b.run <> 'random' and t.status <> 'UNKNOWN')),""" + _resampled("bs", _ITERS) + f""",
ci as (select run, quantile_cont(d, 0.025) as lo, quantile_cont(d, 0.975) as hi from (
         select run, rep, max(auc) filter (where side = 'a') - max(auc) filter (where side = 'b') as d from ra group by all) group by run),
w as (select run, k, n_paired, tt, bb, {_P_EXACT} as pe, case when nd < 25 then {_P_EXACT} else {_erfc('cx')} end as pm
      from (select *, {_CHI} as cx from e))
select w.run, max(n_paired) as n_paired, """ + ", ".join(
    f"round(max(tt) filter (where k = {k}), 6) as target_top{k}, round(max(bb) filter (where k = {k}), 6) as baseline_top{k}, "
    f"round(max(pm) filter (where k = {k}), 6) as p_mcnemar_top{k}, round(log10(max(pe) filter (where k = {k})), 6) as log10_p_exact_top{k}"
    for k in _KS) + f""",
  round(any_value(auc_a), 6) as auc_a, round(any_value(auc_b), 6) as auc_b, any_value(n_pos) as n_pos, any_value(n_neg) as n_neg,
  round(any_value({_erfc('az')}), 6) as p, round(any_value(lo), 6) as diff_lo, round(any_value(hi), 6) as diff_hi
from w join (select *, abs(auc_a - auc_b) / sqrt(var) / sqrt(2) as az from dl) using (run) join ci using (run) group by w.run""")
def significance_by_k(spark, d):
    out = G.significance_by_k(*_target_and_baselines(spark, d), ks=_KS, iters=_ITERS)
    # The logarithm of a p-value that is itself below the smallest double.
    out = out.drop(*[f"p_exact_top{k}" for k in _KS])
    return r6(out, *[c for c in out.columns if c not in ("run", "n_paired", "n_pos", "n_neg")])


@query("bootstrap_report", f"""with {bridge.sql_scored('random', 'keyword')},
bs as (select run, impl_id, status = 'FAIL' as y, 'w' as side, whole as score from rec where status <> 'UNKNOWN'),{_resampled('bs')},
h as (select run, impl_id, k, (best_rank <= k)::int as hit from rec, (select unnest([1, 3]) as k) where status = 'FAIL' and n_bug > 0),
hu as (select *, {draw_sql('impl_id', 'rep')} as u from h, (select unnest(range(20)) as rep)),
hm as (select run, k, rep, sum(hit * c) / sum(c) as m from (select *, {COUNT_SQL} as c from hu) group by all),
v as (select run, 'auroc' as metric, auc as value from ra union all select run, 'top' || k, m from hm),
o as (select run, metric, count(value) as n, list_sort(list(value)) as a from v where value is not null group by all)
select run, metric, n, round(a[n // 2 + 1], 6) as median, round(a[floor(0.025 * n)::int + 1], 6) as lo,
  round(a[floor(0.975 * n)::int + 1], 6) as hi from o""")
def bootstrap_report(spark, d):
    return r6(G.bootstrap_report(bridge.records(spark, d, "random", "keyword"), ["run"], iters=20), "median", "lo", "hi")


@query("length_baseline_pair", f"""with {bridge.SQL_LINES},
e as (select *, row_number() over (partition by impl_id order by length(line_text) desc, sent_idx) as rl,
        row_number() over (partition by impl_id order by {bridge.SQL_ENERGY['keyword']} desc, sent_idx) as rm from sc where status = 'FAIL'),
f as (select impl_id, min(case when buggy then rl end) <= 3 as l, min(case when buggy then rm end) <= 3 as m
      from e group by impl_id having l is not null),
c as (select count(*) as n_paired, count(*) filter (where m and l) as n11, count(*) filter (where m and not l) as n01,
  count(*) filter (where not m and l) as n10, count(*) filter (where not m and not l) as n00,
  round(avg(m::int), 6) as target_topk, round(avg(l::int), 6) as baseline_topk from f),
q as (select *, n01 + n10 as nd, {_CHI} as cx, {_PMF} as pmf from c)
select n_paired, n11, n01, n10, n00, target_topk, baseline_topk, round(case when nd < 25 then {_P_EXACT} else {_erfc('cx')} end, 6) as p_mcnemar,
  round({_P_EXACT}, 6) as p_exact, round({_P_MID}, 6) as p_mid, {_P_LOGS} from q""")
def length_baseline_pair(spark, d):
    recs = S.score(bridge.impls(spark, d), {"keyword": S.SCORERS["keyword"]})
    hits = G.length_pairs(recs, 3)
    out = G.mcnemar_table(hits, [])
    return r5(r6(out, "target_topk", "baseline_topk", "p_mcnemar", "p_exact", "p_mid"), *_LOGS)


@query("subgroup_auroc_unknown_as_pass", f"""with {bridge.sql_scored()}, {sql_auc('rec', 'run', extra='true')}
select run, round(auc, 6) as auc, n_pos, n_neg from auc""")
def subgroup_auroc_unknown_as_pass(spark, d):
    return r6(M.auroc(bridge.records(spark, d), "whole_impl_energy", M.fail_label(True), ["run"]), "auc")
