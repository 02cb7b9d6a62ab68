"""Registered queries: loss evaluators, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineaudit import bridge
from lineaudit.catalog.ranking import r6
from lineaudit.functions import reducers as A
from lineaudit.operators import losses as L
from lineaudit.operators import repair as Q
from lineaudit.operators import sampling as Z
from lineaudit.session import stable

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _recs(spark, d):
    return bridge.records(spark, d, "random", "keyword")


_S = f"with {bridge.sql_scored('random', 'keyword')}"
_ANCHOR = """,
g as (select run, spec_id, arg_min(whole, impl_id) filter (where status = 'PASS') as e_pos,
        count(*) filter (where status = 'FAIL') as nf from rec group by all having e_pos is not null and nf > 0),
pr as (select r.run, g.e_pos, r.whole as e_neg from rec r join g using (run, spec_id) where r.status = 'FAIL')"""


@query("loss_spec_infonce", _S + _ANCHOR + """,
p as (select run, sum(exp(-whole)) as z, avg(whole) as mean_neg from rec where status = 'FAIL' group by run)
select run, round(avg(ln(z + exp(-e_pos)) + e_pos), 6) as loss, count(*) as n, round(avg(mean_neg - e_pos), 6) as diff
from g join p using (run) group by run""")
def loss_spec_infonce(spark, d):
    return r6(L.spec_infonce(_recs(spark, d), ["run"]), "loss", "diff")


@query("loss_pair_logistic", _S + _ANCHOR + """
select run, round(avg(ln(1 + exp(e_pos - e_neg))), 6) as loss, count(*) as n, round(avg(e_neg - e_pos), 6) as diff from pr group by run""")
def loss_pair_logistic(spark, d):
    return r6(L.pair_logistic(_recs(spark, d), ["run"]), "loss", "diff")


@query("loss_pair_hinge", _S + _ANCHOR + """
select run, round(avg(greatest(0, e_pos - e_neg + 1)), 6) as loss, count(*) as n, round(avg(e_neg - e_pos), 6) as diff from pr group by run""")
def loss_pair_hinge(spark, d):
    return r6(L.pair_hinge(_recs(spark, d), ["run"]), "loss", "diff")


@query("loss_pair_epa", _S + """,
o as (select *, (row_number() over (partition by run order by spec_id, impl_id) - 1) // 64 as batch from rec),
g as (select run, batch, spec_id, arg_min(whole, impl_id) filter (where status = 'PASS') as e_pos,
        min(impl_id) filter (where status = 'PASS') as first, count(*) filter (where status = 'FAIL') as nf
      from o group by all having e_pos is not null and nf > 0),
st as (select o.run, o.batch, ln(1 + exp(e_pos - whole)) as l, whole - e_pos as df from o join g using (run, batch, spec_id) where status = 'FAIL'),
wk as (select o.run, o.batch, o.whole from o left join g using (run, batch, spec_id)
       where g.e_pos is null or not (o.status = 'FAIL' or o.impl_id = g.first)),
wp as (select g.run, g.batch, g.spec_id, avg(ln(1 + exp(e_pos - whole))) as w from g join wk using (run, batch) group by all),
wm as (select run, batch, avg(w) as w from wp group by all)
select run, batch, round(avg(l) + 0.2 * coalesce(any_value(w), 0), 6) as loss, count(*) as n, round(avg(df), 6) as diff
from st left join wm using (run, batch) group by run, batch""")
def loss_pair_epa(spark, d):
    # Batches are numbered once; every part of the loss then reads the same rows.
    rows = stable(Z.fixed_batches(_recs(spark, d).select("run", "spec_id", "impl_id", "status", "whole_impl_energy"),
                           64, ["run"], ["spec_id", "impl_id"]))
    return r6(L.pair_epa(rows, ["run", "batch"]), "loss", "diff")


@query("loss_orm", _S + """
select run, round(avg(case when status = 'FAIL' then ln(1 + exp(-whole)) else ln(1 + exp(whole)) end), 6) as loss, count(*) as n,
 round(avg(whole) filter (where status = 'FAIL') - avg(whole) filter (where status = 'PASS'), 6) as diff
from rec where status <> 'UNKNOWN' group by run""")
def loss_orm(spark, d):
    return r6(L.orm(_recs(spark, d), ["run"]), "loss", "diff")


@query("loss_line_listwise", _S + """,
l as (select run, impl_id, n_lines, buggy, energy, ln(sum(exp(energy)) over w) as lse, avg(energy) over w as mu
      from scored where status = 'FAIL' and n_lines >= 2 window w as (partition by run, impl_id)),
i as (select run, impl_id, avg(0.95 * (lse - energy) + 0.05 * (lse - mu)) as l, avg(exp(energy - lse)) as c from l where buggy group by all)
select run, round(avg(l), 6) as loss, count(*) as n, round(avg(c), 6) as confidence from i group by run""")
def loss_line_listwise(spark, d):
    return r6(L.line_listwise(_recs(spark, d), ["run"]), "loss", "confidence")


@query("loss_line_listmle", _S + """,
l as (select *, case when buggy then row_number() over (partition by run, impl_id, buggy order by sent_idx) end as step
      from scored where status = 'FAIL' and n_lines >= 2),
s as (select a.run, a.impl_id, a.step, any_value(a.energy) - ln(sum(exp(b.energy))) as lp
      from l a join l b on a.run = b.run and a.impl_id = b.impl_id and (not b.buggy or b.step >= a.step) where a.buggy group by 1, 2, 3),
i as (select run, impl_id, avg(-lp * (1 - exp(lp)) * (1 - exp(lp))) / sqrt(count(*)) as l, avg(exp(lp)) as c from s group by 1, 2)
select run, round(avg(l), 6) as loss, count(*) as n, round(avg(c), 6) as confidence from i group by run""")
def loss_line_listmle(spark, d):
    return r6(L.line_listmle(_recs(spark, d), ["run"], gamma=2.0, balance=True), "loss", "confidence")


_PAIRS = _S + """,
f as (select * from scored where status = 'FAIL'),
q as (select *, row_number() over (partition by run, impl_id order by energy desc, sent_idx) as h from f where not buggy),
c as (select run, impl_id, count(*) filter (where buggy) as nb, count(*) filter (where not buggy) as no from f group by all having nb > 0 and no > 0)"""


@query("loss_line_hinge", _PAIRS + """,
i as (select b.run, b.impl_id, avg(greatest(0, 1 + o.energy - b.energy)) as l, avg(b.energy) - avg(o.energy) as df
      from f b join q o using (run, impl_id) where b.buggy group by all),
w as (select *, least(4, nb * no) as w from i join c using (run, impl_id))
select run, round(sum(l * w) / sum(w), 6) as loss, sum(w)::bigint as n, round(avg(df), 6) as diff from w group by run""")
def loss_line_hinge(spark, d):
    return r6(L.line_hinge(_recs(spark, d), ["run"]), "loss", "diff")


@query("loss_line_semi_hard", _PAIRS + """,
i as (select b.run, b.impl_id, avg(ln(1 + exp(1 + o.energy - b.energy))) as l, avg(b.energy) - avg(o.energy) as df
      from f b join q o using (run, impl_id) where b.buggy and o.h <= 3 group by all),
w as (select *, nb as w from i join c using (run, impl_id))
select run, round(sum(l * w) / sum(w), 6) as loss, sum(w)::bigint as n, round(avg(df), 6) as diff from w group by run""")
def loss_line_semi_hard(spark, d):
    return r6(L.line_semi_hard(_recs(spark, d), ["run"]), "loss", "diff")


@query("loss_line_bce", _S + """,
i as (select run, impl_id, avg(case when buggy then 10 * ln(1 + exp(-energy)) else ln(1 + exp(energy)) end) as l,
        avg(energy) filter (where buggy) - avg(energy) filter (where not buggy) as df
      from scored group by run, impl_id having bool_or(buggy))
select run, round(avg(l), 6) as loss, count(*) as n, round(avg(df), 6) as diff from i group by run""")
def loss_line_bce(spark, d):
    return r6(L.line_bce(_recs(spark, d), ["run"]), "loss", "diff")


_ALL = _PAIRS + _ANCHOR + """,
nr as (select run, count(*) as n_rows from rec group by run),
sc1 as (select run, avg(ln(1 + exp(e_pos - e_neg))) as l, count(*) as n from pr group by run),
lw as (select run, impl_id, buggy, energy, ln(sum(exp(energy)) over w) as lse, avg(energy) over w as mu
      from scored where status = 'FAIL' and n_lines >= 2 window w as (partition by run, impl_id)),
li as (select run, impl_id, avg(0.95 * (lse - energy) + 0.05 * (lse - mu)) as l from lw where buggy group by all),
ls as (select run, avg(l) as l, count(*) as n from li group by run),
hi as (select b.run, b.impl_id, avg(ln(1 + exp(1 + o.energy - b.energy))) as l from f b join q o using (run, impl_id) where b.buggy and o.h <= 3 group by all),
hs as (select run, sum(l * nb) / sum(nb) as l, sum(nb)::bigint as n from hi join c using (run, impl_id) group by run),
p1 as (select run, sum(exp(-whole)) as z from rec where status = 'FAIL' group by run),
sp as (select run, avg(ln(z + exp(-e_pos)) + e_pos) as l, count(*) as n from g join p1 using (run) group by run),
fi as (select b.run, b.impl_id, avg(greatest(0, 1 + o.energy - b.energy)) as l from f b join q o using (run, impl_id) where b.buggy group by all),
fs as (select run, sum(l * least(4, nb * no)) / sum(least(4, nb * no)) as l, sum(least(4, nb * no))::bigint as n
       from fi join c using (run, impl_id) group by run)"""


@query("loss_hybrid", _ALL + """
select run, n_rows, round(sc1.l, 6) as scalar_loss, sc1.n as scalar_n, round(ls.l, 6) as list_loss, ls.n as list_n,
  round(hs.l, 6) as pair_loss, hs.n as pair_n, round(sc1.l + 0.5 * ls.l + 0.25 * hs.l, 6) as loss
from nr join sc1 using (run) join ls using (run) join hs using (run)""")
def loss_hybrid(spark, d):
    return r6(L.hybrid(_recs(spark, d), ["run"], 1.0, 0.5, 0.25), "loss", "scalar_loss", "list_loss", "pair_loss")


@query("loss_contrastive", _ALL + """
select run, n_rows, round(sp.l, 6) as spec_loss, sp.n as spec_n, round(fs.l, 6) as line_loss, fs.n as line_n,
  round(sp.l + 0.5 * fs.l, 6) as loss from nr join sp using (run) join fs using (run)""")
def loss_contrastive(spark, d):
    return r6(L.contrastive(_recs(spark, d), ["run"], 1.0, 0.5), "loss", "spec_loss", "line_loss")


@query("normalized_lse", _S + """,
t as (select unnest([0.05::double, 0.5, 2.0, 1000.0]) as temperature),
i as (select run, impl_id, temperature, max(energy) + max(temperature) * ln(avg(exp((energy - m) / temperature))) as v
      from (select *, max(energy) over (partition by run, impl_id) as m from scored), t group by run, impl_id, temperature)
select run, temperature, round(avg(v), 6) as mean_value, count(*) as n from i group by run, temperature""")
def normalized_lse(spark, d):
    e = F.col("per_line_energies")
    rows = _recs(spark, d).select("run", F.inline(F.array(*[
        F.struct(F.lit(t).alias("temperature"), A.normalized_lse(e, t).alias("v")) for t in (0.05, 0.5, 2.0, 1000.0)])))
    return r6(rows.groupBy("run", "temperature").agg(F.avg("v").alias("mean_value"), F.count("*").alias("n")), "mean_value")


@query("history_plateau", """
with h as (select *, row_number() over (partition by event_type order by ts, event_id) as rn from events),
w as (select event_type, event_id, rn, avg(value) over (partition by event_type order by rn rows between 19 preceding and 10 preceding) as a,
        avg(value) over (partition by event_type order by rn rows between 9 preceding and current row) as b from h)
select event_type, event_id, round(case when rn >= 20 then a end, 6) as first_half, round(case when rn >= 20 then b end, 6) as second_half,
  rn >= 20 and b >= 0.98 * a as plateau from w""")
def history_plateau(spark, d):
    ev = bridge.table(spark, d, "events").select("event_type", "ts", "event_id", F.col("value").alias("loss"))
    out = Q.plateau(ev, 20, ["event_type"], ["ts", "event_id"])
    return r6(out.select("event_type", "event_id", "first_half", "second_half", "plateau"), "first_half", "second_half")


@query("step_schedules", """
select event_id, round(case when event_id < 500 then event_id / 500.0 else 0.1 + 0.9 * 0.5 * (1 + cos(pi() *
   least(1, (event_id - 500) / 4500.0::double))) end, 6) as lr, round(2.0 - 1.3 * least(1, event_id / 5000.0::double), 6) as temperature from events""")
def step_schedules(spark, d):
    step = F.col("event_id")
    return r6(bridge.table(spark, d, "events").select(
        "event_id", Q.learning_rate_factor(step, 5000, 0.1, 0.1).alias("lr"),
        Q.temperature(step, 5000, 2.0, 0.7).alias("temperature")), "lr", "temperature")
