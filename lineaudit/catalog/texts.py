"""Registered queries: text operators, answers, raw corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineaudit import bridge
from lineaudit.catalog.ranking import r6
from lineaudit.functions import ranking as R
from lineaudit.functions import responses as A
from lineaudit.functions import text as T
from lineaudit.operators import corpus as C
from lineaudit.operators import models
from lineaudit.operators import repair as Q
from lineaudit.operators import scorers as S
from lineaudit.sources import corpora as K
from lineaudit.sources import blocks as TF

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _sha(c):
    return F.sha1(F.encode(c, "UTF-8"))


def _impls(spark, d):
    return bridge.impls(spark, d).withColumn("_l", T.splitlines(F.col("impl_text")))


_JOINED = "sha1(string_agg({}, chr(10) order by src_idx))"


@query("line_index_map", f"""with {bridge.SQL_LINES}
select l.impl_id, l.src_idx::int as src_idx, s.sent_idx::int as sent_idx, l.buggy
from lines l left join sc s on s.impl_id = l.impl_id and s.src_idx = l.src_idx""")
def line_index_map(spark, d):
    from lineaudit.plans.lines import explode_lines
    return explode_lines(bridge.impls(spark, d)).select("impl_id", "src_idx", "sent_idx", "buggy")


@query("sentinel_labels", f"""with {bridge.SQL_LINES}
select impl_id, count(*) filter (where buggy) as n_labels, coalesce(sum(sent_idx) filter (where buggy), 0)::bigint as label_sum
from sc group by impl_id""")
def sentinel_labels(spark, d):
    recs = bridge.records(spark, d, "length")
    b = F.col("buggy_line_indices")
    return recs.select("impl_id", F.size(b).cast("long").alias("n_labels"), F.aggregate(
        b, F.lit(0).cast("long"), lambda a, x: a + x).alias("label_sum"))


@query("insert_sentinels", f"""with {bridge.SQL_LINES},
x as (select l.impl_id, l.src_idx, line_text || case when s.src_idx is not null then chr(10) || '<|fim_pad|>' else '' end as t
      from lines l left join (select impl_id, src_idx from sc) s using (impl_id, src_idx))
select impl_id, {_JOINED.format('t')} as digest from x group by impl_id""")
def insert_sentinels(spark, d):
    rows = _impls(spark, d).filter(F.size("_l") > 0)
    return rows.select("impl_id", _sha(T.insert_sentinels(F.col("_l"))).alias("digest"))


@query("normalize_lines", f"""with {bridge.SQL_LINES}
select trim(split_part(line_text, '//', 1)) as norm, count(*) as n, count(distinct impl_id) as n_impls from sc group by 1""")
def normalize_lines(spark, d):
    texts = T.scorable_texts(F.col("_l"))
    rows = _impls(spark, d).select("impl_id", F.explode(F.transform(texts, T.normalize_line)).alias("norm"))
    # Count repeats inside an implementation first: distinct ids become a plain count.
    per = rows.groupBy("norm", "impl_id").agg(F.count("*").alias("c"))
    return per.groupBy("norm").agg(F.sum("c").alias("n"), F.count("*").alias("n_impls"))


@query("strip_variants", f"""with {bridge.SQL_LINES},
t as (select impl_id, string_agg(line_text, chr(10) order by src_idx) as t,
   {_JOINED.format("case when contains(line_text, '// FAILS') then rtrim(split_part(line_text, '// FAILS', 1)) else line_text end")} as fails_cut,
   {_JOINED.format("regexp_replace(line_text, '(?i)\\s*//\\s*(FAILS|FIXME|fails[-_].*|expected[-_]fail.*)\\b.*$', '')")} as line_markers
   from lines group by impl_id)
select impl_id, fails_cut, line_markers,
  sha1(regexp_replace(t, '(?im)\\s*//\\s*(?:FAILS?|FIXME|TODO|BUG|XXX|HACK|broken|wrong|ok|verified|passes)\\b.*?$', '', 'g')) as markers
from t""")
def strip_variants(spark, d):
    rows = _impls(spark, d).filter(F.size("_l") > 0)
    return rows.select(
        "impl_id", _sha(T.join_lines(T.strip_fails(F.col("_l")))).alias("fails_cut"),
        _sha(T.join_lines(T.strip_line_markers(F.col("_l")))).alias("line_markers"),
        _sha(T.strip_markers(F.col("impl_text"))).alias("markers"))


@query("fails_lines", f"""with {bridge.SQL_LINES}
select impl_id, src_idx::int as src_idx from lines where contains(line_text, '// FAILS')""")
def fails_lines(spark, d):
    return _impls(spark, d).select("impl_id", F.explode(T.fails_line_indices(F.col("_l"))).alias("src_idx"))


@query("strict_scorable", f"""with {bridge.SQL_LINES},
s as (select *, trim(line_text) as t from lines)
select impl_id, count(*) as n, string_agg(src_idx::varchar, ',' order by src_idx) as lines from s
where t <> '' and t not in ('{{', '}}', '{{}}', '()', ');') and not starts_with(t, ')')
  and not (starts_with(t, '//') and not contains(t, '// FAILS')) group by impl_id""")
def strict_scorable(spark, d):
    rows = _impls(spark, d).select("impl_id", T.indices_where(F.col("_l"), T.is_scorable_strict).alias("i"))
    return rows.select("impl_id", F.size("i").cast("long").alias("n"), F.array_join("i", ",").alias("lines")).filter("n > 0")


@query("flag_suspicious", f"""with {bridge.SQL_LINES},
r as (select *, row_number() over (partition by impl_id order by length(trim(line_text)) desc, sent_idx) as rk from sc),
x as (select l.impl_id, l.src_idx, l.line_text || case when r.rk <= 3 then '  // <-- SUSPICIOUS' else '' end as t
      from lines l left join r on r.impl_id = l.impl_id and r.src_idx = l.src_idx)
select impl_id, {_JOINED.format('t')} as digest from x group by impl_id""")
def flag_suspicious(spark, d):
    rows = _impls(spark, d).filter(F.size("_l") > 0)
    top = R.top_k(S.length(T.scorable_texts(F.col("_l")), F.col("impl_id")), 3)
    return rows.select("impl_id", _sha(T.flag_suspicious(
        F.col("_l"), T.scorable_line_indices(F.col("_l")), top)).alias("digest"))


@query("numbered_prompt", f"""with {bridge.SQL_LINES}
select impl_id, sha1(string_agg(sent_idx || ': ' || line_text, chr(10) order by sent_idx)) as digest from sc group by impl_id""")
def numbered_prompt(spark, d):
    rows = _impls(spark, d).withColumn("_t", T.scorable_texts(F.col("_l"))).filter(F.size("_t") > 0)
    return rows.select("impl_id", _sha(T.numbered_lines(F.col("_t"))).alias("digest"))


@query("scorer_skips", f"""with {bridge.SQL_LINES},
p as (select raw.impl_id, coalesce(bool_and(trim(l.line_text) = ''), true) as blank from raw left join lines l using (impl_id) group by 1)
select count(*) as n_total, count(*) filter (where blank) as n_blank,
  count(*) filter (where not blank and impl_id not in (select impl_id from sc)) as n_without_scorable,
  count(*) filter (where not blank and impl_id in (select impl_id from sc)) as n_scored from p""")
def scorer_skips(spark, d):
    return S.skip_counts(bridge.impls(spark, d))


@query("tractable_impls", f"""with {bridge.SQL_LINES},
n as (select impl_id, count(*) as n_lines, count(*) filter (where buggy) as nb from lines group by impl_id),
s as (select impl_id, count(*) as ns from sc group by impl_id)
select impl_id from n join s using (impl_id) where nb = 1 and ns between 2 and 20 and n_lines <= 25""")
def tractable_impls(spark, d):
    rows = bridge.impls(spark, d)
    return rows.filter(C.tractable()).select("impl_id")


@query("heatmap_pools", f"""with {bridge.sql_scored()}
select run, case when best_rank = 1 then 'correct' else 'wrong' end as pool, count(*) as n
from rec where status = 'FAIL' and n_bug > 0 and n_lines between 5 and 35 group by all""")
def heatmap_pools(spark, d):
    return C.heatmap_pools(bridge.records(spark, d)).groupBy("run", "pool").agg(F.count("*").alias("n"))


@query("turn_similarity", """with p as (
  select conv_id, turn, text as b, lag(text) over (partition by conv_id order by turn) as a from conversations),
g as (select conv_id, turn,
    list_distinct(case when length(a) = 1 then [a] else list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) end) as ga,
    list_distinct(case when length(b) = 1 then [b] else list_transform(range(1, length(b)), lambda i: substr(b, i, 2)) end) as gb
  from p where a is not null)
select conv_id, turn, round(case when len(ga) = 0 and len(gb) = 0 then 1 when len(ga) = 0 or len(gb) = 0 then 0
  else len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb))) end, 6) as jaccard from g""")
def turn_similarity(spark, d):
    turns = bridge.table(spark, d, "conversations")
    prev = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a"))
    rows = turns.join(prev, ["conv_id", "turn"])
    return r6(rows.select("conv_id", "turn", T.char_jaccard(F.col("a"), F.col("text")).alias("jaccard")), "jaccard")


@query("file_safe_names", """
select page_id, regexp_replace(url, '[/\\\\]', '__', 'g') as name, substr(sha1(url), 1, 16) as digest from pages""")
def file_safe_names(spark, d):
    return bridge.table(spark, d, "pages").select(
        "page_id", T.file_safe(F.col("url")).alias("name"), T.text_hash(F.col("url")).alias("digest"))


# -- code built around the conversation turns ------------------------------------------

def _code(text):
    return F.concat(F.lit("use lib;\nfn main() {\n}\npub fn f(a: u64)\n    requires a > 0,\n{\n"), text, F.lit("\n}"))


@query("spec_impl_split", f"""
select conv_id, turn, case turn % 3 when 0 then 'pub fn f(a: u64)' || chr(10) || '    requires a > 0,' || chr(10) || '{{'
    when 1 then 'struct S {{' else text end as spec_text,
  sha1(case turn % 3 when 0 then text || chr(10) || '}}' when 1 then regexp_replace(text, '\n$', '') else '' end) as impl_digest,
  (turn % 3 = 0) as has_signature from conversations""")
def spec_impl_split(spark, d):
    t = F.col("text")
    rows = bridge.table(spark, d, "conversations")
    code = F.when(F.col("turn") % 3 == 0, _code(t)).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("struct S {\n"), t)).otherwise(t)
    rows = rows.select("conv_id", "turn", code.alias("code"))
    parts = rows.select("conv_id", "turn", T.spec_impl(F.col("code")).alias("p"), T.signature_line(
        T.splitlines(F.col("code"))).isNotNull().alias("has_signature"))
    return parts.select("conv_id", "turn", F.col("p.spec").alias("spec_text"), _sha(F.col("p.impl")).alias("impl_digest"),
                        "has_signature")


@query("answer_code", r"""
select conv_id, turn, sha1(nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')) as digest from conversations""")
def answer_code(spark, d):
    t = F.col("text")
    rows = bridge.table(spark, d, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.concat(
        F.lit("Here:\n```rust\nuse vstd::prelude::*;\nverus! {\n"), t, F.lit("\n} // end\n```\nDone."))).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("```\n"), t, F.lit("\nfn main() {}\n```"))).otherwise(t)
    return rows.select("conv_id", "turn", _sha(T.response_code(answer)).alias("digest"))


@query("verifier_output", """
select event_id, case when event_type = 'error' then 0 else round(value)::int % 7 end as n_verified,
  case when event_type = 'error' then 2 else user_id::int % 3 end as n_errors from events""")
def verifier_output(spark, d):
    ev = bridge.table(spark, d, "events")
    out = F.when(F.col("event_type") == "error", F.lit("error: a\nnote: b\nerror: c\nan error: d")).otherwise(
        F.format_string("x\nverification results:: %d verified, %d errors\n",
                        F.round("value", 0).cast("int") % 7, F.col("user_id").cast("int") % 3))
    return ev.select("event_id", T.verifier_counts(out).alias("c")).select("event_id", "c.n_verified", "c.n_errors")


@query("json_item_parse", """
select event_id, coalesce(json_extract_string(props, '$.k')::bigint, 0) as k from events""")
def json_item_parse(spark, d):
    ev = bridge.table(spark, d, "events")
    return ev.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@query("schema_key_census", """
select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key""")
def schema_key_census(spark, d):
    from lineaudit.sources.records import census
    return census(bridge.table(spark, d, "events"), "props")


def _answers(spark, d):
    k = F.from_json("props", "k int")["k"]
    listed = F.format_string("[%d, %d, %d, 0, 1, 2, 3]", k % 11, k % 7, k % 5)
    e = F.col("event_type")
    content = (
        F.when(e == "click", F.concat(F.lit('{"top_lines": '), listed, F.lit("}")))
        .when(e == "view", F.concat(F.lit('I think {"top_lines": '), listed, F.lit("} fits")))
        .when(e == "purchase", F.concat(F.lit("lines "), listed, F.lit(" or -4")))
        .when(e == "signup", F.lit('{"other": 1}')).otherwise(F.lit("none")))
    return bridge.table(spark, d, "events").select("event_id", "user_id", "event_type", k.alias("k"), content.alias("content"))


@query("rank_response_parse", """
with c as (select event_id, user_id, json_extract_string(props, '$.k')::int as k, event_type from events),
l as (select event_id, 1 + user_id % 9 as n, case when event_type in ('click', 'view') then [k % 11, k % 7, k % 5, 0, 1, 2, 3]
    when event_type = 'purchase' then [k % 11, k % 7, k % 5, 0, 1] else [] end as x from c),
u as (select event_id, unnest(x) as i, generate_subscripts(x, 1) as p, n from l),
f as (select event_id, i, min(p) as p from u where i >= 0 and i < n group by event_id, i),
o as (select event_id, i, row_number() over (partition by event_id order by p) as r from f)
select l.event_id, coalesce(string_agg(i::varchar, ',' order by r) filter (where r <= 5), '') as top,
  coalesce(sum((6 - r) * (i + 1)) filter (where r <= 5), 0)::double as energy_check
from l left join o using (event_id) group by l.event_id""")
def rank_response_parse(spark, d):
    n = (1 + F.col("user_id") % 9).cast("int")
    rows = _answers(spark, d).withColumn("n", n).withColumn("top", A.ranked_lines(F.col("content"), F.col("n")))
    energies = S.rank_to_energies(F.col("top"), F.col("n"))
    weighted = F.aggregate(F.transform(energies, lambda e, i: e * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("event_id", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"),
                       weighted.alias("energy_check"))


@query("verdict_parse", """
with c as (select event_id, json_extract_string(props, '$.k')::int as k, event_type from events)
select event_id, case when event_type in ('click', 'view') then case when k % 2 = 0 then 'pass' else 'fail' end end as verdict,
  case when event_type in ('click', 'view') then least(1.0, k / 80.0::double) end as p_fail,
  case when event_type in ('click', 'view') then least(1.0, k / 80.0::double) else 0.5 end as energy from c""")
def verdict_parse(spark, d):
    k = F.col("k")
    body = F.concat(F.lit('{"verdict": "'), F.when(k % 2 == 0, "PASS").otherwise("fail"), F.lit('", "p_fail": '),
                    (k / 80.0).cast("string"), F.lit("}"))
    e = F.col("event_type")
    content = F.when(e == "click", body).when(e == "view", F.concat(F.lit("so: "), body)).otherwise(
        F.when(e == "signup", F.lit('{"verdict": "maybe"}')).otherwise(F.lit("unsure")))
    rows = _answers(spark, d).select("event_id", A.verdict(content).alias("v"))
    return rows.select("event_id", "v.verdict", "v.p_fail", A.verdict_energy(F.col("v")).alias("energy"))


@query("status_dialects", """
with r as (select case event_type when 'signup' then 'Status.PASS' when 'click' then 'failed' when 'view' then 'token'
   when 'purchase' then 'success' else 'x.err_OK' end as raw from events)
select raw, upper(split_part(raw, '.', -1)) as verbatim,
  case raw when 'Status.PASS' then 'PASS' when 'failed' then 'FAIL' when 'token' then 'PASS' when 'success' then 'UNKNOWN' else 'FAIL' end as fail_first,
  case raw when 'Status.PASS' then 'PASS' when 'failed' then 'FAIL' when 'token' then 'PASS' when 'success' then 'UNKNOWN' else 'PASS' end as pass_first,
  case raw when 'Status.PASS' then 'PASS' when 'x.err_OK' then 'PASS' else 'UNKNOWN' end as by_suffix,
  case raw when 'success' then 'PASS' else 'UNKNOWN' end as trajectory, count(*) as n from r group by raw""")
def status_dialects(spark, d):
    e = F.col("event_type")
    raw = (F.when(e == "signup", "Status.PASS").when(e == "click", "failed").when(e == "view", "token")
           .when(e == "purchase", "success").otherwise("x.err_OK"))
    return C.status_census(bridge.table(spark, d, "events").select(raw.alias("raw")))


@query("joined_spec_impl", f"""with {bridge.SQL_LINES},
t as (select impl_id, string_agg(line_text, chr(10) order by src_idx) as t from lines group by 1)
select impl_id, sha1(rtrim(spec_text) || chr(10) || regexp_replace(t, '^\\n+', '')) as digest from t join raw using (impl_id)""")
def joined_spec_impl(spark, d):
    rows = bridge.impls(spark, d).filter(F.col("impl_text") != "")
    return rows.select("impl_id", _sha(T.join_spec_impl(F.col("spec_text"), F.col("impl_text"))).alias("digest"))


_WORDS = "len(list_filter(string_split({}, ' '), lambda w: w <> ''))"


@query("tokenized_examples", f"""with {bridge.SQL_LINES},
n as (select impl_id, count(*) as ns, count(*) filter (where buggy) as nb from sc group by 1),
w as (select impl_id, sum({_WORDS.format('line_text')}) as nw from lines group by 1),
k as (select impl_id, {_WORDS.format('spec_text')} as sw, nw + ns + sw as total, ns, nb from n join w using (impl_id) join raw using (impl_id))
select impl_id, total::int as n_tokens, sw::int as spec_token_count, ns::int as n_sentinels, nb::int as n_labels from k where total <= 2048""")
def tokenized_examples(spark, d):
    """A word tokenizer stands in for the model's own."""
    def make():
        return lambda text: [0 if w == "<S>" else len(w) for w in text.split()]

    rows = models.tokenize(bridge.impls(spark, d), make, 0, 2048, sentinel="<S>")
    return rows.select("impl_id", F.size("input_ids").alias("n_tokens"), "spec_token_count",
                       F.size("sentinel_positions").alias("n_sentinels"), F.size("buggy_line_indices").alias("n_labels"))


@query("surprisal_lines", """
with w as (select conv_id, turn, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as i from conversations),
s as (select *, ends_with(w, '.') as stop, count(*) filter (where ends_with(w, '.')) over (partition by conv_id, turn order by i) as k from w),
g as (select conv_id, turn, case when stop then k - 1 else k end as line, stop, length(w) / 10.0::double as lp, i from s),
c as (select conv_id, turn, line, avg(lp) filter (where not stop and i >= 1) as e, bool_or(stop) as closed from g group by all)
select conv_id, turn, line::int as line, round(coalesce(e, 0), 6) as energy from c where closed""")
def surprisal_lines(spark, d):
    """Word lengths stand in for log-probabilities, full stops for sentinels."""
    words = F.split("text", " ")
    rows = bridge.table(spark, d, "conversations").select(
        "conv_id", "turn", F.transform(words, lambda w: -F.char_length(w) / 10.0).alias("log_probs"),
        T.indices_where(words, lambda w: w.endswith(".")).alias("sentinel_positions"), F.lit(1).alias("spec_token_count"))
    out = models.surprisal_records(rows).select("conv_id", "turn", F.posexplode("per_line_energies").alias("line", "energy"))
    return r6(out, "energy")


@query("records_with_texts", f"""with {bridge.sql_scored('length')}
select impl_id, n_lines::int as n_texts, round(whole, 6) as whole_impl_energy from rec""")
def records_with_texts(spark, d):
    recs = bridge.records(spark, d, "length")
    out = Q.with_texts(recs.drop("scorable_line_texts"), recs.select("impl_id", "scorable_line_texts"))
    return r6(out.select("impl_id", F.size("scorable_line_texts").alias("n_texts"), "whole_impl_energy"), "whole_impl_energy")


# -- raw corpora --------------------------------------------------------------------------

def _raw_trajectories(spark, d):
    t, turn = F.col("text"), F.col("turn")
    fenced = F.concat(F.lit("try\n```rust\n"), _code(t), F.lit("\n```\n"))
    return bridge.table(spark, d, "conversations").select(
        F.when(turn % 4 == 0, "success").when(turn % 4 == 1, "error").when(turn % 4 == 2, "timeout")
        .otherwise("queued").alias("status"),
        F.when(turn % 4 == 0, _code(t)).alias("verified_code"),
        F.when(turn % 4 != 0, F.to_json(F.struct(
            F.when(turn % 4 == 1, fenced).alias("output"), fenced.alias("input")))).alias("original_item"),
        F.col("conv_id").alias("original_index"), turn.cast("int").alias("repetition"),
        F.when(turn % 4 == 2, F.col("role")).alias("log"), (turn % 2).cast("int").alias("return_code"))


@query("trajectory_examples", """
select 'traj-' || conv_id as spec_id, 'traj-' || conv_id || '-rep' || turn as impl_id,
  case when turn % 4 = 0 then 'PASS' else 'FAIL' end as status,
  sha1(text || chr(10) || '}') as impl_digest,
  'pub fn f(a: u64)' || chr(10) || '    requires a > 0,' || chr(10) || '{' as spec_text
from conversations where turn % 4 <> 3""")
def trajectory_examples(spark, d):
    return K.parse_trajectories(_raw_trajectories(spark, d)).select(
        "spec_id", "impl_id", "status", _sha(F.col("impl_text")).alias("impl_digest"), "spec_text")


@query("loaded_corpora")
def loaded_corpora(spark, d):
    """All corpora in one table; the repair side rests on difflib, so rows only."""
    both = K.load_all([K.parse_trajectories(_raw_trajectories(spark, d))], [K.parse_repair_pairs(_raw_pairs(spark, d), ["ord"])])
    return both.groupBy("src_ord", "source", "status").agg(F.count("*").alias("n"), F.count_distinct("spec_id").alias("n_specs"))


@query("trajectory_classes", """
with r as (select conv_id as spec, turn % 4 as m, turn % 2 as rc, case when turn % 4 = 1 then length(text) else 0 end as out from conversations),
s as (select spec, bool_or(m = 0) as p, bool_or(m in (1, 2)) as f, bool_and(m = 0) as ap, bool_and(m in (1, 2)) as af,
        count(distinct rc) > 1 or count(distinct m) > 1 or count(distinct out) > 1 as dif from r group by spec)
select case when p and f then 'mixed' when ap then 'all_pass' when af then 'all_fail' else 'other' end as kind,
  count(*) as n, count(*) filter (where af and dif) as n_differential from s group by 1""")
def trajectory_classes(spark, d):
    return C.trajectory_classes(_raw_trajectories(spark, d).withColumnRenamed("original_index", "spec"))


@query("trajectory_diff")
def trajectory_diff(spark, d):
    """difflib matching has no SQL form; tested against difflib itself."""
    rows = bridge.table(spark, d, "conversations").select(
        F.col("conv_id").alias("spec"), F.col("turn").alias("repetition"), F.col("turn").alias("ord"),
        F.col("text").alias("code"))
    return r6(C.trajectory_diff(rows), "share_p25", "share_p50", "share_p75")


@query("log_availability", """
with r as (select case turn % 4 when 0 then 'success' when 1 then 'error' when 2 then 'timeout' else 'queued' end as status,
   case when turn % 4 = 2 then length(role) else 0 end as n from conversations)
select status, count(*) as n, count(*) filter (where n = 0) as n_empty, round(100.0 * count(*) filter (where n = 0) / count(*), 6) as empty_pct,
  round(coalesce(avg(n) filter (where n > 0), 0), 6) as nonempty_mean, max(n)::int as max_len from r group by status""")
def log_availability(spark, d):
    return r6(C.log_availability(_raw_trajectories(spark, d)), "empty_pct", "nonempty_mean")


@query("log_verdict", """
select count(*) as n_fail, count(*) filter (where turn % 4 = 2 and role <> '') as n_with_log, 'inspect' as verdict
from conversations where turn % 4 in (1, 2)""")
def log_verdict(spark, d):
    return C.log_verdict(_raw_trajectories(spark, d))


def _raw_pairs(spark, d):
    """Marked implementations as the broken side, the same without markers as the fixed side."""
    rows = bridge.impls(spark, d)
    fixed = T.join_lines(T.strip_fails(T.splitlines(F.col("impl_text"))))
    err = F.when(F.col("status") == "UNKNOWN", F.lit("")).otherwise(
        F.concat(F.lit("\nThe error messages are below\n```\nat "), F.col("spec_id"), F.lit("\n```\n")))
    return rows.select(
        F.col("impl_id").alias("ord"),
        F.concat(F.lit("Fix\n```rust\n"), _code(F.col("impl_text")), F.lit("\n```\n"), err).alias("input"),
        F.when(F.col("status") == "PASS", F.concat(F.lit("```rust\n"), _code(fixed), F.lit("\n```"))).otherwise(
            _code(fixed)).alias("output"))


@query("repair_pair_scan", """
select count(*) as n_seen, count(*) as n_with_code, count(*) filter (where quality is not null) as n_with_error,
  count(*) filter (where quality is not null) as n_candidates,
  round(count(*) filter (where quality is not null) / count(*), 6) as candidate_share
from documents left join labels using (doc_id)""")
def repair_pair_scan(spark, d):
    return r6(C.pair_scan(_raw_pairs(spark, d)), "candidate_share")


@query("repair_pair_examples")
def repair_pair_examples(spark, d):
    """Labels come from a difflib diff: rows only, tested against difflib."""
    out = K.parse_repair_pairs(_raw_pairs(spark, d), ["ord"])
    return out.select("impl_id", "spec_id", "status", F.size("buggy_lines").alias("n_labels"), "sibling_impl_id",
                      F.col("verifier_log").isNotNull().alias("has_log"))


@query("diff_size_estimate")
def diff_size_estimate(spark, d):
    raw = _raw_pairs(spark, d)
    diffed = K.with_diff(K.debugging_candidates(raw)).select(F.size("buggy_lines").alias("n_changed"))
    out = C.usable_estimate(C.pair_scan(raw), C.diff_size_quantiles(diffed))
    return r6(out, "candidate_share", "small_share", "usable_share")


def _tasks(spark, d):
    rows = bridge.impls(spark, d)
    good = T.join_lines(T.strip_fails(T.splitlines(F.col("impl_text"))))
    return rows.select(
        F.concat(F.lit("Rust/"), F.col("impl_id")).alias("task_id"), F.lit("f").alias("entry_point"),
        F.lit("fn f()\n").alias("declaration"), F.col("spec_text").alias("docstring"), good.alias("canonical_solution"),
        F.col("impl_text").alias("buggy_solution"), F.col("status").alias("bug_type"),
        F.lit(None).cast("string").alias("failure_symptoms"))


@query("task_examples", f"""with {bridge.SQL_LINES},
t as (select impl_id, any_value(status) as status, string_agg(line_text, chr(10) order by src_idx) as bad,
   string_agg(case when contains(line_text, '// FAILS') then rtrim(split_part(line_text, '// FAILS', 1)) else line_text end,
              chr(10) order by src_idx) as good from lines group by impl_id),
s as (select t.*, case when trim(spec_text) = '' then 'fn f()' else '// ' || trim(spec_text) || chr(10) || 'fn f()' end as spec
      from t join raw using (impl_id) where trim(replace(good, chr(10), '')) <> '')
select 'hep-Rust-' || impl_id || '-spec-' || substr(sha1(spec), 1, 12) as spec_id, 'PASS' as status,
   'hep-Rust-' || impl_id || '-pass-' || substr(sha1(spec || good), 1, 12) as impl_id, null as bug_type from s
union all select 'hep-Rust-' || impl_id || '-spec-' || substr(sha1(spec), 1, 12), 'FAIL',
   'hep-Rust-' || impl_id || '-fail-' || substr(sha1(spec || bad), 1, 12), status from s""")
def task_examples(spark, d):
    return K.parse_tasks(_tasks(spark, d)).select("spec_id", "status", "impl_id", "bug_type")


def _test_files(spark, d):
    """Each conversation as one test file, each turn as one test block."""
    turn, t = F.col("turn"), F.col("text")
    name = F.concat(F.lit("t"), F.floor(turn / 2).cast("string"), F.when(turn % 2 == 0, F.lit("_fails")).otherwise(F.lit("")))
    body = F.concat(F.lit("\nuse a;\nfn g() {\n"), t, F.when(turn % 2 == 0, F.lit(" // FAILS")).otherwise(F.lit("")), F.lit("\n}\n"))
    block = F.concat(
        F.lit("test_verify_one_file! {\n    #[test] "), name, F.lit(" verus_code! {"), body, F.lit("} => "),
        F.when(turn % 2 == 0, F.lit("Err(e)")).otherwise(F.lit("Ok(())")), F.lit("\n}\n"))
    turns = bridge.table(spark, d, "conversations").select("conv_id", "turn", block.alias("b"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "b"))).alias("x")).select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".rs")).alias("source_file"),
        F.array_join("x.b", "\n").alias("content"))


@query("test_file_examples", """
with t as (select *, turn // 2 as g, turn % 2 = 0 as bad from conversations),
p as (select conv_id, g, max(case when bad then text end) as f, max(case when not bad then text end) as o from t group by all),
n as (select *, row_number() over (partition by conv_id order by g) - 1 as n from p where f is not null),
s as (select *, 'verus-real-c' || conv_id || '-' || substr(sha1('usea;'), 1, 12) as spec_id from n)
select 'c' || conv_id || '.rs' as source_file, spec_id, 't' || g || '_fails' as test_name, 'FAIL' as status,
  spec_id || '-fail-t' || g || '_fails-' || n as impl_id,
  sha1('fn g() {' || chr(10) || f || ' // FAILS' || chr(10) || '}') as impl_digest from s
union all select 'c' || conv_id || '.rs', spec_id, 't' || g, 'PASS', spec_id || '-pass-t' || g || '-' || n,
  sha1('fn g() {' || chr(10) || o || chr(10) || '}') from s where o is not null""")
def test_file_examples(spark, d):
    out = TF.examples(_test_files(spark, d))
    return out.select("source_file", "spec_id", "test_name", "status", "impl_id", _sha(F.col("impl_text")).alias("impl_digest"))


@query("corpus_size", """
select split_part(split_part(url, '//', 2), '/', 1) as repo, count(*) filter (where contains(html, '<article')) as n_files,
  coalesce(sum(strlen(html)) filter (where contains(html, '<article')), 0)::bigint as n_bytes from pages group by 1""")
def corpus_size(spark, d):
    files = bridge.table(spark, d, "pages").select(
        F.substring_index(F.substring_index("url", "/", 3), "/", -1).alias("repo"), F.col("html").alias("content"))
    return K.corpus_size(files, "<article")


@query("corpus_verdict", """
select count(*) as n_files, sum(strlen(html))::bigint as n_bytes,
  case when sum(strlen(html)) < 2e6 then 'skip' when sum(strlen(html)) < 20e6 then 'skip unless early' else 'worthwhile' end as verdict
from pages""")
def corpus_verdict(spark, d):
    files = bridge.table(spark, d, "pages").select("url", F.col("html").alias("content")).withColumn("repo", F.lit("r"))
    return K.corpus_verdict(K.corpus_size(files, "<html"))


@query("line_count_percentiles", f"""with {bridge.SQL_LINES},
c as (select raw.status, count(l.src_idx) as n_lines from raw left join lines l using (impl_id) group by raw.impl_id, raw.status),
o as (select *, row_number() over (partition by status order by n_lines) - 1 as i, count(*) over (partition by status) as n from c)
select status, max(n) as n, max(case when i = floor(0.1::double * (n - 1)) then n_lines end)::int as p10,
 max(case when i = floor(0.5::double * (n - 1)) then n_lines end)::int as p50,
 max(case when i = floor(0.9::double * (n - 1)) then n_lines end)::int as p90,
 max(case when i = floor(0.99::double * (n - 1)) then n_lines end)::int as p99 from o group by status""")
def line_count_percentiles(spark, d):
    return C.line_count_percentiles(bridge.impls(spark, d), ["status"])


@query("status_pivot", f"""with {bridge.SQL_LINES}
select source, count(*) filter (where status = 'PASS') as "PASS", count(*) filter (where status = 'FAIL') as "FAIL",
  count(*) filter (where status = 'UNKNOWN') as "UNKNOWN" from raw group by source""")
def status_pivot(spark, d):
    return C.status_pivot(bridge.impls(spark, d))


@query("spec_mix", f"""with {bridge.SQL_LINES},
s as (select spec_id, bool_or(status = 'PASS') as p, bool_or(status = 'FAIL') as f from raw group by spec_id)
select case when p and f then 'mixed' when p then 'all_pass' when f then 'all_fail' else 'none' end as kind, count(*) as n from s group by 1""")
def spec_mix(spark, d):
    return C.spec_mix(bridge.impls(spark, d))


@query("drop_reasons", f"""with {bridge.SQL_LINES},
c as (select raw.impl_id, count(s.impl_id) as ns from raw left join sc s using (impl_id) group by 1),
w as (select c.*, coalesce(length(t), 0) as nc from c left join
  (select impl_id, string_agg(line_text, chr(10) order by src_idx) as t from lines group by 1) using (impl_id))
select case when ns = 0 then 'no_scorable_lines' when nc > 4096 then 'over_max_length' else 'kept' end as reason, count(*) as n
from w group by 1""")
def drop_reasons(spark, d):
    return C.drop_reasons(bridge.impls(spark, d), F.char_length("impl_text"), 4096)


@query("first_per_status", f"""with {bridge.SQL_LINES},
o as (select impl_id, status, row_number() over (partition by status order by impl_id) - 1 as position from raw)
select status, impl_id, position from o where position < 2""")
def first_per_status(spark, d):
    return C.first_per_group(bridge.impls(spark, d).select("status", "impl_id"), ["status"], ["impl_id"], 2)
