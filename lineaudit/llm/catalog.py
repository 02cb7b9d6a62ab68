"""The operators of this package applied to the test tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from lineaudit.llm import centroids, decontamination, filter_audit, fingerprints, mixing, near_dedup, pieces, pii, quality, rollups, sharding, toxicity, warc
from lineaudit.llm.common import settle, shared_folder, table

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), corpus_pipeline.piece_model())


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query
def op9_benchmark_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_bottom_k_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


@query
def op10_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))


ORACLE["op10_warc_salvage"] = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
     q as (select *, min(page_id) over (partition by html) as first from p)
select page_id, strlen(html)::bigint as payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((
           ('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from q"""

@query
def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"))


ORACLE["op3_extendible_shards"] = f"""
with r as (select doc_id, coalesce(strlen(text), 0)::bigint as bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as h from documents),
     d as (select r.*, depth, h >> (48 - depth)::int as prefix from r, range(49) t(depth)),
     s as (select depth, prefix, sum(bytes) as shard_bytes, count(distinct h) as keys from d group by all),
     f as (select d.doc_id, d.bytes, d.h, d.depth, d.prefix, s.shard_bytes,
                  row_number() over (partition by d.doc_id order by d.depth) as k
           from d join s using (depth, prefix) where s.shard_bytes <= {sharding.LIMIT} or s.keys = 1)
select doc_id, bytes, case when depth = 0 then '' else lpad(bin(prefix), depth::int, '0') end as shard,
       depth::int as depth, shard_bytes::bigint as shard_bytes, shard_bytes > {sharding.LIMIT} as oversized
from f where k = 1"""


@query
def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are loaded under two tokenizer versions, words without a letter or digit are then taken out of the
    first version's counts, exact copies of a smaller id are deleted, and the first batch comes twice."""
    docs = table(spark, sf_dir, "documents")
    store = rollups.Store(spark, shared_folder(spark, "rollups"))
    text = F.col("text")
    load = rollups.changes(docs, "insert", "words-1", rollups.blank_words(text))
    store.commit("load-words", load)
    store.commit("load-runs", rollups.changes(docs, "insert", "runs-1", rollups.letter_runs(text)))
    noisy = docs.where(text.rlike(r"[#$%&*|]"))
    store.commit("clean-words", rollups.changes(noisy, "revise", "words-1", rollups.blank_words(F.regexp_replace(text, r"[#$%&*|]+", ""))))
    keyed = docs.select("doc_id", "source", "lang", F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("k"))
    firsts = keyed.groupBy("k").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    copies = settle(keyed.join(firsts.select("k", "first"), "k").where("doc_id <> first"))
    store.commit("drop-copies", rollups.changes(copies, "delete", "words-1", F.lit(0)).unionByName(
        rollups.changes(copies, "delete", "runs-1", F.lit(0))))
    store.commit("load-words", load)
    return store.totals()


ORACLE["op6_token_rollups"] = r"""
with d as (select doc_id, source, lang, coalesce(text, '') as t from documents),
     k as (select *, doc_id = min(doc_id) over (partition by t) as first from d),
     c as (select source, lang, 'words-1' as version, len(regexp_extract_all(regexp_replace(t, '[#$%&*|]+', '', 'g'), '[^\x20\x09-\x0D]+')) as n from k where first
           union all
           select source, lang, 'runs-1', len(regexp_extract_all(t, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) from k where first)
select source, lang, version, count(*)::bigint as documents, sum(n)::bigint as tokens from c group by all"""

@query
def op11_orchard_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def _rounds(n: int) -> str:
    """Assignment and update as common table expressions, n times."""
    out = ""
    for i in range(n + 1):
        out += f""",
near{i} as materialized (
  select vec_id, i, v, c as cluster, g, d from (
    select v.*, c.c, c.v as g, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
    from vectors v, c{i} c) qualify row_number() over (partition by i order by d, c) = 1)"""
        if i < n:
            out += f""",
sums{i} as (select cluster, list(s order by p) as v from (
  select cluster, p, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::bigint // count(*)::bigint as s
  from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as p from near{i}) group by all) group by cluster),
c{i + 1} as materialized (select c.c, coalesce(s.v, c.v) as v from c{i} c left join sums{i} s on s.cluster = c.c)"""
    return out


ORACLE["op11_orchard_centroids"] = f"""
with vectors as materialized (
  select vec_id, row_number() over () as i, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by h, v) - 1 as c, v from (
    select sha256('2:' || coalesce(vec_id::varchar, '')) as h, v from vectors order by h, v limit 40)){_rounds(5)}
select vec_id, cluster::int as cluster, d as distance, (sum(d) over (partition by cluster))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, sha256(array_to_string(g, ',')) as centroid_sha256,
       count(*) over (partition by cluster) as cluster_size
from near5"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
with l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
     d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
     w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as low from d),
     m as (select w.part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
                  (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
                  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
                  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > low, false)::int as mask
           from w left join l on l.doc_id = w.doc_id),
     c as (select part, mask, good, toxic, count(*) as n from m group by all),
     f as (select unnest(range(5)) as b),
     o as (select [p.b, q.b, r.b, s.b, u.b] as p from f p, f q, f r, f s, f u where len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5),
     e as (select array_to_string(list_transform(p, lambda x: substr('ABCDE', x::int + 1, 1)), '') as filter_order, k::int as step,
                  1 << p[k]::int as bit, coalesce(list_sum(list_transform(p[1:k - 1], lambda x: 1 << x::int)), 0)::int as seen
           from o, range(1, 6) t(k)),
     g as (select part, filter_order, step, bit, sum(case when mask & (seen | bit) = 0 then n else 0 end) as kept,
                  sum(case when mask & bit <> 0 and mask & seen = 0 then n else 0 end) as removed,
                  sum(case when mask & bit <> 0 and mask & seen <> 0 then n else 0 end) as redundant,
                  sum(case when mask = bit then n else 0 end) as unique_fails,
                  sum(case when mask & bit <> 0 and mask & seen = 0 and good then n else 0 end) as good_lost,
                  sum(case when mask & bit <> 0 and mask & seen = 0 and toxic then n else 0 end) as toxic_lost
           from c, e group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, bit))::bigint as shapley from g"""


@query
def op13_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE["op13_curriculum_mix"] = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                  md5('mix:' || coalesce(doc_id::varchar, '')) as h from documents),
     s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 as turn from d group by source),
     w as (select *, [5.0::double, 2, 1][turn + 1] as weight, [5.5::double, 2, 0.5][turn + 1] as start_weight, [-1.0::double, 0, 1][turn + 1] as slope from s),
     p as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
                  coalesce(sum(3 * source_size) over r, 0) as caps, coalesce(sum(weight) over r, 0) as before
           from w window r as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
     v as (select max((total - caps)::double / (weights - before)) as level from p where (total - caps)::double / (weights - before) <= 3 * source_size / weight),
     t as (select source, source_size, weight, start_weight, slope, least((3 * source_size)::double, coalesce(level * weight, (3 * source_size)::double)) as target from w, v),
     q as (select *, floor(target + 0.5)::bigint as quota from t),
     x as (select d.doc_id, d.size, q.* exclude (source),
                  coalesce(sum(d.size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
           from d join q on d.source is not distinct from q.source),
     y as (select *, start::double / nullif(quota, 0) * weight as area from x)
select doc_id, size, source_size, target,
       (case when source_size = 0 then 0 else (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) end)::bigint as taken,
       case when size > 0 and start < quota then case when area > 0 then 2 * area / (start_weight + sqrt(start_weight * start_weight + 2 * slope * area)) else 0.0 end end as position
from y"""

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
