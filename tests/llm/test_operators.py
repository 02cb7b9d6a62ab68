"""Operators for training text against brute force, on small tables with odd rows."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lineaudit.llm import decontamination, fingerprints, near_dedup, pieces, pii, quality, rollups, sharding, toxicity, warc
from lineaudit.llm.common import components, shared_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, score double, label int"
WORDS = "the of and river stone light water under every house green small walk talk paper north south east west open".split()


def rows(texts, start=0):
    return [(start + i, t, "en" if i % 3 else None, "s", len(t) if t is not None else None, "x", 0.5, 1) for i, t in enumerate(texts)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [None, "", " \n\t", "one", "one two", "ONE two", prose(rng, 4000)]
    base = prose(rng, 120).split()
    for i in range(30):
        w = list(base)
        for _ in range(i % 7):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
        texts.append(" ".join(w))
    return texts + [prose(rng, rng.randrange(3, 60)) for _ in range(30)] + [" ".join(base)] * 3


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(rows(corpus) + [(None, "no id here", None, None, 10, None, None, None)] + rows(["twice the same row"] * 1, 500) * 2, SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def classes(texts, size, percent):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    sets = {i: sh(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs, size, percent):
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = classes(texts, size, percent)
    for r in near_dedup.near_duplicates(docs, shingle=size, percent=percent).collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0


def test_crowded_bucket_is_split_into_tiles(spark, monkeypatch, corpus):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(3)
    base, texts = prose(rng, 100).split(), []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"q{rng.randrange(99)}"
        texts.append(" ".join(w))
    got = {r[0]: (r[1], r[2]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), shingle=3, percent=85).collect()}
    assert got == classes(dict(enumerate(texts)), 3, 85)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7), (None, 3)], "a bigint, b bigint")
    got = dict(components(edges).collect())
    assert {got[i] for i in range(41)} == {0} and got[100] == got[99] == 99


def test_sketches(docs, empty):
    got = fingerprints.edited_pairs(docs).collect()
    assert len(got) == docs.count()
    known = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect() if r["doc_id"] is not None))
    digest = {}
    for (i, t), (_, n) in zip(known, known[1:] + known[:1]):
        h = len(t) // 2
        digest.setdefault(i, set()).add(hashlib.sha256((t[:len(t) - h] + n[:h]).encode()).hexdigest())
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["doc_id"] is None or r["edited_sha256"] in digest[r["doc_id"]]
    same = {r["fingerprint"] for r in got if r["doc_id"] in (67, 68, 69)}
    assert len(same) == 1 and fingerprints.edited_pairs(empty).count() == 0


def test_sketches_merge(docs):
    parts = docs.where("doc_id is not null").select(F.col("doc_id") % 2, fingerprints.sketch(F.col("text"), 16).alias("sketch"))
    got = fingerprints.merged(parts.toDF("g", "sketch"), ["g"], k=16).collect()
    for g, s in got:
        want = sorted({v for x, row in parts.collect() if x == g for v in row})[:16]
        assert s == want


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.piece_model())
    rng = random.Random(5)
    own = pieces.Pieces(corpus_pipeline.piece_model())
    bits = [" ", "  ", "▁", "ing", "é", "\n", "☃", "0", "文", "한", "x", "\x00", "😀", "  th", "====", "². ", "Ω", "the"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        ids = sp.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == sp.decode(ids)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pieces.encoded(docs, corpus_pipeline.piece_model()).collect():
        ids = sp.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert pieces.encoded(empty, corpus_pipeline.piece_model()).count() == 0


def test_piece_columns_round_trip(spark):
    path = corpus_pipeline.piece_model()
    df = spark.createDataFrame([("a  b é☃",), (None,), ("",)], "t string")
    got = df.select("t", pieces.decode_column(path, pieces.encode_column(path, F.col("t"))).alias("d")).collect()
    assert [d for _, d in got] == ["a  b é☃", "", ""]


def test_personal_data(spark, empty):
    texts = [None, "", "mail a.b@c.de, x@y.z@q.r and 1.2.3.4 or 1.2.3.400", "card 4111 1111 1111 1111, 4111111111111112 +1 (555) 010-2030",
             "9" * 3000, "é@b.c +49 12 " + "1.1.1.1 " * 300, "call (555) 123-4567"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r["doc_id"]: r for r in pii.found(df).collect()}
    assert got[2]["n_email"] == 2 and got[2]["n_ip"] == 1 and got[3]["n_card"] == 1 and got[3]["n_phone"] == 1
    assert got[4]["n_card"] == 0 and got[5]["n_ip"] == 300 and got[0]["spans"] == ""
    want = "email:5:13,email:15:20,ip:29:36"
    assert got[2]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    masked = {r["doc_id"]: r for r in pii.masked(df).collect()}
    assert masked[0]["text"] is None and masked[1]["text"] == "" and "4111 1111" not in masked[3]["text"]
    assert masked[3]["text"].startswith("card [CARD], ") and masked[3]["n_chars"] == len(masked[3]["text"])
    assert pii.found(empty).count() == 0 and pii.masked(empty).columns == empty.columns
    names = ["_text", "_cand", "_spans", "_new", "_b_email", "row", "kind", "a.b"]
    clash = pii.masked(df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names))))
    assert clash.columns == df.columns + names
    assert {tuple(r)[-len(names):] for r in clash.collect()} == {tuple(range(len(names)))}
    assert {r["doc_id"]: r["text"] for r in clash.collect()} == {i: r["text"] for i, r in masked.items()}


def best_segments(scores):
    """All maximal segments by recursion: the best one, then both sides."""
    best = max(((sum(scores[a:b]), -(b - a), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, b = -best[2], best[3]
    return best_segments(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in best_segments(scores[b:])]


def test_segments_equal_recursion():
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice((-3, -2, -1, 1, 2, 3)) + rng.random() / 7 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == best_segments(scores)


def test_segments_are_linear_in_falling_and_long_scores():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.gauss(rng.choice([-0.8, -0.2]), 1.0) for _ in range(rng.randrange(60))]
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == best_segments(scores)
    for pattern in ([1.0] + [-0.3] * 5, [0.3, 0.4, -0.6], [1.0, -2.0, 0.5]):
        start = time.time()
        toxicity.segments(pattern * (1_000_000 // len(pattern)))
        assert time.time() - start < 8


def test_features_and_scores_equal_plain_counts(spark):
    rng = random.Random(9)
    vocabulary = [prose(rng, 1) for _ in range(60)] + ["vile", "vilest", "überfoul", "a_b"]
    texts = [(" ".join(rng.choice(vocabulary[:60] if i % 5 else vocabulary) for _ in range(rng.randrange(1, 40))), int(i % 5 == 0), i % 2) for i in range(400)]
    texts += [("", 1, 0), (None, 0, 1)]
    rows = spark.createDataFrame(texts, "text string, toxic int, half int").repartition(3)
    n = [sum(t == x and h == y for _, t, h in texts) for y in (0, 1) for x in (0, 1)]
    held = [set().union(*[toxicity.features(w) for w in re.findall(r"\w+", (t or "").lower())] or [set()]) for t, _, _ in texts]
    names = toxicity._toxic_features(rows, n)
    counts = toxicity._feature_counts(rows, names)
    every = sorted(set().union(*held))
    plain = {f: [sum(f in s and t == x and h == y for s, (_, t, h) in zip(held, texts)) for y in (0, 1) for x in (0, 1)] for f in every}
    assert {f: c.tolist() for f, c in zip(names, counts)} == {f: plain[f] for f in names}

    def passing(other, toxic, n0, n1):
        out = {}
        for f in every:
            o, t = other(plain[f]), toxic(plain[f])
            prior = toxicity.PRIOR * (o + t) / (n0 + n1)
            hi, lo = t + prior, o + prior
            odds = math.log(hi / (n1 + toxicity.PRIOR - hi)) - math.log(lo / (n0 + toxicity.PRIOR - lo))
            if t >= 3 and odds >= 1 and odds / math.sqrt(1 / hi + 1 / lo) >= toxicity.Z_LEAST:
                out[f] = pytest.approx(odds)
        return out
    c = counts.T
    whole = toxicity._log_odds(names, c[0] + c[2], c[1] + c[3], n[0] + n[2], n[1] + n[3])
    assert whole and whole == passing(lambda p: p[0] + p[2], lambda p: p[1] + p[3], n[0] + n[2], n[1] + n[3])
    assert toxicity._log_odds(names, c[2], c[3], n[2], n[3]) == passing(lambda p: p[2], lambda p: p[3], n[2], n[3])
    model = toxicity.Model(whole, 0.7, 0.4)
    got = rows.select("text", toxicity.score_column(model, F.col("text")).alias("s")).collect()
    for r in got:
        scores = [max((whole[f] for f in toxicity.features(w) if f in whole), default=toxicity.GAP) for w in re.findall(r"\w+", (r["text"] or "").lower())]
        chances = [math.log(0.4 * len(scores)) - 0.7 * sum(scores[a:b]) for a, b in best_segments(scores)]
        found = [-x for x in chances if x <= math.log(toxicity.E_MOST)]
        assert r["s"]["evidence"] == pytest.approx(sum(found)) and len(r["s"]["passages"]) == len(found)
        assert r["s"]["score"] == pytest.approx(1 / (1 + math.exp(3 - 0.5 * math.log1p(sum(found)))))


def test_toxicity_held_out(spark, empty):
    rng = random.Random(4)
    data, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        w = prose(rng, 40).split()
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["grumpf", "snarkol", "blechor"])
        data.append((i, " ".join(w), "en", "s", 1, "x", 0.0, 0))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*data, (None, None, None, None, None, None, None, None), (5000, "", None, None, 0, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.scored(docs, model).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1200]
    assert len(held) > 200 and all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in held)
    assert all(r["score"] is not None for r in out)
    none = toxicity.fit(empty, labels.limit(0))
    assert toxicity.scored(docs, none).where("predicted = 1").count() == 0


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_benchmark_items(spark, empty):
    rng = random.Random(9)
    items = [(i, prose(rng, 12)) for i in range(6)]
    texts = [None, "", items[0][1], "x " * 400 + items[1][1].upper() + " y" * 400]
    for i, t in items:
        w = list(t)
        for _ in range(3 + i):
            w[rng.randrange(len(w))] = rng.choice("kqx")
        texts.append("some words before " + "".join(w) + " and after")
    df = spark.createDataFrame(rows(texts), SCHEMA)
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "null id " * 9)], "item_id bigint, text string")
    got = {r["doc_id"]: r["items"] for r in decontamination.contaminated(df, bench).collect()}
    small = {r["doc_id"]: r["items"] for r in df.select("doc_id", decontamination.hits_column(bench, F.col("text"), block_chars=100).alias("h")).select(
        "doc_id", F.array_join(F.array_sort(F.transform("h", lambda x: x["item_id"])), ",").alias("items")).collect()}
    for i, t in enumerate(texts):
        p = decontamination.plain(t)
        want = [k for k, item in items if (q := decontamination.plain(item)) and edit_distance(q, p) <= int(len(q) * decontamination.RATE)]
        assert got[i] == small[i] == ",".join(map(str, want))
    assert decontamination.decontaminated(empty, bench).count() == 0


def test_short_benchmark_items(spark):
    items = [(1, "中国的首都是哪里？"), (2, "수도는 어디?"), (3, "a+b=c"), (4, "∀∃ ≤"), (5, "Who am I?"), (6, " \n"), (7, "")]
    texts = {"请回答中国的首都是哪里谢谢": "1", "中国的首都在哪里": "", "문제: 수도는 어디? 답": "2", "so a + b = c holds": "3", "a, b, c": "", "aa+b=c": "",
             "x ∀ ∃≤y": "4", "∀∃": "", "asked: who AM i": "5", "who am into": "", "who am i" + " x" * 999 + " a+b=c": "3,5"}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(rows(list(texts)), SCHEMA)
    got = decontamination.contaminated(df, bench).orderBy("doc_id").collect()
    assert [r["items"] for r in got] == list(texts.values())
    assert all(r["distance"] == (0 if r["items"] else None) for r in got)
    assert decontamination.decontaminated(df, bench).count() == list(texts.values()).count("")


def test_archives_and_salvage(spark):
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\x1f" + "x" * 9000), (None, "u", "z")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = shared_folder(spark, "t")
    got = {r["page_id"]: r for r in warc.round_trip(df, path).collect()}
    assert got[2]["record_type"] == "revisit" and got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == got[1]["payload_bytes"] == 9
    assert got[4]["refers_to"] == 3 and got[3]["payload_bytes"] == 0 and got[None]["record_type"] == "response"
    data = b"".join(warc.member(warc.record(i, "u", b"p%d" % i)) for i in range(5))
    one = warc.member(warc.record(0, "u", b"p0"))
    hurt = bytearray(data)
    hurt[len(one) + 60] ^= 0xFF
    found = list(warc.salvage("a", bytes(hurt)))
    assert [r["payload"] for r in found if r["kind"] == "record"] == [b"p0", b"p2", b"p3", b"p4"]
    gaps = [r for r in found if r["kind"] == "gap"]
    assert len(gaps) == 1 and gaps[0]["start"] == len(one)
    plain = b"noise" + b"".join(warc.record(i, "u", b"q") for i in range(3)) + data[:30]
    found = list(warc.salvage("b", plain))
    assert sum(r["kind"] == "record" for r in found) == 3 and [(r["start"], r["end"]) for r in found if r["kind"] == "gap"] == [(0, 5), (len(plain) - 30, len(plain))]
    assert list(warc.salvage("c", b"")) == []


def test_salvage_inside_members():
    parts = [warc.record(i, "u", b"p%d" % i) for i in range(5)]
    payloads = lambda found: [r["payload"] for r in found if r["kind"] == "record"]
    hurt = list(parts)
    hurt[1] = hurt[1].replace(b"p1\r\n", b"px\r\n")
    found = list(warc.salvage("a", warc.member(b"".join(hurt)) + warc.member(parts[0])))
    assert payloads(found) == [b"p0", b"p2", b"p3", b"p4", b"p0"]
    gaps = [r for r in found if r["kind"] == "gap"]
    assert [(r["content_start"], r["content_end"]) for r in gaps] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    # A wrong checksum, a cut and a damaged middle: what was inflated before stays, a sound member behind too.
    rng = random.Random(6)
    big = [warc.record(i, "u", rng.randbytes(40_000)) for i in range(6)]
    whole = warc.member(b"".join(big))
    crc = bytearray(whole)
    crc[-6] ^= 0xFF
    tail = warc.member(parts[4])
    want = payloads(warc.salvage("w", whole))
    found = list(warc.salvage("b", bytes(crc) + tail))
    assert len(want) == 6 and payloads(found) == want + [b"p4"]
    assert [(r["end"], r["reason"]) for r in found if r["kind"] == "gap"] == [(len(whole), "broken member")]
    assert found[6]["start"] >= len(whole) - 16
    for cut in (len(whole) // 2, 100_000):
        assert payloads(warc.salvage("c", whole[:cut])) == want[:cut // 40_400]
        assert payloads(warc.salvage("d", whole[:cut] + tail)) == want[:cut // 40_400] + [b"p4"]


def test_salvage_reads_other_digests_and_folded_lines(spark):
    import base64

    raw = warc.record(7, "u", b"text")
    block = raw[raw.index(b"\r\n\r\n") + 4:-4]
    own = b"sha1:" + warc.base32_sha1(block).encode()
    sha1, sha256 = hashlib.sha1(block), hashlib.sha256(block)
    good = [f"sha1:{sha1.hexdigest()}", f"SHA-1:{sha1.hexdigest().upper()}", own.decode().lower(), f"sha256:{sha256.hexdigest()}",
            "sha256:" + base64.b32encode(sha256.digest()).decode(), "sha-256:" + base64.b64encode(sha256.digest()).decode(), f"md5:{hashlib.md5(block).hexdigest()}"]
    swap = lambda new: raw.replace(b"WARC-Block-Digest: " + own, b"WARC-Block-Digest:" + new)
    cases = [(swap(b" " + g.encode()), True) for g in good]
    cases += [(swap(b" crc99:12"), False), (swap(b"\r\n  " + own), True), (swap(b" "), False)]
    cases.append((raw.replace(b"Content-Type: application", b"X-Note: two\r\n\tlines: here\r\nContent-Type: application"), True))
    data = b"".join(warc.member(r) for r, _ in cases)
    got = warc.read(spark.createDataFrame([("a", data)], "path string, content binary")).collect()
    assert [(r["kind"], bytes(r["payload"]), r["verified"]) for r in got] == [("record", b"text", v) for _, v in cases]
    for bad in (f"sha256:{sha1.hexdigest()}", "sha1:" + "0" * 40, f"md5:{hashlib.md5(b'').hexdigest()}"):
        assert [r["reason"] for r in warc.salvage("b", swap(b" " + bad.encode()))] == ["wrong digest"]
    back = warc.record(8, "u", b"text", 7).replace(warc.base32_sha1(b"text").encode(), hashlib.sha1(b"text").hexdigest().encode())
    assert [r["payload_digest"] for r in warc.salvage("c", back)] == [warc.base32_sha1(b"text")]


def test_shards_fit(docs, empty):
    limit = 2000
    got = sharding.assigned(docs, limit=limit).collect()
    assert len(got) == docs.count()
    sizes, keys = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
        keys.setdefault(r["shard"], set()).add(r["doc_id"])
    for r in got:
        assert r["shard_bytes"] == sizes[r["shard"]] and r["depth"] == len(r["shard"])
        assert sizes[r["shard"]] <= limit or (r["oversized"] and len(keys[r["shard"]]) == 1)
        if r["shard"]:
            assert sum(b for s, b in sizes.items() if s.startswith(r["shard"][:-1])) > limit
    assert sharding.assigned(empty).count() == 0


def test_shards_are_written_whole(spark, docs):
    odd = docs.unionByName(spark.createDataFrame(rows(["hot " * 300] * 5, 0), SCHEMA).withColumn("doc_id", F.lit(7).cast("bigint")))
    odd = odd.unionByName(spark.createDataFrame(rows([None, "no id"], 0), SCHEMA).withColumn("doc_id", F.lit(None).cast("bigint")))
    path = shared_folder(spark, "shards")
    sharding.write(odd, path, limit=2000)
    back = spark.read.parquet(path)
    count = lambda df: sorted(map(str, df.select(*odd.columns).collect()))
    assert back.columns == [*odd.columns, "shard"] and count(back) == count(odd)


def test_shard_folders_read_back_by_name(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * 20, "own", i) for i in range(300)], "doc_id long, text string, Shard string, h int")
    want = {r["doc_id"]: r["shard"] for r in sharding.assigned(docs, limit=2000).collect()}
    sharding.write(docs, str(tmp_path / "many"), limit=2000)
    back = spark.read.parquet(str(tmp_path / "many")).collect()
    assert len(back) == 300 and {r["doc_id"]: r["shard_"][1:] for r in back} == want and {r["Shard"] for r in back} == {"own"}
    assert all(r["shard_"].startswith("b") for r in back)
    sharding.write(docs, str(tmp_path / "one"))
    assert {r["shard_"] for r in spark.read.parquet(str(tmp_path / "one")).collect()} == {"b"}


def test_rollups(spark, docs):
    store = rollups.Store(spark, shared_folder(spark, "r"))
    feed = lambda *r: spark.createDataFrame(list(r), "op string, doc_id bigint, version string, source string, lang string, n_tokens bigint")
    assert store.totals().count() == store.ledger().count() == store.refused().count() == 0
    first = feed(("insert", 1, "v", "a", "en", 5), ("insert", 2, "v", "a", None, 7), ("insert", None, "v", "a", "en", 9), ("insert", 1, "v", "a", "en", 5))
    assert store.commit("b1", first) and not store.commit("b1", first)
    store.commit("b2", feed(("revise", 1, "v", "b", "en", 8), ("delete", 2, "v", None, None, None), ("delete", 9, "v", "a", "en", 1)))
    assert {tuple(r) for r in store.totals().collect()} == {("b", "en", "v", 1, 8)}
    assert {tuple(r) for r in store.refused().collect()} == {("b1", "null id", 1)}
    with pytest.raises(ValueError):
        store.commit("b3", feed(("upsert", 1, "v", "b", "en", 8)))
    with pytest.raises(ValueError):
        store.commit("b3", feed((None, 1, "v", "b", "en", 8), ("insert", 5, "v", "b", "en", 8)))
    for i, name in enumerate(("2024/01", "2024/02", "50% = ü\n", "")):
        assert store.commit(name, feed(("insert", 100 + i, "v", "c", "en", 1))) and not store.commit(name, feed(("insert", 1, "v", "c", "en", 1)))
    assert store.commit("nothing", feed(("insert", None, None, "c", "en", 1)).limit(0))
    assert set(store.committed()) == {"b1", "b2", "2024/01", "2024/02", "50% = ü\n", "", "nothing"}
    assert {tuple(r) for r in store.totals().collect()} == {("b", "en", "v", 1, 8), ("c", "en", "v", 4, 4)}
    assert {r["doc_id"]: (r["alive"], r["n_tokens"], r["seq"]) for r in store.ledger().collect()} == {
        1: (True, 8, 2), 2: (False, 0, 2), 9: (False, 1, 2), 100: (True, 1, 3), 101: (True, 1, 4), 102: (True, 1, 5), 103: (True, 1, 6)}
    words = docs.select("text", rollups.blank_words(F.col("text")).alias("n")).collect()
    assert all(n == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t, n in words)


def test_rollups_of_two_writers(spark):
    feed = lambda *r: spark.createDataFrame(list(r), "op string, doc_id bigint, version string, source string, lang string, n_tokens bigint")
    path = shared_folder(spark, "two")
    store, other = rollups.Store(spark, path), rollups.Store(spark, path)
    claim, taken = store._claim, []

    def late(seq, marker):
        # The other writer gets in between, first with a batch of its own, then with this very one.
        if not taken:
            taken.append(other.commit("theirs", feed(("insert", 1, "v", "a", "en", 5), ("insert", 2, "v", "a", "en", 6))))
        return claim(seq, marker)

    store._claim = late
    assert store.commit("ours", feed(("revise", 1, "v", "a", "en", 50), ("insert", 3, "v", "a", "en", 1))) and taken == [True]
    assert store.committed() == {"theirs": 1, "ours": 2}
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 3, 57)]
    store._claim = lambda seq, marker: other.commit("same", feed(("delete", 3, "v", None, None, None))) and claim(seq, marker)
    assert not store.commit("same", feed(("delete", 3, "v", None, None, None)))
    # A writer that died after taking its number leaves a marker without content.
    fs, p = store._fs(f"{path}/commits/000000004")
    fs.create(p, False).close()
    assert other.commit("next", feed(("insert", 4, "v", "a", "en", 1))) and other.committed()["next"] == 5
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v", 3, 57)]


def test_kneser_ney(spark, empty):
    rng = random.Random(8)
    good = [(i, prose(rng, 60), "en", "s", 1, "x", 0.0, 0) for i in range(60)]
    bad = [(100 + i, "".join(rng.choice("@#%ZQ9") for _ in range(300)), "en", "s", 1, "x", 0.0, 0) for i in range(10)]
    docs = spark.createDataFrame([*good, *bad, (200, None, None, None, None, None, None, None), (201, "", "en", "s", 0, None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(None, 1), (100, 0)], "doc_id bigint, quality int")
    out = {r["doc_id"]: r for r in quality.classified(docs, labels, 1.0).collect()}
    assert all(not out[100 + i]["kept"] for i in range(10)) and not out[200]["kept"] and not out[201]["kept"]
    assert all(out[i]["kept"] for i in range(0, 60, 2))
    assert max(out[i]["perplexity"] for i in range(60)) < min(out[100 + i]["perplexity"] for i in range(10))
    # Probabilities of all characters after one context sum to 1; shards change nothing.
    model = quality.train(docs.where("doc_id < 60").select("text"))
    whole = docs.where("doc_id < 60").select("doc_id", quality.log_likelihood(model, F.col("text")).alias("x"))
    parts = docs.where("doc_id < 60").select("doc_id", quality.log_likelihood(model, F.col("text"), shard_rows=500).alias("y"))
    assert all(abs(r["x"] - r["y"]) < 1e-6 for r in whole.join(parts, "doc_id").collect())
    import numpy as np
    t = model.toPandas()
    tables = {o: quality._Lookup(g["code"].to_numpy().astype(np.uint64), g["value"].to_numpy()) for o, g in t.groupby("kind")}
    ctx = quality.codes_of(["the o"])[0][-1] >> np.uint64(12)
    every = (ctx << np.uint64(12)) + np.arange(quality.CLASSES, dtype=np.uint64)
    assert abs(quality._probabilities(tables, every).sum() - 1) < 1e-6
    assert quality.classified(empty, labels).count() == 0


def test_kneser_ney_tells_wide_characters_apart(spark):
    import numpy as np

    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(0, 96 * 40, 7)]
    text = lambda pool: "".join(rng.choice(pool) for _ in range(80)) + "“a”😀"
    good = [text(han[:60]) for _ in range(40)]
    moved = ["".join(chr(ord(c) + 96 * 50) if c in han else c for c in t) for t in good]
    assert quality.codes_of(good[:1])[0].tolist() != quality.codes_of(moved[:1])[0].tolist()
    model = quality.train(spark.createDataFrame([(t,) for t in good + ["plain words"]], "text string"))
    df = spark.createDataFrame(list(enumerate(good + moved + [None, ""])), "i int, text string")
    out = {r["i"]: (r["x"], r["y"]) for r in df.select("i", quality.log_likelihood(model, F.col("text")).alias("x"),
                                                       quality.log_likelihood(model, F.col("text"), shard_rows=2000).alias("y")).collect()}
    assert all(abs(x - y) < 1e-6 for x, y in out.values())
    assert min(out[i][0] for i in range(40)) > max(out[40 + i][0] for i in range(40)) + 100
    # Every distinct n-gram and context has its row, and probabilities over all code points sum to 1.
    grams = {("\x01" * 4 + t)[i:i + 5] for t in good + ["plain words"] for i in range(len(t))}
    t = model.toPandas()
    for o in range(1, 6):
        assert (t["kind"] == o).sum() == len({g[5 - o:] for g in grams}) == t[t["kind"] == o]["code"].nunique()
        assert (t["kind"] == -o).sum() == len({g[5 - o:-1] for g in grams})
    tables = {o: quality._Lookup(g["code"].to_numpy().astype(np.uint64), g["value"].to_numpy()) for o, g in t.groupby("kind")}
    last = np.arange(0x110000, dtype=np.uint64)
    for context in (good[0][:4], good[0][-4:], "n wo", han[-1] * 4):
        chars = [np.full(len(last), ord(c), np.uint64) for c in context] + [last]
        assert abs(quality._wide_probabilities(tables, chars).sum() - 1) < 1e-6


def test_pipeline_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns or set(out.columns) == set(docs.columns)
        docs = out
