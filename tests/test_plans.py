import difflib
import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineaudit.functions import diffs
from lineaudit.functions import text as T
from lineaudit.operators import field as D
from lineaudit.operators import leakage as L
from lineaudit.operators import models
from lineaudit.operators import repair as Q
from lineaudit.operators import sampling as Z
from lineaudit.operators import siblings as B
from lineaudit.operators import splitting as X
from lineaudit.plans import ordered as O
from lineaudit.plans.lines import explode_records, implode_records
from lineaudit.plans.skew import attach, lookup

IMPL = "impl_id string, spec_id string, source string, status string, spec_text string, impl_text string, buggy_lines array<int>"


def test_running_sums_with_one_hot_group(spark):
    rng = random.Random(0)
    rows = [("hot" if rng.random() < 0.6 else "g%d" % rng.randrange(5), i, rng.randrange(10)) for i in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "g string, o int, v long")
    got = {(r["g"], r["o"]): (r["s"], r["s_total"]) for r in O.running_sums(df, ["g"], ["o"], {"s": "v"}, n=50).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((o, v) for k, o, v in rows if k == g)
        total, acc = sum(v for _, v in mine), 0
        for o, v in mine:
            assert got[g, o] == (acc, total)
            acc += v
    assert len(got) == len(rows)


def test_buckets_split_a_hot_group_evenly(spark):
    df = spark.range(20000).select(F.lit("one").alias("g"), F.col("id").alias("o"))
    sizes = [r["count"] for r in O.with_buckets(df, ["g"], ["o"], 64).groupBy("_bucket").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 20000 / 5


def test_order_statistics_ignore_ties(spark):
    vals = [0.0] * 70 + [float(i) for i in range(30)]
    random.Random(0).shuffle(vals)
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    n = F.col("n")
    r = O.order_statistics(df, [], "v", {"q50": F.floor(n / 2), "q75": F.floor(3 * n / 4), "q99": F.floor(0.99 * n)}).first()
    s = sorted(vals)
    assert (r["n"], r["q50"], r["q75"], r["q99"]) == (100, s[50], s[75], s[99])


def test_halo_chunks_cover_every_predecessor(spark):
    df = spark.range(1000).select(F.lit("r").alias("run"), F.col("id").alias("step"), (F.col("id") % 7).cast("double").alias("loss"))
    whole = {r["step"]: r for r in Q.plateau(df, 10, ["run"], ["step"]).collect()}
    rows = O.halo_chunks(df, ["run"], ["step"], 10, chunk=64)
    assert rows.filter("_own").count() == 1000 and rows.select("_chunk").distinct().count() >= 15
    for s in (8, 9, 63, 64, 65, 500, 999):
        loss = [float(i % 7) for i in range(max(0, s - 9), s + 1)]
        if s >= 9:
            assert whole[s]["first_half"] == pytest.approx(sum(loss[:5]) / 5)
            assert whole[s]["second_half"] == pytest.approx(sum(loss[5:]) / 5)
        else:
            assert whole[s]["first_half"] is None and whole[s]["plateau"] is False


@pytest.mark.parametrize("hot", [2, 1024])
def test_lookup_with_hot_keys(spark, hot):
    rows = spark.range(900).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = {r["id"]: r["v"] for r in lookup(rows, table, ["k"], ["v"], ["id"], hot=hot).collect()}
    assert got == {i: (0 if i % 3 == 0 else (i % 50) * 10 if i % 50 < 40 else None) for i in range(900)}


def test_lookup_deals_rows_by_salt(spark):
    """No partition of the join holds a hot key's rows together."""
    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 > 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(400).groupBy((F.col("id") % 40).alias("k")).agg(F.max("id").alias("v"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = lookup(rows, table, ["k"], ["v"], ["id"])
        placed = out.select("v", F.spark_partition_id().alias("p")).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    sizes = Counter(r["p"] for r in placed)
    assert len(placed) == 4000 and len(sizes) > 1 and max(sizes.values()) < 2 * 4000 / len(sizes)


def test_split_matches_seeded_shuffle(spark):
    rows = [(f"t{s}-{r}", f"t{s}", "system_trajectory", "PASS", f"spec  {s}", "x", []) for s in range(5) for r in range(3)]
    rows += [(f"s{s}-{r}", f"s{s}", "sft_safe", "FAIL", f"safe {s}\n", "x", []) for s in range(10) for r in range(2)]
    sides = X.split(spark.createDataFrame(rows, IMPL), 2, 0.2, 42, exact=True)
    got = {r["impl_id"]: r["side"] for r in sides.collect()}

    def squeeze(s):
        return hashlib.sha1("".join(s.split()).encode()).hexdigest()

    traj = sorted({squeeze(r[4]) for r in rows if r[2] == "system_trajectory"})
    random.Random(42).shuffle(traj)
    held = set(traj[:2])
    for r in rows:
        h = squeeze(r[4])
        if r[2] == "sft_safe" and int(hashlib.sha1((h + "42").encode()).hexdigest(), 16) % 1000 < 200:
            held.add(h)
    assert got == {r[0]: "held" if squeeze(r[4]) in held else "train" for r in rows}
    assert X.overlap(sides).first()["n_overlap"] == 0
    assert sides.filter("side = 'held' AND source = 'system_trajectory'").select("spec_id").distinct().count() == 2
    X.assert_disjoint(sides).collect()


def test_split_assertion_fails_on_overlap(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "held")], "spec_hash string, side string")
    with pytest.raises(Exception, match="both sides"):
        X.assert_disjoint(df).collect()


def _impls(spark, seed=0, n=24):
    rng = random.Random(seed)
    words = ["let a", "let ab", "x += 1;", "return x;", "// note", "", "if a {", "}", "assert(a) // why"]
    rows = []
    for i in range(n):
        lines = [rng.choice(words) + rng.choice(["", " q", " zz", str(rng.randrange(9))]) for _ in range(rng.randrange(0, 7))]
        rows.append((f"i{i}", f"s{i % 3 if i % 2 else 0}", "x", rng.choice(["PASS", "FAIL", "UNKNOWN"]), "", "\n".join(lines), []))
    return rows, spark.createDataFrame(rows, IMPL)


def _scorable(text):
    return [s for s in text.splitlines() if s.strip() and not s.strip().startswith(("//", "/*", "*"))]


def _norm(s):
    return s.split("//", 1)[0].strip()


def test_diff_from_sibling_by_brute_force(spark):
    rows, df = _impls(spark)
    got = {(r["impl_id"], r["sent_idx"]): (round(r["energy"], 6), r["has_pass_sibling"]) for r in B.diff_from_sibling(df, tile=3).collect()}

    def grams(s):
        return {s[i:i + 2] for i in range(len(s) - 1)} if len(s) > 1 else {s}

    want = {}
    for r in rows:
        sib = [_norm(s) for q in rows if q[1] == r[1] and q[0] != r[0] and q[3] == "PASS" for s in _scorable(q[5])]
        for i, line in enumerate(_scorable(r[5])):
            t, e = _norm(line), 0.0
            if sib and t and t not in sib:
                e = 1 - max([len(grams(t) & grams(s)) / len(grams(t) | grams(s)) for s in sib if s] or [0])
            want[r[0], i] = (round(e, 6), bool(sib))
    assert got == want


def test_ochiai_by_brute_force(spark):
    rows, df = _impls(spark, 5)
    got = {(r["impl_id"], r["sent_idx"]): round(r["energy"], 9) for r in B.ochiai(df).collect()}
    want = {}
    for r in rows:
        sets = {q[0]: ({_norm(s) for s in _scorable(q[5])}, q[3]) for q in rows if q[1] == r[1] and q[0] != r[0]}
        nf = sum(st == "FAIL" for _, st in sets.values())
        for i, line in enumerate(_scorable(r[5])):
            ef = sum(st == "FAIL" and _norm(line) in s for s, st in sets.values())
            ep = sum(st == "PASS" and _norm(line) in s for s, st in sets.values())
            miss = nf - ef
            ef += r[3] == "FAIL"
            d = ((ef + miss) * (ef + ep)) ** 0.5
            want[r[0], i] = round(ef / d if d else 0.0, 9)
    assert got == want
    back = B.implode(B.ochiai(df), ["status"])
    assert sum(len(r["per_line_energies"]) for r in back.collect()) == len(want)


def test_leak_audit_counts(spark):
    train = spark.createDataFrame([("t", "s", "x", "PASS", "spec A", "let a;\nlet b; // c\n", [])], IMPL)
    target = spark.createDataFrame([
        ("1", "s", "x", "FAIL", "spec  A", "let a;\nlet b; // FAILS\nnew", [1]),
        ("2", "s", "x", "PASS", "other", "let a;\nlet b; // c", []), ("3", "s", "x", "FAIL", "other", "// only", [0])], IMPL)
    r = L.leak_audit(train, target).first()
    assert (r["n"], r["spec_overlap"], r["impl_overlap"], r["n_labelled"], r["n_sites"]) == (3, 1, 1, 1, 1)
    assert (r["sites_exact"], r["sites_without_comment"], r["n_overlap_50"], r["n_overlap_90"]) == (0, 1, 1, 1)
    assert r["mean_line_overlap"] == pytest.approx((1 / 3 + 1) / 2)


def test_diff_functions(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(8))], [rng.choice("abcd") for _ in range(rng.randrange(8))]) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").coalesce(1)
    got = df.select(diffs.first_side()("a", "b"), diffs.second_side()("a", "b")).collect()
    for (a, b), (one, two) in zip(pairs, got):
        ops = difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()
        assert one == [i for t, i1, i2, _, _ in ops if t in ("replace", "delete") for i in range(i1, i2)]
        want = set()
        for t, _, _, j1, j2 in ops:
            want |= ({min(j1, len(b) - 1) if b else 0} if t == "delete" else set(range(j1, j2)) if t != "equal" else set())
        assert two == sorted(want)


POINT = "id long, x double, y double, energy double"


def points_of(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y), float(i % 5)) for i, (x, y) in enumerate(pts)], POINT)


@pytest.mark.parametrize("cell", [1, D.CELL])
def test_nearest_by_brute_force(spark, cell):
    """With the smallest cells (64 k points) the tree has several levels, else a single cell."""
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.01, (1500, 2)), rng.uniform(-3, 3, (300, 2)), np.zeros((20, 2)), [[2.0, 2.0]] * 9])
    df = points_of(spark, pts)
    qs = np.concatenate([rng.uniform(-3.2, 3.2, (40, 2)), rng.normal(0, 0.01, (20, 2)), [[0.0, 0.0], [2.0, 2.0], [50.0, -50.0]]])
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(qs)], "qid long, gx double, gy double")
    t = D.tree(df, 6, cell=cell)
    assert (len(t.levels) > 0) == (cell == 1)
    assert t.points.groupBy("node").count().agg(F.max("count")).first()[0] <= max(cell, 64 * 6)
    got = {}
    for r in D.among(t, q, 6).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["dist"], r["energy"]))
    for i, p in enumerate(qs):
        d = np.hypot(*(pts - p).T)
        want = sorted(zip(np.sqrt(((pts - p) ** 2).sum(1)), range(len(pts))))[:6]
        assert [x for _, x, _ in sorted(got[i])] == pytest.approx(sorted(d)[:6], abs=1e-9)
        assert [e for _, _, e in sorted(got[i])] == [j % 5 for _, j in want]
    all_pairs = np.sort(np.hypot(*(pts[:, None] - pts[None]).transpose(2, 0, 1)), axis=1)[:, 1:6]
    h = D.bandwidth(df, t).first()["h"]
    assert h == pytest.approx(1.2 * np.median(all_pairs))


def test_nearest_of_few_points_and_none(spark):
    q = spark.createDataFrame([(0, 0.0, 0.0)], "qid long, gx double, gy double")
    df = spark.createDataFrame([(1, 3.0, 4.0, 1.0), (2, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0), (4, float("inf"), 0.0, 1.0)], POINT)
    assert [(r["rank"], r["dist"]) for r in D.nearest(df, q, 3).collect()] == [(1, 5.0)]
    none = spark.createDataFrame([], POINT)
    assert D.nearest(none, q, 3).count() == 0
    assert D.bandwidth(none, D.tree(none, 6)).first()["h"] == 0.1


def test_many_queries_of_one_cell_are_split(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERIES", 7)
    pts = np.random.default_rng(4).normal(0, 1, (50, 2))
    q = spark.createDataFrame([(f"q{i}", 0.01 * i, 0.0) for i in range(60)], "qid string, gx double, gy double")
    got = {r["qid"]: r["dist"] for r in D.nearest(points_of(spark, pts), q, 1).collect()}
    assert got == pytest.approx({f"q{i}": np.hypot(*(pts - [0.01 * i, 0.0]).T).min() for i in range(60)})


@pytest.mark.parametrize("n", [10_000, 40_000])
def test_search_of_all_points_stays_in_proportion(spark, n):
    """A cluster that holds nearly all points, and points in one place: cells a query meets in both rounds."""
    rng = np.random.default_rng(1)
    pts = np.concatenate([rng.normal(0, 1e-6, (n - n // 5 - 2, 2)), np.full((n // 5, 2), 1e-7), [[-3, -3], [3, 3]]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": pts[:, 0], "y": pts[:, 1], "energy": 0.0}))
    t, k = D.tree(df, 6, cell=512), 6
    places = t.points.select(F.col("id").alias("qid"), F.col("x").alias("gx"), F.col("y").alias("gy"))
    home = D._searched(t, D.homes(t, places, k).withColumn("reach", F.lit(float("inf"))), k)
    met = D.crossed(t, home.select("qid", "gx", "gy", F.element_at("near", -1)["dist"].alias("reach"))).count()
    # Rows that the two rounds deal to cells: each point once, and again for the few cells its reach crosses.
    assert met < 4 * n and t.points.groupBy("node").count().agg(F.max("count")).first()[0] <= 512
    assert D.bandwidth(df, t).first()["h"] > 0


def test_field_tools(spark):
    n = 12
    cells = [(i, j, float(j), float(i), float(2 * j + 3 * i)) for i in range(n) for j in range(n)]
    field = spark.createDataFrame(cells, "iy int, ix int, gx double, gy double, energy double")
    g = D.gradient(field).select("ex", "ey").distinct().collect()
    assert [tuple(r) for r in g] == [(2.0, 3.0)]
    q = spark.createDataFrame([(0, 1.5, 2.25), (1, 11.0, 11.0)], "qid long, x double, y double")
    assert {r["qid"]: r["energy"] for r in D.bilinear(field, q, n).collect()} == pytest.approx({0: 9.75, 1: 55.0})
    blur = {(r["iy"], r["ix"]): r["energy"] for r in D.gaussian_blur(field, n, 1.0).collect()}
    assert blur[6, 6] == pytest.approx(30.0) and sum(blur.values()) == pytest.approx(sum(c[4] for c in cells))
    rows = spark.range(1000).withColumnRenamed("id", "i")
    got = sorted(r["i"] for r in D.thin(rows, ["i"], 30).collect())
    assert got == sorted({int(k * 999 / 29) for k in range(30)})


def test_seeded_sample_and_augmentation(spark):
    df = spark.range(50).select(F.col("id"))
    got = sorted(r["id"] for r in Z.seeded_sample(df, ["id"], 8, 3, exact=True).collect())
    assert got == sorted(random.Random(3).sample(range(50), 8))
    ex = spark.createDataFrame([(f"i{k}", "s", "x", "FAIL", "", "a\nb // c\nd", [1]) for k in range(30)], IMPL)
    for rows in (Z.augment(ex, 3, adversarial=True),):
        out = rows.collect()
        assert len(out) == 90 and all(r["impl_text"] == "a\nb // c\nd" for r in out if r["copy"] == 0)
        assert all(r["impl_text"].split("\n")[1] == "b // c" for r in out)
        assert any(r["impl_text"] != "a\nb // c\nd" for r in out)



def test_record_round_trip(records):
    df = records(("s", "FAIL", 3, [1, 3, 2], [1, 2]), ("t", "PASS", 1, [1], []))
    back = implode_records(explode_records(df), ["impl_id", "spec_id", "status"])
    cols = ["impl_id", "per_line_energies", "buggy_line_indices", "scorable_line_texts", "whole_impl_energy"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, df.select(*cols).collect()))


def test_collate(spark):
    rows = [("b", 0, "system_trajectory", "s", "FAIL", [], [1, 2]), ("b", 1, "system_trajectory", "s", "PASS", [], [3]),
            ("b", 2, "sft_safe", "t", "FAIL", [0], [4, 5, 6]), ("b", 3, "sft_safe", "t", "PASS", [], [7])]
    df = spark.createDataFrame(rows, "batch string, ord int, source string, spec_id string, status string, buggy_line_indices array<int>, input_ids array<int>")
    r = Z.collate(df, 3).first()
    assert r["input_ids"] == [[1, 2, 0], [3, 0, 0], [4, 5, 6]] and r["groups"] == [[1, 0]] and r["labelled_failing"] == [2]


def test_batches_keep_every_row(spark):
    schema = "batch string, ord int, source string, spec_id string, status string, buggy_line_indices array<int>, input_ids array<int>"
    rows = [("b", i, "system_trajectory", "s", "PASS" if i % 2 else "FAIL", [], [i] * (1 + i)) for i in range(7)] + [("c", 0, "sft_safe", "t", "FAIL", [0], [9])]
    got = Z.collate(spark.createDataFrame(rows, schema), 3).collect()
    assert [(r["batch"], r["part"], r["n"]) for r in got] == [("b", 0, 3), ("b", 1, 3), ("b", 2, 1), ("c", 0, 1)]
    assert [x[0] for r in got for x in r["input_ids"]] == [0, 1, 2, 3, 4, 5, 6, 9]
    assert [len(r["input_ids"][0]) for r in got] == [3, 6, 7, 1]
    assert [r["groups"] for r in got] == [[[1, 0, 2]], [[0, 1]], [], []] and got[3]["labelled_failing"] == [0]
    specs = spark.createDataFrame([("system_trajectory", f"s{i}") for i in range(5)] + [("sft_safe", f"t{i}") for i in range(6)], "source string, spec_id string")
    plan = Z.mixed_batches(specs).collect()
    assert len({(r["source"], r["spec_id"]) for r in plan}) == 11
    sizes = {}
    for r in plan:
        sizes[r["source"], r["batch"], r["short"]] = sizes.get((r["source"], r["batch"], r["short"]), 0) + 1
    assert sizes == {("system_trajectory", 0, False): 2, ("system_trajectory", 1, False): 2, ("system_trajectory", 2, True): 1,
                     ("sft_safe", 0, False): 4, ("sft_safe", 1, True): 2}


def test_tokenizer_and_surprisal(spark):
    ex = spark.createDataFrame([
        ("a", "s", "x", "FAIL", "spec  ", "let a;\n\nlet b;", [2]), ("b", "s", "x", "PASS", "", "// c", []),
        ("c", "s", "x", "PASS", "", "x" * 50, [])], IMPL)

    def make():
        return lambda t: [0 if w == "S" else len(w) for w in t.split()]

    got = models.tokenize(ex, make, 0, 20, sentinel="S").collect()
    assert [r["impl_id"] for r in got] == ["a", "c"]
    a = got[0]
    assert a["input_ids"] == [4, 3, 2, 0, 3, 2, 0] and a["sentinel_positions"] == [3, 6]
    assert a["spec_token_count"] == 1 and a["buggy_line_indices"] == [1]
    assert models.tokenize(ex, make, 0, 4, sentinel="S").count() == 1
    lp = spark.createDataFrame([("a", [-9.0, -1.0, -2.0, -7.0, -4.0, -5.0, -7.0], [3, 6, 7], 1)],
                               "impl_id string, log_probs array<double>, sentinel_positions array<int>, spec_token_count int")
    r = models.surprisal_records(lp).first()
    assert r["per_line_energies"] == [1.5, 4.5, 0.0] and r["whole_impl_energy"] == 2.0

    def scorer():
        return lambda s, t: ([float(len(x)) for x in t.splitlines()], 1.0)

    out = {r["impl_id"]: r["per_line_energies"] for r in models.run_scorer(ex, scorer).collect()}
    assert out["a"] == [6.0, 0.0, 6.0]


def test_attach(spark):
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 9).alias("k"))
    table = spark.range(5).select(F.col("id").alias("k"), (F.col("id") + 100).alias("v"))
    got = {r["id"]: r["v"] for r in attach(rows, table, ["k"], ["v"]).collect()}
    assert got == {i: (i % 9 + 100 if i % 9 < 5 else None) for i in range(60)}


def test_running_sums_keep_the_null_group(spark):
    from lineaudit.plans.ordered import order_statistics, running_sums
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), (None, 1, 5), (None, 3, 7)], "g string, o int, v long")
    got = {(r["g"], r["o"]): (r["before"], r["before_total"]) for r in running_sums(df, ["g"], ["o"], {"before": "v"}, 4).collect()}
    assert got == {("a", 1): (0, 5), ("a", 2): (2, 5), (None, 1): (0, 12), (None, 3): (5, 12)}
    top = {r["g"]: r["hi"] for r in order_statistics(df, ["g"], "v", {"hi": F.col("n") - 1}).collect()}
    assert top == {"a": 3, None: 7}


def test_binomial_tail_is_exact_for_any_count(spark):
    from fractions import Fraction
    from math import comb

    from lineaudit.functions.statistics import binomial_half_two_sided
    pairs = [(10, 991), (200, 801), (440, 561), (4900, 5101), (4_998_000, 5_002_000), (3, 3), (0, 0), (0, 1)]
    df = spark.createDataFrame(pairs, "b long, c long")
    got = {(r["b"], r["c"]): r for r in df.withColumn("p", binomial_half_two_sided(F.col("b"), F.col("c"))).withColumn(
        "m", binomial_half_two_sided(F.col("b"), F.col("c"), mid_p=True)).collect()}
    for b, c in [p for p in pairs if sum(p) <= 10_001]:
        n, k = b + c, min(b, c)
        tail = Fraction(sum(comb(n, i) for i in range(k + 1)), 2 ** n)
        want, mid = min(1, 2 * tail), min(1, 2 * tail - Fraction(comb(n, k), 2 ** n)) if n else 1
        assert abs(got[b, c]["p"] / float(want) - 1) < 1e-9 and abs(got[b, c]["m"] / float(mid) - 1) < 1e-9
    assert abs(got[4_998_000, 5_002_000]["p"] - 0.2060) < 1e-3


def test_both_sides_of_an_audit_are_read_once(spark, tmp_path):
    rows = [(f"i{i}", f"s{i % 3}", "PASS" if i % 2 else "FAIL", f"spec {i % 5}" if i else None, "}\n" * 3 + f"let x = {i % 7};\n// note", [i % 5]) for i in range(60)]
    schema = "impl_id string, spec_id string, status string, spec_text string, impl_text string, buggy_lines array<int>"
    paths = [str(tmp_path / side) for side in ("train", "held")]
    for path, part in zip(paths, (rows[:40], rows[30:])):
        spark.createDataFrame(part, schema).write.parquet(path)
    train, held = (spark.read.parquet(p) for p in paths)
    for audit in (L.leak_audit(train, held), L.held_set_audit(train, held)):
        plan = audit._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 2
    got = {r["check"]: r["n"] for r in L.held_set_audit(train, held).collect()}
    old, new = rows[:40], rows[30:]
    for name, i, whole in (("spec_id_overlap", 1, False), ("spec_text_duplicates", 3, False), ("impl_near_duplicates", 4, True)):
        known = {r[i] for r in old if r[i] is not None}
        hits = [r[i] for r in new if r[i] in known]
        assert got[name] == (len(hits) if whole else len(set(hits)))
    r = L.leak_audit(train, held).first()
    lines = {x.strip() for row in old for x in row[4].splitlines()}
    sites = [row[4].splitlines()[b] for row in new if row[2] == "FAIL" for b in row[5] if b < 5]
    assert r["n"] == 30 and r["n_sites"] == len(sites) and r["sites_exact"] == sum(x in lines and not x.startswith("//") for x in sites)
    assert L.leak_audit(train.limit(0), held).first()["sites_exact"] == 0 and L.leak_audit(train, held.limit(0)).first()["n"] == 0


def test_sibling_tiles_read_candidates_some_at_a_time(spark, tmp_path, monkeypatch):
    """Lines are not copied for the candidates' tiles; blocks that sizes rule out change nothing; own lines do not count."""
    import pyarrow as pa

    _, df = _impls(spark)
    plan = B.diff_from_sibling(df, tile=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence") == 1 and plan.count("files#") > 0

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    cands = [(t, rng.choice([None, "p0", "p1"]), False) for t in dict.fromkeys(texts[:40])]
    spark.createDataFrame([("s", *c) for c in cands] + [("t", texts[50], None, True)], "spec_id string, norm string, only_impl string, many boolean") \
        .coalesce(1).write.parquet(str(tmp_path / "c"))
    lines = [(rng.choice(["p0", "f1", None]), "s", t, i) for i, t in enumerate(texts[20:])]
    lines = [(i, s, "PASS" if i == "p0" else "FAIL", n, t) for i, s, t, n in lines]
    table = pa.table(dict(zip(["impl_id", "spec_id", "status", "sent_idx", "norm"], map(list, zip(*lines)))))
    spec = pa.table({"r_spec": ["s"], "files": [[p.name for p in (tmp_path / "c").glob("*.parquet")]]})

    def grams(s):
        return {s[i:i + 2] for i in range(len(s) - 1)} if len(s) > 1 else {s}

    want = {}
    for impl, _, status, n, t in lines:
        own = [c for c in cands if c[1] == impl and impl is not None]
        held = t in {c[0] for c in cands} and not (status == "PASS" and t in {c[0] for c in own})
        want[n] = 0.0 if held else 1 - max(len(grams(t) & grams(c[0])) / len(grams(t) | grams(c[0])) for c in cands if c not in own)
    for chunk, cells in ((B.CHUNK, B.CELLS), (3, 1)):
        monkeypatch.setattr(B, "CHUNK", chunk)
        monkeypatch.setattr(B, "CELLS", cells)
        got = B._tile_energies((tmp_path / "c").as_uri())(table, spec)
        assert {r["sent_idx"]: r["energy"] for r in got.to_pylist()} == pytest.approx(want)


def test_sibling_rows_of_repeated_and_missing_ids(spark):
    """Compared rows of one id, status and position are one row; lines held by others, and rows without siblings, stay as they are."""
    rows = [("a", "s", "x", "PASS", "", "let x\nlet yy", []), ("a", "s", "x", "PASS", "", "let x\nlet yy", []),
            ("b", "s", "x", "FAIL", "", "let z", []), ("b", "s", "x", "FAIL", "", "let z", []), (None, "s", "x", "PASS", "", "let q", []),
            ("c", "s", "x", "FAIL", "", "let x", []), ("c", "s", "x", "FAIL", "", "let x", []), ("a", "s", "x", "FAIL", "", "let y\nlet x", []),
            ("d", None, "x", "PASS", "", "let x", []), ("e", "s", "x", None, "", "let x", [])]
    columns = ["impl_id", "status", "sent_idx", "energy", "has_pass_sibling"]
    got = sorted(map(str, B.diff_from_sibling(spark.createDataFrame(rows, IMPL)).select(*columns).toLocalIterator()))
    want = [("a", "FAIL", 0, 0.4, True), ("a", "FAIL", 1, 0.0, True), *[("a", "PASS", i, 0.0, False) for i in (0, 0, 1, 1)],
            ("b", "FAIL", 0, 0.4, True), *[("c", "FAIL", 0, 0.0, True)] * 2, ("d", "PASS", 0, 0.0, False),
            ("e", None, 0, 0.0, False), (None, "PASS", 0, 0.0, False)]
    assert got == sorted(f"Row({', '.join(f'{c}={v!r}' for c, v in zip(columns, w))})" for w in want)
