"""Centroids, filter audit and curriculum mix against brute force, on small tables with odd rows."""

import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineaudit.llm import centroids, filter_audit, mixing

DOCS = "doc_id bigint, text string, source string, quality string, part string, size bigint, row string, _h int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "q", "p", 1, "r", 2) for i, t, s in rows], DOCS)


# Centroids


def vectors_of(rng, n, size, spread=3):
    base = [[rng.uniform(-spread, spread) for _ in range(size)] for _ in range(6)]
    return [[float(np.float32(x + rng.gauss(0, 0.3))) for x in base[rng.randrange(6)]] for _ in range(n)]


def lloyd(rows, k, rounds, size, seed):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    cents = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), cents


def test_centroids_equal_plain_k_means(spark):
    rng = random.Random(3)
    rows = list(enumerate(vectors_of(rng, 300, 8)))
    rows += [(400 + i, rows[0][1]) for i in range(40)] + [rows[1], rows[1], (None, rows[2][1])]
    rows += [(500, None), (501, [1.0] * 7), (502, [1.0] * 7 + [None]), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (505, [])]
    df = spark.createDataFrame([(i, v, 9, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, v int, distance double").repartition(5)
    for k in (1, 12, 500):
        out = centroids.report(df, k=k, rounds=3, size=8, seed="x").collect()
        want, cents = lloyd(rows, k, 3, 8, "x")
        assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out), key=str) == want
        assert {r["inertia"] for r in out} == {sum(d for _, _, d in want)}
        for r in out:
            assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()
            assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


def test_search_meets_ties_and_skips_far_centroids():
    rng = np.random.default_rng(1)
    grid = rng.integers(-4, 5, (60, 3)).astype(np.int64)
    grid[7], grid[30] = grid[50], grid[50]
    points = rng.integers(-5, 6, (4000, 3)).astype(np.int64)
    best, closest = centroids.Lists(grid).nearest(points)
    d = ((points[:, None] - grid[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (closest == d.min(1)).all()


def test_centroids_of_nothing_and_too_wide(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert centroids.report(spark.createDataFrame([], schema)).count() == 0
    assert centroids.report(spark.createDataFrame([(1, [0.5] * 63)], schema)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.report(spark.createDataFrame([(1, [1e30] * 64)], schema)).count()


# Filter audit


def audited(rows, labels):
    known = {}
    for i, q, t in labels:
        a = known.setdefault(i, [False, False])
        known[i] = [a[0] or q == 1, a[1] or t == 1]
    docs = []
    for i, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), re.search("[#$%&*|]", text),
            any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows))) if bad}
        docs.append((source or "", fails, *(known.get(i, [False, False]) if i is not None else (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                kept = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
        for k in [k for k in out if k[0] == part]:
            out[k].append(shapley[k[1][k[2] - 1]])
    return out


def test_audit_equals_all_orders_applied(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Loud", "SHOUT", "a#b"]
    texts = [None, "", " \n", "A", "ÄÖ Ü", " ".join(rng.choice(words[:40]) for _ in range(230)), "boiler " * 400 + "x", "boiler " * 400 + "y", "boiler " * 400]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(150, 260))) for _ in range(25)]
    texts += [" ".join(words[:210]) + end for end in ("", " é", " | z")]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, "c\x00"])) for i in range(260)]
    rows += [(None, texts[5], "a"), (None, texts[5], "b"), rows[3], rows[3], (-4, texts[9], "late")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (9999, 1, 1)]
    df = docs_of(spark, rows).repartition(6)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    want = audited(rows, labels)
    for limit in (filter_audit.TRIE_BYTES, 2000):  # a small bound empties tries and tables many times
        monkeypatch.setattr(filter_audit, "TRIE_BYTES", limit)
        got = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in filter_audit.audit(df, lab).collect()}
        assert got == want


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs_of(spark, []), labels).count() == 0
    assert filter_audit.audit(docs_of(spark, [(1, "one", None)]), labels).count() == 600


def test_trie_holds_every_text_once():
    rng = random.Random(2)
    keys = [b"", b"\x00", b"ab", b"abc", b"abd", b"x" * 100_000, b"x" * 99_999 + b"y"] + [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(500)]
    trie, want = filter_audit.Trie(), {}
    for i, k in enumerate(keys):
        trie.add(k, [i % 50, {(k,): [1, 0, 0]}, 0])
        low, n = want.get(k, (99, 0))
        want[k] = min(low, i % 50), n + 1
    got = [(next(iter(v[1]))[0], v[0], sum(next(iter(v[1].values())))) for v in trie.values()]
    assert got == [(k, *want[k]) for k in sorted(want)]


def test_merging_entries_in_any_order_and_grouping():
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), ("p", rng.random() < 0.5, False)) for _ in range(9)]

    def entry(i, key):
        return [i, {key: [1, 0, 0] if i is not None else [0, 0, 1]}, 0]
    low = min(i for i, _ in rows if i is not None)
    want = {k: [sum(i == low for i, x in rows if x == k), sum(i is not None and i > low for i, x in rows if x == k), sum(i is None for i, x in rows if x == k)]
            for k in {k for _, k in rows}}
    for _ in range(50):
        entries = [entry(*r) for r in rng.sample(rows, len(rows))]
        while len(entries) > 1:
            i = rng.randrange(len(entries) - 1)
            entries[i:i + 2] = [filter_audit.merged(entries[i], entries[i + 1])]
        assert entries[0][:2] == [low, want]


# Curriculum mix


def filled(sizes, weights, most=3):
    """Water filling by repetition, in fractions."""
    target, open_ = {}, set(sizes)
    left = Fraction(sum(sizes.values()))
    while open_:
        share = {s: left * Fraction(weights[s]) / sum(Fraction(weights[x]) for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = Fraction(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def mix_rows(rng):
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), rng.choice(["big", "big", "big", "mid", None])) for i in range(200)]
    return rows + [(300, "a b c", "tiny"), (301, None, "mid"), (302, "", "none"), (None, "x " * 30, "big"), (303, "w " * 5000, "mid"),
                   rows[0], rows[0], rows[0], (304, "x", "ä"), (305, "y z", "\U0001f600")]


def test_mix_meets_targets(spark):
    rows = mix_rows(random.Random(4))
    out = mixing.planned(docs_of(spark, rows).repartition(7)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == sum(p["words"] for p in r["passes"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= Fraction(1, 2) + Fraction(1, 10 ** 6) for s in sizes)
    again = mixing.planned(docs_of(spark, rows).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    positions = [r["position"] for r in out]
    assert positions[:-sum(p is None for p in positions)] == sorted(p for p in positions if p is not None)


def test_curves_decide_when_a_source_is_read(spark):
    rows = [(i, "w w w w w", "early" if i % 2 else "late") for i in range(4000)]
    curves = {"early": ((0.0, 3.0), (0.5, 1.0), (1.0, 0.0)), "late": ((0.0, 0.0), (0.25, 0.0), (1.0, 2.0))}
    plan = mixing.planned(docs_of(spark, rows), curves=curves).collect()

    def area(knots, upto):
        total = 0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            end = min(t1, upto)
            if end > t0:
                w = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                total += (w0 + w) / 2 * (end - t0)
        return total
    for name, knots in curves.items():
        passes = [p for r in plan if r["source"] == name for p in r["passes"]]
        words = sum(p["words"] for p in passes)
        for t in (0.1, 0.25, 0.4, 0.5, 0.8, 1.0):
            seen = sum(p["words"] for p in passes if p["position"] < t)
            assert abs(seen / words - area(knots, t) / area(knots, 1)) < 0.002
    only = mixing.planned(docs_of(spark, rows), curves={"early": ((0.0, 1.0), (1.0, 1.0))}).groupBy("source").agg(F.sum("taken")).collect()
    assert {tuple(r) for r in only} == {("early", 20000), ("late", 0)}


def test_mixed_carries_rows_in_training_order(spark):
    rows = mix_rows(random.Random(6))
    df = docs_of(spark, rows)
    out = mixing.mixed(df).collect()
    assert [r["position"] for r in out] == sorted(r["position"] for r in out)
    got, want = {}, {}
    for r in out:
        got[r["row"]["source"]] = got.get(r["row"]["source"], 0) + r["words"]
        assert r["words"] <= len(r["row"]["text"].split()) and set(r["row"].asDict()) == set(df.columns)
    for r in mixing.planned(df).collect():
        want[r["source"]] = want.get(r["source"], 0) + r["taken"]
    assert got == {s: n for s, n in want.items() if n}


def test_mix_of_nothing(spark):
    assert mixing.planned(docs_of(spark, [])).count() == 0
    blank = mixing.planned(docs_of(spark, [(1, None, None), (2, " ", "s")])).collect()
    assert {(r["doc_id"], r["size"], r["target"], r["taken"], r["position"]) for r in blank} == {(1, 0, 0.0, 0, None), (2, 0, 0.0, 0, None)}
    with pytest.raises(ValueError):
        mixing.planned(docs_of(spark, []), curves=(((0.0, 1.0), (0.5, 1.0)),))
