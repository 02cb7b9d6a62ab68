"""Queries that SQL cannot express against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from lineaudit.llm import fingerprints, pii, quality

WORDS = "the of and river stone light water under every house green small walk talk paper north south east west open".split()


# -- op2: sketches -------------------------------------------------------------------------------

def _shingles(text: str | None, size: int = 5) -> set[int]:
    """Spark's xxhash64 of the shingles' arrays of word hashes, as signed integers."""
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(max(1, len(hashes) - size + 1) if hashes else 0):
        h = 42
        for x in hashes[i:i + size]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        out.add(signed(h))
    return out


def test_sketches_equal_plain_sets(spark):
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(900)]
    texts = [None, "", " \t ", "one two", "One TWO", " ".join(base[:60]), " ".join(base[:90]), " ".join(base), " ".join(base[:600] + ["x"] * 300), " ".join(base[450:])]
    rows = [(i, a, j, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    s, t = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    df = spark.createDataFrame(rows, "i int, a string, j int, b string").withColumns({"s": s, "t": t})
    for r in df.select("*", fingerprints.resemblance(F.col("s"), F.col("t")).alias("like"), fingerprints.containment(F.col("s"), F.col("t")).alias("part"),
                       fingerprints.distinct_shingles(F.col("s")).alias("n")).collect():
        a, b = _shingles(r["a"]), _shingles(r["b"])
        assert r["s"] == sorted(a)[:fingerprints.K]
        like = len(a & b) / len(a | b) if a | b else 1.0
        part = len(a & b) / len(a) if a else 1.0
        exact = len(a | b) < fingerprints.K
        assert abs(r["like"] - like) < (1e-12 if exact else 0.15)
        assert abs(r["part"] - part) < (1e-12 if exact else 0.25)
        assert abs(r["n"] - len(a)) <= (0 if len(a) < fingerprints.K else 0.25 * len(a))


def test_edited_pairs_equal_plain_versions(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 80))) for _ in range(30)] + [None, "", "é😀x", "abc"]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    got = {r["doc_id"]: r for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    ordered = sorted(rows)

    def printed(text):
        return "".join(f"{x & (1 << 64) - 1:016X}" for x in sorted(_shingles(text))[:fingerprints.K])

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        t, u = t or "", u or ""
        edited = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (printed(t), printed(edited))
        # Both sets together stay under K here, so that likeness is exact.
        assert abs(r["near_edited"] - like(_shingles(t), _shingles(edited))) < 1e-12 or len(_shingles(t) | _shingles(edited)) > 127
        assert abs(r["near_next"] - like(_shingles(t), _shingles(u))) < 1e-12 or len(_shingles(t) | _shingles(u)) > 127


# -- op7: base spans ------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _kept(kind: str, v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and _luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def test_personal_data_equals_plain_patterns(spark):
    rng = random.Random(7)
    pieces = ["a@b.c", "x.y%z@mail-host.example.org", "@", "@@", ".", "..", "1.2.3.4", "255.255.255.256", "010.0.00255.1", "1.2.3.4.5.6.7.8",
              "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "6011000990139424123", "+1 (202) 555-0143", "+49.30.1234567", "+", "+4",
              "+12345678901234567", "é", "😀", " ", "-", "\n", "tel", "card", "mail", "9", "00", "a", "Z.", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 2 3 4 5 6 7 8"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(1500)] + [None, ""]
    texts.append(" ".join(f"user{i}@mail{i % 7}.example.com" for i in range(500)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.found(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        spans = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if _kept(k, m.group())] for k, p in PATTERNS.items()}
        printed = ",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in spans[k])
        r = got[i]
        assert r["base_sha256"] == hashlib.sha256(printed.encode()).hexdigest(), t
        whole = set(r["spans"].split(",")) - {""}
        # Counts are of the base spans; the method may add spans, never drop one.
        assert set(printed.split(",")) - {""} <= whole and {k: r[f"n_{k}"] for k in PATTERNS} == {k: len(spans[k]) for k in PATTERNS}
        order = [(list(PATTERNS).index(x.split(":")[0]), int(x.split(":")[1])) for x in r["spans"].split(",") if x]
        assert order == sorted(order)


# -- op1: interpolated modified Kneser-Ney ----------------------------------------------------------

def _kneser_ney(texts: list[str], order: int = 5):
    """log-likelihood of a text under the model of ``texts``, from dictionaries."""
    pad = "\x01" * (order - 1)
    counts = {order: Counter((pad + t)[i:i + order] for t in texts for i in range(len(t)))}
    for o in range(order - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    discounts, total, mass = {}, {}, {}
    for o, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        formula = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else 0.0 for i in (1, 2, 3)]
        discounts[o] = [min(float(i), d) if d > 0 else 0.5 * i for i, d in enumerate(formula, 1)]
        total[o], mass[o] = defaultdict(int), defaultdict(float)
        for g, k in c.items():
            total[o][g[:-1]] += k
            mass[o][g[:-1]] += discounts[o][min(k, 3) - 1]

    def probability(gram: str, o: int) -> float:
        if o == 0:
            return 1 / 4096
        gram = gram[-o:]
        below, n = probability(gram, o - 1), total[o].get(gram[:-1], 0)
        if not n:
            return below
        k = counts[o].get(gram, 0)
        own = k - discounts[o][min(k, 3) - 1] if k else 0.0
        return (own + mass[o][gram[:-1]] * below) / n

    return lambda t: sum(math.log(probability((pad + t)[i:i + order], order)) for i in range(len(t)))


def test_perplexity_equals_plain_kneser_ney(spark):
    rng = random.Random(8)
    trusted = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(40)] + ["", "a"]
    other = [" ".join(rng.choice(WORDS)[::-1] for _ in range(20)) for _ in range(10)] + ["zzzz qqqq", "é", "the", "", None]
    rows = list(enumerate(trusted + other))
    df = spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(trusted))], "doc_id long, quality int")
    plain = _kneser_ney(trusted)
    for size in (quality.SHARD_ROWS, 400):
        got = {r["doc_id"]: r["perplexity"] for r in quality.classified(df, labels, shard_rows=size).collect()}
        for i, t in rows:
            want = math.exp(-plain(t) / len(t)) if t else None
            assert got[i] == want or abs(got[i] - want) < 1e-6 * want, t
    # Without any trusted text nothing is kept.
    none = quality.classified(df, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r["kept"] for r in none)
