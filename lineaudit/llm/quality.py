"""Language quality by an interpolated modified Kneser-Ney model of character n-grams.

Characters, not words: their n-grams saturate, so the model of a corpus of any size stays small
while every text gets a perplexity. Characters are whole code points: n-grams of code points below ``WIDE`` are packed
into one word, all others into two words while counting and into a 64-bit hash in the finished model. Trusted texts are counted in Spark (all of them, each
occurrence); lower orders count distinct left neighbours. Discounts come from the counts
of counts per order, and joins on contexts and suffixes give every seen n-gram its final
probability and every context its back-off weight.

Scoring lays the model beside the texts in shards of ``SHARD_ROWS`` entries at most in expectation, by the two characters
before the predicted one; each pass scores the positions of its shard, and the sums over shards are
columns of one row. Texts are never shuffled for scoring. A text is kept if its
perplexity is at most the ``QUANTILE`` quantile of trusted texts in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.llm.common import settle
from lineaudit.plans.skew import lookup

ORDER = 5
CLASSES = 4096
SHARD_ROWS = 4_000_000
QUANTILE = 0.99
WIDE = 4000
_BITS = 21
_FLAG = 1 << 62
# The uniform distribution below order 1: one share for each character below WIDE, the other shares evenly for the rest.
_FAR_BASE = (CLASSES - WIDE) / CLASSES / (0x110000 - WIDE)
_PIECE = 1_000_000
_START = 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The characters of the n-gram at every position of all texts, one array per place, and each text's length.
    Texts start with start marks."""
    pad = np.full(ORDER - 1, _START, np.uint64)
    parts, lengths = [], np.array([len(t) for t in texts], np.int64)
    for t in texts:
        parts += [pad, _points(t)]
    c = np.concatenate(parts) if parts else np.array([], np.uint64)
    ends = np.cumsum(lengths + ORDER - 1) - (ORDER - 1)
    starts = ends - lengths
    size = max(0, len(c) - ORDER + 1)
    keep = np.zeros(size + 1, np.int64)
    np.add.at(keep, starts[lengths > 0], 1)
    np.add.at(keep, ends[lengths > 0], -1)
    keep = np.cumsum(keep[:-1]) > 0
    return [c[i:i + size][keep] for i in range(ORDER)], lengths


def _keys(chars: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, code) of n-grams: 12 bits a character and hi = 0 if all are below ``WIDE``, else 21 bits a character."""
    hi, code, wide = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, bool)
    for c in chars:
        code = code * np.uint64(CLASSES) + c
        wide |= c >= WIDE
    if wide.any():
        hi[wide], code[wide] = _FLAG, 0
        for i, c in enumerate(reversed(chars)):
            (code if i < 3 else hi)[wide] |= c[wide] << np.uint64(_BITS * (i % 3))
    return hi, code


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _xxhash64(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of bigint columns."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(columns[0]), 42, np.uint64)
    for x in columns:
        h = (h + p5 + np.uint64(8)) ^ (_rotated(x * p2, 31) * p1)
        h = _rotated(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h ^= h >> np.uint64(32)
    return h


def _codes(chars: list[np.ndarray], size: int) -> np.ndarray:
    """The model's key of n-grams: their code, or for wide ones a hash with the top bit set."""
    hi, code = _keys(chars, size)
    wide = hi != 0
    if wide.any():
        code[wide] = _xxhash64(hi[wide], code[wide]) | np.uint64(1 << 63)
    return code


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of every position of all texts, and each text's length. Texts start with start marks."""
    chars, lengths = _windows(texts)
    return _codes(chars, len(chars[0])), lengths


def _runs(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in runs of about ``_PIECE`` characters."""
    run, size = [], 0
    for t in batch:
        run.append(t.as_py() or "")
        size += len(run[-1])
        if size >= _PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run


def _tallied(hi: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if not len(hi):
        return hi, code, n
    order = np.lexsort((code, hi))
    hi, code, n = hi[order], code[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (code[1:] != code[:-1])]))
    return hi[at], code[at], np.add.reduceat(n, at)


def counted(texts: DataFrame) -> DataFrame:
    """(hi, code, n) of the longest n-grams of ``texts(text)``."""
    none = np.array([], np.uint64), np.array([], np.int64)

    def rows(keys, counts, wide):
        for h, k, n in ((np.zeros(len(keys), np.uint64), keys, counts), wide):
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.view(np.int64)), pa.array(n)], ["hi", "code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, counts), wide = none, (none[0], *none)
        for batch in batches:
            for texts in _runs(batch.column(0)):
                chars, _ = _windows(texts)
                hi, code = _keys(chars, len(chars[0]))
                far = hi != 0
                if far.any():
                    new = hi[far], code[far], np.ones(np.count_nonzero(far), np.int64)
                    wide = _tallied(*map(np.concatenate, zip(wide, new)))
                    code = code[~far]
                k, n = np.unique(code, return_counts=True)
                keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
                if len(keys) + len(wide[0]) > 2_000_000:
                    yield from rows(keys, counts, wide)
                    (keys, counts), wide = none, (none[0], *none)
        yield from rows(keys, counts, wide)

    return texts.mapInArrow(run, "hi bigint, code bigint, n bigint").groupBy("hi", "code").agg(F.sum("n").alias("n"))


def _part(first: int, end: int, narrow: Column) -> list[Column]:
    """(hi, code) of the characters ``first`` to ``end - 1``, counted from the last one, of the n-grams (hi, code).
    ``narrow`` is the code where all characters are below ``WIDE``."""
    chars = [F.shiftright(F.col("code" if k < 3 else "hi"), _BITS * (k % 3)).bitwiseAND(F.lit((1 << _BITS) - 1)) for k in range(first, end)]
    if not chars:
        return [F.lit(0).cast("bigint"), F.lit(0).cast("bigint")]
    packed = lambda some, bits: reduce(lambda a, b: a + b, [F.shiftleft(c, bits * i) for i, c in enumerate(some)], F.lit(0).cast("bigint"))
    wide = reduce(lambda a, b: a | b, [c >= WIDE for c in chars])
    near = F.col("hi") == 0
    return [F.when(near | ~wide, F.lit(0).cast("bigint")).otherwise(packed(chars[3:], _BITS) + F.lit(_FLAG)),
            F.when(near, narrow).when(wide, packed(chars[:3], _BITS)).otherwise(packed(chars, 12))]


def _suffix(order: int) -> list[Column]:
    return _part(0, order, F.col("code").bitwiseAND(F.lit(CLASSES ** order - 1)))


def _context(order: int) -> list[Column]:
    return _part(1, order, F.shiftright("code", 12))


def _rows(kind: int, hi: str, code: str, value: str) -> list[Column]:
    """Columns of the model. The shard's characters of a wide key are kept, as its hash does not tell them."""
    wide, pair = F.col(hi) != 0, F.lit((1 << 2 * _BITS) - 1)
    before = F.shiftright(code, _BITS) if kind > 0 else F.col(code)
    return [F.lit(kind).alias("kind"), F.when(wide, F.xxhash64(hi, code).bitwiseOR(F.lit(-1 << 63))).otherwise(F.col(code)).alias("code"),
            F.col(value).alias("value"), (F.when(wide, before.bitwiseAND(pair)) if abs(kind) >= 3 else F.lit(None).cast("bigint")).alias("pair")]


def _discount(i: int, y: float, n: float, after: float) -> float:
    """Discount of count ``i``, of which there are ``n``, by the ``after`` n-grams of the next count. Where the counts of counts
    give none that is above 0 (small corpora), half of ``i``: without a discount an unseen n-gram would have probability 0."""
    d = i - (i + 1) * y * after / n if n and after else 0.0
    return min(float(i), d) if d > 0 else 0.5 * i


def train(texts: DataFrame) -> DataFrame:
    """The model: (kind, code, value, pair). kind n in 1..ORDER: probability of n-gram ``code``;
    kind -n: back-off weight of the context ``code`` of n-grams of order n."""
    grams = {ORDER: settle(counted(texts))}
    for o in range(ORDER - 1, 0, -1):
        hi, code = _suffix(o)
        grams[o] = settle(grams[o + 1].select(hi.alias("hi"), code.alias("code")).groupBy("hi", "code").agg(F.count("*").alias("n")))
    lower = None
    out = []
    for o in range(1, ORDER + 1):
        g = grams[o]
        r = g.agg(*(F.sum((F.col("n") == i).cast("bigint")).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (float(r[f"n{i}"] or 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [_discount(i, y, a, b) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        ctx_hi, ctx = _context(o)
        rows = g.withColumns({"ctx_hi": ctx_hi, "ctx": ctx}).withColumn(
            "d", F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))
        ctx = rows.groupBy("ctx_hi", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("mass")).select(
            "ctx_hi", "ctx", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        rows = rows.join(ctx, ["ctx_hi", "ctx"])
        own = (F.col("n") - F.col("d")) / F.col("total")
        if lower is None:
            base = F.when(F.col("hi") == 0, F.lit(1 / CLASSES)).otherwise(F.lit(_FAR_BASE))
            rows = rows.select("hi", "code", (own + F.col("gamma") * base).alias("value"))
        else:
            sub_hi, sub = _suffix(o - 1)
            rows = rows.withColumns({"sub_hi": sub_hi, "sub": sub}).join(lower.select(
                F.col("hi").alias("sub_hi"), F.col("code").alias("sub"), F.col("value").alias("below")), ["sub_hi", "sub"])
            rows = rows.select("hi", "code", (own + F.col("gamma") * F.col("below")).alias("value"))
        lower = settle(rows)
        out.append(lower.select(*_rows(o, "hi", "code", "value")))
        out.append(ctx.select(*_rows(-o, "ctx_hi", "ctx", "gamma")))
    return settle(reduce(DataFrame.unionByName, out))


class _Lookup:
    """Values by 64-bit key, by open addressing in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys) - 1).bit_length()) if len(keys) else 4
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == ~np.uint64(0)
            self.keys[at[free]] = keys[left[free]]
            placed = self.keys[at] == keys[left]
            self.values[at[placed]] = values[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (there != ~np.uint64(0))
            left, at = left[on], (at[on] + 1) & self.mask
        return out


def _probabilities(tables: dict[int, _Lookup], codes: np.ndarray) -> np.ndarray:
    """Interpolated probability of the last character of each code."""
    p, weight = np.zeros(len(codes)), np.ones(len(codes))
    left = np.arange(len(codes))
    for o in range(ORDER, 0, -1):
        gram = codes[left] & np.uint64(CLASSES ** o - 1)
        found = tables[o].get(gram, -1.0)
        hit = found >= 0
        p[left[hit]] = weight[left[hit]] * found[hit]
        left, gram = left[~hit], gram[~hit]
        weight[left] *= tables[-o].get(gram >> np.uint64(12), 1.0)
    p[left] = weight[left] / CLASSES
    return p


def _wide_probabilities(tables: dict[int, _Lookup], chars: list[np.ndarray]) -> np.ndarray:
    """Like ``_probabilities``, for n-grams given by their characters."""
    size = len(chars[-1])
    p, weight = np.zeros(size), np.ones(size)
    left = np.arange(size)
    for o in range(ORDER, 0, -1):
        mine = [c[left] for c in chars[ORDER - o:]]
        found = tables[o].get(_codes(mine, len(left)), -1.0)
        hit = found >= 0
        p[left[hit]] = weight[left[hit]] * found[hit]
        left = left[~hit]
        weight[left] *= tables[-o].get(_codes([c[~hit] for c in mine[:-1]], len(left)), 1.0)
    p[left] = weight[left] * np.where(chars[-1][left] >= WIDE, _FAR_BASE, 1 / CLASSES)
    return p


def _shard_of(pair, shards: int):
    return pair * 40503 % 65521 % shards


def log_likelihood(model: DataFrame, text: Column, shard_rows: int = SHARD_ROWS) -> Column:
    """Sum of natural log-probabilities of a text's characters."""
    spark = model.sparkSession
    shards = model.count() // shard_rows + 1
    code = F.when(F.col("kind") >= 3, F.shiftright("code", 12)).when(F.col("kind") <= -3, F.col("code"))
    last = F.lit(CLASSES - 1)
    pair = F.coalesce("pair", F.shiftleft(F.shiftright(code, 12).bitwiseAND(last), _BITS).bitwiseOR(code.bitwiseAND(last)))
    parts = []
    for s in range(shards):
        # Orders 1 and 2 and their contexts, as many rows as distinct pairs of characters, go to every shard.
        own = model if shards == 1 else model.where(pair.isNull() | (_shard_of(pair, shards) == s))
        t = own.select("kind", "code", "value").toArrow()
        kinds, keys, values = (t[c].to_numpy() for c in ("kind", "code", "value"))
        shared = spark.sparkContext.broadcast({int(k): (keys[kinds == k].astype(np.uint64), values[kinds == k]) for k in np.unique(kinds)})
        parts.append(_shard_sum(shared, s, shards)(text))
    return reduce(lambda a, b: a + b, parts)


def _shard_sum(shared, s: int, shards: int):
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = (np.array([], np.uint64), np.array([]))
        tables = {k: _Lookup(*shared.value.get(k, none)) for o in range(1, ORDER + 1) for k in (o, -o)}
        for batch in batches:
            sums: list[np.ndarray] = []
            for texts in _runs(batch):
                chars, lengths = _windows(texts)
                logs = np.zeros(len(chars[0]))
                if shards > 1:
                    mine = np.flatnonzero(_shard_of((chars[-3] << np.uint64(_BITS)) | chars[-2], shards) == s)
                    chars = [c[mine] for c in chars]
                else:
                    mine = np.arange(len(logs))
                hi, codes = _keys(chars, len(mine))
                far = hi != 0
                if far.any():
                    logs[mine[far]] = np.log(_wide_probabilities(tables, [c[far] for c in chars]))
                    mine, codes = mine[~far], codes[~far]
                logs[mine] = np.log(_probabilities(tables, codes))
                upto = np.concatenate([[0.0], np.cumsum(logs)])
                ends = np.cumsum(lengths)
                sums.append(upto[ends] - upto[ends - lengths])
            yield pa.array(np.concatenate(sums) if sums else np.array([]), pa.float64())

    return run


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for every row.

    Trusted texts are those with quality 1 in ``labels(doc_id, quality)``. Null and empty texts have no perplexity and
    are not kept; a language without trusted texts has the threshold of all. Null languages are a language.
    """
    trusted = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    # Always by merging: the ids of trusted texts grow with the corpus.
    model = train(docs.select("doc_id", "text").join(trusted.hint("merge"), "doc_id").select("text"))
    n = F.char_length("text")
    rows = docs.select("doc_id", "lang", n.alias("n"), log_likelihood(model, F.col("text"), shard_rows).alias("ll"))
    rows = settle(rows.select("doc_id", "lang", F.when(F.col("n") > 0, F.exp(-F.col("ll") / F.col("n"))).alias("perplexity")))
    known = rows.join(trusted, "doc_id", "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = known.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(cut.alias("_own"))
    whole = known.agg(cut.alias("_all"))
    rows = rows.withColumn("_lang", F.coalesce("lang", F.lit("")))
    out = lookup(rows, by_lang, ["_lang"], ["_own"], ["doc_id"]).crossJoin(F.broadcast(whole))
    out = out.withColumn("threshold", F.coalesce("_own", "_all"))
    return out.select("doc_id", "lang", "perplexity", "threshold",
                      F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
