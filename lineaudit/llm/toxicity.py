"""Toxic passages by maximum-scoring segments of token log-odds.

* Features of a token are the word and its substrings of 3 to 8 characters, so that
  inflected words share evidence. Their log-odds between toxic and other labelled
  texts carry an informative Dirichlet prior (the feature's overall rate); features
  below ``Z_LEAST`` standard errors are left out. A token scores its best feature, or
  ``GAP`` without one.
* One linear scan (all maximal scoring segments) yields every passage of a text. A text whose positive scores
  together stay below the least score that counts is not scanned: it has no passage.
* Under clean text the best of n tokens' segments follows an extreme-value law,
  P(S >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves E[exp(lambda x)] = 1 over the
  token scores of clean texts, K is its maximum-likelihood value. Passages with an expected number of
  chance occurrences below ``E_MOST`` count; a text's evidence is the sum of -ln E over
  them, turned into a probability by logistic calibration.

Features are counted where it can matter: those of toxic texts first, then, in all texts of the sample, the ones that
enough toxic texts hold to pass at any count of the others.

Labels are learned from a sample of ``LABELLED`` rows at most in expectation, chosen by
digest of the id. Near copies within the sample (equal smallest shingle hash) count once.
The calibration is cross-fitted: either half is scored by the log-odds of the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.llm.common import settle, shingle_set

LABELLED = 40_000
FEATURES = 50_000
PRIOR = 10.0
Z_LEAST = 3.3
GAP = -0.25
E_MOST = 0.05
_WORD = re.compile(r"\w+")
_MEMO = 300_000
_RESULT = "struct<score: double, evidence: double, passages: array<struct<start: int, end: int, score: double>>>"


@dataclass(frozen=True)
class Model:
    odds: dict[str, float]
    scale: float = 1.0
    k: float = 1.0
    intercept: float = -3.0
    slope: float = 0.5


def features(word: str) -> set[str]:
    """The word itself (marked, so that it differs from a substring) and its substrings."""
    return {"=" + word} | {word[i:i + n] for n in range(3, 9) for i in range(len(word) - n + 1)}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time.

    A segment on the stack knows the last one below it whose left sum is smaller: the only one that a
    later segment with a left sum no larger can still be joined to. Where none is smaller, everything on the
    stack is complete.
    """
    scores = np.asarray(scores, float)
    positive = np.flatnonzero(scores > 0)
    sums = np.cumsum(scores)
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at the end, link
    for i, right, before in zip(positive.tolist(), sums[positive].tolist(), np.concatenate(([0.0], sums))[positive].tolist()):
        start, left, j = i, before, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, _, left, _, down = stack[j]
            del stack[j:]
            j = down
        if j < 0:
            done += [(x, y, r - lf) for x, y, lf, r, _ in stack]
            stack.clear()
        stack.append((start, i + 1, left, right, j))
    return done + [(x, y, r - lf) for x, y, lf, r, _ in stack]


class _Matcher:
    """Finds which of a list of features a word has, in one pass over the word."""

    def __init__(self, names: list[str]):
        self.whole = {f[1:]: i for i, f in enumerate(names) if f[0] == "="}
        self.parts = ahocorasick.Automaton()
        for i, f in enumerate(names):
            if f[0] != "=":
                self.parts.add_word(f, i)
        self.any = len(self.parts) > 0
        if self.any:
            self.parts.make_automaton()

    def ids(self, word: str) -> list[int]:
        found = [i for _, i in self.parts.iter(word)] if self.any else []
        if word in self.whole:
            found.append(self.whole[word])
        return found


class _Memo(dict):
    """Values by word, forgotten when there are many."""

    def __init__(self, value):
        self.value = value

    def __missing__(self, word):
        if len(self) > _MEMO:
            self.clear()
        v = self[word] = self.value(word)
        return v


class _Scorer:
    """Token scores of a text; every distinct word is looked up once."""

    def __init__(self, odds: dict[str, float]):
        matcher, values = _Matcher(list(odds)), list(odds.values())
        self.memo = _Memo(lambda w: max((values[i] for i in matcher.ids(w)), default=GAP))

    def text(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.memo.__getitem__, words), float, len(words))


def _passages(model: Model, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
    if not len(scores):
        return 0.0, []
    # No segment outweighs the sum of all positive scores.
    least = (math.log(model.k * len(scores)) - math.log(E_MOST)) / model.scale
    if scores[scores > 0].sum() < least - 1e-6:
        return 0.0, []
    found, evidence = [], 0.0
    for a, b, s in segments(scores):
        chance = math.log(model.k * len(scores)) - model.scale * s
        if chance <= math.log(E_MOST):
            found.append((a, b, s))
            evidence -= chance
    return evidence, found


def _probability(model: Model, evidence: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.intercept + model.slope * math.log1p(evidence)))))


def score_column(model: Model, text: Column) -> Column:
    """Struct (score, evidence, passages in word positions) of a text; null and empty texts have no passage."""
    @F.arrow_udf(_RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(model.odds)
        for batch in texts:
            scores, evidences, ends, passages = [], [], [0], []
            for t in batch:
                evidence, found = _passages(model, scorer.text(t.as_py()))
                scores.append(_probability(model, evidence))
                evidences.append(evidence)
                passages += found
                ends.append(len(passages))
            cols = zip(*passages) if passages else ([], [], [])
            spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64()))], ["start", "end", "score"])
            yield pa.StructArray.from_arrays([
                pa.array(scores, pa.float64()), pa.array(evidences, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)],
                ["score", "evidence", "passages"])

    return run(text)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, toxic, half) of labelled rows outside the held-out fold; conflicting labels count as toxic."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, bound / max(1, rows.count()))
    digest = F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(4))
    picked = rows.where(F.pmod(digest, F.lit(1_000_000)) < int(share * 1_000_000)).select("doc_id", "toxic")

    @F.arrow_udf("bigint")
    def key(texts: pa.Array) -> pa.Array:
        sets = (shingle_set(t.as_py(), 5) for t in texts)
        return pa.array([int(s[0] >> np.uint64(1)) if len(s) else None for s in sets], pa.int64())

    # At most `bound` rows of two numbers.
    base = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    base = settle(base.select("doc_id", "text", "toxic", key("text").alias("key")))
    first = base.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return base.join(F.broadcast(first), ["key", "doc_id"]).select("text", "toxic", F.pmod("key", F.lit(2)).cast("int").alias("half"))


_NAMES = ["n00", "n01", "n10", "n11"]


def _odds(toxic, other, n0: int, n1: int, log, sqrt):
    """(log-odds, z) of features held by ``toxic`` and ``other`` texts, with the prior PRIOR * overall rate on either side."""
    prior = PRIOR * (other + toxic) / (n0 + n1)
    hi, lo = toxic + prior, other + prior
    odds = log(hi / (n1 + PRIOR - hi)) - log(lo / (n0 + PRIOR - lo))
    return odds, odds / sqrt(1 / hi + 1 / lo)


def _least_toxic(n0: int, n1: int) -> int:
    """The smallest number of toxic texts with which a feature can pass ``Z_LEAST``, whatever the others hold."""
    if not n0 or not n1:
        return n1 + 1
    other = np.arange(n0 + 1, dtype=float)
    for t in range(3, n1 + 1):
        odds, z = _odds(float(t), other, n0, n1, np.log, np.sqrt)
        if ((z >= Z_LEAST - 1e-9) & (odds >= 1 - 1e-9)).any():
            return t
    return n1 + 1


def _toxic_features(rows: DataFrame, n: list[int]) -> list[str]:
    """The features that enough toxic texts hold to matter in the whole sample or in one half; the sample bounds their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = (Counter(), Counter()), _Memo(features)

        def flush():
            found = list(set().union(*counts))
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array([c[f] for f in found], pa.int64()) for c in counts)], ["feature", "n01", "n11"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, half in zip(batch.column(0), batch.column(1)):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                counts[half.as_py()].update(set().union(*map(seen.__getitem__, words)))
                if sum(map(len, counts)) > 1_000_000:
                    yield flush()
        yield flush()

    parts = rows.where("toxic = 1").select("text", "half").mapInArrow(run, "feature string, n01 bigint, n11 bigint")
    parts = parts.groupBy("feature").agg(F.sum("n01").alias("n01"), F.sum("n11").alias("n11"))
    enough = ((F.col("n01") + F.col("n11") >= _least_toxic(n[0] + n[2], n[1] + n[3]))
              | (F.col("n01") >= _least_toxic(n[0], n[1])) | (F.col("n11") >= _least_toxic(n[2], n[3])))
    return [r["feature"] for r in parts.where(enough).select("feature").orderBy("feature").collect()]


def _feature_counts(rows: DataFrame, names: list[str]) -> np.ndarray:
    """For each of ``names`` the texts that hold it, by half and label (columns n00, n01, n10, n11)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher(names)
        memo = _Memo(lambda w: np.array(matcher.ids(w), np.int32))
        counts = np.zeros((4, len(names)), np.int64)
        for batch in batches:
            for text, toxic, half in zip(*batch.columns):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                if words:
                    counts[2 * half.as_py() + toxic.as_py(), np.concatenate([memo[w] for w in words])] += 1  # once per feature
        held = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *(pa.array(c[held]) for c in counts)], ["i", *_NAMES])

    parts = rows.select("text", "toxic", "half").mapInArrow(run, "i bigint, " + ", ".join(f"{x} bigint" for x in _NAMES))
    out = np.zeros((len(names), 4), np.int64)
    found = parts.groupBy("i").agg(*(F.sum(x).alias(x) for x in _NAMES)).toArrow()  # one row per name
    out[found.column("i").to_numpy()] = np.stack([found.column(x).to_numpy() for x in _NAMES], axis=1)
    return out


def _logistic(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Intercept and slope by Newton's method on (value, negatives, positives) with a small ridge."""
    a, b = -2.0, 0.5
    for _ in range(50):
        ga = -1e-3 * a
        gb, haa, hab, hbb = -1e-3 * b, 1e-3, 0.0, 1e-3
        for x, n, p in cells:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = (n + p) * q * (1 - q)
            ga += p - (n + p) * q
            gb += (p - (n + p) * q) * x
            haa, hab, hbb = haa + w, hab + w * x, hbb + w * x * x
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5 / (abs(da) + abs(db) + 1e-12))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return a, b


def _log_odds(names: list[str], other: np.ndarray, toxic: np.ndarray, n0: int, n1: int) -> dict[str, float]:
    """The strongest features, at most FEATURES, with their log-odds."""
    if not n0 or not n1 or not names:
        return {}
    some = np.flatnonzero(toxic >= 3)
    odds, z = _odds(toxic[some].astype(float), other[some].astype(float), n0, n1, np.log, np.sqrt)
    kept = np.flatnonzero((z >= Z_LEAST) & (odds >= 1))
    # The names are sorted: equal z keep their order.
    kept = kept[np.argsort(-z[kept], kind="stable")[:FEATURES]]
    return {names[some[i]]: float(odds[i]) for i in kept}


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """Learn a model from ``labels(doc_id, toxic)``. Without labels of both kinds no token counts."""
    rows = _sample(docs, labels, bound)
    sizes = {(r["half"], r["toxic"]): r["n"] for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n = [sizes.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))]
    if not n[0] + n[2] or not n[1] + n[3]:
        return Model({})
    names = _toxic_features(rows, n)
    c = _feature_counts(rows, names).T
    whole = _log_odds(names, c[0] + c[2], c[1] + c[3], n[0] + n[2], n[1] + n[3])
    scale, k = _extreme_values(rows.where("toxic = 0"), Model(whole))
    cells: Counter = Counter()
    for half in (0, 1):
        i = 2 * (1 - half)
        model = Model(_log_odds(names, c[i], c[i + 1], n[i], n[i + 1]), scale, k)
        value = F.round(F.log1p(score_column(model, F.col("text"))["evidence"]), 2)
        # Rounded values: a few hundred rows whatever the sample.
        for r in rows.where(F.col("half") == half).select(value.alias("x"), "toxic").groupBy("x", "toxic").agg(F.count("*").alias("n")).collect():
            cells[r["x"], r["toxic"]] += r["n"]
    a, b = _logistic([(x, cells[x, 0], cells[x, 1]) for x in {x for x, _ in cells}])
    return Model(whole, scale, k, a, max(b, 1e-3))


def _extreme_values(clean: DataFrame, model: Model) -> tuple[float, float]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, tokens, tops = _Scorer(model.odds), Counter(), Counter()
        for batch in batches:
            for t in batch.column(0):
                scores = scorer.text(t.as_py())
                if len(scores):
                    values, many = np.unique(np.round(scores, 1), return_counts=True)
                    for x, c in zip(values.tolist(), many.tolist()):
                        tokens[x] += c
                    top = max((s for _, _, s in segments(scores)), default=0.0)
                    tops[round(top, 1)] += len(scores)
                    tokens["texts"] += 1
        texts = tokens.pop("texts", 0)
        rows = [("token", x, c) for x, c in tokens.items()] + [("top", x, c) for x, c in tops.items()] + [("texts", 0.0, texts)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.int64()))], ["what", "x", "c"])

    rows = clean.select("text").mapInArrow(run, "what string, x double, c bigint").groupBy("what", "x").agg(F.sum("c").alias("c")).collect()
    tokens = {r["x"]: r["c"] for r in rows if r["what"] == "token"}
    total = sum(tokens.values())
    if not total:
        return 1.0, 1.0
    # Laplace: one more token at the smallest positive score, so that the root exists.
    tokens[1.0] = tokens.get(1.0, 0) + 1
    excess = lambda t: sum(c * math.exp(t * x) for x, c in tokens.items()) / (total + 1) - 1
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    texts = sum(r["c"] for r in rows if r["what"] == "texts")
    mass = sum(r["c"] * math.exp(-lo * r["x"]) for r in rows if r["what"] == "top")
    return lo, max(texts / mass, 1e-9)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, evidence) for every row; only the text enters the score."""
    rows = docs.select("doc_id", score_column(model, F.col("text")).alias("s"))
    return rows.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("s.score").alias("score"),
        (F.col("s.score") >= threshold).cast("int").alias("predicted"), F.size("s.passages").alias("n_passages"), F.col("s.evidence").alias("evidence"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    return docs.where(score_column(model, F.col("text"))["score"] < threshold)
