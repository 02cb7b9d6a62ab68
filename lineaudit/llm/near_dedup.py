"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of word shingles, k minima of seeded hashes, band
   keys over groups of ``ROWS`` minima, and a packed signature of the low
   ``BITS`` bits of each minimum. The number of bands follows from the threshold:
   a link at the threshold shares no band with probability ``MISS`` at most.
2. Texts with equal sets are one class, stood for by its smallest id.
3. Classes that share a band key are candidates. A bucket does not emit its
   pairs: each member meets four members of the bucket (the smallest ids in four
   orders). The share of equal low bits, corrected for chance, rules out pairs
   that are ``SIGMAS`` standard errors below the threshold; the full sets decide the rest.
4. Buckets whose members still lie in several components are compared in tiles of
   ``BLOCK`` x ``BLOCK`` signatures. Only members with an undecided partner in another
   component send their text to the tile, which tests on full sets and returns a
   spanning forest of the links it found. No pair is skipped unless its ends are
   already connected, so components equal those of all links between candidates.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.llm.common import components, mix, overlap, settle, shingle_set

ROWS = 6
BITS = 4
MISS = 1e-7
SIGMAS = 5.0
BLOCK = 1024
_ORDERS = (0, -1, 0x5555555555555555, 0x3333333333333333)
_SCHEMA = "id bigint, n_shingles bigint, digest binary, signature binary, bands array<bigint>"


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (s[:k] >> np.uint64(32)).astype(np.uint32), (s[k:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def minima(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest hash of the set under each seed, in slices so that long texts stay in cache."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 512):
        v = h[i:i + 512, None] ^ flips
        v *= factors
        np.minimum(out, v.min(axis=0), out=out)
    return out


def pack(low: np.ndarray) -> bytes:
    """Low bits of the minima, ``BITS`` each, padded with zeros to whole 64-bit words."""
    low = (low & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    low = np.pad(low, (0, -len(low) % 16))
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def resemblance(x: np.ndarray, k: int) -> np.ndarray:
    """Similarity from XORed packed signatures (..., words): equal low bits, less those equal by chance."""
    y = x | (x >> np.uint64(1))
    y = (y | (y >> np.uint64(2))) & np.uint64(0x1111111111111111)
    equal = 1.0 - np.bitwise_count(y).sum(axis=-1) / k
    chance = 2.0 ** -BITS
    return (equal - chance) / (1 - chance)


def floor_of(percent: int, k: int) -> float:
    """Estimates below this are ruled out."""
    t, chance = percent / 100, 2.0 ** -BITS
    p = t + (1 - t) * chance
    return t - SIGMAS * math.sqrt(p * (1 - p) / k) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Set size, digest, packed signature and band keys of each row of ``docs(id, text)``."""
    bands = band_count(percent)
    flips, factors = _seeds(bands * ROWS)
    weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix(np.arange(100, 100 + bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, signatures, keys = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), signatures.append(None), keys.append(None)
                    continue
                low = minima(s, flips, factors)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                signatures.append(pack(low))
                keys.append(mix((low.reshape(bands, ROWS).astype(np.uint64) * weights).sum(axis=1) + salts).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n_shingles", "digest", "signature", "bands"])

    return docs.mapInArrow(run, _SCHEMA)


def _plausible(percent: int) -> Column:
    k = band_count(percent) * ROWS
    least = floor_of(percent, k)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(len(s), -1) for s in (a, b))
        return pd.Series(resemblance(x ^ y, k) >= least)

    return test("sig_a", "sig_b")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked on their full sets."""
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_text, last = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                y = y.as_py()
                if y != last_text:
                    last_text, last = y, shingle_set(y, size)
                keep.append(linked(shingle_set(x.as_py(), size), last, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint")


class _Forest:
    """Union by smallest label."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def _tile_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, component labels, side of the tile, and signature words of one tile."""
    words = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
    return t["id"].to_numpy(), t["label"].to_numpy(), (t["block"].to_numpy() != t["i"].to_numpy()), words


def _open_pairs(t: pa.Table, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the tile that lie in two components and may be linked, with their estimates."""
    _, label, side, words = _tile_rows(t)
    diagonal = not side.any()
    rows, cols, guess = [], [], []
    left = np.arange(len(label)) if diagonal else np.flatnonzero(~side)
    right = left if diagonal else np.flatnonzero(side)
    for x in left:
        others = right[right > x] if diagonal else right
        others = others[label[others] != label[x]]
        if len(others):
            est = resemblance(words[others] ^ words[x], k)
            ok = est >= least
            rows.append(np.full(int(ok.sum()), x)), cols.append(others[ok]), guess.append(est[ok])
    if not rows:
        return np.array([], int), np.array([], int), np.array([])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(guess)


def _residual(buckets: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside buckets that the stars left in several components."""
    k = band_count(percent) * ROWS
    least = floor_of(percent, k)
    rows = buckets.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    tiles = (rows.join(mixed, "key")
             .join(nodes.select("id", "signature"), "id")
             .withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "signature"))
    names = ["key", "i", "j", "block", "id", "label", "signature"]

    def flag(t: pa.Table) -> pa.Table:
        x, y, _ = _open_pairs(t, k, least)
        return t.select(names).take(pa.array(np.unique(np.concatenate([x, y]))))

    flagged = settle(tiles.select(names).groupBy("key", "i", "j").applyInArrow(
        flag, "key bigint, i int, j int, block int, id bigint, label bigint, signature binary"))
    texts = docs.join(flagged.select("id").distinct(), "id")

    def forest(t: pa.Table) -> pa.Table:
        ids, label, _, _ = _tile_rows(t)
        x, y, est = _open_pairs(t, k, least)
        sets: dict[int, np.ndarray] = {}
        texts_of = t["text"]
        found, tree = [], _Forest()
        for p in np.argsort(-est, kind="stable"):
            u, v = int(x[p]), int(y[p])
            if tree.find(int(label[u])) == tree.find(int(label[v])):
                continue
            for w in (u, v):
                if w not in sets:
                    sets[w] = shingle_set(texts_of[w].as_py(), size)
            if linked(sets[u], sets[v], percent):
                tree.join(int(label[u]), int(label[v]))
                found.append((int(ids[u]), int(ids[v])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return flagged.join(texts, "id").select(*names, "text").groupBy("key", "i", "j").applyInArrow(forest, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked when 100 * intersection >= percent * union of their shingle
    sets; ``component_id`` is the smallest id reachable. Null or empty texts have
    no shingles and are linked with nothing. A row with a null id is linked with
    nothing, its component is null and it is kept. Rows that share an id count as
    one document. Ids are integers. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    prints = settle(fingerprints(docs, shingle, percent))
    real = prints.where("id is not null and n_shingles > 0")
    classes = real.groupBy("digest").agg(F.min(F.struct("id", "signature", "bands")).alias("s"))
    classes = settle(classes.select("digest", "s.*"))
    nodes = classes.select("id", "signature")

    rows = classes.select("id", F.explode("bands").alias("key"))
    orders = [F.min(F.col("id").bitwiseXOR(F.lit(o))).bitwiseXOR(F.lit(o)).alias(f"p{i}") for i, o in enumerate(_ORDERS)]
    stars = rows.groupBy("key").agg(F.count("*").alias("c"), *orders).where("c > 1")
    buckets = settle(rows.join(stars.select("key", "c", F.array_distinct(F.array(*(f"p{i}" for i in range(len(_ORDERS))))).alias("pivots")), "key"))
    pairs = buckets.select("id", F.explode("pivots").alias("p")).where("id <> p").select(
        F.greatest("id", "p").alias("a"), F.least("id", "p").alias("b")).distinct()
    signed = pairs.join(nodes.select(F.col("id").alias("a"), F.col("signature").alias("sig_a")), "a").join(
        nodes.select(F.col("id").alias("b"), F.col("signature").alias("sig_b")), "b")
    pairs = settle(signed.where(_plausible(percent)).select("a", "b"))
    texts = settle(docs.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id"))
    edges = settle(_confirmed(pairs, texts, shingle, percent))
    labels = components(edges)
    more = settle(_residual(buckets.where("c > 2").drop("pivots"), nodes, labels, docs, shingle, percent))
    labels = settle(components(edges.unionByName(more)))

    whole = prints.select("id", "n_shingles", "digest").join(
        classes.select("digest", F.col("id").alias("node")), "digest", "left").join(labels, "node", "left")
    top = F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id"))
    return whole.select(F.col("id").alias(id_col), "n_shingles", top.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows of a component other than those of its smallest id."""
    gone = near_duplicates(docs, id_col, text_col, shingle, percent).where("not kept").select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
