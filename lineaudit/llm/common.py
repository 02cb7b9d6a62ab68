"""What several of the operators share: tables, checkpoints, shingles, components."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit.session import ensure_checkpoint_dir

_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate result once into the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables an operator writes."""
    import uuid

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z, other letters as they are."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out + h[i:i + n])
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, label) with the smallest id of the component.

    Alternates two star operations: every node hands its larger neighbours, then
    its smaller ones, to the smallest id it knows. A round is written to the
    checkpoint folder; the number of rounds grows with the logarithm of the
    longest chain. Nodes without edges do not appear; null ends and loops are ignored.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        e = settle(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
