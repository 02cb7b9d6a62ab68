"""Shards of bounded size by extendible hashing.

A row's place is the first bits of its key's digest. A bucket that holds more than the limit splits on the
next bit; all others stay as they are, so the directory is a prefix tree whose leaves are the
shards. Sizes are counted on prefixes of ``BITS`` more bits than an even spread would need; only buckets
that are still too large there are counted again on further bits. A bucket of a single key cannot
split: it is a shard of its own, marked oversized.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.llm.common import settle

LIMIT = 8 << 20
DEPTH = 48
BITS = 4


def place(key: Column) -> Column:
    """48 bits of the key's digest; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.floor(h / F.pow(F.lit(2.0), DEPTH - depth)).cast("bigint")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(depth, prefix, bytes, documents, oversized) of every shard, from ``rows(h, bytes)``."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    at, deep = 0, min(DEPTH, max(1, math.ceil(math.log2(max(1, total / limit)))) + BITS)
    leaves = None
    while True:
        counted = rows.groupBy(_prefix(F.col("h"), deep).alias("p")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("documents"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        # One row per prefix and depth: a multiple of the number of shards, whatever the number of rows.
        nodes = counted.withColumn("depth", F.explode(F.sequence(F.lit(at), F.lit(deep)))).groupBy(
            "depth", F.floor(F.col("p") / F.pow(F.lit(2.0), deep - F.col("depth"))).cast("bigint").alias("prefix")).agg(
            F.sum("bytes").alias("bytes"), F.sum("documents").alias("documents"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        nodes = settle(nodes.withColumn("final", (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))))
        split = nodes.where("not final").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        below = nodes.where(F.col("depth") > at).withColumn("up", F.floor(F.col("prefix") / 2).cast("bigint")).join(split, ["depth", "up"])
        new = nodes.where(F.col("final") & (F.col("depth") == at)).unionByName(below.where("final").drop("up"))
        new = new.select("depth", "prefix", "bytes", "documents", (F.col("bytes") > limit).alias("oversized"))
        leaves = new if leaves is None else leaves.unionByName(new)
        still = nodes.where(~F.col("final") & (F.col("depth") == deep)).select(F.col("prefix").alias("_p"))
        if deep == DEPTH or still.isEmpty():
            return leaves
        rows = rows.withColumn("_p", _prefix(F.col("h"), deep)).join(still, "_p", "left_semi").drop("_p")
        at, deep = deep, min(DEPTH, deep + 2 * BITS)


def _sharded(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the columns h and bytes, each once, and depth, prefix, shard_bytes, oversized and shard of its leaf."""
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most DEPTH + 1 numbers
    tries = rows.withColumn("depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.expr("array(0)")))
    tries = tries.withColumn("prefix", _prefix(F.col("h"), F.col("depth")))
    out = tries.join(leaves.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), "oversized"), ["depth", "prefix"])
    return out.withColumn("shard", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))))


def assigned(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, oversized) for every row of ``docs``.

    ``shard`` is the bit prefix as text, empty while one shard holds everything. Null texts have no bytes;
    rows with equal keys stay together.
    """
    rows = settle(docs.select(F.col(key), place(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes")))
    leaves = settle(directory(rows.select("h", "bytes"), limit))
    return _sharded(rows, leaves).select(key, "bytes", "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "oversized")


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """The rows of ``docs``, each once, in one folder per shard. Keys may be null or repeat. A shard fits one task;
    an oversized one is spread over as many as it holds limits.

    Folders are named by ``b`` and the bit prefix, so that Spark reads them back as text, as column ``shard``; where
    ``docs`` has a column of that name, underscores are added to the new one.
    """
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    rows = docs.select(F.struct("*").alias("row"), place(F.col(key)).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"),
                       F.monotonically_increasing_id().alias("n"))
    leaves = settle(directory(settle(rows.select("h", "bytes")), limit))
    parts = F.ceil(F.col("shard_bytes") / limit)
    out = _sharded(rows, leaves).withColumn("salt", F.when(F.col("oversized"), F.pmod(F.xxhash64("n"), parts)).otherwise(F.lit(0)))
    out = out.withColumn("shard", F.concat(F.lit("b"), "shard"))
    out.repartition("shard", "salt").select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
