"""Evaluation records as they arrive: the batch transforms over a file stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, StringType

from lineaudit import schemas
from lineaudit.functions import ranking as R
from lineaudit.functions import status as ST
from lineaudit.sources.records import last_per_key


def read_stream(spark: SparkSession, path: str, dialect=ST.verbatim, files_per_trigger: int = 1000) -> DataFrame:
    """JSON-lines records from a folder that keeps filling."""
    raw = spark.readStream.schema(schemas.EVAL_RECORD).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.withColumn("status", dialect(F.col("status")))


def running_recall(records: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Recall so far; state is one row per k."""
    e, b = F.col("per_line_energies"), F.col("buggy_line_indices")
    rows = records.filter((F.col("status") == "FAIL") & (F.size(b) > 0) & (F.size(e) > 0)).withColumn("_o", R.rank_order(e))
    hits = rows.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("k"), R.hit(F.col("_o"), b, k).cast("int").alias("hit")) for k in ks])))
    return hits.groupBy("k").agg(F.avg("hit").alias("recall"), F.count("*").alias("n"))


def append_json(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows once each, surviving restarts; stops when the folder is drained."""
    return (rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def each_batch(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# -- the last record of each key ------------------------------------------------------------------

#: Groups of keys that share one state; fixed for the life of a stream, since its checkpoint holds them.
BUCKETS = 4096


def latest_updates(rows: DataFrame, key: str, order: str, time: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Of every micro-batch the rows that are the last of their key so far, by ``order``; at most one per key.

    State is one order value per key, kept until the watermark (``delay`` behind the latest ``time``) has passed the
    key's last row. Repeated rows and rows out of order but within the delay change nothing or take their place; rows
    that come later than the delay are dropped by the watermark. Rows without key, order or time have no place.

    Integer and text keys share a state by ``buckets`` digests, so that a micro-batch calls Python once per bucket
    instead of once per key; a batch rewrites the states of the buckets it meets. Other keys have a state each.
    """
    names = rows.columns

    def newest(_, chunks, state: GroupState):
        kept = dict(zip(state.get[0], zip(state.get[1], state.get[2]))) if state.exists else {}
        now, found = state.getCurrentWatermarkMs(), None
        # After a timeout there is a chunk, too, but without rows.
        for pdf in chunks if not state.hasTimedOut else ():
            ahead = {}
            for i, (k, n, ms) in enumerate(zip(pdf["_key"].tolist(), pdf[order].tolist(), pdf["_ms"].tolist())):
                best, until = kept.get(k, (None, now))
                # A NaN is before every number.
                if best is None or n > best or (best != best and n == n):
                    best, ahead[k] = n, i
                kept[k] = best, max(until, ms, now)
            if ahead:
                fresh = pdf.iloc[list(ahead.values())]
                found = fresh if found is None else pd.concat([found[~found["_key"].isin(ahead.keys())], fresh])
        kept = {k: v for k, v in kept.items() if v[1] + 1 >= now}
        if kept:
            state.update((list(kept), [v[0] for v in kept.values()], [v[1] for v in kept.values()]))
            state.setTimeoutTimestamp(min(v[1] for v in kept.values()) + 1)
        elif state.exists:
            state.remove()
        if found is not None:
            yield found[names]

    known = rows.filter(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col(time).isNotNull())
    shared = isinstance(rows.schema[key].dataType, (IntegralType, StringType))
    timed = known.withWatermark(time, delay).withColumns({
        "_ms": F.unix_millis(time), "_key": F.col(key) if shared else F.lit(0),
        "_group": F.pmod(F.xxhash64(key), F.lit(buckets)) if shared else F.col(key)})
    kinds = timed.schema["_key"].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    return timed.groupBy("_group").applyInPandasWithState(
        newest, rows.schema, "key array<{}>, best array<{}>, until array<bigint>".format(*kinds), "update",
        GroupStateTimeout.EventTimeTimeout)


def upsert(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch to a folder of its own that a repeated batch replaces, so that a restart leaves every batch once."""
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return (rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_latest(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """One row per key from what ``upsert`` has written so far."""
    rows = spark.read.option("basePath", path).parquet(path)
    return last_per_key(rows, key, F.struct(order, "batch")).drop("batch")
