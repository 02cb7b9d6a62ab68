"""Evaluation records from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineaudit import schemas
from lineaudit.functions import status as ST

_ORDER = "_file_order"


def with_file_order(df: DataFrame) -> DataFrame:
    """Add a sortable position: file, block within the file, row within the block."""
    return df.withColumn(_ORDER, F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def read_records(spark: SparkSession, path, dialect=ST.verbatim) -> DataFrame:
    """JSON lines with a fixed schema; blank lines vanish, the status is normalized."""
    raw = spark.read.schema(schemas.EVAL_RECORD).json(path)
    return raw.withColumn("status", dialect(F.col("status")))


def read_keyed_records(spark: SparkSession, path, dialect=ST.verbatim) -> DataFrame:
    """As above, keeping the last record of each ``impl_id`` in file order."""
    raw = with_file_order(spark.read.schema(schemas.EVAL_RECORD).json(path))
    rows = raw.withColumn("status", dialect(F.col("status")))
    return last_per_key(rows, "impl_id", F.col(_ORDER)).drop(_ORDER)


def last_per_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Last row per key by aggregation, so repeats of a hot key fold before the shuffle."""
    others = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return picked.select(key, "_r.*")


def read_examples(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.EXAMPLE).json(path)


def read_history(spark: SparkSession, path) -> DataFrame:
    """Training and evaluation history in step order; a zero step counts as missing."""
    raw = spark.read.schema(schemas.HISTORY).json(path)
    step = F.coalesce(F.nullif(F.col("`train/step`"), F.lit(0)), F.nullif(F.col("_step"), F.lit(0)), F.lit(0))
    return raw.withColumn("step", step).orderBy("step")


def read_points(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.IMPL_POINT).parquet(path)


def key_census(spark: SparkSession, path, n: int | None = None) -> DataFrame:
    """How many rows carry each JSON key; with ``n`` a preview of the first n rows."""
    rows = spark.read.text(path)
    return census(rows if n is None else rows.limit(n), "value")


def census(rows: DataFrame, column: str) -> DataFrame:
    keys = rows.select(F.explode(F.json_object_keys(column)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))
