"""Key lookups that stay even when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1024
_SALTS = 4096


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str],
           spread_on: list[str], hot_from: DataFrame | None = None, hot: int = HOT_KEYS) -> DataFrame:
    """Left join of ``rows`` with ``table`` (unique on ``keys``), adding ``values``.

    The most frequent keys of ``rows`` are answered from a broadcast of at most
    ``hot`` rows; their rows are then salted by ``spread_on`` so that they
    spread evenly through the shuffle the other rows need. Any key outside the
    broadcast holds less than 1/hot of the rows. Frequencies may be taken from
    ``hot_from`` where that is cheaper to compute than ``rows`` and has the same
    hot keys; chained lookups should, or each would double the work below it.
    """
    frequent = (rows if hot_from is None else hot_from).groupBy(*keys).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), *keys).limit(hot).select(*keys)
    answers = table.select(*keys, F.struct(*values).alias("_hot_value")).join(F.broadcast(frequent), keys)
    # At most `hot` rows on both sides: `table` is unique on the keys.
    known = frequent.join(F.broadcast(answers), keys, "left").withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(known), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_on), F.lit(_SALTS))).otherwise(F.lit(-1)))
    # Always -1, but no literal: the optimizer turns equality with a literal into a side condition, and
    # the rows would then be dealt by the keys alone.
    cold = table.select(*keys, F.struct(*values).alias("_cold_value")).withColumn(
        "_salt", F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")) - 1)
    out = tagged.join(cold, [*keys, "_salt"], "left")
    picked = F.when(F.col("_hot"), F.col("_hot_value")).otherwise(F.col("_cold_value"))
    return out.withColumns({v: picked[v] for v in values}).select(*rows.columns, *values)


def attach(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join of wide rows with a table (unique on ``keys``) that is usually small, adding ``values``.

    A plain join: the planner measures the table while the query runs, broadcasts a small one so that the wide rows
    stay where they are, and splits skewed partitions of the rows otherwise.
    """
    return rows.join(table.select(*keys, *values), keys, "left").select(*rows.columns, *values)
