"""Running sums along a global order, without a one-task window.

``Window.orderBy`` with no (or a huge) partition moves all rows into one task.
Here the order is cut into many buckets by splitters drawn from the data
itself: the rows whose hash is smallest form a uniform sample, the same sample
on every evaluation, so a retried task cuts the data at the same places. Rows
are shuffled once by bucket; each bucket gets its own window and starts at the
total of the buckets before it, and those totals are a table of one row per
bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaudit.functions.binding import let
from lineaudit.plans.joins import join_null_safe


def splitter_count(df: DataFrame) -> int:
    """Enough buckets that each holds a small share of one shuffle partition."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_buckets(df: DataFrame, by: list[str], order: list[str], n: int | None = None, sample_from: DataFrame | None = None) -> DataFrame:
    """Add ``_bucket``: non-decreasing along (by, order), balanced, at most n+1 values.

    Splitters may be drawn from ``sample_from``, rows with the same keys that are cheaper to compute.
    """
    n = n or splitter_count(df)
    stride = max(1, int(n ** 0.5))
    keys = by + order
    # Hash every column, not just the keys: both branches then need the same
    # input and the exchange below them is computed once and reused.
    drawn = df if sample_from is None else sample_from
    sample = drawn.orderBy(F.xxhash64(*drawn.columns), *keys).limit(n)
    key = F.struct(*[F.col(c) for c in keys])
    splitters = sample.agg(F.sort_array(F.collect_list(key)).alias("_splitters"))
    heads = F.filter("_splitters", lambda s, i: i % stride == 0)
    # One row of at most n small structs, so the broadcast has a fixed bound.
    small = F.broadcast(splitters.withColumn("_heads", heads))

    def body(b):
        block = F.size(F.filter(F.col("_heads"), lambda h: h <= b))
        return let(F.greatest(block - 1, F.lit(0)) * stride, lambda start: start + F.size(
            F.filter(F.slice(F.col("_splitters"), start + 1, stride), lambda s: s <= b)))

    return df.crossJoin(small).withColumn("_bucket", let(key, body)).drop("_splitters", "_heads")


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str],
                 n: int | None = None) -> DataFrame:
    """For each ``name: column`` add ``name`` (sum over the rows strictly before
    this one in its group) and ``name_total`` (sum over the whole group).

    ``order`` must be unique within a group for the result to be defined.
    """
    cut = with_buckets(df, by, order, n)
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    buckets = cut.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    # One row per bucket and group: at most n + number of groups rows.
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    offsets = buckets.select(
        *by, "_bucket",
        *[(F.sum(f"_s_{k}").over(upto) - F.col(f"_s_{k}")).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_s_{k}").over(whole).alias(f"{k}_total") for k in sums])
    joined = join_null_safe(cut, offsets, by + ["_bucket"])
    out = joined
    for k, c in sums.items():
        out = out.withColumn(k, F.col(f"_o_{k}") + F.sum(c).over(in_bucket) - F.col(c))
    return out.drop("_bucket", *[f"_o_{k}" for k in sums])


def tied_sums(df: DataFrame, by: list[str], value: str, rest: list[str], sums: dict[str, str],
              n: int | None = None, sample_from: DataFrame | None = None) -> DataFrame:
    """For each ``name: column`` add ``name_below``, ``name_tied`` and ``name_total``: the column's sum over the rows of
    the group whose value is smaller, over those that share the row's value, and over the whole group.

    Rows are unique on (by, value, rest) and dealt to buckets along that order, so a value of many rows spreads over
    buckets too. Only the first and the last value of a bucket can reach into another one; their sums sit in the table
    of buckets, and nothing is joined on the value itself. NULL is a group and the smallest value.
    """
    cut = with_buckets(df, by, [value, *rest], n, sample_from)
    here = [*by, "_bucket"]
    upto = Window.partitionBy(*here).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*here, value)
    rows = cut
    for k, c in sums.items():
        rows = rows.withColumns({f"_t_{k}": F.sum(c).over(peers), f"_u_{k}": F.sum(c).over(upto)})
    tied = F.struct(*[f"_t_{k}" for k in sums])
    buckets = rows.groupBy(*here).agg(
        # Inside a struct NULL is the smallest value, not a missing one.
        F.min(F.struct(value)).alias("_first"), F.max(F.struct(value)).alias("_last"),
        F.min_by(tied, F.struct(value)).alias("_tf"), F.max_by(tied, F.struct(value)).alias("_tl"),
        *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    # One row per bucket and group, two below: at most twice n + number of groups rows.
    line = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = buckets.withColumns({f"_o_{k}": F.sum(f"_s_{k}").over(line) - F.col(f"_s_{k}") for k in sums} | {
        f"{k}_total": F.sum(f"_s_{k}").over(Window.partitionBy(*by)) for k in sums})
    first = F.struct(F.lit(0).alias("_end"), F.col("_first").alias("_edge"), F.col("_tf").alias("_t"))
    last = F.struct(F.lit(1).alias("_end"), F.col("_last").alias("_edge"), F.col("_tl").alias("_t"))
    edges = buckets.select("*", F.inline(F.when(F.col("_first") == F.col("_last"), F.array(first)).otherwise(F.array(first, last))))
    same = Window.partitionBy(*by, "_edge")
    before = same.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.select(*here, "_end", "_edge", *[c for k in sums for c in (
        F.col(f"_o_{k}"), F.col(f"{k}_total"), F.sum(f"_t._t_{k}").over(same).alias(f"_all_{k}"),
        (F.sum(f"_t._t_{k}").over(before) - F.col(f"_t._t_{k}")).alias(f"_gone_{k}"))])
    ends = edges.groupBy(*here).agg(
        *[F.max(c).alias(c) for k in sums for c in (f"_o_{k}", f"{k}_total")],
        *[F.max(F.when(F.col("_end") == e, F.struct("_edge", *[f"_{w}_{k}" for k in sums for w in ("all", "gone")]))).alias(f"_e{e}")
          for e in (0, 1)])
    out = join_null_safe(rows, ends, here)
    own = F.struct(value)
    edge = F.when(own == F.col("_e0._edge"), F.col("_e0")).when(own == F.col("_e1._edge"), F.col("_e1"))
    out = out.withColumn("_edge", edge)
    for k in sums:
        gone = F.coalesce(F.col(f"_edge._gone_{k}"), F.lit(0))
        out = out.withColumns({
            f"{k}_below": F.col(f"_o_{k}") + F.col(f"_u_{k}") - F.col(f"_t_{k}") - gone,
            f"{k}_tied": F.coalesce(F.col(f"_edge._all_{k}"), F.col(f"_t_{k}"))})
    return out.select(*df.columns, *[f"{k}_{w}" for k in sums for w in ("below", "tied", "total")])


def row_positions(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """0-based position of each row in its group's order, and ``<name>_total``."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("long")), by, order, {name: "_one"}).drop("_one")


def order_statistics(df: DataFrame, by: list[str], value: str, cuts: dict[str, Column], weight: str | None = None) -> DataFrame:
    """Exact order statistics: one row per group, one column per cut.

    A cut is a 0-based position given as a function of ``n`` (the group's row
    count), e.g. ``floor(n/2)``. Values are counted before they are ordered, so
    a value shared by most rows is one row here. With ``weight`` a row stands for that many rows.
    """
    many = F.count("*") if weight is None else F.sum(weight)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(many.alias("_c"))
    run = running_sums(counted, by, [value], {"_before": "_c"}).withColumnRenamed("_before_total", "n")
    picks = [
        F.max(F.when((F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_c")), F.col(value))).alias(name)
        for name, pos in cuts.items()]
    return run.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def halo_chunks(df: DataFrame, by: list[str], order: list[str], width: int, chunk: int = 100_000) -> DataFrame:
    """Cut each group's order into chunks that overlap by ``width`` rows.

    A window over (by, _chunk) then sees all ``width`` predecessors of every
    row with ``_own`` set, while no task holds more than one chunk of a group.
    """
    chunk = max(chunk, width)
    placed = row_positions(df, by, order).withColumn("_home", F.floor(F.col("position") / chunk))
    near_end = F.col("position") % chunk >= chunk - width
    copies = F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))
    return placed.withColumn("_chunk", F.explode(copies)).withColumn("_own", F.col("_chunk") == F.col("_home"))
