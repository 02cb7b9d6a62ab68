"""Bottom-k sketches of word shingles, as columns only.

A sketch is the sorted array of the ``K`` smallest 64-bit hashes of a text's distinct
shingles of ``SHINGLE`` words (a shorter text is one shingle; null, empty and blank texts
have an empty sketch). Sketches of parts merge into the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaudit.functions.binding import let
from lineaudit.plans.ordered import splitter_count

K = 128
SHINGLE = 5


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def smallest(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0)))
        return F.slice(F.sort_array(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(h, i + 1, shingle))))), 1, k)

    return let(hashes, lambda h: F.when(F.size(h) > 0, smallest(h)).otherwise(F.expr("cast(array() as array<bigint>)")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches; 1 for two empty ones, 0 if only one is empty."""
    def share(union: Column) -> Column:
        return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)

    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        let(F.slice(F.sort_array(F.array_union(a, b)), 1, k), share))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    def share(j: Column) -> Column:
        return F.least(F.lit(1.0), j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k)) / distinct_shingles(a, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(let(resemblance(a, b, k), share))


def merged(parts: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group of ``by``. Tasks keep their k smallest values of a group before anything
    is shuffled, so a group of any size meets as k values per task. Null groups are groups."""
    values = parts.select(*by, F.explode(column).alias("_v")).distinct()
    top = values.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_v"))).where(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias(column))


def printed(a: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits per hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def ranged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, range, guest): the ascending order of ids cut into ranges, and in each range the row that follows it.

    The order is cut by splitters, ids of the table chosen by digest. A splitter opens its range, so
    the only row a range needs from elsewhere is the next splitter's: that row goes to both ranges
    (``guest`` 1), the smallest id also behind the last range (``guest`` 2), and texts move once.
    Rows without an id have no place in the order; they get ranges below 0 by digest.
    """
    n = splitter_count(docs)
    ids = docs.where("doc_id is not null").select("doc_id").distinct()
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    # One row of at most n ids and the smallest id.
    cuts = chosen.agg(F.sort_array(F.collect_list("doc_id")).alias("_cuts")).crossJoin(
        F.broadcast(docs.agg(F.min("doc_id").alias("_first"))))
    stride = max(1, int(n ** 0.5))
    cuts = cuts.withColumn("_heads", F.filter("_cuts", lambda s, i: i % stride == 0))
    rows = docs.select("doc_id", "text").crossJoin(F.broadcast(cuts))

    def home(x: Column) -> Column:
        block = F.size(F.filter(F.col("_heads"), lambda h: h <= x))
        return let(F.greatest(block - 1, F.lit(0)) * stride, lambda start: start + F.size(
            F.filter(F.slice(F.col("_cuts"), start + 1, stride), lambda s: s <= x)))

    own = F.struct(F.col("_home").alias("range"), F.lit(0).alias("guest"))
    before = F.when((F.col("_home") > 0) & (F.element_at("_cuts", F.greatest(F.col("_home"), F.lit(1))) == F.col("doc_id")),
                    F.array(F.struct((F.col("_home") - 1).alias("range"), F.lit(1).alias("guest"))))
    around = F.when(F.col("doc_id") == F.col("_first"), F.array(F.struct(F.size("_cuts").alias("range"), F.lit(2).alias("guest"))))
    none = F.expr("cast(array() as array<struct<range: int, guest: int>>)")
    rows = rows.withColumn("_home", F.when(
        F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(4096)).cast("int")).otherwise(home(F.col("doc_id"))))
    rows = rows.withColumn("_at", F.explode(F.concat(F.array(own), F.coalesce(before, none), F.coalesce(around, none))))
    return rows.select("doc_id", "text", F.col("_at.range").alias("range"), F.col("_at.guest").alias("guest"))


def edited_pairs(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles) per row.

    The next document is that of the next id, after the last the first; rows with equal ids follow each other by
    text; a row without an id has an empty next text. The edited text has its last floor(n / 2) code points replaced
    by as many first ones of the next document, or all if it has fewer.
    """
    by = Window.partitionBy("range").orderBy("guest", "doc_id", "text")
    placed = F.col("doc_id").isNotNull()
    rows = ranged(docs).withColumn("next_text", F.when(placed, F.lead("text").over(by)))
    text, after = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("next_text"), F.lit(""))
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))
    rows = rows.select("doc_id", "range", "guest", "text", n.cast("bigint").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("doc_id", "range", "guest", "n_chars", "text", F.sha2("edited", 256).alias("edited_sha256"),
                       sketch(F.col("text"), k).alias("s"), F.when(F.col("guest") == 0, sketch(F.col("edited"), k)).alias("e"))
    # The same ranges in the same order: no further exchange.
    rows = rows.withColumn("t", F.when(placed, F.lead("s").over(by)).otherwise(F.expr("cast(array() as array<bigint>)")))
    return rows.where("guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("s")).alias("fingerprint"), printed(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("t"), k).alias("near_next"),
        F.round(distinct_shingles(F.col("s"), k)).cast("bigint").alias("n_shingles"))
