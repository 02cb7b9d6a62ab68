"""Mixing sources to target weights along a curriculum that changes over time, as columns only.

Every source has a weight curve over training time 0..1, linear between its knots. The area under the curve is the
source's weight in the whole mix: the targets share the mix by area, no source gives more than ``MOST`` times its size,
and what capped sources leave is shared again by weight among the others. A source's documents, in the order of a
digest, form an endless stream of which the first ``target`` words are taken. The word at offset x is due when the
area under the curve so far is x / target of the whole area; that time is the position of a pass over a
document, found by inverting the curve's integral. Sorted by position the passes are the training order.

Only ids, sizes and digests are ranked. The stream of a source is cut into many buckets (``ordered.running_sums``),
so a source that holds a third of the rows is spread over tasks, and rows that are equal count as one with a number.

Null texts, empty and blank texts have no words: they are planned with size 0 and never taken. A null source is a
source of its own, the last one. Rows without an id and rows that repeat are documents like any other. A source
without words has the target 0; an empty table gives no rows. Other columns are ignored by ``planned``
and carried by ``mixed``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions.binding import let
from lineaudit.llm.common import settle
from lineaudit.plans import ordered

#: Largest number of passes over a document.
MOST = 3
#: Curves dealt to the sources in turn, as (time, weight) knots. Their areas are 5, 2 and 1: the first source of each
#: three leads early, the last one is kept for the end, and the three weights add up to 8 at any time.
CURVES = (((0.0, 5.5), (1.0, 4.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))

_KNOT = "array<struct<at: double, weight: double, slope: double, area: double>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _curve(knots) -> Column:
    """A curve as a literal: each piece with its start, weight there, slope and the area before it; the last piece is
    the end point, whose area is the whole one."""
    pieces, area = [], 0.0
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1:
        raise ValueError(f"a curve runs from time 0 to time 1: {knots}")
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        if t1 <= t0 or w0 < 0 or w1 < 0:
            raise ValueError(f"a curve has ascending times and no negative weights: {knots}")
        pieces.append((t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (w0 + w1) / 2 * (t1 - t0)
    pieces.append((1.0, knots[-1][1], 0.0, area))
    return F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("at", "weight", "slope", "area"), p)]) for p in pieces]).cast(_KNOT)


def due(curve: Column, share: Column) -> Column:
    """The time at which ``share`` (0 to 1) of the area under ``curve`` is reached."""
    def inside(piece: Column, u: Column) -> Column:
        # weight * s + slope / 2 * s^2 = u, solved without cancellation.
        root = F.sqrt(piece["weight"] * piece["weight"] + 2 * piece["slope"] * u)
        return piece["at"] + F.when(u > 0, 2 * u / (piece["weight"] + root)).otherwise(0.0)

    def place(y: Column) -> Column:
        return let(F.element_at(F.filter(curve, lambda p: p["area"] <= y), -1), lambda p: inside(p, y - p["area"]))

    return let(share * F.element_at(curve, -1)["area"], place)


def targets(sizes: DataFrame, curves=CURVES, most: int = MOST) -> DataFrame:
    """(source, source_size, target, quota, curve) per source from ``sizes(source, source_size)``.

    ``curves`` is a tuple of knot lists dealt to the sources by code point, null last, or a dictionary from source
    to knots; a source that it leaves out gets nothing. ``quota`` is the target in whole words.
    """
    rows = sizes.select("source", F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), "source_size")
    if isinstance(curves, dict):
        curve = F.lit(None).cast(_KNOT)
        for name, knots in curves.items():
            curve = F.when(F.col("source").eqNullSafe(F.lit(name)), _curve(knots)).otherwise(curve)
        rows = rows.withColumn("curve", curve)
    else:
        turn = ordered.row_positions(rows, [], ["_none", "_name"], "_at")
        picks = F.array(*map(_curve, curves))
        rows = turn.withColumn("curve", F.get(picks, F.pmod(F.col("_at"), F.lit(len(curves))).cast("int"))).drop("_at", "_at_total")
    rows = rows.withColumn("weight", F.coalesce(F.element_at("curve", -1)["area"], F.lit(0.0)))
    rows = rows.withColumn("cap", F.when(F.col("weight") > 0, most * F.col("source_size")).otherwise(0))
    rows = settle(rows.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(0.0)))
    # Water level: sources fill up in the order of cap / weight. The level is right from the first source on that it
    # does not fill; behind it, sources are counted as full that are not, and the level only falls.
    filled = ordered.running_sums(rows, [], ["ratio", "_none", "_name"], {"_caps": "cap", "_weights": "weight"})
    total = rows.agg(F.sum("source_size").alias("_total"))
    level = filled.crossJoin(F.broadcast(total)).withColumn(
        "_level", (F.col("_total") - F.col("_caps")) / F.when(F.col("_weights_total") > F.col("_weights"), F.col("_weights_total") - F.col("_weights"))).where(
        F.col("_level") <= F.col("ratio")).agg(F.max("_level").alias("_level"))
    target = F.when(F.col("weight") == 0, 0.0).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("cap").cast("double"))))
    out = rows.crossJoin(F.broadcast(level)).withColumn("target", target)
    return out.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("bigint").alias("quota"), "curve")


def _passes(rows: DataFrame) -> DataFrame:
    """Add ``taken`` and ``passes`` (array of words and position) to rows with start, size, source_size, quota and curve."""
    def one(k: Column) -> Column:
        begin = k * F.col("source_size") + F.col("start")
        return F.struct(F.least(F.col("size"), F.col("quota") - begin).alias("words"),
                        due(F.col("curve"), begin / F.col("quota")).alias("position"))

    # The passes whose first word lies below the quota.
    n = F.when((F.col("size") > 0) & (F.col("start") < F.col("quota")), F.floor((F.col("quota") - F.col("start") - 1) / F.col("source_size")) + 1).otherwise(0)
    many = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), one)).otherwise(
        F.expr("cast(array() as array<struct<words: bigint, position: double>>)"))
    return rows.withColumn("passes", many).withColumn("taken", F.aggregate("passes", F.lit(0).cast("bigint"), lambda s, p: s + p["words"]))


def _placed(narrow: DataFrame, order: list[str], curves, most: int, seed: str) -> DataFrame:
    """One row per document of ``narrow(source, size, *order)`` with its place in its source's stream and its passes."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]).cast("binary"))
    counted = settle(narrow.groupBy("source", *order, "size").agg(F.count("*").alias("copies")).withColumn("_h", digest).withColumn(
        "_words", F.col("size") * F.col("copies")))
    goal = settle(targets(counted.groupBy("source").agg(F.sum("_words").alias("source_size")), curves, most))
    stream = ordered.running_sums(counted, ["source"], ["_h", *order, "size"], {"_before": "_words"}).drop("_before_total")
    each = stream.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).withColumn(
        "start", F.col("_before") + (F.col("_copy") - 1) * F.col("size"))
    named = goal.withColumnRenamed("source", "_source")
    return _passes(each.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_before", "_words", "_h"))


def planned(docs: DataFrame, curves=CURVES, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, position) for every row of ``docs``, sorted by position.

    ``passes`` lists words and training position of every pass over the document. The document at which a source's
    demand ends is taken as far as the demand goes, so a source's words are its target rounded to whole words.
    ``position`` is that of the first pass, null if the document is not taken.
    """
    narrow = docs.select("source", F.col("doc_id"), word_count(F.col("text")).alias("size"))
    rows = _placed(narrow, ["doc_id"], curves, most, seed)
    out = rows.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", F.get("passes", F.lit(0))["position"].alias("position"))
    return out.orderBy(F.asc_nulls_last("position"), "source", "doc_id", "size")


def mixed(docs: DataFrame, curves=CURVES, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(row, words, pass, position) in training order: one row per pass, ``row`` being the document's own columns.

    Documents are told apart by a digest of the whole row; rows alike in every column travel once with their number.
    """
    whole = F.struct(*docs.columns)
    rows = docs.select(F.coalesce("source", F.lit(None).cast("string")).alias("source"), word_count(F.col("text")).alias("size"), whole.alias("row"))
    keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct("row"), {"ignoreNullFields": "false"}), 256))
    plan = _placed(keyed.select("source", "key", "size"), ["key"], curves, most, seed)
    taken = plan.where("taken > 0").select("key", F.posexplode("passes").alias("pass", "_p")).select(
        "key", "pass", F.col("_p.words").alias("words"), F.col("_p.position").alias("position"))
    texts = keyed.groupBy("key").agg(F.first("row").alias("row"))
    return texts.join(taken, "key").select("row", "words", "pass", "position", "key").orderBy("position", "key").drop("key")
