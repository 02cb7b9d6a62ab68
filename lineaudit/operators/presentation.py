"""Values behind heat maps, curated examples and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.functions.reducers import z_scores
from lineaudit.sources.sinks import fixed


def heat(energies: Column) -> Column:
    """Per line: z-score, hue from green (120) to red (0), and terminal colour code."""
    def cell(z):
        c = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z))
        t = (c + 2.0) / 4.0
        code = F.when(t < 0.5, 46 + 180 * (t / 0.5)).otherwise(226 - 30 * ((t - 0.5) / 0.5))
        return F.struct(z.alias("z"), (120.0 * (1.0 - t)).alias("hue"), F.floor(code).cast("int").alias("ansi"))

    return F.transform(z_scores(energies), lambda z: let(z, cell))


def html_rows(texts: Column, energies: Column) -> Column:
    """One shaded HTML line per scored line."""
    cells = F.arrays_zip(texts.alias("t"), heat(energies).alias("h"))

    def escaped(s):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            s = F.replace(s, F.lit(a), F.lit(b))
        return s

    return F.transform(cells, lambda c: F.concat(
        # The last digits of a mean differ between engines; the hue is printed from eight decimals, by its binary value.
        F.lit('<div style="background:hsl('), fixed(F.round(c["h"]["hue"], 8), 1), F.lit(',70%,85%)">'),
        escaped(c["t"]), F.lit("</div>")))


def shortest_pair(impls: DataFrame) -> DataFrame:
    """Per spec the shortest failing and the shortest passing implementation; ties by id."""
    size = F.struct(F.size(T.splitlines(F.col("impl_text"))).alias("n"), F.col("impl_id"))
    body = F.struct("impl_id", "impl_text", "spec_text")

    def pick(status):
        hit = F.col("status") == status
        return F.min_by(F.when(hit, body), F.when(hit, size))

    pairs = impls.groupBy("spec_id").agg(pick("FAIL").alias("f"), pick("PASS").alias("p"))
    return pairs.filter("f IS NOT NULL AND p IS NOT NULL")


def corruption_variants(impls: DataFrame) -> DataFrame:
    """Original failure, the same without markers (if that changes it), and a passing sibling."""
    pairs = shortest_pair(impls).withColumn(
        "_cut", T.join_lines(T.strip_line_markers(T.splitlines(F.col("f.impl_text")))))
    variants = F.array(
        F.struct(F.lit("fail_original").alias("kind"), F.col("f.impl_text").alias("impl_text")),
        F.when(F.col("_cut") != F.col("f.impl_text"), F.struct(
            F.lit("fail_marker_stripped").alias("kind"), F.col("_cut").alias("impl_text"))),
        F.struct(F.lit("pass_sibling").alias("kind"), F.col("p.impl_text").alias("impl_text")))
    return pairs.select("spec_id", F.col("f.spec_text").alias("spec_text"), F.inline(
        F.filter(variants, lambda v: v.isNotNull())))


def overlay(variants: DataFrame) -> DataFrame:
    """Lines of the longest variant of each example with every variant's energy for the same text.

    Needs (example, kind, lines, scorable_line_texts, per_line_energies); of
    equal trimmed texts in one variant the last one counts.
    """
    longest = variants.groupBy("example").agg(F.max_by(F.col("lines"), F.struct(F.size("lines"), F.col("kind"))).alias("l"))
    template = longest.select("example", F.posexplode("l").alias("row", "text")).withColumn("t", T.strip(F.col("text")))
    zipped = F.arrays_zip(F.col("scorable_line_texts").alias("t"), F.col("per_line_energies").alias("e"))
    scored = variants.select("example", "kind", F.posexplode(zipped).alias("i", "z"))
    last = scored.groupBy("example", "kind", T.strip(F.col("z.t")).alias("t")).agg(F.max_by("z.e", "i").alias("energy"))
    return template.join(last, ["example", "t"], "left").select("example", "row", "text", "kind", "energy")
