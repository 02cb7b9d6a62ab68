"""How much of one corpus can be found in another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import ranking as R
from lineaudit.functions import text as T
from lineaudit.functions.binding import let
from lineaudit.operators import metrics as M
from lineaudit.plans.skew import attach


def line_key(line: Column) -> Column:
    """Fixed-width stand-in for a line in shuffles."""
    return F.unhex(F.sha2(F.encode(line, "UTF-8"), 256))


def _lines(df: DataFrame) -> Column:
    return T.splitlines(F.col("impl_text"))


def train_code_keys(train: DataFrame) -> DataFrame:
    """Distinct keys of the scorable lines, stripped and their comment cut."""
    lines = train.select(F.explode(F.array_distinct(T.scorable_texts(_lines(train)))).alias("l"))
    return lines.select(line_key(T.normalize_line(F.col("l"))).alias("key")).distinct().withColumn("in_train", F.lit(True))


def _text_keys(df: DataFrame) -> Column:
    """(kind, key) of an implementation's squeezed spec and text."""
    return F.array(*[F.struct(F.lit(kind).alias("kind"), F.encode(T.squeeze_hash(F.col(c), 16), "UTF-8").alias("key"))
                     for kind, c in (("spec", "spec_text"), ("impl", "impl_text"))])


def _code_keys(line: Column) -> Column:
    return F.array(
        F.struct(F.lit("raw").alias("kind"), line_key(T.strip(line)).alias("key")),
        F.struct(F.lit("code").alias("kind"), line_key(T.normalize_line(line)).alias("key")))


def _overlap(train: DataFrame, target: DataFrame) -> DataFrame:
    """Per target implementation: is its spec and its text known, and how many lines and labelled lines are.

    Texts and lines of both sides are keyed in one pass each and meet in one join; a line every implementation
    holds is a skewed partition of it, which the planner splits.
    """
    lines = F.flatten(F.transform(F.array_distinct(T.scorable_texts(_lines(train))), _code_keys))
    known = train.select(F.inline(F.concat(_text_keys(train), F.array_distinct(lines)))).distinct().withColumn("in_train", F.lit(True))

    buggy = F.when(F.col("status") == "FAIL", F.col("buggy_lines"))

    def of_line(x, i, b):
        site = F.coalesce(F.array_contains(b, i), F.lit(False))
        return F.transform(_code_keys(x), lambda k: F.struct(
            k["kind"].alias("kind"), k["key"].alias("key"), T.is_scorable(x).alias("s"), site.alias("site")))

    flagged = let(buggy, lambda b: F.flatten(F.transform(_lines(target), lambda x, i: of_line(x, i, b))))
    wanted = F.filter(flagged, lambda k: k["site"] | (k["s"] & (k["kind"] == "raw")))
    whole = F.transform(_text_keys(target), lambda k: F.struct(
        k["kind"].alias("kind"), k["key"].alias("key"), F.lit(False).alias("s"), F.lit(False).alias("site")))
    rows = target.select("impl_id", "status", F.size("buggy_lines").alias("n_b"), F.inline(F.concat(whole, F.coalesce(wanted, F.array()))))
    found = attach(rows, known, ["kind", "key"], ["in_train"])
    kind, hit = F.col("kind"), F.coalesce("in_train", F.lit(False))
    n = F.count_if((kind == "raw") & F.col("s"))
    out = found.groupBy("impl_id", "status", "n_b").agg(
        F.bool_or((kind == "spec") & hit).alias("spec_in_train"), F.bool_or((kind == "impl") & hit).alias("impl_in_train"),
        n.alias("n_scorable"), F.count_if((kind == "raw") & F.col("s") & hit).alias("n_known"),
        F.count_if((kind == "raw") & F.col("site")).alias("n_sites"),
        F.count_if((kind == "raw") & F.col("site") & hit).alias("sites_raw"),
        F.count_if((kind == "code") & F.col("site") & hit).alias("sites_code"))
    # Implementations without a scorable line have no share, and their sites do not count.
    some = F.col("n_scorable") > 0
    return out.withColumns({"overlap": F.when(some, F.col("n_known") / F.col("n_scorable"))} | {
        c: F.when(some, F.col(c)) for c in ("n_sites", "sites_raw", "sites_code")})


def leak_audit(train: DataFrame, target: DataFrame) -> DataFrame:
    """One row of overlap counts and shares. Shares are over all target records,
    the mean line overlap over those with scorable lines. Ids are unique in the target."""
    per = _overlap(train, target)
    labelled = (F.col("status") == "FAIL") & (F.col("n_b") > 0) & F.col("overlap").isNotNull()
    out = per.agg(
        F.count("*").alias("n"), F.count_if("spec_in_train").alias("spec_overlap"),
        F.count_if("impl_in_train").alias("impl_overlap"), F.avg("overlap").alias("mean_line_overlap"),
        F.count_if(F.col("overlap") >= 0.5).alias("n_overlap_50"),
        F.count_if(F.col("overlap") >= 0.9).alias("n_overlap_90"),
        F.count_if(labelled).alias("n_labelled"), F.sum("n_sites").alias("n_sites"),
        F.sum("sites_raw").alias("sites_exact"), F.sum("sites_code").alias("sites_without_comment"))
    pct = {f"{c}_pct": 100 * F.col(c) / F.greatest(F.col("n"), F.lit(1))
           for c in ("spec_overlap", "impl_overlap", "n_overlap_50", "n_overlap_90")}
    site = {f"{c}_pct": 100 * F.col(c) / F.greatest(F.col("n_sites"), F.lit(1))
            for c in ("sites_exact", "sites_without_comment")}
    return out.withColumns({**pct, **site})


def report(audit: DataFrame) -> DataFrame:
    """The audit as text lines."""
    def line(label, count, total, pct):
        return F.format_string(f"{label}: %d/%d (%.1f%%)", F.col(count), F.col(total), F.col(pct))

    return audit.select(F.explode(F.array(
        line("spec text overlap", "spec_overlap", "n", "spec_overlap_pct"),
        line("impl text overlap", "impl_overlap", "n", "impl_overlap_pct"),
        F.format_string("mean line overlap: %.3f", "mean_line_overlap"),
        line("records with at least half of their lines known", "n_overlap_50", "n", "n_overlap_50_pct"),
        line("records with at least 90%% of their lines known", "n_overlap_90", "n", "n_overlap_90_pct"),
        line("labelled sites known verbatim", "sites_exact", "n_sites", "sites_exact_pct"),
        line("labelled sites known without comments", "sites_without_comment", "n_sites",
             "sites_without_comment_pct"))).alias("line"))


def deep_leak_audit(train: DataFrame, records: DataFrame) -> DataFrame:
    """Is the predicted (or the labelled) line known more often when the record is a hit?"""
    texts, order = F.col("scorable_line_texts"), F.col("_order")
    rows = M.with_order(M.aligned(records))
    rows = rows.withColumn("_labels", R.in_range(F.col("buggy_line_indices"), F.size(texts)))
    rows = rows.select(
        "impl_id", R.hit(order, F.col("buggy_line_indices"), 1).alias("hit1"),
        R.hit(order, F.col("buggy_line_indices"), 3).alias("hit3"),
        F.explode(F.concat(
            F.array(F.struct(F.lit(True).alias("top"), F.get(texts, F.get(order, 0)).alias("l"))),
            F.transform("_labels", lambda i: F.struct(F.lit(False).alias("top"), F.get(texts, i).alias("l")))))
        .alias("x"))
    rows = rows.select("impl_id", "hit1", "hit3", F.col("x.top").alias("top"), line_key(T.normalize_line(F.col("x.l"))).alias("key"))
    found = attach(rows, train_code_keys(train), ["key"], ["in_train"])
    known = F.coalesce("in_train", F.lit(False))
    per = found.groupBy("impl_id", "hit1", "hit3").agg(
        F.max(F.col("top") & known).alias("top_known"), F.max(~F.col("top") & known).alias("label_known"))
    cells = per.select(F.inline(F.array(
        F.struct(F.lit(1).alias("k"), F.col("hit1").alias("hit"), F.col("top_known").cast("int").alias("t"),
                 F.col("label_known").cast("int").alias("g")),
        F.struct(F.lit(3).alias("k"), F.col("hit3").alias("hit"), F.lit(None).cast("int").alias("t"),
                 F.col("label_known").cast("int").alias("g")))))
    return cells.groupBy("k", "hit").agg(
        F.count("*").alias("n"), F.avg("t").alias("top1_in_train"), F.avg("g").alias("label_in_train"))


def held_set_audit(train: DataFrame, held: DataFrame) -> DataFrame:
    """Duplicates between the two sides of a split, as (check, count) rows."""
    spec, impl = T.squeeze_hash(F.col("spec_text")), T.squeeze_hash(F.col("impl_text"))
    keys = {"spec_hash": spec, "spec_id": F.col("spec_id"), "spec_text": F.sha2(F.encode("spec_text", "UTF-8"), 256), "impl_hash": impl}

    def keyed(df, c, t):
        pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), k.cast("string").alias("k")) for kind, k in keys.items()])
        return df.select(F.inline(pairs), F.lit(c).alias("c"), F.lit(t).alias("t")).filter("k IS NOT NULL")

    # Each side is read once; a key of many rows collapses before the shuffle.
    both = keyed(held, 1, False).unionByName(keyed(train, 0, True)).groupBy("kind", "k").agg(F.sum("c").alias("c"), F.bool_or("t").alias("t"))
    shared = both.agg(*[F.struct(F.count_if(here).alias("n"), F.coalesce(F.sum(F.when(here, F.col("c"))), F.lit(0)).alias("rows")).alias(kind)
                        for kind in keys for here in [(F.col("kind") == kind) & F.col("t") & (F.col("c") > 0)]])
    # Overlaps are distinct keys, near duplicates are held rows.
    checks = {"spec_hash_overlap": "spec_hash.n", "spec_id_overlap": "spec_id.n", "spec_text_duplicates": "spec_text.n",
              "spec_near_duplicates": "spec_hash.rows", "impl_near_duplicates": "impl_hash.rows"}
    return shared.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(c).alias("n")) for name, c in checks.items()])))


def composition(examples: DataFrame, keys=("source", "status")) -> DataFrame:
    return examples.groupBy(*keys).agg(F.count("*").alias("n"))
