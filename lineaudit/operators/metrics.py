"""Ranking quality of evaluation records.

Line-level work happens inside the row (arrays); what reaches a shuffle is a
handful of numbers per record, pre-aggregated on the map side. Global ranks go
through the bucketed running sums, never through one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineaudit.functions import ranking as R
from lineaudit.functions import reducers as A
from lineaudit.plans.joins import join_groups
from lineaudit.plans.ordered import running_sums, with_buckets
from lineaudit.session import stable


def _e() -> Column:
    return F.col("per_line_energies")


def _b() -> Column:
    return F.col("buggy_line_indices")


def _n(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def labelled_fail(records: DataFrame) -> DataFrame:
    return records.filter((F.col("status") == "FAIL") & (_n(_b()) > 0) & (_n(_e()) > 0))


def labelled_fail_loose(records: DataFrame) -> DataFrame:
    """Keeps records without energies: they count as misses."""
    return records.filter((F.col("status") == "FAIL") & (_n(_b()) > 0))


def aligned(records: DataFrame) -> DataFrame:
    return labelled_fail(records).filter(_n(F.col("scorable_line_texts")) == _n(_e()))


def with_order(records: DataFrame) -> DataFrame:
    return records.withColumn("_order", R.rank_order(_e()))


# -- top-k recall -------------------------------------------------------------

def topk_recall(records: DataFrame, ks=(1, 3, 5), by: list[str] | None = None) -> DataFrame:
    """Recall, uniform expectation and lift per k over labelled failing records."""
    by = by or []
    # Records whose labels all fall outside the line range can still miss, but
    # carry no uniform expectation; the two averages have their own denominators.
    rows = with_order(labelled_fail(records)).withColumn("_b", _n(R.in_range(_b(), F.size(_e()))))
    rows = rows.select(*by, F.inline(F.array(*[F.struct(
        F.lit(k).alias("k"),
        R.hit(F.col("_order"), _b(), k).cast("int").alias("hit"),
        F.when(F.col("_b") > 0, R.uniform_hit_probability(F.size(_e()), F.col("_b"), k)).alias("u"),
    ) for k in ks])))
    out = rows.groupBy(*by, "k").agg(
        F.avg("hit").alias("recall"), F.count("hit").alias("n"), F.avg("u").alias("uniform"))
    return out.withColumn("lift", F.try_divide(F.col("recall"), F.nullif(F.col("uniform"), F.lit(0.0))))


def audit_recall(records: DataFrame, ks=(1, 3, 5), by: list[str] | None = None) -> DataFrame:
    """Recall with energy-less records left in the denominator."""
    by = by or []
    rows = with_order(labelled_fail_loose(records))
    hits = rows.select(*by, F.inline(F.array(*[F.struct(
        F.lit(k).alias("k"), F.coalesce(R.hit(F.col("_order"), _b(), k), F.lit(False)).cast("int").alias("hit"))
        for k in ks])))
    return hits.groupBy(*by, "k").agg((F.sum("hit") / F.count("*")).alias("recall"), F.count("*").alias("n_fail"))


def marker_audit(with_markers: DataFrame, stripped: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Does recall depend on marker comments? One row per k, verdict from k=1."""
    both = with_markers.withColumn("_v", F.lit("w")).unionByName(stripped.withColumn("_v", F.lit("s")))
    wide = audit_recall(both, ks, ["_v"]).groupBy("k").agg(
        F.max(F.when(F.col("_v") == "w", F.col("recall"))).alias("with_markers"),
        F.max(F.when(F.col("_v") == "s", F.col("recall"))).alias("stripped"),
        F.max(F.when(F.col("_v") == "w", F.col("n_fail"))).alias("n_fail"))
    wide = wide.withColumn("delta", F.col("with_markers") - F.col("stripped"))
    # len(ks) rows by now: a window over all of them is a window over a handful.
    d1 = F.max(F.when(F.col("k") == 1, F.col("delta"))).over(Window.partitionBy())
    return wide.withColumn(
        "verdict",
        F.when(F.abs(d1) <= 0.05, "marker-INVARIANT").when(d1 > 0, "marker-RELIANT")
        .when(d1.isNotNull(), "marker-AVERSE"))


# -- whole-implementation separation ----------------------------------------------

def auroc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties at one half: ``auc, n_pos, n_neg`` per group.

    Rows with a NULL ``positive`` are left out. Rows are first counted per
    distinct score, so ties, however heavy, collapse before the ordered shuffle.
    """
    by = by or []
    counted = (
        df.withColumn("_p", positive).filter(F.col("_p").isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("_score"))
        .agg(F.count_if("_p").alias("p"), F.count_if(~F.col("_p")).alias("n")))
    cut = with_buckets(counted, by, ["_score"])
    upto = Window.partitionBy(*by, "_bucket").orderBy("_score").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inner = cut.withColumn("_wins", F.col("p") * (F.sum("n").over(upto) - F.col("n") * 0.5))
    buckets = inner.groupBy(*by, "_bucket").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("_wins").alias("wins"))
    # One row per bucket and group from here on.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = buckets.withColumn("wins", F.col("wins") + F.col("p") * (F.sum("n").over(before) - F.col("n")))
    out = total.groupBy(*by).agg(
        F.sum("wins").alias("_w"), F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"))
    return out.select(
        *by, F.try_divide(F.col("_w"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def fail_label(unknown_as_pass: bool = False) -> Column:
    """TRUE for FAIL, FALSE for PASS; UNKNOWN is NULL or, if asked, a PASS."""
    s = F.col("status")
    if unknown_as_pass:
        return s == "FAIL"
    return F.when(s == "FAIL", True).when(s == "PASS", False)


def within_spec_ranking(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of specs whose worst PASS scores strictly below the best FAIL."""
    by = by or []
    w = F.col("whole_impl_energy")
    specs = records.groupBy(*by, "spec_id").agg(
        F.max(F.when(F.col("status") == "PASS", w)).alias("p"),
        F.min(F.when(F.col("status") == "FAIL", w)).alias("f"))
    both = specs.filter(F.col("p").isNotNull() & F.col("f").isNotNull())
    return both.groupBy(*by).agg(
        F.avg((F.col("p") < F.col("f")).cast("int")).alias("accuracy"), F.count("*").alias("n_specs"))


def slim(records: DataFrame, by: list[str], ks=(1, 3)) -> DataFrame:
    """One narrow row per record, written once: the metrics below read it several
    times, the texts and energy arrays behind it are read a single time."""
    labelled = (F.col("status") == "FAIL") & (_n(_b()) > 0) & (_n(_e()) > 0)
    order = F.when(labelled, R.rank_order(_e()))
    rows = records.select(
        *by, "spec_id", "status", "whole_impl_energy", F.col("buggy_line_indices").alias("_l"), order.alias("_o"))
    return stable(rows.select(*by, "spec_id", "status", "whole_impl_energy", *[
        R.hit(F.col("_o"), F.col("_l"), k).cast("int").alias(f"hit{k}") for k in ks]))


def eval_bundle(records: DataFrame, by: list[str]) -> DataFrame:
    """All headline metrics, one row per group."""
    rows = slim(records, by)
    w, s = F.col("whole_impl_energy"), F.col("status")
    basic = rows.groupBy(*by).agg(
        F.count("*").alias("n_impls"),
        F.avg(F.when(s == "PASS", w)).alias("mean_pass"),
        F.avg(F.when(s == "FAIL", w)).alias("mean_fail"),
        F.stddev_pop(F.when(s.isin("PASS", "FAIL"), w)).alias("std_energy"),
        F.avg("hit1").alias("per_line_top1"), F.avg("hit3").alias("per_line_top3"),
        F.count("hit1").alias("n_with_labels"))
    area = auroc(rows, "whole_impl_energy", fail_label(), by)
    rank = within_spec_ranking(rows, by)
    return (join_groups(join_groups(basic, area, by, "left"), rank, by, "left")
            .withColumnRenamed("n_pos", "n_fail").withColumnRenamed("n_neg", "n_pass"))


def reducer_sweep(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """AUROC of every in-row reducer of the line energies."""
    by = by or []
    long = _long(records, by, A.reducers(_e()))
    return auroc(long, "score", fail_label(), by + ["reducer"])


def z_sweep(records: DataFrame, ks=(1, 2, 3, 5), by: list[str] | None = None) -> DataFrame:
    by = by or []
    cols = {f"z_top{k}": A.z_top_mean(_e(), k) for k in ks}
    cols["max"] = F.coalesce(F.array_max(_e()), F.lit(0.0))
    return auroc(_long(records, by, cols), "score", fail_label(), by + ["reducer"])


def _long(records: DataFrame, by: list[str], cols: dict[str, Column]) -> DataFrame:
    # Rounded so that the last bits of a sum cannot turn a tie into an order.
    return records.select(*by, "status", F.inline(F.array(*[
        F.struct(F.lit(k).alias("reducer"), F.round(v, 9).alias("score")) for k, v in cols.items()])))


def roc_curve(records: DataFrame, by: list[str], key: str = "impl_id", unknown_as_pass: bool = False) -> DataFrame:
    """One point per record, best score first, ties broken by key; plus the origin."""
    rows = records.withColumn("_y", fail_label(unknown_as_pass)).filter("_y IS NOT NULL").select(
        *by, (-F.col("whole_impl_energy")).alias("_neg"), key,
        F.col("_y").cast("long").alias("_p"), (~F.col("_y")).cast("long").alias("_n"))
    run = running_sums(rows, by, ["_neg", key], {"tp": "_p", "fp": "_n"})
    points = run.select(
        *by, key, (F.col("tp") + F.col("_p")).alias("tp"), (F.col("fp") + F.col("_n")).alias("fp"),
        F.try_divide(F.col("tp") + F.col("_p"), F.col("tp_total")).alias("tpr"),
        F.try_divide(F.col("fp") + F.col("_n"), F.col("fp_total")).alias("fpr"))
    origin = rows.groupBy(*by).agg(F.lit("").alias(key)).select(
        *by, key, F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
        F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return points.unionByName(origin)


def by_source(records: DataFrame, k: int = 3) -> DataFrame:
    """Counts, AUROC (UNKNOWN counts as PASS) and recall per record source."""
    src = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.substring_index("impl_id", "-", 1))
    rows = slim(records.withColumn("src", src), ["src"], (k,))
    s = F.col("status")
    counts = rows.groupBy("src").agg(
        F.count("*").alias("n"), F.count_if(s == "PASS").alias("n_pass"), F.count_if(s == "FAIL").alias("n_fail"),
        F.avg(f"hit{k}").alias("topk"))
    area = auroc(rows, "whole_impl_energy", fail_label(True), ["src"]).select("src", "auc")
    return counts.join(area, "src", "left")


def topk_curve(records: DataFrame, by: list[str], k_max: int = 10) -> DataFrame:
    """Recall for k = 1..k_max from the best rank of any labelled line."""
    rows = with_order(labelled_fail(records))
    ranks = F.filter(F.transform(_b(), lambda b: F.array_position(F.col("_order"), b)), lambda p: p > 0)
    best = rows.select(*by, F.array_min(ranks).alias("_best"))
    # A histogram of best ranks is all the curve needs: k_max+1 cells per group.
    hist = best.groupBy(*by, F.least(F.coalesce("_best", F.lit(k_max + 1)), F.lit(k_max + 1)).alias("_best")).agg(
        F.count("*").alias("c"))
    ks = hist.select(*by, "_best", "c", F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("k"))
    return ks.groupBy(*by, "k").agg(
        (F.sum(F.when(F.col("_best") <= F.col("k"), F.col("c")).otherwise(0)) / F.sum("c")).alias("recall"),
        F.sum("c").alias("n"))
