"""Paired tests between scorer runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import ranking as R
from lineaudit.functions import statistics as S
from lineaudit.functions.binding import let
from lineaudit.operators import metrics as M
from lineaudit.operators import sampling as Z
from lineaudit.plans.emit import filter_map
from lineaudit.plans.ordered import tied_sums
from lineaudit.session import stable


def row_hits(records: DataFrame, k: int) -> Column:
    """1/0 for labelled failing records with energies, NULL for all others."""
    return F.when(
        (F.col("status") == "FAIL") & (F.size("buggy_line_indices") > 0) & (F.size("per_line_energies") > 0),
        R.hit(R.rank_order(F.col("per_line_energies")), F.col("buggy_line_indices"), k).cast("int"))


def paired_hits(target: DataFrame, baselines: DataFrame, k: int) -> DataFrame:
    """One row per baseline run and record id both sides cover."""
    def known(records, name, *keys):
        hit = F.struct(row_hits(records, k).alias(name))
        return filter_map(records, hit, lambda s: s[name].isNotNull()).select(*keys, "impl_id", name)

    return known(target, "target_hit").join(known(baselines, "baseline_hit", "run"), "impl_id")


def length_pairs(records: DataFrame, k: int) -> DataFrame:
    """A record's own hit next to the hit of ranking its lines by length."""
    b = F.col("buggy_line_indices")
    lengths = F.transform("scorable_line_texts", lambda t: F.char_length(t).cast("double"))
    return M.aligned(records).select(
        R.hit(R.rank_order(F.col("per_line_energies")), b, k).cast("int").alias("target_hit"),
        R.hit(R.rank_order(lengths), b, k).cast("int").alias("baseline_hit"))


def mcnemar_table(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Discordant counts and the three p-value conventions, each with its ``log10``."""
    t, b = F.col("target_hit") == 1, F.col("baseline_hit") == 1
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n_paired"), F.count_if(t & b).alias("n11"), F.count_if(t & ~b).alias("n01"),
        F.count_if(~t & b).alias("n10"), F.count_if(~t & ~b).alias("n00"),
        F.avg("target_hit").alias("target_topk"), F.avg("baseline_hit").alias("baseline_topk"))
    n01, n10 = F.col("n01"), F.col("n10")
    logs = {"p_mcnemar": S.mcnemar_log_p(n01, n10), "p_exact": S.binomial_half_log_p(n01, n10),
            "p_mid": S.binomial_half_log_p(n01, n10, mid_p=True)}
    out = out.withColumns({f"_{p}": x for p, x in logs.items()})
    out = out.withColumns({p: F.exp(f"_{p}") for p in logs} | {f"log10_{p}": S.log10_of(F.col(f"_{p}")) for p in logs})
    return out.drop(*[f"_{p}" for p in logs])


def _placed(cells: DataFrame, score: str, by: list[str], counted: DataFrame) -> DataFrame:
    """Each cell with the share of the other class below its score, ties at one half, as ``v_<score>``."""
    other = "b" if score == "a" else "a"
    run = tied_sums(cells, by, score, [other, "y"], {"_p": "pos", "_n": "neg"}, sample_from=counted)
    below = (F.col("_n_below") + F.col("_n_tied") * 0.5) / F.nullif(F.col("_n_total"), F.lit(0))
    above = (F.col("_p_total") - F.col("_p_below") - F.col("_p_tied") * 0.5) / F.nullif(F.col("_p_total"), F.lit(0))
    return run.select(*cells.columns, F.when(F.col("y"), below).otherwise(above).alias(f"v_{score}"))


def delong(paired: DataFrame, by: list[str], a: str = "a", b: str = "b", y: Column | None = None) -> DataFrame:
    """Paired comparison of two AUROCs.

    ``paired`` holds one row per record with both scores; a record without a
    class or without one of the scores is left out. Rows are counted per
    (a, b, class) first; a scan along each score hands every cell its structural
    component (``tied_sums``), and the covariances are count-weighted moments of
    the cells, so neither ties nor class size ever concentrate work and nothing is
    joined on a score. NULL is a group.
    """
    y = M.fail_label() if y is None else y
    rows = paired.withColumn("y", y).select(*by, F.col(a).alias("a"), F.col(b).alias("b"), "y").filter(
        "y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    cells = rows.groupBy(*by, "a", "b", "y").agg(F.count("*").alias("c")).withColumns({
        "pos": F.when(F.col("y"), F.col("c")).otherwise(0), "neg": F.when(F.col("y"), 0).otherwise(F.col("c"))})
    # The splitters of both scans come from the cells, so the pairs are formed once.
    full = _placed(_placed(cells, "a", by, cells), "b", by, cells)
    va, vb = F.col("v_a"), F.col("v_b")
    # Components lie in [0, 1] around the AUC; moments about 1/2 lose no digits that matter.
    da, db, c = va - 0.5, vb - 0.5, F.col("c")
    m = full.groupBy(*by, "y").agg(
        F.sum("c").alias("n"), F.sum(c * da).alias("sa"), F.sum(c * db).alias("sb"),
        F.sum(c * da * da).alias("saa"), F.sum(c * db * db).alias("sbb"), F.sum(c * da * db).alias("sab"))
    n = F.col("n")

    def cov(s, p, q):
        return F.try_divide(F.col(s) - F.col(p) * F.col(q) / n, n - 1) / n

    m = m.select(*by, "y", "n", (F.col("sa") / n + 0.5).alias("auc_a"), (F.col("sb") / n + 0.5).alias("auc_b"),
                 (cov("saa", "sa", "sa") + cov("sbb", "sb", "sb") - 2 * cov("sab", "sa", "sb")).alias("var"))
    out = m.groupBy(*by).agg(
        F.max(F.when(F.col("y"), F.col("auc_a"))).alias("auc_a"),
        F.max(F.when(F.col("y"), F.col("auc_b"))).alias("auc_b"),
        F.max(F.when(F.col("y"), n)).alias("n_pos"), F.max(F.when(~F.col("y"), n)).alias("n_neg"),
        F.sum("var").alias("var"))
    out = out.withColumn("diff", F.col("auc_a") - F.col("auc_b"))
    tiny = F.col("var") > 1e-18
    out = out.withColumn("z", F.when(tiny, F.col("diff") / F.sqrt("var")))
    # A vanishing variance is p=1 in one convention and undefined in the other.
    out = out.withColumn("_log", S.two_sided_normal_log_p(F.col("z")))
    p = F.exp("_log")
    return out.withColumns({
        "p": F.when(tiny, p).otherwise(F.lit(1.0)), "p_or_nan": F.when(tiny, p).otherwise(F.lit(math.nan)),
        "log10_p": F.when(tiny, S.log10_of(F.col("_log"))).otherwise(F.lit(0.0))}).drop("_log")


def paired_scores(target: DataFrame, baselines: DataFrame) -> DataFrame:
    t = target.select("impl_id", "status", F.col("whole_impl_energy").alias("a"))
    return t.join(baselines.select("impl_id", "run", F.col("whole_impl_energy").alias("b")), "impl_id")


def significance_table(target: DataFrame, baselines: DataFrame, k: int = 1) -> DataFrame:
    """One row per baseline: paired recall test and paired AUROC test."""
    def narrow(records, *extra):
        return stable(records.select(*extra, "impl_id", "status", "whole_impl_energy", row_hits(records, k).alias("hit")))

    t, b = narrow(target), narrow(baselines, "run")
    pairs = t.select("impl_id", F.col("hit").alias("target_hit")).join(
        b.select("impl_id", "run", F.col("hit").alias("baseline_hit")), "impl_id")
    recall = mcnemar_table(pairs.filter("target_hit IS NOT NULL AND baseline_hit IS NOT NULL"), ["run"])
    area = delong(paired_scores(t, b), ["run"])
    return recall.join(area.withColumnRenamed("var", "auc_var"), "run", "left")


def hits_at(ks: tuple[int, ...]) -> Column:
    """``row_hits`` for several k from one ranking: an array, NULL where ``row_hits`` is."""
    b = F.col("buggy_line_indices")
    hits = let(R.rank_order(F.col("per_line_energies")), lambda order: F.array(*[R.hit(order, b, k).cast("int") for k in ks]))
    return F.when((F.col("status") == "FAIL") & (F.size(b) > 0) & (F.size("per_line_energies") > 0), hits)


def significance_by_k(target: DataFrame, baselines: DataFrame, ks: tuple[int, ...] = (1, 3, 5), iters: int = 500,
                      seed: int = 0) -> DataFrame:
    """One row per baseline: recall and paired test for every k, both AUROCs, their paired test, and a resampled
    95 % interval of their difference. Ids are unique within a run; a run without both classes has NULL areas."""
    def narrow(records, hit, *extra):
        # Recall, areas and resamples all read it: the texts behind it are scored once.
        return stable(records.select(*extra, "impl_id", "status", "whole_impl_energy", hits_at(ks).alias(hit)))

    t, b = narrow(target, "t"), narrow(baselines, "b", "run")
    pairs = t.select("impl_id", "t").join(b.select("impl_id", "run", "b"), "impl_id")
    per_k = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.get("t", F.lit(i)).alias("target_hit"),
                                        F.get("b", F.lit(i)).alias("baseline_hit")) for i, k in enumerate(ks)]),
                     lambda x: x["target_hit"].isNotNull() & x["baseline_hit"].isNotNull())
    table = mcnemar_table(pairs.select("run", F.inline(per_k)), ["run", "k"])
    named = {"target_topk": "target_top", "baseline_topk": "baseline_top", "p_mcnemar": "p_mcnemar_top", "p_exact": "p_exact_top",
             "log10_p_exact": "log10_p_exact_top"}
    recall = table.groupBy("run").agg(F.max("n_paired").alias("n_paired"), *[
        F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{name}{k}") for k in ks for c, name in named.items()])
    scores = paired_scores(t, b)
    area = delong(scores, ["run"]).select("run", "auc_a", "auc_b", "n_pos", "n_neg", "p")
    auc = Z.bootstrap_auroc(scores.filter("a IS NOT NULL AND b IS NOT NULL"), ["a", "b"], M.fail_label(), "impl_id", ["run"], iters, seed)
    delta = auc.groupBy("run", "rep").agg((F.max(F.when(F.col("score") == "a", F.col("auc")))
                                           - F.max(F.when(F.col("score") == "b", F.col("auc")))).alias("delta"))
    interval = Z.linear_interval(delta, "delta", ["run"]).select("run", F.col("lo").alias("diff_lo"), F.col("hi").alias("diff_hi"))
    return recall.join(area, "run", "left").join(interval, "run", "left")


def bootstrap_report(records: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 3), iters: int = 1000, seed: int = 0) -> DataFrame:
    """Median and 95 % interval of AUROC and of top-k recall per group, all from the same resamples of the records."""
    area = Z.bootstrap_auroc(records, ["whole_impl_energy"], M.fail_label(), "impl_id", by, iters, seed).select(
        *by, F.lit("auroc").alias("metric"), F.col("auc").alias("value"))
    hits = filter_map(records, F.struct(hits_at(ks).alias("_hits")), lambda s: s["_hits"].isNotNull()).select(
        *by, "impl_id", F.inline(F.array(*[F.struct(F.lit(f"top{k}").alias("metric"), F.get("_hits", F.lit(i)).alias("hit"))
                                           for i, k in enumerate(ks)])))
    recall = Z.bootstrap_means(hits, "hit", "impl_id", [*by, "metric"], iters, seed).select(
        *by, "metric", F.col("mean").alias("value"))
    return Z.index_interval(area.unionByName(recall), "value", [*by, "metric"])
