"""Forward values of the training losses as offline metrics.

``by`` names the batch. Line losses are computed inside the row; group losses
compare every failing example with the one anchor of its group, so the work is
linear in the rows. What reads the rows several times writes its few numbers a
record once, so that records are scored once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineaudit.functions import ranking as R
from lineaudit.functions.binding import let
from lineaudit.functions.reducers import log_sum_exp, softplus, total
from lineaudit.plans.joins import join_groups
from lineaudit.plans.merging import log_sum_exp_by
from lineaudit.plans.skew import lookup
from lineaudit.session import stable


def _e() -> Column:
    return F.col("per_line_energies")


def _mean(values: Column) -> Column:
    return let(values, lambda v: total(v) / F.size(v))


_WHOLE = ("spec_id", "impl_id", "status", "whole_impl_energy")


def _once(rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """The columns that group losses meet up to five times, and ``more`` numbers of a record, written once."""
    return stable(rows.select(*by, *_WHOLE, *more))


# -- implementation-level -----------------------------------------------------------

def _anchors(rows: DataFrame, by: list[str]) -> DataFrame:
    """Energy of the first passing example of each group that also has a failing one."""
    passing, failing = F.col("status") == "PASS", F.col("status") == "FAIL"
    w = F.col("whole_impl_energy")
    groups = rows.groupBy(*by, "spec_id").agg(
        F.min_by(F.when(passing, w), F.when(passing, F.col("impl_id"))).alias("e_pos"),
        F.count_if(failing).alias("_nf"), F.sum(F.when(failing, w)).alias("_sf"))
    return groups.filter(F.col("e_pos").isNotNull() & (F.col("_nf") > 0))


def spec_infonce(rows: DataFrame, by: list[str]) -> DataFrame:
    """Anchor against all failing examples of the batch: its own spec's and the others'."""
    return _spec_infonce(_once(rows, by), by)


def _spec_infonce(rows: DataFrame, by: list[str]) -> DataFrame:
    fails = rows.filter("status = 'FAIL'")
    w = F.col("whole_impl_energy")
    pool = log_sum_exp_by(fails, by, -w, "_pool", _n=F.count("*"), _t=F.sum(w))
    per = join_groups(_anchors(rows, by), pool, by)
    own = -F.col("e_pos")
    m = F.greatest("_pool", own)
    lse = m + F.log(F.exp(F.col("_pool") - m) + F.exp(own - m))
    return per.groupBy(*by).agg(
        F.avg(lse + F.col("e_pos")).alias("loss"), F.count("*").alias("n"),
        F.avg(F.col("_t") / F.col("_n") - F.col("e_pos")).alias("diff"))


def _pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "spec_id"]
    fails = rows.filter("status = 'FAIL'").select(*keys, "impl_id", F.col("whole_impl_energy").alias("e_neg"))
    return lookup(fails, _anchors(rows, by).select(*keys, "e_pos"), keys, ["e_pos"], ["impl_id"]).filter(
        "e_pos IS NOT NULL")


def pair_logistic(rows: DataFrame, by: list[str], margin: float = 0.0) -> DataFrame:
    return _pair_logistic(_once(rows, by), by, margin)


def _pair_logistic(rows: DataFrame, by: list[str], margin: float = 0.0) -> DataFrame:
    gap = F.col("e_pos") - F.col("e_neg")
    return _pairs(rows, by).groupBy(*by).agg(
        F.avg(softplus(gap + margin)).alias("loss"), F.count("*").alias("n"), F.avg(-gap).alias("diff"))


def pair_hinge(rows: DataFrame, by: list[str], margin: float = 1.0) -> DataFrame:
    return _pair_hinge(_once(rows, by), by, margin)


def _pair_hinge(rows: DataFrame, by: list[str], margin: float = 1.0) -> DataFrame:
    gap = F.col("e_pos") - F.col("e_neg")
    return _pairs(rows, by).groupBy(*by).agg(
        F.avg(F.greatest(F.lit(0.0), gap + margin)).alias("loss"), F.count("*").alias("n"), F.avg(-gap).alias("diff"))


def pair_epa(rows: DataFrame, by: list[str], margin: float = 0.0, weak_weight: float = 0.2) -> DataFrame:
    """Logistic pairs plus a weak term against the batch's examples outside any group.

    ``by`` must name batches of bounded size (see ``sampling.fixed_batches``):
    the weak pool of a batch is held as one array. ``rows`` are read several times.
    """
    anchors = _anchors(rows, by).select(*by, "spec_id", "e_pos")
    grouped = anchors.withColumn("_in", F.lit(True)).drop("e_pos")
    weak = rows.join(grouped, [*by, "spec_id"], "left")
    # An example is outside when its group has no anchor, or it is a further PASS of one.
    first = rows.filter("status = 'PASS'").groupBy(*by, "spec_id").agg(F.min("impl_id").alias("_first"))
    weak = weak.join(first, [*by, "spec_id"], "left")
    member = F.coalesce("_in", F.lit(False)) & ((F.col("status") == "FAIL") | (F.col("impl_id") == F.col("_first")))
    pool = weak.filter(~member).groupBy(*by).agg(F.collect_list("whole_impl_energy").alias("_pool"))
    per = join_groups(anchors, pool, by, "left").withColumn("_weak", let(F.col("e_pos"), lambda p: _mean(
        F.transform("_pool", lambda k: softplus(p - k + margin)))))
    weak_mean = per.groupBy(*by).agg(F.avg("_weak").alias("_weak"))
    strong = _pair_logistic(rows, by, margin)
    return join_groups(strong, weak_mean, by, "left").withColumn(
        "loss", F.col("loss") + weak_weight * F.coalesce("_weak", F.lit(0.0))).drop("_weak")


def orm(rows: DataFrame, by: list[str], pos_weight: float = 1.0) -> DataFrame:
    """Binary cross-entropy of the implementation energy as a logit of FAIL."""
    z, y = F.col("whole_impl_energy"), F.col("status") == "FAIL"
    known = rows.filter(F.col("status").isin("PASS", "FAIL"))
    return known.groupBy(*by).agg(
        F.avg(F.when(y, pos_weight * softplus(-z)).otherwise(softplus(z))).alias("loss"), F.count("*").alias("n"),
        (F.avg(F.when(y, z)) - F.avg(F.when(~y, z))).alias("diff"))


# -- line-level ------------------------------------------------------------------------

def _labelled(rows: DataFrame, min_lines: int) -> DataFrame:
    """Failing records with labels, as (labels in range, line count)."""
    n = F.size(_e())
    return rows.filter((F.col("status") == "FAIL") & (F.size("buggy_line_indices") > 0) & (n >= min_lines)).withColumn(
        "_b", R.in_range(F.col("buggy_line_indices"), n)).filter(F.size("_b") > 0)


def _at(e: Column, idx: Column) -> Column:
    return F.transform(idx, lambda i: F.get(e, i))


def _others(e: Column, labels: Column) -> Column:
    return F.filter(e, lambda x, i: ~F.array_contains(labels, i))


def _focal(loss: Column, log_p: Column, gamma: float) -> Column:
    return loss * F.pow(1.0 - F.exp(log_p), F.lit(gamma)) if gamma > 0 else loss


def _packed() -> Column:
    return F.struct(_e().alias("e"), F.col("_b").alias("b"))


def _averaged(rows: DataFrame, by: list[str], x: str = "_x") -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(f"{x}.loss").alias("loss"), F.count(x).alias("n"), F.avg(f"{x}.conf").alias("confidence"))


def _balanced(loss: Column, b: Column, balance: bool) -> Column:
    return loss / F.sqrt(F.size(b)) if balance else loss


def _listwise(smoothing: float, gamma: float, balance: bool):
    """Loss and confidence of one record, from its energies ``e`` and labels ``b``."""
    def per_row(p):
        e, lse = p["e"], p["lse"]
        uniform = lse - _mean(e)
        steps = let(uniform, lambda u: F.transform(_at(e, p["b"]), lambda x: _focal(
            (1.0 - smoothing) * (lse - x) + smoothing * u, x - lse, gamma)))
        return F.struct(_balanced(_mean(steps), p["b"], balance).alias("loss"),
                        _mean(F.transform(_at(e, p["b"]), lambda x: F.exp(x - lse))).alias("conf"))

    return lambda p: let(F.struct(p["e"].alias("e"), p["b"].alias("b"), log_sum_exp(p["e"]).alias("lse")), per_row)


def line_listwise(rows: DataFrame, by: list[str], smoothing: float = 0.05, gamma: float = 0.0,
                  balance: bool = False) -> DataFrame:
    """Softmax cross-entropy over a record's lines with its labels as targets."""
    return _averaged(_labelled(rows, 2).withColumn("_x", let(_packed(), _listwise(smoothing, gamma, balance))), by)


def _listmle(gamma: float, balance: bool):
    def per_row(p):
        ranked = F.concat(_at(p["e"], p["b"]), _others(p["e"], p["b"]))

        def steps(r):
            return F.transform(p["b"], lambda _x, i: F.get(r, i) - log_sum_exp(F.slice(r, i + 1, F.size(r))))

        return let(let(ranked, steps), lambda lp: F.struct(
            _balanced(_mean(F.transform(lp, lambda x: _focal(-x, x, gamma))), p["b"], balance).alias("loss"),
            _mean(F.transform(lp, lambda x: F.exp(x))).alias("conf")))

    return per_row


def line_listmle(rows: DataFrame, by: list[str], gamma: float = 0.0, balance: bool = False) -> DataFrame:
    """Plackett-Luce likelihood of the labelled lines standing first, in label order."""
    return _averaged(_labelled(rows, 2).withColumn("_x", let(_packed(), _listmle(gamma, balance))), by)


def _contrast(pick, pair, weight):
    """Expected pair loss of a record's labelled lines against picked other lines, its weight; NULL without other lines."""
    def per_row(p):
        both = F.struct(_at(p["e"], p["b"]).alias("b"), pick(_others(p["e"], p["b"])).alias("o"))
        return let(both, lambda s: F.when(F.size(s["o"]) > 0, F.struct(
            _mean(F.transform(s["b"], lambda x: let(x, lambda v: _mean(F.transform(
                s["o"], lambda y: pair(v, y)))))).alias("loss"),
            (_mean(s["b"]) - _mean(s["o"])).alias("diff"),
            weight(F.size(s["b"]), F.size(_others(p["e"], p["b"]))).alias("w"))))

    return per_row


def _weighted(rows: DataFrame, by: list[str], x: str = "_x") -> DataFrame:
    return rows.groupBy(*by).agg(
        (F.sum(F.col(f"{x}.loss") * F.col(f"{x}.w")) / F.sum(f"{x}.w")).alias("loss"),
        F.sum(f"{x}.w").alias("n"), F.avg(f"{x}.diff").alias("diff"))


def _hinge(margin: float, pairs_per_impl: int = 4):
    return _contrast(lambda o: o, lambda b, o: F.greatest(F.lit(0.0), margin + o - b),
                     lambda nb, no: F.least(F.lit(pairs_per_impl), nb * no))


def line_hinge(rows: DataFrame, by: list[str], margin: float = 1.0, pairs_per_impl: int = 4) -> DataFrame:
    """Expected hinge over uniformly drawn (labelled, other) pairs; a record weighs as many
    pairs as would be drawn from it."""
    return _weighted(_labelled(rows, 1).select(*by, let(_packed(), _hinge(margin, pairs_per_impl)).alias("_x")), by)


def _semi_hard(margin: float, k: int):
    return _contrast(lambda o: F.slice(F.sort_array(o, asc=False), 1, k),
                     lambda b, o: softplus(margin + o - b), lambda nb, no: nb)


def line_semi_hard(rows: DataFrame, by: list[str], margin: float = 1.0, k: int = 3) -> DataFrame:
    """Expected logistic pair loss against one of the k highest other lines."""
    return _weighted(_labelled(rows, 1).select(*by, let(_packed(), _semi_hard(margin, k)).alias("_x")), by)


def line_bce(rows: DataFrame, by: list[str], pos_weight: float = 10.0) -> DataFrame:
    """Per-line cross-entropy, averaged within the record and then over records."""
    n = F.size(_e())
    kept = rows.withColumn("_b", R.in_range(F.col("buggy_line_indices"), n)).filter((n > 0) & (F.size("_b") > 0))

    def per_row(p):
        loss = F.transform(p["e"], lambda x, i: F.when(
            F.array_contains(p["b"], i), pos_weight * softplus(-x)).otherwise(softplus(x)))
        others = _others(p["e"], p["b"])
        return F.struct(_mean(loss).alias("loss"), F.when(
            F.size(others) > 0, _mean(_at(p["e"], p["b"])) - _mean(others)).alias("diff"))

    packed = F.struct(_e().alias("e"), F.col("_b").alias("b"))
    x = kept.select(*by, let(packed, per_row).alias("_x"))
    return x.groupBy(*by).agg(
        F.avg("_x.loss").alias("loss"), F.count("*").alias("n"), F.avg("_x.diff").alias("diff"))


# -- combinations ----------------------------------------------------------------------------

def hybrid(rows: DataFrame, by: list[str], w_scalar: float, w_list: float, w_pair: float, margin: float = 1.0,
           smoothing: float = 0.05, k: int = 3, scalar: str = "logistic", listwise: str = "listnet",
           gamma: float = 0.0, balance: bool = False, weak_weight: float = 0.2) -> DataFrame:
    """Weighted sum of a scalar, a listwise and a semi-hard pair loss."""
    listed = _listmle(gamma, balance) if listwise == "listmle" else _listwise(smoothing, gamma, balance)
    seen = _with_lines(rows, by, list=(2, listed), pair=(1, _semi_hard(margin, k)))
    parts = {
        "scalar": {"hinge": lambda: _pair_hinge(seen, by), "epa": lambda: pair_epa(seen, by, weak_weight=weak_weight),
                   "logistic": lambda: _pair_logistic(seen, by)}[scalar](),
        "list": _averaged(seen.filter("list IS NOT NULL"), by, "list"), "pair": _weighted(seen.filter("pair IS NOT NULL"), by, "pair")}
    return _combine(seen, by, parts, {"scalar": w_scalar, "list": w_list, "pair": w_pair})


def contrastive(rows: DataFrame, by: list[str], w_spec: float, w_line: float, margin: float = 1.0) -> DataFrame:
    """Weighted sum of the group softmax loss and the line hinge."""
    seen = _with_lines(rows, by, line=(1, _hinge(margin)))
    parts = {"spec": _spec_infonce(seen, by), "line": _weighted(seen.filter("line IS NOT NULL"), by, "line")}
    return _combine(seen, by, parts, {"spec": w_spec, "line": w_line})


def _with_lines(rows: DataFrame, by: list[str], **losses) -> DataFrame:
    """Every record once, with its line losses, named (least lines, loss); NULL where a record has no labels or too few lines."""
    n = F.size(_e())
    labels = F.when((F.col("status") == "FAIL") & (F.size("buggy_line_indices") > 0), R.in_range(F.col("buggy_line_indices"), n))
    packed = F.struct(_e().alias("e"), labels.alias("b"))
    found = let(packed, lambda p: F.when(F.size(p["b"]) > 0, F.struct(*[
        F.when(F.size(p["e"]) >= least, loss(p)).alias(name) for name, (least, loss) in losses.items()])))
    return _once(rows, by, found.alias("_x")).select(*by, *_WHOLE, *[F.col(f"_x.{name}") for name in losses])


def _combine(rows: DataFrame, by: list[str], parts: dict, weights: dict) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("n_rows"))
    total_ = F.lit(0.0)
    for name, df in parts.items():
        part = df.select(*by, F.col("loss").alias(f"{name}_loss"), F.col("n").cast("long").alias(f"{name}_n"))
        out = join_groups(out, part, by, "left")
        total_ = total_ + weights[name] * F.coalesce(f"{name}_loss", F.lit(0.0))
    return out.withColumn("loss", total_)
