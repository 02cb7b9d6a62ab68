import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lineaudit.functions import reducers as A
from lineaudit.functions import statistics as S
from lineaudit.operators import losses as L
from lineaudit.operators import metrics as M
from lineaudit.operators import positions as P
from lineaudit.operators import significance as G
from lineaudit.operators import subgroups as U


def auc(rows):
    r = M.auroc(rows, "whole_impl_energy", M.fail_label()).first()
    return (r["auc"], r["n_neg"], r["n_pos"]) if r else None


def test_auroc_goldens(records):
    assert auc(records(("a", "PASS", -2, [], []), ("b", "PASS", -1, [], []), ("a", "FAIL", 1, [], []), ("b", "FAIL", 2, [], []))) == (1.0, 2, 2)
    assert auc(records(("a", "PASS", 2, [], []), ("a", "FAIL", -2, [], [])))[0] == 0.0
    assert auc(records(("a", "PASS", 2, [], []))) == (None, 1, 0)


def test_auroc_ties_and_skew_against_definition(spark):
    rng = random.Random(1)
    rows = [("g%d" % (i % 3 == 0), rng.choice([0.0, 0.0, 0.0, rng.random()]), rng.choice(["PASS", "FAIL", "UNKNOWN"])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, whole_impl_energy double, status string")
    got = {r["g"]: r["auc"] for r in M.auroc(df, "whole_impl_energy", M.fail_label(), ["g"]).collect()}
    for g in ("g0", "g1"):
        pos = [s for k, s, y in rows if k == g and y == "FAIL"]
        neg = [s for k, s, y in rows if k == g and y == "PASS"]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("energies,labels,k,want", [
    ([0, 5, 1], [1], 1, 1.0), ([5, 0, 1], [1], 1, 0.0), ([5, 4, 0, 3, 0], [3], 3, 1.0), ([1, 1, 1], [0], 1, 1.0)])
def test_topk_goldens(records, energies, labels, k, want):
    r = M.topk_recall(records(("a", "FAIL", 0, energies, labels), ("a", "PASS", 0, energies, labels)), (k,)).first()
    assert (r["recall"], r["n"]) == (want, 1)


def test_topk_empty_and_loose(records):
    df = records(("a", "FAIL", 0, [1.0, 2.0], []), ("a", "FAIL", 0, [], [0]), ("a", "FAIL", 0, [1.0, 2.0], [1]))
    assert M.topk_recall(df, (1,)).first()["n"] == 1
    r = M.audit_recall(df, (1,)).first()
    assert (r["recall"], r["n_fail"]) == (0.5, 2)


def test_uniform_expectation(records):
    r = M.topk_recall(records(("a", "FAIL", 0, [5, 4, 3, 2, 1], [0, 1])), (3,)).first()
    assert r["uniform"] == pytest.approx(1 - math.comb(3, 3) / math.comb(5, 3))


def test_within_spec_ranking(records):
    def acc(*rows):
        r = M.within_spec_ranking(records(*rows)).first()
        return (r["accuracy"], r["n_specs"]) if r else None
    assert acc(("s", "PASS", -1, [], []), ("s", "FAIL", 1, [], [])) == (1.0, 1)
    assert acc(("s", "PASS", 1, [], []), ("s", "FAIL", -1, [], [])) == (0.0, 1)
    assert acc(("s", "PASS", 1, [], []), ("t", "PASS", 0, [], []), ("t", "FAIL", 1, [], [])) == (1.0, 1)


def test_bundle(records):
    df = records(("s", "PASS", -1, [0], []), ("s", "FAIL", 1, [0, 5], [1])).withColumn("run", F.lit("r"))
    r = M.eval_bundle(df, ["run"]).first()
    assert (r["n_impls"], r["auc"], r["per_line_top1"], r["accuracy"], r["mean_pass"], r["mean_fail"]) == (2, 1.0, 1.0, 1.0, -1.0, 1.0)
    assert r["std_energy"] == 1.0


def test_marker_audit_verdict(records):
    w = records(("s", "FAIL", 0, [9, 1], [0]))
    s = records(("s", "FAIL", 0, [0, 1], [0]))
    assert {r["verdict"] for r in M.marker_audit(w, s).collect()} == {"marker-RELIANT"}
    assert {r["verdict"] for r in M.marker_audit(s, w).collect()} == {"marker-AVERSE"}
    assert {r["verdict"] for r in M.marker_audit(w, w).collect()} == {"marker-INVARIANT"}


def test_reducers(spark):
    e = [0.5, -1.0, 3.0, 3.0]
    row = spark.createDataFrame([(e,), ([],), ([2.0, 2.0],)], "e array<double>").coalesce(1).select(
        *[v.alias(k) for k, v in A.reducers(F.col("e")).items()], A.z_top_mean(F.col("e"), 2).alias("z2"),
        A.normalized_lse(F.col("e"), 1000.0).alias("hot"), A.normalized_lse(F.col("e"), 0.01).alias("cold")).collect()
    mu, sd = statistics.fmean(e), statistics.pstdev(e)
    assert row[0]["mean"] == pytest.approx(mu) and row[0]["last"] == 3.0 and row[0]["ms_top1_minus_min"] == 4.0
    assert row[0]["ms_top3"] == pytest.approx((3 + 3 + 0.5) / 3 - mu) and row[0]["z2"] == pytest.approx((3 - mu) / sd)
    assert row[0]["hot"] == pytest.approx(mu, abs=0.01) and row[0]["cold"] == pytest.approx(3.0, abs=0.05)
    assert all(v == 0.0 for v in row[1].asDict().values()) and row[2]["z2"] == 0.0


def test_positions(records):
    df = records(("a", "FAIL", 0, [1, 2, 9], [2]), ("a", "FAIL", 0, [5], [0]), ("a", "FAIL", 0, [1, 2], [0]))
    assert sorted(r["position"] for r in P.label_positions(df).collect()) == [0.0, 0.0, 1.0]
    assert sorted(r["position"] for r in P.predicted_positions(df).collect()) == [0.0, 1.0, 1.0]
    assert P.spearman_position(df.withColumn("run", F.lit(1)), ["run"]).first()["rho"] == pytest.approx(1.0)


def test_label_count_buckets_always_three(records):
    got = {r["bucket"]: (r["n"], r["topk"]) for r in U.by_label_count(records(("a", "FAIL", 0, [1, 2], [1]))).collect()}
    assert got == {"|B|=1": (1, 1.0), "|B|=2": (0, 0.0), "|B|>=3": (0, 0.0)}


def test_tertiles_are_not_ntile(records):
    df = records(*[("a", "FAIL", 0, [1.0] * (i + 1), [0]) for i in range(5)])
    got = {r["tertile"]: r["n"] for r in U.by_length_tertile(df, []).collect()}
    assert got == {"short": 1, "medium": 2, "long": 2}


@pytest.mark.parametrize("b,c,p", [(0, 5, .0625), (9, 11, .8238029479980469), (11, 8, .6476058959960938), (3, 2, 1.0), (0, 0, 1.0)])
def test_exact_mcnemar(spark, b, c, p):
    got = spark.range(1).select(S.binomial_half_two_sided(F.lit(b), F.lit(c))).first()[0]
    assert got == pytest.approx(p, abs=1e-12)


def test_large_mcnemar_and_normal(spark):
    r = spark.range(1).select(
        S.binomial_half_two_sided(F.lit(700), F.lit(600)), S.mcnemar_p(F.lit(30), F.lit(10)), S.two_sided_normal_p(F.lit(1.96))).first()
    exact = 2 * sum(math.comb(1300, i) for i in range(601)) / 2 ** 1300
    assert r[0] == pytest.approx(exact, rel=0.01)
    assert r[1] == pytest.approx(math.erfc(math.sqrt(19 ** 2 / 40 / 2))) and r[2] == pytest.approx(0.05, abs=1e-3)


def test_delong_against_components(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["PASS", "FAIL"]), round(rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1)) for _ in range(120)]
    r = G.delong(spark.createDataFrame(rows, "status string, a double, b double"), []).first()
    pos, neg = [x for x in rows if x[0] == "FAIL"], [x for x in rows if x[0] == "PASS"]

    def psi(x, y):
        return 1.0 if x > y else 0.5 if x == y else 0.0

    def comp(i):
        return ([sum(psi(p[i], n[i]) for n in neg) / len(neg) for p in pos],
                [sum(psi(p[i], n[i]) for p in pos) / len(pos) for n in neg])

    (a10, a01), (b10, b01) = comp(1), comp(2)
    var = (statistics.variance([x - y for x, y in zip(a10, b10)]) / len(pos)
           + statistics.variance([x - y for x, y in zip(a01, b01)]) / len(neg))
    assert r["auc_a"] == pytest.approx(statistics.fmean(a10)) and r["var"] == pytest.approx(var)
    assert r["p"] == pytest.approx(math.erfc(abs(statistics.fmean(a10) - statistics.fmean(b10)) / math.sqrt(var) / math.sqrt(2)))


def test_delong_of_equal_scores(spark):
    df = spark.createDataFrame([("PASS", 0.0), ("FAIL", 1.0), ("FAIL", -1.0), ("PASS", 0.5)], "status string, a double").withColumn("b", F.col("a"))
    r = G.delong(df, []).first()
    assert r["p"] == 1.0 and math.isnan(r["p_or_nan"])


def test_losses(records):
    good = records(("s", "PASS", -5, [], []), ("s", "FAIL", 5, [], []), ("t", "FAIL", 5, [], []))
    bad = records(("s", "PASS", 5, [], []), ("s", "FAIL", -5, [], []), ("t", "FAIL", -5, [], []))
    assert L.spec_infonce(good, []).first()["loss"] < 0.01 and L.spec_infonce(bad, []).first()["loss"] > 5
    own = bad.filter("spec_id = 's'")
    assert L.spec_infonce(bad, []).first()["loss"] > L.spec_infonce(own, []).first()["loss"]
    assert L.orm(good, []).first()["loss"] < 0.1 and L.orm(bad, []).first()["loss"] > 4
    hinge = records(("s", "FAIL", 0, [0, 10, 0], [1]))
    assert L.line_hinge(hinge, []).first()["loss"] == 0.0
    assert L.line_hinge(records(("s", "FAIL", 0, [5, 0, 5], [1])), []).first()["loss"] > 5
    assert L.line_hinge(records(("s", "FAIL", 0, [5, 0], [0, 1])), []).first() is None or \
        L.line_hinge(records(("s", "FAIL", 0, [5, 0], [0, 1])), []).first()["loss"] is None
    r = L.line_bce(records(("s", "FAIL", 0, [0, -2, 5], [1])), [], 5.0).first()
    assert r["loss"] > 0.5 and r["n"] == 1


def test_listmle_against_definition(records):
    e, b = [0.3, 1.0, -2.0, 0.5], [1, 3]
    r = L.line_listmle(records(("s", "FAIL", 0, e, b)), []).first()
    order = [1, 3, 0, 2]
    want = statistics.fmean(math.log(sum(math.exp(e[j]) for j in order[i:])) - e[order[i]] for i in range(2))
    assert r["loss"] == pytest.approx(want)


def test_delong_leaves_out_missing_scores_and_keeps_the_null_group(spark):
    rows = [("FAIL", 3.0, 1.0), ("FAIL", 2.0, 2.0), ("FAIL", 0.0, 2.0), ("PASS", 1.0, 2.0), ("PASS", 0.0, 0.0), ("PASS", 0.0, 1.0)]
    extra = [("FAIL", 9.0, None), ("PASS", None, 9.0), ("UNKNOWN", 5.0, 5.0)]
    schema = "run string, status string, a double, b double"
    want = G.delong(spark.createDataFrame(rows, schema.partition(", ")[2]), []).first()
    got = {r["run"]: r for r in G.delong(spark.createDataFrame([(g, *r) for g in (None, "x") for r in rows + extra], schema), ["run"]).collect()}
    assert set(got) == {None, "x"}
    for r in got.values():
        assert (r["n_pos"], r["n_neg"]) == (3, 3)
        assert all(r[c] == pytest.approx(want[c]) for c in ("auc_a", "auc_b", "var", "p"))


def test_poisson_weights_have_no_lower_top_than_their_draws():
    from math import exp, factorial

    from lineaudit.operators.sampling import poisson_cuts
    cuts = poisson_cuts()
    assert cuts == pytest.approx([sum(exp(-1) / factorial(j) for j in range(i + 1)) for i in range(len(cuts))])
    assert 1 - cuts[-1] >= 2.0 ** -32 > 1 - cuts[-1] - exp(-1) / factorial(len(cuts))


def test_one_ranking_gives_the_hits_of_every_k(spark):
    df = spark.createDataFrame([("FAIL", [1], [0.5, 0.1, 0.9]), ("FAIL", [2], [0.5, 0.1, 0.9]), ("PASS", [1], [1.0]), ("FAIL", [], [1.0])],
                               "status string, buggy_line_indices array<int>, per_line_energies array<double>")
    got = df.select(G.hits_at((1, 2, 3)).alias("h"), *[G.row_hits(df, k).alias(f"h{k}") for k in (1, 2, 3)]).collect()
    assert [r["h"] for r in got] == [[0, 0, 1], [1, 1, 1], None, None]
    assert all(r["h"] == (None if r["h1"] is None else [r["h1"], r["h2"], r["h3"]]) for r in got)


def test_resampled_areas_and_means_by_plain_counts(spark, monkeypatch):
    """Ties, missing and not-a-number scores, a null group, a group of one class; small tables make tasks pass on often."""
    from lineaudit.operators import sampling as Z
    rng = random.Random(11)
    rows = [(f"k{i}", rng.choice(["a", None]), rng.choice([0.5, 0.5, 1.0, 2.0, None, float("nan"), rng.random()]), rng.random(), rng.choice(["FAIL", "PASS", "UNKNOWN"]))
            for i in range(150)] + [("z1", "one", 1.0, 1.0, "PASS")]
    df = spark.createDataFrame(rows, "id string, g string, a double, b double, status string").repartition(3)
    iters = 7
    cuts = Z.poisson_cuts()

    def weight(key, r):
        u = int(hashlib.sha1(f"{key}|{r}|0".encode()).hexdigest()[:8], 16) / 2 ** 32
        return sum(u >= q for q in cuts)

    def place(x):
        return (0, 0) if x is None else (2, 0) if math.isnan(x) else (1, x)

    def area(items):
        wins = sum(w * v * (1 if x > z else 0.5 if x == z else 0) for x, w, y in items if y for z, v, t in items if not t)
        pos, neg = sum(w for _, w, y in items if y), sum(w for _, w, y in items if not y)
        return wins / (pos * neg) if pos * neg else None
    for held in (Z._HELD, 30):
        monkeypatch.setattr(Z, "_HELD", held)
        got = {(r["g"], r["score"], r["rep"]): r["auc"] for r in Z.bootstrap_auroc(df, ["a", "b"], M.fail_label(), "id", ["g"], iters).collect()}
        for g in ("a", None, "one"):
            for r in range(iters):
                for name, at in (("a", 2), ("b", 3)):
                    want = area([(place(x[at]), weight(x[0], r), x[4] == "FAIL") for x in rows if x[1] == g and x[4] != "UNKNOWN"])
                    assert got[g, name, r] == (want if want is None else pytest.approx(want))
        means = {(r["g"], r["rep"]): r["mean"] for r in Z.bootstrap_means(df.where("b > 0.1"), "b", "id", ["g"], iters).collect()}
        for (g, r), m in means.items():
            own = [(x[3], weight(x[0], r)) for x in rows if x[1] == g and x[3] > 0.1]
            total = sum(w for _, w in own)
            assert m == (pytest.approx(sum(v * w for v, w in own) / total) if total else None)
        assert len(means) == 3 * iters
    assert Z.bootstrap_auroc(df.limit(0), ["a"], M.fail_label(), "id", [], 3).count() == 0


def test_log_sum_exp_of_groups(spark):
    from lineaudit.plans.merging import log_sum_exp_by
    inf, nan = math.inf, math.nan
    groups = {"near": [0.5, -2.0, 3.25, 3.25], "far": [-9000.0, -9001.0, 5000.0], "deep": [-1e6, -1e6 - 1], "seam": [255.9, 256.1, 511.99],
              "one": [0.0], "inf": [inf, 1.0], "none": [-inf, -inf], "some": [-inf, 2.0], "nan": [nan, inf, 1.0], "null": [None], None: [1.0, None, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    got = {r["g"]: r for r in log_sum_exp_by(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), "lse", n=F.count("*"), t=F.sum("v")).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        assert got[g]["n"] == len(vs)
        if not known:
            assert got[g]["lse"] is None and got[g]["t"] is None
        elif any(math.isnan(v) for v in known):
            assert math.isnan(got[g]["lse"])
        elif math.isinf(max(known)):
            assert got[g]["lse"] == max(known)
        else:
            want = max(known) + math.log(math.fsum(math.exp(v - max(known)) for v in known))
            assert got[g]["lse"] == pytest.approx(want, rel=1e-13)
    assert log_sum_exp_by(spark.createDataFrame([], "g string, v double"), ["g"], F.col("v"), "lse").count() == 0


def test_sums_below_and_beside_a_tied_value(spark):
    from lineaudit.plans.ordered import tied_sums
    rng = random.Random(11)
    # One value holds most rows, so it fills many buckets; the NULL group has its own.
    rows = [(g, v, i, rng.randint(0, 5)) for g in (None, "x") for i, v in enumerate(
        [7.0] * 60 + [rng.choice([1.0, 7.0, 9.0, None]) for _ in range(30)] + [float(rng.randint(0, 20)) for _ in range(30)])]
    df = spark.createDataFrame(rows, "g string, v double, i int, c int")
    for n in (3, 16, 200):
        got = tied_sums(df, ["g"], "v", ["i"], {"s": "c"}, n).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [x for x in rows if x[0] == r["g"]]
            key = -1.0 if r["v"] is None else r["v"]
            low = [x[3] for x in same if (-1.0 if x[1] is None else x[1]) < key]
            tie = [x[3] for x in same if (-1.0 if x[1] is None else x[1]) == key]
            assert (r["s_below"], r["s_tied"], r["s_total"]) == (sum(low), sum(tie), sum(x[3] for x in same))


def test_delong_joins_nothing_on_a_score(spark):
    df = spark.createDataFrame([("x", "PASS", 0.0, 1.0), ("x", "FAIL", 1.0, 1.0)], "run string, status string, a double, b double")
    plan = G.delong(df, ["run"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_g_" in line]
    assert joins and all("_g__bucket" in line and "_g_a" not in line and "_g_b#" not in line for line in joins)


def test_logarithms_of_tails(spark):
    from fractions import Fraction
    from math import comb, log10

    from pyspark.sql import functions as F

    from lineaudit.functions import statistics as S

    pairs = [(0, 0), (0, 1), (3, 3), (0, 40), (7, 21), (400, 700), (900, 5000), (0, 3000)]
    rows = spark.createDataFrame(pairs, "b long, c long").select("b", "c", S.log10_of(S.binomial_half_log_p(F.col("b"), F.col("c"))).alias("x"),
                                                                 S.log10_of(S.binomial_half_log_p(F.col("b"), F.col("c"), True)).alias("m")).collect()
    for r in rows:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])

        def exact(last):
            if not n:
                return 0.0
            p = Fraction(2 * (sum(comb(n, i) for i in range(k)) + last * comb(n, k)), 2 ** n)
            return min(0.0, log10(p.numerator) - log10(p.denominator))

        assert abs(r["x"] - exact(1)) < 1e-9 * max(1, abs(r["x"])), r
        assert abs(r["m"] - exact(Fraction(1, 2))) < 1e-9 * max(1, abs(r["m"])), r
    big = spark.createDataFrame([(5e11, 5e11 + 3e6), (1e11, 9e11)], "b double, c double").select(
        S.binomial_half_log_p(F.col("b"), F.col("c")).alias("x"), S.mcnemar_log_p(F.col("b"), F.col("c")).alias("y")).collect()
    assert abs(big[0]["x"] - big[0]["y"]) < 1e-4 and big[1]["x"] < -1e10
    near, far = S._log_erfc(19.999999), S._log_erfc(20.000001)
    assert 0 < near - far < 1e-4
