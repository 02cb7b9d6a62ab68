"""Work that must not be repeated per line, tile or branch."""

import random

import pytest
from pyspark.sql import functions as F


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_line_count_is_bound_once(spark):
    from lineaudit.operators import sampling as Z

    docs = spark.createDataFrame([("a", "x\ny\nz"), ("b", "x")], "impl_id string, t string")
    out = docs.select("impl_id", Z.uniform_energies(F.size(F.split("t", "\n")), F.col("impl_id")).alias("e"))
    assert _plan(out).count("split(") == 1
    assert {r["impl_id"]: len(r["e"]) for r in out.collect()} == {"a": 3, "b": 1}


def test_hue_prints_by_its_binary_value(spark):
    from lineaudit.sources.sinks import fixed

    rng = random.Random(5)
    values = [45.25, 45.35, 0.35, 0.05, 0.15, 119.95, 0.25, 7.65, 60.0, 0.0, 1e-9, 99.949999999, 1.005]
    values += [rng.randrange(24001) / 200 for _ in range(500)] + [rng.random() * 120 for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 1).alias("s")).collect()
    assert [(r["v"], r["s"]) for r in rows if r["s"] != f"{r['v']:.1f}"] == []


def test_bigrams_of_a_tile_are_those_of_the_column(spark):
    from lineaudit.functions import text as T
    from lineaudit.operators.siblings import _bigrams

    texts = ["abab", "x", "", "äöü😀b😀b", "aa", "a b c", "zz"]
    codes, at = _bigrams(texts)
    want = [sorted(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "s string").select(T.bigram_codes(F.col("s"))).collect()]
    assert [codes[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == want


def test_vector_takes_one_digest_per_line(spark):
    from lineaudit.catalog.exchange import _with_vectors

    rows = spark.createDataFrame([(["a", "b"],)], "scorable_line_texts array<string>")
    assert _plan(_with_vectors(rows)).count("sha1(") == 1


def test_significance_by_k_scores_once(records):
    from lineaudit.operators import significance as G

    rows = records(("s", "FAIL", 2, [2, 1], [0]), ("s", "PASS", 1, [1, 0], []), ("s", "FAIL", 3, [1, 3], [0]))
    out = G.significance_by_k(rows, rows.withColumn("run", F.lit("b")), ks=(1,), iters=2)
    assert "per_line_energies" not in _plan(out)


def test_quantiles_do_not_repeat_the_diff(spark):
    from lineaudit.functions import diffs
    from lineaudit.operators import corpus as C

    rows = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a"])], "a array<string>, b array<string>")
    out = C.diff_size_quantiles(rows.select(F.size(diffs.first_side()("a", "b")).alias("n_changed")))
    assert "first(" not in _plan(out)
    assert out.first()["small_share"] == 0.5


def test_diffs_take_some_rows_at_a_time():
    import pyarrow as pa

    from lineaudit.functions import diffs

    n = diffs.ROWS * 2 + 1
    a = pa.array([["x", "y"]] * n + [None], pa.list_(pa.string()))
    b = pa.array([["x"]] * n + [["x"]], pa.list_(pa.string()))
    assert diffs._per_row(diffs.changed_in_first)(a, b).to_pylist() == [[1]] * n + [None]


def test_token_ids_leave_some_rows_at_a_time():
    import pandas as pd

    from lineaudit.operators import models

    encode = models._encoder(lambda: lambda text: [len(text)]).func
    parts = list(encode(iter([pd.Series(["ab"] * (models.ROWS * 2) + [None])])))
    assert max(len(p) for p in parts) == models.ROWS and sum(len(p) for p in parts) == models.ROWS * 2 + 1
    assert parts[0].iloc[0] == [2] and parts[-1].iloc[0] is None


def test_exact_p_by_k_keeps_its_size(spark):
    from lineaudit.operators import significance as G

    def side(energies):
        return spark.range(1200).select(
            F.concat(F.lit("i"), "id").alias("impl_id"), F.lit("FAIL").alias("status"), F.lit(1.0).alias("whole_impl_energy"),
            F.array(*[F.lit(e) for e in energies]).alias("per_line_energies"), F.array(F.lit(0)).alias("buggy_line_indices"))

    out = G.significance_by_k(side([2.0, 1.0]), side([1.0, 2.0]).withColumn("run", F.lit("b")), ks=(1,), iters=1).first()
    assert abs(out["log10_p_exact_top1"] + 1199 * 0.30102999566398) < 1e-6


def test_combined_losses_score_once(records):
    """The parts of a combined loss read narrow rows that were written once, not the energies again."""
    from lineaudit.operators import losses as L

    rows = records(("s", "FAIL", 2, [2, 1], [0]), ("s", "PASS", 1, [1, 0], []), ("s", "FAIL", 3, [1, 3, 2], [0, 2]),
                   ("t", "FAIL", 1, [1], [0]), ("t", "PASS", 0, [], None), ("u", "FAIL", 4, [0, 4], [1])).withColumn("run", F.lit("r"))
    by = ["run"]
    parts = {"scalar": L.pair_hinge(rows, by), "list": L.line_listmle(rows, by, 2.0, True), "pair": L.line_semi_hard(rows, by, 1.0, 3),
             "spec": L.spec_infonce(rows, by), "line": L.line_hinge(rows, by)}
    want = {k: (v.first()["loss"], v.first()["n"]) for k, v in parts.items()}
    hybrid = L.hybrid(rows, by, 1.0, 0.5, 0.25, scalar="hinge", listwise="listmle", gamma=2.0, balance=True)
    contrastive = L.contrastive(rows, by, 1.0, 0.5)
    for out in (hybrid, contrastive, L.pair_logistic(rows, by), L.spec_infonce(rows, by)):
        assert "per_line_energies" not in _plan(out)
    got = hybrid.first().asDict() | contrastive.first().asDict()
    assert {k: (got[f"{k}_loss"], got[f"{k}_n"]) for k in want} == want
    assert got["n_rows"] == 6


def test_significance_interval_has_the_operators_resamples(monkeypatch):
    """The registered query draws as often as the operator does by itself, and its SQL as often."""
    import inspect

    from lineaudit.catalog import comparisons
    from lineaudit.operators import significance as G

    iters = inspect.signature(G.significance_by_k).parameters["iters"].default
    seen = {}

    def caught(*args, **kwargs):
        seen.update(kwargs)
        raise InterruptedError

    monkeypatch.setattr(comparisons, "_target_and_baselines", lambda spark, d: (None, None))
    monkeypatch.setattr(comparisons.G, "significance_by_k", caught)
    with pytest.raises(InterruptedError):
        comparisons.QUERIES["significance_by_k"](None, "")
    assert seen["iters"] == iters == 500
    assert f"unnest(range({iters})) as rep" in comparisons.ORACLE["significance_by_k"]


def test_resampled_areas_some_rows_at_a_time(spark, monkeypatch):
    """Equal scores reach over the blocks that a task draws and adds up, and the weights travel packed."""
    import numpy as np

    from lineaudit.operators import metrics as M
    from lineaudit.operators import sampling as Z

    rows = [(f"k{i}" if i % 17 else None, float(i % 5), float(i % 3), "FAIL" if i % 4 else "PASS") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, a double, b double, status string").repartition(3)
    found = []
    for drawn, held in ((Z._DRAWN, Z._HELD), (6, 12), (1, 1)):
        monkeypatch.setattr(Z, "_DRAWN", drawn)
        monkeypatch.setattr(Z, "_HELD", held)
        out = Z.bootstrap_auroc(df, ["a", "b"], M.fail_label(), "id", [], 6)
        found.append({(r["score"], r["rep"]): r["auc"] for r in out.collect()})
    assert len(found[0]) == 12 and found[0] == found[1] == found[2]
    for counts in ([0, 0], [1, 255], [0, 256], [70_000, 3]):
        packed = Z._packed(np.array(counts))
        assert Z._unpacked([packed], 2).tolist() == [counts]
    assert len(Z._packed(np.array([3, 1] * 250))) == 500
