"""Map tables: builder, layout, lookups."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lineaudit.operators import manifold as N
from lineaudit.sources import sinks as W

RECORD = ("impl_id string, spec_id string, status string, whole_impl_energy double, per_line_energies array<double>, "
          "buggy_line_indices array<int>, scorable_line_texts array<string>, line_vectors array<array<double>>")
IMPL = "impl_id string, spec_id string, status string, spec_text string, impl_text string"


def built(spark, n, lines=4):
    recs = [(f"i{i:05d}", f"s{i % 7}", "PASS" if i % 7 == 0 and i < 8 else "FAIL", float(i), [float(j) for j in range(lines)], [1],
             [f"line {j}" for j in range(lines)], [[float((i * 7 + j * j) % 11), float(j), float(i % 5)] for j in range(lines)]) for i in range(n)]
    impls = [(r[0], r[1], r[2], "spec", "text") for r in recs]
    return N.tables(spark.createDataFrame(recs, RECORD), spark.createDataFrame(impls + [("lone", "s0", "PASS", "", "")], IMPL), dim=3), recs


def test_tables_hold_means_flags_and_positions(spark):
    (impls, lines), recs = built(spark, 20)
    got = {r["impl_id"]: r for r in impls.collect()}
    assert set(got) == {r[0] for r in recs}
    for r in recs:
        mean = [sum(v[d] for v in r[7]) / len(r[7]) for d in range(3)]
        assert got[r[0]]["n_lines"] == 4 and all(math.isclose(a, b) for a, b in zip(got[r[0]]["vector"], mean))
        assert got[r[0]]["has_pass_sibling"] == any(o[1] == r[1] and o[2] == "PASS" and o[0] != r[0] for o in recs)
        assert got[r[0]]["x"] is not None and got[r[0]]["y"] is not None
    rows = lines.collect()
    assert len(rows) == 80 and {r["line_idx"] for r in rows if r["is_buggy"]} == {1}


def test_odd_records(spark):
    rows = [("a", "s", "FAIL", 1.0, [1.0, 2.0], None, ["x", "y"], [[1.0, 2.0, 3.0], None]), ("b", None, None, None, [], [], [], []),
            ("c", "s", "PASS", 1.0, [1.0, 2.0], [0], ["x", "y"], [[1.0, 0.0, 3.0]])]
    recs = spark.createDataFrame(rows, RECORD)
    impls, lines = N.tables(recs, spark.createDataFrame([(i, "s", "FAIL", None, None) for i in "abc"], IMPL), dim=3)
    got = {r["impl_id"]: r for r in impls.collect()}
    assert got["b"]["vector"] is None and got["b"]["x"] is None and got["b"]["n_lines"] == 0 and got["c"]["n_lines"] == 1
    assert sorted((r["impl_id"], r["line_idx"], r["x"] is None) for r in lines.collect()) == [("a", 0, False), ("a", 1, True), ("c", 0, False)]
    impls, lines = N.tables(recs.limit(0), spark.createDataFrame([], IMPL), dim=3)
    assert impls.count() == 0 and lines.count() == 0


def test_lookup_reads_few_rows(spark, tmp_path):
    (impls, lines), _ = built(spark, 5000)
    folder = str(tmp_path / "map")
    N.write(impls, lines, folder, rows_per_group=500)
    impl, own = N.detail(spark, folder, "i02345")
    assert [r["line_idx"] for r in own.collect()] == [0, 1, 2, 3] and impl.first()["impl_id"] == "i02345"
    assert N.detail(spark, folder, "nobody")[0].count() == 0

    scan = N.read(spark, folder, "lines").filter(F.col("impl_id") == "i02345").select("line_idx")
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan()
    assert "EqualTo(impl_id,i02345)" in plan.toString()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().get("numOutputRows").get().value() <= 2000
    page = N.light(spark, folder, "lines", limit=3, offset=4)
    assert [(r["impl_id"], r["line_idx"]) for r in page.collect()] == [("i00001", 0), ("i00001", 1), ("i00001", 2)]
    assert "vector" not in page.columns and N.light(spark, folder, "impls").count() == 5000


def test_latex_document_dashes(spark):
    table = spark.createDataFrame(
        [("weak_records", 10, 0.5, 0.25, 0.0005, 0.75, 0.75, 1.0, None, 0.5, None, None, None), ("b", 3, 0.1, 0.2, 0.00001, 0.1, 0.2, 0.5, 0.9, 0.5, 0.04, 0.1, 0.3)],
        "run string, n_paired long, target_top1 double, baseline_top1 double, p_mcnemar_top1 double, target_top3 double, baseline_top3 double, "
        "p_mcnemar_top3 double, auc_a double, auc_b double, p double, diff_lo double, diff_hi double")
    rows = [r["line"] for r in W.latex_document(table, interval=True).orderBy("position", "run").collect()]
    assert r"b & 3 & 0.200 vs 0.100 & $<10^{-4}$ & 0.200 vs 0.100 & $0.500$ & 0.500 vs \textbf{0.900} & $0.040$ & [0.100, 0.300] \\" in rows
    assert r"weak & 10 & 0.250 vs \textbf{0.500} & $5.00\times 10^{-4}$ & 0.750 vs 0.750 & $1.000$ & 0.500 vs --- & --- & --- \\" in rows
    assert rows[0] == r"\begin{table}[t]" and rows[-1] == r"\end{table}" and rows[5] == r"\begin{tabular}{lrrrrrrrr}"
