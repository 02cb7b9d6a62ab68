import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineaudit.operators import field as D
from lineaudit.plans.merging import moments

SCHEMA = "id int, v array<double>"


def test_moments_of_usable_vectors(spark):
    x = np.random.default_rng(5).normal(size=(200, 3)) * [1, 2, 3] + [10, 0, -4]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 2.0]), (903, [1.0, math.nan, 2.0]), (904, [math.inf, 0.0, 0.0]), (905, [])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, SCHEMA).repartition(7)
    r = moments(rows, "v", 3).first()
    assert r["n"] == 200 and r["mean"] == pytest.approx(x.mean(axis=0).tolist())
    assert r["cov"] == pytest.approx(np.cov(x.T, bias=True)[np.triu_indices(3)].tolist())
    empty = moments(spark.createDataFrame([], SCHEMA), "v", 3).first()
    assert (empty["n"], empty["mean"], empty["cov"]) == (0, None, None)


def test_projection_against_a_plain_decomposition(spark):
    x = np.random.default_rng(8).normal(size=(150, 4)) @ np.diag([5.0, 3.0, 1.0, 0.5]) + 2.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0])], SCHEMA).withColumn("_base", F.lit("kept"))
    got = {r["id"]: r for r in D.project_2d(rows.withColumnRenamed("_base", "base"), "v", 4).collect()}
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred)[2][:2]
    axes = np.array([a * np.sign(a[np.abs(a).argmax()]) for a in axes])
    want = centred @ axes.T
    assert len(got) == 152 and got[500]["x"] is None and got[501]["y"] is None
    for i, (a, b) in enumerate(want):
        assert (got[i]["x"], got[i]["y"]) == pytest.approx((a, b), abs=1e-9)


def test_projection_of_one_point_and_of_none(spark):
    one = D.project_2d(spark.createDataFrame([(1, [1.0, 2.0, 3.0])] * 3, SCHEMA), "v", 3).collect()
    assert [(r["x"], r["y"]) for r in one] == [(0.0, 0.0)] * 3
    assert D.project_2d(spark.createDataFrame([], SCHEMA), "v", 3).count() == 0
    none = D.project_2d(spark.createDataFrame([(1, None)], SCHEMA), "v", 3).first()
    assert none["x"] is None and none["y"] is None
    line = D.project_2d(spark.createDataFrame([(1, [1.0]), (2, [3.0])], SCHEMA), "v", 1).orderBy("id").collect()
    assert [r["x"] for r in line] == [-1.0, 1.0] and line[0]["y"] is None
