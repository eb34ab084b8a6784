"""Quantiles by selection against numpy, and how many rows their passes hold."""

import math

import numpy as np
import pytest

from tripmill.functions.quantiles import quantiles
from tripmill.operators import report

SHARES = (0.0, 0.1, 0.25, 0.5, 1 / 3, 0.9, 0.999, 1.0)


def found(df, *by, **options):
    return {tuple(r[b] for b in by): (r.n, list(r.q)) for r in quantiles(df, "v", by, SHARES, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"most": 0}, {"most": 20, "bins": 256, "most_groups": 1}])
def test_quantiles(spark, options):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=800), "ties": rng.integers(0, 9, 700).astype(float), "wide": 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "same": np.full(500, 7.25),
        "near": 1 + rng.integers(0, 5, 200) * 2.0**-52, "outlier": np.r_[rng.normal(size=300), 1e12], None: rng.uniform(size=150), "zero": np.array([0.0] * 40 + [-0.0] * 40 + [1.0]),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("ties", None), ("ties", math.nan), ("ties", math.inf), ("ties", -math.inf), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = found(df, "g", **options)
    assert set(got) == {(g,) for g in groups}
    for g, xs in groups.items():
        assert got[(g,)][0] == len(xs)
        np.testing.assert_allclose(got[(g,)][1], np.quantile(xs, SHARES), rtol=1e-12, atol=0 if g == "near" else 1e-300, err_msg=str(g))


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.range(1001).selectExpr("CAST(id AS DOUBLE) AS v", "id % 2 AS a", "id % 3 AS b")
    assert found(df, most=10, bins=32)[()][1] == pytest.approx([1000 * s for s in SHARES])
    assert found(df, "a", "b", most=10)[(1, 2)][1] == pytest.approx(np.quantile(np.arange(5, 1001, 6), SHARES).tolist())
    assert found(df.where("false"), "a") == {} and found(df.where("false")) == {}


def test_describe_without_speeds(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "road_type string, speed double")
    got = {r.road_type: (r.n, r.min, r.q25, r.q50, r.q75, r.max) for r in report.speed_describe(df, "road_type").collect()}
    assert got == {"a": (2, 1.0, 1.25, 1.5, 1.75, 2.0), "b": (0, None, None, None, None, None)}
    assert [(r.quantile, r.speed) for r in report.speed_distribution(df, parts=2).orderBy("quantile").collect()] == [(0.0, 1.0), (0.5, 1.5), (1.0, 2.0)]


def test_a_pass_shuffles_counts(spark):
    """A hundred thousand distinct values, of which a task may read out a hundred."""
    df = spark.range(100_000).selectExpr("sin(id) AS v")
    assert found(df, most=100)[()][1] == pytest.approx(np.quantile(np.sin(np.arange(100_000)), SHARES).tolist())
    plan = quantiles(df, "v", (), SHARES, most=100)._jdf.queryExecution().toString()
    assert "percentile" not in plan
