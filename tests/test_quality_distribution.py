"""Profiling (P2-P8) and histogram / density."""

import math

import pytest

from salesmart.operators import distribution as D
from salesmart.operators import quality as Q
from salesmart.operators.reports import value_split


def test_profile(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, 3.0, None)], "a int, b double, `c c` string")
    n = {r["coluna"]: r for r in Q.profile_nulls(df).collect()}
    assert n["b"]["nulos"] == 2 and n["b"]["pct_nulos"] == pytest.approx(66.67) and n["c c"]["nulos"] == 1
    assert [r["coluna"] for r in Q.top_nulls(df, 2).collect()] == ["b", "c c"]
    d = Q.duplicate_rows(df).first()
    assert d["linhas_duplicadas"] == 1 and d["linhas_distintas"] == 2  # null equals null
    assert Q.profile_shape(df, "t").first()["colunas"] == 3
    assert dict(Q.column_types(spark, df).collect())["a"] == "int"
    tc = {r[0]: r[1] for r in Q.table_counts({"x": df, "y": df.limit(1)}).collect()}
    assert tc == {"x": 3, "y": 1}
    assert [r["a"] for r in Q.head(df, ["a"], 1).collect()] == [1]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]], "x double")
    h = D.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["contagem"] for r in h] == [2, 2, 1, 0, 1]  # [0,2) [2,4) [4,6) [6,8) [8,10]: max in the last bin
    assert sum(r["contagem"] for r in h) == 6 and h[0]["inicio"] == 0.0 and h[-1]["fim"] == 10.0
    one = D.histogram(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x", 40).collect()
    assert len(one) == 1 and one[0]["contagem"] == 2  # one distinct value: one bin


def test_density_matches_formula(spark):
    xs = [1.0, 2.0, 2.0, 3.5, 7.0]
    out = D.density(spark.createDataFrame([(v,) for v in xs], "x double"), "x", grid=11).orderBy("ponto").collect()
    n = len(xs)
    mean = sum(xs) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in xs) / (n - 1))
    h = sd * n ** -0.2
    for r in out:
        g = 1.0 + 6.0 * r["ponto"] / 10
        f = sum(math.exp(-0.5 * ((g - v) / h) ** 2) for v in xs) / (n * h * math.sqrt(2 * math.pi))
        assert r["densidade_x1e6"] == pytest.approx(f * 1e6, abs=1e-5)


def test_value_split(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (None,)], "f int")
    got = {r["valor"]: (r["contagem"], r["pct"]) for r in value_split(df, "f").collect()}
    assert got[1][0] == 2 and got[0][1] == pytest.approx(100 / 3)
