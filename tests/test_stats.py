import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from innsight.functions import frames, geo
from innsight.functions.stats import (
    bh_qvalues, counts_up_to, student_quantile, student_tail, wilson, with_t_tests, z_two_sided,
)


def test_student_tail():
    t = [2.228, 2.571, 12.706, 4.032, 3.169, 1.96, -2.228, math.inf, -math.inf]
    dof = [10, 5, 1, 5, 10, 1e6, 10, 3, 3]
    want = [.025, .025, .025, .005, .005, .025, .975, 0, 1]
    assert np.allclose(student_tail(np.array(t), np.array(dof)), want, atol=2e-5)
    assert np.isnan(student_tail(np.array([math.nan, 1.0]), np.array([3.0, 0.0]))).all()
    x = np.array([0.3, 1.0, 7.0, 900.0])  # one degree of freedom has a closed form
    exact = 0.5 - np.arctan(x) / np.pi
    assert np.allclose(student_tail(x, np.ones(4)), exact, rtol=1e-9)


def test_student_quantile():
    got = student_quantile(np.array([.975, .95, .5, .025]), np.array([10, 5, 7, 30]))
    assert np.allclose(got, [2.2281, 2.0150, 0, -2.0423], atol=1e-4)


def bh(values):
    m, order = len(values), sorted(range(len(values)), key=lambda i: values[i])
    out, low = [0.0] * m, 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        low = min(low, values[i] * m / rank)
        out[i] = low
    return out


@pytest.mark.parametrize("limit", [0, 1000])
def test_bh(spark, limit):
    hand = [.01, .04, .03, .005]
    many = [((i * 7919) % 1000) / 1000 for i in range(700)] + [1.0] * 300 + [0.0, 1e-30, 1e-9]
    data = [(0, i, p) for i, p in enumerate(hand)] + [(1, i, p) for i, p in enumerate(many)]
    df = spark.createDataFrame(data + [(1, 9999, None)], "fam int, i int, p_value double")
    got = {(r["fam"], r["i"]): r["q_value"]
           for r in bh_qvalues(df, "p_value", ["fam"], bounded=bool(limit)).collect()}
    assert got.pop((1, 9999)) is None
    assert np.allclose([got[0, i] for i in range(4)], [.02, .04, .04, .02])
    assert np.allclose([got[1, i] for i in range(len(many))], bh(many), rtol=1e-12)


def test_ranks_in_buckets(spark):
    values = [((i * 31) % 97) / 97 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("f", F.lit(1))
    for r in counts_up_to(df, "v", ["f"]).collect():
        assert r["rank"] == sum(v <= r["v"] for v in values) and r["size"] == 500


def test_intervals(spark):
    df = spark.range(1).select(F.lit(6).alias("k"), F.lit(10).alias("n"))
    low, high = df.select(*wilson(F.col("k"), F.col("n"))).first()
    assert (round(low, 3), round(high, 3)) == (.313, .832)
    rows = spark.createDataFrame([(1.0, 0.0, 5.0), (0.0, 0.0, 5.0), (2.228, 1.0, 10.0)],
                                 "effect double, se double, dof double")
    p = [r["p_two_sided"] for r in with_t_tests(rows).collect()]
    assert p[0] == 0 and p[1] == 1 and abs(p[2] - .05) < 1e-4
    z = spark.createDataFrame([(1.96,)], "z double").select(z_two_sided("z")).first()[0]
    assert abs(z - .05) < 1e-4


def test_printing(spark):
    values = [0.945, -0.945, 0.125, 0.375, 2.675, -0.005, 1.005, 12.3456]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(frames.decimals(F.col("v"), 2, signed=True)).collect()]
    assert got == [f"{v:+.2f}" for v in values]


def test_natural_order(spark):
    names = ["P10", "P2", "p1", "Q"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(frames.natural_key(F.col("n"))).collect()]
    assert got == ["p1", "P2", "P10", "Q"]


def test_haversine(spark):
    km = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert abs(km.first()[0] - 111.19) < 0.01


def test_two_sided_tail_is_even(spark):
    df = spark.createDataFrame([(20.0, 1.0, 50.0), (-20.0, 1.0, 50.0), (0.0, 1.0, 50.0)], "effect double, se double, dof double")
    p = [r["p_two_sided"] for r in with_t_tests(df).collect()]
    assert p[0] == p[1] and np.isclose(p[0], 1.65e-25, rtol=1e-2) and np.isclose(p[2], 1.0)


def test_rounding_decides_on_the_binary_value(spark):
    from innsight.functions.frames import half_even

    values = [(0.5335, 3), (2.675, 2), (0.125, 2), (0.375, 2), (-0.5335, 3), (1e-9, 3), (1234.5675, 3)]
    for value, digits in values:
        got = spark.createDataFrame([(value,)], "v double").select(half_even(F.col("v"), digits)).first()[0]
        assert got == round(value, digits), (value, got)
