"""Comparisons from moments and counts against plain formulas."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlens.operators.compare import chi_square, standardised_differences, welch
from spendlens.operators.summary import group_measures, level_counts


def rows(seed, n=200):
    rnd = random.Random(seed)
    return [(rnd.choice("ABC"), rnd.choice(["u", "v"]), rnd.gauss(2, 3) if rnd.random() < .9 else None, rnd.choice(["x", "y", "z", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_formulas(spark, seed):
    data = rows(seed) + [(None, "u", 5.0, "x")]
    df = spark.createDataFrame(data, "category string, k string, m double, l string")
    agg = group_measures(df, ["m"], "category", ["k"])
    f = {r.k: r for r in welch(agg, ["m"], keys=["k"]).collect()}
    d = {r.k: r.difference for r in standardised_differences(agg, ["m"], ("A", "C"), keys=["k"]).collect()}
    c = {r.k: r for r in chi_square(level_counts(df, ["k", "l", "category"]), ["l"], keys=["k"]).collect()}
    for key in "uv":
        groups = {g: [m for a, b, m, _ in data if a == g and b == key and m is not None] for g in "ABC"}
        n, mean, var = ([fn(x) for x in groups.values()] for fn in (len, statistics.mean, statistics.variance))
        w = [a / b for a, b in zip(n, var, strict=True)]
        centre = sum(a * b for a, b in zip(w, mean, strict=True)) / sum(w)
        part = sum((1 - a / sum(w)) ** 2 / (b - 1) for a, b in zip(w, n, strict=True))
        between = sum(a * (b - centre) ** 2 for a, b in zip(w, mean, strict=True)) / 2
        assert f[key].statistic == pytest.approx(between / (1 + 2 * part / 8)) and f[key].df1 == 2 and f[key].df2 == pytest.approx(8 / (3 * part))
        assert d[key] == pytest.approx((mean[0] - mean[2]) / ((var[0] + var[2]) / 2) ** 0.5)
        cells = Counter((x, a) for a, b, _, x in data if b == key and x and a)
        total = sum(cells.values())
        expected = {(x, a): sum(v for (y, _), v in cells.items() if y == x) * sum(v for (_, g), v in cells.items() if g == a) / total for x in "xyz" for a in "ABC"}
        assert c[key].statistic == pytest.approx(sum((cells[p] - e) ** 2 / e for p, e in expected.items())) and c[key].df1 == 4


def test_groups_without_spread_or_alone(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", 2.0), ("B", 4.0), ("C", 3.0)], "category string, m double")
    agg = group_measures(df, ["m"], "category")
    assert welch(agg, ["m"]).first().statistic is None
    assert welch(agg.where(F.col("category") == "B"), ["m"]).first().statistic is None
    assert standardised_differences(agg, ["m"], ("A", "Z")).first().difference is None
    assert chi_square(level_counts(df, ["category"]).withColumn("l", F.lit(None).cast("string")), ["l"]).count() == 0
