"""Exact decile bands: fixed cases, duplicates, and brute force on random data."""

import random

import pytest
from pyspark.sql import functions as F

from spendlens.operators.quantile_bands import (band_bounds, band_expr, band_intervals, check_edges, exact_quantile_edges,
                                                quantile_edges, with_group_band, with_value_band)


def brute_edges(values, q=10):
    xs = sorted(v for v in values if v is not None)
    n = len(xs)
    return [xs[((n - 1) * i) // q] for i in range(q + 1)]


def brute_band(x, edges):
    return 1 + sum(1 for e in edges[1:-1] if x > e)


def test_fixture_case(spark):
    vals = [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    out = [r.b for r in with_value_band(df, "v", "b").orderBy("id").collect()]
    assert out == [1, 1, 2, 3, 3, 4, 5, 5, 6, 7, 8, 8, 9, 10, 10]


def test_duplicate_edges(spark):
    vals = [0.0] * 8 + [1.0, 2.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    edges = exact_quantile_edges(df, "v")[None]
    with pytest.raises(ValueError):
        check_edges(edges, "raise")
    interior = check_edges(edges, "merge")
    out = sorted(r.b for r in df.select(band_expr(F.col("v"), interior).alias("b")).collect())
    assert out[0] == 1 and max(out) == len(interior) + 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(50, 400)
    vals = [float(rnd.randint(-50, 50)) if rnd.random() < 0.3 else rnd.uniform(-1e3, 1e3)
            for _ in range(n)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double") \
        .repartition(5)
    # tiny parts force several rounds, and cells with many ranks
    edges = exact_quantile_edges(df, "v", leaf_rows=9, splits=4)[None]
    assert list(edges) == brute_edges(vals)
    if len(set(edges.interpolated)) == len(edges):
        got = {r.id: r.b for r in with_value_band(df, "v", "b", leaf_rows=60).collect()}
        assert all(got[i] == brute_band(v, edges) for i, v in enumerate(vals))


def test_null_is_a_group(spark):
    rows = [(None, float(i)) for i in range(21)] + [("b", float(-i)) for i in range(31)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert list(exact_quantile_edges(df, "v", by="g")[None]) == brute_edges([float(i) for i in range(21)])
    out = {(r.g, r.v): r.b for r in with_group_band(df, "v", "g", quantile_edges(df, "v", by="g"), "b").collect()}
    assert out[None, 0.0] == 1 and out[None, 20.0] == 10 and out["b", None] is None


@pytest.mark.parametrize(("leaf_rows", "splits"), [(250_000, 64), (20, 4)])
def test_thousands_of_groups_in_one_plan(spark, leaf_rows, splits):
    """2,000 groups of one to sixty values, a null group, infinities, repeats, NaN and null values."""
    rnd = random.Random(9)
    special = [float("inf"), float("-inf"), 0.0, -0.0, 1e300]
    rows = []
    for g in [None, *range(2000)]:
        for _ in range(rnd.randint(1, 60)):
            rows.append((g, rnd.choice(special) if rnd.random() < 0.05 else rnd.uniform(-9, 9) if rnd.random() < 0.8 else float(rnd.randint(0, 3))))
        rows += [(g, None), (g, float("nan"))]
    rows.append((5000, None))  # a group without values has no edges
    df = spark.createDataFrame(rows, "g int, v double").repartition(4)
    got = {}
    for r in quantile_edges(df, "v", by="g", leaf_rows=leaf_rows, splits=splits).collect():
        got.setdefault(r.g, {})[r.i] = (r.n, r.lower, r.upper)
    values = {}
    for g, v in rows:
        if v is not None and v == v:
            values.setdefault(g, []).append(v)
    assert got.keys() == values.keys()
    for g, vs in values.items():
        xs, last = sorted(vs), len(vs) - 1
        assert got[g] == {i: (len(vs), xs[last * i // 10], xs[-(-last * i // 10)]) for i in range(11)}


def test_bands_of_many_groups(spark):
    rnd = random.Random(11)
    rows = [(g, rnd.uniform(-5, 5)) for g in [None, "a", "b", "c"] for _ in range(rnd.randint(20, 90))]
    df = spark.createDataFrame(rows, "g string, v double")
    edges = quantile_edges(df, "v", by="g", leaf_rows=15, splits=3)
    for r in with_group_band(df, "v", "g", edges).collect():
        assert r.band == brute_band(r.v, brute_edges([v for g, v in rows if g == r.g]))
    bounds = {(r.g, r.band): (r.lo, r.hi) for r in band_bounds(edges, "g").collect()}
    own = brute_edges([v for g, v in rows if g == "a"])
    assert [bounds["a", k + 1] for k in range(10)] == list(zip(own, own[1:]))


def test_duplicates_in_a_group(spark):
    rows = [("a", 0.0)] * 8 + [("a", 1.0), ("a", 2.0)] + [("b", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, v double")
    edges = quantile_edges(df, "v", by="g")
    with pytest.raises(Exception, match="Bin edges must be unique"):
        with_group_band(df, "v", "g", edges).collect()
    interior = check_edges(exact_quantile_edges(df, "v", by="g")["a"], "merge")
    for r in with_group_band(df, "v", "g", edges, on_duplicates="merge").where("g = 'a'").collect():
        assert r.band == 1 + sum(r.v > e for e in interior)


def test_one_value_repeated_beyond_a_part(spark):
    df = spark.createDataFrame([(7.0,)] * 500 + [(float(i),) for i in range(7)], "v double")
    assert list(exact_quantile_edges(df, "v", leaf_rows=50, splits=4)[None]) == brute_edges([7.0] * 500 + [float(i) for i in range(7)])


def test_plan_does_not_grow_with_the_groups(spark):
    plans = []
    for groups in (4, 400):
        df = spark.range(groups * 30).selectExpr(f"id % {groups} AS g", "cast(id as double) AS v")
        edges = quantile_edges(df, "v", by="g")
        plans.append(len(with_group_band(df, "v", "g", edges)._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[1] < 1.05 * plans[0]


def test_intervals(spark):
    df = spark.createDataFrame([(float(i),) for i in range(16)], "v double")
    rows = [tuple(r) for r in band_intervals(quantile_edges(df, "v"), "group").orderBy("band").collect()]
    assert rows[0] == (0, 1, -0.001, 1.5, "(-0.001, 1.5]") and rows[-1][1:] == (10, 13.5, 15.0, "(13.5, 15.0]")


def test_grouped_edges(spark):
    rows = [("a", float(i)) for i in range(21)] + [("b", float(i * i)) for i in range(31)]
    df = spark.createDataFrame(rows, "g string, v double")
    e = exact_quantile_edges(df, "v", by="g")
    assert list(e["a"]) == brute_edges([float(i) for i in range(21)])
    assert list(e["b"]) == brute_edges([float(i * i) for i in range(31)])


def test_rounds_do_not_multiply_the_plan(spark):
    """Each round adds the rows' plan a constant number of times, and the edges are right."""
    df = spark.range(2000).selectExpr("cast(id * 7919 % 2003 as double) AS v")
    edges = quantile_edges(df, "v", leaf_rows=250, splits=4)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert 1 < plan.count("Range (") <= 8
    values = sorted(i * 7919 % 2003 for i in range(2000))
    assert {r.i: r.lower for r in edges.collect()} == {i: float(values[1999 * i // 10]) for i in range(11)}


def _written(folder, base=2000):
    """Tables of our own: ``base`` people with a survey, a line of the first year and a customer value each."""
    import datetime as dt
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    n = range(base)
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    tables = {
        "customer": {"c_custkey": list(n), "c_nationkey": pa.array([i % 25 for i in n], pa.int32()), "c_acctbal": [i * 0.37 - 99 for i in n],
                     "c_mktsegment": [segments[i % 5] for i in n]},
        "orders": {"o_orderkey": [3 * i + 1 for i in n], "o_custkey": list(n), "o_orderstatus": ["F" if i % 2 else "O" for i in n],
                   "o_orderdate": pa.array([dt.datetime(2000, 1 + i % 6, 1 + i % 28) for i in n], pa.timestamp("us")),
                   "o_orderpriority": ["1-URGENT" if i % 3 else "5-LOW" for i in n]},
        "lineitem": {"l_orderkey": [3 * i + 1 for i in n], "l_suppkey": [i % 7 for i in n], "l_extendedprice": [100.005 + i for i in n],
                     "l_discount": [0.05] * base, "l_tax": [0.02] * base, "l_quantity": [float(1 + i % 9) for i in n],
                     "l_returnflag": ["A" if i % 2 else "N" for i in n], "l_linestatus": ["F"] * base},
        "nation": {"n_nationkey": pa.array(range(25), pa.int32()), "n_name": [f"NATION_{i}" for i in range(25)], "n_regionkey": pa.array([i % 5 for i in range(25)], pa.int32())},
        "region": {"r_regionkey": pa.array(range(5), pa.int32()), "r_name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]},
    }
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), os.path.join(folder, f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["cohort_grid_by_segment", "balance_quota"])
def test_a_large_base_is_one_file_scan_in_the_plans(spark, tmp_path, monkeypatch, name):
    from spendlens.plans import queries as Q

    folder = _written(tmp_path)
    plain = Q.QUERIES[name](spark, folder)
    monkeypatch.setattr(Q, "MOST_ROWS", 500)
    large = Q.QUERIES[name](spark, folder)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString() for df in (plain, large)]
    assert "l_extendedprice" in plans[0] and "l_extendedprice" not in plans[1] and len(plans[1]) < 0.5 * len(plans[0])
    rows = [sorted(map(repr, df.collect())) for df in (plain, large)]
    assert rows[0] == rows[1] and rows[0]


def test_lines_are_converted_after_the_join(spark, tmp_path):
    """The shuffled lines carry the table's own numbers; decimals are made of those of the two years."""
    from spendlens.plans.queries import tables

    frame = tables(spark, _written(tmp_path, 300)).customer_years()
    lines = frame._jdf.queryExecution().logical().toString().split("\n")
    join = next(i for i, line in enumerate(lines) if "Join " in line)
    made = [i for i, line in enumerate(lines) if "cast('l_extendedprice" in line or "cast(l_extendedprice" in line]
    assert made and max(made) < join
    total = frame.agg(F.sum("ticket_1").cast("string")).first()[0]
    assert total == "74853.00"
