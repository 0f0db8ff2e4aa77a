"""Group values joined back: null keys, heavy keys spread by the sketch, light ones with one copy."""

from pyspark.sql import functions as F

from spendlens.operators.attach import attach, heavy_hitter_salts
from spendlens.session import release, reused


def frame(spark):
    """3,000 rows: a third of them one key, a fifth null, the others 7 rows a key."""
    key = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE concat('k', id % 200) END"
    return spark.range(3000).selectExpr(f"{key} AS k", "id AS n")


def test_same_rows_with_and_without_salts(spark):
    rows = frame(spark)
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    want = sorted(map(tuple, attach(rows, table, ["k"]).select("k", "n", "size").collect()), key=str)
    for how in ("inner", "left"):
        got = attach(rows, table, ["k"], spread="n", how=how, least_rows=10)
        assert got.columns == ["k", "n", "size"] and sorted(map(tuple, got.collect()), key=str) == want
    some = attach(rows, table.where("k = 'hot'"), ["k"], spread="n", how="left", least_rows=10)
    assert some.count() == 3000 and some.where("size IS NOT NULL").count() == 1000


def test_only_heavy_keys_get_salts(spark):
    rows = frame(spark)
    salts = rows.sparkSession.range(1).select(heavy_hitter_salts(rows, ["k"], 100).alias("s")).first().s
    hashed = {r.k: r.h for r in rows.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    # 4 partitions: a task's due is 750 rows
    assert salts == {hashed["hot"]: 2}
    assert rows.sparkSession.range(1).select(heavy_hitter_salts(rows, ["k"]).alias("s")).first().s == {}
    assert rows.sparkSession.range(1).select(heavy_hitter_salts(rows.where("false"), ["k"]).alias("s")).first().s == {}


def test_light_keys_have_one_copy(spark):
    rows = frame(spark)
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size")).withColumn("copies_of", F.monotonically_increasing_id())
    spread = attach(rows, table, ["k"], spread="n", least_rows=10).groupBy("k").agg(F.countDistinct("copies_of").alias("c"))
    assert spread.where("c <> 1").count() == 0


def test_release(spark):
    release(spark, shared=True)
    a, b = reused(spark.range(3)), reused(spark.range(4), shared=True)
    assert release(spark) == 1 and not a.is_cached and b.is_cached and spark.range(4).storageLevel.useMemory
    assert release(spark, shared=True) == 1 and not spark.range(4).storageLevel.useMemory and b.count() == 4
