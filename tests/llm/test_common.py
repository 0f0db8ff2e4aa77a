"""Written tables and free names."""

import os

from pyspark.sql import functions as F

from spendlens.llm.common import materialize, prepare, release, shared_dir, unused


def test_tables_are_written_to_the_shared_folder_and_released(spark):
    top = shared_dir(spark).removeprefix("file:")
    df = materialize(spark.range(5).toDF("n"), "test")
    assert sorted(r.n for r in df.collect()) == list(range(5)) and df.inputFiles()[0].startswith(f"file://{top}/llm/")
    assert materialize(spark.range(0).toDF("n"), "empty").count() == 0
    release(spark)
    assert not os.path.exists(f"{top}/llm/{spark.sparkContext.applicationId}")


def test_unused(spark):
    assert unused(spark.range(1).selectExpr("id AS _X", "id AS _x_"), "_x") == "_x__"


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    prepare(spark)
    long = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 300 and max(r.size for r in got) < 5 << 20
