"""Versioned tables: readers follow the manifest, a writer killed half-way changes nothing, two writers get two numbers."""

import tempfile

import pytest
from pyspark.sql import functions as F

from spendlens.plans.incremental import LatestSurveys
from spendlens.sources.versions import VersionedTable


@pytest.fixture
def table(spark):
    return VersionedTable(spark, tempfile.mkdtemp(prefix="spendlens-test-") + "/t")


def test_write_read_and_history(spark, table):
    with pytest.raises(LookupError):
        table.read()
    first = table.write(spark.range(3).toDF("a"), notes={"who": "x"})
    old = table.read()
    table.write(spark.range(5).selectExpr("id AS a", "id % 2 AS b"), partition_by=["b"])
    assert table.numbers() == [1, 2] and table.version().n_rows == 5 and table.version(1).notes == {"who": "x"}
    assert table.read().columns == ["a", "b"] and table.read().count() == 5
    assert sorted(r.a for r in old.collect()) == [0, 1, 2] == sorted(r.a for r in table.read(first.number).collect())


def test_killed_writer_leaves_the_former_version(spark, table):
    table.write(spark.range(3).toDF("a"))
    staged = table.stage(spark.range(100).toDF("a"))  # all files written, the manifest never put
    with pytest.raises(Exception, match="boom"):
        table.write(spark.range(50).select(F.when(F.col("id") == 49, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("a")))
    assert table.read().count() == 3 and table.numbers() == [1]
    gone = table.vacuum()
    assert staged in gone and table.read().count() == 3


def test_writers_of_one_number(spark, table):
    other = VersionedTable(spark, table.path)
    df = spark.range(2).toDF("a")
    a, b = table.stage(df), other.stage(df)
    seen = other.numbers
    stale = [seen()]
    other.numbers = lambda: stale.pop() if stale else seen()  # the second writer looked before the first one committed
    table.commit(a, df.schema)
    assert other.commit(b, df.schema).number == 2 and table.numbers() == [1, 2]


def test_vacuum_keeps_the_last_versions(spark, table):
    for n in range(4):
        table.write(spark.range(n + 1).toDF("a"))
    assert len(table.vacuum(keep=2)) == 2 and table.numbers() == [3, 4] and table.read(3).count() == 3


def surveys(spark):
    rows = [(p, p * 10 + k, f"2000-0{m}-15") for p in range(20) for k, m in enumerate([(p + 3 * j) % 8 + 1 for j in range(4)])]
    rows += [(None, 900, "2000-03-01"), (3, 901, None), (5, 902, "2000-08-15"), (6, 60, "2000-06-15")]
    return spark.createDataFrame(rows, "party_id long, survey_id long, survey_dt string").withColumn("survey_dt", F.to_date("survey_dt"))


def test_batches_equal_the_whole_late_rows_included(spark, table):
    df = surveys(spark)
    whole = LatestSurveys(VersionedTable(spark, table.path + "-whole"), "2000-02-01", "2000-07-31")
    whole.advance(df)
    want = sorted(map(tuple, whole.state().collect()))
    state = LatestSurveys(table, "2000-02-01", "2000-07-31")
    newest_first = [("new", df.where("survey_dt >= '2000-05-01'")), ("late", df.where("survey_dt < '2000-05-01' OR survey_dt IS NULL")), ("again", df.limit(9))]
    assert sorted(map(tuple, state.advance_all(newest_first).collect())) == want and len(want) == 20
    assert [table.version(n).notes["batch"] for n in table.numbers()] == ["new", "late", "again"]


def test_stream_of_surveys(spark, table):
    df, folder = surveys(spark), tempfile.mkdtemp(prefix="spendlens-test-")
    for k in range(2):
        df.where(F.pmod("survey_id", F.lit(2)) == k).write.mode("append").parquet(f"{folder}/in")
    state = LatestSurveys(table, "2000-02-01", "2000-07-31")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    state.advance_stream(source, f"{folder}/checkpoint").awaitTermination(120)
    whole = LatestSurveys(VersionedTable(spark, table.path + "-whole"), "2000-02-01", "2000-07-31")
    whole.advance(df)
    assert sorted(map(tuple, state.state().collect())) == sorted(map(tuple, whole.state().collect()))
