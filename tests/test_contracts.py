"""Schema contracts: a renamed column raises, bad rows are told apart, the report counts what plain code counts."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001
from spendlens.plans.population import build_population
from spendlens.sources.contracts import Contract, Expect, SchemaError, accepted, check_columns, contract_report, quarantine
from spendlens.sources.relations import CONTRACTS, conform
from spendlens.sources.tpch_binding import LABELS, Binding, BoundTables

DEMO = Contract("demo", (Expect("id", T.LongType(), 0.0), Expect("amount", T.DecimalType(10, 2), 0.25, least=0), Expect("flag", T.StringType(), allowed=("Y", "N")),
                         Expect("x", T.DoubleType()), Expect("note", T.StringType(), optional=True)), key=("id",))
ROWS = [(1, "10.00", "Y", 1.0), (2, "-1", "N", float("nan")), (2, "abc", "Q", None), (None, None, None, 2.0), (4, None, "Y", 3.0)]


def demo(spark):
    return spark.createDataFrame(ROWS, "id long, amount string, flag string, x double")


def test_renamed_spend_column_raises(spark):
    tables = BoundTables(spark, SF001)

    class Renamed(dict):
        def __missing__(self, name):
            return tables[name]

    with pytest.raises(SchemaError, match="spend_y2: own_rev .* is missing"):
        conform(tables["spend_y2"].withColumnRenamed("own_rev", "own_revenue"), "spend_y2")
    known = conform(tables["spend_y2"].drop("national_ind"), "spend_y2", absent=["national_ind"])
    b = Binding()
    pop = build_population(Renamed(spend_y2=known), b.survey_start, b.survey_end, LABELS, ["own_rev_y2", "national_ind"])
    assert pop.where("own_rev_y2 IS NOT NULL").count() > 0 and pop.where("national_ind IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        conform(tables["spend_y2"], "spend_y2", absent=["nothing"])


def test_types_that_cannot_be_cast_raise(spark):
    check_columns(demo(spark), DEMO)
    with pytest.raises(SchemaError, match="amount is array<int>"):
        check_columns(demo(spark).withColumn("amount", F.array(F.lit(1))), DEMO)
    assert all(c.columns for c in CONTRACTS.values())


def test_quarantine_and_accepted(spark):
    bad = {(r.id, r.amount): set(r.broken) for r in quarantine(demo(spark), DEMO).collect()}
    assert bad == {(2, "-1"): {"amount: least"}, (2, "abc"): {"amount: type", "flag: allowed"}, (None, None): {"id: key is null"}}
    good = accepted(demo(spark), DEMO)
    assert [f.dataType for f in good.schema.fields] == [e.type for e in DEMO.columns]
    assert sorted(r.id for r in good.collect()) == [1, 4]


def test_report(spark):
    got = {(r.column, r.rule): (r.observed, r.n_rows, r.bound, r.passed) for r in contract_report(demo(spark), DEMO).collect()}
    assert got["id", "nulls"] == (1, 5, 0, False) and got["id", "unique"] == (1, 4, 0, False)
    assert got["amount", "nulls"] == (3, 5, 1, False) and got["amount", "type"] == (1, 5, 0, False) and got["amount", "least"] == (1, 5, 0, False)
    assert got["flag", "allowed"] == (1, 5, 0, False) and got["x", "nulls"] == (2, 5, 5, True) and got["note", "nulls"] == (5, 5, 5, True)
    empty = contract_report(demo(spark).where("false"), DEMO).collect()
    assert all(r.passed and r.n_rows == 0 for r in empty) and len(empty) == len(got)
