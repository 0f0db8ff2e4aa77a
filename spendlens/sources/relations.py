"""The six input relations: declared schemas, validation, one row per person."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.sources.contracts import Contract, Expect, check_columns, typed

AMOUNT = T.DecimalType(18, 2)
STR = T.StringType()
DBL = T.DoubleType()
LONG = T.LongType()

SCHEMAS: dict[str, list[tuple[str, T.DataType]]] = {
    "survey": [
        ("party_id", LONG), ("survey_id", LONG), ("survey_dt", T.DateType()),
        ("category", STR), ("delay_cat", STR), ("disruption_ind", STR),
        ("transactor_stage", STR), ("tenure", STR), ("generation", STR),
        ("delay_mins", DBL),
    ],
    "spend_y2": [
        ("party_id", LONG),
        ("own_rev", AMOUNT), ("other_spend", AMOUNT), ("national_spend", AMOUNT),
        ("budget_spend", AMOUNT), ("foreign_spend", AMOUNT), ("total_spend", AMOUNT),
        ("own_share_pct", DBL),
        ("customer_group", STR), ("match_ind", STR), ("own_rev_ind", STR),
        ("other_spend_ind", STR), ("national_ind", STR), ("budget_ind", STR), ("foreign_ind", STR),
        ("national_merchants", STR), ("budget_merchants", STR), ("foreign_merchants", STR),
        ("total_spend_band", STR), ("own_share_band", STR), ("total_spend_tier", STR),
        ("own_share_tier", STR),
    ],
    "spend_y1": [("party_id", LONG), ("own_rev", AMOUNT), ("total_spend", AMOUNT)],
    "cust_y1": [
        ("party_id", LONG),
        ("ticket_rev", AMOUNT), ("ticket_rev_non_award", AMOUNT), ("ancillary_rev", AMOUNT),
        ("displacement", AMOUNT),
        ("cust_value", DBL), ("flight_value", DBL), ("currency_value", DBL), ("rpm", DBL),
        ("no_of_trips", T.IntegerType()),
        ("cust_type", STR), ("member_ind", STR), ("tier_code", STR), ("channel_type", STR),
        ("cust_tenure", STR), ("intent", STR), ("home_airport", STR), ("home_country", STR),
    ],
    "cust_y2": [
        ("party_id", LONG),
        ("ticket_rev", AMOUNT), ("ticket_rev_non_award", AMOUNT), ("ancillary_rev", AMOUNT),
        ("flight_value", DBL), ("currency_value", DBL),
    ],
    "individual": [("party_id", LONG), ("birth_year", T.IntegerType())],
}

#: what must not be null, and how much of a relation may lack a value that the base needs
REQUIRED: dict[str, dict[str, float]] = {
    "survey": {"party_id": 0.0, "survey_id": 0.0, "survey_dt": 0.0, "category": 0.05},
    "spend_y2": {"party_id": 0.0, "own_rev": 0.0, "total_spend": 0.0},
    "spend_y1": {"party_id": 0.0, "own_rev": 0.0, "total_spend": 0.0},
    "cust_y1": {"party_id": 0.0, "ticket_rev": 0.0, "cust_value": 0.1},
    "cust_y2": {"party_id": 0.0, "ticket_rev": 0.0},
    "individual": {"party_id": 0.0, "birth_year": 0.0},
}
_BOUNDS = {("spend_y2", "own_share_pct"): {"least": 0.0}, ("cust_y1", "no_of_trips"): {"least": 1.0}, ("individual", "birth_year"): {"least": 1900.0},
           **{("spend_y2", c): {"allowed": ("Y", "N")} for c in ("match_ind", "own_rev_ind", "other_spend_ind")}, ("cust_y1", "member_ind"): {"allowed": ("Y", "N")}}

CONTRACTS: dict[str, Contract] = {
    name: Contract(name, tuple(Expect(c, t, max_null_share=REQUIRED[name].get(c, 1.0), **_BOUNDS.get((name, c), {})) for c, t in columns),
                   key=("survey_id",) if name == "survey" else ("party_id",))
    for name, columns in SCHEMAS.items()
}


def conform(df: DataFrame, name: str, absent: Sequence[str] = ()) -> DataFrame:
    """Select the declared columns with declared types; NaN becomes null.

    A declared column that the source does not have, or has in a type that
    cannot be cast, raises ``SchemaError`` (a renamed spend column would
    otherwise make everybody churned); ``absent`` names those that a source is
    known not to carry: they are bound as null.  Spark treats NaN as equal to
    itself and greater than every number, so NaN must not reach the categorisers.
    """
    contract = CONTRACTS[name]
    unknown = set(absent) - {e.column for e in contract.columns}
    if unknown:
        raise ValueError(f"relation {name} declares no {sorted(unknown)}")
    contract = replace(contract, columns=tuple(replace(e, optional=e.column in absent) for e in contract.columns))
    check_columns(df, contract)
    return df.select(*[typed(df, e, strict=True).alias(e.column) for e in contract.columns])


def one_per_key(df: DataFrame, key: str = "party_id", on_duplicates: str = "first", name: str = "relation") -> DataFrame:
    """One row per key, so that a join cannot multiply people.

    ``first`` keeps the least row of a key (by all its columns, deterministic);
    ``raise`` fails the job that meets a repeated key; ``trust`` does nothing, for
    relations that are known to be unique.
    """
    if on_duplicates == "trust":
        return df
    if on_duplicates not in ("first", "raise"):
        raise ValueError(f"unknown on_duplicates {on_duplicates!r}")
    place = Window.partitionBy(key).orderBy(*[F.col(c) for c in df.columns if c != key])
    ranked = df.withColumn("_n", F.row_number().over(place))
    if on_duplicates == "first":
        return ranked.where(F.col("_n") == 1).drop("_n")
    failed = F.raise_error(F.concat(F.lit(f"{name}: {key} is not unique: "), F.col(key).cast("string"))).cast("boolean")
    return ranked.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(failed)).drop("_n")
