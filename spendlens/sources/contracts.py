"""Schema contracts of the input relations.

A relation declares, per column, what a scan must find: presence, a type that
its values can take, the largest share of nulls, allowed values, and for the
relation a key that identifies its rows.  Three uses:

* ``missing_columns`` / ``check_columns`` look at the schema only (no job) and
  raise ``SchemaError`` naming what is absent or cannot be cast, before a query
  runs on silently null columns;
* ``contract_report`` compiles all expectations of a relation into one aggregate
  over its scan (and one over the key counts) and returns a row per expectation;
* ``judge_rows`` marks each row with the rules it breaks, for ``accepted`` and
  ``quarantine``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A source does not have the columns or types that its relation declares."""


@dataclass(frozen=True)
class Expect:
    """One column: its type, the largest share of nulls, allowed values and bounds; ``optional``: it may be absent (then null)."""

    column: str
    type: T.DataType
    max_null_share: float = 1.0
    allowed: tuple = ()
    least: float | None = None
    optional: bool = False


@dataclass(frozen=True)
class Contract:
    """A relation: its columns, and the columns that identify a row (none: rows need not be distinct)."""

    name: str
    columns: tuple[Expect, ...]
    key: tuple[str, ...] = ()




def _castable(have: T.DataType, want: T.DataType) -> bool:
    if have == want or isinstance(have, T.NullType):
        return True
    if isinstance(want, T.NumericType):
        return isinstance(have, (T.NumericType, T.StringType, T.BooleanType))
    if isinstance(want, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return isinstance(have, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))
    if isinstance(want, T.StringType):
        return isinstance(have, T.AtomicType)
    return False


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    """What the schema lacks, as messages; nothing is read."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for e in contract.columns:
        if e.column not in have:
            if not e.optional:
                out.append(f"{e.column} ({e.type.simpleString()}) is missing")
        elif not _castable(have[e.column], e.type):
            out.append(f"{e.column} is {have[e.column].simpleString()}, not {e.type.simpleString()}")
    return out


def check_columns(df: DataFrame, contract: Contract) -> None:
    wrong = missing_columns(df, contract)
    if wrong:
        raise SchemaError(f"relation {contract.name}: {'; '.join(wrong)}; the source has {', '.join(df.columns)}")


def typed(df: DataFrame, e: Expect, strict: bool = False) -> Column:
    """The column in its type, null where it is absent; NaN is null, and so is a value that cannot be cast (``strict``: as the session casts)."""
    if e.column not in df.columns:
        return F.lit(None).cast(e.type)
    column = F.col(e.column).cast(e.type) if strict else F.col(e.column).try_cast(e.type)
    return F.nanvl(column, F.lit(None).cast(e.type)) if isinstance(e.type, (T.DoubleType, T.FloatType)) else column


def _broken(df: DataFrame, e: Expect) -> dict[str, Column]:
    """Row rules of a column: condition under which a row breaks them."""
    value, rules = typed(df, e), {}
    if e.column in df.columns:
        raw = F.col(e.column)
        is_nan = F.isnan(raw) if isinstance(df.schema[e.column].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
        rules["type"] = raw.isNotNull() & ~is_nan & value.isNull()
    if e.allowed:
        rules["allowed"] = value.isNotNull() & ~value.isin(list(e.allowed))
    if e.least is not None:
        rules["least"] = value < F.lit(e.least)
    return rules


def judge_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` with ``broken``: the rules ('column: rule') that a row breaks; a null in the key is one."""
    check_columns(df, contract)
    rules = {f"{e.column}: {rule}": bad for e in contract.columns for rule, bad in _broken(df, e).items()}
    rules |= {f"{k}: key is null": F.col(k).isNull() for k in contract.key}
    return df.withColumn("broken", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()], F.lit(None).cast("string"))))


def accepted(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows that break no rule, in the declared columns and types."""
    good = judge_rows(df, contract).where(F.size("broken") == 0)
    return good.select(*[typed(df, e).alias(e.column) for e in contract.columns])


def quarantine(df: DataFrame, contract: Contract) -> DataFrame:
    """The rows that break a rule, as they came, with the rules they break."""
    return judge_rows(df, contract).where(F.size("broken") > 0)


def contract_report(df: DataFrame, contract: Contract) -> DataFrame:
    """``(relation, column, rule, observed, n_rows, bound, passed)``: a row for each expectation.

    observed: nulls, rows that break the rule, or rows beyond the first of their
    key.  One aggregate over the scan; the key's counts are a second one.
    """
    check_columns(df, contract)
    counts, bounds = {}, {}
    for e in contract.columns:
        counts[e.column, "nulls"] = F.count(F.when(typed(df, e).isNull(), 1))
        bounds[e.column, "nulls"] = F.floor(F.lit(e.max_null_share) * F.col("n_rows"))
        for rule, bad in _broken(df, e).items():
            counts[e.column, rule] = F.count(F.when(bad, 1))
            bounds[e.column, rule] = F.lit(0)
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[n.alias(f"{c}/{rule}") for (c, rule), n in counts.items()])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(f"`{c}/{rule}`").alias("observed"), bounds[c, rule].cast("long").alias("bound"))
            for c, rule in counts]
    out = one.select("n_rows", F.explode(F.array(*rows)).alias("r")).select("r.column", "r.rule", "r.observed", "n_rows", "r.bound")
    if contract.key:
        known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in contract.key)).groupBy(*contract.key).agg(F.count(F.lit(1)).alias("n"))
        again = known.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("observed"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        out = out.unionByName(again.select(F.lit(",".join(contract.key)).alias("column"), F.lit("unique").alias("rule"), "observed", "n_rows",
                                           F.lit(0).cast("long").alias("bound")))
    return out.select(F.lit(contract.name).alias("relation"), "column", "rule", "observed", "n_rows", "bound", (F.col("observed") <= F.col("bound")).alias("passed"))


def report_all(tables: Mapping[str, DataFrame], contracts: Sequence[Contract]) -> DataFrame:
    parts = [contract_report(tables[c.name], c) for c in contracts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
