"""Tool-call linking: calls and results joined by identifier, ordered, validated, as canonical JSON.

``link_tool_calls`` hash-joins calls with results by (conversation, call id).
Arguments are validated against the JSON schema of the called tool.  A call may
use earlier results: an argument ``{"$ref": "<call id>"}`` anywhere in it makes the
call depend on that call.  The calls of a conversation get a topological order:
``level`` is the length of the longest chain of references below a call, and
(level, turn, call id) sorts every call after all it uses.  Each row's ``message``
is canonical JSON: keys sorted by code point, no spaces, no escapes that JSON
does not need, integral numbers without a fraction.

Scale: a conversation is never collected: one row is one call or one result
without a call, joins are keyed by (conversation, id), and levels are found for
all conversations at once: references that point back in the turns (the normal
case) are chains that pointer doubling resolves in log(depth) rounds where each
call uses at most one other; calls with several references are relaxed round by
round.  Every round is written to the shared folder.

Defined cases: null conversation or call ids never link (each such row stands
alone, status ``no_id``); several calls or results with one id: the first (by
turn, then by content) is used, the others are ``duplicate``; a result
without a call is ``orphan_result``, a call without one ``missing_result``; references to
unknown calls are errors and are ignored for the order; calls on or above a
cycle have a null level and the error ``cycle``; arguments that are no JSON object,
or nested deeper than ``MAX_DEPTH`` (kept as their text), or with half of a surrogate pair
(U+FFFD takes its place) are errors; a null text of a result is JSON null; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import materialize

MAX_DEPTH = 100
DEEP = f"$: nested deeper than {MAX_DEPTH}"
SURROGATE = re.compile("[\ud800-\udfff]")
CHECKED = "conv_id bigint, call_id string, turn bigint, name string, arguments string, errors array<string>, refs array<string>"


def canonical(value: Any) -> str:
    """Canonical JSON; NaN and infinities are not JSON and become null."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            return "null"
        return str(int(value)) if value.is_integer() and abs(value) < 2 ** 53 else repr(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def validate(value: Any, schema: dict, path: str = "$") -> list[str]:
    """Errors of a value against a JSON schema (type, enum, const, ranges, lengths, properties, required, items).

    A reference ``{"$ref": id}`` stands for a value not known yet and fits everything.
    """
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: not of type {kinds}"]
    errors = []
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        errors.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        errors.append(f"{path}: not the constant")
    if _is(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            errors.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            errors.append(f"{path}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            errors.append(f"{path}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            errors.append(f"{path}: too long")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            errors.append(f"{path}: too few items")
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            errors.append(f"{path}: too many items")
        if "items" in schema:
            for i, x in enumerate(value):
                errors += validate(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}: {k} is missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += validate(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{path}: {k} is not allowed")
    return errors


def references(value: Any) -> set[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            return {value["$ref"]}
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) and value else set()


def too_deep(value: Any, most: int = MAX_DEPTH) -> bool:
    """Whether lists and objects are nested deeper than ``most``, without recursion."""
    level = [value] if isinstance(value, dict | list) else []
    for _ in range(most):
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v) if isinstance(x, dict | list)]
        if not level:
            return False
    return True


def check_call(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str, list[str], list[str]]:
    """Canonical arguments, errors and references of one call."""
    try:
        value = json.loads(arguments) if arguments is not None else None
    except ValueError:
        return canonical(arguments), ["$: not JSON"], []
    except RecursionError:  # far deeper than MAX_DEPTH
        return canonical(arguments), [DEEP], []
    if too_deep(value):
        return canonical(arguments), [DEEP], []
    text = canonical(value)
    whole = not SURROGATE.search(text)
    if not isinstance(value, dict):
        errors, refs = ["$: not an object"], []
    else:
        errors = validate(value, schemas[name]) if name in schemas else [f"unknown tool {name}"]
        refs = sorted(references(value))
    if whole:
        return text, errors, refs
    clean = lambda x: SURROGATE.sub("\ufffd", x)
    return clean(text), [*map(clean, errors), "$: lone surrogate"], [r for r in refs if not SURROGATE.search(r)]


def _first(rows: DataFrame, *order: str) -> DataFrame:
    """``n``: the place of a row among those with its ids (nulls are never the same id).

    Repeats of an id are rare; rows without an id are spread over keys of their own.
    """
    alone = F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), F.monotonically_increasing_id())
    spread = rows.withColumn("alone", alone)
    return spread.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "call_id", "alone").orderBy(*order))).drop("alone")


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and ``level`` of the calls that are on or above no cycle; ``refs`` name calls of the same table."""
    nodes = calls.select("conv_id", "call_id", F.size("refs").alias("k"))
    edges = materialize(calls.select("conv_id", "call_id", F.explode("refs").alias("ref")), "references")
    # chains: a call with one reference points to it, up to a call with none or several (the root)
    targets = nodes.select("conv_id", F.col("call_id").alias("root"), (F.col("k") != 1).alias("done"))
    single = nodes.where("k = 1").join(edges, ["conv_id", "call_id"])
    open_ = materialize(single.select("conv_id", "call_id", F.col("ref").alias("root"), F.lit(1).cast("bigint").alias("steps")).join(targets, ["conv_id", "root"]), "chains")
    chains = nodes.where("k <> 1").select("conv_id", "call_id", F.col("call_id").alias("root"), F.lit(0).cast("bigint").alias("steps"))
    columns = ["conv_id", "call_id", "root", "steps"]
    for _ in range(open_.count().bit_length() + 1):  # what is still open then is on or above a cycle
        chains = chains.unionByName(open_.where("done").select(*columns))
        open_ = open_.where("NOT done")
        if open_.isEmpty():
            break
        to = materialize(open_.unionByName(chains.withColumn("done", F.lit(True))), "chains")  # doubling: each takes over what its target has
        there = to.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("root2"), F.col("steps").alias("more"), F.col("done").alias("done2"))
        open_ = materialize(open_.join(there, ["conv_id", "root"]).select(
            "conv_id", "call_id", F.col("root2").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), F.col("done2").alias("done")), "chains")
    chains = materialize(chains, "chains")
    known = materialize(nodes.where("k = 0").select("conv_id", F.col("call_id").alias("root"), F.lit(0).cast("bigint").alias("base")), "levels")
    # the level of a root with several references is 1 + the greatest of theirs; without any it is 0
    needs = materialize(edges.join(nodes.where("k > 1").select("conv_id", "call_id"), ["conv_id", "call_id"])
                        .join(chains.select("conv_id", F.col("call_id").alias("ref"), "root", "steps"), ["conv_id", "ref"], "left"), "needs")
    while not needs.isEmpty():
        ready = (needs.join(known, ["conv_id", "root"], "left").groupBy("conv_id", "call_id")
                 .agg(F.bool_and(F.col("base").isNotNull()).alias("ok"), F.max(F.col("base") + F.col("steps") + 1).alias("base")).where("ok"))
        new = materialize(ready.select("conv_id", F.col("call_id").alias("root"), "base"), "levels-new")
        if new.isEmpty():
            break
        known = materialize(known.unionByName(new), "levels")
        needs = materialize(needs.join(new.select("conv_id", F.col("root").alias("call_id")), ["conv_id", "call_id"], "left_anti"), "needs")
    return chains.join(known, ["conv_id", "root"]).select("conv_id", "call_id", (F.col("base") + F.col("steps")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without one.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text); ``results``: conv_id,
    call_id, turn, content.  Returns conv_id, call_id, turn, status, valid, errors, level
    and message.
    """

    def checked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [check_call(n, a, schemas) for n, a in zip(f["name"], f["arguments"], strict=True)]
            yield f.assign(arguments=[d[0] for d in done], errors=[d[1] for d in done], refs=[d[2] for d in done])

    rows = calls.select(F.col("conv_id").cast("bigint"), F.col("call_id").cast("string"), F.col("turn").cast("bigint"), "name", "arguments")
    texts = rows.select(F.col("conv_id").cast("string").alias("conv_id"), "call_id", F.col("turn").cast("string").alias("turn"), "name", "arguments")
    made = texts.mapInPandas(checked, CHECKED.replace("conv_id bigint", "conv_id string").replace("turn bigint", "turn string"))
    numbered = materialize(_first(made.withColumns({"conv_id": F.col("conv_id").cast("bigint"), "turn": F.col("turn").cast("bigint")}), "turn", "name", "arguments"), "calls")
    linkable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = numbered.where(linkable & (F.col("n") == 1))
    # references to calls that exist
    known = first.select("conv_id", F.col("call_id").alias("ref"))
    refs = first.select("conv_id", "call_id", F.explode("refs").alias("ref"))
    found = refs.join(known, ["conv_id", "ref"]).groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_list("ref")).alias("good"))
    good = F.coalesce("good", F.array().cast("array<string>"))
    first = materialize(first.join(found, ["conv_id", "call_id"], "left").select("conv_id", "call_id", good.alias("refs")), "calls-first")
    placed = first.join(levels(first), ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("refs").alias("good"), "level", F.lit(1).alias("n"))
    answers = _first(results.select(F.col("conv_id").cast("bigint"), F.col("call_id").cast("string"), F.col("turn").cast("bigint").alias("result_turn"), "content"),
                     "result_turn", "content").withColumn("answered", F.lit(True))
    # hash join by identifier; null ids match nothing
    joined = numbered.join(placed, ["conv_id", "call_id", "n"], "left").join(answers, ["conv_id", "call_id", "n"], "full")
    has_call = F.col("arguments").isNotNull()
    status = (F.when(~linkable, "no_id").when(F.col("n") > 1, "duplicate").when(~has_call, "orphan_result")
              .when(F.col("answered").isNull(), "missing_result").otherwise("linked"))
    unknown = F.transform(F.array_except("refs", good), lambda r: F.concat(F.lit("unknown reference "), r))
    cycle = F.when((F.col("n") == 1) & linkable & F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(has_call, F.concat("errors", unknown, cycle)).otherwise(F.array().cast("array<string>"))

    @F.pandas_udf("string")
    def message(call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series, answered: pd.Series) -> pd.Series:
        out = []
        for c, n, a, r, ok in zip(call_id, name, arguments, content, answered, strict=True):
            parts = []
            if a is not None:  # already canonical; keys in order
                parts.append(f'"call":{{"arguments":{a},"id":{canonical(c)},"name":{canonical(n)}}}')
            if ok:
                parts.append(f'"result":{{"content":{canonical(r)},"id":{canonical(c)}}}')
            out.append("{" + ",".join(parts) + "}")
        return pd.Series(out, dtype="object")

    told = joined.withColumns({"status": status, "errors": errors})
    return told.select(
        "conv_id", "call_id", F.coalesce("turn", "result_turn").alias("turn"), "status", (has_call & (F.size("errors") == 0)).alias("valid"), "errors",
        F.when(F.col("n") == 1, F.col("level")).alias("level"),
        message("call_id", "name", "arguments", "content", F.coalesce("answered", F.lit(False))).alias("message"))
