"""Tool calls: linking, order, validation and canonical JSON."""

import json
import random

import pytest

from spendlens.llm import tool_calls as T

SCHEMAS = {"f": {"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}},
                 "required": ["a"], "additionalProperties": False}, "any": {}}


def frames(spark, calls, results):
    return (spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string"),
            spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"))


def run(spark, calls, results):
    return T.link_tool_calls(*frames(spark, calls, results), SCHEMAS).collect()


def ref(*ids):
    return json.dumps({f"k{i}": {"$ref": x} for i, x in enumerate(ids)})


@pytest.mark.parametrize("value, text", [
    ({"b": 1, "a": [True, None, 1.0, 0.5]}, '{"a":[true,null,1,0.5],"b":1}'), ("é\n\"\\/\x01", '"é\\n\\"\\\\/\\u0001"'), (float("nan"), "null"),
    ({"é": {}, "z": []}, '{"z":[],"é":{}}'), (10 ** 30, str(10 ** 30)), (-0.0, "0")])
def test_canonical(value, text):
    assert T.canonical(value) == text


@pytest.mark.parametrize("arguments, errors", [
    ('{"a": 1}', []), ('{"a": 1.0, "b": ["xy"]}', []), ('{"a": -1}', ["$.a: below minimum"]), ('{"a": true}', ["$.a: not of type integer"]),
    ('{"b": ["xyz", 1]}', ["$: a is missing", "$.b[0]: too long", "$.b[1]: not of type string"]), ('{"a": 1, "c": 2}', ["$: c is not allowed"]),
    ('{"a": {"$ref": "c1"}}', []), ("[1]", ["$: not an object"]), ("{", ["$: not JSON"]), (None, ["$: not an object"])])
def test_validation(arguments, errors):
    assert T.check_call("f", arguments, SCHEMAS)[1] == errors


def test_linking(spark):
    calls = [(1, "a", 0, "f", '{"a":1}'), (1, "b", 2, "f", '{"a":-1}'), (1, "b", 3, "f", '{"a":2}'), (2, "a", 0, "g", "{}"), (None, "a", 0, "f", '{"a":1}'), (1, None, 5, "f", '{"a":1}')]
    results = [(1, "a", 1, "ok"), (1, "z", 4, None), (2, "a", 1, None), (2, "a", 9, "again"), (None, "a", 1, "x")]
    out = {(r.conv_id, r.call_id, r.turn): r for r in run(spark, calls, results)}
    status = {k: r.status for k, r in out.items()}
    assert status == {(1, "a", 0): "linked", (1, "b", 2): "missing_result", (1, "b", 3): "duplicate", (1, "z", 4): "orphan_result", (2, "a", 0): "linked",
                      (2, "a", 9): "duplicate", (None, "a", 0): "no_id", (None, "a", 1): "no_id", (1, None, 5): "no_id"}
    assert out[1, "a", 0].message == '{"call":{"arguments":{"a":1},"id":"a","name":"f"},"result":{"content":"ok","id":"a"}}'
    assert out[2, "a", 0].message == '{"call":{"arguments":{},"id":"a","name":"g"},"result":{"content":null,"id":"a"}}'
    assert out[1, "z", 4].message == '{"result":{"content":null,"id":"z"}}'
    assert out[1, "a", 0].valid and list(out[2, "a", 0].errors) == ["unknown tool g"] and list(out[1, "b", 2].errors) == ["$.a: below minimum"]
    for r in out.values():
        assert T.canonical(json.loads(r.message)) == r.message


def test_order_of_random_graphs(spark):
    rnd = random.Random(1)
    calls, needs = [], {}
    for conv in range(6):
        n = rnd.randint(1, 40)
        for i in range(n):
            k = rnd.choice([0, 1, 1, 1, 2, 3])
            to = sorted({rnd.randrange(n) for _ in range(k)} - {i}) if conv == 5 else sorted({rnd.randrange(i) for _ in range(k if i else 0)})
            needs[conv, f"c{i}"] = {f"c{j}" for j in to}
            calls.append((conv, f"c{i}", rnd.randint(0, 9), "any", ref(*(f"c{j}" for j in to))))
    calls += [(9, f"c{i}", i, "any", ref(f"c{i - 1}") if i else "{}") for i in range(300)]  # a long chain
    needs |= {(9, f"c{i}"): {f"c{i - 1}"} if i else set() for i in range(300)}
    level, changed = {}, True
    while changed:
        changed = False
        for (conv, c), to in needs.items():
            if (conv, c) not in level and all((conv, t) in level for t in to):
                level[conv, c] = 1 + max((level[conv, t] for t in to), default=-1)
                changed = True
    out = run(spark, calls, [])
    assert {(r.conv_id, r.call_id): r.level for r in out} == {k: level.get(k) for k in needs}
    assert all((list(r.errors) == ["cycle"]) == (r.level is None) for r in out)


def test_unknown_references_and_cycles(spark):
    calls = [(1, "a", 0, "any", ref("nowhere")), (1, "b", 1, "any", ref("c")), (1, "c", 2, "any", ref("b")), (1, "d", 3, "any", ref("c", "a")), (1, "e", 4, "any", ref("e"))]
    out = {r.call_id: r for r in run(spark, calls, [])}
    assert list(out["a"].errors) == ["unknown reference nowhere"] and out["a"].level == 0
    assert all(out[c].level is None and list(out[c].errors) == ["cycle"] for c in "bcde")


def test_empty(spark):
    assert run(spark, [], []) == []
    assert [r.status for r in run(spark, [], [(1, "a", 0, "x")])] == ["orphan_result"]
    assert [r.status for r in run(spark, [(1, "a", 0, "f", '{"a":1}')], [])] == ["missing_result"]


def test_surrogates_and_depth_are_errors_of_the_call(spark):
    deep = lambda n: '{"text":' + "[" * n + "]" * n + "}"
    arguments = ['{"text":"\\ud800"}', '{"\\udc00":1}', '{"text":{"$ref":"\\ud800"}}', '"\\udfff"', '{"text":"\\ud83d\\ude00"}',
                 deep(99), deep(100), deep(1000), deep(3000), deep(200_000), "[" * 50]
    calls = spark.createDataFrame([(1, f"c{i}", i, "t", a) for i, a in enumerate(arguments)], "conv_id long, call_id string, turn long, name string, arguments string")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, content string")
    got = {r.turn: r for r in T.link_tool_calls(calls, results, {"t": {"type": "object"}}).collect()}
    assert [got[i].errors for i in (0, 2, 4, 5)] == [["$: lone surrogate"], ["$: lone surrogate"], [], []]
    assert got[1].errors == ["$: lone surrogate"] and got[3].errors == ["$: not an object", "$: lone surrogate"]
    assert json.loads(got[0].message)["call"]["arguments"] == {"text": "\ufffd"}
    assert all(got[i].errors == ["$: nested deeper than 100"] for i in (6, 7, 8, 9)) and got[10].errors == ["$: not JSON"]
    assert json.loads(got[7].message)["call"]["arguments"] == deep(1000)
