"""Linking, order, validation and canonical JSON."""

import json
import random

from shopspark.llm.tool_calls import conversation_frames, levels, linked_calls

SCHEMAS = {"add": {"a": ("integer", True), "b": ("integer", True), "note": ("string", False)}, "stop": {}}
CALLS = "call_id string, tool string, arguments string, follows string, level int, content string"


def linked(spark, calls, results):
    df = spark.createDataFrame([(*c, 1, "x") for c in calls], CALLS)
    return linked_calls(df, spark.createDataFrame(results, "call_id string, content string"), SCHEMAS).collect()


def test_links_errors_and_json(spark):
    calls = [
        ("c1", "add", '{"b": 2, "a": 1}', None),
        ("c2", "add", '{"a": "1", "extra": {"z": 1, "y": [true, null]}}', "c1"),
        ("c3", "stop", "{}", "c2"),
        ("c4", "other", "{}", "gone"),
        ("c5", "add", "not json", None),
        ("c6", "add", None, None),
        ("c7", "add", "[1]", None),
        (None, "stop", "{}", "c1"),
        ("c8", "add", '{"a":1,"b":2,"note":"\\u00e9\\n"}', None),
    ]
    rows = {r.call_id: r for r in linked(spark, calls, [("c1", "3"), ("c1", "30"), ("lost", "?"), (None, "no id")]) if r.call_id or r.has_call}
    assert rows["c1"].errors == [] and rows["c1"].results == 2 and rows["c1"].has_result
    assert rows["c2"].errors == ["missing b", "mistyped a", "unknown extra"]
    assert rows["c4"].errors == ["unknown tool"] and rows["c4"].level == 0
    assert rows["c5"].errors == rows["c6"].errors == rows["c7"].errors == ["not an object"]
    assert [rows[c].level for c in ("c1", "c2", "c3", None)] == [0, 1, 2, 0]
    assert rows["lost"].errors == ["no call"] and not rows["lost"].has_call and rows["lost"].level is None
    assert rows["c8"].errors == []
    frame = json.loads(rows["c2"].json)
    assert list(frame) == ["call", "level"] and list(frame["call"]) == ["arguments", "id", "name"]
    assert frame["call"]["arguments"] == '{"a":"1","extra":{"y":[true,null],"z":1}}'
    assert json.loads(rows["c1"].json)["result"] == "30"


def test_levels_of_chains_and_cycles(spark):
    chain = [(f"n{i}", f"n{i - 1}") for i in range(300)]
    other = [("x", "y"), ("y", "z"), ("z", "x"), ("behind", "x"), ("self", "self"), ("far", "behind")]
    df = spark.createDataFrame(chain + other, "call_id string, follows string")
    got = {r.call_id: r.level for r in levels(df).collect()}
    assert [got[f"n{i}"] for i in range(300)] == list(range(300))
    assert {got[k] for k, _ in other} == {None}


def test_conversations(spark):
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hi \"x\""), (1, 2, "assistant", "hello"), (1, 3, "user", None), (2, 0, "assistant", "alone"),
             (2, 1, None, "odd"), (None, 4, "user", "lost")]
    df = spark.createDataFrame([(*t, "c", 3) for t in turns], "conv_id long, turn long, role string, text string, call_id string, level int")
    rows = {r.call_id: r for r in conversation_frames(df).collect()}
    assert rows["1:1"].has_result and rows["1:1"].level == 0 and rows["1:3"].level == 1
    assert rows["1:3"].errors == "missing text" and rows["2:-1"].errors == "no call" and rows["1:0"].tool == "instruct"
    assert rows[None].level == 0 and not rows[None].has_result
    assert conversation_frames(df.limit(0)).collect() == []


def test_plan_has_no_python(spark, small):
    plan = conversation_frames(spark.read.parquet(f"{small}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan and "ExistingRDD" not in plan


def test_every_result_is_kept(spark):
    calls = [("c1", "stop", "{}", None), ("c2", "stop", "{}", "c1"), (None, "stop", "{}", None)]
    results = [("c1", "3"), ("c1", "30"), ("c1", "3"), ("c1", None), ("lost", "b"), ("lost", "a"), ("c2", "one"), (None, "x"), (None, "x"), (None, "y"), (None, None)]
    rows = linked(spark, calls, results)
    named = {r.call_id: r for r in rows if r.call_id}
    assert json.loads(named["c1"].json)["results"] == [None, "3", "3", "30"] and named["c1"].results == 4
    assert json.loads(named["lost"].json) == {"result": "b", "results": ["a", "b"]}
    assert json.loads(named["c2"].json)["result"] == "one" and "results" not in json.loads(named["c2"].json)
    lone = [r for r in rows if r.call_id is None and not r.has_call]
    assert sorted(json.loads(r.json).get("result", "") for r in lone) == ["", "x", "x", "y"]
    assert all(r.results == 1 and r.has_result and r.errors == ["no call"] and r.level is None for r in lone)
    assert len(rows) == 3 + 1 + 4


def test_levels_by_the_longest_path(spark):
    rng = random.Random(4)
    edges = [("c", "a"), ("c", "b"), ("b", "a"), ("z", "a"), ("z", "c"), ("a", None), ("a", "gone"), ("t", "z"), ("p", "q"), ("q", "p"), ("q", "a"), ("r", "a"), ("r", "p"), ("s", "r"), ("w", "w"), ("w", "a")]
    edges += [(f"n{i}", f"n{rng.randrange(max(0, i - 6), i)}") for i in range(1, 40) for _ in range(rng.choice([1, 1, 3]))] + [("n0", None)] * 2
    parents = {k: {p for c, p in edges if c == k} & {c for c, _ in edges} for k, _ in edges}
    want = {}
    while ready := [k for k in parents if k not in want and all(p in want for p in parents[k])]:
        want |= {k: max((want[p] + 1 for p in parents[k]), default=0) for k in ready}
    df = spark.createDataFrame(edges, "call_id string, follows string").repartition(3)
    got = [tuple(r) for r in levels(df).collect()]
    assert len(got) == len(parents) and dict(got) == {k: want.get(k) for k in parents}
    assert dict(got)["c"] == 2 and dict(got)["t"] == 4 and dict(got)["s"] is None


def test_repeated_assistant_turns(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "first"), (1, 1, "assistant", "again"), (None, 1, "assistant", "x"), (1, None, "assistant", "y")]
    rows = conversation_frames(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [json.loads(r.json)["results"] for r in rows if r.call_id] == [["again", "first"]]
    assert sorted(json.loads(r.json)["result"] for r in rows if r.call_id is None) == ["x", "y"]
