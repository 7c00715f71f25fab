"""Tool calls that used to end a job or vanish."""

from __future__ import annotations

import json

from leaksieve.llm import tool_calls

_CALLS = "conv_id long, call_id string, position long, name string, arguments string, needs array<string>"
_RESULTS = "conv_id long, call_id string, position long, content string"


def linked(spark, calls, results, schemas):
    made, got = spark.createDataFrame(calls, _CALLS), spark.createDataFrame(results, _RESULTS)
    return tool_calls.link_calls(made, got, schemas)


def test_odd_arguments_end_no_job(spark):
    big = "1" + "0" * 400
    texts = [f'{{"n": {big}}}', '{"n": 1e400}', '{"n": "\\ud800"}', '{"n": NaN}', "[" * 100_000, '{"n": 2.0}', '{"n": "😀"}', None, '{"n": 1.5}']
    calls = [(1, f"c{n}", n, "f", text, None) for n, text in enumerate(texts)]
    schemas = {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}}
    rows = sorted(linked(spark, calls, [], schemas).collect(), key=lambda r: r.position)
    assert [r.valid for r in rows] == [True, False, False, False, False, True, False, False, False]
    assert [r.errors == ["$: not JSON"] for r in rows] == [False, True, True, True, True, False, False, True, False]
    assert json.loads(rows[0].json)["arguments"]["n"] == int(big)
    assert json.loads(rows[1].json)["arguments"] == '{"n": 1e400}' and "Infinity" not in rows[1].json


def test_rows_without_an_id_and_repeated_ids_are_kept(spark):
    calls = [(1, None, 0, "f", "{}", ["a"]), (1, None, 1, "f", "x", None), (1, "a", 2, "f", "{}", None), (1, "a", 3, "f", "{}", None)]
    results = [(1, None, 4, "lost"), (1, "a", 5, "one"), (1, "a", 6, "two"), (None, None, None, None)]
    rows = linked(spark, calls, results, {}).collect()
    assert len(rows) == 5
    (a,) = [r for r in rows if r.call_id == "a"]
    assert (a.status, a.n_calls, a.n_results, json.loads(a.json)["result"]) == ("linked", 2, 2, "one")
    odd = [r for r in rows if r.status == "no_id"]
    assert sorted((r.n_calls, r.n_results, r.valid) for r in odd) == [(0, 1, True), (0, 1, True), (1, 0, False), (1, 0, True)]
    assert "lost" in {json.loads(r.json).get("result") for r in odd}


def test_results_are_joined_by_hash(spark):
    plan = linked(spark, [(1, "a", 0, "f", "{}", None)], [(1, "a", 1, "x")], {})._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan
