"""Tool-call linking: calls meet their results by identifier, in topological order, as canonical JSON.

A call is (conv_id, call_id, position, name, arguments, needs): arguments are JSON text, ``needs`` the ids of calls whose
results it uses. A result is (conv_id, call_id, position, content). A call's level is 0 if it needs nothing, else one more than
the highest level it needs; within a conversation calls are ordered by (level, position, call_id).

Defined results: a call without a result has ``status`` "unanswered"; a result without a call becomes a row of status
"orphan"; of several results of a call the first by position (then content) is linked and ``n_results`` tells their
number. Of repeated calls with one id the first by position counts. An id is only known in
its conversation; null ids link to nothing. A call that needs a missing call or itself, directly or in a ring, gets level null and
status "blocked". Arguments that are no JSON, or no valid ones under the schema of the call's name, have
``valid`` false and the errors in ``errors``; a name without a schema takes any object.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leaksieve.llm.common import saved, table

Schema = dict[str, object]

_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}


def _is(value: object, kind: str) -> bool:
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        return _is(value, "number") and (isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES[kind])


def schema_errors(value: object, schema: Schema, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, bounds, lengths, items, properties."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if _is(value, "number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: out of bounds")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{path}: wrong length")
    elif isinstance(value, list):
        if "items" in schema:
            out += [e for k, item in enumerate(value) for e in schema_errors(item, schema["items"], f"{path}[{k}]")]
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{key}: missing" for key in schema.get("required", ()) if key not in value]
        for key in sorted(value):
            if key in known:
                out += schema_errors(value[key], known[key], f"{path}.{key}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{key}: not allowed")
    return out


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks, and no escapes but the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def _finite(digits: str) -> float:
    value = float(digits)
    if value in (float("inf"), float("-inf")):
        raise ValueError(f"{digits} is out of range")
    return value


def parsed(arguments: str | None, name: str | None, schemas: dict[str, Schema]) -> tuple[object, list[str]]:
    """The arguments and what is wrong with them; those that are no JSON are returned as text.

    Numbers beyond a double, lone surrogates and nesting beyond what can be written back are no JSON either.
    """
    try:
        value = json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite)
        canonical(value).encode()
        schema_errors(value, {})
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]
    return value, schema_errors(value, schemas.get(name, {"type": "object"}))


def _blocked(calls: DataFrame, block: int) -> DataFrame:
    """The calls with the block they are in: stretches of ``block`` positions of one conversation, split by hash where ties crowd them."""
    stretch = calls.select("conv_id", "call_id", F.coalesce(F.floor(F.col("position") / block), F.lit(0)).alias("stretch"))
    full = stretch.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")).where(F.col("n") > block)
    parts = F.ceil(F.coalesce("n", F.lit(1)) / block)
    part = F.pmod(F.xxhash64("call_id"), parts)
    joined = stretch.join(full, ["conv_id", "stretch"], "left")
    return joined.select("conv_id", "call_id", F.struct("stretch", part.alias("part")).alias("block"))


def _level_block(edges: pa.Table) -> pa.Table:
    """The calls of one block whose needs are met, by levels known from outside or found in the block."""
    level: dict[str, int] = {}
    unmet: dict[str, int] = {}
    waiting: dict[str, list[str]] = {}
    for call, need, got in zip(*(edges[c].to_pylist() for c in ("call_id", "need", "got")), strict=True):
        unmet.setdefault(call, 0)
        level.setdefault(call, 0)
        if got is None:
            unmet[call] += 1
            waiting.setdefault(need, []).append(call)
        else:
            level[call] = max(level[call], got + 1)
    ready = [call for call, n in unmet.items() if not n]
    for call in ready:
        for later in waiting.get(call, ()):
            level[later] = max(level[later], level[call] + 1)
            unmet[later] -= 1
            if not unmet[later]:
                ready.append(later)
    conv = edges["conv_id"].combine_chunks()
    return pa.table(
        {
            "conv_id": pa.repeat(conv[0], len(ready)),
            "call_id": pa.array(ready, pa.string()),
            "level": pa.array([level[call] for call in ready], pa.int32()),
        }
    )


def levels(needs: DataFrame, calls: DataFrame, block: int = 50_000) -> DataFrame:
    """(conv_id, call_id, level) of all calls that can be run.

    Calls that need nothing are level 0. The others are dealt out in blocks of at most about ``block`` calls, so that no
    task holds a whole conversation; each round solves the blocks as far as the levels known so far allow, and is a written
    table. There are as many rounds as the longest chain changes blocks, not one a level. ``needs`` is (conv_id, call_id,
    need), one row each.
    """
    key = ["conv_id", "call_id"]
    schema = calls.select(*key, F.lit(0).alias("level")).schema
    done = last = saved(calls.join(needs, key, "left_anti").select(*key, F.lit(0).alias("level")), "level")
    open_needs = saved(
        needs.join(_blocked(calls, block), key).select(*key, "block", "need", F.lit(None).cast("int").alias("got")), "needs"
    )
    # Asked for, so that small rounds are not put into one task.
    tasks = max(needs.sparkSession.sparkContext.defaultParallelism, open_needs.count() // block)
    while not last.isEmpty():
        met = last.select("conv_id", F.col("call_id").alias("need"), "level")
        rest = open_needs.join(last, key, "left_anti").join(met, ["conv_id", "need"], "left")
        got = F.coalesce("got", "level").alias("got")
        open_needs = saved(rest.select(*key, "block", "need", got), "needs")
        last = saved(open_needs.repartition(tasks, "conv_id", "block").groupBy("conv_id", "block").applyInArrow(_level_block, schema), "level")
        done = done.unionByName(last)
    return done


def _first(rows: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    least = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("first")
    folded = rows.groupBy("conv_id", "call_id").agg(least, F.count("*").alias("n"))
    return folded.select("conv_id", "call_id", *[F.col(f"first.{c}").alias(c) for c in keep], "n")


def _serialise(batches: Iterator[pa.RecordBatch], schemas: dict[str, Schema]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        texts, all_errors = [], []
        for row in rows:
            errors: list[str] = []
            entry = {"id": row["call_id"], "status": row["status"], "level": row["level"]}
            if row["n_calls"]:
                value, errors = parsed(row["arguments"], row["name"], schemas)
                entry |= {"name": row["name"], "arguments": value, "needs": row["needs"] or []}
            if row["status"] != "unanswered" and row["content"] is not None:
                entry["result"] = row["content"]
            texts.append(canonical(entry))
            all_errors.append(errors)
        names = ["conv_id", "call_id", "position", "level", "status", "n_calls", "n_results"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        valid = pa.array([not e for e in all_errors])
        yield pa.RecordBatch.from_arrays(
            [*columns, valid, pa.array(all_errors, pa.list_(pa.string())), pa.array(texts)],
            [*names, "valid", "errors", "json"],
        )


def _nameless(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The calls and results without an id, as rows of their own."""
    asked = calls.where("call_id IS NULL").selectExpr(
        "conv_id", "call_id", "CAST(position AS LONG) AS position", "CAST(NULL AS INT) AS level", "'no_id' AS status",
        "1L AS n_calls", "0L AS n_results", "name", "arguments", "needs", "CAST(NULL AS STRING) AS content",
    )
    got = results.where("call_id IS NULL").selectExpr(
        "conv_id", "call_id", "CAST(position AS LONG) AS position", "CAST(NULL AS INT) AS level", "'no_id' AS status",
        "0L AS n_calls", "1L AS n_results", "CAST(NULL AS STRING) AS name", "CAST(NULL AS STRING) AS arguments",
        "CAST(NULL AS ARRAY<STRING>) AS needs", "content",
    )
    return asked.unionByName(got)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema], block: int = 50_000) -> DataFrame:
    """A row per call and per orphaned result; ordered within a conversation by (level, position, call_id).

    ``n_calls`` and ``n_results`` say how often an id was called and answered; the first of each counts. Calls and results
    without an id can be linked to nothing: each is a row of its own with the status ``no_id``.
    """
    key = ["conv_id", "call_id"]
    nameless = _nameless(calls, results)
    calls = saved(
        _first(calls.where("call_id IS NOT NULL"), ["position"], ["position", "name", "arguments", "needs"])
        .withColumnRenamed("n", "n_calls"),
        "calls",
    )
    answers = _first(results.where("call_id IS NOT NULL"), ["position", "content"], ["position", "content"])
    answers = answers.select(*key, F.col("position").alias("at"), "content", F.col("n").alias("n_results"))
    needs = calls.select(*key, F.explode_outer(F.array_distinct("needs")).alias("need")).where("need IS NOT NULL")
    depth = levels(needs, calls, block)
    status = (
        F.when(F.col("mine").isNull(), "orphan")
        .when(F.col("level").isNull(), "blocked")
        .when(F.col("n_results").isNull(), "unanswered")
        .otherwise("linked")
    )
    linked = calls.withColumn("mine", F.lit(True)).join(depth, key, "left").join(answers.hint("shuffle_hash"), key, "full")
    rows = linked.select(
        *key,
        F.coalesce("position", "at").cast("long").alias("position"),
        F.col("level").cast("int"),
        status.alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        "name",
        "arguments",
        "needs",
        "content",
    ).unionByName(nameless)
    return rows.mapInArrow(
        lambda batches: _serialise(batches, schemas),
        "conv_id long, call_id string, position long, level int, status string, n_calls long, n_results long, "
        "valid boolean, errors array<string>, json string",
    )


#: What the query's calls have to look like.
SCHEMAS: dict[str, Schema] = {
    "answer": {
        "type": "object",
        "required": ["question", "turn"],
        "properties": {
            "question": {"type": "string", "minLength": 1},
            "turn": {"type": "integer", "minimum": 0},
        },
        "additionalProperties": False,
    },
    "instruct": {
        "type": "object",
        "required": ["rules"],
        "properties": {"rules": {"type": "string", "minLength": 20}},
        "additionalProperties": False,
    },
}


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of the turns: a user's or the system's turn calls, and the assistant's next one answers it.

    A user's call needs the call of the user's turn two before, if it is there, and the system's.
    """
    turn = F.col("turn").cast("long")
    name = F.concat(F.lit("call_"), turn)
    asked = turns.where("role IN ('user', 'system') AND turn IS NOT NULL").select(
        "conv_id",
        name.alias("call_id"),
        turn.alias("position"),
        F.when(F.col("role") == "system", "instruct").otherwise("answer").alias("name"),
        F.when(F.col("role") == "system", F.to_json(F.struct(F.col("text").alias("rules"))))
        .otherwise(F.to_json(F.struct(turn.alias("turn"), F.col("text").alias("question"))))
        .alias("arguments"),
        F.col("role").alias("role"),
        turn.alias("turn"),
    )
    there = asked.select("conv_id", F.col("turn").alias("before"), F.col("role").alias("their")).distinct()
    back = F.array(F.col("turn") - 1, F.col("turn") - 2)
    reach = asked.where("role = 'user'").select("conv_id", "turn", F.explode(back).alias("before")).distinct()
    met = reach.join(there, ["conv_id", "before"]).where("their = 'system' OR before = turn - 2")
    needs = met.groupBy("conv_id", "turn").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("call_"), F.col("before")))).alias("needs")
    )
    none = F.array().cast("array<string>")
    calls = asked.join(needs, ["conv_id", "turn"], "left").withColumn("needs", F.coalesce("needs", none))
    results = turns.where("role = 'assistant'").select(
        "conv_id",
        F.concat(F.lit("call_"), turn - 1).alias("call_id"),
        turn.alias("position"),
        F.col("text").alias("content"),
    )
    return calls.drop("turn", "role"), results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return link_calls(calls, results, SCHEMAS)
