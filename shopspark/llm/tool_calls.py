"""Tool calls in conversations: linking, order, validation, canonical JSON.

*Linking.* Calls and results meet in a hash join by identifier. Several results
for one call are all kept: ``results`` in the JSON lists them in order of their
contents, absent ones first, and a result's number is its place there; ``result`` is
the last of them. Results without a call and calls without a result are marked.

*Order.* A call may follow other calls, whose results it needs; rows with equal
identifiers add up. Its level is the number of calls before it on the longest such
path. Calls that follow one other call form trees, which pointer doubling climbs:
each round doubles the reach of every pointer, so a chain of n calls takes log2(n)
rounds of one join. Calls that follow several are settled after all those, in as many
rounds as such calls stand one behind the other. A call on a cycle, or after one,
has no level. Sorting by level puts every call after those it follows.

*Validation.* Arguments are a JSON object. A schema lists a tool's keys with their
types and says which are required; unknown, missing and mistyped keys are listed.

*Canonical JSON.* Keys sorted at every depth, no blanks between tokens.

Everything is built of DataFrame operations. Schemas are literals of the plan, so
validation shuffles nothing however many calls one tool has. Results fold by
identifier before the join; the results of one call must fit a row. Rows without
identifier take no part in grouping and join.

Defined cases: a null identifier links with nothing; such a call has level 0, such a
result is a row of its own. A null or
broken arguments text is the error "not an object". A tool without a schema is the
error "unknown tool". Calls with equal identifiers share a place in the order and
their results.
Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopspark.storage import materialize

#: The types a schema may name, as Spark spells them for values read from JSON.
TYPES = {"integer": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text, null if it is broken."""
    return F.to_json(F.try_parse_json(json))


def _climbed(state: DataFrame) -> DataFrame:
    """Pointers (call_id, up, steps) carried on to where no pointer leads on; ``up`` stays null there.

    Result: call_id, top, steps, with a null top on and behind a cycle.
    """
    state = materialize(state.withColumn("top", F.coalesce("up", "call_id")), "call-levels")
    total = state.count()
    reach, waiting = 1, state.where("up is not null").count()
    # A pointer that still leads on after as many steps as there are calls goes round a cycle.
    while waiting and reach <= total:
        far = state.select(
            F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("top").alias("higher")
        )
        state = state.join(far, "up", "left").select(
            "call_id",
            F.col("next").alias("up"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.coalesce("higher", "top").alias("top"),
        )
        state = materialize(state, "call-levels")
        reach, waiting = 2 * reach, state.where("up is not null").count()
    return state.select("call_id", F.when(F.col("up").isNull(), F.col("top")).alias("top"), "steps")


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) for calls (call_id, follows); level is null on and behind a cycle."""
    rows = calls.where("call_id is not null").select("call_id", "follows")
    nodes = rows.select("call_id").distinct()
    # A pointer to an absent call is none.
    edges = rows.distinct().join(nodes.withColumnRenamed("call_id", "follows"), "follows", "left_semi")
    edges = materialize(edges.select("call_id", "follows"), "call-edges")
    parents = edges.groupBy("call_id").agg(F.count("*").alias("parents"), F.min("follows").alias("up"))
    start = nodes.join(parents, "call_id", "left").select(
        "call_id", F.when(F.col("parents") == 1, F.col("up")).alias("up"), F.when(F.col("parents") == 1, 1).otherwise(0).cast("long").alias("steps")
    )
    climbed = _climbed(start)
    joints = parents.where("parents > 1").select("call_id")
    # Tops that follow nothing have level 0; those that follow several wait for all of them.
    waiting = edges.join(joints, "call_id", "left_semi").join(climbed.withColumnRenamed("call_id", "follows"), "follows")
    waiting = materialize(waiting.select("call_id", "top", "steps"), "call-joints")
    done = climbed.where("top = call_id").join(joints, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))
    left = waiting.select("call_id").distinct().count()
    while left:
        met = waiting.join(done.select(F.col("call_id").alias("top"), "level"), "top", "left")
        ready = met.groupBy("call_id").agg(F.count("*").alias("all"), F.count("level").alias("known"), F.max(F.col("level") + F.col("steps") + 1).alias("level"))
        ready = materialize(ready.where(F.col("known") == F.col("all")).select("call_id", "level"), "call-ready")
        if not ready.count():
            break
        done = materialize(done.union(ready), "call-done")
        waiting = materialize(waiting.join(ready, "call_id", "left_anti"), "call-joints")
        left = waiting.select("call_id").distinct().count()
    tops = done.select(F.col("call_id").alias("top"), "level")
    return climbed.join(tops, "top", "left").select("call_id", (F.col("level") + F.col("steps")).alias("level"))


def _per_tool(schemas: dict, value) -> Column:
    """A literal for each tool, null for tools without a schema."""
    found = F.lit(None)
    for tool, keys in schemas.items():
        found = F.when(F.col("tool") == tool, value(keys)).otherwise(found)
    return found


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def validated(calls: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """``calls`` (with tool, arguments) and: errors (array), canonical arguments.

    schemas: {tool: {key: (type, required)}}.
    """
    parsed = calls.withColumn("variant", F.try_parse_json("arguments"))
    parsed = parsed.withColumn("is_object", F.coalesce(F.schema_of_variant("variant").startswith("OBJECT"), F.lit(False)))
    members = F.when(F.col("is_object"), F.col("variant").cast("map<string,variant>"))
    met = parsed.withColumn("members", members)
    met = met.withColumn(
        "kinds", _per_tool(schemas, lambda keys: F.map_from_arrays(_strings(list(keys)), _strings([TYPES[kind] for kind, _ in keys.values()])))
    ).withColumn("required", _per_tool(schemas, lambda keys: _strings(sorted(k for k, (_, needed) in keys.items() if needed))))
    kinds = F.transform_values("members", lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    keys = F.map_keys("members")
    missing = F.transform(F.array_except("required", keys), lambda k: F.concat(F.lit("missing "), k))
    unknown = F.transform(F.array_except(keys, F.map_keys("kinds")), lambda k: F.concat(F.lit("unknown "), k))
    common = F.array_intersect(keys, F.map_keys("kinds"))
    mistyped = F.filter(common, lambda k: F.element_at("found", k) != F.element_at("kinds", k))
    mistyped = F.transform(mistyped, lambda k: F.concat(F.lit("mistyped "), k))
    errors = (
        F.when(F.col("kinds").isNull(), F.array(F.lit("unknown tool")))
        .when(~F.col("is_object"), F.array(F.lit("not an object")))
        .otherwise(F.array_sort(F.concat(missing, unknown, mistyped)))
    )
    checked = met.withColumn("found", kinds).withColumn("errors", errors).withColumn("canonical", F.to_json("variant"))
    return checked.drop("variant", "is_object", "members", "kinds", "required", "found")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call, per identifier with results only and per result without identifier.

    calls: call_id, tool, arguments, follows. results: call_id, content.
    Result: call_id, tool, level, errors, has_call, has_result, results, json.
    """
    calls = calls.select("call_id", "tool", "arguments", "follows")
    checked = validated(calls, schemas).withColumn("has_call", F.lit(True))
    content = F.sort_array(F.collect_list(F.struct("content")))
    named = results.where("call_id is not null").groupBy("call_id").agg(F.max("content").alias("content"), content.alias("every"))
    named = named.withColumn("every", F.col("every.content")).withColumn("has_result", F.lit(True))
    met = checked.where("call_id is not null").join(named, "call_id", "full").join(levels(calls), "call_id", "left")
    lone = checked.where("call_id is null").withColumn("level", F.lit(0).cast("long"))
    nameless = results.where("call_id is null").select("call_id", "content", F.array("content").alias("every"), F.lit(True).alias("has_result"))
    met = met.unionByName(lone, allowMissingColumns=True).unionByName(nameless, allowMissingColumns=True)
    met = met.withColumn("results", F.when(F.col("has_result"), F.size("every")).otherwise(0).cast("long"))
    call = F.struct(F.col("canonical").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"))
    several = F.when(F.col("results") > 1, F.col("every")).alias("results")
    frame = F.to_json(F.struct(F.when(F.col("has_call"), call).alias("call"), "level", F.col("content").alias("result"), several))
    return met.select(
        "call_id",
        "tool",
        "level",
        F.coalesce("errors", F.array(F.lit("no call"))).alias("errors"),
        F.coalesce("has_call", F.lit(False)).alias("has_call"),
        F.coalesce("has_result", F.lit(False)).alias("has_result"),
        "results",
        canonical(frame).alias("json"),
    )


#: Tools that stand for the turns of plain conversations.
TURN_SCHEMAS = {
    "ask": {"text": ("string", True), "turn": ("integer", True)},
    "instruct": {"text": ("string", True), "turn": ("integer", True)},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text).

    A user's or system turn is a call that follows the call two turns before, an
    assistant's turn the result of the call one turn before.
    """
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    asked = turns.where(F.coalesce(F.col("role"), F.lit("")) != "assistant")
    calls = asked.select(
        name(0).alias("call_id"),
        F.when(F.col("role") == "system", "instruct").otherwise("ask").alias("tool"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        name(2).alias("follows"),
    )
    return calls, turns.where(F.col("role") == "assistant").select(name(1).alias("call_id"), F.col("text").alias("content"))


def conversation_frames(turns: DataFrame) -> DataFrame:
    """The linked calls of conversations with their errors as one text."""
    linked = linked_calls(*conversation_calls(turns), TURN_SCHEMAS)
    return linked.withColumn("n_errors", F.size("errors")).withColumn("errors", F.array_join("errors", "; "))
