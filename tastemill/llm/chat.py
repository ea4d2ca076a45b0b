"""Chat formatting with linked tool calls, with SQL functions only.

Messages are rows. An assistant's message may carry tool calls and a tool's
message the result of one, both as JSON:

    {"tool_calls": [{"id": "a", "name": "find", "arguments": {...}, "after": ["b"]}]}
    {"tool_call_id": "a", "content": ...}

Calls and results are joined by conversation and identifier, calls are checked
against schemas, ordered by what they come after, and written as canonical JSON:
keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.llm.common import saved
from tastemill.operators.skew import lookup_join

KEYS = ["conv_id", "turn", "role", "text"]
CALL = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is no valid JSON."""
    return F.to_json(F.try_parse_json(json))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages with ``message`` (a number of the row), ``calls`` and ``result_of``."""
    text = F.coalesce("text", F.lit(""))
    json = F.when(F.ltrim(text).startswith("{"), text)
    made = F.from_json(json, f"tool_calls {CALL}")
    calls = F.when(F.col("role") == "assistant", made["tool_calls"])
    result_of = F.when(F.col("role") == "tool", F.get_json_object(json, "$.tool_call_id"))
    rows = messages.select(*KEYS).select(
        *KEYS, F.coalesce(calls, F.array().cast(CALL)).alias("calls"), result_of.alias("result_of")
    )
    # The numbers name rows, so they are written down before anything is joined by them.
    return saved(rows.withColumn("message", F.monotonically_increasing_id()))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with ``valid``: known tool, arguments an object, required ones there, types right, no others.

    ``schemas`` has rows of tool ``name``, ``parameter``, JSON ``type`` (string,
    integer, number, boolean, object or array) and ``required``; it is looked up
    by name and parameter.
    """
    per_tool = schemas.groupBy("name").agg(
        F.map_from_entries(F.sort_array(F.collect_set(F.struct("parameter", "type")))).alias("types"),
        F.sort_array(F.collect_set(F.when(F.col("required"), F.col("parameter")))).alias("required"),
    )
    # Members by name, each as canonical JSON, so that strings keep their quotes; any name will do.
    members = F.from_json(canonical(F.col("arguments")), "map<string,variant>")
    members = F.transform_values(members, lambda _, value: F.to_json(value))

    def right(name: Column, wanted: Column) -> Column:
        # A value's type is read off its canonical JSON.
        value = F.try_element_at("members", name)
        return (
            F.when(wanted == "string", value.startswith('"'))
            .when(wanted == "integer", value.rlike(r"^-?[0-9]+$"))
            .when(wanted == "number", value.rlike(r"^-?[0-9]"))
            .when(wanted == "boolean", value.isin("true", "false"))
            .when(wanted == "object", value.startswith("{"))
            .when(wanted == "array", value.startswith("["))
            .otherwise(False)
        )

    given = lookup_join(calls, per_tool, "name").withColumn("members", members).withColumn("names", F.map_keys("members"))
    valid = (
        F.col("types").isNotNull()
        & F.col("names").isNotNull()
        & (F.size(F.array_except("required", "names")) == 0)
        & (F.size(F.array_except("names", F.map_keys("types"))) == 0)
        & F.forall("names", lambda k: F.coalesce(right(k, F.try_element_at("types", k)), F.lit(False)))
    )
    return given.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("types", "required", "names", "members")


def depths(calls: DataFrame) -> DataFrame:
    """``depth`` of each call: 0 after nothing, else one more than the deepest it comes after.

    Calls after one other form chains, which are followed by doubling the distance at
    each round, down to a call after none or several. Those are then settled level by level: one round for
    each call after several others on the longest chain. Each round is a join by conversation and identifier. Unknown
    identifiers don't count, and calls in a cycle, or after one, have no depth.
    """
    key = ["conv_id", "id"]
    nodes = calls.select(*key).distinct()
    known = nodes.withColumnRenamed("id", "needed")
    needs = calls.select(*key, F.explode("after").alias("needed")).distinct().join(known, ["conv_id", "needed"], "left_semi")
    counted = needs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed"))
    needs, single = saved(needs), saved(counted.where("n = 1").select(*key, F.col("needed").alias("end"), F.lit(1).alias("steps")))
    # An end that has one need itself can be moved on; in a cycle that never stops.
    longest = single.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(longest.bit_length() + 1):
        onward = single.select("conv_id", F.col("id").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        moved = single.join(onward, ["conv_id", "end"], "left")
        moved = moved.select(*key, F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNull().alias("over"))
        single = saved(moved)
        if single.where("not over").isEmpty():
            break
    ends = single.where("over").select(*key, "end", "steps")
    cyclic = single.where("not over").select(*key)
    # What is left: calls after several others, each other one followed to the end of its chain.
    several = needs.join(counted.where("n > 1").select(*key), key, "left_semi")
    link = ends.select("conv_id", F.col("id").alias("needed"), "end", "steps")
    waits = several.join(link, ["conv_id", "needed"], "left")
    waits = waits.select(*key, F.coalesce("end", "needed").alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), "needed")
    lost = cyclic.withColumnRenamed("id", "needed").withColumn("lost", F.lit(True))
    waits = saved(waits.join(lost, ["conv_id", "needed"], "left").groupBy(*key, "end").agg(F.max("steps").alias("steps"), F.max("lost").alias("lost")))
    done = saved(nodes.join(needs.select(*key).distinct(), key, "left_anti").withColumn("depth", F.lit(0)))
    new = done
    while not waits.isEmpty() and not new.isEmpty():
        settled = waits.join(done.withColumnRenamed("id", "end"), ["conv_id", "end"], "left")
        ready = settled.groupBy(*key).agg(
            F.max(F.col("depth") + F.col("steps")).alias("depth"), F.bool_and(F.col("depth").isNotNull() & F.col("lost").isNull()).alias("ready")
        )
        new = saved(ready.where("ready").select(*key, "depth"))
        waits = saved(waits.join(new, key, "left_anti"))
        done = saved(done.unionByName(new))
    chained = ends.join(done.withColumnRenamed("id", "end"), ["conv_id", "end"])
    return done.unionByName(chained.select(*key, (F.col("depth") + F.col("steps")).cast("int").alias("depth")))


def formatted(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each message, call by call, in the order of the formatted chat.

    Columns: ``conv_id``, ``turn``, ``role``, ``call_id`` (null for plain
    messages), ``depth`` (of a call; null without one), ``linked`` (a call has a
    result, a result has a call; null for plain messages), ``valid`` (of a call),
    ``position`` (1, 2, ... within a conversation and turn, calls by depth and
    identifier) and ``json``, canonical. Messages are never gathered into one
    row, so a conversation may have any length.

    A null text counts as empty; text that is no JSON object, or has none of the
    members above, is a plain message. Null conversations, turns and roles stay
    null and link nothing. Identifiers are meant to be unique within a
    conversation; repeated rows stay repeated, and a call or result met twice is
    linked if any partner exists. Empty tables give an empty one; other columns
    are not read.
    """
    rows = parsed(messages)
    calls = rows.select("conv_id", "turn", "role", "message", F.posexplode("calls").alias("place", "call")).select(
        "conv_id", "turn", "role", "message", "place", "call.id", "call.name", "call.arguments", F.coalesce("call.after", F.array().cast("array<string>")).alias("after")
    )
    calls = checked(calls, schemas)
    results = rows.where("result_of is not null").select("conv_id", F.col("result_of").alias("id"))
    answered = results.distinct().withColumn("linked", F.lit(True))
    depth = depths(calls.where("id is not null"))
    linked_calls = (
        calls.join(answered, ["conv_id", "id"], "left").join(depth, ["conv_id", "id"], "left").select(
            "conv_id",
            "turn",
            "role",
            "message",
            "place",
            F.col("id").alias("call_id"),
            "depth",
            F.coalesce("linked", F.lit(False)).alias("linked"),
            "valid",
            canonical(
                F.to_json(
                    F.struct(
                        "role",
                        F.struct("id", "name", F.coalesce(canonical(F.col("arguments")), F.col("arguments")).alias("arguments")).alias("tool_call"),
                    )
                )
            ).alias("json"),
        )
    )
    known = calls.where("id is not null").select("conv_id", F.col("id").alias("result_of")).distinct().withColumn("linked", F.lit(True))
    others = (
        rows.where(F.size("calls") == 0)
        .join(known, ["conv_id", "result_of"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            "message",
            F.lit(0).alias("place"),
            F.col("result_of").alias("call_id"),
            F.lit(None).cast("int").alias("depth"),
            F.when(F.col("result_of").isNotNull(), F.coalesce("linked", F.lit(False))).alias("linked"),
            F.lit(None).cast("boolean").alias("valid"),
            canonical(
                F.to_json(
                    F.struct(
                        "role",
                        F.col("result_of").alias("tool_call_id"),
                        F.coalesce(
                            F.when(F.col("result_of").isNotNull(), F.get_json_object("text", "$.content")), "text", F.lit("")
                        ).alias("content"),
                    )
                )
            ).alias("json"),
        )
    )
    # Only the calls of one message share a window.
    order = Window.partitionBy("message").orderBy(F.col("depth").asc_nulls_last(), "call_id", "place")
    numbered = linked_calls.withColumn("position", F.row_number().over(order))
    return numbered.unionByName(others.withColumn("position", F.lit(1))).drop("message", "place")
