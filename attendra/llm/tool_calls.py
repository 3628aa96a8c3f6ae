"""Tool calls linked to their results, ordered, validated and serialised, with SQL functions only.

``link`` takes calls (``conv_id, call_id, after_id, name, arguments``), results
(``call_id, content``) and a schema (``name, field, kind, required``):

* calls and results meet in a hash join on ``call_id``; of repeated calls or
  results with one id the least row counts. A call without a result has none, a
  result without a call is reported with ``error`` "no call";
* ``after_id`` names the call whose result a call uses. ``place`` is the number
  of calls before it on that path, found by pointer doubling, so a path of a
  thousand calls takes ten joins and no conversation is gathered. Calls on or
  behind a cycle have no place ("cycle"); a missing ``after_id`` counts as none;
* arguments must be one JSON object with each key once and nothing behind it, else
  they are malformed and serialised as null. Its fields are checked by their JSON
  kinds ("string", "integer", "number", "boolean", "object", "array") against the
  schema of the tool: unknown tool, missing or unknown fields, wrong kinds. A
  number without fraction is an integer, text of digits is not;
* ``json`` is canonical: keys of all depths in order, no blanks, text escaped as JSON
  asks, numbers in their shortest form. Values keep their kinds.

Null call ids are dropped; null texts are JSON nulls. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attendra.sources.storage import materialize

#: Kind -> pattern on the type that Spark tells of a JSON value.
KINDS = {
    "string": "^STRING$",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$",
    "number": "^(BIGINT|DECIMAL.*|DOUBLE)$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
}


def places(calls: DataFrame) -> DataFrame:
    """``call_id, place``: calls before each on its path; null on or behind a cycle."""
    known = calls.select(F.col("call_id").alias("after_id"), F.lit(True).alias("known"))
    at = materialize(
        calls.select("call_id", "after_id")
        .join(known, "after_id", "left")
        .select("call_id", F.when(F.col("known"), F.col("after_id")).alias("up"))
        .withColumn("place", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")),
        "call-places",
    )
    total = None
    reached = 1
    while True:
        open_rows = at.where(F.col("up").isNotNull()).count()
        if not open_rows:
            break
        total = total or at.count()
        if reached > total:  # longer than any path without a cycle
            break
        higher = at.select(F.col("call_id").alias("up"), F.col("up").alias("upper"), F.col("place").alias("more"))
        at = materialize(
            at.join(higher, "up", "left").select(
                "call_id", F.col("upper").alias("up"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")
            ),
            "call-places",
        )
        reached *= 2
    return at.select("call_id", F.when(F.col("up").isNull(), F.col("place")).alias("place"))


def parsed(text: Column) -> Column:
    """JSON text as a variant; null unless all of it is one value without repeated keys.

    The parser stops behind the first value. Inside an array what follows an early end
    is refused unless it closes the array, inside an object unless it closes that.
    """
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(alone.isNotNull(), F.try_variant_get(inside, "$.v", "variant"))


def checked_arguments(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """``call_id, problem, canonical``: the first problem in text order and canonical arguments.

    Each call is checked within its row, against the fields of its tool.
    """
    rules = (
        schema.groupBy("name", "field")
        .agg(F.min("kind").alias("kind"), F.max("required").alias("required"))
        .groupBy("name")
        # As many entries as the tool has fields.
        .agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("kind", "required")))).alias("rules"))
    )
    value = calls.select("call_id", "name", parsed(F.col("arguments")).alias("value"))
    given = value.withColumn("given", F.try_variant_get("value", "$", "map<string,variant>")).join(rules, "name", "left")

    def problem(field: Column, found: Column) -> Column:
        rule = F.try_element_at("rules", field)
        right = F.lit(False)
        for kind, pattern in KINDS.items():
            right = right | ((rule["kind"] == kind) & F.schema_of_variant(found).rlike(pattern))
        return (
            F.when(rule.isNull(), F.concat(F.lit("unknown field "), field))
            .when(F.is_variant_null(found) & rule["required"], F.concat(F.lit("missing field "), field))
            .when(~F.is_variant_null(found) & ~right, F.concat(F.lit("wrong kind of "), field))
        )

    problems = F.transform(F.map_entries("given"), lambda e: problem(e["key"], e["value"]))
    absent = F.exists(
        F.map_entries("rules"), lambda r: r["value"]["required"] & ~F.map_contains_key(F.col("given"), r["key"])
    )
    first = F.array_min(F.filter(problems, lambda p: p.isNotNull()))
    return given.select(
        "call_id",
        F.when(F.col("rules").isNull(), "unknown tool")
        .when(F.col("given").isNull(), "malformed arguments")
        .when(first.isNotNull(), first)
        .when(absent, "missing field")
        .alias("problem"),
        F.when(F.col("given").isNotNull(), F.to_json("value")).alias("canonical"),
    )


def json_value(value: Column) -> Column:
    """A non-null string as a JSON string."""
    whole = F.to_json(F.struct(value.alias("v")))  # {"v":"..."}
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def link(calls: DataFrame, results: DataFrame, schema: DataFrame) -> DataFrame:
    """``conv_id, call_id, place, linked, valid, error, json``, a row per call or lone result."""
    fields = [F.col(c) for c in ("conv_id", "after_id", "name", "arguments")]
    calls = materialize(
        calls.where("call_id is not null")
        .groupBy("call_id")
        .agg(F.min(F.struct(*fields)).alias("call"))
        .select("call_id", "call.*"),
        "calls",
    )
    results = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    ordered = calls.join(places(calls), "call_id").join(checked_arguments(calls, schema), "call_id").withColumn("is_call", F.lit(True))
    both = ordered.join(results, "call_id", "full")
    error = (
        F.when(F.col("is_call").isNull(), "no call")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.col("place").isNull(), "cycle")
    )
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(json_value(F.col(c).cast("string")))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")),
        F.lit(',"call_id":'), text("call_id"),
        F.lit(',"name":'), text("name"),
        F.lit(',"result":'), text("content"), F.lit("}"),
    )
    return both.select(
        "conv_id", "call_id", "place", F.coalesce("linked", F.lit(False)).alias("linked"),
        error.isNull().alias("valid"), error.alias("error"), body.alias("json"),
    )
