"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON. DataFrame operations only.

Calls and results meet in a hash join on (conversation, identifier). A call may name earlier calls whose results it uses. Chains of calls that use
one call each are walked by doubling pointers, so that its rounds grow with the logarithm of the longest chain; calls that use several are then peeled
level by level. Arguments are parsed into variants, checked against the tool's schema, and written with sorted keys and without white space.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import WORD, checkpointed, table

#: JSON types and how the type of a variant reads.
TYPES = {"string": "STRING", "number": r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "OBJECT<.*>", "null": "VOID"}
#: The tools that the query's conversations call: what a user asks for, and a system message as a setting.
SCHEMAS = {
    "reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 1500}, "turn": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 2}}, "required": ["prompt", "turn", "words"], "additionalProperties": False},
    "configure": {"type": "object", "properties": {"system": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}, "required": ["system"]},
}


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and without white space; null if it isn't JSON, or if an object repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _is(value: Column, kind: str) -> Column:
    """Whether a variant has a JSON Schema type; a number without a fraction is an integer."""
    if kind == "integer":
        number = F.when(_is(value, "number"), F.try_variant_get(value, "$", "double"))
        return F.coalesce(number % 1 == 0, F.lit(False))
    return F.schema_of_variant(value).rlike(f"^{TYPES[kind]}$")


def _equals(value: Column, constant: object) -> Column:
    """Whether a variant is a JSON value; numbers are equal by value, objects whatever the order of their keys."""
    if isinstance(constant, bool) or constant is None or isinstance(constant, list | dict):
        return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))
    kind, read = ("string", "string") if isinstance(constant, str) else ("number", "double")
    return F.coalesce(_is(value, kind) & (F.try_variant_get(value, "$", read) == F.lit(constant)), F.lit(False))


#: Rules that nest or only describe; any other than these and the tests below isn't known.
NESTING = {"properties", "required", "additionalProperties", "items", "$defs", "definitions", "title", "description", "default", "examples", "$schema", "$id", "$comment"}


def _member(value: Column, name: str) -> Column:
    """The variant under a name of an object, null if it isn't there. A path can't hold every name, a map can."""
    if re.fullmatch(r"[^'\"\\?]+", name):
        return F.try_variant_get(value, f"$['{name}']", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


def _found(value: Column, schema: dict, root: dict, path: str, opened: frozenset = frozenset()) -> list[Column]:
    """What is wrong with a variant that is there: texts or arrays of texts, null where nothing is. opened: the references that lead here. A rule that isn't known raises an error."""
    if "$ref" in schema:
        if schema["$ref"] in opened:
            raise ValueError("schemas that refer to themselves aren't supported")
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return _found(value, target, root, path, opened | {schema["$ref"]})
    text, number = F.when(_is(value, "string"), F.try_variant_get(value, "$", "string")), F.when(_is(value, "number"), F.try_variant_get(value, "$", "double"))
    size = F.when(_is(value, "array"), F.size(F.try_variant_get(value, "$", "array<variant>")))
    tests = {
        "type": lambda v: ~_any([_is(value, k) for k in ([v] if isinstance(v, str) else v)]),
        "enum": lambda v: ~_any([_equals(value, x) for x in v]),
        "const": lambda v: ~_equals(value, v),
        "minimum": lambda v: number < v,
        "maximum": lambda v: number > v,
        "exclusiveMinimum": lambda v: number <= v,
        "exclusiveMaximum": lambda v: number >= v,
        "minLength": lambda v: F.length(text) < v,
        "maxLength": lambda v: F.length(text) > v,
        "pattern": lambda v: ~text.rlike(v),
        "minItems": lambda v: size < v,
        "maxItems": lambda v: size > v,
    }
    unknown = set(schema) - set(tests) - NESTING | ({"additionalProperties"} if not isinstance(schema.get("additionalProperties", True), bool) else set()) | ({"items"} if not isinstance(schema.get("items", {}), dict) else set())
    if unknown:
        raise ValueError(f"rules that aren't known: {', '.join(sorted(unknown))}")
    at = f"{path}: " if path else ""
    found = [F.when(tests[rule](limit), F.lit(f"{at}{rule}")) for rule, limit in schema.items() if rule in tests and (path or rule != "type")]
    inside = f"{path}." if path else ""
    for name, rule in schema.get("properties", {}).items():
        child = F.when(_is(value, "object"), _member(value, name))
        found += [F.when(child.isNotNull(), e) for e in _found(child, rule, root, f"{inside}{name}", opened)]
    found += [F.when(_is(value, "object") & _member(value, name).isNull(), F.lit(f"{inside}{name}: required")) for name in schema.get("required", [])]
    if schema.get("additionalProperties") is False:
        extra = F.array_except(F.json_object_keys(F.when(_is(value, "object"), F.to_json(value))), F.array(*[F.lit(x) for x in schema.get("properties", {})]).cast("array<string>"))
        found.append(F.when(F.size(extra) > 0, F.concat(F.lit(f"{at}unknown: "), F.array_join(F.array_sort(extra), " "))))
    if isinstance(schema.get("items"), dict):
        items = F.when(_is(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
        each = F.transform(items, lambda x, i: F.transform(_listed(_found(x, schema["items"], root, "item", opened)), lambda e: F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("] "), e)))
        found.append(F.array_join(F.when(F.size(F.flatten(each)) > 0, F.flatten(each)), "; "))
    return found


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _listed(found: list[Column]) -> Column:
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def schema_errors(arguments: Column, schema: dict) -> Column:
    """Array of what is wrong with a variant by a schema: type, enum, const, properties, required, additionalProperties, items and $ref at any depth,
    and the bounds of numbers (minimum, maximum and the exclusive ones), texts (minLength, maxLength, pattern) and arrays (minItems, maxItems), which
    values of other types pass. Empty if nothing is."""
    kinds = schema.get("type", "object")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    wrong = F.array(F.lit(f"not of type {' or '.join(kinds)}"))
    return F.when(arguments.isNull(), F.array(F.lit("not JSON"))).when(~_any([_is(arguments, k) for k in kinds]), wrong).otherwise(_listed(_found(arguments, schema, schema, "")))


def validated(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    out = None
    for tool, schema in schemas.items():
        errors = schema_errors(arguments, schema)
        out = F.when(name == tool, errors) if out is None else out.when(name == tool, errors)
    unknown = F.array(F.lit("unknown tool"))
    return unknown if out is None else out.otherwise(unknown)


def _used(calls: DataFrame) -> Column:
    """The identifiers that a call uses, once each."""
    one = dict(calls.dtypes)["after"].startswith("array")
    return F.array_distinct(F.array_compact(F.col("after") if one else F.array("after")))


def ordered(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, latest, cyclic) for calls (conv_id, call_id, turn, after), each once. after: an identifier or an array of them.

    depth: calls before it in its longest chain; latest: the latest turn in all chains up to it. By (latest, depth, turn) every call follows
    those it uses, however late they were issued. Calls that aren't there aren't waited for. Calls in or behind a circle are cyclic, with null depth and latest.
    The rounds grow with the logarithm of the longest chain of calls that use one call, and with the most calls with several parents in one chain.
    """
    same = lambda c, i, other: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col(i) == F.col(other))
    there = calls.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"))
    uses = calls.select("conv_id", "call_id", F.explode(_used(calls)).alias("parent"))
    uses = checkpointed(uses.join(there, same("pc", "parent", "pi"), "left_semi"))
    parents = uses.groupBy(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi")).agg(F.count("*").alias("parents"), F.max("parent").alias("only"))
    state = calls.select("conv_id", "call_id", "turn").join(parents, same("pc", "call_id", "pi"), "left")
    one, many = F.col("parents") == 1, F.coalesce(F.col("parents") > 1, F.lit(False))
    # a call without a single parent ends the walk of those behind it
    state = checkpointed(state.select("conv_id", "call_id", F.when(one, F.col("only")).alias("next"), F.when(one, 1).otherwise(0).cast("long").alias("depth"), F.col("turn").alias("latest"), F.when(one, F.lit(None)).otherwise(F.col("call_id")).alias("anchor"), many.alias("many")))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        if not state.where("next is not null").limit(1).count():
            break
        step = state.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), F.col("next").alias("n2"), F.col("depth").alias("d2"), F.col("latest").alias("l2"), F.col("anchor").alias("a2"))
        open_, done = state.where("next is not null"), state.where("next is null")
        moved = open_.join(step, same("pc", "next", "pi")).select("conv_id", "call_id", F.col("n2").alias("next"), (F.col("depth") + F.col("d2")).alias("depth"), F.greatest("latest", "l2").alias("latest"), F.col("a2").alias("anchor"), "many")
        state = checkpointed(done.unionByName(moved))
    if not state.where("many").limit(1).count():
        cyclic = F.col("next").isNotNull()
        return state.select("conv_id", "call_id", F.when(~cyclic, F.col("depth")).alias("depth"), F.when(~cyclic, F.col("latest")).alias("latest"), cyclic.alias("cyclic"))
    # calls with several parents: each waits for the ends of its parents' walks
    ends = state.select(F.col("conv_id").alias("pc"), F.col("call_id").alias("pi"), "anchor", "depth", "latest")
    merges = state.where("many").select("conv_id", "call_id", F.col("latest").alias("turn")).join(uses.withColumnsRenamed({"conv_id": "uc", "call_id": "ui"}), same("uc", "call_id", "ui"))
    merges = checkpointed(merges.join(ends, same("pc", "parent", "pi")).select("conv_id", "call_id", "turn", "anchor", "depth", "latest"))
    solved = checkpointed(state.where("next is null and not many").select(F.col("conv_id").alias("sc"), F.col("call_id").alias("si"), F.col("depth").alias("d"), F.col("latest").alias("l")))
    had = -1
    while (now := solved.count()) > had:
        had = now
        waiting = merges.join(solved, same("sc", "call_id", "si"), "left_anti").join(solved, same("sc", "anchor", "si"), "left")
        ready = waiting.groupBy("conv_id", "call_id").agg(F.max((F.col("d").isNull()).cast("int")).alias("open"), F.max(F.col("d") + F.col("depth") + 1).alias("d"), F.max(F.greatest("turn", "l", "latest")).alias("l")).where("open = 0")
        solved = checkpointed(solved.unionByName(ready.select(F.col("conv_id").alias("sc"), F.col("call_id").alias("si"), "d", "l")))
    out = state.join(solved, same("sc", "anchor", "si"), "left")
    return out.select("conv_id", "call_id", (F.col("d") + F.col("depth")).alias("depth"), F.when(F.col("d").isNotNull(), F.greatest("latest", "l")).alias("latest"), F.col("d").isNull().alias("cyclic"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each identifier of a conversation that a call or a result bears.

    calls: (conv_id, call_id, turn, name, arguments, after), after being an identifier or an array of them, results: (conv_id, call_id, turn, content); other columns don't matter.
    Returns conv_id, call_id, status (linked, unanswered, orphan), call_turn, result_turn, depth, latest, cyclic, valid, errors
    and json, the canonical exchange. Of calls (and of results) that repeat an identifier the one of the smallest turn counts, then of the smallest
    text. Rows without an identifier are left out; a null conv_id is a conversation. Null or malformed arguments are errors and
    appear as null in json; null contents and names too. Arguments and contents of any length are parsed and
    written whole. Repeated rows count once. Empty inputs give no rows.
    """
    first = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    first = first.select("conv_id", "call_id", F.col("c.turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    order = ordered(first.select("conv_id", "call_id", "turn", "after")).withColumnsRenamed({"conv_id": "oc", "call_id": "oi"})
    answers = results.where("call_id is not null").groupBy(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri")).agg(F.min(F.struct("turn", "content")).alias("r"))
    same = lambda c, i: F.col("conv_id").eqNullSafe(F.col(c)) & (F.col("call_id") == F.col(i))
    both = first.join(order, same("oc", "oi")).join(answers, same("rc", "ri"), "full")
    parsed = F.try_parse_json(F.col("arguments"))
    called = F.col("oi").isNotNull()
    errors = F.when(called, validated(F.col("name"), parsed, schemas))
    rows = both.select(
        F.coalesce("conv_id", "rc").alias("conv_id"),
        F.coalesce("call_id", "ri").alias("call_id"),
        F.when(~called, "orphan").when(F.col("ri").isNull(), "unanswered").otherwise("linked").alias("status"),
        F.col("turn").alias("call_turn"),
        F.col("r.turn").alias("result_turn"),
        "depth",
        "latest",
        "cyclic",
        (F.size(errors) == 0).alias("valid"),
        F.array_join(errors, "; ").alias("errors"),
        "name",
        "after",
        F.to_json(parsed).alias("arguments_json"),
        F.col("r.content").alias("result"),
    ).withColumn("id", F.col("call_id"))
    # the arguments are put in as JSON, not as text; everything is then sorted and written by one rule
    quoted = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.array(F.col(c)))), F.lit("[null]"))
    bare = lambda c: F.substr(quoted(c), F.lit(2), F.length(quoted(c)) - 2)
    used = F.coalesce(F.to_json(F.to_variant_object("after")), F.lit("null")) if dict(calls.dtypes)["after"].startswith("array") else bare("after")
    text = F.concat(F.lit('{"after":'), used, F.lit(',"arguments":'), F.coalesce("arguments_json", F.lit("null")), F.lit(',"id":'), bare("id"), F.lit(',"name":'), bare("name"), F.lit(',"result":'), bare("result"), F.lit("}"))
    return rows.withColumn("json", text).drop("name", "after", "arguments_json", "result", "id")


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations (conv_id, turn, role, text), which name no tools themselves.

    A user's turn calls `reply` and uses the reply that came two turns before, a system turn calls `configure`; a call's identifier is its
    turn. An assistant's turn is the result of the call of the turn before it.
    """
    said = F.coalesce("text", F.lit(""))
    words = F.regexp_count(said, F.lit(WORD))
    prompt = F.to_json(F.struct(words.alias("words"), F.col("turn"), F.col("text").alias("prompt")))
    setting = F.to_json(F.struct(F.col("turn"), F.col("text").alias("system")))
    user = F.col("role") == "user"
    calls = conversations.where("role in ('user', 'system') and turn is not null").select("conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.when(user, "reply").otherwise("configure").alias("name"), F.when(user, prompt).otherwise(setting).alias("arguments"), F.when(user & (F.col("turn") >= 2), (F.col("turn") - 2).cast("string")).alias("after"))
    results = conversations.where("role = 'assistant' and turn is not null").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*calls_of(table(spark, sf_dir, "conversations")), SCHEMAS)
