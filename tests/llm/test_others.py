"""Conversations, vectors and the pipeline."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievespark.llm import ann, chat

CALLS = "conv_id string, call_id string, turn long, name string, arguments string, after string"


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            ("a", "1", 5, "reply", '{"words":3,"prompt":"x","turn":1,"q":1}', "2"), ("a", "2", 7, "reply", "{bad", None), ("a", "3", 1, "reply", "[1]", "1"), ("a", "1", 6, "reply", "{}", None),
            ("b", "x", 1, "z", "{}", "y"), ("b", "y", 2, "z", None, "x"), ("b", "w", 3, "z", None, "x"), (None, "1", 1, None, None, "9"), ("a", None, 1, "z", "{}", None),
            ("a", "4", 9, "reply", '{"turn": 1.5, "words": 1, "prompt": ""}', None),
        ],
        CALLS,
    )
    results = spark.createDataFrame([("a", "1", 6, 'é"\n'), ("a", "1", 9, "late"), ("q", "1", 9, None)], "conv_id string, call_id string, turn long, content string")
    extra = {c: F.lit("x") for c in ("depth", "latest", "next", "pc", "status")}
    out = {(r["conv_id"], r["call_id"]): r for r in chat.link(calls.withColumns(extra), results.withColumns(extra), chat.SCHEMAS).collect()}
    assert out["a", "1"]["json"] == '{"after":"2","arguments":{"prompt":"x","q":1,"turn":1,"words":3},"id":"1","name":"reply","result":"é\\"\\n"}'
    assert [out["a", i]["errors"] for i in "1234"] == ["unknown: q", "not JSON", "not of type object", "prompt: minLength; turn: type; words: minimum"]
    assert [(out["a", i]["latest"], out["a", i]["depth"]) for i in "123"] == [(7, 1), (7, 0), (7, 2)]
    assert all(out["b", i]["cyclic"] for i in "xyw") and out["b", "x"]["depth"] is None
    assert out["q", "1"]["status"] == "orphan" and out[None, "1"]["status"] == "unanswered" and len(out) == 9
    assert all(json.loads(r["json"])["id"] == r["call_id"] for r in out.values())
    assert chat.link(calls.limit(0), results.limit(0), chat.SCHEMAS).count() == 0


def test_long_chain(spark):
    calls = spark.createDataFrame([("c", str(i), 100 - i if i == 50 else i, "z", "{}", str(i - 1) if i else None) for i in range(70)], CALLS)
    out = sorted(chat.ordered(calls.select("conv_id", "call_id", "turn", "after")).collect(), key=lambda r: int(r["call_id"]))
    assert [r["depth"] for r in out] == list(range(70)) and not any(r["cyclic"] for r in out)


@pytest.mark.parametrize("block", [4096, 40])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 16))
    x[100:250] = x[7]  # a vector that a third of the rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, None] * 8), (1400, [float("inf")] * 16), (None, [1.0] * 16), (1500, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("block", "score", "code", "v", "label")})
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 100, 200, 300, 400]
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(500), d))[:10]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hits += len(set(want) & {v for _, v, _ in found})
    assert hits >= 0.98 * 50
    few = ann.nearest(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")).collect()
    assert [r["rank"] for r in few] == [1, 2, 3] and ann.nearest(df.limit(0)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    vocabulary = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "lambda", "theta", "zeta"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = "\n".join(text(8) for _ in range(3))
    rows = [(i, text(60), "en", "s0" if i % 3 else "s1") for i in range(30)]
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[1][1] + " omega", "en", "s1"), (102, shared + "\n" + text(50), "en", "s0"), (103, text(50) + "\n" + shared, "en", "s0"), (104, "123", "en", "s0"), (105, None, "en", "s0"), (106, "", None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= {*range(30), 102, 103}
    # what reaches the mix: documents that have a language, with the later passage cut, one of each group
    left = {r[0]: r[1] for r in rows if r[0] < 100 or r[0] in (102, 103)}
    left[103] = left[103].split("\n")[0]
    size = {i: len(t.split()) for i, t in left.items()}
    source = {r[0]: r[3] for r in rows}
    totals = {s: sum(n for i, n in size.items() if source[i] == s) for s in ("s0", "s1")}
    want = {"s0": min(2 * totals["s0"], 1.5 * sum(totals.values()) * 5 / 7)}
    want["s1"] = min(2 * totals["s1"], 1.5 * sum(totals.values()) - want["s0"])
    taken = {"s0": 0, "s1": 0}
    for r in out:
        taken[source[r["doc_id"]]] += size[r["doc_id"]]
    assert all(abs(taken[s] - want[s]) <= 60 for s in taken)
    import hashlib

    assert all(r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() for r in out)


SCHEMA = {
    "type": "object", "required": ["id", "it's"], "additionalProperties": False, "$defs": {"place": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0}, "y": {"type": ["integer", "null"]}}, "required": ["x"]}},
    "properties": {"id": {"type": "integer", "maximum": 1e31}, "it's": {"enum": ["a", 1, None]}, "where": {"$ref": "#/$defs/place"}, "back": {"$ref": "#/$defs/place"}, "list": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/place"}}, "q?": {"const": {"b": [1, 2], "a": True}}},
}


def plainly(value, schema, path=""):
    """What is wrong, as a set of (place, rule)."""
    if "$ref" in schema:
        return plainly(value, SCHEMA["$defs"]["place"], path)
    number = isinstance(value, int | float) and not isinstance(value, bool)
    is_kind = {"object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "number": number, "integer": number and value % 1 == 0, "null": value is None, "boolean": isinstance(value, bool)}
    kinds = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", list(is_kind))
    same = lambda a, b: type(a) is type(b) and a == b or (isinstance(a, int | float) and isinstance(b, int | float) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)
    out = {(path, "type")} if not any(is_kind[k] for k in kinds) else set()
    out |= {(path, "enum")} if "enum" in schema and not any(same(value, x) for x in schema["enum"]) else set()
    out |= {(path, "const")} if "const" in schema and not same(value, schema["const"]) else set()
    out |= {(path, "minimum")} if number and value < schema.get("minimum", value) else set()
    out |= {(path, "maximum")} if number and value > schema.get("maximum", value) else set()
    if isinstance(value, list):
        out |= {(path, "maxItems")} if len(value) > schema.get("maxItems", len(value)) else set()
        for i, x in enumerate(value if "items" in schema else []):
            out |= plainly(x, schema["items"], f"{path}[{i}] item")
    if isinstance(value, dict):
        inside = f"{path}." if path else ""
        out |= {(f"{inside}{k}", "required") for k in schema.get("required", []) if k not in value}
        for k, v in value.items():
            if k in schema.get("properties", {}):
                out |= plainly(v, schema["properties"][k], f"{inside}{k}")
            elif schema.get("additionalProperties") is False:
                out.add((path, f"unknown: {k}"))
    return out


def test_arguments_against_a_plain_validator(spark):
    rng = np.random.default_rng(8)

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def place():
        return pick({"x": 1, "y": None}, {"x": -2.5, "y": 3}, {"y": "n"}, {"x": 0, "y": 1.5, "z": 2}, "nowhere", None, [], {"x": True})

    values = []
    for _ in range(120):
        full = {"id": pick(1, 2.0, 2.5, 10**30, 1e44, 12345678901234567890123, "1", None), "it's": pick("a", 1, 1.0, None, "b", True), "where": place(), "back": place(), "list": pick([], [place()], [place(), place(), place()], 7), "q?": pick({"a": True, "b": [1, 2]}, {"b": [1, 2], "a": True}, {"a": True}, 0), "more": 1}
        values.append({k: v for k, v in full.items() if rng.random() < 0.7})
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, a string")
    for r in rows.select("i", chat.schema_errors(F.try_parse_json("a"), SCHEMA).alias("e")).collect():
        found = [x for e in r["e"] for x in e.split("; ")]
        want = {f"{p}: {rule}" if p else rule for p, rule in plainly(values[r["i"]], SCHEMA)}
        assert set(found) == want, values[r["i"]]


def test_schemas_that_arent_known(spark):
    column = F.lit("{}")
    for schema in ({"anyOf": [{"type": "string"}]}, {"type": "object", "properties": {"a": {"multipleOf": 2}}}, {"additionalProperties": {"type": "string"}}, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"b": {"$ref": "#/$defs/a"}}}}}):
        with pytest.raises(ValueError, match="aren't"):
            chat.schema_errors(column, schema)
    deep = {"type": "integer"}
    for _ in range(20):
        deep = {"properties": {"d": deep}}
    chat.schema_errors(column, {"properties": {"d": {"$ref": "#/$defs/i"}, "e": {"$ref": "#/$defs/i"}}, "$defs": {"i": deep}})
