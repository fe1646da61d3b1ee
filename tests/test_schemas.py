import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwell.functions import jsontext, schemas

TOOL = {
    "type": "dict",
    "properties": {"sku": {"type": "string"}, "quantity_delta": {"type": "integer"}, "bins": {"type": "array", "items": {"type": "integer"}}, "weight": {"type": "float"}, "flags": {"type": "dict", "properties": {"urgent": {"type": "boolean"}}, "required": ["urgent"]}},
    "required": ["sku", "quantity_delta", "bins"],
}


def errors(spark, schema, values):
    rows = spark.createDataFrame([(i, json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    read = rows.select("i", jsontext.read_call("v").alias("r"))
    found = read.select("i", schemas.first_error(F.col("r.leaves"), schemas.fixed(schema)).alias("e")).orderBy("i").collect()
    return [None if r.e is None else (r.e.keyword, r.e.path, r.e.message) for r in found]


def obj(**parts):
    return {"type": "object", "properties": parts, "additionalProperties": False}


def test_each_keyword(spark):
    cases = [
        (obj(a={"type": "integer"}), {"a": "x"}, ("type", "/a", "'x' is not of type 'integer'")),
        (obj(a={"type": "integer"}), {"a": 2.0}, None),
        (obj(a={"type": "integer"}), {"a": True}, ("type", "/a", "True is not of type 'integer'")),
        (obj(a={"type": ["string", "null"]}), {"a": 1}, ("type", "/a", "1 is not of type 'string', 'null'")),
        (obj(a={"type": "string", "pattern": "^x"}), {"a": "yx"}, ("pattern", "/a", "'yx' does not match '^x'")),
        (obj(a={"enum": ["p", 1, None]}), {"a": 1.0}, None),
        (obj(a={"enum": ["p", 1, None]}), {"a": None}, None),
        (obj(a={"enum": ["p", 1]}), {"a": "1"}, ("enum", "/a", "'1' is not one of the options")),
        (obj(a={"const": 10**20}), {"a": 1e20}, None),
        (obj(a={"const": "t"}), {"a": "u"}, ("const", "/a", "t was expected")),
        (obj(a={"minimum": 3}), {"a": 2}, ("minimum", "/a", "2 is less than the minimum")),
        (obj(a={"maximum": 3}), {"a": 3.5}, ("maximum", "/a", "3.5 is greater than the maximum")),
        (obj(a={"exclusiveMinimum": 3}), {"a": 3}, ("exclusiveMinimum", "/a", "3 is less than or equal to the minimum")),
        (obj(a={"exclusiveMaximum": 3}), {"a": 3}, ("exclusiveMaximum", "/a", "3 is greater than or equal to the maximum")),
        (obj(a={"multipleOf": 0.5}), {"a": 1.5}, None),
        (obj(a={"multipleOf": 4}), {"a": 6}, ("multipleOf", "/a", "6 is not a multiple of the step")),
        (obj(a={"minLength": 2}), {"a": "é"}, ("minLength", "/a", "'é' is too short")),
        (obj(a={"maxLength": 1}), {"a": "ab"}, ("maxLength", "/a", "'ab' is too long")),
        (obj(a={"minItems": 1}), {"a": []}, ("minItems", "/a", "[...] is too short")),
        (obj(a={"maxItems": 1}), {"a": [1, 2]}, ("maxItems", "/a", "[...] is too long")),
        ({"type": "object", "minProperties": 1}, {}, ("minProperties", "", "{...} does not have enough properties")),
        ({"type": "object", "maxProperties": 1}, {"a": 1, "b": 2}, ("maxProperties", "", "{...} has too many properties")),
        ({"type": "object"} | {"required": ["b", "c"]}, {"a": 1}, ("required", "", "'b' is a required property")),
        (obj(a={}), {"z": 1, "y": 2}, ("additionalProperties", "", "Additional properties are not allowed ('z', 'y' were unexpected)")),
        ({"type": "object", "properties": {}}, {"z": {"deep": [1]}}, None),
    ]
    rows = [(i, json.dumps(schema), json.dumps(value)) for i, (schema, value, _) in enumerate(cases)]
    frame = schemas.with_nodes(spark.createDataFrame(rows, "i int, doc string, v string").coalesce(1), "doc").withColumn("r", jsontext.read_call("v"))
    got = frame.select("i", schemas.first_error(F.col("r.leaves"), F.col("nodes")).alias("e")).orderBy("i").collect()
    for r, (schema, value, want) in zip(got, cases, strict=True):
        assert (r.e and (r.e.keyword, r.e.path, r.e.message)) == want, (schema, value)


def test_first_error_by_path_positions_as_numbers_then_keywords(spark):
    schema = obj(b={"type": "array", "items": obj(x={"type": "integer", "minimum": 5}) | {"required": ["x"]}}, a={"type": "string"})
    bad = [{"x": 9}] * 2 + [{"x": 1}] + [{"x": 9}] * 7 + [{"x": 0}]
    assert errors(spark, schema, [{"b": bad}, {"b": bad, "a": 1}, {"b": [{"x": 9}, {}]}, {"b": [{"x": "s"}]}, "no json", {"b": [], "q": 1, "a": 2}]) == [
        ("minimum", "/b/2/x", "1 is less than the minimum"), ("type", "/a", "1 is not of type 'string'"), ("required", "/b/1", "'x' is a required property"), ("type", "/b/0/x", "'s' is not of type 'integer'"), None,
        ("additionalProperties", "", "Additional properties are not allowed ('q' was unexpected)"),
    ]
    both = {"type": "object", "additionalProperties": False, "required": ["n"], "properties": {}}
    assert [e[0] for e in errors(spark, both, [{"m": 1}])] == ["additionalProperties"]
    assert [e[0] for e in errors(spark, dict(reversed(list(both.items()))), [{"m": 1}])] == ["required"]


def test_keys_with_signs_of_paths(spark):
    schema = obj(**{"a/b": {"type": "integer"}, "*": {"type": "string"}, "~": {"type": "null"}})
    assert errors(spark, schema, [{"a/b": 1, "*": "s", "~": None}, {"a/b": "x"}, {"*": 1}]) == [None, ("type", "/a~1b", "'x' is not of type 'integer'"), ("type", "/~2", "1 is not of type 'string'")]


def test_tool_schemas():
    strict = schemas.strict_schema(TOOL)
    assert strict["properties"]["weight"] == {"type": "number"} and strict["additionalProperties"] is False and strict["properties"]["flags"]["required"] == ["urgent"]
    external = schemas.call_schema("adjust_inventory", strict, integers=False)["properties"]["arguments"]
    assert external["properties"]["quantity_delta"] == {"type": "string", "pattern": schemas.CANONICAL_SEARCH}
    assert external["properties"]["bins"]["items"]["type"] == "string" and external["properties"]["weight"] == {"type": "number"}
    assert schemas.call_schema("t", strict)["properties"]["arguments"]["properties"]["quantity_delta"] == {"type": "integer"}
    for bad in ({"type": "tuple"}, {"type": "array"}, {"type": "dict"}, {"type": "dict", "properties": {"a": 1}}, {"type": "dict", "properties": {}, "required": ["a"]}, [], None):
        with pytest.raises(schemas.UnsupportedSchema):
            schemas.strict_schema(bad)


@pytest.mark.parametrize("keyword", schemas.INTEGER_CONSTRAINTS)
def test_integers_with_constraints_have_no_string_form(keyword):
    with pytest.raises(schemas.UnsupportedSchema, match=keyword):
        schemas.integers_as_strings({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer", keyword: 7}}}})


@pytest.mark.parametrize("schema", [{"$ref": "#/x"}, {"oneOf": []}, {"type": "object", "additionalProperties": {"type": "string"}}, {"enum": [[1]]}, {"type": "array", "items": True}])
def test_what_is_not_checked_is_refused(schema):
    with pytest.raises(schemas.UnsupportedSchema):
        schemas.nodes_of(schema)


def test_documents_of_a_column(spark):
    docs = [TOOL, {"type": "tuple"}, {"type": "dict", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": []}, "{"]
    calls = [{"name": "t", "arguments": {"sku": "a", "quantity_delta": -1, "bins": [0]}}, {"name": "t", "arguments": {"n": 0}}, {"name": "u", "arguments": {}}]
    rows = [(i, j, d if isinstance(d, str) else json.dumps(d), json.dumps(c), "t") for i, d in enumerate(docs) for j, c in enumerate(calls)]
    frame = spark.createDataFrame(rows, "i int, j int, doc string, call string, tool string")
    read = schemas.with_nodes(frame, "doc", "tool").withColumn("r", jsontext.read_call("call"))
    got = {(r.i, r.j): (r.problem is not None, r.e and (r.e.keyword, r.e.path)) for r in read.select("i", "j", "problem", schemas.first_error(F.col("r.leaves"), F.col("nodes")).alias("e")).collect()}
    assert [got[0, j] for j in range(3)] == [(False, None), (False, ("required", "/arguments")), (False, ("required", "/arguments"))]
    assert [got[2, j] for j in range(3)] == [(False, ("additionalProperties", "/arguments")), (False, ("minimum", "/arguments/n")), (False, ("const", "/name"))]
    assert all(got[i, j] == (True, None) for i in (1, 3) for j in range(3))
    text = schemas.with_nodes(frame, "doc", "tool", integers=False).filter("i = 2").first()
    assert "minimum" in text.problem


def test_a_batch_compiles_each_document_once(monkeypatch):
    seen, one = [], schemas._compiled
    monkeypatch.setattr(schemas, "_compiled", lambda *x: seen.append(x) or one(*x))
    docs = [json.dumps(TOOL), None, "{", json.dumps(TOOL), "{", json.dumps(TOOL), None]
    tools, integers = ["t", "t", "t", "t", "t", "u", None], [True] * 7
    got = schemas._compile.func(*map(pa.array, (docs, tools, integers)))
    want = [one(*x) for x in zip(docs, tools, integers, strict=True)]
    assert [x["problem"] for x in got.to_pylist()] == [x["problem"] for x in want]
    assert [x["nodes"] and [k for k, _ in x["nodes"]] for x in got.to_pylist()] == [x["nodes"] and [k for k, _ in x["nodes"]] for x in want]
    assert len(seen) == 5
    assert schemas._compile.func(*(pa.array([], t) for t in (pa.string(), pa.string(), pa.bool_()))).to_pylist() == []
