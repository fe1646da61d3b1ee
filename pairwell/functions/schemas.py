"""JSON Schema documents, fixed or in a column, as tables of nodes that leaves are looked up in.

A document compiles to one node for each place that it describes; the place is a leaf's shape (keys, and * for
positions), so the nodes are the states of a walk down the document and every leaf finds its own by one lookup. All
checks of a leaf are native expressions over it and its node. Errors are ordered as paths are, positions as
numbers, and at one path as the document lists its keywords; the first one is reported. Keywords that are not checked are
refused when the document is compiled.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import numbers
from pairwell.functions.contracts import CANONICAL_SEARCH
from pairwell.functions.jsontext import kind_and_text, pointer

KINDS = {"string": ["string"], "integer": ["integer", "integral"], "number": ["integer", "integral", "number"], "boolean": ["boolean"], "object": ["object"], "array": ["array"], "null": ["null"]}
#: Keywords that say nothing about a value.
_SILENT = {"title", "description", "$schema", "default", "examples"}
_BOUNDS = {"minimum": "low", "maximum": "high", "exclusiveMinimum": "above", "exclusiveMaximum": "below", "multipleOf": "step"}
_COUNTS = {"minLength": "min_length", "maxLength": "max_length", "minItems": "min_items", "maxItems": "max_items", "minProperties": "min_keys", "maxProperties": "max_keys"}
_CHECKED = {"type", "properties", "required", "additionalProperties", "items", "pattern", "enum", "const", *_BOUNDS, *_COUNTS}
# The constraints of an integer that no pattern of its string form carries, and the types of tool schemas.
INTEGER_CONSTRAINTS = ("const", "enum", "exclusiveMaximum", "exclusiveMinimum", "maximum", "minimum", "multipleOf")
TOOL_TYPES = {"string": "string", "integer": "integer", "float": "number", "boolean": "boolean", "array": "array", "dict": "object"}

NODE = T.StructType(
    [
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("keywords", "keys", "required", "options")),
        T.StructField("closed", T.BooleanType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("constant", T.StringType()),
        *(T.StructField(n, T.DoubleType()) for n in _BOUNDS.values()),
        *(T.StructField(n, T.IntegerType()) for n in _COUNTS.values()),
    ]
)
NODES = T.MapType(T.StringType(), NODE)
COMPILED = T.StructType([T.StructField("problem", T.StringType()), T.StructField("nodes", NODES)])


class UnsupportedSchema(ValueError):
    """A schema that cannot be taken over without guessing."""


def _scalar(value: Any) -> str:
    kind, text = kind_and_text(value)
    if kind in ("object", "array"):
        raise UnsupportedSchema("options that are objects or arrays")
    return f"number:{numbers.number_key_of(text or '')}" if kind in KINDS["number"] else f"{kind}:{text}"


def nodes_of(schema: dict, shape: str = "") -> dict[str, dict]:
    """The nodes of a schema document by shape."""
    if not isinstance(schema, dict):
        raise UnsupportedSchema(f"{shape or '/'}: no object")
    unknown = sorted(set(schema) - _CHECKED - _SILENT)
    if unknown:
        raise UnsupportedSchema(f"{shape or '/'}: keywords that are not checked: {unknown}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise UnsupportedSchema(f"{shape or '/'}: additionalProperties that is a schema")
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else list(types)
    inner = schema.get("properties", {})
    node = {
        "types": types,
        "kinds": [k for t in types for k in KINDS[t]],
        "keywords": [k for k in schema if k in _CHECKED],
        "keys": [pointer(k) for k in inner],
        "required": [pointer(k) for k in schema.get("required", [])],
        "options": [_scalar(x) for x in schema["enum"]] if "enum" in schema else None,
        "closed": schema.get("additionalProperties") is False,
        "pattern": schema.get("pattern"),
        "constant": _scalar(schema["const"]) if "const" in schema else None,
        **{n: None if k not in schema else float(schema[k]) for k, n in _BOUNDS.items()},
        **{n: schema.get(k) for k, n in _COUNTS.items()},
    }
    out = {shape: node}
    for key, part in inner.items():
        out |= nodes_of(part, f"{shape}/{pointer(key)}")
    if "items" in schema:
        out |= nodes_of(schema["items"], f"{shape}/*")
    return out


def fixed(schema: dict) -> Column:
    """The nodes of one document as a constant."""
    made = nodes_of(schema)

    def lit(value: Any, kind: T.DataType) -> Column:
        if isinstance(value, list):
            return (F.array(*map(F.lit, value)) if value else F.array()).cast(kind)
        return F.lit(value).cast(kind)

    rows = [F.struct(*[lit(n[f.name], f.dataType).alias(f.name) for f in NODE]) for n in made.values()]
    return F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*rows))


def strict_schema(doc: Any) -> dict:
    """A tool's own schema as a JSON Schema document: objects closed, only the types of TOOL_TYPES, nothing guessed."""
    if not isinstance(doc, dict) or doc.get("type") not in TOOL_TYPES:
        raise UnsupportedSchema(f"unsupported type: {doc.get('type') if isinstance(doc, dict) else doc!r}")
    kind = TOOL_TYPES[doc["type"]]
    out = {"type": kind} | {k: doc[k] for k in ("description", "enum", "minimum", "maximum") if k in doc}
    if kind == "array":
        if not isinstance(doc.get("items"), dict):
            raise UnsupportedSchema("array without items")
        out["items"] = strict_schema(doc["items"])
    elif kind == "object":
        parts, needed = doc.get("properties"), doc.get("required", [])
        if not isinstance(parts, dict) or not all(isinstance(p, dict) for p in parts.values()):
            raise UnsupportedSchema("object without properties")
        if not isinstance(needed, list) or not set(map(str, needed)) <= set(parts):
            raise UnsupportedSchema("required keys that are no properties")
        out |= {"properties": {k: strict_schema(p) for k, p in parts.items()}, "required": list(needed), "additionalProperties": False}
    return out


def integers_as_strings(schema: dict) -> dict:
    """The document with every integer as a canonical string; refuses the constraints that a string would lose."""
    kind = schema.get("type")
    if kind == "integer":
        lost = [k for k in INTEGER_CONSTRAINTS if k in schema]
        if lost:
            raise UnsupportedSchema(f"an integer's string form loses {lost}")
        return {"type": "string", "pattern": CANONICAL_SEARCH} | {k: schema[k] for k in ("title", "description") if isinstance(schema.get(k), str)}
    out = dict(schema)
    if "items" in schema:
        out["items"] = integers_as_strings(schema["items"])
    if "properties" in schema:
        out["properties"] = {k: integers_as_strings(p) for k, p in schema["properties"].items()}
    return out


def call_schema(name: str, arguments: dict, integers: bool = True) -> dict:
    """The document of a call of one tool: its name, and its arguments with integers as such or as strings."""
    inner = arguments if integers else integers_as_strings(arguments)
    return {"type": "object", "properties": {"name": {"type": "string", "const": name}, "arguments": inner}, "required": ["name", "arguments"], "additionalProperties": False}


def answer_schema(representation: str, order: tuple[str, ...] = ("reasoning", "answer")) -> dict:
    """The two-field answer object as a document; its canonical and broad forms are signed_string and string."""
    answer = {"integer": {"type": "integer"}, "signed_string": {"type": "string", "pattern": CANONICAL_SEARCH}, "string": {"type": "string"}}[representation]
    fields = {"reasoning": {"type": "string", "maxLength": 256}, "answer": answer}
    return {"type": "object", "properties": {k: fields[k] for k in order}, "required": list(order), "additionalProperties": False}


def _compiled(text: str | None, tool: str | None, integers: bool | None) -> dict:
    try:
        doc = json.loads(text or "null")
        doc = doc if tool is None else call_schema(tool, strict_schema(doc), bool(integers))
        return {"problem": None, "nodes": list(nodes_of(doc).items())}
    except RecursionError:
        return {"problem": "nested too deep", "nodes": None}
    except (ValueError, TypeError, KeyError) as e:
        return {"problem": str(e)[:200], "nodes": None}


@F.arrow_udf(COMPILED)
def _compile(texts: pa.Array, tools: pa.Array, integers: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    asked = list(zip(texts.to_pylist(), tools.to_pylist(), integers.to_pylist(), strict=True))
    place = {x: i for i, x in enumerate(dict.fromkeys(asked))}
    made = pa.array([_compiled(*x) for x in place], to_arrow_type(COMPILED))
    return made.take(pa.array([place[x] for x in asked], pa.int64()))


def compiled(text: Column, tool: Column | None = None, integers: bool = True) -> Column:
    """problem and nodes of a document's text; with tool, of the call of a tool (its name) whose own schema the text is.

    An Arrow batch compiles each of its documents once, so rows of few documents need no join with them.
    """
    return _compile(text, F.lit(None).cast("string") if tool is None else tool, F.lit(integers))


def with_nodes(rows: DataFrame, text: str, tool: str | None = None, integers: bool = True) -> DataFrame:
    """rows with problem and nodes of the document in a column; each distinct document is compiled once."""
    keys = [text, *([tool] if tool else [])]
    made = rows.select(*keys).distinct()
    made = made.select(*(F.col(k).alias(f"__{k}") for k in keys), compiled(F.col(text), F.col(tool) if tool else None, integers).alias("__c"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(made, match).select(*rows.columns, F.col("__c.problem").alias("problem"), F.col("__c.nodes").alias("nodes"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once however often it is used: expressions inside lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shown(leaf: Column) -> Column:
    text, kind = leaf["text"], leaf["kind"]
    return F.when(kind == "string", F.concat(F.lit("'"), text, F.lit("'"))).when(kind == "boolean", F.initcap(text)).when(kind == "null", "None").when(kind == "object", "{...}").when(kind == "array", "[...]").otherwise(text)


def _inner_keys(leaves: Column, path: Column) -> Column:
    """The keys of the object at a path."""
    below = F.concat(path, F.lit("/"))
    inside = F.filter(leaves, lambda x: x["path"].startswith(below) & ~F.substr(x["path"], F.char_length(below) + 1).contains("/"))
    return F.transform(inside, lambda x: F.substr(x["path"], F.char_length(below) + 1))


def path_order(leaf: Column) -> Column:
    """What a leaf's path sorts by: its parts, keys as text and positions as numbers."""
    parts = F.arrays_zip(F.split(leaf["path"], "/").alias("p"), F.split(leaf["shape"], "/").alias("s"))
    key = lambda t: F.replace(F.replace(F.when(t == "~2", "*").otherwise(t), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    one = lambda x: F.struct(F.when(x["s"] == "*", x["p"].try_cast("long")).otherwise(-1).alias("n"), F.when(x["s"] == "*", "").otherwise(key(x["p"])).alias("t"))
    return F.when(leaf["path"] == "", F.array().cast("array<struct<n: long, t: string>>")).otherwise(F.slice(F.transform(parts, one), 2, 1 << 30))


def _leaf_error(leaf: Column, node: Column, leaves: Column, then: Callable[[Column], Column] = lambda error: error) -> Column:
    """then() of the first keyword of its node that a leaf fails (rank, keyword and message, null if it fails none); null without a node."""
    keys = F.when(leaf["kind"] == "object", _inner_keys(leaves, leaf["path"]))
    odd = lambda n: _bound(keys, lambda k: F.struct(F.array_except(n["required"], k).alias("missing"), F.array_except(k, n["keys"]).alias("extra")))
    return _bound(node, lambda n: F.when(n.isNotNull(), _bound(odd(n), lambda o: _bound(_failed(leaf, n, o["missing"], o["extra"]), then))))


def _failed(leaf: Column, node: Column, missing: Column, extra: Column) -> Column:
    """The first of the node's keywords, in the document's order, that a leaf fails."""
    kind, text = leaf["kind"], leaf["text"]
    number, string = kind.isin(*KINDS["number"]), kind == "string"
    value, count = text.try_cast("double"), text.try_cast("int")
    plain = F.when(number, F.concat(F.lit("number:"), numbers.number_key(text))).otherwise(F.concat_ws(":", kind, F.coalesce(text, F.lit("None"))))
    shown = _shown(leaf)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    quoted = lambda names: F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")
    length = F.char_length(text)
    is_array, is_object = kind == "array", kind == "object"
    checks = {
        "type": ((F.size(node["types"]) > 0) & ~F.array_contains(node["kinds"], kind), say(shown, " is not of type ", quoted(node["types"]))),
        "required": (is_object & (F.size(missing) > 0), say("'", F.get(missing, F.lit(0)), "' is a required property")),
        "additionalProperties": (is_object & node["closed"] & (F.size(extra) > 0), say("Additional properties are not allowed (", quoted(extra), F.when(F.size(extra) == 1, " was").otherwise(" were"), " unexpected)")),
        "pattern": (string & ~F.regexp_like(text, node["pattern"]), say(shown, " does not match '", node["pattern"], "'")),
        "enum": (node["options"].isNotNull() & ~F.coalesce(F.array_contains(node["options"], plain), F.lit(False)), say(shown, " is not one of the options")),
        "const": (node["constant"].isNotNull() & ~plain.eqNullSafe(node["constant"]), say(F.substring_index(node["constant"], ":", -1), " was expected")),
        "minimum": (number & (value < node["low"]), say(shown, " is less than the minimum")),
        "maximum": (number & (value > node["high"]), say(shown, " is greater than the maximum")),
        "exclusiveMinimum": (number & (value <= node["above"]), say(shown, " is less than or equal to the minimum")),
        "exclusiveMaximum": (number & (value >= node["below"]), say(shown, " is greater than or equal to the maximum")),
        "multipleOf": (number & (F.abs(value / node["step"] - F.rint(value / node["step"])) > 1e-9), say(shown, " is not a multiple of the step")),
        "minLength": (string & (length < node["min_length"]), say(shown, " is too short")),
        "maxLength": (string & (length > node["max_length"]), say(shown, " is too long")),
        "minItems": (is_array & (count < node["min_items"]), say(shown, " is too short")),
        "maxItems": (is_array & (count > node["max_items"]), say(shown, " is too long")),
        "minProperties": (is_object & (count < node["min_keys"]), say(shown, " does not have enough properties")),
        "maxProperties": (is_object & (count > node["max_keys"]), say(shown, " has too many properties")),
    }

    def tried(keyword: Column, at: Column) -> Column:
        """The failure of one of the node's keywords; others are not computed."""
        out = F.when(F.lit(False), None)
        for name, (bad, message) in checks.items():
            out = out.when(keyword == name, F.when(F.coalesce(bad, F.lit(False)), F.struct(at.alias("rank"), F.lit(name).alias("keyword"), message.alias("message"))))
        return out

    return F.get(F.filter(F.transform(node["keywords"], tried), lambda error: error.isNotNull()), F.lit(0))


def first_error(leaves: Column, nodes: Column) -> Column:
    """path, keyword and message of the first error of an object's leaves by its nodes; null if it has none or there is nothing to check.

    Limits compare as doubles, options and constants by exact value. Values that are objects or arrays are not spelled out in messages. A position
    is a number in a path's order.
    """

    def judged(leaf: Column) -> Column:
        placed = lambda error: F.when(error.isNotNull(), F.struct(path_order(leaf).alias("order"), error["rank"].alias("rank"), leaf["path"].alias("path"), error["keyword"].alias("keyword"), error["message"].alias("message")))
        return _leaf_error(leaf, F.try_element_at(nodes, leaf["shape"]), leaves, placed)

    return F.array_min(F.transform(leaves, judged))


def options_by_key(leaves: Column, at: Column, nodes: Column, scope: str = "/arguments") -> Column:
    """Of an object whose values are lists of options: each option's key (as it stands in paths), place and leaves' verdict by the key's node below scope.

    One entry a leaf inside a list, in the order of the leaves; values that are no lists give none.
    """
    depth = F.size(F.split(at, "/"))
    inside = F.filter(leaves, lambda x: x["path"].startswith(F.concat(at, F.lit("/"))) & (F.get(F.split(x["shape"], "/"), depth + 1) == "*"))

    def judged(leaf: Column) -> Column:
        path, shape = (F.slice(F.split(leaf[n], "/"), depth + 1, F.lit(1 << 30)) for n in ("path", "shape"))
        node = F.array_join(F.concat(F.array(F.lit(scope), F.get(shape, F.lit(0))), F.slice(shape, 3, 1 << 30)), "/")
        wrong = F.coalesce(_leaf_error(leaf, F.try_element_at(nodes, node), leaves, Column.isNotNull), F.lit(False))
        return F.struct(F.get(path, F.lit(0)).alias("key"), F.array_join(F.slice(path, 1, 2), "/").alias("option"), (F.size(path) == 2).alias("root"), leaf["kind"].alias("kind"), leaf["text"].alias("text"), wrong.alias("wrong"))

    return F.transform(inside, judged)


def accepted_keys(options: Column) -> Column:
    """The keys that have at least one valid option, from options_by_key()."""
    wrong = F.transform(F.filter(options, lambda x: x["wrong"]), lambda x: x["option"])
    right = F.filter(options, lambda x: x["root"] & ~F.array_contains(wrong, x["option"]))
    return F.array_distinct(F.transform(right, lambda x: x["key"]))


def inner_keys(leaves: Column, path: Column) -> Column:
    """The keys of the object at a path, as they stand in paths."""
    return _inner_keys(leaves, path)
