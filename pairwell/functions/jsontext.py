"""Strict JSON texts as arrays of leaves.

One small Arrow helper reads a response into leaves (path, shape, kind, text); every contract check, transform
and score is a native expression over that array. A leaf's path joins keys and positions with /, its shape has
* for positions; the root is the empty path. Kinds: null, boolean, integer, integral (a float without fraction), number, string, object,
array. Objects keep the order of keys; of a repeated key the last value counts. Inside a path a key's ~ is written
~0, its / is ~1, and a key that is just * is ~2.
"""

from __future__ import annotations

import hashlib
import json
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
READ = T.StructType([T.StructField("whole", T.BooleanType()), T.StructField("recovered", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("leaves", T.ArrayType(LEAF))])


def _utf8(text: str) -> str:
    """The text with lone surrogates, which JSON can spell but UTF-8 cannot, replaced."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def pointer(key: str) -> str:
    """A key as it stands in a path."""
    return "~2" if key == "*" else key.replace("~", "~0").replace("/", "~1") if "~" in key or "/" in key else key


def key_of(part: str) -> str:
    """The key that a part of a path stands for."""
    return "*" if part == "~2" else part.replace("~1", "/").replace("~0", "~")


def part_of(key: Column) -> Column:
    """pointer() of a column of keys."""
    return F.when(key == "*", "~2").otherwise(F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def named(part: Column) -> Column:
    """key_of() of a column of parts."""
    return F.when(part == "~2", "*").otherwise(F.replace(F.replace(part, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))


def leaf_at(leaves: Column, path: Column | str) -> Column:
    """The leaf at a path; null if there is none."""
    return F.get(leaves, (F.array_position(leaves["path"], path) - 1).cast("int"))


def value_of(leaves: list[dict]) -> Any:
    """The value that leaves spell, a parent before its children."""
    plain = {"null": lambda t: None, "boolean": lambda t: t == "true", "integer": int, "integral": float, "number": float, "string": str, "object": lambda t: {}, "array": lambda t: []}
    held: dict[str, Any] = {}
    for leaf in leaves:
        value = plain[leaf["kind"]](leaf["text"])
        held[leaf["path"]] = value
        if leaf["path"]:
            above, part = leaf["path"].rsplit("/", 1)
            owner = held[above]
            if isinstance(owner, list):
                owner.append(value)
            else:
                owner[key_of(part)] = value
    return held[""]


@F.arrow_udf(T.StringType())
def _state_digest(leaves: pa.Array) -> pa.Array:
    out = []
    for call in leaves.to_pylist():
        text = None if call is None else json.dumps({"call_count": 1, "last_call": value_of(call)}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        out.append(None if text is None else hashlib.sha256(text.encode()).hexdigest())
    return pa.array(out, pa.string())


# Declared non-deterministic, as the readers below: a filter on the digest must not compute it and the call again.
_STATE_DIGEST = _state_digest.asNondeterministic()


def state_digest(leaves: Column | str) -> Column:
    """The digest of the state after one call: its canonical JSON (sorted keys, no blanks), counted as the first; null for null."""
    return _STATE_DIGEST(leaves)


def kind_and_text(value: Any) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, int):
        return "integer", str(value)
    if isinstance(value, float):
        return ("integral" if value.is_integer() else "number"), repr(value)
    if isinstance(value, str):
        return "string", _utf8(value)
    return ("object", str(len(value))) if isinstance(value, dict) else ("array", str(len(value)))


class _Batch:
    """Arrays of what a batch of texts holds, leaves laid end to end."""

    def __init__(self):
        self.whole, self.recovered, self.error, self.known, self.ends = [], [], [], [], [0]
        self.path, self.shape, self.kind, self.text = [], [], [], []

    def add(self, text: str | None, strip: bool) -> None:
        value, error = None, None
        if text is None:
            error = "missing"
        else:
            try:
                value = json.loads(text.strip() if strip else text)
                error = None if isinstance(value, dict) else "not_object"
            except (ValueError, RecursionError):
                error = "invalid_json"
        self.whole.append(error is None)
        self.error.append(error)
        if error is not None:
            value = None if text is None else _recovered(text)
        self.recovered.append(value is not None)
        self.known.append(value is not None)
        if value is not None:
            self._add_leaves(value)
        self.ends.append(len(self.path))

    def _add_leaves(self, root: dict) -> None:
        todo: list[tuple[str, str, Any]] = [("", "", root)]
        while todo:
            path, shape, value = todo.pop()
            kind, text = kind_and_text(value)
            self.path.append(path)
            self.shape.append(shape)
            self.kind.append(kind)
            self.text.append(text)
            if kind == "object":
                todo += [(f"{path}/{k}", f"{shape}/{k}", v) for k, v in ((pointer(_utf8(k)), v) for k, v in reversed(value.items()))]
            elif kind == "array":
                todo += [(f"{path}/{i}", f"{shape}/*", value[i]) for i in range(len(value) - 1, -1, -1)]

    def arrow(self) -> pa.Array:
        leaf = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (self.path, self.shape, self.kind, self.text)], names=["path", "shape", "kind", "text"])
        ends = pa.array(self.ends, pa.int32(), mask=np.append(~np.array(self.known, bool), False))
        leaves = pa.ListArray.from_arrays(ends, leaf)
        return pa.StructArray.from_arrays([pa.array(self.whole, pa.bool_()), pa.array(self.recovered, pa.bool_()), pa.array(self.error, pa.string()), leaves], names=["whole", "recovered", "error", "leaves"])


def _recovered(text: str) -> dict | None:
    """The first object that decodes at any opening brace."""
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, dict):
            return value
        at = text.find("{", at + 1)
    return None


def _read(texts: pa.Array, strip: bool) -> pa.Array:
    batch = _Batch()
    for text in texts.to_pylist():
        batch.add(text, strip)
    return batch.arrow()


@F.arrow_udf(READ)
def _read_stripped(texts: pa.Array) -> pa.Array:
    return _read(texts, True)


@F.arrow_udf(READ)
def _read_exact(texts: pa.Array) -> pa.Array:
    return _read(texts, False)


# Declared non-deterministic: a filter on a score would otherwise be pushed below the reading and read every text again.
_READ_STRIPPED, _READ_EXACT = _read_stripped.asNondeterministic(), _read_exact.asNondeterministic()


def read_response(text: Column | str) -> Column:
    """Reads a response, once a row: whole (all of it is one object), recovered (some object decodes), error, leaves."""
    return _READ_STRIPPED(text)


def read_call(text: Column | str) -> Column:
    """As read_response, for tool calls."""
    return _READ_EXACT(text)
