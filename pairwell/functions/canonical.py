"""Canonical JSON: one text for equal values, in the three byte forms that digests are taken of."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spelled(text: str, escaped: bool = True, newline: bool = False) -> str | None:
    """The canonical form of a JSON text: keys sorted at all depths, no blanks, of a repeated key the last value; null if it is no JSON."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    out = json.dumps(value, ensure_ascii=escaped, sort_keys=True, separators=(",", ":"))
    return (out if escaped else out.encode("utf-8", "replace").decode()) + "\n" * newline


def _form(escaped: bool, newline: bool):
    @F.arrow_udf(T.StringType())
    def form(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else spelled(t, escaped, newline) for t in texts.to_pylist()], pa.string())

    return form


_FORMS = {(e, n): _form(e, n) for e in (True, False) for n in (True, False)}


def canonical_json(text: Column | str, escaped: bool = True, newline: bool = False) -> Column:
    """A JSON text in canonical form, floats in their shortest spelling; escaped writes characters beyond ASCII as escapes."""
    return _FORMS[escaped, newline](text)


def digest(text: Column | str, escaped: bool = True, newline: bool = False) -> Column:
    """SHA-256 of the canonical form, in hexadecimal; null for what is no JSON."""
    return F.sha2(canonical_json(text, escaped, newline).cast("binary"), 256)


def _member(key: str):
    @F.arrow_udf(T.StringType())
    def member(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for text in texts.to_pylist():
            try:
                value = None if text is None else json.loads(text)
            except (ValueError, RecursionError):
                value = None
            found = isinstance(value, dict) and key in value
            out.append(json.dumps(value[key], sort_keys=True, separators=(",", ":")) if found else None)
        return pa.array(out, pa.string())

    return member


def member_digest(text: Column | str, key: str) -> Column:
    """digest() of one member of a JSON object; null where there is none."""
    return F.sha2(_member(key)(text).cast("binary"), 256)
