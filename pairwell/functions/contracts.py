"""Contracts on leaves: which paths an object may and must have, and what each may hold.

A contract is a list of fields; checks compile to one native boolean expression, once per query. Array
positions are written * in a field's path, keys as jsontext.pointer() does.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwell.functions.numbers import CANONICAL_INTEGER, STRICT_NUMBER

# Fixed value: how a canonical integer is spelled as a string; searched for, so a final newline passes.
CANONICAL_SEARCH = r"^-?(?:0|[1-9][0-9]*)$"

#: Kinds that satisfy a declared type. A float without fraction counts as an integer.
_KINDS = {
    "string": ["string"],
    "integer": ["integer", "integral"],
    "number": ["integer", "integral", "number"],
    "boolean": ["boolean"],
    "object": ["object"],
    "array": ["array"],
    "null": ["null"],
}


@dataclass(frozen=True)
class Field:
    path: str
    type: str
    required: bool = True
    pattern: str | None = None
    const: str | None = None
    enum: tuple[str, ...] = ()
    max_length: int | None = None
    minimum: float | None = None
    maximum: float | None = None


def text_at(leaves: Column, path: str) -> Column:
    """The text of the leaf at a path, null without one."""
    return F.try_element_at(F.filter(leaves, lambda x: x["path"] == path), F.lit(1))["text"]


def kind_at(leaves: Column, path: str) -> Column:
    return F.try_element_at(F.filter(leaves, lambda x: x["path"] == path), F.lit(1))["kind"]


def key_order(leaves: Column, scope: str = "") -> Column:
    """The keys of the object at a path, in their order, as they stand in paths."""
    inside = F.filter(leaves, lambda x: x["path"].startswith(scope + "/") & ~F.substr(x["path"], F.lit(len(scope) + 2)).contains("/"))
    return F.transform(inside, lambda x: F.substr(x["path"], F.lit(len(scope) + 2)))


def _holds(leaf: Column, field: Field) -> Column:
    text = leaf["text"]
    out = leaf["kind"].isin(_KINDS[field.type])
    if field.pattern is not None:
        out &= text.rlike(field.pattern)
    if field.const is not None:
        out &= text == field.const
    if field.enum:
        out &= text.isin(*field.enum)
    if field.max_length is not None:
        out &= F.char_length(text) <= field.max_length
    if field.minimum is not None:
        out &= text.try_cast("double") >= field.minimum
    if field.maximum is not None:
        out &= text.try_cast("double") <= field.maximum
    return out


def conforms(leaves: Column, contract: list[Field]) -> Column:
    """Whether an object has every required field, no undeclared one, and fitting values; null leaves do not."""

    def fits(leaf: Column) -> Column:
        out = F.when(leaf["path"] == "", leaf["kind"] == "object")
        for field in contract:
            out = out.when(leaf["shape"] == field.path, F.coalesce(_holds(leaf, field), F.lit(False)))
        return out.otherwise(False)

    present = F.transform(leaves, lambda x: x["path"])
    needed = [f.path for f in contract if f.required and "*" not in f.path]
    has_all = F.size(F.array_except(F.array(*map(F.lit, needed)), present)) == 0 if needed else F.lit(True)
    return F.coalesce(has_all & F.forall(leaves, fits), F.lit(False))


def answer_contract(representation: str, order: tuple[str, str] = ("reasoning", "answer")) -> list[Field]:
    """The two-field answer object: an integer answer, a canonical integer string, or any string."""
    answer = {
        "integer": Field("/answer", "integer"),
        "signed_string": Field("/answer", "string", pattern=CANONICAL_SEARCH),
        "string": Field("/answer", "string"),
    }[representation]
    fields = {"reasoning": Field("/reasoning", "string", max_length=256), "answer": answer}
    return [fields[name] for name in order]


def baseline_contract(order: tuple[str, str] = ("reasoning", "answer")) -> list[Field]:
    """The historic two-field object: any reasoning, and an answer that is a number in a string."""
    fields = {"reasoning": Field("/reasoning", "string"), "answer": Field("/answer", "string", pattern=STRICT_NUMBER)}
    return [fields[name] for name in order]


def integers_as_strings(contract: list[Field]) -> list[Field]:
    """The contract with every integer as a canonical string; refuses limits that a string cannot carry."""
    for f in contract:
        if f.type == "integer" and (f.const is not None or f.enum or f.minimum is not None or f.maximum is not None):
            raise ValueError(f"{f.path}: limits on an integer have no exact string form")
    return [replace(f, type="string", pattern=CANONICAL_SEARCH) if f.type == "integer" else f for f in contract]


def is_canonical_integer(text: Column) -> Column:
    return text.rlike(CANONICAL_INTEGER)
