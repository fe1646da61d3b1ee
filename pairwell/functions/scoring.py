"""Layered scores of responses and tool calls, as Column builders over what was read from them."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import contracts, jsontext, numbers
from pairwell.plans.transforms import IntegerString, Plan


def predicted_answer(leaves: Column, floats: bool = False) -> Column:
    """The numeric answer of an object: integers as they are, of strings the last number; with floats, those too."""
    kind, text = contracts.kind_at(leaves, "/answer"), contracts.text_at(leaves, "/answer")
    taken = F.when(kind == "integer", text).when(kind == "string", numbers.last_number(text))
    return taken.when(kind.isin("integral", "number"), numbers.last_number(text)) if floats else taken


def baseline_score(read: Column, order: tuple[str, str]) -> Column:
    """The historic score: the contract is checked on whatever object was recovered, floats count as answers."""
    leaves = read["leaves"]
    answer = predicted_answer(leaves, floats=True)
    text = F.when(contracts.kind_at(leaves, "/answer") == "string", contracts.text_at(leaves, "/answer"))
    return F.struct(
        read["whole"].alias("whole"),
        read["recovered"].alias("recovered"),
        contracts.conforms(leaves, contracts.baseline_contract(order)).alias("schema_valid"),
        F.coalesce(contracts.key_order(leaves) == F.array(*map(F.lit, order)), F.lit(False)).alias("order_matches"),
        answer.alias("predicted"),
        numbers.strict_number(text).isNotNull().alias("strict_numeric"),
    )


def scored_row(text: Column, read: Column, gold: Column, free: Column, order: tuple[str, str]) -> dict[str, Column]:
    """The flags of a run row: free text by its marker and last number, JSON by the historic score.

    Flags that do not apply are null: the JSON layers and the strict answer of free text, the marker of JSON.
    """
    said, score = numbers.free_answer(text), baseline_score(read, order)
    right = numbers.canonical_number(gold)
    predicted = F.when(free, said["answer"]).otherwise(score["predicted"])
    strict = F.when(score["strict_numeric"], contracts.text_at(read["leaves"], "/answer"))
    layers = {name: F.when(~free, score[name]) for name in ("strict_numeric", "whole", "recovered", "schema_valid", "order_matches")}
    return {
        "correct": F.coalesce(numbers.canonical_number(predicted) == right, F.lit(False)),
        "strict": F.when(~free, F.coalesce(numbers.canonical_number(strict) == right, F.lit(False))),
        **layers,
        "marker_at_end": F.when(free, F.coalesce(said["marker_at_end"], F.lit(False))),
    }


def layered_score(rows: DataFrame, read: str, gold: str, order: tuple[str, str], representation: str) -> DataFrame:
    """rows with s, the layers of a response: whole object, internal contract, semantics, external contract, and both.

    Only a whole object can satisfy a contract; the answer may also come from a recovered one. The external
    answer is a canonical integer string; an internal integer is turned into one.
    """
    r = F.col(read)
    whole = F.when(r["whole"], r["leaves"])
    external = tuple(contracts.answer_contract("signed_string", order))
    plan = Plan(external, (IntegerString("/answer"),) if representation == "integer" else ())
    keep = rows.columns
    out = plan.run(rows, whole).withColumns({"__internal": contracts.conforms(whole, contracts.answer_contract(representation, order)), "__answer": numbers.canonical_number(predicted_answer(r["leaves"])), "__gold": numbers.canonical_number(F.col(gold))})
    semantic = F.coalesce(F.col("__answer") == F.col("__gold"), F.lit(False))
    valid = F.col("__internal") & F.col("code").isNull()
    score = F.struct(
        r["whole"].alias("whole"),
        r["recovered"].alias("recovered"),
        F.col("__internal").alias("internal_valid"),
        F.coalesce(contracts.key_order(whole) == F.array(*map(F.lit, order)), F.lit(False)).alias("order_matches"),
        F.col("__answer").alias("predicted"),
        semantic.alias("semantic_correct"),
        valid.alias("external_valid"),
        (semantic & valid).alias("contract_valid_correct"),
    )
    return out.select(*keep, score.alias("s"))


def tool_contract(name: str, arguments: list[contracts.Field]) -> list[contracts.Field]:
    """A call of one tool: its name, and an object of exactly these arguments (paths below /arguments)."""
    return [contracts.Field("/name", "string", const=name), contracts.Field("/arguments", "object"), *arguments]


def equal_values(kind: Column, text: Column, other_kind: Column, other_text: Column) -> Column:
    """Equality of two scalars: numbers by exact value whatever their spelling, all else by kind and text."""
    number = ["integer", "integral", "number"]
    both = kind.isin(*number) & other_kind.isin(*number)
    return F.coalesce(F.when(both, numbers.same_number(text, other_text)).otherwise((kind == other_kind) & text.eqNullSafe(other_text)), F.lit(False))


#: Arguments and the values that count as right for each: texts of scalars as columns, or JSON values.
Accepted = dict[str, list[Column | Any]]


def _plain(kind: Column, text: Column) -> tuple[Column, Column]:
    """Kind and text under which equal values agree: numbers by exact value, NaN and infinity equal to nothing."""
    number = kind.isin("integer", "integral", "number")
    return F.when(number, "number").otherwise(kind), F.when(number, F.coalesce(numbers.number_key(text), F.lit("not finite"))).otherwise(text)


def _parts(value: Any, path: str = "") -> list[tuple[str, str, str | None]]:
    """Paths, kinds and texts of a JSON value, as _plain() has them."""
    kind, text = jsontext.kind_and_text(value)
    if kind in ("integer", "integral", "number"):
        kind, text = "number", numbers.number_key_of(text) or "not finite, and so equal to nothing"
    inner = [(jsontext.pointer(k), v) for k, v in value.items()] if kind == "object" else list(enumerate(value)) if kind == "array" else []
    return [(path, kind, text), *(x for k, v in inner for x in _parts(v, f"{path}/{k}"))]


def matches(leaves: Column, path: str, option: Column | Any) -> Column:
    """Whether the value at a path equals an option: lists and objects in all their parts, objects in any order."""
    inside = F.filter(leaves, lambda x: (x["path"] == path) | x["path"].startswith(path + "/"))
    if isinstance(option, Column):
        only = F.when(F.size(inside) == 1, F.get(inside, F.lit(0)))
        number = only["kind"].isin("integer", "integral", "number")
        return F.coalesce(F.when(number, numbers.same_number(only["text"], option)).otherwise(only["text"] == option), F.lit(False))
    shown = lambda p, k, t: F.to_json(F.array(p, k, F.coalesce(t, F.lit("null"))))
    have = F.transform(inside, lambda x: shown(F.substr(x["path"], F.lit(len(path) + 1)), *_plain(x["kind"], x["text"])))
    want = [json.dumps([p, k, "null" if t is None else t], ensure_ascii=False, separators=(",", ":")) for p, k, t in _parts(option)]
    return F.array_sort(have) == F.array_sort(F.array(*map(F.lit, want)))


def arguments_right(leaves: Column, accepted: Accepted) -> Column:
    """Whether every argument given is one with options, and its value one of them."""
    known = [jsontext.pointer(k) for k in accepted]
    right = F.size(F.array_except(contracts.key_order(leaves, "/arguments"), F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))) == 0
    for key, options in accepted.items():
        path = f"/arguments/{jsontext.pointer(key)}"
        right = right & (contracts.kind_at(leaves, path).isNull() | reduce(Column.__or__, [matches(leaves, path, o) for o in options], F.lit(False)))
    return F.coalesce(right, F.lit(False))


def executed(rows: DataFrame, read: str, name: str, arguments: list[contracts.Field]) -> DataFrame:
    """rows with internal and valid (the call satisfies the internal contract; and the external one, once turned back)
    and call, the leaves of a valid call with its integers decoded."""
    whole = F.when(F.col(read)["whole"], F.col(read)["leaves"])
    external = tool_contract(name, contracts.integers_as_strings(arguments))
    whole_numbers = [f.path for f in arguments if f.type == "integer"]
    out = Plan(tuple(external), tuple(IntegerString(p) for p in whole_numbers)).run(rows, whole).withColumn("internal", contracts.conforms(whole, tool_contract(name, arguments)))
    decoded = F.transform("external", lambda x: F.when(x["shape"].isin(*whole_numbers) & (x["kind"] == "string"), x.withField("kind", F.lit("integer"))).otherwise(x)) if whole_numbers else F.col("external")
    return out.withColumn("valid", F.col("internal") & F.col("code").isNull()).withColumn("call", F.when(F.col("valid"), decoded))


def tool_score(rows: DataFrame, read: str, name: str, arguments: list[contracts.Field], accepted: Accepted) -> DataFrame:
    """rows with s: whether a call selects the tool, satisfies the internal and external contracts, gives accepted
    values and no argument without any, is executed, leaves the right state, and succeeds.

    error is the first layer that fails, as a code; null for a success. A call that satisfies the external contract is executed; its
    state is right if its arguments are, as the state holds the call itself.
    """
    keep = rows.columns
    whole = F.when(F.col(read)["whole"], F.col(read)["leaves"])
    out = executed(rows, read, name, arguments)
    out = out.withColumns({"right": F.col("valid") & arguments_right(F.col("call"), accepted), "selected": F.coalesce(contracts.text_at(whole, "/name") == name, F.lit(False))})
    score = F.struct(
        F.col(read)["whole"].alias("whole"),
        F.col("selected"),
        F.col("internal").alias("internal_valid"),
        F.col("valid").alias("external_valid"),
        F.coalesce("right", F.lit(False)).alias("arguments_correct"),
        F.col("valid").alias("executed"),
        F.coalesce("right", F.lit(False)).alias("post_state_correct"),
        (F.col("selected") & F.coalesce("right", F.lit(False))).alias("success"),
        F.when(~F.col(read)["whole"], F.coalesce(F.col(read)["error"], F.lit("no_object"))).when(~F.col("selected"), "other_tool").when(~F.col("valid"), F.coalesce("code", F.lit("internal_invalid"))).when(~F.coalesce("right", F.lit(False)), "wrong_arguments").alias("error"),
    )
    return out.select(*keep, score.alias("s"))


def receipts(rows: DataFrame, read: str, name: str, arguments: list[contracts.Field]) -> DataFrame:
    """The rows whose call can be executed, with receipt: the digest of the state after it."""
    return executed(rows, read, name, arguments).select(*rows.columns, jsontext.state_digest("call").alias("receipt")).filter("receipt is not null")
