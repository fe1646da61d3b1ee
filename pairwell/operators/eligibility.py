"""Which tool items can be evaluated: a cascade of thirteen reasons over an item's question and answer documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import jsontext, schemas
from pairwell.operators.catalogue import first_reason

#: The reasons in the order in which they are tried. Fixed values.
REASONS = (
    "not_single_turn_user_request",
    "not_single_function",
    "invalid_function_definition",
    "parameters_not_object_like",
    "invalid_parameter_schema",
    "no_required_integer",
    "unsupported_schema",
    "bounded_integer_not_supported",
    "ambiguous_ground_truth_call",
    "ground_truth_has_unknown_argument",
    "required_argument_has_no_typed_reference",
    "ground_truth_options_not_lists",
    "required_reference_type_mismatch",
)
_PARAMETERS = "/function/0/parameters"


def _is(leaves: Column, path: Column | str, kind: str, text: str | None = None) -> Column:
    """Whether there is a value of a kind at a path; text is a string's text or the size of a list or object."""
    leaf = jsontext.leaf_at(leaves, path)
    found = leaf["kind"] == kind
    return F.coalesce(found if text is None else found & (leaf["text"] == text), F.lit(False))


def _any(values: Column, check) -> Column:
    return F.coalesce(F.exists(values, check), F.lit(False))


def judged_items(rows: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """rows with reason (null for items that can be evaluated) and, for those, user_request, function_name, required_integers and
    negative_references (field and value as text).

    question and answer are JSON texts. Each is read once; each distinct parameter schema is compiled once an Arrow batch, so no row moves to find
    its schema. A null text, or one that is no object, lacks all that is asked of it, so a bad question is the first reason and a bad answer the
    ninth. Of a repeated key the last value counts, but inside the parameters, which are compiled with the first. The last reason can only hold
    where the eleventh does, which comes before it.
    Columns of rows with a result's name stay in the struct row: the result has row and the columns named here.
    """
    of = schemas.compiled(F.get_json_object(question, "$.function[0].parameters"), F.get_json_object(question, "$.function[0].name"))
    texts = rows.select(F.struct("*").alias("row"), jsontext.read_call(question).alias("qr"), jsontext.read_call(answer).alias("ar"), of.alias("of"))
    read = texts.select("row", "of.problem", "of.nodes", F.when(F.col("qr.whole"), F.col("qr.leaves")).alias("q"), F.when(F.col("ar.whole"), F.col("ar.leaves")).alias("a"))
    q, a = F.col("q"), F.col("a")
    name = jsontext.leaf_at(q, "/function/0/name")["text"]
    needed = F.filter(q, lambda x: (x["shape"] == "/function/*/parameters/required/*") & x["path"].startswith(_PARAMETERS) & (x["kind"] == "string"))
    at = read.select("*", name.alias("name"), F.concat(F.lit("/ground_truth/0/"), jsontext.part_of(name)).alias("call"), F.coalesce(F.transform(needed, lambda x: jsontext.part_of(x["text"])), F.array().cast("array<string>")).alias("required"))
    whole = at.select("*", schemas.options_by_key(a, F.col("call"), F.col("nodes")).alias("options"))
    kind_of = lambda part: F.concat(F.lit(f"{_PARAMETERS}/properties/"), part, F.lit("/type"))
    integers = F.filter("required", lambda part: _is(q, kind_of(part), "string", "integer"))
    known = whole.select("*", schemas.accepted_keys(F.col("options")).alias("accepted"), integers.alias("integers"))
    judged = known.withColumn("reason", _reason())
    wanted = F.filter("options", lambda x: x["root"] & (x["kind"] == "integer") & x["text"].startswith("-") & F.array_contains("integers", x["key"]))
    refs = F.transform(wanted, lambda x: F.struct(jsontext.named(x["key"]).alias("field"), x["text"].alias("value")))
    fits = F.col("reason").isNull()
    return judged.select(
        "row",
        "reason",
        F.when(fits, jsontext.leaf_at(q, "/question/0/0/content")["text"]).alias("user_request"),
        F.when(fits, F.col("name")).alias("function_name"),
        F.when(fits, F.transform("integers", jsontext.named)).alias("required_integers"),
        F.when(fits, refs).alias("negative_references"),
    )


def _reason() -> Column:
    q, a, call, required, accepted = (F.col(n) for n in ("q", "a", "call", "required", "accepted"))
    p = _PARAMETERS
    turn = _is(q, "/question", "array", "1") & _is(q, "/question/0", "array", "1") & _is(q, "/question/0/0/role", "string", "user") & _is(q, "/question/0/0/content", "string")
    properties = schemas.inner_keys(q, F.lit(f"{p}/properties"))
    bounded = lambda part: _is(q, F.concat(F.lit(f"{p}/properties/"), part, F.lit("/type")), "string", "integer") & F.exists(
        F.array(F.lit("minimum"), F.lit("maximum")), lambda limit: jsontext.leaf_at(q, F.concat(F.lit(f"{p}/properties/"), part, F.lit("/"), limit)).isNotNull()
    )
    one_call = _is(a, "/ground_truth", "array", "1") & _is(a, "/ground_truth/0", "object", "1") & _is(a, call, "object")
    arguments = F.coalesce(schemas.inner_keys(a, call), F.array().cast("array<string>"))
    required_list = _is(q, f"{p}/required", "array") | jsontext.leaf_at(q, f"{p}/required").isNull()
    untyped = F.filter(required, lambda k: ~F.coalesce(F.array_contains(accepted, k), F.lit(False)))
    cases = [
        ~turn,
        ~_is(q, "/function", "array", "1"),
        ~(_is(q, "/function/0", "object") & _is(q, "/function/0/name", "string")),
        ~_is(q, f"{p}/type", "string", "dict"),
        ~(_is(q, f"{p}/properties", "object") & required_list),
        F.size("integers") <= 0,
        F.col("problem").isNotNull(),
        _any(properties, bounded),
        ~one_call,
        F.size(F.array_except(arguments, properties)) > 0,
        F.size(untyped) > 0,
        _any(arguments, lambda k: ~_is(a, F.concat(call, F.lit("/"), k), "array")),
        F.size(F.array_intersect(untyped, arguments)) > 0,
    ]
    return first_reason(list(zip(REASONS, cases, strict=True)))
