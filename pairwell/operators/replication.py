"""Validating paired runs of several roles (datasets) against what was frozen: their items in order, configurations, manifests and environment.

Rows are read once for all checks; sequences are compared by mergeable digests, so no role's rows come together in one task.
Roles and manifests are tables of a row a role and a row a run.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import canonical, jsontext, numbers
from pairwell.functions.jsontext import kind_and_text, leaf_at
from pairwell.functions.schemas import KINDS
from pairwell.operators.manifests import comparable, value_at
from pairwell.operators.matrix import sequence_digest
from pairwell.operators.selection import numbered
from pairwell.sources.shared import cut

# The keys of a configuration in which the runs of one role may differ, and what of a manifest makes its environment.
REPRESENTATION_KEYS = ("condition", "answer_representation", "internal_schema_sha256", "transducer_version", "plan_id")
ENVIRONMENT_KEYS = ("packages", "torch", "cuda_runtime", "gpus", "python")
CONFIG = "/run_config"


def assigned(dataset: DataFrame, roles: DataFrame) -> DataFrame:
    """role, pos (from 1 without gaps) and item_id of the dataset's items (role, pos, item_id) that their role does not exclude."""
    gone = roles.select(F.col("role").alias("r"), F.explode("excluded").alias("i")).distinct()
    left = dataset.join(gone, (F.col("role") == F.col("r")) & (F.col("item_id") == F.col("i")), "left_anti")
    ordered = cut(numbered(left.select("role", "item_id", F.struct("role", "pos").alias("at")), "at"))
    first = ordered.groupBy("role").agg(F.min("index").alias("first"))
    return ordered.join(F.broadcast(first), "role").select("role", (F.col("index") - F.col("first") + 1).alias("pos"), "item_id")  # a row a role


def is_value(leaf: Column, value: Any) -> Column:
    """Whether a leaf of comparable() is a plain value: numbers by value, whatever their spelling; never null."""
    kind, text = kind_and_text(value)
    if kind in KINDS["number"]:
        kind, text = "number", numbers.number_key_of(text)
    return leaf["kind"].eqNullSafe(F.lit(kind)) & leaf["text"].eqNullSafe(F.lit(text))


def _below(leaves: Column, path: str, without: tuple[str, ...] = ()) -> Column:
    """The leaves below a path, by path, but those of some of its keys."""
    own = lambda x: F.split(x["path"], "/", 4)[path.count("/") + 1]
    return F.array_sort(F.filter(leaves, lambda x: x["path"].startswith(path + "/") & ~own(x).isin(*without)))


def with_manifest(manifests: DataFrame) -> DataFrame:
    """manifests (role, condition, text) with object (whether it holds a configuration), leaves, signature, config and environment."""
    read = manifests.select("role", "condition", "text", jsontext.read_response("text").alias("r"))
    read = read.select("role", "condition", canonical.member_digest("text", "run_config").alias("digest"), F.when(F.col("r.whole"), comparable(F.col("r.leaves"))).alias("leaves"))
    found = read.withColumn("leaves", F.coalesce("leaves", F.array().cast("array<struct<path:string,kind:string,text:string>>")))
    environment = F.array(*[value_at(F.col("leaves"), F.lit(f"/{k}")) for k in ENVIRONMENT_KEYS])
    return found.select(
        "role",
        "condition",
        "leaves",
        leaf_at(F.col("leaves"), CONFIG)["kind"].eqNullSafe(F.lit("object")).alias("object"),
        F.left("digest", F.lit(12)).alias("signature"),
        F.to_json(_below(F.col("leaves"), CONFIG, REPRESENTATION_KEYS)).alias("config"),
        F.to_json(environment).alias("environment"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Of every run (role, condition): its rows, signature, run, errors, cap hits and rows that fail a schema; one scan."""
    false = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    return rows.groupBy("role", "condition").agg(
        F.count("*").alias("rows"),
        F.min("run_signature").alias("run_signature"),
        F.min("run_id").alias("run_id"),
        F.count("error").alias("errors"),
        F.count_if(F.coalesce("hit_max_new_tokens", F.lit(False))).alias("cap_hits"),
        false("internal_schema_valid").alias("internal_invalid"),
        false("external_schema_valid").alias("external_invalid"),
    )


def _bad(checks: list[tuple[str, Column]]) -> Column:
    cells = F.array(*[F.struct(F.lit(name).alias("check"), n.cast("long").alias("n")) for name, n in checks])
    return F.explode(F.filter(cells, lambda x: x["n"] > 0)).alias("x")


def failures(dataset: DataFrame, roles: DataFrame, rows: DataFrame, manifests: DataFrame, conditions: dict[str, str], revision: str, config: dict[str, Any], manifest: dict[str, Any]) -> DataFrame:
    """role, condition, check and n: every way in which runs are not those that were frozen. Nothing is returned for valid ones.

    dataset: role, pos, item_id. roles: role, items (how many are assigned), excluded (item ids in order), dataset_sha256.
    rows: role, condition (whose file it is), pos, item_id, row_condition, representation, run_signature, run_id, model_revision, tokenizer_revision, template_depth.
    manifests: role, condition, text. conditions names each condition's representation; config and manifest are values
    that every run's configuration and manifest must hold.

    A run without rows or manifest fails each check that needs them. condition is null for what concerns a role, and so is role for
    what concerns all runs. n counts rows or items for checks of rows, else it is 1; nulls in rows never pass a check.
    """
    want = cut(assigned(dataset, roles))
    expected = want.groupBy("role").agg(sequence_digest(F.col("pos"), F.col("item_id")).alias("want"))
    twice = lambda df, by: df.groupBy(*by, "item_id").agg(F.count("*").alias("k")).filter("k > 1").groupBy(*by).agg(F.sum(F.col("k") - 1).alias("repeats"))
    of_role = roles.join(expected, "role", "left").join(twice(want, ["role"]), "role", "left")
    of_role = of_role.select("role", _bad([("assigned_items", F.abs(F.coalesce("want.n", F.lit(0)) - F.col("items"))), ("dataset_duplicates", F.coalesce("repeats", F.lit(0)))]))

    names = F.create_map(*[F.lit(x) for kv in conditions.items() for x in kv])
    no = lambda ok: F.count_if(~F.coalesce(ok, F.lit(False)))
    per_row = {
        "model_revision": F.col("model_revision") == revision,
        "tokenizer_revision": F.col("tokenizer_revision") == revision,
        "condition": F.col("row_condition") == F.col("condition"),
        "representation": F.col("representation") == names[F.col("condition")],
        "template_depth": F.col("template_depth") == 1,
    }
    text = lambda c: F.coalesce(c, F.lit("\x00null"))
    ends = [f(text(c)).alias(f"{n}_{c}") for c in ("run_signature", "run_id") for n, f in (("min", F.min), ("max", F.max))]
    sums = rows.groupBy("role", "condition").agg(F.count("*").alias("rows"), sequence_digest(F.col("pos"), F.col("item_id")).alias("got"), *ends, *[no(ok).alias(f"no_{n}") for n, ok in per_row.items()])
    runs = roles.select("role", "items", "excluded", "dataset_sha256", F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
    held = cut(with_manifest(manifests))
    at = runs.join(sums, ["role", "condition"], "left").join(twice(rows, ["role", "condition"]), ["role", "condition"], "left").join(expected, "role", "left").join(held, ["role", "condition"], "left")
    empty = F.col("rows").isNull()
    differ = lambda ok: (~F.coalesce(ok, F.lit(False))).cast("int")
    leaf = lambda path: leaf_at(F.col("leaves"), path)
    excluded = F.filter("leaves", lambda x: x["path"].startswith(f"{CONFIG}/excluded_item_ids/"))
    # positions are part of the path: put them in order as numbers
    excluded = F.array_sort(F.transform(excluded, lambda x: F.struct(F.element_at(F.split(x["path"], "/"), -1).cast("int").alias("i"), x["text"].alias("t"))))
    checks = [
        ("row_count", F.abs(F.coalesce("rows", F.lit(0)) - F.col("items"))),
        ("order", differ(F.col("got").eqNullSafe(F.col("want")))),
        ("duplicates", F.coalesce("repeats", F.lit(0))),
        ("one_signature", differ(F.col("min_run_signature") == F.col("max_run_signature"))),
        ("one_run", differ(F.col("min_run_id") == F.col("max_run_id"))),
        *[(n, F.when(empty, 1).otherwise(F.col(f"no_{n}"))) for n in per_row],
        ("config_object", differ(F.col("object"))),
        ("signature", differ((F.col("min_run_signature") == F.col("signature")) & (F.col("max_run_signature") == F.col("signature")))),
        ("config_dataset_sha256", differ(leaf(f"{CONFIG}/dataset_sha256")["text"] == F.col("dataset_sha256"))),
        ("config_excluded_item_ids", differ((leaf(f"{CONFIG}/excluded_item_ids")["kind"] == "array") & (excluded["t"] == F.col("excluded")))),
        *[(f"config_{k}", differ(is_value(leaf(f"{CONFIG}/{jsontext.pointer(k)}"), v))) for k, v in config.items()],
        *[(f"manifest_{k}", differ(is_value(leaf(f"/{jsontext.pointer(k)}"), v))) for k, v in manifest.items()],
    ]
    of_run = at.select("role", "condition", _bad(checks))
    known = runs.select("role", "condition").join(held, ["role", "condition"], "left")
    value = lambda c: F.count_distinct(text(c))
    paired = known.groupBy("role").agg(value("config").alias("k")).select("role", _bad([("paired_configs", (F.col("k") != 1).cast("int"))]))
    alike = known.agg(value("environment").alias("k")).select(_bad([("one_environment", (F.col("k") > 1).cast("int"))]))
    none = F.lit(None).cast("string")
    parts = [of_run.select("role", "condition", "x.*"), *[p.select("role", none.alias("condition"), "x.*") for p in (of_role, paired)], alike.select(none.alias("role"), none.alias("condition"), "x.*")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
