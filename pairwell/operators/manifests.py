"""Projections of run manifests: whether two runs had the same configuration or environment, and where they differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwell.functions import numbers
from pairwell.functions.schemas import KINDS

# The fields of a manifest that say in which environment a run ran, and of its configuration that must be alike in compared runs.
ENVIRONMENT = ("python", "torch", "cuda_runtime", "gpus", "model_revision", "tokenizer_revision", "packages", "source_manifest_sha256")
CONFIG = ("model", "revision", "answer_representation", "field_order", "prompt_version", "seed", "do_sample", "max_new_tokens", "dtype", "device_map_auto", "internal_schema_sha256", "external_schema_sha256", "transducer_version", "plan_id")


def comparable(leaves: Column) -> Column:
    """Leaves as they compare: numbers by value, whatever their spelling. Make it a column of its own before fields are compared."""

    def one(x: Column) -> Column:
        number = x["kind"].isin(*KINDS["number"])
        return F.struct(x["path"].alias("path"), F.when(number, "number").otherwise(x["kind"]).alias("kind"), F.when(number, numbers.number_key(x["text"])).otherwise(x["text"]).alias("text"))

    return F.transform(leaves, one)


def value_at(values: Column, path: Column) -> Column:
    """The value at a path of comparable(): keys in any order, lists in theirs. Null if it is absent or null."""
    found = F.array_sort(F.filter(values, lambda x: (x["path"] == path) | x["path"].startswith(F.concat(path, F.lit("/")))))
    return F.when(F.get(found, F.lit(0))["kind"] != "null", found)


def differing_fields(left: Column, right: Column, fields: tuple[str, ...], at: str = "") -> Column:
    """The fields, in order, whose values at a place of two manifests differ; an absent field is the same as null, and so are all fields of a manifest that is null.

    left and right are of comparable().
    """
    path = lambda f: F.concat(F.lit(f"{at}/"), f)
    return F.filter(F.array(*map(F.lit, fields)), lambda f: ~value_at(left, path(f)).eqNullSafe(value_at(right, path(f))))
