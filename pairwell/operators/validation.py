"""Artifact validation: named checks that yield rows, and gates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_violations(rows: DataFrame, scope: Column, checks: dict[str, Column]) -> DataFrame:
    """scope, check and n of every row check that fails somewhere; one scan for all checks."""
    sums = rows.groupBy(scope.alias("scope")).agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])
    return sums.select("scope", F.explode(cells).alias("x")).select("scope", "x.*").filter("n > 0")


def group_violations(rows: DataFrame, scope: Column, checks: dict[str, Column]) -> DataFrame:
    """scope and check of every group check (an aggregate that must be true) that fails; n is 1."""
    got = rows.groupBy(scope.alias("scope")).agg(*[F.coalesce(ok, F.lit(False)).alias(name) for name, ok in checks.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("ok")) for n in checks])
    return got.select("scope", F.explode(cells).alias("x")).select("scope", F.col("x.check").alias("check"), F.col("x.ok").alias("ok")).filter("not ok").select("scope", "check", F.lit(1).cast("long").alias("n"))


def all_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def gate(violations: DataFrame, scopes: DataFrame) -> DataFrame:
    """Each scope with its failed checks and whether it passes."""
    bad = violations.groupBy("scope").agg(F.sort_array(F.collect_set("check")).alias("failed"))
    return scopes.select("scope").distinct().join(bad, "scope", "left").select("scope", F.coalesce(F.array_join("failed", ","), F.lit("")).alias("failed"), F.col("failed").isNull().alias("passes"))
