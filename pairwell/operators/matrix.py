"""Validating a matrix of runs against its dataset: coverage, order and equal fields of all conditions in one scan.

A sequence's digest is a sum over its rows of a hash of position and value. Sums of parts add up to the sum of the
whole, so it is one plain aggregate over any partitioning; equal digests mean equal values at equal positions. Only
the conditions whose digests differ from the dataset's are compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators import validation
from pairwell.sources.shared import cut


def sequence_digest(pos: Column, *values: Column) -> Column:
    """A mergeable digest of values by position: an aggregate."""
    text = [F.coalesce(v.cast("string"), F.lit("\x00null")) for v in values]
    first, second = F.xxhash64(pos, *text), F.xxhash64(F.lit(7), pos, *text)
    return F.struct(F.count("*").alias("n"), F.sum(first.cast("decimal(38,0)")).alias("a"), F.sum(second.cast("decimal(38,0)")).alias("b"))


def differences(expected: DataFrame, rows: DataFrame, scope: str, fields: list[str]) -> DataFrame:
    """scope, check, pos, expected and found of every position at which a scope of rows does not hold the dataset's value of a field.

    expected has pos (from 0 or 1, without gaps) and the fields, rows further a scope. A position that one side lacks is a difference (its value is null there), as is
    one that rows hold twice. Scopes that agree cost one scan.
    """
    want = expected.agg(*[sequence_digest(F.col("pos"), F.col(f)).alias(f) for f in fields]).first()
    sums = cut(rows.groupBy(scope).agg(*[sequence_digest(F.col("pos"), F.col(f)).alias(f) for f in fields]))
    tests = [F.struct(F.lit(f).alias("check"), (F.col(f"{f}.n").eqNullSafe(F.lit(want[f].n)) & F.col(f"{f}.a").eqNullSafe(F.lit(want[f].a)) & F.col(f"{f}.b").eqNullSafe(F.lit(want[f].b))).alias("same")) for f in fields]
    wrong = cut(sums.select(F.col(scope).alias("scope"), F.explode(F.array(*tests)).alias("x")).filter("not x.same").select("scope", "x.check"))
    by = wrong.groupBy("scope").agg(F.collect_set("check").alias("checks"))  # at most one row a scope
    scopes = by.agg(F.collect_list(F.struct("scope", "checks")).alias("all"))
    value = lambda: F.array(*[F.struct(F.lit(f).alias("check"), F.col(f).cast("string").alias("value")) for f in fields])
    left = expected.select("pos", F.explode(value()).alias("x")).join(F.broadcast(scopes)).select("pos", "x.*", F.explode("all").alias("s"))
    left = left.filter(F.array_contains("s.checks", F.col("check"))).select(F.col("s.scope").alias("scope"), "check", "pos", F.col("value").alias("expected"), F.lit(1).alias("side"))
    right = rows.join(F.broadcast(by), F.col(scope) == F.col("scope"), "left_semi").select(F.col(scope).alias("scope"), "pos", F.explode(value()).alias("x"))
    right = right.select("scope", F.col("x.check").alias("check"), "pos", F.col("x.value").alias("found"))
    right = right.join(F.broadcast(wrong.select(F.col("scope").alias("s"), F.col("check").alias("c"))), (F.col("scope") == F.col("s")) & (F.col("check") == F.col("c")), "left_semi")
    both = left.unionByName(right.withColumn("side", F.lit(2)), allowMissingColumns=True)
    each = both.groupBy("scope", "check", "pos").agg(F.max("expected").alias("expected"), F.max("found").alias("found"), F.count_if(F.col("side") == 1).alias("wanted"), F.count_if(F.col("side") == 2).alias("held"))
    return each.filter((F.col("wanted") != 1) | (F.col("held") != 1) | ~F.col("expected").eqNullSafe(F.col("found"))).select("scope", "check", "pos", "expected", "found")


def violations(expected: DataFrame, rows: DataFrame, scope: str, fields: list[str], once: list[str], checks: dict[str, Column]) -> DataFrame:
    """scope, check, n and first (the first position concerned, null where none is): every way in which rows fail to be the dataset's matrix.

    same_<field>: positions that differ from the dataset's; one_<column>: a column that must hold one value a scope and does not; the row checks by
    their names.
    """
    order = differences(expected, rows, scope, fields).groupBy("scope", F.concat(F.lit("same_"), "check").alias("check")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    singles = validation.group_violations(rows, F.col(scope), {f"one_{c}": F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\x00null"))) == 1 for c in once}) if once else None
    names = list(checks)
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.col("pos")) for ok in checks.values()]
    row = rows.groupBy(F.col(scope).alias("scope")).agg(*[F.struct(F.count(b).alias("n"), F.min(b).alias("first")).alias(f"c{i}") for i, b in enumerate(bad)]) if checks else None
    out = order
    if row is not None:
        cells = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}.n").alias("n"), F.col(f"c{i}.first").alias("first")) for i, n in enumerate(names)])
        out = out.unionByName(row.select("scope", F.explode(cells).alias("x")).select("scope", "x.*").filter("n > 0"))
    return out if singles is None else out.unionByName(singles.withColumn("first", F.lit(None).cast("long")))
