"""Group profiles: rates under an explicit null policy, means, medians and conditional counts."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions import stats

#: How a rate treats unknown flags: leaves them out, or counts them as false.
POLICIES = {"known": stats.rate_known, "all": stats.rate_all}


def rates(flags: dict[str, Column], policy: str) -> list[Column]:
    return [POLICIES[policy](flag).alias(name) for name, flag in flags.items()]


def first_known(new: Column, old: Column) -> Column:
    """The new value unless it is null."""
    return F.coalesce(new, old)


def if_present(row_keys: Column, key: str, new: Column, old: Column) -> Column:
    """The new value, null or not, where the row has the key; the old one only where the key is missing."""
    return F.when(F.array_contains(row_keys, key), new).otherwise(old)


def per_token(latency: Column, tokens: Column) -> Column:
    """Mean of row-level latency per token over rows with tokens."""
    return F.avg(F.when(tokens > 0, latency / tokens))


#: Digits of binary fraction that a double can have, and those that exact_totals() keeps beside its leading one.
_DEEPEST, _KEPT = 1074 + 54, 54


@F.arrow_udf(T.DoubleType())
def _rounded_once(parts: pa.Array) -> pa.Array:
    out = []
    for row in parts.to_pylist():
        if row is None:
            out.append(None)
            continue
        total = sum(int(p["total"]) << (p["power"] - _KEPT + _DEEPEST) for p in row)
        try:
            out.append(total / (1 << _DEEPEST))  # a quotient of integers is rounded once
        except OverflowError:
            out.append(math.inf if total > 0 else -math.inf)
    return pa.array(out, pa.float64())


def exact_totals(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by and name: the sum of a double column by group, computed without error and rounded once, whatever the order.

    Every value is an integer of at most 56 binary digits times a power of two, so sums by power are exact; they are
    plain aggregates, and a group has some 2,100 powers at most. Nulls are left out, and a group of nulls only gives null. With infinite values
    or NaN the sum is theirs.
    """
    x = F.col(value).cast("double")
    odd = x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    power = F.when(odd | (x == 0), 0).otherwise(F.floor(F.log2(F.abs(x)))).cast("int")
    shift = F.lit(_KEPT) - power
    half = F.floor(shift / 2)
    # two exact steps: 2 to the whole shift may be out of range
    whole = (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), shift - half)).cast("long")
    parts = rows.select(*by, power.alias("power"), F.when(~odd, whole).cast("decimal(38,0)").alias("m"), F.when(odd, x).alias("odd"))
    sums = parts.groupBy(*by, "power").agg(F.sum("m").alias("total"), F.sum("odd").alias("odd"))
    some = F.struct("power", F.col("total").cast("string").alias("total"))
    all_ = sums.groupBy(*by).agg(F.collect_list(F.when(F.col("total").isNotNull(), some)).alias("parts"), F.sum("odd").alias("odd"))
    return all_.select(*by, F.coalesce("odd", F.when(F.size("parts") > 0, _rounded_once("parts"))).alias(name))


def profile(rows: DataFrame, by: list[str], flags: dict[str, Column], policy: str) -> DataFrame:
    """Per group: examples, each flag's rate, latency and token means and medians, errors and cap hits."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("examples"),
        *rates(flags, policy),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.median("latency_ms").alias("median_latency_ms"),
        F.avg("generated_tokens").alias("avg_generated_tokens"),
        F.median("generated_tokens").alias("median_generated_tokens"),
        per_token(F.col("latency_ms"), F.col("generated_tokens")).alias("avg_latency_per_token_ms"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.count_if(F.coalesce("hit_max_new_tokens", F.lit(False))).alias("cap_hits"),
    )


def layer_profile(rows: DataFrame, by: list[str], flags: dict[str, Column], more: dict[str, Column] | None = None) -> DataFrame:
    """Per group: examples; of each flag its count, rate and Wilson interval over all rows (unknown counts as false); errors and cap hits;
    totals, means and medians of tokens and latency, the latency's total without rounding in between; and further aggregates.

    rows has latency_ms, generated_tokens, error and hit_max_new_tokens. by may not hold nulls.
    """
    n = F.count("*")
    layers = []
    for name, flag in flags.items():
        k = stats.successes(flag)
        ci = stats.wilson(k, n)
        layers += [k.alias(f"{name}_count"), (k / n).alias(f"{name}_rate"), ci["low"].alias(f"{name}_low"), ci["high"].alias(f"{name}_high")]
    found = rows.groupBy(*by).agg(
        n.alias("examples"),
        *layers,
        F.count("error").alias("errors"),
        F.count_if(F.coalesce("hit_max_new_tokens", F.lit(False))).alias("cap_hits"),
        F.sum("generated_tokens").alias("tokens_total"),
        F.avg("generated_tokens").alias("tokens_mean"),
        F.median("generated_tokens").alias("tokens_median"),
        F.avg("latency_ms").alias("latency_mean"),
        F.median("latency_ms").alias("latency_median"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    return found.join(exact_totals(rows, by, "latency_ms", "latency_total"), by)


def scored_profile(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group every metric of scored rows: counts, rates over known flags, two Wilson intervals, telemetry, files.

    Flags that a condition does not have (JSON layers of free text, the marker of JSON) are null there and so are
    their rates and intervals. Medians are exact; each group's files are a sorted list of distinct names.
    """
    flags = ["strict_numeric", "whole", "recovered", "schema_valid", "order_matches", "marker_at_end", "hit_max_new_tokens"]
    known = lambda name: stats.wilson(F.count_if(F.col(name)), F.count(name))
    return rows.groupBy(*by).agg(
        F.count("*").alias("examples"),
        stats.successes(F.col("correct")).alias("correct_exact"),
        *rates({"accuracy": F.col("correct"), "strict_accuracy": F.col("strict")}, "known"),
        known("correct").alias("accuracy_ci"),
        known("strict").alias("strict_accuracy_ci"),
        *rates({name: F.col(name) for name in flags}, "known"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.median("latency_ms").alias("median_latency_ms"),
        F.avg("generated_tokens").alias("avg_generated_tokens"),
        per_token(F.col("latency_ms"), F.col("generated_tokens")).alias("avg_latency_per_token_ms"),
        F.count("error").alias("errors"),
        F.array_sort(F.collect_set("source_file")).alias("source_files"),
    )


def invariants(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Per group and column the sorted distinct values, null shown as such, and whether there is just one."""
    values = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in columns]
    long = rows.select(*by, F.explode(F.array(*values)).alias("x")).select(*by, "x.*").distinct()
    return long.groupBy(*by, "column").agg(F.sort_array(F.collect_list("value")).alias("values"), F.count("*").alias("n_values"))
