"""Failure catalogues, audit worklists and targeted suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import numbers
from pairwell.operators.selection import first_per_reason


def losses(pairs: DataFrame, correct: str = "correct", answer: str = "answer") -> DataFrame:
    """A record for every pair that the control gets right and the treatment wrong."""
    t, c = F.col("t"), F.col("c")
    lost = pairs.filter(F.coalesce(c[correct], F.lit(False)) & ~F.coalesce(t[correct], F.lit(False)))
    flipped = numbers.sign_inverse(c[answer], t[answer])
    return lost.select(
        F.lit("paired_loss").alias("record_type"),
        "item_id",
        "comparison",
        F.when(flipped, "sign_inversion_at_answer_boundary").otherwise("constrained_semantic_regression").alias("failure_class"),
        F.when(flipped, "high").otherwise("medium").alias("confidence"),
        F.create_map(F.lit("control_answer"), c[answer], F.lit("treatment_answer"), t[answer]).alias("evidence"),
    )


def negatives(rows: DataFrame, answer: str = "answer") -> DataFrame:
    """A record for every negative answer."""
    return rows.filter(F.startswith(F.col(answer), F.lit("-"))).select(
        F.lit("negative_answer").alias("record_type"),
        "item_id",
        F.col("condition").alias("comparison"),
        F.lit("negative_answer_on_positive_gold_subset").alias("failure_class"),
        F.lit("high").alias("confidence"),
        F.create_map(F.lit("predicted_answer"), F.col(answer)).alias("evidence"),
    )


def order_discordance(pairs: DataFrame, correct: str = "correct", answer: str = "answer") -> DataFrame:
    """A record for every pair of field orders (t: answer first, c: reasoning first) of which just one is right."""
    first, second = F.coalesce(F.col("c")[correct], F.lit(False)), F.coalesce(F.col("t")[correct], F.lit(False))
    return pairs.filter(first != second).select(
        F.lit("field_order_discordance").alias("record_type"),
        "item_id",
        "comparison",
        F.when(first, "premature_answer_commitment").otherwise("answer_first_specific_recovery").alias("failure_class"),
        F.lit("high").alias("confidence"),
        F.create_map(F.lit("reasoning_first_answer"), F.col("c")[answer], F.lit("answer_first_answer"), F.col("t")[answer]).alias("evidence"),
    )


def completions(rows: DataFrame) -> DataFrame:
    """A record for every row that hit the token cap or failed."""
    cap = F.coalesce("hit_max_new_tokens", F.lit(False))
    return rows.filter(cap | F.col("error").isNotNull()).select(
        F.lit("completion_diagnostic").alias("record_type"),
        "item_id",
        F.col("condition").alias("comparison"),
        F.when(cap, "token_cap_hit").otherwise("generation_error").alias("failure_class"),
        F.lit("high").alias("confidence"),
        F.create_map(F.lit("error"), F.col("error")).alias("evidence"),
    )


def catalogue_order(index: Column) -> Column:
    """The sort key of a catalogue: a missing index and index 0 both sort as -1."""
    return F.when(F.coalesce(index, F.lit(0)) == 0, F.lit(-1)).otherwise(index)


def targeted(marks: DataFrame, reasons: list[str]) -> DataFrame:
    """Items with any reason, reasons in the given order."""
    rank = F.array_position(F.array(*map(F.lit, reasons)), F.col("reason"))
    got = marks.groupBy("item_id").agg(F.sort_array(F.collect_set(F.struct(rank.alias("rank"), "reason"))).alias("all"))
    return got.select("item_id", F.array_join(F.transform("all", lambda x: x["reason"]), ",").alias("selection_reason"))


def bounded_suite(marks: DataFrame, limits: dict[str, int | None], pos: str) -> DataFrame:
    """The first items by position of each reason, as many as its limit says (None: all), with their reasons in the order of limits.

    Reasons without a limit are not ranked; the others are ranked under a bound, so a task keeps only the first of each before the shuffle.
    """
    free = marks.filter(F.col("reason").isin([r for r, n in limits.items() if n is None])).select(pos, "reason")
    for reason, count in limits.items():
        if count is not None:
            free = free.unionByName(first_per_reason(marks.filter(F.col("reason") == reason).select(pos, "reason"), "reason", pos, count))
    return targeted(free.withColumnRenamed(pos, "item_id"), list(limits)).withColumnRenamed("item_id", pos)


def restore_labels(generated: DataFrame, labels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """generated with the manual columns of labels; where there is no label they become null."""
    return generated.drop(*columns).join(labels.select(*keys, *columns), keys, "left")


def first_reason(cases: list[tuple[str, Column]]) -> Column:
    """The first case that holds, in order: an eligibility cascade; null where none does."""
    out = F.when(cases[0][1], F.lit(cases[0][0]))
    for name, case in cases[1:]:
        out = out.when(case, F.lit(name))
    return out
