"""What a model weighed where its answer begins: records of the steps at an answer boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What generated text ends in where the answer's value comes next. Fixed value.
BOUNDARY = r'"answer"\s*:\s*$'


def best(scores: Column, count: int) -> Column:
    """The count highest scores of an array with their positions (token ids), highest first, of equal ones the lower id; nulls are left out, NaN comes last."""
    ranked = F.array_sort(F.filter(F.transform(scores, lambda x, i: F.struct((-x).alias("down"), i.cast("int").alias("token_id"))), lambda x: x["down"].isNotNull()))
    return F.transform(F.slice(ranked, 1, count), lambda x: F.struct(x["token_id"].alias("token_id"), F.round(-x["down"], 6).alias("score")))


def known_scores(scores: Column, known: dict[str, int]) -> Column:
    """The scores of some tokens by their text; ids beyond the array are left out."""
    entries = F.array(*[F.struct(F.lit(t).alias("text"), F.struct(F.lit(i).alias("token_id"), F.round(F.get(scores, F.lit(i)), 6).alias("score")).alias("at")) for t, i in known.items()])
    return F.map_from_entries(F.filter(entries, lambda x: x["at"]["token_id"] < F.size(scores)))


def boundary_records(steps: DataFrame, known: dict[str, int], top: int = 8, suffix: int = 240) -> DataFrame:
    """A record for every step whose decoded text ends at an answer boundary, the other columns of steps kept in row.

    steps has decoded (text generated before the step), pre and post (scores by token id before and after the mask) and selected (the token taken, null
    at the end). The filter comes before any score is sorted; rows are independent, so nothing is shuffled. Null texts are no boundary; null
    arrays give null fields.
    """
    at = steps.filter(F.regexp_like("decoded", F.lit(BOUNDARY)))
    pre, post = F.col("pre"), F.col("post")
    return at.select(
        F.struct(*[F.col(f"`{c}`") for c in steps.columns if c not in ("decoded", "pre", "post")]).alias("row"),
        F.right("decoded", F.lit(suffix)).alias("decoded_suffix"),
        F.size(F.filter(post, lambda x: x == float("-inf"))).alias("masked_count"),
        best(pre, top).alias("top_pre_mask"),
        best(post, top).alias("top_post_mask"),
        known_scores(pre, known).alias("known_pre_mask_scores"),
        known_scores(post, known).alias("known_post_mask_scores"),
    )
