"""Registered queries of tool items, boundary traces, prompts, subsets of pairs and bounded suites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions import jsontext, prompts
from pairwell.operators import catalogue, eligibility, manifests, pairing, selection, traces
from pairwell.sources.stand_ins import COMPARISONS, dealt, runs, table, tool_items

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    _QUERIES[f.__name__] = f
    return f


@query
def prj_07_tool_items(spark, sf_dir):
    """Why a tool item cannot be evaluated, the first of thirteen reasons; what is asked of those that can."""
    found = eligibility.judged_items(tool_items(spark, sf_dir))
    refs = F.array_join(F.transform("negative_references", lambda x: F.concat_ws("=", x["field"], x["value"])), ",")
    return found.select("row.p_partkey", "reason", "user_request", F.array_join("required_integers", ",").alias("required_integers"), refs.alias("negative_references"))


@query
def agg_18_item_reasons(spark, sf_dir):
    """Tool items by reason."""
    found = eligibility.judged_items(tool_items(spark, sf_dir))
    return found.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("items"))


#: Tokens whose scores every boundary record holds, by their text; the ids stand for a tokenizer's.
KNOWN = {"-": 3, "0": 5, "1": 6, " ": 40, "beyond": 1 << 20}


@query
def srt_05_boundary_traces(spark, sf_dir):
    """The eight best scores before and after a mask, and those of known tokens, of every vector that stands for a step at an answer boundary."""
    at, scores = F.col("vec_id"), F.col("embedding").cast("array<double>")
    said = F.when(at % 4 == 0, '{"reasoning": "so", "answer": ').when(at % 4 == 1, '{"answer"  :').when(at % 4 == 2, '{"answer": 1').otherwise('{"answers": ')
    masked = F.transform(scores, lambda x, i: F.when((i + at) % 3 == 0, float("-inf")).otherwise(x))
    steps = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.repeat(F.lit("x"), (at % 300).cast("int")), said).alias("decoded"), scores.alias("pre"), masked.alias("post"), "label")
    found = traces.boundary_records(steps, KNOWN)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["token_id"].cast("string")), ",")
    minus = lambda c: F.col(c)["-"]["score"]
    return found.select(
        "row.vec_id",
        F.char_length("decoded_suffix").cast("long").alias("suffix"),
        F.col("masked_count").cast("long").alias("masked"),
        ids("top_pre_mask").alias("pre"),
        ids("top_post_mask").alias("post"),
        F.get("top_post_mask", F.lit(0))["score"].alias("best"),
        minus("known_pre_mask_scores").alias("minus"),
        F.size("known_post_mask_scores").cast("long").alias("known"),
    )


@query
def scl_16_all_prompts(spark, sf_dir):
    """The prompt of every turn by every builder, by length and digest."""
    made = {
        "free": prompts.question_prompt("text"),
        **{f"{r}_{order[0]}_first": prompts.question_prompt("text", r, order) for r in prompts.ANSWERS for order in (prompts.ORDER, prompts.ORDER[::-1])},
        "tool": prompts.tool_prompt(F.col("text"), F.lit("adjust_stock"), F.col("role"), F.lit('{"type":"object"}')),
    }
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.create_map(*[x for k, p in made.items() for x in (F.lit(k), p)])).alias("builder", "prompt"))
    return rows.select("conv_id", "turn", "builder", F.char_length("prompt").cast("long").alias("chars"), F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"))


def _arms(spark, sf_dir) -> DataFrame:
    return pairing.last_wins(runs(spark, sf_dir), ["item_id", "condition"])


@query
def agg_16_mismatched_items(spark, sf_dir):
    """Every item and field in which the arms of a comparison differ, all comparisons: rows in place of lists, which would be as long as the table."""
    pairs = pairing.paired(_arms(spark, sf_dir), COMPARISONS, [])
    fields = ["answer", "correct", "strict", "error"]
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c.{f}").eqNullSafe(F.col(f"t.{f}")).alias("same")) for f in fields])
    return pairs.select("comparison", "item_id", F.explode(cells).alias("x")).filter("not x.same").select("comparison", "item_id", "x.field")


@query
def jon_03b_subsets(spark, sf_dir):
    """Two arms by subset: positions that do not hold one item, repeated items, and what the treatment repairs and breaks."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat_ws("_", "p_type", F.col("p_partkey").cast("string")).alias("item"), F.col("p_type").alias("subset"), "p_size")
    control = rows.select("subset", "pos", "item", (F.col("p_size") % 2 == 0).alias("success"))
    moved = F.when(F.col("pos") % 97 == 5, F.concat("item", F.lit("x"))).otherwise(F.col("item"))
    treatment = rows.filter(F.col("pos") % 101 != 3).select("subset", "pos", moved.alias("item"), (F.col("p_size") % 3 == 0).alias("success"))
    return pairing.subset_effects(control, treatment, "success")


def _three(spark, sf_dir) -> DataFrame:
    """Items that three conditions hold, with who is right: prompt (purchase), and two treatments (signup, view)."""
    right = lambda name: F.max(F.when(F.col("condition") == name, F.col("correct"))).alias(name)
    at = _arms(spark, sf_dir).groupBy(F.col("item_id").cast("long").alias("pos")).agg(right("purchase"), right("signup"), right("view"), right("click"))
    return at.filter("purchase is not null and signup is not null and view is not null")


@query
def smp_05_first_controls(spark, sf_dir):
    """The suite as it is drawn: all losses, the first five items right everywhere and the first three wrong everywhere, none of them excluded."""
    three = _three(spark, sf_dir).filter(F.col("pos") % 7 != 0)
    reason = F.when(F.col("purchase") & ~F.col("signup") & ~F.col("view"), "constrained_semantic_loss").when(F.least("purchase", "signup", "view"), "matched_all_correct_control").when(~F.greatest("purchase", "signup", "view"), "shared_wrong_diagnostic")
    marks = three.select("pos", reason.alias("reason")).filter("reason is not null")
    return catalogue.bounded_suite(marks, {"constrained_semantic_loss": None, "matched_all_correct_control": 5, "shared_wrong_diagnostic": 3}, "pos")


@query
def jon_08b_shared_losses(spark, sf_dir):
    """Items that the prompt gets right and both treatments wrong: whether another arm has them, and repairs them."""
    lost = _three(spark, sf_dir).filter(F.col("purchase") & ~F.col("signup") & ~F.col("view") & (F.col("pos") % 7 != 0))
    return lost.select("pos", F.col("click").isNotNull().alias("available"), F.coalesce("click", F.lit(False)).alias("repaired"))


def _manifest(model: str, seed: str, order: str, packages: str) -> Column:
    return F.concat(F.lit('{"run_config": {"model": "'), F.col(model), F.lit('", "seed": '), F.col(seed), F.lit(', "field_order": '), F.col(order), F.lit('}, "packages": '), F.col(packages), F.lit("}"))


@query
def prj_01_projections(spark, sf_dir):
    """Two manifests of every customer: the fields of their configurations and environments that differ. Some spell the same in another way."""
    n, text = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_mktsegment").alias("model"),
        F.when(n % 7 == 1, F.concat("c_mktsegment", F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("model2"),
        text.alias("seed"),
        F.when(n % 5 == 1, F.concat(text, F.lit(".0"))).when(n % 5 == 2, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text).alias("seed2"),
        F.lit('["reasoning", "answer"]').alias("order"),
        F.when(n % 3 == 1, '["answer", "reasoning"]').otherwise('["reasoning", "answer"]').alias("order2"),
        F.when(n % 4 == 3, "null").otherwise('{"a": "1", "b": {"c": [1, 2]}}').alias("packages"),
        F.when(n % 8 == 3, 'null, "python": null').when(n % 4 == 1, '{"b": {"c": [1, 2]}, "a": "1"}').when(n % 4 == 2, '{"a": "1", "b": {"c": [1, 2, 3]}}').otherwise('{"a": "1", "b": {"c": [1, 2]}}').alias("packages2"),
    )
    both = dealt(rows).select("c_custkey", jsontext.read_call(_manifest("model", "seed", "order", "packages")).alias("l"), jsontext.read_call(_manifest("model2", "seed2", "order2", "packages2")).alias("r"))
    both = both.select("c_custkey", manifests.comparable(F.col("l.leaves")).alias("l"), manifests.comparable(F.col("r.leaves")).alias("r"))
    differ = lambda fields, at: F.array_join(manifests.differing_fields(F.col("l"), F.col("r"), fields, at), ",")
    return both.select("c_custkey", differ(manifests.CONFIG, "/run_config").alias("config"), differ(manifests.ENVIRONMENT, "").alias("environment"))


@query
def fil_02b_slice(spark, sf_dir):
    """Positions 50 to the end of the documents, at most 200 of them, with nothing excluded."""
    return selection.sliced(table(spark, sf_dir, "documents").select("doc_id", "source"), None, "doc_id", 50, None, 200, "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
