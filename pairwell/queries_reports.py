"""Registered queries of replications against what was frozen, and of reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.operators import pairing, profiles, replication, report, validation
from pairwell.sources.stand_ins import COMPARISONS, dealt, runs, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CONDITIONS = {"string": "signed_string", "integer": "integer"}
REVISION = "r1"
FROZEN = {"model": "m", "revision": REVISION, "backend": "grammar", "seed": 0, "do_sample": False, "dtype": "float32", "max_new_tokens": 256}


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _replication(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as the datasets of three roles (their status), the roles, two conditions' rows over each and the runs' manifests.

    Every role excludes its first order. All that is wrong is listed here: what the rows of a condition hold, then what its manifest does.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("role"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("item_id"), "o_totalprice")
    dataset = orders.select("role", "pos", "item_id")
    first = F.array(F.concat(F.lit("order_"), F.min("pos").cast("string")))
    roles = dataset.groupBy("role").agg((F.count("*") - F.when(F.col("role") == "P", 0).otherwise(1)).alias("items"), first.alias("excluded"), F.sha2(F.col("role").cast("binary"), 256).alias("dataset_sha256"))
    role, condition, k = F.col("role"), F.col("condition"), F.col("pos")
    here = lambda r, c: (role == r) & (condition == c)
    made = replication.assigned(dataset, roles).withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    made = made.filter(~here("F", "integer") | (k % 101 != 7))
    other = F.when(here("F", "string") & (k % 97 == 3), k + 1).when(here("F", "string") & (k % 97 == 4), k - 1).otherwise(k)
    bound = spark.createDataFrame([(r, c, s) for r in "FOP" for c, s in (("string", 0), ("integer", 0))], "role string, condition string, seed int")
    bound = bound.withColumn("seed", F.when(here("P", "string"), F.lit("1")).otherwise(F.lit("0")))
    bound = bound.join(roles, "role")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    representation = F.when(condition == "string", "signed_string").otherwise("integer")
    parts = {
        "answer_representation": q(representation),
        "backend": F.lit('"grammar"'),
        "condition": q(condition),
        "dataset_sha256": q(F.col("dataset_sha256")),
        "do_sample": F.lit("false"),
        "dtype": F.lit('"float32"'),
        "excluded_item_ids": F.concat(F.lit('["'), F.array_join("excluded", '","'), F.lit('"]')),
        "max_new_tokens": F.lit("256"),
        "model": F.lit('"m"'),
        "revision": F.lit('"r1"'),
        "seed": F.col("seed"),
    }
    spelled = lambda keys, comma, colon: F.concat(F.lit("{"), F.concat_ws(comma, *[F.concat(F.lit(f'"{n}"{colon}'), parts[n]) for n in keys]), F.lit("}"))
    plain, turned = spelled(parts, ",", ":"), spelled(list(reversed(parts)), ", ", ": ")
    packages = F.when(here("P", "integer"), '{"a": "2"}').when(condition == "string", '{"a": "1", "b": [1, 2]}').otherwise('{"b": [1, 2], "a": "1"}')
    text = F.concat(F.lit('{"packages": '), packages, F.lit(', "python": "3", "model_revision": "r1", "run_config": '), turned, F.lit("}"))
    signature = F.left(F.sha2(F.concat(plain, F.when(here("P", "integer"), " ").otherwise("")).cast("binary"), 256), F.lit(12))
    bound = bound.select("role", "condition", text.alias("text"), signature.alias("run_signature"))
    repeated = F.when(here("O", "string") & (k % 89 == 5), k - 1)
    # the item at another place of the role: the rows of a condition are looked up by place
    wanted = made.select("role", "condition", k, F.coalesce(repeated, other).alias("from"))
    place = replication.assigned(dataset, roles).select("role", F.col("pos").alias("from"), "item_id")
    rows = wanted.join(place, ["role", "from"]).join(F.broadcast(bound.select("role", "condition", "run_signature")), ["role", "condition"])  # a row a run
    odd = here("O", "integer")
    rows = rows.select(
        "role",
        "condition",
        "pos",
        "item_id",
        condition.alias("row_condition"),
        representation.alias("representation"),
        "run_signature",
        F.when(odd & (k % 2 == 0), "second").otherwise("first").alias("run_id"),
        F.when(odd & (k % 50 == 1), "r0").otherwise(REVISION).alias("model_revision"),
        F.lit(REVISION).alias("tokenizer_revision"),
        F.when(odd & (k % 60 == 2), F.lit(None)).otherwise(1).alias("template_depth"),
        F.when(k % 40 == 9, "timeout").alias("error"),
        (k % 70 == 1).alias("hit_max_new_tokens"),
        (k % 30 != 4).alias("internal_schema_valid"),
        F.when(k % 20 != 4, k % 15 != 4).alias("external_schema_valid"),
    )
    return dataset, roles, rows, bound.select("role", "condition", "text")


def _failures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    dataset, roles, rows, manifests = _replication(spark, sf_dir)
    return replication.failures(dataset, roles, rows, dealt(manifests), CONDITIONS, REVISION, FROZEN, {"model_revision": REVISION, "python": "3"}), rows


@query
def val_04_replication(spark, sf_dir):
    """Every way in which the runs over three roles are not those that were frozen."""
    return _failures(spark, sf_dir)[0]


@query
def val_04_report(spark, sf_dir):
    """The runs with their counts, which of their own checks fail, and whether they pass."""
    found, rows = _failures(spark, sf_dir)
    scope = lambda df: df.withColumn("scope", F.concat_ws("/", "role", "condition"))
    counts = scope(replication.report(rows))
    return counts.join(validation.gate(scope(found.filter("condition is not null")), counts), "scope").drop("scope", "run_signature")


@query
def snk_04_condition_table(spark, sf_dir):
    """The lines of the report's table of conditions: four layers, negative answers, errors, caps, means."""
    contract = F.col("correct") & F.col("strict")
    flags = {"semantic": F.col("correct"), "external": F.col("strict"), "contract": contract, "internal": F.col("k") % 11 != 0}
    found = profiles.layer_profile(runs(spark, sf_dir), ["condition"], flags, {"negative": F.count_if(F.startswith("answer", F.lit("-")))})
    n = F.col("examples")
    share = lambda name: report.share_cell(F.col(name), n)
    cells = {"Condition": F.col("condition"), "n": n, "Semantic correctness": share("semantic_count"), "External validity": share("external_count"), "Contract-valid correctness": share("contract_count"), "Internal validity": share("internal_count")}
    cells |= {"Negative answers": share("negative"), "Errors": F.col("errors"), "Cap hits": F.col("cap_hits"), "Avg latency ms": report.number_cell(F.col("latency_mean")), "Avg tokens": report.number_cell(F.col("tokens_mean"))}
    return report.table_lines(found, cells, "condition")


@query
def snk_04_comparison_table(spark, sf_dir):
    """The lines of the report's table of comparisons: difference with interval, items won and lost, exact p-value."""
    arms = pairing.last_wins(runs(spark, sf_dir), ["item_id", "condition"])
    counts = pairing.with_exact_interval(pairing.contingency(pairing.paired(arms, COMPARISONS, []), F.col("t.correct"), F.col("c.correct"), ["comparison"]))
    won = F.concat_ws("/", F.col("treatment_only").cast("string"), F.col("control_only").cast("string"))
    cells = {"Comparison": F.col("comparison"), "Paired n": F.col("pairs"), "Delta (95% CI)": report.interval_cell(F.col("delta"), F.col("bootstrap.low"), F.col("bootstrap.high")), "Treatment-only/control-only": won, "Exact p": report.significant("mcnemar_p")}
    return report.table_lines(counts, cells, "comparison")


@query
def snk_06_repair_stage(spark, sf_dir):
    """Items that a purchase gets right and both a signup and a view get wrong: what the arms repair, and whether they pass."""
    last = pairing.last_wins(runs(spark, sf_dir), ["item_id", "condition"])
    right = lambda name: F.max(F.when(F.col("condition") == name, F.col("correct")))
    lost = last.groupBy("item_id").agg(right("purchase").alias("p"), right("signup").alias("s"), right("view").alias("v")).filter("p and not s and not v")
    arms = last.filter(F.col("condition").isin("click", "error", "view")).select(F.col("condition").alias("arm"), "item_id", "correct", ((F.col("condition") == "error") | F.col("strict")).alias("valid"))
    return report.repair_stage(lost, arms)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
