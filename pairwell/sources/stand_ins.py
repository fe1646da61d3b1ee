"""Run rows, responses and tool calls that Spark derives from the given tables.

The tables hold no model runs, so users stand for items, event types for conditions, and the number in an
event's properties for the outcome. Every row of a table gives a row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMPARISONS = [("purchase_vs_signup", "purchase", "signup"), ("view_vs_click", "view", "click"), ("error_vs_signup", "error", "signup")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, if a scan gives fewer: for work that outweighs a shuffle.

    Large tables come in many splits and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored run rows: item_id, condition, pos, flags with and without nulls, answer and telemetry."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"))
    return rows.select(
        F.col("user_id").cast("string").alias("item_id"),
        F.col("event_type").alias("condition"),
        F.col("event_id").alias("pos"),
        "k",
        F.col("value").alias("latency_ms"),
        F.col("k").alias("generated_tokens"),
        (F.col("k") % 2 == 0).alias("correct"),
        F.when(F.col("k") % 5 != 0, F.col("k") % 3 == 0).alias("strict"),
        F.when(F.col("k") % 7 == 0, "timeout").alias("error"),
        (F.col("k") >= 95).alias("hit_max_new_tokens"),
        F.concat(F.when(F.col("event_id") % 4 == 0, "-").otherwise(""), F.col("k").cast("string")).alias("answer"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw responses in eight shapes by event: whole, with prose behind or before, answers of other types, cut, reordered."""
    rows = runs(spark, sf_dir)
    k = F.col("k").cast("string")
    body = F.concat(F.lit('{"reasoning": "so it is '), k, F.lit('", "answer": '))
    shape = F.col("pos") % 8
    raw = (
        F.when(shape == 0, F.concat(body, k, F.lit("}")))
        .when(shape == 1, F.concat(body, k, F.lit("} Done.")))
        .when(shape == 2, F.concat(F.lit("Answer: "), body, k, F.lit("}")))
        .when(shape == 3, F.concat(body, F.lit('"'), k, F.lit('"}')))
        .when(shape == 4, F.concat(body, k, F.lit(".0}")))
        .when(shape == 5, F.concat(body, F.lit("true}")))
        .when(shape == 6, F.concat(body, k))
        .otherwise(F.concat(F.lit('{"answer": '), k, F.lit(', "reasoning": "it was 7"}')))
    )
    gold = F.when(F.col("pos") % 3 == 0, F.col("k") + 1).otherwise(F.col("k")).cast("string")
    return dealt(rows.select("item_id", "pos", "condition", "k", "latency_ms", "generated_tokens", "error", "hit_max_new_tokens", raw.alias("raw_output"), gold.alias("gold_answer")))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tool calls from order lines: by line number whole, of another tool, lacking a field, with a string, a float or an extra field, cut."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"))
    shape = F.col("l_linenumber")

    def call(name: str, quantity: Column, tail: str = "}}") -> Column:
        return F.concat(F.lit(f'{{"name": "{name}", "arguments": {{"sku": "P'), F.col("l_partkey").cast("string"), F.lit('", "quantity_delta": '), quantity, F.lit(', "bins": [1, 2]' + tail))

    number = (-F.col("quantity")).cast("string")
    raw = (
        F.when(shape == 1, call("adjust_stock", number))
        .when(shape == 2, call("adjust_price", number))
        .when(shape == 3, F.concat(F.lit('{"name": "adjust_stock", "arguments": {"sku": "P'), F.col("l_partkey").cast("string"), F.lit('", "bins": [1, 2]}}')))
        .when(shape == 4, call("adjust_stock", F.concat(F.lit('"'), number, F.lit('"'))))
        .when(shape == 5, call("adjust_stock", F.concat(number, F.lit(".0"))))
        .when(shape == 6, call("adjust_stock", number, ', "note": null}}'))
        .otherwise(call("adjust_stock", number, ""))
    )
    wanted = F.when(F.col("l_orderkey") % 2 == 0, -F.col("quantity")).otherwise(F.col("quantity")).cast("string")
    return dealt(rows.select("l_orderkey", "l_linenumber", "l_partkey", raw.alias("raw_output"), wanted.alias("wanted_quantity")))


def tool_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool item for every part, its question and answer as JSON texts, by key in sixteen shapes: fifteen depart from a plain one in one thing."""
    shape, n = F.col("p_partkey") % 16, (F.col("p_size") - 25).cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", shape.alias("shape"), n.alias("n"))

    def either(cases: dict[int, str], plain: str) -> Column:
        out = F.lit(plain)
        for at, text in cases.items():
            out = F.when(F.col("shape") == at, text).otherwise(out)
        return out

    role = either({1: "system"}, "user")
    tool = either({3: "7"}, '"adjust_stock"')
    kind = either({4: "object"}, "dict")
    required = either({5: '"sku"', 6: '["sku"]'}, '["sku", "count"]')
    note = either({7: "tuple"}, "string")
    count = either({8: '{"type": "integer", "minimum": 0}'}, '{"type": "integer"}')
    function = F.concat(F.lit('{"name": '), tool, F.lit(', "parameters": {"type": "'), kind, F.lit('", "properties": {"sku": {"type": "string"}, "count": '), count, F.lit(', "note": {"type": "'), note, F.lit('"}}, "required": '), required, F.lit("}}"))
    functions = F.concat(F.lit("["), function, F.when(F.col("shape") == 2, F.concat(F.lit(", "), function)).otherwise(""), F.lit("]"))
    question = F.concat(F.lit('{"question": [[{"role": "'), role, F.lit('", "content": "adjust '), F.col("p_brand"), F.lit('"}]], "function": '), functions, F.lit("}"))
    number = F.col("n")
    options = F.when(F.col("shape") == 11, F.concat(F.lit('["'), number, F.lit('"]'))).when(F.col("shape") == 13, F.concat(F.lit("["), number, F.lit(".0]"))).otherwise(F.concat(F.lit("["), number, F.lit(', "none", -3]')))
    call = F.concat(F.lit('{"adjust_stock": {"sku": ["P"], "count": '), options, either({10: ', "color": ["red"]', 12: ', "note": "none"'}, ', "note": [""]'), F.lit("}}"))
    answer = F.concat(F.lit('{"ground_truth": ['), call, F.when(F.col("shape") == 9, F.concat(F.lit(", "), call)).otherwise(""), F.lit("]}"))
    return dealt(rows.select("p_partkey", F.when(F.col("shape") == 14, F.left(question, F.lit(40))).otherwise(question).alias("question"), F.when(F.col("shape") != 15, answer).alias("answer")))
