"""Report tables."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.functions.numbers import percent, table_cell


def item_matrix(rows: DataFrame, conditions: list[str], cell: Column) -> DataFrame:
    """One row per item, one column per condition; a missing row says so."""
    at = rows.select("item_id", "condition", cell.alias("cell")).groupBy("item_id").pivot("condition", conditions).agg(F.first("cell"))
    return at.select("item_id", *[F.coalesce(F.col(f"`{c}`"), F.lit("missing row")).alias(c) for c in conditions])


def prediction_cell(answer: Column, correct: Column, strict: Column, error: Column, cap: Column) -> Column:
    """A prediction as a table shows it: value, mark, and flags for a lax format, an error or a cap hit."""
    value = F.coalesce(table_cell(answer), F.lit("none"))
    lax = F.when(F.coalesce(strict, F.lit(True)), "").otherwise(" (non-strict)")
    mark = F.when(F.coalesce(correct, F.lit(False)), " ok").otherwise(" wrong")
    return F.concat(value, lax, mark, F.when(error.isNotNull(), " [error]").otherwise(""), F.when(F.coalesce(cap, F.lit(False)), " [cap]").otherwise(""))


def markdown(table: DataFrame, columns: list[str]) -> str:
    """A small result table as Markdown text; for summaries, one row a group."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join("n/a" if r[c] is None else str(r[c]) for c in columns) + " |" for r in table.select(*columns).toLocalIterator()]
    return "\n".join(lines) + "\n"


@F.arrow_udf(T.StringType())
def significant(values: pa.Array) -> pa.Array:
    """A number with six significant digits, without trailing zeros; n/a for null."""
    return pa.array(["n/a" if v is None else f"{v:.6g}" for v in values.to_pylist()], pa.string())


def share_cell(count: Column, total: Column) -> Column:
    """count/total (percent); n/a as the share of nothing."""
    share = F.when(total != 0, count / total)
    return F.concat(count.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), percent(share), F.lit(")"))


def interval_cell(value: Column, low: Column, high: Column) -> Column:
    """value [low, high], all in percent; an interval of which an end is unknown is n/a."""
    return F.concat(percent(value), F.lit(" ("), F.when(low.isNull() | high.isNull(), "n/a").otherwise(F.concat(F.lit("["), percent(low), F.lit(", "), percent(high), F.lit("]"))), F.lit(")"))


def number_cell(value: Column) -> Column:
    """A mean with one decimal, n/a for null."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.1f", value.cast("double")))


def table_lines(summary: DataFrame, cells: dict[str, Column], order: str) -> DataFrame:
    """position and line of a Markdown table: title, alignment (the first column to the left, the others to the right), then a line for
    each row of a summary by order. Null cells are n/a, bars and line ends in them are escaped. A summary has a row a group: its lines are
    numbered in one task.
    """
    text = [F.coalesce(table_cell(c.cast("string")), F.lit("n/a")) for c in cells.values()]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |"))
    rows = summary.select((F.row_number().over(Window.orderBy(order)) + 1).cast("long").alias("position"), line.alias("line"))
    head = ["| " + " | ".join(cells) + " |", "|" + "|".join(["---", *["---:"] * (len(cells) - 1)]) + "|"]
    return summary.sparkSession.createDataFrame(list(enumerate(head)), "position long, line string").unionByName(rows)


def indented_json(summary: DataFrame, order: list[str]) -> str:
    """A small summary as indented JSON, a list of objects in order; nulls stay. It is as long as the summary has rows: one a group."""
    rows = summary.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    return json.dumps([json.loads(r.j) for r in rows], indent=2, ensure_ascii=False) + "\n"


def repair_stage(lost: DataFrame, arms: DataFrame, enough: int = 5) -> DataFrame:
    """Of every arm: how many lost items it has (available) and gets right (repaired), its rows that are invalid, and whether it passes.

    lost: item_id, each once. arms: arm, item_id, correct, valid (null counts as false), an item once an arm. An arm passes that repairs enough and has no
    invalid row.
    """
    false = F.lit(False)
    marked = arms.join(lost.select(F.col("item_id").alias("l")), F.col("item_id") == F.col("l"), "left")
    sums = marked.groupBy("arm").agg(
        F.count("l").alias("available"),
        F.count_if(F.col("l").isNotNull() & F.coalesce("correct", false)).alias("repaired"),
        F.count_if(~F.coalesce("valid", false)).alias("invalid"),
    )
    return sums.withColumn("passes", (F.col("repaired") >= enough) & (F.col("invalid") == 0))
