"""Report tables as lines, summaries as JSON and the repair stage."""

import json

from pyspark.sql import functions as F

from pairwell.operators import report


def lines(df):
    return [r.line for r in df.orderBy("position").collect()]


def test_cells_of_nothing_and_bars(spark):
    rows = spark.createDataFrame([("b|c\nd", 0, 0, None, None, None), ("a", 1, 8, 0.5, -0.25, 0.75), (None, 3, 3, 0.0, None, 0.1)], "name string, k long, n long, d double, low double, high double")
    cells = {"Name": F.col("name"), "Share": report.share_cell(F.col("k"), F.col("n")), "Delta": report.interval_cell(F.col("d"), F.col("low"), F.col("high")), "Mean": report.number_cell(F.col("d"))}
    assert lines(report.table_lines(rows, cells, "name")) == [
        "| Name | Share | Delta | Mean |",
        "|---|---:|---:|---:|",
        "| n/a | 3/3 (100.0%) | 0.0% (n/a) | 0.0 |",
        "| a | 1/8 (12.5%) | 50.0% ([-25.0%, 75.0%]) | 0.5 |",
        "| b\\|c d | 0/0 (n/a) | n/a (n/a) | n/a |",
    ]
    assert lines(report.table_lines(rows.limit(0), cells, "name")) == ["| Name | Share | Delta | Mean |", "|---|---:|---:|---:|"]


def test_six_significant_digits(spark):
    values = [1.0, 0.5, 0.0312500001, 1.23456789e-9, 123456789.0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", report.significant("v").alias("s"))
    assert [r.s for r in rows.orderBy("i").collect()] == ["1", "0.5", "0.03125", "1.23457e-09", "1.23457e+08", "n/a"]


def test_a_summary_as_indented_json(spark):
    rows = spark.createDataFrame([("z", None, [1]), ("ä", 2.5, [])], "name string, rate double, ids array<int>")
    text = report.indented_json(rows, ["name"])
    assert json.loads(text) == [{"name": "z", "rate": None, "ids": [1]}, {"name": "ä", "rate": 2.5, "ids": []}]
    assert text.startswith('[\n  {\n    "name": "z"') and "ä" in text and text.endswith("]\n")


def test_the_repair_stage(spark):
    lost = spark.createDataFrame([(f"i{n}",) for n in range(6)], "item_id string")
    arms = [("good", f"i{n}", n != 0, True) for n in range(9)]  # lacks none, repairs five
    arms += [("few", f"i{n}", n < 4, True) for n in range(5)]  # has five, repairs four
    arms += [("invalid", f"i{n}", True, None if n == 7 else True) for n in range(8)]
    arms += [("elsewhere", "i100", None, False)]
    rows = spark.createDataFrame(arms, "arm string, item_id string, correct boolean, valid boolean")
    got = {r.arm: (r.available, r.repaired, r.invalid, r.passes) for r in report.repair_stage(lost, rows).collect()}
    assert got == {"good": (6, 5, 0, True), "few": (5, 4, 0, False), "invalid": (6, 6, 1, False), "elsewhere": (0, 0, 1, False)}
    assert report.repair_stage(lost, rows, enough=4).filter("arm = 'few' and passes").count() == 1
    assert report.repair_stage(lost.limit(0), rows).filter("passes").count() == 0
