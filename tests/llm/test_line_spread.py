import re

import pytest
from pyspark.sql import functions as F

from pairwell.llm import line_spread, queries
from tests.llm import helpers
from tests.oracle import assert_same


def brute(docs, least):
    sites = {}
    for d in docs:
        for line in (d[1] or "").split("\n"):
            if line.strip(" \t\r"):
                sites.setdefault(line.strip(" \t\r"), set()).update([] if d[3] is None else [d[3]])
    out = []
    for d in docs:
        lines = [] if d[1] is None else d[1].split("\n")
        keep = [x for x in lines if len(sites.get(x.strip(" \t\r"), ())) < least]
        out.append((d[0], sum(bool(x.strip(" \t\r")) for x in lines), len(lines) - len(keep), None if d[1] is None else "\n".join(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 5, 9])
def test_lines_equal_brute_force(spark, least):
    docs = helpers.odd_rows()
    for i in range(200):
        body = [f"own line {i}", "", f" shared {i % 7} \t", f"rare {i % 60}", "everywhere\r" if i % 2 else "everywhere"]
        docs.append((10 + i, "\n".join(body[i % 3 :]), "en", None if i % 23 == 0 else f"site{i % (3 + i % 9)}", 1))
    docs += docs[20:25]
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["n_lines", "clean_text", "pos", "line", "h", "__drop"])
    got = line_spread.remove_spread_lines(frame, min_sites=least)
    assert helpers.rows_of(got, "doc_id", "n_lines", "n_removed", "clean_text") == brute(docs, least)


def test_very_long_texts(spark):
    """Texts of over a megabyte, half of whose 300 000 lines go."""
    text = "\n".join(f"boiler {i % 1000}" if i % 2 else f"own {i}" for i in range(300_000))
    docs = [(1, text, "en", "a", 1)] + [(10 + k, "\n".join(f"boiler {i}" for i in range(1000)), "en", f"s{k}", 1) for k in range(5)] + [(3, "y" * 1_500_000, "en", "b", 1)]
    got = helpers.rows_of(line_spread.remove_spread_lines(spark.createDataFrame(docs, helpers.SCHEMA)), "doc_id", "n_lines", "n_removed", "clean_text")
    same = got == brute(docs, 5)
    assert same, [r[:3] for r in got]


def test_empty(spark):
    assert line_spread.remove_spread_lines(helpers.empty_docs(spark)).count() == 0


def test_estimates_far_from_the_threshold_decide_alone(spark):
    docs = [(i, "wide line\nnarrow line" if i % 40 == 0 else "wide line", "en", f"s{i}", 1) for i in range(400)]
    each = line_spread.lines(spark.createDataFrame(docs, helpers.SCHEMA), "source")
    assert line_spread.spread_lines(each, 50, 0.25).count() == 1


def test_main_path_is_native(spark, sf_dir, monkeypatch):
    for step in ("cut", "written"):  # one plan from end to end
        monkeypatch.setattr(line_spread, step, lambda rows: rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = line_spread.remove_spread_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("PythonUDF|ArrowEval|BatchEval|MapIn|FlatMap|ExistingRDD", plan) and "hll_sketch_agg" in plan and "collect_set" in plan


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op9_line_spread(spark, sf_dir), queries.OP9_SQL, sf_dir)


def test_nulls(spark):
    docs = helpers.odd_docs(spark).withColumn("source", F.lit(None).cast("string"))
    assert line_spread.remove_spread_lines(docs).filter("n_removed > 0").count() == 0
