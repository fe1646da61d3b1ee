import random

import pytest

from pairwell import queries_strict as strict
from pairwell.functions import stats
from pairwell.queries import queries
from pairwell.queries_sql import SQL
from pairwell.sources.stand_ins import table
from tests.oracle import assert_same


_QUERIES = queries()
#: Draws of the standard generator, which SQL does not have: compared with it below.
SEEDED = {"smp_01_seeded_shuffle", "smp_02_seeded_sample", "agg_13_seeded_interval"}


@pytest.mark.parametrize("name", sorted(set(_QUERIES) - SEEDED))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(_QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


def test_every_query_has_sql():
    assert set(_QUERIES) - SEEDED == set(SQL)


def test_seeded_draws_are_those_of_the_whole_list(spark, sf_dir):
    parts = sorted(r.p_partkey for r in table(spark, sf_dir, "part").select("p_partkey").collect() if r.p_partkey % 3)
    pool = list(parts)
    random.Random(20260815).shuffle(pool)
    got = strict.smp_01_seeded_shuffle(spark, sf_dir).collect()
    assert [r.p_partkey for r in sorted(got, key=lambda r: r.draw_order)] == pool[: len(parts) // 8]
    assert all(parts[r.source_rank] == r.p_partkey for r in got)
    orders = sorted(r.o_orderkey for r in table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey").collect())
    got = strict.smp_02_seeded_sample(spark, sf_dir).collect()
    assert [r.o_orderkey for r in sorted(got, key=lambda r: r.draw_order)] == random.Random(20260731).sample(orders, len(orders) // 10)


def test_seeded_intervals(spark, sf_dir):
    got = strict.agg_13_seeded_interval(spark, sf_dir).collect()
    assert got and all(0 < r.pairs <= strict.BLOCK and -1 <= r.low <= r.high <= 1 for r in got)
    rows = spark.createDataFrame([([1] * 6 + [-1] * 3 + [0] * 40, "a:b:legacy"), ([], "x")], "d array<int>, t string").coalesce(1)
    ci = [r.ci for r in rows.select(stats.seeded_interval("d", "t").alias("ci")).collect()]
    assert (ci[0].low, ci[0].high) == stats.seeded_bootstrap([1] * 6 + [-1] * 3 + [0] * 40, "a:b:legacy") and ci[1].low is None
    assert abs(ci[0].low + 0.0612) < 0.021 and abs(ci[0].high - 0.1837) < 0.021
