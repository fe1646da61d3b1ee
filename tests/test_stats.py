import math
import random

import pytest
from pyspark.sql import functions as F

from pairwell.functions import stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("k", "n", "low", "high"),
    [(5, 10, 0.236593090512564, 0.7634069094874361), (36, 49, 0.5973771102868921, 0.8378871786504258), (92, 150, 0.5334979124018292, 0.6875088322080735)],
)
def test_wilson(spark, k, n, low, high):
    got = one(spark, stats.wilson(F.lit(k), F.lit(n)))
    assert got.low == pytest.approx(low, abs=1e-12) and got.high == pytest.approx(high, abs=1e-12)


def test_wilson_bounds(spark):
    assert one(spark, stats.wilson(F.lit(0), F.lit(0))) is None
    assert one(spark, stats.wilson(F.lit(0), F.lit(7))).low == pytest.approx(0, abs=1e-12)
    assert one(spark, stats.wilson(F.lit(7), F.lit(7))).high <= 1


@pytest.mark.parametrize(
    ("t", "c", "p"),
    [(0, 0, 1.0), (3, 4, 1.0), (2, 11, 0.0224609375), (1, 23, 2.9802322387695312e-06), (0, 36, 2.9103830456733704e-11), (9, 3, 0.14599609375), (6, 16, 0.052478790283203125), (5, 15, 0.04138946533203125), (1, 3, 0.625)],
)
def test_mcnemar(spark, t, c, p):
    assert one(spark, stats.mcnemar(F.lit(t), F.lit(c))) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize(("t", "c"), [(420, 500), (4_900, 5_100), (0, 400)])
def test_mcnemar_of_many_pairs(spark, t, c):
    n = t + c
    exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(t, c) + 1)) / 2**n)
    assert one(spark, stats.mcnemar(F.lit(t), F.lit(c))) == pytest.approx(exact, rel=1e-8)


@pytest.mark.parametrize(("n", "t", "c", "low", "high"), [(49, 9, 3, 0.0, 13 / 49), (150, 6, 16, -0.12666666666666668, -0.006666666666666667), (30, 1, 3, -0.2, 0.06666666666666667), (20, 0, 0, 0.0, 0.0)])
def test_exact_bootstrap(spark, n, t, c, low, high):
    got = one(spark, stats.exact_bootstrap(F.lit(n), F.lit(t), F.lit(c)))
    assert (got.low, got.high) == (pytest.approx(low, abs=1e-12), pytest.approx(high, abs=1e-12))


def test_exact_bootstrap_of_nothing_and_of_much(spark):
    assert one(spark, stats.exact_bootstrap(F.lit(0), F.lit(0), F.lit(0))).low is None
    got = one(spark, stats.exact_bootstrap(F.lit(10**9), F.lit(2 * 10**8), F.lit(10**8)))
    assert got.low < 0.1 < got.high and got.high - got.low == pytest.approx(2 * 1.959963985 * math.sqrt(0.29 / 1e9), rel=1e-3)


def test_seeded_draws_are_those_of_the_standard_generator():
    import hashlib

    for text, n in (("m:c:legacy", 49), ("x", 150), ("y", 1), ("z", 64)):
        rng = random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
        assert stats.seeded_draws(text, n, 500).tolist() == [rng.randrange(n) for _ in range(500)]


def test_seeded_bootstrap():
    low, high = stats.seeded_bootstrap([1] * 9 + [-1] * 3 + [0] * 37, "m:c:legacy", 2_000)
    assert low == pytest.approx(0, abs=0.03) and high == pytest.approx(13 / 49, abs=0.03)


def test_null_policies(spark):
    rows = spark.createDataFrame([(True,), (None,), (False,), (None,)], "x boolean")
    got = rows.agg(stats.rate_known(F.col("x")).alias("a"), stats.rate_all(F.col("x")).alias("b")).first()
    assert (got.a, got.b) == (0.5, 0.25)
    assert rows.filter("x is null").agg(stats.rate_known(F.col("x")).alias("a")).first().a is None


def test_mcnemar_of_few_pairs_is_exact(spark):
    """2/6 is 37/128: spelled with six digits, a value above it by one bit ends in 3, not 2."""
    pairs = [(t, c) for n in range(1, stats.EXACT + 1) for t, c in {(n // 2, n - n // 2), (n // 3, n - n // 3), (0, n), (2 * n // 3, n - 2 * n // 3)}] + [(2, 6)]
    rows = spark.createDataFrame(pairs, "t long, c long").select("t", "c", stats.mcnemar(F.col("t"), F.col("c")).alias("p")).collect()
    for r in rows:
        assert r.p == min(1.0, 2 * sum(math.comb(r.t + r.c, i) for i in range(min(r.t, r.c) + 1)) / 2 ** (r.t + r.c)), r
