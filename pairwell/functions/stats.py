"""Paired and unpaired statistics as Column builders over counts."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the two-sided 95 % normal quantile.
Z95 = 1.959963984540054
#: Discordant pairs up to which a binomial coefficient times a row of its triangle stays below 2**53.
EXACT = 48


def rate_known(flag: Column) -> Column:
    """Share of true among rows whose flag is known; null if none is."""
    return F.avg(flag.cast("double"))


def rate_all(flag: Column) -> Column:
    """Share of true among all rows; unknown counts as false."""
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def successes(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def wilson(count: Column, total: Column) -> Column:
    """The Wilson 95 % interval as struct(low, high), null for no rows."""
    n, p = total.cast("double"), count / total
    scale = 1 + Z95**2 / n
    centre = (p + Z95**2 / (2 * n)) / scale
    radius = Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n)) / scale
    return F.when(total > 0, F.struct(F.greatest(F.lit(0.0), centre - radius).alias("low"), F.least(F.lit(1.0), centre + radius).alias("high")))


def log_factorial(n: Column) -> Column:
    x = F.greatest(n.cast("double"), F.lit(21.0))
    series = x * F.log(x) - x + F.log(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def mcnemar(treatment_only: Column, control_only: Column) -> Column:
    """Two-sided exact McNemar p-value, 1 without discordant pairs.

    The binomial tail is summed from its largest term down; terms beyond a dozen standard deviations vanish
    in double precision, so the work grows with the root of the number of pairs. Up to EXACT discordant pairs
    whole coefficients are summed, which doubles hold without error, so p-values halfway between two spellings stay there.
    """
    n = (treatment_only + control_only).cast("long")
    k = F.least(treatment_only, control_only).cast("long")
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * F.log(F.lit(2.0))
    terms = F.least(k, F.ceil(12 * F.sqrt(n.cast("double"))).cast("long") + 64)
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<long>")), state, add, lambda s: s["sum"])

    def add_whole(s: Column, j: Column) -> Column:
        term = s["term"] * (n - j + 1) / j
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    whole = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), state, add_whole, lambda s: s["sum"])
    exact = F.least(F.lit(1.0), whole / F.pow(F.lit(2.0), n - 1))
    return F.when(n == 0, 1.0).when(n <= EXACT, exact).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * tail))


def _exact_quantiles(n: int, up: int, down: int) -> tuple[float, float]:
    """2.5 % and 97.5 % quantiles of the mean of n draws from up ones, down minus ones and zeros else.

    The distribution of the sum comes from its characteristic function on a window of a dozen standard
    deviations on either side, outside of which nothing is left in double precision.
    """
    if up + down == 0:
        return 0.0, 0.0
    p, q = up / n, down / n
    mean, spread = n * (p - q), np.sqrt(n * (p + q - (p - q) ** 2))
    low = max(-n, int(np.floor(mean - 12 * spread)) - 2)
    high = min(n, int(np.ceil(mean + 12 * spread)) + 2)
    size = 1 << int(high - low + 1).bit_length()
    angle = 2 * np.pi * np.arange(size // 2 + 1) / size
    phi = (p * np.exp(-1j * angle) + q * np.exp(1j * angle) + (1 - p - q)) ** n
    mass = np.fft.irfft(phi, size)
    at = np.arange(low, high + 1)
    total = np.cumsum(np.maximum(mass[at % size], 0))
    return tuple(float(at[min(np.searchsorted(total, x - 1e-12), len(at) - 1)]) / n for x in (0.025, 0.975))


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def exact_bootstrap(pairs: pd.Series, treatment_only: pd.Series, control_only: pd.Series) -> pd.DataFrame:
    """The exact percentile interval of the paired bootstrap, from counts; one row a comparison."""
    got = [(None, None) if not n else _exact_quantiles(int(n), int(a), int(b)) for n, a, b in zip(pairs, treatment_only, control_only, strict=True)]
    return pd.DataFrame(got, columns=["low", "high"], dtype="float64")


def seeded_draws(seed_text: str, n: int, count: int) -> np.ndarray:
    """count uniform numbers below n, as the standard generator seeded with the text's digest gives them."""
    seed = int.from_bytes(hashlib.sha256(seed_text.encode()).digest()[:8], "big")
    words = [seed & 0xFFFFFFFF, seed >> 32] if seed >> 32 else [seed]
    bits = np.random.MT19937()
    bits._legacy_seeding(np.array(words, np.uint32))
    out = np.zeros(0, np.int64)
    shift = np.uint64(32 - n.bit_length())
    while len(out) < count:
        raw = bits.random_raw(int((count - len(out)) * 2 + 64)) >> shift
        out = np.concatenate([out, raw[raw < n].astype(np.int64)])
    return out[:count]


def seeded_bootstrap(differences: list[int], seed_text: str, replicates: int = 20_000) -> tuple[float, float]:
    """The percentile interval of a Monte-Carlo paired bootstrap with reproducible draws.

    For the differences of one comparison in item order. Draws go by position, so the whole list is needed
    at once; use exact_bootstrap where it may be long.
    """
    values = np.array(differences, np.int64)
    # the percentile positions are fixed values
    means = np.sort(values[seeded_draws(seed_text, len(values), len(values) * replicates)].reshape(replicates, -1).sum(1)) / len(values)
    return float(means[int(0.025 * (replicates - 1))]), float(means[int(0.975 * (replicates - 1))])


@F.arrow_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def seeded_interval(differences: pa.Array, seed_text: pa.Array) -> pa.Array:
    """seeded_bootstrap() of a column of lists of differences, in item order, each with the text that seeds its draws; null for an empty list."""
    got = [seeded_bootstrap(d, t) if d else (None, None) for d, t in zip(differences.to_pylist(), seed_text.to_pylist(), strict=True)]
    return pa.array([{"low": a, "high": b} for a, b in got], pa.struct([("low", pa.float64()), ("high", pa.float64())]))
