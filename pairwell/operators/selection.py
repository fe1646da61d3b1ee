"""Selecting rows: exclusion, slices, resume, holdouts and seeded samples."""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.sources.shared import cut


def without_items(rows: DataFrame, excluded: DataFrame, item: str = "item_id") -> DataFrame:
    """rows but those of excluded items, compared as text."""
    gone = excluded.select(F.col(item).cast("string").alias("__gone")).distinct()
    return rows.join(gone, F.col(item).cast("string") == F.col("__gone"), "left_anti")


def numbered(rows: DataFrame, pos: str, as_name: str = "index") -> DataFrame:
    """rows with their rank from 0 by position (nulls first), of equal positions by a digest of the row: reruns agree.

    Rows are range-sorted by position, digest and a number of their own, so ties and even repeated rows are split over tasks; a row's rank
    is the count of all ranges before its own and its place there. The table is written to the shared folder once.
    """
    names = rows.columns
    own = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = cut(rows.select(own.alias("row"), F.col(pos).alias("pos"), F.xxhash64(own).alias("tie"), F.monotonically_increasing_id().alias("id")))
    order = ["pos", "tie", "id"]
    ranged = cut(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("part").alias("p"), before.alias("before"))  # a row a shuffle partition
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    found = ranged.withColumn("local", local).join(F.broadcast(sums), F.col("part") == F.col("p"))
    return found.select("row.*", (F.col("before") + F.col("local")).cast("long").alias(as_name))


def sliced(rows: DataFrame, excluded: DataFrame | None, pos: str, start: int, end: int | None, limit: int | None, item: str = "item_id") -> DataFrame:
    """Excludes first (nothing where excluded is None), then takes positions start to end (exclusive) of what is left, then at most limit rows."""
    left = numbered(rows if excluded is None else without_items(rows, excluded, item), pos)
    stop = min(x for x in (end, None if limit is None else start + limit, 1 << 62) if x is not None)
    return left.filter((F.col("index") >= start) & (F.col("index") < stop))


def pending(items: DataFrame, completed: DataFrame, item: str = "item_id") -> DataFrame:
    """Items that no completed row has."""
    return items.join(completed.select(item).distinct(), item, "left_anti")


def in_both(rows: DataFrame, wanted: DataFrame, item: str = "item_id") -> DataFrame:
    """rows whose item is wanted; the left side's order is its position column."""
    return rows.join(wanted.select(item).distinct(), item, "left_semi")


def shuffled_ranks(total: int, count: int, seed: int) -> list[int]:
    """The first count of the numbers below total as a seeded shuffle orders them. Eight bytes a number on the driver."""
    _enough(total, count)
    pool = array("q", range(total))
    random.Random(seed).shuffle(pool)
    return list(pool[:count])


def sampled_ranks(total: int, count: int, seed: int) -> list[int]:
    """count different numbers below total as a seeded sample draws them; only the draw is held."""
    _enough(total, count)
    return random.Random(seed).sample(range(total), count)


def _enough(total: int, count: int) -> None:
    if count <= 0:
        raise ValueError("count must be positive")
    if count > total:
        raise ValueError(f"{count} wanted, {total} eligible")


def drawn(rows: DataFrame, pos: str, count: int, seed: int, draw: Callable[[int, int, int], list[int]] = sampled_ranks) -> DataFrame:
    """count of the rows with source_rank (by position) and draw_order, as a generator seeded alike draws them from the rows in order.

    The driver draws ranks from the number of rows alone; a join on the rows' ranks finds them. Draws too many
    rows: an error.
    """
    ranked = numbered(rows, pos, "source_rank")
    ranks = draw(rows.count(), count, seed)
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(r, i) for i, r in enumerate(ranks)], "drawn_rank long, draw_order long")
    return ranked.join(wanted, F.col("source_rank") == F.col("drawn_rank")).drop("drawn_rank")


def seeded_choice(keys: list, count: int, seed: int) -> list:
    """count keys as a seeded shuffle draws them, for small key lists; see drawn() for tables."""
    return [keys[r] for r in shuffled_ranks(len(keys), count, seed)]


def hashed_sample(rows: DataFrame, key: Column, share: float, seed: int) -> DataFrame:
    """A reproducible sample by hash of the key: the same rows at any partitioning."""
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < int(share * (1 << 20)))


def first_per_reason(rows: DataFrame, reason: str, pos: str, count: int) -> DataFrame:
    """The first rows by position of each reason. The bound on the rank lets every task keep only that many
    rows of a reason before the shuffle, however common it is."""
    rank = F.row_number().over(Window.partitionBy(reason).orderBy(pos))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= count).drop("__rank")
