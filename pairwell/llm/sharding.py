"""Sharding by sampled splitters.

Documents are ordered by the first bytes of the text, then by a hash of all of it, so equal texts lie together and
texts that begin alike side by side. How texts begin is far from even; a bounded, size-weighted sample of keys gives quantile boundaries of many more ranges than shards; each document goes to its range.
Ranges that come out overfull are subdivided by samples of their own, and a single text that outweighs a
whole shard is subdivided by id. What reaches the driver is bounded: the sample and one sum a range.

Ranges are dealt to shards by size, largest first, each to the shard that holds least, so shards come out
near equal in bytes and equal texts stay together unless they outweigh a shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.common import cut, without, written

SHARDS = 8
RANGES_PER_SHARD = 64
#: Sampled keys for each range.
SAMPLE_PER_RANGE = 48
#: A range above this many times its share is subdivided.
OVERFULL = 2.0
#: Rounds of subdividing before what is left is split by id.
ROUNDS = 3
#: Rows of one slot-numbering window, and those of one where an order is given.
CELL_ROWS, ORDER_ROWS = 512, 4096
#: Bytes of the text and hexadecimal digits of its hash that make a key of less than 64 bits.
PREFIX, KEY_DIGITS = 4, 7


def sampled(keys: DataFrame, total: float, count: int, seed: int) -> np.ndarray:
    """About count keys, each row drawn with a chance in proportion to its size, as often as that is due."""
    rate = count / max(total, 1.0)
    chance = F.pmod(F.xxhash64(F.lit(seed), "key", "tie"), F.lit(1 << 30)) / float(1 << 30)
    due = F.floor(F.col("size") * rate + chance)
    found = keys.select("key", due.alias("due")).filter("due > 0").toArrow()
    return np.sort(np.repeat(found["key"].to_numpy(), np.minimum(found["due"].to_numpy(), count)))


def splitters(sample: np.ndarray, ranges: int) -> np.ndarray:
    """Quantile boundaries of a sorted sample: the first key of each range but the first."""
    if not len(sample):
        return np.zeros(0, np.int64)
    at = (np.arange(1, ranges) * len(sample)) // ranges
    return np.unique(sample[at])


def placed(keys: DataFrame, bounds: np.ndarray) -> DataFrame:
    """keys with range: the number of boundaries at or below the key."""
    names = keys.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column("key").to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(at, pa.int64())], names=[*names, "range"])

    return keys.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in keys.dtypes) + ", range long")


def balanced_bounds(keys: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, dict[int, tuple[int, int, int, int]]]:
    """Boundaries of ranges that hold no more than OVERFULL times their share, but for single keys; of each
    range its bytes, rows, least and greatest key."""
    bounds = splitters(sampled(keys, total, ranges * SAMPLE_PER_RANGE, 0), ranges)
    for attempt in range(ROUNDS + 1):
        sums = placed(keys, bounds).groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        full = [r for r in sums if r["size"] > OVERFULL * total / ranges and r.low < r.high]
        if not full or attempt == ROUNDS:
            return bounds, {r.range: (r["size"], r.n, r.low, r.high) for r in sums}
        more = [bounds]
        for r in full:
            part = keys.filter(F.col("key").between(r.low, r.high))
            parts = int(2 * r["size"] * ranges // total) + 2
            sample = sampled(part, r["size"], parts * SAMPLE_PER_RANGE, attempt + 1)
            inner = splitters(sample, parts)
            heavy, n = np.unique(sample, return_counts=True)
            heavy = heavy[n > SAMPLE_PER_RANGE // 2]  # a heavy key gets a range of its own
            more.append(np.concatenate([inner, heavy, heavy + 1, [r.low]]))
        bounds = np.unique(np.concatenate(more))
    raise AssertionError


def dealt(sizes: dict[tuple[int, int], int], shards: int) -> dict[tuple[int, int], int]:
    """The shard of each piece of a range: largest first, each to the shard that holds least."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for piece, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        out[piece] = s
        heapq.heappush(loads, (load + size, s))
    return out


class Plan:
    """Where keys go: the boundaries of the ranges, and of each range its shards by piece and its cells."""

    def __init__(self, keys: DataFrame, shards: int):
        total = keys.agg(F.sum("size")).first()[0] or 0
        self.bounds, ranges = balanced_bounds(keys, total, shards * RANGES_PER_SHARD)
        most = max(ranges, default=0) + 1
        self.pieces, self.first = np.ones(most, np.int64), np.zeros(most, np.int64)
        self.single = np.zeros(most, bool)  # ranges of one key, which may be one row many times over
        for k, (size, n, low, high) in ranges.items():
            self.single[k] = low == high
            if size > total / shards:
                self.pieces[k] = min(n, int(np.ceil(size * shards / total * RANGES_PER_SHARD / 4)))
        self.first = np.cumsum(self.pieces) - self.pieces
        self.shards, self.cells = np.zeros(int(self.pieces.sum()), np.int64), np.ones(int(self.pieces.sum()), np.int64)
        rows = {(k, 0): r[1] for k, r in ranges.items() if self.pieces[k] == 1}
        sizes = {(k, 0): r[0] for k, r in ranges.items() if self.pieces[k] == 1}
        split = [F.col("key").between(ranges[k][2], ranges[k][3]) for k in ranges if self.pieces[k] > 1]
        if split:  # the pieces as they come out, not as they should
            heavy = reduce(Column.__or__, split)
            found = with_places(keys.filter(heavy).select("key", "tie", "size"), self).groupBy("range", "piece").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
            sizes |= {(r.range, r.piece): r.n for r in found}
            rows |= {(r.range, r.piece): r["rows"] for r in found}
        for (k, piece), s in dealt(sizes, shards).items():
            self.shards[self.first[k] + piece] = s
            self.cells[self.first[k] + piece] = -(-rows[k, piece] // CELL_ROWS)

    def place(self, key: np.ndarray, tie: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
        """Shard, range, piece and cell of each key; tie splits pieces and cells, and the row's number the cells of one key."""
        at = np.minimum(np.searchsorted(self.bounds, key, "right"), len(self.pieces) - 1)
        tie = tie.view(np.uint64)
        piece = (tie % self.pieces[at].astype(np.uint64)).astype(np.int64)
        slot = self.first[at] + piece
        cell = (((tie >> np.uint64(32)) + np.where(self.single[at], number, 0).astype(np.uint64)) % self.cells[slot].astype(np.uint64)).astype(np.int64)
        return self.shards[slot], at, piece, cell


def keyed(docs: DataFrame, columns: list[str], order: Sequence[Column] = ()) -> DataFrame:
    """row (a struct of the columns), size, text_crc32, key, tie and order of each document.

    The key is the first PREFIX bytes of the text, then KEY_DIGITS hexadecimal digits of its hash.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    begin = F.rpad(F.hex(F.substring(data, 1, PREFIX)), 2 * PREFIX, "0")
    key = F.conv(F.concat(begin, F.substring(F.lpad(F.hex(F.xxhash64(data)), 16, "0"), 1, KEY_DIGITS)), 16, 10).cast("long").alias("key")
    place = [F.struct(*order).alias("order")] if order else []
    return docs.select(row, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key, F.xxhash64(F.lit("tie"), "doc_id").alias("tie"), *place)


PLACES = ["shard", "range", "piece", "cell"]


def with_places(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (with key and tie) with the shard, range, piece and cell that the plan gives them."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            number = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            got = plan.place(batch.column("key").to_numpy(zero_copy_only=False), batch.column("tie").to_numpy(zero_copy_only=False), number)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x, pa.int64()) for x in got)], names=[*names, *PLACES])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in PLACES)]))


def numbered(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (as of keyed) with shard and slot, in the given order of rows, or else by key.

    Slots are counted over cells, so no task holds a shard. An order is a value and a number; cells are stretches
    of the number. Without one, the rows must be read from a written table, as their numbers there split hot keys.
    """
    names = [c for c in rows.columns if c != "order"]
    if "order" in rows.columns:
        first, second = (F.col("order")[f.name] for f in rows.schema["order"].dataType.fields)
        cell, inner = F.struct(first.alias("a"), F.floor(second / ORDER_ROWS).alias("b")), [second]
    else:
        cell, inner = F.struct("range", "piece", "cell"), [F.col("key"), F.col("tie")]
    rows = with_places(rows, plan).select(*rows.columns, F.col("shard").alias("s"), cell.alias("c"))
    sums = rows.groupBy(F.col("s").alias("shard"), F.col("c").alias("cell")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("s", "c").orderBy(*inner)) - 1
    rows = rows.withColumn("at", at).join(sums, (F.col("s") == F.col("shard")) & (F.col("c") == F.col("cell")))
    return rows.select(*names, F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("at")).cast("long").alias("slot"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; 1 for null), text_crc32 (0 for null), shard and slot
    (gapless from 0 in each shard), for every row.

    Null and empty texts count as equal. Repeated rows each get a slot; rows that agree in id and text share
    a shard. An empty table gives an empty result. Reruns agree but for which of equal texts has which of their
    slots. Further columns are not used.
    """
    keys = cut(keyed(docs, ["doc_id"]))
    return numbered(keys, Plan(keys, shards)).select("row.doc_id", "size", "text_crc32", "shard", "slot")


def sharded_rows(docs: DataFrame, shards: int = SHARDS, order: Sequence[Column] = ()) -> DataFrame:
    """All columns of docs with shard and slot, which take the place of columns so named.

    order may give the order of slots in a shard: two columns, a value and a number from 0, that are unique
    together; such as the file and the row in it that a table was read from. Else slots go by key. As to nulls,
    repeated rows and empty tables as shard().
    """
    plan = Plan(cut(keyed(docs, ["doc_id"])), shards)
    rows = keyed(docs, without(docs, ["shard", "slot"]).columns, order)
    return numbered(rows if order else written(rows), plan).select("row.*", "shard", "slot")
