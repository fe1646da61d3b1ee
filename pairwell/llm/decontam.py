"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A window of a benchmark item (ten consecutive words, or the whole of a shorter item) is a pattern. Blocks
of up to three words index a shift table: a block that no pattern holds lets the search jump over all
windows that would contain it. Where the shift is zero, the suffix hash picks a bucket of test strings,
their prefix hash thins it out, and comparing the bytes of all words confirms an occurrence.

The patterns go to the tasks in blocks of bounded size (block_bytes of benchmark text). A larger benchmark is
searched block after block: each search writes the hits of its block, by text, and gives up its tables before the
next begins, so no plan holds more than one search and what is broadcast does not grow with the benchmark. Items
are cut into pieces that overlap by a window less one word, and equal pieces share one entry, so neither a long
item nor one with many ids outgrows a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.common import ALNUM, Words, byte_texts, cut, key_bits, mix, ramp, slices, text_key, with_bit, without, written

WINDOW = 10
#: Benchmark text that one search holds at once; its tables take about twenty times as much.
BLOCK_BYTES = 4 << 20
#: Windows of one piece of a benchmark item.
PIECE = 4096
#: Window ends that one search pointer covers.
STRIDE = 512

_FACTORS = np.array([0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: A word of a document, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULT = ["n_words", "n_hit", "n_items", "items", "contaminated"]


class PatternClass:
    """All patterns of the same number of words, with their shift table and suffix buckets."""

    def __init__(self, patterns: list[list[bytes]], ids: list[int]):
        words = Words([b" ".join(p) for p in patterns], ALNUM)
        self.m = len(patterns[0])
        self.block = min(3, self.m)
        self.ids = np.array(ids, np.int64)
        hashes = words.hash.reshape(-1, self.m)
        self.sizes = words.size.reshape(-1, self.m)
        self.start = words.start[:: self.m]
        self.total = self.sizes.sum(1)
        self.data = words.data
        self.bits = np.uint64(64 - max(12, int(np.ceil(np.log2(16 * hashes.size + 1)))))
        self.shift = np.full(1 << (64 - int(self.bits)), self.m - self.block + 1, np.int64)
        for end in range(self.block, self.m + 1):
            slot = self.slot(self.hashed(hashes.ravel(), np.arange(len(hashes)) * self.m + end - 1, self.block))
            np.minimum.at(self.shift, slot, self.m - end)
        self.order = np.argsort(slot, kind="stable")
        self.bucket = np.searchsorted(slot[self.order], np.arange(len(self.shift) + 1)).astype(np.int32)
        self.prefix = self.hashed(hashes.ravel(), np.arange(len(hashes)) * self.m + min(2, self.m) - 1, min(2, self.m))

    @staticmethod
    def hashed(h: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n words that end at each of the given words."""
        out = h[last] * _FACTORS[0]
        for k in range(1, n):
            out = out + h[last - k] * _FACTORS[k]
        return mix(out)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.bits).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the pattern of every occurrence."""
        first = words.first
        low, high = first[:-1] + self.m - 1, first[1:]
        runs = np.maximum(0, -(-(high - low) // STRIDE))
        at = np.repeat(low, runs) + ramp(runs) * STRIDE
        end = np.minimum(at + STRIDE, np.repeat(high, runs))
        found, slots = [], []
        while at.size:
            slot = self.slot(self.hashed(words.hash, at, self.block))
            jump = self.shift[slot]
            stop = jump == 0
            if stop.any():
                found.append(at[stop])
                slots.append(slot[stop])
            at = at + np.maximum(jump, 1)
            go = at < end
            at, end = at[go], end[go]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.confirmed(words, np.concatenate(found) - self.m + 1, np.concatenate(slots))

    def confirmed(self, words: Words, start: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = (self.bucket[slot + 1] - self.bucket[slot]).astype(np.int64)
        head = self.hashed(words.hash, start + min(2, self.m) - 1, min(2, self.m))
        starts, patterns = [], []
        for a, b in pieces(count, 1 << 18):
            n = count[a:b]
            s = np.repeat(start[a:b], n)
            p = self.order[np.repeat(self.bucket[slot[a:b]].astype(np.int64), n) + ramp(n)]
            same = self.prefix[p] == np.repeat(head[a:b], n)
            s, p = s[same], p[same]
            same = (words.size[s[:, None] + np.arange(self.m)] == self.sizes[p]).all(1)
            s, p = s[same], p[same]
            for c, d in pieces(self.total[p], 1 << 20):
                n = self.total[p[c:d]]
                r = ramp(n)
                equal = words.data[np.repeat(words.start[s[c:d]], n) + r] == self.data[np.repeat(self.start[p[c:d]], n) + r]
                same = np.logical_and.reduceat(equal, np.cumsum(n) - n)
                starts.append(s[c:d][same])
                patterns.append(p[c:d][same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), self.ids[np.concatenate(patterns)]


def pieces(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges whose counts come to about limit each, one entry at least."""
    if not len(counts):
        return
    group = np.cumsum(counts) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(counts)]])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


class Patterns:
    """The windows of one block of benchmark items, by number of words, and the items of each window."""

    def __init__(self, items: list[tuple[list[str], bytes]], window: int):
        of: dict[tuple[bytes, ...], set[str]] = {}
        for names, text in items:
            words = Words([text], ALNUM)
            each = words.texts(np.arange(len(words.size)))
            for i in range(max(1, len(each) - window + 1) if each else 0):
                of.setdefault(tuple(each[i : i + window]), set()).update(names)
        self.names = [sorted(x) for x in of.values()]
        by_length: dict[int, list[tuple[int, list[bytes]]]] = {}
        for k, p in enumerate(of):
            by_length.setdefault(len(p), []).append((k, list(p)))
        self.classes = [PatternClass([p for _, p in x], [k for k, _ in x]) for _, x in sorted(by_length.items())]

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[set[str]]]:
        """Of each text: the number of words, the merged ranges of hit words (start, end, start, ...), the items."""
        words = Words(texts, ALNUM)
        ranges: list[list[int]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        edge = np.zeros(len(words.size) + 1, np.int64)
        for c in self.classes:
            start, pattern = c.search(words)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + c.m, -1)
            doc = np.searchsorted(words.first, start, "right") - 1
            pairs = np.unique(np.stack([doc, pattern], 1), axis=0)
            for d, p in pairs.tolist():
                items[d].update(self.names[p])
        inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        turn = np.flatnonzero(np.diff(inside.view(np.int8)))
        # a range cannot run over a document's end, but two documents' ranges may touch: cut there
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            d = int(np.searchsorted(words.first, a, "right")) - 1
            while a < b:
                e = min(b, int(words.first[d + 1]))
                if e > a:
                    base = int(words.first[d])
                    ranges[d] += [a - base, e - base]
                a, d = max(a, e), d + 1
        return words.counts(), ranges, items


def item_pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """piece (lower-case words, joined by blanks) and names (the items it is of) of all items: every window lies in a piece of its item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.col("text").cast("binary").alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = Words([text], ALNUM)
                each = words.texts(np.arange(len(words.size)))
                starts = range(0, max(1, len(each) - window + 1) if each else 0, PIECE)
                out = [b" ".join(each[a : a + PIECE + window - 1]) for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.string()), pa.array(out, pa.binary())], names=["name", "piece"])

    pieces = items.mapInArrow(run, "name string, piece binary")
    return cut(pieces.groupBy("piece").agg(F.collect_set("name").alias("names")))


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Patterns, bool]]:
    """Blocks of about block_bytes, dealt by hash, and whether there is only one; the driver holds one at a time."""
    pieces = item_pieces(benchmark, window)
    total = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = pieces if n == 1 else pieces.filter(F.pmod(F.xxhash64("piece"), F.lit(n)) == k)
        yield Patterns([(r.names, bytes(r.piece)) for r in part.toLocalIterator()], window), n == 1


def searched(docs: DataFrame, patterns: Patterns, only_hits: bool) -> tuple[DataFrame, Broadcast]:
    """docs with n_words, hit_ranges and items in place of text, or with only_hits those that have a hit."""
    fields = [f for f in docs.schema.fields if not (only_hits and f.name == "text")]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            counts, ranges, items = [], [], []
            for a, b in slices(texts):
                n, r, i = shared.value.hits(texts[a:b])
                counts += n.tolist()
                ranges += r
                items += [sorted(x) for x in i]
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*names, "n_words", "hit_ranges", "items"],
            )
            yield out.filter(pa.array([bool(r) for r in ranges], pa.bool_())) if only_hits else out

    return docs.mapInArrow(search, schema), shared


def block_hits(docs: DataFrame, blocks: Iterator[Patterns]) -> DataFrame:
    """tkey, ranges and items of every text with a hit in any block; each block is searched by itself."""
    texts = docs.filter(F.col("text").isNotNull()).select(text_key().alias("tkey"), "text")
    each = []
    for patterns in blocks:
        found, shared = searched(texts, patterns, True)
        by = F.struct("hit_ranges", "items")  # equal texts have equal hits
        each.append(written(found.groupBy("tkey").agg(F.first(by).alias("found"))))
        shared.destroy()
    return reduce(DataFrame.unionByName, each)


def merged(lists: list[list[int]]) -> list[int]:
    """The union of lists of ranges (start, end, start, ...) as one such list."""
    out: list[int] = []
    for a, b in sorted(x for one in lists for x in zip(one[::2], one[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def all_hits(docs: DataFrame, blocks: Iterator[Patterns]) -> DataFrame:
    """tkey, hit_ranges and items of every text with a hit, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("found").to_pylist()
            ranges = [merged([x["hit_ranges"] for x in f]) for f in found]
            items = [sorted({i for x in f for i in x["items"]}) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("tkey"), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["tkey", "hit_ranges", "items"])

    found = block_hits(docs, blocks).groupBy("tkey").agg(F.collect_list("found").alias("found"))
    return cut(found.mapInArrow(run, "tkey binary, hit_ranges array<int>, items array<string>"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window), n_items, items (sorted ids as
    text), contaminated (n_hit > 0) and hit_ranges (word ranges, start and exclusive end in turn).

    A null or empty text has no words and no hits. A benchmark row with a null text or no word is no
    pattern; a null item_id is called 'null'; repeated items count once. Repeated documents each get their
    own row. A very long text is searched in one pass of its own. An empty table gives an empty result. Input
    columns named as a result column give way to it.
    """
    docs = without(docs, [*RESULT, "hit_ranges"])
    blocks = pattern_blocks(benchmark, window, block_bytes)
    first, alone = next(blocks)
    if alone:
        found = searched(docs, first, False)[0]
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        hits = all_hits(docs, chain([first], (b for b, _ in blocks)))
        counted = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words")
        rows = with_bit(docs.select(row, text_key().alias("key"), counted), key_bits(hits), "key", "near")
        near = rows.filter("near").join(hits, F.col("key") == F.col("tkey"), "left").select("row.*", "n_words", *(F.coalesce(c, F.array()).alias(c) for c in ("hit_ranges", "items")))
        found = rows.filter("not near").select("row.*", "n_words", F.array().cast("array<int>").alias("hit_ranges"), F.array().cast("array<string>").alias("items")).unionByName(near)
    ranges = F.col("hit_ranges")
    hit = F.aggregate(F.sequence(F.lit(1), F.size(ranges), F.lit(1)), F.lit(0).cast("long"), lambda s, i: s + F.when(i % 2 == 0, 1).otherwise(-1) * F.element_at(ranges, i))
    n_hit = F.when(F.size(ranges) > 0, hit).otherwise(F.lit(0).cast("long"))
    out = found.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size(ranges) > 0).alias("contaminated"), "hit_ranges")
    return out if keep_text else out.drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit, with their own columns. Null texts and texts without words stay, repeated rows each; an empty table gives an empty result."""
    blocks = pattern_blocks(benchmark, WINDOW, block_bytes)
    first, alone = next(blocks)
    if not alone:
        hits = cut(block_hits(docs, chain([first], (b for b, _ in blocks))).select("tkey").distinct())
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = with_bit(docs.select(row, text_key().alias("key")), key_bits(hits), "key", "near")
        near = rows.filter("near").join(hits, F.col("key") == F.col("tkey"), "left_anti")
        return rows.filter("not near").select("row.*").unionByName(near.select("row.*"))
    shared = docs.sparkSession.sparkContext.broadcast(first)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            free: list[bool] = []
            for a, b in slices(texts):
                free += [not r for r in shared.value.hits(texts[a:b])[1]]
            yield batch.filter(pa.array(free, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
