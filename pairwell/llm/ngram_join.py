"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Distinct texts are compared as sets of five-word shingles. Each of TREES trees gives a text a label of DEPTH
minimum hashes, a byte each. The labels of all texts, sorted by tree, are the forest: a prefix of d bytes is a
node of depth d, its texts lie side by side, and the bytes that a label shares with its neighbour are its
deepest match. Matching begins at full labels. Round by round a byte is dropped for the texts whose recall is
still below the target; a text closes at the depth at which the weakest link it can have, given its size and
the sizes that the corpus holds, meets in some tree with the target recall (closing_depths). A text whose size
allows no link in this corpus never enters the forest. Neighbours of which one closes are candidates, so a
node of any size gives one edge a text, never its pairs, and the sort splits anywhere, in a node or a label.

Candidates are joined to groups and dealt to blocks of bounded count and bytes, in label order. All pairs of a
block are verified exactly; two blocks of a group only if they share a shingle that is among the rarest of a
text in each, as the texts of every link across them must (rare_prefix). So groups that many weak candidates
hold together, such as texts of one template, cost little more than their blocks. Rarity is read from counts in
a fixed number of slots, which affects the cost only. Where most blocks of a group meet, as in a group of near
copies, its sets are sent by tiles of blocks, of which a group has about TILES, and not once for each other
block; tiles are bounded, so beyond TILES * TILE blocks the sets sent grow with the square again, as links do.

Verification compares 64-bit hashes of shingles, not their words: two different shingles are taken for one with
a chance of 2**-64 a pair. Copies (equal texts) are counted, not compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import ALNUM, Words, byte_texts, cut, key_bits, lean, mix, slices, text_key, with_bit, written

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.999
#: Texts of a block, and bytes of text where one block holds more than one.
BLOCK, BLOCK_BYTES = 96, 16 << 20
#: Blocks of a tile at most, and tiles that a group is dealt to until its tiles are full; a unit compares blocks of two tiles.
TILE, TILES = 8, 64
#: Sets up to this size have a closing depth of their own; sizes are told apart up to SIZES.
SHORT, SIZES = 64, 128
#: Slots of the counts that tell rare shingles.
SLOTS = 1 << 20
_FACTORS = (np.random.default_rng(20240501).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix with which a pair at the threshold shares a node of some tree with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def weakest_link(size: int, sizes: dict[int, int], threshold: float) -> float | None:
    """The least similarity, from the threshold up, that a set of this size can have with another text's set.

    sizes counts the texts of every size, this one's among them; None if no link is possible.
    """
    found = []
    for other, texts in sizes.items():
        common = math.ceil(threshold * (size + other) / (1 + threshold) - 1e-9)
        if common <= min(size, other) and texts > (other == size):
            found.append(common / (size + other - common))
    return min(found, default=None)


def closing_depths(sizes: dict[int, int], threshold: float = THRESHOLD, recall: float = RECALL) -> list[int]:
    """Of sets of size 0, 1, ... SHORT the depth at which they close, 0 for those that cannot have a link here; the last entry is for larger sets."""
    short = min(SHORT, int(SIZES * threshold) - 1)  # partners of larger ones may have more than SIZES shingles
    weakest = [weakest_link(n, sizes, threshold) for n in range(1, short + 1)]
    last = prefix_depth(threshold, recall)
    return [0, *(prefix_depth(w, recall) if w else 0 for w in weakest), *[last] * (SHORT + 1 - short)]


def shingled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles (a shorter text is one shingle) and where those of each text begin."""
    words = Words(texts, ALNUM)
    n = words.counts()
    sizes = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = words.first[doc] + np.arange(len(doc)) - starts[doc]
    left = np.minimum(n, SHINGLE)[doc]
    out = left.astype(np.uint64)
    padded = np.concatenate([words.hash, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(k < left, padded[at + k], np.uint64(0))
        out ^= out >> np.uint64(29)
    return mix(out), starts


def set_sizes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many different shingles each text has, SIZES + 1 for more than SIZES."""
    n = np.diff(starts)
    head = SIZES + SIZES // 4
    long = np.flatnonzero(n >= head)
    first = np.sort(shingles[starts[long][:, None] + np.arange(head)], axis=1)
    out = np.zeros(len(n), np.int64)
    out[long] = (first[:, 1:] != first[:, :-1]).sum(1) + 1  # most long texts show it at once
    for i in np.flatnonzero((n > 0) & (out <= SIZES)).tolist():
        out[i] = len(np.unique(shingles[starts[i] : starts[i + 1]]))
    return np.minimum(out, SIZES + 1)


def labels(texts: list[bytes]) -> tuple[list[np.ndarray | None], list[int]]:
    """The labels of each text, a 64-bit number per tree with the first hash in the leading byte, and its set size."""
    shingles, starts = shingled(texts)
    some = np.flatnonzero(np.diff(starts))
    out: list[np.ndarray | None] = [None] * len(texts)
    sizes = set_sizes(shingles, starts).tolist()
    if not len(some):
        return out, sizes
    got = np.zeros((len(some), TREES), np.uint64)
    for k, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(shingles * factor, starts[some])
        got[:, k // DEPTH] |= (mix(least) & np.uint64(255)) << np.uint64(8 * (DEPTH - 1 - k % DEPTH))
    for i, row in zip(some.tolist(), got.view(np.int64), strict=True):
        out[i] = row
    return out, sizes


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (of the text), labels (null if the text has no words), size (of its set) and bytes (of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            got: list = []
            sizes: list[int] = []
            for a, b in slices(texts):
                each, size = labels(texts[a:b])
                got += each
                sizes += size
            arrays = [batch.column("doc_id"), batch.column("tkey"), pa.array(got, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "tkey", "labels", "size", "bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("tkey"), "text").mapInArrow(lean(run), f"doc_id {kind}, tkey binary, labels array<long>, size int, bytes long")


def distinct_texts(sig: DataFrame) -> DataFrame:
    """A row for each text with words: tkey, copies, least (its least doc_id), labels, size, bytes."""
    by = sig.filter("labels is not null").groupBy("tkey")
    return by.agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("labels", "size", "bytes")))


def forest(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Candidate edges of distinct texts (tkey, labels, size): a, b, depth (the round that found them) and shared (bytes that the labels share).

    Two texts are candidates if a chain of edges joins them.
    """
    found = texts.groupBy("size").agg(F.count("*").alias("n")).collect()  # at most SIZES + 1 rows
    closes = closing_depths({r["size"]: r["n"] for r in found if r["size"] <= SIZES}, threshold, recall)
    depth = F.element_at(F.array(*map(F.lit, closes)), F.least(F.col("size"), F.lit(len(closes) - 1)) + 1)
    entries = texts.select("tkey", depth.alias("closes"), F.posexplode("labels").alias("tree", "label")).filter("closes > 0")
    order = ["tree", "label", "tkey"]
    rounds = sorted(set(closes) - {0}, reverse=True)
    schema = "a binary, b binary, depth int, shared int, tree int, label long, closes int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The edges of one stretch of the sorted labels, and of each round its first and last entry (b is null)."""
        last: dict[int, pa.RecordBatch] = {}
        for batch in batches:
            for d in rounds:
                part = batch.filter(pa.array(batch.column("closes").to_numpy() <= d))
                if not part.num_rows:
                    continue
                if d in last:
                    part = pa.Table.from_batches([last[d], part]).combine_chunks().to_batches()[0]
                else:
                    yield end_entry(part.slice(0, 1), d)
                yield neighbours(part, d)
                last[d] = part.slice(part.num_rows - 1)
        for d, part in last.items():
            yield end_entry(part, d)

    edges = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(scan), schema))
    ends = sorted((r.depth, r.tree, r.label, r.a, r.closes) for r in edges.filter("b is null").collect())  # two rows a task and round
    between = [(a, b, d, shared_bytes(x ^ y)) for (d, t, x, a, p), (e, u, y, b, q) in zip(ends, ends[1:], strict=False) if (d, t) == (e, u) and a != b and d in (p, q) and shared_bytes(x ^ y) >= d]
    edges = edges.filter("b is not null").select("a", "b", "depth", "shared")
    return edges.unionByName(edges.sparkSession.createDataFrame([(bytes(a), bytes(b), d, s) for a, b, d, s in between], edges.schema))


def shared_bytes(differ: int) -> int:
    """Leading bytes of two labels in which they agree, from the bits in which they differ."""
    return DEPTH - (((differ & (1 << 64) - 1).bit_length() + 7) // 8)


def neighbours(part: pa.RecordBatch, depth: int) -> pa.RecordBatch:
    """Edges for sorted entries that stand side by side, share a prefix of this depth, and one of which closes at it: from the first of a run of such entries to each other."""
    label, tree, closes = (part.column(c).to_numpy() for c in ("label", "tree", "closes"))
    differ = (label[1:] ^ label[:-1]).view(np.uint64)
    near = (tree[1:] == tree[:-1]) & ((closes[1:] == depth) | (closes[:-1] == depth))
    if depth < DEPTH:
        near &= differ >> np.uint64(8 * (DEPTH - depth)) == 0
    else:
        near &= differ == 0
    at = np.flatnonzero(near)
    n = len(at)
    first = np.maximum.accumulate(np.where(near, 0, np.arange(1, len(near) + 1)))[at] if n else at
    shared = [shared_bytes(int(x)) for x in differ[at]]
    key, blank = part.column("tkey"), pa.nulls
    arrays = [key.take(pa.array(first)), key.take(pa.array(at + 1)), pa.array([depth] * n, pa.int32()), pa.array(shared, pa.int32()), blank(n, pa.int32()), blank(n, pa.int64()), blank(n, pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=_EDGE)


def end_entry(part: pa.RecordBatch, depth: int) -> pa.RecordBatch:
    """An entry that begins or ends a stretch of the sorted labels, as a row of the edges' table."""
    n = part.num_rows
    arrays = [part.column("tkey"), pa.nulls(n, pa.binary()), pa.array([depth] * n, pa.int32()), pa.nulls(n, pa.int32()), *(part.column(c) for c in ("tree", "label", "closes"))]
    return pa.RecordBatch.from_arrays(arrays, names=_EDGE)


_EDGE = ["a", "b", "depth", "shared", "tree", "label", "closes"]


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node of the edges (a, b).

    Each round, every node's edges move to its least neighbour, first from the larger side, then from the
    smaller, until all point to a root; a round is aggregates and joins on the node.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # done when every node but the roots has one edge, and that to a root
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.filter("up > 1 or (up = 1 and down = 1)").limit(1).count():
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return cut(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # cut, so that the join reads two plain shuffles and Spark can split the one of a node with many edges
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
        large = cut(edges.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b")).distinct())
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low.select(F.col("a").alias("n"), "m"), F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())


def blocked(texts: DataFrame, groups: DataFrame, block: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """tkey, copies, least, root, block, tile and shared of the texts of groups (node, root): blocks of up to so many
    texts and bytes (one text at least) in label order. tile is the first block of a run of up to TILE blocks in which the
    bytes pass a multiple of block_bytes nowhere but at its end. shared says that the group has several blocks."""
    rows = groups.join(texts.withColumnRenamed("tkey", "node"), "node")
    rows = cut(rows.select(F.col("node").alias("tkey"), "copies", "least", "root", F.element_at("labels", 1).alias("label"), "bytes"))
    order = ["root", "label", "tkey"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, n, held, root = TaskContext.get().partitionId() << 40, 0, 0, None
        for batch in batches:
            out = []
            for r, size in zip(batch.column("root").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if r != root or n >= block or held + size > block_bytes:
                    name, n, held, root = name + 1, 0, 0, r
                n, held = n + 1, held + size
                out.append(name)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("tkey", "copies", "least", "root", "bytes")), pa.array(out, pa.int64())], names=["tkey", "copies", "least", "root", "bytes", "block"])

    kind = texts.schema["least"].dataType.simpleString()
    rows = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(deal), f"tkey binary, copies long, least {kind}, root binary, bytes long, block long"))
    # a row a block from here
    group = Window.partitionBy("root")
    before = group.orderBy("block")
    blocks = cut(rows.groupBy("root", "block").agg(F.sum("bytes").alias("bytes"))).withColumns({"n": F.count("*").over(group), "nth": F.row_number().over(before) - 1, "end": F.sum("bytes").over(before)})
    many = blocks.filter("n > 1").withColumns({"run": F.floor(F.col("nth") / F.least(F.lit(TILE), F.ceil(F.col("n") / TILES))), "part": F.floor((F.col("end") - F.col("bytes")) / block_bytes)})
    many = cut(many.select("block", F.min("block").over(Window.partitionBy("root", "run", "part")).alias("tile")))
    return cut(rows.join(many, "block", "left").select("tkey", "copies", "least", "root", "block", F.coalesce("tile", "block").alias("tile"), F.col("tile").isNotNull().alias("shared")))


def shingle_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members with shingles: the sorted distinct hashes of the text as 8-byte little-endian numbers.

    Of equal texts the row of the least doc_id is read. Texts whose bit no member sets are not shuffled.
    """
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), text_key().alias("tkey"), "text")
    texts = with_bit(texts, key_bits(members), "tkey", "near").filter("near")
    names = ["tkey", "copies", "root", "block", "tile", "shared"]
    rows = texts.join(members, "tkey").filter(F.col("id").eqNullSafe(F.col("least"))).groupBy("tkey").agg(*(F.first(c).alias(c) for c in (*names[1:], "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for a, b in slices(texts):
                h, starts = shingled(texts[a:b])
                sets = [np.unique(h[s:e]).astype("<u8").tobytes() for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(a, b - a) for n in names), pa.array(sets, pa.binary())], names=[*names, "shingles"])

    return written(rows.mapInArrow(lean(run), "tkey binary, copies long, root binary, block long, tile long, shared boolean, shingles binary"))


def by_block(sets: DataFrame) -> DataFrame:
    """The sets of groups of several blocks, those of a block in one task: what they have in common is then counted and listed once."""
    return written(sets.filter("shared").repartitionByRange("block"))


def slot_rows(sets: DataFrame) -> DataFrame:
    """slot and n: of each task the slots that shingles of its sets fall into, so at most a row a shingle, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            total += np.bincount(slots(np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<u8")), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["slot", "n"])

    return sets.select("shingles").mapInArrow(run, "slot int, n long")


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each of SLOTS slots."""
    found = slot_rows(sets).groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    out = np.ones(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(SLOTS)).astype(np.int64)


def rare_prefix(shingles: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles by count, then hash, so many that any set of similarity threshold or more has one of its own first ones among them."""
    n = len(shingles) - math.ceil(threshold * len(shingles) - 1e-9) + 1
    return shingles[np.lexsort((shingles, counts[slots(shingles)]))[:n]]


def block_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """low and high of the pairs of different blocks of a group that may hold a link across: they share a rare shingle."""
    shared = sets.sparkSession.sparkContext.broadcast(slot_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple[bytes, int], list[np.ndarray]] = {}
            for root, block, data in zip(*(batch.column(c).to_pylist() for c in ("root", "block", "shingles")), strict=True):
                own.setdefault((root, block), []).append(rare_prefix(np.frombuffer(data, "<u8"), shared.value, threshold))
            for (root, block), parts in own.items():
                h = np.unique(np.concatenate(parts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(h), pa.binary()), pa.array([block] * len(h), pa.int64()), pa.array(h)], names=["root", "block", "h"])

    rare = sets.select("root", "block", "shingles").mapInArrow(run, "root binary, block long, h long")
    blocks = cut(rare.groupBy("root", "h").agg(F.array_sort(F.collect_set("block")).alias("blocks")).filter(F.size("blocks") > 1).select("root", "blocks").distinct())
    # a set of blocks within its group's largest one gives no pair of its own: in a group of near copies most are
    largest = cut(blocks.groupBy("root").agg(F.max_by("blocks", F.size("blocks")).alias("all")))
    rest = blocks.join(largest, "root").filter(F.size(F.array_except("blocks", "all")) > 0).select("blocks")
    firsts = rest.unionByName(largest.select(F.col("all").alias("blocks"))).select("blocks", F.posexplode("blocks").alias("at", "low"))
    pairs = firsts.select("low", F.explode(F.slice("blocks", F.col("at") + 2, F.size("blocks"))).alias("high"))
    return written(pairs.distinct())


def units(sets: DataFrame, threshold: float) -> DataFrame:
    """The sets by unit (low, high): every block by itself, and pairs of tiles (the first block of one, the last of the other).

    against has the blocks of the unit that a set's own block is compared with, each pair of blocks on one side only:
    those that may hold a link across.
    """
    large = by_block(sets)
    tiles = cut(large.select("block", "tile").distinct()).withColumn("last", F.max("block").over(Window.partitionBy("tile")))
    pairs = block_pairs(large, threshold)
    pairs = pairs.join(tiles.select(F.col("block").alias("low"), "tile"), "low").join(tiles.select(F.col("block").alias("high"), "last"), "high")
    ends = pairs.select(F.col("low").alias("block"), "tile", "last", F.col("high").alias("other")).unionByName(pairs.select(F.col("high").alias("block"), "tile", "last", F.lit(None).cast("long").alias("other")))
    ends = cut(ends.groupBy("block", F.col("tile").alias("low"), F.col("last").alias("high")).agg(F.collect_list("other").alias("against")))
    names = ["tkey", "block", "copies", "shingles", "low", "high", "against"]
    alone = sets.withColumns({"low": F.col("block"), "high": F.col("block"), "against": F.array("block")})
    return alone.select(*names).unionByName(large.join(ends, "block").select(*names))


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """Links of the texts of each unit: tkey, hub (the least text of its linked ones here), n (linked texts), w (their copies)."""

    def compare(unit: pa.Table) -> pa.Table:
        keys = unit["tkey"].to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys = [keys[i] for i in order]
        copies = unit["copies"].to_numpy()[order]
        sets = [np.frombuffer(unit["shingles"][i].as_py(), "<u8") for i in order]
        held: dict[int, list[int]] = {}
        for i, name in enumerate(unit["block"].to_numpy()[order].tolist()):
            held.setdefault(name, []).append(i)
        near = np.zeros((len(keys), len(keys)), bool)
        for own in held.values():
            for other in unit["against"][order[own[0]]].as_py():
                rest = [] if held[other] is own else held[other]
                found = similar([sets[i] for i in own + rest], threshold)
                if rest:
                    found = found[: len(own), len(own) :]
                    near[np.ix_(rest, own)] = found.T
                near[np.ix_(own, rest or own)] = found
        n = near.sum(1)
        weight = near @ copies
        hub = np.arange(len(keys))
        while True:
            reach = np.where(near, hub[None, :], len(keys)).min(1, initial=len(keys))
            new = np.minimum(hub, reach)
            new = new[new]
            if (new == hub).all():
                break
            hub = new
        some = np.flatnonzero(n)
        return pa.table({"tkey": pa.array([keys[i] for i in some], pa.binary()), "hub": pa.array([keys[hub[i]] for i in some], pa.binary()), "n": pa.array(n[some], pa.int64()), "w": pa.array(weight[some], pa.int64())})

    return rows.groupBy("low", "high").applyInArrow(compare, "tkey binary, hub binary, n long, w long")


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted distinct arrays have a Jaccard similarity of threshold or more; the diagonal is false."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    common = np.zeros((m, m), np.int64)
    if m <= 4:
        for i in range(m):
            for j in range(i):
                common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        owner = np.repeat(np.arange(m), sizes)
        names, index, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = np.cumsum(shared) - 1
        keep = shared[index]
        row, col = owner[keep], column[index[keep]]
        by = np.argsort(col, kind="stable")
        row, col = row[by], col[by]
        width = max(1, 4_000_000 // m)
        total = np.zeros((m, m), np.float64)
        columns = int(shared.sum())
        for a in range(0, columns, width):
            s, e = np.searchsorted(col, [a, a + width])
            part = np.zeros((m, min(width, columns - a)), np.float32)
            part[row[s:e], col[s:e] - a] = 1
            total += part @ part.T
        common = np.rint(total).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    near = (union > 0) & (common >= threshold * union - 1e-9)
    np.fill_diagonal(near, False)
    return near


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links, n_copies and keeper of every row, with tkey (of its text).

    Two documents are linked if their shingle sets have a Jaccard similarity of threshold or more. class_id
    is the least doc_id of the documents connected by links. n_links counts the linked documents, copies
    included; n_text_links the linked other texts; n_copies the rows of the same text, itself included.
    keeper marks the rows of the least doc_id of a class. Words are runs of letters and digits in lower case;
    a text of fewer than five words is one shingle. A null text or one without words has no links, n_copies
    1 and its own doc_id as class. Null ids come last in a class. Repeated rows count as copies of each other.
    A very long text is a block and a pass of its own. An empty table gives an empty result. Further columns
    are not used.
    """
    docs = docs.select("doc_id", "text")
    sig = cut(signatures(docs))
    whole = classes(docs, cut(distinct_texts(sig)), threshold, recall, block)
    out = sig.select("doc_id", "tkey").join(whole.withColumnRenamed("tkey", "t"), F.col("tkey") == F.col("t"), "left")
    alone = F.col("t").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("w") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.col("n")).cast("long").alias("n_text_links"),
        F.when(alone, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"),
        (alone | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class")))).alias("keeper"),
        "tkey",
    )


def classes(docs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Of every distinct text: tkey, copies, n (linked texts), w (their copies), class (the least doc_id of its class) and leads (its text is kept)."""
    members = blocked(texts, components(forest(texts, threshold, recall)), block)
    links = cut(verified(units(shingle_sets(docs, members), threshold), threshold))
    roots = components(links.select(F.col("tkey").alias("a"), F.col("hub").alias("b")))
    # cut, so that the joins below read plain shuffles and Spark can split the one of a hot class
    counts = cut(links.groupBy("tkey").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
    linked = cut(texts.select("tkey", "copies", "least").join(counts, "tkey").join(roots.select(F.col("node").alias("tkey"), "root"), "tkey"))
    first = cut(linked.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "tkey")).alias("first")))
    linked = linked.join(first, "root").select("tkey", "n", "w", F.struct(F.col("first.least").alias("class"), (F.col("tkey") == F.col("first.tkey")).alias("leads")).alias("own"))
    out = texts.select("tkey", "copies", "least").join(cut(linked), "tkey", "left")
    zero = F.lit(0)
    by = F.col("own").isNull()
    return out.select("tkey", "copies", F.coalesce("n", zero).alias("n"), F.coalesce("w", zero).alias("w"), F.when(by, F.col("least")).otherwise(F.col("own.class")).alias("class"), F.coalesce("own.leads", F.lit(True)).alias("leads"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every class of docs, its keeper, with the columns of docs.

    Null texts and texts without words all stay; of rows that agree in id and text one stays. Only rows of texts
    with copies or links are compared with their class; the others pass. An empty table gives an empty result.
    """
    mine = docs.select("doc_id", "text")
    texts = cut(distinct_texts(cut(signatures(mine))))
    dense = cut(classes(mine, texts).filter("copies > 1 or n > 0").select("tkey", "leads"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = with_bit(docs.select(text_key().alias("__tkey"), row), key_bits(dense), "__tkey", "__near")
    match = F.col("__tkey") == F.col("tkey")
    near = keyed.filter("__near")
    alone = keyed.filter("not __near").select("__row.*").unionByName(near.join(dense, match, "left_anti").select("__row.*"))
    by = F.struct(F.col("__row.doc_id").isNull(), F.col("__row.doc_id"))
    one = near.join(dense.filter("leads"), match, "left_semi").groupBy("__tkey").agg(F.min_by("__row", by).alias("__row"))
    return alone.unionByName(one.select("__row.*"))
