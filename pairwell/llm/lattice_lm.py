"""LM scoring by the likelihood of a subword lattice.

An existing tokenizer gives the pieces; a piece's score is the log of its smoothed relative frequency in
the training documents (as the tokenizer splits them), plus all single bytes, so every text has a
segmentation. A word's probability is the sum over all segmentations, by forward recursion in log space over
its bytes: words of one length side by side, a long word by itself over the pieces that match in it. A piece that begins a word carries the blank before it, so segmentations never cross words and a
text's probability is the product over its words and one end piece.

Words are counted once per block of documents of bounded size. Blocks stay in a written table; only their
distinct words are shuffled: summed by word, scored once per distinct word of the corpus, and joined back to
the blocks. No table of words is broadcast or collected; the piece counts are, bounded by the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import SOLID, Words, byte_texts, id_fold, mix, powers, written

#: Text bytes of a block, one document at least.
BLOCK_BYTES = 8 << 20
#: Words that one lattice pass takes, by length; and cells of it at most.
LATTICE_WORDS, LATTICE_CELLS = 20_000, 400_000
#: Bytes of a word from which it is scored by itself, and start positions whose matches are looked up at once.
LONG_WORD, SEGMENT = 64, 1 << 16
#: Blocks that one task combines.
TASK_BLOCKS = 4
#: Rows of an outgoing batch of words.
WORD_ROWS = 20_000
SMOOTHING = 0.5
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for the blank before a word: no word holds it.
BLANK = b" "
_MARK = "▁"


def vocabulary(model: bytes) -> tuple[list[bytes], list[int]]:
    """The pieces of a SentencePiece model as bytes, single bytes first, and of each of its ids the piece (-1: none)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = {bytes([b]): b for b in range(256)}
    of = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            of.append(int(sp.id_to_piece(i)[3:5], 16))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            of.append(-1)
        else:
            data = sp.id_to_piece(i).replace(_MARK, " ").encode()
            of.append(pieces.setdefault(data, len(pieces)) if BLANK not in data[1:] else -1)
    return list(pieces), of


class Lattice:
    """Natural-log scores of pieces in sorted hash arrays, one per length in bytes."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        self.by_length = {}
        lengths = np.array([len(p) for p in pieces])
        for n in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join(pieces[i] for i in which), np.uint8).reshape(-1, n)
            h = np.zeros(len(which), np.uint64)
            for j in range(n):
                h = h * powers(2)[1] + data[:, j] + np.uint64(1)
            h = mix(h)
            order = np.argsort(h)
            self.by_length[n] = h[order], scores[which][order]

    def scores(self, words: list[bytes]) -> np.ndarray:
        """The log of the summed probability of all segmentations of each word, with its blank before it."""
        out = np.zeros(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = self.scan(np.frombuffer(BLANK + words[i], np.uint8))
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG_WORD]
        at = 0
        while at < len(order):
            n = int(size[order[at]])
            many = max(1, min(LATTICE_WORDS, LATTICE_CELLS // n))
            part = order[at : at + many]
            part = part[size[part] == n]
            out[part] = self.forward(np.frombuffer(b"".join(BLANK + words[i] for i in part), np.uint8).reshape(-1, n))
            at += len(part)
        return out

    def matches(self, data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Start, length and score of every piece that matches from a start in [a, b), by start."""
        h = np.zeros(b - a, np.uint64)
        found = []
        for k in range(1, max(self.by_length) + 1):
            m = min(b, len(data) - k + 1) - a
            if m <= 0:
                break
            h = h[:m] * powers(2)[1] + data[a + k - 1 : a + k - 1 + m] + np.uint64(1)
            if k in self.by_length:
                keys, scores = self.by_length[k]
                mixed = mix(h)
                at = np.minimum(np.searchsorted(keys, mixed), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == mixed)
                found.append((hit + a, np.full(len(hit), k), scores[at[hit]]))
        start, length, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], length[order], score[order]

    def scan(self, data: np.ndarray) -> float:
        """As forward(), for one long word: its matches are looked up at once, then summed from left to right."""
        n, reach = len(data), max(self.by_length) + 1
        sums = [-math.inf] * reach  # of the next positions, in a ring
        sums[0], here, own = 0.0, 0, 0.0
        for a in range(0, n, SEGMENT):
            for start, length, score in zip(*(x.tolist() for x in self.matches(data, a, min(n, a + SEGMENT))), strict=True):
                if start != here:  # single bytes are pieces, so every position is a start
                    sums[here % reach] = -math.inf
                    here = start
                    own = sums[here % reach]
                k = (start + length) % reach
                one, two = sums[k], own + score
                if one < two:
                    one, two = two, one
                sums[k] = one + math.log1p(math.exp(two - one)) if two > -math.inf else one
        return sums[n % reach]

    def forward(self, data: np.ndarray) -> np.ndarray:
        rows, n = data.shape
        base = powers(2)[1]
        longest = max(self.by_length)
        hashes, sums = np.zeros((n + 1, rows), np.uint64), np.full((n + 1, rows), -np.inf)
        sums[0] = 0
        power = powers(longest + 1)
        for i in range(1, n + 1):
            hashes[i] = hashes[i - 1] * base + data[:, i - 1] + np.uint64(1)
            total = sums[i]
            for k, (keys, scores) in self.by_length.items():
                if k > i:
                    continue
                h = mix(hashes[i] - hashes[i - k] * power[k])
                found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[found] == h)
                if len(hit):
                    total[hit] = np.logaddexp(total[hit], sums[i - k][hit] + scores[found[hit]])
        return sums[n]


def blocks(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds by block of documents. With places: a document, the numbers of its words in the
    block (int32, each as the step from the one before) and how often it has each (int32). With word: a distinct word of the block, its number (place)
    and how often training documents have it (trained)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block string, doc_id {kind}, held boolean, places binary, times binary, place int, word binary, trained long"
    names = ["block", "doc_id", "held", "places", "times", "place", "word", "trained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        prefix = TaskContext.get().partitionId()

        def flush(number: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
            block = f"{prefix}-{number}"
            words = Words(byte_texts(part["text"].combine_chunks()), SOLID)
            held = part["held"].to_numpy()
            _, index, where = np.unique(words.hash, return_index=True, return_inverse=True)
            n = len(index)
            doc = np.repeat(np.arange(len(held)), words.counts())
            pair, times = np.unique(doc * np.int64(max(1, n)) + where, return_counts=True)
            owner, place = pair // max(1, n), pair % max(1, n)
            ends = np.searchsorted(owner, np.arange(len(held) + 1)).tolist()
            times = times.astype("<i4")
            train = ~held[owner].astype(bool)
            trained = np.bincount(place[train], times[train], n).astype(np.int64)
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            steps = np.diff(place, prepend=0)  # places rise within a document: their steps are small
            heads = np.array(ends[:-1])[np.diff(ends) > 0]
            steps[heads] = place[heads]
            steps = steps.astype("<i4")
            empty = pa.nulls
            own = [part["doc_id"].combine_chunks(), part["held"].combine_chunks(), pa.array([steps[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([times[a:b].tobytes() for a, b in spans], pa.binary())]
            m = len(held)
            yield pa.RecordBatch.from_arrays([pa.array([block] * m), *own, empty(m, pa.int32()), empty(m, pa.binary()), empty(m, pa.int64())], names=names)
            for a in range(0, n, WORD_ROWS):
                which = index[a : a + WORD_ROWS]
                m = len(which)
                blank = [empty(m, own[0].type), empty(m, pa.bool_()), empty(m, pa.binary()), empty(m, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([block] * m), *blank, pa.array(np.arange(a, a + m), pa.int32()), pa.array(words.texts(which), pa.binary()), pa.array(trained[a : a + m])], names=names)

        held_back, size, number = [], 0, 0
        for batch in batches:
            start = 0
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for i, n in enumerate(sizes):
                if size and size + n > block_bytes:
                    yield from flush(number, pa.Table.from_batches([*held_back, batch.slice(start, i - start)]))
                    held_back, size, start, number = [], 0, i, number + 1
                size += n
            held_back.append(batch.slice(start))
        if sum(x.num_rows for x in held_back):
            yield from flush(number, pa.Table.from_batches(held_back))

    return docs.select("doc_id", held_out.alias("held"), "text").mapInArrow(run, schema)


def piece_counts(words: DataFrame, model: bytes, of: list[int], n: int) -> np.ndarray:
    """How often each piece stands in the training words, as the tokenizer splits them."""
    shared = words.sparkSession.sparkContext.broadcast((model, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, of = shared.value
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        to = np.array(of)
        total = np.zeros(n)
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            ids = sp.encode(texts, num_threads=1)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = to[np.fromiter((x for one in ids for x in one), np.int64, int(sizes.sum()))]
            weight = np.repeat(batch.column("c").to_numpy(zero_copy_only=False), sizes)
            total += np.bincount(flat[flat >= 0], weight[flat >= 0], n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64), pa.int64())], names=["piece", "n"])

    found = words.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n)
    out[found["piece"].to_numpy()] = found["n"].to_numpy()
    return out


def score(docs: DataFrame, held_out: Column | None = None, tokenizer: str = TOKENIZER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows that are not held out. score is the log10 marginal probability of the
    lower-cased text under the piece model; base_score that of a smoothed word unigram. A null or empty text
    is only the end token. Without any training row all counts are 0. Repeated rows count each. A very long
    text is a block of its own, and a very long word takes time in proportion to its length. An empty table gives an
    empty result. Further columns are not used.
    """
    held_out = (id_fold() == 1) if held_out is None else held_out
    with open(tokenizer, "rb") as f:
        model = f.read()
    pieces, of = vocabulary(model)
    spark = docs.sparkSession
    table = written(blocks(docs, held_out, block_bytes))
    each = table.filter("word is not null").select("block", "place", "word", "trained")
    rows = table.filter("places is not null").select(F.col("block").alias("own"), "doc_id", "held", "places", "times")
    words = written(each.groupBy("word").agg(F.sum("trained").alias("c")))
    learned = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends, many = rows.agg(F.count_if(~F.col("held")), F.count_distinct("own")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // TASK_BLOCKS)  # a task's share does not grow with the corpus
    tokens, kinds = learned.n + ends, learned.v + (ends > 0)
    counts = np.concatenate([piece_counts(words, model, of, len(pieces)), [ends]]) + SMOOTHING
    scores = np.log(counts / counts.sum())
    lattice = spark.sparkContext.broadcast(Lattice(pieces, scores[:-1]))
    end_score = float(scores[-1])
    end_base = float(np.log10((ends + 0.5) / (tokens + 0.5 * (kinds + 1))))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = lattice.value.scores(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(got)], names=["word", "c", "lp"])

    scored = words.mapInArrow(weigh, "word binary, c long, lp double")
    joined = each.select("block", "place", "word").join(scored, "word").select("block", "place", "c", "lp")

    kind = docs.schema["doc_id"].dataType.simpleString()

    def combine(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        c, lp = np.zeros(n), np.zeros(n)
        place = right["place"].to_numpy()
        c[place], lp[place] = right["c"].to_numpy(), right["lp"].to_numpy()
        base = np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))
        out = []
        for at, times in zip(left["places"].to_pylist(), left["times"].to_pylist(), strict=True):
            at, times = np.cumsum(np.frombuffer(at, "<i4")), np.frombuffer(times, "<i4").astype(np.int64)
            out.append((int(times.sum()) + 1, int(times[c[at] > 0].sum()) + (ends > 0), float((times * base[at]).sum()) + end_base, (float((times * lp[at]).sum()) + end_score) / float(np.log(10))))
        n_tokens, n_known, base_score, total = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held"],
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(out), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(total, pa.float64()),
            }
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows, joined = rows.repartition(tasks, "own"), joined.repartition(tasks, "block")
    return rows.groupBy("own").cogroup(joined.groupBy("block")).applyInArrow(combine, schema)
