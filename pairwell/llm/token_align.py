"""Alignment of two tokenizers' tokens by galloping intersection of their end offsets.

A text's bytes are cut by tokenizer A (byte-level BPE) and by tokenizer B (pieces with a word mark). The ends
of A's and of B's tokens are two sorted lists; the shorter drives an exponential, then binary search into the
longer. Ends found in both cut the text into groups; the rank at which an end falls into the other list gives
the range of tokens that a token overlaps, from its predecessor's rank to its own.

Neither tokenizer joins a character to a blank behind it, so a text is cut before blanks that follow a character
which is no white space, and workers remember the tokens of stretches. (A vocabulary of B that has a blank inside a
piece is refused.) Counts of linked id pairs are aggregated over the whole corpus. The most frequent pairs, HEAVY of them at
most, are looked up in a broadcast table; documents with other pairs join those with their counts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import ramp, written

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Bytes of text that one pass of the search handles.
PASS_BYTES = 1 << 18
#: Pairs of the broadcast table, of 17 bytes each.
HEAVY = 1 << 20
#: Stretches whose tokens a worker remembers; then it begins anew. And those tokenized at once.
MEMO, ENCODE = 200_000, 4096
#: Stretches that are tokenized as one text.
JOIN = 64
#: Ends of one block of the search, which begins where the block before it ended.
BLOCK = 4096
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary has for each byte: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and how the groups of an alignment are spelled."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_bpe)
        letters = byte_letters()
        with open(byte_bpe, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{piece_bpe}: a piece has a blank behind another character")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()
        self.spelled = [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for end in ends]

    def encode(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of stretches that begin with a blank, laid end to end, and how many each stretch has. A
        stretch that a tokenizer does not give back byte for byte has none. Up to JOIN of them are tokenized as one
        text, and each by itself where such a text does not come back or has a token across two of them."""
        groups = [stretches[at : at + JOIN] for at in range(0, len(stretches), JOIN)]
        texts = ["".join(g) for g in groups]
        joined = [[x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)]
        out: list[tuple[list[np.ndarray], list[np.ndarray]]] = [([], []), ([], [])]
        for g, text, *both in zip(groups, texts, *joined, strict=True):
            raw = text.encode()
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, g)) if len(raw) > len(text) else map(len, g), np.int64, len(g)))
            found = []
            apart = text == " " or any(map(str.isspace, {x[-1] for x in g[:-1]}))
            for ids, table, size in zip(both, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size), strict=True):
                if apart or b"".join(map(table.__getitem__, ids)) != raw:
                    break
                ids = np.array(ids, np.int64)
                stop = np.cumsum(size[ids])
                at = np.searchsorted(stop, ends)
                if (stop[at] != ends).any():
                    break
                found.append((ids, np.diff(at, prepend=-1)))
            for side, (ids, n) in zip(out, found if len(found) == 2 else self.each(g), strict=True):
                side[0].append(ids)
                side[1].append(n)
        return [(np.concatenate(ids), np.concatenate(n)) for ids, n in out]

    def each(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """encode() of stretches tokenized one by one."""
        sides = [[x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)], self.b.encode([s[1:] for s in stretches], num_threads=1)]
        for i, s in enumerate(stretches):
            if s == " ":  # a text's last blank, which B would take for an empty text
                sides[1][i] = [self.b.piece_to_id("▁")]
        for ids, table in zip(sides, (self.a_bytes, self.b_bytes), strict=True):
            for i, s in enumerate(stretches):
                if b"".join(map(table.__getitem__, ids[i])) != s.encode():
                    sides[0][i] = sides[1][i] = []
        return [(np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))) for ids in sides]

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """Where the ids of each stretch stand in the memo; new ones are tokenized."""
        known = list(map(self.memo.get, stretches))
        new = list(dict.fromkeys(x for x, i in zip(stretches, known, strict=True) if i is None))
        if len(self.memo) + len(new) > MEMO:
            self.forget()
            new, known = list(dict.fromkeys(stretches)), [None]
        new.sort(key=lambda x: x[-1].isspace())  # those are not joined
        made = [self.encode(new[at : at + ENCODE]) for at in range(0, len(new), ENCODE)]
        for side in (0, 1) if new else ():
            self.ids[side] = np.concatenate([self.ids[side], *(m[side][0] for m in made)])
            self.size[side] = np.concatenate([self.size[side], *(m[side][1] for m in made)])
            self.begin[side] = np.cumsum(self.size[side]) - self.size[side]
        self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
        return np.array(list(map(self.memo.__getitem__, stretches)) if new else known, np.int64)

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.ids, self.size, self.begin = ([np.zeros(0, np.int64), np.zeros(0, np.int64)] for _ in range(3))


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    """The tokenizers, loaded once a worker."""
    key = (byte_bpe, piece_bpe)
    if key not in _loaded:
        _loaded[key] = Tokenizers(*key)
    return _loaded[key]


def ranks(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of many are less than each of few, both ascending: steps double from where the last block ended, then halve."""
    out, origin = np.empty(len(few), np.int64), 0
    for at in range(0, len(few), BLOCK):
        want = few[at : at + BLOCK]
        low, high = np.full(len(want), origin), np.full(len(want), origin)
        open_, step = 0, 1  # all before open_ are bounded from above
        while open_ < len(want):
            bound = min(origin + step, len(many))
            inside = len(want) if bound == len(many) else int(np.count_nonzero(want <= many[bound]))
            high[open_:inside] = bound
            low[max(inside, open_) :] = bound
            open_, step = max(inside, open_), step * 2
        half = 1 << int((high - low).max()).bit_length()
        while half := half >> 1:
            probe = np.minimum(low + half, high)
            low = np.where(many[probe - 1] < want, probe, low)
        out[at : at + len(want)] = low
        origin = int(low[-1])
    return out


class Alignment:
    """Groups and links of the tokens of some documents, laid end to end.

    a, b: ids; a_doc, b_doc: the document of each token; links: pairs of positions in a and b whose bytes overlap.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, a_doc: np.ndarray, b_doc: np.ndarray):
        self.a, self.b, self.a_doc, self.b_doc = a, b, a_doc, b_doc
        ends = [np.cumsum(a_size), np.cumsum(b_size)]
        turned = len(b) < len(a)
        few, many = ends[::-1] if turned else ends
        rank = ranks(few, many)
        common = many[rank] == few if len(few) else np.zeros(0, bool)
        first = np.concatenate([[0], (rank + common)[:-1]]) if len(few) else rank
        n = rank - first + 1
        mine, other = np.repeat(np.arange(len(few)), n), np.repeat(first, n) + ramp(n)
        shared = np.zeros(len(many), bool)
        shared[rank[common]] = True
        self.links = (other, mine) if turned else (mine, other)
        self.a_common, self.b_common = (shared, common) if turned else (common, shared)

    def spelled(self, t: Tokenizers) -> tuple[list[str], np.ndarray]:
        """The pieces of the groups' text in order, ids with the mark that follows, and the document of each."""
        a_group, b_group = (np.cumsum(x) - x for x in (self.a_common, self.b_common))
        a_ends, b_ends = np.flatnonzero(self.a_common) + 1, np.flatnonzero(self.b_common) + 1
        a_at = np.arange(len(self.a)) + np.concatenate([[0], b_ends])[a_group]
        b_at = np.arange(len(self.b)) + a_ends[b_group] if len(self.b) else np.zeros(0, np.int64)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        doc = np.empty(len(codes), np.int64)
        codes[a_at] = self.a * 2 + self.a_common
        codes[b_at] = 2 * len(t.a_bytes) + self.b * 2 + self.b_common
        doc[a_at], doc[b_at] = self.a_doc, self.b_doc
        return list(map(t.spelled.__getitem__, codes.tolist())), doc


def stretches(text: str) -> Iterator[list[str]]:
    """The stretches of a blank and the text, in lists of about PASS_BYTES characters."""
    text, at = " " + text, 0
    while at < len(text):
        cut = _CUT.search(text, at + PASS_BYTES) if len(text) - at > PASS_BYTES else None
        end = cut.start() if cut else len(text)
        part = text[at:end]
        yield _CUT.split(part) if _ODD.search(part) else [" " + w for w in part[1:].split(" ")]
        at = end


class Found:
    """What the alignment of a batch of documents gives, document by document."""

    def __init__(self, n: int):
        self.counts = np.zeros((4, n), np.int64)  # A's tokens, B's, groups, links
        self.groups: list[list[str]] = [[] for _ in range(n)]
        self.pairs: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.bad = np.zeros(n, bool)

    def add(self, t: Tokenizers, docs: list[int], parts: list[list[str]]) -> None:
        """Aligns parts of documents, whose stretches are given."""
        if not docs:
            return
        number = t.numbers(list(chain.from_iterable(parts)))
        owner = np.repeat(docs, np.fromiter(map(len, parts), np.int64, len(parts)))
        self.bad[owner[t.size[0][number] == 0]] = True
        good = ~self.bad[owner]
        number, owner = number[good], owner[good]
        if not len(number):
            return
        sides = []
        for side in (0, 1):
            begin, n = t.begin[side][number], t.size[side][number]
            sides.append((t.ids[side][np.repeat(begin, n) + ramp(n)], np.repeat(owner, n)))
        (a, a_doc), (b, b_doc) = sides
        found = Alignment(a, b, t.a_size[a], t.b_size[b], a_doc, b_doc)
        x, y = found.links
        docs_here = len(self.bad)
        self.counts += [np.bincount(d, minlength=docs_here) for d in (a_doc, b_doc, a_doc[found.a_common], a_doc[x])]
        pieces, doc = found.spelled(t)
        local, start = np.unique(doc, return_index=True)
        for d, s, e in zip(local.tolist(), start.tolist(), [*start[1:].tolist(), len(doc)], strict=True):
            self.groups[d].append("".join(pieces[s:e]))
        links = (a[x] << 20) | b[y]
        link_doc = a_doc[x]
        local, start = np.unique(link_doc, return_index=True)
        for d, s, e in zip(local.tolist(), start.tolist(), [*start[1:].tolist(), len(link_doc)], strict=True):
            self.pairs[d].append(links[s:e])


def alignments(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (a1,a2|b1;a3|b2,b3: ids of A and B by group), pairs (distinct linked
    ids, A's times 2**20 plus B's) and times (how often each is linked), a row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(byte_bpe, piece_bpe)
        for batch in batches:
            data = batch.column("text").cast(pa.large_binary()).to_pylist()
            at = 0
            while at < len(data):  # documents of about PASS_BYTES, one at least
                end, held = at, 0
                while end < len(data) and (end == at or held + len(data[end] or b"") <= PASS_BYTES):
                    held += len(data[end] or b"")
                    end += 1
                yield of(t, batch.column("doc_id").slice(at, end - at), data[at:end])
                at = end

    def of(t: Tokenizers, ids: pa.Array, data: list[bytes | None]) -> pa.RecordBatch:
        found = Found(len(data))
        docs, parts, held = [], [], 0
        for i, raw in enumerate(data):
            try:
                text = (raw or b"").decode()
            except UnicodeDecodeError:
                text = ""
            for part in stretches(text) if text else ():
                docs.append(i)
                parts.append(part)
                held += sum(map(len, part))
                if held >= PASS_BYTES:
                    found.add(t, docs, parts)
                    docs, parts, held = [], [], 0
        found.add(t, docs, parts)
        counts = np.where(found.bad, 0, found.counts)
        groups = ["" if bad else "".join(g)[:-1] for g, bad in zip(found.groups, found.bad.tolist(), strict=True)]
        pairs, times = [], []
        for each, bad in zip(found.pairs, found.bad.tolist(), strict=True):
            p, n = np.unique(np.concatenate(each), return_counts=True) if each and not bad else (np.zeros(0, np.int64),) * 2
            pairs.append(p)
            times.append(n)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in counts), pa.array(groups, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", *COUNTS, "groups", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (rows that hold it linked) and best (no other pair of its id of A is in more) of all pairs of rows."""
    n = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 20)))  # a window has a row for each id of B at most
    return written(n.select("pair", "n", (F.col("n") == most).alias("best")))


def scored(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """rows of alignments() with n_best (links whose pair is the best of its id of A) and count_sum (the sum of counts over links)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield batch.append_column("row", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    names = [c for c in rows.columns if c not in ("pairs", "times")]
    kept = written(rows.mapInArrow(number, _with(rows, "row long")))
    counts = pair_counts(kept)
    top = counts.orderBy(F.desc("n"), "pair").limit(heavy).toArrow().sort_by("pair")
    table = kept.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            own, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            of = lambda x: np.bincount(doc[known], (x[at] * times)[known], len(size)).astype(np.int64) if len(pair) else np.zeros(len(size), np.int64)
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=len(size)))]).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~known])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*names, "row")), pa.array(of(best)), pa.array(of(n)), *rest], names=[*names, "row", "n_best", "count_sum", "pairs", "times"])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes if c not in ("pairs", "times")), "n_best long, count_sum long, pairs array<long>, times array<long>"])
    found = written(kept.select(*names, "row", "pairs", "times").mapInArrow(look_up, schema))
    whole = found.filter(F.size("pairs") == 0).select(*names, "n_best", "count_sum")
    open_ = found.filter(F.size("pairs") > 0)
    links = open_.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    own = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    late = open_.join(own, "row").select(*names, (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"))
    return whole.unionByName(late)


def _with(rows: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), more])


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, heavy: int = HEAVY, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row; with digest, groups_sha256 in place of groups.

    A text that is null or empty, or that a tokenizer does not give back byte for byte, has no tokens: zeros and
    an empty groups. Repeated rows count each, as documents of their own; of equally frequent pairs of one id of A all are best. Null ids
    stay. A text of any length is handled in stretches; memory holds its groups' text and one pass, so only a word
    of many megabytes without a blank is tokenized in one piece. An empty table gives an empty result. Further columns are
    not used.
    """
    rows, last = alignments(docs, byte_bpe, piece_bpe), "groups"
    if digest:  # before anything is written: the groups' text outweighs the document's
        last = "groups_sha256"
        rows = rows.select("doc_id", *COUNTS, F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias(last), "pairs", "times")
    return scored(rows, heavy).select("doc_id", *COUNTS, "n_best", "count_sum", last)
