"""Toxic spans by a linear-chain conditional random field over words.

A word's evidence is the sum of the weights of its features: the word, its beginnings and its endings. With the
weights of the transitions between clean and toxic words this is a chain of two states; forward-backward gives the marginal
chance of each word to be toxic. Runs of words whose chance is a half or more are the offending offsets, and the
marginals together, calibrated on documents not learned from, are the document's score.

Words are labelled from the labels of documents: in a bounded sample a feature counts as a trigger if it is found
in toxic documents far more often than chance allows among all features tried (a likelihood ratio), near copies counted
once; words of toxic documents with a trigger are toxic, all other words clean. The field then learns weights
for all features of the words in windows of the sample's documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import ALNUM, byte_texts, cut, id_fold, mix, slices, written
from pairwell.llm.langid import Sorted
from pairwell.llm.ngram_join import shingled

#: About so many documents of each label teach, a quarter of which calibrate.
SAMPLE_DOCS = 4000
CALIBRATION = 0.25
#: Words of a training window, and windows of a document.
WINDOW, WINDOWS = 32, 4
#: Bytes of the beginnings and endings that are features.
BEGIN, END = range(3, 11), range(3, 9)
FEATURES = 1 + len(BEGIN) + len(END)
#: The chance that any one feature is taken for a trigger though it is none, and the share of toxic documents among those with a trigger.
CHANCE, PRECISION = 0.01, 0.6
ROUNDS, RATE, DECAY = 80, 0.3, 1e-3
#: A score from here on means toxic; a word from here on is part of a span; below FAINT a word adds nothing to the document.
TOXIC, SPAN, FAINT = 0.7, 0.5, 0.05
#: Words of one stretch of the forward-backward pass.
STRETCH = 256
_BASE = np.uint64(0x100000001B3)


class Tokens:
    """The words of some texts: where each lies (bytes of the texts joined by newlines), the texts' first words, and features of the distinct ones."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        turn = np.diff(ALNUM.member[raw].view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.first = np.searchsorted(self.start, self.begin)
        self.data = ALNUM.lower[raw]
        heads, tails = self._hashes(self.start, self.end)
        name = mix(heads[-1] * _BASE + tails[-1]) + (self.end - self.start).astype(np.uint64)
        self.names, some, self.word = np.unique(name, return_index=True, return_inverse=True)
        self.sample = some  # a place of each distinct word

    def _hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Hashes of the beginnings and endings of 1, 2, ... bytes; of a shorter word, of all of it."""
        size = end - start
        heads, tails = [], []
        h, g, powers_ = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64), np.multiply.accumulate(np.array([1, *[_BASE] * max(END)], np.uint64))
        for k in range(max(BEGIN)):
            byte = self.data[np.minimum(start + k, end - 1)].astype(np.uint64) + np.uint64(1)
            h = np.where(size > k, h * _BASE + byte, h)
            heads.append(h)
        for k in range(max(END)):
            byte = self.data[np.maximum(end - 1 - k, start)].astype(np.uint64) + np.uint64(1)
            g = np.where(size > k, g + byte * powers_[k], g)
            tails.append(g)
        return heads, tails

    def features(self) -> np.ndarray:
        """Of each distinct word its FEATURES hashes, 0 where it is too short to have one."""
        start, end = self.start[self.sample], self.end[self.sample]
        heads, tails = self._hashes(start, end)
        size, out = end - start, np.zeros((len(start), FEATURES), np.uint64)
        out[:, 0] = self.names
        for i, k in enumerate(BEGIN):
            out[:, 1 + i] = np.where(size > k, mix(heads[k - 1] + np.uint64(k)), 0)
        for i, k in enumerate(END):
            out[:, 1 + len(BEGIN) + i] = np.where(size > k, mix(tails[k - 1] + np.uint64(64 + k)), 0)
        return out


def marginals(evidence: np.ndarray, first: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The chance of state 1 at each place of a chain by forward-backward.

    evidence: of state 1 against 0 at each place; first: the places where a new chain begins; move, start: log weights.
    A place where a chain begins forgets what was before it, so chains lie end to end; stretches of them are
    walked side by side, joined by the products of their transfer matrices.
    """
    n = len(evidence)
    if not n:
        return np.zeros(0)
    width = STRETCH if n > 16 * STRETCH else max(1, n // 16 + 1)
    rows = -(-n // width)
    e = np.zeros(rows * width)
    e[:n] = np.clip(evidence, -30, 30)
    fresh = np.zeros(rows * width, bool)
    fresh[first[first < n]] = True
    fresh[n:] = True
    gain, fresh = np.exp(e).reshape(rows, width), fresh.reshape(rows, width)
    m, s = np.exp(move), np.exp(start)

    def step(t: int) -> tuple[np.ndarray, ...]:
        f, g = fresh[:, t], gain[:, t]
        return np.where(f, s[0], m[0, 0]), np.where(f, s[1], m[0, 1]) * g, np.where(f, s[0], m[1, 0]), np.where(f, s[1], m[1, 1]) * g

    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(width):
        w, x, y, z = step(t)
        a, b, c, d = a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
    ahead, behind = np.empty(rows), np.empty(rows)  # shares of state 1 before a stretch, and of the weight behind it
    p = 0.5
    for r in range(rows):
        ahead[r] = p
        u, v = (1 - p) * a[r] + p * c[r], (1 - p) * b[r] + p * d[r]
        p = v / (u + v)
    q = 0.5
    for r in range(rows - 1, -1, -1):
        behind[r] = q
        u, v = a[r] * (1 - q) + b[r] * q, c[r] * (1 - q) + d[r] * q
        q = v / (u + v)
    forward = np.empty((rows, width))
    p = ahead
    for t in range(width):
        w, x, y, z = step(t)
        u, v = (1 - p) * w + p * y, (1 - p) * x + p * z
        p = v / (u + v)
        forward[:, t] = p
    out = forward
    q = behind
    for t in range(width - 1, -1, -1):
        on, off = forward[:, t] * q, (1 - forward[:, t]) * (1 - q)
        w, x, y, z = step(t)
        out[:, t] = on / (on + off)
        u, v = w * (1 - q) + x * q, y * (1 - q) + z * q
        q = v / (u + v)
    return out.reshape(-1)[:n]


@dataclass
class Model:
    weights: Sorted = field(default_factory=lambda: Sorted(np.zeros(0, np.uint64), np.zeros(0, np.float32)))
    move: np.ndarray = field(default_factory=lambda: np.array([[0.0, -30.0]] * 2))
    start: np.ndarray = field(default_factory=lambda: np.array([0.0, -30.0]))
    slope: float = 0.0
    offset: float = 0.0

    def evidence(self, tokens: Tokens) -> np.ndarray:
        hashes = tokens.features()
        at = self.weights.find(hashes.ravel())
        weights = np.append(self.weights.values, np.float32(0))[at] if len(self.weights.hashes) else np.zeros(hashes.size)
        return np.where(hashes.ravel() == 0, 0, weights).reshape(hashes.shape).sum(1)[tokens.word]

    def score(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * odds + self.offset)))


#: Log odds of a document's evidence are kept within these bounds.
LIMIT = 8.0


def gathered(chance: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds that any word of a document is toxic: of its marginals from FAINT up, else of the greatest."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    p = np.clip(chance, 1e-9, 1 - 1e-9)
    off = np.bincount(doc, np.where(p >= FAINT, np.log1p(-p), 0), n)
    most = np.zeros(n)
    np.maximum.at(most, doc, p)
    any_ = np.where(most >= FAINT, -np.expm1(off), np.maximum(most, 1e-9))
    any_ = np.clip(any_, 1e-9, 1 - 1e-9)
    return np.clip(np.log(any_) - np.log1p(-any_), -LIMIT, LIMIT)


def pieces(text: bytes, limit: int) -> Iterator[tuple[int, bytes]]:
    """Where each piece of a text begins, and the piece: about limit bytes each, cut where no word is."""
    at = 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text):
            inside = ALNUM.member[np.frombuffer(text[end : end + limit], np.uint8)]
            gap = np.flatnonzero(~inside)
            if len(gap):
                end += int(gap[0])
                break
            end += limit
        end = min(end, len(text))
        yield at, text[at:end]
        at = end
    yield at, text[at:]


def judged(model: Model, texts: list[bytes], limit: int = 1 << 20) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Log odds of each text, and its toxic spans in code points.

    Words and their evidence come piece by piece of a long text; only the chain runs over all of it.
    """
    odds, spans = [], []
    for a, b in slices(texts, limit):
        some = texts[a:b]
        if b - a == 1 and len(some[0]) > limit:
            parts = [(at, Tokens([piece])) for at, piece in pieces(some[0], limit)]
            evidence = np.concatenate([model.evidence(t) for _, t in parts])
            start, end = (np.concatenate([getattr(t, name) + at for at, t in parts]) for name in ("start", "end"))
            begin, first = np.array([0, len(some[0]) + 1]), np.array([0, len(evidence)])
            del parts
        else:
            t = Tokens(some)
            evidence, start, end, begin, first = model.evidence(t), t.start, t.end, t.begin, t.first
        chance = marginals(evidence, first[:-1][np.diff(first) > 0], model.move, model.start)
        odds.append(gathered(chance, first))
        found = np.flatnonzero(chance >= SPAN)
        each: list[list[tuple[int, int]]] = [[] for _ in some]
        doc = np.searchsorted(first, found, "right") - 1
        new = np.concatenate([[True], (np.diff(found) > 1) | (np.diff(doc) > 0)]) if len(found) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(found)) - 1
        for d in np.unique(doc).tolist():
            letters = np.cumsum((np.frombuffer(some[d], np.uint8) & 0xC0) != 0x80)
            mine = doc[heads] == d
            low, high = start[found[heads[mine]]] - begin[d], end[found[tails[mine]]] - begin[d]
            each[d] = list(zip((letters[low] - 1).tolist(), letters[high - 1].tolist(), strict=True))
        spans += each
    return (np.concatenate(odds) if odds else np.zeros(0)), spans


# learning


def sampled(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """text, toxic and held of about sample_docs labelled documents of each label, near copies once.

    labels has doc_id and toxic (1 or 0; others teach nothing; of several labels of one id the greatest counts). Ids, then distinct texts, are
    drawn by hash, so the sample is bounded even where many rows share an id. Of near copies (equal least shingles under one of
    three orders) one stays. held marks the documents to calibrate on.
    """

    def draw(name: str, *columns: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), *columns), F.lit(1 << 30)) / float(1 << 30)

    def thinned(rows: DataFrame, *columns: str) -> DataFrame:
        share = {r.toxic: min(1.0, sample_docs / r.n) for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
        return rows.filter(draw("sample", *columns) < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))

    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(learn)
    known = cut(thinned(cut(known), "doc_id")).select(F.col("doc_id").alias("id"), "toxic")  # sample_docs rows a label, so it can be broadcast
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))
    rows = rows.select("toxic", "text", F.xxhash64("text").alias("h"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            marks = np.zeros((3, len(texts)), np.int64)
            for a, b in slices(texts):
                shingles, starts = shingled(texts[a:b])
                some = np.flatnonzero(np.diff(starts))
                for k in range(3):
                    if len(some):
                        marks[k, a + some] = mix(np.minimum.reduceat(mix(shingles + np.uint64(k)), starts[some])).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("toxic", "text", "h")), *map(pa.array, marks)], names=["toxic", "text", "h", "m0", "m1", "m2"])

    rows = written(rows.mapInArrow(least, "toxic int, text string, h long, m0 long, m1 long, m2 long"))
    small = rows.drop("text")
    for k in range(3):
        small = small.groupBy(f"m{k}").agg(F.min_by(F.struct(*[c for c in small.columns if c != f"m{k}"]), F.struct("h", "toxic")).alias("x")).select(f"m{k}", "x.*")
    chosen = cut(thinned(cut(small), "h")).select("h", "toxic").distinct()
    texts = rows.join(F.broadcast(chosen), ["h", "toxic"]).groupBy("h", "toxic").agg(F.first("text").alias("text"))
    return written(texts.select("text", "toxic", (draw("part", "h") < CALIBRATION).alias("held")))


def triggers(sample: DataFrame) -> np.ndarray:
    """The sorted hashes of features that toxic documents have far more often than chance allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(byte_texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                found = np.unique(Tokens([text]).features())
                found = found[found != 0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([toxic] * len(found), pa.int32())], names=["f", "toxic"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = n.get(1, 0) / max(1, sum(n.values()))
    if not 0 < base < 1:
        return np.zeros(0, np.uint64)
    counts = cut(sample.mapInArrow(run, "f long, toxic int").groupBy("f").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")))
    bar = math.log(max(1, counts.count()) / CHANCE)
    some = counts.filter(F.col("p") * math.log(1 / base) > bar).toArrow()  # at least bar / log(1 / base) toxic documents each
    p, all_ = some["p"].to_numpy().astype(float), some["n"].to_numpy().astype(float)
    q, clean = p / all_, all_ - p
    gain = p * np.log(q / base) + np.where(clean > 0, clean * np.log(np.maximum(1 - q, 1e-12) / (1 - base)), 0)
    return np.sort(some["f"].to_numpy()[(gain > bar) & (q >= PRECISION)].view(np.uint64))


def windows(sample: DataFrame, trigger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features (windows, words, features) and labels (1 toxic, 0 clean, -1 none) of WINDOWS windows a document at most.

    Windows of toxic documents lie around their triggers first; others are spread over the text.
    """
    shared = sample.sparkSession.sparkContext.broadcast(trigger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger = shared.value
        for batch in batches:
            for text, toxic in zip(byte_texts(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                t = Tokens([text])
                n = len(t.word)
                if not n:
                    continue
                features = t.features()
                hit = np.isin(features, trigger).any(1)[t.word] & (toxic == 1)
                spread = (np.arange(WINDOWS) * n // WINDOWS).tolist()
                found = np.flatnonzero(hit)
                around = found[np.linspace(0, len(found) - 1, WINDOWS).astype(int)].tolist() if len(found) else []
                out, marks, last = [], [], -WINDOW
                for at in sorted([*spread[:: 2 if around else 1], *around]):
                    a = max(at - WINDOW // 2, last + WINDOW, 0)
                    if a >= n or a > at:
                        continue
                    last = a
                    b = min(a + WINDOW, n)
                    block = np.zeros((WINDOW, FEATURES), np.uint64)
                    block[: b - a] = features[t.word[a:b]]
                    label = np.full(WINDOW, -1, np.int8)
                    label[: b - a] = hit[a:b]
                    out.append(block.tobytes())
                    marks.append(label.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(marks, pa.binary())], names=["features", "labels"])

    found = sample.mapInArrow(run, "features binary, labels binary").toArrow().sort_by([("labels", "ascending"), ("features", "ascending")])
    x = np.frombuffer(b"".join(found["features"].to_pylist()), np.uint64).reshape(-1, WINDOW, FEATURES)
    y = np.frombuffer(b"".join(found["labels"].to_pylist()), np.int8).reshape(-1, WINDOW)
    return x, y


def trained(x: np.ndarray, y: np.ndarray) -> Model:
    """The field of greatest likelihood of labelled windows, by gradient steps of decreasing size (Adagrad)."""
    model = Model()
    if not (y == 1).any():
        return model
    names, index, count = np.unique(x, return_inverse=True, return_counts=True)
    index = index.reshape(x.shape)
    width = len(names)
    usable = (names != 0) & (count >= 2)
    weights, power = np.zeros(width), np.full(width, 1e-8)
    chain, chain_power = np.zeros(6), np.full(6, 1e-8)  # transitions 00, 01, 10, 11, start 0, 1
    real = y >= 0
    last = real.sum(1) - 1
    rows = np.arange(len(y))
    pairs = real[:, 1:]
    before, after = np.maximum(y[:, :-1], 0), np.maximum(y[:, 1:], 0)
    seen = np.array([(pairs & (before == i) & (after == j)).sum() for i in (0, 1) for j in (0, 1)] + [(y[:, 0] == i).sum() for i in (0, 1)], float)
    for _ in range(ROUNDS):
        e = np.clip(weights[index].sum(2), -30, 30)
        move, start = chain[:4].reshape(2, 2), chain[4:]
        gain = np.exp(np.stack([np.zeros_like(e), e], 2))
        forward, backward = np.empty((*y.shape, 2)), np.ones((*y.shape, 2))
        f = np.exp(start) * gain[:, 0]
        forward[:, 0] = f / f.sum(1, keepdims=True)
        for t in range(1, WINDOW):
            f = (forward[:, t - 1] @ np.exp(move)) * gain[:, t]
            forward[:, t] = f / f.sum(1, keepdims=True)
        for t in range(WINDOW - 2, -1, -1):
            b = (gain[:, t + 1] * backward[:, t + 1]) @ np.exp(move).T
            backward[:, t] = np.where((t < last)[:, None], b / b.sum(1, keepdims=True), 1.0)
        p = forward * backward
        p /= p.sum(2, keepdims=True)
        joint = forward[:, :-1, :, None] * np.exp(move) * (gain[:, 1:] * backward[:, 1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        expected = np.concatenate([joint[pairs].sum(0).ravel(), p[rows, 0].sum(0)])
        miss = np.where(real, np.maximum(y, 0) - p[:, :, 1], 0)
        slope = np.bincount(index.ravel(), np.repeat(miss.ravel(), FEATURES), width) - DECAY * weights
        slope[~usable] = 0
        power += slope**2
        weights += RATE * slope / np.sqrt(power)
        slope = seen - expected - DECAY * chain
        chain_power += slope**2
        chain += RATE * slope / np.sqrt(chain_power)
    keep = usable & (np.abs(weights) > 0.01)
    model.weights = Sorted(names[keep], weights[keep].astype(np.float32))
    model.move, model.start = chain[:4].reshape(2, 2), chain[4:]
    return model


def calibrated(model: Model, odds: np.ndarray, toxic: np.ndarray) -> Model:
    """Fits the score to the labels of documents by a logistic curve (Newton's steps, halved while they overshoot; one document of each label assumed)."""
    odds = np.concatenate([odds, [-LIMIT, LIMIT]])
    y = np.concatenate([toxic, [0, 1]]).astype(float)
    a, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def loss(a: float, b: float) -> float:
        z = a * odds + b
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * a * a)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((y - p) * odds).sum() - a, (y - p).sum()])
        h = np.array([[(w * odds * odds).sum() + 1, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-6]])
        step, now = np.linalg.solve(h, g), loss(a, b)
        while loss(a + step[0], b + step[1]) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        a, b = a + step[0], b + step[1]
    model.slope, model.offset = max(float(a), 0.0), float(b)
    return model


def learned(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled documents for whose doc_id learn holds. Without any toxic one all scores are alike and low."""
    sample = sampled(docs, labels, learn, sample_docs)
    teach = sample.filter(~F.col("held"))
    model = trained(*windows(teach, triggers(teach)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds, _ = judged(shared.value, byte_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(odds), batch.column("toxic")], names=["odds", "toxic"])

    found = sample.select("toxic", "text", "held").filter("held").mapInArrow(run, "odds double, toxic int").toArrow()
    if found.num_rows < 40:  # too few to say anything: all of the sample
        found = sample.select("toxic", "text").mapInArrow(run, "odds double, toxic int").toArrow()
    return calibrated(model, found["odds"].to_numpy(), found["toxic"].to_numpy())


def tagged(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if the score is TOXIC or more, else 0) and spans (start and end, exclusive, of toxic words in
    code points) of every row.

    A text that is null or empty, or has no words, gets the score of a text without evidence. Only the text
    decides, so repeated rows agree; null ids stay. A text of any length is one chain, its words read in pieces. An empty
    table gives an empty result. Further columns are not used.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds, spans = judged(shared.value, byte_texts(batch.column("text")))
            score = shared.value.score(odds)
            rows = [[{"start": a, "end": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= TOXIC).astype(np.int32)), pa.array(rows, pa.list_(span))], names=["doc_id", "score", "predicted", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start: long, end: long>>")


def default_learn() -> Column:
    """Documents that may teach: those outside the held-out fold of three."""
    return id_fold(folds=3) != 1
