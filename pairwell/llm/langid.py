"""Language ID by interpolated Kneser-Ney character models.

One character 5-gram model per language; the keys of all languages share one sorted hash array per order,
with one column of resolved log probabilities per language, so a position is looked up once for all
languages. A text gets the language of the lowest cross-entropy per character. Temperature and the
rejection bound are calibrated on labelled documents that the models did not learn from. Only a high
cross-entropy rejects; a text is not rejected for being torn between languages, its score tells that.

The models learn from a bounded sample (sample_docs documents a language, by hash of the id and text); counting
n-grams is a Spark job, and what reaches the driver is bounded by that sample.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.common import id_fold, lean, mix, slices, without, written

ORDER = 5
#: Labelled documents a language that the models learn from and are calibrated on, and the share of the latter.
SAMPLE_DOCS = 1200
CALIBRATION = 0.25
#: Share of calibration documents that the rejection bound may lose, and the room left beyond it.
REJECT_SHARE = 0.001
REJECT_ROOM = 1.5
UNKNOWN = "und"
RESULT = ["lang_pred", "score", "cross_entropy", "rejected"]

_SPACE, _BEGIN = 32, 1
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
_letters: tuple[np.ndarray, np.ndarray] | None = None


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case letter (or combining mark), a space for all else; whether it is a letter."""
    global _letters
    if _letters is None:
        out, real = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x32400):  # no letters lie beyond
            ch = chr(c)
            real[c] = ch.isalpha()
            if real[c] or unicodedata.category(ch) in ("Mn", "Mc"):
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out, real
    return _letters


class Characters:
    """Normalised texts in one array: words split by one space, a space at each end; ORDER marks and spaces before each text.

    at: positions of all scored characters; first: of each text the number of its first one; sizes: how
    many it has; letters: how many of its characters are letters.
    """

    def __init__(self, texts: list[str]):
        lower, real = letters()
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        codes = lower[raw]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        begins = np.concatenate([[0], ends])
        space = codes == _SPACE
        after = np.concatenate([[True], space[:-1]])[: len(codes)]
        after[begins[:-1]] = True  # the space that every text begins with
        keep = ~space | ~after
        kept = codes[keep]
        held = np.concatenate([[0], np.cumsum(keep)])[begins]
        self.sizes, self.first = np.diff(held), held[:-1]
        self.letters = np.diff(np.concatenate([[0], np.cumsum(real[raw])])[begins])
        number = np.arange(len(texts))
        self.codes = np.full(len(kept) + ORDER * len(texts), _BEGIN, np.uint32)
        self.codes[self.first + (number + 1) * ORDER - 1] = _SPACE
        self.at = np.arange(len(kept)) + np.repeat((number + 1) * ORDER, self.sizes)
        self.codes[self.at] = kept


def keys(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n characters that end at each position."""
    wide = codes.astype(np.uint64) + np.uint64(7)
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = out + wide[at - k] * _FACTORS[k]
    return mix(out)


class Sorted:
    """A sorted hash array with a row of values for each key, found through the leading bits of the hash."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order])
        bits = max(4, int(np.ceil(np.log2(len(hashes) + 1))) + 1)
        self.drop = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes >> self.drop, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each hash, -1 where there is none."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.hashes):
            return out
        top = (wanted >> self.drop).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        go = np.flatnonzero(at < end)
        at, end, want = at[go], end[go], wanted[go]
        left = go
        while len(left):
            hit = self.hashes[at] == want
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end, want = left[on], at[on] + 1, end[on], want[on]
        return out


@dataclass
class Model:
    langs: list[str]
    grams: list[Sorted] = field(default_factory=list)  # by order: log2 probabilities
    contexts: list[Sorted] = field(default_factory=list)  # by order: log2 of the weight of the next lower order
    floor: np.ndarray | None = None  # log2 probability of a character never seen
    temperature: float = 1.0
    worst: float = np.inf
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of each text in each language, its scored characters and its letters."""
        c = Characters(texts)
        n, total = len(self.langs), np.zeros((len(texts), len(self.langs)))
        if not len(c.at) or not n:
            return total, c.sizes, c.letters
        row = self.grams[-1].find(keys(c.codes, c.at, ORDER))
        seen = row >= 0
        bits = np.zeros((n, len(c.at)), np.float32)
        for k in range(n):
            bits[k, seen] = self.grams[-1].values[row[seen], k]
        left = np.flatnonzero(~seen)
        at = c.at[left]
        owed = np.zeros((len(left), n), np.float32)
        for order in range(ORDER, 0, -1):
            if order < ORDER:
                row = self.grams[order - 1].find(keys(c.codes, at, order))
                hit = row >= 0
                value = owed[hit] + self.grams[order - 1].values[row[hit]]
                bits[:, left[hit]] = value.T
                left, at, owed = left[~hit], at[~hit], owed[~hit]
            row = self.contexts[order - 1].find(keys(c.codes, at - 1, order - 1))
            owed = owed + np.where((row >= 0)[:, None], self.contexts[order - 1].values[np.maximum(row, 0)], 0)
        bits[:, left] = (owed + self.floor).T
        some = np.flatnonzero(c.sizes > 0)
        for k in range(n):
            total[some, k] = -np.add.reduceat(bits[k].astype(np.float64), c.first[some])
        return total, c.sizes, c.letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        bits, n, has = self.costs([t or "" for t in texts])
        known = has > 0
        if not self.langs:
            zero = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), zero, zero, ~known  # nothing to judge by: only texts without letters go
        best = bits.argmin(1)
        rows = np.arange(len(texts))
        per = bits[rows, best] / np.maximum(n, 1)
        odds = -(bits - bits[rows, best][:, None]) / self.temperature
        score = np.where(known, 1 / np.exp2(np.maximum(odds, -1000)).sum(1), 0.0)
        far = self.deviation(per, best, n)
        rejected = ~known | (far > self.worst)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score, np.where(known, per, 0.0), rejected

    def deviation(self, per: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standard deviations by which a cross-entropy lies above its language's, shorter texts varying more."""
        spread = self.spread[best] * np.sqrt(1 + 200 / np.maximum(n, 1))
        return (per - self.mean[best]) / spread


def estimated(langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney from counts of 5-grams (rows of code points) by language."""
    model, n = Model(langs), len(langs)
    model.floor = np.zeros(n)
    # by order, from 5 down: hash of the gram, of its context and of its suffix, by language, with its count
    level = {ORDER: (lang, grams, counts)}
    for order in range(ORDER - 1, 0, -1):
        up_lang, up, _ = level[order + 1]
        both = np.concatenate([up_lang[:, None].astype(np.uint32), up[:, 1:]], 1)
        rows, types = np.unique(both, axis=0, return_counts=True)
        level[order] = (rows[:, 0].astype(np.int64), rows[:, 1:], types)
    for order in range(1, ORDER + 1):
        which, rows, count = level[order]
        at = np.arange(len(rows)) * order + order - 1
        flat = np.ascontiguousarray(rows).ravel()
        gram = keys(flat, at, order)
        context = keys(flat, at - 1, order - 1)
        names, index = np.unique(gram, return_inverse=True)
        contexts, of = np.unique(context, return_inverse=True)
        total, types = np.zeros((n, len(contexts))), np.zeros((n, len(contexts)))
        np.add.at(total, (which, of), count)
        np.add.at(types, (which, of), 1)
        once = np.array([((count == 1) & (which == k)).sum() for k in range(n)], float)
        twice = np.array([((count == 2) & (which == k)).sum() for k in range(n)], float)
        cut = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
        weight = np.where(total > 0, cut[:, None] * types / np.maximum(total, 1), 1.0)  # no such context: all to the lower order
        p = np.zeros((n, len(names)))
        own = np.maximum(count - cut[which], 0) / total[which, of]
        np.add.at(p, (which, index), own)
        first = np.zeros(len(names), np.int64)
        first[index] = np.arange(len(index))
        if order == 1:
            lower = np.full((n, len(names)), 1 / (len(names) + 1))
            model.floor = np.full(n, np.log2(1 / (len(names) + 1)))
        else:
            suffix = keys(flat, at[first], order - 1)
            below = model.grams[-1]
            lower = np.exp2(below.values[below.find(suffix)].T.astype(np.float64))
        p += weight[:, of[first]] * lower
        model.grams.append(Sorted(names, np.log2(p).T.astype(np.float32)))
        model.contexts.append(Sorted(contexts, np.log2(np.maximum(weight, 1e-9)).T.astype(np.float32)))
    return model


def calibrated(model: Model, lang: list[str], bits: np.ndarray, n: np.ndarray) -> Model:
    """Fits the temperature by likelihood and the rejection bound by quantile on documents not learned from."""
    count = len(model.langs)
    model.mean, model.spread = np.zeros(count), np.ones(count)
    if not len(lang):
        return model
    truth = np.array([model.langs.index(x) for x in lang])
    gap = bits - bits.min(1)[:, None]
    rows = np.arange(len(truth))
    grid = np.exp2(np.arange(0, 12, 0.25))
    loss = [float((gap[rows, truth] / t + np.log2(np.exp2(-np.minimum(gap / t, 1000)).sum(1))).sum()) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    best = bits.argmin(1)
    per = bits[rows, best] / np.maximum(n, 1)
    for k in range(count):
        mine = per[best == k]
        model.mean[k] = np.median(mine) if len(mine) else np.median(per)
        model.spread[k] = max(0.05, float(np.median(np.abs(mine - model.mean[k]))) * 1.4826 if len(mine) else 1.0)
    far = model.deviation(per, best, n)
    model.worst = max(6.0, float(np.quantile(far, 1 - REJECT_SHARE)) * REJECT_ROOM)
    return model


def sampled(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """lang, text and held of about sample_docs distinct rows a language, or of all where there are no more.

    Rows are drawn by hash of the id and text, so neither repeated ids nor repeated rows thin out or swell the
    sample; a row that is repeated in full counts once. held marks the rows to calibrate on, drawn by id; further
    texts of one id are drawn each by itself.
    """
    each = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("distinct"))
    share = {r.lang: 1.0 if r.rows <= sample_docs else sample_docs / max(r.distinct, 1) for r in each.collect()}

    def draw(name: str, *columns: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), *columns), F.lit(1 << 30)) / float(1 << 30)

    if share:
        shares = F.create_map(*[F.lit(x) for k in sorted(share) for x in (k, share[k])])
        labelled = labelled.filter(draw("sample", "doc_id", "text") < shares[F.col("lang")])
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = labelled.repartition(tasks, "lang", "doc_id").groupBy("lang", "doc_id").agg(F.sort_array(F.collect_set("text")).alias("texts"))
    rows = texts.select("lang", "doc_id", F.posexplode("texts").alias("nth", "text"))
    part = F.when(F.col("nth") == 0, draw("part", "doc_id")).otherwise(draw("part", "doc_id", "text"))
    return rows.select("lang", "text", (part < CALIBRATION).alias("held"))


def learned(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the non-null languages of the rows of docs for which learn holds (a null text teaches nothing).

    It learns from sampled() rows. A language all of whose rows would be held back learns from them instead.
    Without any labelled row with a letter the model has no language, predicts und and rejects only texts without letters.
    """
    sample = written(sampled(docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text"), sample_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for name in sorted(set(lang)):
                c = Characters([t for t, x in zip(text, lang, strict=True) if x == name])
                if not len(c.at):
                    continue
                rows = np.lib.stride_tricks.sliding_window_view(c.codes, ORDER)[c.at - ORDER + 1]
                packed = np.ascontiguousarray(rows).view(f"V{4 * ORDER}").ravel()
                grams, n = np.unique(packed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array([g.tobytes() for g in grams], pa.binary()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def counted(rows: DataFrame) -> pa.Table:
        return rows.select("lang", "text").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()

    found = counted(sample.filter(~F.col("held")))
    untaught = sorted({r.lang for r in sample.select("lang").distinct().collect()} - set(found["lang"].unique().to_pylist()))
    if untaught:
        found = pa.concat_tables([found, counted(sample.filter(F.col("lang").isin(untaught)))])
    langs = sorted(found["lang"].unique().to_pylist())
    if not langs:
        return Model([])
    index = {k: i for i, k in enumerate(langs)}
    lang = np.array([index[x] for x in found["lang"].to_pylist()], np.int64)
    grams = np.frombuffer(b"".join(found["gram"].to_pylist()), np.uint32).reshape(-1, ORDER)
    model = estimated(langs, lang, grams, found["n"].to_numpy().astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, n, has = shared.value.costs(batch.column("text").to_pylist())
            some = has > 0
            yield pa.RecordBatch.from_arrays([batch.column("lang").filter(pa.array(some)), pa.array(list(bits[some]), pa.list_(pa.float64())), pa.array(n[some], pa.int64())], names=["lang", "bits", "n"])

    held = sample.filter(F.col("held") & ~F.col("lang").isin(untaught)).select("lang", "text").mapInArrow(weigh, "lang string, bits array<double>, n long").toArrow()
    bits = np.array(held["bits"].to_pylist(), float).reshape(-1, len(langs))
    return calibrated(model, held["lang"].to_pylist(), bits, held["n"].to_numpy())


def predicted(model: Model, batch: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    langs: list[str] = []
    parts: list[tuple[np.ndarray, ...]] = []
    for a, b in slices(texts, 1 << 18):
        got = model.predict(texts[a:b])
        langs += got[0]
        parts.append(got[1:])
    if not parts:
        return [], np.zeros(0), np.zeros(0), np.zeros(0, bool)
    return langs, *(np.concatenate(x) for x in zip(*parts, strict=True))


def identify(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (calibrated probability, 0 to 1), cross_entropy (bits a character) and rejected.

    A null text, or one without a letter, is und with score 0 and is rejected. Only the text decides, so
    repeated rows agree. Input columns of these names give way to the results.
    """
    docs = without(docs, RESULT)
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    names = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, per, rejected = predicted(shared.value, batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score), pa.array(per), pa.array(rejected)], names=[*names, *RESULT])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with their own columns; without a language, all with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~predicted(shared.value, batch)[3]))

    return docs.mapInArrow(lean(run), docs.schema)


def default_learn() -> Column:
    """Documents that may teach: those outside the held-out fold."""
    return id_fold() != 0
