import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import lattice_lm, queries
from tests.llm import helpers


def tokens(text):
    return helpers.SOLID.findall(helpers.lower(text))


def brute(docs, fold=1):
    with open(lattice_lm.TOKENIZER, "rb") as f:
        model = f.read()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces, of = lattice_lm.vocabulary(model)
    train = [d for d in docs if helpers.fold(d[0]) != fold]
    c = Counter(w for d in train for w in tokens(d[1]))
    ends = len(train)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    counts = np.full(len(pieces) + 1, lattice_lm.SMOOTHING)
    counts[-1] += ends
    for w, k in c.items():
        for i in sp.encode(w):
            if of[i] >= 0:
                counts[of[i]] += k
    lp = dict(zip(pieces, np.log10(counts / counts.sum()), strict=False))
    end = math.log10(counts[-1] / counts.sum())
    longest = max(map(len, pieces))

    def word(w):
        data = b" " + w.encode()
        p = [1.0] + [0.0] * len(data)
        for i in range(1, len(data) + 1):
            p[i] = sum(p[j] * 10 ** lp[data[j:i]] for j in range(max(0, i - longest), i) if data[j:i] in lp)
        return math.log10(p[-1])

    base = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for d in docs:
        t = tokens(d[1])
        out.append((d[0], helpers.fold(d[0]) == fold, len(t) + 1, sum(c[w] > 0 for w in t) + (ends > 0), n, sum(base(c[w]) for w in t) + base(ends), sum(map(word, t)) + end))
    return sorted(out, key=lambda r: str(r[:5]))


def compare(df, docs):
    got = sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=lambda r: str(r[:5]))
    want = brute(docs)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose(sorted(r[5] for r in got), sorted(r[5] for r in want), rtol=1e-9)
    np.testing.assert_allclose(sorted(r[6] for r in got), sorted(r[6] for r in want), rtol=1e-7)


@pytest.mark.parametrize("block_bytes", [lattice_lm.BLOCK_BYTES, 500])
def test_scores_equal_brute_force(spark, block_bytes):
    docs = [(i, " ".join(helpers.prose(i, 30, 50)) + " Ünïted straße 中文 The End.", "en", "s", 1) for i in range(40)]
    docs += [r for r in helpers.odd_rows() if len(r[1] or "") < 1000] + [(77, "antidisestablishmentarianism" * 3, "en", "s", 1)]
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA).repartition(3), ["held", "block", "word", "score"])
    compare(lattice_lm.score(frame, block_bytes=block_bytes), docs)


def test_long_text_and_no_training(spark):
    got = lattice_lm.score(helpers.odd_docs(spark), held_out=F.lit(True)).collect()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0} and all(r.base_score == 0 for r in got)
    assert max(r.n_tokens for r in got) == 30_001 and all(math.isfinite(r.score) for r in got)
    assert lattice_lm.score(helpers.empty_docs(spark)).count() == 0


def test_a_word_sums_over_its_segmentations():
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b" ab"]
    p = np.full(len(pieces), 1e-3)
    p[-3:] = [0.1, 0.2, 0.3]
    got = lattice_lm.Lattice(pieces, np.log(p)).scores([b"ab", b"", b"b" * 50])
    assert got[0] == pytest.approx(math.log(0.3 + 0.1 * 1e-3 + 1e-3 * 0.2 + 1e-9)) and got[1] == pytest.approx(math.log(1e-3))
    assert got[2] == pytest.approx(51 * math.log(1e-3))


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(queries.op6_lattice_score(spark, sf_dir), docs)


@pytest.mark.parametrize("segment", [1, 7, lattice_lm.SEGMENT])
def test_long_words_equal_brute_force(monkeypatch, segment):
    monkeypatch.setattr(lattice_lm, "SEGMENT", segment)
    rng = np.random.default_rng(8)
    pieces = [bytes([b]) for b in range(256)] + sorted({rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (2, 3, 5, 9) for _ in range(40)})
    scores = np.log(rng.dirichlet(np.ones(len(pieces))))
    of = dict(zip(pieces, scores, strict=True))

    def word(w):
        data = b" " + w
        p = [0.0] + [-math.inf] * len(data)
        for i in range(1, len(data) + 1):
            p[i] = float(np.logaddexp.reduce([p[j] + of[data[j:i]] for j in range(max(0, i - 9), i) if data[j:i] in of]))
        return p[-1]

    words = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (1, 62, 63, 64, 65, 70, 333, 1000)]
    np.testing.assert_allclose(lattice_lm.Lattice(pieces, scores).scores(words), [word(w) for w in words], rtol=1e-10)


def test_very_long_texts(spark):
    """Texts of over a megabyte, one of them without a blank: the score of a word said n times over is that of its parts."""
    docs = [(1, "word " * 300_000, "en", "s", 1), (2, "中文字符" * 100_000, "en", "s", 1), (3, "a b c word", "en", "s", 1), (6, "word", "en", "s", 1), (7, "word word", "en", "s", 1)]
    got = {r.doc_id: r for r in lattice_lm.score(spark.createDataFrame(docs, helpers.SCHEMA)).collect()}
    assert got[1].n_tokens == 300_001 and got[2].n_tokens == 2 and math.isfinite(got[2].score) and got[2].score < got[6].score
    assert got[1].score - got[6].score == pytest.approx(299_999 * (got[7].score - got[6].score), rel=1e-9)
