import itertools
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pairwell.llm import queries, toxicity
from tests.llm.helpers import ALNUM, SCHEMA, clashing, empty_docs, odd_rows, rows_of

LABELS = "doc_id long, toxic int, quality int"
EVERY = lambda: F.lit(True)


def test_marginals_equal_all_taggings():
    rng = np.random.default_rng(0)
    move, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    sizes = [1, 5, 3, 7, 1]
    evidence = rng.normal(size=sum(sizes)) * 3
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    want = []
    for a, n in zip(first, sizes, strict=True):
        weight, on = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(start[tags[0]] + sum(move[i, j] for i, j in itertools.pairwise(tags)) + (np.array(tags) * evidence[a : a + n]).sum())
            weight += w
            on += w * np.array(tags)
        want += (on / weight).tolist()
    assert np.allclose(toxicity.marginals(evidence, first, move, start), want)


def test_stretches_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(1)
    move, start = rng.normal(size=(2, 2)) + np.eye(2) * 3, rng.normal(size=2)
    evidence, first = rng.normal(size=9000) * 4, np.array([0, 10, 5000])
    long = toxicity.marginals(evidence, first, move, start)
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    assert np.allclose(long, toxicity.marginals(evidence, first, move, start))


def test_words_and_features():
    t = toxicity.Tokens(["Über stupid-STUPID x".encode(), b"", "stupidly über".encode()])
    raw = b"\n".join(["Über stupid-STUPID x".encode(), b"", "stupidly über".encode()]) + b"\n"
    assert [raw[a:b].decode().lower() for a, b in zip(t.start, t.end, strict=True)] == ["über", "stupid", "stupid", "x", "stupidly", "über"]
    assert t.first.tolist() == [0, 4, 4, 6]
    f = t.features()[t.word]
    assert (f[1] == f[2]).all()
    shared = set(f[1].tolist()) & set(f[4].tolist()) - {0}
    assert len(shared) == 3  # the beginnings of 3, 4 and 5 bytes of both words
    assert (f[3][1:] == 0).all()


def corpus(seed, n, toxic=0.3):
    """Invented prose; toxic texts hold words that begin with blargh or are vexum, in any inflection."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randrange(1, 5))) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < toxic
        if bad:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vexum", "Vexum", "blargh" + rng.choice(syllables)]))
        rows.append((i, " ".join(words).capitalize() + ".", None, None, 0))
        labels.append((i, int(bad), 0))
    return rows, labels


def test_learns_words_and_beginnings_and_tags_their_offsets(spark):
    rows, labels = corpus(1, 700)
    model = toxicity.learned(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), EVERY())
    new = [(1, "Ta mi vexum so.", None, None, 0), (2, "ü\U0001f600 blarghest ra\nvexum, vexum", None, None, 0), (3, "ta mi so la", None, None, 0), (4, None, None, None, 0), (5, "", None, None, 0), (6, "!!", None, None, 0)]
    got = {r.doc_id: r for r in toxicity.tagged(clashing(spark.createDataFrame(new, SCHEMA), ["spans", "score"]), model).collect()}
    cut = lambda i: [new[i - 1][1][s.start : s.end] for s in got[i].spans]
    assert cut(1) == ["vexum"] and cut(2) == ["blarghest", "vexum, vexum"] and cut(3) == []
    assert got[1].predicted == 1 and got[2].predicted == 1
    assert all(got[i].predicted == 0 and 0 <= got[i].score < 0.5 for i in (3, 4, 5, 6)) and got[4].score == got[5].score == got[6].score
    held, marks = corpus(2, 300)
    found = {r.doc_id: r.predicted for r in toxicity.tagged(spark.createDataFrame(held, SCHEMA), model).collect()}
    right = [found[i] == toxic for i, toxic, _ in marks]
    assert sum(right) >= 0.95 * len(right)


def test_near_copies_teach_once(spark):
    rng = random.Random(4)
    base, labels = corpus(3, 60, 0.0)
    words = ALNUM.findall(base[0][1])
    rows = list(base)
    for i in range(60, 140):  # a toxic group of near copies, whose words are harmless
        copy = list(words)
        copy[rng.randrange(len(copy))] = f"only{i}"
        rows.append((i, " ".join(["groupword", *copy]), None, None, 0))
        labels.append((i, 1, 0))
    sample = toxicity.sampled(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), EVERY())
    assert sample.filter("toxic = 1").count() <= 3
    assert len(toxicity.triggers(sample)) == 0


def test_sample_is_bounded_and_takes_learned_rows_only(spark):
    rows, labels = corpus(6, 400, 0.5)
    rows += [(1, f"{i} of the same id {rows[i][1]}", None, None, 0) for i in range(300)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (2, 7, 0), (3, 0, 0)], LABELS)
    learn = toxicity.default_learn()
    sample = toxicity.sampled(docs, marks, learn, 40)
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    assert all(20 <= n[k] <= 70 for k in (0, 1))
    held = {r[1] for r in rows_of(docs.filter(~learn).select("doc_id", "text"), "doc_id", "text")}
    assert not held & {r.text for r in sample.collect()}


def test_no_toxic_label_and_empty_tables(spark):
    rows, labels = corpus(7, 30, 0.0)
    docs = spark.createDataFrame(rows + odd_rows(), SCHEMA)
    for marks in (spark.createDataFrame(labels, LABELS), spark.createDataFrame([], LABELS)):
        model = toxicity.learned(docs, marks, EVERY())
        got = toxicity.tagged(docs, model).collect()
        assert len(got) == len(rows) + len(odd_rows()) and all(r.predicted == 0 and r.spans == [] for r in got)
    assert toxicity.tagged(empty_docs(spark), model).count() == 0
    assert toxicity.learned(empty_docs(spark), spark.createDataFrame(labels, LABELS), EVERY()).slope >= 0


def test_a_long_text_in_pieces_is_as_in_one():
    model = toxicity.Model(move=np.array([[0.0, -6.0], [0.0, -1.0]]))
    text = (" ".join(f"w{i % 997} é vexum{i % 13}" for i in range(30_000)) + "x" * 3000).encode()
    t = toxicity.Tokens([text])
    names = np.unique(t.features()[:, 0])
    model.weights = toxicity.Sorted(names[::40], np.full(len(names[::40]), 9, np.float32))
    whole = toxicity.judged(model, [b"a", text], limit=1 << 30)
    parts = toxicity.judged(model, [b"a", text], limit=1000)
    assert np.allclose(whole[0], parts[0]) and whole[1] == parts[1] and len(whole[1][1]) > 100


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_toxic_spans(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    assert sum(p == 1 and t == 0 for p, t in held) <= 2
    assert sum(p == 1 and t == 1 for p, t in held) >= 9
    assert all(0 <= r.score <= 1 for r in got.values())
