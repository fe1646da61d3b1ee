import hashlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from pairwell.llm import queries, token_align
from tests.llm.helpers import SCHEMA, clashing, empty_docs, odd_rows

MORE = [
    (20, "<|endoftext|> <s> </s> <0x41> <unk> [INST] a<|endoftext|>b", "en", "a", 1),
    (21, "  two  blanks\n\n and \t tabs  nbsp  x ", "en", "a", 1),
    (22, "a mark ▁ that stands for a blank", "en", "a", 1),
    (23, "don't we'll I'd 1234567 $%&!! é́ ﬁ \x00 \x1c x", "en", "a", 1),
    (24, " ", "en", "a", 1),
    (25, "\n", "en", "a", 1),
    (26, "abcdefghij" * 700, "en", "a", 1),
]


@pytest.fixture(scope="module")
def both():
    return token_align.Tokenizers(token_align.BYTE_BPE, token_align.PIECE_BPE)


def plain(t, text):
    """Groups and links of a text, its ids from the whole of it at once."""
    if not text:
        return [], []
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    data = (" " + text).encode()
    if b"".join(t.a_bytes[i] for i in a) != data or b"".join(t.b_bytes[i] for i in b) != data:
        return [], []

    def spans(ids, table):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(table[i]), i))
            at += len(table[i])
        return out

    x, y = spans(a, t.a_bytes), spans(b, t.b_bytes)
    ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
    groups, low = [], 0
    for e in ends:
        groups.append(([i for s, f, i in x if low <= s and f <= e], [i for s, f, i in y if low <= s and f <= e]))
        low = e
    return groups, [(i, j) for s, f, i in x for u, v, j in y if s < v and u < f]


def expected(t, texts):
    found = [plain(t, x) for x in texts]
    n = Counter(p for _, links in found for p in set(links))
    best: dict = {}
    for (i, _), k in n.items():
        best[i] = max(best.get(i, 0), k)
    out = []
    for groups, links in found:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), said))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.mark.parametrize("heavy", [0, 7, token_align.HEAVY])
def test_equals_brute_force(spark, both, heavy):
    texts = [r for r in odd_rows() if r[0] != 7] + MORE + [(30, "w1 w2 w3 " * 60, "en", "c", 1)]
    docs = clashing(spark.createDataFrame(texts, SCHEMA).repartition(3), ["row", "pairs", "n_a", "tkey"])
    got = token_align.aligned(docs, heavy=heavy).collect()
    want = expected(both, [r[1] for r in texts])
    key = lambda i, x: (str(i), x)
    assert sorted((key(r.doc_id, tuple(r[n] for n in NAMES)) for r in got)) == sorted(key(r[0], w) for r, w in zip(texts, want, strict=True))


def test_query_on_the_given_table(spark, both, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    docs = [d for d in docs if len(d["text"] or "") < 3000]
    table = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
    got = {r.doc_id: tuple(r[n] for n in (*NAMES[:-1], "groups_sha256")) for r in token_align.aligned(table, digest=True).collect()}
    for d, w in zip(docs, expected(both, [d["text"] for d in docs]), strict=True):
        assert got[d["doc_id"]] == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
    whole = queries.op13_token_align(spark, sf_dir)
    assert whole.filter("n_links <> n_a + n_b - n_groups").count() == 0 and whole.filter("n_groups > 0").count() > 150


def test_stretches_give_the_tokens_of_the_whole(both, monkeypatch):
    monkeypatch.setattr(token_align, "PASS_BYTES", 97)
    for _, text, *_ in [*odd_rows(), *MORE]:
        if text:
            parts = list(token_align.stretches(text))
            assert "".join(s for p in parts for s in p) == " " + text
            ids = [both.encode([s for p in parts for s in p])[k][0].tolist() for k in (0, 1)]
            if "▁" not in text:
                assert ids == [both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)]


def test_ranks():
    rng = np.random.default_rng(3)
    for few, many in ((0, 0), (0, 5), (1, 1), (5, 5000), (9000, 9100), (5000, 5001)):
        x, y = (np.sort(rng.choice(20_000, n, replace=False)) for n in (few, many))
        if len(x) and len(y):
            y[-1] = max(y[-1], x[-1])
        assert token_align.ranks(x, y).tolist() == np.searchsorted(y, x).tolist()


def test_a_long_text_is_as_its_parts(spark):
    word = " ".join(f"part{i % 311} of it" for i in range(40_000))  # 0.6 million bytes
    rows = [(1, word, "en", "a", 1), (2, "\n".join([word] * 6), "en", "a", 1)]
    got = {r.doc_id: r for r in token_align.aligned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[2].n_links > 5.9 * got[1].n_links and got[2].groups.startswith(got[1].groups[:1000])
    assert got[2].n_links == got[2].n_a + got[2].n_b - got[2].n_groups


def test_empty_table(spark):
    assert token_align.aligned(empty_docs(spark)).count() == 0


def test_stretches_are_tokenized_together(both, monkeypatch):
    """Few calls' worth of texts, and the ids and counts of stretches tokenized one by one, odd ones too."""
    real, texts = both.b, []

    class Spy:
        encode = staticmethod(lambda x, **more: texts.extend(x) or real.encode(x, **more))
        piece_to_id = staticmethod(real.piece_to_id)

    monkeypatch.setattr(both, "b", Spy())
    plain_ones = [f" w{i}é" for i in range(640)]
    together = both.encode(plain_ones)
    assert len(texts) <= 640 / 32
    odd = [*plain_ones[:70], " ﬁne", "  x", " <s>", " a\n", " ", " \x1c", *plain_ones[70:90]]
    for got, want in ((together, both.each(plain_ones)), (both.encode(odd), both.each(odd))):
        for (ids, n), (a, b) in zip(got, want, strict=True):
            assert ids.tolist() == a.tolist() and n.tolist() == b.tolist()
