import random

import pytest

from pairwell.llm import decontam, queries
from tests.llm import helpers
from tests.oracle import assert_same

ITEMS = "item_id long, text string"


def brute(docs, items, window=10):
    patterns = {}
    for i, t in items:
        w = helpers.words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            patterns.setdefault(tuple(w[k : k + window]), set()).add("null" if i is None else str(i))
    out = []
    for d in docs:
        w = helpers.words(d[1])
        hit, found = set(), set()
        for p, names in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= names
        out.append((d[0], len(w), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(5)
    items = [(i, " ".join(helpers.prose(i, n, 30))) for i, n in enumerate([12, 25, 10, 3, 1, 40, 9, 11])]
    items += [(None, "a null id has, a text of its own that counts as well"), (8, None), (9, ""), (9, "!!"), (1, items[1][1]), (10, items[1][1])]
    docs = []
    for k in range(60):
        body = helpers.prose(100 + k, rng.randrange(0, 80), 30)
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            at = rng.randrange(len(body) + 1)
            body[at:at] = text.upper().replace(" ", rng.choice([" ", ", ", "\n"])).split(" ")
        docs.append((k, " ".join(body), "en", "s", 1))
    return docs + helpers.odd_rows() + docs[:3], items


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 200])
def test_hits_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontam, "PIECE", 6 if block_bytes == 200 else decontam.PIECE)
    docs, items = planted()
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["n_words", "Items", "hit_ranges", "__items"])
    got = decontam.decontaminate(frame, spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
    assert helpers.rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items", "contaminated") == brute(docs, items)


def test_empty_tables(spark):
    docs, items = planted()
    assert decontam.decontaminate(helpers.empty_docs(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    got = decontam.decontaminate(spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame([], ITEMS))
    assert got.filter("contaminated or n_items > 0 or n_hit > 0").count() == 0 and got.count() == len(docs)


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 200])
def test_clean_keeps_what_has_no_hit(spark, block_bytes):
    docs, items = planted()
    want = sorted(b[0] for b in brute(docs, items) if not b[5] and b[0] is not None)
    got = decontam.clean(spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, ITEMS), block_bytes)
    assert got.columns == helpers.empty_docs(spark).columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == want


def test_adjacent_occurrences_in_neighbouring_documents(spark):
    docs = [(i, "a b c d e f g h i j", "en", "s", 1) for i in range(4)]
    got = decontam.decontaminate(spark.createDataFrame(docs, helpers.SCHEMA).coalesce(1), spark.createDataFrame([(7, "A b c d e f g h i j")], ITEMS))
    assert {r.n_hit for r in got.collect()} == {10}


def test_no_plan_holds_more_than_one_search(spark):
    """A benchmark of many blocks: each is searched by itself, and the result reads what they wrote."""
    docs, items = planted()
    got = decontam.decontaminate(spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, ITEMS), block_bytes=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 0
    pieces = decontam.item_pieces(spark.createDataFrame([(i, "the same text under many ids " * 3) for i in range(50)], ITEMS), 10)
    assert pieces.count() == 1 and len(pieces.first().names) == 50


def test_very_long_texts(spark):
    """A document and an item of over a megabyte; the item is cut into pieces, none of its windows is lost."""
    long = [f"w{i * 7919 % 100_003}" for i in range(250_000)]
    docs = [(1, " ".join(long), "en", "s", 1), (2, " ".join(["x", *long[4090:4106], "y"]), "en", "s", 1), (3, " ".join(reversed(long)), "en", "s", 1)]
    items = [(7, " ".join(long[:200_000]))]
    for block_bytes in (64 << 20, 1 << 20):
        got = decontam.decontaminate(spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, ITEMS), block_bytes=block_bytes)
        assert helpers.rows_of(got, "doc_id", "n_words", "n_hit", "n_items") == [(1, 250_000, 250_000, 1), (2, 18, 16, 1), (3, 250_000, 0, 0)]


def test_query(spark, sf_dir):
    assert_same(queries.op10_decontaminate(spark, sf_dir), queries.OP10_SQL, sf_dir)
