import random

import pytest
from pyspark.sql import functions as F

from pairwell.llm import ngram_join, queries
from tests.llm import helpers
from tests.oracle import assert_same


def shingles(text):
    w = helpers.words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    sets = [shingles(d[1]) for d in docs]
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    root = list(range(len(docs)))
    for _ in docs:
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(docs))]
    groups = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(docs[i][0])
    ids = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((docs[i][0], ids[root[i]], len(links[i])) for i in range(len(docs))), key=str)


def near_copies(seed=3):
    rng = random.Random(seed)
    docs = []
    for g in range(25):
        body = helpers.prose(g, rng.randrange(4, 120), 3000)
        for _ in range(rng.choice([1, 1, 2, 3, 9])):
            copy = list(body)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            docs.append((10_000 + len(docs), rng.choice([" ", ", "]).join(copy).capitalize(), "en", "s", 1))
    docs += [(1000 + i, docs[5][1], "en", "s", 1) for i in range(6)]
    rng.shuffle(docs)
    return docs


def chain():
    """Texts that link only to their neighbours, in one long component."""
    body = helpers.prose(77, 200, 5000)
    return [(2000 + i, " ".join(body[8 * i : 8 * i + 104]), "en", "s", 1) for i in range(12)]


def test_links_and_classes_equal_brute_force(spark):
    docs = near_copies() + chain() + helpers.odd_rows()
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["tkey", "class_id", "labels", "keeper"])
    got = ngram_join.joined(frame, block=4)
    assert helpers.rows_of(got, "doc_id", "class_id", "n_links") == brute(docs)
    assert any(n for *_, n in brute(docs))


def test_a_large_group_in_many_blocks(spark):
    rng = random.Random(1)
    body = helpers.prose(9, 60, 5000)
    docs = []
    for i in range(150):
        copy = list(body)
        copy[rng.randrange(len(copy))] = f"q{i}"
        docs.append((i, " ".join(copy), "en", "s", 1))
    got = ngram_join.joined(spark.createDataFrame(docs, helpers.SCHEMA), block=16)
    assert helpers.rows_of(got, "doc_id", "class_id", "n_links") == brute(docs)


def near_copies_of_one(n, words=60):
    rng = random.Random(n)
    body = helpers.prose(9, words, 5000)
    docs = []
    for i in range(n):
        copy = list(body)
        copy[rng.randrange(len(copy))] = f"q{i}"
        docs.append((i, " ".join(copy), "en", "s", 1))
    return docs


def grouped_sets(spark, docs, block):
    frame = spark.createDataFrame(docs, helpers.SCHEMA)
    texts = ngram_join.cut(ngram_join.distinct_texts(ngram_join.signatures(frame)))
    return ngram_join.shingle_sets(frame, ngram_join.blocked(texts, ngram_join.components(ngram_join.forest(texts)), block))


def test_sets_sent_grow_with_the_group_not_its_square(spark):
    n = 600
    docs = near_copies_of_one(n)
    sets = grouped_sets(spark, docs, block=2)
    blocks = sets.select("block").distinct().count()
    assert blocks >= n / 2  # each of which may hold links to all others
    assert ngram_join.units(sets, 0.8).count() <= n * (ngram_join.TILES + 10)
    got = ngram_join.joined(spark.createDataFrame(docs, helpers.SCHEMA), block=2)
    assert helpers.rows_of(got, "doc_id", "class_id", "n_links") == brute(docs)


def test_slots_are_counted_once_a_block(spark):
    """Sets that lie anywhere make no more rows than their blocks have different shingles, and twice the blocks twice as many."""
    rng = random.Random(2)
    body = rng.sample(range(1 << 60), 60)
    rows = {}
    for blocks in (10, 20):
        sets = [(i % blocks, sorted([*body[1:], rng.randrange(1 << 60)])) for i in range(blocks * 16)]
        frame = spark.createDataFrame([(k, True, ngram_join.np.array(h, "<u8").tobytes()) for k, h in sets], "block long, shared boolean, shingles binary").repartition(blocks * 4)
        counted = ngram_join.slot_rows(ngram_join.by_block(frame)).cache()
        rows[blocks] = counted.count()
        assert counted.agg(F.sum("n")).first()[0] == 60 * len(sets)
        assert rows[blocks] <= sum(len({x for k, h in sets if k == b for x in h}) for b in range(blocks))
    assert rows[20] <= 2.1 * rows[10]


def test_one_of_each(spark):
    docs = near_copies() + helpers.odd_rows()
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["tkey", "class_id", "__row"])
    kept = ngram_join.one_of_each(frame)
    assert kept.columns == frame.columns
    classes = {c for i, c, _ in brute(docs)}
    worded = [r for r in kept.collect() if helpers.words(r.text)]
    by = {}
    for i, c, _ in brute([d for d in docs if helpers.words(d[1])]):
        by.setdefault(c, []).append(i)
    assert len(worded) == len(by) and {r.doc_id for r in worded} == set(by) and classes
    assert sum(not helpers.words(r.text) for r in kept.collect()) == sum(not helpers.words(d[1]) for d in docs)


def test_empty(spark):
    assert ngram_join.joined(helpers.empty_docs(spark)).count() == 0
    assert ngram_join.one_of_each(helpers.empty_docs(spark)).count() == 0


def test_prefix_depth_reaches_the_recall():
    d = ngram_join.prefix_depth()
    reach = lambda k: 1 - (1 - ngram_join.THRESHOLD**k) ** ngram_join.TREES
    assert reach(d) >= ngram_join.RECALL > reach(d + 1) and 1 <= d <= ngram_join.DEPTH
    assert ngram_join.prefix_depth(0.1, 0.999999) == 1 and ngram_join.prefix_depth(1.0) == ngram_join.DEPTH


def test_the_weakest_link_equals_all_pairs_of_sets():
    sizes = {1: 1, 3: 2, 4: 5, 6: 1, 7: 2, 9: 1, 30: 2}
    for n in range(1, 40):
        here = {**sizes, n: sizes.get(n, 1)}
        all_links = [c / (n + m - c) for m, k in here.items() if (m, k) != (n, 1) for c in range(min(n, m) + 1) if c >= 0.8 * (n + m - c) - 1e-9]
        assert ngram_join.weakest_link(n, here, 0.8) == min(all_links, default=None)


def test_texts_close_where_their_weakest_link_reaches_the_recall():
    sizes = dict.fromkeys(range(1, 100), 9)
    closes = ngram_join.closing_depths(sizes)
    assert closes[1:4] == [8, 8, 8] and len(set(closes)) >= 4 and closes[-1] == ngram_join.prefix_depth()
    for n, d in enumerate(closes[1:-1], 1):
        weakest = ngram_join.weakest_link(n, sizes, 0.8)
        assert 1 - (1 - weakest**d) ** ngram_join.TREES >= ngram_join.RECALL
    assert ngram_join.closing_depths({7: 1, 20: 3})[7] == 0  # no other set has a size that allows a link


def test_matched_prefixes_shorten_text_by_text(spark):
    docs = near_copies() + [(i, " ".join(helpers.prose(1000 + i // 2, 5 + i // 2 % 6)) + " end" * (i % 2), "en", "s", 1) for i in range(600)]
    texts = ngram_join.distinct_texts(ngram_join.signatures(spark.createDataFrame(docs, helpers.SCHEMA))).cache()
    edges = ngram_join.forest(texts).cache()
    by = {r.depth: r.n for r in edges.groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert len(by) >= 3 and min(by) == ngram_join.prefix_depth() and all(by.values())
    assert not edges.filter("shared < depth or shared > 8").count()
    labels = {bytes(r.tkey): r.labels for r in texts.collect()}
    for r in edges.collect():  # every edge joins texts that agree in the leading bytes of a label
        assert any(ngram_join.shared_bytes(x ^ y) >= r.depth for x, y in zip(labels[bytes(r.a)], labels[bytes(r.b)], strict=True))


def test_candidates_equal_all_texts_under_one_node(spark):
    docs = near_copies(11)
    texts = ngram_join.distinct_texts(ngram_join.signatures(spark.createDataFrame(docs, helpers.SCHEMA))).cache()
    rows = [(bytes(r.tkey), r["labels"], r["size"]) for r in texts.collect()]
    sizes = {}
    for _, _, n in rows:
        sizes[n] = sizes.get(n, 0) + 1
    closes = ngram_join.closing_depths({n: k for n, k in sizes.items() if n <= ngram_join.SIZES})
    at = {k: closes[min(n, len(closes) - 1)] for k, _, n in rows}
    root = {k: k for k, *_ in rows}
    want = set()
    for i, (a, x, _) in enumerate(rows):
        for b, y, _ in rows[:i]:
            if at[a] and at[b] and any(ngram_join.shared_bytes(p ^ q) >= max(at[a], at[b]) for p, q in zip(x, y, strict=True)):
                want.add(frozenset((a, b)))
    groups = ngram_join.components(ngram_join.forest(texts).select("a", "b"))
    root |= {bytes(r.node): bytes(r.root) for r in groups.collect()}
    assert want and all(len({root[k] for k in pair}) == 1 for pair in want)


def test_weak_candidates_cost_near_linear_work(spark):
    """Texts that share half of their shingles with all others are all candidates; few of their pairs are verified."""
    n = 20_000
    body = " ".join(helpers.prose(5, 24, 5000))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(body + " "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.xxhash64("id", k).cast("string")), " ")).alias("text"))
    docs = docs.withColumn("text", F.regexp_replace("text", "-", "m")).cache()
    texts = ngram_join.cut(ngram_join.distinct_texts(ngram_join.signatures(docs)))
    groups = ngram_join.components(ngram_join.forest(texts))
    assert groups.groupBy("root").count().agg(F.max("count")).first()[0] > n / 2  # one group holds most
    sets = ngram_join.shingle_sets(docs, ngram_join.blocked(texts, groups, ngram_join.BLOCK))
    pairs = ngram_join.units(sets, 0.8).groupBy("low", "high").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0]
    assert pairs <= n * ngram_join.BLOCK
    assert ngram_join.verified(ngram_join.units(sets, 0.8), 0.8).count() == 0


def test_rare_prefixes_meet_across_every_link():
    rng = random.Random(4)
    counts = ngram_join.np.array([rng.randrange(9) for _ in range(ngram_join.SLOTS)])
    for _ in range(300):
        pool = rng.sample(range(10**12), 60)
        a, b = (ngram_join.np.unique(ngram_join.np.array(rng.sample(pool, rng.randrange(40, 61)), "<u8")) for _ in "ab")
        if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
            assert set(ngram_join.rare_prefix(a, counts, 0.8)) & set(ngram_join.rare_prefix(b, counts, 0.8))


def test_very_long_texts(spark):
    """Texts of over a megabyte, each a pass and a block of its own, and a copy that differs in some words."""
    long = [f"w{i * 7919 % 100_003}" for i in range(250_000)]
    other = [f"v{i}" if i % 20_000 == 0 else w for i, w in enumerate(long)]
    docs = [(1, " ".join(long), "en", "s", 1), (2, " ".join(other), "en", "s", 1), (3, " ".join(reversed(long)), "en", "s", 1), (4, "a" * 1_500_000, "en", "s", 1)]
    got = ngram_join.joined(spark.createDataFrame(docs, helpers.SCHEMA))
    assert helpers.rows_of(got, "doc_id", "class_id", "n_links") == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 29)], [(5, 5)]])
def test_components(spark, edges):
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = ngram_join.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == root


def test_query_equals_its_sql(spark, sf_dir):
    assert_same(queries.op2_ngram_join(spark, sf_dir), queries.OP2_SQL, sf_dir)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op2_ngram_join(spark, sf_dir)
    assert helpers.rows_of(got, "doc_id", "class_id", "n_links") == brute(docs)
    assert got.filter("keeper").agg(F.countDistinct("class_id")).first()[0] == len({c for _, c, _ in brute(docs)})
