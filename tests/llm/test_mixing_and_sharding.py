import bisect
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairwell.llm import mixing, queries, sharding
from tests.llm import helpers


def targets(sizes, cap=3):
    """Water filling by plain rounds; sources by code point, null last, weigh 5, 2, 1, repeating."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check_mix(rows):
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.copies >= 0
        assert (r.position <= 1) == (r.taken > 0) or r.size == 0
        assert len(r.positions) == max(1, r.copies) and list(r.positions) == sorted(r.positions)
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == round(target[s])
    assert all(r.source_size == sizes[r.source] for r in rows)


def test_mix_on_odd_rows(spark):
    docs = helpers.odd_rows() + [(100 + i, " ".join(helpers.prose(i, 5 + i % 60)), "en", ["a", "b", "c", None, "é"][i % 7 % 5], 1) for i in range(300)]
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["size", "target", "cell", "rank"])
    rows = mixing.curriculum(frame, cell_rows=16).collect()
    assert len(rows) == len(docs)
    check_mix(rows)
    again = mixing.curriculum(frame.repartition(7), cell_rows=16).collect()
    key = lambda r: str((r.doc_id, r.source, r.size, r.taken, r.position))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.curriculum(helpers.empty_docs(spark)).count() == 0
    assert all(r.taken == 0 for r in mixing.curriculum(frame.withColumn("text", F.lit(None).cast("string"))).collect())


def test_positions_are_spread_evenly_over_the_words_trained(spark):
    """Sorted by position, the words of all copies add up in proportion to it; at any of them the sources stand in the ratio of their weights then."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"), F.element_at(F.array(*map(F.lit, "abcd")), (F.col("id") % 7 % 4 + 1).cast("int")).alias("source"))
    rows = mixing.curriculum(docs).collect()
    copies = sorted((p, r.size, r.source) for r in rows if r.copies for p in r.positions)
    words = np.cumsum([n for _, n, _ in copies])
    assert np.abs(words / words[-1] - [p for p, *_ in copies]).max() < 0.01
    knots = [mixing.SCHEDULES[i % 3] for i in range(4)]
    target = {r.source: r.target for r in rows}
    grid = np.linspace(0, 1, 2001)
    rate = np.array([np.interp(grid, *zip(*k, strict=True)) for k in knots])
    rate *= (np.array([target[x] for x in "abcd"]) / rate.mean(1))[:, None]
    trained = np.cumsum(rate.sum(0)) / rate.sum()
    for low, high in ((0, 0.2), (0.4, 0.6), (0.8, 1)):
        part = rate[:, (trained >= low) & (trained <= high)].sum(1)
        got = np.array([sum(n for p, n, x in copies if x == s and low <= p <= high) for s in "abcd"])
        np.testing.assert_allclose(got / got.sum(), part / part.sum(), atol=0.01)
    assert all(r.position > 1 for r in rows if not r.taken)


def test_very_long_texts(spark):
    docs = [(1, "w " * 700_000, "en", "a", 1), (2, "x" * 1_500_000, "en", "b", 1), (3, "y z", "en", "b", 1), (4, "x" * 1_500_000, "en", "a", 1)]
    frame = spark.createDataFrame(docs, helpers.SCHEMA)
    assert helpers.rows_of(mixing.curriculum(frame), "doc_id", "size") == [(1, 700_000), (2, 1), (3, 2), (4, 1)]
    rows = {r.doc_id: r for r in sharding.shard(frame).collect()}
    assert [rows[i]["size"] for i in (1, 2, 3, 4)] == [1_400_001, 1_500_001, 4, 1_500_001] and len({(r.shard, r.slot) for r in rows.values()}) == 4


def test_schedules_shape_the_order(spark):
    """The share of a source among positions follows its schedule."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    rows = mixing.curriculum(docs, weight=lambda rank: F.lit(1.0), schedules=(((0.0, 1.0), (1.0, 0.0)), ((0.0, 0.0), (1.0, 1.0)))).collect()
    x = np.array([r.position for r in rows if r.source == "x"])
    assert (x < 0.5).mean() == pytest.approx(0.75, abs=0.01) and (x < 0.25).mean() == pytest.approx(1 - 0.75**2, abs=0.01)
    y = np.array([r.position for r in rows if r.source == "y"])
    assert (y < 0.5).mean() == pytest.approx(0.25, abs=0.01)


def test_inverse_inverts_the_integral(spark):
    for knots in mixing.SCHEDULES + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.5)),):
        got = spark.range(101).select((F.col("id") / 100).alias("u"), mixing.inverse(F.col("id") / 100, knots).alias("t")).collect()
        grid = np.linspace(0, 1, 20_001)
        w = np.interp(grid, *zip(*knots, strict=True))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        for r in got:
            assert np.interp(r.t, grid, area / area[-1]) == pytest.approx(r.u, abs=1e-6)


def test_mixed_rows(spark):
    docs = [(i, " ".join(helpers.prose(i, 10)), "en", "abc"[i % 3], 1) for i in range(90)] + helpers.odd_rows()
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["size", "__size", "copies", "place", "places", "row", "id"])
    got = mixing.mixed(frame)
    assert got.columns == frame.columns and got.filter("size <> 'mine' or __size <> 'mine' or place <> 'mine' or row <> 'mine'").count() == 0
    plan = {r.doc_id: r.copies for r in mixing.curriculum(frame).collect() if r.doc_id is not None and r.doc_id >= 10}
    seen = {}
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert {i: n for i, n in seen.items() if i in plan} == {i: n for i, n in plan.items() if n}
    assert mixing.mixed(helpers.empty_docs(spark)).count() == 0


def test_mixed_rows_equal_what_is_taken_where_ids_and_sizes_repeat(spark):
    """Words by source equal taken, up to half a document, though rows share id, source and size; every row has its own text."""
    rows = [(None, f"a{i} b c", "en", "s0", 1) for i in range(2000)] + [(7, f"x{i} y", "en", "s1", 1) for i in range(900)]
    rows += [(i, f"one{i} two three four", "en", [None, "s2"][i % 2], 1) for i in range(100)] + [(3, "same same", "en", "s1", 1)] * 50
    docs = spark.createDataFrame(rows, helpers.SCHEMA).repartition(6)
    plan = mixing.curriculum(docs, cell_rows=16).collect()
    assert len(plan) == len(rows)
    check_mix(plan)
    want, words = {}, {}
    for r in plan:
        want[r.source] = want.get(r.source, 0) + r.taken
    out = mixing.mixed(docs).collect()
    for r in out:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert all(abs(words[s] - want[s]) <= 4 for s in want)
    copies = {}
    for r in out:
        copies.setdefault(r.source, {}).setdefault(r.text, 0)
        copies[r.source][r.text] += 1
    for s, n in copies.items():  # an epoch more or less a row; the repeated row has 50
        each = [c for t, c in n.items() if t != "same same"]
        assert max(each) - min(each) <= 1 or len({r[1] for r in rows if r[3] == s}) > len(each)


def test_repetitions_of_a_key_are_numbered_in_parts(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit(3).cast("long").alias("size"), F.lit(4000).cast("long").alias("n"), F.monotonically_increasing_id().alias("tag"))
    got = mixing._numbered(rows)
    assert sorted(r.nth for r in got.collect()) == list(range(4000))


def check_shards(rows, near):
    loads = np.zeros(sharding.SHARDS)
    slots = {}
    for r in rows:
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert loads.max() - loads.min() <= near * loads.sum() / sharding.SHARDS
    return loads


def test_shards_of_odd_rows(spark):
    docs = helpers.odd_rows() + [(100 + i, "x" * (i % 50) + str(i), "en", "s", 1) for i in range(4000)]
    frame = helpers.clashing(spark.createDataFrame(docs, helpers.SCHEMA), ["shard", "slot", "range", "size", "key"])
    rows = sharding.shard(frame).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] >= 1
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in rows) == sorted((str(d[0]), len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard)
    assert sorted(map(key, rows)) == sorted(map(key, sharding.shard(frame.repartition(5)).collect()))
    assert sharding.shard(helpers.empty_docs(spark)).count() == 0
    wide = sharding.sharded_rows(frame)
    assert wide.columns == [*[c for c in frame.columns if c not in ("shard", "slot")], "shard", "slot"] and wide.count() == len(docs)


def test_shards_equal_brute_force(spark):
    """Keys, ranges and the dealing of ranges, read anew from the texts and the sampled boundaries."""
    docs = [(i, ["the cat ", "The dog ", "the ", "", "é"][i % 5] + "x" * (i % 50) + str(i % 900), "en", "s", 1) for i in range(4000)] + helpers.odd_rows()
    frame = spark.createDataFrame(docs, helpers.SCHEMA)
    keys = sharding.cut(sharding.keyed(frame, ["doc_id"]))
    plan = sharding.Plan(keys, 8)

    def key(text):
        data = (text or "").encode()
        return int(data[:4].hex().ljust(8, "0") + xxhash.xxh64_hexdigest(data, 42)[:7], 16)

    loads, of = {}, {}
    for d in docs:
        of[d[1] or ""] = bisect.bisect_right(plan.bounds.tolist(), key(d[1]))
        loads[of[d[1] or ""]] = loads.get(of[d[1] or ""], 0) + len((d[1] or "").encode()) + 1
    assert len(loads) > 100 and (plan.pieces == 1).all()
    held, want = [0] * 8, {}
    for k in sorted(loads, key=lambda k: (-loads[k], k)):
        s = min(range(8), key=lambda s: (held[s], s))
        want[k], held[s] = s, held[s] + loads[k]
    rows = sharding.shard(frame).collect()
    shard_of = {}
    for r in rows:
        shard_of.setdefault((r.doc_id, r.text_crc32), set()).add(r.shard)
    assert shard_of == {(d[0], zlib.crc32((d[1] or "").encode())): {want[of[d[1] or ""]]} for d in docs}


def test_one_row_many_times_over_is_numbered_in_many_cells(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("again and again").alias("text"))
    keys = sharding.cut(sharding.keyed(rows, ["doc_id"]))
    plan = sharding.Plan(keys, 8)
    cells = sharding.with_places(keys, plan).groupBy(*sharding.PLACES).count().agg(F.max("count")).first()[0]
    assert cells <= 4 * sharding.CELL_ROWS
    check_shards(sharding.shard(rows).collect(), 9)


def test_slots_follow_a_given_order(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 977).cast("string")).alias("text"), F.concat(F.lit("f"), F.floor(F.col("id") / 10_000).cast("string")).alias("file"), (F.col("id") % 10_000).alias("nth"))
    got = sharding.sharded_rows(docs, order=(F.col("file"), F.col("nth")))
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, []).append((r.slot, r.file, r.nth))
    for rows in by.values():
        rows.sort()
        assert [s for s, *_ in rows] == list(range(len(rows))) and [x[1:] for x in rows] == sorted(x[1:] for x in rows)


def test_a_text_that_outweighs_a_shard_is_split_and_others_are_not(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("hot text " * 20).alias("text"))
    rest = spark.range(3000, 9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text " * 12), (F.col("id") % 2000).cast("string")).alias("text"))
    rows = sharding.shard(hot.unionByName(rest)).collect()
    check_shards(rows, 0.05)
    shards = {}
    for r in rows:
        shards.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) == 1 and max(map(len, shards.values())) >= 3


def test_query_mix(spark, sf_dir):
    rows = queries.op7_curriculum_mix(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(r["size"] == len(helpers.SOLID.findall(docs[r.doc_id].text)) for r in rows)
    taken, target = {}, {}
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(taken[s] == round(target[s]) for s in target)


def test_query_shards(spark):
    rows = queries.op8_sampled_shards(spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, 0.05)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_positions_are_planned_step_by_step(spark):
    """The plan holds no expression within itself many times over, which driver and executors would have to hold and compile."""
    docs = spark.createDataFrame([(i, "a b", "en", "xy"[i % 2], 1) for i in range(20)], helpers.SCHEMA)
    plan = mixing.curriculum(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000
