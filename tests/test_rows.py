import json
import os

import pytest
from pyspark.sql import functions as F

from pairwell.operators import catalogue, matrix, pairing, report, selection, validation
from pairwell.sources import runs as io
from pairwell.streaming import resume

ROWS = "item_id string, condition string, pos long, correct boolean"


def frame(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def test_last_row_wins_and_pairs(spark):
    rows = frame(spark, [("a", "t", 1, False), ("a", "t", 5, True), ("a", "c", 2, False), ("b", "t", 3, None), ("b", "c", 4, True), ("d", "t", 9, True)])
    made = pairing.paired(pairing.last_wins(rows, ["item_id", "condition"]), [("x", "t", "c"), ("none", "t", "zz")], [])
    got = pairing.contingency(made, F.col("t.correct"), F.col("c.correct"), ["comparison"]).collect()
    assert [(r.comparison, r.pairs, r.treatment_only, r.control_only, r.both_correct, r.both_wrong) for r in got] == [("x", 2, 1, 1, 0, 0)]
    assert pairing.repeated(rows, ["item_id", "condition"]).collect()[0].n == 2
    with pytest.raises(Exception, match="repeated keys"):
        pairing.checked_unique(rows, ["item_id", "condition"]).collect()
    assert pairing.checked_unique(rows, ["pos"]).count() == 6


def test_empty_arms_give_no_comparison(spark):
    made = pairing.paired(frame(spark, []), [("x", "t", "c")], [])
    assert pairing.with_exact_interval(pairing.contingency(made, F.col("t.correct"), F.col("c.correct"), ["comparison"])).count() == 0


def test_ordered_pairing(spark):
    a = frame(spark, [(0, "a"), (1, "b")], "pos long, item_id string")
    b = frame(spark, [(0, "a"), (1, "x"), (2, "c")], "pos long, item_id string")
    assert pairing.ordered_mismatches(a, a).count() == 0
    assert [(r.pos, r.control_item, r.treatment_item) for r in pairing.ordered_mismatches(a, b).orderBy("pos").collect()] == [(1, "b", "x"), (2, None, "c")]


def test_exclude_before_slice(spark):
    rows = frame(spark, [(i, str(i)) for i in range(50)], "pos long, item_id string").repartition(5)
    gone = frame(spark, [("3",), ("4",)], "item_id string")
    assert [r.item_id for r in selection.sliced(rows, gone, "pos", 2, 6, 3).orderBy("pos").collect()] == ["2", "5", "6"]
    assert sorted(r["index"] for r in selection.numbered(rows, "pos").collect()) == list(range(50))
    assert selection.numbered(rows.limit(0), "pos").count() == 0


def test_samples(spark):
    keys = [f"k{i}" for i in range(20)]
    assert selection.seeded_choice(keys, 5, 7) == selection.seeded_choice(keys, 5, 7)
    with pytest.raises(ValueError):
        selection.seeded_choice(keys, 21, 7)
    rows = spark.range(20_000)
    n = selection.hashed_sample(rows, F.col("id"), 0.1, 1).count()
    assert 1_700 < n < 2_300 and n == selection.hashed_sample(rows.repartition(3), F.col("id"), 0.1, 1).count()


def test_catalogue(spark):
    assert [r.x for r in frame(spark, [(None,), (0,), (3,)], "i int").select(catalogue.catalogue_order(F.col("i")).alias("x")).collect()] == [-1, -1, 3]
    generated = frame(spark, [("a", "old"), ("b", "old")], "item_id string, note string")
    labels = frame(spark, [("a", "new")], "item_id string, note string")
    assert {r.item_id: r.note for r in catalogue.restore_labels(generated, labels, ["item_id"], ["note"]).collect()} == {"a": "new", "b": None}


def test_one_mutation_fails_the_gate(spark):
    good = [(f"i{k}", "c", k, True) for k in range(5)]
    checks = {"correct_known": F.col("correct").isNotNull()}
    for rows, passes in ((good, True), ([*good[:4], ("i4", "c", 4, None)], False)):
        df = frame(spark, rows)
        bad = validation.all_violations([validation.row_violations(df, F.col("condition"), checks), validation.group_violations(df, F.col("condition"), {"five": F.count("*") == 5})])
        assert validation.gate(bad, df.select(F.col("condition").alias("scope"))).first().passes is passes


def test_reports(spark):
    table = report.item_matrix(frame(spark, [("a", "t", 1, True)]), ["t", "c"], F.col("correct").cast("string"))
    assert [(r.item_id, r.t, r.c) for r in table.collect()] == [("a", "true", "missing row")]
    assert report.markdown(table, ["item_id", "t"]) == "| item_id | t |\n|---|---|\n| a | true |\n"


def test_sources_and_sinks(spark, tmp_path):
    rows = frame(spark, [("a", "t", 1, True), ("b", "t", 2, None)])
    out = str(tmp_path / "rows")
    io.write_runs(rows, out, sort_keys=True)
    with pytest.raises(Exception, match="exist"):
        io.write_runs(rows, out)
    back = io.read_runs(spark, [out], ROWS)
    assert sorted(r.item_id for r in back.collect()) == ["a", "b"] and all(r.source_file for r in back.collect())
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text('{"item_id": "a", "pos": 1}\n\n{"item_id": "a"} tail\n[1]\n{"item_id"\n')
    with pytest.raises(ValueError):
        io.read_runs(spark, [str(tmp_path / "d")], ROWS, recursive=True)
    lines = spark.read.text(str(tmp_path / "d"))
    good, bad = io.parsed(lines, ROWS)
    assert good.count() == 1 or good.count() == 2
    assert bad.filter(F.col("line").contains('{"item_id"\n') | (F.col("line") == '{"item_id"')).count() == 1
    inventory = io.file_inventory(spark, [str(tmp_path / "d")], "item_id").first()
    assert inventory.rows == 5 and inventory.distinct_keys == 1
    assert len(io.file_digests(spark, [str(tmp_path / "d")]).first().sha256) == 64


def test_stream_resumes(spark, tmp_path):
    schema = "run_signature string, item_id string, timestamp string, condition string, error string"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    row = {"run_signature": "s", "timestamp": "2024-01-01T00:00:00Z", "condition": "c", "error": None}
    go = lambda: resume.append_scored(resume.arriving(spark, src, schema), lambda d: d.withColumn("ok", F.lit(True)), out, ck).awaitTermination()
    (tmp_path / "in" / "1.json").write_text("".join(json.dumps(row | {"item_id": x}) + "\n" for x in ("a", "b", "a")))
    go()
    (tmp_path / "in" / "2.json").write_text("".join(json.dumps(row | {"item_id": x}) + "\n" for x in ("b", "c")))
    go()
    assert sorted(r.item_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_stream_takes_late_rows_and_no_repeats_at_any_age(spark, tmp_path):
    schema = "run_signature string, item_id string, timestamp string, condition string, error string"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    go = lambda: resume.append_scored(resume.arriving(spark, src, schema), lambda d: d.withColumn("ok", F.lit(True)), out, ck).awaitTermination()

    def arrive(name, rows, modified):
        path = tmp_path / "in" / name
        path.write_text("".join(json.dumps({"run_signature": s, "item_id": i, "timestamp": t, "condition": "c", "error": None}) + "\n" for s, i, t in rows))
        os.utime(path, (modified, modified))
        go()

    arrive("1.json", [("s", "a", "2024-03-02T00:00:00Z"), ("s", "a", "2024-03-01T00:00:00Z"), ("s", None, None)], 1_710_000_000)
    arrive("2.json", [("s", "z", "2024-03-09T00:00:00Z")], 1_710_000_100)  # no row is left before the old ones come
    arrive("3.json", [("s", "old", "2024-01-01T00:00:00Z"), ("s", "a", "2024-06-01T00:00:00Z"), ("t", "a", "2024-01-01T00:00:00Z"), ("s", None, None)], 1_700_000_000)
    arrive("4.json", [("s", "old", "2024-05-01T00:00:00Z"), ("s", "a", "2024-09-01T00:00:00Z")], 1_710_000_200)
    got = sorted((r.run_signature, r.item_id or "", r.timestamp and r.timestamp.isoformat()[:10], r.ok) for r in spark.read.parquet(out).collect())
    want = [("s", "", None, True), ("s", "a", "2024-03-01", True), ("s", "old", "2024-01-01", True), ("s", "z", "2024-03-09", True), ("t", "a", "2024-01-01", True)]
    assert got == want
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)  # stopped after the append, before the checkpoint knew
    go()
    assert spark.read.parquet(out).count() == len(want)


def test_a_batch_reads_only_its_signatures_partitions(spark, tmp_path):
    schema = "run_signature string, item_id string, timestamp string, condition string, error string"
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    go = lambda: resume.append_scored(resume.arriving(spark, src, schema), lambda d: d.withColumn("ok", F.lit(True)), out, ck).awaitTermination()
    line = lambda s, i: json.dumps({"run_signature": s, "item_id": i, "timestamp": None, "condition": "c", "error": None}) + "\n"
    (tmp_path / "in" / "1.json").write_text("".join(line(s, "a") for s in ("007", "7", "", None, "x/y=z")))
    go()
    keys = lambda: sorted(str(r.run_signature) + ":" + r.item_id for r in spark.read.parquet(out).collect())
    assert keys() == sorted(["007:a", "7:a", ":a", "None:a", "x/y=z:a"])
    (tmp_path / "in" / "2.json").write_text("".join(line(s, i) for s in ("007", "7", "", None, "x/y=z") for i in "ab"))
    go()
    assert keys() == sorted(f"{s}:{i}" for s in ("007", "7", "", None, "x/y=z") for i in "ab")
    plan = resume.not_in(spark.createDataFrame([("7", "a"), ("7", "c")], "run_signature string, item_id string"), out)
    assert [r.item_id for r in plan.collect()] == ["c"]
    assert "PartitionFilters: [isnotnull(signature_part" in plan._jdf.queryExecution().toString()


def test_windowed_progress(spark):
    rows = frame(spark, [("c", "2024-01-01 00:01:00", None), ("c", "2024-01-01 00:09:00", "x"), ("c", "2024-01-01 00:11:00", None)], "condition string, timestamp string, error string")
    got = resume.windowed_progress(rows.withColumn("timestamp", F.to_timestamp("timestamp"))).orderBy("window").collect()
    assert [(r["rows"], r.errors) for r in got] == [(2, 1), (1, 0)]


def test_joins_that_refuse(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    right = spark.createDataFrame([(1, 5), (3, 6)], "k int, y int")
    twice = right.unionAll(right.limit(1))
    assert [(r.k, r.t.x, r.c.y) for r in pairing.strict_pairs(left, right, "k").collect()] == [(1, "a", 5)]
    with pytest.raises(ValueError, match="m: no shared keys"):
        pairing.strict_pairs(left.filter("k = 2"), right, "k", "m")
    for refused, what in ((lambda: pairing.strict_pairs(left, twice, "k"), "repeated keys"), (lambda: pairing.looked_up(left, right, "k"), "no row for key: 2"), (lambda: pairing.looked_up(left, twice, "k"), "repeated keys"), (lambda: pairing.with_answers(left, twice, "k"), "repeated keys")):
        with pytest.raises(Exception, match=what):
            refused().collect()
    assert [(r.k, r.reason) for r in pairing.with_answers(left, right, "k").orderBy("k").collect()] == [(1, None), (2, "missing_ground_truth")]
    assert pairing.looked_up(left.filter("k = 1"), right, "k").first().found.y == 5


def test_matrix_names_what_differs_and_where(spark):
    expected = spark.range(50).select(F.col("id").alias("pos"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("item"), F.lit("p").alias("prompt"))
    good = expected.withColumn("c", F.lit("good"))
    lacking = expected.filter("pos <> 31").withColumn("c", F.lit("lacking"))
    double = expected.unionAll(expected.filter("pos = 4")).withColumn("c", F.lit("double"))
    more = expected.unionAll(spark.createDataFrame([(50, "i50", None)], "pos long, item string, prompt string")).withColumn("c", F.lit("more"))
    turned = expected.withColumn("item", F.concat(F.lit("i"), (49 - F.col("pos")).cast("string"))).withColumn("c", F.lit("turned"))
    rows = good.unionAll(lacking).unionAll(double).unionAll(more).unionAll(turned).repartition(5)
    got = {(r.scope, r.check, r.pos): (r.expected, r.found) for r in matrix.differences(expected, rows, "c", ["item", "prompt"]).collect()}
    assert got.pop(("lacking", "item", 31)) == ("i31", None) and got.pop(("lacking", "prompt", 31)) == ("p", None)
    assert got.pop(("double", "item", 4)) == ("i4", "i4") and got.pop(("double", "prompt", 4)) == ("p", "p")
    assert got.pop(("more", "item", 50)) == (None, "i50") and got.pop(("more", "prompt", 50)) == (None, None)
    assert len(got) == 50 and set(k[:2] for k in got) == {("turned", "item")}
    found = {(r.scope, r.check): (r.n, r.first) for r in matrix.violations(expected, rows, "c", ["item", "prompt"], ["prompt"], {"early": F.col("pos") < 50}).collect()}
    assert found == {("lacking", "same_item"): (1, 31), ("lacking", "same_prompt"): (1, 31), ("double", "same_item"): (1, 4), ("double", "same_prompt"): (1, 4), ("more", "same_item"): (1, 50), ("more", "same_prompt"): (1, 50), ("turned", "same_item"): (50, 0), ("more", "one_prompt"): (1, None), ("more", "early"): (1, 50)}
    assert matrix.differences(expected, good, "c", ["item"]).count() == 0
