import json

import pytest
from pyspark.sql import functions as F

from pairwell.functions import canonical
from pairwell.operators import selection
from pairwell.sources import lines, runs

SCHEMA = "a long, b string"


@pytest.fixture()
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(folder, name, rows, end="\n"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(end.join(rows).encode() + end.encode())


def test_lines_are_numbered_across_splits(spark, tmp_path, small_splits):
    rows = ["" if i % 7 == 0 else json.dumps({"a": i, "b": "é" * (i % 50)}, ensure_ascii=False) for i in range(2000)]
    write(tmp_path / "d", "f.jsonl", rows)
    write(tmp_path / "d", "g.jsonl", rows[5:900], "\r\n")
    found = lines.numbered(lines.text_lines(spark, [str(tmp_path / "d")], True, "*.jsonl"))
    assert found.rdd.getNumPartitions() > 10
    for name, want in (("f.jsonl", rows), ("g.jsonl", rows[5:900])):
        got = {r.line: r.value for r in found.filter(F.col("source_file").endswith(name)).collect()}
        assert got == {i + 1: x for i, x in enumerate(want)}


def test_errors_name_path_and_line(spark, tmp_path, small_splits):
    good = [json.dumps({"a": i, "b": "x"}) for i in range(800)]
    for at, bad, kind, problem in ((700, '{"a": 1} x', ValueError, "invalid_json"), (600, '{"a": 1}{"b": "2"}', ValueError, "invalid_json"), (500, "[1]", TypeError, "not_object"), (400, '{"a": "one"}', ValueError, "other_schema"), (300, "not-json", ValueError, "invalid_json"), (200, " {}", ValueError, "invalid_json")):
        good[at] = bad
        write(tmp_path / "d", "f.jsonl", good)
        with pytest.raises(kind, match=rf"f\.jsonl:{at + 1}: "):
            lines.read_lines(spark, [str(tmp_path / "d")], SCHEMA)
        _, found = lines.collected_lines(spark, [str(tmp_path / "d")], SCHEMA)
        assert found.orderBy("line").first().problem == problem
    rows, bad = lines.collected_lines(spark, [str(tmp_path / "d")], SCHEMA, objects=False)
    assert rows.count() == 794 and bad.count() == 5
    with pytest.raises(ValueError, match="201"):
        runs.read_runs(spark, [str(tmp_path / "d")], SCHEMA)
    assert lines.read_lines(spark, [str(tmp_path / "d")], SCHEMA, strict=False).count() == 794


def test_blank_lines_of_all_kinds_and_python_numbers(spark):
    frame = spark.createDataFrame([(v,) for v in ("", "\t", "  \x1c ", None, '{"a": NaN}', '{"a": 1, "a": 2}', ' {"b": "y"}\t')], "value string")
    good, bad = lines.split_lines(frame, "a double, b string")
    assert good.count() == 3 and bad.count() == 0


def test_documents_and_manifests(spark, tmp_path):
    d = tmp_path / "docs"
    write(d, "a.json", ["{", '  "k": [1,', "2]", "}"])
    write(d, "b.json", ["[1]"])
    write(d, "c.json", ["{"])
    write(d, "d.json", [""])
    got = {r.source_file[-6:]: r.problem for r in lines.documents(spark, [str(d)]).collect()}
    assert got == {"a.json": None, "b.json": "not_object", "c.json": "invalid_json", "d.json": "invalid_json"}
    assert lines.load_document(spark, str(d / "a.json")) == {"k": [1, 2]}
    with pytest.raises(TypeError, match="b.json"):
        lines.load_document(spark, str(d / "b.json"))
    path = str(tmp_path / "manifest")
    assert lines.write_or_verify(spark, path, {"seed": 1, "note": "x", "gpus": ["a"]}, ("seed", "gpus"))
    assert not lines.write_or_verify(spark, path, {"seed": 1, "note": "y", "gpus": ["a"]}, ("seed", "gpus"))
    with pytest.raises(ValueError, match=r"mismatch: \['seed', 'gpus'\]"):
        lines.write_or_verify(spark, path, {"seed": 2}, ("seed", "gpus"))


def test_canonical_forms(spark):
    value = {"b": [1.0, 1e20, 0.1, -0.0, 10**30, True, None], "a": {"ü": " \U0001f600", "": "x\"\\/\n"}}
    text = json.dumps(value, indent=3)
    frame = spark.createDataFrame([(text,), ("{",), (None,)], "t string").coalesce(1)
    for escaped in (True, False):
        got = [r.x for r in frame.select(canonical.canonical_json("t", escaped, newline=not escaped).alias("x")).collect()]
        want = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=escaped)
        assert got == [want + "\n" * (not escaped), None, None]


def test_signature_is_that_of_sorted_escaped_json(spark):
    row = spark.createDataFrame([("é", 1e20, None, 3)], "z string, lr double, cap string, n int")
    want = json.dumps({"z": "é", "lr": 1e20, "cap": None, "n": 3}, sort_keys=True, separators=(",", ":"))
    import hashlib

    assert runs.signature(row, ["z", "lr", "cap", "n"]).first().run_signature == hashlib.sha256(want.encode()).hexdigest()[:12]


def test_numbers_of_ties_and_nulls_are_dealt(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3 * F.when(F.col("id") % 5 > 0, 1)).alias("pos"), F.col("id").alias("v"))
    got = selection.numbered(rows, "pos").collect()
    assert sorted(r["index"] for r in got) == list(range(5000))
    by = sorted(got, key=lambda r: r["index"])
    assert [r.pos is not None for r in by] == sorted(r.pos is not None for r in by)
    assert [r.pos for r in by if r.pos is not None] == sorted(r.pos for r in by if r.pos is not None)
    again = {r.v: r["index"] for r in selection.numbered(rows.repartition(3, "v"), "pos").collect()}
    assert again == {r.v: r["index"] for r in got}
    assert selection.numbered(rows.limit(0), "pos").count() == 0
