"""The composed validator of a replication: valid runs give nothing, and each fault its own check."""

import hashlib
import json

import pytest

from pairwell.operators import replication

CONFIG = {"model": "m", "revision": "r1", "seed": 0, "do_sample": False, "dataset_sha256": "d", "excluded_item_ids": [f"i{n}" for n in range(11)]}
CONDITIONS = {"string": "signed_string", "integer": "integer"}
ROW = "role string, condition string, pos long, item_id string, row_condition string, representation string, run_signature string, run_id string, model_revision string, tokenizer_revision string, template_depth int"


def signature(config):
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def found(spark, change_rows=lambda rows: rows, change=lambda role, condition, manifest: manifest, roles=None, dataset=None):
    dataset = dataset or [(r, n, f"i{n}") for r in ("bridge", "fresh") for n in range(20, -1, -1)]
    rows, manifests = [], []
    for role in ("bridge", "fresh"):
        for condition, representation in CONDITIONS.items():
            config = CONFIG | {"condition": condition, "answer_representation": representation, "note": "ü"}
            manifest = change(role, condition, {"run_config": config, "packages": {"a": [1, 2]}, "model_revision": "r1"})
            manifests.append((role, condition, manifest if manifest is None or isinstance(manifest, str) else json.dumps(manifest)))
            rows += [[role, condition, p, f"i{p + 10}", condition, representation, signature(config), "run", "r1", "r1", 1] for p in range(1, 11)]
    roles = roles or [(r, 10, CONFIG["excluded_item_ids"], "d") for r in ("bridge", "fresh")]
    frames = [
        spark.createDataFrame(dataset, "role string, pos long, item_id string"),
        spark.createDataFrame(roles, "role string, items long, excluded array<string>, dataset_sha256 string"),
        spark.createDataFrame([tuple(r) for r in change_rows(rows)], ROW),
        spark.createDataFrame(manifests, "role string, condition string, text string"),
    ]
    got = replication.failures(*frames, CONDITIONS, "r1", {"model": "m", "revision": "r1", "seed": 0, "do_sample": False}, {"model_revision": "r1"}).collect()
    return sorted(("/".join(filter(None, (r.role, r.condition))), r.check, r.n) for r in got)


def test_valid_runs_have_no_failures(spark):
    assert found(spark) == []


def test_an_absent_field_of_the_environment_is_null(spark):
    def change(role, condition, m):
        return m | ({"torch": None} if role == "fresh" else {})

    assert found(spark, change=change) == []


def test_rows(spark):
    def change(rows):
        rows[0][3], rows[1][3] = rows[1][3], rows[0][3]  # bridge/string: order
        rows[10][8], rows[11][9], rows[12][10] = "r0", None, 2  # bridge/integer
        rows[20][4], rows[21][5], rows[22][7] = "integer", None, None  # fresh/string
        rows[31][3] = rows[30][3]  # fresh/integer
        return rows[:39]

    assert found(spark, change) == [
        ("bridge/integer", "model_revision", 1),
        ("bridge/integer", "template_depth", 1),
        ("bridge/integer", "tokenizer_revision", 1),
        ("bridge/string", "order", 1),
        ("fresh/integer", "duplicates", 1),
        ("fresh/integer", "order", 1),
        ("fresh/integer", "row_count", 1),
        ("fresh/string", "condition", 1),
        ("fresh/string", "one_run", 1),
        ("fresh/string", "representation", 1),
    ]


def test_manifests(spark):
    def change(role, condition, m):
        if (role, condition) == ("bridge", "string"):  # 1 is not false and "0" no number; signature and partner differ too
            return m | {"run_config": m["run_config"] | {"seed": "0", "do_sample": 0}, "model_revision": None}
        if (role, condition) == ("fresh", "string"):  # ids are compared in order, i10 after i9
            return m | {"run_config": m["run_config"] | {"excluded_item_ids": sorted(CONFIG["excluded_item_ids"])}, "packages": {"a": [2, 1]}}
        return m

    assert found(spark, change=change) == [
        ("", "one_environment", 1),
        ("bridge", "paired_configs", 1),
        ("bridge/string", "config_do_sample", 1),
        ("bridge/string", "config_seed", 1),
        ("bridge/string", "manifest_model_revision", 1),
        ("bridge/string", "signature", 1),
        ("fresh", "paired_configs", 1),
        ("fresh/string", "config_excluded_item_ids", 1),
        ("fresh/string", "signature", 1),
    ]


@pytest.mark.parametrize("text", [None, "{", "[]", '{"run_config": 3}'])
def test_a_manifest_without_configuration(spark, text):
    got = found(spark, change=lambda role, condition, m: text if (role, condition) == ("fresh", "integer") else m)
    checks = {c for s, c, _ in got if s == "fresh/integer"}
    assert {"config_object", "signature", "config_seed", "config_excluded_item_ids", "manifest_model_revision"} <= checks
    assert not [s for s, *_ in got if s.startswith("bridge")]


def test_a_run_without_rows_and_roles_of_other_sizes(spark):
    got = found(spark, lambda rows: rows[10:], roles=[("bridge", 10, CONFIG["excluded_item_ids"], "d"), ("fresh", 12, CONFIG["excluded_item_ids"], "d")])
    empty = {(c, n) for s, c, n in got if s == "bridge/string"}
    assert empty == {("row_count", 10), ("order", 1), ("one_signature", 1), ("one_run", 1), ("signature", 1), *[(c, 1) for c in ("model_revision", "tokenizer_revision", "condition", "representation", "template_depth")]}
    assert ("fresh", "assigned_items", 2) in got and ("fresh/string", "row_count", 2) in got


def test_a_dataset_that_repeats_an_item(spark):
    dataset = [(r, n, "i12" if (r, n) == ("fresh", 13) else f"i{n}") for r in ("bridge", "fresh") for n in range(21)]
    assert found(spark, dataset=dataset) == [("fresh", "dataset_duplicates", 1), ("fresh/integer", "order", 1), ("fresh/string", "order", 1)]
