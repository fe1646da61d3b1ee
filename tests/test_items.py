import json
import random

import pytest
from pyspark.sql import functions as F

from pairwell import queries_items
from pairwell.functions import jsontext, prompts
from pairwell.operators import catalogue, eligibility, manifests, pairing, traces
from pairwell.operators.eligibility import REASONS

PARAMETERS = {"type": "dict", "properties": {"a/b": {"type": "integer"}, "*": {"type": "dict", "properties": {"x": {"type": "float"}}, "required": ["x"]}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["a/b", "*"]}
TRUTH = {"a/b": [5, -7, -0, "x", -8.0], "*": [{"x": "no"}, {"x": 1.5}], "tags": [["t"], ""]}


def question(**changes):
    return {"question": [[{"role": "user", "content": "hé"}]], "function": [{"name": "f/g", "parameters": PARAMETERS}]} | changes


def answer(truth):
    return {"ground_truth": [{"f/g": truth}]}


def with_parameters(**changes):
    return question(function=[{"name": "f/g", "parameters": PARAMETERS | changes}])


Q, A = question(), answer(TRUTH)
CASES = [
    (None, Q, A),
    (None, Q, answer(TRUTH | {"a/b": [3.0]})),  # a number without fraction is an integer by its schema
    (None, Q, answer({k: TRUTH[k] for k in ("a/b", "*")})),
    (0, question(question=[]), A),
    (0, question(question=[Q["question"][0] * 2]), A),
    (0, question(question=[[{"role": "user", "content": 5}]]), A),
    (0, None, A),
    (0, [Q], A),
    (1, question(function=Q["function"] * 2), A),
    (1, question(function={}), A),
    (2, question(function=["f"]), A),
    (2, question(function=[{"name": None, "parameters": PARAMETERS}]), A),
    (3, with_parameters(type="object"), A),
    (3, question(function=[{"name": "f/g", "parameters": "dict"}]), A),
    (4, with_parameters(required={}), A),
    (4, with_parameters(properties=[]), A),
    (5, with_parameters(required=["*", 5]), A),
    (5, with_parameters(required=[]), A),
    (6, with_parameters(properties=PARAMETERS["properties"] | {"tags": {"type": "array"}}), A),
    (6, with_parameters(required=["a/b", "absent"]), A),
    (7, with_parameters(properties=PARAMETERS["properties"] | {"a/b": {"type": "integer", "maximum": 9}}), A),
    (8, Q, {"ground_truth": A["ground_truth"] * 2}),
    (8, Q, {"ground_truth": [{"other": TRUTH}]}),
    (8, Q, {"ground_truth": [{"f/g": TRUTH, "h": {}}]}),
    (8, Q, answer([])),
    (8, Q, None),
    (9, Q, answer(TRUTH | {"b": [1]})),
    (10, Q, answer({"a/b": [1]})),
    (10, Q, answer(TRUTH | {"a/b": []})),
    (10, Q, answer(TRUTH | {"a/b": ["1", True, None, 1.5]})),
    (10, Q, answer(TRUTH | {"a/b": 5})),
    (10, Q, answer(TRUTH | {"*": [{"x": 1, "y": 2}, {}, 3]})),
    (11, Q, answer(TRUTH | {"tags": "t"})),
]


def test_reasons_in_order(spark):
    rows = [(i, None if q is None else json.dumps(q), None if a is None else json.dumps(a), "kept") for i, (_, q, a) in enumerate(CASES)]
    rows += [(100, "", A and json.dumps(A), "kept"), (101, json.dumps(Q), "{", "kept"), (0, *rows[0][1:])]
    found = eligibility.judged_items(spark.createDataFrame(rows, "id int, question string, answer string, reason string").repartition(3)).collect()
    want = [(i, None if r is None else REASONS[r]) for i, (r, _, _) in enumerate(CASES)] + [(100, REASONS[0]), (101, REASONS[8]), (0, None)]
    assert sorted([(r["row"].id, r.reason) for r in found], key=str) == sorted(want, key=str)
    assert {r["row"].reason for r in found} == {"kept"}
    plain = [r for r in found if r["row"].id == 0]
    assert len(plain) == 2 and plain[0].required_integers == ["a/b"] and plain[0].user_request == "hé" and plain[0].function_name == "f/g"
    assert [tuple(x) for x in plain[0].negative_references] == [("a/b", "-7")]
    assert all(r.required_integers is None and r.negative_references is None for r in found if r.reason)


def test_items_do_not_move_to_find_their_schema(spark):
    """A join would send all rows with their leaves, which are longer than the planner takes them for, to the driver."""
    rows = spark.createDataFrame([(json.dumps(q), json.dumps(a)) for _, q, a in CASES], "question string, answer string")
    plan = eligibility.judged_items(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_reasons_are_counted_where_the_items_are(spark, sf_dir):
    """Only counts leave the tasks: items are read once, and neither dealt by schema nor broadcast."""
    found = queries_items.agg_18_item_reasons(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("ArrowEvalPython") == plan.count("FileScan") == 1
    assert sum(r["items"] for r in found.collect()) == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_no_items(spark):
    assert eligibility.judged_items(spark.createDataFrame([], "question string, answer string")).collect() == []


def test_earlier_reasons_win(spark):
    broken = {"question": 1, "function": []}
    text = [(json.dumps(broken), "null"), (json.dumps(with_parameters(type="x", required=3)), "{}"), (json.dumps(with_parameters(required=["a/b", "absent"])), "{}")]
    assert {r.reason for r in eligibility.judged_items(spark.createDataFrame(text, "question string, answer string")).collect()} == {REASONS[0], REASONS[3], REASONS[6]}


STEPS = "id int, decoded string, pre array<double>, post array<double>, selected int, row string"


def test_boundary_records_equal_a_full_sort(spark):
    draw = random.Random(5)
    rows = [(i, 'x "answer": ', [draw.choice([0.25, 0.5, -1.5, float("-inf"), 3.125]) for _ in range(30)], [draw.random() for _ in range(30)], i, "r") for i in range(20)]
    for r in traces.boundary_records(spark.createDataFrame(rows, STEPS), {"-": 2, "far": 30}).collect():
        for name, scores in (("top_pre_mask", rows[r["row"].id][2]), ("top_post_mask", rows[r["row"].id][3])):
            best = sorted(range(30), key=lambda t: (-scores[t], t))[:8]
            assert [(x.token_id, x.score) for x in r[name]] == [(t, pytest.approx(round(scores[t], 6))) for t in best]
        assert set(r.known_pre_mask_scores) == {"-"} and r.known_pre_mask_scores["-"].score == rows[r["row"].id][2][2]
        assert r["row"].row == "r" and r["row"].selected == r["row"].id


def test_boundaries_short_arrays_and_nulls(spark):
    inf = float("-inf")
    rows = [
        (1, '{"answer":', [1.0, None, 2.0], [inf, inf, 0.0], None, "r"),
        (2, 'a' * 500 + '"answer" :\n ', [], None, 4, "r"),
        (3, '"answer": 1', [1.0], [1.0], 0, "r"),
        (4, None, [1.0], [1.0], 0, "r"),
        (5, "", [1.0], [1.0], 0, "r"),
    ]
    found = {r["row"].id: r for r in traces.boundary_records(spark.createDataFrame(rows, STEPS), {"-": 0}).collect()}
    assert set(found) == {1, 2}
    assert [x.token_id for x in found[1].top_pre_mask] == [2, 0] and found[1].masked_count == 2 and found[1]["row"].selected is None
    assert found[2].top_pre_mask == [] and found[2].top_post_mask is None and len(found[2].decoded_suffix) == 240
    assert traces.boundary_records(spark.createDataFrame([], STEPS), {"-": 0}).collect() == []


def test_subset_effects(spark):
    schema = "subset string, pos int, item string, ok boolean"
    control = spark.createDataFrame([("a", 0, "x", True), ("a", 1, "y", False), ("a", 2, "y", None), ("b", 0, "z", True), (None, 0, "n", False)], schema)
    treatment = spark.createDataFrame([("a", 0, "x", False), ("a", 1, "y", True), ("a", 2, "q", True), (None, 0, "n", True), ("c", 9, "new", True)], schema)
    found = {r.subset: r.asDict() for r in pairing.subset_effects(control, treatment, "ok").collect()}
    assert found["a"] == {"subset": "a", "control_rows": 3, "treatment_rows": 3, "mismatched": 1, "pairs": 2, "repaired": 1, "broken": 1, "repeated": 1}
    assert (found["b"]["mismatched"], found["b"]["treatment_rows"], found["b"]["pairs"]) == (1, 0, 0)
    assert found[None]["repaired"] == 1 and found["c"]["control_rows"] == 0
    assert pairing.subset_effects(control.limit(0), treatment.limit(0), "ok").collect() == []


def test_bounded_suite(spark):
    marks = spark.createDataFrame([(i, r) for i in range(20) for r in (["lost"] if i % 2 else ["right", "wrong"])] + [(3, "right"), (3, "lost")], "pos int, reason string")
    found = {r.pos: r.selection_reason for r in catalogue.bounded_suite(marks, {"lost": None, "right": 3, "wrong": 1}, "pos").collect()}
    assert found == {**{i: "lost" for i in range(1, 20, 2)}, 3: "lost,right", 0: "right,wrong", 2: "right"}


def test_prompts(spark):
    at = spark.createDataFrame([("2+2?",), (None,)], "question string").select(prompts.question_prompt("question", "integer").alias("p"), prompts.question_prompt("question").alias("f")).collect()
    assert '{"reasoning": "<calculation sentences>", "answer": <integer>}\n\nQuestion:\n2+2?' in at[0].p and at[1].f.endswith("Final answer: <number>\n\nQuestion:\n")
    turned = prompts.instructions("baseline", ("answer", "reasoning"))
    assert '"answer", then "reasoning"' in turned and '{"answer": "<final numeric answer>", "reasoning": "<calculation sentences>"}' in turned


def test_manifest_projections(spark):
    base = {"run_config": {"model": "m", "seed": 7, "field_order": ["a", "b"]}, "packages": {"x": "1", "y": {"z": [1, {}]}}, "gpus": []}
    others = [
        (base, [], []),
        ({"packages": {"y": {"z": [1.0, {}]}, "x": "1"}, "gpus": [], "run_config": {"field_order": ["a", "b"], "seed": 7.0, "model": "m", "dtype": None, "unknown": 1}}, [], []),
        (base | {"gpus": {}}, [], ["gpus"]),
        (base | {"gpus": None, "packages": {"x": "1", "y": {"z": [{}, 1]}}}, [], ["gpus", "packages"]),
        (base | {"run_config": {"model": "m", "seed": "7", "field_order": ["b", "a"]}}, ["field_order", "seed"], []),
        (base | {"run_config": None}, ["model", "field_order", "seed"], []),
        (None, ["model", "field_order", "seed"], ["gpus", "packages"]),
    ]
    rows = spark.createDataFrame([(i, json.dumps(base), None if o is None else json.dumps(o)) for i, (o, _, _) in enumerate(others)], "id int, l string, r string")
    read = rows.select("id", jsontext.read_call("l").alias("l"), jsontext.read_call("r").alias("r"))
    read = read.select("id", manifests.comparable(F.col("l.leaves")).alias("l"), manifests.comparable(F.col("r.leaves")).alias("r"))
    l, r = F.col("l"), F.col("r")
    found = read.select("id", manifests.differing_fields(l, r, manifests.CONFIG, "/run_config").alias("config"), manifests.differing_fields(l, r, manifests.ENVIRONMENT).alias("environment")).collect()
    assert [(x.config, x.environment) for x in sorted(found, key=lambda x: x.id)] == [(c, e) for _, c, e in others]
