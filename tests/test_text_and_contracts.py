import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pairwell.functions import contracts, jsontext, numbers, scoring
from pairwell.operators import profiles
from pairwell.plans.transforms import FieldOrder, IntegerString, KeyAlias, Plan, ScratchField, rendered

ORDER = ("reasoning", "answer")


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def read_rows(spark, values, read=jsontext.read_response):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return rows.select("i", read("v").alias("r"))


def test_canonical_number(spark):
    given = ["$1,200.00", "2/4", "18.0", "007", "-3.50", "abc X", "", None, "12.", "1e5", "3/0", "-12", "9" * 40]
    assert column(spark, given, numbers.canonical_number) == ["1200", "1/2", "18", "7", "-3.5", "abc x", None, None, "12", "100000", "3/0", "-12", "9" * 40]


def test_free_answer(spark):
    given = ["Final answer: 12. Later text contains 13", "Final answer: 12.", "final ANSWER : -$3,000", "a 5 b 7", "Final answer: none 'x'", "", None]
    got = column(spark, given, numbers.free_answer)
    assert [(g.answer, g.marker_at_end) for g in got[:3]] == [("12", False), ("12", True), ("-$3,000", True)]
    assert (got[3].answer, got[3].method) == ("7", "last_number_fallback")
    assert (got[4].answer, got[4].method, got[4].marker_present) == (None, "not_found", True)
    assert got[5].answer is None and got[6].answer is None


def test_small_text_functions(spark):
    assert column(spark, ["a #### 1 #### 18 ", "none", "x #### y"], numbers.gold_answer) == ["18", None, None]
    assert column(spark, ["1,234.5", "1,23", " 7 ", "7 kg", "-3/4"], numbers.strict_number) == ["1,234.5", None, "7", None, "-3/4"]
    assert column(spark, ["gsm_12", "12", "other_12", "gsm_x"], lambda v: numbers.id_index(v, "gsm")) == [12, 12, None, None]
    assert column(spark, ["5", "-5", None], lambda v: numbers.sign_inverse(v, F.lit("-5"))) == [True, False, False]
    assert column(spark, ["a|b\nc"], numbers.table_cell) == ["a\\|b c"]


def test_reading_is_strict(spark):
    given = ['{"a": 1}', ' {"a": 1} ', '{"a": 1} x', 'x {"a": {"b": [1, 2.0, null]}}', "[1]", "{bad", "", None, '{"a": 1, "a": 2}', "{" * 3000]
    got = column(spark, given, jsontext.read_response)
    assert [(g.whole, g.recovered) for g in got] == [(True, True), (True, True), (False, True), (False, True), (False, False), (False, False), (False, False), (False, False), (True, True), (False, False)]
    assert [(x.path, x.kind, x.text) for x in got[3].leaves] == [("", "object", "1"), ("/a", "object", "1"), ("/a/b", "array", "3"), ("/a/b/0", "integer", "1"), ("/a/b/1", "integral", "2.0"), ("/a/b/2", "null", None)]
    assert got[8].leaves[1].text == "2"
    odd = column(spark, ['{"\\ud800": "\\udfff é"}'], jsontext.read_response)[0]
    assert odd.whole and odd.leaves[1].path == "/?" and odd.leaves[1].text == "? é"


def test_layers(spark):
    given = ['{"reasoning": "r", "answer": 18}', '{"reasoning": "r", "answer": "18"}', '{"reasoning": "r", "answer": 18.0}', '{"reasoning": "r", "answer": true}', '{"reasoning": "r", "answer": 18} ok', '{"answer": 18, "reasoning": "r"}', '{"reasoning": "r", "answer": 18, "x": 1}', '{"reasoning": "' + "r" * 257 + '", "answer": 18}']
    got = [r.s for r in scoring.layered_score(read_rows(spark, given).withColumn("gold", F.lit("18")), "r", "gold", ORDER, "integer").orderBy("i").collect()]
    assert [g.internal_valid for g in got] == [True, False, True, False, False, True, False, False]
    assert [g.external_valid for g in got] == [True, False, False, False, False, True, False, False]
    assert [g.semantic_correct for g in got] == [True, True, False, False, True, True, True, True]
    assert [g.order_matches for g in got] == [True, True, True, True, False, False, False, True]
    assert [g.contract_valid_correct for g in got] == [True, False, False, False, False, True, False, False]


def test_huge_integers_survive(spark):
    big = "9" * 300
    plan = Plan(tuple(contracts.answer_contract("signed_string", ORDER)), (IntegerString("/answer"),))
    got = plan.run(read_rows(spark, [f'{{"reasoning": "r", "answer": -{big}}}']), F.col("r.leaves")).select(rendered(F.col("external")).alias("x")).first()
    assert json.loads(got.x) == {"reasoning": "r", "answer": "-" + big}


def test_plan_round_trip_and_refusals(spark):
    external = tuple(contracts.answer_contract("signed_string", ("answer", "reasoning")))
    steps = (ScratchField("scratch", 5), KeyAlias("reasoning", "why"), IntegerString("/answer"), FieldOrder(("answer", "reasoning"), ("reasoning", "answer")))
    plan = Plan(external, steps)
    assert [f.path for f in plan.internal()] == ["/scratch", "/why", "/answer"]
    assert plan.digest() == Plan(external, steps).digest() != Plan(external, steps[1:]).digest()
    given = ['{"scratch": "s", "why": "a \\"b\\"", "answer": 3}', '{"why": "w", "answer": 3}', '{"scratch": "s", "why": "w", "answer": 3.0}', '{"scratch": "longer", "why": "w", "answer": 3}', "no"]
    got = plan.run(read_rows(spark, given), F.col("r.leaves")).orderBy("i").collect()
    assert [g.code for g in got] == [None, "internal_invalid", "not_reversible", "internal_invalid", "no_object"]
    assert [(x.path, x.kind, x.text) for x in got[0].external] == [("", "object", "3"), ("/answer", "string", "3"), ("/reasoning", "string", 'a "b"')]
    assert all(g.external is None for g in got[1:])
    with pytest.raises(ValueError):
        Plan(external, (steps[2], steps[0]))
    with pytest.raises(ValueError):
        Plan(external, (steps[0], steps[0]))
    with pytest.raises(ValueError):
        KeyAlias("reasoning", "answer").forward(list(external))
    with pytest.raises(ValueError):
        contracts.integers_as_strings([contracts.Field("/a", "integer", minimum=0)])


def test_tool_score(spark):
    args = [contracts.Field("/arguments/sku", "string"), contracts.Field("/arguments/n", "integer"), contracts.Field("/arguments/bins", "array"), contracts.Field("/arguments/bins/*", "integer", required=False)]
    given = ['{"name": "t", "arguments": {"sku": "a", "n": -5, "bins": [1]}}', '{"name": "u", "arguments": {"sku": "a", "n": -5, "bins": []}}', '{"name": "t", "arguments": {"sku": "a", "n": "-5", "bins": []}}', '{"name": "t", "arguments": {"sku": "a", "n": 5, "bins": []}}', '{"name": "t"}']
    got = [r.s for r in scoring.tool_score(read_rows(spark, given, jsontext.read_call), "r", "t", args, {"n": [F.lit("-5")], "sku": [F.lit("z"), F.lit("a")], "bins": [[], [2], [1]]}).orderBy("i").collect()]
    assert [(g.selected, g.internal_valid, g.arguments_correct, g.success) for g in got] == [(True, True, True, True), (False, False, False, False), (True, False, False, False), (True, True, False, False), (True, False, False, False)]
    unlisted = scoring.tool_score(read_rows(spark, given[:1], jsontext.read_call), "r", "t", args, {"n": [F.lit("-5")], "sku": [F.lit("a")]}).first().s
    assert unlisted.external_valid and not unlisted.arguments_correct  # bins is given, but has no options
    done = scoring.receipts(read_rows(spark, given, jsontext.read_call), "r", "t", args).orderBy("i").collect()
    state = '{"call_count":1,"last_call":{"arguments":{"bins":[1],"n":-5,"sku":"a"},"name":"t"}}'
    assert done[0].receipt == hashlib.sha256(state.encode()).hexdigest() and [r.i for r in done] == [0, 3]


def test_options_are_equal_in_all_parts(spark):
    args = [contracts.Field("/arguments/o", "object"), contracts.Field("/arguments/o/a", "array"), contracts.Field("/arguments/o/a/*", "number", required=False), contracts.Field("/arguments/o/b~1c", "null")]
    call = '{"name": "t", "arguments": {"o": {"b/c": null, "a": [1, 2.0, 0.5]}}}'
    for option, same in (({"a": [1, 2, 0.5], "b/c": None}, True), ({"a": [2, 1, 0.5], "b/c": None}, False), ({"a": [1, 2, 0.5]}, False), ({"a": [1, 2, 0.5], "b/c": "null"}, False)):
        got = scoring.tool_score(read_rows(spark, [call], jsontext.read_call), "r", "t", args, {"o": [option]}).first().s
        assert got.external_valid and got.arguments_correct == same


def test_keys_with_slashes_do_not_pass_for_paths(spark):
    args = [contracts.Field("/arguments/sku", "string")]
    given = ['{"name": "t", "arguments": {}, "arguments/sku": "P1"}', '{"name": "t", "arguments": {"sku": "P1"}}', '{"name": "t", "arguments": {"*": "P1", "~": 1, "a/b": 2}}']
    rows = read_rows(spark, given, jsontext.read_call).orderBy("i").collect()
    assert [x.path for x in rows[2].r.leaves] == ["", "/name", "/arguments", "/arguments/~2", "/arguments/~0", "/arguments/a~1b"]
    assert jsontext.value_of([x.asDict() for x in rows[2].r.leaves]) == {"name": "t", "arguments": {"*": "P1", "~": 1, "a/b": 2}}
    got = [r.s.internal_valid for r in scoring.tool_score(read_rows(spark, given, jsontext.read_call), "r", "t", args, {"sku": [F.lit("P1")]}).orderBy("i").collect()]
    assert got == [False, True, False]


def test_white_space_of_all_kinds(spark):
    assert column(spark, ["so #### 18\n", "#### \t18\u2003"], numbers.gold_answer) == ["18", "18"]
    assert column(spark, [" 12\n", "\t12", "+5", "1.5/2", "1/1,000", "-1,234.50", "12 3", "\n"], numbers.strict_number) == ["12", "12", None, None, "1/1,000", "-1,234.50", None, None]
    assert [r.marker_at_end for r in column(spark, ["Final answer: 12.\n", "Final answer: 12 \n\t.", "Final answer: 12 kg"], numbers.free_answer)] == [True, True, False]
    assert column(spark, [" 1,200.50\n", "6/3", "1.5/2", "-0.0", "7.", "\t"], numbers.canonical_number) == ["1200.5", "2", "1.5/2", "-0", "7", None]


def test_the_baseline_contract(spark):
    given = ['{"reasoning": "%s", "answer": "7"}' % ("x" * 300), '{"reasoning": "so", "answer": "abc"}', '{"reasoning": "so", "answer": "1/1,000"}', '{"reasoning": "so", "answer": "+7"}', '{"reasoning": "so", "answer": 7}']
    got = read_rows(spark, given, jsontext.read_response).select("i", scoring.baseline_score(F.col("r"), ("reasoning", "answer")).alias("s")).orderBy("i").collect()
    assert [r.s.schema_valid for r in got] == [True, False, True, False, False]


def test_totals_are_rounded_once(spark):
    rng = random.Random(3)
    wild = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)]
    groups = {
        "tenths": [0.1] * 3, "cancel": [1e16, 1.0, -1e16], "wild": wild, "tiny": [5e-324, 5e-324, -1e-320, 0.0, -0.0], "large": [2e18, 2e18, 1.5], "two": [2.0**52 + 0.5, 2.0**53 - 1, 1023.999999999999],
        "powers": [2.0**k for k in range(-1074, 1020)] + [-(2.0**k) for k in range(-1000, 1000, 3)], "near": [math.nextafter(2.0**k, 0) for k in range(-60, 60)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("nulls", None), ("some", None), ("some", 2.5), ("inf", math.inf), ("inf", 1.0), ("nan", math.nan), ("nan", 1.0), ("over", 1.7e308), ("over", 1.7e308)]
    got = {r.g: r.total for r in profiles.exact_totals(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], "x", "total").collect()}
    assert {g: got[g] for g in groups} == {g: math.fsum(xs) for g, xs in groups.items()}
    assert got["nulls"] is None and got["some"] == 2.5 and got["inf"] == math.inf == got["over"] and math.isnan(got["nan"])


def test_equal_values(spark):
    same = lambda a, b, c, d: spark.range(1).select(scoring.equal_values(*map(F.lit, (a, b, c, d))).alias("x")).first().x
    assert same("integer", "2", "integral", "2.0") and not same("boolean", "true", "string", "true")
    assert not same("integer", str(2**80 + 1), "integral", repr(float(2**80 + 1)))
    assert same("integral", repr(1e16), "integer", "10000000000000000") and same("integral", "-0.0", "integer", "0")
    assert same("number", "0.125", "number", repr(1.25e-1)) and same("number", "1.5e-07", "number", "0.00000015") and not same("integer", "2", "integer", "20")
    assert not same("number", "nan", "number", "nan") and not same("number", "inf", "number", "inf")


def test_number_keys(spark):
    texts = ["0", "-0", "0.0", "7", "-7", "700", "7e2", "0.07", "70e-3", "1e16", "1E+16", "12.50", "nan", "Infinity", "x", "", "1.", "-1200.0"]
    assert column(spark, texts, numbers.number_key) == [numbers.number_key_of(t) for t in texts]
    assert numbers.number_key_of("700") == numbers.number_key_of("7e2") != numbers.number_key_of("70")


def test_arguments_compare_by_value(spark):
    args = [contracts.Field("/arguments/n", "number")]
    for given, option, right in (("1e16", 10**16, True), ("-0.0", 0, True), ("0", F.lit("-0.0"), True), ("10000000000000000", F.lit("1e16"), True), ("NaN", float("nan"), False), ("0.1", [0.1], False), ("2.50", 2.5, True)):
        call = '{"name": "t", "arguments": {"n": %s}}' % given
        assert scoring.tool_score(read_rows(spark, [call], jsontext.read_call), "r", "t", args, {"n": [option]}).first().s.arguments_correct == right, given


def test_aliases_and_scratch_fields_in_nested_scopes(spark):
    fields = [contracts.Field("/outer", "object"), contracts.Field("/outer/list", "array"), contracts.Field("/outer/list/*", "object", required=False), contracts.Field("/outer/list/*/name", "string", required=False), contracts.Field("/name", "string")]
    plan = Plan(tuple(fields), (ScratchField("note", 3, "/outer/list/*"), KeyAlias("name", "n", "/outer/list/*")))
    assert [f.path for f in plan.internal()] == ["/outer", "/outer/list", "/outer/list/*", "/outer/list/*/note", "/outer/list/*/n", "/name"]
    given = [
        '{"outer": {"list": [{"note": "a", "n": "x"}, {"note": "", "n": "y/z"}]}, "name": "kept"}',
        '{"outer": {"list": [{"note": "a", "n": "x"}, {"n": "y"}]}, "name": "kept"}',  # one lacks its note
        '{"outer": {"list": [{"note": "a", "name": "x"}]}, "name": "kept"}',  # the external key inside
        '{"outer": {"list": []}, "name": "kept"}',
    ]
    got = plan.run(read_rows(spark, given), F.col("r.leaves")).orderBy("i").collect()
    assert [g.code for g in got] == [None, "not_reversible", "internal_invalid", None]
    assert [(x.path, x.shape, x.text) for x in got[0].external if x.kind == "string"] == [("/outer/list/0/name", "/outer/list/*/name", "x"), ("/outer/list/1/name", "/outer/list/*/name", "y/z"), ("/name", "/name", "kept")]
    for step in (KeyAlias("name", "n", "/outer"), ScratchField("name", 3, "/outer/list/*"), ScratchField("q", 3, "/none")):
        with pytest.raises(ValueError):
            step.forward(fields)
    assert KeyAlias("name", "n").forward(fields)[-1].path == "/n"
