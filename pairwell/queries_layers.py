"""Further registered queries: profiles, selections, JSON layers, transforms and validators one by one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwell.functions import contracts, jsontext, numbers, scoring, stats
from pairwell.operators import catalogue, pairing, profiles, selection, validation
from pairwell.plans.transforms import FieldOrder, IntegerString, KeyAlias, Plan, ScratchField, rendered
from pairwell.sources.stand_ins import COMPARISONS, responses, runs, table, tool_calls

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORDER = ("reasoning", "answer")


def query(f):
    _QUERIES[f.__name__] = f
    return f


def _arms(spark, sf_dir):
    return pairing.last_wins(runs(spark, sf_dir), ["item_id", "condition"])


def _pairs(spark, sf_dir):
    return pairing.paired(_arms(spark, sf_dir), COMPARISONS, [])


def _read(spark, sf_dir):
    return responses(spark, sf_dir).select("pos", "condition", "k", "gold_answer", "raw_output", jsontext.read_response("raw_output").alias("r"))


@query
def fil_03_single_condition(spark, sf_dir):
    """Whether the rows of each item and answer all name one condition."""
    found = runs(spark, sf_dir).groupBy("item_id", "answer").agg(F.countDistinct("condition").alias("conditions"), F.count("*").alias("rows"))
    return found.withColumn("holds", F.col("conditions") == 1)


@query
def fil_05_losses(spark, sf_dir):
    return catalogue.losses(_pairs(spark, sf_dir)).select("item_id", "comparison")


@query
def fil_06_negative_answers(spark, sf_dir):
    return catalogue.negatives(runs(spark, sf_dir)).groupBy("comparison").agg(F.count("*").alias("n"))


@query
def fil_07_no_negative_gold(spark, sf_dir):
    """Whether the answers that stand for an item's gold are all free of signs."""
    return runs(spark, sf_dir).groupBy("item_id", "condition").agg((~F.bool_or(F.startswith("answer", F.lit("-")))).alias("holds"))


@query
def prj_02_rest_of_config(spark, sf_dir):
    """Pairs whose configuration agrees once the keys of representation are dropped."""
    config = lambda s: F.map_filter(F.create_map(F.lit("condition_key"), F.col(f"{s}.answer"), F.lit("cap"), F.col(f"{s}.hit_max_new_tokens").cast("string"), F.lit("error"), F.coalesce(F.col(f"{s}.error"), F.lit("none"))), lambda k, v: k != "condition_key")
    same = F.array_sort(F.map_entries(config("t"))) == F.array_sort(F.map_entries(config("c")))
    return _pairs(spark, sf_dir).groupBy("comparison").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("other"))


@query
def prj_06_aliases(spark, sf_dir):
    """Rows with the names that older reports use."""
    return runs(spark, sf_dir).select("pos", F.col("correct").alias("correct_exact"), F.coalesce("strict", "correct").alias("correct_exact_strict"))


@query
def prj_08_typed_options(spark, sf_dir):
    """How many of an order's options are integers."""
    options = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(F.filter(options, contracts.is_canonical_integer)).cast("long").alias("integers"))


@query
def jon_04_zip(spark, sf_dir):
    """Arms zipped by position: how often both are right."""
    own = lambda c: selection.numbered(runs(spark, sf_dir).filter(F.col("condition") == c).select("pos", F.col("correct").alias(c)), "pos").drop("pos")
    both = own("click").join(own("view"), "index")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("click") & F.col("view")).alias("both_correct"))


@query
def jon_11_lookup(spark, sf_dir):
    """Documents looked up in labels, which cover some of them: found and missing, by source."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), "quality")
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("key"), "left")
    return joined.groupBy("source").agg(F.count("*").alias("looked_up"), F.count_if(F.col("key").isNull()).alias("missing"), F.sum("quality").alias("quality"))


def _scored(spark, sf_dir):
    """Scored rows of three models: one condition answers in free text, the others in JSON; telemetry as in the runs."""
    pos, k, free = F.col("pos"), F.col("k").cast("string"), F.col("condition") == "signup"
    said = F.when(pos % 4 == 0, F.concat(F.lit("So 5 and 3.\nFinal answer: "), k, F.lit(".\n"))).when(pos % 4 == 1, F.concat(F.lit("Final answer: "), k, F.lit(" apples"))).when(pos % 4 == 2, F.concat(F.lit("We get "), k)).otherwise("None.")
    text = F.when(free, said).otherwise(F.col("raw_output"))
    rows = responses(spark, sf_dir).select("*", F.concat(F.lit("m"), (pos % 3).cast("string")).alias("model"), F.concat(F.lit("run_"), (pos % 5).cast("string")).alias("source_file"), text.alias("said"), jsontext.read_response(text).alias("r"))
    return rows.withColumns(scoring.scored_row(F.col("said"), F.col("r"), F.col("gold_answer"), free, ORDER)).drop("r", "said", "raw_output")


@query
def agg_01_model_profile(spark, sf_dir):
    """Every metric of scored rows by model and condition."""
    found = profiles.scored_profile(_scored(spark, sf_dir), ["model", "condition"])
    ends = {f"{name}_{end}": F.col(f"{name}_ci.{end}") for name in ("accuracy", "strict_accuracy") for end in ("low", "high")}
    rounded = {n: F.round(F.col(n), 6) for n, t in found.dtypes if t == "double"}
    return found.withColumns({**rounded, **{n: F.round(c, 9) for n, c in ends.items()}, "source_files": F.array_join("source_files", ",")}).drop("accuracy_ci", "strict_accuracy_ci")


@query
def agg_11_model_contingency(spark, sf_dir):
    """Two-by-two counts of every comparison within each model; an item's last row in a model and condition counts."""
    rows = _scored(spark, sf_dir).select("model", "condition", "item_id", "pos", "correct", "strict")
    pairs = pairing.paired(pairing.last_wins(rows, ["model", "item_id", "condition"]), COMPARISONS, ["model"])
    flag = lambda side: profiles.first_known(F.col(f"{side}.strict"), F.col(f"{side}.correct"))
    counts = pairing.contingency(pairs, flag("t"), flag("c"), ["model", "comparison"])
    return counts.withColumns({"delta": F.round("delta", 9), "mcnemar_p": F.round("mcnemar_p", 9)})


@query
def agg_03_consistency_profile(spark, sf_dir):
    """Scores of responses by condition: rates over all rows, intervals, and the reasoning's consistency."""
    verdict = numbers.consistency(contracts.text_at(F.col("r.leaves"), "/reasoning"), scoring.predicted_answer(F.col("r.leaves")))
    rows = scoring.layered_score(_read(spark, sf_dir), "r", "gold_answer", ORDER, "integer").select("condition", "s", verdict.alias("v"))
    n = F.count("*")
    found = rows.groupBy("condition").agg(
        n.alias("examples"),
        F.count_if("s.semantic_correct").alias("semantic"),
        F.count_if("s.contract_valid_correct").alias("contract_valid"),
        stats.wilson(F.count_if("s.contract_valid_correct"), n).alias("ci"),
        F.count_if(F.col("v") == "inconsistent").alias("inconsistent"),
        F.count_if(F.col("v") == "not_assessable").alias("not_assessable"),
    )
    return found.select("condition", "examples", "semantic", "contract_valid", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"), "inconsistent", "not_assessable")


_ARGUMENTS = [contracts.Field("/arguments/sku", "string"), contracts.Field("/arguments/quantity_delta", "integer"), contracts.Field("/arguments/bins", "array"), contracts.Field("/arguments/bins/*", "integer", required=False)]


def _tool_scores(spark, sf_dir):
    read = tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "wanted_quantity", jsontext.read_call("raw_output").alias("r"))
    sku = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    return scoring.tool_score(read, "r", "adjust_stock", _ARGUMENTS, {"quantity_delta": [F.col("wanted_quantity")], "sku": [sku], "bins": [[1, 2]]})


@query
def agg_04_tool_profile(spark, sf_dir):
    """Shares of tool calls that pass each layer, by shape of the call."""
    flags = {f: F.col(f"s.{f}") for f in ("whole", "selected", "internal_valid", "external_valid", "arguments_correct", "success")}
    found = _tool_scores(spark, sf_dir).groupBy("l_linenumber").agg(F.count("*").alias("calls"), *profiles.rates(flags, "all"), F.count_if(F.col("s.internal_valid") & ~F.col("s.external_valid")).alias("transduction_failures"))
    return found.withColumns({f: F.round(F.col(f), 9) for f in flags})


@query
def sco_05_receipts(spark, sf_dir):
    """The digest of the state after every executable call."""
    read = tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", jsontext.read_call("raw_output").alias("r"))
    return scoring.receipts(read, "r", "adjust_stock", _ARGUMENTS).select("l_orderkey", "l_linenumber", "receipt")


@query
def agg_08_latency_per_token(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("item_id").agg(F.round(profiles.per_token(F.col("latency_ms"), F.col("generated_tokens")), 6).alias("latency_per_token"))


@query
def agg_10_conditional_counts(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("condition").agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("hit_max_new_tokens").alias("cap_hits"), F.count_if(F.col("strict").isNull()).alias("blank"), F.count_if(F.col("correct") & F.col("error").isNull()).alias("clean"))


@query
def agg_12_mcnemar_by_brand(spark, sf_dir):
    """Exact p-values of return flags A against N, brand by brand."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("condition"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_quantity") > 25).alias("correct"))
    best = lines.groupBy("item_id", "condition").agg(F.max_by(F.struct("pos", "correct"), F.struct("pos", "correct")).alias("r")).select("item_id", "condition", "r.*")
    made = pairing.paired(best, [("A_vs_N", "A", "N")], []).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_brand"), "item_id")
    counts = pairing.contingency(made, F.col("t.correct"), F.col("c.correct"), ["p_brand"])
    return counts.select("p_brand", "pairs", "treatment_only", "control_only", F.round("mcnemar_p", 9).alias("p"))


@query
def agg_21_conjunction(spark, sf_dir):
    """Whether every named check of a condition holds."""
    checks = F.bool_and(F.col("latency_ms") > 0) & F.bool_and(F.col("generated_tokens") <= 99) & (F.count("*") > 0)
    return runs(spark, sf_dir).groupBy("condition").agg(checks.alias("holds"))


@query
def agg_23_repair_summary(spark, sf_dir):
    """Of the items that a comparison's control loses, how many the treatment repairs."""
    lost = _pairs(spark, sf_dir).filter(~F.col("c.correct"))
    return lost.groupBy("comparison").agg(F.count("*").alias("available"), F.count_if("t.correct").alias("repaired"), F.min(F.when(F.col("t.correct"), F.col("item_id"))).alias("first_repaired"))


@query
def agg_24_totals(spark, sf_dir):
    """Totals of all scopes beside each other."""
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("scope"), F.count("*").alias("rows")) for t in ("events", "documents", "conversations", "labels", "benchmark")]
    return reduce(DataFrame.unionByName, parts)


@query
def win_04_last_rows(spark, sf_dir):
    return _arms(spark, sf_dir).select("item_id", "condition", "pos", "answer")


@query
def win_05_canary_rows(spark, sf_dir):
    """The first three rows of every condition."""
    return selection.first_per_reason(runs(spark, sf_dir).select("condition", "pos", "item_id"), "condition", "pos", 3)


@query
def srt_01_sorted_groups(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).orderBy("c_mktsegment", "c_nationkey")


@query
def smp_03_parity_selection(spark, sf_dir):
    """All discordant pairs and those concordant ones whose item is in the hashed sample."""
    drawn = F.substr(F.md5(F.col("item_id").cast("binary")), F.lit(1), F.lit(1)) < "4"
    differ = F.col("t.correct") != F.col("c.correct")
    return _pairs(spark, sf_dir).filter(differ | drawn).select("comparison", "item_id", differ.alias("discordant"))


@query
def set_01_union_all(spark, sf_dir):
    """Keys of two tables under one name; a table without a column gives null."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return a.unionByName(b, allowMissingColumns=True)


@query
def set_02_intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query
def set_05_overlap(spark, sf_dir):
    """How many ids a set of training documents, by source, shares with a holdout of labelled ones of quality; a holdout allows none."""
    held = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    shared = table(spark, sf_dir, "documents").select("doc_id", "source").join(held, "doc_id", "left_semi")
    return shared.groupBy("source").agg(F.count("*").alias("overlap"), F.min("doc_id").alias("first"))


@query
def scl_04_whole_object(spark, sf_dir):
    return _read(spark, sf_dir).select("pos", F.col("r.whole").alias("whole"), F.col("r.error").alias("error"))


@query
def scl_05_recovered(spark, sf_dir):
    """Responses whose object is recovered from around prose, with the answer's kind and text."""
    kept = _read(spark, sf_dir).filter("r.recovered and not r.whole")
    return kept.select("pos", contracts.kind_at(F.col("r.leaves"), "/answer").alias("kind"), contracts.text_at(F.col("r.leaves"), "/answer").alias("text"))


@query
def scl_05b_sliced(spark, sf_dir):
    """What lies between the first opening and the last closing brace, read strictly."""
    raw = F.regexp_extract("raw_output", r"(?s)(\{.*\})", 1)
    return responses(spark, sf_dir).select("pos", jsontext.read_response(raw).alias("r")).select("pos", F.col("r.whole").alias("whole"))


@query
def scl_06_answers(spark, sf_dir):
    """The answer as it counts for each scorer: floats do only for the older one."""
    leaves = F.col("r.leaves")
    return _read(spark, sf_dir).select("pos", scoring.predicted_answer(leaves).alias("strict"), scoring.predicted_answer(leaves, floats=True).alias("lax"))


@query
def scl_08_key_order(spark, sf_dir):
    return _read(spark, sf_dir).select("pos", F.array_join(contracts.key_order(F.col("r.leaves")), ",").alias("keys"))


@query
def scl_09_consistency(spark, sf_dir):
    leaves = F.col("r.leaves")
    return _read(spark, sf_dir).select("pos", numbers.consistency(contracts.text_at(leaves, "/reasoning"), scoring.predicted_answer(leaves)).alias("verdict"))


@query
def scl_10_sign_inverse(spark, sf_dir):
    return _pairs(spark, sf_dir).select("comparison", "item_id", numbers.sign_inverse(F.col("c.answer"), F.col("t.answer")).alias("flipped"))


@query
def scl_15_percent(spark, sf_dir):
    """Rates as reports show them."""
    return runs(spark, sf_dir).groupBy("item_id").agg(numbers.percent(F.count_if("correct") / F.lit(8.0)).alias("shown"))


@query
def scl_17_equal_values(spark, sf_dir):
    """Whether a quantity equals its spelling as a float, with an exponent or with a sign on zero, and as a string."""
    n = F.col("l_linenumber")
    q = F.when(n == 5, "0").otherwise(F.concat(F.col("l_quantity").cast("long").cast("string"), F.when(n == 6, "0" * 15).otherwise("")))
    other = F.when(n == 5, "-0.0").when(n == 6, F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("e+15"))).when(n == 7, F.concat(q, F.lit("e1"))).when(n % 2 == 0, F.concat(q, F.lit(".0"))).otherwise(F.concat(q, F.lit(".5")))
    same = scoring.equal_values(F.lit("integer"), q, F.lit("number"), other)
    kind = scoring.equal_values(F.lit("integer"), q, F.lit("string"), q)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", same.alias("as_number"), kind.alias("as_text"))


@query
def scl_18_accepted_options(spark, sf_dir):
    """Orders whose priority is among the options that their status accepts, each key by its own list."""
    options = F.create_map(F.lit("F"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), F.lit("O"), F.array(F.lit("5-LOW")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.array_contains(F.try_element_at(options, F.col("o_orderstatus")), F.col("o_orderpriority")), F.lit(False)).alias("accepted"))


@query
def scl_19_cap_hits(spark, sf_dir):
    return runs(spark, sf_dir).select("pos", (F.col("generated_tokens") >= 90).alias("cap"))


@query
def scl_20_prompt_parity(spark, sf_dir):
    """First turns that several conversations share, by digest."""
    first = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return first.groupBy("digest").agg(F.count("*").alias("conversations")).filter("conversations > 1")


@query
def sch_01_contracts(spark, sf_dir):
    """Which of the three answer contracts a whole response satisfies."""
    leaves = F.when(F.col("r.whole"), F.col("r.leaves"))
    return _read(spark, sf_dir).select("pos", *[contracts.conforms(leaves, contracts.answer_contract(name)).alias(name) for name in ("integer", "signed_string", "string")])


def _step(spark, sf_dir, step, contract: str, fields: Column, order: tuple[str, str] = ORDER) -> DataFrame:
    plan = Plan(tuple(contracts.answer_contract(contract, order)), (step,))
    raw = F.concat(F.lit("{"), fields, F.lit("}"))
    read = runs(spark, sf_dir).select("pos", jsontext.read_response(raw).alias("r"))
    return plan.run(read, F.col("r.leaves")).select("pos", "code", rendered(F.col("external")).alias("external"))


@query
def trf_01_integer_string(spark, sf_dir):
    fields = F.concat(F.lit('"reasoning": "r", "answer": '), F.when(F.col("pos") % 3 == 0, "-0").otherwise(F.col("answer")))
    return _step(spark, sf_dir, IntegerString("/answer"), "signed_string", fields)


@query
def trf_02_key_alias(spark, sf_dir):
    fields = F.concat(F.when(F.col("pos") % 3 == 0, '"reasoning"').otherwise('"why"'), F.lit(': "r", "answer": "'), F.col("k").cast("string"), F.lit('"'))
    return _step(spark, sf_dir, KeyAlias("reasoning", "why"), "signed_string", fields)


@query
def trf_03_field_order(spark, sf_dir):
    fields = F.concat(F.lit('"reasoning": "r", "answer": "'), F.col("k").cast("string"), F.lit('"'))
    return _step(spark, sf_dir, FieldOrder(("answer", "reasoning"), ("reasoning", "answer")), "string", fields, ("answer", "reasoning"))


@query
def trf_04_scratch_field(spark, sf_dir):
    fields = F.concat(F.lit('"scratch": "'), F.when(F.col("pos") % 4 == 0, "far too long").otherwise("short"), F.lit('", "reasoning": "r", "answer": "'), F.col("k").cast("string"), F.lit('"'))
    return _step(spark, sf_dir, ScratchField("scratch", 8), "string", fields)


@query
def trd_02_tool_arguments(spark, sf_dir):
    """The external arguments of every valid call, as text of the quantity."""
    external = scoring.tool_contract("adjust_stock", contracts.integers_as_strings(_ARGUMENTS))
    plan = Plan(tuple(external), tuple(IntegerString(f.path) for f in _ARGUMENTS if f.type == "integer"))
    read = tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", jsontext.read_call("raw_output").alias("r"))
    done = plan.run(read, F.when(F.col("r.whole"), F.col("r.leaves")))
    at = "/arguments/quantity_delta"
    return done.select("l_orderkey", "l_linenumber", "code", contracts.kind_at(F.col("external"), at).alias("kind"), contracts.text_at(F.col("external"), at).alias("quantity"))


@query
def sco_04_smoke_score(spark, sf_dir):
    """The first scorer: simple numbers, the last one counts, braces are sliced."""
    raw = F.regexp_extract("raw_output", r"(?s)(\{.*\})", 1)
    read = responses(spark, sf_dir).select("pos", "raw_output", "gold_answer", jsontext.read_response(raw).alias("r"))
    last = numbers.last_number(F.col("raw_output"), numbers.SIMPLE_NUMBER)
    return read.select("pos", (F.col("r.whole")).alias("object"), last.alias("last_number"), F.coalesce(last == F.col("gold_answer"), F.lit(False)).alias("correct"))


@query
def hsh_01_text_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query
def val_02_coverage(spark, sf_dir):
    """Items of the dimension that a condition lacks, and how many it has."""
    sums = runs(spark, sf_dir).rollup("condition").agg(F.countDistinct("item_id").alias("covered"), F.grouping("condition").alias("total"))
    all_items = F.max(F.when(F.col("total") == 1, F.col("covered"))).over(Window.partitionBy(F.lit(1)))  # one row a condition
    return sums.withColumn("missing", all_items - F.col("covered")).filter("total = 0").select("condition", "covered", "missing")


@query
def val_05_rescore(spark, sf_dir):
    """Rows whose stored verdict (right if gold and number agree) is not what scoring them again gives."""
    stored = F.col("gold_answer") == F.col("k").cast("string")
    scored = scoring.layered_score(_read(spark, sf_dir), "r", "gold_answer", ORDER, "integer")
    rows = scored.select("condition", F.col("s.semantic_correct").alias("now"), stored.alias("stored"))
    return rows.groupBy("condition").agg(F.count_if(F.col("now") != F.col("stored")).alias("changed"), F.count("*").alias("rows"))


@query
def val_08_stage_gate(spark, sf_dir):
    """Whether each order status passes: known customers, positive prices, unique keys."""
    orders = table(spark, sf_dir, "orders")
    a = validation.row_violations(orders, F.col("o_orderstatus"), {"positive_price": F.col("o_totalprice") > 0, "known_priority": F.col("o_orderpriority") != "5-LOW"})
    b = validation.group_violations(orders, F.col("o_orderstatus"), {"unique_keys": F.count("*") == F.countDistinct("o_orderkey")})
    return validation.gate(validation.all_violations([a, b]), orders.select(F.col("o_orderstatus").alias("scope")))


@query
def val_09_unlabelled(spark, sf_dir):
    """Documents by source that still need a manual label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return catalogue.restore_labels(docs, labels, ["doc_id"], ["quality"]).groupBy("source").agg(F.count_if(F.col("quality").isNull()).alias("open"), F.count("*").alias("all"))


@query
def val_10_contains_facts(spark, sf_dir):
    """Documents that contain or lack a required phrase, and those with a forbidden one."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.contains(text, F.lit("the"))).alias("required"), F.count_if(F.contains(text, F.lit("password"))).alias("forbidden"))


@query
def val_11_cross_check(spark, sf_dir):
    """Counts of pairs against the counts of their transitions: both ways must agree."""
    pairs = _pairs(spark, sf_dir)
    counts = pairing.contingency(pairs, F.col("t.correct"), F.col("c.correct"), ["comparison"])
    grid = pairing.transitions(pairs, F.col("t.correct"), F.col("c.correct")).groupBy("comparison").agg(F.count_if(F.col("transition") == 2).alias("repaired"), F.count_if(F.col("transition") == 1).alias("lost"))
    return counts.join(grid, "comparison").select("comparison", "treatment_only", "control_only", ((F.col("treatment_only") == F.col("repaired")) & (F.col("control_only") == F.col("lost"))).alias("agrees"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
