
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell import queries_items as items
from pairwell import queries_layers as layers
from pairwell import queries_reports as reports
from pairwell import queries_strict as strict
from pairwell.functions import contracts, jsontext, numbers, scoring, stats
from pairwell.operators import catalogue, pairing, profiles, report, selection, validation
from pairwell.plans.transforms import FieldOrder, IntegerString, KeyAlias, Plan, ScratchField, rendered
from pairwell.queries_sql import SQL
from pairwell.sources import runs as io
from pairwell.sources.stand_ins import COMPARISONS, responses, runs, table, tool_calls

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORDER = ("reasoning", "answer")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def dp(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.last_wins(runs(spark, sf_dir), ["item_id", "condition"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.paired(arms(spark, sf_dir), COMPARISONS, [])


# scans


@query
def snk_01_json_lines(spark, sf_dir):
    """Orders as compact JSON lines with sorted keys, by digest."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return rows.select("o_orderkey", F.sha2(io.json_line(rows.columns, sort_keys=True), 256).alias("line_sha256"))


# filters and projections


@query
def fil_01_exclude(spark, sf_dir):
    """Documents by source before and after leaving out toxic ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1")
    left = selection.without_items(docs, toxic, "doc_id").groupBy("source").agg(F.count("*").alias("kept"))
    return docs.groupBy("source").agg(F.count("*").alias("all")).join(left, "source", "left").select("source", "all", (F.col("all") - F.coalesce("kept", F.lit(0))).alias("excluded"))


@query
def fil_02_exclude_then_slice(spark, sf_dir):
    """The slice of positions 100 to 600 of documents, counted after leaving out toxic ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.sliced(docs, table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", 100, 600, None, "doc_id").select("doc_id", "source", "index")


@query
def fil_04_cap_or_error(spark, sf_dir):
    return catalogue.completions(runs(spark, sf_dir)).groupBy("comparison", "failure_class").agg(F.count("*").alias("n"))


@query
def prj_03_legacy_fallback(spark, sf_dir):
    """Rates with a fallback for missing keys against one for nulls: rows of three conditions lack the new key."""
    rows = runs(spark, sf_dir)
    keys = F.when(F.col("condition").isin("click", "view", "error"), F.array(F.lit("correct"))).otherwise(F.array(F.lit("correct"), F.lit("strict")))
    missing = profiles.if_present(keys, "strict", F.col("strict"), F.col("correct"))
    return rows.groupBy("condition").agg(dp(stats.rate_all(missing)).alias("missing_only"), dp(stats.rate_all(profiles.first_known(F.col("strict"), F.col("correct")))).alias("null_too"))


@query
def prj_05_prediction_cells(spark, sf_dir):
    cell = report.prediction_cell(F.col("answer"), F.col("correct"), F.col("strict"), F.col("error"), F.col("hit_max_new_tokens"))
    return runs(spark, sf_dir).select("pos", cell.alias("cell"))


def _eligibility() -> Column:
    return catalogue.first_reason(
        [
            ("no_customer_segment", F.col("c_mktsegment").isNull()),
            ("not_finished", F.col("o_orderstatus") != "F"),
            ("low_priority", F.col("o_orderpriority") == "5-LOW"),
            ("too_small", F.col("o_totalprice") < 50_000),
        ]
    )


@query
def prj_07_eligibility(spark, sf_dir):
    """The first reason that an order is not eligible, null if it is."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    return joined.select("o_orderkey", _eligibility().alias("reason"))


@query
def agg_18_reason_counts(spark, sf_dir):
    return prj_07_eligibility(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n")).orderBy("reason")


@query
def prj_09_explode_references(spark, sf_dir):
    """Negative wanted quantities of tool calls, one row a reference."""
    refs = F.filter(F.array(F.col("wanted_quantity").cast("long")), lambda v: v < 0)
    return tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(refs).alias("value"))


@query
def prj_10_budget(spark, sf_dir):
    """What each segment has left of a budget in exact decimals, never below nothing."""
    spent = F.sum(F.col("c_acctbal").cast("decimal(18,2)"))
    limit = F.lit(5_000_000).cast("decimal(28,2)")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.greatest(F.lit(0).cast("decimal(28,2)"), limit - spent).cast("double").alias("left"), (spent <= limit).alias("within"))


# joins and pairs


@query
def agg_11_paired_contingency(spark, sf_dir):
    """Two-by-two counts, difference and exact McNemar p-value of every comparison; the last row of an item counts."""
    counts = pairing.contingency(pairs(spark, sf_dir), F.col("t.correct"), F.col("c.correct"), ["comparison"])
    return counts.withColumns({"delta": dp(F.col("delta"), 9), "mcnemar_p": dp(F.col("mcnemar_p"), 9)})


@query
def agg_11_strict_contingency(spark, sf_dir):
    """As above by the strict flag, the other one where it is unknown."""
    flag = lambda side: profiles.first_known(F.col(f"{side}.strict"), F.col(f"{side}.correct"))
    counts = pairing.contingency(pairs(spark, sf_dir), flag("t"), flag("c"), ["comparison"])
    return counts.withColumns({"delta": dp(F.col("delta"), 9), "mcnemar_p": dp(F.col("mcnemar_p"), 9)})


@query
def jon_01_part_pairs(spark, sf_dir):
    """Parts as items and return flags as conditions: the largest pairing load."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_returnflag").alias("condition"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_quantity") > 25).alias("correct"))
    best = lines.groupBy("item_id", "condition").agg(F.max_by(F.struct("pos", "correct"), F.struct("pos", "correct")).alias("r")).select("item_id", "condition", "r.*")
    made = pairing.paired(best, [("A_vs_N", "A", "N"), ("R_vs_N", "R", "N"), ("A_vs_R", "A", "R")], [])
    counts = pairing.contingency(made, F.col("t.correct"), F.col("c.correct"), ["comparison"])
    return counts.withColumns({"delta": dp(F.col("delta"), 9), "mcnemar_p": dp(F.col("mcnemar_p"), 9)})


@query
def agg_14_exact_bootstrap(spark, sf_dir):
    counts = pairing.with_exact_interval(pairing.contingency(pairs(spark, sf_dir), F.col("t.correct"), F.col("c.correct"), ["comparison"]))
    return counts.select("comparison", "pairs", dp(F.col("bootstrap.low"), 9).alias("low"), dp(F.col("bootstrap.high"), 9).alias("high"))


@query
def agg_22_repairs_and_regressions(spark, sf_dir):
    """Items that the treatment repairs or loses."""
    moved = pairing.transitions(pairs(spark, sf_dir), F.col("t.correct"), F.col("c.correct"))
    return moved.filter(F.col("transition").isin(1, 2)).select("comparison", "item_id", F.when(F.col("transition") == 2, "repair").otherwise("regression").alias("kind"))


@query
def agg_25_decision(spark, sf_dir):
    """Each comparison's decision: enough repairs, more than regressions, and a small p-value."""
    counts = pairing.contingency(pairs(spark, sf_dir), F.col("t.correct"), F.col("c.correct"), ["comparison"])
    go = (F.col("treatment_only") >= 5) & (F.col("delta") > 0) & (F.col("mcnemar_p") < 0.05)
    return counts.select("comparison", F.when(go, "adopt").when(F.col("treatment_only") >= 5, "keep_testing").otherwise("stop").alias("decision"))


@query
def agg_26_transition_grid(spark, sf_dir):
    moved = pairing.transitions(pairs(spark, sf_dir), F.col("t.correct"), F.col("c.correct"))
    return moved.select("comparison", "item_id", "transition")


@query
def jon_02_repeated_items(spark, sf_dir):
    """Items that an arm repeats, which a strict pairing refuses."""
    return pairing.repeated(runs(spark, sf_dir), ["item_id", "condition"])


@query
def jon_03_ordered_mismatches(spark, sf_dir):
    """Positions at which the arms click and view do not hold the same item."""
    own = lambda c: selection.numbered(runs(spark, sf_dir).filter(F.col("condition") == c).select("pos", "item_id"), "pos")
    return pairing.ordered_mismatches(own("click"), own("view"), "index")


@query
def jon_05_pending(spark, sf_dir):
    """Documents that no label completes."""
    return selection.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query
def jon_06_unseen(spark, sf_dir):
    """Customers that no order has seen."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return selection.pending(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, "c_custkey")


@query
def jon_07_semi_ordered(spark, sf_dir):
    """Orders of building customers, in the order of orders."""
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return selection.in_both(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), wanted, "o_custkey").orderBy("o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


def _three_way(spark, sf_dir):
    found = arms(spark, sf_dir).filter(F.col("condition").isin("purchase", "signup", "view")).groupBy("item_id").agg(F.count("*").alias("n"), F.min("correct").alias("all_right"), F.max("correct").alias("any_right"))
    return found.filter("n = 3")


@query
def jon_08_three_way(spark, sf_dir):
    """Items that all three conditions get right, or none does."""
    found = _three_way(spark, sf_dir)
    return found.filter("all_right or not any_right").select("item_id", F.when(F.col("all_right"), "all_correct").otherwise("none_correct").alias("kind"))


@query
def jon_08c_order_discordance(spark, sf_dir):
    found = catalogue.order_discordance(pairs(spark, sf_dir))
    return found.select("item_id", "comparison", "failure_class")


@query
def jon_09_restore_labels(spark, sf_dir):
    """Documents with their manual labels restored; null where there is none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(None).cast("int").alias("quality"))
    return catalogue.restore_labels(docs, table(spark, sf_dir, "labels"), ["doc_id"], ["quality"])


@query
def jon_10_ground_truth(spark, sf_dir):
    """Parts with their sold quantity as ground truth, or the reason that there is none."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("sold"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = parts.join(sold, parts.p_partkey == sold.l_partkey, "left")
    return joined.select("p_partkey", "sold", F.when(F.col("sold").isNull(), "missing_ground_truth").alias("reason"))


@query
def jon_12_field_differences(spark, sf_dir):
    """Fields in which the arms of an item differ, one row a field."""
    both = arms(spark, sf_dir)
    side = lambda c: both.filter(F.col("condition") == c).select("item_id", "answer", "correct", "strict", "error")
    return pairing.field_differences(side("signup"), side("purchase"), ["item_id"], ["answer", "correct", "strict", "error"])


@query
def agg_16_field_agreement(spark, sf_dir):
    both = pairs(spark, sf_dir).filter("comparison = 'purchase_vs_signup'")
    found = jon_12_field_differences(spark, sf_dir)
    return pairing.field_agreement(found, both, ["answer", "correct", "strict", "error"], "item_id")


@query
def agg_17_all_fields_equal(spark, sf_dir):
    """Pairs whose compared fields all agree."""
    same = F.struct("t.answer", "t.correct", "t.strict", "t.error").eqNullSafe(F.struct("c.answer", "c.correct", "c.strict", "c.error"))
    return pairs(spark, sf_dir).groupBy("comparison").agg(F.count("*").alias("pairs"), F.count_if(same).alias("equal"))


# profiles


@query
def agg_01_condition_profile(spark, sf_dir):
    flags = {"accuracy": F.col("correct"), "strict_accuracy": F.col("strict")}
    found = profiles.profile(runs(spark, sf_dir), ["condition"], flags, "known")
    doubles = [n for n, t in found.dtypes if t == "double"]
    return found.withColumns({n: dp(F.col(n)) for n in doubles})


@query
def agg_02_profile_null_false(spark, sf_dir):
    rows = runs(spark, sf_dir)
    n, all_rows = stats.successes(F.col("strict")), F.count("*")
    found = rows.groupBy("condition").agg(all_rows.alias("examples"), n.alias("strict"), stats.wilson(n, all_rows).alias("ci"), F.count_if(F.startswith("answer", F.lit("-"))).alias("negative_answers"))
    return found.select("condition", "examples", "strict", dp(F.col("strict") / F.col("examples"), 9).alias("rate"), dp(F.col("ci.low"), 9).alias("low"), dp(F.col("ci.high"), 9).alias("high"), "negative_answers")


@query
def agg_05_null_policies(spark, sf_dir):
    """Label rates by language when unlabelled documents are left out, or count as false."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flag = F.col("quality") == 1
    return docs.groupBy("lang").agg(F.count("*").alias("n"), dp(stats.rate_known(flag), 9).alias("known"), dp(stats.rate_all(flag), 9).alias("of_all"))


@query
def agg_06_wilson(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count("*").alias("n"))
    ci = stats.wilson(F.col("k"), F.col("n"))
    return lines.select("l_suppkey", "k", "n", dp(ci["low"], 9).alias("low"), dp(ci["high"], 9).alias("high"))


@query
def agg_09_exact_total(spark, sf_dir):
    """The sum of latencies without error, rounded once, and their median; thirds are added, whose sum depends on the order."""
    rows = runs(spark, sf_dir).withColumn("third", F.col("latency_ms") / 3)
    total = profiles.exact_totals(rows, ["condition"], "third", "third_total")
    medians = rows.groupBy(F.col("condition").alias("c")).agg(F.median("latency_ms").alias("latency_median"))
    return total.join(medians, F.col("condition") == F.col("c")).select("condition", dp(F.col("third_total"), 8).alias("third_total"), "latency_median")


@query
def agg_15_assessed_ratio(spark, sf_dir):
    """Share of consistent responses among those that can be assessed."""
    read = responses(spark, sf_dir).select("condition", jsontext.read_response("raw_output").alias("r"))
    verdict = numbers.consistency(contracts.text_at(F.col("r.leaves"), "/reasoning"), scoring.predicted_answer(F.col("r.leaves")))
    found = read.select("condition", verdict.alias("v")).groupBy("condition").agg(F.count_if(F.col("v") != "not_assessable").alias("assessed"), F.count_if(F.col("v") == "consistent").alias("consistent"))
    return found.withColumn("ratio", dp(F.try_divide("consistent", "assessed"), 9))


@query
def agg_19_invariants(spark, sf_dir):
    found = profiles.invariants(runs(spark, sf_dir), ["error", "strict", "correct"], ["condition"])
    return found.select("condition", "column", F.array_join("values", ",").alias("values"), "n_values")


@query
def agg_20_uniqueness(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("rows"), F.countDistinct("item_id").alias("items"), F.countDistinct("answer").alias("answers"))


# windows, sorts, samples, sets


@query
def win_01_source_index(spark, sf_dir):
    """Every order's index in the order of keys, counted in parallel."""
    return selection.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "source_index")


@query
def win_02_first_appearance(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("item_id").agg(F.min("pos").alias("first_pos"))


@query
def win_03_first_per_reason(spark, sf_dir):
    """The first five orders of each reason."""
    rows = prj_07_eligibility(spark, sf_dir).select(F.coalesce("reason", F.lit("eligible")).alias("reason"), "o_orderkey")
    return selection.first_per_reason(rows, "reason", "o_orderkey", 5)


@query
def srt_02_catalogue_order(spark, sf_dir):
    """Losses in catalogue order: index 0 and a missing index sort first."""
    found = catalogue.losses(pairs(spark, sf_dir))
    key = catalogue.catalogue_order(F.col("item_id").cast("long"))
    return found.select("item_id", "comparison", "failure_class", "confidence", key.alias("sort_key")).orderBy("sort_key", "comparison")


@query
def srt_05_top_scores(spark, sf_dir):
    """The eight best latencies of each condition, by partial aggregation."""
    rows = runs(spark, sf_dir).select("condition", (-F.col("latency_ms")).alias("worst"), "pos")
    found = selection.first_per_reason(rows.select("condition", F.struct("worst", "pos").alias("at")), "condition", "at", 8)
    return found.select("condition", F.col("at.pos").alias("pos"), (-F.col("at.worst")).alias("latency_ms"))


@query
def smp_04_stress_set(spark, sf_dir):
    """Order lines with a negative wanted quantity that are not in the hashed primary sample."""
    calls = tool_calls(spark, sf_dir)
    negative = calls.filter(F.col("wanted_quantity").startswith("-")).select("l_orderkey", "l_linenumber")
    primary = calls.filter(F.substr(F.md5(F.col("l_orderkey").cast("string").cast("binary")), F.lit(1), F.lit(1)) < "4").select("l_orderkey").distinct()
    return negative.join(primary, "l_orderkey", "left_anti")


@query
def smp_05_targeted_suite(spark, sf_dir):
    """Items lost in a comparison, right everywhere or wrong everywhere, with all reasons."""
    names = ["constrained_semantic_loss", "matched_all_correct_control", "shared_wrong_diagnostic"]
    three = _three_way(spark, sf_dir)
    marks = [catalogue.losses(pairs(spark, sf_dir)).select("item_id", F.lit(names[0]).alias("reason")), three.filter("all_right").select("item_id", F.lit(names[1]).alias("reason")), three.filter("not any_right").select("item_id", F.lit(names[2]).alias("reason"))]
    return catalogue.targeted(reduce(DataFrame.unionByName, marks), names)


def _lost(spark, sf_dir, comparison: str) -> DataFrame:
    return catalogue.losses(pairs(spark, sf_dir)).filter(F.col("comparison") == comparison).select("item_id")


@query
def set_03_loss_union(spark, sf_dir):
    """Items lost in either of two comparisons, and whether in both."""
    a, b = _lost(spark, sf_dir, "purchase_vs_signup"), _lost(spark, sf_dir, "error_vs_signup")
    both = a.intersect(b).select("item_id", F.lit(True).alias("shared"))
    return a.union(b).distinct().join(both, "item_id", "left").select("item_id", F.coalesce("shared", F.lit(False)).alias("shared"))


@query
def set_04_missing_coverage(spark, sf_dir):
    """Parts that no order line covers."""
    return table(spark, sf_dir, "part").select("p_partkey").exceptAll(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct())


@query
def set_06_identity_union(spark, sf_dir):
    """Distinct identities of orders under either of their keys."""
    return table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderkey", "o_custkey")).alias("identity")).distinct()


@query
def jon_08d_catalogue(spark, sf_dir):
    """The whole failure catalogue by type and class."""
    parts = [catalogue.losses(pairs(spark, sf_dir)), catalogue.negatives(runs(spark, sf_dir)), catalogue.order_discordance(pairs(spark, sf_dir)), catalogue.completions(runs(spark, sf_dir))]
    return reduce(DataFrame.unionByName, parts).groupBy("record_type", "comparison", "failure_class", "confidence").agg(F.count("*").alias("n"))


# text


@query
def scl_01_last_number(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", numbers.last_number(F.col("text")).alias("last_number"), F.size(numbers.numbers(F.col("text"))).cast("long").alias("mentions"))


@query
def scl_02_canonical_number(spark, sf_dir):
    """Prices as dollar texts, brought to one spelling."""
    shown = F.concat(F.lit(" $"), F.format_number("o_totalprice", 2), F.lit(". "))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.canonical_number(shown).alias("price"))


def _free_text() -> Column:
    k = F.col("k").cast("string")
    shape = F.col("pos") % 6
    texts = [
        F.concat(F.lit("I add 3 and get it. Final answer: "), k, F.lit(".")),
        F.concat(F.lit("final ANSWER : "), k, F.lit(" because 5 is less")),
        F.concat(F.lit("First 4 then "), k),
        F.lit("7 tries. Final answer: none"),
        F.concat(F.lit("Final answer: 9\nFinal answer:\n"), k, F.lit(" .\n\t")),
        F.concat(F.lit("Final answer: "), k, F.lit("\n")),
    ]
    return F.element_at(F.array(*texts), (shape + 1).cast("int"))


@query
def scl_03_free_answer(spark, sf_dir):
    found = numbers.free_answer(_free_text())
    return runs(spark, sf_dir).select("pos", found.alias("f")).select("pos", "f.*")


@query
def scl_07_strict_number(spark, sf_dir):
    """Whether a written price is nothing but a number: with units, signs, fractions and white space of all kinds."""
    price = F.format_number("o_totalprice", 2)
    around = [("", " USD"), ("", "\n"), ("+", ""), ("\t-", " "), ("", "/2"), ("7/", ""), ("", "\u2003"), ("$", "")]
    shown = F.element_at(F.array(*[F.concat(F.lit(a), price, F.lit(b)) for a, b in around]), (F.col("o_orderkey") % len(around) + 1).cast("int"))
    shown = F.when(F.col("o_orderkey") % 16 == 5, F.lit("1/1,000")).otherwise(shown)
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.strict_number(shown).alias("strict"))


@query
def scl_12_gold_answer(spark, sf_dir):
    """Gold answers after the last mark, up to a newline; every fifth text has no number there."""
    k = F.col("k").cast("string")
    solution = F.concat(F.lit("so #### 1 then ####"), F.when(F.col("pos") % 5 == 0, " none").otherwise(F.concat(F.lit("\t"), k, F.lit(" \n"))))
    return runs(spark, sf_dir).select("pos", numbers.gold_answer(solution).alias("gold"))


@query
def scl_13_id_index(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.id_index(F.concat(F.when(F.col("c_custkey") % 2 == 0, "customer_").otherwise("other_"), F.col("c_custkey").cast("string")), "customer").alias("index"))


@query
def scl_11_tail_and_cell(spark, sf_dir):
    """The last 240 characters of every text as a table cell, by digest."""
    cell = numbers.table_cell(numbers.tail_of(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(cell.cast("binary"), 256).alias("cell_sha256"))


@query
def scl_16_prompts(spark, sf_dir):
    """A prompt for every turn, by length and digest."""
    prompt = F.concat(F.lit('Solve the problem. Return only one JSON object with the keys "reasoning" and "answer".\n\nProblem:\n'), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length(prompt).cast("long").alias("chars"), F.sha2(prompt.cast("binary"), 256).alias("prompt_sha256"))


# scores, transforms, validation, reports


@query
def sco_01_baseline_score(spark, sf_dir):
    shape, variant, k = F.col("pos") % 8, F.floor(F.col("pos") / 8) % 4, F.col("k").cast("string")
    said = lambda reasoning, answer: F.concat(F.lit('{"reasoning": "'), reasoning, F.lit('", "answer": "'), answer, F.lit('"}'))
    odd = F.when(variant == 1, said(F.repeat(F.lit("x"), F.lit(300)), k)).when(variant == 2, said(F.lit("so"), F.concat(k, F.lit(" kg")))).when(variant == 3, said(F.lit("so"), F.concat(F.lit("+"), k)))
    raw = F.when((shape == 3) & (variant > 0), odd).otherwise(F.col("raw_output"))
    read = responses(spark, sf_dir).select("pos", jsontext.read_response(raw).alias("r"))
    return read.select("pos", scoring.baseline_score(F.col("r"), ORDER).alias("s")).select("pos", "s.*")


@query
def sco_02_layered_score(spark, sf_dir):
    read = responses(spark, sf_dir).select("pos", "gold_answer", jsontext.read_response("raw_output").alias("r"))
    return scoring.layered_score(read, "r", "gold_answer", ORDER, "integer").select("pos", "s.*")


@query
def sco_06_rescore_difference(spark, sf_dir):
    """Verdicts that change when an integer contract is replaced by one for strings."""
    read = responses(spark, sf_dir).select("pos", "gold_answer", jsontext.read_response("raw_output").alias("r"))
    one = scoring.layered_score(read, "r", "gold_answer", ORDER, "integer").withColumnRenamed("s", "a")
    both = scoring.layered_score(one, "r", "gold_answer", ORDER, "signed_string").withColumnRenamed("s", "b")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("before"), F.col(f"b.{f}").alias("after")) for f in ("internal_valid", "external_valid", "contract_valid_correct")])
    return both.select("pos", F.explode(cells).alias("x")).select("pos", "x.*").filter("before <> after")


_ARGUMENTS = [contracts.Field("/arguments/sku", "string"), contracts.Field("/arguments/quantity_delta", "integer"), contracts.Field("/arguments/bins", "array"), contracts.Field("/arguments/bins/*", "integer", required=False)]


@query
def sco_03_tool_score(spark, sf_dir):
    read = tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "wanted_quantity", jsontext.read_call("raw_output").alias("r"))
    accepted = {"quantity_delta": [F.col("wanted_quantity")], "sku": [F.lit("none"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"))], "bins": [[3], [1, 2]]}
    return scoring.tool_score(read, "r", "adjust_stock", _ARGUMENTS, accepted).select("l_orderkey", "l_linenumber", "s.*")


def answer_plan() -> Plan:
    """Scratch first, the reasoning under another name, an integer answer, answer and reasoning swapped."""
    external = tuple(contracts.answer_contract("signed_string", ("answer", "reasoning")))
    return Plan(external, (ScratchField("scratch", 40), KeyAlias("reasoning", "why"), IntegerString("/answer"), FieldOrder(("answer", "reasoning"), ("reasoning", "answer"))))


@query
def trf_07_transduce(spark, sf_dir):
    """Internal objects turned back to external ones; every sixth lacks the scratch field, every seventh has a float."""
    k = F.col("k").cast("string")
    scratch = F.when(F.col("pos") % 6 == 0, "").otherwise('"scratch": "notes", ')
    answer = F.when(F.col("pos") % 7 == 0, F.concat(k, F.lit(".0"))).otherwise(k)
    raw = F.concat(F.lit("{"), scratch, F.lit('"why": "it is '), k, F.lit('", "answer": '), answer, F.lit("}"))
    read = runs(spark, sf_dir).select("pos", jsontext.read_response(raw).alias("r"))
    return answer_plan().run(read, F.col("r.leaves")).select("pos", "code", rendered(F.col("external")).alias("external"))


@query
def val_01_violations(spark, sf_dir):
    """Failed checks of every condition's rows: row checks in one scan, group checks in another."""
    rows = runs(spark, sf_dir)
    a = validation.row_violations(rows, F.col("condition"), {"no_error": F.col("error").isNull(), "below_cap": ~F.col("hit_max_new_tokens"), "positive_latency": F.col("latency_ms") > 0, "strict_known": F.col("strict").isNotNull()})
    b = validation.group_violations(rows, F.col("condition"), {"unique_items": F.count("*") == F.countDistinct("item_id"), "some_rows": F.count("*") > 0})
    return validation.all_violations([a, b])


@query
def val_07_gate(spark, sf_dir):
    return validation.gate(val_01_violations(spark, sf_dir), runs(spark, sf_dir).select(F.col("condition").alias("scope")))


@query
def hsh_05_one_environment(spark, sf_dir):
    """How many environments (line status and ship year, by digest) the lines of each return flag and supplier ran under: one is consistent."""
    digest = F.sha2(F.to_json(F.struct("l_linestatus", F.year("l_shipdate").alias("year"))), 256)
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.countDistinct(digest).alias("environments"), F.count("*").alias("rows"))
    return found.withColumn("holds", F.col("environments") == 1)


@query
def snk_05_item_matrix(spark, sf_dir):
    rows = arms(spark, sf_dir)
    cell = report.prediction_cell(F.col("answer"), F.col("correct"), F.col("strict"), F.col("error"), F.col("hit_max_new_tokens"))
    return report.item_matrix(rows, ["click", "error", "purchase", "signup", "view"], cell)


@query
def agg_27_canonical_delta(spark, sf_dir):
    """Per condition, responses whose answer is a canonical integer, and those that the broad contract takes too."""
    read = responses(spark, sf_dir).select("condition", jsontext.read_response("raw_output").alias("r"))
    leaves = F.when(F.col("r.whole"), F.col("r.leaves"))
    broad = contracts.conforms(leaves, contracts.answer_contract("string", ORDER))
    narrow = contracts.conforms(leaves, contracts.answer_contract("signed_string", ORDER))
    return read.groupBy("condition").agg(F.count_if(broad).alias("broad"), F.count_if(narrow).alias("canonical"), F.count_if(broad & ~narrow).alias("not_canonical"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | layers.queries() | strict.queries() | items.queries() | reports.queries()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

