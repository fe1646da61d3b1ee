"""Registered queries of strict sources, schema documents, canonical digests, seeded draws and joins that refuse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwell.functions import canonical, contracts, jsontext, numbers, schemas, scoring, stats
from pairwell.operators import matrix, pairing, profiles, selection, validation
from pairwell.sources import lines as strict
from pairwell.sources import runs as io
from pairwell.sources.shared import new_folder
from pairwell.sources.stand_ins import COMPARISONS, dealt, responses, runs, table, tool_calls

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EVENT = "event_id long, event_type string, value double"
#: Lines of a file that stands for a run's output.
FILE_LINES = 4000


def query(f):
    _QUERIES[f.__name__] = f
    return f


def event_line() -> Column:
    """An event as a JSON line, some of them wrong: white space, cut, with text or another object behind, no object, of other types."""
    at = F.col("event_id")
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    return (
        F.when(at % 101 == 0, "\t   ")
        .when(at % 97 == 0, F.left(whole, F.lit(12)))
        .when(at % 89 == 0, F.concat(whole, F.lit(" x")))
        .when(at % 83 == 0, F.concat(whole, whole))
        .when(at % 79 == 0, F.concat(F.lit("["), at.cast("string"), F.lit("]")))
        .when(at % 73 == 0, F.concat(F.lit('{"event_id": "no number", "event_type": 1, "value": 2}')))
        .when(at % 71 == 0, F.concat(F.lit("  "), whole, F.lit("\t")))
        .otherwise(whole)
    )


def _files(lines: DataFrame, file: Column, order: str) -> str:
    """Writes value to a file for each number, in order, and gives the folder."""
    path = new_folder(lines.sparkSession)
    rows = lines.withColumn("file", file.cast("long")).repartition("file").sortWithinPartitions("file", order)
    rows.select("file", "value").write.partitionBy("file").text(path)
    return path


def _event_files(spark, sf_dir) -> str:
    return _files(table(spark, sf_dir, "events").select("event_id", event_line().alias("value")), F.floor(F.col("event_id") / FILE_LINES), "event_id")


def _file_number() -> Column:
    return F.regexp_extract("source_file", r"file=(\d+)", 1).cast("long").alias("file")


@query
def src_01_strict_lines(spark, sf_dir):
    """Of each written file: its good rows, its bad lines, and the number and problem of the first, at which a strict reading stops."""
    good, bad = strict.collected_lines(spark, [_event_files(spark, sf_dir)], EVENT)
    both = good.select("source_file", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("problem")).unionByName(bad.select("source_file", "line", "problem"))
    found = both.groupBy(_file_number()).agg(F.count_if(F.col("line").isNull()).alias("good"), F.count("line").alias("bad"), F.min("line").alias("first_line"), F.min_by("problem", "line").alias("first_problem"))
    return found


@query
def src_01_other_lines(spark, sf_dir):
    """Lines that are JSON but no object: a reading that does not ask for objects leaves them out, and is stopped by others."""
    good, bad = strict.collected_lines(spark, [_event_files(spark, sf_dir)], EVENT, objects=False)
    return bad.groupBy("problem").agg(F.count("*").alias("lines"), F.sum("line").alias("line_sum"))


@query
def src_03_numbered_rows(spark, sf_dir):
    """Every good row of the written files with its file and line."""
    good, _ = strict.collected_lines(spark, [_event_files(spark, sf_dir)], EVENT)
    return good.select(_file_number(), "line", "event_id", "event_type")


@query
def src_02_collecting_scan(spark, sf_dir):
    """Good rows and bad lines of a scan that collects errors, by type and problem."""
    lines = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), event_line().alias("value"))
    good, bad = strict.split_lines(lines, EVENT)
    both = good.select("scope", F.lit("none").alias("problem")).unionByName(bad.select("scope", "problem"))
    return both.groupBy("scope", "problem").agg(F.count("*").alias("lines"))


@query
def src_04_inventory(spark, sf_dir):
    """Rows, distinct keys, bytes and digest of every file that orders were written to."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = _files(orders.select("o_orderkey", io.json_line(orders.columns).alias("value")), F.floor(F.col("o_orderkey") / FILE_LINES), "o_orderkey")
    inventory = io.file_inventory(spark, [path], "o_custkey", pattern="*.txt").join(io.file_digests(spark, [path + "/*"]), "source_file")
    return inventory.select(_file_number(), "rows", "distinct_keys", "bytes", "sha256")


@query
def src_05_documents(spark, sf_dir):
    """Whole JSON documents, one a file and customers' nation: their problem, or the digest of their canonical form."""
    n = F.col("c_nationkey")
    text = F.when(n % 7 == 3, F.lit("[1]")).when(n % 7 == 5, F.lit('{"nation":')).otherwise(F.concat(F.lit('{\n  "nation": '), n.cast("string"), F.lit(',\n\n  "customers": '), F.col("customers").cast("string"), F.lit("\n}")))
    docs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers")).select("c_nationkey", text.alias("value"))
    path = _files(docs, F.col("c_nationkey"), "c_nationkey")
    found = strict.documents(spark, [path])
    return found.select(_file_number(), "problem", F.when(F.col("problem").isNull(), canonical.digest("text")).alias("sha256"))


@query
def hsh_02_signature(spark, sf_dir):
    """Run signatures of nested configurations with text beyond ASCII and floats: keys sorted at all depths, characters escaped, floats in their shortest form."""
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()
    inner = F.struct((F.col("c_nationkey") / 2).alias("zoom"), F.array(F.lit(1e20), F.lit(0.1)).alias("limits"))
    config = rows.select("*", F.struct(F.concat("c_mktsegment", F.lit(" é\U0001f600")).alias("segment"), inner.alias("inner"), F.lit(None).cast("string").alias("cap")).alias("config"))
    return io.signature(config, ["config"]).drop("config")


@query
def hsh_03_canonical_digests(spark, sf_dir):
    """Digests of one value spelled in another order and with blanks, in three byte forms."""
    text = F.concat(F.lit('{"z": {"b": '), F.col("value").cast("string"), F.lit(', "a": "ü/\\u00fc"}, "list": [3, {"y": null, "x": true}], "id": '), F.col("event_id").cast("string"), F.lit("}"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", canonical.digest("t").alias("escaped"), canonical.digest("t", escaped=False).alias("plain"), canonical.digest("t", escaped=False, newline=True).alias("line"))


def tool_documents(parts: DataFrame) -> DataFrame:
    """parts with doc: a tool's schema by the last digit of the brand; some cannot be taken over."""
    d = F.right("p_brand", F.lit(1)).cast("int")
    integer = F.when(d == 2, '{"type": "integer", "minimum": 0}').when(d == 3, '{"type": "tuple"}').otherwise('{"type": "integer"}')
    bins = F.when(d == 4, '{"type": "array"}').otherwise('{"type": "array", "items": {"type": "integer"}}')
    needed = F.when(d == 5, '["sku", "size"]').otherwise('["sku", "quantity_delta", "bins"]')
    return parts.withColumn("doc", F.concat(F.lit('{"type": "dict", "properties": {"sku": {"type": "string"}, "quantity_delta": '), integer, F.lit(', "bins": '), bins, F.lit('}, "required": '), needed, F.lit("}")))


@query
def sch_05_tool_schemas(spark, sf_dir):
    """Of each brand's tool schema: whether it becomes a document, with how many nodes, and whether its integers become strings."""
    parts = tool_documents(table(spark, sf_dir, "part").select("p_brand"))
    counted = parts.groupBy("p_brand", "doc").agg(F.count("*").alias("parts")).withColumn("tool", F.lit("adjust_stock"))
    both = schemas.with_nodes(counted, "doc", "tool")
    text = schemas.with_nodes(both.withColumnsRenamed({"problem": "p", "nodes": "n"}), "doc", "tool", integers=False)
    return text.select("p_brand", "parts", F.col("p").isNull().alias("strict"), F.size("n").alias("nodes"), F.col("problem").isNull().alias("as_strings"))


@query
def sch_01_documents(spark, sf_dir):
    """Every call of a tool against its own part's schema, in one plan: the first error's path, keyword and message."""
    brands = tool_documents(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    nodes = schemas.with_nodes(brands.withColumn("tool", F.lit("adjust_stock")), "doc", "tool").filter("problem is null").select(F.col("p_partkey").alias("l_partkey"), "nodes")
    calls = tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", jsontext.read_call("raw_output").alias("r"))
    found = calls.join(nodes, "l_partkey").select("l_orderkey", "l_linenumber", F.when(F.col("r.whole"), schemas.first_error(F.col("r.leaves"), F.col("nodes"))).alias("e"))
    return found.select("l_orderkey", "l_linenumber", F.col("e.path").alias("path"), F.col("e.keyword").alias("keyword"), F.col("e.message").alias("message"))


@query
def srt_04_first_error(spark, sf_dir):
    """The first error of nested lists by path, positions as numbers: item 2 before item 10."""
    schema = {"type": "object", "properties": {"lists": {"type": "array", "items": {"type": "array", "maxItems": 2, "items": {"type": "integer", "maximum": 60}}}}, "required": ["lists"], "additionalProperties": False}
    k = F.get_json_object("props", "$.k").cast("long")
    numbers = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.array(k + i, (k + 5 * i) % 97))
    rows = dealt(table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(numbers.alias("lists"))).alias("text")))
    read = rows.select("event_id", jsontext.read_call("text").alias("r"))
    found = read.select("event_id", schemas.first_error(F.col("r.leaves"), schemas.fixed(schema)).alias("e"))
    return found.select("event_id", F.col("e.path").alias("path"), F.col("e.message").alias("message"))


@query
def hsh_04_schema_digest(spark, sf_dir):
    """Digests of brands' schemas do not depend on the order of keys; those of the texts do."""
    docs = tool_documents(table(spark, sf_dir, "part").select("p_brand").distinct())
    turned = docs.select("p_brand", F.col("doc").alias("a"), F.regexp_replace("doc", r'\A\{"type": "dict", (.*)\}\z', '{$1, "type": "dict"}').alias("b"))
    return turned.select("p_brand", (canonical.digest("a") == canonical.digest("b")).alias("same_schema"), (F.sha2("a", 256) == F.sha2("b", 256)).alias("same_text"))


@query
def smp_01_seeded_shuffle(spark, sf_dir):
    """An eighth of the parts that no label excludes, as a seeded shuffle of their source order draws them."""
    eligible = table(spark, sf_dir, "part").select("p_partkey", "p_brand").filter(F.col("p_partkey") % 3 != 0)
    return selection.drawn(eligible, "p_partkey", max(1, eligible.count() // 8), 20260815, selection.shuffled_ranks)


@query
def smp_02_seeded_sample(spark, sf_dir):
    """A tenth of the orders of one status as a seeded sample of their source order draws them, with the order of the draw."""
    eligible = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    return selection.drawn(eligible, "o_orderkey", max(1, eligible.count() // 10), 20260731)


#: Items of a block whose interval is drawn in one task.
BLOCK = 50


@query
def agg_13_seeded_interval(spark, sf_dir):
    """The seeded Monte-Carlo interval of every comparison and block of items: blocks are of bounded size, each with draws of its own."""
    arms = pairing.last_wins(runs(spark, sf_dir), ["item_id", "condition"])
    pairs = pairing.paired(arms, COMPARISONS, [])
    block = F.floor(F.col("item_id").cast("long") / BLOCK).alias("block")
    each = pairs.select("comparison", block, F.col("item_id").cast("long").alias("item"), (F.col("t.correct").cast("int") - F.col("c.correct").cast("int")).alias("difference"))
    lists = each.groupBy("comparison", "block").agg(F.sort_array(F.collect_list(F.struct("item", "difference"))).alias("d"))
    named = lists.select("comparison", "block", F.col("d.difference").alias("differences"), F.concat_ws(":", "comparison", F.col("block").cast("string"), F.lit("legacy")).alias("seed_text"))
    ci = stats.seeded_interval("differences", "seed_text")
    return named.select("comparison", "block", F.size("differences").alias("pairs"), ci["low"].alias("low"), ci["high"].alias("high"))


@query
def jon_02_strict_pairs(spark, sf_dir):
    """Items of two arms, each of which holds an item once: a repeated one would fail the job."""
    last = pairing.last_wins(runs(spark, sf_dir).select("item_id", "condition", "pos", "correct"), ["item_id", "condition"])
    arm = lambda name: last.filter(F.col("condition") == name).select("item_id", "pos", "correct")
    found = pairing.strict_pairs(arm("view"), arm("click"), "item_id", "view_vs_click")
    return found.select("item_id", F.col("t.pos").alias("treatment_pos"), F.col("c.pos").alias("control_pos"), (F.col("t.correct") & F.col("c.correct")).alias("both"))


@query
def jon_10_strict_answers(spark, sf_dir):
    """Documents with their label as ground truth, which may not be repeated, or the reason that there is none."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return pairing.with_answers(docs, labels, "doc_id").select("doc_id", F.col("answer.quality").alias("quality"), "reason")


@query
def jon_11_strict_lookup(spark, sf_dir):
    """Order lines with their part's brand: a part that is missing or repeated would fail the job."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    found = pairing.looked_up(lines, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey")
    return found.groupBy(F.col("found.p_brand").alias("brand")).agg(F.count("*").alias("lines"))


ORDER = ("reasoning", "answer")


@query
def agg_03_full_profile(spark, sf_dir):
    """Scores of responses by condition: count, rate and interval of four layers, errors, caps, tokens, latency, negatives and consistency."""
    read = responses(spark, sf_dir).select("*", jsontext.read_response("raw_output").alias("r"))
    verdict = numbers.consistency(contracts.text_at(F.col("r.leaves"), "/reasoning"), scoring.predicted_answer(F.col("r.leaves")))
    rows = scoring.layered_score(read.withColumn("v", verdict), "r", "gold_answer", ORDER, "integer")
    flags = {n: F.col(f"s.{n}") for n in ("contract_valid_correct", "semantic_correct", "external_valid", "internal_valid")}
    more = {
        "gold_negative": F.count_if(F.startswith("gold_answer", F.lit("-"))),
        "predicted_negative": F.count_if(F.startswith("s.predicted", F.lit("-"))),
        "assessed": F.count_if(F.col("v") != "not_assessable"),
        **{n: F.count_if(F.col("v") == n) for n in ("consistent", "inconsistent", "not_assessable")},
        "consistent_share": F.count_if(F.col("v") == "consistent") / F.count_if(F.col("v") != "not_assessable"),
    }
    return _rounded(profiles.layer_profile(rows, ["condition"], flags, more))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(*[F.round(F.col(n), 6).alias(n) if t == "double" else F.col(n) for n, t in found.dtypes])


def _tool_rows(spark, sf_dir) -> DataFrame:
    """Scored calls with telemetry: a line's quantity stands for tokens, its price for latency."""
    arguments = [contracts.Field("/arguments/sku", "string"), contracts.Field("/arguments/quantity_delta", "integer"), contracts.Field("/arguments/bins", "array"), contracts.Field("/arguments/bins/*", "integer", required=False)]
    read = tool_calls(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "wanted_quantity", jsontext.read_call("raw_output").alias("r"))
    sku = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    scored = scoring.tool_score(read, "r", "adjust_stock", arguments, {"quantity_delta": [F.col("wanted_quantity")], "sku": [sku], "bins": [[1, 2]]})
    size = F.abs(F.col("wanted_quantity").cast("long"))
    return scored.withColumns({"generated_tokens": size, "latency_ms": size / 7, "error": F.when(F.col("l_orderkey") % 11 == 0, "timeout"), "hit_max_new_tokens": size >= 48})


@query
def agg_04_full_profile(spark, sf_dir):
    """Tool calls by shape: count, rate and interval of eight layers, errors, caps, failures to turn back, tokens and latency."""
    rows = _tool_rows(spark, sf_dir)
    flags = {n: F.col(f"s.{n}") for n in ("success", "selected", "whole", "internal_valid", "external_valid", "arguments_correct", "executed", "post_state_correct")}
    return _rounded(profiles.layer_profile(rows, ["l_linenumber"], flags, {"transduction_failures": F.count_if(F.col("s.internal_valid") & ~F.col("s.external_valid")), "repairs": F.sum(F.lit(0).cast("long"))}))


@query
def sco_03_first_failures(spark, sf_dir):
    """Tool calls by the first layer that fails, as a code, and shape."""
    return _tool_rows(spark, sf_dir).groupBy("l_linenumber", F.coalesce("s.error", F.lit("none")).alias("error")).agg(F.count("*").alias("calls"))


def _part_matrix(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The parts as a dataset in order, and four conditions that ran over it: one as it should be, others with rows missing, swapped or of other prompts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("item"), F.sha2("p_name", 256).alias("prompt"), "p_size")
    at, c = F.col("pos"), F.col("condition")
    rows = parts.withColumn("condition", F.explode(F.array(*map(F.lit, ("as_planned", "missing", "swapped", "prompts")))))
    other = F.when((c == "swapped") & (at % 97 == 3), at + 1).when((c == "swapped") & (at % 97 == 4), at - 1).otherwise(at)
    item = F.concat(F.lit("part_"), other.cast("string"))
    prompt = F.when((c == "prompts") & (at % 89 == 5), F.sha2(F.concat("prompt", F.lit("x")), 256)).otherwise(F.col("prompt"))
    rows = rows.filter((c != "missing") | (at % 101 != 7))
    rows = rows.select("condition", "pos", item.alias("item"), prompt.alias("prompt"), F.when((c == "prompts") & (at % 50 == 1), "rerun").otherwise("first").alias("run"), F.when((c == "as_planned") & (at % 60 == 2), "timeout").alias("error"))
    return parts.select("pos", "item", "prompt"), rows


@query
def val_03_matrix(spark, sf_dir):
    """What is wrong with each condition of a matrix of runs: positions whose item or prompt is not the dataset's, several runs in one, errors."""
    expected, rows = _part_matrix(spark, sf_dir)
    return matrix.violations(expected, rows, "condition", ["item", "prompt"], ["run"], {"no_error": F.col("error").isNull()})


@query
def val_03_differences(spark, sf_dir):
    """Every position of the matrix at which a condition does not hold the dataset's item or prompt, with both values."""
    expected, rows = _part_matrix(spark, sf_dir)
    return matrix.differences(expected, rows, "condition", ["item", "prompt"])


@query
def val_06_tool_rows(spark, sf_dir):
    """What is wrong with tool runs by shape: calls that are not whole, other tools, errors, caps, valid calls that were not executed."""
    rows = _tool_rows(spark, sf_dir)
    checks = {"whole": F.col("s.whole"), "selected": F.col("s.selected"), "no_error": F.col("error").isNull(), "no_cap": ~F.col("hit_max_new_tokens"), "executed_if_valid": F.col("s.executed") == F.col("s.external_valid"), "state_if_right": F.col("s.post_state_correct") == F.col("s.arguments_correct")}
    return validation.row_violations(rows, F.concat(F.lit("shape_"), F.col("l_linenumber").cast("string")), checks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)
