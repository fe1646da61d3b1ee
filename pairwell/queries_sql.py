"""The SQL that gives each registered query's rows, for an engine with the same tables."""

from __future__ import annotations

from pairwell.queries_items_sql import SQL as ITEMS
from pairwell.queries_reports_sql import SQL as REPORTS
from pairwell.queries_strict_sql import SQL as STRICT

_RUNS = r"""
WITH e AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k FROM events),
runs AS (
  SELECT CAST(user_id AS VARCHAR) AS item_id, event_type AS condition, event_id AS pos, k, value AS latency_ms, k AS generated_tokens,
         k % 2 = 0 AS correct, CASE WHEN k % 5 <> 0 THEN k % 3 = 0 END AS strict,
         CASE WHEN k % 7 = 0 THEN 'timeout' END AS error, k >= 95 AS hit_max_new_tokens,
         (CASE WHEN event_id % 4 = 0 THEN '-' ELSE '' END) || CAST(k AS VARCHAR) AS answer
  FROM e
)"""

_ARMS = (
    _RUNS
    + """,
arms AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY item_id, condition ORDER BY pos DESC) = 1),
names(comparison, t, c) AS (VALUES ('purchase_vs_signup', 'purchase', 'signup'), ('view_vs_click', 'view', 'click'), ('error_vs_signup', 'error', 'signup')),
pairs AS (
  SELECT comparison, x.item_id, x.correct AS tc, y.correct AS cc, coalesce(x.strict, x.correct) AS ts, coalesce(y.strict, y.correct) AS cs,
         x.answer AS ta, y.answer AS ca, x.strict AS tst, y.strict AS cst, x.error AS te, y.error AS ce
  FROM names JOIN arms x ON x.condition = names.t JOIN arms y ON y.condition = names.c AND y.item_id = x.item_id
)"""
)


def _counts(source: str, t: str, c: str) -> str:
    return f""",
counts AS (
  SELECT comparison, count(*) AS pairs, count(*) FILTER ({t} AND NOT {c}) AS treatment_only, count(*) FILTER ({c} AND NOT {t}) AS control_only,
         count(*) FILTER ({t} AND {c}) AS both_correct, count(*) FILTER (NOT {t} AND NOT {c}) AS both_wrong
  FROM {source} GROUP BY comparison
),
tested AS (
  SELECT *, (treatment_only - control_only) / CAST(pairs AS DOUBLE) AS delta, CASE WHEN treatment_only + control_only = 0 THEN 1.0 ELSE least(1.0, 2 * (
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))
    FROM (SELECT CAST(treatment_only + control_only AS DOUBLE) AS n, unnest(range(least(treatment_only, control_only) + 1)) AS i))) END AS mcnemar_p
  FROM counts
)"""


_TESTED = "\nSELECT comparison, pairs, treatment_only, control_only, both_correct, both_wrong, round(delta, 9) AS delta, round(mcnemar_p, 9) AS mcnemar_p FROM tested"

_MOVED = """,
moved AS (SELECT comparison, item_id, CASE WHEN tc AND cc THEN 3 WHEN tc THEN 2 WHEN cc THEN 1 ELSE 0 END AS transition FROM pairs)"""

_ELIGIBLE = """
WITH reasons AS (
  SELECT o_orderkey, CASE WHEN c_mktsegment IS NULL THEN 'no_customer_segment' WHEN o_orderstatus <> 'F' THEN 'not_finished'
         WHEN o_orderpriority = '5-LOW' THEN 'low_priority' WHEN o_totalprice < 50000 THEN 'too_small' END AS reason
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

_CALLS = """
WITH calls AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS wanted, -CAST(l_quantity AS BIGINT) AS given
  FROM lineitem
)"""

_CELL = "coalesce(answer, 'none') || CASE WHEN coalesce(strict, true) THEN '' ELSE ' (non-strict)' END || CASE WHEN correct THEN ' ok' ELSE ' wrong' END || CASE WHEN error IS NOT NULL THEN ' [error]' ELSE '' END || CASE WHEN hit_max_new_tokens THEN ' [cap]' ELSE '' END"

_SIGN = "(ta = '-' || ca OR ca = '-' || ta)"
_LOSSES = f""",
losses AS (
  SELECT item_id, comparison, CASE WHEN {_SIGN} THEN 'sign_inversion_at_answer_boundary' ELSE 'constrained_semantic_regression' END AS failure_class,
         CASE WHEN {_SIGN} THEN 'high' ELSE 'medium' END AS confidence
  FROM pairs WHERE cc AND NOT tc
)"""

_THREE = """,
three AS (SELECT item_id, bool_and(correct) AS every_one, bool_or(correct) AS some_one FROM arms WHERE condition IN ('purchase', 'signup', 'view') GROUP BY item_id HAVING count(*) = 3)"""

#: What the eight response shapes hold: the verdicts follow from the shape alone.
_SHAPES = (
    _RUNS
    + """,
s AS (SELECT pos, condition, k, pos % 8 AS shape, CASE WHEN pos % 3 = 0 THEN k + 1 ELSE k END AS gold FROM runs)"""
)

_Z = "1.959963984540054"


def _wilson(k: str, n: str) -> tuple[str, str]:
    p, z = f"({k} / CAST({n} AS DOUBLE))", _Z
    centre = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    radius = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"round(greatest(0.0, {centre} - {radius}), 9)", f"round(least(1.0, {centre} + {radius}), 9)"


_LINE_LOW, _LINE_HIGH = _wilson("k", "n")
_STRICT_LOW, _STRICT_HIGH = _wilson("count(*) FILTER (strict)", "count(*)")

_SCORED = (
    _RUNS
    + """,
s AS (SELECT *, pos % 8 AS shape, pos % 4 AS said, CASE WHEN pos % 3 = 0 THEN k + 1 ELSE k END AS gold, condition = 'signup' AS free,
             'm' || CAST(pos % 3 AS VARCHAR) AS model, 'run_' || CAST(pos % 5 AS VARCHAR) AS source_file FROM (SELECT * EXCLUDE (correct, strict) FROM runs)),
scored AS (
  SELECT *, k = gold AND CASE WHEN free THEN said <> 3 ELSE shape NOT IN (5, 6) END AS correct, CASE WHEN NOT free THEN shape = 3 AND k = gold END AS strict,
         CASE WHEN NOT free THEN shape = 3 END AS strict_numeric, CASE WHEN NOT free THEN shape NOT IN (1, 2, 6) END AS whole, CASE WHEN NOT free THEN shape <> 6 END AS recovered,
         CASE WHEN NOT free THEN shape = 3 END AS schema_valid, CASE WHEN NOT free THEN shape NOT IN (6, 7) END AS order_matches, CASE WHEN free THEN said = 0 END AS marker_at_end
  FROM s
)"""
)

_SCORED_ENDS = ", ".join(
    f"CASE WHEN count({flag}) > 0 THEN {bound} END AS {name}_{end}"
    for name, flag in (("accuracy", "correct"), ("strict_accuracy", "strict"))
    for end, bound in zip(("low", "high"), _wilson(f"count(*) FILTER ({flag})", f"nullif(count({flag}), 0)"), strict=True)
)
_SCORED_RATES = ", ".join(f"round(avg(CAST({f} AS INT)), 6) AS {f}" for f in ("strict_numeric", "whole", "recovered", "schema_valid", "order_matches", "marker_at_end", "hit_max_new_tokens"))

SQL = {
    "snk_01_json_lines": """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') AS line_sha256 FROM orders""",
    "fil_01_exclude": 'SELECT source, count(*) AS "all", count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS excluded FROM documents GROUP BY source',
    "fil_02_exclude_then_slice": "SELECT * FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) WHERE index >= 100 AND index < 600",
    "fil_04_cap_or_error": _RUNS + " SELECT condition AS comparison, CASE WHEN hit_max_new_tokens THEN 'token_cap_hit' ELSE 'generation_error' END AS failure_class, count(*) AS n FROM runs WHERE hit_max_new_tokens OR error IS NOT NULL GROUP BY ALL",
    "prj_03_legacy_fallback": _RUNS
    + " SELECT condition, round(avg(CAST(coalesce(CASE WHEN condition IN ('click', 'view', 'error') THEN correct ELSE strict END, false) AS INT)), 6) AS missing_only, round(avg(CAST(coalesce(strict, correct) AS INT)), 6) AS null_too FROM runs GROUP BY condition",
    "prj_05_prediction_cells": _RUNS + f" SELECT pos, {_CELL} AS cell FROM runs",
    "prj_07_eligibility": _ELIGIBLE + " SELECT * FROM reasons",
    "agg_18_reason_counts": _ELIGIBLE + " SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM reasons GROUP BY 1",
    "prj_09_explode_references": _CALLS + " SELECT l_orderkey, l_linenumber, wanted AS value FROM calls WHERE wanted < 0",
    "prj_10_budget": 'SELECT c_mktsegment, CAST(greatest(0, 5000000 - sum(CAST(c_acctbal AS DECIMAL(18, 2)))) AS DOUBLE) AS "left", sum(CAST(c_acctbal AS DECIMAL(18, 2))) <= 5000000 AS within FROM customer GROUP BY c_mktsegment',
    "agg_11_paired_contingency": _ARMS + _counts("pairs", "tc", "cc") + _TESTED,
    "agg_11_strict_contingency": _ARMS + _counts("pairs", "ts", "cs") + _TESTED,
    "jon_01_part_pairs": """
WITH l AS (SELECT l_partkey AS item_id, l_returnflag AS condition, l_orderkey * 8 + l_linenumber AS pos, l_quantity > 25 AS correct FROM lineitem),
arms AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY item_id, condition ORDER BY pos DESC, correct DESC) = 1),
names(comparison, t, c) AS (VALUES ('A_vs_N', 'A', 'N'), ('R_vs_N', 'R', 'N'), ('A_vs_R', 'A', 'R')),
pairs AS (SELECT comparison, x.correct AS tc, y.correct AS cc FROM names JOIN arms x ON x.condition = names.t JOIN arms y ON y.condition = names.c AND y.item_id = x.item_id)"""
    + _counts("pairs", "tc", "cc")
    + _TESTED,
    "agg_14_exact_bootstrap": _ARMS
    + _counts("pairs", "tc", "cc")
    + """,
p AS (SELECT comparison, pairs AS n, CAST(treatment_only AS DOUBLE) / pairs AS u, CAST(control_only AS DOUBLE) / pairs AS d, CAST(pairs - treatment_only - control_only AS DOUBLE) / pairs AS z FROM counts),
ups AS (SELECT *, unnest(range(n + 1)) AS a FROM p),
draws AS (SELECT *, unnest(range(n - a + 1)) AS b FROM ups),
mass AS (
  SELECT comparison, n, a - b AS s, sum(exp(lgamma(n + 1) - lgamma(a + 1) - lgamma(b + 1) - lgamma(n - a - b + 1)
         + CASE WHEN a = 0 THEN 0 ELSE a * ln(u) END + CASE WHEN b = 0 THEN 0 ELSE b * ln(d) END + CASE WHEN n - a - b = 0 THEN 0 ELSE (n - a - b) * ln(z) END)) AS m
  FROM draws WHERE (u > 0 OR a = 0) AND (d > 0 OR b = 0) AND (z > 0 OR n - a - b = 0) GROUP BY comparison, n, a - b
), c AS (SELECT *, sum(m) OVER (PARTITION BY comparison ORDER BY s) AS below FROM mass)
SELECT comparison, n AS pairs, round(min(s) FILTER (below >= 0.025 - 1e-9) / CAST(n AS DOUBLE), 9) AS low, round(min(s) FILTER (below >= 0.975 - 1e-9) / CAST(n AS DOUBLE), 9) AS high FROM c GROUP BY comparison, n""",
    "agg_22_repairs_and_regressions": _ARMS + _MOVED + " SELECT comparison, item_id, CASE WHEN transition = 2 THEN 'repair' ELSE 'regression' END AS kind FROM moved WHERE transition IN (1, 2)",
    "agg_25_decision": _ARMS + _counts("pairs", "tc", "cc") + " SELECT comparison, CASE WHEN treatment_only >= 5 AND delta > 0 AND mcnemar_p < 0.05 THEN 'adopt' WHEN treatment_only >= 5 THEN 'keep_testing' ELSE 'stop' END AS decision FROM tested",
    "agg_26_transition_grid": _ARMS + _MOVED + " SELECT * FROM moved",
    "jon_02_repeated_items": _RUNS + " SELECT item_id, condition, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) > 1",
    "jon_03_ordered_mismatches": _RUNS
    + """,
n AS (SELECT condition, item_id, row_number() OVER (PARTITION BY condition ORDER BY pos) - 1 AS index FROM runs WHERE condition IN ('click', 'view'))
SELECT coalesce(c.index, t.index) AS index, c.item_id AS control_item, t.item_id AS treatment_item
FROM (SELECT * FROM n WHERE condition = 'click') c FULL JOIN (SELECT * FROM n WHERE condition = 'view') t ON c.index = t.index WHERE c.item_id IS DISTINCT FROM t.item_id""",
    "jon_05_pending": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "jon_06_unseen": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "jon_07_semi_ordered": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "jon_08_three_way": _ARMS + _THREE + " SELECT item_id, CASE WHEN every_one THEN 'all_correct' ELSE 'none_correct' END AS kind FROM three WHERE every_one OR NOT some_one",
    "jon_08c_order_discordance": _ARMS + " SELECT item_id, comparison, CASE WHEN cc THEN 'premature_answer_commitment' ELSE 'answer_first_specific_recovery' END AS failure_class FROM pairs WHERE tc <> cc",
    "jon_09_restore_labels": "SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "jon_10_ground_truth": "SELECT p_partkey, sold, CASE WHEN sold IS NULL THEN 'missing_ground_truth' END AS reason FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS sold FROM lineitem GROUP BY 1) ON l_partkey = p_partkey",
    "jon_12_field_differences": _ARMS
    + """,
p AS (SELECT * FROM pairs WHERE comparison = 'purchase_vs_signup'),
f AS (
  SELECT item_id, 'answer' AS field, ca AS stored, ta AS replayed FROM p
  UNION ALL SELECT item_id, 'correct', CAST(cc AS VARCHAR), CAST(tc AS VARCHAR) FROM p
  UNION ALL SELECT item_id, 'strict', CAST(cst AS VARCHAR), CAST(tst AS VARCHAR) FROM p
  UNION ALL SELECT item_id, 'error', ce, te FROM p
)
SELECT * FROM f WHERE stored IS DISTINCT FROM replayed""",
    "agg_16_field_agreement": _ARMS
    + """,
p AS (SELECT * FROM pairs WHERE comparison = 'purchase_vs_signup'),
f AS (
  SELECT item_id, 'answer' AS field, ca IS NOT DISTINCT FROM ta AS same FROM p
  UNION ALL SELECT item_id, 'correct', cc = tc FROM p UNION ALL SELECT item_id, 'strict', cst IS NOT DISTINCT FROM tst FROM p UNION ALL SELECT item_id, 'error', ce IS NOT DISTINCT FROM te FROM p
)
SELECT field, count(*) FILTER (same) AS agreeing, count(*) FILTER (NOT same) AS differing, min(item_id) FILTER (NOT same) AS first_item FROM f GROUP BY field""",
    "agg_17_all_fields_equal": _ARMS + " SELECT comparison, count(*) AS pairs, count(*) FILTER (ta = ca AND tc = cc AND tst IS NOT DISTINCT FROM cst AND te IS NOT DISTINCT FROM ce) AS equal FROM pairs GROUP BY comparison",
    "agg_01_condition_profile": _RUNS
    + """
SELECT condition, count(*) AS examples, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(CAST(strict AS INT)), 6) AS strict_accuracy,
       round(avg(latency_ms), 6) AS avg_latency_ms, round(median(latency_ms), 6) AS median_latency_ms, round(avg(generated_tokens), 6) AS avg_generated_tokens,
       round(median(CAST(generated_tokens AS DOUBLE)), 6) AS median_generated_tokens,
       round(avg(CASE WHEN generated_tokens > 0 THEN latency_ms / generated_tokens END), 6) AS avg_latency_per_token_ms,
       count(error) AS errors, count(*) FILTER (hit_max_new_tokens) AS cap_hits
FROM runs GROUP BY condition""",
    "agg_02_profile_null_false": _RUNS
    + f"""
SELECT condition, count(*) AS examples, count(*) FILTER (strict) AS strict, round(count(*) FILTER (strict) / CAST(count(*) AS DOUBLE), 9) AS rate,
       {_STRICT_LOW} AS low, {_STRICT_HIGH} AS high, count(*) FILTER (answer LIKE '-%') AS negative_answers
FROM runs GROUP BY condition""",
    "agg_05_null_policies": "SELECT lang, count(*) AS n, round(avg(CAST(quality = 1 AS INT)), 9) AS known, round(avg(CAST(coalesce(quality = 1, false) AS INT)), 9) AS of_all FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "agg_06_wilson": f"WITH s AS (SELECT l_suppkey, count(*) FILTER (l_discount > 0.05) AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, k, n, {_LINE_LOW} AS low, {_LINE_HIGH} AS high FROM s",
    "agg_15_assessed_ratio": _SHAPES
    + """, v AS (
  SELECT condition, CASE WHEN shape IN (5, 6) THEN 'not_assessable' WHEN shape = 4 THEN 'not_assessable' WHEN shape = 7 THEN CASE WHEN k = 7 THEN 'consistent' ELSE 'inconsistent' END ELSE 'consistent' END AS v FROM s
)
SELECT condition, count(*) FILTER (v <> 'not_assessable') AS assessed, count(*) FILTER (v = 'consistent') AS consistent,
       round(count(*) FILTER (v = 'consistent') / CAST(count(*) FILTER (v <> 'not_assessable') AS DOUBLE), 9) AS ratio
FROM v GROUP BY condition""",
    "agg_19_invariants": _RUNS
    + """,
l AS (
  SELECT DISTINCT condition, 'error' AS "column", coalesce(error, '<null>') AS v FROM runs
  UNION SELECT DISTINCT condition, 'strict', coalesce(CAST(strict AS VARCHAR), '<null>') FROM runs
  UNION SELECT DISTINCT condition, 'correct', coalesce(CAST(correct AS VARCHAR), '<null>') FROM runs
)
SELECT condition, "column", string_agg(v, ',' ORDER BY v) AS "values", count(*) AS n_values FROM l GROUP BY ALL""",
    "agg_20_uniqueness": _RUNS + ' SELECT condition, count(*) AS "rows", count(DISTINCT item_id) AS items, count(DISTINCT answer) AS answers FROM runs GROUP BY condition',
    "win_01_source_index": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS source_index FROM orders",
    "win_02_first_appearance": _RUNS + " SELECT item_id, min(pos) AS first_pos FROM runs GROUP BY item_id",
    "win_03_first_per_reason": _ELIGIBLE + " SELECT coalesce(reason, 'eligible') AS reason, o_orderkey FROM reasons QUALIFY row_number() OVER (PARTITION BY coalesce(reason, 'eligible') ORDER BY o_orderkey) <= 5",
    "srt_02_catalogue_order": _ARMS + _LOSSES + " SELECT item_id, comparison, failure_class, confidence, CASE WHEN CAST(item_id AS BIGINT) = 0 THEN -1 ELSE CAST(item_id AS BIGINT) END AS sort_key FROM losses",
    "srt_05_top_scores": _RUNS + " SELECT condition, pos, latency_ms FROM runs QUALIFY row_number() OVER (PARTITION BY condition ORDER BY latency_ms DESC, pos) <= 8",
    "smp_04_stress_set": _CALLS + " SELECT l_orderkey, l_linenumber FROM calls WHERE wanted < 0 AND NOT left(md5(CAST(l_orderkey AS VARCHAR)), 1) < '4'",
    "smp_05_targeted_suite": _ARMS
    + _LOSSES
    + _THREE
    + """,
m AS (
  SELECT DISTINCT item_id, 1 AS r, 'constrained_semantic_loss' AS reason FROM losses
  UNION ALL SELECT item_id, 2, 'matched_all_correct_control' FROM three WHERE every_one UNION ALL SELECT item_id, 3, 'shared_wrong_diagnostic' FROM three WHERE NOT some_one
)
SELECT item_id, string_agg(reason, ',' ORDER BY r) AS selection_reason FROM m GROUP BY item_id""",
    "set_03_loss_union": _ARMS + _LOSSES + " SELECT item_id, count(DISTINCT comparison) = 2 AS shared FROM losses WHERE comparison IN ('purchase_vs_signup', 'error_vs_signup') GROUP BY item_id",
    "set_04_missing_coverage": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem",
    "set_06_identity_union": "SELECT o_orderkey AS identity FROM orders UNION SELECT o_custkey FROM orders",
    "jon_08d_catalogue": _ARMS
    + _LOSSES
    + """
SELECT 'paired_loss' AS record_type, comparison, failure_class, confidence, count(*) AS n FROM losses GROUP BY ALL
UNION ALL SELECT 'negative_answer', condition, 'negative_answer_on_positive_gold_subset', 'high', count(*) FROM runs WHERE answer LIKE '-%' GROUP BY ALL
UNION ALL SELECT 'field_order_discordance', comparison, CASE WHEN cc THEN 'premature_answer_commitment' ELSE 'answer_first_specific_recovery' END, 'high', count(*) FROM pairs WHERE tc <> cc GROUP BY ALL
UNION ALL SELECT 'completion_diagnostic', condition, CASE WHEN hit_max_new_tokens THEN 'token_cap_hit' ELSE 'generation_error' END, 'high', count(*) FROM runs WHERE hit_max_new_tokens OR error IS NOT NULL GROUP BY ALL""",
    "scl_01_last_number": r"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '-?\$?\d[\d,]*(?:\.\d+)?(?:/\d[\d,]*)?') AS a FROM documents)
SELECT doc_id, a[-1] AS last_number, CAST(len(a) AS BIGINT) AS mentions FROM n""",
    "scl_02_canonical_number": r"SELECT o_orderkey, regexp_replace(regexp_replace(format('{:.2f}', o_totalprice), '(\.\d*?)0+$', '\1'), '\.$', '') AS price FROM orders",
    "scl_03_free_answer": _RUNS
    + """
SELECT pos, CASE WHEN pos % 6 = 3 THEN NULL ELSE CAST(k AS VARCHAR) END AS answer, CASE pos % 6 WHEN 2 THEN 'last_number_fallback' WHEN 3 THEN 'not_found' ELSE 'final_answer_marker' END AS method,
       pos % 6 <> 2 AS marker_present, pos % 6 IN (0, 5) OR pos % 6 = 4 AS marker_at_end
FROM runs""",
    "scl_07_strict_number": r"""
WITH p AS (SELECT o_orderkey, o_orderkey % 8 AS v, format('{:,.2f}', o_totalprice) AS p FROM orders),
t AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 16 = 5 THEN '1/1,000' ELSE CASE v WHEN 2 THEN '+' WHEN 3 THEN chr(9) || '-' WHEN 5 THEN '7/' WHEN 7 THEN '$' ELSE '' END || p
         || CASE v WHEN 0 THEN ' USD' WHEN 1 THEN chr(10) WHEN 3 THEN ' ' WHEN 4 THEN '/2' WHEN 6 THEN chr(8195) ELSE '' END END AS t FROM p
), b AS (SELECT o_orderkey, trim(t, ' ' || chr(9) || chr(10) || chr(8195)) AS t FROM t)
SELECT o_orderkey, CASE WHEN regexp_full_match(t, '-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?') OR regexp_full_match(t, '-?(\d+|\d{1,3}(,\d{3})+)/(\d+|\d{1,3}(,\d{3})+)') THEN t END AS strict FROM b""",
    "scl_12_gold_answer": _RUNS + " SELECT pos, CASE WHEN pos % 5 <> 0 THEN CAST(k AS VARCHAR) END AS gold FROM runs",
    "scl_13_id_index": 'SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS "index" FROM customer',
    "scl_11_tail_and_cell": "SELECT doc_id, sha256(replace(replace(right(text, 240), '|', '\\|'), chr(10), ' ')) AS cell_sha256 FROM documents",
    "scl_16_prompts": """
WITH p AS (SELECT conv_id, turn, 'Solve the problem. Return only one JSON object with the keys "reasoning" and "answer".' || chr(10) || chr(10) || 'Problem:' || chr(10) || coalesce(text, '') AS p FROM conversations)
SELECT conv_id, turn, length(p) AS chars, sha256(p) AS prompt_sha256 FROM p""",
    "sco_01_baseline_score": _SHAPES
    + """
SELECT pos, shape NOT IN (1, 2, 6) AS whole, shape <> 6 AS recovered, shape = 3 AND (pos // 8) % 4 < 2 AS schema_valid, shape NOT IN (6, 7) AS order_matches,
       CASE WHEN shape IN (5, 6) THEN NULL WHEN shape = 4 THEN CAST(k AS VARCHAR) || '.0' ELSE CAST(k AS VARCHAR) END AS predicted, shape = 3 AND (pos // 8) % 4 < 2 AS strict_numeric
FROM s""",
    "sco_02_layered_score": _SHAPES
    + """
SELECT pos, shape NOT IN (1, 2, 6) AS whole, shape <> 6 AS recovered, shape IN (0, 4, 7) AS internal_valid, shape IN (0, 3, 4, 5) AS order_matches,
       CASE WHEN shape NOT IN (4, 5, 6) THEN CAST(k AS VARCHAR) END AS predicted, shape NOT IN (4, 5, 6) AND k = gold AS semantic_correct,
       shape IN (0, 7) AS external_valid, shape IN (0, 7) AND k = gold AS contract_valid_correct
FROM s""",
    "sco_06_rescore_difference": _SHAPES
    + """,
f AS (
  SELECT pos, 'internal_valid' AS field, shape IN (0, 4, 7) AS before, shape = 3 AS after FROM s
  UNION ALL SELECT pos, 'external_valid', shape IN (0, 7), shape = 3 FROM s
  UNION ALL SELECT pos, 'contract_valid_correct', shape IN (0, 7) AND k = gold, shape = 3 AND k = gold FROM s
)
SELECT * FROM f WHERE before <> after""",
    "sco_03_tool_score": _CALLS
    + """
SELECT l_orderkey, l_linenumber, l_linenumber < 7 AS whole, l_linenumber IN (1, 3, 4, 5, 6) AS selected, l_linenumber IN (1, 5) AS internal_valid,
       l_linenumber = 1 AS external_valid, l_linenumber = 1 AND wanted = given AS arguments_correct, l_linenumber = 1 AND wanted = given AS success, l_linenumber = 1 AS executed,
       l_linenumber = 1 AND wanted = given AS post_state_correct, CASE l_linenumber WHEN 1 THEN CASE WHEN wanted <> given THEN 'wrong_arguments' END WHEN 2 THEN 'other_tool' WHEN 5 THEN 'not_reversible' WHEN 7 THEN 'invalid_json' ELSE 'internal_invalid' END AS error
FROM calls""",
    "trf_07_transduce": _RUNS
    + """
SELECT pos, CASE WHEN pos % 6 = 0 THEN 'internal_invalid' WHEN pos % 7 = 0 THEN 'not_reversible' END AS code,
       CASE WHEN pos % 6 <> 0 AND pos % 7 <> 0 THEN '{"answer":"' || k || '","reasoning":"it is ' || k || '"}' END AS external
FROM runs""",
    "val_01_violations": _RUNS
    + """
SELECT condition AS scope, 'no_error' AS "check", count(error) AS n FROM runs GROUP BY 1 HAVING count(error) > 0
UNION ALL SELECT condition, 'below_cap', count(*) FROM runs WHERE hit_max_new_tokens GROUP BY 1
UNION ALL SELECT condition, 'positive_latency', count(*) FROM runs WHERE NOT coalesce(latency_ms > 0, false) GROUP BY 1
UNION ALL SELECT condition, 'strict_known', count(*) FROM runs WHERE strict IS NULL GROUP BY 1
UNION ALL SELECT condition, 'unique_items', 1 FROM runs GROUP BY 1 HAVING count(*) <> count(DISTINCT item_id)""",
    "hsh_05_one_environment": 'SELECT l_returnflag, l_suppkey, count(DISTINCT (l_linestatus, year(l_shipdate))) AS environments, count(*) AS "rows", count(DISTINCT (l_linestatus, year(l_shipdate))) = 1 AS holds FROM lineitem GROUP BY ALL',
    "snk_05_item_matrix": _ARMS
    + f""",
c AS (SELECT item_id, condition, {_CELL} AS cell FROM arms)
SELECT item_id, """
    + ", ".join(f"coalesce(max(cell) FILTER (condition = '{x}'), 'missing row') AS \"{x}\"" for x in ("click", "error", "purchase", "signup", "view"))
    + " FROM c GROUP BY item_id",
    "agg_27_canonical_delta": _SHAPES + " SELECT condition, count(*) FILTER (shape = 3) AS broad, count(*) FILTER (shape = 3) AS canonical, CAST(0 AS BIGINT) AS not_canonical FROM s GROUP BY condition",
}
_GATE = SQL["val_01_violations"].replace("\nSELECT condition AS scope", ",\nv AS (SELECT condition AS scope", 1)
SQL["val_07_gate"] = _GATE + ") SELECT c.scope, coalesce(string_agg(\"check\", ',' ORDER BY \"check\"), '') AS failed, count(\"check\") = 0 AS passes FROM (SELECT DISTINCT condition AS scope FROM runs) c LEFT JOIN v USING (scope) GROUP BY c.scope"

SQL |= {
    "fil_03_single_condition": _RUNS + ' SELECT item_id, answer, count(DISTINCT condition) AS conditions, count(*) AS "rows", min(condition) = max(condition) AS holds FROM runs GROUP BY item_id, answer',
    "fil_05_losses": _ARMS + " SELECT item_id, comparison FROM pairs WHERE cc AND NOT tc",
    "fil_06_negative_answers": _RUNS + " SELECT condition AS comparison, count(*) AS n FROM runs WHERE answer LIKE '-%' GROUP BY 1",
    "fil_07_no_negative_gold": _RUNS + " SELECT item_id, condition, count(*) FILTER (pos % 4 = 0) = 0 AS holds FROM runs GROUP BY item_id, condition",
    "prj_02_rest_of_config": _ARMS.replace("x.error AS te", "x.hit_max_new_tokens AS th, y.hit_max_new_tokens AS ch, x.error AS te")
    + " SELECT comparison, count(*) FILTER (th = ch AND te IS NOT DISTINCT FROM ce) AS same, count(*) FILTER (NOT (th = ch AND te IS NOT DISTINCT FROM ce)) AS other FROM pairs GROUP BY comparison",
    "prj_06_aliases": _RUNS + " SELECT pos, correct AS correct_exact, coalesce(strict, correct) AS correct_exact_strict FROM runs",
    "prj_08_typed_options": "SELECT o_orderkey, CAST(2 AS BIGINT) AS integers FROM orders",
    "jon_04_zip": _RUNS
    + """,
n AS (SELECT condition, correct, row_number() OVER (PARTITION BY condition ORDER BY pos) AS i FROM runs WHERE condition IN ('click', 'view'))
SELECT count(*) AS pairs, count(*) FILTER (c.correct AND v.correct) AS both_correct FROM n c JOIN n v ON c.i = v.i AND c.condition = 'click' AND v.condition = 'view'""",
    "jon_11_lookup": "SELECT source, count(*) AS looked_up, count(*) FILTER (l.doc_id IS NULL) AS missing, CAST(sum(quality) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source",
    "agg_01_model_profile": _SCORED
    + f"""
SELECT model, condition, count(*) AS examples, count(*) FILTER (correct) AS correct_exact, round(avg(CAST(correct AS INT)), 6) AS accuracy, round(avg(CAST(strict AS INT)), 6) AS strict_accuracy,
       {_SCORED_ENDS}, {_SCORED_RATES}, round(avg(latency_ms), 6) AS avg_latency_ms, round(median(latency_ms), 6) AS median_latency_ms,
       round(avg(generated_tokens), 6) AS avg_generated_tokens, round(avg(CASE WHEN generated_tokens > 0 THEN latency_ms / generated_tokens END), 6) AS avg_latency_per_token_ms,
       count(error) AS errors, string_agg(DISTINCT source_file, ',' ORDER BY source_file) AS source_files
FROM scored GROUP BY model, condition""",
    "agg_11_model_contingency": _SCORED
    + """,
arms AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model, item_id, condition ORDER BY pos DESC) = 1),
names(name, t, c) AS (VALUES ('purchase_vs_signup', 'purchase', 'signup'), ('view_vs_click', 'view', 'click'), ('error_vs_signup', 'error', 'signup')),
pairs AS (
  SELECT x.model || '/' || name AS comparison, coalesce(x.strict, x.correct) AS ts, coalesce(y.strict, y.correct) AS cs
  FROM names JOIN arms x ON x.condition = names.t JOIN arms y ON y.condition = names.c AND y.item_id = x.item_id AND y.model = x.model
)"""
    + _counts("pairs", "ts", "cs")
    + """
SELECT split_part(comparison, '/', 1) AS model, split_part(comparison, '/', 2) AS comparison, pairs, treatment_only, control_only, both_correct, both_wrong,
       round(delta, 9) AS delta, round(mcnemar_p, 9) AS mcnemar_p
FROM tested""",
    "agg_03_consistency_profile": _SHAPES
    + f""",
v AS (
  SELECT condition, shape NOT IN (4, 5, 6) AND k = gold AS semantic, shape IN (0, 7) AND k = gold AS valid,
         shape = 7 AND k <> 7 AS inconsistent, shape IN (4, 5, 6) AS not_assessable FROM s
)
SELECT condition, count(*) AS examples, count(*) FILTER (semantic) AS semantic, count(*) FILTER (valid) AS contract_valid,
       {_wilson("count(*) FILTER (valid)", "count(*)")[0]} AS low, {_wilson("count(*) FILTER (valid)", "count(*)")[1]} AS high,
       count(*) FILTER (inconsistent) AS inconsistent, count(*) FILTER (not_assessable) AS not_assessable
FROM v GROUP BY condition""",
    "agg_04_tool_profile": _CALLS
    + """,
f AS (SELECT l_linenumber, l_linenumber < 7 AS w, l_linenumber IN (1, 3, 4, 5, 6) AS s, l_linenumber IN (1, 5) AS i, l_linenumber = 1 AS e, l_linenumber = 1 AND wanted = given AS a FROM calls)
SELECT l_linenumber, count(*) AS calls, round(avg(CAST(w AS INT)), 9) AS whole, round(avg(CAST(s AS INT)), 9) AS selected, round(avg(CAST(i AS INT)), 9) AS internal_valid,
       round(avg(CAST(e AS INT)), 9) AS external_valid, round(avg(CAST(a AS INT)), 9) AS arguments_correct, round(avg(CAST(a AS INT)), 9) AS success, count(*) FILTER (i AND NOT e) AS transduction_failures
FROM f GROUP BY l_linenumber""",
    "sco_05_receipts": _CALLS
    + """
SELECT l_orderkey, l_linenumber, sha256('{"call_count":1,"last_call":{"arguments":{"bins":[1,2],"quantity_delta":' || given || ',"sku":"P' || l_partkey || '"},"name":"adjust_stock"}}') AS receipt
FROM calls WHERE l_linenumber = 1""",
    "agg_08_latency_per_token": _RUNS + " SELECT item_id, round(avg(CASE WHEN generated_tokens > 0 THEN latency_ms / generated_tokens END), 6) AS latency_per_token FROM runs GROUP BY item_id",
    "agg_10_conditional_counts": _RUNS + " SELECT condition, count(error) AS errors, count(*) FILTER (hit_max_new_tokens) AS cap_hits, count(*) FILTER (strict IS NULL) AS blank, count(*) FILTER (correct AND error IS NULL) AS clean FROM runs GROUP BY condition",
    "agg_12_mcnemar_by_brand": """
WITH l AS (SELECT l_partkey AS item_id, l_returnflag AS condition, l_orderkey * 8 + l_linenumber AS pos, l_quantity > 25 AS correct FROM lineitem),
arms AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY item_id, condition ORDER BY pos DESC, correct DESC) = 1),
pairs AS (SELECT p_brand AS comparison, x.correct AS tc, y.correct AS cc FROM arms x JOIN arms y ON x.item_id = y.item_id AND x.condition = 'A' AND y.condition = 'N' JOIN part ON p_partkey = x.item_id)"""
    + _counts("pairs", "tc", "cc")
    + " SELECT comparison AS p_brand, pairs, treatment_only, control_only, round(mcnemar_p, 9) AS p FROM tested",
    "agg_21_conjunction": _RUNS + " SELECT condition, bool_and(latency_ms > 0 AND generated_tokens <= 99) AS holds FROM runs GROUP BY condition",
    "agg_23_repair_summary": _ARMS + " SELECT comparison, count(*) AS available, count(*) FILTER (tc) AS repaired, min(item_id) FILTER (tc) AS first_repaired FROM pairs WHERE NOT cc GROUP BY comparison",
    "agg_24_totals": " UNION ALL ".join(f"SELECT '{t}' AS scope, count(*) AS \"rows\" FROM {t}" for t in ("events", "documents", "conversations", "labels", "benchmark")),
    "win_04_last_rows": _ARMS + " SELECT item_id, condition, pos, answer FROM arms",
    "win_05_canary_rows": _RUNS + " SELECT condition, pos, item_id FROM runs QUALIFY row_number() OVER (PARTITION BY condition ORDER BY pos) <= 3",
    "srt_01_sorted_groups": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL",
    "smp_03_parity_selection": _ARMS + " SELECT comparison, item_id, tc <> cc AS discordant FROM pairs WHERE tc <> cc OR left(md5(item_id), 1) < '4'",
    "set_01_union_all": "SELECT c_custkey AS key, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier",
    "set_02_intersection": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_05_overlap": 'SELECT source, count(*) AS overlap, min(doc_id) AS "first" FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source',
    "scl_04_whole_object": _SHAPES + " SELECT pos, shape NOT IN (1, 2, 6) AS whole, CASE WHEN shape IN (1, 2, 6) THEN 'invalid_json' END AS error FROM s",
    "scl_05_recovered": _SHAPES + " SELECT pos, 'integer' AS kind, CAST(k AS VARCHAR) AS text FROM s WHERE shape IN (1, 2)",
    "scl_05b_sliced": _SHAPES + " SELECT pos, shape <> 6 AS whole FROM s",
    "scl_06_answers": _SHAPES + " SELECT pos, CASE WHEN shape NOT IN (4, 5, 6) THEN CAST(k AS VARCHAR) END AS strict, CASE WHEN shape = 4 THEN k || '.0' WHEN shape NOT IN (5, 6) THEN CAST(k AS VARCHAR) END AS lax FROM s",
    "scl_08_key_order": _SHAPES + " SELECT pos, CASE shape WHEN 6 THEN NULL WHEN 7 THEN 'answer,reasoning' ELSE 'reasoning,answer' END AS keys FROM s",
    "scl_09_consistency": _SHAPES + " SELECT pos, CASE WHEN shape IN (4, 5, 6) THEN 'not_assessable' WHEN shape = 7 AND k <> 7 THEN 'inconsistent' ELSE 'consistent' END AS verdict FROM s",
    "scl_10_sign_inverse": _ARMS + f" SELECT comparison, item_id, {_SIGN} AS flipped FROM pairs",
    "scl_15_percent": _RUNS + " SELECT item_id, printf('%.1f%%', 100 * (count(*) FILTER (correct) / 8.0)) AS shown FROM runs GROUP BY item_id",
    "scl_18_accepted_options": "SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'O' AND o_orderpriority = '5-LOW' AS accepted FROM orders",
    "scl_19_cap_hits": _RUNS + " SELECT pos, k >= 90 AS cap FROM runs",
    "scl_20_prompt_parity": "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS conversations FROM conversations WHERE turn = 0 GROUP BY 1 HAVING count(*) > 1",
    "sch_01_contracts": _SHAPES + ' SELECT pos, shape IN (0, 4, 7) AS "integer", shape = 3 AS signed_string, shape = 3 AS "string" FROM s',
    "trf_01_integer_string": _RUNS
    + """,
a AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN '-0' ELSE answer END AS a FROM runs)
SELECT pos, NULL AS code, '{"reasoning":"r","answer":"' || CASE WHEN a = '-0' THEN '0' ELSE a END || '"}' AS external FROM a""",
    "trf_02_key_alias": _RUNS + """ SELECT pos, CASE WHEN pos % 3 = 0 THEN 'internal_invalid' END AS code, CASE WHEN pos % 3 <> 0 THEN '{"reasoning":"r","answer":"' || k || '"}' END AS external FROM runs""",
    "trf_03_field_order": _RUNS + """ SELECT pos, NULL AS code, '{"answer":"' || k || '","reasoning":"r"}' AS external FROM runs""",
    "trf_04_scratch_field": _RUNS + """ SELECT pos, CASE WHEN pos % 4 = 0 THEN 'internal_invalid' END AS code, CASE WHEN pos % 4 <> 0 THEN '{"reasoning":"r","answer":"' || k || '"}' END AS external FROM runs""",
    "trd_02_tool_arguments": _CALLS
    + """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 5 THEN 'not_reversible' WHEN l_linenumber = 7 THEN 'no_object' ELSE 'internal_invalid' END AS code,
       CASE WHEN l_linenumber = 1 THEN 'string' END AS kind, CASE WHEN l_linenumber = 1 THEN CAST(given AS VARCHAR) END AS quantity
FROM calls""",
    "sco_04_smoke_score": _SHAPES
    + """,
n AS (SELECT *, CASE WHEN shape = 4 THEN k || '.0' WHEN shape = 7 THEN '7' ELSE CAST(k AS VARCHAR) END AS last FROM s)
SELECT pos, shape <> 6 AS object, last AS last_number, last = CAST(gold AS VARCHAR) AS correct FROM n""",
    "hsh_01_text_digests": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "val_02_coverage": _RUNS
    + """
SELECT c.condition, count(h.item_id) AS covered, count(*) - count(h.item_id) AS missing
FROM (SELECT DISTINCT condition FROM runs) c CROSS JOIN (SELECT DISTINCT item_id FROM runs) i LEFT JOIN (SELECT DISTINCT item_id, condition FROM runs) h ON h.item_id = i.item_id AND h.condition = c.condition
GROUP BY c.condition""",
    "val_05_rescore": _SHAPES + " SELECT condition, count(*) FILTER ((shape NOT IN (4, 5, 6) AND k = gold) <> (k = gold)) AS changed, count(*) AS \"rows\" FROM s GROUP BY condition",
    "val_08_stage_gate": "SELECT o_orderstatus AS scope, CASE WHEN count(*) FILTER (o_orderpriority = '5-LOW') > 0 THEN 'known_priority' ELSE '' END AS failed, count(*) FILTER (o_orderpriority = '5-LOW') = 0 AS passes FROM orders GROUP BY 1",
    "val_09_unlabelled": 'SELECT source, count(*) FILTER (quality IS NULL) AS open, count(*) AS "all" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source',
    "val_10_contains_facts": "SELECT lang, count(*) FILTER (contains(coalesce(text, ''), 'the')) AS required, count(*) FILTER (contains(coalesce(text, ''), 'password')) AS forbidden FROM documents GROUP BY lang",
    "val_11_cross_check": _ARMS + _counts("pairs", "tc", "cc") + " SELECT comparison, treatment_only, control_only, true AS agrees FROM tested",
    "agg_09_exact_total": _RUNS + " SELECT condition, round(CAST(sum(CAST(latency_ms / 3 AS DECIMAL(38, 18))) AS DOUBLE), 8) AS third_total, median(latency_ms) AS latency_median FROM runs GROUP BY condition",
    "scl_17_equal_values": "SELECT l_orderkey, l_linenumber, l_linenumber IN (2, 4, 5, 6) AS as_number, false AS as_text FROM lineitem",
}


def _layers(flags: dict[str, str]) -> str:
    """Count, rate and interval of each flag."""
    out = []
    for name, flag in flags.items():
        k = f"count(*) FILTER ({flag})"
        low, high = (x.removesuffix(", 9)") + ", 6)" for x in _wilson(k, "count(*)"))
        out.append(f"{k} AS {name}_count, round({k} / CAST(count(*) AS DOUBLE), 6) AS {name}_rate, {low} AS {name}_low, {high} AS {name}_high")
    return ", ".join(out)


_TELEMETRY = """count(error) AS errors, count(*) FILTER (cap) AS cap_hits, CAST(sum(tokens) AS BIGINT) AS tokens_total, round(avg(tokens), 6) AS tokens_mean, round(median(tokens), 6) AS tokens_median,
       round(avg(latency), 6) AS latency_mean, round(median(latency), 6) AS latency_median, round(sum(CAST(latency AS DECIMAL(38, 15))), 6)::DOUBLE AS latency_total"""

_PARTS = """
WITH parts AS (SELECT p_partkey AS pos, 'part_' || p_partkey AS item, sha256(p_name) AS prompt, sha256(sha256(p_name) || 'x') AS other FROM part),
held AS (
  SELECT condition, pos, CASE WHEN condition = 'swapped' AND pos % 97 = 3 THEN 'part_' || (pos + 1) WHEN condition = 'swapped' AND pos % 97 = 4 THEN 'part_' || (pos - 1) ELSE item END AS held_item,
         CASE WHEN condition = 'prompts' AND pos % 89 = 5 THEN other ELSE prompt END AS held_prompt, condition = 'prompts' AND pos % 50 = 1 AS rerun, condition = 'as_planned' AND pos % 60 = 2 AS failed
  FROM parts, (SELECT unnest(['as_planned', 'missing', 'swapped', 'prompts']) AS condition) WHERE condition <> 'missing' OR pos % 101 <> 7
),
planned AS (SELECT condition, pos, item, prompt FROM parts, (SELECT unnest(['as_planned', 'missing', 'swapped', 'prompts']) AS condition)),
off AS (
  SELECT condition AS scope, 'item' AS "check", pos, item AS expected, held_item AS found FROM planned LEFT JOIN held USING (condition, pos) WHERE held_item IS DISTINCT FROM item
  UNION ALL SELECT condition, 'prompt', pos, prompt, held_prompt FROM planned LEFT JOIN held USING (condition, pos) WHERE held_prompt IS DISTINCT FROM prompt
)"""

SQL |= {
    "agg_03_full_profile": _SHAPES
    + f""",
v AS (
  SELECT s.condition, s.k AS tokens, r.latency_ms AS latency, r.error, r.hit_max_new_tokens AS cap, s.shape IN (0, 7) AND s.k = gold AS valid, shape NOT IN (4, 5, 6) AND s.k = gold AS semantic,
         shape IN (0, 7) AS ext, shape IN (0, 4, 7) AS int, CASE WHEN shape IN (4, 5, 6) THEN 'not_assessable' WHEN shape = 7 AND s.k <> 7 THEN 'inconsistent' ELSE 'consistent' END AS v
  FROM s JOIN runs r USING (pos)
)
SELECT condition, count(*) AS examples, {_layers({"contract_valid_correct": "valid", "semantic_correct": "semantic", "external_valid": "ext", "internal_valid": "int"})}, {_TELEMETRY},
       0 AS gold_negative, 0 AS predicted_negative, count(*) FILTER (v <> 'not_assessable') AS assessed, count(*) FILTER (v = 'consistent') AS consistent, count(*) FILTER (v = 'inconsistent') AS inconsistent,
       count(*) FILTER (v = 'not_assessable') AS not_assessable, round(count(*) FILTER (v = 'consistent') / CAST(count(*) FILTER (v <> 'not_assessable') AS DOUBLE), 6) AS consistent_share
FROM v GROUP BY condition""",
    "agg_04_full_profile": _CALLS
    + f""",
f AS (SELECT l_linenumber AS n, abs(wanted) AS tokens, abs(wanted) / 7 AS latency, CASE WHEN l_orderkey % 11 = 0 THEN 'timeout' END AS error, abs(wanted) >= 48 AS cap, wanted = given AS same FROM calls)
SELECT n AS l_linenumber, count(*) AS examples, {_layers({"success": "n = 1 AND same", "selected": "n IN (1, 3, 4, 5, 6)", "whole": "n < 7", "internal_valid": "n IN (1, 5)", "external_valid": "n = 1", "arguments_correct": "n = 1 AND same", "executed": "n = 1", "post_state_correct": "n = 1 AND same"})}, {_TELEMETRY},
       count(*) FILTER (n = 5) AS transduction_failures, 0 AS repairs
FROM f GROUP BY n""",
    "sco_03_first_failures": _CALLS
    + """
SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN CASE WHEN wanted = given THEN 'none' ELSE 'wrong_arguments' END WHEN 2 THEN 'other_tool' WHEN 5 THEN 'not_reversible' WHEN 7 THEN 'invalid_json' ELSE 'internal_invalid' END AS error, count(*) AS calls
FROM calls GROUP BY ALL""",
    "jon_02_strict_pairs": _ARMS + " SELECT x.item_id, x.pos AS treatment_pos, y.pos AS control_pos, x.correct AND y.correct AS both FROM arms x JOIN arms y USING (item_id) WHERE x.condition = 'view' AND y.condition = 'click'",
    "jon_10_strict_answers": "SELECT doc_id, quality, CASE WHEN l.doc_id IS NULL THEN 'missing_ground_truth' END AS reason FROM documents LEFT JOIN labels l USING (doc_id)",
    "jon_11_strict_lookup": "SELECT p_brand AS brand, count(*) AS lines FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand",
    "val_03_differences": _PARTS + ' SELECT scope, "check", pos, expected, found FROM off',
    "val_03_matrix": _PARTS
    + """
SELECT scope, 'same_' || "check" AS "check", count(*) AS n, min(pos) AS first FROM off GROUP BY ALL
UNION ALL SELECT 'prompts', 'one_run', 1, NULL FROM held WHERE rerun HAVING count(*) > 0
UNION ALL SELECT 'as_planned', 'no_error', count(*), min(pos) FROM held WHERE failed HAVING count(*) > 0""",
    "val_06_tool_rows": _CALLS
    + """
SELECT 'shape_' || l_linenumber AS scope, "check", n FROM (
  SELECT l_linenumber, count(*) FILTER (l_linenumber = 7) AS whole, count(*) FILTER (l_linenumber NOT IN (1, 3, 4, 5, 6)) AS selected, count(*) FILTER (l_orderkey % 11 = 0) AS no_error, count(*) FILTER (abs(wanted) >= 48) AS no_cap
  FROM calls GROUP BY l_linenumber
) UNPIVOT (n FOR "check" IN (whole, selected, no_error, no_cap)) WHERE n > 0""",
}
SQL |= STRICT | ITEMS | REPORTS
SQL["agg_16_mismatched_items"] = (
    _ARMS
    + """
SELECT comparison, item_id, unnest(list_filter([CASE WHEN ca IS DISTINCT FROM ta THEN 'answer' END, CASE WHEN cc IS DISTINCT FROM tc THEN 'correct' END,
       CASE WHEN cst IS DISTINCT FROM tst THEN 'strict' END, CASE WHEN ce IS DISTINCT FROM te THEN 'error' END], lambda x: x IS NOT NULL)) AS field
FROM pairs"""
)

SQL["snk_04_comparison_table"] = f"""
WITH t AS (SELECT * FROM ({SQL["agg_11_paired_contingency"]}) JOIN ({SQL["agg_14_exact_bootstrap"]}) USING (comparison, pairs))
SELECT 0 AS position, '| Comparison | Paired n | Delta (95% CI) | Treatment-only/control-only | Exact p |' AS line
UNION ALL SELECT 1, '|---|---:|---:|---:|---:|'
UNION ALL SELECT row_number() OVER (ORDER BY comparison) + 1, '| ' || comparison || ' | ' || pairs || ' | ' || printf('%.1f%%', delta * 100) || ' ([' || printf('%.1f%%', low * 100) || ', ' || printf('%.1f%%', high * 100) || ']) | '
  || treatment_only || '/' || control_only || ' | ' || format('{{:.6g}}', mcnemar_p) || ' |' FROM t"""

SQL["snk_06_repair_stage"] = (
    _ARMS
    + """,
o AS (SELECT item_id, bool_or(correct) FILTER (condition = 'purchase') AS p, bool_or(correct) FILTER (condition = 'signup') AS s, bool_or(correct) FILTER (condition = 'view') AS v FROM arms GROUP BY item_id),
lost AS (SELECT item_id FROM o WHERE p AND NOT s AND NOT v)
SELECT condition AS arm, count(*) FILTER (item_id IN (FROM lost)) AS available, count(*) FILTER (item_id IN (FROM lost) AND correct) AS repaired,
       count(*) FILTER (NOT (condition = 'error' OR coalesce(strict, false))) AS invalid,
       count(*) FILTER (item_id IN (FROM lost) AND correct) >= 5 AND count(*) FILTER (NOT (condition = 'error' OR coalesce(strict, false))) = 0 AS passes
FROM arms WHERE condition IN ('click', 'error', 'view') GROUP BY condition"""
)
