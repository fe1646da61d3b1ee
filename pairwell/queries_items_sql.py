"""The SQL of queries_items."""

from __future__ import annotations

from pairwell.functions import prompts

_ITEMS = """
WITH i AS (
  SELECT p_partkey, p_brand, p_size - 25 AS n, p_partkey % 16 AS shape,
         CASE p_partkey % 16
           WHEN 1 THEN 'not_single_turn_user_request' WHEN 2 THEN 'not_single_function' WHEN 3 THEN 'invalid_function_definition'
           WHEN 4 THEN 'parameters_not_object_like' WHEN 5 THEN 'invalid_parameter_schema' WHEN 6 THEN 'no_required_integer'
           WHEN 7 THEN 'unsupported_schema' WHEN 8 THEN 'bounded_integer_not_supported' WHEN 9 THEN 'ambiguous_ground_truth_call'
           WHEN 10 THEN 'ground_truth_has_unknown_argument' WHEN 11 THEN 'required_argument_has_no_typed_reference'
           WHEN 12 THEN 'ground_truth_options_not_lists' WHEN 14 THEN 'not_single_turn_user_request' WHEN 15 THEN 'ambiguous_ground_truth_call' END AS reason
  FROM part
)"""

_THREE = """
WITH arms AS (
  SELECT user_id AS pos, event_type AS condition, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS correct
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1
),
three AS (
  SELECT pos, bool_or(correct) FILTER (condition = 'purchase') AS p, bool_or(correct) FILTER (condition = 'signup') AS s,
         bool_or(correct) FILTER (condition = 'view') AS v, bool_or(correct) FILTER (condition = 'click') AS c
  FROM arms GROUP BY pos HAVING p IS NOT NULL AND s IS NOT NULL AND v IS NOT NULL
)"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _prompts() -> str:
    heads = {"free": prompts.instructions()}
    for r in prompts.ANSWERS:
        for order in (prompts.ORDER, prompts.ORDER[::-1]):
            heads[f"{r}_{order[0]}_first"] = prompts.instructions(r, order)
    parts = [f"SELECT conv_id, turn, '{k}' AS builder, {_text(v)} || chr(10) || chr(10) || 'Question:' || chr(10) || coalesce(text, '') AS prompt FROM conversations" for k, v in heads.items()]
    gap = "|| chr(10) || chr(10) ||"
    tool = (
        f"SELECT conv_id, turn, 'tool', {_text(prompts.TOOL)} {gap} 'User request:' || chr(10) || coalesce(text, '') {gap} 'Function name:' || chr(10) || 'adjust_stock' "
        f"""{gap} 'Function description:' || chr(10) || coalesce(role, '') {gap} 'Call schema:' || chr(10) || '{{"type":"object"}}' FROM conversations"""
    )
    return "WITH p AS (" + " UNION ALL ".join([*parts, tool]) + ") SELECT conv_id, turn, builder, length(prompt) AS chars, sha256(prompt) AS prompt_sha256 FROM p"


SQL: dict[str, str] = {
    "prj_07_tool_items": _ITEMS
    + """
SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN 'adjust ' || p_brand END AS user_request, CASE WHEN reason IS NULL THEN 'count' END AS required_integers,
       CASE WHEN reason IS NULL THEN CASE WHEN shape = 13 THEN '' WHEN n < 0 THEN 'count=' || n || ',count=-3' ELSE 'count=-3' END END AS negative_references
FROM i""",
    "agg_18_item_reasons": _ITEMS + " SELECT coalesce(reason, 'eligible') AS reason, count(*) AS items FROM i GROUP BY ALL",
    "srt_05_boundary_traces": """
WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS pre, vec_id % 4 AS shape FROM embeddings WHERE vec_id % 4 < 2),
e AS (SELECT vec_id, i - 1 AS id, pre[i] AS x, (i - 1 + vec_id) % 3 = 0 AS gone FROM s, LATERAL (SELECT unnest(range(1, len(pre) + 1)) AS i)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY gone, x DESC, id) AS b FROM e
)
SELECT vec_id, least(240, vec_id % 300 + CASE vec_id % 4 WHEN 0 THEN 30 ELSE 12 END) AS suffix, count(*) FILTER (gone) AS masked,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY a) FILTER (a <= 8) AS pre, string_agg(CAST(id AS VARCHAR), ',' ORDER BY b) FILTER (b <= 8) AS post,
       round(max(x) FILTER (NOT gone), 6) AS best, round(max(x) FILTER (id = 3), 6) AS minus, count(*) FILTER (id IN (3, 5, 6, 40)) AS known
FROM r GROUP BY vec_id""",
    "scl_16_all_prompts": _prompts(),
    "jon_03b_subsets": """
WITH c AS (SELECT p_type AS subset, p_partkey AS pos, p_type || '_' || p_partkey AS item, p_size % 2 = 0 AS ok FROM part),
t AS (SELECT p_type AS subset, p_partkey AS pos, p_type || '_' || p_partkey || CASE WHEN p_partkey % 97 = 5 THEN 'x' ELSE '' END AS item, p_size % 3 = 0 AS ok FROM part WHERE p_partkey % 101 <> 3)
SELECT subset, count(*) AS control_rows, count(t.pos) AS treatment_rows, count(*) FILTER (t.item IS DISTINCT FROM c.item) AS mismatched, 0 AS repeated,
       count(*) FILTER (t.item = c.item) AS pairs, count(*) FILTER (t.item = c.item AND t.ok AND NOT c.ok) AS repaired, count(*) FILTER (t.item = c.item AND c.ok AND NOT t.ok) AS broken
FROM c LEFT JOIN t USING (subset, pos) GROUP BY subset""",
    "smp_05_first_controls": _THREE
    + """,
m AS (
  SELECT pos, CASE WHEN p AND NOT s AND NOT v THEN 'constrained_semantic_loss' WHEN p AND s AND v THEN 'matched_all_correct_control'
                   WHEN NOT (p OR s OR v) THEN 'shared_wrong_diagnostic' END AS reason
  FROM three WHERE pos % 7 <> 0
)
SELECT pos, reason AS selection_reason FROM m WHERE reason IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY reason ORDER BY pos) <= CASE reason WHEN 'matched_all_correct_control' THEN 5 WHEN 'shared_wrong_diagnostic' THEN 3 ELSE 1000000000000 END""",
    "jon_08b_shared_losses": _THREE + " SELECT pos, c IS NOT NULL AS available, coalesce(c, false) AS repaired FROM three WHERE p AND NOT s AND NOT v AND pos % 7 <> 0",
    "prj_01_projections": """
SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 7 = 1 THEN 'model' END, CASE WHEN c_custkey % 3 = 1 THEN 'field_order' END, CASE WHEN c_custkey % 5 = 2 THEN 'seed' END) AS config,
       CASE WHEN c_custkey % 4 = 2 OR c_custkey % 8 = 7 THEN 'packages' ELSE '' END AS environment
FROM customer""",
    "fil_02b_slice": """
WITH d AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS "index" FROM documents)
SELECT * FROM d WHERE "index" >= 50 AND "index" < 250""",
}
