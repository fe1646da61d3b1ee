"""The SQL of queries_strict: what the files, documents and calls hold by the way they were made."""

from __future__ import annotations

_LINES = """
WITH l AS (
  SELECT event_id, event_type, event_id // 4000 AS file, row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) AS line,
         CASE WHEN event_id % 101 = 0 THEN 'blank' WHEN event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 THEN 'invalid_json'
              WHEN event_id % 79 = 0 THEN 'not_object' WHEN event_id % 73 = 0 THEN 'other_schema' END AS problem
  FROM events
)"""

_TOOL = """
WITH p AS (SELECT p_partkey, p_brand, CAST(right(p_brand, 1) AS INT) AS d FROM part)"""

SQL: dict[str, str] = {
    "src_01_strict_lines": _LINES
    + """
SELECT file, count(*) FILTER (problem IS NULL) AS good, count(*) FILTER (problem <> 'blank') AS bad, min(line) FILTER (problem <> 'blank') AS first_line,
       arg_min(problem, line) FILTER (problem <> 'blank') AS first_problem
FROM l GROUP BY file HAVING count(*) FILTER (coalesce(problem, '') <> 'blank') > 0""",
    "src_01_other_lines": _LINES + " SELECT problem, count(*) AS lines, CAST(sum(line) AS BIGINT) AS line_sum FROM l WHERE problem IN ('invalid_json', 'other_schema') GROUP BY problem",
    "src_02_collecting_scan": _LINES + " SELECT event_type AS scope, coalesce(problem, 'none') AS problem, count(*) AS lines FROM l WHERE coalesce(problem, '') <> 'blank' GROUP BY ALL",
    "src_03_numbered_rows": _LINES + " SELECT file, line, event_id, event_type FROM l WHERE problem IS NULL",
    "src_04_inventory": """
WITH l AS (SELECT *, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS line FROM orders)
SELECT o_orderkey // 4000 AS file, count(*) AS "rows", count(DISTINCT o_custkey) AS distinct_keys, CAST(sum(strlen(line)) AS BIGINT) AS bytes,
       sha256(string_agg(line || chr(10), '' ORDER BY o_orderkey)) AS sha256
FROM l GROUP BY ALL""",
    "src_05_documents": """
SELECT c_nationkey AS file, CASE c_nationkey % 7 WHEN 3 THEN 'not_object' WHEN 5 THEN 'invalid_json' END AS problem,
       CASE WHEN c_nationkey % 7 NOT IN (3, 5) THEN sha256('{"customers":' || count(*) || ',"nation":' || c_nationkey || '}') END AS sha256
FROM customer GROUP BY c_nationkey""",
    "hsh_02_signature": r"""
SELECT DISTINCT c_mktsegment, c_nationkey, left(sha256('{"config":{"cap":null,"inner":{"limits":[1e+20,0.1],"zoom":' || CAST(c_nationkey / 2 AS VARCHAR) || '},"segment":"' || c_mktsegment || ' \u00e9\ud83d\ude00"}}'), 12) AS run_signature
FROM customer""",
    "hsh_03_canonical_digests": r"""
WITH t AS (SELECT event_id, '{"id":' || event_id || ',"list":[3,{"x":true,"y":null}],"z":{"a":"' AS head, '","b":' || CAST(value AS VARCHAR) || '}}' AS tail FROM events)
SELECT event_id, sha256(head || '\u00fc/\u00fc' || tail) AS escaped, sha256(head || 'ü/ü' || tail) AS plain, sha256(head || 'ü/ü' || tail || chr(10)) AS line FROM t""",
    "hsh_04_schema_digest": "SELECT DISTINCT p_brand, true AS same_schema, false AS same_text FROM part",
    "sch_05_tool_schemas": _TOOL + " SELECT p_brand, count(*) AS parts, d NOT IN (3, 4, 5) AS strict, CASE WHEN d NOT IN (3, 4, 5) THEN 7 END AS nodes, d NOT IN (2, 3, 4, 5) AS as_strings FROM p GROUP BY p_brand, d",
    "sch_01_documents": _TOOL
    + """,
c AS (SELECT l_orderkey, l_linenumber, -CAST(l_quantity AS BIGINT) AS q, d FROM lineitem JOIN p ON p_partkey = l_partkey WHERE d NOT IN (3, 4, 5))
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_linenumber IN (3, 6) THEN '/arguments' WHEN l_linenumber = 4 THEN '/arguments/quantity_delta' WHEN l_linenumber IN (1, 2, 5) AND d = 2 THEN '/arguments/quantity_delta' WHEN l_linenumber = 2 THEN '/name' END AS path,
       CASE WHEN l_linenumber = 3 THEN 'required' WHEN l_linenumber = 6 THEN 'additionalProperties' WHEN l_linenumber = 4 THEN 'type' WHEN l_linenumber IN (1, 2, 5) AND d = 2 THEN 'minimum' WHEN l_linenumber = 2 THEN 'const' END AS keyword,
       CASE WHEN l_linenumber = 3 THEN '''quantity_delta'' is a required property' WHEN l_linenumber = 6 THEN 'Additional properties are not allowed (''note'' was unexpected)'
            WHEN l_linenumber = 4 THEN '''' || q || ''' is not of type ''integer''' WHEN l_linenumber IN (1, 2, 5) AND d = 2 THEN q || CASE l_linenumber WHEN 5 THEN '.0' ELSE '' END || ' is less than the minimum' WHEN l_linenumber = 2 THEN 'adjust_stock was expected' END AS message
FROM c""",
    "srt_04_first_error": """
WITH e AS (SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
v AS (SELECT event_id, i, j, CASE j WHEN 0 THEN k + i ELSE (k + 5 * i) % 97 END AS x FROM e, (SELECT unnest(range(12)) AS i), (SELECT unnest(range(2)) AS j)),
b AS (SELECT event_id, arg_min(i, 2 * i + j) AS i, arg_min(j, 2 * i + j) AS j, arg_min(x, 2 * i + j) AS x FROM v WHERE x > 60 GROUP BY event_id)
SELECT event_id, '/lists/' || i || '/' || j AS path, x || ' is greater than the maximum' AS message FROM events LEFT JOIN b USING (event_id)""",
}
