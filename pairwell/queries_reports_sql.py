"""The SQL of queries_reports."""

from __future__ import annotations

_REPLICATION = """
WITH d AS (SELECT o_orderstatus AS role, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos FROM orders),
n AS (SELECT role, max(pos) AS items FROM d GROUP BY role),
c AS (SELECT role, condition, pos FROM d, (VALUES ('string'), ('integer')) v(condition) WHERE pos > 0 AND NOT (role = 'F' AND condition = 'integer' AND pos % 101 = 7)),
r AS (
  SELECT c.*, CASE WHEN role = 'F' AND condition = 'string' AND pos % 97 = 3 THEN pos + 1 WHEN role = 'F' AND condition = 'string' AND pos % 97 = 4 THEN pos - 1
                   WHEN role = 'O' AND condition = 'string' AND pos % 89 = 5 THEN pos - 1 ELSE pos END AS "from"
  FROM c
), kept AS (SELECT r.* FROM r JOIN n USING (role) WHERE "from" BETWEEN 1 AND items),
runs AS (SELECT role, condition, count(*) AS "rows", count(*) - count(DISTINCT "from") AS repeats, count(*) FILTER ("from" <> pos) AS moved,
                count(*) FILTER (role = 'O' AND condition = 'integer' AND pos % 50 = 1) AS revisions, count(*) FILTER (role = 'O' AND condition = 'integer' AND pos % 60 = 2) AS depths,
                count(*) FILTER (pos % 2 = 0) AS even
         FROM kept GROUP BY role, condition),
f AS (
  SELECT role, condition, unnest([
    {'c': 'row_count', 'n': abs("rows" - items - CASE WHEN role = 'P' THEN 1 ELSE 0 END)}, {'c': 'order', 'n': CAST(moved > 0 OR "rows" <> items AS BIGINT)}, {'c': 'duplicates', 'n': repeats},
    {'c': 'one_run', 'n': CAST(role = 'O' AND condition = 'integer' AND even > 0 AND even < "rows" AS BIGINT)}, {'c': 'model_revision', 'n': revisions}, {'c': 'template_depth', 'n': depths},
    {'c': 'signature', 'n': CAST(role = 'P' AND condition = 'integer' AS BIGINT)}, {'c': 'config_seed', 'n': CAST(role = 'P' AND condition = 'string' AS BIGINT)}]) AS x
  FROM runs JOIN n USING (role)
),
failed AS (SELECT role, condition, x.c AS "check", x.n AS n FROM f WHERE x.n > 0)"""

SQL: dict[str, str] = {
    "val_04_replication": _REPLICATION
    + """
SELECT * FROM failed
UNION ALL SELECT 'P', NULL, 'assigned_items', 1 UNION ALL SELECT 'P', NULL, 'paired_configs', 1 UNION ALL SELECT NULL, NULL, 'one_environment', 1""",
    "val_04_report": _REPLICATION
    + """
SELECT role, condition, count(*) AS "rows", CASE WHEN role = 'O' AND condition = 'integer' AND min(pos % 2) > 0 THEN 'first' WHEN role = 'O' AND condition = 'integer' AND max(pos % 2) = 0 THEN 'second' ELSE 'first' END AS run_id,
       count(*) FILTER (pos % 40 = 9) AS errors, count(*) FILTER (pos % 70 = 1) AS cap_hits, count(*) FILTER (pos % 30 = 4) AS internal_invalid,
       count(*) FILTER (pos % 20 = 4 OR pos % 15 = 4) AS external_invalid,
       coalesce((SELECT string_agg("check", ',' ORDER BY "check") FROM failed WHERE failed.role = kept.role AND failed.condition = kept.condition), '') AS failed,
       NOT EXISTS (SELECT 1 FROM failed WHERE failed.role = kept.role AND failed.condition = kept.condition) AS passes
FROM kept GROUP BY role, condition""",
    "snk_04_condition_table": """
WITH e AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events),
s AS (SELECT event_type AS condition, count(*) AS n, count(*) FILTER (k % 2 = 0) AS semantic, count(*) FILTER (k % 5 <> 0 AND k % 3 = 0) AS external, count(*) FILTER (k % 5 <> 0 AND k % 6 = 0) AS contract,
             count(*) FILTER (k % 11 <> 0) AS internal, count(*) FILTER (event_id % 4 = 0) AS negative, count(*) FILTER (k % 7 = 0) AS errors, count(*) FILTER (k >= 95) AS caps, avg(value) AS latency, avg(k) AS tokens
      FROM e GROUP BY event_type),
x AS (SELECT condition, n, [semantic, external, contract, internal, negative] AS c, errors, caps, latency, tokens FROM s)
SELECT 0 AS position, '| Condition | n | Semantic correctness | External validity | Contract-valid correctness | Internal validity | Negative answers | Errors | Cap hits | Avg latency ms | Avg tokens |' AS line
UNION ALL SELECT 1, '|---|---:|---:|---:|---:|---:|---:|---:|---:|---:|---:|'
UNION ALL SELECT row_number() OVER (ORDER BY condition) + 1, '| ' || condition || ' | ' || n || ' | ' || array_to_string(list_transform(c, lambda v: v || '/' || n || ' (' || printf('%.1f%%', v / CAST(n AS DOUBLE) * 100) || ')'), ' | ')
  || ' | ' || errors || ' | ' || caps || ' | ' || printf('%.1f', latency) || ' | ' || printf('%.1f', tokens) || ' |' FROM x""",
}
