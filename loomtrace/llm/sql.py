"""SQL for the queries that SQL can express."""

from __future__ import annotations

from loomtrace.plans.packing_sql import NAMES, TRACES, events_sql

_BLOCK = "nullif(lower(trim({}, ' ' || chr(9) || chr(13) || chr(10))), '')"

#: Sequences of both tables with events named alike, and the gaps of the traces.
_SEQUENCES = f"""WITH {TRACES}, {NAMES},
both_ AS (
  SELECT 'event_traces' AS src, row_id, {_BLOCK.format("BlockId")} AS block, events, list_transform(gap_texts, lambda x: x::DOUBLE) AS gaps FROM judged JOIN event_traces USING (row_id) WHERE fault IS NULL
  UNION ALL SELECT 'block_sequences', row_id, {_BLOCK.format("block_id")}, {events_sql("event_ids")}, NULL FROM block_sequences WHERE event_ids IS NOT NULL),
flat AS (SELECT src, row_id, block, name AS e, i FROM (SELECT src, row_id, block, unnest(events) AS n, (generate_subscripts(events, 1) - 1)::INT AS i FROM both_) JOIN names USING (n))"""

_RUNS = _SEQUENCES + """,
islands AS (SELECT src, row_id, e, i, i - row_number() OVER (PARTITION BY src, row_id, e ORDER BY i) AS g FROM flat),
runs AS (SELECT src, row_id, e AS event, min(i) AS first_pos, max(i) AS last_pos, count(*)::INT AS n_events FROM islands GROUP BY src, row_id, e, g)"""
P1_FOUND = _RUNS + " SELECT src, row_id, first_pos, last_pos FROM runs WHERE n_events > 1"
P1_RUNS = _RUNS + """ SELECT src, row_id, first_pos, last_pos, event, n_events, CASE WHEN src = 'event_traces' THEN round(coalesce(list_sum(gaps[first_pos + 1:last_pos]), 0), 6) END AS duration FROM runs JOIN (SELECT src, row_id, gaps FROM both_) USING (src, row_id)"""

P1_EVENT_RUNS = """WITH e AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, event_type, count(*) AS n_events FROM e GROUP BY user_id, event_type, g"""


def _level(n: int) -> str:
    """Patterns of n events from the frequent ones of n - 1, each at the first place where it ends in a row."""
    return f"""
l{n} AS MATERIALIZED (SELECT l.src, l.row_id, l.block, l.p || '>E' || x.e AS p, x.i FROM l{n - 1} l JOIN f{n - 1} USING (src, p) JOIN follow x ON x.src = l.src AND x.row_id = l.row_id AND x.after = l.i),
f{n} AS MATERIALIZED (SELECT src, p, count(DISTINCT block) AS support FROM l{n} JOIN total USING (src) GROUP BY src, p, need HAVING count(DISTINCT block) >= need)"""


P2_PATTERNS = _SEQUENCES + """,
total AS (SELECT src, count(DISTINCT block) / 8 AS need FROM both_ GROUP BY src),
own AS MATERIALIZED (SELECT * FROM flat WHERE block IS NOT NULL),
follow AS MATERIALIZED (SELECT a.src, a.row_id, a.i AS after, b.e, min(b.i) AS i FROM own a JOIN own b ON a.src = b.src AND a.row_id = b.row_id AND b.i > a.i GROUP BY ALL),
l1 AS MATERIALIZED (SELECT src, row_id, block, 'E' || e AS p, min(i) AS i FROM own GROUP BY src, row_id, block, e),
f1 AS MATERIALIZED (SELECT src, p, count(DISTINCT block) AS support FROM l1 JOIN total USING (src) GROUP BY src, p, need HAVING count(DISTINCT block) >= need),""" + ",".join(map(_level, (2, 3, 4))) + """
SELECT src, p AS pattern, support FROM f3 UNION ALL SELECT src, p, support FROM f4"""
P2_FOUND = f"SELECT src, pattern FROM ({P2_PATTERNS})"

_RELATED = f"""WITH RECURSIVE keyed AS (
  SELECT row_id, 'b' || {_BLOCK.format("block_id")} AS k FROM block_sequences UNION ALL SELECT row_id, 's' || nullif(regexp_extract(lower(trace_signature), '([0-9a-f]{{64}})', 1), '') FROM block_sequences),
held AS (SELECT row_id, min(row_id) OVER (PARTITION BY k) AS m FROM keyed WHERE k IS NOT NULL),
links AS MATERIALIZED (SELECT DISTINCT row_id AS a, m AS b FROM held WHERE row_id <> m UNION SELECT m, row_id FROM held WHERE row_id <> m),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""
P4_FOUND = _RELATED + """ SELECT min(b) AS row_id_a, a AS row_id_b FROM reach GROUP BY a HAVING min(b) < a"""

P4_SPLIT_REPORT = _RELATED + """, members AS (SELECT a FROM reach GROUP BY a HAVING min(b) < a)
SELECT (SELECT count(*) FROM split_targets) AS splits, count(*) AS records, count(*) FILTER (lower(trim(label)) = 'anomaly') AS anomalies, count(*) FILTER (lower(trim(label)) = 'normal') AS normals,
 count(*) - (SELECT count(*) FROM members) AS whole_groups, (SELECT count(*) FROM split_targets) AS near_target, (SELECT count(*) FROM split_targets) AS with_both_labels FROM block_sequences"""

ORACLES = {"p1_found": P1_FOUND, "p1_runs": P1_RUNS, "p1_event_runs": P1_EVENT_RUNS, "p2_found": P2_FOUND, "p2_patterns": P2_PATTERNS, "p4_found": P4_FOUND, "p4_split_report": P4_SPLIT_REPORT}
