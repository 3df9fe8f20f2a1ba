"""SQL that states the graph queries' results over the source tables, for another engine to run."""

from __future__ import annotations

BASE = """
WITH w AS (SELECT o_custkey AS pre, l_partkey AS post, CAST(l_quantity AS INTEGER) AS raw_weight, l_linenumber AS delay FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
, a AS (SELECT p_partkey AS body_id, p_type AS type, p_brand AS side FROM part)
, l AS (SELECT c_custkey AS body_id, c_mktsegment AS nt FROM customer)
, g AS (SELECT * FROM (VALUES ('AUTOMOBILE', 1), ('FURNITURE', 1), ('MACHINERY', 1), ('BUILDING', -1)) AS s(nt, sign))
, x AS (SELECT pre, post, raw_weight, delay, coalesce(nt, 'unknown') AS nt FROM w LEFT JOIN l ON pre = body_id)
, i AS (SELECT * FROM x WHERE nt <> 'HOUSEHOLD')
, u AS (SELECT body_id FROM a UNION SELECT pre FROM w UNION SELECT post FROM w)
, idx AS (SELECT body_id, row_number() OVER (ORDER BY body_id) - 1 AS id FROM u)
"""


def graph_sql(delays: bool) -> str:
    """e: the indexed, signed and scaled edges."""
    return BASE + f"""
, e AS (SELECT s.id AS source, t.id AS target, raw_weight, raw_weight * sign * 10 AS weight, {"delay" if delays else "1"} AS delay
        FROM i JOIN g USING (nt) JOIN idx s ON s.body_id = pre JOIN idx t ON t.body_id = post)
"""


def unrolled(delays: bool, steps: int, threshold: int = 400, shift: int = 2, refractory: int = 2, start: int = 5000) -> str:
    """every: t, id, v, refr, spike of each step, one set of expressions per step."""
    out = [graph_sql(delays), f", s AS (SELECT id, CASE WHEN body_id % 20 = 0 THEN {start} ELSE 0 END AS v, 0 AS refr FROM idx)"]
    before = "s"
    for t in range(steps):
        spikes = " UNION ALL ".join(f"SELECT id, {t - k} AS delay FROM s{k} WHERE spike" for k in range(t)) or "SELECT id, 0 AS delay FROM s WHERE false"
        out.append(f"""
, r{t} AS (SELECT target, sum(weight) AS current FROM e JOIN ({spikes}) p ON e.source = p.id AND e.delay = p.delay GROUP BY target)
, y{t} AS (SELECT b.id, b.refr, CASE WHEN b.refr = 0 THEN CAST(b.v + coalesce(current, 0) AS BIGINT) END AS y FROM {before} b LEFT JOIN r{t} ON target = b.id)
, z{t} AS (SELECT id, refr, y - (y >> {shift}) AS y FROM y{t})
, s{t} AS MATERIALIZED (SELECT id, CASE WHEN refr > 0 OR y >= {threshold} THEN 0 ELSE y END AS v, CASE WHEN refr > 0 THEN refr - 1 WHEN y >= {threshold} THEN {refractory} ELSE 0 END AS refr, coalesce(y >= {threshold}, false) AS spike FROM z{t})""")
        before = f"s{t}"
    out.append("\n, every AS (" + " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS t, * FROM s{t}" for t in range(steps)) + ")\n")
    return "".join(out)
