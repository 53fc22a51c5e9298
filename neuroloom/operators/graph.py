"""Signed digraphs: edge attributes, pair statistics, regions and summaries, all by session and stimulus."""

from __future__ import annotations

from .sql import operator

_KEYS = "session, stimulus"
_N = "k AS (SELECT count(*) AS n FROM {nodes})"

graph_edges = operator("graph_edges", "SELECT session, stimulus, src, dst, weight, confidence FROM {edges} WHERE weight <> 0")
# In the canonical order if all stimuli are known to it, else by name; the last known one is left out.
session_stimulus = operator("session_stimulus", """
WITH known AS (SELECT * FROM (VALUES ('3-MEDIUM', 1), ('1-URGENT', 2), ('2-HIGH', 3), ('5-LOW', 4), ('4-NOT SPECIFIED', 5)) AS t(stimulus, rank)),
d AS (SELECT DISTINCT session, stimulus FROM {edges}),
a AS (SELECT d.session, d.stimulus, rank, min(CASE WHEN rank IS NULL THEN 0 ELSE 1 END) OVER () AS sure FROM d LEFT JOIN known ON known.stimulus = d.stimulus)
SELECT session, stimulus, row_number() OVER (PARTITION BY session ORDER BY CASE WHEN sure = 1 THEN rank END, stimulus) AS place FROM a WHERE coalesce(rank, 0) <> 5""")
# Which stimuli count as one, and the order they are told in.
COMBINED = """comb AS (SELECT * FROM (VALUES ('1-URGENT', 0, 'fast'), ('2-HIGH', 0, 'fast'), ('3-MEDIUM', 1, 'plain'), ('4-NOT SPECIFIED', 2, 'slow'), ('5-LOW', 2, 'slow')) AS t(stimulus, place, combined))"""
combined_stimulus = operator("combined_stimulus", f"""
WITH {COMBINED}
SELECT session, combined, CAST(place AS BIGINT) AS place, count(*) AS edges FROM {{edges}} e JOIN comb m ON e.stimulus = m.stimulus GROUP BY session, combined, place""")
edge_sign = operator("edge_sign", "SELECT session, stimulus, src, dst, CAST(sign(weight) AS BIGINT) AS edge_sign FROM {edges}")
edge_delay = operator("edge_delay", "SELECT session, stimulus, src, dst, edge_offset, duration, edge_offset + duration AS delay FROM {edges}")
binary_edges = operator("binary_edges", "SELECT session, stimulus, src, dst, 1 AS weight FROM {edges} WHERE weight <> 0")


def scaling(name: str, low: float, high: float, logscale: bool = False):
    """Sizes of weights, or 2 to their power, stretched to low .. high within a graph; a graph of equal sizes has ``low``."""
    size = "power(2.0, abs(weight))" if logscale else "abs(weight)"
    return operator(name, f"""
SELECT session, stimulus, src, dst, round(CASE WHEN hi = lo THEN {low} ELSE {low} + (x - lo) / (hi - lo) * {high - low} END, 6) AS width
FROM (SELECT *, min(x) OVER (PARTITION BY session, stimulus) AS lo, max(x) OVER (PARTITION BY session, stimulus) AS hi FROM (SELECT *, {size} AS x FROM {{edges}}) y) s""")


scale_interval, scale_interval_log = scaling("scale_interval", 1.0, 5.0), scaling("scale_interval_log", 0.0, 1.0, logscale=True)
log2_signed = operator("log2_signed", "SELECT session, stimulus, src, dst, round(log2(abs(weight)) * CASE WHEN weight >= 0 THEN 1 ELSE -1 END, 6) AS value FROM {edges} WHERE weight <> 0")
# What each of two stimuli of a session has and the other lacks.
edge_difference = operator("edge_difference", """
WITH g AS (SELECT DISTINCT session, stimulus FROM {edges}),
p AS (SELECT a.session, a.stimulus AS own, b.stimulus AS other FROM g a JOIN g b ON a.session = b.session AND a.stimulus <> b.stimulus)
SELECT p.session, own, other, e.src, e.dst FROM p JOIN {edges} e ON e.session = p.session AND e.stimulus = p.own
WHERE NOT EXISTS (SELECT 1 FROM {edges} f WHERE f.session = p.session AND f.stimulus = p.other AND f.src = e.src AND f.dst = e.dst)""")

_PAIRS = """p AS (SELECT e.session, e.stimulus, least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS m,
  CAST(sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS BIGINT) AS plus FROM {edges} e GROUP BY e.session, e.stimulus, least(src, dst), greatest(src, dst))"""
pair_connection = operator("pair_connection", f"""WITH {_PAIRS}, {_N}
SELECT session, stimulus, round(1 - count(*) / (max(n) * (max(n) - 1) / 2.0), 6) AS p0, round(sum(CASE WHEN m = 1 THEN 1 ELSE 0 END) / (max(n) * (max(n) - 1) / 2.0), 6) AS p1,
  round(sum(CASE WHEN m = 2 THEN 1 ELSE 0 END) / (max(n) * (max(n) - 1) / 2.0), 6) AS p2 FROM p CROSS JOIN k GROUP BY session, stimulus""")
_CLASSES = """sum(CASE WHEN m = 1 AND plus = 1 THEN 1 ELSE 0 END) AS c1, sum(CASE WHEN m = 1 AND plus = 0 THEN 1 ELSE 0 END) AS c2,
  sum(CASE WHEN m = 2 AND plus = 2 THEN 1 ELSE 0 END) AS c3, sum(CASE WHEN m = 2 AND plus = 1 THEN 1 ELSE 0 END) AS c4, sum(CASE WHEN m = 2 AND plus = 0 THEN 1 ELSE 0 END) AS c5"""
_SIGNED = f"{_PAIRS}, {_N}, q AS (SELECT session, stimulus, max(n) * (max(n) - 1) / 2.0 AS pairs, count(*) AS linked, {_CLASSES} FROM p CROSS JOIN k GROUP BY session, stimulus)"
_SHARES = "round(1 - linked / pairs, 6) AS none, round(c1 / pairs, 6) AS plus, round(c2 / pairs, 6) AS minus, round(c3 / pairs, 6) AS plus_plus, round(c4 / pairs, 6) AS plus_minus, round(c5 / pairs, 6) AS minus_minus"
signed_pair_unordered = operator("signed_pair_unordered", f"WITH {_SIGNED} SELECT session, stimulus, {_SHARES} FROM q")
# Over ordered pairs each unordered pair counts twice in both parts of the fraction; counts differ, shares don't.
signed_pair_ordered = operator("signed_pair_ordered", f"WITH {_SIGNED} SELECT session, stimulus, CAST(2 * pairs AS BIGINT) AS ordered_pairs, {_SHARES} FROM q")
relative_pair_count = operator("relative_pair_count", f"""WITH {_SIGNED},
d AS (SELECT session, stimulus, sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) / (max(n) * (max(n) - 1.0)) AS p, sum(CASE WHEN weight > 0 THEN 0 ELSE 1 END) / (max(n) * (max(n) - 1.0)) AS q FROM {{edges}} CROSS JOIN k GROUP BY session, stimulus)
SELECT q.session, q.stimulus, round(CASE WHEN ((1 - d.p - d.q) * (1 - d.p - d.q)) = 0 THEN 0 ELSE (1 - linked / pairs) / nullif(((1 - d.p - d.q) * (1 - d.p - d.q)), 0) END, 6) AS none, round(CASE WHEN (2 * d.p * (1 - d.p - d.q)) = 0 THEN 0 ELSE (c1 / pairs) / nullif((2 * d.p * (1 - d.p - d.q)), 0) END, 6) AS plus, round(CASE WHEN (2 * d.q * (1 - d.p - d.q)) = 0 THEN 0 ELSE (c2 / pairs) / nullif((2 * d.q * (1 - d.p - d.q)), 0) END, 6) AS minus,
  round(CASE WHEN (d.p * d.p) = 0 THEN 0 ELSE (c3 / pairs) / nullif((d.p * d.p), 0) END, 6) AS plus_plus, round(CASE WHEN (2 * d.p * d.q) = 0 THEN 0 ELSE (c4 / pairs) / nullif((2 * d.p * d.q), 0) END, 6) AS plus_minus, round(CASE WHEN (d.q * d.q) = 0 THEN 0 ELSE (c5 / pairs) / nullif((d.q * d.q), 0) END, 6) AS minus_minus
FROM q JOIN d ON q.session = d.session AND q.stimulus = d.stimulus""")

ex_in_density = operator("ex_in_density", f"""WITH {_N}
SELECT session, stimulus, count(*) FILTER (WHERE weight > 0) AS excitatory, count(*) FILTER (WHERE weight < 0) AS inhibitory,
  round(count(*) FILTER (WHERE weight > 0) / (max(n) * (max(n) - 1.0)), 6) AS ex_density, round(count(*) FILTER (WHERE weight < 0) / (max(n) * (max(n) - 1.0)), 6) AS in_density FROM {{edges}} CROSS JOIN k GROUP BY session, stimulus""")
density = operator("density", f"WITH {_N} SELECT session, stimulus, round(count(*) / (max(n) * (max(n) - 1.0)), 6) AS density FROM {{edges}} CROSS JOIN k GROUP BY session, stimulus")
ex_fraction = operator("ex_fraction", "SELECT session, stimulus, round(count(*) FILTER (WHERE weight > 0) / CAST(count(*) AS DOUBLE), 6) AS excitatory, round(count(*) FILTER (WHERE weight < 0) / CAST(count(*) AS DOUBLE), 6) AS inhibitory FROM {edges} GROUP BY session, stimulus")
region_matrix = operator("region_matrix", "SELECT session, stimulus, a.area AS src_area, b.area AS dst_area, count(*) AS edges, count(*) FILTER (WHERE weight > 0) AS excitatory FROM {edges} e JOIN {nodes} a ON e.src = a.node JOIN {nodes} b ON e.dst = b.node GROUP BY session, stimulus, a.area, b.area")
intra_inter = operator("intra_inter", "SELECT session, stimulus, round(avg(CASE WHEN a.area = b.area THEN 1.0 ELSE 0.0 END), 6) AS intra, round(avg(CASE WHEN a.area = b.area THEN 0.0 ELSE 1.0 END), 6) AS inter FROM {edges} e JOIN {nodes} a ON e.src = a.node JOIN {nodes} b ON e.dst = b.node GROUP BY session, stimulus")
degrees = operator("degrees", """
WITH g AS (SELECT DISTINCT session, stimulus FROM {edges}), o AS (SELECT session, stimulus, src, count(*) AS n FROM {edges} GROUP BY session, stimulus, src), i AS (SELECT session, stimulus, dst, count(*) AS n FROM {edges} GROUP BY session, stimulus, dst)
SELECT g.session, g.stimulus, node, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM g CROSS JOIN {nodes}
LEFT JOIN o ON o.session = g.session AND o.stimulus = g.stimulus AND o.src = node LEFT JOIN i ON i.session = g.session AND i.stimulus = g.stimulus AND i.dst = node""")

# Triangles once each: a pair goes up from the node with fewer partners, so that a hub is the middle of few wedges.
_UP = """u AS (SELECT session, stimulus, a, b, count(*) AS w FROM (SELECT session, stimulus, src AS a, dst AS b FROM {edges} UNION ALL SELECT session, stimulus, dst, src FROM {edges}) x GROUP BY session, stimulus, a, b),
deg AS (SELECT session, stimulus, a AS node, CAST(sum(w) AS BIGINT) AS d, CAST(sum(CASE WHEN w = 2 THEN 1 ELSE 0 END) AS BIGINT) AS m, count(*) AS partners FROM u GROUP BY session, stimulus, a),
up AS (SELECT u.session, u.stimulus, a, b, w FROM u JOIN deg p ON p.session = u.session AND p.stimulus = u.stimulus AND p.node = a JOIN deg q ON q.session = u.session AND q.stimulus = u.stimulus AND q.node = b
  WHERE p.partners < q.partners OR p.partners = q.partners AND a < b),
tri AS (SELECT x.session, x.stimulus, x.a AS n1, x.b AS n2, y.b AS n3, x.w * y.w * z.w AS t FROM up x JOIN up y ON x.session = y.session AND x.stimulus = y.stimulus AND x.a = y.a AND x.b <> y.b
  JOIN up z ON z.session = x.session AND z.stimulus = x.stimulus AND z.a = x.b AND z.b = y.b)"""
# (A + A^T)^3 / (2 (d (d - 1) - 2 b)): weights of undirected pairs are 1 or 2, b counts mutual partners; each triangle is met from both sides.
clustering = operator("clustering", f"""WITH {_UP}, {_N},
own AS (SELECT session, stimulus, node, CAST(2 * sum(t) AS BIGINT) AS t FROM (SELECT session, stimulus, n1 AS node, t FROM tri UNION ALL SELECT session, stimulus, n2, t FROM tri UNION ALL SELECT session, stimulus, n3, t FROM tri) x GROUP BY session, stimulus, node)
SELECT deg.session, deg.stimulus, round(sum(coalesce(t, 0) / (2.0 * nullif(d * (d - 1) - 2 * m, 0))) / max(n), 6) AS clustering
FROM deg LEFT JOIN own ON own.session = deg.session AND own.stimulus = deg.stimulus AND own.node = deg.node CROSS JOIN k GROUP BY deg.session, deg.stimulus""")
transitivity = operator("transitivity", f"""WITH {_UP},
w AS (SELECT session, stimulus, CAST(sum(partners * (partners - 1)) AS BIGINT) AS wedges FROM deg GROUP BY session, stimulus),
t AS (SELECT session, stimulus, 6 * count(*) AS closed FROM tri GROUP BY session, stimulus)
SELECT w.session, w.stimulus, round(coalesce(closed, 0) / CAST(wedges AS DOUBLE), 6) AS transitivity FROM w LEFT JOIN t ON w.session = t.session AND w.stimulus = t.stimulus""")
reciprocity = operator("reciprocity", """
SELECT a.session, a.stimulus, round(count(b.src) / CAST(count(*) AS DOUBLE), 6) AS reciprocity FROM {edges} a LEFT JOIN {edges} b ON a.session = b.session AND a.stimulus = b.stimulus AND a.src = b.dst AND a.dst = b.src GROUP BY a.session, a.stimulus""")
assortativity = operator("assortativity", """
WITH o AS (SELECT session, stimulus, src AS node, count(*) AS n FROM {edges} GROUP BY session, stimulus, src), i AS (SELECT session, stimulus, dst AS node, count(*) AS n FROM {edges} GROUP BY session, stimulus, dst),
x AS (SELECT e.session, e.stimulus, so.n AS src_out, coalesce(si.n, 0) AS src_in, coalesce(tout.n, 0) AS dst_out, di.n AS dst_in FROM {edges} e
  JOIN o so ON so.session = e.session AND so.stimulus = e.stimulus AND so.node = e.src LEFT JOIN i si ON si.session = e.session AND si.stimulus = e.stimulus AND si.node = e.src
  LEFT JOIN o tout ON tout.session = e.session AND tout.stimulus = e.stimulus AND tout.node = e.dst JOIN i di ON di.session = e.session AND di.stimulus = e.stimulus AND di.node = e.dst)
SELECT session, stimulus, round(corr(src_out, dst_in), 6) AS out_in, round(corr(src_in, dst_out), 6) AS in_out, round(corr(src_in, dst_in), 6) AS in_in, round(corr(src_out, dst_out), 6) AS out_out FROM x GROUP BY session, stimulus""")
_LIMITS = ", ".join(f"round(percentile_cont({low}) WITHIN GROUP (ORDER BY CASE WHEN weight < 0 THEN weight END), 6) AS low_{k}, round(percentile_cont({high}) WITHIN GROUP (ORDER BY CASE WHEN weight > 0 THEN weight END), 6) AS high_{k}" for k, low, high in (("wide", 0.2, 0.85), ("narrow", 0.005, 0.992), ("usual", 0.02, 0.98)))
percentile_limits = operator("percentile_limits", f"SELECT session, stimulus, {_LIMITS} FROM {{edges}} GROUP BY session, stimulus")
weight_mode = operator("weight_mode", """
SELECT session, stimulus, edge_offset, n FROM (SELECT session, stimulus, edge_offset, count(*) AS n, row_number() OVER (PARTITION BY session, stimulus ORDER BY count(*) DESC, edge_offset) AS k FROM {edges} GROUP BY session, stimulus, edge_offset) q WHERE k = 1""")
density_regression = operator("density_regression", f"""WITH {_N},
d AS (SELECT session, stimulus, count(*) / (max(n) * (max(n) - 1.0)) AS x, avg(CASE WHEN a.area = b.area THEN 1.0 ELSE 0.0 END) AS y FROM {{edges}} e JOIN {{nodes}} a ON e.src = a.node JOIN {{nodes}} b ON e.dst = b.node CROSS JOIN k GROUP BY session, stimulus)
SELECT session, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, round(regr_slope(y, log10(x)), 6) AS log_slope FROM d GROUP BY session""")
two_step = operator("two_step", "SELECT a.session, a.stimulus, a.src, b.dst, count(*) AS paths FROM {edges} a JOIN {edges} b ON a.session = b.session AND a.stimulus = b.stimulus AND a.dst = b.src AND a.src <> b.dst GROUP BY a.session, a.stimulus, a.src, b.dst")
