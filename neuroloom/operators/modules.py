"""Communities and signal correlation: pairs, purity and coverage, thresholds, boundaries, resolution choice."""

from __future__ import annotations

from .graph import COMBINED
from .sql import operator

_G = "g AS (SELECT DISTINCT session, stimulus FROM {edges})"

signal_corr_pairs = operator("signal_corr_pairs", f"""WITH {_G},
b AS (SELECT g.session, g.stimulus, i, j, r FROM g CROSS JOIN {{scorr}} s WHERE r IS NOT NULL),
d AS (SELECT session, stimulus, i, j, r, i AS src, j AS dst FROM b UNION ALL SELECT session, stimulus, i, j, r, j, i FROM b),
x AS (SELECT d.*, e.weight FROM d LEFT JOIN {{edges}} e ON e.session = d.session AND e.stimulus = d.stimulus AND e.src = d.src AND e.dst = d.dst),
y AS (SELECT *, count(weight) OVER (PARTITION BY session, stimulus, i, j) AS linked FROM x)
SELECT session, stimulus, src, dst, r, CASE WHEN weight > 0 THEN 1 ELSE 0 END AS positive, CASE WHEN weight < 0 THEN 1 ELSE 0 END AS negative FROM y WHERE weight IS NOT NULL OR linked = 0 AND src < dst""")
signal_corr_connected = operator("signal_corr_connected", f"""WITH {_G},
d AS (SELECT g.session, g.stimulus, i, j, r, i AS src, j AS dst FROM g CROSS JOIN {{scorr}} s UNION ALL SELECT g.session, g.stimulus, i, j, r, j, i FROM g CROSS JOIN {{scorr}} s)
SELECT d.session, d.stimulus, d.src, d.dst, r, CASE WHEN weight > 0 THEN 1 ELSE 0 END AS positive, CASE WHEN weight < 0 THEN 1 ELSE 0 END AS negative FROM d JOIN {{edges}} e ON e.session = d.session AND e.stimulus = d.stimulus AND e.src = d.src AND e.dst = d.dst WHERE r IS NOT NULL""")
signal_corr_comm_connected = operator("signal_corr_comm_connected", f"""
WITH {COMBINED}, u AS (SELECT DISTINCT session, stimulus, least(src, dst) AS i, greatest(src, dst) AS j FROM {{edges}})
SELECT u.session, combined, CASE WHEN a.comm = b.comm THEN 'within' ELSE 'across' END AS part, count(*) AS pairs, round(avg(r), 6) AS mean_r
FROM u JOIN comb ON comb.stimulus = u.stimulus JOIN {{scorr}} s ON s.i = u.i AND s.j = u.j JOIN {{comms}} a ON a.node = u.i JOIN {{comms}} b ON b.node = u.j AND a.run = b.run
WHERE r IS NOT NULL GROUP BY u.session, combined, CASE WHEN a.comm = b.comm THEN 'within' ELSE 'across' END""")
signal_corr_comm = operator("signal_corr_comm", "SELECT a.run, CASE WHEN a.comm = b.comm THEN 'within' ELSE 'across' END AS part, count(*) AS pairs, round(avg(r), 6) AS mean_r, round(stddev_samp(r), 6) AS std_r FROM {scorr} s JOIN {comms} a ON a.node = i JOIN {comms} b ON b.node = j AND a.run = b.run GROUP BY a.run, CASE WHEN a.comm = b.comm THEN 'within' ELSE 'across' END")
between_comm_edges = operator("between_comm_edges", "SELECT session, stimulus, a.run, least(a.comm, b.comm) AS low, greatest(a.comm, b.comm) AS high, count(*) AS edges FROM {edges} e JOIN {comms} a ON a.node = src JOIN {comms} b ON b.node = dst AND a.run = b.run WHERE a.comm <> b.comm GROUP BY session, stimulus, a.run, least(a.comm, b.comm), greatest(a.comm, b.comm)")
comm_select = operator("comm_select", """
WITH n AS (SELECT run, comm, count(*) AS size FROM {comms} GROUP BY run, comm HAVING count(*) >= 6)
SELECT n.run, n.comm, n.size FROM n WHERE EXISTS (SELECT 1 FROM {edges} e JOIN {comms} a ON a.node = e.src JOIN {comms} b ON b.node = e.dst AND b.run = a.run WHERE a.run = n.run AND a.comm = n.comm AND b.comm <> n.comm)""")
_SHARE = """s AS (SELECT run, comm, area, count(*) AS n FROM {comms} c JOIN {nodes} d ON c.node = d.node GROUP BY run, comm, area),
t AS (SELECT area, count(*) AS total FROM {nodes} GROUP BY area),
q AS (SELECT run, comm, CAST(sum(n) AS BIGINT) AS size, max(n) / CAST(sum(n) AS DOUBLE) AS purity, max(n / CAST(total AS DOUBLE)) AS coverage FROM s JOIN t ON s.area = t.area GROUP BY run, comm HAVING sum(n) >= 4)"""
# Modules of four nodes or more with an edge inside, by graph.
_INNER = f"""{_SHARE},
m AS (SELECT DISTINCT session, stimulus, a.run, a.comm FROM {{edges}} JOIN {{comms}} a ON a.node = src JOIN {{comms}} b ON b.node = dst AND a.run = b.run AND a.comm = b.comm),
x AS (SELECT session, stimulus, m.run, m.comm, size / CAST(nodes AS DOUBLE) AS relative, purity, coverage FROM m JOIN q ON m.run = q.run AND m.comm = q.comm CROSS JOIN (SELECT count(*) AS nodes FROM {{nodes}}) k)"""
module_purity = operator("module_purity", f"WITH {_INNER} SELECT session, stimulus, run, comm, round(relative, 6) AS relative_size, round(purity, 6) AS purity, round(coverage, 6) AS coverage FROM x")
purity_coverage = operator("purity_coverage", f"WITH {_SHARE} SELECT run, CAST(sum(size) AS BIGINT) AS nodes, round(sum(size * purity) / sum(size), 6) AS purity, round(sum(size * coverage) / sum(size), 6) AS coverage FROM q GROUP BY run")
purity_cumulative = operator("purity_cumulative", f"""WITH {_SHARE}, r AS (SELECT run, sum(size) AS n, sum(size * purity) AS p, sum(size * coverage) AS c FROM q GROUP BY run)
SELECT run, round(sum(p) OVER (ORDER BY run) / sum(n) OVER (ORDER BY run), 6) AS purity, round(sum(c) OVER (ORDER BY run) / sum(n) OVER (ORDER BY run), 6) AS coverage FROM r""")
module_by_area = operator("module_by_area", f"""WITH {_SHARE}, o AS (SELECT s.run, s.comm, area, row_number() OVER (PARTITION BY s.run, s.comm ORDER BY n DESC, area) AS k FROM s)
SELECT o.run, o.area, count(*) AS modules, round(avg(size), 6) AS size, round(avg(purity), 6) AS purity, round(avg(coverage), 6) AS coverage FROM o JOIN q ON o.run = q.run AND o.comm = q.comm WHERE k = 1 GROUP BY o.run, o.area""")
threshold_curve = operator("threshold_curve", f"""WITH {_INNER}, {COMBINED}, g AS (SELECT SERIES(0, 10) AS step),
all_of AS (SELECT combined, count(*) AS graphs FROM (SELECT DISTINCT session, stimulus FROM {{edges}}) e JOIN comb ON comb.stimulus = e.stimulus GROUP BY combined),
r AS (SELECT count(DISTINCT run) AS runs FROM {{comms}}),
y AS (SELECT combined, purity, coverage FROM x JOIN comb ON comb.stimulus = x.stimulus)
SELECT y.combined, CAST(step AS BIGINT) AS step, round(count(*) FILTER (WHERE purity >= step / 10.0) / CAST(max(graphs) * max(runs) AS DOUBLE), 6) AS purity, round(count(*) FILTER (WHERE coverage >= step / 10.0) / CAST(max(graphs) * max(runs) AS DOUBLE), 6) AS coverage
FROM y JOIN all_of ON all_of.combined = y.combined CROSS JOIN g CROSS JOIN r GROUP BY y.combined, step""")
adjusted_rand = operator("adjusted_rand", """
WITH x AS (SELECT run, comm, area, count(*) AS n FROM {comms} c JOIN {nodes} d ON c.node = d.node GROUP BY run, comm, area),
i AS (SELECT run, sum(n * (n - 1) / 2.0) AS agree, sum(n) AS total FROM x GROUP BY run),
a AS (SELECT run, sum(n * (n - 1) / 2.0) AS s FROM (SELECT run, comm, sum(n) AS n FROM x GROUP BY run, comm) q GROUP BY run),
b AS (SELECT run, sum(n * (n - 1) / 2.0) AS s FROM (SELECT run, area, sum(n) AS n FROM x GROUP BY run, area) q GROUP BY run)
SELECT i.run, round((agree - a.s * b.s / (total * (total - 1) / 2.0)) / ((a.s + b.s) / 2 - a.s * b.s / (total * (total - 1) / 2.0)), 6) AS ari FROM i JOIN a ON i.run = a.run JOIN b ON i.run = b.run""")
area_boundary = operator("area_boundary", "SELECT session, stimulus, a.run, a.comm AS src_comm, b.comm AS dst_comm, count(*) AS edges, count(*) FILTER (WHERE weight > 0) AS positive, count(*) FILTER (WHERE weight < 0) AS negative FROM {edges} e JOIN {comms} a ON a.node = src JOIN {comms} b ON b.node = dst AND a.run = b.run GROUP BY session, stimulus, a.run, a.comm, b.comm")
# Of modules of four nodes or more, each with the area most of its nodes lie in (the least on ties): signal correlation, density and
# shares of signs within, between two of the same area, and over all pairs (part 'any', without an area).
def module_areas(one_sided: bool = False):
    """Density between modules counts all edges of both directions.  ``one_sided``: as in the study, all edges from the first and the positive
    ones from the second, and in part 'any' the positive ones of both."""
    between, whole = ("m1 + p2", "p1 + p2") if one_sided else ("m1 + m2", "m1 + m2")
    return operator("module_area_data", _AREA_DATA.replace("BETWEEN_EDGES", between).replace("ANY_EDGES", whole))


_AREA_DATA = """
WITH n AS (SELECT run, comm, count(*) AS size FROM {comms} GROUP BY run, comm HAVING count(*) >= 4),
k AS (SELECT c.run, c.comm, area, row_number() OVER (PARTITION BY c.run, c.comm ORDER BY count(*) DESC, area) AS rk FROM {comms} c JOIN {nodes} d ON d.node = c.node GROUP BY c.run, c.comm, area),
m AS (SELECT n.run, n.comm, size, area FROM n JOIN k ON k.run = n.run AND k.comm = n.comm AND rk = 1),
g AS (SELECT DISTINCT session, stimulus FROM {edges}),
e AS (SELECT session, stimulus, a.run, a.comm AS p, b.comm AS q, count(*) AS m, count(*) FILTER (WHERE weight > 0) AS plus, count(*) FILTER (WHERE weight < 0) AS minus
  FROM {edges} JOIN {comms} a ON a.node = src JOIN {comms} b ON b.node = dst AND b.run = a.run GROUP BY session, stimulus, a.run, a.comm, b.comm),
c AS (SELECT a.run, least(a.comm, b.comm) AS p, greatest(a.comm, b.comm) AS q, avg(r) AS r FROM {scorr} JOIN {comms} a ON a.node = i JOIN {comms} b ON b.node = j AND b.run = a.run WHERE r IS NOT NULL GROUP BY a.run, least(a.comm, b.comm), greatest(a.comm, b.comm)),
inside AS (SELECT g.session, g.stimulus, m.run, m.area, c.r, coalesce(e.m, 0) / (size * (size - 1.0)) AS density, plus / CAST(nullif(e.m, 0) AS DOUBLE) AS plus, minus / CAST(nullif(e.m, 0) AS DOUBLE) AS minus
  FROM g CROSS JOIN m LEFT JOIN c ON c.run = m.run AND c.p = m.comm AND c.q = m.comm LEFT JOIN e ON e.session = g.session AND e.stimulus = g.stimulus AND e.run = m.run AND e.p = m.comm AND e.q = m.comm),
pairs AS (SELECT g.session, g.stimulus, x.run, CASE WHEN x.area = y.area THEN x.area END AS area, c.r, x.size * y.size AS cells, coalesce(u.m, 0) AS m1, coalesce(v.m, 0) AS m2, coalesce(u.plus, 0) AS p1, coalesce(v.plus, 0) AS p2, coalesce(u.minus, 0) + coalesce(v.minus, 0) AS minus
  FROM g CROSS JOIN m x JOIN m y ON x.run = y.run AND x.comm < y.comm LEFT JOIN c ON c.run = x.run AND c.p = x.comm AND c.q = y.comm
  LEFT JOIN e u ON u.session = g.session AND u.stimulus = g.stimulus AND u.run = x.run AND u.p = x.comm AND u.q = y.comm LEFT JOIN e v ON v.session = g.session AND v.stimulus = g.stimulus AND v.run = x.run AND v.p = y.comm AND v.q = x.comm),
whole AS (SELECT a.run, avg(r) AS r FROM {scorr} JOIN {comms} a ON a.node = i JOIN {comms} b ON b.node = j AND b.run = a.run AND b.comm <> a.comm WHERE r IS NOT NULL GROUP BY a.run),
parts AS (SELECT session, stimulus, run, 'within' AS part, area, r, density, plus, minus FROM inside
  UNION ALL SELECT session, stimulus, run, 'between', area, r, (BETWEEN_EDGES) / CAST(cells AS DOUBLE), (p1 + p2) / CAST(nullif(m1 + m2, 0) AS DOUBLE), minus / CAST(nullif(m1 + m2, 0) AS DOUBLE) FROM pairs WHERE area IS NOT NULL
  UNION ALL SELECT session, stimulus, pairs.run, 'any', NULL, whole.r, (ANY_EDGES) / CAST(cells AS DOUBLE), (p1 + p2) / CAST(nullif(m1 + m2, 0) AS DOUBLE), minus / CAST(nullif(m1 + m2, 0) AS DOUBLE) FROM pairs LEFT JOIN whole ON whole.run = pairs.run)
SELECT session, stimulus, run, part, area, count(*) AS modules, round(avg(r), 6) AS signal_corr, round(avg(density), 6) AS density, round(avg(plus), 6) AS positive, round(avg(minus), 6) AS negative FROM parts GROUP BY session, stimulus, run, part, area"""
module_area_data = module_areas()
region_boundary = operator("region_boundary", "SELECT session, stimulus, a.area AS src_area, b.area AS dst_area, count(*) AS edges, count(*) FILTER (WHERE weight > 0) AS positive, count(*) FILTER (WHERE weight < 0) AS negative FROM {edges} e JOIN {nodes} a ON a.node = src JOIN {nodes} b ON b.node = dst WHERE a.area <> b.area GROUP BY session, stimulus, a.area, b.area")

# Energies of a partition on a grid of resolutions: -sum over inner edges of weight, less the expected share of each sign.
_H = """r AS (SELECT SERIES(0, 20) AS step), grid AS (SELECT p.step / 10.0 AS pos, q.step / 10.0 AS neg FROM r p CROSS JOIN r q),
e AS (SELECT session, stimulus, a.run, sum(CASE WHEN weight > 0 AND a.comm = b.comm THEN weight ELSE 0 END) AS pin, sum(CASE WHEN weight < 0 AND a.comm = b.comm THEN -weight ELSE 0 END) AS nin,
  sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS pall, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS nall FROM {edges} x JOIN {comms} a ON a.node = src JOIN {comms} b ON b.node = dst AND a.run = b.run GROUP BY session, stimulus, a.run),
f AS (SELECT run, sum(size * size) / (sum(size) * sum(size)) AS share FROM (SELECT run, comm, CAST(count(*) AS DOUBLE) AS size FROM {comms} GROUP BY run, comm) z GROUP BY run),
h AS (SELECT session, stimulus, e.run, pos, neg, pall + nall AS total, -(pin - pos * pall * share) + (nin - neg * nall * share) AS h FROM e JOIN f ON e.run = f.run CROSS JOIN grid)"""
# The same for edges whose weights are dealt anew (in the order of a hash): what the real energies are held against.
_BOTH = """r AS (SELECT SERIES(0, 20) AS step), grid AS (SELECT p.step / 10.0 AS pos, q.step / 10.0 AS neg FROM r p CROSS JOIN r q),
a1 AS (SELECT session, stimulus, src, dst, row_number() OVER (PARTITION BY session, stimulus ORDER BY (src * 7919 + dst * 104729) % 1009, src, dst) AS k FROM {edges}),
b1 AS (SELECT session, stimulus, weight, row_number() OVER (PARTITION BY session, stimulus ORDER BY src, dst) AS k FROM {edges}),
drawn AS (SELECT 'real' AS kind, session, stimulus, src, dst, weight FROM {edges} UNION ALL SELECT 'drawn', a1.session, a1.stimulus, src, dst, weight FROM a1 JOIN b1 ON a1.session = b1.session AND a1.stimulus = b1.stimulus AND a1.k = b1.k),
e AS (SELECT kind, session, stimulus, a.run, sum(CASE WHEN weight > 0 AND a.comm = b.comm THEN weight ELSE 0 END) AS pin, sum(CASE WHEN weight < 0 AND a.comm = b.comm THEN -weight ELSE 0 END) AS nin,
  sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS pall, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS nall FROM drawn x JOIN {comms} a ON a.node = src JOIN {comms} b ON b.node = dst AND a.run = b.run GROUP BY kind, session, stimulus, a.run),
f AS (SELECT run, sum(size * size) / (sum(size) * sum(size)) AS share FROM (SELECT run, comm, CAST(count(*) AS DOUBLE) AS size FROM {comms} GROUP BY run, comm) z GROUP BY run),
h AS (SELECT kind, session, stimulus, e.run, pos, neg, pall + nall AS total, -(pin - pos * pall * share) + (nin - neg * nall * share) AS h FROM e JOIN f ON e.run = f.run CROSS JOIN grid),
d AS (SELECT session, stimulus, pos, neg, avg(CASE WHEN kind = 'drawn' THEN h END) - avg(CASE WHEN kind = 'real' THEN h END) AS gap FROM h GROUP BY session, stimulus, pos, neg),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, stimulus ORDER BY round(gap, 6) DESC, pos, neg) AS rk FROM d) w WHERE rk = 1)"""
resolution_choice = operator("resolution_choice", f"WITH {_BOTH} SELECT session, stimulus, round(pos, 1) AS pos, round(neg, 1) AS neg, round(gap, 5) AS gap FROM best")
modularity_score = operator("modularity_score", f"WITH {_H} SELECT session, stimulus, run, round(-h / total, 6) AS modularity FROM h WHERE pos = 1.0 AND neg = 1.0")
modularity_z = operator("modularity_z", f"""WITH {_BOTH}, {COMBINED},
q AS (SELECT h.session, h.stimulus, kind, count(*) AS n, avg(-h / total) AS m, var_samp(-h / total) AS v FROM h JOIN best ON best.session = h.session AND best.stimulus = h.stimulus AND best.pos = h.pos AND best.neg = h.neg GROUP BY h.session, h.stimulus, kind),
z AS (SELECT x.session, x.stimulus, x.m - y.m AS gap, (x.m - y.m) / nullif(sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2.0) * (1.0 / x.n + 1.0 / y.n)), 0) AS z FROM q x JOIN q y ON x.session = y.session AND x.stimulus = y.stimulus AND x.kind = 'real' AND y.kind = 'drawn')
SELECT combined, count(*) AS graphs, round(avg(gap), 6) AS gap, round(avg(z), 4) AS z FROM z JOIN comb ON comb.stimulus = z.stimulus GROUP BY combined""")
