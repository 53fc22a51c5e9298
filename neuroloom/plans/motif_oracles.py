"""DuckDB SQL for motifs, modules and summaries, written apart from the operators: permutations of triples, lists of areas, grids of pairs."""

from __future__ import annotations

import re
from itertools import permutations

from ..operators.triad_table import EDGE_ORDER, ROLES, vocabulary

_SLOT = {(0, 1): 1, (1, 0): 2, (0, 2): 3, (2, 0): 4, (1, 2): 5, (2, 1): 6}


def _ways() -> str:
    """Every way to lay a type on a triple: the arcs' slots in the order of the signs, and the places of its roles."""
    rows = [
        (kind, [_SLOT[p[a], p[b]] for a, b in order], [p[r] + 1 for r in ROLES[kind][0]], ROLES[kind][1])
        for kind, order in EDGE_ORDER.items()
        for p in permutations(range(3))
    ]
    return "(VALUES " + ", ".join(f"('{k}', {s}, {r}, '{o}')" for k, s, r, o in rows) + ") AS ways(kind, slots, roles, sorts)"


_VOCABULARY = "(VALUES " + ", ".join(f"('{v}')" for v in vocabulary()) + ") AS vocabulary(smt)"
_COMBINED = "(SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS stimulus, unnest(['fast', 'fast', 'plain', 'slow', 'slow']) AS combined)"

_GRAPHS = "graphs AS (SELECT session, stimulus FROM edges GROUP BY ALL)"
# All triples of nodes, the six weights in the order of the slots, and every type that lies on them.
_NAMED = f"""{_GRAPHS},
weights AS MATERIALIZED (SELECT g.session, g.stimulus, x.node AS a, y.node AS b, e.weight FROM graphs g CROSS JOIN nodes x CROSS JOIN nodes y
  LEFT JOIN edges e ON (e.session, e.stimulus, e.src, e.dst) = (g.session, g.stimulus, x.node, y.node) WHERE x.node <> y.node),
joined AS MATERIALIZED (SELECT p.session, p.stimulus, p.a, p.b, [p.weight, q.weight] AS two FROM weights p JOIN weights q ON (q.session, q.stimulus, q.a, q.b) = (p.session, p.stimulus, p.b, p.a) WHERE p.a < p.b),
triples AS MATERIALIZED (SELECT x.session, x.stimulus, x.a AS v, x.b AS u, y.b AS w, x.two || y.two || z.two AS six FROM joined x
  JOIN joined y ON (y.session, y.stimulus, y.a) = (x.session, x.stimulus, x.a) AND y.b > x.b JOIN joined z ON (z.session, z.stimulus, z.a, z.b) = (x.session, x.stimulus, x.b, y.b)),
laid AS MATERIALIZED (SELECT session, stimulus, v, u, w, kind, roles, sorts, array_to_string([if(six[s] > 0, '+', '-') FOR s IN slots], '') AS signs,
    list_filter([abs(x) FOR x IN six], lambda x: x IS NOT NULL) AS sizes
  FROM triples JOIN {_ways()} ON list_sort(slots) = list_filter(range(1, 7), lambda i: six[i] IS NOT NULL)),
named AS MATERIALIZED (SELECT session, stimulus, v, u, w, any_value(kind) || min(signs) AS smt, any_value(list_product(sizes) ** (1.0e0 / len(sizes))) AS intensity, any_value(list_avg(sizes)) AS mean FROM laid GROUP BY session, stimulus, v, u, w)"""
_CENSUS = f"""{_NAMED},
census AS MATERIALIZED (SELECT g.session, g.stimulus, smt, count(n.v) AS n, coalesce(sum(n.intensity), 0) AS intensity, coalesce(sum(n.intensity / n.mean), 0) AS coherence
  FROM graphs g CROSS JOIN {_VOCABULARY} LEFT JOIN named n USING (session, stimulus, smt) GROUP BY ALL)"""
# The baseline of a graph is the list of the other sessions' values.
_OTHERS = f"""{_CENSUS},
lists AS (SELECT stimulus, smt, list(intensity ORDER BY session) AS all_of, list(session ORDER BY session) AS sessions FROM census GROUP BY ALL),
base AS (SELECT c.session, c.stimulus, c.smt, c.intensity, list_filter(all_of, lambda x, i: sessions[i] <> c.session) AS rest FROM census c JOIN lists USING (stimulus, smt)),
z AS (SELECT session, stimulus, smt, intensity, list_avg(rest) AS mean, if(list_max(rest) = 0, list_stddev_pop(list_append(list_resize([0.0e0], len(rest) - 1, 0.0e0), 4.0e0)), list_stddev_samp(rest)) AS dev FROM base),
zs AS (SELECT *, (intensity - mean) / dev AS z FROM z WHERE dev > 0.000001)"""
_REGION = f"""{_NAMED},
area_of AS (SELECT map_from_entries(list((node, area))) AS m FROM nodes),
roled AS (SELECT l.session, l.stimulus, l.v, l.u, l.w, sorts, [[m[v], m[u], m[w]][r] FOR r IN roles] AS r FROM laid l, area_of),
region AS MATERIALIZED (SELECT session, stimulus, v, u, w, min(array_to_string(CASE sorts WHEN 'xo' THEN [r[1]] || list_sort(r[2:3]) WHEN 'px' THEN list_sort(r[1:2]) || [r[3]] WHEN 'all' THEN list_sort(r)
    WHEN 'turn' THEN list_min([r, [r[2], r[3], r[1]], [r[3], r[1], r[2]]]) ELSE r END, '_')) AS region FROM roled GROUP BY ALL),
regions AS MATERIALIZED (SELECT session, stimulus, v, u, w, smt, region FROM named JOIN region USING (session, stimulus, v, u, w))"""
_IDS = f"{_NAMED}, ids AS (SELECT session, combined, smt, v, u, w FROM named JOIN {_COMBINED} USING (stimulus) GROUP BY ALL)"

# Modules as lists of their nodes' areas.
_MODULES = """sized AS (SELECT map_from_entries(list((area, n))) AS total FROM (SELECT area, count(*) AS n FROM nodes GROUP BY area)),
listed AS (SELECT run, comm, list(area) AS areas FROM comms JOIN nodes USING (node) GROUP BY ALL),
shares AS (SELECT run, comm, len(areas) AS size, [len(list_filter(areas, lambda x: x = a)) FOR a IN list_sort(list_distinct(areas))] AS counts, list_sort(list_distinct(areas)) AS kinds FROM listed),
modules AS MATERIALIZED (SELECT run, comm, size, kinds[list_position(counts, list_max(counts))] AS area, list_max(counts) / size::DOUBLE AS purity,
  list_max([counts[i] / total[kinds[i]]::DOUBLE FOR i IN range(1, len(kinds) + 1)]) AS coverage FROM shares, sized WHERE size > 3)"""
_LINKED = f"""{_MODULES}, side AS (SELECT run, map_from_entries(list((node, comm))) AS m FROM comms GROUP BY run),
inner_edges AS (SELECT session, stimulus, run, m[src] AS comm FROM edges, side WHERE m[src] = m[dst] GROUP BY ALL),
linked AS (SELECT * FROM modules JOIN inner_edges USING (run, comm))"""
_SIDES = "side AS (SELECT run, map_from_entries(list((node, comm))) AS m FROM comms GROUP BY run)"

# Energies as sums over all ordered pairs of nodes of one module; 'drawn' graphs have the weights in another order.
_KINDS = """turned AS (SELECT session, stimulus, list((src, dst) ORDER BY (src * 7919 + dst * 104729) % 1009, src, dst) AS way, list(weight ORDER BY src, dst) AS ws FROM edges GROUP BY ALL),
kinds AS MATERIALIZED (SELECT 'real' AS kind, session, stimulus, src, dst, weight FROM edges UNION ALL SELECT 'drawn', session, stimulus, p[1], p[2], w FROM (SELECT session, stimulus, unnest(way) AS p, unnest(ws) AS w FROM turned))"""
_ENERGY = f"""{_KINDS}, {_SIDES},
steps AS (SELECT p / 10 AS pos, q / 10 AS neg FROM range(0, 21) a(p), range(0, 21) b(q)),
pairs AS (SELECT a.run, count(*) AS inner_pairs FROM comms a JOIN comms b USING (run, comm) GROUP BY run),
squared AS (SELECT count(*) * count(*) AS cells FROM nodes),
h AS MATERIALIZED (SELECT kind, session, stimulus, run, pos, neg, sum(abs(weight)) AS total,
    -sum(if(m[src] = m[dst], weight, 0)) + any_value(inner_pairs / cells) * (pos * sum(greatest(weight, 0)) - neg * sum(greatest(-weight, 0))) AS h
  FROM kinds, side JOIN pairs USING (run), squared, steps GROUP BY kind, session, stimulus, run, pos, neg),
cell AS (SELECT session, stimulus, pos, neg, (avg(h) FILTER (WHERE kind = 'drawn') - avg(h) FILTER (WHERE kind = 'real')) AS gap FROM h GROUP BY ALL),
best AS (SELECT session, stimulus, list((-round(gap, 6), pos, neg, gap) ORDER BY -round(gap, 6), pos, neg)[1] AS b FROM cell GROUP BY ALL)"""

# Every graph with its weights in 97 other orders (a mean of as many has no tie at six digits), as graphs of their own named rep:stimulus, and Z against them.
_DEALT = """orders AS (SELECT session, stimulus, rep, list((src, dst) ORDER BY (src * 7919 + dst * 104729 + (rep + 1) * (src * 613 + dst * 389 + 1)) % 10007 * (rep + 37) % 9973, src, dst) AS way FROM edges, range(0, 97) t(rep) GROUP BY ALL),
given AS (SELECT session, stimulus, list(weight ORDER BY src, dst) AS ws FROM edges GROUP BY ALL),
dealt AS MATERIALIZED (SELECT session, stimulus, rep, p[1] AS src, p[2] AS dst, weight FROM (SELECT session, stimulus, rep, unnest(way) AS p, unnest(ws) AS weight FROM orders JOIN given USING (session, stimulus)))"""
_NULLS = f"""{_DEALT}, replicas AS (SELECT session, rep || ':' || stimulus AS stimulus, src, dst, weight FROM dealt),
{re.sub(r"(graphs|weights|joined|triples|laid|named|census)(?= |,|$)", r"replica_\1", _CENSUS.replace("FROM edges", "FROM replicas").replace("JOIN edges", "JOIN replicas"))},
{_CENSUS},
told AS MATERIALIZED (SELECT session, stimulus, smt, n, round(intensity, 6) AS intensity FROM census),
lists AS MATERIALIZED (SELECT session, split_part(stimulus, ':', 2) AS stimulus, smt, list(round(intensity, 6)) AS xs, sum(n) AS seen FROM replica_census GROUP BY ALL),
moments AS (SELECT c.session, c.stimulus, c.smt, c.n, c.intensity, list_avg(xs) AS mean, if(list_max(xs) = 0, list_stddev_pop(list_append(list_resize([0.0e0], len(xs) - 1, 0.0e0), 4.0e0)), list_stddev_samp(xs)) AS dev FROM told c JOIN lists USING (session, stimulus, smt)),
zs AS MATERIALIZED (SELECT *, if(dev > 0.000001, (intensity - mean) / dev, NULL) AS z FROM moments)"""
# Whole lists of each type's intensities and coherences over the replicas, a type that none has being one 5 among zeros and all zeros.
_BASELINES = f"""{_NULLS}, known AS (SELECT list(DISTINCT smt) AS ks FROM (SELECT smt FROM lists WHERE seen > 0 UNION ALL SELECT smt FROM census WHERE n > 0)),
cl AS (SELECT session, split_part(stimulus, ':', 2) AS stimulus, smt, list(round(coherence, 6)) AS cs FROM replica_census GROUP BY ALL),
bl AS (SELECT session, stimulus, smt, round(c.intensity, 6) AS x, round(c.coherence, 6) AS y, if(list_max(xs) = 0, list_append(list_resize([0.0e0], len(xs) - 1, 0.0e0), 5.0e0), xs) AS xs, cs
  FROM census c JOIN lists USING (session, stimulus, smt) JOIN cl USING (session, stimulus, smt), known WHERE list_contains(ks, smt)),
ms AS (SELECT *, list_avg(xs) AS xm, list_stddev_pop(xs) AS xd, list_avg(cs) AS ym, list_stddev_pop(cs) AS yd, if(xd > 0.000001, (x - xm) / xd, NULL) AS xz, if(yd > 0.000001, (y - ym) / yd, NULL) AS yz FROM bl)"""
_GIVEN = "['030T+++', '120D++++', '120U++++', '120C++++', '210+++++', '300++++++']"

_SPLIT = "SELECT session, list(confidence) FILTER (WHERE weight > 0) AS x, list(confidence) FILTER (WHERE weight < 0) AS y FROM edges GROUP BY session"
_T = "(list_avg(x) - list_avg(y)) / sqrt(((len(x) - 1) * list_var_samp(x) + (len(y) - 1) * list_var_samp(y)) / (len(x) + len(y) - 2) * (1 / len(x) + 1 / len(y)))"

TEXTS = {
    "stored_graphs": "o AS (SELECT 1) SELECT session, stimulus, src, dst, weight, confidence, edge_offset, duration FROM edges",
    "stored_areas": "on_edges AS (SELECT session, list(src) || list(dst) AS touched FROM edges GROUP BY session) SELECT session, node, area::VARCHAR AS area, list_contains(touched, node) AS is_active FROM on_edges, nodes",
    "spike_times": "l AS (SELECT neuron_id, trial_id, list_sort(list(t)) AS ts FROM spikes GROUP BY ALL) SELECT neuron_id, trial_id, len(ts) AS spikes, ts[1] AS first, ts[-1] AS last, list_max([ts[i + 1] - ts[i] FOR i IN range(1, len(ts))]) AS longest_gap FROM l",
    "graph_edges": "o AS (SELECT 1) SELECT session, stimulus, src, dst, weight, confidence FROM edges WHERE weight > 0 UNION ALL SELECT session, stimulus, src, dst, weight, confidence FROM edges WHERE weight < 0",
    "binary_edges": "l AS (SELECT session, stimulus, list((src, dst)) AS es FROM edges WHERE weight > 0 OR weight < 0 GROUP BY ALL), u AS (SELECT session, stimulus, unnest(es) AS e FROM l) SELECT session, stimulus, e[1] AS src, e[2] AS dst, 1 AS weight FROM u",
    "edge_delay": "l AS (SELECT *, [edge_offset, duration] AS parts FROM edges) SELECT session, stimulus, src, dst, edge_offset, duration, list_sum(parts)::BIGINT AS delay FROM l",
    "session_stimulus": """k AS (SELECT ['3-MEDIUM', '1-URGENT', '2-HIGH', '5-LOW', '4-NOT SPECIFIED'] AS k), sure AS (SELECT bool_and(list_contains(k, stimulus)) AS sure FROM edges, k),
l AS (SELECT session, list_sort(list(DISTINCT [if(sure, list_position(k, stimulus), 0)::VARCHAR, stimulus])) AS ss FROM edges, sure, k WHERE stimulus <> '4-NOT SPECIFIED' GROUP BY session)
SELECT session, unnest([s[2] FOR s IN ss]) AS stimulus, unnest(range(1, len(ss) + 1)) AS place FROM l""",
    "combined_stimulus": f"m AS (SELECT map_from_entries(list((stimulus, combined))) AS m FROM {_COMBINED}) SELECT session, m[stimulus] AS combined, list_position(['fast', 'plain', 'slow'], m[stimulus])::BIGINT - 1 AS place, count(*) AS edges FROM edges, m WHERE m[stimulus] IS NOT NULL GROUP BY ALL",
    "percentile_limits": f"""l AS (SELECT session, stimulus, coalesce(list_sort(list(weight) FILTER (WHERE weight < 0)), []) AS a, coalesce(list_sort(list(weight) FILTER (WHERE weight > 0)), []) AS b FROM edges GROUP BY ALL)
SELECT session, stimulus, {", ".join(f"round({x}[floor((len({x}) - 1) * {p})::BIGINT + 1] + ((len({x}) - 1) * {p}e0 - floor((len({x}) - 1) * {p}e0)) * (coalesce({x}[floor((len({x}) - 1) * {p})::BIGINT + 2], 0) - {x}[floor((len({x}) - 1) * {p})::BIGINT + 1]), 6) AS {n}" for n, x, p in (("low_wide", "a", 0.2), ("high_wide", "b", 0.85), ("low_narrow", "a", 0.005), ("high_narrow", "b", 0.992), ("low_usual", "a", 0.02), ("high_usual", "b", 0.98)))} FROM l""",
    "density_regression": """m AS (SELECT map_from_entries(list((node, area))) AS m, count(*) AS n FROM nodes),
d AS (SELECT session, stimulus, count(*) / any_value(n * (n - 1)) AS x, sum(if(m[src] = m[dst], 1, 0)) / count(*) AS y FROM edges, m GROUP BY session, stimulus),
l AS (SELECT session, list(x ORDER BY stimulus) AS x, list([ln(x) / ln(10)] ORDER BY stimulus) AS g, list(y ORDER BY stimulus) AS y FROM d GROUP BY session),
c AS (SELECT session, len(x) AS n, list_avg(x) AS mx, list_avg(y) AS my, list_avg(flatten(g)) AS mg, x, y, flatten(g) AS g FROM l),
s AS (SELECT session, n, mx, my, list_sum([(x[i] - mx) * (y[i] - my) FOR i IN range(1, n + 1)]) AS xy, list_sum([(v - mx) ** 2 FOR v IN x]) AS xx, list_sum([(v - my) ** 2 FOR v IN y]) AS yy,
  list_sum([(g[i] - mg) * (y[i] - my) FOR i IN range(1, n + 1)]) AS gy, list_sum([(v - mg) ** 2 FOR v IN g]) AS gg FROM c)
SELECT session, n, round(xy / xx, 6) AS slope, round(my - xy / xx * mx, 6) AS intercept, round(xy / sqrt(xx * yy), 6) AS r, round(gy / gg, 6) AS log_slope FROM s""",
    "edge_sign": "o AS (SELECT 1) SELECT session, stimulus, src, dst, CASE WHEN weight > 0 THEN 1 WHEN weight < 0 THEN -1 ELSE 0 END::BIGINT AS edge_sign FROM edges",
    "log2_signed": "o AS (SELECT 1) SELECT session, stimulus, src, dst, round(ln(weight * weight) / (2 * ln(2)) * if(weight < 0, -1, 1), 6) AS value FROM edges WHERE weight <> 0",
    "scale_interval": "l AS (SELECT session, stimulus, list(abs(weight)) AS ws FROM edges GROUP BY ALL) SELECT session, stimulus, src, dst, round(coalesce(1 + 4 * (abs(weight) - list_min(ws)) / nullif(list_max(ws) - list_min(ws), 0), 1), 6) AS width FROM edges JOIN l USING (session, stimulus)",
    "scale_interval_log": "l AS (SELECT session, stimulus, list(2 ** abs(weight)) AS ws FROM edges GROUP BY ALL) SELECT session, stimulus, src, dst, round(coalesce((2 ** abs(weight) - list_min(ws)) / nullif(list_max(ws) - list_min(ws), 0), 0), 6) AS width FROM edges JOIN l USING (session, stimulus)",
    "ex_in_density": "n AS (SELECT len(list(node)) AS n FROM nodes) SELECT session, stimulus, len(list_filter(list(weight), lambda x: x > 0)) AS excitatory, len(list_filter(list(weight), lambda x: x < 0)) AS inhibitory, round(len(list_filter(list(weight), lambda x: x > 0)) / any_value(n * (n - 1)), 6) AS ex_density, round(len(list_filter(list(weight), lambda x: x < 0)) / any_value(n * (n - 1)), 6) AS in_density FROM edges, n GROUP BY session, stimulus",
    "ex_fraction": "o AS (SELECT 1) SELECT session, stimulus, round((1 + avg(sign(weight))) / 2, 6) AS excitatory, round((1 - avg(sign(weight))) / 2, 6) AS inhibitory FROM edges WHERE weight <> 0 GROUP BY ALL",
    "region_matrix": "m AS (SELECT map_from_entries(list((node, area))) AS m FROM nodes) SELECT session, stimulus, m[src] AS src_area, m[dst] AS dst_area, count(*) AS edges, sum(if(weight > 0, 1, 0))::BIGINT AS excitatory FROM edges, m GROUP BY ALL",
    "intra_inter": "m AS (SELECT map_from_entries(list((node, area))) AS m FROM nodes), s AS (SELECT session, stimulus, list_count(list_filter(list(m[src] = m[dst]), lambda x: x)) AS same, count(*) AS n FROM edges, m GROUP BY ALL) SELECT session, stimulus, round(same / n, 6) AS intra, round(1 - same / n, 6) AS inter FROM s",
    "assortativity": """d AS (SELECT session, stimulus, src, dst, [(SELECT count(*) FROM edges f WHERE (f.session, f.stimulus, f.src) = (e.session, e.stimulus, e.src)), (SELECT count(*) FROM edges f WHERE (f.session, f.stimulus, f.dst) = (e.session, e.stimulus, e.src))] AS s,
  [(SELECT count(*) FROM edges f WHERE (f.session, f.stimulus, f.src) = (e.session, e.stimulus, e.dst)), (SELECT count(*) FROM edges f WHERE (f.session, f.stimulus, f.dst) = (e.session, e.stimulus, e.dst))] AS t FROM edges e)
SELECT session, stimulus, round(corr(s[1], t[2]), 6) AS out_in, round(corr(s[2], t[1]), 6) AS in_out, round(corr(s[2], t[2]), 6) AS in_in, round(corr(s[1], t[1]), 6) AS out_out FROM d GROUP BY ALL""",
    "two_step": "l AS (SELECT session, stimulus, src, list(dst) AS mids FROM edges GROUP BY ALL), x AS (SELECT session, stimulus, src, unnest(mids) AS mid FROM l), y AS (SELECT x.session, x.stimulus, x.src, unnest(l.mids) AS dst FROM x JOIN l ON (l.session, l.stimulus, l.src) = (x.session, x.stimulus, x.mid)) SELECT session, stimulus, src, dst, count(*) AS paths FROM y WHERE src <> dst GROUP BY ALL",
    "mean_error": "l AS (SELECT session, stimulus, list(weight) AS ws FROM edges GROUP BY ALL) SELECT session, stimulus, len(ws) AS n, round(list_sum(ws) / len(ws), 6) AS mean, round(sqrt(list_sum([(x - list_avg(ws)) ** 2 FOR x IN ws]) / (len(ws) - 1) / len(ws)), 6) AS sem FROM l",
    "t_test": f"s AS ({_SPLIT}) SELECT session, coalesce(len(x), 0) + coalesce(len(y), 0) - 2 AS df, round({_T}, 5) AS t FROM s",
    "z_test": f"s AS ({_SPLIT}) SELECT session, round({_T}, 5) AS z, round(list_avg(x) - list_avg(y), 6) AS difference FROM s",
    "weight_shuffle": f"{_KINDS} SELECT session, stimulus, src, dst, weight FROM kinds WHERE kind = 'drawn'",
    "median_interval": """l AS (SELECT session, stimulus, list_sort(list(weight)) AS ws, count(*) AS n FROM edges GROUP BY ALL),
r AS (SELECT session, stimulus, ws, n, unnest(ws) AS x FROM l), s AS (SELECT *, len(list_filter(ws, lambda v: v <= x)) / n AS p FROM r),
t AS (SELECT session, stimulus, n, x, [if(p = 1, 1, list_sum([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) FOR k IN range(m::BIGINT, n + 1)])) FOR m IN [(n + 1) // 2, n // 2 + 1]] AS tails FROM s),
b AS (SELECT session, stimulus, n, [[min(x) FILTER (WHERE tails[1] >= 0.025), min(x) FILTER (WHERE tails[2] >= 0.025)], [min(x) FILTER (WHERE tails[1] >= 0.975), min(x) FILTER (WHERE tails[2] >= 0.975)]] AS b FROM t GROUP BY ALL)
SELECT session, stimulus, n, round((SELECT median(weight) FROM edges e WHERE (e.session, e.stimulus) = (b.session, b.stimulus)), 6) AS median, round(list_avg(b[1]), 6) AS low, round(list_avg(b[2]), 6) AS high FROM b""",
    "motif_sign": f"{_NAMED} SELECT session, stimulus, v, u, w, smt FROM named",
    "motif_census": f"{_CENSUS} SELECT session, stimulus, smt, n, round(intensity, 6) AS intensity, round(coherence, 6) AS coherence FROM census",
    "motif_ids": f"{_IDS} SELECT * FROM ids",
    "motif_upset": f"{_IDS}, sets AS (SELECT session, smt, v, u, w, array_to_string(list_filter(['fast', 'plain', 'slow'], lambda c: list_contains(list(combined), c)), ',') AS stimuli FROM ids GROUP BY ALL) SELECT smt, stimuli, count(*) AS triples FROM sets GROUP BY ALL HAVING count(*) > 1",
    "motif_region": f"{_REGION} SELECT * FROM regions",
    "motif_region_census": f"{_REGION} SELECT session, stimulus, smt, region, len(list(v)) AS n FROM regions GROUP BY session, stimulus, smt, region",
    "motif_region_fraction": f"""{_REGION},
f AS (SELECT session, stimulus, smt, list([m[v], m[u], m[w]]) AS areas FROM regions, area_of GROUP BY ALL),
s AS (SELECT stimulus, smt, list_avg([if(len(list_distinct(a)) = 1, 1, 0) FOR a IN areas]) AS same, list_avg([if(list_contains(a, 0), 1, 0) FOR a IN areas]) AS touch FROM f WHERE len(areas) > 4)
SELECT stimulus, smt, count(*) AS sessions, round(avg(same), 6) AS same_mean, round(stddev_samp(same), 6) AS same_std, round(avg(touch), 6) AS touch_mean FROM s GROUP BY ALL""",
    "motif_zscore": f"{_OTHERS} SELECT session, stimulus, smt, round(intensity, 6) AS intensity, round(mean, 6) AS mean, round(dev, 6) AS deviation, round(z, 5) AS z FROM zs",
    "z_density": f"{_OTHERS} SELECT session, stimulus, (SELECT count(*) FROM edges e WHERE (e.session, e.stimulus) = (zs.session, zs.stimulus)) AS edges, round(avg(abs(z)), 5) AS mean_abs_z FROM zs GROUP BY session, stimulus",
    "mean_z": f"{_OTHERS} SELECT stimulus, smt, round(sum(z) / count(*), 5) AS mean_z FROM zs GROUP BY ALL",
    "z_corr_matrix": f"""{_OTHERS}, m AS (SELECT stimulus, map_from_entries(list((smt, z))) AS zs FROM (SELECT stimulus, smt, avg(z) AS z FROM zs GROUP BY ALL) GROUP BY stimulus),
p AS (SELECT x.stimulus AS first, y.stimulus AS second, unnest(map_keys(x.zs)) AS smt, x.zs AS a, y.zs AS b FROM m x JOIN m y ON x.stimulus <> y.stimulus)
SELECT first, second, count(*) AS types, round(corr(a[smt], b[smt]), 5) AS r FROM p WHERE b[smt] IS NOT NULL GROUP BY first, second""",
    "motif_zscore_stored": f"""{_CENSUS}, l AS (SELECT stimulus, smt, list(intensity) AS xs FROM census GROUP BY ALL),
b AS (SELECT stimulus, smt, xs, if(list_max(xs) = 0, list_append(list_resize([0.0e0], len(xs) - 1, 0.0e0), 5.0e0), xs) AS base FROM l),
z AS (SELECT stimulus, smt, unnest([(x - list_avg(base)) / nullif(list_stddev_pop(base), 0) FOR x IN xs]) AS z FROM b)
SELECT stimulus, smt, count(z) AS sessions, round(avg(z), 5) + 0e0 AS mean_z, round(stddev_samp(z), 5) AS std_z FROM z GROUP BY ALL""",
    "signal_corr_motif": f"""{_NAMED}, plus AS (SELECT session, stimulus, unnest([[v, u], [v, w], [u, w]]) AS p FROM named WHERE NOT contains(smt, '-')),
held AS (SELECT session, stimulus, list(DISTINCT p) AS ps FROM plus GROUP BY ALL)
SELECT g.session, g.stimulus, if(coalesce(list_contains(ps, [i, j]), false), 'motif', 'rest') AS part, count(*) AS pairs, round(avg(r), 6) AS mean_r FROM graphs g LEFT JOIN held USING (session, stimulus) CROSS JOIN scorr GROUP BY ALL""",
    "signal_corr_pairs": f"""{_GRAPHS}, ij AS (SELECT session, stimulus, i, j, r, (SELECT any_value(weight) FROM edges e WHERE (e.session, e.stimulus, e.src, e.dst) = (g.session, g.stimulus, i, j)) AS f, (SELECT any_value(weight) FROM edges e WHERE (e.session, e.stimulus, e.src, e.dst) = (g.session, g.stimulus, j, i)) AS b FROM graphs g, scorr WHERE r IS NOT NULL)
SELECT session, stimulus, i AS src, j AS dst, r, if(f > 0, 1, 0) AS positive, if(f < 0, 1, 0) AS negative FROM ij WHERE f IS NOT NULL OR b IS NULL UNION ALL SELECT session, stimulus, j, i, r, if(b > 0, 1, 0), if(b < 0, 1, 0) FROM ij WHERE b IS NOT NULL""",
    "signal_corr_comm": f"{_SIDES} SELECT run, if(m[i] = m[j], 'within', 'across') AS part, count(*) AS pairs, round(avg(r), 6) AS mean_r, round(stddev_samp(r), 6) AS std_r FROM scorr, side GROUP BY ALL",
    "signal_corr_comm_connected": f"""{_SIDES} SELECT session, combined, if(m[i] = m[j], 'within', 'across') AS part, count(*) AS pairs, round(avg(r), 6) AS mean_r
FROM scorr, side, (SELECT session, stimulus, list((src, dst)) AS es FROM edges GROUP BY ALL) g JOIN {_COMBINED} USING (stimulus) WHERE r IS NOT NULL AND (list_contains(es, (i, j)) OR list_contains(es, (j, i))) GROUP BY ALL""",
    "between_comm_edges": f"{_SIDES} SELECT session, stimulus, run, list_sort([m[src], m[dst]])[1] AS low, list_sort([m[src], m[dst]])[2] AS high, count(*) AS edges FROM edges, side WHERE m[src] <> m[dst] GROUP BY ALL",
    "area_boundary": f"{_SIDES} SELECT session, stimulus, run, m[src] AS src_comm, m[dst] AS dst_comm, count(*) AS edges, sum(if(weight > 0, 1, 0))::BIGINT AS positive, sum(if(weight < 0, 1, 0))::BIGINT AS negative FROM edges, side GROUP BY ALL",
    "region_boundary": "m AS (SELECT map_from_entries(list((node, area))) AS m FROM nodes), x AS (SELECT session, stimulus, m[src] AS src_area, m[dst] AS dst_area, list(weight) AS ws FROM edges, m GROUP BY ALL) SELECT session, stimulus, src_area, dst_area, len(ws) AS edges, len(list_filter(ws, lambda w: w > 0)) AS positive, len(list_filter(ws, lambda w: w < 0)) AS negative FROM x WHERE src_area <> dst_area",
    "module_area_data": f"""{_MODULES}, {_SIDES}, {_GRAPHS},
links AS (SELECT session, stimulus, run, list_sort([m[src], m[dst]]) AS p, list(weight) AS ws FROM edges, side GROUP BY ALL),
corrs AS (SELECT run, list_sort([m[i], m[j]]) AS p, list(r) AS rs FROM scorr, side WHERE r IS NOT NULL GROUP BY ALL),
apart AS (SELECT run, avg(r) AS r FROM scorr, side WHERE r IS NOT NULL AND m[i] <> m[j] GROUP BY run),
two AS (SELECT g.session, g.stimulus, x.run, x.comm = y.comm AS own, x.area = y.area AS alike, x.area, if(x.comm = y.comm, x.size * (x.size - 1), x.size * y.size) AS cells, coalesce(ws, []) AS ws, list_avg(rs) AS r
  FROM graphs g CROSS JOIN modules x JOIN modules y ON y.run = x.run AND x.comm <= y.comm LEFT JOIN links l ON (l.session, l.stimulus, l.run, l.p) = (g.session, g.stimulus, x.run, [x.comm, y.comm]) LEFT JOIN corrs c ON (c.run, c.p) = (x.run, [x.comm, y.comm])),
parts AS (SELECT session, stimulus, run, if(own, 'within', 'between') AS part, area, r, cells, ws FROM two WHERE alike UNION ALL SELECT session, stimulus, two.run, 'any', NULL, apart.r, cells, ws FROM two LEFT JOIN apart USING (run) WHERE NOT own)
SELECT session, stimulus, run, part, area, count(*) AS modules, round(avg(r), 6) AS signal_corr, round(avg(len(ws) / cells), 6) AS density, round(avg(len(list_filter(ws, lambda w: w > 0)) / nullif(len(ws), 0)), 6) AS positive,
  round(avg(len(list_filter(ws, lambda w: w < 0)) / nullif(len(ws), 0)), 6) AS negative FROM parts GROUP BY ALL""",
    "comm_select": f"{_SIDES}, out_of AS (SELECT run, list(DISTINCT m[src]) AS cs FROM edges, side WHERE m[src] <> m[dst] GROUP BY run) SELECT run, comm, count(*) AS size FROM comms JOIN out_of USING (run) WHERE list_contains(cs, comm) GROUP BY run, comm HAVING count(*) > 5",
    "module_purity": f"{_LINKED} SELECT session, stimulus, run, comm, round(size / (SELECT count(*) FROM nodes), 6) AS relative_size, round(purity, 6) AS purity, round(coverage, 6) AS coverage FROM linked",
    "purity_coverage": f"{_MODULES} SELECT run, sum(size)::BIGINT AS nodes, round(list_sum(list(size * purity)) / sum(size), 6) AS purity, round(list_sum(list(size * coverage)) / sum(size), 6) AS coverage FROM modules GROUP BY run",
    "purity_cumulative": f"{_MODULES} SELECT a.run, round(sum(b.size * b.purity) / sum(b.size), 6) AS purity, round(sum(b.size * b.coverage) / sum(b.size), 6) AS coverage FROM (SELECT DISTINCT run FROM modules) a JOIN modules b ON b.run <= a.run GROUP BY a.run",
    "module_by_area": f"{_MODULES} SELECT run, area, count(*) AS modules, round(avg(size), 6) AS size, round(avg(purity), 6) AS purity, round(avg(coverage), 6) AS coverage FROM modules GROUP BY run, area",
    "threshold_curve": f"""{_LINKED}, c AS (SELECT combined, list(purity) AS ps, list(coverage) AS cs FROM linked JOIN {_COMBINED} USING (stimulus) GROUP BY combined),
g AS (SELECT combined, count(DISTINCT (session, stimulus)) * (SELECT count(DISTINCT run) FROM comms) AS n FROM edges JOIN {_COMBINED} USING (stimulus) GROUP BY combined)
SELECT combined, step::BIGINT AS step, round(len(list_filter(ps, lambda x: x >= step / 10)) / n, 6) AS purity, round(len(list_filter(cs, lambda x: x >= step / 10)) / n, 6) AS coverage FROM c JOIN g USING (combined), range(0, 11) t(step)""",
    "dealt_weights": f"{_DEALT} SELECT session, stimulus, rep::INT AS rep, src, dst, weight FROM dealt",
    "dealt_zscore": f"{_NULLS} SELECT session, stimulus, smt, round(intensity, 6) AS intensity, round(mean, 6) AS mean, round(dev, 6) AS deviation, round(z, 5) + 0e0 AS z FROM zs",
    "dealt_zscore_stored": f"""{_NULLS}, known AS (SELECT list(DISTINCT smt) AS ks FROM (SELECT smt FROM lists WHERE seen > 0 UNION ALL SELECT smt FROM census WHERE n > 0)),
b AS (SELECT c.stimulus, c.smt, c.intensity, if(list_max(xs) = 0, list_append(list_resize([0.0e0], len(xs) - 1, 0.0e0), 5.0e0), xs) AS base FROM told c JOIN lists USING (session, stimulus, smt), known WHERE list_contains(ks, c.smt)),
q AS (SELECT stimulus, smt, (intensity - list_avg(base)) / nullif(list_stddev_pop(base), 0) AS z FROM b)
SELECT stimulus, smt, count(z) AS sessions, round(avg(z), 5) + 0e0 AS mean_z, round(stddev_samp(z), 5) AS std_z FROM q GROUP BY ALL""",
    "dealt_baseline_zscore": f"""{_BASELINES} SELECT 'dealt' AS model, session, stimulus, smt, x AS intensity, round(xm, 6) AS intensity_mean, round(xd, 6) AS intensity_std, round(xz, 5) + 0e0 AS intensity_z,
  y AS coherence, round(ym, 6) AS coherence_mean, round(yd, 6) AS coherence_std, round(yz, 5) + 0e0 AS coherence_z FROM ms""",
    "dealt_baseline_mean": f"""{_BASELINES} SELECT 'dealt' AS model, stimulus, smt, round(avg(x), 6) AS intensity, round(avg(xm), 6) AS intensity_mean, round(avg(xd), 6) AS intensity_std, round(avg(xz), 5) + 0e0 AS intensity_z,
  round(avg(y), 6) AS coherence, round(avg(ym), 6) AS coherence_mean, round(avg(yd), 6) AS coherence_std, round(avg(yz), 5) + 0e0 AS coherence_z, round(stddev_samp(xz), 5) AS intensity_z_std FROM ms GROUP BY stimulus, smt""",
    "dealt_z_density": f"{_NULLS} SELECT session, stimulus, count(z) AS types, round(sum(abs(z)) / count(z), 5) AS mean_abs_z FROM zs GROUP BY ALL",
    "dealt_mean_z": f"{_NULLS} SELECT combined, smt, round(list_avg(list(z) FILTER (WHERE z IS NOT NULL)), 5) + 0e0 AS mean_z FROM zs JOIN {_COMBINED} USING (stimulus) GROUP BY combined, smt",
    "dealt_z_corr": f"""{_NULLS}, m AS (SELECT combined, map_from_entries(list((smt, z))) AS zs FROM (SELECT combined, smt, avg(z) AS z FROM zs JOIN {_COMBINED} USING (stimulus) GROUP BY ALL) GROUP BY combined),
p AS (SELECT x.combined AS first, y.combined AS second, unnest(map_keys(x.zs)) AS smt, x.zs AS a, y.zs AS b FROM m x JOIN m y ON x.combined <> y.combined)
SELECT first, second, count(a[smt] + b[smt]) AS types, round(corr(a[smt], b[smt]), 5) AS r FROM p GROUP BY first, second""",
    "dealt_log2_z": f"{_NULLS} SELECT session, stimulus, smt, round(if(z = 0, NULL, ln(abs(z)) / ln(2) * if(z < 0, -1, 1)), 5) + 0e0 AS value FROM zs",
    "dealt_region_fraction": f"""{_NULLS}, area_of AS (SELECT map_from_entries(list((node, area))) AS m FROM nodes),
f AS (SELECT session, stimulus, smt, list([m[v], m[u], m[w]]) AS areas FROM named, area_of GROUP BY ALL HAVING count(*) > 4),
picked AS (SELECT combined, smt, list_avg([if(a = [0, 0, 0], 1, 0) FOR a IN areas]) AS same, list_avg([if(list_contains(a, 0), 1, 0) FOR a IN areas]) AS touch FROM f JOIN zs USING (session, stimulus, smt) JOIN {_COMBINED} USING (stimulus) WHERE z > 1.96)
SELECT c.combined, c.smt, count(same) AS graphs, round(coalesce(avg(same), 0), 6) AS same_mean, round(stddev_samp(same), 6) AS same_std, round(coalesce(avg(touch), 0), 6) AS touch_mean, round(stddev_samp(touch), 6) AS touch_std
FROM (SELECT DISTINCT combined, smt FROM {_COMBINED}, {_VOCABULARY}) c LEFT JOIN picked p ON (p.combined, p.smt) = (c.combined, c.smt) GROUP BY c.combined, c.smt""",
    "dealt_signal_corr_motif": f"""{_NULLS}, high AS (SELECT stimulus, smt FROM zs WHERE NOT list_contains({_GIVEN}, smt) GROUP BY ALL HAVING avg(z) > 2.576),
parts AS (SELECT session, stimulus, v, u, w, CASE WHEN list_contains({_GIVEN}, smt) THEN 'given' WHEN EXISTS (FROM high h WHERE h.stimulus = named.stimulus AND h.smt = named.smt) THEN 'other' END AS part FROM named),
sides AS (SELECT session, stimulus, part, unnest([[v, u], [v, w], [u, w]]) AS p FROM parts WHERE part IS NOT NULL),
held AS (SELECT session, stimulus, list(DISTINCT p) AS ps FROM sides GROUP BY ALL),
every AS (SELECT session, stimulus, part, p[1] AS i, p[2] AS j FROM sides UNION ALL SELECT g.session, g.stimulus, 'rest', i, j FROM graphs g LEFT JOIN held USING (session, stimulus), scorr WHERE NOT coalesce(list_contains(ps, [i, j]), false))
SELECT session, stimulus, part, count(*) AS pairs, round(avg(r), 6) AS mean_r FROM every JOIN scorr USING (i, j) WHERE r IS NOT NULL GROUP BY ALL""",
    "modularity_score": f"{_ENERGY} SELECT session, stimulus, run, round(-h / total, 6) + 0e0 AS modularity FROM h WHERE kind = 'real' AND pos = 1 AND neg = 1",
    "resolution_choice": f"{_ENERGY} SELECT session, stimulus, round(b[2], 1) AS pos, round(b[3], 1) AS neg, round(b[4], 5) AS gap FROM best",
    "modularity_z": f"""{_ENERGY}, q AS (SELECT session, stimulus, list(-h / total) FILTER (WHERE kind = 'real') AS x, list(-h / total) FILTER (WHERE kind = 'drawn') AS y FROM h JOIN best USING (session, stimulus) WHERE pos = b[2] AND neg = b[3] GROUP BY ALL)
SELECT combined, count(*) AS graphs, round(avg(list_avg(x) - list_avg(y)), 6) AS gap, round(avg({_T}), 4) AS z FROM q JOIN {_COMBINED} USING (stimulus) GROUP BY combined""",
}
