"""DuckDB SQL written apart from the operators' own text: lists, full grids and recursion instead of windows and joins on keys.

Each text reads the model tables named in it, made by DuckDB.
"""

from __future__ import annotations

import re

from ..operators.triad_table import table_sql
from ..sources.tables import BASE
from . import motif_oracles

_LAG, _LONG, _LEVEL = 12, 6, 2.5

# For a pair and duration: all sums in order, their mean and deviation, and places and Z of the first and second extreme.
_SUMS = f"""l AS (SELECT src, dst, list(value ORDER BY lag) AS c FROM ccg GROUP BY src, dst),
t AS (SELECT src, dst, d, [list_sum(c[k + 1:k + 1 + d]) FOR k IN range(0, len(c) - d)] AS t FROM l, (SELECT unnest(range(0, {_LONG + 1})) AS d) x),
s AS (SELECT src, dst, d, t, list_avg(t) AS mu, list_stddev_pop(t) AS sd FROM t),
o AS (SELECT *, [round(abs(x - mu), 9) FOR x IN t[1:{_LAG + 1} - d]] AS far FROM s WHERE sd > 0),
o1 AS (SELECT *, list_position(far, list_max(far)) AS p1 FROM o),
o2 AS (SELECT *, [CASE WHEN k + 1 = p1 THEN -1 ELSE far[k + 1] END FOR k IN range(0, len(far))] AS left_over FROM o1),
e AS (SELECT src, dst, d, sd, p1 - 1 AS lag1, t[p1] AS v1, (t[p1] - mu) / sd AS z1, list_position(left_over, list_max(left_over)) AS p2, t[p2] AS v2, (t[p2] - mu) / sd AS z2, len(far) AS room FROM o2)"""
_PEAKS = f"""{_SUMS},
pk AS (SELECT x.*, coalesce(y.lag1 = 0 AND x.lag1 = 0 AND abs(y.z1) > {_LEVEL} AND CASE WHEN x.z1 > 0 THEN y.z1 > 0 AND round(x.v2, 9) >= round(y.v2, 9) ELSE y.z1 < 0 AND round(x.v2, 9) <= round(y.v2, 9) END, false) AS lost
  FROM e x LEFT JOIN e y ON (y.src, y.dst, y.d) = (x.dst, x.src, x.d) WHERE abs(x.z1) > {_LEVEL}),
kp AS (SELECT src, dst, d, if(lost, p2 - 1, lag1) AS lag, if(lost, v2, v1) AS v, if(lost, z2, z1) AS z FROM pk WHERE NOT lost OR z1 * z2 > 0 AND abs(z2) > {_LEVEL})"""
_FIRST = "list(struct_pack(a := round(abs({z}), 9), d := d, lag := {lag}, v := {v}, z := {z}) ORDER BY round(abs({z}), 9) DESC, d DESC)[1]"
_VALUE = "round({v}, 6) AS value, round({z}, 6) AS z, {lag} AS peak_offset"

# All ordered pairs of nodes with the weights of both directions.
_GRID = """gr AS (SELECT DISTINCT session, stimulus FROM edges),
ab AS (SELECT gr.session, gr.stimulus, x.node AS a, y.node AS b, f.weight AS wf, g.weight AS wb FROM gr, nodes x, nodes y
  LEFT JOIN edges f ON f.session = gr.session AND f.stimulus = gr.stimulus AND f.src = x.node AND f.dst = y.node
  LEFT JOIN edges g ON g.session = gr.session AND g.stimulus = gr.stimulus AND g.src = y.node AND g.dst = x.node WHERE x.node <> y.node)"""
_SHARE = """sh AS (SELECT session, stimulus, count(*) AS cells, avg(CAST(wf IS NULL AND wb IS NULL AS INT)) AS none, avg(CAST((wf IS NULL) <> (wb IS NULL) AND coalesce(wf, wb) > 0 AS INT)) AS plus, avg(CAST((wf IS NULL) <> (wb IS NULL) AND coalesce(wf, wb) < 0 AS INT)) AS minus,
  avg(CAST(coalesce(wf > 0 AND wb > 0, false) AS INT)) AS plus_plus, avg(CAST(coalesce(wf * wb < 0, false) AS INT)) AS plus_minus, avg(CAST(coalesce(wf < 0 AND wb < 0, false) AS INT)) AS minus_minus,
  avg(CAST(coalesce(wf > 0, false) AS INT)) AS p, avg(CAST(coalesce(wf < 0, false) AS INT)) AS q FROM ab GROUP BY session, stimulus)"""
_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("none", "plus", "minus", "plus_plus", "plus_minus", "minus_minus"))
_OVER = lambda c, den: f"round(coalesce({c} / nullif({den}, 0), 0), 6) AS {c}"

# All triples of nodes with two linked pairs or more: the six weights in the order of the codes' bits.
_TRIPLES = f"""{_GRID}, tr AS (SELECT p.session, p.stimulus, p.a AS v, p.b AS u, r.b AS w, [p.wf, p.wb, r.wf, r.wb, k.wf, k.wb] AS six
  FROM ab p JOIN ab r ON r.session = p.session AND r.stimulus = p.stimulus AND r.a = p.a JOIN ab k ON k.session = p.session AND k.stimulus = p.stimulus AND k.a = p.b AND k.b = r.b
  WHERE p.a < p.b AND p.b < r.b AND CAST(p.wf IS NOT NULL OR p.wb IS NOT NULL AS INT) + CAST(r.wf IS NOT NULL OR r.wb IS NOT NULL AS INT) + CAST(k.wf IS NOT NULL OR k.wb IS NOT NULL AS INT) >= 2),
co AS (SELECT *, CAST(list_sum([CASE WHEN six[i + 1] IS NULL THEN 0 ELSE 1 << i END FOR i IN range(0, 6)]) AS INT) AS code, list_filter(six, lambda x: x IS NOT NULL) AS ws FROM tr),
k AS {table_sql()}"""

_HOPS = """hop AS (SELECT session, stimulus, src AS a, dst AS b, 1 AS n FROM edges UNION SELECT hop.session, hop.stimulus, hop.a, e.dst, n + 1 FROM hop JOIN edges e ON e.session = hop.session AND e.stimulus = hop.stimulus AND e.src = hop.b WHERE n < (SELECT count(*) FROM nodes) AND e.dst <> hop.a),
dist AS (SELECT session, stimulus, a AS src, b AS dst, CAST(min(n) AS BIGINT) AS hops FROM hop GROUP BY ALL)"""
_SAME = """pr AS (SELECT a.run, a.comm = b.comm AS c, x.area = y.area AS r FROM comms a JOIN comms b ON a.run = b.run AND a.node < b.node JOIN nodes x ON x.node = a.node JOIN nodes y ON y.node = b.node)"""

TEXTS = {
    "boxcar": f"{_SUMS} SELECT src, dst, d AS duration, unnest(range(0, len(t))) AS lag, round(unnest(t), 6) AS total, round(mu, 6) AS mean, round(sd, 6) AS deviation FROM s",
    "extreme_offset": f"{_SUMS} SELECT src, dst, d AS duration, {_VALUE.format(v='v1', z='z1', lag='lag1')} FROM e",
    "second_extreme": f"{_SUMS} SELECT src, dst, d AS duration, {_VALUE.format(v='v2', z='z2', lag='p2 - 1')} FROM e WHERE room > 1",
    "second_peak": f"{_SUMS} SELECT src, dst, d AS duration, {_VALUE.format(v='v2', z='z2', lag='p2 - 1')} FROM e WHERE room > 1 AND abs(z2) > {_LEVEL}",
    "sharp_peak_d": f"{_PEAKS} SELECT src, dst, d AS duration, {_VALUE.format(v='v', z='z', lag='lag')} FROM kp",
    "significant_ccg": f"""{_PEAKS}, b AS (SELECT src, dst, {_FIRST.format(z="z", lag="lag", v="v")} AS m FROM kp GROUP BY src, dst)
SELECT x.src, x.dst, round(x.m.v, 6) AS weight, round(x.m.z, 6) AS confidence, x.m.lag AS edge_offset, x.m.d AS duration FROM b x LEFT JOIN b y ON (y.src, y.dst) = (x.dst, x.src)
WHERE x.m.lag <> 0 OR y.src IS NULL OR y.m.lag <> 0 OR x.m.d < y.m.d""",
    "full_ccg": f"""{_SUMS}, b AS (SELECT src, dst, {_FIRST.format(z="z1", lag="lag1", v="v1")} AS m FROM e GROUP BY src, dst) SELECT src, dst, m.d AS duration, {_VALUE.format(v="m.v", z="m.z", lag="m.lag")} FROM b""",
    "ccg_zscore": f"""{_SUMS}, b AS (SELECT src, dst, {_FIRST.format(z="z1", lag="lag1", v="v1")} AS m FROM e GROUP BY src, dst) SELECT l.src, l.dst, round(coalesce(m.z, 0), 6) AS z, round(coalesce(m.v, 0), 6) AS value, coalesce(m.d, 0) AS duration FROM l LEFT JOIN b USING (src, dst)""",
    "firing_rate": "n AS (SELECT len(list_distinct(list(trial_id))) AS n FROM spikes) SELECT neuron_id, len(list(t)) AS spikes, round(len(list(t)) / (any_value(n) * 1.44), 6) AS rate FROM spikes, n GROUP BY neuron_id",
    "ccg_pairs": "x AS (SELECT 1) SELECT a.neuron_id AS src, b.neuron_id AS dst, b.t - a.t AS lag, count(*) AS n FROM spikes a JOIN spikes b USING (trial_id) WHERE b.t >= a.t AND b.t <= a.t + 100 AND a.neuron_id <> b.neuron_id GROUP BY ALL",
    "spike_train": "x AS (SELECT neuron_id, trial_id, list_sort(list(t)) AS ts FROM spikes GROUP BY ALL), p AS (SELECT *, unnest(range(1, len(ts) + 1)) AS place FROM x) SELECT neuron_id, trial_id, ts[place] AS t, place, if(place = 1, NULL, ts[place] - ts[place - 1]) AS gap FROM p",
    "raster": "d AS (SELECT list_sort(list_distinct(list(trial_id))) AS ds FROM spikes) SELECT neuron_id, trial_id, 1490 * (list_position(ds, trial_id) - 1) + t AS at, area FROM spikes, d, nodes WHERE node = neuron_id",
    "stimulus_raster": """fs AS (SELECT stimulus, list_min(list(trial_id)) AS first FROM stimulus_spikes GROUP BY stimulus), sorted AS (SELECT list(node ORDER BY area, node) AS ns FROM nodes WHERE area IS NOT NULL),
p AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS stimulus, unnest([1440, 1200, 960, 720, 480]) AS length, unnest([0, 1490, 2740, 3750, 4520]) AS base)
SELECT s.stimulus, neuron_id, area, list_position(ns, neuron_id) - 1 AS line, base + t AS at FROM stimulus_spikes s JOIN p USING (stimulus) JOIN fs ON fs.stimulus = s.stimulus AND first = trial_id JOIN nodes ON node = neuron_id, sorted WHERE t < length AND area IS NOT NULL""",
    "raster_areas": "s AS (SELECT list(area) AS areas FROM nodes WHERE area IS NOT NULL) SELECT DISTINCT area, len(list_filter(areas, lambda a: a = area)) AS size, len(list_filter(areas, lambda a: a < area)) AS start FROM nodes, s WHERE area IS NOT NULL",
    "gamma_windows": """x AS (SELECT neuron_id, trial_id, list_sort(list(t)) AS ts FROM spikes GROUP BY ALL), p AS (SELECT *, unnest(ts) AS t FROM x),
h AS (SELECT neuron_id, trial_id, t, list_filter(ts, lambda v, i: i = 1 OR v - ts[i - 1] > 10) AS heads FROM p),
y AS (SELECT *, len(list_filter(heads, lambda v: v <= t)) AS burst, list_max(list_filter(heads, lambda v: v <= t)) AS head FROM h)
SELECT neuron_id, trial_id, t, burst, head, greatest(0, least(head // 25 * 25 + t - head, 1415)) AS first FROM y""",
    "ccg_normalised": """tr AS (SELECT len(list_distinct(list(trial_id))) AS trials FROM spikes), f AS (SELECT neuron_id, count(*) * 1.0e0 AS n FROM spikes GROUP BY neuron_id),
p AS (SELECT a.neuron_id AS src, b.neuron_id AS dst, b.t - a.t AS lag, count(*) AS n FROM spikes a JOIN spikes b USING (trial_id) WHERE b.t - a.t BETWEEN 0 AND 100 GROUP BY ALL)
SELECT a.neuron_id AS src, b.neuron_id AS dst, l.lag, round(coalesce(p.n, 0) * 1440.0e0 / ((1440 - l.lag) * sqrt(a.n * b.n)), 6) AS ccg
FROM f a JOIN f b ON a.neuron_id <> b.neuron_id CROSS JOIN (SELECT unnest(range(0, 101)) AS lag) l LEFT JOIN p ON p.src = a.neuron_id AND p.dst = b.neuron_id AND p.lag = l.lag""",
    "omega_windows": "x AS (SELECT 1) SELECT neuron_id, trial_id, t, if(t < 2, 0, if(t > 1437, 1435, t - 2)) AS first, if(t < 2, 0, if(t > 1437, 1435, t - 2)) + 4 AS last FROM spikes",
    "pair_connection": f"{_GRID} SELECT session, stimulus, round(avg(CAST(wf IS NULL AND wb IS NULL AS INT)), 6) AS p0, round(avg(CAST((wf IS NULL) <> (wb IS NULL) AS INT)), 6) AS p1, round(avg(CAST(wf IS NOT NULL AND wb IS NOT NULL AS INT)), 6) AS p2 FROM ab WHERE a < b GROUP BY ALL",
    "signed_pair_unordered": f"{_GRID}, {_SHARE} SELECT session, stimulus, {_SIX} FROM sh",
    "signed_pair_ordered": f"{_GRID}, {_SHARE} SELECT session, stimulus, cells AS ordered_pairs, {_SIX} FROM sh",
    "relative_pair_count": f"{_GRID}, {_SHARE} SELECT session, stimulus, {_OVER('none', '((1 - p - q) ** 2)')}, {_OVER('plus', '(2 * p * (1 - p - q))')}, {_OVER('minus', '(2 * q * (1 - p - q))')}, {_OVER('plus_plus', '(p * p)')}, {_OVER('plus_minus', '(2 * p * q)')}, {_OVER('minus_minus', '(q * q)')} FROM sh",
    "reciprocity": f"{_GRID} SELECT session, stimulus, round(count(wf) FILTER (WHERE wb IS NOT NULL) / count(wf), 6) AS reciprocity FROM ab GROUP BY ALL",
    "degrees": f"{_GRID} SELECT session, stimulus, a AS node, count(wb) AS in_degree, count(wf) AS out_degree FROM ab GROUP BY ALL",
    "density": f"{_GRID} SELECT session, stimulus, round(avg(CAST(wf IS NOT NULL AS INT)), 6) AS density FROM ab GROUP BY ALL",
    "edge_difference": """x AS (SELECT 1) SELECT e.session, e.stimulus AS own, o.stimulus AS other, e.src, e.dst FROM edges e JOIN (SELECT session, stimulus, list((src, dst)) AS has FROM edges GROUP BY ALL) o ON o.session = e.session AND o.stimulus <> e.stimulus WHERE NOT list_contains(has, (e.src, e.dst))""",
    "clustering": f"""{_GRID}, m AS (SELECT *, CAST(wf IS NOT NULL AS INT) + CAST(wb IS NOT NULL AS INT) AS s FROM ab),
cu AS (SELECT x.session, x.stimulus, x.a, sum(x.s * y.s * z.s) AS t FROM m x JOIN m y ON y.session = x.session AND y.stimulus = x.stimulus AND y.a = x.b JOIN m z ON z.session = x.session AND z.stimulus = x.stimulus AND z.a = y.b AND z.b = x.a GROUP BY ALL),
dg AS (SELECT session, stimulus, a, sum(s) AS d, sum(CAST(s = 2 AS INT)) AS b FROM m GROUP BY ALL)
SELECT session, stimulus, round(avg(if(d * (d - 1) - 2 * b = 0, 0, coalesce(t, 0) / (2 * (d * (d - 1) - 2 * b)))), 6) AS clustering FROM dg LEFT JOIN cu USING (session, stimulus, a) GROUP BY ALL""",
    "transitivity": f"""{_GRID}, m AS (SELECT * FROM ab WHERE wf IS NOT NULL OR wb IS NOT NULL)
SELECT x.session, x.stimulus, round(avg(CAST(z.a IS NOT NULL AS INT)), 6) AS transitivity FROM m x JOIN m y ON y.session = x.session AND y.stimulus = x.stimulus AND y.a = x.a AND y.b <> x.b LEFT JOIN m z ON z.session = x.session AND z.stimulus = x.stimulus AND z.a = x.b AND z.b = y.b GROUP BY ALL""",
    "triads": f"{_TRIPLES} SELECT session, stimulus, v, u, w, CAST(code AS BIGINT) AS code, (SELECT any_value(kind) FROM k WHERE k.code = co.code) AS kind FROM co",
    "triad_census": f"{_TRIPLES}, kinds AS (SELECT DISTINCT code, kind FROM k) SELECT session, stimulus, kind, count(*) AS triads FROM co JOIN kinds USING (code) GROUP BY ALL",
    "motif_intensity": f"""{_TRIPLES},
sg AS (SELECT session, stimulus, v, u, w, kind || min(list_aggregate([CASE WHEN x = 7 THEN '' WHEN six[x] > 0 THEN '+' ELSE '-' END FOR x IN [s1, s2, s3, s4, s5, s6]], 'string_agg', '')) AS smt, any_value(list_product([abs(x) FOR x IN ws]) ** (1 / len(ws))) AS g, any_value(list_avg([abs(x) FOR x IN ws])) AS m FROM co JOIN k USING (code) GROUP BY session, stimulus, v, u, w, kind)
SELECT session, stimulus, v, u, w, smt, round(g, 6) AS intensity, round(g / m, 6) AS coherence FROM sg""",
    "short_cycles": """wk AS (SELECT session, stimulus, [src, dst] AS way FROM edges WHERE src < dst UNION ALL SELECT wk.session, wk.stimulus, list_append(way, e.dst) FROM wk JOIN edges e ON e.session = wk.session AND e.stimulus = wk.stimulus AND e.src = way[-1] AND e.dst > way[1] AND NOT list_contains(way, e.dst) WHERE len(way) < 4)
SELECT wk.session, wk.stimulus, CAST(len(way) AS BIGINT) AS size, count(*) AS cycles FROM wk JOIN edges e ON e.session = wk.session AND e.stimulus = wk.stimulus AND e.src = way[-1] AND e.dst = way[1] GROUP BY ALL""",
    "cycles": """wk AS (SELECT session, stimulus, [src, dst] AS way FROM edges WHERE src < dst UNION ALL SELECT wk.session, wk.stimulus, list_append(way, e.dst) FROM wk JOIN edges e ON e.session = wk.session AND e.stimulus = wk.stimulus AND e.src = way[-1] AND e.dst > way[1] AND NOT list_contains(way, e.dst) WHERE len(way) < 5)
SELECT wk.session, wk.stimulus, CAST(len(way) AS BIGINT) AS size, count(*) AS cycles FROM wk JOIN edges e ON e.session = wk.session AND e.stimulus = wk.stimulus AND e.src = way[-1] AND e.dst = way[1] GROUP BY ALL""",
    "distances": f"{_HOPS} SELECT * FROM dist",
    "flow_hierarchy": f"{_HOPS} SELECT e.session, e.stimulus, round(avg(if(d.hops IS NULL, 1, 0)), 6) AS hierarchy FROM edges e LEFT JOIN dist d ON (d.session, d.stimulus, d.src, d.dst) = (e.session, e.stimulus, e.dst, e.src) GROUP BY ALL",
    "strong_components": f"{_HOPS}, nd AS (SELECT session, stimulus, src AS node FROM edges UNION SELECT session, stimulus, dst FROM edges), mt AS (SELECT d.session, d.stimulus, d.src AS node, min(d.dst) AS least FROM dist d JOIN dist e ON (e.session, e.stimulus, e.src, e.dst) = (d.session, d.stimulus, d.dst, d.src) GROUP BY ALL) SELECT nd.*, least(nd.node, coalesce(least, nd.node)) AS component FROM nd LEFT JOIN mt USING (session, stimulus, node)",
    "closeness": f"{_HOPS}, n AS (SELECT count(*) AS n FROM nodes), c AS (SELECT session, stimulus, dst, count(*) * count(*) / (sum(hops) * (any_value(n) - 1)) AS c FROM dist, n GROUP BY ALL) SELECT session, stimulus, round(sum(c) / any_value(n), 6) AS closeness FROM c, n GROUP BY ALL",
    "path_metrics": f"""{_HOPS}, n AS (SELECT count(*) AS n FROM nodes), f AS (SELECT session, stimulus, src, max(hops) AS ecc, count(*) AS reach FROM dist GROUP BY ALL), o AS (SELECT session, stimulus, min(ecc) AS radius, list(reach) AS reached FROM f GROUP BY ALL)
SELECT d.session, d.stimulus, count(*) AS pairs, max(hops) AS diameter, any_value(radius) AS radius, round(avg(hops), 6) AS mean_path, round(sum(1 / hops) / any_value(n * (n - 1)), 6) AS efficiency, CAST(sum(hops) AS BIGINT) AS wiener,
  round(any_value(list_sum([list_max(reached) / (n - 1) - x / (n - 1) FOR x IN list_resize(reached, n, 0)]) / (n - 1)), 6) AS reaching FROM dist d JOIN o USING (session, stimulus), n GROUP BY ALL""",
    "rank_sum": """r AS (SELECT a.session, a.weight > 0 AS plus, (SELECT count(*) FROM edges b WHERE b.session = a.session AND b.confidence < a.confidence) + ((SELECT count(*) FROM edges b WHERE b.session = a.session AND b.confidence = a.confidence) + 1) / 2 AS rk FROM edges a),
s AS (SELECT session, count(*) FILTER (WHERE plus) AS n1, count(*) FILTER (WHERE NOT plus) AS n2, sum(rk) FILTER (WHERE plus) AS w FROM r GROUP BY session)
SELECT session, n1, n2, round((w - n1 * (n1 + n2 + 1) / 2) / nullif(sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 0), 5) AS z FROM s""",
    "adjusted_rand": f"{_SAME}, c AS (SELECT run, sum(CAST(c AND r AS DOUBLE)) AS agree, sum(CAST(c AS DOUBLE)) AS a, sum(CAST(r AS DOUBLE)) AS b, count(*) AS n FROM pr GROUP BY run) SELECT run, round((agree - a * b / n) / ((a + b) / 2 - a * b / n), 6) AS ari FROM c",
    "kde": """ps AS (SELECT g.session, g.stimulus, s.i, s.j, s.r, list(e.weight) AS ws FROM (SELECT DISTINCT session, stimulus FROM edges) g CROSS JOIN scorr s LEFT JOIN edges e ON e.session = g.session AND e.stimulus = g.stimulus AND (e.src = s.i AND e.dst = s.j OR e.src = s.j AND e.dst = s.i) WHERE s.r IS NOT NULL GROUP BY ALL),
cl AS (SELECT stimulus, CASE WHEN list_max(ws) > 0 THEN 'excitatory' WHEN list_min(ws) < 0 THEN 'inhibitory' ELSE 'disconnected' END AS class, list(r) AS rs FROM ps GROUP BY ALL),
h AS (SELECT *, list_stddev_samp(rs) / len(rs) ** 0.2 AS h FROM cl)
SELECT stimulus, class, CAST(step AS BIGINT) AS step, round(list_sum([exp(-0.5 * pow((step / 10 - 1 - x) / h, 2)) FOR x IN rs]) / (len(rs) * h * sqrt(2 * pi())), 6) AS density FROM h, (SELECT unnest(range(0, 21)) AS step) g WHERE h > 0""",
    "weight_mode": "c AS (SELECT session, stimulus, edge_offset, count(*) AS n FROM edges GROUP BY ALL) SELECT session, stimulus, min(edge_offset) AS edge_offset, n FROM c WHERE n = (SELECT max(n) FROM c d WHERE d.session = c.session AND d.stimulus = c.stimulus) GROUP BY ALL",
    "signal_corr_connected": "x AS (SELECT 1) SELECT session, stimulus, src, dst, r, CAST(weight > 0 AS INT) AS positive, CAST(weight < 0 AS INT) AS negative FROM edges JOIN scorr ON (i, j) = (least(src, dst), greatest(src, dst)) WHERE r IS NOT NULL",
}

TEXTS |= {f"{k}_sketch" if k == "closeness" else "path_sketch": TEXTS[k] for k in ("closeness", "path_metrics")}  # few nodes: sketches count exactly
TEXTS |= {f"stream_{k}": TEXTS[k] for k in ("ccg_pairs", "gamma_windows")}  # replayed to its end, a stream gives what the table gives

TEXTS |= motif_oracles.TEXTS


def texts() -> dict[str, str]:
    out = {}
    for name, text in TEXTS.items():
        used = [t for t in BASE if re.search(rf"\b{t}\b", text)]
        out[name] = f"WITH RECURSIVE {', '.join(f'{t} AS ({BASE[t].duckdb()})' for t in used)}, {text}"
    return out
