"""Three-node signed motifs: census, intensity and coherence, Z-scores, regions and stimulus sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from . import nullmodels
from .graph import COMBINED
from .sql import operator
from .triad_table import table_sql, vocabulary, vocabulary_sql

# Connected triples once: two neighbours of a middle node, ordered, distinct; then their six arcs.
_TRIADS = """u AS (SELECT DISTINCT session, stimulus, a, b FROM (SELECT session, stimulus, src AS a, dst AS b FROM {edges} UNION ALL SELECT session, stimulus, dst, src FROM {edges}) x WHERE a <> b),
h AS (SELECT x.session, x.stimulus, x.a AS m, x.b AS p, y.b AS q FROM u x JOIN u y ON x.session = y.session AND x.stimulus = y.stimulus AND x.a = y.a AND x.b < y.b),
t AS (SELECT DISTINCT session, stimulus, least(m, p) AS v, CASE WHEN m < p THEN p WHEN m < q THEN m ELSE q END AS u, greatest(m, q) AS w FROM h),
pair AS (SELECT session, stimulus, v, u, w, pos, CASE pos WHEN 3 THEN u ELSE v END AS p, CASE pos WHEN 1 THEN u ELSE w END AS q FROM t CROSS JOIN (VALUES (1), (2), (3)) AS x(pos)),
line AS (SELECT session, stimulus, src, least(src, dst) AS p, greatest(src, dst) AS q, weight FROM {edges}),
arc AS (SELECT pair.session, pair.stimulus, v, u, w, weight, 2 * pos - CASE WHEN src = pair.p THEN 1 ELSE 0 END AS slot FROM pair JOIN line ON line.session = pair.session AND line.stimulus = pair.stimulus AND line.p = pair.p AND line.q = pair.q),
c AS (SELECT session, stimulus, v, u, w, CAST(sum(CASE slot WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 16 ELSE 32 END) AS INT) AS code,
  max(CASE WHEN slot = 1 THEN sg END) AS g1, max(CASE WHEN slot = 2 THEN sg END) AS g2, max(CASE WHEN slot = 3 THEN sg END) AS g3, max(CASE WHEN slot = 4 THEN sg END) AS g4, max(CASE WHEN slot = 5 THEN sg END) AS g5, max(CASE WHEN slot = 6 THEN sg END) AS g6,
  exp(avg(ln(abs(weight)))) AS intensity, avg(abs(weight)) AS mean FROM (SELECT *, CASE WHEN weight > 0 THEN '+' ELSE '-' END AS sg FROM arc) z GROUP BY session, stimulus, v, u, w)"""
_SIGNS = "coalesce(g1, ' ') || coalesce(g2, ' ') || coalesce(g3, ' ') || coalesce(g4, ' ') || coalesce(g5, ' ') || coalesce(g6, ' ')"
_TABLE = f"k AS {table_sql()}"
_PICK = " || ".join(f"CASE WHEN s{i} = 7 THEN '' ELSE substr(signs, s{i}, 1) END" for i in range(1, 7))
_MOTIFS = f"""{_TRIADS}, {_TABLE},
s AS (SELECT *, {_SIGNS} AS signs FROM c),
m AS (SELECT session, stimulus, v, u, w, s.code, kind, kind || min({_PICK}) AS smt, max(intensity) AS intensity, max(intensity) / max(mean) AS coherence FROM s JOIN k ON s.code = k.code GROUP BY session, stimulus, v, u, w, s.code, kind)"""

triads = operator("triads", f"WITH {_TRIADS}, {_TABLE} SELECT session, stimulus, v, u, w, CAST(c.code AS BIGINT) AS code, kind FROM c JOIN k ON c.code = k.code AND ord = 0")
triad_census = operator("triad_census", f"WITH {_TRIADS}, {_TABLE} SELECT session, stimulus, kind, count(*) AS triads FROM c JOIN k ON c.code = k.code AND ord = 0 GROUP BY session, stimulus, kind")
motif_sign = operator("motif_sign", f"WITH {_MOTIFS} SELECT session, stimulus, v, u, w, smt FROM m")
motif_intensity = operator("motif_intensity", f"WITH {_MOTIFS} SELECT session, stimulus, v, u, w, smt, round(intensity, 6) AS intensity, round(coherence, 6) AS coherence FROM m")
motif_vocabulary = operator("motif_vocabulary", f"SELECT smt, count(*) OVER () AS total FROM {vocabulary_sql()} x CROSS JOIN (SELECT count(*) AS n FROM {{nodes}}) y")
_CENSUS = f"""{_MOTIFS}, g AS (SELECT DISTINCT session, stimulus FROM {{edges}}), vocab AS {vocabulary_sql()},
z AS (SELECT session, stimulus, smt, count(*) AS n, sum(intensity) AS intensity, sum(coherence) AS coherence FROM m GROUP BY session, stimulus, smt),
census AS (SELECT g.session, g.stimulus, vocab.smt, coalesce(n, 0) AS n, coalesce(intensity, 0) AS intensity, coalesce(coherence, 0) AS coherence FROM g CROSS JOIN vocab LEFT JOIN z ON z.session = g.session AND z.stimulus = g.stimulus AND z.smt = vocab.smt)"""
motif_census = operator("motif_census", f"WITH {_CENSUS} SELECT session, stimulus, smt, n, round(intensity, 6) AS intensity, round(coherence, 6) AS coherence FROM census")

# Z against the graphs of the other sessions with the same stimulus; against null models see NULL_Z.  A type absent in all
# has mean and deviation 0; its deviation is then that of one 4 among zeros.
_Z = f"""{_CENSUS},
r AS (SELECT a.session, a.stimulus, a.smt, a.intensity, count(*) AS reps, avg(b.intensity) AS mean, stddev_samp(b.intensity) AS dev FROM census a JOIN census b ON a.stimulus = b.stimulus AND a.smt = b.smt AND a.session <> b.session GROUP BY a.session, a.stimulus, a.smt, a.intensity),
y AS (SELECT *, CASE WHEN mean = 0 AND dev = 0 THEN sqrt(16.0 / reps - 16.0 / (reps * reps)) ELSE dev END AS sd FROM r),
zs AS (SELECT session, stimulus, smt, intensity, mean, sd, (intensity - mean) / nullif(sd, 0) AS z FROM y)"""
motif_zscore = operator("motif_zscore", f"WITH {_Z} SELECT session, stimulus, smt, round(intensity, 6) AS intensity, round(mean, 6) AS mean, round(sd, 6) AS deviation, round(z, 5) AS z FROM zs WHERE sd > 0.000001")
motif_zscore_stored = operator("motif_zscore_stored", f"""WITH {_CENSUS},
b AS (SELECT stimulus, smt, avg(intensity) AS mean, stddev_pop(intensity) AS dev, count(*) AS reps, max(intensity) AS top FROM census GROUP BY stimulus, smt),
q AS (SELECT census.session, census.stimulus, census.smt, (intensity - CASE WHEN top = 0 THEN 5.0 / reps ELSE mean END) / nullif(CASE WHEN top = 0 THEN sqrt(25.0 / reps - 25.0 / (reps * reps)) ELSE dev END, 0) AS z FROM census JOIN b ON census.stimulus = b.stimulus AND census.smt = b.smt)
SELECT stimulus, smt, count(z) AS sessions, round(avg(z), 5) AS mean_z, round(stddev_samp(z), 5) AS std_z FROM q GROUP BY stimulus, smt""")
z_density = operator("z_density", f"WITH {_Z}, d AS (SELECT session, stimulus, count(*) AS m FROM {{edges}} GROUP BY session, stimulus) SELECT zs.session, zs.stimulus, max(m) AS edges, round(avg(abs(z)), 5) AS mean_abs_z FROM zs JOIN d ON d.session = zs.session AND d.stimulus = zs.stimulus WHERE sd > 0.000001 GROUP BY zs.session, zs.stimulus")
mean_z = operator("mean_z", f"WITH {_Z} SELECT stimulus, smt, round(avg(z), 5) AS mean_z FROM zs WHERE sd > 0.000001 GROUP BY stimulus, smt")
z_corr_matrix = operator("z_corr_matrix", f"""WITH {_Z}, a AS (SELECT stimulus, smt, avg(z) AS z FROM zs WHERE sd > 0.000001 GROUP BY stimulus, smt)
SELECT x.stimulus AS first, y.stimulus AS second, count(*) AS types, round(corr(x.z, y.z), 5) AS r FROM a x JOIN a y ON x.smt = y.smt AND x.stimulus <> y.stimulus GROUP BY x.stimulus, y.stimulus""")

_ROLE = "CASE {} WHEN 1 THEN av WHEN 2 THEN au ELSE aw END"
_REGION = f"""{_MOTIFS},
a AS (SELECT session, stimulus, v, u, w, smt, m.kind, x.area AS av, y.area AS au, z.area AS aw, p, k.x, o, sorts FROM m JOIN k ON m.code = k.code AND ord = 0 JOIN {{nodes}} x ON v = x.node JOIN {{nodes}} y ON u = y.node JOIN {{nodes}} z ON w = z.node),
b AS (SELECT session, stimulus, v, u, w, smt, kind, sorts, {_ROLE.format('p')} AS rp, {_ROLE.format('x')} AS rx, {_ROLE.format('o')} AS ro FROM a),
region AS (SELECT session, stimulus, v, u, w, smt, kind, CASE sorts WHEN 'xo' THEN concat_ws('_', rp, least(rx, ro), greatest(rx, ro)) WHEN 'px' THEN concat_ws('_', least(rp, rx), greatest(rp, rx), ro)
  WHEN 'all' THEN concat_ws('_', least(rp, rx, ro), rp + rx + ro - least(rp, rx, ro) - greatest(rp, rx, ro), greatest(rp, rx, ro))
  WHEN 'turn' THEN least(concat_ws('_', rp, rx, ro), concat_ws('_', rx, ro, rp), concat_ws('_', ro, rp, rx)) ELSE concat_ws('_', rp, rx, ro) END AS region FROM b)"""
motif_region = operator("motif_region", f"WITH {_REGION} SELECT session, stimulus, v, u, w, smt, region FROM region")
motif_region_census = operator("motif_region_census", f"WITH {_REGION} SELECT session, stimulus, smt, region, count(*) AS n FROM region GROUP BY session, stimulus, smt, region ORDER BY count(*) DESC")
motif_region_fraction = operator("motif_region_fraction", f"""WITH {_REGION},
f AS (SELECT session, stimulus, smt, count(*) AS n, avg(CASE WHEN x.area = y.area AND y.area = z.area THEN 1.0 ELSE 0.0 END) AS same, avg(CASE WHEN x.area = 0 OR y.area = 0 OR z.area = 0 THEN 1.0 ELSE 0.0 END) AS touch
  FROM region JOIN {{nodes}} x ON v = x.node JOIN {{nodes}} y ON u = y.node JOIN {{nodes}} z ON w = z.node GROUP BY session, stimulus, smt HAVING count(*) >= 5)
SELECT stimulus, smt, count(*) AS sessions, round(avg(same), 6) AS same_mean, round(stddev_samp(same), 6) AS same_std, round(avg(touch), 6) AS touch_mean FROM f GROUP BY stimulus, smt""")
# Triples are told apart by session, so that sessions can be merged.
motif_ids = operator("motif_ids", f"WITH {_MOTIFS}, {COMBINED} SELECT DISTINCT session, combined, smt, v, u, w FROM m JOIN comb ON comb.stimulus = m.stimulus")


def upset(name: str, least: int):
    """By type and set of combined stimuli: triples that occur in exactly these; sets of ``least`` triples or more."""
    return operator(name, f"""WITH {_MOTIFS}, {COMBINED}, d AS (SELECT DISTINCT session, combined, smt, v, u, w FROM m JOIN comb ON comb.stimulus = m.stimulus),
g AS (SELECT session, smt, v, u, w, TEXT_LIST(combined) AS stimuli FROM d GROUP BY session, smt, v, u, w)
SELECT smt, stimuli, count(*) AS triples FROM g GROUP BY smt, stimuli HAVING count(*) >= {least}""")


motif_upset = upset("motif_upset", 2)
signal_corr_motif = operator("signal_corr_motif", f"""WITH {_MOTIFS},
e AS (SELECT DISTINCT session, stimulus, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT session, stimulus, v AS a, u AS b FROM m WHERE smt LIKE '%+' AND smt NOT LIKE '%-%' UNION ALL SELECT session, stimulus, v, w FROM m WHERE smt LIKE '%+' AND smt NOT LIKE '%-%' UNION ALL SELECT session, stimulus, u, w FROM m WHERE smt LIKE '%+' AND smt NOT LIKE '%-%') q),
g AS (SELECT DISTINCT session, stimulus FROM {{edges}})
SELECT g.session, g.stimulus, CASE WHEN e.a IS NULL THEN 'rest' ELSE 'motif' END AS part, count(*) AS pairs, round(avg(r), 6) AS mean_r FROM g CROSS JOIN {{scorr}} s LEFT JOIN e ON e.session = g.session AND e.stimulus = g.stimulus AND e.a = s.i AND e.b = s.j GROUP BY g.session, g.stimulus, CASE WHEN e.a IS NULL THEN 'rest' ELSE 'motif' END""")

GIVEN = ("030T+++", "120D++++", "120U++++", "120C++++", "210+++++", "300++++++")  # all-excitatory types with a feed-forward loop

# Z against a null model: the census of a graph and those of its replicas (with rep).  As above, a type absent in all
# replicas has the deviation of one 4 among zeros, and one whose replicas all agree otherwise has a null Z, which means and correlations pass over; the stored form has the mean and deviation of one 5.
_NULL_Z = """r AS (SELECT session, stimulus, smt, count(*) AS reps, avg(intensity) AS mean, stddev_samp(intensity) AS dev FROM {replicas} GROUP BY session, stimulus, smt),
y AS (SELECT *, CASE WHEN mean = 0 AND dev = 0 THEN sqrt(16.0 / reps - 16.0 / (reps * reps)) ELSE dev END AS sd FROM r),
zs AS (SELECT c.session, c.stimulus, c.smt, c.n, c.intensity, mean, sd, CASE WHEN sd > 0.000001 THEN (c.intensity - mean) / sd END AS z FROM {census} c JOIN y ON c.session = y.session AND c.stimulus = y.stimulus AND c.smt = y.smt)"""
NULL_Z = {o.name: o for o in (
    operator("null_zscore", f"WITH {_NULL_Z} SELECT session, stimulus, smt, round(intensity, 6) AS intensity, round(mean, 6) AS mean, round(sd, 6) AS deviation, round(z, 5) AS z FROM zs"),
    operator("null_zscore_stored", """WITH
b AS (SELECT session, stimulus, smt, avg(intensity) AS mean, stddev_pop(intensity) AS dev, count(*) AS reps, max(intensity) AS top FROM {replicas} GROUP BY session, stimulus, smt),
q AS (SELECT c.session, c.stimulus, c.smt, (intensity - CASE WHEN top = 0 THEN 5.0 / reps ELSE mean END) / nullif(CASE WHEN top = 0 THEN sqrt(25.0 / reps - 25.0 / (reps * reps)) ELSE dev END, 0) AS z FROM {census} c JOIN b ON c.session = b.session AND c.stimulus = b.stimulus AND c.smt = b.smt
  WHERE c.smt IN (SELECT smt FROM {replicas} WHERE n > 0 UNION SELECT smt FROM {census} WHERE n > 0))
SELECT stimulus, smt, count(z) AS sessions, round(avg(z), 5) AS mean_z, round(stddev_samp(z), 5) AS std_z FROM q GROUP BY stimulus, smt"""),
    operator("null_z_density", f"WITH {_NULL_Z} SELECT session, stimulus, count(z) AS types, round(avg(abs(z)), 5) AS mean_abs_z FROM zs GROUP BY session, stimulus"),
    operator("null_mean_z", f"WITH {_NULL_Z}, {COMBINED} SELECT combined, smt, round(avg(z), 5) AS mean_z FROM zs JOIN comb ON comb.stimulus = zs.stimulus GROUP BY combined, smt"),
    operator("null_z_corr", f"""WITH {_NULL_Z}, {COMBINED}, a AS (SELECT combined, smt, avg(z) AS z FROM zs JOIN comb ON comb.stimulus = zs.stimulus GROUP BY combined, smt)
SELECT x.combined AS first, y.combined AS second, count(x.z + y.z) AS types, round(corr(x.z, y.z), 5) AS r FROM a x JOIN a y ON x.smt = y.smt AND x.combined <> y.combined GROUP BY x.combined, y.combined"""),
    operator("null_log2_z", f"WITH {_NULL_Z} SELECT session, stimulus, smt, round(log2(nullif(abs(z), 0)) * CASE WHEN z >= 0 THEN 1 ELSE -1 END, 5) AS value FROM zs"),
    # Of types with five triples or more and Z above 1.96: the share of triples all in area 0, or touching it; 0 where no graph is left.
    operator("null_region_fraction", f"""WITH {_REGION}, {_NULL_Z}, {COMBINED},
f AS (SELECT region.session, region.stimulus, region.smt, avg(CASE WHEN x.area = 0 AND y.area = 0 AND z.area = 0 THEN 1.0 ELSE 0.0 END) AS same, avg(CASE WHEN x.area = 0 OR y.area = 0 OR z.area = 0 THEN 1.0 ELSE 0.0 END) AS touch
  FROM region JOIN {{nodes}} x ON v = x.node JOIN {{nodes}} y ON u = y.node JOIN {{nodes}} z ON w = z.node GROUP BY region.session, region.stimulus, region.smt HAVING count(*) >= 5),
picked AS (SELECT combined, f.smt, same, touch FROM f JOIN zs ON zs.session = f.session AND zs.stimulus = f.stimulus AND zs.smt = f.smt AND zs.z > 1.96 JOIN comb ON comb.stimulus = f.stimulus)
SELECT c.combined, c.smt, count(same) AS graphs, round(coalesce(avg(same), 0), 6) AS same_mean, round(stddev_samp(same), 6) AS same_std, round(coalesce(avg(touch), 0), 6) AS touch_mean, round(stddev_samp(touch), 6) AS touch_std
FROM (SELECT DISTINCT combined, smt FROM comb CROSS JOIN {vocabulary_sql()} v) c LEFT JOIN picked t ON t.combined = c.combined AND t.smt = c.smt GROUP BY c.combined, c.smt"""),
    # Signal correlation of pairs in triples of the given types, of other types whose mean Z is above 2.576, and of all other pairs.
    operator("null_signal_corr_motif", f"""WITH {_MOTIFS}, {_NULL_Z},
given AS (SELECT * FROM (VALUES {", ".join(f"('{k}')" for k in GIVEN)}) AS t(smt)),
high AS (SELECT stimulus, smt FROM zs WHERE smt NOT IN (SELECT smt FROM given) GROUP BY stimulus, smt HAVING avg(z) > 2.576),
side AS (SELECT m.session, m.stimulus, m.smt, v AS a, u AS b FROM m UNION ALL SELECT session, stimulus, smt, v, w FROM m UNION ALL SELECT session, stimulus, smt, u, w FROM m),
within AS (SELECT side.session, side.stimulus, 'given' AS part, a, b FROM side JOIN given ON given.smt = side.smt UNION ALL SELECT side.session, side.stimulus, 'other', a, b FROM side JOIN high ON high.smt = side.smt AND high.stimulus = side.stimulus),
gr AS (SELECT DISTINCT session, stimulus FROM {{edges}}),
rest AS (SELECT gr.session, gr.stimulus, 'rest' AS part, s.i AS a, s.j AS b FROM gr CROSS JOIN {{scorr}} s LEFT JOIN (SELECT DISTINCT session, stimulus, a, b FROM within) x ON x.session = gr.session AND x.stimulus = gr.stimulus AND x.a = s.i AND x.b = s.j WHERE x.a IS NULL),
every AS (SELECT * FROM within UNION ALL SELECT * FROM rest)
SELECT every.session, every.stimulus, part, count(*) AS pairs, round(avg(x.r), 6) AS mean_r FROM every JOIN {{scorr}} x ON x.i = every.a AND x.j = every.b WHERE x.r IS NOT NULL GROUP BY every.session, every.stimulus, part"""),
)}


def replica_census(replicas: DataFrame) -> DataFrame:
    """The census of every replica of ``random_graphs``: session, stimulus, rep, smt, n, intensity, coherence."""
    graphs = staged(replicas.select("session", F.concat_ws(":", "rep", "stimulus").alias("stimulus"), "src", "dst", "weight"), "replicas")  # read several times, drawn once
    rep, stimulus = F.substring_index("stimulus", ":", 1).cast("int"), F.expr("substr(stimulus, instr(stimulus, ':') + 1)")
    return motif_census(edges=graphs).select("session", stimulus.alias("stimulus"), rep.alias("rep"), "smt", "n", "intensity", "coherence")


def null_z(name: str, edges: DataFrame, nodes: DataFrame, model: str = "signed_pair", replicas: int = 200, **more: DataFrame) -> DataFrame:
    """One of ``NULL_Z`` for every graph against its own replicas; ``more``: further tables that it reads.

    ``model``: one of ``nullmodels.random_graphs``, or 'dealt' for weights dealt anew by an arithmetic hash.
    """
    # The last text reads each table several times: all are made once, or edges would be joined anew and replicas counted anew at every place.
    edges = staged(edges, "edges")
    more = {k: staged(v, k) for k, v in more.items()}
    graphs = nullmodels.dealt_weights(replicas)(edges=edges) if model == "dealt" else nullmodels.random_graphs(edges, nodes, model, replicas)
    census, drawn = staged(motif_census(edges=edges), "census"), staged(replica_census(graphs), "replica-census")
    return NULL_Z[name](census=census, replicas=drawn, edges=edges, nodes=nodes, **more)


assert len(vocabulary()) == 132
