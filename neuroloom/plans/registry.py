"""All queries by name, with their DuckDB SQL.

A query loads the model tables that its operator names.  Its SQL is a text of its own (``oracles``) or, where
there is none yet, the operator's text over the same tables made by DuckDB, which shows that both engines agree but no more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import baselines, centrality, communities, cycles, detect, graph, modules, motifs, nullmodels, paths, ranks, rewiring, simulate, sketches, spikes
from ..operators.sql import SqlOperator
from ..sources import matrices, matrix_source
from ..sources.tables import BASE, load
from ..staging import shared_dir, staged
from ..streaming import spikes as stream
from . import oracles

OPERATORS: dict[str, SqlOperator] = {
    op.name: op for m in (spikes, detect, graph, motifs, modules, nullmodels, centrality, stats) for op in vars(m).values() if isinstance(op, SqlOperator)
}


def _run(op: SqlOperator):
    return lambda spark, sf_dir: op(**{k: load(spark, sf_dir, k) for k in op.inputs})


def _sql(op: SqlOperator) -> str:
    base = ", ".join(f"{k} AS ({BASE[k].duckdb()})" for k in op.inputs)
    return f"WITH {base} SELECT * FROM ({op.duckdb()}) q"


def _nulls(model: str):
    return lambda spark, d: nullmodels.random_graphs(load(spark, d, "edges"), load(spark, d, "nodes"), model)


def _verified(spark, d):
    edges = load(spark, d, "edges")
    return nullmodels.verify(edges, nullmodels.random_graphs(edges, load(spark, d, "nodes"), "signed_pair"))


def _null_z(name: str, model: str = "signed_pair", replicas: int = 200):
    more = [k for k in motifs.NULL_Z[name].inputs if k not in ("census", "replicas", "edges", "nodes")]
    return lambda spark, d: motifs.null_z(name, load(spark, d, "edges"), load(spark, d, "nodes"), model, replicas, **{k: load(spark, d, k) for k in more})


def _baseline_z(models: tuple[str, ...], replicas: int, then=lambda scores: scores):
    """Baselines drawn, written and read again, and every graph held against them."""

    def run(spark, d):
        edges, nodes = load(spark, d, "edges"), load(spark, d, "nodes")
        path = f"{shared_dir(spark)}/baselines-{uuid.uuid4().hex}"
        baselines.store(edges, nodes, path, models, replicas)
        return baselines.rounded(then(baselines.zscores(motifs.motif_census(edges=edges), baselines.stored(spark, path, *models))))

    return run


def _stored_graphs(spark, d):
    """Graphs written as matrix archives and loaded again by the data source."""
    matrix_source.register(spark)
    edges, nodes = load(spark, d, "edges"), load(spark, d, "nodes")
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    matrix_source.write_archives(edges, nodes, folder)
    read = spark.read.format("matrices").load(folder)
    areas = edges.select("session").dropDuplicates().crossJoin(nodes).withColumn("is_active", F.lit(True))
    found = matrices.graphs(read, areas)
    return found.select("session", "stimulus", "src", "dst", "weight", "confidence", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("edge_offset", "duration")])


def _streamed(found, shape, result):
    """The events arrive in three parts and go through a stream that ends and starts again after each."""

    def run(spark, d):
        base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        spikes = stream.spike_times(spark.read.parquet(f"{d}/events.parquet"))
        stream.replay(spikes, f"{base}/in", 3, lambda arrived: stream.into(found(arrived), f"{base}/out", f"{base}/state", shape))
        return result(spark, f"{base}/out")

    return run


def _stored_areas(spark, d):
    """Areas of every session's nodes, active where an edge touches them, written and loaded again."""
    edges = load(spark, d, "edges")
    on = edges.select("session", F.explode(F.array("src", "dst")).alias("node")).dropDuplicates().withColumn("on", F.lit(True))
    areas = edges.select("session").dropDuplicates().crossJoin(load(spark, d, "nodes")).join(on, ["session", "node"], "left").withColumn("is_active", F.coalesce("on", F.lit(False)))
    path = f"{shared_dir(spark)}/areas-{uuid.uuid4().hex}"
    matrices.write_areas(areas, path)
    return matrices.read_areas(spark, path)


def _rank_sum(spark, d):
    edges = load(spark, d, "edges").select("session", "confidence", (F.col("weight") > 0).alias("plus"))
    return ranks.rank_sum(edges, ["session"], "confidence", "plus")


def _energies(then):
    return lambda spark, d: then(staged(communities.energies(load(spark, d, "edges"), load(spark, d, "nodes")), "energies"))


def _louvain_purity(spark, d):
    """Purity and coverage of areas of every partition found, instead of the given ones."""
    comms, names = communities.numbered(staged(communities.louvain(load(spark, d, "edges"), load(spark, d, "nodes")), "partitions"))
    return modules.purity_coverage(comms=comms, nodes=load(spark, d, "nodes")).join(names, "run").select("session", "stimulus", F.col("of").alias("run"), "nodes", "purity", "coverage")


#: Iterative, random or with p-values: beyond SQL, held against invariants and brute force in tests.
OTHERS = {
    "stored_graphs": _stored_graphs, "stored_areas": _stored_areas,
    "stream_ccg_pairs": _streamed(stream.coincidences, stream.partial_counts, stream.pair_totals), "stream_gamma_windows": _streamed(stream.bursts, stream.with_neuron, stream.burst_windows),
    "curveball_graph": lambda s, d: rewiring.curveball(load(s, d, "edges")),
    "small_world": lambda s, d: rewiring.small_world(load(s, d, "edges")),
    "cycles": lambda s, d: cycles.cycles(load(s, d, "edges"), 5),
    "path_sketch": lambda s, d: sketches.path_sketch(load(s, d, "edges"), load(s, d, "nodes")),
    "closeness_sketch": lambda s, d: sketches.closeness_sketch(load(s, d, "edges"), load(s, d, "nodes")),
    "median_interval": lambda s, d: stats.median_interval(load(s, d, "edges"), ["session", "stimulus"], "weight"),
    "rank_sum": _rank_sum, "rank_sum_p": lambda s, d: stats.with_p_values(_rank_sum(s, d)),
    "louvain_communities": lambda s, d: communities.louvain(load(s, d, "edges"), load(s, d, "nodes")).withColumn("energy", F.round("energy", 6)),
    "louvain_resolution": _energies(communities.resolution), "louvain_modularity_z": _energies(communities.modularity_z), "louvain_purity": _louvain_purity,
    "surrogates": lambda s, d: spikes.surrogates(load(s, d, "spikes")),
    "ccg_corrected": lambda s, d: spikes.ccg_corrected(load(s, d, "spikes")),
    "er_graph": _nulls("random"), "degree_graph": _nulls("degree"), "pair_graph": _nulls("pair"), "signed_pair_graph": _nulls("signed_pair"), "verify_null": _verified,
    **{name: _null_z(name) for name in motifs.NULL_Z},
    **{name.replace("null_", "dealt_"): _null_z(name, "dealt", 97) for name in motifs.NULL_Z},  # the same against replicas that SQL can repeat
    **{f"baseline_zscore_{m}": _baseline_z((m,), 200) for m in baselines.MODELS}, "baseline_zscore_mean": _baseline_z(("signed_pair",), 200, baselines.over_sessions),
    "dealt_baseline_zscore": _baseline_z(("dealt",), 97), "dealt_baseline_mean": _baseline_z(("dealt",), 97, baselines.over_sessions),
    "weak_components": lambda s, d: paths.weak_components(load(s, d, "edges")),
    "largest_wcc": lambda s, d: paths.largest_component(load(s, d, "edges")),
    "distances": lambda s, d: paths.distances(load(s, d, "edges")),
    "path_metrics": lambda s, d: paths.path_metrics(load(s, d, "edges"), load(s, d, "nodes")),
    "strong_components": lambda s, d: paths.strong_components(load(s, d, "edges")),
    "largest_scc": lambda s, d: paths.largest_strong(load(s, d, "edges")),
    "corrected_zscore": lambda s, d: detect.detector("ccg_zscore", max_duration=11)(ccg=spikes.ccg_corrected(load(s, d, "spikes")).withColumnRenamed("ccg", "value")),
    "closeness": lambda s, d: centrality.closeness(load(s, d, "edges"), load(s, d, "nodes")),
    "betweenness": lambda s, d: centrality.betweenness(load(s, d, "edges"), load(s, d, "nodes")),
    "surrogates_memory": lambda s, d: spikes.surrogates(load(s, d, "spikes"), memory=True),
    "network": lambda s, d: spikes.network(load(s, d, "spikes")),
    "shapiro": lambda s, d: stats.shapiro(load(s, d, "edges"), ["session", "stimulus"], "weight"),
    "density_regression_p": lambda s, d: stats.regression_p(graph.density_regression(edges=load(s, d, "edges"), nodes=load(s, d, "nodes"))),
    "simulated_spikes_variable": lambda s, d: simulate.izhikevich_variable(s, [(0, 1, 10000.0), (1, 2, 10000.0)], 3)[0],
    "flow_hierarchy": lambda s, d: paths.flow_hierarchy(load(s, d, "edges")),
    "t_test_p": lambda s, d: stats.with_p_values(stats.t_test(edges=load(s, d, "edges"))),
    "z_test_p": lambda s, d: stats.with_p_values(stats.z_test(edges=load(s, d, "edges"))),
    "mean_interval": lambda s, d: stats.confidence_interval(load(s, d, "edges"), ["session", "stimulus"], "weight"),
    "bootstrap_median": lambda s, d: stats.bootstrap_median(load(s, d, "edges"), ["session", "stimulus"], "weight"),
    "simulated_spikes": lambda s, d: simulate.izhikevich(s, [(0, 1, 10000.0, 3)], 2),
    "random_delays": lambda s, d: simulate.random_delays(load(s, d, "edges").select("session", "stimulus", "src", "dst")),
    "random_adjacency": lambda s, d: simulate.random_adjacency(s, 50),
    "block_model": lambda s, d: simulate.block_model(s), "random_train": lambda s, d: simulate.random_train(s),
}

_WEAK = """b AS (SELECT session, stimulus, src AS x, dst AS y FROM edges UNION SELECT session, stimulus, dst, src FROM edges),
r AS (SELECT session, stimulus, x AS node, x AS y FROM b UNION SELECT r.session, r.stimulus, r.node, b.y FROM r JOIN b ON b.session = r.session AND b.stimulus = r.stimulus AND b.x = r.y),
c AS (SELECT session, stimulus, node, min(y) AS component FROM r GROUP BY ALL)"""
OTHER_SQL = {
    "weak_components": f"{_WEAK} SELECT * FROM c",
}


def queries() -> dict:
    return {name: _run(op) for name, op in OPERATORS.items()} | OTHERS


def oracle_sql() -> dict[str, str]:
    edges = f"WITH RECURSIVE edges AS ({BASE['edges'].duckdb()}), "
    return {name: _sql(op) for name, op in OPERATORS.items()} | {k: edges + v for k, v in OTHER_SQL.items()} | oracles.texts()
