"""Distances in large graphs by neighbourhood counters: N sketches instead of N^2 pairs.

A node's HyperLogLog sketch holds the nodes within h steps.  A round unions each node's sketch with those of its targets; what a
round adds is the number of nodes at distance h.  Sketches are Spark's own, of 2^lg registers: small sets are counted exactly, large ones with
a relative error of about 1.04 / sqrt(2^lg).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import KEYS, _cut


def neighbourhoods(edges: DataFrame, lg: int = 12, inward: bool = False) -> DataFrame:
    """(session, stimulus, node, hops, more): how many further nodes a node reaches in ``hops`` steps, or is reached from (``inward``); rows where there are some.

    Unions go on until no node's estimate changes, so there are as many rounds as the longest shortest path.  Loops don't count.
    """
    a, b = ("dst", "src") if inward else ("src", "dst")
    step = _cut(edges.where("src <> dst").select(*KEYS, F.col(a).alias("node"), F.col(b).alias("near")).dropDuplicates())
    every = step.select(*KEYS, "node").union(step.select(*KEYS, "near")).dropDuplicates()
    state = _cut(every.groupBy(*KEYS, "node").agg(F.hll_sketch_agg("node", F.lit(lg)).alias("sketch")).withColumn("reach", F.lit(1).cast("long")))
    found, hops = None, 0
    while True:
        hops += 1
        sent = step.join(state.select(*KEYS, F.col("node").alias("near"), "sketch"), [*KEYS, "near"]).select(*KEYS, "node", "sketch", F.lit(None).cast("long").alias("reach"))
        new = sent.union(state.select(*KEYS, "node", "sketch", "reach")).groupBy(*KEYS, "node").agg(F.hll_union_agg("sketch", F.lit(False)).alias("sketch"), F.max("reach").alias("before"))
        new = _cut(new.withColumn("reach", F.greatest("before", F.hll_sketch_estimate("sketch"))))
        more = new.where("reach > before").select(*KEYS, "node", F.lit(hops).cast("long").alias("hops"), (F.col("reach") - F.col("before")).alias("more"))
        if not more.limit(1).count():
            return found if found is not None else more
        found = more if found is None else found.union(more)
        state = new.drop("before")


def path_sketch(edges: DataFrame, nodes: DataFrame, lg: int = 12) -> DataFrame:
    """The columns of ``path_metrics`` by sketches: pairs, diameter, radius, mean path, efficiency, Wiener index and global reaching centrality."""
    d = neighbourhoods(edges, lg)
    n = nodes.agg(F.count("*").alias("n"))
    far = d.groupBy(*KEYS, "node").agg(F.max("hops").alias("ecc"), F.sum("more").alias("reach"))
    a = d.groupBy(*KEYS).agg(F.sum("more").alias("pairs"), F.max("hops").alias("diameter"), F.sum(F.col("more") / F.col("hops")).alias("inverse"), F.sum(F.col("more") * F.col("hops")).alias("wiener"))
    b = far.groupBy(*KEYS).agg(F.min("ecc").alias("radius"), F.max("reach").alias("top"), F.sum("reach").alias("all"))
    x = a.join(b, KEYS).crossJoin(n)
    return x.select(*KEYS, "pairs", "diameter", "radius", F.round(F.col("wiener") / F.col("pairs"), 6).alias("mean_path"), F.round(F.col("inverse") / (F.col("n") * (F.col("n") - 1)), 6).alias("efficiency"), "wiener", F.round((F.col("top") * F.col("n") - F.col("all")) / ((F.col("n") - 1) * (F.col("n") - 1)), 6).alias("reaching"))


def closeness_sketch(edges: DataFrame, nodes: DataFrame, lg: int = 12) -> DataFrame:
    """The mean closeness of each graph by sketches of who reaches a node."""
    n = nodes.agg(F.count("*").alias("n"))
    near = neighbourhoods(edges, lg, inward=True).groupBy(*KEYS, "node").agg(F.sum("more").alias("r"), F.sum(F.col("more") * F.col("hops")).alias("far"))
    each = near.crossJoin(n).withColumn("c", F.col("r") * F.col("r") / (F.col("far") * (F.col("n") - 1)))
    return each.groupBy(*KEYS).agg(F.round(F.sum("c") / F.max("n"), 6).alias("closeness"))
