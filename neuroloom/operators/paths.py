"""Reachability and distances by rounds of joins; every round is written to the shared folder, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

KEYS = ["session", "stimulus"]


def _cut(df: DataFrame) -> DataFrame:
    return staged(df, "rounds")


def weak_components(edges: DataFrame) -> DataFrame:
    """(session, stimulus, node, component): the least node reachable along edges of either direction.

    Large-star and small-star rounds (Kiveris et al. 2014): as many as the logarithm of the longest path, not as its length.
    """
    every = edges.select(*KEYS, F.col("src").alias("node")).union(edges.select(*KEYS, "dst")).dropDuplicates()
    high, low = F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")
    now, mark = _cut(edges.where("src <> dst").select(*KEYS, high, low).dropDuplicates()), None
    while True:
        got = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64(*KEYS, "a", "b"))).first())
        if got == mark or not got[0]:
            break
        mark = got
        both = now.union(now.select(*KEYS, "b", "a")).toDF(*KEYS, "u", "v")
        least = both.groupBy(*KEYS, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, [*KEYS, "u"]).select(*KEYS, F.col("v").alias("a"), F.col("m").alias("b")).dropDuplicates()
        tied = large.join(large.groupBy(*KEYS, "a").agg(F.min("b").alias("m")), [*KEYS, "a"])
        ends = F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")
        now = _cut(tied.select(*KEYS, ends).select(*KEYS, F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").dropDuplicates())
    found = now.select(*KEYS, F.col("a").alias("node"), F.col("b").alias("component"))
    return every.join(found, [*KEYS, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges inside each graph's largest weak component (the one with the least node on ties)."""
    label = weak_components(edges)
    best = label.groupBy(*KEYS, "component").count().groupBy(*KEYS).agg(F.max(F.struct("count", -F.col("component"))).alias("m")).select(*KEYS, (-F.col("m").getField("col2")).alias("component"))
    kept = label.join(best, [*KEYS, "component"]).select(*KEYS, F.col("node").alias("src"))
    return edges.join(kept, [*KEYS, "src"], "left_semi")


def strong_components(edges: DataFrame) -> DataFrame:
    """(session, stimulus, node, component): strongly connected components, each named by its least node.

    Rounds of colouring: every node takes the least node that reaches it; the nodes that reach their colour's node back, within the
    colour, are its component and leave.  Nodes that cannot be on a cycle leave at the start of a round.
    """
    left = _cut(edges.select(*KEYS, "src", "dst").where("src <> dst").dropDuplicates())
    every = edges.select(*KEYS, F.col("src").alias("node")).union(edges.select(*KEYS, "dst")).dropDuplicates()
    done = None
    ends = lambda e, c: e.select(*KEYS, F.col(c).alias("node")).dropDuplicates()
    while left.limit(1).count():
        inner = ends(left, "src").join(ends(left, "dst"), [*KEYS, "node"], "left_semi")  # the others are components by themselves
        on = lambda e, c: e.join(inner.withColumnRenamed("node", c), [*KEYS, c], "left_semi")
        kept = _cut(on(on(left, "src"), "dst"))
        if kept.count() < left.count():
            left = kept
            continue
        colour = _cut(inner.withColumn("colour", F.col("node")))
        while True:  # forward: the least node that reaches each
            seen = left.join(colour.withColumnRenamed("node", "src"), [*KEYS, "src"]).groupBy(*KEYS, F.col("dst").alias("node")).agg(F.min("colour").alias("near"))
            new = _cut(colour.join(seen, [*KEYS, "node"], "left").withColumn("less", F.least("colour", F.coalesce("near", "colour"))))
            same = not new.where("less < colour").limit(1).count()
            colour = new.select(*KEYS, "node", F.col("less").alias("colour"))
            if same:
                break
        own = lambda end: colour.withColumnRenamed("node", end).withColumnRenamed("colour", f"{end}_colour")
        inside = _cut(left.join(own("src"), [*KEYS, "src"]).join(own("dst"), [*KEYS, "dst"]).where("src_colour = dst_colour").select(*KEYS, "src", "dst"))
        back = front = _cut(colour.where("node = colour"))
        while front.limit(1).count():  # backward: who reaches its colour's node
            step = inside.join(front.withColumnRenamed("node", "dst"), [*KEYS, "dst"]).select(*KEYS, F.col("src").alias("node"), "colour").dropDuplicates()
            front = _cut(step.join(back, [*KEYS, "node", "colour"], "left_anti"))
            back = _cut(back.union(front))
        done = back if done is None else _cut(done.union(back))
        out = lambda c: back.select(*KEYS, F.col("node").alias(c))
        left = _cut(left.join(out("src"), [*KEYS, "src"], "left_anti").join(out("dst"), [*KEYS, "dst"], "left_anti"))
    if done is None:
        return every.withColumn("component", F.col("node"))
    return every.join(done.withColumnRenamed("colour", "component"), [*KEYS, "node"], "left").select(*KEYS, "node", F.coalesce("component", "node").alias("component"))


def largest_strong(edges: DataFrame) -> DataFrame:
    """The edges inside each graph's largest strongly connected component (the one with the least node on ties)."""
    label = strong_components(edges)
    best = label.groupBy(*KEYS, "component").count().groupBy(*KEYS).agg(F.max(F.struct("count", (-F.col("component")).alias("c"))).alias("m")).select(*KEYS, (-F.col("m.c")).alias("component"))
    kept = label.join(best, [*KEYS, "component"]).select(*KEYS, "node")
    for end in ("src", "dst"):
        edges = edges.join(kept.withColumnRenamed("node", end), [*KEYS, end], "left_semi")
    return edges


def distances(edges: DataFrame) -> DataFrame:
    """(session, stimulus, src, dst, hops): shortest directed paths between all pairs that have one, breadth first."""
    step = _cut(edges.select(*KEYS, "src", "dst").dropDuplicates())
    found, front, hops = _cut(step.withColumn("hops", F.lit(1).cast("long"))), step, 1
    while True:
        hops += 1
        ahead = front.withColumnRenamed("dst", "mid").join(step.withColumnRenamed("src", "mid"), [*KEYS, "mid"]).where("src <> dst").select(*KEYS, "src", "dst").dropDuplicates()
        front = _cut(ahead.join(found, [*KEYS, "src", "dst"], "left_anti"))
        if not front.limit(1).count():
            return found
        found = _cut(found.union(front.withColumn("hops", F.lit(hops).cast("long"))))


def path_metrics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """By graph: reachable pairs, diameter and radius over them, mean path, efficiency, Wiener index and global reaching centrality."""
    d = distances(edges)
    n = nodes.agg(F.count("*").alias("n"))
    far = d.groupBy(*KEYS, "src").agg(F.max("hops").alias("ecc"), F.count("*").alias("reach"))
    a = d.groupBy(*KEYS).agg(F.count("*").alias("pairs"), F.max("hops").alias("diameter"), F.avg("hops").alias("mean"), F.sum(1 / F.col("hops")).alias("inverse"), F.sum("hops").alias("wiener"))
    b = far.groupBy(*KEYS).agg(F.min("ecc").alias("radius"), F.max("reach").alias("top"), F.sum("reach").alias("all"))
    x = a.join(b, KEYS).crossJoin(n)
    return x.select(*KEYS, "pairs", "diameter", "radius", F.round("mean", 6).alias("mean_path"), F.round(F.col("inverse") / (F.col("n") * (F.col("n") - 1)), 6).alias("efficiency"), "wiener", F.round((F.col("top") * F.col("n") - F.col("all")) / ((F.col("n") - 1) * (F.col("n") - 1)), 6).alias("reaching"))


def flow_hierarchy(edges: DataFrame) -> DataFrame:
    """By graph: the share of edges on no cycle, which are those between strongly connected components."""
    label = strong_components(edges)
    ends = lambda c: label.select(*KEYS, F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    both = edges.join(ends("src"), [*KEYS, "src"]).join(ends("dst"), [*KEYS, "dst"])
    return both.groupBy(*KEYS).agg(F.round(F.avg(F.when(F.col("src_part") == F.col("dst_part"), 0.0).otherwise(1.0)), 6).alias("hierarchy"))
