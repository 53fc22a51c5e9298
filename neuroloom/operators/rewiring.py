"""Null graphs of one large graph, and small-worldness against random and lattice references.

Curveball trades rewire a graph by many tasks: nodes are paired anew in each round, and the two of a pair trade the
targets that only one of them has.  Whatever a trade does, both keep their number of targets and every target its number of
sources, so no trade needs to know of another, and no task holds more than two nodes' targets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .paths import KEYS, _cut, distances, largest_component
from .ranks import placed

REP = [*KEYS, "rep"]


def curveball(edges: DataFrame, replicas: int = 200, rounds: int = 20, seed: int = 3, bucket: int = 1000) -> DataFrame:
    """(session, stimulus, rep, src, dst, weight): replicas with every node's number of in- and out-going edges, without loops or repeats; weights dealt anew.

    Nodes meet in buckets of about ``bucket``, drawn anew in each round, and are paired there in a random order.  Loops and repeated edges of the
    graph are left out, with all but the least weight of a repeat.  Random numbers are hashes of (seed, rep, round, node), so results don't depend on partitions.
    """
    spark = edges.sparkSession
    own = edges.where("src <> dst").groupBy(*KEYS, "src", "dst").agg(F.min("weight").alias("weight"))
    reps = spark.range(replicas).select(F.col("id").cast("int").alias("rep"))
    outs = _cut(own.groupBy(*KEYS, "src").agg(F.collect_list("dst").alias("to")))  # who has no target has none to trade
    size = outs.groupBy(*KEYS).agg(F.ceil(F.count("*") / F.lit(bucket)).alias("buckets"))
    now = _cut(outs.join(size, KEYS).crossJoin(F.broadcast(reps)))
    for k in range(rounds):
        order = F.xxhash64(F.lit(seed), F.lit(k), "rep", "src")
        paired = now.withColumn("order", order).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(k), "rep", "src"), F.col("buckets")))
        line = Window.partitionBy(*REP, "part").orderBy("order", "src")
        paired = paired.withColumn("pair", F.floor((F.row_number().over(line) - 1) / 2))
        two = paired.groupBy(*REP, "part", "pair", "buckets").agg(F.sort_array(F.collect_list(F.struct("src", "to"))).alias("two"))
        a, b = F.col("two")[0], F.get("two", F.lit(1))
        two = two.select(*REP, "buckets", "part", "pair", a.src.alias("a"), b.src.alias("b"), a.to.alias("x"), F.coalesce(b.to, F.array().cast("array<bigint>")).alias("y"))
        # What only one has and the other may have, in a random order: as many as before go to the first.
        free_x, free_y = (F.array_except(F.array_except(p, q), F.array(o)) for p, q, o in (("x", "y", "b"), ("y", "x", "a")))
        two = two.withColumn("fx", F.when(F.col("b").isNull(), F.array().cast("array<bigint>")).otherwise(free_x)).withColumn("fy", F.when(F.col("b").isNull(), F.array().cast("array<bigint>")).otherwise(free_y))
        mixed = F.transform(F.array_sort(F.transform(F.concat("fx", "fy"), lambda v: F.struct(F.xxhash64(F.lit(seed + 2), F.lit(k), "rep", "a", v).alias("h"), v.alias("v")))), lambda s: s.v)
        two = two.withColumn("pool", mixed).withColumn("n", F.size("fx"))
        both = F.array(
            F.struct(F.col("a").alias("src"), F.concat(F.array_except("x", "fx"), F.slice("pool", F.lit(1), F.col("n"))).alias("to")),
            F.struct(F.col("b").alias("src"), F.concat(F.array_except("y", "fy"), F.slice("pool", F.col("n") + 1, F.size("pool"))).alias("to")),
        )
        each = two.select(*REP, "buckets", F.explode(both).alias("e")).where("e.src IS NOT NULL")
        now = _cut(each.select(*KEYS, "e.src", "e.to", "buckets", "rep"))
    links = now.select(*REP, "src", F.explode("to").alias("dst")).withColumn("h", F.xxhash64(F.lit(seed + 3), "rep", "src", "dst"))
    dealt = placed(links, REP, ["h", "src", "dst"])
    weights = placed(own.withColumn("h", F.lit(0)).select(*KEYS, "src", "dst", "weight"), KEYS, ["src", "dst"]).select(*KEYS, "place", "weight")
    return dealt.join(weights, [*KEYS, "place"]).select(*REP, "src", "dst", "weight")


def _connected(links: list[tuple[int, int]], n: int) -> bool:
    near = defaultdict(list)
    for a, b in links:
        near[a].append(b)
        near[b].append(a)
    seen, todo = {0}, [0]
    while todo:
        for v in near[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return len(seen) == n


def rewired_pairs(pairs: list[tuple[int, int]], n: int, swaps: int, lattice: bool, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Undirected links after ``swaps`` tries to exchange the ends of two; the graph stays connected.

    A lattice takes only exchanges that bring links nearer to the ring of nodes.
    """
    near = lambda a, b: min(abs(a - b), n - abs(a - b))
    links, held = list(pairs), {frozenset(p) for p in pairs}
    window = max(1, len(links) // 10)
    tried = 0
    while tried < swaps:
        before, done = (list(links), set(held)), 0
        for _ in range(min(window, swaps - tried)):
            tried += 1
            i, j = rng.integers(0, len(links), 2).tolist()
            (a, b), (c, d) = links[i], links[j]
            if rng.random() < 0.5:
                c, d = d, c
            if len({a, b, c, d}) < 4 or frozenset((a, d)) in held or frozenset((c, b)) in held:
                continue
            if lattice and near(a, d) + near(c, b) >= near(a, b) + near(c, d):
                continue
            held -= {frozenset((a, b)), frozenset((c, d))}
            held |= {frozenset((a, d)), frozenset((c, b))}
            links[i], links[j] = (a, d), (c, b)
            done += 1
        if done and not _connected(links, n):  # a whole window is taken back, and the next is shorter
            links, held = before
            window = max(1, window // 2)
    return links


def references(edges: DataFrame, replicas: int = 10, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(session, stimulus, kind, rep, src, dst): the undirected largest component of every graph (kind 'own'), and its random and lattice references.

    Both directions are in the table.  A replica is a task; it tries ``rounds`` exchanges a link.  Nodes are on the lattice's ring by their number.
    """
    own = largest_component(edges.where("src <> dst")).select(*KEYS, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).dropDuplicates()
    own = _cut(own)
    reps = edges.sparkSession.range(replicas).select(F.col("id").cast("int").alias("rep"), F.explode(F.array(F.lit("random"), F.lit("lattice"))).alias("kind"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["src", "dst"])
        first = g.iloc[0]
        ids, flat = np.unique(np.concatenate([g["src"], g["dst"]]), return_inverse=True)
        pairs = list(zip(flat[: len(g)].tolist(), flat[len(g) :].tolist()))
        rng = np.random.default_rng([seed, int(first["rep"]), first["kind"] == "lattice", zlib.crc32(f"{first['session']}|{first['stimulus']}".encode())])
        links = np.array(rewired_pairs(pairs, len(ids), rounds * len(pairs), first["kind"] == "lattice", rng))
        return pd.DataFrame({"session": first["session"], "stimulus": first["stimulus"], "kind": first["kind"], "rep": first["rep"], "src": ids[links[:, 0]], "dst": ids[links[:, 1]]})

    groups = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.crossJoin(F.broadcast(reps)).repartition(groups, *KEYS, "kind", "rep")
    made = rows.groupBy(*KEYS, "kind", "rep").applyInPandas(run, "session string, stimulus string, kind string, rep int, src long, dst long")
    both = made.union(own.select(*KEYS, F.lit("own"), F.lit(0), "src", "dst"))
    return _cut(both.union(both.select(*KEYS, "kind", "rep", "dst", "src")))


def small_world(edges: DataFrame, replicas: int = 10, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(session, stimulus, nodes, links, transitivity, path, sigma, omega) of the undirected form of every graph's largest weak component.

    sigma = (C / C_random) / (L / L_random), omega = L_random / L - C / C_lattice, with C the transitivity, L the mean shortest path and means over
    the references.  Directions, weights and loops don't count.  A component of at most two nodes or two links has sigma and omega 0; where a reference
    has no triangle the value is null.
    """
    table = references(edges, replicas, rounds, seed)
    graph = [*KEYS, "kind", "rep"]
    degree = table.groupBy(*graph, "src").agg(F.count("*").alias("d"))
    wedges = degree.groupBy(*graph).agg(F.count("*").alias("nodes"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("wedges"), (F.sum("d") / 2).cast("long").alias("links"))
    # A link goes up from the node with fewer links, so that a hub's wedges are few.
    rank = F.struct("d", "src")
    named = lambda c: degree.select(*graph, F.col("src").alias(c), rank.alias(f"{c}_rank"))
    up = _cut(table.join(named("src"), [*graph, "src"]).join(degree.select(*graph, F.col("src").alias("dst"), F.struct("d", "src").alias("dst_rank")), [*graph, "dst"]).where("src_rank < dst_rank").select(*graph, "src", "dst"))
    corners = up.withColumnRenamed("dst", "x").join(up.withColumnRenamed("dst", "y"), [*graph, "src"]).where("x <> y")
    triangles = corners.join(up.select(*graph, F.col("src").alias("x"), F.col("dst").alias("y")), [*graph, "x", "y"]).groupBy(*graph).agg(F.count("*").alias("triangles"))
    long_name = F.concat_ws(":", "kind", "rep", "stimulus").alias("stimulus")
    far = distances(table.select("session", long_name, "src", "dst")).groupBy(*KEYS).agg(F.avg("hops").alias("path"))
    far = far.select("session", F.split("stimulus", ":", 3).alias("s"), "path").select("session", F.col("s")[2].alias("stimulus"), F.col("s")[0].alias("kind"), F.col("s")[1].cast("int").alias("rep"), "path")
    each = wedges.join(triangles, graph, "left").join(far, graph).withColumn("c", 3 * F.coalesce("triangles", F.lit(0)) / F.when(F.col("wedges") > 0, F.col("wedges")))
    mean = lambda kind, c: F.avg(F.when(F.col("kind") == kind, F.col(c)))
    x = each.groupBy(*KEYS).agg(*[F.max(F.when(F.col("kind") == "own", F.col(c))).alias(c) for c in ("nodes", "links")], *[mean(k, c).alias(f"{c}_{k}") for k in ("own", "random", "lattice") for c in ("c", "path")])
    tiny = (F.col("nodes") <= 2) | (F.col("links") <= 2)
    over = lambda p, q: F.col(p) / F.nullif(F.col(q), F.lit(0.0))
    sigma = F.when(tiny, 0.0).otherwise(over("c_own", "c_random") / over("path_own", "path_random"))
    omega = F.when(tiny, 0.0).otherwise(over("path_random", "path_own") - over("c_own", "c_lattice"))
    return x.select(*KEYS, "nodes", "links", F.round("c_own", 6).alias("transitivity"), F.round("path_own", 6).alias("path"), F.round(sigma, 6).alias("sigma"), F.round(omega, 6).alias("omega"))
