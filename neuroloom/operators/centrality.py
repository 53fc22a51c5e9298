"""Closeness, betweenness and short cycles of every graph."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import KEYS, _cut, distances
from .sql import operator


def closeness(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """By graph: the mean over all nodes of (r / (N - 1)) (r / sum of distances), for the r nodes that reach a node; 0 where none does."""
    n = nodes.agg(F.count("*").alias("n"))
    near = distances(edges).groupBy(*KEYS, "dst").agg(F.count("*").alias("r"), F.sum("hops").alias("far"))
    each = near.crossJoin(n).withColumn("c", F.col("r") * F.col("r") / (F.col("far") * (F.col("n") - 1)))
    return each.groupBy(*KEYS).agg(F.round(F.sum("c") / F.max("n"), 6).alias("closeness"))


def shares(links: dict[int, list[tuple[int, float]]], source: int) -> dict[int, float]:
    """For each node the share of shortest paths from ``source`` to any other that pass through it (Brandes 2001; lengths above 0)."""
    far, paths, before, done = {source: 0.0}, defaultdict(float, {source: 1.0}), defaultdict(list), []
    heap, closed = [(0.0, source)], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in closed:
            continue
        closed.add(v)
        done.append(v)
        for w, length in links.get(v, ()):
            reach = d + length
            if w not in far or reach < far[w] - 1e-12:
                far[w], paths[w], before[w] = reach, paths[v], [v]
                heapq.heappush(heap, (reach, w))
            elif abs(reach - far[w]) <= 1e-12:
                paths[w] += paths[v]
                before[w].append(v)
    passed: dict[int, float] = defaultdict(float)
    for w in reversed(done):
        for v in before[w]:
            passed[v] += paths[v] / paths[w] * (1 + passed[w])
    passed.pop(source, None)
    return passed


def by_groups(edges: DataFrame, blocks: int = 8) -> DataFrame:
    """(session, stimulus, node, sum): pair dependencies of every node; sources are dealt out in ``blocks`` groups a graph, each with the graph's edges."""
    block = edges.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        links = defaultdict(list)
        for a, b, w in zip(g["src"].tolist(), g["dst"].tolist(), g["weight"].abs().tolist()):
            links[a].append((b, w))
        total: dict[int, float] = defaultdict(float)
        for s in sorted(links):
            if s % blocks == g["block"].iloc[0]:
                for v, x in shares(links, s).items():
                    total[v] += x
        return pd.DataFrame({"session": g["session"].iloc[0], "stimulus": g["stimulus"].iloc[0], "node": list(total), "part": list(total.values())}).astype({"node": "int64", "part": "float64"})

    rows = edges.where("weight <> 0").select(*KEYS, "src", "dst", "weight").crossJoin(F.broadcast(block))
    parts = rows.groupBy(*KEYS, "block").applyInPandas(run, "session string, stimulus string, node long, part double")
    return parts.groupBy(*KEYS, "node").agg(F.sum("part").alias("sum"))


def by_messages(edges: DataFrame, blocks: int = 8) -> DataFrame:
    """The same as messages along partitioned edges: no task holds a graph.

    For a block of sources: lengths are relaxed until none falls; edges on shortest paths remain; path counts go forward and
    dependencies backward, a node's once all its neighbours there have sent theirs.  State is (sources of a block) x (nodes they reach).
    """
    step = _cut(edges.where("weight <> 0 AND src <> dst").groupBy(*KEYS, F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.min(F.abs("weight")).alias("length")))
    every = step.select(*KEYS, F.col("a").alias("s")).dropDuplicates()
    pair = [*KEYS, "s"]

    def swept(links: DataFrame, begin: DataFrame, worth) -> DataFrame:
        """(pair, node, value) of all nodes, from those of ``begin`` on; links (pair, a, b, ...) lead to b; ``worth`` of a link is what it adds to b."""
        degree = _cut(links.groupBy(*pair, "b").agg(F.count("*").alias("degree")))
        done = front = begin
        waiting = None
        while True:
            sent = front.withColumnRenamed("node", "a").join(links, [*pair, "a"]).select(*pair, "b", worth.alias("value"), F.lit(1).cast("long").alias("n"))
            waiting = sent if waiting is None else sent.union(waiting)
            waiting = _cut(waiting.groupBy(*pair, "b").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).join(degree, [*pair, "b"]))
            front = waiting.where("n = degree").select(*pair, F.col("b").alias("node"), "value")
            if not front.limit(1).count():
                return done
            done = _cut(done.union(front))
            waiting = waiting.where("n < degree").select(*pair, "b", "value", "n")

    total = None
    for k in range(blocks):
        far = front = _cut(every.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == k).select(*pair, F.col("s").alias("node"), F.lit(0.0).alias("far")))
        while front.limit(1).count():
            reach = front.withColumnRenamed("node", "a").join(step, [*KEYS, "a"]).groupBy(*pair, F.col("b").alias("node")).agg(F.min(F.col("far") + F.col("length")).alias("new"))
            both = _cut(far.join(reach, [*pair, "node"], "full"))
            fell = F.col("far").isNull() | (F.col("new") < F.col("far") - 1e-12)
            front = both.where(fell).select(*pair, "node", F.col("new").alias("far"))
            far = both.select(*pair, "node", F.when(fell, F.col("new")).otherwise(F.col("far")).alias("far"))
        on = far.withColumnRenamed("node", "a").withColumnRenamed("far", "far_a").join(step, [*KEYS, "a"]).join(far.withColumnRenamed("node", "b").withColumnRenamed("far", "far_b"), [*pair, "b"])
        links = _cut(on.where(F.abs(F.col("far_a") + F.col("length") - F.col("far_b")) <= 1e-12).select(*pair, "a", "b"))
        start = _cut(links.where("a = s").select(*pair, F.col("s").alias("node"), F.lit(1.0).alias("value")).dropDuplicates())
        paths = swept(links, start, F.col("value"))
        count = lambda c: paths.select(*pair, F.col("node").alias(c), F.col("value").alias(f"paths_{c}"))
        back = _cut(links.join(count("a"), [*pair, "a"]).join(count("b"), [*pair, "b"]).select(*pair, F.col("b").alias("a"), F.col("a").alias("b"), (F.col("paths_a") / F.col("paths_b")).alias("share")))
        last = _cut(paths.select(*pair, "node").join(back.select(*pair, F.col("b").alias("node")), [*pair, "node"], "left_anti").withColumn("value", F.lit(0.0)))
        passed = swept(back, last, F.col("share") * (1 + F.col("value"))).where("node <> s").groupBy(*KEYS, "node").agg(F.sum("value").alias("sum"))
        total = passed if total is None else total.union(passed)
    return total.groupBy(*KEYS, "node").agg(F.sum("sum").alias("sum")).where("sum > 0")


def betweenness(edges: DataFrame, nodes: DataFrame, blocks: int = 8, small: int = 200_000) -> DataFrame:
    """By graph and node: the share of shortest paths between other nodes that pass through it; an edge is as long as its weight's size.

    Isolated nodes have 0.  Graphs are groups of tasks as long as none has more than ``small`` edges, else messages.
    """
    graphs = edges.groupBy(*KEYS).agg(F.count("*").alias("m"))
    most = graphs.agg(F.max("m")).first()[0] or 0
    found = by_groups(edges, blocks) if most <= small else by_messages(edges, blocks)
    n = nodes.agg(F.count("*").alias("n"))
    grid = graphs.select(*KEYS).crossJoin(nodes.select("node")).crossJoin(n)  # as many rows as the result
    scaled = F.coalesce("sum", F.lit(0.0)) / F.greatest(F.lit(1), (F.col("n") - 1) * (F.col("n") - 2))
    return grid.join(found, [*KEYS, "node"], "left").select(*KEYS, "node", F.round(scaled, 9).alias("betweenness"))


# Simple cycles of two to four nodes, each once: from its least node.
short_cycles = operator("short_cycles", """
WITH two AS (SELECT a.session, a.stimulus, a.src AS p, a.dst AS q FROM {edges} a WHERE a.src < a.dst),
far AS (SELECT t.session, t.stimulus, p, q, b.dst AS r FROM two t JOIN {edges} b ON b.session = t.session AND b.stimulus = t.stimulus AND b.src = q AND b.dst >= p),
deep AS (SELECT f.session, f.stimulus, p, q, r, c.dst AS s FROM far f JOIN {edges} c ON c.session = f.session AND c.stimulus = f.stimulus AND c.src = r AND c.dst >= p AND c.dst <> q WHERE r > p),
last AS (SELECT d.session, d.stimulus, count(*) AS n FROM deep d JOIN {edges} e ON e.session = d.session AND e.stimulus = d.stimulus AND e.src = s AND e.dst = p WHERE s > p GROUP BY d.session, d.stimulus),
n AS (SELECT session, stimulus, 2 AS size, count(*) AS cycles FROM far WHERE r = p GROUP BY session, stimulus
  UNION ALL SELECT session, stimulus, 3, count(*) FROM deep WHERE s = p GROUP BY session, stimulus UNION ALL SELECT session, stimulus, 4, n FROM last)
SELECT session, stimulus, CAST(size AS BIGINT) AS size, CAST(cycles AS BIGINT) AS cycles FROM n""")
