"""Simple cycles of any bounded length, counted by sets of visited nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paths import KEYS, _cut, strong_components


def cycles(edges: DataFrame, length: int = 6, trace: list | None = None) -> DataFrame:
    """(session, stimulus, size, cycles): how many simple directed cycles of 2 to ``length`` nodes each graph has; sizes without one have no row.

    A cycle is counted from its least node.  Only edges inside a strongly connected component can be on one.  Paths go over nodes above their start, and
    only as far as some way back to it, over such nodes, is short enough.  Paths from one start to one end over the same set of nodes go on
    alike: they are one row with a count, so that rows are sets and not orders.  Loops and repeated edges don't count.
    ``trace`` gets the number of rows of each step.
    """
    if length < 2:
        raise ValueError("a cycle has two nodes or more")
    part = strong_components(edges)
    own = edges.where("src <> dst").select(*KEYS, "src", "dst").dropDuplicates()
    end = lambda c: part.select(*KEYS, F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    step = _cut(own.join(end("src"), [*KEYS, "src"]).join(end("dst"), [*KEYS, "dst"]).where("src_part = dst_part").select(*KEYS, "src", "dst"))
    back = front = _cut(step.where("src > dst").select(*KEYS, F.col("dst").alias("start"), F.col("src").alias("node"), F.lit(1).alias("left")))
    for d in range(2, length):
        ahead = step.join(front.withColumnRenamed("node", "dst"), [*KEYS, "dst"]).where("src > start").select(*KEYS, "start", F.col("src").alias("node")).dropDuplicates()
        front = _cut(ahead.join(back, [*KEYS, "start", "node"], "left_anti").withColumn("left", F.lit(d)))
        if not front.limit(1).count():
            break
        back = _cut(back.union(front))
    paths = step.where("dst > src").select(*KEYS, F.col("src").alias("start"), F.col("dst").alias("node"))
    paths = _cut(paths.join(back, [*KEYS, "start", "node"]).where(F.col("left") < length).select(*KEYS, "start", "node", F.array("node").alias("seen"), F.lit(1).cast("long").alias("n"), "left"))
    found = None
    for size in range(2, length + 1):
        if trace is not None:
            trace.append(paths.count())
        closed = paths.where("left = 1").groupBy(*KEYS).agg(F.sum("n").alias("cycles")).select(*KEYS, F.lit(size).cast("long").alias("size"), "cycles")
        found = closed if found is None else found.union(closed)
        if size == length:
            break
        ahead = paths.drop("left").withColumnRenamed("node", "src").join(step, [*KEYS, "src"]).where("dst > start AND NOT array_contains(seen, dst)")
        ahead = ahead.join(back.withColumnRenamed("node", "dst"), [*KEYS, "start", "dst"]).where(F.col("left") < length - size + 1)
        ahead = ahead.select(*KEYS, "start", F.col("dst").alias("node"), F.array_sort(F.array_append("seen", F.col("dst"))).alias("seen"), "n", "left")
        paths = _cut(ahead.groupBy(*KEYS, "start", "node", "seen", "left").agg(F.sum("n").alias("n")).select(*KEYS, "start", "node", "seen", "n", "left"))
    return found
