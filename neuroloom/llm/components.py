"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of these edges but the roots; a root is its tree's least node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
        i, j = find(i), find(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    roots = np.fromiter((find(i) for i in range(len(nodes))), np.int64, len(nodes))
    kept = roots != np.arange(len(nodes))
    return nodes[kept], nodes[roots[kept]]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node on an edge (a, b); component is the least id reachable.

    Edges are first contracted within each partition, then rounds of star operations run on
    shuffled tables until nothing changes; each round's table is written to the shared folder.
    The driver sees a count and a checksum only.  Self-loops, repeats and nulls are ignored.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, root = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            node, root = forest(np.concatenate([node, a]), np.concatenate([root, b]))
            if len(node) > 1_000_000:  # bounded memory: hand on what there is
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])
                node, root = node[:0], root[:0]
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    start = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = staged(start.mapInArrow(local, "a long, b long").dropDuplicates(), "components")  # a > b throughout
    mark = None
    while True:
        got = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if got == mark or not got[0]:
            break
        mark = got
        # Large star: every neighbour above u is tied to the least of u and its neighbours.
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # Small star: u and its neighbours below it are tied to the least of them.
        large = large.dropDuplicates()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = staged(tied.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").dropDuplicates(), "components")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).dropDuplicates()
    return now.toDF("id", "component").union(roots)
