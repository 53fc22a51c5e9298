"""Random graphs that keep some property of each graph, one task a replica, and their checks.

A rewiring chain is sequential, so replicas are the unit of distribution: every (graph, replica)
is a group of its own with the graph's edge list, and its generator is seeded by both.  A chain goes
on until the wanted swaps are reached; only a graph that no pair of edges can change any more, which
is looked for once all pairs could have been proposed in vain, ends before.  Each output row tells the
swaps reached.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .sql import operator

SCHEMA = "session string, stimulus string, rep int, src long, dst long, weight double, swaps long"


def _rewired(src, dst, weight, model, swaps, rng):
    src, dst, weight, n = src.copy(), dst.copy(), weight.copy(), len(src)
    done = 0
    ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    size, sign = len(ids), np.sign(weight).tolist()
    src, dst = flat[:n].tolist(), flat[n:].tolist()
    where = {a * size + b: i for i, (a, b) in enumerate(zip(src, dst))}

    def kind(i: int) -> tuple:
        back = where.get(dst[i] * size + src[i])
        return () if model == "degree" else (back is None,) if model == "pair" else (back is None, sign[i], back is not None and sign[back])

    # Only edges of one kind swap, and no swap changes a kind: pairs are proposed within kinds, each pair as often as any other.
    kinds: dict[tuple, list[int]] = {}
    for i in range(n):
        kinds.setdefault(kind(i), []).append(i)
    members, count = np.array(sum(kinds.values(), [])), np.array([len(k) for k in kinds.values()])
    first, pairs = np.cumsum(count) - count, int((count**2).sum())

    def moves(i: int, j: int) -> tuple | None:
        a, b, c, d = src[i], dst[i], src[j], dst[j]
        if a * size + d in where or c * size + b in where or a == b or a == c or a == d or b == c or b == d or c == d:
            return None
        if model == "degree":
            return (i, a, d), (j, c, b)
        if d * size + a in where or b * size + c in where:
            return None
        back = where.get(b * size + a)
        if back is None:
            return (i, a, d), (j, c, b)
        return (i, a, d), (j, c, b), (back, b, c), (where[d * size + c], d, a)  # both pairs are mutual: their second arcs move too

    in_vain = 0
    while done < swaps:
        if in_vain >= pairs:
            if not any(moves(i, j) for k in kinds.values() for i in k for j in k):
                break
            in_vain = 0
        k = rng.choice(len(count), 4096, p=count**2 / pairs)
        drawn = members[first[k] + rng.integers(0, count[k], (2, 4096))]
        for i, j, other_end in np.vstack([drawn, rng.integers(0, 2, 4096)]).T.tolist():
            if done >= swaps:
                break
            moved = moves(i, j)
            if moved is None:
                in_vain += 1
                continue
            in_vain = 0
            for e, _, _ in moved:
                del where[src[e] * size + dst[e]]
            for e, x, y in moved:
                src[e], dst[e] = x, y
                where[x * size + y] = e
            if other_end:  # weights stay with either end of what is swapped, a mutual pair's together
                weight[[i, j]] = weight[[j, i]]
            elif len(moved) == 4:
                back, far = moved[2][0], moved[3][0]
                weight[[back, far]] = weight[[far, back]]
            done += len(moved) // 2
    src, dst = ids[src], ids[dst]
    return src, dst, weight if model == "signed_pair" else rng.permutation(weight), done


def erdos_renyi(edges: DataFrame, nodes: DataFrame, replicas: int = 200, seed: int = 3) -> DataFrame:
    """Replicas with the nodes, the number of edges and the weights of every graph, edges drawn uniformly without repeats.

    Pairs are numbered; each replica draws a third more numbers than it needs plus sixty-four, keeps distinct ones in a random order and
    tops up from all numbers only if it has too few, which a dense graph does from the start.
    """
    spark = edges.sparkSession
    place = nodes.select("node").dropDuplicates().withColumn("k", F.row_number().over(Window.orderBy("node")) - 1)  # as many rows as nodes
    n = nodes.select("node").dropDuplicates().count()
    pairs = n * (n - 1)
    own = edges.groupBy("session", "stimulus").agg(F.count("*").cast("long").alias("m"))
    if own.where(F.col("m") > pairs).limit(1).count():
        raise ValueError("a graph has more edges than there are pairs of nodes")
    reps = spark.range(replicas).select(F.col("id").cast("int").alias("rep"))
    want = own.crossJoin(F.broadcast(reps))
    id_of = F.xxhash64(F.lit(seed), "session", "stimulus", "rep", "draw")
    sparse = want.where(F.col("m") * 4 < pairs).withColumn("draw", F.explode(F.sequence(F.lit(0), (F.col("m") * F.lit(4) / 3 + 64).cast("int"))))
    sparse = sparse.withColumn("pair", F.pmod(id_of, F.lit(max(pairs, 1)))).groupBy("session", "stimulus", "rep", "m", "pair").agg(F.min(id_of).alias("mark"))
    short = sparse.groupBy("session", "stimulus", "rep", "m").count().where("count < m").select("session", "stimulus", "rep")
    dense = want.where(F.col("m") * 4 >= pairs).select("session", "stimulus", "rep", "m").union(want.join(short, ["session", "stimulus", "rep"], "left_semi").select("session", "stimulus", "rep", "m"))
    dense = dense.withColumn("pair", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(pairs, 1) - 1).cast("long"))))
    dense = dense.withColumn("mark", F.xxhash64(F.lit(seed), "session", "stimulus", "rep", "pair"))
    both = sparse.join(short, ["session", "stimulus", "rep"], "left_anti").select(*dense.columns).union(dense)
    group = Window.partitionBy("session", "stimulus", "rep").orderBy("mark", "pair")
    drawn = both.withColumn("k", F.row_number().over(group)).where("k <= m")
    line = Window.partitionBy("session", "stimulus").orderBy("src", "dst")
    weights = edges.select("session", "stimulus", "weight", F.row_number().over(line).alias("k"))
    drawn = drawn.join(weights, ["session", "stimulus", "k"])  # in the random order of the draws
    a, b = F.floor(F.col("pair") / F.lit(max(n - 1, 1))).cast("long"), F.pmod("pair", F.lit(max(n - 1, 1)))
    drawn = drawn.withColumn("a", a).withColumn("b", b).withColumn("b", F.col("b") + (F.col("b") >= F.col("a")).cast("long"))
    src, dst = place.select(F.col("k").cast("long").alias("a"), F.col("node").alias("src")), place.select(F.col("k").cast("long").alias("b"), F.col("node").alias("dst"))
    return drawn.join(src, "a").join(dst, "b").select("session", "stimulus", "rep", "src", "dst", "weight", F.col("m").alias("swaps"))


def random_graphs(edges: DataFrame, nodes: DataFrame, model: str, replicas: int = 200, rounds: int = 100, seed: int = 3) -> DataFrame:
    """Replicas of every graph; ``model``: random (nodes and edges kept), degree, pair or signed_pair."""
    if model not in ("random", "degree", "pair", "signed_pair"):
        raise ValueError(model)
    if model == "random":
        return erdos_renyi(edges, nodes, replicas, seed)
    reps = edges.sparkSession.range(replicas).select(F.col("id").cast("int").alias("rep"))
    rows = edges.select("session", "stimulus", "src", "dst", "weight").crossJoin(F.broadcast(reps))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["src", "dst"])
        first = g.iloc[0]
        rng = np.random.default_rng([seed, int(first["rep"]), zlib.crc32(f"{first['session']}|{first['stimulus']}".encode())])
        s, d, w, done = _rewired(g["src"].to_numpy(), g["dst"].to_numpy(), g["weight"].to_numpy(), model, rounds * len(g), rng)
        return pd.DataFrame({"session": first["session"], "stimulus": first["stimulus"], "rep": first["rep"], "src": s, "dst": d, "weight": w, "swaps": done})

    groups = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(groups, "session", "stimulus", "rep")  # many small groups: not to be coalesced
    return rows.groupBy("session", "stimulus", "rep").applyInPandas(run, SCHEMA)


def verify(edges: DataFrame, replicas: DataFrame) -> DataFrame:
    """By session, stimulus and replica: whether edges, weights, degrees, pairs and signed pairs are kept, each compared in full."""
    graph = ["session", "stimulus"]
    rep = [*graph, "rep"]
    replicas = staged(replicas, "replicas")  # read by every test, drawn once
    reps = replicas.select(*rep).dropDuplicates()
    own = edges.select(*graph, "src", "dst", "weight")
    new = replicas.select(*rep, "src", "dst", "weight")

    def differ(mark: str, tell) -> DataFrame:
        """Replicas in which some value of ``tell`` (name, value) is not the graph's."""
        a = tell(own, graph).join(reps, graph)
        b = tell(new, rep).withColumnRenamed("value", "got")
        both = a.join(b, [*rep, "name"], "full").where(~F.col("value").eqNullSafe(F.col("got")))
        return both.select(*rep).dropDuplicates().withColumn(mark, F.lit(False))

    named = lambda df, keys, name, value: df.groupBy(*keys, name.alias("name")).agg(value.alias("value"))
    number, one = F.count("*").cast("string"), F.lit("all")
    tests = {
        "edges": lambda d, k: named(d.where("src <> dst").dropDuplicates([*k, "src", "dst"]), k, one, number),
        "weights": lambda d, k: named(d, k, F.round("weight", 9).cast("string"), number),
        "degrees": lambda d, k: named(d, k, F.concat(F.lit("out "), "src"), number).union(named(d, k, F.concat(F.lit("in "), "dst"), number)),
    }

    def classes(signed: bool):
        def tell(d: DataFrame, k: list[str]) -> DataFrame:
            sign = F.sign("weight").cast("int") if signed else F.lit(0)
            pair = d.groupBy(*k, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sort_array(F.collect_list(sign)).cast("string").alias("class"))
            return named(pair, k, F.col("class"), number)

        return tell

    tests |= {"pairs": classes(False), "signed_pairs": classes(True)}
    out = reps
    for mark, tell in tests.items():
        out = out.join(differ(mark, tell), rep, "left").withColumn(mark, F.coalesce(mark, F.lit(True)))
    return out


# Weights dealt anew over the same edges, by rank of a hash: the multiset stays.
weight_shuffle = operator("weight_shuffle", """
WITH a AS (SELECT session, stimulus, src, dst, row_number() OVER (PARTITION BY session, stimulus ORDER BY (src * 7919 + dst * 104729) % 1009, src, dst) AS k FROM {edges}),
b AS (SELECT session, stimulus, weight, row_number() OVER (PARTITION BY session, stimulus ORDER BY src, dst) AS k FROM {edges})
SELECT a.session, a.stimulus, src, dst, weight FROM a JOIN b ON a.session = b.session AND a.stimulus = b.stimulus AND a.k = b.k""")


def dealt_weights(replicas: int = 97):
    """(session, stimulus, rep, src, dst, weight): every graph with its weights dealt anew ``replicas`` times, in the order of an arithmetic hash that any engine repeats."""
    return operator("dealt_weights", f"""
WITH r AS (SELECT SERIES(0, {replicas - 1}) AS rep),
a AS (SELECT session, stimulus, rep, src, dst, row_number() OVER (PARTITION BY session, stimulus, rep ORDER BY (src * 7919 + dst * 104729 + (rep + 1) * (src * 613 + dst * 389 + 1)) % 10007 * (rep + 37) % 9973, src, dst) AS k FROM {{edges}} CROSS JOIN r),
b AS (SELECT session, stimulus, weight, row_number() OVER (PARTITION BY session, stimulus ORDER BY src, dst) AS k FROM {{edges}})
SELECT a.session, a.stimulus, CAST(rep AS INT) AS rep, src, dst, weight FROM a JOIN b ON a.session = b.session AND a.stimulus = b.stimulus AND a.k = b.k""")


dealt = dealt_weights()
