"""Communities of signed digraphs by a Louvain method whose rounds are parallel and never raise the energy.

Energy of a partition at resolutions (pos, neg): minus the weights inside communities, plus L times the sum of squared community
sizes, where L = (pos P - neg N) / n^2 for the sums P and N of positive and of negative weights over n nodes.  A round takes every
node's best move, to a neighbour's community or to one of its own.  Of moves that touch the same community only the best is made:
moves that share no community change the energy by the sum of what each changes, so they can be made at once, and more
strictly than with a colouring, in which two nodes could still enter one community.  When no move is left, or after ``sweeps`` rounds,
communities become the nodes of a smaller graph.  Communities are named by their least node throughout, and random numbers belong to
(run, round, node), so results depend neither on partitions nor on which of two forms is used: small graphs, many cells and
runs of them at once, by dense arrays in a task each; large graphs by joins on (node, neighbour community).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from .paths import KEYS, _cut

PRIME, STEP = 2147483647, 48271  # of the random numbers: x -> 48271 x mod (2^31 - 1)
CELL = [*KEYS, "pos", "neg", "run"]
LEAST = 1e-9  # a smaller gain is none
FOUND = "session string, stimulus string, pos double, neg double, run int, node long, comm long, energy double"


def _mark(node, turn, run):
    """A number below 2^31 for each node, the same in Spark and NumPy."""
    return ((node % PRIME + 1) * STEP + (turn + 1) * 69621 + (run + 1) * 16807) % PRIME * STEP % PRIME


def dense(weights: np.ndarray, bound: np.ndarray, runs: np.ndarray, ids: np.ndarray, sweeps: int = 16, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(community as a place in ``ids``, energy) for a batch of cells and runs of one graph; ``weights`` (cells x n x n, w_ij + w_ji off the diagonal), ``bound``: L."""
    cells, n, _ = weights.shape
    at = np.arange(n)
    a, inside = weights.copy(), np.zeros((cells, n))  # ``inside``: twice the weights within a level's nodes
    size = np.ones((cells, n))
    whole = np.tile(at, (cells, 1))  # community of each first node
    turn, lam = 0, bound[:, None, None]
    while True:
        comm, moved = np.tile(at, (cells, 1)), False
        comm[size == 0] = -1
        for _ in range(sweeps):
            member = (comm[:, :, None] == at) * 1.0  # cells x node x community
            k = a @ member
            total = np.einsum("bnc,bn->bc", member, size)
            own = np.maximum(comm, 0)[:, :, None]
            k_own, s_own = np.take_along_axis(k, own, 2), np.take_along_axis(np.broadcast_to(total[:, None, :], k.shape), own, 2)
            mine = size[:, :, None]
            gain = k - k_own - 2 * lam * mine * (total[:, None, :] - s_own + mine)
            linked = (np.abs(a) > 0).astype(float) @ member > 0
            gain[~linked | (member > 0) | (total[:, None, :] == 0)] = -np.inf
            alone = (-k_own - 2 * lam * mine * (mine - s_own))[:, :, 0]
            alone[(s_own - mine)[:, :, 0] <= 0] = -np.inf
            gain = np.concatenate([gain, alone[:, :, None]], 2)
            gain[comm < 0] = -np.inf
            gain = np.where(np.isfinite(gain), np.round(gain, 9), gain)
            # Ties go to the community of the least node; one of its own counts as the node itself.
            order = np.concatenate([np.broadcast_to(at, (cells, n, n)), np.broadcast_to(at[:, None], (cells, n, 1))], 2)
            top = gain.max(2)
            best = np.where(gain == top[:, :, None], order, n + 1).min(2)
            solo = gain[:, :, n] == top
            solo &= best == at
            asks = top > LEAST
            if not asks.any():
                break
            mark = _mark(ids[None, :], turn, runs[:, None])
            turn += 1
            asks &= mark % 2 == 0
            # The best proposal at each community, by gain, then mark, then node.
            rank = np.empty((cells, n), np.int64)
            order = np.lexsort((np.broadcast_to(at, (cells, n)), mark, -np.where(asks, top, -np.inf)), axis=1)
            np.put_along_axis(rank, order, np.broadcast_to(at, (cells, n)), 1)
            first = np.full((cells, n), n)
            row = np.broadcast_to(np.arange(cells)[:, None], (cells, n))
            np.minimum.at(first, (row[asks], comm[asks]), rank[asks])
            into = asks & ~solo
            np.minimum.at(first, (row[into], best[into]), rank[into])
            wins = asks & (np.take_along_axis(first, np.maximum(comm, 0), 1) == rank) & (solo | (np.take_along_axis(first, best, 1) == rank))
            if wins.any():
                moved = True
                label = np.where(wins, np.where(solo, n + at, best), comm)  # a community of its own until it is named
                least = np.full((cells, 2 * n), 2 * n)
                live = label >= 0
                np.minimum.at(least, (row[live], label[live]), np.broadcast_to(at, (cells, n))[live])
                comm = np.where(live, np.take_along_axis(least, np.maximum(label, 0), 1), -1)
            if trace is not None:
                m = (comm[:, :, None] == at) * 1.0
                trace.append(-(inside.sum(1) + np.einsum("bij,bik,bjk->b", a, m, m)) / 2 + bound * (np.einsum("bnc,bn->bc", m, size) ** 2).sum(1))
        member = (comm[:, :, None] == at) * 1.0
        joined = np.swapaxes(member, 1, 2) @ a @ member
        inside = np.einsum("bn,bnc->bc", inside, member) + np.einsum("bcc->bc", joined)
        a = joined
        a[:, at, at] = 0
        size = np.einsum("bn,bnc->bc", size, member)
        whole = np.take_along_axis(comm, whole, 1)
        if not moved:
            return whole, bound * (size**2).sum(1) - inside.sum(1) / 2


def _totals(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session, stimulus, p, q): positive and negative weights over the number of nodes squared."""
    n = nodes.select("node").dropDuplicates().agg(F.count("*").alias("n"))
    one = lambda s: F.sum(F.greatest(s * F.col("weight"), F.lit(0.0)))
    return edges.groupBy(*KEYS).agg(one(1).alias("p"), one(-1).alias("q")).crossJoin(F.broadcast(n)).select(*KEYS, (F.col("p") / F.col("n") ** 2).alias("p"), (F.col("q") / F.col("n") ** 2).alias("q"))


def _energy(state: DataFrame, links: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, energy) of a partition; links: (cell, a, b, w) between first nodes, one row an edge and direction summed."""
    inner = links.join(state.select(*CELL, F.col("node").alias("a"), F.col("comm").alias("x")), [*CELL, "a"]).join(state.select(*CELL, F.col("node").alias("b"), F.col("comm").alias("y")), [*CELL, "b"])
    inner = inner.where("x = y").groupBy(*CELL).agg((F.sum("w") / 2).alias("inner"))
    square = state.groupBy(*CELL, "comm").agg(F.sum("size").alias("s")).groupBy(*CELL).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    return square.join(cells, CELL).join(inner, CELL, "left").select(*CELL, (F.col("bound") * F.col("square") - F.coalesce("inner", F.lit(0.0))).alias("energy"))


def by_joins(edges: DataFrame, nodes: DataFrame, cells: DataFrame, sweeps: int = 16, trace: list | None = None) -> DataFrame:
    """Partitions of graphs of any size; cells: (session, stimulus, pos, neg, run, bound).  Each round is written to the shared folder; the driver sees counts."""
    spark = edges.sparkSession
    both = edges.where("src <> dst").select(*KEYS, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"))
    both = both.union(both.select(*KEYS, "b", "a", "w")).groupBy(*KEYS, "a", "b").agg(F.sum("w").alias("w"))
    cells = _cut(cells)
    first = links = _cut(both.join(cells.select(*CELL), KEYS).select(*CELL, "a", "b", "w"))
    whole = _cut(cells.select(*CELL).crossJoin(nodes.select("node").dropDuplicates()).withColumn("comm", F.col("node")))
    state = _cut(whole.withColumn("size", F.lit(1.0)))
    turn = 0
    while True:
        moved = False
        for _ in range(sweeps):
            sizes = state.groupBy(*CELL, "comm").agg(F.sum("size").alias("s"))
            near = links.join(state.select(*CELL, F.col("node").alias("b"), F.col("comm").alias("d")), [*CELL, "b"]).groupBy(*CELL, F.col("a").alias("node"), "d").agg(F.sum("w").alias("k"))
            own = state.join(sizes, [*CELL, "comm"]).join(near.withColumnRenamed("d", "comm").withColumnRenamed("k", "k_own"), [*CELL, "node", "comm"], "left").withColumn("k_own", F.coalesce("k_own", F.lit(0.0))).join(cells, CELL)
            gain = lambda k, s: F.round(k - F.col("k_own") - 2 * F.col("bound") * F.col("size") * (s - F.col("s") + F.col("size")), 9)
            there = own.join(near, [*CELL, "node"]).where("d <> comm").join(sizes.select(*CELL, F.col("comm").alias("d"), F.col("s").alias("s_there")), [*CELL, "d"])
            there = there.select(*CELL, "node", "comm", "d", F.lit(False).alias("solo"), gain(F.col("k"), F.col("s_there")).alias("gain"))
            alone = own.where("s > size").select(*CELL, "node", "comm", F.col("node").alias("d"), F.lit(True).alias("solo"), gain(F.lit(0.0), F.lit(0.0)).alias("gain"))
            best = there.union(alone).where(F.col("gain") > LEAST).groupBy(*CELL, "node", "comm").agg(F.max_by(F.struct("d", "solo"), F.struct("gain", (-F.col("d")).alias("d"))).alias("to"), F.max("gain").alias("gain"))
            best = _cut(best.select(*CELL, "node", "comm", "to.d", "to.solo", "gain"))
            if not best.limit(1).count():
                break
            mark = _mark(F.pmod("node", F.lit(PRIME)), F.lit(turn).cast("long"), F.col("run").cast("long"))
            turn += 1
            asks = best.withColumn("mark", mark).where("mark % 2 = 0")
            touch = asks.withColumn("at", F.explode(F.expr("IF(solo, array(comm), array(comm, d))")))
            line = Window.partitionBy(*CELL, "at").orderBy(F.col("gain").desc(), "mark", "node")
            wins = touch.withColumn("first", (F.row_number().over(line) == 1).cast("int")).groupBy(*CELL, "node", "d", "solo").agg(F.min("first").alias("first")).where("first = 1")
            label = F.struct(F.coalesce("solo", F.lit(False)).alias("solo"), F.coalesce("d", "comm").alias("of"))  # a community of its own until it is named
            new = state.join(wins.select(*CELL, "node", "d", "solo"), [*CELL, "node"], "left").withColumn("label", label)
            names = new.groupBy(*CELL, "label").agg(F.min("node").alias("name"))
            new = _cut(new.join(names, [*CELL, "label"]).select(*CELL, "node", F.col("name").alias("comm"), "size", (F.col("d").isNotNull()).alias("went")))
            moved = moved or new.where("went").limit(1).count() > 0
            state = new.drop("went")
            if trace is not None:
                far = whole.select(*CELL, "node", F.col("comm").alias("mid")).join(state.select(*CELL, F.col("node").alias("mid"), "comm"), [*CELL, "mid"])
                trace.append({tuple(r[:5]): r.energy for r in _energy(far.withColumn("size", F.lit(1.0)), first, cells).collect()})
        if not moved:
            break
        step = state.select(*CELL, F.col("node").alias("mid"), F.col("comm").alias("top"))
        whole = _cut(whole.withColumnRenamed("comm", "mid").join(step, [*CELL, "mid"]).select(*CELL, "node", F.col("top").alias("comm")))
        side = lambda c: step.select(*CELL, F.col("mid").alias(c), F.col("top").alias(f"{c}_top"))
        links = _cut(links.join(side("a"), [*CELL, "a"]).join(side("b"), [*CELL, "b"]).where("a_top <> b_top").groupBy(*CELL, F.col("a_top").alias("a"), F.col("b_top").alias("b")).agg(F.sum("w").alias("w")))
        state = _cut(state.groupBy(*CELL, "comm").agg(F.sum("size").alias("size")).select(*CELL, F.col("comm").alias("node"), "comm", "size"))
    done = _energy(whole.withColumn("size", F.lit(1.0)), first, cells)
    return whole.join(done, CELL).select(*[F.col(c) for c in CELL], "node", "comm", "energy")


def louvain(edges: DataFrame, nodes: DataFrame, resolutions: list[tuple[float, float]] = [(1.0, 1.0)], runs: int = 5, sweeps: int = 16, dense_nodes: int = 1000) -> DataFrame:  # noqa: B006
    """(session, stimulus, pos, neg, run, node, comm, energy): a partition of all nodes by graph, pair of resolutions and run.

    Parallel edges count with their sum, loops not at all (they are inside any community); a graph without edges has no rows.  A node on no edge
    is a community of its own.  Null weights count as 0, null nodes are left out.  Tables of at most ``dense_nodes`` nodes are done by dense arrays,
    a graph in a task; others by joins.  Both give the same partitions.
    """
    spark = edges.sparkSession
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(*KEYS, "src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    nodes = nodes.select("node").where("node IS NOT NULL").dropDuplicates()
    totals = _totals(edges, nodes)
    if nodes.limit(dense_nodes + 1).count() > dense_nodes:
        want = spark.createDataFrame([(float(p), float(q), r) for p, q in resolutions for r in range(runs)], "pos double, neg double, run int")
        cells = totals.crossJoin(F.broadcast(want)).select(*CELL, (F.col("pos") * F.col("p") - F.col("neg") * F.col("q")).alias("bound"))
        return by_joins(edges, nodes, cells, sweeps)
    ids = np.array(sorted(r[0] for r in nodes.collect()), np.int64)  # at most ``dense_nodes``
    n, grid = len(ids), [(float(p), float(q), r) for p, q in resolutions for r in range(runs)]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        one = np.zeros((n, n))
        np.add.at(one, (np.searchsorted(ids, g["src"]), np.searchsorted(ids, g["dst"])), g["weight"].to_numpy())
        pos, neg, number = (np.array(c) for c in zip(*grid))
        out, some = [], max(1, 2_000_000 // (n * n))
        for i in range(0, len(grid), some):
            part = slice(i, i + some)
            bound = pos[part] * g["p"].iloc[0] - neg[part] * g["q"].iloc[0]
            comm, energy = dense(np.broadcast_to(one + one.T, (len(bound), n, n)), bound, number[part], ids, sweeps)
            out.append(pd.DataFrame({"session": g["session"].iloc[0], "stimulus": g["stimulus"].iloc[0], "pos": np.repeat(pos[part], n), "neg": np.repeat(neg[part], n), "run": np.repeat(number[part], n), "node": np.tile(ids, len(bound)), "comm": ids[comm].ravel(), "energy": np.repeat(energy, n)}))
        return pd.concat(out)

    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = edges.join(F.broadcast(totals), KEYS) if totals.limit(10_001).count() <= 10_000 else edges.join(totals, KEYS)
    return rows.repartition(groups, *KEYS).groupBy(*KEYS).applyInPandas(run, FOUND)  # few graphs, much work on each: not to be coalesced


#: The grid of resolutions: 0 to 2 by tenths, each with each.
GRID = [(p / 10, q / 10) for p in range(21) for q in range(21)]


def energies(edges: DataFrame, nodes: DataFrame, resolutions: list[tuple[float, float]] = GRID, runs: int = 4, seed: int = 5) -> DataFrame:
    """(kind, session, stimulus, pos, neg, run, h, total): energies of the partitions found of every graph ('real') and of as many surrogates ('drawn').

    A surrogate has the graph's edges with its weights dealt anew, another time for each run; ``total`` is the sum of sizes of weights.
    """
    line = Window.partitionBy(*KEYS)
    own = edges.select(*KEYS, "src", "dst", "weight")
    reps = edges.sparkSession.range(runs).select(F.col("id").cast("int").alias("rep"))
    ranked = own.crossJoin(F.broadcast(reps)).withColumn("k", F.row_number().over(Window.partitionBy(*KEYS, "rep").orderBy(F.xxhash64(F.lit(seed), "rep", "src", "dst"), "src", "dst")))
    weights = own.select(*KEYS, "weight", F.row_number().over(line.orderBy("src", "dst")).alias("k"))
    drawn = ranked.drop("weight").join(weights, [*KEYS, "k"]).select("session", F.concat_ws(":", "rep", "stimulus").alias("stimulus"), "src", "dst", "weight")
    total = own.groupBy(*KEYS).agg(F.sum(F.abs("weight")).alias("total"))
    real = louvain(own, nodes, resolutions, runs).select(F.lit("real").alias("kind"), *CELL, F.col("energy").alias("h")).dropDuplicates()
    rep, stimulus = F.substring_index("stimulus", ":", 1).cast("int"), F.expr("substr(stimulus, instr(stimulus, ':') + 1)")
    other = louvain(drawn, nodes, resolutions, 1).select(F.lit("drawn").alias("kind"), "session", stimulus.alias("stimulus"), "pos", "neg", rep.alias("run"), F.col("energy").alias("h")).dropDuplicates()
    return real.union(other).join(total, KEYS)


def numbered(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comms(run, comm, node), names(run, session, stimulus, of)): the partitions of all graphs as runs of one table, as the module operators read them."""
    names = staged(found.select(*KEYS, F.col("run").alias("of")).dropDuplicates().withColumn("run", F.xxhash64(*KEYS, "of")), "runs")
    comms = found.withColumnRenamed("run", "of").join(names, [*KEYS, "of"]).select("run", "comm", "node")
    return comms, names


def resolution(h: DataFrame) -> DataFrame:
    """(session, stimulus, pos, neg, gap): the cell where surrogates' mean energy is furthest above the graph's, the first on ties."""
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("h")))
    gap = h.groupBy(*KEYS, "pos", "neg").agg(F.round(mean("drawn") - mean("real"), 6).alias("gap"))
    best = Window.partitionBy(*KEYS).orderBy(F.col("gap").desc(), "pos", "neg")
    return gap.withColumn("k", F.row_number().over(best)).where("k = 1").select(*KEYS, "pos", "neg", "gap")


def modularity_z(h: DataFrame) -> DataFrame:
    """(session, stimulus, q, drawn_q, z): mean modularities -h / total at the chosen cell, and the pooled two-sample Z of real against drawn runs."""
    at = h.join(resolution(h), [*KEYS, "pos", "neg"]).withColumn("q", -F.col("h") / F.col("total"))
    x = at.groupBy(*KEYS).agg(*[f(F.when(F.col("kind") == k, F.col("q"))).alias(f"{n}_{k}") for k in ("real", "drawn") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n_real") - 1) * F.col("v_real") + (F.col("n_drawn") - 1) * F.col("v_drawn")) / (F.col("n_real") + F.col("n_drawn") - 2) * (1 / F.col("n_real") + 1 / F.col("n_drawn")))
    return x.select(*KEYS, F.round("m_real", 6).alias("q"), F.round("m_drawn", 6).alias("drawn_q"), F.round((F.col("m_real") - F.col("m_drawn")) / F.nullif(pooled, F.lit(0.0)), 5).alias("z"))
