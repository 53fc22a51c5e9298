"""Signed Louvain: both forms agree, energies never rise and are those of SQL, moves one by one find no better."""

import duckdb
import numpy as np
import pytest

from neuroloom.operators import communities

EDGE = "session string, stimulus string, src long, dst long, weight double"


def blocks(seed, n, k, inside=0.7, across=0.15):
    rng = np.random.default_rng(seed)
    w = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            same = i // k == j // k
            if i != j and rng.random() < (inside if same else across):
                w[i, j] = (1 if rng.random() < (0.95 if same else 0.3) else -1) * rng.integers(1, 5)
    return w


def energy(w, bound, comm):
    comm = np.asarray(comm)
    return bound * sum((comm == c).sum() ** 2 for c in set(comm.tolist())) - w[comm[:, None] == comm].sum()


def plain(w, bound):
    """Louvain's first phase move by move, then merges of communities, until neither lowers the energy."""
    comm = list(range(len(w)))
    better = True
    while better:
        better = False
        for i in range(len(w)):
            for c in {*comm, max(comm) + 1}:
                trial = comm[:i] + [c] + comm[i + 1 :]
                if energy(w, bound, trial) < energy(w, bound, comm) - 1e-9:
                    comm, better = trial, True
        for a in set(comm):
            for b in set(comm):
                trial = [a if c == b else c for c in comm]
                if energy(w, bound, trial) < energy(w, bound, comm) - 1e-9:
                    comm, better = trial, True
    return energy(w, bound, comm)


def bound_of(w, pos, neg):
    return (pos * w[w > 0].sum() + neg * w[w < 0].sum()) / len(w) ** 2


def test_energy_never_rises_and_is_right():
    for seed, n, k in ((0, 24, 6), (1, 15, 5), (2, 9, 9)):
        w = blocks(seed, n, k)
        cells = [(p, q, r) for p in (0, 0.5, 1, 2) for q in (0, 1, 2) for r in range(3)]
        bound, trace = np.array([bound_of(w, p, q) for p, q, _ in cells]), []
        comm, found = communities.dense(np.broadcast_to(w + w.T, (len(cells), n, n)), bound, np.array([r for *_, r in cells]), np.arange(n) * 7 + 3, trace=trace)
        assert (np.diff(np.array([[energy(w, b, range(n)) for b in bound], *trace]), axis=0) <= 1e-9).all()
        for b, c, e in zip(bound, comm, found):
            assert e == pytest.approx(energy(w, b, c), abs=1e-6) and all(x <= i for i, x in enumerate(c))


def test_as_good_as_moves_one_by_one():
    ratio = []
    for seed in range(6):
        w = blocks(seed, 16, 4)
        b = bound_of(w, 1, 1)
        _, found = communities.dense(np.broadcast_to(w + w.T, (8, 16, 16)), np.full(8, b), np.arange(8), np.arange(16))
        ratio.append(found.min() / plain(w, b))
    assert min(ratio) > 0.97 and np.mean(ratio) > 0.99  # energies are below 0
    w = blocks(9, 20, 5, 1.0, 0.0)
    comm, _ = communities.dense((w + w.T)[None], np.array([bound_of(w, 1, 1)]), np.zeros(1, int), np.arange(20))
    assert comm[0].tolist() == [i // 5 * 5 for i in range(20)] or len(set(comm[0].tolist())) >= 4


def test_joins_find_the_same_as_arrays_and_sql_the_same_energy(spark):
    rows = [(s, "t", i * 5 + 2, j * 5 + 2, float(w)) for k, s in enumerate("ab") for (i, j), w in np.ndenumerate(blocks(k, 10, 5)) if w]
    edges = spark.createDataFrame([*rows, ("a", "t", 2, 2, 9.0), ("a", "t", None, 2, 1.0)], EDGE)
    nodes = spark.createDataFrame([(i * 5 + 2,) for i in range(11)] + [(None,), (2,)], "node long")
    want = sorted(map(tuple, communities.louvain(edges, nodes, [(1, 1), (0.5, 2)], 2).collect()))
    got = sorted(map(tuple, communities.louvain(edges, nodes, [(1, 1), (0.5, 2)], 2, dense_nodes=1).collect()))
    assert [r[:7] for r in got] == [r[:7] for r in want] and np.allclose([r[7] for r in got], [r[7] for r in want])
    assert len(want) == 2 * 4 * 11 and all(r[6] == 52 for r in want if r[5] == 52)
    con = duckdb.connect()
    con.execute("CREATE TABLE e (session VARCHAR, src BIGINT, dst BIGINT, weight DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", [(s, a, b, w) for s, _, a, b, w in rows])
    con.execute("CREATE TABLE p (session VARCHAR, pos DOUBLE, neg DOUBLE, run INT, node BIGINT, comm BIGINT, energy DOUBLE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?, ?, ?, ?)", [(r[0], *r[2:]) for r in want])
    bad = con.execute("""WITH h AS (SELECT p.session, p.pos, p.neg, p.run, sum(e.weight) AS inner_w FROM p JOIN p q ON (p.session, p.pos, p.neg, p.run, p.comm) = (q.session, q.pos, q.neg, q.run, q.comm) JOIN e ON e.session = p.session AND e.src = p.node AND e.dst = q.node GROUP BY ALL),
s AS (SELECT session, pos, neg, run, sum(n * n) AS square, sum(n) AS nodes, any_value(energy) AS energy FROM (SELECT session, pos, neg, run, comm, count(*) AS n, any_value(energy) AS energy FROM p GROUP BY ALL) GROUP BY ALL),
t AS (SELECT session, sum(greatest(weight, 0)) AS plus, sum(greatest(-weight, 0)) AS minus FROM e GROUP BY session)
SELECT * FROM s JOIN t USING (session) LEFT JOIN h USING (session, pos, neg, run) WHERE abs(energy - ((pos * plus - neg * minus) / (nodes * nodes) * square - coalesce(inner_w, 0))) > 1e-6""").fetchall()
    assert bad == []


def test_energies_choose_a_cell_and_beat_surrogates(spark):
    rows = [("a", "t", i, j, float(w)) for (i, j), w in np.ndenumerate(blocks(3, 16, 4, 0.9, 0.3)) if w]
    edges, nodes = spark.createDataFrame(rows, EDGE), spark.range(16).toDF("node")
    h = communities.energies(edges, nodes, [(1.0, 1.0), (0.0, 0.0)], runs=6).cache()
    assert h.count() == 2 * 2 * 6
    assert h.where("pos = 0 and kind = 'real'").agg({"h": "max"}).first()[0] <= -edges.agg({"weight": "sum"}).first()[0] + 1e-9  # one community is as low at no resolution
    assert communities.resolution(h).collect()[0].pos == 1.0
    assert communities.modularity_z(h).collect()[0].z > 2
    assert communities.louvain(edges.limit(0), nodes).collect() == []
