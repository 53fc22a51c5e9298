"""Rewiring by trades, small-worldness, cycles and ranks against brute force, invariants and known graphs."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from neuroloom.operators import cycles, ranks, rewiring

EDGE = "session string, stimulus string, src long, dst long, weight double"


def graph(spark, links, name="s"):
    return spark.createDataFrame([(name, "t", a, b, float(i + 1)) for i, (a, b) in enumerate(links)], EDGE)


def random_links(seed, n, p):
    rng = np.random.default_rng(seed)
    return [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p]


def test_curveball_keeps_degrees_and_mixes(spark):
    links = random_links(1, 12, 0.3) + [(20, a) for a in range(12)] + [(a, 21) for a in range(12)]
    edges = graph(spark, links).union(graph(spark, [(0, 1), (1, 2), (2, 0)], "ring")).union(graph(spark, [(5, 5)], "loop"))
    got = rewiring.curveball(edges, replicas=12, rounds=15, bucket=4)
    reps = defaultdict(list)
    for r in got.collect():
        reps[r.session, r.rep].append(r)
    assert {s for s, _ in reps} == {"s", "ring"} and len(reps) == 24
    for (s, _), rows in reps.items():
        if s == "s":
            assert len({(r.src, r.dst) for r in rows}) == len(rows) == len(links) and all(r.src != r.dst for r in rows)
            assert Counter(r.src for r in rows) == Counter(a for a, _ in links) and Counter(r.dst for r in rows) == Counter(b for _, b in links)
            assert sorted(r.weight for r in rows) == [float(i + 1) for i in range(len(links))]
    kinds = {frozenset((r.src, r.dst) for r in rows) for (s, _), rows in reps.items() if s == "s"}
    assert len(kinds) == 12
    again = rewiring.curveball(edges.repartition(7), replicas=12, rounds=15, bucket=4)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, again.collect()))
    assert rewiring.curveball(edges.limit(0), 2, 2).collect() == []


def test_curveball_reaches_all_graphs_with_these_degrees_alike(spark):
    """Three nodes with two targets each among six: every way to deal them appears about equally often."""
    edges = graph(spark, [(0, 10), (0, 11), (1, 12), (1, 13), (2, 14), (2, 15)])
    rows = rewiring.curveball(edges, replicas=900, rounds=16).select("rep", "src", "dst").collect()
    reps = defaultdict(set)
    for r in rows:
        reps[r.rep].add((r.src, r.dst))
    seen = Counter(frozenset(x) for x in reps.values())
    assert len(seen) == math.factorial(6) // 8 and max(seen.values()) < 4 * 900 / 90


@pytest.mark.parametrize("kind", ["lattice", "random", "small"])
def test_small_worldness_of_known_graphs(spark, kind):
    n, rng = 36, np.random.default_rng(4)
    ring = [(i, (i + k) % n) for i in range(n) for k in (1, 2)]
    if kind == "random":
        pairs = list(itertools.combinations(range(n), 2))
        ring = [pairs[i] for i in rng.permutation(len(pairs))[: len(ring)]]
    if kind == "small":
        ring = [(a, b) if rng.random() > 0.12 else (a, int((a + rng.integers(5, 30)) % n)) for a, b in ring]
    r = rewiring.small_world(graph(spark, ring), replicas=4).first()
    if kind == "lattice":
        assert r.transitivity == 0.5 and r.omega < -0.3 and r.nodes == n and r.links == 2 * n
    elif kind == "random":
        assert r.omega > 0.3 and r.sigma < 2
    else:
        assert r.sigma > 1.5 and abs(r.omega) < 0.6


def test_small_worldness_of_tiny_and_split_graphs(spark):
    edges = graph(spark, [(0, 1), (1, 0), (2, 2)]).union(graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (7, 8)], "b"))
    got = {r.session: r for r in rewiring.small_world(edges, replicas=2).collect()}
    assert (got["s"].nodes, got["s"].links, got["s"].sigma, got["s"].omega) == (2, 1, 0.0, 0.0)
    assert (got["b"].nodes, got["b"].links, got["b"].transitivity) == (4, 4, 0.6)
    assert rewiring.small_world(edges.limit(0), 1).collect() == []


def test_rewired_pairs_keep_degrees_and_connection():
    pairs = [(i, (i + k) % 15) for i in range(15) for k in (1, 3)]
    for lattice in (False, True):
        got = rewiring.rewired_pairs(pairs, 15, 300, lattice, np.random.default_rng(2))
        assert Counter(x for p in got for x in p) == Counter(x for p in pairs for x in p) and len({frozenset(p) for p in got}) == 30
        assert rewiring._connected(got, 15)
    near = lambda ps: sum(min(abs(a - b), 15 - abs(a - b)) for a, b in ps)
    assert near(got) < near(pairs)


def plain_cycles(links, most):
    out, near = Counter(), defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)

    def go(start, path):
        for v in near[path[-1]]:
            if v == start and len(path) > 1:
                out[len(path)] += 1
            elif v > start and v not in path and len(path) < most:
                go(start, [*path, v])

    for s in list(near):
        go(s, [s])
    return dict(out)


def test_cycles_to_length_eight(spark):
    links = random_links(7, 11, 0.28) + [(3, 3), (40, 41), (41, 42), (42, 43), (50, 40)]
    edges = graph(spark, [*links, links[0]])
    trace = []
    got = {r.size: r.cycles for r in cycles.cycles(edges, 8, trace).collect()}
    assert got == plain_cycles(links, 8)
    starts = Counter(a for a, _ in links)
    assert trace[0] < len(links) and trace[-1] < sum(starts.values()) * 11**3
    assert {r.size: r.cycles for r in cycles.cycles(edges, 2).collect()} == {k: v for k, v in plain_cycles(links, 2).items()}
    assert cycles.cycles(graph(spark, [(1, 2), (2, 3)]), 5).collect() == []


def test_running_sums_and_places_over_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(v), int(w)) for k in "ab" for v, w in zip(rng.integers(0, 40, 300), rng.integers(0, 9, 300))] + [("c", 5, 1)]
    df = spark.createDataFrame(rows, "k string, v long, w long").repartition(6)
    got = ranks.placed(df, ["k"], ["v"])
    assert got.columns == ["k", "v", "w", "place"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.k].append((r.place, r.v))
    for k, x in by.items():
        assert sorted(p for p, _ in x) == list(range(len(x))) and [v for _, v in sorted(x)] == sorted(v for a, v, _ in rows if a == k)
    sums = ranks.running(df.dropDuplicates(["k", "v"]), ["k"], ["v"], {"before": "w"}).collect()
    kept = sorted((r.k, r.v, r.w) for r in sums)
    for r in sums:
        assert r.before == sum(w for k, v, w in kept if k == r.k and v < r.v)


def test_rank_sum_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(rng.integers(0, 15)), bool(rng.random() < 0.4)) for k in "ab" for _ in range(150)] + [("a", None, True), ("a", 3.0, None), ("one", 1.0, True)]
    df = spark.createDataFrame(rows, "k string, v double, m boolean").repartition(5)
    got = {r.k: r for r in ranks.rank_sum(df, ["k"], "v", "m").collect()}
    for k in "ab":
        x = [v for a, v, m in rows if a == k and m and v is not None]
        y = [v for a, v, m in rows if a == k and not m and v is not None]
        u = sum((p > q) + (p == q) / 2 for p in x for q in y)
        assert (got[k].n1, got[k].n2) == (len(x), len(y))
        assert got[k].z == pytest.approx((u - len(x) * len(y) / 2) / math.sqrt(len(x) * len(y) * (len(x) + len(y) + 1) / 12), abs=1e-5)
    assert (got["one"].n1, got["one"].n2, got["one"].z) == (1, 0, None)


def test_sketches_against_all_pairs(spark):
    from neuroloom.operators import paths, sketches

    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (900, 2))]
    edges, nodes = graph(spark, links).union(graph(spark, [(0, 1), (1, 2), (5, 5)], "b")), spark.range(400).toDF("node")
    exact = {r.session: r for r in paths.path_metrics(edges.where("src <> dst"), nodes).collect()}
    got = {r.session: r for r in sketches.path_sketch(edges, nodes).collect()}
    for s in ("s", "b"):
        for c in ("pairs", "mean_path", "efficiency", "wiener", "reaching"):
            assert got[s][c] == pytest.approx(exact[s][c], rel=0.04)  # 1.04 / sqrt(4096) is 0.016
    assert got["b"] == exact["b"] and abs(got["s"].diameter - exact["s"].diameter) <= 1
    rough = sketches.path_sketch(edges, nodes, lg=6).where("session = 's'").first()
    assert rough.pairs == pytest.approx(exact["s"].pairs, rel=0.3)
    assert sketches.path_sketch(edges.limit(0), nodes).collect() == []


def test_betweenness_by_messages_is_that_by_groups(spark):
    from neuroloom.operators import centrality

    rng = np.random.default_rng(8)
    links = [("s", "t", int(a), int(b), float(rng.choice([-2, -1, 1, 2, 0.5]))) for a, b in random_links(3, 12, 0.2)] + [("s", "t", 30, 31, 0.0), ("b", "t", 0, 1, 1.0), ("b", "t", 1, 2, -1.0), ("b", "t", 0, 3, 1.0), ("b", "t", 3, 2, 1.0)]
    edges, nodes = spark.createDataFrame(links, EDGE), spark.range(13).toDF("node")
    want = {(r.session, r.node): r.betweenness for r in centrality.betweenness(edges, nodes).collect()}
    got = {(r.session, r.node): r.betweenness for r in centrality.betweenness(edges, nodes, blocks=2, small=3).collect()}
    assert want.keys() == got.keys() and len(want) == 26
    assert all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want) and max(want.values()) > 0.05
    assert got["b", 1] == got["b", 3] == pytest.approx(0.5 / (12 * 11), abs=1e-8)


def test_shapiro_and_medians_on_any_number_of_partitions(spark):
    from neuroloom.functions import stats

    rng = np.random.default_rng(12)
    rows = [("a", float(v)) for v in rng.normal(size=61)] + [("b", float(v)) for v in rng.exponential(size=400).round(2)] + [("c", 1.0), ("c", 2.0), ("c", 4.0), ("d", 5.0), ("d", None), ("e", float("nan"))] + [("f", 3.0)] * 9 + [("g", float(i % 5)) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, v double")
    by = defaultdict(list)
    for k, v in rows:
        if v is not None and v == v:
            by[k].append(v)
    for parts in (1, 40):
        got = {r.k: r for r in stats.shapiro(df.repartition(parts), ["k"], "v").collect()}
        assert got.keys() == by.keys()
        for k, x in by.items():
            want = stats.shapiro_wilk(x)
            assert got[k].n == len(x) and got[k].in_range == (3 <= len(x) <= 5000)
            assert (got[k].w, got[k].p) == ((None, None) if want[0] != want[0] else pytest.approx(want, abs=1e-9))
        m = {r.k: r for r in stats.median_interval(df.repartition(parts), ["k"], "v").collect()}
        assert m.keys() == by.keys()
        for k, x in by.items():
            assert m[k].n == len(x) and m[k].median == pytest.approx(np.median(x), abs=1e-6)
            draws = np.median(np.array(x)[rng.integers(0, len(x), (20_000, len(x)))], axis=1)
            gap = (max(x) - min(x)) / len(x) * 2 + 0.02 if len(x) > 10 else max(x) - min(x) + 1e-9
            assert m[k].low == pytest.approx(np.quantile(draws, 0.025), abs=gap) and m[k].high == pytest.approx(np.quantile(draws, 0.975), abs=gap)
    assert stats.binomial_tail.func(*(np.array([x]) for x in (0.5, 50_000_001.0, 100_000_001.0)))[0] == pytest.approx(0.5, abs=1e-6)
