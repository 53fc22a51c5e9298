"""Operators beyond SQL: invariants, hand-made cases and brute force."""

import math
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from neuroloom.functions import stats
from neuroloom.operators import baselines, centrality, detect, modules, motifs, nullmodels, paths, simulate, spikes
from neuroloom.operators.triad_table import table, vocabulary
from neuroloom.plans import registry
from neuroloom.sources import matrices
from neuroloom.sources.tables import load, read_edges, write_edges

SF = "/root/testdata/sf0.001"
EDGE = "session string, stimulus string, src long, dst long, weight double"


def graph(spark, links):
    return spark.createDataFrame([("s", "t", a, b, float(w)) for a, b, w in links], EDGE)


@pytest.fixture(scope="module")
def random_links():
    rng = np.random.default_rng(5)
    pairs = [(a, b) for a in range(14) for b in range(14) if a != b and rng.random() < 0.22]
    return [(a, b, float(rng.choice([-1, 1]) * rng.integers(1, 9))) for a, b in pairs]


def test_vocabulary():
    assert len(vocabulary()) == len(set(vocabulary())) == 132
    assert Counter(n.rstrip("+-") for n in vocabulary())["201"] == 10
    assert len({r[0] for r in table()}) == 54


def test_motif_fixture(spark):
    rows = motifs.motif_intensity(edges=graph(spark, [(0, 1, 2), (1, 2, 4), (0, 2, 8)])).collect()
    assert [(r.smt, r.intensity, r.coherence) for r in rows] == [("030T+++", 4.0, 0.857143)]
    assert motifs.motif_intensity(edges=graph(spark, [(0, 1, -2), (1, 2, 4), (0, 2, 8)])).first().smt == "030T-++"


def test_motifs_do_not_depend_on_labels(spark, random_links):
    rng = np.random.default_rng(1)
    name = rng.permutation(14)
    census = lambda links: Counter(r.smt for r in motifs.motif_sign(edges=graph(spark, links)).collect())
    first = census(random_links)
    assert first == census([(int(name[a]), int(name[b]), w) for a, b, w in random_links])
    linked = {frozenset((a, b)) for a, b, _ in random_links}
    assert sum(first.values()) == sum(sum(frozenset(p) in linked for p in combinations(t, 2)) >= 2 for t in combinations(range(14), 3))


PEAKS = [
    ("sharp peak", {3: 1}, {15: 1}, 20, 4, 6, (1, 4.472136, 3, 0), None), ("sharp interval", {3: 1, 4: 1, 5: 1}, {15: 1}, 20, 2.5, 6, (3, 2.868549, 3, 2), None),
    ("negative", {3: -1}, {15: 1}, 20, 4, 6, (-1, -4.472136, 3, 0), None), ("tie", {0: 1}, {0: 1}, 20, 4, 6, None, None),
    ("zero lag, second significant", {0: 1, 5: 0.8}, {0: 1}, 100, 4, 0, (0.8, 6.199178, 5, 0), (1, 10, 0, 0)), ("zero lag, second weak", {0: 1, 5: 0.2}, {0: 1}, 100, 4, 0, None, (1, 10, 0, 0)),
]


@pytest.mark.parametrize("name,ab,ba,window,level,longest,want_ab,want_ba", PEAKS)
def test_peaks(spark, name, ab, ba, window, level, longest, want_ab, want_ba):
    rows = [(x, y, k, float(c.get(k, 0))) for x, y, c in ((1, 2, ab), (2, 1, ba)) for k in range(window + 1)]
    found = detect.detector("significant_ccg", level, 12, longest)(ccg=spark.createDataFrame(rows, "src long, dst long, lag long, value double"))
    got = {(r.src, r.dst): (r.weight, r.confidence, r.edge_offset, r.duration) for r in found.collect()}
    for pair, want in (((1, 2), want_ab), ((2, 1), want_ba)):
        assert (pair in got) == (want is not None) and (want is None or got[pair] == pytest.approx(want, abs=2e-6))


def test_ccg_fixture(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 0, 50), (1, 0, 13), (1, 0, 53)], "neuron_id long, trial_id long, t long")
    got = {(r.src, r.dst, r.lag): r.n for r in spikes.ccg_pairs(spikes=df).collect()}
    assert got == {(0, 1, 3): 2, (0, 1, 43): 1, (1, 0, 37): 1}


def test_ccg_fixture_values(spark):
    """Rates of 20 Hz in 100 bins; the operator's trial is longer, so values follow its own length."""
    df = spark.createDataFrame([(0, 0, 10), (0, 0, 50), (1, 0, 13), (1, 0, 53)], "neuron_id long, trial_id long, t long")
    got = {(r.src, r.dst, r.lag): r.ccg for r in spikes.ccg_normalised(spikes=df).collect()}
    rate = 2 / (spikes.BINS / 1000)
    for (a, b, lag), n in {(0, 1, 3): 2, (0, 1, 43): 1, (1, 0, 37): 1, (0, 1, 4): 0}.items():
        assert math.isclose(got[a, b, lag], n / ((spikes.BINS - lag) / 1000 * rate), abs_tol=1e-6)


def test_jitter_windows(spark):
    df = spark.createDataFrame([(0, 0, t) for t in (0, 10, 30, 36, 60, 1439)], "neuron_id long, trial_id long, t long")
    assert {r.t: (r.first, r["last"]) for r in spikes.omega_windows(spikes=df).collect()} == {0: (0, 4), 10: (8, 12), 30: (28, 32), 36: (34, 38), 60: (58, 62), 1439: (1435, 1439)}
    assert {r.t: r.first for r in spikes.gamma_windows(spikes=df.where("t in (30, 36, 60)")).collect()} == {30: 25, 36: 31, 60: 50}


def test_memory_keeps_bursts(spark):
    rng = np.random.default_rng(3)
    times = sorted(set(np.cumsum(rng.choice([3, 6, 10, 40, 70], 25)).tolist()))
    df = spark.createDataFrame([(n, k, int(t)) for n in range(3) for k in range(2) for t in times], "neuron_id long, trial_id long, t long")
    got = {}
    for r in spikes.surrogates(df, samples=4, memory=True).collect():
        got.setdefault((r.sample, r.neuron_id, r.trial_id), []).append(r.t)
    kept = all_gaps = 0
    for v in got.values():
        assert len(set(v)) == len(times) and min(v) >= 0 and max(v) < spikes.BINS
        gaps = Counter(np.diff(sorted(v)).tolist())
        for g in (3, 6, 10):
            want = int((np.diff(times) == g).sum())
            kept, all_gaps = kept + min(gaps[g], want), all_gaps + want
    assert kept >= 0.8 * all_gaps  # a time already taken moves a spike now and then
    crowded = spark.createDataFrame([(0, 0, t) for t in range(60)], "neuron_id long, trial_id long, t long")
    assert spikes.surrogates(crowded, samples=2, length=5, bins=60).dropDuplicates().count() == 120  # full windows lose no spike


def test_betweenness_and_cycles(spark, random_links):
    edges = graph(spark, random_links)
    nodes = spark.createDataFrame([(i, 0) for i in range(15)], "node long, area long")
    length = {(a, b): abs(w) for a, b, w in random_links}
    inf = math.inf
    far = {(a, b): 0 if a == b else length.get((a, b), inf) for a in range(15) for b in range(15)}
    for k in range(15):
        for a in range(15):
            for b in range(15):
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    paths_of = {}

    def number(a, b):
        if a == b:
            return 1
        if (a, b) not in paths_of:
            paths_of[a, b] = sum(number(a, x) for (x, y), w in length.items() if y == b and far[a, x] + w == far[a, b] < inf)
        return paths_of[a, b]

    want = {v: sum(number(a, v) * number(v, b) / number(a, b) for a in range(15) for b in range(15) if v not in (a, b) and a != b and far[a, b] < inf and far[a, v] + far[v, b] == far[a, b]) / (14 * 13) for v in range(15)}
    assert {r.node: r.betweenness for r in centrality.betweenness(edges, nodes).collect()} == pytest.approx(want, abs=1e-8)
    linked = {(a, b) for a, b, _ in random_links}
    cycles = {k: sum(p[0] == min(p) and all(e in linked for e in zip(p, (*p[1:], p[0]))) for p in permutations(range(14), k)) for k in (2, 3, 4)}
    assert {r["size"]: r.cycles for r in centrality.short_cycles(edges=edges).collect()} == {k: n for k, n in cycles.items() if n}


def test_shapiro():
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert math.isclose(w, 0.78881, abs_tol=2e-4) and math.isclose(p, 0.006704, abs_tol=2e-4)
    rng = np.random.default_rng(1)
    ps = [stats.shapiro_wilk(rng.standard_normal(n).tolist())[1] for n in (3, 4, 5, 8, 30, 200) for _ in range(60)]
    assert 0.02 < np.mean(np.array(ps) < 0.1) < 0.2 and stats.shapiro_wilk(rng.exponential(size=200).tolist())[1] < 1e-6
    assert math.isnan(stats.shapiro_wilk([1, 1, 1, 1])[0]) and math.isnan(stats.shapiro_wilk([1, 2])[1])


def test_regression_p(spark):
    df = spark.createDataFrame([(12, 0.5), (2, 0.9), (8, 1.0)], "n long, r double")
    got = [r.p for r in stats.regression_p(df).collect()]
    assert math.isclose(got[0], 0.0978, abs_tol=2e-4) and got[1] is None and got[2] is None


def test_verify_sees_each_change(spark, random_links):
    edges = graph(spark, random_links)
    marks = lambda links: {k: v for k, v in nullmodels.verify(edges, graph(spark, links).selectExpr("session", "stimulus", "1 AS rep", "src", "dst", "weight", "0 AS swaps")).first().asDict().items() if k not in ("session", "stimulus", "rep")}
    assert all(marks(random_links).values())
    (a, b, w), *rest = random_links
    assert not marks([*rest, (a, b, w + 1e-3)])["weights"] and not marks(rest)["edges"]
    flipped = marks([*rest, (a, b, -w)])
    assert flipped["pairs"] and flipped["degrees"] and not flipped["signed_pairs"]
    assert not marks([*rest, (90, b, w)])["degrees"]


def test_random_graphs_are_uniform(spark):
    """Over all pairs, in sparse and dense graphs; too many edges are an error."""
    nodes = spark.createDataFrame([(10 * i, 0) for i in range(6)], "node long, area long")
    for m in (4, 20, 30):
        links = [(10 * a, 10 * b, i + 1) for i, (a, b) in enumerate(list(permutations(range(6), 2))[:m])]
        rows = nullmodels.random_graphs(graph(spark, links), nodes, "random", replicas=300).collect()
        times = Counter((r.src, r.dst) for r in rows)
        assert len(rows) == 300 * m and len(times) == 30 and len({(r.rep, r.src, r.dst) for r in rows}) == 300 * m
        assert all(abs(n - 10 * m) < 5 * math.sqrt(10 * m + 1) for n in times.values()) and Counter(r.weight for r in rows) == {float(i + 1): 300 for i in range(m)}
    with pytest.raises(ValueError):
        nullmodels.random_graphs(graph(spark, [(a, b, 1) for a, b in permutations(range(8), 2)]), nodes, "random", replicas=1)


def test_module_area_data(spark):
    """Two modules of one area, one of another and a small one, by hand."""
    comms = spark.createDataFrame([(0, c, n) for c, ns in enumerate([range(0, 4), range(4, 8), range(8, 12), range(12, 14)]) for n in ns], "run long, comm long, node long")
    nodes = spark.createDataFrame([(n, 1 if n < 8 else 2) for n in range(14)], "node long, area long")
    edges = graph(spark, [(0, 1, 1), (1, 0, -1), (0, 4, 1), (4, 0, -1), (5, 1, 2), (0, 12, 1), (9, 0, 1)])
    scorr = spark.createDataFrame([(0, 1, 0.5), (2, 3, 0.1), (0, 4, 0.2), (0, 8, 0.4)], "i long, j long, r double")
    for op, between, whole in ((modules.module_areas(one_sided=True), 2, (2 / 16 + 1 / 16) / 3), (modules.module_area_data, 3, (3 / 16 + 1 / 16) / 3)):
        got = {(r.part, r.area): tuple(r)[5:] for r in op(edges=edges, nodes=nodes, comms=comms, scorr=scorr).collect()}
        assert got["within", 1] == (2, 0.3, pytest.approx(2 / 12 / 2, abs=1e-6), 0.5, 0.5) and got["within", 2] == (1, None, 0.0, None, None)
        assert got["between", 1] == (1, 0.2, pytest.approx(between / 16), pytest.approx(2 / 3, abs=1e-6), pytest.approx(1 / 3, abs=1e-6))
        assert got["any", None] == (3, 0.3, pytest.approx(whole, abs=1e-6), pytest.approx((2 / 3 + 1) / 2, abs=1e-6), pytest.approx(1 / 6, abs=1e-6))


def test_variable_simulator(spark):
    got, drawn = simulate.izhikevich_variable(spark, [(0, 1, 10000.0), (1, 2, 10000.0)], 3, trials=20)
    rows = got.collect()
    assert all(2 <= d <= 5 for *_, d in drawn) and rows and max(r.t for r in rows) < 250
    times = {(r.neuron_id, r.trial_id, r.t) for r in rows}
    a, b, d = drawn[0]
    sent = [(k, t) for n, k, t in times if n == a and t + d + 2 < 250]
    assert sum((b, k, t + d + e) in times for k, t in sent for e in (0, 1, 2)) >= 0.8 * len(sent)


def test_network_finds_the_link(spark):
    """Spikes to edges: the simulated link is the strongest edge found, at its delay."""
    df = simulate.izhikevich(spark, [(0, 1, 10000.0, 3)], 2, trials=60, current=130.0)
    best = spikes.network(df, samples=4, level=3.0, max_duration=0).orderBy(F.desc("confidence")).first()
    assert (best.src, best.dst) == (0, 1) and best.edge_offset in (3, 4) and best.weight > 0


@pytest.mark.parametrize("model", ["random", "degree", "pair", "signed_pair"])
def test_null_models(spark, random_links, model):
    edges = graph(spark, random_links)
    nodes = spark.createDataFrame([(i, i % 3) for i in range(14)], "node long, area long")
    reps = nullmodels.random_graphs(edges, nodes, model, replicas=3)
    own = Counter((a, b) for a, b, _ in random_links)
    for rep in range(3):
        rows = reps.where(F.col("rep") == rep).collect()
        assert len(rows) == len(random_links) and len({(r.src, r.dst) for r in rows}) == len(rows) and all(r.src != r.dst for r in rows)
        assert Counter(round(r.weight, 6) for r in rows) == Counter(w for *_, w in random_links) and rows[0].swaps > 0
        assert Counter((r.src, r.dst) for r in rows) != own
    v = nullmodels.verify(edges, reps).collect()
    keeps = {"random": (), "degree": ("degrees",), "pair": ("degrees", "pairs"), "signed_pair": ("degrees", "pairs", "signed_pairs")}[model]
    assert len(v) == 3 and all(r.edges and r.weights and all(r[k] for k in keeps) for r in v)


def test_rewiring_ends_on_full_graphs(spark):
    full = graph(spark, [(a, b, 1) for a, b in permutations(range(4), 2)])
    nodes = spark.createDataFrame([(i, 0) for i in range(4)], "node long, area long")
    assert {r.swaps for r in nullmodels.random_graphs(full, nodes, "degree", replicas=1).collect()} == {0}


def test_rewiring_reaches_all_swaps(spark):
    """Where nearly all proposals are refused, and in as many replicas as the reference by default."""
    gaps = {(0, 1), (2, 3)}
    dense = graph(spark, [(a, b, 1) for a, b in permutations(range(7), 2) if (a, b) not in gaps])
    nodes = spark.createDataFrame([(i, 0) for i in range(7)], "node long, area long")
    assert {r.swaps for r in nullmodels.random_graphs(dense, nodes, "degree", replicas=2).collect()} == {100 * 40}
    assert registry.queries()["signed_pair_graph"](spark, SF).select("rep").distinct().count() == 200


def test_surrogates_keep_counts_and_windows(spark):
    df = load(spark, SF, "spikes")
    once = spikes.surrogates(df, samples=2)
    again = spikes.surrogates(df.repartition(7), samples=2)
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, again.collect()))
    counts = lambda d, *k: {tuple(r)[:-1]: r["count"] for r in d.groupBy(*k).count().collect()}
    own = counts(df, "neuron_id", "trial_id")
    assert {k[1:]: n for k, n in counts(once, "sample", "neuron_id", "trial_id").items()} == own
    assert once.where("t < 0 or t >= 1440").count() == 0 and once.dropDuplicates().count() == once.count()


def test_null_z_against_replicas(spark, random_links):
    """M9 by hand from the replicas' motifs; a type absent everywhere has Z 0 and the deviation of one 4 among zeros."""
    edges, nodes = graph(spark, random_links), spark.createDataFrame([(i, 0) for i in range(14)], "node long, area long")
    reps = nullmodels.random_graphs(edges, nodes, "signed_pair", replicas=6)
    sums = lambda g: Counter({r.smt: r.s for r in motifs.motif_intensity(edges=g).groupBy("smt").agg(F.sum("intensity").alias("s")).collect()})
    own, drawn = sums(edges), [sums(reps.where(F.col("rep") == k)) for k in range(6)]
    got = {r.smt: r for r in motifs.null_z("null_zscore", edges, nodes, replicas=6).collect()}
    assert any(r.mean == 0 for r in got.values()) and any(abs(r.z) > 0.5 for r in got.values())
    for smt, r in got.items():
        x = [d[smt] for d in drawn]
        sd = np.std(x, ddof=1) if any(x) else np.std([4, 0, 0, 0, 0, 0])
        assert math.isclose(r.deviation, sd, abs_tol=1e-4) and math.isclose(r.z, (own[smt] - np.mean(x)) / sd, abs_tol=1e-3, rel_tol=1e-3)


def test_null_z_reads_staged_tables_alone(spark, random_links, tmp_path):
    """Edges, census and replicas are made once: the last text, which names each several times, reads none of their sources."""
    at = f"file://{tmp_path}/edges"
    graph(spark, random_links).write.parquet(at)
    nodes = spark.range(14).selectExpr("id AS node", "id % 2 AS area")
    scorr = spark.createDataFrame([(0, 1, 0.5)], "i long, j long, r double")
    for name in ("null_zscore_stored", "null_z_corr", "null_signal_corr_motif"):
        more = {"scorr": scorr} if "scorr" in motifs.NULL_Z[name].inputs else {}
        files = motifs.null_z(name, spark.read.parquet(at), nodes, "dealt", 2, **more).inputFiles()
        assert files and not [f for f in files if str(tmp_path) in f], name


def test_null_classes_and_fractions(spark):
    """R2 and G10 on a graph of one feed-forward loop and a chain, against replicas of its own."""
    links = [(0, 1, 2), (1, 2, 4), (0, 2, 8), (4, 5, 1), (5, 6, 1)]
    edges = graph(spark, links).withColumn("stimulus", F.lit("3-MEDIUM"))
    nodes, scorr = spark.createDataFrame([(i, 0) for i in range(8)], "node long, area long"), spark.createDataFrame([(i, j, 0.1 * (i + j)) for i, j in combinations(range(8), 2)], "i long, j long, r double")
    got = {r.part: (r.pairs, r.mean_r) for r in motifs.null_z("null_signal_corr_motif", edges, nodes, replicas=3, scorr=scorr).collect()}
    assert got["given"] == (3, pytest.approx(0.2)) and got["given"][0] + got["rest"][0] + got.get("other", (0,))[0] == 28
    rows = motifs.null_z("null_region_fraction", edges, nodes, replicas=3).collect()
    assert len(rows) == 3 * 132 and all(r.graphs == 0 and r.same_mean == 0 for r in rows)  # no type has five triples


def test_registered_sizes(spark):
    """Registered queries run at their operators' own sizes."""
    made = registry.queries()
    assert made["surrogates"](spark, SF).select("sample").distinct().count() == 10
    assert made["simulated_spikes"](spark, SF).agg(F.max("trial_id")).first()[0] == 39
    full = stats.bootstrap_median(load(spark, SF, "edges"), ["session", "stimulus"], "weight", draws=10_000).collect()
    assert sorted(map(tuple, made["bootstrap_median"](spark, SF).collect())) == sorted(map(tuple, full))
    full = spikes.ccg_corrected(load(spark, SF, "spikes"), samples=10)
    assert full.exceptAll(made["ccg_corrected"](spark, SF)).count() == 0


def test_paths(spark, random_links):
    want = {}
    for s in range(14):
        seen, front = {s: 0}, [s]
        while front:
            front = [b for a in front for x, b, _ in random_links if x == a and b not in seen and not seen.update({b: seen[a] + 1})]
        want |= {(s, k): v for k, v in seen.items() if k != s}
    edges = graph(spark, random_links)
    assert {(r.src, r.dst): r.hops for r in paths.distances(edges).collect()} == want
    two = edges.union(graph(spark, [(100, 101, 1), (102, 101, 1)]))
    assert {r.component for r in paths.weak_components(two).where("node >= 100").collect()} == {100}
    assert paths.largest_component(two).count() == len(random_links)


def test_strong_components(spark):
    rng = np.random.default_rng(8)
    links = [(a, b, 1.0) for a in range(40) for b in range(40) if a != b and rng.random() < 0.03] + [(50, 51, 1.0), (51, 50, 1.0), (60, 61, 1.0)]
    reach = {}
    for s in {x for a, b, _ in links for x in (a, b)}:
        seen, front = {s}, [s]
        while front:
            front = [b for a in front for x, b, _ in links if x == a and b not in seen and not seen.add(b)]
        reach[s] = seen
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    assert {r.node: r.component for r in paths.strong_components(graph(spark, links)).collect()} == want
    top = max(Counter(want.values()).items(), key=lambda x: (x[1], -x[0]))[0]
    assert {(r.src, r.dst) for r in paths.largest_strong(graph(spark, links)).collect()} == {(a, b) for a, b, _ in links if want[a] == want[b] == top}
    assert paths.strong_components(graph(spark, [(0, 1, 1.0)])).count() == 2


def test_matrices(spark, tmp_path):
    """Dense, by coordinates, by compressed rows and columns, and a cube; graphs with their side files."""
    m = np.array([[0, 2.0, np.nan], [-1, 0, 0], [0, 5, 0]])
    i, j = np.nonzero(m)
    csr = {"data": m[i, j], "indices": j, "indptr": np.searchsorted(i, range(4)), "shape": np.array(m.shape)}
    tj, ti = np.nonzero(m.T)
    csc = {"data": m[ti, tj], "indices": ti, "indptr": np.searchsorted(tj, range(4)), "shape": np.array(m.shape), "format": np.array(b"csc")}
    for k, parts in enumerate(({"arr_0": m}, {"row": i, "col": j, "data": m[i, j]}, csr, csc)):
        buffer = __import__("io").BytesIO()
        np.savez(buffer, **parts)
        a, b, v = matrices.entries(buffer.getvalue())
        assert sorted(zip(a.tolist(), b.tolist(), np.nan_to_num(v, nan=9).tolist())) == [(0, 1, 2.0), (0, 2, 9.0), (1, 0, -1.0), (2, 1, 5.0)], k
    cube = np.zeros((2, 3, 4))
    cube[1, 2, 3], cube[0, 1, 0] = 7, 8
    buffer = __import__("io").BytesIO()
    np.savez(buffer, arr_0=cube.reshape(2, 12), ndim=np.array(cube.shape))
    assert sorted(zip(*map(np.ndarray.tolist, matrices.entries(buffer.getvalue())))) == [(1, 0, 8.0), (5, 3, 7.0)]
    np.savez(tmp_path / "7_gray_screen.npz", arr_0=m)
    np.savez(tmp_path / "7_gray_screen_confidence.npz", arr_0=np.where(m == 5, np.nan, np.abs(m) + 3))
    np.savez(tmp_path / "7_gray_screen_offset.npz", arr_0=np.nan_to_num(np.abs(m)))
    areas = spark.createDataFrame([(7, 30, "a", True), (7, 10, "a", True), (7, 15, "a", False), (7, 20, "b", True)], "session int, node long, area string, is_active boolean")
    read = matrices.read_matrices(spark, str(tmp_path))
    got = {(r.session, r.stimulus, r.src, r.dst): (r.weight, r.confidence, r.edge_offset, r.duration) for r in matrices.graphs(read, areas).collect()}
    assert got == {("7", "gray_screen", 10, 20): (2.0, 5.0, 2, None), ("7", "gray_screen", 20, 10): (-1.0, 4.0, 1, None), ("7", "gray_screen", 30, 20): (5.0, None, 5, None)}
    assert {(r.src, r.dst, r.weight) for r in matrices.graphs(read, areas, weighted=False, cc=True).collect()} == {(10, 20, 1.0), (20, 10, 1.0)}


def test_distribution_functions():
    assert math.isclose(stats.normal_sf(1.959963984540054), 0.025, rel_tol=1e-9)
    assert math.isclose(stats.t_sf(2.2281388519649385, 10), 0.025, rel_tol=1e-9) and math.isclose(stats.t_sf(-1.0, 1), 0.75, rel_tol=1e-9)
    assert math.isclose(stats.t_quantile(0.975, 10), 2.2281388519649385, rel_tol=1e-9)


def test_simulated_link_is_found(spark):
    got = simulate.izhikevich(spark, [(0, 1, 10000.0, 3)], 2, trials=30, current=130.0)
    pairs = spikes.ccg_pairs(spikes=got).where("src = 0 and dst = 1").orderBy(F.desc("n"), "lag").first()
    assert got.where("neuron_id = 0").count() > 30 and pairs.lag in (3, 4)


def test_generators(spark):
    dale = simulate.random_adjacency(spark, 40).groupBy("src").agg(F.countDistinct("sign").alias("k")).where("k > 1").count()
    assert dale == 0
    train = simulate.random_train(spark).orderBy("neuron_id", "t").collect()
    assert all(b.t - a.t >= 5 for a, b in zip(train, train[1:]) if a.neuron_id == b.neuron_id)


def test_edges_round_trip(spark, tmp_path):
    edges = load(spark, SF, "edges")
    write_edges(edges, str(tmp_path / "e"))
    back = read_edges(spark, str(tmp_path / "e"), session="A")
    assert back.count() == edges.where("session = 'A'").count()
    assert "PartitionFilters: [isnotnull(session" in back._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(set(registry.OTHERS) - set(registry.oracle_sql()) - {"surrogates"}))
def test_other_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).limit(5).count() > 0


def test_baselines_stored_by_model(spark, tmp_path):
    """Z against stored censuses by hand: absent types, types that no replica varies in, types only a replica has, a graph without baselines."""
    path = f"file://{tmp_path}/baselines"
    kept = [("s", "a", "T+", 0, 2, 4.0, 1.0, 4), ("s", "a", "T+", 2, 1, 2.0, 0.5, 4), *[("s", "a", "S", r, 1, 3.0, 1.0, 4) for r in range(4)], ("s", "a", "R", 1, 1, 8.0, 1.0, 4)]
    table = spark.createDataFrame(kept, baselines.STORED.removesuffix(", model string"))
    table.write.parquet(f"{path}/model=degree")
    table.where("smt = 'R'").write.parquet(f"{path}/model=random")
    census = spark.createDataFrame([("s", g, t, int(x > 0), x, y) for g, t, x, y in [("a", "T+", 5.0, 1.5), ("a", "S", 6.0, 1.0), ("a", "R", 0.0, 0.0), ("a", "U", 1.0, 1.0), ("a", "V", 0.0, 0.0), ("b", "T+", 1.0, 1.0)]], "session string, stimulus string, smt string, n long, intensity double, coherence double")
    scores = baselines.zscores(census, baselines.stored(spark, path))
    got = {(r.model, r.stimulus, r.smt): r for r in scores.collect()}
    assert {k[1:] for k in got if k[0] == "degree"} == {("a", "T+"), ("a", "S"), ("a", "R"), ("a", "U"), ("b", "T+")}  # V is nowhere
    assert {k[1:] for k in got if k[0] == "random"} == {("a", "T+"), ("a", "S"), ("a", "R"), ("a", "U"), ("b", "T+")}
    r = got["degree", "a", "T+"]
    x, y = np.array([4.0, 0, 2, 0]), np.array([1.0, 0, 0.5, 0])
    assert np.allclose([r.intensity_mean, r.intensity_std, r.intensity_z], [x.mean(), x.std(), (5 - x.mean()) / x.std()])
    assert np.allclose([r.coherence_mean, r.coherence_std, r.coherence_z], [y.mean(), y.std(), (1.5 - y.mean()) / y.std()])
    assert got["degree", "a", "S"].intensity_z is None and got["degree", "a", "S"].intensity_mean == 3.0
    lone = np.array([5.0, 0, 0, 0])
    for k in (("degree", "a", "U"), ("random", "a", "T+"), ("degree", "b", "T+")):
        assert np.allclose([got[k].intensity_mean, got[k].intensity_std], [lone.mean(), lone.std()])
        assert (got[k].coherence_mean, got[k].coherence_std, got[k].coherence_z) == (0.0, 0.0, None)
    means = {(r.model, r.stimulus, r.smt): r for r in baselines.over_sessions(scores).collect()}
    assert means["degree", "a", "T+"].intensity_z_std is None and math.isclose(means["degree", "a", "T+"].intensity_z, got["degree", "a", "T+"].intensity_z)
    assert baselines.zscores(census, baselines.stored(spark, path, "pair")).count() == 0
    plan = baselines.stored(spark, path, "random")._jdf.queryExecution().executedPlan().toString()
    assert "model#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_baselines_drawn(spark, tmp_path, random_links):
    """What is stored is the census of the replicas; a model stored again replaces itself only."""
    edges, nodes = graph(spark, random_links), spark.range(14).select(F.col("id").alias("node"), F.lit(0).alias("area"))
    path = f"file://{tmp_path}/drawn"
    baselines.store(edges, nodes, path, ("degree", "dealt"), 3)
    again = baselines.stored(spark, path, "dealt").count()
    baselines.store(edges, nodes, path, ("degree",), 2)
    assert {r.replicas for r in baselines.stored(spark, path, "degree").select("replicas").collect()} == {2}
    assert baselines.stored(spark, path, "dealt").count() == again > 0
    census = motifs.motif_census(edges=edges)
    mine = baselines.zscores(census, baselines.stored(spark, path, "dealt"))
    triples = motifs.replica_census(nullmodels.dealt_weights(3)(edges=edges)).groupBy("smt").agg(F.avg("intensity").alias("want"), F.sum("n").alias("n")).where("n > 0")
    rows = mine.join(triples, "smt").collect()
    assert rows and all(math.isclose(r.intensity_mean, r.want, abs_tol=1e-9) for r in rows)
