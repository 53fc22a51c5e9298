"""Trials of any length: rates, correlograms, jitter windows and detected edges by parameters."""

import math
from collections import Counter

import numpy as np
import pytest

from neuroloom.operators import spikes

SPIKES = "neuron_id long, trial_id long, t long"


def test_fixture_of_one_trial_of_a_hundred(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 0, 50), (1, 0, 13), (1, 0, 53)], SPIKES)
    rates = spikes.correlogram("firing_rate", bins=100, window=99)(spikes=df).collect()
    assert {r.neuron_id: r.rate for r in rates} == {0: 20.0, 1: 20.0}
    got = {(r.src, r.dst, r.lag): r.ccg for r in spikes.correlogram("ccg_normalised", bins=100, window=99)(spikes=df).collect()}
    want = {(0, 1, 3): 1.030928, (0, 1, 43): 0.877193, (1, 0, 37): 0.793651}
    assert len(got) == 200 and all(v == pytest.approx(want.get(k, 0.0), abs=1e-6) for k, v in got.items())
    df = spark.createDataFrame([(0, 0, t) for t in (0, 10, 99)], SPIKES)
    assert {r.t: (r.first, r["last"]) for r in spikes.correlogram("omega_windows", 100, 20)(spikes=df).collect()} == {0: (0, 4), 10: (8, 12), 99: (95, 99)}
    df = spark.createDataFrame([(0, 0, t) for t in (30, 36, 60, 249)], SPIKES)
    assert {r.t: r.first for r in spikes.correlogram("gamma_windows", 250, 20)(spikes=df).collect()} == {30: 25, 36: 31, 60: 50, 249: 225}
    assert {r.t: r.first for r in spikes.correlogram("gamma_windows", 250, 20, burst_length=10, burst=3)(spikes=df).collect()} == {30: 30, 36: 30, 60: 60, 249: 240}
    with pytest.raises(ValueError):
        spikes.correlogram("ccg_pairs", bins=100, window=100)


def test_correlograms_against_brute_force(spark):
    rng = np.random.default_rng(4)
    bins, window, trials = 120, 15, 3
    rows = sorted({(int(n), k, int(t)) for k in range(trials) for n in range(3) for t in rng.integers(0, bins, 25)})
    got = {(r.src, r.dst, r.lag): r.ccg for r in spikes.correlogram("ccg_normalised", bins, window)(spikes=spark.createDataFrame(rows, SPIKES)).collect()}
    rate = {n: sum(a == n for a, _, _ in rows) / (trials * bins / 1000) for n in range(3)}
    held = set(rows)
    for (a, b, lag), v in got.items():
        n = sum((b, k, t + lag) in held for x, k, t in rows if x == a)
        assert v == pytest.approx(n / (trials * (bins - lag) / 1000 * math.sqrt(rate[a] * rate[b])), abs=1e-6)
    assert len(got) == 6 * (window + 1)


def test_network_of_short_trials_finds_the_delay(spark):
    """A drives B after 3 ms in trials of 250."""
    rng = np.random.default_rng(5)
    rows = set()
    for k in range(60):
        for t in rng.integers(0, 240, 12).tolist():
            rows |= {(0, k, t), (1, k, t + 3)} if rng.random() < 0.8 else {(0, k, t)}
        rows |= {(1, k, int(t)) for t in rng.integers(0, 250, 3)}
    df = spark.createDataFrame(sorted(rows), SPIKES)
    got = spikes.network(df, samples=4, level=4.0, maxlag=12, max_duration=0, bins=250, window=50, length=25).collect()
    best = max(got, key=lambda r: r.confidence)
    assert (best.src, best.dst, best.edge_offset, best.duration) == (0, 1, 3, 0) and best.weight > 0
    lags = spikes.ccg_corrected(df, 2, bins=250, window=50).select("lag").distinct().count()
    assert lags == 51


def test_coincidences_are_counted_without_joining_spikes(spark):
    """Against all pairs: repeats, times before 0, long trials, more neurons than a block of sources; and no plan joins spikes with spikes."""
    rng = np.random.default_rng(8)
    rows = [(int(n), 0, int(t)) for n, t in zip(rng.integers(0, 90, 400), rng.integers(-60, 9000, 400))]
    rows += [(int(n), 1, int(t)) for n, t in zip(rng.integers(0, 3, 200), rng.integers(0, 40, 200))] + [(5, 2, 7)]
    want = Counter((a, b, u - t) for a, k, t in rows for b, j, u in rows if k == j and a != b and 0 <= u - t <= 30)
    df = spark.createDataFrame([*rows, (None, 1, 3), (1, None, 3)], SPIKES)
    got = spikes.correlogram("ccg_pairs", bins=9000, window=30)(spikes=df)
    assert {(r.src, r.dst, r.lag): r.n for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert spikes.trial_counts(df.limit(0)).count() == 0


def test_corrected_by_the_trains_of_surrogates(spark):
    """The jittered part is the count over the trains that ``surrogates`` gives with the same seed."""
    rng = np.random.default_rng(4)
    rows = sorted({(int(n), int(k), int(t)) for n, k, t in zip(rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 200, 500))})
    df = spark.createDataFrame(rows, SPIKES)
    n, trains = Counter(r[0] for r in rows), [tuple(r) for r in spikes.surrogates(df, 2, 25, 200, 7).select("sample", "trial_id", "neuron_id", "t").collect()]
    hits = lambda rs: Counter((a, b, u - t) for s, k, a, t in rs for q, j, b, u in rs if (s, k) == (q, j) and a != b and 0 <= u - t <= 20)
    raw, moved = hits([(0, k, a, t) for a, k, t in rows]), hits(trains)
    for r in spikes.ccg_corrected(df, 2, 7, bins=200, window=20, length=25).collect():
        at, scale = (r.src, r.dst, r.lag), 200 / ((200 - r.lag) * (n[r.src] * n[r.dst]) ** 0.5)
        assert abs(r.ccg - (raw[at] - moved[at] / 2) * scale) < 2e-6


def test_raster_of_first_trials(spark):
    """Lengths cut, blanks between, first trials alone, lines by area; no area, unknown neurons, stimuli not asked for and repeats are left out or kept once."""
    rows = [("b", 5, 2, 0), ("b", 5, 2, 9), ("b", 5, 3, 1), ("a", 1, 0, 19), ("a", 1, 0, 20), ("a", 7, 0, 3), ("a", 8, 0, 4), ("a", 9, 0, 4), ("it's", 5, 4, 2), ("z", 5, 0, 0)]
    df = spark.createDataFrame(rows, "stimulus string, neuron_id long, trial_id long, t long")
    nodes = spark.createDataFrame([(1, 1), (5, 0), (7, 0), (8, None)], "node long, area long")
    got = sorted(tuple(r) for r in spikes.stimulus_raster("r", {"b": 8, "a": 20, "it's": 4, "none": 9}, blank=2)(stimulus_spikes=df, nodes=nodes).collect())
    assert got == [("a", 1, 1, 2, 10 + 19), ("a", 7, 0, 1, 10 + 3), ("b", 5, 0, 0, 0), ("it's", 5, 0, 0, 32 + 2)]
    assert sorted(tuple(r) for r in spikes.raster_areas(nodes=nodes).collect()) == [(0, 2, 0), (1, 1, 2)]
    assert spikes.stimuli_raster(stimulus_spikes=df.limit(0), nodes=nodes.limit(0)).count() == 0


def test_raster_keeps_every_spike(spark):
    """Spikes late in a trial and those without a trial stay, the latter without a place and without moving the others; places may pass 32 bits."""
    nodes = spark.createDataFrame([(1, 0), (2, 1)], "node long, area long")
    df = spark.createDataFrame([(1, 4, 5), (2, 4, 1439), (1, 9, 0), (2, None, None), (1, None, 3)], SPIKES)
    got = [tuple(r) for r in spikes.raster(spikes=df, nodes=nodes).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, 5, 0), (2, 4, 1439, 1), (1, 9, 1490, 0), (2, None, None, 1), (1, None, None, 0)], key=str)
    many = spark.range(1_500_000).selectExpr("1L AS neuron_id", "id AS trial_id", "0L AS t")
    assert spikes.raster(spikes=many, nodes=nodes).selectExpr("max(at)").first()[0] == 1_499_999 * 1490
