"""Spike trains: rates, coincidences, cross-correlograms, jitter windows and surrogates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from .sql import SqlOperator, operator

BINS, WINDOW = 1440, 100


def lag_counts(neuron: np.ndarray, t: np.ndarray, window: int, lane: np.ndarray | None = None) -> Iterator[dict[str, np.ndarray]]:
    """src, dst, lag, n: spikes of two neurons at lags 0 to ``window``, summed over lanes (samples, which do not meet), nonzero ones of 64 sources at a time.

    A stretch of time is a matrix of neurons by bins, and a lag the product of it with itself moved on: the cost grows with bins
    and not with pairs of spikes.  Counts are whole numbers that the products hold exactly.
    """
    if not len(t):
        return
    ids, row = np.unique(neuron, return_inverse=True)
    lane = np.zeros(len(t), np.int64) if lane is None else lane
    width = int(min(max(t.max() - t.min() + 1, window + 1), 4096))
    place = t - t.min()
    order = np.lexsort((place, lane))
    row, lane, place = row[order], lane[order], place[order]
    stretches = np.unique(np.stack([lane, place // width]), axis=1).T.tolist()
    for low in range(0, len(ids), 64):
        out = np.zeros((window + 1, len(ids[low : low + 64]), len(ids)))
        for of, k in stretches:
            first, last = np.searchsorted(lane, [of, of + 1])
            first, last = first + np.searchsorted(place[first:last], [k * width, (k + 1) * width + window])
            cells = np.bincount(row[first:last] * (width + window) + place[first:last] - k * width, minlength=len(ids) * (width + window)).reshape(len(ids), -1)
            cells = cells.astype(np.float32 if cells.max() <= 64 else np.float64)  # 64 * 64 * 4096 is the last whole number of 32 bits
            for lag in range(window + 1):
                out[lag] += cells[low : low + 64, :width] @ cells[:, lag : lag + width].T
        lag, src, dst = np.nonzero(out)
        other = src + low != dst
        lag, src, dst = lag[other], src[other], dst[other]
        yield {"src": ids[src + low], "dst": ids[dst], "lag": lag, "n": out[lag, src, dst].astype(np.int64)}


def trial_counts(spikes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(src, dst, lag, n): the coincidences of ``ccg_pairs``, counted by trial and summed."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(rows)
        for found in lag_counts(rows["neuron_id"].to_numpy(), rows["t"].to_numpy(), window):
            yield pd.DataFrame(found)

    whole = spikes.select("neuron_id", "trial_id", "t").dropna()
    return whole.groupBy("trial_id").applyInPandas(run, "src long, dst long, lag long, n long").groupBy("src", "dst", "lag").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counted(SqlOperator):
    """An operator on coincidences: ``body`` joins spikes, ``over`` reads the counts of ``trial_counts``, which Spark runs."""

    window: int
    over: SqlOperator

    def __call__(self, **frames: DataFrame) -> DataFrame:
        return self.over(**frames, counts=trial_counts(frames["spikes"], self.window))


def correlograms(bins: int = BINS, window: int = WINDOW, length: int = 5, burst_length: int = 25, burst: int = 10) -> dict[str, SqlOperator]:
    """The operators on trials of ``bins`` milliseconds: rates, coincidences at lags 0 to ``window``, normalised correlograms, jitter windows.

    ``length``: places of a spike's window without memory; ``burst_length``: the grid in which bursts are placed; ``burst``: the longest gap inside one.
    """
    if not 0 <= window < bins or not 0 < length <= bins or not 0 < burst_length <= bins:
        raise ValueError("lags and windows lie inside a trial")
    # A range join: spikes meet in their own time bucket and the one before, so the join has equal keys.  Spark counts by ``trial_counts`` instead.
    counts = f"""
a AS (SELECT trial_id, neuron_id, t, CAST(floor(t / {window + 1}) AS BIGINT) AS bucket FROM {{spikes}}),
b AS (SELECT trial_id, neuron_id, t, bucket FROM a UNION ALL SELECT trial_id, neuron_id, t, bucket - 1 FROM a),
c AS (SELECT a.neuron_id AS src, b.neuron_id AS dst, b.t - a.t AS lag, count(*) AS n FROM a JOIN b
  ON a.trial_id = b.trial_id AND a.bucket = b.bucket AND b.t - a.t BETWEEN 0 AND {window} AND a.neuron_id <> b.neuron_id GROUP BY a.neuron_id, b.neuron_id, b.t - a.t)"""
    normal = lambda first, c: f"""{first}k AS (SELECT count(DISTINCT trial_id) AS trials FROM {{spikes}}),
r AS (SELECT neuron_id, count(*) / (max(trials) * {bins} / 1000.0) AS f FROM {{spikes}} CROSS JOIN k GROUP BY neuron_id),
l AS (SELECT SERIES(0, {window}) AS lag),
g AS (SELECT x.neuron_id AS src, y.neuron_id AS dst, CAST(lag AS BIGINT) AS lag, x.f AS fa, y.f AS fb FROM r x JOIN r y ON x.neuron_id <> y.neuron_id CROSS JOIN l)
SELECT g.src, g.dst, g.lag, round(coalesce(n, 0) / (trials * ({bins} - g.lag) / 1000.0 * sqrt(fa * fb)), 6) AS ccg
FROM g LEFT JOIN {c} c ON g.src = c.src AND g.dst = c.dst AND g.lag = c.lag CROSS JOIN k"""  # noqa: E731
    low = f"greatest(0, least(t - {(length + 1) // 2 - 1}, {bins} - {length}))"
    return {o.name: o for o in (
        operator("firing_rate", f"""
SELECT neuron_id, count(*) AS spikes, round(count(*) / (max(n) * {bins} / 1000.0), 6) AS rate
FROM {{spikes}} CROSS JOIN (SELECT count(DISTINCT trial_id) AS n FROM {{spikes}}) k GROUP BY neuron_id"""),
        Counted(**vars(operator("ccg_pairs", f"WITH {counts} SELECT src, dst, lag, n FROM c")), window=window, over=operator("ccg_pairs", "SELECT src, dst, lag, n FROM {counts}")),
        Counted(**vars(operator("ccg_normalised", f"WITH {normal(f'{counts},{chr(10)}', 'c')}")), window=window, over=operator("ccg_normalised", f"WITH {normal('', '{counts}')}")),
        # The window a spike may move in without memory, clamped to the trial.
        operator("omega_windows", f"SELECT neuron_id, trial_id, t, {low} AS first, {low} + {length - 1} AS last FROM {{spikes}}"),
        # With memory: a longer gap starts a burst, whose head is placed in a grid and whose other spikes follow it.
        operator("gamma_windows", f"""
WITH g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY neuron_id, trial_id ORDER BY t) <= {burst} THEN 0 ELSE 1 END AS starts FROM {{spikes}}),
b AS (SELECT *, sum(starts) OVER (PARTITION BY neuron_id, trial_id ORDER BY t) AS burst FROM g),
h AS (SELECT neuron_id, trial_id, t, CAST(burst AS BIGINT) AS burst, min(t) OVER (PARTITION BY neuron_id, trial_id, burst) AS head FROM b)
SELECT neuron_id, trial_id, t, burst, head, greatest(0, least(CAST(floor(head / {burst_length}) * {burst_length} AS BIGINT) + t - head, {bins} - {burst_length})) AS first FROM h"""),
    )}


def correlogram(name: str, bins: int = BINS, window: int = WINDOW, **more: int) -> SqlOperator:
    return correlograms(bins, window, **more)[name]


firing_rate, ccg_pairs, ccg_normalised, omega_windows, gamma_windows = correlograms().values()

burst_sizes = operator("spike_times", "SELECT neuron_id, trial_id, count(*) AS spikes, min(t) AS first, max(t) AS last, max(gap) AS longest_gap FROM (SELECT *, t - lag(t) OVER (PARTITION BY neuron_id, trial_id ORDER BY t) AS gap FROM {spikes}) s GROUP BY neuron_id, trial_id")

# Every spike of every neuron and trial with its place in the train and the gap before it (null for the first).
spike_train = operator("spike_train", "SELECT neuron_id, trial_id, t, CAST(row_number() OVER (PARTITION BY neuron_id, trial_id ORDER BY t) AS BIGINT) AS place, CAST(t - lag(t) OVER (PARTITION BY neuron_id, trial_id ORDER BY t) AS BIGINT) AS gap FROM {spikes}")

# All trials end to end, with blanks of 50 between them.  Spikes without a trial take no room and have no place.
raster = operator("raster", f"""
WITH place AS (SELECT trial_id, (CAST(row_number() OVER (ORDER BY trial_id) AS BIGINT) - 1) * {BINS + 50} AS base FROM (SELECT DISTINCT trial_id FROM {{spikes}} WHERE trial_id IS NOT NULL) d)
SELECT s.neuron_id, s.trial_id, CAST(base + s.t AS BIGINT) AS at, n.area FROM {{spikes}} s LEFT JOIN place p ON s.trial_id = p.trial_id JOIN {{nodes}} n ON n.node = s.neuron_id""")


def stimulus_raster(name: str, lengths: dict[str, int], blank: int = 50) -> SqlOperator:
    """The first trial of every stimulus in ``lengths``, cut to its length and set end to end in that order with blanks between.

    ``line`` is a neuron's place when neurons are sorted by area and number; those without an area, and spikes of no known neuron, are left out.
    """
    plan, base = [], 0
    for stimulus, length in lengths.items():
        quoted = stimulus.replace("'", "''")
        plan.append(f"('{quoted}', {length}, {base})")
        base += length + blank
    return operator(name, f"""
WITH plan AS (SELECT * FROM (VALUES {", ".join(plan)}) AS v(stimulus, length, base)),
head AS (SELECT stimulus, min(trial_id) AS trial_id FROM {{stimulus_spikes}} GROUP BY stimulus),
sizes AS (SELECT area, count(*) AS size FROM {{nodes}} WHERE area IS NOT NULL GROUP BY area),
starts AS (SELECT area, sum(size) OVER (ORDER BY area) - size AS start FROM sizes),
lines AS (SELECT n.node, n.area, row_number() OVER (PARTITION BY n.area ORDER BY n.node) - 1 + start AS line FROM {{nodes}} n JOIN starts ON starts.area = n.area)
SELECT s.stimulus, s.neuron_id, area, CAST(line AS BIGINT) AS line, CAST(base + s.t AS BIGINT) AS at
FROM {{stimulus_spikes}} s JOIN plan ON plan.stimulus = s.stimulus AND s.t < length JOIN head ON head.stimulus = s.stimulus AND head.trial_id = s.trial_id JOIN lines ON lines.node = s.neuron_id""")


stimuli_raster = stimulus_raster("stimulus_raster", {"click": 1440, "error": 1200, "purchase": 960, "signup": 720, "view": 480})

# The bands of the raster: how many neurons an area has and the line of its first.
raster_areas = operator("raster_areas", "WITH sizes AS (SELECT area, count(*) AS size FROM {nodes} WHERE area IS NOT NULL GROUP BY area) SELECT area, size, CAST(sum(size) OVER (ORDER BY area) - size AS BIGINT) AS start FROM sizes")


def _jittered(rows: pd.DataFrame, samples: int, length: int, bins: int, seed: int, memory: bool, burst: int) -> pd.DataFrame:
    """The trains of ``surrogates`` of one trial."""
    trial = int(rows["trial_id"].iloc[0])
    rng = np.random.default_rng((seed + 1_000_003 * trial) % (2**32 - 1))
    out = []
    for neuron, times in sorted(rows.groupby("neuron_id")["t"]):
        times = np.sort(times.to_numpy())
        gaps = np.diff(times)
        lows = times - (length + 1) // 2 + 1
        if memory:
            head = np.maximum.accumulate(np.where(np.concatenate([[True], gaps > burst]), times, -1))
            lows = head // length * length + times - head
        lows = np.clip(lows, 0, bins - length)
        start = np.cumsum(rng.random(length))
        moves = np.cumsum(rng.random((len(times) - 1, length, length)), axis=2)
        for s in range(samples):
            used: set[int] = set()
            now = 0
            for k, low in enumerate(lows.tolist()):
                if k and memory and gaps[k - 1] <= burst:
                    now = min(now + int(gaps[k - 1]), bins - 1)
                else:
                    line = moves[k - 1, min(max(now - int(lows[k - 1]), 0), length - 1)] if k else start
                    now = low + min(int(line.searchsorted(rng.random() * line[-1], side="right")), length - 1)
                if now in used:
                    free = [p for p in range(low, low + length) if p not in used]
                    now = int(rng.choice(free)) if free else next(p for d in range(bins) for p in (now - d, now + d) if 0 <= p < bins and p not in used)
                used.add(now)
                out.append((s, neuron, trial, now))
    return pd.DataFrame(out, columns=["sample", "neuron_id", "trial_id", "t"])


def surrogates(spikes: DataFrame, samples: int = 10, length: int = 25, bins: int = BINS, seed: int = 42, memory: bool = False, burst: int = 10) -> DataFrame:
    """(sample, neuron_id, trial_id, t): jittered trains by a chain of random moves, one generator a trial.

    Each spike's window has ``length`` places about it.  A neuron's samples share one random start
    distribution and one random row-stochastic matrix for each later spike: the next place is drawn
    from the row of the place before.  With ``memory`` a spike at most ``burst`` bins after another
    keeps that interval; a burst's head has the window of the grid cell it lies in, the others follow it.
    A time already taken is drawn anew among the window's free ones, or, if there is none, is the nearest free one
    of the trial, so spike counts stay.  Trials are independent groups; a trial with a seed gives the same trains
    wherever it runs.
    """

    run = lambda rows: _jittered(rows, samples, length, bins, seed, memory, burst)
    return spikes.groupBy("trial_id").applyInPandas(run, "sample int, neuron_id long, trial_id long, t long")


def ccg_corrected(spikes: DataFrame, samples: int = 10, seed: int = 42, memory: bool = False, bins: int = BINS, window: int = WINDOW, length: int = 25, burst: int = 10) -> DataFrame:
    """(src, dst, lag, ccg): the mean correlogram of trials of ``bins`` at lags 0 to ``window``, less that of jittered trains, by the original rates.

    ``length`` and ``burst`` are those of ``surrogates``.
    """
    ops, spikes = correlograms(bins, window), staged(spikes, "spikes")

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Coincidences of a trial's spikes, and of all its jittered trains together, which never leave the task."""
        rows = pd.concat(rows)
        for found in lag_counts(rows["neuron_id"].to_numpy(), rows["t"].to_numpy(), window):
            yield pd.DataFrame(found | {"jittered": 0})
        moved = _jittered(rows, samples, length, bins, seed, memory, burst)
        for found in lag_counts(moved["neuron_id"].to_numpy(), moved["t"].to_numpy(), window, moved["sample"].to_numpy()):
            yield pd.DataFrame({**found, "n": 0, "jittered": found["n"]})

    by_trial = spikes.dropna().groupBy("trial_id").applyInPandas(run, "src long, dst long, lag long, n long, jittered long")
    counts = staged(by_trial.groupBy("src", "dst", "lag").agg(F.sum("n").alias("n"), F.sum("jittered").alias("jittered")), "counts")
    raw = ops["ccg_normalised"].over(spikes=spikes, counts=counts)
    rates = ops["firing_rate"](spikes=spikes)
    trials = spikes.agg(F.countDistinct("trial_id").alias("trials"))
    f = lambda k: rates.select(F.col("neuron_id").alias(k), (F.col("spikes")).alias(f"n_{k}"))
    scaled = counts.join(f("src"), "src").join(f("dst"), "dst").crossJoin(trials)
    rate = lambda c: F.col(c) / (F.col("trials") * bins / 1000.0)
    value = F.col("jittered") / (F.col("trials") * samples * (bins - F.col("lag")) / 1000.0 * F.sqrt(rate("n_src") * rate("n_dst")))
    both = raw.join(scaled.select("src", "dst", "lag", value.alias("mean")), ["src", "dst", "lag"], "left")
    return both.select("src", "dst", "lag", F.round(F.col("ccg") - F.coalesce("mean", F.lit(0.0)), 6).alias("ccg"))


def network(spikes: DataFrame, samples: int = 10, seed: int = 42, memory: bool = False, level: float = 2.5, maxlag: int = 12, max_duration: int = 6, bins: int = BINS, window: int = WINDOW, length: int = 25) -> DataFrame:
    """From spikes to edges: the significant peaks and intervals of the jitter-corrected correlograms (src, dst, weight, confidence, edge_offset, duration)."""
    from .detect import detector

    return detector("significant_ccg", level, maxlag, max_duration)(ccg=ccg_corrected(spikes, samples, seed, memory, bins, window, length).withColumnRenamed("ccg", "value"))
