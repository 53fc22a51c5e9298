"""Generators: spiking networks, delays, connectivity and random trains.  Trials are independent, seeded tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The regular-spiking cell's constants.
C, VR, VT, K, A, B, RESET, D, PEAK = 100.0, -60.0, -40.0, 0.7, 0.03, -2.0, -50.0, 100.0, 35.0


def izhikevich(spark: SparkSession, links: list[tuple[int, int, float, int]], neurons: int, trials: int = 40, bins: int = 250, current: float = 112.0, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """(neuron_id, trial_id, t): spikes of cells joined by (src, dst, strength, delay), one task a trial."""

    by_source: dict[int, list[tuple[int, float, int]]] = {}
    for a, b, strength, delay in links:
        by_source.setdefault(a, []).append((b, strength, delay))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for trial in batch["id"].tolist():
                rng = np.random.default_rng([seed, trial])
                v, u = np.full(neurons, VR), np.zeros(neurons)
                due = np.zeros((bins + max([d for *_, d in links], default=0) + 2, neurons))
                for t in range(bins):
                    drive = current * (1 + noise * rng.standard_normal()) + due[t]
                    v, u = v + (K * (v - VR) * (v - VT) - u + drive) / C, u + A * (B * (v - VR) - u)
                    for i in np.flatnonzero(v >= PEAK).tolist():
                        out.append((i, trial, t))
                        v[i], u[i] = RESET, u[i] + D
                        for b, strength, delay in by_source.get(i, ()):
                            due[t + delay, b] += strength
            yield pd.DataFrame(out, columns=["neuron_id", "trial_id", "t"]).astype("int64")

    return spark.range(trials).repartition(min(trials, spark.sparkContext.defaultParallelism)).mapInPandas(run, "neuron_id long, trial_id long, t long")


def izhikevich_variable(spark: SparkSession, links: list[tuple[int, int, float]], neurons: int, trials: int = 40, bins: int = 250, delays: tuple[int, int] = (2, 5), currents: tuple[int, int] = (115, 124), noise: float = 0.25, seed: int = 0) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """((neuron_id, trial_id, t), (src, dst, delay)): the same cells with a random delay for each link and a random current for each cell.

    A cell's current in a bin is its own times a uniform number; the noise of a bin, one normal number, is added to all
    potentials.  Delays and currents are drawn from ``seed`` alone, so all trials share them.
    """
    rng = np.random.default_rng(seed)
    drawn = [(a, b, int(d)) for (a, b, _), d in zip(links, rng.integers(delays[0], delays[1] + 1, len(links)))]
    own = rng.integers(currents[0], currents[1] + 1, neurons)
    by_source: dict[int, list[tuple[int, float, int]]] = {}
    for (a, b, strength), (_, _, d) in zip(links, drawn):
        by_source.setdefault(a, []).append((b, strength, d))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for trial in batch["id"].tolist():
                rng = np.random.default_rng([seed, trial])
                v, u = np.full(neurons, VR), np.zeros(neurons)
                drive, due = own[:, None] * rng.random((neurons, bins)), np.zeros((bins + delays[1] + 2, neurons))
                for t in range(bins - 1):
                    dv = (K * (v - VR) * (v - VT) - u + drive[:, t] + due[t]) / C + noise * rng.standard_normal()
                    v, u = v + dv, u + A * (B * (v - VR) - u)
                    for i in np.flatnonzero(v >= PEAK).tolist():
                        out.append((i, trial, t + 1))
                        v[i], u[i] = RESET, u[i] + D
                        for b, strength, delay in by_source.get(i, ()):
                            due[t + 1 + delay, b] += strength
            yield pd.DataFrame(out, columns=["neuron_id", "trial_id", "t"]).astype("int64")

    rows = spark.range(trials).repartition(min(trials, spark.sparkContext.defaultParallelism)).mapInPandas(run, "neuron_id long, trial_id long, t long")
    return rows, drawn


def random_delays(edges: DataFrame, low: int = 2, high: int = 5, seed: int = 0) -> DataFrame:
    """A delay from ``low`` to ``high`` for every edge, by a hash of its columns: the same whatever the partitions; repeated rows have the same one."""
    return edges.withColumn("delay", (F.pmod(F.xxhash64(F.lit(seed), *edges.columns), F.lit(high - low + 1)) + low).cast("int"))


def random_adjacency(spark: SparkSession, n: int, inhibitory: float = 0.2, p: float = 0.1, seed: int = 0) -> DataFrame:
    """(src, dst, sign): each pair an edge with probability p; a source's edges share one sign."""
    src = spark.range(n).select(F.col("id").alias("src"), F.when(F.rand(seed) < inhibitory, -1).otherwise(1).alias("sign"))
    return src.crossJoin(spark.range(n).withColumnRenamed("id", "dst")).where("src <> dst").where(F.rand(seed + 1) < p).select("src", "dst", "sign")


def block_model(spark: SparkSession, blocks: int = 3, size: int = 30, inside: float = 0.1, across: float = 0.005, seed: int = 1234) -> DataFrame:
    n = spark.range(blocks * size)
    pairs = n.withColumnRenamed("id", "src").crossJoin(n.withColumnRenamed("id", "dst")).where("src <> dst")
    return pairs.where(F.rand(seed) < F.when(F.floor(F.col("src") / size) == F.floor(F.col("dst") / size), inside).otherwise(across))


def random_train(spark: SparkSession, bins: int = 1000, rate: float = 15, refractory: int = 5, trains: int = 10, seed: int = 0) -> DataFrame:
    """(neuron_id, t): Bernoulli spikes of about ``rate`` a train; one with another in the ``refractory`` bins up to it goes."""
    from pyspark.sql import Window

    raw = spark.range(trains).withColumnRenamed("id", "neuron_id").crossJoin(spark.range(bins).withColumnRenamed("id", "t")).where(F.rand(seed) < rate / bins)
    return raw.withColumn("n", F.count("*").over(Window.partitionBy("neuron_id").orderBy("t").rangeBetween(1 - refractory, 0))).where("n = 1").drop("n")
