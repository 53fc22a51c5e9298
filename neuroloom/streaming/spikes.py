"""Coincidences and bursts of spikes while they arrive: Structured Streaming forms of ``ccg_pairs`` and ``gamma_windows``.

One bin is one second of event time.  State is bounded by the watermark: a spike is held no longer than its window
or burst may still grow.  A spike more than ``delay`` bins behind the newest may be lost.  Rows without a neuron are
heartbeats: they move the watermark on and are never counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.spikes import BINS, WINDOW, lag_counts

SPIKE = "neuron_id long, trial_id long, t long, at timestamp"


def spike_times(events: DataFrame) -> DataFrame:
    """neuron_id, trial_id, t, at of every event; repeated spikes stay.  Works on tables and streams."""
    day, time = F.unix_date(F.to_date("ts")).cast("long"), (F.hour("ts") * 60 + F.minute("ts")).cast("long")
    found = events.select((F.col("user_id") % 20).cast("long").alias("neuron_id"), day.alias("trial_id"), time.alias("t"))
    return found.withColumn("at", F.timestamp_seconds(F.col("trial_id") * 2 * BINS + F.col("t")))  # trials lie further apart than any window


def coincidences(spikes: DataFrame, window: int = WINDOW, delay: int = 60) -> DataFrame:
    """(src, dst, lag, n): coincidences of two spikes of one trial, ``lag`` from 0 to ``window``, counted as soon as the second arrives.

    Repeated spikes count once.  State is a row a trial with the spikes that later ones may still meet; it goes when the watermark
    has passed the last by ``window``.  Pairs are counted by trial and never leave it as rows.
    """

    def run(key: tuple, arrived: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = np.frombuffer(state.get[0], np.int64).reshape(3, -1) if state.exists else np.empty((3, 0), np.int64)
        rows = pd.concat(arrived)
        seconds = rows["at"].to_numpy().astype("datetime64[s]").astype(np.int64)
        new = np.unique(np.stack([rows["neuron_id"].to_numpy(np.int64), rows["t"].to_numpy(np.int64), seconds]), axis=1)
        known = set(map(tuple, kept.T.tolist()))
        new = new[:, [c not in known for c in map(tuple, new.T.tolist())]] if known else new
        every = np.concatenate([kept, new], axis=1)
        for found in lag_counts(every[0], every[1], window):
            yield pd.DataFrame(found)
        for found in lag_counts(kept[0], kept[1], window):  # told before
            yield pd.DataFrame(found | {"n": -found["n"]})
        now = state.getCurrentWatermarkMs()
        every = every[:, (every[2] + window) * 1000 >= now]
        if every.shape[1]:
            state.update((every.tobytes(),))
            state.setTimeoutTimestamp(max(int(every[2].max() + window) * 1000, now + 1))
        elif state.exists:
            state.remove()

    whole = spikes.withWatermark("at", f"{delay} seconds").where("neuron_id IS NOT NULL AND trial_id IS NOT NULL AND t IS NOT NULL")
    return whole.groupBy("trial_id").applyInPandasWithState(run, "src long, dst long, lag long, n long", "spikes binary", "append", "EventTimeTimeout")


def bursts(spikes: DataFrame, burst: int = 10, delay: int = 60) -> DataFrame:
    """(neuron_id, trial_id, times): bursts, in which no gap exceeds ``burst``, as session windows.

    Repeated spikes count once.  A burst is emitted once the watermark has passed its end.
    """
    inside = F.session_window("at", f"{burst * 1000 + 500} milliseconds")  # times are whole seconds, so a gap of burst stays inside
    times = F.sort_array(F.collect_set("t")).alias("times")
    return spikes.withWatermark("at", f"{delay} seconds").groupBy("neuron_id", "trial_id", inside).agg(times).select("neuron_id", "trial_id", "times")


def partial_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst", "lag").agg(F.sum("n").alias("n")).where("n <> 0")


def with_neuron(found: DataFrame) -> DataFrame:
    return found.where("neuron_id IS NOT NULL")


def into(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Take all that has arrived, write ``shape`` of each micro-batch to a folder of its own and return the ended query, which tells its progress.

    A batch done again after a failure overwrites its own folder, so each counts once.  Called again, it goes on from the checkpoint.
    """

    def write(rows: DataFrame, batch: int) -> None:
        shape(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def pair_totals(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, lag, n) over all batches so far."""
    return spark.read.schema("src long, dst long, lag long, n long").parquet(path).groupBy("src", "dst", "lag").agg(F.sum("n").alias("n"))


def burst_windows(spark: SparkSession, path: str, bins: int = BINS, burst_length: int = 25) -> DataFrame:
    """The columns of ``gamma_windows`` of all bursts emitted so far."""
    found = spark.read.schema("neuron_id long, trial_id long, times array<long>").parquet(path).select("neuron_id", "trial_id", "times", F.col("times")[0].alias("head"))
    place = F.row_number().over(Window.partitionBy("neuron_id", "trial_id").orderBy("head")).cast("long")
    rows = found.withColumn("burst", place).select("neuron_id", "trial_id", F.explode("times").alias("t"), "burst", "head")
    first = F.floor(F.col("head") / burst_length) * burst_length + F.col("t") - F.col("head")
    return rows.withColumn("first", F.greatest(F.lit(0), F.least(first, F.lit(bins - burst_length))).cast("long"))


def replay(spikes: DataFrame, folder: str, slices: int, step: Callable[[DataFrame], object]) -> None:
    """Let a table of spikes arrive in ``slices`` parts by time and a last heartbeat; ``step`` takes the stream after each.

    The cuts are approximate quantiles, so that the driver sees only them.
    """
    spark = spikes.sparkSession
    second = spikes.withColumn("second", F.unix_seconds("at"))
    cuts = second.approxQuantile("second", [k / slices for k in range(1, slices)], 0.01) if slices > 1 else []
    last = second.agg(F.max("second")).first()[0]
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col("second") > c).cast("int")
    stream = lambda: spark.readStream.schema(SPIKE).parquet(folder)
    for k in range(slices):
        second.where(part == k).select("neuron_id", "trial_id", "t", "at").write.mode("append").parquet(folder)
        step(stream())
    if last is not None:
        beat = spark.range(1).select(F.lit(None).cast("long").alias("neuron_id"), F.lit(None).cast("long").alias("trial_id"), F.lit(None).cast("long").alias("t"), F.timestamp_seconds(F.lit(last + 4 * BINS)).alias("at"))
        beat.write.mode("append").parquet(folder)
        step(stream())
