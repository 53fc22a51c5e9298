"""Streams of spikes against the operators on tables: disorder, repeats, restarts, batches done twice, and bounded state."""

import pathlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from neuroloom.operators import spikes as batch
from neuroloom.streaming import spikes as stream

ROWS = [(1, 0, 3), (1, 0, 13), (1, 0, 24), (2, 0, 3), (2, 0, 103), (3, 0, 104), (1, 1, 0), (1, 1, 9), (2, 1, 1439), (3, 1, 1430), (3, 2, 5), (3, 2, 5)]


def table(spark, rows):
    return spark.createDataFrame(rows, "neuron_id long, trial_id long, t long").withColumn("at", F.timestamp_seconds(F.col("trial_id") * 2 * batch.BINS + F.col("t")))


def expected(spark, rows, op):
    return sorted(tuple(r) for r in op(spikes=table(spark, rows).select("neuron_id", "trial_id", "t").distinct()).collect())


def run(spark, tmp_path, spikes, kind, slices=2):
    found, shape, result = {"pairs": (stream.coincidences, stream.partial_counts, stream.pair_totals), "bursts": (stream.bursts, stream.with_neuron, stream.burst_windows)}[kind]
    ends = []
    stream.replay(spikes, f"file://{tmp_path}/in", slices, lambda arrived: ends.append(stream.into(found(arrived), f"file://{tmp_path}/out", f"file://{tmp_path}/state", shape)))
    return ends, lambda: sorted(tuple(r) for r in result(spark, f"file://{tmp_path}/out").collect())


@pytest.mark.parametrize("kind", ["pairs", "bursts"])
def test_as_the_table(spark, tmp_path, kind):
    op = {"pairs": batch.ccg_pairs, "bursts": batch.gamma_windows}[kind]
    ends, got = run(spark, tmp_path, table(spark, ROWS), kind)
    assert got() == expected(spark, ROWS, op)
    assert len(ends) == 3
    left = [s["numRowsTotal"] for s in ends[-1].lastProgress["stateOperators"]]
    assert sum(left) <= 4 * len(left)  # the heartbeat alone


@pytest.mark.parametrize("kind", ["pairs", "bursts"])
def test_no_spikes(spark, tmp_path, kind):
    _, got = run(spark, tmp_path, table(spark, []), kind)
    assert got() == []


def arrive(spark, tmp_path, rows):
    table(spark, rows).write.mode("append").parquet(f"file://{tmp_path}/in")
    return stream.into(stream.coincidences(spark.readStream.schema(stream.SPIKE).parquet(f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/state", stream.partial_counts)


def totals(spark, tmp_path):
    return sorted(tuple(r) for r in stream.pair_totals(spark, f"file://{tmp_path}/out").collect())


def test_late_spikes_within_the_delay_count_and_repeats_do_not(spark, tmp_path):
    first, late = [(1, 0, 50), (2, 0, 90)], [(3, 0, 60), (1, 0, 50)]
    arrive(spark, tmp_path, first)
    arrive(spark, tmp_path, late)
    assert totals(spark, tmp_path) == expected(spark, first + late, batch.ccg_pairs)


def test_a_batch_done_twice_counts_once(spark, tmp_path):
    first, then = [(1, 0, 50), (2, 0, 90)], [(3, 0, 100)]
    arrive(spark, tmp_path, first)
    query = arrive(spark, tmp_path, then)
    before = totals(spark, tmp_path)
    commits = sorted((int(p.name), p) for p in pathlib.Path(tmp_path, "state", "commits").iterdir() if p.name.isdigit())
    commits[-1][1].with_name(f".{commits[-1][0]}.crc").unlink(missing_ok=True)
    commits[-1][1].unlink()  # as if the driver was lost after writing, before it noted the batch
    arrive(spark, tmp_path, [])
    assert query.exception() is None
    assert totals(spark, tmp_path) == before == expected(spark, first + then, batch.ccg_pairs)


def test_coincidences_hold_a_row_a_trial_and_tell_counts(spark, tmp_path):
    """Neither pairs nor spikes are rows of the state: one a trial, and a count for each pair of neurons and lag."""
    rows = [(n, k, t) for n in range(3) for k in (1, 2) for t in range(0, 200, 2)]
    query = arrive(spark, tmp_path, rows)
    busy = [p for p in query.recentProgress if p["numInputRows"]]
    assert [s["numRowsTotal"] for s in busy[0]["stateOperators"]] == [2]
    assert totals(spark, tmp_path) == expected(spark, rows, batch.ccg_pairs)


def test_event_times(spark):
    at = datetime(2024, 1, 2, 3, 4, 59, tzinfo=timezone.utc)
    events = spark.createDataFrame([(at, 43), (at + timedelta(seconds=1), None), (None, 1)], "ts timestamp, user_id long")
    rows = [tuple(r)[:3] for r in stream.spike_times(events).collect()]
    assert rows == [(3, 19724, 184), (None, 19724, 185), (1, None, None)]
