"""The model's tables, and how they are read or made from the driver's tables.

spikes(neuron_id, trial_id, t): one row a spike, one bin a millisecond
stimulus_spikes(stimulus, neuron_id, trial_id, t): the same by stimulus
edges(session, stimulus, src, dst, weight, confidence, edge_offset, duration): a signed digraph for each session and stimulus
nodes(node, area): all nodes, isolated ones too
ccg(src, dst, lag, value): cross-correlograms in long form, no diagonal
scorr(i, j, r): signal correlation of unordered pairs, i < j
comms(run, comm, node): partitions
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sql import SqlOperator, operator

BASE = {o.name: o for o in (
    operator("spikes", "SELECT DISTINCT CAST(user_id % 20 AS BIGINT) AS neuron_id, CAST(DAY_NUMBER(ts) AS BIGINT) AS trial_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS t FROM {events}"),
    operator("stimulus_spikes", "SELECT DISTINCT event_type AS stimulus, CAST(user_id % 20 AS BIGINT) AS neuron_id, CAST(DAY_NUMBER(ts) AS BIGINT) AS trial_id, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS t FROM {events}"),
    operator("edges", """
WITH c AS (
  SELECT l_returnflag AS session, o_orderpriority AS stimulus, CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS n
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY l_returnflag, o_orderpriority, s_nationkey, c_nationkey),
z AS (SELECT session, stimulus, src, dst, n, (n - avg(n) OVER (PARTITION BY session, stimulus)) / nullif(stddev_pop(n) OVER (PARTITION BY session, stimulus), 0) AS z FROM c)
SELECT session, stimulus, src, dst, round(z, 6) AS weight, round(abs(z) + 1, 6) AS confidence, n % 12 AS edge_offset, n % 5 AS duration FROM z WHERE abs(z) > 1"""),
    operator("nodes", "SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_regionkey AS BIGINT) AS area FROM {nation}"),
    operator("ccg", """
WITH s AS (SELECT CAST(ceil(sqrt(max(vec_id) + 1)) AS BIGINT) AS side FROM {embeddings}),
p AS (SELECT CAST(floor(vec_id / side) AS BIGINT) AS src, vec_id % side AS dst, embedding AS e FROM {embeddings} CROSS JOIN s)
SELECT src, dst, CAST(lag AS BIGINT) AS lag, CAST(value AS DOUBLE) AS value FROM p VALUES_OF(e) WHERE src <> dst"""),
    operator("scorr", """
WITH m AS (SELECT CAST(c_nationkey AS BIGINT) AS node, year(o_orderdate) * 12 + month(o_orderdate) AS mon, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, year(o_orderdate) * 12 + month(o_orderdate)),
g AS (SELECT node, mon FROM (SELECT DISTINCT node FROM m) a CROSS JOIN (SELECT DISTINCT mon FROM m) b),
f AS (SELECT g.node, g.mon, coalesce(n, 0) AS n FROM g LEFT JOIN m ON g.node = m.node AND g.mon = m.mon)
SELECT a.node AS i, b.node AS j, round(corr(a.n, b.n), 6) AS r FROM f a JOIN f b ON a.mon = b.mon AND a.node < b.node GROUP BY a.node, b.node"""),
    operator("comms", "WITH r AS (SELECT SERIES(0, 4) AS run) SELECT CAST(run AS BIGINT) AS run, CAST((n_nationkey * (run + 1) + run) % 4 AS BIGINT) AS comm, CAST(n_nationkey AS BIGINT) AS node FROM {nation} CROSS JOIN r"),
)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table over the driver's parquet tables."""
    op: SqlOperator = BASE[name]
    return op(**{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in op.inputs})


def read_edges(spark: SparkSession, path: str, session: str | None = None, stimulus: str | None = None) -> DataFrame:
    """A stored catalogue of graphs, partitioned by session and stimulus; a filter on them prunes folders."""
    df = spark.read.parquet(path)
    for column, value in (("session", session), ("stimulus", stimulus)):
        df = df if value is None else df.where(df[column] == value)
    return df


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.partitionBy("session", "stimulus").mode("overwrite").parquet(path)
