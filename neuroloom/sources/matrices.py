"""Adjacency matrices in NumPy archives, read into long tables and joined to graphs."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.paths import largest_strong

SIDES = ("confidence", "offset", "duration")


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of one archive's matrix, NaN included and zeros not; a cube is flattened to rows of its last axis.

    Forms: one dense array; row, col, data; or indices, indptr, data (compressed rows, or columns with format csc).  An array
    ``ndim`` tells a cube's shape.  Pickled objects are refused.
    """
    with np.load(io.BytesIO(data), allow_pickle=False) as archive:
        parts = {k: archive[k] for k in archive.files}
    if "indptr" in parts:
        major, minor = np.repeat(np.arange(len(parts["indptr"]) - 1), np.diff(parts["indptr"])), parts["indices"]
        i, j = (minor, major) if str(parts.get("format", "csr").item() if hasattr(parts.get("format"), "item") else "csr").strip("b'") == "csc" else (major, minor)
        v = parts["data"]
    elif "row" in parts:
        i, j, v = parts["row"], parts["col"], parts["data"]
    else:
        names = [k for k in parts if k != "ndim"]
        if len(names) != 1:
            raise ValueError(f"an archive of {sorted(parts)} is no matrix")
        dense = np.asarray(parts[names[0]], float)
        dense = dense.reshape(-1, dense.shape[-1])
        i, j = np.nonzero(dense)
        v = dense[i, j]
    if "ndim" in parts:
        last = int(parts["ndim"][-1])
        wide = int(np.prod(parts["ndim"][1:]))
        flat = np.asarray(i, np.int64) * wide + j
        i, j = flat // last, flat % last
    kept = np.asarray(v, float) != 0
    return np.asarray(i, np.int64)[kept], np.asarray(j, np.int64)[kept], np.asarray(v, float)[kept]


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, j, value) of every .npz file of a folder, each read by one task; any store that Spark reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                i, j, v = entries(content)
                yield pd.DataFrame({"name": name.rsplit("/", 1)[-1].removesuffix(".npz"), "i": i, "j": j, "value": v})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "name string, i long, j long, value double")


def graphs(matrices: DataFrame, areas: DataFrame, weighted: bool = True, relabel: bool = True, cc: bool = False) -> DataFrame:
    """The edges of matrices named session_stimulus, with those of session_stimulus_confidence and the like at their side.

    ``areas`` (session, node, area, is_active): a matrix's places are the session's active nodes in order, which ``relabel`` puts in.
    NaN counts as no edge and no confidence; ``weighted`` false gives all edges the weight 1; ``cc`` keeps each graph's largest strongly
    connected component.
    """
    side = F.regexp_extract("name", f"_({'|'.join(SIDES)})$", 1)
    named = matrices.where(~F.isnan("value")).withColumn("side", side).withColumn("base", F.regexp_replace("name", f"_({'|'.join(SIDES)})$", ""))
    keys = [F.substring_index("base", "_", 1).alias("session"), F.expr("substr(base, instr(base, '_') + 1)").alias("stimulus")]
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    wide = named.groupBy("base", "i", "j").agg(pick("").alias("weight"), *[pick(s).alias(s) for s in SIDES]).where("weight IS NOT NULL")
    out = wide.select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"), "weight" if weighted else F.lit(1.0).alias("weight"), "confidence", F.col("offset").cast("long").alias("edge_offset"), F.col("duration").cast("long").alias("duration"))
    if relabel:
        place = active(areas).select(F.col("session").alias("s"), "node", (F.row_number().over(Window.partitionBy("session").orderBy("node")) - 1).cast("long").alias("at"))
        for end in ("src", "dst"):
            p = place.select(F.col("s").alias("session"), F.col("at").alias(end), F.col("node").alias(f"{end}_node"))
            out = out.join(p, ["session", end]).drop(end).withColumnRenamed(f"{end}_node", end)
        out = out.select("session", "stimulus", "src", "dst", "weight", "confidence", "edge_offset", "duration")
    return largest_strong(out) if cc else out


def active(areas: DataFrame) -> DataFrame:
    """Only active nodes, sessions as text."""
    return areas.withColumn("session", F.col("session").cast("string")).where("is_active")


AREAS = "session string, areas map<string,string>, active array<long>"


def write_areas(areas: DataFrame, path: str) -> None:
    """A line of JSON a session: its nodes' areas by node, and which nodes are active.  Nodes without a number are left out; of repeated ones the last area in order stays."""
    one = areas.where("node IS NOT NULL").groupBy(F.col("session").cast("string").alias("session"), "node").agg(F.max(F.col("area").cast("string")).alias("area"), F.max("is_active").alias("on"))
    lines = one.groupBy("session").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("node").cast("string").alias("node"), "area")))).alias("areas"), F.sort_array(F.collect_list(F.when(F.col("on"), F.col("node").cast("long")))).alias("active")
    )
    lines.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_areas(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """session, node, area, is_active of stored areas: sessions are text and nodes numbers, whatever the file has.

    A file without ``active`` makes all nodes active; nodes that are no numbers are left out.
    """
    found = spark.read.schema(AREAS).json(path).where("session IS NOT NULL")
    found = found if session is None else found.where(F.col("session") == session)
    rows = found.select("session", "active", F.explode("areas").alias("key", "area")).withColumn("node", F.col("key").try_cast("long")).where("node IS NOT NULL")
    return rows.select("session", "node", "area", F.when(F.col("active").isNull(), F.lit(True)).otherwise(F.array_contains("active", F.col("node"))).alias("is_active"))
