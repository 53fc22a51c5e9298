"""Matrix archives as a Spark data source: ``spark.read.format("matrices")``, one partition a file.

Options session, stimulus and side (one value, or several parted by "|"; side '' is the weights) are answered by file names, so other files are never
opened.  They are options and not pushed filters because Spark 4.1 keeps what a Python source was pushed with the frame: a second
query over the same frame would miss the files that the first had pruned (seen here, with the filters of one query cutting the next).
Folders are those that Arrow's file systems open: local or mounted ones, hdfs, s3 and the like; ``matrices.read_matrices`` reads
any that Spark itself can.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .matrices import SIDES, entries

SCHEMA = "name string, session string, stimulus string, side string, i long, j long, value double"


def told(name: str) -> dict[str, str]:
    """What a file's name without its ending says: session_stimulus, or session_stimulus_side; side is '' for the weights."""
    side = re.search(f"_({'|'.join(SIDES)})$", name)
    base = name[: side.start()] if side else name
    session, _, stimulus = base.partition("_")
    return {"name": name, "session": session, "stimulus": stimulus, "side": side[1] if side else ""}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class MatrixFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class MatrixReader(DataSourceReader):
    def __init__(self, folder: str, wanted: dict[str, set[str]]):
        self.folder, self.wanted = folder, wanted

    def partitions(self) -> list[MatrixFile]:
        system, folder = opened(self.folder)
        found = [x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".npz")]
        kept = lambda p: all(told(p.rsplit("/", 1)[-1][:-4])[c] in v for c, v in self.wanted.items())
        return [MatrixFile(p) for p in sorted(found) if kept(p)]

    def read(self, partition: MatrixFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where no file is left
            return
        system, _ = opened(self.folder)
        with system.open_input_file(partition.path) as f:
            i, j, v = entries(f.read())
        name = told(partition.path.rsplit("/", 1)[-1][:-4])
        same = [pa.array([x] * len(i), pa.string()) for x in name.values()]
        yield pa.RecordBatch.from_arrays([*same, pa.array(i), pa.array(j), pa.array(v)], [*name, "i", "j", "value"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        wanted = {c: set(self.options[c].split("|")) for c in ("session", "stimulus", "side") if c in self.options}
        return MatrixReader(self.options["path"], wanted)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MatrixSource)


def write_archives(edges: DataFrame, nodes: DataFrame, folder: str) -> int:
    """One archive (row, col, data) a graph, and one for each side column that the table has; returns how many files there are.

    A node's place is its rank among ``nodes``, whose number bounds what a task holds.  Writing again writes the same.
    """
    ids = np.array(sorted(r[0] for r in nodes.select("node").where("node IS NOT NULL").dropDuplicates().collect()), np.int64)
    columns = {"": "weight", "confidence": "confidence", "offset": "edge_offset", "duration": "duration"}
    columns = {k: c for k, c in columns.items() if c in edges.columns}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        system, at = opened(folder)
        system.create_dir(at, recursive=True)
        g = g.sort_values(["src", "dst"])
        i, j = np.searchsorted(ids, g["src"]), np.searchsorted(ids, g["dst"])
        for side, column in columns.items():
            out = io.BytesIO()
            np.savez_compressed(out, row=i, col=j, data=g[column].to_numpy(float))
            with system.open_output_stream(f"{at}/{'_'.join(filter(None, (g['session'].iloc[0], g['stimulus'].iloc[0], side)))}.npz") as f:
                f.write(out.getvalue())
        return pd.DataFrame({"files": [len(columns)]})

    return edges.groupBy("session", "stimulus").applyInPandas(run, "files int").agg({"files": "sum"}).first()[0] or 0
