"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space bytes that separate words: space, and 0x09 to 0x0D.
SPACES = "\t\n\x0b\x0c\r "
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where it is unset on one machine (tests) a local folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage: later stages reread files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame, part: str = "") -> None:
    """Delete the files of a staged table that nothing reads any more, or those of one partition ("kind=1")."""
    jvm = table.sparkSession.sparkContext._jvm
    for f in [f for f in table.inputFiles() if not part or f"/{part}/" in f][:1]:
        folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows and 16 MB, so that long texts don't fill a worker; a session's own lower bounds stay."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(name).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def texts_of(docs: DataFrame, *extra) -> DataFrame:
    """Only the columns an operator needs, so that further ones can't clash; null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


_LEAN = False


def lean() -> None:
    """At the start of a task in a worker: what earlier tasks freed goes back to the operating system, and large blocks will at once."""
    global _LEAN
    c = ctypes.CDLL(None)
    if not hasattr(c, "malloc_trim"):  # not the GNU C library
        return
    if not _LEAN:
        _LEAN = True
        pa.set_memory_pool(pa.system_memory_pool())
        for option, value in ((-3, 1 << 20), (-1, 4 << 20), (-8, 2)):  # from where on blocks are mapped, what the heap keeps, arenas
            c.mallopt(option, value)
    c.malloc_trim(0)


DOCUMENT = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def document_columns(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, in their types; those that the table lacks are null."""
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in DOCUMENT.items()])


def split_words(data: bytes) -> list[bytes]:
    """Maximal runs of bytes other than the six white-space bytes."""
    return data.split()


def parts(df: DataFrame) -> int:
    """Shuffle width: as the session asks."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
