"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits by a fixed rule (strings by hash, sizes by
logarithm, ids by their place between the least and the greatest), the cells' indexes on the
curve order the rows, and runs of equal row count are cut.  Near cells stay in near shards, so
each shard's ranges are narrow in every dimension and a reader can skip files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, read, staged


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of each row of ``cells`` (rows x dimensions, unsigned, below 2**bits).

    Skilling's transposition (2004): undo the rotations bit by bit from the top, then Gray-code.
    """
    x = [c.astype(np.int64) for c in cells.T]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t = np.where((x[n - 1] >> level) & 1, t ^ ((1 << level) - 1), t)
    x = [v ^ t for v in x]
    out = np.zeros_like(t)
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> level) & 1
    return out


def shard(docs: DataFrame, shards: int = 16, bits: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve.

    Law ``rows``: shard counts are at most one apart.  Null text: size 1, the crc of no bytes.
    Nulls in a dimension take cell 0; equal cells are ordered by doc_id (nulls first), then by the
    other columns, so repeated rows get neighbouring slots.  An empty table gives no rows.
    """
    cells = 1 << bits
    src = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "source", "lang",
    )
    least, most = docs.agg(F.min(F.col("doc_id").cast("double")), F.max(F.col("doc_id").cast("double"))).first()
    span = (most - least) if most is not None and most > least else 1.0
    by_hash = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(cells - 1)) + 1)
    dims = [
        by_hash("source"), by_hash("lang"),
        F.least(F.lit(cells - 1), F.floor(F.log2(F.col("bytes") + F.lit(1.0)) * F.lit(cells / 40))),
        F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(least or 0.0)) / F.lit(span) * F.lit(cells - 1)), F.lit(0)),
    ]

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([a, b, c, d], 1), bits))

    keyed = src.select("doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", curve(*[d.cast("int") for d in dims]).alias("curve"))
    order = ["curve", "doc_id", "size", "text_crc32"]
    keyed = staged(keyed, "hilbert-keys")
    laid = keyed.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    laid = staged(laid, "hilbert-order")  # rows keep the numbers they have now
    total, bases = 0, []
    for r in laid.groupBy(F.shiftright("row", 33).cast("int").alias("part")).count().orderBy("part").collect():  # one number a partition
        bases.append((r["part"], total))
        total += r["count"]
    base = F.broadcast(docs.sparkSession.createDataFrame(bases, "part int, base long"))
    rank = F.col("base") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    first = lambda s: F.expr(f"({s} * {total}L + {shards - 1}) div {shards}")
    ranked = laid.withColumn("part", F.shiftright("row", 33).cast("int")).join(base, "part").withColumn("rank", rank)
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)"))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first("shard")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def shard_ranges(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Least and greatest of each dimension by shard: what a reader prunes files with."""
    both = placed.select("doc_id", "shard").join(docs.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return both.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in ("doc_id", "source", "lang", "n_chars") for n, f in (("min", F.min), ("max", F.max))])


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
