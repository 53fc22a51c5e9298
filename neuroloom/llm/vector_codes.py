"""Vector codes by product quantisation with weighted Lloyd rounds over distinct parts.

Components become integers, so parts of vectors repeat.  Equal parts at a position are counted once:
partial counts in each task, then one row a distinct part with its weight.  Every round reads only those
rows; a task returns counts and sums of each codebook entry, which Spark adds up, so that the driver
holds the codebooks alone.  The last round's codes and errors are joined back to the vectors: parts that many
vectors share go by a broadcast whose size is bounded by their share, all others by a shuffle in which no key is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, read, staged

#: Integer components are held within this bound, so that distances fit 64 bits.
MOST = 1 << 26
KEY = ["dim", "position", "part"]


def edges(dim: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end: equal parts if ``parts`` divides ``dim``, else nearly so."""
    return [p * dim // parts for p in range(parts + 1)]


def packed(rows: np.ndarray) -> list[bytes]:
    """A row's integers as little-endian bytes, two an integer where all of the row fit, else four."""
    width = rows.shape[1]
    narrow = (rows >= -(1 << 15)).all(1) & (rows < 1 << 15).all(1)
    data = rows.astype("<i2").tobytes()
    out = [data[i : i + 2 * width] for i in range(0, len(data), 2 * width)] if width else [b""] * len(rows)
    for i in np.flatnonzero(~narrow):
        out[i] = rows[i].astype("<i4").tobytes()
    return out


def unpacked(parts: list[bytes], width: int) -> np.ndarray:
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    if not width or (size == 2 * width).all():
        return np.frombuffer(b"".join(parts), "<i2").reshape(len(parts), width).astype(np.int64)
    return np.stack([np.frombuffer(p, "<i2" if len(p) == 2 * width else "<i4") for p in parts]).astype(np.int64)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, its squared distance), ties to the lower index; exact."""
    top = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * rows.shape[1] * top * top < 1 << 53 else np.int64  # whole numbers either way
    x, c = rows.astype(kind), entries.astype(kind)
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    code = d.argmin(1)
    return code, d[np.arange(len(d)), code].astype(np.int64)


def integer_parts(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(row, vec_id, label, dim, parts) for every finite vector; ``row`` is unique."""
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    own = vectors.where(F.col("embedding").isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    schema = T.StructType([T.StructField("row", T.LongType()), *own.schema.fields[:2], T.StructField("dim", T.IntegerType()), T.StructField("parts", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            offsets, flat = v.offsets.to_numpy().astype(np.int64), v.values.to_numpy(zero_copy_only=False)
            whole = np.clip(np.floor(np.clip(flat * scale, -2.0 * MOST, 2.0 * MOST)), -MOST, MOST).astype(np.int64)
            dims = np.diff(offsets)
            out: list = [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                m, cut = whole[offsets[at][:, None] + np.arange(d)], edges(d, parts)
                for i, p in zip(at.tolist(), zip(*[packed(m[:, i:j]) for i, j in zip(cut, cut[1:])])):
                    out[i] = p
            rows = pa.array(np.arange(row, row + len(dims)))
            row += len(dims)
            yield pa.RecordBatch.from_arrays([rows, b.column("vec_id"), b.column("label"), pa.array(dims.astype(np.int32)), pa.array(out, pa.list_(pa.binary()))], schema.names)

    return own.mapInArrow(run, schema)


def by_position(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(dim, position, rows of the batch there, their integers)."""
    dim, position = batch.column("dim").to_numpy().astype(np.int64), batch.column("position").to_numpy().astype(np.int64)
    code = dim * parts + position
    for c in np.unique(code).tolist():
        at = np.flatnonzero(code == c)
        d, p = divmod(c, parts)
        cut = edges(d, parts)
        yield d, p, at, unpacked(batch.column("part").take(pa.array(at)).to_pylist(), cut[p + 1] - cut[p])


def sums(distinct: DataFrame, books: dict, parts: int) -> DataFrame:
    """(dim, position, entry, place, total): weighted sums of the components of the parts nearest to each entry; their weight at place -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            weight = b.column("weight").to_numpy()
            for d, p, at, rows in by_position(b, parts):
                code, w = nearest(rows, books[d, p])[0], weight[at]
                now = total.setdefault((d, p), np.zeros((len(books[d, p]), rows.shape[1] + 1), np.int64))
                np.add.at(now, code, np.column_stack([w, rows * w[:, None]]))
        found = [(d, p, e, j - 1, int(t[e, j])) for (d, p), t in total.items() for e in np.flatnonzero(t[:, 0]).tolist() for j in range(t.shape[1])]
        columns = list(zip(*found)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.int64()])], ["dim", "position", "entry", "place", "total"])

    made = distinct.mapInArrow(run, "dim int, position int, entry int, place int, total long")
    return made.groupBy("dim", "position", "entry", "place").agg(F.sum("total").alias("total"))


def coded(distinct: DataFrame, books: dict, parts: int) -> DataFrame:
    """(dim, position, part, weight, code, error) for every distinct part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, error = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for d, p, at, rows in by_position(b, parts):
                code[at], error[at] = nearest(rows, books[d, p])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code), pa.array(error)], [*b.schema.names, "code", "error"])

    return distinct.mapInArrow(run, "dim int, position int, part binary, weight long, code long, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, shared: int = 10_000, labels: int = 100_000) -> tuple[DataFrame, dict]:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), and the codebooks by (length, position).

    Null vectors and those with null or non-finite components have no row.  Each length of vectors has codebooks of its
    own, and one job more; a length that ``parts`` does not divide is cut as evenly as can be, so the empty vector has code
    0 and error 0.  Integer components beyond 2**26 (a component of 16,384) are held there.  Codebooks start with the least vec_ids, nulls last, repeated
    ones by their parts' bytes; with fewer than ``entries`` vectors they are shorter.  Repeated rows are coded each.  Null labels
    are one label, whatever type labels have.  An empty table gives no rows.

    At most ``shared`` distinct parts, each with more than one ``shared``-th of all parts, are broadcast;
    sums of labels are where there are at most ``labels`` of them.  Codes have two hex digits a part, so ``entries`` is 256 at most.
    """
    if not 1 <= parts <= 8 or not 1 <= entries <= 256:
        raise ValueError("1 to 8 parts, 1 to 256 entries")
    spark = vectors.sparkSession
    own = staged(integer_parts(vectors, parts, scale), "vector-parts")
    each = own.select("row", "dim", F.posexplode("parts").alias("position", "part"))
    distinct = staged(each.groupBy(*KEY).agg(F.count("*").alias("weight")), "distinct-parts")
    books: dict[tuple[int, int], np.ndarray] = {}
    for (dim,) in own.select("dim").distinct().collect():
        cut = edges(dim, parts)
        first = own.where(F.col("dim") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).select("parts").collect()
        for p in range(parts):
            books[dim, p] = unpacked([bytes(r.parts[p]) for r in first], cut[p + 1] - cut[p])
    for _ in range(rounds if books else 0):
        weights, moved = {}, {k: b.copy() for k, b in books.items()}
        found = sums(distinct, books, parts).collect()  # entries x components, whatever the number of rows
        for r in found:
            if r.place < 0:
                weights[r.dim, r.position, r.entry] = r.total
        for r in found:
            if r.place >= 0:
                moved[r.dim, r.position][r.entry, r.place] = r.total // weights[r.dim, r.position, r.entry]
        books = moved
    table = staged(coded(distinct, books, parts), "coded-parts")
    discard(distinct)
    floor = (table.agg(F.sum("weight")).first()[0] or 0) / shared
    hot, cold = table.where(F.col("weight") > floor), table.where(F.col("weight") <= floor)
    there = each.join(F.broadcast(hot), KEY).select("row", "position", "code", "error")
    rest = each.join(F.broadcast(hot.select(*KEY)), KEY, "left_anti").join(cold, KEY).select("row", "position", "code", "error")
    bits = F.sum(F.expr(f"shiftleft(code, 8 * ({parts - 1} - position))"))
    rows = there.union(rest).groupBy("row").agg(bits.alias("bits"), F.sum("error").alias("error"))
    digits = F.lower(F.substring(F.lpad(F.hex("bits"), 16, "0"), 17 - 2 * parts, 2 * parts))
    rows = own.select("row", "vec_id", "label", "dim").join(rows, "row").select("vec_id", "label", "dim", digits.alias("code"), "error")
    rows = staged(rows, "vector-codes")
    discard(table)
    total = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    few = total.limit(labels + 1).count() <= labels
    rows = rows.join(F.broadcast(total) if few else total, F.col("label").eqNullSafe(F.col("of")))
    text = {d: ",".join(str(x) for p in range(parts) for x in books[d, p].ravel().tolist()) for d in {k[0] for k in books}}
    names = spark.createDataFrame([(d, hashlib.sha256(t.encode()).hexdigest()) for d, t in text.items()], "dim int, codebooks_sha256 string")
    return rows.join(names, "dim").select("vec_id", "code", "error", "label_error", "codebooks_sha256"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))[0]


def _sql(rounds: int = 6) -> str:
    near = lambda c: f"""SELECT p.row, p.pos, arg_min(c.entry, list_sum(list_transform(range(1, len(p.x) + 1), i -> (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT * 16 + c.entry) AS entry,
  min(list_sum(list_transform(range(1, len(p.x) + 1), i -> (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT) AS d FROM p JOIN {c} c USING (pos) GROUP BY p.row, p.pos"""  # noqa: E731
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near(f"c{r}")}),
s{r} AS (SELECT pos, entry, j, sum(p.x[j])::BIGINT AS s, count(*) AS n FROM a{r} JOIN p USING (row, pos), range(1, 9) t(j) GROUP BY ALL),
m{r} AS (SELECT pos, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{r} GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT pos, entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (pos, entry))""")
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT row, pos, e[8 * pos + 1 : 8 * pos + 8] AS x FROM v, range(8) t(pos)),
c0 AS MATERIALIZED (SELECT pos, row AS entry, x FROM p WHERE row < 16),
{", ".join(steps)},
last AS MATERIALIZED ({near(f"c{rounds}")}),
q AS MATERIALIZED (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM last JOIN v USING (row) GROUP BY row, vec_id, label),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM q, h""".replace("i -> ", "lambda i: ")


OP13_SQL = _sql()
