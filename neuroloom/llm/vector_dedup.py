"""Near-duplicate vectors by collision-counting projections.

Unit vectors are projected on ``projections`` random directions.  For a pair at the threshold's
distance r a projected difference is normal with deviation r, so a query-centred window of
half-width ``width`` r catches it with a known probability, and the number of windows in which
the pair collides is binomial.  The least count that keeps ``recall`` of such pairs is the
calibrated count; pairs that reach it are verified by their exact cosine.

Further, wide windows cut space into cells, along more directions the more vectors the commonest label has, so that a
cell of scattered vectors holds about as many at any size: a vector lies in one cell and queries the
few cells its windows touch.  A cell with many vectors all the same is dealt out in blocks, each query block
against each data block, so no task holds more than a block of either.  Equal vectors are one
class with a count.  A task returns sums of links and a spanning forest, never lists of pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, read, staged
from .components import components, forest


def calibrated_count(projections: int, hit: float, recall: float) -> int:
    """The greatest count that a binomial of so many trials reaches with probability ``recall`` or more."""
    tail = 0.0
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * hit**k * (1 - hit) ** (projections - k)
        if tail >= recall:
            return k
    return 0


def within(width: float) -> float:
    return math.erf(width / math.sqrt(2))


def collisions(queries: np.ndarray, data: np.ndarray, half: float) -> np.ndarray:
    """Counts (queries x data): in how many columns the values differ by ``half`` at most."""
    counts = np.zeros((len(queries), len(data)), np.uint8)
    for k in range(data.shape[1]):
        order = np.argsort(data[:, k], kind="stable")
        line = data[order, k]
        lows = np.searchsorted(line, queries[:, k] - half).tolist()
        highs = np.searchsorted(line, queries[:, k] + half, side="right").tolist()
        for row, a, z in zip(counts, lows, highs):
            if z > a:
                row[order[a:z]] += 1
    return counts


def near_vectors(vectors: DataFrame, cosine: float = 0.98, projections: int = 32, width: float = 1.0, lead_width: float = 4.0, recall: float = 0.9999, block: int = 4096, cell_rows: int = 1024, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Vectors are compared when labels and lengths are equal.  A null label or vector, an empty or
    zero vector, and null or non-finite components: no links, component_id is vec_id, kept.  Equal
    vectors link.  With repeated vec_ids each row counts as a vector.  A null vec_id is passed over
    for component_id; kept is then false unless the component has no id, when it is null.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * cosine)
    need = calibrated_count(projections, within(width), recall)
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    own = own.withColumn("key", F.when(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)), F.xxhash64("label", "v")))
    classes = own.where("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))

    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    leads = max(2, math.ceil(math.log(max(most, 1) / cell_rows) / math.log(2.5)))  # a direction's cells part scattered vectors by about 2.5

    def directions(size: int) -> np.ndarray:
        return np.random.default_rng([seed, size]).standard_normal((size, projections + leads))

    @F.pandas_udf("array<long>")
    def cells(vs: pd.Series) -> pd.Series:
        """The number of its own cell, then those of all cells its windows touch."""
        reach = lead_width * radius
        weights = np.random.default_rng([seed, 1]).integers(0, 1 << 63, leads).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        number = lambda at: int(((at.astype(np.int64).view(np.uint64) * weights).sum(dtype=np.uint64)).view(np.int64))
        out = []
        for x in vs:
            x = np.asarray(x, np.float64)
            p = (x / np.abs(x).max() @ directions(len(x))[:, :leads]) / np.linalg.norm(x / np.abs(x).max())
            home, low, high = (np.floor(y / (2 * reach)) for y in (p, p - reach, p + reach))
            touched = itertools.product(*[range(int(a), int(b) + 1) for a, b in zip(low, high)])
            out.append([number(home), *sorted({number(np.array(t)) for t in touched})])
        return pd.Series(out)

    placed = staged(classes.withColumn("dim", F.size("v")).withColumn("c", cells("v")), "vectors")
    homes = placed.select("label", "dim", F.col("c")[0].alias("cell"), "key", "v", "n")
    asked = placed.select("label", "dim", F.explode(F.slice("c", 2, F.size("c"))).alias("cell"), "key", "v", "n")
    cell = ["label", "dim", "cell"]
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block)).cast("int")
    sizes = homes.groupBy(*cell).count().select(*cell, blocks("count").alias("d")).join(asked.groupBy(*cell).count().select(*cell, blocks("count").alias("q")), cell)
    mine = lambda c: F.pmod("key", F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    data = homes.join(sizes, cell).select(*cell, mine("d").alias("i"), each("q").alias("j"), F.lit(False).alias("asks"), "key", "v", "n")
    asks = asked.join(sizes, cell).select(*cell, each("d").alias("i"), mine("q").alias("j"), F.lit(True).alias("asks"), "key", "v", "n")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        q, x = rows[rows["asks"]], rows[~rows["asks"]]
        if q.empty or x.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        unit = lambda r: (m := np.stack(r["v"].to_list())) / np.abs(m).max(1, keepdims=True)
        uq, ux = unit(q), unit(x)
        uq, ux = uq / np.linalg.norm(uq, axis=1, keepdims=True), ux / np.linalg.norm(ux, axis=1, keepdims=True)
        lines = directions(uq.shape[1])[:, leads:]
        pq, px, kq, kx, nx = uq @ lines, ux @ lines, q["key"].to_numpy(), x["key"].to_numpy(), x["n"].to_numpy()
        out, a, b = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s in range(0, len(q), 512):
            i, j = np.nonzero(collisions(pq[s : s + 512], px, width * radius) >= need)
            i += s
            for t in range(0, len(i), 200_000):
                p, r = i[t : t + 200_000], j[t : t + 200_000]
                good = (np.einsum("ij,ij->i", uq[p], ux[r]) >= cosine) & (kq[p] != kx[r])
                p, r = p[good], r[good]
                if len(p):
                    got = np.bincount(p, nx[r], len(q))
                    hit = np.flatnonzero(got)
                    out.append(pd.DataFrame({"a": kq[hit], "b": kq[hit], "links": got[hit].astype("int64")}))
                    a, b = forest(np.concatenate([a, kq[p]]), np.concatenate([b, kx[r]]))
        out.append(pd.DataFrame({"a": a, "b": b, "links": np.zeros(len(a), np.int64)}))
        return pd.concat(out)

    found = data.union(asks).repartition(parts(vectors), *cell, "i", "j").groupBy(*cell, "i", "j").applyInPandas(compare, "a long, b long, links long")
    found = staged(found, "vector-links")
    comps = components(found.where("a <> b").select("a", "b")).toDF("key", "component")
    sums = found.groupBy("a").agg(F.sum("links").alias("more")).withColumnRenamed("a", "key")
    known = placed.select("key", "n", "least").join(sums, "key", "left").join(comps, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    rows = own.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("key").isNull(), F.lit(True)).when(component.isNull(), F.lit(None)).otherwise(F.coalesce(F.col("vec_id") == component, F.lit(False)))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
