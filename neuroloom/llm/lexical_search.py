"""Ranked lexical search over a hierarchical max tree.

One pass over the documents keeps, of each, its length and its counts of the queries' terms.  A task then takes
ranges of documents as they are stored.  For every term a range has a tree: its leaves are the term's impacts on
documents, and a node above holds the greatest impact among the documents below it.  A query goes down
best first: the node with the highest sum of its terms' maxima is opened next, until the highest is below the score of the
k-th document found; a node that equals it is opened if it may hold a lesser doc_id.  What a task has found bounds its
next ranges.  Only k documents a query leave a task.

Queries are a stated set: the driver passes them to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, read, staged, texts_of

#: Bytes of terms as they are, A-Z in lower case, and a space for all others: the rest of ASCII.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
FAR = np.iinfo(np.int64).max  # a null doc_id, after all others


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, codes, tfs) of documents with a term: how many terms, and the counts of those that have a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        get = numbers.get
        for b in batches:
            n, codes, hits = np.zeros(b.num_rows, np.int64), [], np.zeros(b.num_rows, np.int64)
            for i, text in enumerate(b.column("text").cast(pa.large_binary())):
                words = terms(text.as_py())
                n[i] = len(words)
                found = [c for c in map(get, words) if c is not None]
                hits[i] = len(found)
                codes.append(np.array(found, np.int64))
            key, tf = np.unique(np.repeat(np.arange(b.num_rows), hits) * len(numbers) + np.concatenate([np.zeros(0, np.int64), *codes]), return_counts=True) if numbers else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            row = key // max(len(numbers), 1)
            edges = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (key - row * len(numbers), tf)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "codes", "tfs"]).filter(pa.array(n > 0))

    return texts_of(docs).mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of each value, values)"""
    size = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), size), lists.flatten().to_numpy().astype(np.int64)


def document_counts(table: DataFrame, size: int) -> np.ndarray:
    """In how many documents each numbered term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(flat(b.column("codes"))[1], minlength=size)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(df[found])], ["code", "df"])

    out = np.zeros(size, np.int64)
    for code, df in table.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df")).collect():  # one number a term of the block
        out[code] = df
    return out


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms; exact where 64 bits would not hold the product."""
    if 25 * documents * int(n.max(initial=0)) < 1 << 63:
        return 75 + 25 * documents * n // total
    return np.array([75 + 25 * documents * x // total for x in n.tolist()], np.int64)


class MaxTree:
    """Impacts by (term, document) of a range of documents, and their maxima by (term, node) on each level above."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, code: np.ndarray, impact: np.ndarray, fan: int):
        order = np.argsort(ids, kind="stable")
        self.ids, place = ids[order], np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.fan, self.depth = fan, 1
        while fan**self.depth < len(ids):
            self.depth += 1
        width = fan**self.depth
        key = code * width + place[doc]
        order = np.argsort(key)
        key, impact = key[order], impact[order]
        self.keys, self.tops, self.widths, self.least = [key], [impact], [width], [self.ids]
        for _ in range(self.depth):
            key = key // fan
            first = np.flatnonzero(np.diff(key, prepend=-1))
            impact = np.maximum.reduceat(impact, first) if len(first) else impact
            key, width = key[first], width // fan
            self.keys.append(key)
            self.tops.append(impact)
            self.widths.append(width)
            self.least.append(self.least[-1][::fan])

    def below(self, level: int, node: int, codes: np.ndarray, times: np.ndarray) -> tuple[int, np.ndarray]:
        """(first child, bounds of all children): sums over the terms of the maxima on the level below; on the lowest, scores."""
        keys, top = self.keys[level - 1], self.tops[level - 1]
        start = codes * self.widths[level - 1] + node * self.fan
        low, high = np.searchsorted(keys, start), np.searchsorted(keys, start + self.fan)
        size = high - low
        row = np.repeat(np.arange(len(codes)), size)
        at = np.arange(len(row)) + np.repeat(low - (np.cumsum(size) - size), size)
        out = np.zeros(self.fan, np.int64)
        np.add.at(out, keys[at] - start[row], top[at] * times[row])
        return node * self.fan, out

    def search(self, codes: np.ndarray, times: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray], int]:
        """The k best of ``best`` (scores, ids) and this tree's documents, and the number of nodes opened."""
        scores, ids = best
        floor, far = (int(scores[-1]), int(ids[-1])) if len(scores) == k else (0, -FAR - 1)
        heap, opened = [(-(1 << 62), 0, self.depth, 0)], 0
        while heap:
            bound, least, level, node = heapq.heappop(heap)
            if -bound < floor:
                break
            if -bound == floor and least >= far:
                continue
            opened += 1
            first, sums = self.below(level, node, codes, times)
            there = np.flatnonzero(sums >= max(floor, 1))
            lows = self.least[level - 1][first + there]
            there, lows = (x[(sums[there] > floor) | (lows < far)] for x in (there, lows))
            if level > 1:
                for i, low in zip(there.tolist(), lows.tolist()):
                    heapq.heappush(heap, (-int(sums[i]), low, level - 1, first + i))
            elif len(there):
                scores, ids = np.concatenate([scores, sums[there]]), np.concatenate([ids, lows])
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                if len(scores) == k:
                    floor, far = int(scores[-1]), int(ids[-1])
        return (scores, ids), opened


def ranked(table: DataFrame, queries: list[Counter], weights: np.ndarray, documents: int, total: int, k: int, fan: int, range_docs: int, range_postings: int) -> DataFrame:
    """(item, doc_id, score, part): each task's k best documents for each query, by the query's place."""
    asked = [(np.array(sorted(q), np.int64), np.array([q[c] for c in sorted(q)], np.int64)) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(asked)
        held: list[tuple] = []

        def close() -> None:
            """Build the tree of the range held, and ask it."""
            ids, n, doc, code, tf = (np.concatenate(x) for x in zip(*held))
            held.clear()
            impact = weights[code] * (1_000_000_000 * tf // (1000 * tf + 12 * lengths(n, documents, total)[doc]))
            tree = MaxTree(ids, doc, code, impact, fan)
            for i, (codes, times) in enumerate(asked):
                if len(codes):
                    best[i] = tree.search(codes, times, k, best[i])[0]

        docs = postings = 0
        for b in batches:
            if not b.num_rows:
                continue
            doc, code = flat(b.column("codes"))
            held.append((b.column("doc_id").fill_null(FAR).to_numpy(), b.column("n").to_numpy(), doc + docs, code, flat(b.column("tfs"))[1]))
            docs, postings = docs + b.num_rows, postings + len(code)
            if docs >= range_docs or postings >= range_postings:
                close()
                docs = postings = 0
        if held:
            close()
        item = np.repeat(np.arange(len(best)), [len(x[0]) for x in best])
        scores, ids = (np.concatenate([none, *(x[j] for x in best)]) for j in (0, 1))
        part = np.full(len(item), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(ids, mask=ids == FAR), pa.array(scores), pa.array(part)], ["item", "doc_id", "score", "part"])

    return table.mapInArrow(run, "item int, doc_id long, score long, part int")


def blocks(items: DataFrame, most: int, size: int) -> Iterator[list[tuple]]:
    """(item_id, text as bytes) in blocks of at most ``most`` rows, closed at ``size`` bytes."""
    block, held = [], 0
    for r in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        block.append((r.item_id, r.text.encode()))
        held += len(block[-1][1])
        if len(block) == most or held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, fan: int = 32, range_docs: int = 32_768, range_postings: int = 4_000_000, block_items: int = 1_000, block_bytes: int = 8_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, ties by ascending doc_id.

    Null and empty texts have no terms: such documents don't count and are never found, such items find nothing.  Repeated
    documents are ranked each; a null doc_id comes after all others.  Every row of items is a query of its own, so repeated
    or null item_ids have as many lists.  Texts are read whole.  An empty table of documents or items gives no rows.
    ``range_docs`` and ``range_postings`` bound a tree, ``block_items`` and ``block_bytes`` what the driver sends at once.
    """
    spark = docs.sparkSession
    kind = next(f.dataType for f in items.schema.fields if f.name == "item_id")
    out = None
    for block in blocks(items, block_items, block_bytes):
        words = [Counter(terms(text)) for _, text in block]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(w for q in words for w in q))}
        table = staged(counted(docs, numbers), "term-counts")
        documents, total = table.agg(F.count("*"), F.sum("n")).first()
        df = document_counts(table, len(numbers))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        queries = [Counter({numbers[w]: n for w, n in q.items()}) for q in words]
        found = ranked(table, queries, weights, documents, max(total or 0, 1), k, fan, range_docs, range_postings)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for key in (["item", F.pmod("part", F.lit(64))], ["item"]):  # many tasks' lists meet in two steps
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        found = staged(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        discard(table)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), *[T.StructField(c, t) for c, t in (("rank", T.IntegerType()), ("doc_id", T.LongType()), ("score", T.LongType()))]]))
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
n AS MATERIALIZED (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM n),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // len) AS m FROM n, total),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
