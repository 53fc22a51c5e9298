"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with equal n-gram sets are one row of the matrix (a class).

1. Of each row only a prefix of its entries, long enough for its size, can meet another row that
   is similar enough: columns are ordered rare first and a row's first ``n - ceil(t n) + 1``
   entries are taken.  Rows meet in the columns of that restricted matrix.  A meeting pair is
   discarded when its sizes rule the threshold out, or when the difference of their bucket
   counts, which bounds the sets' symmetric difference from below, does.  What is left joins rows
   into candidate groups; each task returns a spanning forest, never pairs.
2. The whole sets of a group's rows are brought together once, and its rows are multiplied
   with themselves: overlap counts are accumulated over blocks of columns, and a pair is discarded
   as soon as its count and what its rows have left cannot reach the bound that their sizes set.
   Pairs that reach it are links; a task returns their spanning forest.

Both steps work on blocks of bounded size.  A column or group beyond one block first takes each
block by itself; what that leaves outside the unit's commonest component is then taken against all
its blocks, each pair of blocks a task of its own.  So no link is lost, no task holds more than two
blocks, and a large group of near copies costs no square of its rows.

The order of columns may be any order that all rows share.  It puts the commonest n-grams last:
a table of at most ``common`` n-grams, found by counting in blocks, has a fixed size and only
affects speed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, document_columns, lean, parts, read, staged, texts_of
from .components import components, forest

_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_LOWER = np.frombuffer(UPPER, np.uint8)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX[1])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX[2])
    return x ^ x >> np.uint64(31)


def word_hashes(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word with A-Z lower-cased, number of words before each text and after the last).

    ``data``: bytes of texts laid end to end; ``edges``: where each begins, and the end.  All words
    of a block advance eight bytes at a time, side by side.
    """
    blank = _BLANK[data]
    inner = ~blank
    start, stop = inner.copy(), inner.copy()
    start[1:] &= blank[:-1]
    stop[:-1] &= blank[1:]
    full = edges[:-1] < edges[1:]
    at = edges[:-1][full]
    start[at] = inner[at]
    at = edges[1:][full] - 1
    stop[at] = inner[at]
    begin, left = np.flatnonzero(start), np.flatnonzero(stop) + 1
    left -= begin
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    h = mixed(left.astype(np.uint64) * np.uint64(_MIX[0]))
    live = np.arange(len(begin))
    place = begin
    while len(live):
        h[live] = mixed((h[live] ^ eight[place] & _KEPT[np.minimum(left, 8)]) * np.uint64(_MIX[0]))
        more = left > 8
        live, place, left = live[more], place[more] + 8, left[more] - 8
    return h, np.searchsorted(begin, edges)


def text_sets(texts: pa.Array, width: int, size: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, edges) of consecutive blocks of texts of about ``size`` bytes: text i's sorted distinct 64-bit n-gram
    hashes are entries[edges[i]:edges[i + 1]].  With fewer words than ``width``, the sequence as one; without words, none."""
    texts = texts.cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(places, places[i] + size)) - 1)
        h, at = word_hashes(raw[places[i] : places[j]], places[i : j + 1] - places[i])
        words = np.diff(at)
        used = np.minimum(words, width)
        count = words - used + (words > 0)
        first = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        code = np.repeat(used, count).astype(np.uint64)
        short = used < width
        for k in range(width):  # short texts end early
            step = mixed(code * np.uint64(_MIX[0]) + h[np.minimum(first + k, max(len(h) - 1, 0))]) if len(h) else code
            code = np.where(np.repeat(used > k, count), step, code) if short.any() else step
        edges = np.concatenate([[0], np.cumsum(count)])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            code[a:b].sort()
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        new[edges[:-1][count > 0]] = True
        yield code[new], np.concatenate([[0], np.cumsum(new)])[edges]
        i = j


def set_keys(entries: np.ndarray, edges: np.ndarray) -> list[int | None]:
    """A 64-bit hash of each set; None of an empty one."""
    data, at = memoryview(np.ascontiguousarray(entries)).cast("B") if len(entries) else b"", (8 * edges).tolist()
    return [int.from_bytes(hashlib.blake2b(data[a:b], digest_size=8).digest(), "little", signed=True) if a < b else None for a, b in zip(at, at[1:])]


def count_bits(n: np.ndarray) -> np.ndarray:
    """A set of n entries is counted in 2**bits buckets, so that buckets hold few: then sets that share little differ by more than the bound."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) / 12)), 7, 16).astype(np.int64)


def bucket_counts(entries: np.ndarray, edges: np.ndarray) -> pa.Array:
    """How many entries of each set fall in each of its buckets; a count of 255 may stand for more."""
    n = np.diff(edges)
    bits = count_bits(n)
    at = np.concatenate([[0], np.cumsum(1 << bits)])
    place = np.repeat(at[:-1], n) + (entries >> np.repeat(64 - bits, n).astype(np.uint64)).astype(np.int64)
    data = np.minimum(np.bincount(place, minlength=int(at[-1])), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype("<i8")), pa.py_buffer(data)]).cast(pa.binary())


def row_hash():
    """Finds a document again by its id (which may be null or repeat) and text; a chance meeting costs a needless row, as keys are compared then."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull()).alias("row")


SETS = "doc_id long, row long, key long, n long, counts binary, gram long, seen long"


def set_table(docs: DataFrame, width: int, held: int = 1_000_000) -> DataFrame:
    """Rows with a key: a document's set (key: its hash, null without words).  Rows with a gram: an n-gram that several documents of a block of ``held`` entries hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        names = [f.split()[0] for f in SETS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        block: list[np.ndarray] = []

        def common() -> pa.RecordBatch:
            flat = np.sort(np.concatenate(block)) if block else np.zeros(0, np.uint64)
            flat = flat[2:][flat[2:] == flat[:-2]]  # those met three times or more, once less two
            g, c = np.unique(flat, return_counts=True)
            cols = [pa.nulls(len(g), k) for k in kinds[:5]] + [pa.array(g.view(np.int64)), pa.array(c.astype(np.int64) + 2)]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            done = 0
            for entries, edges in text_sets(b.column("text"), width):
                n = len(edges) - 1
                part = b.slice(done, n)
                done += n
                cols = [part.column("doc_id"), part.column("row"), pa.array(set_keys(entries, edges), pa.int64()), pa.array(np.diff(edges)), bucket_counts(entries, edges)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
                block.append(entries)
                if sum(map(len, block)) > held:
                    yield common()
                    block.clear()
        yield common()

    return texts_of(docs, row_hash()).mapInArrow(run, SETS)


def prefixes(docs: DataFrame, width: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, key, n): the first entries of every row of n entries under the shared order of columns."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        often, times = shared.value
        met: set[int] = set()
        for b in batches:
            for entries, edges in text_sets(b.column("text"), width):
                keys = set_keys(entries, edges)
                fresh = np.array([k is not None and k not in met and not (len(met) < 200_000 and met.add(k)) for k in keys], bool)  # copies in this split meet the same columns
                n = np.diff(edges)
                row = np.repeat(np.arange(len(n)), n)
                if len(often):
                    spot = np.minimum(np.searchsorted(often, entries), len(often) - 1)
                    heat = np.where(often[spot] == entries, times[spot], 0)
                    if heat.any():
                        entries = entries[np.argsort((row << 40) + heat, kind="stable")]
                length = np.where(fresh, n - (percent * n + 99) // 100 + 1, 0)
                kept = np.arange(len(entries)) - np.repeat(edges[:-1], n) < length[row]
                key = np.array([k or 0 for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(entries[kept].view(np.int64)), pa.array(key[row[kept]]), pa.array(n[row[kept]])], ["gram", "key", "n"])

    return texts_of(docs).mapInArrow(run, "gram long, key long, n long")


def _whole_units(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches whose rows with equal ``names`` are adjacent, cut anew so that none of these units is split."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        marks = [b.column(k).to_numpy() for k in names]
        differ = np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks]))
        last = int(differ[-1]) + 1 if len(differ) else 0
        if held and any(held[-1].column(k)[-1].as_py() != m[0] for k, m in zip(names, marks)):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


MEETINGS = "a long, b long, unit long, n long, counts binary"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class Forest:
    """A spanning forest of the edges met so far, made anew now and then; ``full`` when it is to be handed on."""

    def __init__(self):
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.made = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.size += len(a)
        if self.size > 2 * self.made + 50_000:
            self.edges = [forest(*map(np.concatenate, zip(*self.edges)))]
            self.size = self.made = len(self.edges[0][0])

    @property
    def full(self) -> bool:
        return self.made > 1_000_000

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        out = forest(*map(np.concatenate, zip(*self.edges))) if self.edges else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.__init__()
        return out


class Bounds:
    """Which pairs of rows their sizes and bucket counts allow."""

    def __init__(self, key: np.ndarray, n: np.ndarray, counts: pa.ChunkedArray, percent: int):
        self.key, self.n, self.percent, self.bits = key, n, percent, count_bits(n)
        c = pa.concat_arrays(counts.chunks)
        at, data = np.frombuffer(c.buffers()[1], "<i4", len(c) + 1, 4 * c.offset)[:-1], np.frombuffer(c.buffers()[2], np.uint8)
        self.spot, self.full = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        self.of: dict[int, np.ndarray] = {}
        for bits in np.unique(self.bits).tolist():
            own = np.flatnonzero(self.bits == bits)
            self.spot[own] = np.arange(len(own))
            self.of[bits] = m = data[at[own][:, None] + np.arange(1 << bits)]
            self.full[own] = (m == 255).any(1)

    def _folded(self, rows: np.ndarray, bits: int, to: int) -> np.ndarray:
        m = self.of[bits][self.spot[rows]]
        return m.astype(np.int16) if bits == to else m.reshape(len(rows), 1 << to, -1).sum(2, dtype=np.int16)

    def differences(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each pair a lower bound of how many entries only one of both has."""
        out = np.zeros(len(p), np.int64)
        kind = self.bits[p] << 8 | self.bits[q]
        for k in np.unique(kind).tolist():
            a, b = k >> 8, k & 255
            where = np.flatnonzero((kind == k) & ~self.full[p] & ~self.full[q])
            step = max(1, 4_000_000 >> max(a, b))
            for s in range(0, len(where), step):
                w = where[s : s + step]
                out[w] = np.abs(self._folded(p[w], a, min(a, b)) - self._folded(q[w], b, min(a, b))).sum(1, dtype=np.int64)
        return out

    def passing(self, row: np.ndarray, low: np.ndarray, high: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) with y from ``low`` to ``high`` of each x in ``row``, of differing labels, by blocks of about 30,000."""
        step = 30_000
        width = np.maximum(high - low, 0)
        ends = np.cumsum(width)
        i = 0
        while i < len(row):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + step)))
            w = width[i:j]
            x = np.repeat(row[i:j], w)
            y = np.arange(len(x)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[i:j], w)
            i = j
            other = (label[x] != label[y]) & (self.key[x] != self.key[y])
            x, y = x[other], y[other]
            for s in range(0, len(x), step):
                p, q = x[s : s + step], y[s : s + step]
                n, m, percent = self.n[p], self.n[q], self.percent
                ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                p, q, n, m = p[ok], q[ok], n[ok], m[ok]
                ok = (100 + percent) * self.differences(p, q) <= (100 - percent) * (n + m)
                if ok.any():
                    yield p[ok], q[ok]


def _labels(key: np.ndarray, node: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Each key's root in a forest, or itself."""
    if not len(node):
        return key
    spot = np.minimum(np.searchsorted(node, key), len(node) - 1)
    return np.where(node[spot] == key, root[spot], key)


def meetings(columns: DataFrame, percent: int, near: int) -> DataFrame:
    """(a, b): a spanning forest, for each task, of the pairs in columns (gram, chunk) that sizes and bucket counts allow.

    Each row is compared with ``near`` predecessors by size; then those outside their column's commonest
    component with all rows of the column of other components.  Rows of a column of several
    chunks are handed on, too: a is the key then, b null, unit the column.
    """
    names = [f.split()[0] for f in MEETINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        met = Forest()

        def whole() -> pa.RecordBatch:
            node, root = met.taken()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), *(pa.nulls(len(node), k) for k in (pa.int64(), pa.int64(), pa.binary()))], names)

        for t in _whole_units(batches, ["gram", "chunk"]):
            gram, chunk, key, n = (t[k].to_numpy() for k in ("gram", "chunk", "key", "n"))
            bounds = Bounds(key, n, t["counts"], percent)
            new = np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(chunk) != 0)])
            first = np.flatnonzero(new)
            column = np.cumsum(new).astype(np.int64) << 40
            place = column + 100 * n  # rows are sorted by it
            row = np.arange(len(n))
            low = np.searchsorted(place, column + percent * n)  # the first row of the column that is large enough
            node = root = np.zeros(0, np.int64)
            for x, y in bounds.passing(row, np.maximum(low, row - near), row, key):
                node, root = forest(np.concatenate([node, key[x]]), np.concatenate([root, key[y]]))
            label = _labels(key, *_sorted(node, root))
            order = np.lexsort((label, column))
            run_start = np.concatenate([[True], (np.diff(column[order]) != 0) | (np.diff(label[order]) != 0)])
            number = np.cumsum(run_start) - 1
            times = np.bincount(number)[number]
            of = np.empty(len(row), np.int64)
            of[order] = times
            most = np.repeat(np.maximum.reduceat(of, first), np.diff(np.append(first, len(row))))
            tops = np.where(of == most, label, np.iinfo(np.int64).min)
            top = np.repeat(np.maximum.reduceat(tops, first), np.diff(np.append(first, len(row))))
            stray = label != top
            high = np.searchsorted(place, column + 100 * (100 * n // percent), side="right")
            for x, y in bounds.passing(row[stray], low[stray], high[stray], label):
                node, root = forest(np.concatenate([node, key[x]]), np.concatenate([root, key[y]]))
            met.add(node, root)
            if met.full:
                yield whole()
            hot = t.filter(t["hot"])
            for b in hot.to_batches():
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.nulls(b.num_rows, pa.int64()), b.column("gram"), b.column("n"), b.column("counts")], names)
        yield whole()

    return columns.mapInArrow(run, MEETINGS)


def stray_meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the same for pairs of blocks of a hot column: rows of differing labels, ``stray`` ones against the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t in _whole_units(batches, ["unit", "i", "j"]):
            marks = [t[k].to_numpy() for k in ("unit", "i", "j")]
            key, n, label, stray = (t[k].to_numpy(zero_copy_only=False) for k in ("key", "n", "label", "stray"))
            bounds = Bounds(key, n, t["counts"], percent)
            at = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([np.diff(m) != 0 for m in marks]), [True]])).tolist()
            node = root = np.zeros(0, np.int64)
            for s, e in zip(at, at[1:]):  # within a unit, others come first
                row = np.flatnonzero(stray[s:e]) + s
                for x, y in bounds.passing(row, np.full(len(row), s), np.full(len(row), e - len(row)), label):
                    node, root = forest(np.concatenate([node, key[x]]), np.concatenate([root, key[y]]))
            if len(node):
                yield _edges(node, root)

    return rows.mapInArrow(run, "a long, b long")


def _sorted(node: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(node)
    return node[order], root[order]


def strays(rows: DataFrame, unit: str, blocks: DataFrame) -> DataFrame:
    """Of rows (unit, key, label, ...): those outside their unit's commonest label (left) against all rows of the unit, dealt out in pairs of blocks (i, j).

    ``blocks``: (unit, q), in how many blocks a unit's rows lie.
    """
    count = rows.groupBy(unit, "label").agg(F.count("*").alias("c"))
    sums = count.groupBy(unit).agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"))
    own = rows.join(blocks.join(sums, unit), unit).withColumn("outside", F.col("all") - F.col("m.c")).withColumn("top", F.col("m.label"))
    own = own.where("outside > 0").withColumn("s", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("outside") / F.col("all"))).cast("int")).drop("m")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c).cast("int") - 1))
    mine = lambda c: F.pmod(F.xxhash64("key", F.lit(3)), F.col(c)).cast("int")
    left = own.where("label <> top").withColumn("stray", F.lit(True)).withColumn("i", mine("s")).withColumn("j", each("q"))
    right = own.withColumn("stray", F.lit(False)).withColumn("j", mine("q")).withColumn("i", each("s"))
    return left.unionByName(right.select(left.columns)).drop("all", "outside", "top", "s", "q")


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Units side by side, in as many tasks as the session asks for."""
    return rows.repartition(parts(rows), *by)


def candidate_groups(columns: DataFrame, percent: int, near: int, chunk: int) -> DataFrame:
    """(key, unit): the component of every row that meets another one, of columns (gram, key, n, hot, counts); ``hot``: the column may not fit in a chunk."""
    place = F.row_number().over(Window.partitionBy("gram").orderBy("n", "key")) - 1
    columns = _dealt(columns, "gram").withColumn("chunk", F.floor(place / F.lit(chunk)).cast("long"))
    found = staged(meetings(columns.select("gram", "chunk", "key", "n", "hot", "counts"), percent, near), "ngram-meetings")
    pairs = found.where("b IS NOT NULL").select("a", "b")
    group = components(pairs)
    hot = found.where("b IS NULL").select("unit", F.col("a").alias("key"), "n", "counts")
    if hot.limit(1).count():
        hot = hot.join(group.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
        blocks = hot.groupBy("unit").agg(F.ceil(F.count("*") / F.lit(chunk)).alias("q"))
        dealt = _dealt(strays(hot, "unit", blocks), "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "stray", "key")
        group = components(pairs.union(stray_meetings(dealt, percent)))
    return group.toDF("key", "unit")


def products(grams: list[np.ndarray], percent: int, left: int = 0, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of rows whose overlap reaches the threshold: x below ``left`` and y from it on, or all x < y when ``left`` is 0.

    Entries of columns that two rows or more hold are multiplied in blocks of ``width`` columns.
    """
    n = np.fromiter(map(len, grams), np.int64, len(grams))
    flat, row = np.concatenate(grams), np.repeat(np.arange(len(n)), n)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    held = np.bincount(column)[column] > 1
    row, column = row[held], column[held]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    a, b = (np.arange(left), np.arange(left, len(n))) if left else (np.arange(len(n)), np.arange(len(n)))
    need = (percent * (n[a][:, None] + n[b]) + 99 + percent) // (100 + percent)
    rest = np.bincount(row, minlength=len(n))
    live = (need <= np.minimum(rest[a][:, None], rest[b])) & (a[:, None] < b)
    kind = np.float64 if n.max() >= 1 << 24 else np.float32
    overlap = np.zeros(live.shape, kind)
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + width, width))
    for lo, hi in zip(edges, edges[1:]):
        if not live.any():
            break
        ra, rb = np.flatnonzero(live.any(1)), np.flatnonzero(live.any(0))
        r, c = row[lo:hi], column[lo:hi] - column[lo]
        some = np.zeros((len(n), int(c[-1]) + 1), kind)
        some[r, c] = 1
        overlap[np.ix_(ra, rb)] += some[a[ra]] @ some[b[rb]].T
        rest = rest - np.bincount(r, minlength=len(n))
        live &= overlap + np.minimum(rest[a][:, None], rest[b]) >= need
    x, y = np.nonzero(live & (overlap >= need))
    return a[x], b[y]


def group_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each block of a group (adjacent rows with equal unit and i) a spanning forest of its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t in _whole_units(batches, ["unit", "i"]):
            unit, i, key = (t[k].to_numpy() for k in ("unit", "i", "key"))
            grams = [np.frombuffer(x.as_buffer(), "<u8") for x in t["grams"]]
            at = np.flatnonzero(np.concatenate([[True], (np.diff(unit) != 0) | (np.diff(i) != 0), [True]])).tolist()
            found = []
            for s, e in zip(at, at[1:]):
                if e - s > 1:
                    x, y = products(grams[s:e], percent)
                    if len(x):
                        found.append(forest(key[s + x], key[s + y]))
            if found:
                yield _edges(*map(np.concatenate, zip(*found)))

    return rows.mapInArrow(run, "a long, b long")


def stray_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): the same for pairs of blocks of a large group: ``stray`` rows against others of differing labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for t in _whole_units(batches, ["unit", "i", "j"]):
            marks = [t[k].to_numpy() for k in ("unit", "i", "j")]
            key, label, stray = (t[k].to_numpy(zero_copy_only=False) for k in ("key", "label", "stray"))
            grams = [np.frombuffer(x.as_buffer(), "<u8") for x in t["grams"]]
            at = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([np.diff(m) != 0 for m in marks]), [True]])).tolist()
            for s, e in zip(at, at[1:]):  # within a unit, others come first
                others = int((~stray[s:e]).sum())
                if 0 < others < e - s:
                    x, y = products(grams[s:e], percent, others)
                    differ = label[s + x] != label[s + y]
                    if differ.any():
                        yield _edges(*forest(key[s + x[differ]], key[s + y[differ]]))

    return rows.mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, width: int = 4, percent: int = 85, common: int = 200_000, near: int = 32, rows: bool = False, chunk: int = 4096, most_rows: int = 1024, most_entries: int = 1_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id reachable by links of Jaccard >= ``percent`` / 100.

    A document without words (or null text) has no n-grams and is its own component.  Equal sets
    link, repeated rows too.  A row with null doc_id links others as any row does; among ids nulls
    are passed over, and a component of such rows alone has a null id.  An empty table gives no
    rows.  Only doc_id and text are read, so further columns can't clash.  N-grams and sets are compared
    by 64-bit hashes.  ``rows`` adds group (the component, never null) and row.

    ``chunk``: rows of a column in one block; ``most_rows``, ``most_entries``: rows and entries of a
    group in one block.  They set what a task holds, not what is found.
    """
    sets = staged(set_table(docs, width), "ngram-sets")
    own = sets.where("gram IS NULL")
    often = sets.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen")).where("seen >= 8").orderBy(F.desc("seen"), "gram").limit(common).toArrow()
    grams = often["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    filled = own.where("key IS NOT NULL")
    classes = filled.groupBy("key").agg(F.first("n").alias("n"), F.min("row").alias("row"))

    met = prefixes(docs, width, percent, (grams[order], often["seen"].to_numpy()[order]))
    line = Window.partitionBy("gram").orderBy("n", "key")
    met = met.withColumn("before", F.lag("key").over(line)).where("before IS NULL OR before <> key")  # copies in other splits
    near_size = lambda small, great: F.lit(100) * small >= F.lit(percent) * great
    partner = F.coalesce(near_size(F.lag("n").over(line), F.col("n")), F.lit(False)) | F.coalesce(near_size(F.col("n"), F.lead("n").over(line)), F.lit(False))
    met = met.withColumn("partner", partner).where("partner").select("gram", "key", "n")  # whose size has none in the column meets none there
    met = met.withColumn("hot", F.count("*").over(Window.partitionBy("gram")) > chunk)
    columns = met.join(filled.groupBy("key").agg(F.first("counts").alias("counts")), "key")
    group = candidate_groups(columns, percent, near, chunk)
    group = staged(group.join(filled.groupBy("key").agg(F.first("n").alias("n"), F.min("row").alias("row")), "key"), "ngram-groups")
    wanted = group.select("row")
    if wanted.count() <= broadcast_rows:  # 8 bytes a row; else Spark joins by shuffle
        wanted = F.broadcast(wanted)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        met: set[int] = set()
        for b in batches:
            fresh = [r not in met and not met.add(r) for r in b.column("row").to_pylist()]  # wholly equal rows
            for entries, edges in text_sets(b.filter(pa.array(fresh, pa.bool_())).column("text"), width):
                at = edges.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(entries, edges), pa.int64()), pa.array([entries[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], ["key", "grams"])

    made = texts_of(docs, row_hash()).join(wanted, "row", "left_semi").select("row", "text").mapInArrow(again, "key long, grams binary")
    blocks = lambda rows: F.greatest(F.ceil(F.count("*") / F.lit(most_rows)), F.ceil(F.sum("n") / F.lit(most_entries))).cast("int").alias("q")
    sized = lambda rows: rows.join(rows.groupBy("unit").agg(blocks(rows)), "unit")
    whole = staged(made.join(sized(group.select("key", "unit", "n")), "key"), "ngram-rows")
    whole = whole.withColumn("i", F.pmod(F.xxhash64("key", F.lit(3)), F.col("q")).cast("int"))
    dealt = _dealt(whole.select("unit", "i", "key", "grams"), "unit", "i").sortWithinPartitions("unit", "i", "key")
    links = staged(group_links(dealt, percent), "ngram-links")
    final = components(links)
    large = whole.where("q > 1").drop("i")
    if large.limit(1).count():
        large = large.dropDuplicates(["unit", "key"]).join(final.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
        dealt = _dealt(strays(large.drop("q"), "unit", large.groupBy("unit").agg(F.first("q").alias("q"))), "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "stray", "key")
        final = components(links.union(stray_links(dealt, percent)))

    classes = filled.groupBy("key").agg(F.min("doc_id").alias("least")).join(final.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "component").select("key", "component", "component_id")
    out = own.select("doc_id", "row", "key", "n").join(named, "key", "left")
    own_id = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own_id.alias("component_id"), *([F.coalesce("component", "row").alias("group"), "row"] if rows else []))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The columns of documents; of each component the row with the least doc_id (null ids last).

    Rows without words are components of their own; of wholly equal rows one stays.  Columns that the table
    lacks are null; further columns are left out.
    """
    found = similar_documents(docs, width, percent, rows=True)
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")).select("best.doc_id", "best.row")
    own = document_columns(docs).withColumn("row", row_hash())
    return own.join(best, own["doc_id"].eqNullSafe(best["doc_id"]) & (own["row"] == best["row"]), "left_semi").dropDuplicates(["row", "doc_id"]).drop("row")


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
g AS (SELECT rep, unnest(sh) AS gram, len(sh) AS n FROM c),
f AS (SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) > 1),
r AS (SELECT rep, n, gram, row_number() OVER (PARTITION BY rep ORDER BY coalesce(df, 1), gram) AS pos, df FROM g LEFT JOIN f USING (gram)),
p AS (SELECT * FROM r WHERE pos <= n - (85 * n + 99) // 100 + 1 AND df IS NOT NULL),
pairs AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.gram = b.gram AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
k AS (SELECT a, b, len(list_intersect(x.sh, y.sh)) AS k, len(x.sh) + len(y.sh) AS t FROM pairs JOIN c x ON x.rep = a JOIN c y ON y.rep = b),
e AS (SELECT a, b FROM k WHERE 100 * k >= 85 * (t - k) UNION SELECT b, a FROM k WHERE 100 * k >= 85 * (t - k)),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
comp AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE component_id END AS component_id
FROM s LEFT JOIN c ON list_sort(s.sh) = c.sh LEFT JOIN comp USING (rep)"""
