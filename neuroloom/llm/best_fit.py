"""Best-fit packing by linear grouping.

All that decides a packing is how many pieces have each length: at most as many numbers as a sequence
has tokens, however large the corpus.  From them the driver draws a plan: large lengths, in groups of equal
cardinality, are rounded up to their group's longest; a linear program over configurations of these few sizes
(columns made by a knapsack) says how often to use each; its whole part is filled with the actual
lengths, longest first; what is left over and the small lengths go, longest first, where they fit best.
The plan is a table of runs: equal sequences in a row.  Pieces find their places in it by their rank among the
pieces of their length, which is a count before them in their split and one before their split.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, read, staged, texts_of
from .wordcache import encoder


def pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int, with_ids: bool, entries: int, block: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, split, local): a document's pieces; ``local``: pieces of that length before it in its split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        enc, split, before = encoder(tokenizer_path, entries), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for b in batches:
            done = 0
            for n, flat in enc.blocks(b.column("text"), block):
                flat = np.insert(flat, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                count = (n - 1) // length + 1
                row = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                short = n - (count - 1) * length  # the first piece has what whole ones leave
                size = np.where(k == 0, short[row], length)
                start = np.where(k == 0, 0, short[row] + (k - 1) * length)
                order = np.argsort(size, kind="stable")
                line = size[order]
                again = np.arange(len(line)) - np.searchsorted(line, line)
                local = np.empty(len(line), np.int64)
                local[order] = before[line] + again
                before += np.bincount(size, minlength=length + 1)
                data, cut = memoryview(flat).cast("B"), (4 * np.concatenate([[0], np.cumsum(size)])).tolist()
                crc = pa.array([zlib.crc32(data[i:j]) for i, j in zip(cut, cut[1:])], pa.int64())
                cols = [b.column("doc_id").slice(done, len(n)).take(pa.array(row)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(size), crc, pa.array(np.full(len(row), split, np.int32)), pa.array(local)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "split", "local", "ids"][: len(cols)])
                done += len(n)

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, split int, local long" + ", ids array<int>" * with_ids)


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[length, count], ...] longest first) of groups of equal cardinality; groups rounded alike are one."""
    total, seen, out = sum(counts.values()), 0, []
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            group = seen * groups // total
            take = min(left, -(-(group + 1) * total // groups) - seen)
            if not out or out[-1][0] != group:
                out.append((group, size, []))
            out[-1][2].append([size, take])
            seen, left = seen + take, left - take
    merged: list[tuple[int, list[list[int]]]] = []
    for _, size, content in out:
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(content)
        else:
            merged.append((size, content))
    return merged


def knapsack(values: np.ndarray, sizes: list[int], length: int) -> tuple[float, np.ndarray]:
    """The configuration of most value that fits a sequence."""
    best, takes = np.zeros(length + 1), []
    use = [i for i in range(len(sizes)) if values[i] > 1e-12]
    for i in use:
        s, v, before = sizes[i], values[i], best
        best, take = before.copy(), np.zeros(length + 1, np.int64)
        for n in range(1, length // s + 1):
            got = before[: length + 1 - n * s] + n * v
            more = got > best[n * s :] + 1e-12
            best[n * s :][more], take[n * s :][more] = got[more], n
        takes.append(take)
    out, room = np.zeros(len(sizes)), length
    for i, take in zip(reversed(use), reversed(takes)):
        out[i] = take[room]
        room -= take[room] * sizes[i]
    return float(best[length]), out


def configurations(sizes: list[int], demand: list[int], length: int, steps: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often the linear program uses them: the fewest sequences for the demand, by column generation."""
    k = len(sizes)
    columns = np.diag([float(length // s) for s in sizes])
    inverse, level = np.diag(1 / np.diag(columns)), np.array(demand) / np.diag(columns)
    for _ in range(steps):
        value, column = knapsack(inverse.sum(0), sizes, length)
        if value <= 1 + 1e-7:
            break
        move = inverse @ column
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        level = level - ratio[out] * move
        level[out] = ratio[out]
        inverse[out] /= move[out]
        move[out] = 0
        inverse -= np.outer(move, inverse[out])
        columns[:, out] = column
    return [(columns[:, i], max(float(level[i]), 0.0)) for i in range(k)]


#: (groups, least share of a sequence that is large): many large pieces need full configurations, many small ones few roundings.
SETTINGS = ((64, 1 / 8), (128, 1 / 4), (512, 1 / 3), (512, 1 / 2))


def plan(counts: dict[int, int], length: int, groups: int, large: float, steps: int = 1000) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of sequences, [(length, how many in each), ...]) that hold all pieces counted."""
    left = {s: n for s, n in counts.items() if n}
    classes = grouped({s: n for s, n in left.items() if s > large * length}, groups)
    runs: list[tuple[int, dict[int, int]]] = []
    if classes:
        for column, level in configurations([s for s, _ in classes], [sum(n for _, n in c) for _, c in classes], length, steps):
            times = int(level + 1e-6)
            slots = [content for (_, content), n in zip(classes, column.astype(int).tolist()) for _ in range(n)]
            while times and slots:  # equal sequences as long as no slot's length changes
                need = {id(c): sum(x is c for x in slots) for c in slots}
                heads: list[int] = []
                same = times
                for c in {id(c): c for c in slots}.values():
                    while c and not c[0][1]:
                        c.pop(0)
                    n = need[id(c)]
                    if sum(x[1] for x in c) < n:
                        same = 0
                        break
                    if c[0][1] >= n:
                        same = min(same, c[0][1] // n)
                        heads += [c[0][0]] * n
                    else:  # one sequence across the border of two lengths
                        same = 1
                        heads += [s for s, m in c for _ in range(m)][:n] if sum(m for _, m in c) <= 4 * length else _first(c, n)
                if not same:
                    break
                used: dict[int, int] = defaultdict(int)
                for s in heads:
                    used[s] += 1
                for c in {id(c): c for c in slots}.values():
                    n = need[id(c)] * same
                    for x in c:
                        m = min(n, x[1])
                        x[1] -= m
                        n -= m
                runs.append((same, dict(used)))
                for s, n in used.items():
                    left[s] -= n * same
                times -= same
    room: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    for times, used in runs:
        room[length - sum(s * n for s, n in used.items())].append((times, used))
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        n = left[size]
        for gap in range(size, length):
            while n and room[gap]:
                times, used = room[gap].pop()
                each = gap // size
                if n >= each:
                    full = min(times, n // each)
                    room[gap - each * size].append((full, used | {size: used.get(size, 0) + each}))
                    n -= full * each
                else:
                    full = 1
                    room[gap - n * size].append((1, used | {size: used.get(size, 0) + n}))
                    n = 0
                if times > full:
                    room[gap].append((times - full, used))
            if not n:
                break
        each = length // size
        if n >= each:
            room[length - each * size].append((n // each, {size: each}))
        if n % each:
            room[length - n % each * size].append((1, {size: n % each}))
    return [(times, sorted(used.items(), reverse=True)) for gap in sorted(room) for times, used in room[gap]]


def fewest(counts: dict[int, int], length: int, settings: tuple[tuple[int, float], ...]) -> list[tuple[int, list[tuple[int, int]]]]:
    """The plan with the fewest sequences of those by these (groups, large)."""
    return min((plan(counts, length, g, large) for g, large in settings), key=lambda runs: sum(n for n, _ in runs))


def _first(content: list[list[int]], n: int) -> list[int]:
    out: list[int] = []
    for s, m in content:
        out += [s] * min(m, n - len(out))
        if len(out) == n:
            break
    return out


def table(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, how many in a sequence, offset of the first), by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, content in runs:
        offset = 0
        for size, n in content:
            rows.append((size, used[size], sequence, n, offset))
            used[size] += times * n
            offset += size * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def places(at: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    for s in np.unique(size).tolist():
        own, rows = at[at[:, 0] == s], np.flatnonzero(size == s)
        r = own[np.searchsorted(own[:, 1], rank[rows], side="right") - 1]
        step = rank[rows] - r[:, 1]
        sequence[rows], offset[rows] = r[:, 2] + step // r[:, 3], r[:, 4] + step % r[:, 3] * s
    return sequence, offset


def pack_best_fit(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 2, settings: tuple = SETTINGS, with_ids: bool = False, entries: int = 600_000, block: int = 8_000_000) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``with_ids``: ids too.

    Null text counts as empty, so such a document is its end id alone; a null doc_id stays null.  Repeated rows are
    packed as often as they occur.  Only documents of more than ``length`` tokens are cut: their first piece has what whole
    pieces leave.  Sequences are numbered from 0, fullest first.  An empty table gives no rows.
    """
    made = staged(pieces(docs, tokenizer_path, length, end_id, with_ids, entries, block), "best-fit")
    each = made.groupBy("length", "split").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in each.groupBy("length").agg(F.sum("n")).collect()}  # at most ``length`` numbers
    at = table(fewest(counts, length, settings))
    upto = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select("length", "split", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places(at, size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    rows = made.join(starts, ["length", "split"]).withColumn("at", place("length", F.col("base") + F.col("local")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *["ids"] * with_ids)


def op12_best_fit(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_best_fit(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
