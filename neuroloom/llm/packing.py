"""Packing by concatenate and cut.

Pass 1 tokenises each input split once, writing a document's ids with the number of tokens
before it in its split.  The splits' totals alone (one number a split) are then summed to
offsets.  Pass 2 adds both: a document's global place follows without any shuffle, and fixed
windows cut it into pieces.  Windows that a document or split boundary crosses are made of
boundary records: pieces that begin or end inside the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read, staged, texts_of
from .wordcache import encoder

TOKENS = "doc_id long, split int, before long, n long, ids binary"


def stored(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """Documents' ids, ``n`` each, as bytes: two an id where all are below 65,536, else four."""
    flat = flat.astype("<u2") if len(flat) and flat.max() < 1 << 16 else flat
    edges = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges.astype("<i8")), pa.py_buffer(flat)]).cast(pa.binary())


def loaded(ids: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of all these documents, one after another; a batch may hold both widths."""
    edges = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset)
    wide = np.diff(edges) == 4 * n
    data = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
    if wide.any() and not wide.all():
        return np.concatenate([data[i:j].view("<u4" if w else "<u2").astype("<u4") for i, j, w in zip(edges, edges[1:], wide)])
    return data[edges[0] : edges[-1]].view("<u4" if wide.any() else "<u2").astype("<u4")


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, entries: int = 600_000, block: int = 8_000_000) -> DataFrame:
    """(doc_id, split, before, n, ids): every document's ids and the end id; ``before``: tokens before it in its split.

    ``entries``: words whose ids a worker keeps, about 200 bytes each; ``block``: bytes of text it encodes at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        enc, before, split = encoder(tokenizer_path, entries), 0, TaskContext.get().partitionId()
        for b in batches:
            done = 0
            for n, flat in enc.blocks(b.column("text"), block):
                flat = np.insert(flat, np.cumsum(n), end_id)
                n = n + 1
                place = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(done, len(n)), pa.array(np.full(len(n), split, np.int32)), pa.array(place), pa.array(n), stored(flat, n)], ["doc_id", "split", "before", "n", "ids"])
                done += len(n)

    return texts_of(docs).mapInArrow(run, TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, with_ids: bool = False, entries: int = 600_000, block: int = 8_000_000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, boundary; ``with_ids``: ids too.

    Null text counts as empty, so such a document is its end id alone.  A null doc_id stays null.
    Repeated rows are packed as often as they occur.  A document longer than a window becomes several pieces.
    An empty table gives no rows.  Only the last sequence is short of ``length``; its padding
    (``length`` less its pieces) is not a row.
    """
    table = staged(tokenised(docs, tokenizer_path, end_id, entries, block), "pack")
    total, offsets = 0, []
    for split, n in sorted(table.groupBy("split").agg(F.sum("n")).collect()):  # one number an input split
        offsets.append((split, total))
        total += n
    spark = docs.sparkSession
    places = F.broadcast(spark.createDataFrame(offsets, "split int, base long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            n = b.column("n").to_numpy()
            place = b.column("base").to_numpy() + b.column("before").to_numpy()
            firsts, lasts = place // length, (place + n - 1) // length
            count = lasts - firsts + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            sequence = firsts[row] + k
            begin = np.maximum(sequence * length, place[row])
            end = np.minimum((sequence + 1) * length, (place + n)[row])
            start = begin - place[row]
            flat = loaded(b.column("ids"), n)
            data = memoryview(flat).cast("B") if len(flat) else b""
            edges = (4 * np.concatenate([[0], np.cumsum(end - begin)])).tolist()  # pieces follow each other as their documents do
            cols = {
                "doc_id": b.column("doc_id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(end - begin),
                "ids_crc32": pa.array([zlib.crc32(data[i:j]) for i, j in zip(edges, edges[1:])], pa.int64()), "doc_tokens": pa.array(n[row]),
                "sequence_id": pa.array(sequence), "offset": pa.array(begin - sequence * length),
                "boundary": pa.array((k > 0) | (sequence < lasts[row])),
            }
            if with_ids:
                cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)), pa.array(flat.view("<i4")))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"
    return table.join(places, "split").select("doc_id", "before", "n", "ids", "base").mapInArrow(cut, schema + ", ids array<int>" * with_ids)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
