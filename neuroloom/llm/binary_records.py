"""Token ids as length-delimited binary records with a separate offset index.

Record:  u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload
Payload: u8 (1: doc_id is null; 2: ids are u32, else u16) | i64 doc_id | ids ...
Index:   for each record u64 place in the data file, u64 payload length
All little-endian.  The checksum is zlib's CRC-32, rotated by 15 bits and shifted by a constant,
so that checksums of data which hold checksums stay sound.  The index lets a reader seek to
records in any order (shuffled reads) without scanning the data.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, parts, read, shared_dir, staged, texts_of
from .wordcache import encoder

MASK = 0xA282EAD8
HEAD, TAIL, ID = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + TAIL.pack(masked(size)) + payload + TAIL.pack(masked(payload))


def unframe(data, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and the place of the next; ValueError if either checksum fails."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at byte {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    if len(payload) != size or masked(payload) != TAIL.unpack_from(data, at + 12 + size)[0]:
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + size


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    return ID.pack((doc_id is None) + 2 * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def parsed(payload: bytes) -> tuple[int | None, bytes]:
    """The doc_id and the ids as little-endian unsigned 32-bit integers."""
    marks, doc_id = ID.unpack_from(payload)
    return None if marks & 1 else doc_id, np.frombuffer(payload, "<u4" if marks & 2 else "<u2", offset=ID.size).astype("<u4").tobytes()


def _open(uri: str):
    """(file system, path); any store that Arrow knows, as executors need not share a disk."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_records(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, entries: int = 300_000, block: int = 4_000_000) -> DataFrame:
    """Tokenise ``docs`` and write files of records in ascending doc_id order; returns the manifest.

    Manifest: part, data, index (file names), records, tokens.  Files sort by name as their
    doc_ids do.  Each task attempt writes under a name of its own and renames when done, and only
    the attempt whose row Spark keeps is in the manifest: lost executors leave nothing half read.
    Null doc_ids come first; rows with the same doc_id are adjacent, in order of their text's hash.
    ``entries``: words whose ids a worker keeps; ``block``: bytes of text it encodes at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        enc, part = encoder(tokenizer_path, entries), TaskContext.get().partitionId()
        fs, base = _open(out)
        name = f"{base}/part-{part:07d}-{uuid.uuid4().hex}"
        records, tokens, at, index, sink = 0, 0, 0, array("Q"), None
        for b in batches:
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{name}.tmp")
            ids_of = iter(b.column("doc_id").to_pylist())
            for n, flat in enc.blocks(b.column("text"), block):
                flat = np.insert(flat, np.cumsum(n), end_id)
                edges = np.concatenate([[0], np.cumsum(n + 1)]).tolist()
                for i, j in zip(edges, edges[1:]):
                    payload = payload_of(next(ids_of), flat[i:j])
                    sink.write(frame(payload))
                    index.extend((at, len(payload)))
                    at += 16 + len(payload)
                records += len(n)
                tokens += len(flat)
        if sink is None:
            return
        sink.close()
        fs.move(f"{name}.tmp", f"{name}.rec")
        with fs.open_output_stream(f"{name}.tmp") as f:
            f.write(np.frombuffer(index, np.uint64).astype("<u8").tobytes())
        fs.move(f"{name}.tmp", f"{name}.idx")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": [f"{name}.rec"], "index": [f"{name}.idx"], "records": [records], "tokens": [tokens]})

    rows = texts_of(docs).withColumn("tie", F.xxhash64("text"))
    laid = rows.repartitionByRange(parts(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return staged(laid.select("doc_id", "text").mapInArrow(run, "part int, data string, index string, records long, tokens long"), "records-manifest")


def read_records(manifest: DataFrame, out: str, block: int = 4 << 20) -> DataFrame:
    """(doc_id, start, ids binary) of every record, each checked; ``start``: ids of all records before it."""
    spark, start, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["part"]):  # one row a file
        rows.append((r["data"], r["index"], start))
        start += r["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        fs, _ = _open(out)
        for b in batches:
            for data, index, before in zip(*(b.column(k).to_pylist() for k in ("data", "index", "start"))):
                with fs.open_input_file(index) as f:
                    spans = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                with fs.open_input_file(data) as f:
                    i = 0
                    while i < len(spans):
                        at = int(spans[i, 0])
                        j = max(i + 1, int(np.searchsorted(spans[:, 0], at + block)))
                        stop = int(spans[j - 1].sum()) + 16
                        f.seek(at)
                        raw, ids, docs, starts, here = f.read(stop - at), [], [], [], 0
                        for _ in range(i, j):
                            payload, here = unframe(raw, here)
                            d, own = parsed(payload)
                            docs.append(d)
                            ids.append(own)
                            starts.append(before)
                            before += len(ids[-1]) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])
                        i = j

    table = spark.createDataFrame(rows, "data string, index string, start long").repartition(max(1, len(rows)))
    return table.mapInArrow(run, "doc_id long, start long, ids binary")


def op7_binary_records(spark, sf_dir: str) -> DataFrame:
    """Empty texts are the end id alone; an empty table gives no file and no rows."""
    import public_tokenizers as P

    out = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    manifest = write_records(read(spark, sf_dir, "documents"), out, P.path("byte_bpe_50k.json"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_records(manifest, out).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
