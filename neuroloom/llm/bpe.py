"""Byte-level BPE encoding and decoding.

Boundaries come from arrays, not from a regular expression.  Every code point is mapped to a class,
which with the class of its successor selects a transition function on the splitter's eight states.
These functions and all their compositions form a small monoid, whose elements are numbered and
whose product is a table; a work-efficient scan with that associative product gives, for each
position of a whole batch of texts side by side, the function composed of all before it, so its
state and whether a token starts there.  Slices between boundaries feed a cache of merged pairs;
token byte offsets are kept, and decoding places the tokens' bytes by them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read, texts_of

#: The code points that have Unicode's White_Space property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: What a code point is: other white space, the space, a letter of some use in contractions or another, a number, an apostrophe, all else.
BLANK, SPACE, LETTER, SHORT, R, V, L, E, NUMBER, QUOTE, OTHER, NONE = range(12)
#: What a code point is with its successor: the last of a run of white space before something else, or not; a letter that ends or opens a contraction.
LAST_BLANK, LAST_SPACE, INNER_BLANK, ANY_LETTER, ONE, TWO, DIGIT, APOSTROPHE, MARK = range(9)
#: The splitter's states: what the token so far is.  NEW: ended; LEAD: a space that may lead; QUOTED: an apostrophe; PENDING: that and the first of two letters.
NEW, LEAD, WHITES, LETTERS, NUMBERS, MARKS, QUOTED, PENDING = range(8)


def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = BLANK
    for c, kind in ((" ", SPACE), ("'", QUOTE), ("r", R), ("v", V), ("l", L), ("e", E), *((x, SHORT) for x in "sdmt")):
        table[ord(c)] = kind
    return table


def _with_successor(kind: int, after: int) -> int:
    if kind in (BLANK, SPACE):
        return INNER_BLANK if after in (BLANK, SPACE, NONE) else LAST_SPACE if kind == SPACE else LAST_BLANK
    if kind == SHORT:
        return ONE
    if (kind, after) in ((R, E), (V, E), (L, L)):
        return TWO
    return {NUMBER: DIGIT, QUOTE: APOSTROPHE, OTHER: MARK}.get(kind, ANY_LETTER)


def _step(state: int, c: int) -> tuple[int, bool]:
    """(next state, whether a token starts here)."""
    if c in (LAST_BLANK, LAST_SPACE):  # by itself, or led by
        return (LEAD if c == LAST_SPACE else NEW), True
    if c == INNER_BLANK:
        return WHITES, state != WHITES
    if c in (ANY_LETTER, ONE, TWO):
        if state == PENDING:
            return NEW, False
        if state == QUOTED and c != ANY_LETTER:
            return (NEW if c == ONE else PENDING), False
        return LETTERS, state not in (LEAD, LETTERS)
    if c == DIGIT:
        return NUMBERS, state not in (LEAD, NUMBERS)
    goes_on = state in (LEAD, MARKS, QUOTED)
    return (MARKS if c == MARK or goes_on else QUOTED), not goes_on


def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, then of each class at a text's start; product of any two; each element's image of NEW; START[state, class])."""
    base = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    base += [(f[NEW],) * 8 for f in base]
    found = {f: i for i, f in enumerate(dict.fromkeys(base))}
    queue = list(found)
    for f in queue:  # grows while it is read: compositions with each generator, until there is no new one
        for g in base:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    size = len(found)
    assert size <= 256
    product = np.zeros((256, 256), np.uint8)
    for f, i in found.items():
        for g, j in found.items():
            product[i, j] = found[tuple(g[x] for x in f)]
    return np.array([found[f] for f in base], np.uint8), product.ravel(), np.array([f[NEW] for f in found], np.uint8), np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], bool)


ELEMENT, PRODUCT, IMAGE, START = monoid()
SUCCEEDED = np.array([[_with_successor(k, a) for a in range(12)] for k in range(11)], np.uint8).ravel()


def scanned(x: np.ndarray) -> np.ndarray:
    """For each place the product of all elements up to it: pairs are multiplied, their scan taken, and the places between filled in."""
    if len(x) < 2:
        return x
    even, odd = x[0::2], x[1::2]
    pairs = scanned(PRODUCT[even[: len(odd)].astype(np.uint16) << 8 | odd])
    out = np.empty_like(x)
    out[1::2] = pairs
    out[0] = x[0]
    out[2::2] = PRODUCT[pairs[: len(even) - 1].astype(np.uint16) << 8 | even[1:]]
    return out


def boundaries(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens start.  points: code points of texts laid end to end; first: True where a text starts."""
    kind = table[points]
    after = np.empty(len(points), np.uint8)
    after[-1], after[:-1] = NONE, kind[1:]
    after[:-1][first[1:]] = NONE
    c = SUCCEEDED[kind * np.uint8(12) + after]
    state = IMAGE[scanned(ELEMENT[c + first * np.uint8(9)])]
    before = np.empty_like(state)
    before[0], before[1:] = NEW, state[:-1]
    return np.flatnonzero(START.ravel()[before * np.uint8(9) + c] | first)


class Merger(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; merges what it has not met."""

    def __init__(self, path: str, entries: int = 500_000, longest: int = 48):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.sizes = np.array([len(t) for t in self.bytes_of], np.int64)
        self.places, self.data = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.table, self.entries, self.longest = class_table(), entries, longest

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.merge(data) if len(data) <= 64 else self.merge_long(data)
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= self.longest:
            self[piece] = packed
        return packed

    def merge(self, data: bytes) -> list[int]:
        ranks, token = self.ranks, [data[i : i + 1] for i in range(len(data))]
        pair = [ranks.get(a + b, 1 << 40) for a, b in zip(token, token[1:])]
        while pair and (least := min(pair)) < 1 << 40:
            i = pair.index(least)
            token[i : i + 2] = [token[i] + token[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(token[i] + token[i + 1], 1 << 40)
            if i:
                pair[i - 1] = ranks.get(token[i - 1] + token[i], 1 << 40)
        return [ranks[t] for t in token]

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges by a heap: time grows as n log n."""
        ranks, n = self.ranks, len(data)
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # token at i is data[i:end[i]]; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := ranks.get(data[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            end[i], end[j] = stop, 0
            if stop < n:
                left[stop] = i
            offer(i)
            offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str], chars: int = 1_000_000) -> list[bytes]:
        """Ids of each whole text; texts are scanned in batches of about ``chars`` code points."""
        out, block, size = [], [], 0
        for t in texts:
            block.append(t)
            size += len(t)
            if size >= chars:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.entries:
            self.clear()
        text = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not text:
            return [b""] * len(texts)
        first = np.zeros(len(text), bool)
        first[(ends - sizes)[sizes > 0]] = True
        at = boundaries(np.frombuffer(text.encode("utf-32-le"), "<u4"), first, self.table)
        stops = np.append(at[1:], len(text))
        merged = list(map(self.__getitem__, map(text.__getitem__, map(slice, at.tolist(), stops.tolist()))))
        lows, highs = np.searchsorted(at, ends - sizes).tolist(), np.searchsorted(at, ends).tolist()
        return [b"".join(merged[a:b]) for a, b in zip(lows, highs)]

    def decode(self, ids: bytes, offsets: np.ndarray) -> bytes:
        """The bytes of all tokens, each put where its offset says."""
        return self.data[np.repeat(self.places[np.frombuffer(ids, "<u4")] - offsets[:-1], np.diff(offsets)) + np.arange(offsets[-1])].tobytes()

    def offsets(self, ids: bytes) -> np.ndarray:
        """Each token's first byte in the text's UTF-8, and the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])])


_MADE: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _MADE:
        _MADE[path] = Merger(path)
    return _MADE[path]


def encoded(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), offsets (array: first byte of each token, and the end).

    Null and empty texts have no ids.  Rows are encoded apart, so repeats and ties need no rule; an
    empty table gives no rows.  A piece of any length is merged whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks_path)
        for b in batches:
            ids = m.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([m.offsets(x) for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids", "offsets"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids binary, offsets array<long>")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids by their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(ranks_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids = m.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(m.decode(x, m.offsets(x))) for x in ids])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(read(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"))
