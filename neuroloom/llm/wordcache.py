"""Exact byte-level BPE ids by the tokenizers library, each distinct word encoded once.

The vocabulary's pre-tokeniser never joins text across a space that is followed by a
non-space (it splits " word" from what stands before).  So a text may be cut before each
such space and the pieces encoded apart; their ids concatenate to the ids of the text.  It
also cuts where letters or digits end at punctuation, and on both sides of a single newline.
A text with a space between two white-space characters, or with a special token's string, is
encoded whole.

Splitting, numbering the distinct words of a block, cutting off their punctuation and putting
ids in the texts' order are Arrow kernels; only distinct words pass through Python.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: A space at which cutting could split one white-space run: white space before and after it.
IRREGULAR = f"[{WHITE}] (?:[{WHITE}]|\\z)"
#: What stands before punctuation that may be cut off: the pre-tokeniser cuts there, too.
STEM, MARKS = "[A-Za-z0-9À-ÖØ-öø-ɏ]\\z", ".,;:!?)\"&*#$%"
LONG = 48  # longer pieces are encoded each time, so that the cache's entries are small


class Cache:
    """piece -> ids as bytes, in two generations: when the young one is full it becomes the old one, so that pieces in use stay."""

    def __init__(self, entries: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = entries // 2

    def look(self, pieces: list[str], ids_of: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each of these distinct pieces; those not held come from ``ids_of`` in one call, and are kept if short."""
        found = list(map(self.young.get, pieces))
        gone = [i for i, v in enumerate(found) if v is None]
        if gone:
            older = [self.old.get(pieces[i]) for i in gone]
            fresh = [i for i, v in zip(gone, older) if v is None]
            for i, v in zip(gone, older):
                found[i] = v
            for i, v in zip(fresh, ids_of([pieces[i] for i in fresh]) if fresh else ()):
                found[i] = v
            if len(self.young) + len(gone) > self.most:
                self.young, self.old = {}, self.young
            kept = [pieces[i] for i in gone]
            if max(map(len, kept)) <= LONG:
                self.young.update(zip(kept, [found[i] for i in gone]))
            else:
                self.young.update((p, found[i]) for p, i in zip(kept, gone) if len(p) <= LONG)
        return found


class WordEncoder:
    """``encode(texts)`` gives little-endian unsigned 32-bit ids of every text, as bytes; ``blocks`` the same by Arrow."""

    def __init__(self, path: str, entries: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([IRREGULAR, *special])
        self.spaced, self.plain = Cache(entries), Cache(entries // 4)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that begin with a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _spaced_ids(self, words: list[str]) -> list[bytes]:
        """The ids of " " + word for each: encoded as one text, which is cut at the tokens that begin with a space."""
        lines = [i for i, w in enumerate(words) if "\n" in w]
        if lines:
            out: list[bytes | None] = [None] * len(words)
            rest = []
            for i in lines:
                first, *more = words[i].split("\n")
                if first and all(p and not p[0].isspace() and not p[-1].isspace() for p in (first, *more)):
                    rest.append((i, first, more))
                else:
                    (out[i],) = self._ids([" " + words[i]])
            firsts = list({f for _, f, _ in rest})
            tails = list({p for _, _, more in rest for p in ("\n", *more)})
            head, tail = dict(zip(firsts, self.spaced.look(firsts, self._spaced_ids))), dict(zip(tails, self.plain.look(tails, self._ids)))
            for i, f, more in rest:
                out[i] = b"".join([head[f], *(x for p in more for x in (tail["\n"], tail[p]))])
            others = [i for i, v in enumerate(out) if v is None]
            for i, v in zip(others, self._spaced_ids([words[i] for i in others]) if others else ()):
                out[i] = v
            return out
        if any(not w or w[0].isspace() for w in words):  # spaces could join: apart
            return self._ids([" " + w for w in words])
        (joined,) = self._ids([" " + " ".join(words)])
        edges = (4 * np.append(np.flatnonzero(self.opens[np.frombuffer(joined, "<u4")]), len(joined) // 4)).tolist()
        if len(edges) != len(words) + 1:
            return self._ids([" " + w for w in words])
        return [joined[i:j] for i, j in zip(edges, edges[1:])]

    def _look(self, words: pa.Array) -> pa.Array:
        """The ids of " " + word for each of these distinct words: its stem's and its punctuation's, each from a cache."""
        stems = pc.utf8_rtrim(words, MARKS)
        cut = pc.match_substring_regex(stems, STEM)
        stems = pc.if_else(cut, stems, words)
        size, most = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (stems, words))
        rest = np.flatnonzero(size < most)
        coded = stems.dictionary_encode()
        ids = pa.array(self.spaced.look(coded.dictionary.to_pylist(), self._spaced_ids), pa.large_binary()).take(coded.indices)
        if not len(rest):
            return ids
        long = words.cast(pa.large_binary())
        stop = np.frombuffer(long.buffers()[1], "<i8", len(long) + 1, 8 * long.offset)[1:][rest]
        more = (most - size)[rest]
        to = np.cumsum(more)
        data = np.frombuffer(long.buffers()[2], np.uint8)[np.arange(to[-1]) + np.repeat(stop - to, more)]  # punctuation is ASCII: bytes are characters
        marks = pa.Array.from_buffers(pa.large_string(), len(rest), [None, pa.py_buffer(np.append(0, to).astype("<i8")), pa.py_buffer(data)]).dictionary_encode()
        distinct = marks.dictionary.to_pylist()
        place = np.full(len(words), len(distinct), np.int64)
        place[rest] = marks.indices.to_numpy()
        ends = pa.array([*self.plain.look(distinct, self._ids), b""], pa.large_binary()).take(pa.array(place))
        return pc.binary_join_element_wise(ids, ends, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[str], size: int = 8_000_000) -> list[bytes]:
        out: list[bytes] = []
        for n, flat in self.blocks(pa.array(texts, pa.large_string()), size):
            edges = np.concatenate([[0], np.cumsum(n)]).tolist()
            out += [flat[i:j].tobytes() for i, j in zip(edges, edges[1:])]
        return out

    def blocks(self, texts: pa.Array, size: int = 8_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of ids of each text, all their ids one after another) of consecutive runs of texts of about ``size`` bytes."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + size)))
            yield self._block(texts.slice(i, j - i).cast(pa.large_string()))
            i = j

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False).astype(bool)
        if not odd.any():
            return self._cut(texts)
        whole = iter([np.frombuffer(x, "<u4") for x in self._ids(texts.filter(pa.array(odd)).to_pylist())])
        n, flat = self._cut(texts.filter(pa.array(~odd)))
        even = iter(np.split(flat, np.cumsum(n)[:-1]) if len(n) else [])
        rows = [next(whole if o else even) for o in odd]
        return np.fromiter(map(len, rows), np.int64, len(rows)), np.concatenate(rows)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, "<u4")
        split = pc.split_pattern(texts, " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = edges[:-1]  # a text's first word has no space before it
        distinct, place = np.unique(codes[first], return_inverse=True)
        codes[first] = len(words.dictionary) + place
        ids = pa.concat_arrays([self._look(words.dictionary), pa.array(self._ids(words.dictionary.take(pa.array(distinct)).to_pylist()), pa.large_binary())])
        laid = ids.take(pa.array(codes))
        at = np.frombuffer(laid.buffers()[1], "<i8", len(codes) + 1, 8 * laid.offset)[edges]
        return np.diff(at) // 4, np.frombuffer(laid.buffers()[2] or b"", "<u4")[at[0] // 4 : at[-1] // 4]


_MADE: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, entries: int = 600_000) -> WordEncoder:
    """One encoder for each file and worker process; reused by later tasks."""
    if (path, entries) not in _MADE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _MADE.clear()  # a worker holds one cache at a time
        _MADE[path, entries] = WordEncoder(path, entries)
    return _MADE[path, entries]
