"""Quality rules, line first.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed;
a document that so loses more than ``max_lost`` of its characters (in words) is rejected, as is
one that fails the base rules on the uncleaned text.  Licence lines are removed too, but count
neither as lost nor as part of the document; one of nothing else is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, lean, read, small_batches, split_words

SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&<>"
SEPARATORS = frozenset(("|", "»", "›", "•", "·", "→", "←", "«", "‹", "::"))
#: What ends a sentence, in several scripts, closing quotes and brackets included.
ENDS = frozenset(".!?…:;。！？؟।։\"'”’»)]」』")
NOT_WORD = re.compile(r"[^\w\s]")
LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
RIGHTS = re.compile(r"(?:©|\(c\)|copyright) ?(?:©|\(c\))? ?(?:19|20)[0-9]{2}", re.I)
# Stock phrases by language (en, fr, de, es); a licence's or rights' notice first.
LICENCE = (
    "licensed under", "released under the", "all rights reserved", "tous droits réservés", "sous licence", "alle rechte vorbehalten", "lizenziert unter",
    "todos los derechos reservados", "bajo la licencia",
)
PHRASES = (
    *LICENCE, "privacy policy", "cookie policy", "uses cookies", "terms of service", "terms of use", "enable javascript", "lorem ipsum", "click here to", "subscribe to our",
    "politique de confidentialité", "utilise des cookies", "conditions d'utilisation", "activer javascript", "cliquez ici", "datenschutzerklärung", "verwendet cookies",
    "nutzungsbedingungen", "javascript aktivieren", "klicken sie hier", "política de privacidad", "utiliza cookies", "términos de uso", "activar javascript", "haga clic aquí",
)
SPACE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def repeat_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more; ids are 0-based word numbers.  Exact."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    vocabulary = int(ids.max()) + 1
    code, top = ids.astype(np.int64), vocabulary
    for k in range(1, width):
        if top * vocabulary >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            top = len(code)
        code = code[:-1] * vocabulary + ids[k:]
        top *= vocabulary
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(counts[inverse] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


FAILS, LICENSES = 1, 2


def bad_line(line: str, marked: bool, phrased: bool) -> int:
    """Whether a line fails, by the first rule that holds, all of them by shares of the line.

    Navigation: separators are an eighth of its words; or less than three words of under 20 characters
    in all that end no sentence; or links are half of its characters.  Punctuation: marks are a tenth of its characters, or
    all that is neither letter nor digit is half.  Boilerplate: stock phrases are an eighth of
    its characters, or a short line claims copyright; LICENSES if a licence's or rights' notice alone.
    """
    words = line.split()
    size = sum(map(len, words))
    if 8 * sum(w in SEPARATORS for w in words) >= max(1, len(words)):
        return FAILS
    if len(words) < 3 and size < 20 and words and words[-1][-1] not in ENDS:
        return FAILS
    if marked and 10 * sum(map(line.count, MARKS)) >= size > 0:
        return FAILS
    if 2 * len(NOT_WORD.findall(line)) >= size > 0:
        return FAILS
    if phrased and 2 * sum(map(len, LINK.findall(line))) >= size > 0:
        return FAILS
    if not phrased:
        return 0
    low = " ".join(words).lower()
    found = {p: low.count(p) * len(p) for p in PHRASES if p in low}
    if RIGHTS.search(low) and len(words) <= 25:
        found["all rights reserved"] = len(low)
    if 8 * sum(found.values()) < len(low) or not found:
        return 0
    return LICENSES if all(p in LICENCE for p in found) else FAILS


def judged(text: str, max_lost: float) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text."""
    words = split_words(text.encode())
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n_words, word_chars = len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    repeated = repeat_words(ids) if len(number) < len(words) else 0
    low = text.lower()
    phrased, marked = "www." in low or "http" in low or RIGHTS.search(low) is not None or any(p in low for p in PHRASES), n_symbols > 0
    seen: set[str] = set()
    good, duplicates, removed, lost, licence = [], 0, 0, 0, 0
    for line in text.split("\n"):
        if not line.strip(" \t\x0b\x0c\r"):
            good.append(line)
            continue
        again = line in seen
        seen.add(line)
        duplicates += again
        bad = FAILS if again else bad_line(line, marked, phrased)
        if bad:
            removed += 1
            size = len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
            lost += size if bad == FAILS else 0
            licence += size if bad == LICENSES else 0
        else:
            good.append(line)
    failed = n_words < 10 or 100 * repeated > 20 * n_words
    kept = not failed and word_chars > licence and lost <= max_lost * (word_chars - licence)
    return n_words, word_chars, n_symbols, duplicates, repeated, failed, kept, "\n".join(good) if removed else text


def judge(docs: DataFrame, max_lost: float = 0.3) -> DataFrame:
    """The five columns of documents, the five counts, base_failed, kept and clean_text.

    Null text: no words, so base_failed, and clean_text is empty.  A repeated line counts as
    boilerplate from its second time on.  Rows are judged apart: repeated rows each give a row, an
    empty table gives none.  Columns of documents that the table lacks are null, further ones are left out.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            rows = [judged(t or "", max_lost) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*b.schema.names, *names])

    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"
    return document_columns(docs).mapInArrow(run, schema)


def cleaned(docs: DataFrame, max_lost: float = 0.3) -> DataFrame:
    """Kept documents only, with their cleaned text; n_chars follows it."""
    good = judge(docs, max_lost).where("kept")
    return good.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.char_length("clean_text").cast("long").alias("n_chars"))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("text", "lang", "source", "n_chars", "clean_text")
