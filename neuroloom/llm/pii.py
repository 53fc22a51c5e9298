"""Personal data by anchor expansion.

One Aho-Corasick pass over each whole text (lower-cased A to Z) finds anchors: at-signs, URL schemes,
digits, identifier cues, street words and the prefixes of issued keys.  Local parsers then expand
each anchor to its boundaries and validate it.  No pattern is searched for elsewhere in the text.

Base kinds (their rules are fixed): email, ip, card, phone.  Added kinds: iban (cue and mod-97
check), ssn (cue and NNN-NN-NNNN), account (cue and 8 to 17 digits, which spaces or hyphens may part),
login (user and password in a URL), secret (a cue and an assigned value that looks random, an issued
key's prefix and body, a private key's block, a signed token), address (house number and street).
Added spans never change base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import DOCUMENT, document_columns, lean, read, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "login", "secret", "address")
BASE = 4

# The contract's character classes and limits.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
DIAL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

CUES = {
    "iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "passphrase", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "access-key", "accesskey", "private key", "private_key", "client_key", "auth_key", "bearer"),
}
AFTER = {
    "iban": re.compile(r"(?i:(?: number| no\.?)?(?: is)?)\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})"),
    "ssn": re.compile(r"(?: number| no\.?)?(?: is)?\W{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])", re.I),
    "account": re.compile(r"(?: number| no\.?| #)?(?: is)?\W{0,3}([0-9](?:[ -]?[0-9]){7,16})(?![0-9-])", re.I),
    "secret": re.compile(r"(?:[_ -](?:key|id|token|value))?[\"']?(?: is|[ \t]*(?::=|=>|[:=]))?[ \t]*[\"'`]?([^\s\"'`<>,;]{8,})", re.I),
}
ASSIGNED = re.compile(r" is|[:=]")
# Prefixes of issued keys (lower-cased, as anchors) and what follows them.
ISSUED = {
    "akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "asia": re.compile(r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "aiza": re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36,}"), "gho_": re.compile(r"gho_[0-9A-Za-z]{36,}"), "github_pat_": re.compile(r"github_pat_[0-9A-Za-z_]{22,}"), "glpat-": re.compile(r"glpat-[0-9A-Za-z_-]{20,}"),
    "sk-": re.compile(r"sk-[0-9A-Za-z_-]{20,}"), "sk_live_": re.compile(r"sk_live_[0-9A-Za-z]{16,}"), "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{20,}"), "xoxp-": re.compile(r"xoxp-[0-9A-Za-z-]{20,}"),
    "eyj": re.compile(r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"),
    "-----begin": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s:,-]*?-----END [A-Z ]*PRIVATE KEY-----"),
}
# Words for a street, those that stand after its name and those before it.
STREETS = ("street", "avenue", "road", "boulevard", "lane", "drive", " st.", " ave.", " rd.", " blvd.")
RUES = ("rue ", "avenue ", "boulevard ", "place ", "calle ", "plaza ")
BEFORE = re.compile(r"(?:[0-9]{1,5}[A-Za-z]?,? (?:[NSEW]\.? )?(?:[A-Z][\w'’.-]* ){1,4})\Z")
HOUSE = re.compile(r"([0-9]{1,5}(?: ?(?:bis|ter))?,? )\Z", re.I)
NAME = re.compile(r"(?:(?:de|du|des|del|la|las|le|les|los|l'|d') ?)*[A-ZÀ-Þ][\w'’-]*(?: (?:(?:de|du|des|del|la|le|les|los) )*[A-ZÀ-Þ][\w'’-]*){0,3}")
STRASSE = re.compile(r"[ .]?[ ]?([0-9]{1,4}[a-z]?)(?![0-9A-Za-z])")
LOWER = {k: k + 32 for k in range(65, 91)}  # A to Z only, so that offsets stay
LOGIN = re.compile(r"([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")


def random_looking(value: str) -> bool:
    """At least 16 characters of a key's alphabet, letters and digits mixed, of three bits or more a character; one of eight with all four sorts will do."""
    body = value.strip(".-_=:()[]{}")
    sorts = (any(c.isdigit() for c in body), any(c.islower() for c in body), any(c.isupper() for c in body), any(not c.isalnum() for c in body))
    if len(body) < 16:
        return len(body) >= 8 and all(sorts)
    if not sorts[0] or not (sorts[1] or sorts[2]) or not re.fullmatch(r"[0-9A-Za-z+/_=.:~-]+", body):
        return False
    return -sum((n := body.count(c)) / len(body) * math.log2(n / len(body)) for c in set(body)) >= 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    words: dict[str, list[str]] = {}  # a word may be an anchor of several parsers
    for kind, cues in [*CUES.items(), ("issued", ISSUED), ("street", STREETS), ("rue", RUES), ("strasse", ("straße", "strasse", "str."))]:
        for cue in cues:
            words.setdefault(cue, []).append(kind)
    for cue, kinds in words.items():
        a.add_word(cue, ("+".join(kinds), len(cue)))
    a.make_automaton()
    return a


_AC = None


def added(kind: str, text: str, start: int, end: int) -> tuple[int, int, int] | None:
    """(kind number, start, end) of what an anchor at start to end expands to, or nothing."""
    if kind == "issued":
        m = ISSUED[text[start:end].lower()].match(text, start)
        return (8, m.start(), m.end()) if m and not text[start - 1 : start].isalnum() else None
    if kind == "street":
        if text[end : end + 1].isalnum() or not text[start : start + 1].strip() and not text[start + 1 : start + 2].isupper():
            return None
        low = text[max(0, start + (text[start] == " ") - 120) : start + (text[start] == " ")]
        m = BEFORE.search(low)
        return (9, start + (text[start] == " ") - len(m[0]), end) if m and not low[: m.start()][-1:].isalnum() and (text[start] == " " or text[start].isupper()) else None
    if kind == "rue":
        m, n = HOUSE.search(text[max(0, start - 12) : start]), NAME.match(text, end)
        return (9, start - len(m[0]), n.end()) if m and n else None
    if kind == "strasse":
        m, first = STRASSE.match(text, end), start
        while first and text[first - 1].isalpha():
            first -= 1
        return (9, first, m.end()) if m and text[first].isupper() else None
    m = AFTER[kind].match(text, end)
    if not m:
        return None
    a, value = m.start(1), m[1]
    if kind == "iban":
        while value and not iban_ok(value) and len(value) > 15:
            value = value[:-1].rstrip()
        if not iban_ok(value):
            return None
    if kind == "secret":
        value = value.rstrip(".)]}:")
        assigned = ASSIGNED.search(text, end, a) or text[start:end].lower() == "bearer" or text[a - 1] in "\"'`"
        if text[start - 1 : start].isalpha() or not assigned or not random_looking(value):
            return None
    return KINDS.index(kind), a, a + len(value)


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all kinds by start, then kind; code points, end exclusive."""
    global _AC
    if _AC is None:
        _AC = automaton()
    out: list[tuple[int, int, int]] = []
    ends = [0] * len(KINDS)  # where the last match of each kind ended, kept or not
    last_digit = -2
    for at, (kind, size) in _AC.iter(text.translate(LOWER)):
        if kind == "digit":
            if at >= ends[2]:
                if m := DIGITS.match(text, at):
                    ends[2] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, m.end(), 2))
            if at >= ends[1] and at != last_digit + 1:
                if m := QUAD.match(text, at):
                    ends[1] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        out.append((at, m.end(), 1))
            last_digit = at
            if at and text[at - 1] == "+" and (m := DIAL.match(text, at - 1)):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((at - 1, m.end(), 3))
        elif kind == "at":
            start = at
            while start > ends[0] and LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                ends[0] = m.end()
                out.append((start, m.end(), 0))
        elif kind == "scheme":
            if m := LOGIN.match(text, at + 1):
                out.append((m.start(1), m.end(1), 7))
        else:
            for one in kind.split("+"):
                if span := added(one, text, at + 1 - size, at + 1):
                    k, a, z = span
                    if a >= ends[k]:
                        ends[k] = z
                        out.append((a, z, k))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """Each stretch of overlapping spans becomes its first span's kind in angle brackets."""
    out, at = [], 0
    for i, (a, b, k) in enumerate(found):
        if a < at and i:
            at = max(at, b)
            continue
        out += (text[at:a], f"<{KINDS[k].upper()}>")
        at = b
    return "".join(out) + text[at:]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added (spans of added kinds), found (whether there is any span).

    Null and empty texts have no spans (the hash is that of no bytes).  Rows are judged apart, so
    repeated rows and ties each give a row, and an empty table gives none.  Work is linear in the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t) for t in b.column("text").to_pylist()]
            base = [[s for s in f if s[2] < BASE] for f in found]
            counts = [pa.array([sum(s[2] == k for s in f) for f in base], pa.int64()) for k in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base]), pa.array([joined(f) for f in found]), pa.array([len(f) - len(x) for f, x in zip(found, base)], pa.int64()), pa.array([bool(f) for f in found], pa.bool_())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "found"],
            )

    return texts_of(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, found boolean")


def redacted(docs: DataFrame) -> DataFrame:
    """The columns of documents with personal data replaced in text; n_chars follows the new text; null text stays null.

    Columns that the table lacks are null, further ones are left out.  Rows are changed apart, so repeated
    rows stay, and an empty table gives none.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            old = b.column("text").to_pylist()
            new = [t if not t else redact(t, spans(t)) for t in old]
            size = [n if t is None else len(t) for t, n in zip(new, b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(new, pa.string()), b.column("lang"), b.column("source"), pa.array(size, pa.int64())], list(DOCUMENT))

    return document_columns(docs).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in DOCUMENT.items()))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
