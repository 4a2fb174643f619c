"""Personal data in text: plain identifiers, and disguised ones found through offset-preserving normalisation.

Plain identifiers are matched on the text as it stands, leftmost and non-overlapping for each kind. Beside
them, transducers rewrite the text (look-alike letters, digits of all scripts, spelled digits, at/dot disguises) while
they keep, for every character they emit, the source characters it stands for. The same detectors run over
the rewritten text, and what they find is mapped back to spans of the source. A mapped span is added unless
a plain span of its kind holds it already; plain ones always stay.

Offsets count code points, ends are exclusive. Defined results: null and empty texts have no spans; repeated
rows each get a row; very long runs without an identifier cost linear time. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, strings, table, trimmed

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A card has 16 digits at least, each after at most one separator.
_CARD_HINT = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_IP_HINT = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")

# Letters and digits that look like ASCII ones, beside those that NFKC maps by itself.
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
_DROPPED = "​‌‍⁠­﻿"
# Digit words.
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

# every decimal digit of Unicode; they stand in tens from 0 to 9
_WIDE = "！-～①-⑨\U0001d400-\U0001d7ff" + "".join(f"{chr(c)}-{chr(c + 9)}" for c in range(128, sys.maxunicode - 8) if unicodedata.decimal(chr(c), None) == 0)
_GLYPH = re.compile("[" + re.escape("".join(_LOOKALIKE)) + _DROPPED + _WIDE + "]")
_WORDS = "|".join(_DIGIT_WORDS)
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_WORDS})(?:[\x20.-]{{1,2}}(?:{_WORDS}|[0-9]+))+(?![^\W_])")
_DIGIT_WORD = re.compile(rf"(?i){_WORDS}")
_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s+@\s+|\s*[\[({<]\s*@\s*[\])}>]\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s+\.\s+)"
#: A disguised address needs its at and, in the domain, a dot; one of them at least is disguised. A local part without them matches too, so that it is read once.
_HIDDEN = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])(?>[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*(?:{_DOT}[A-Za-z0-9_%+-]+)*)((?:{_AT}|@)[A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)+)?")
_HIDDEN_HINT = re.compile(r"(?i)[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\sdot\s|\s\.\s|\s@\s")
#: Four groups of an ip with dots, plain or disguised, between them; a group is digits or up to three digits that are spelled.
_GROUP = rf"(?:[0-9]+|(?:{_WORDS}|[0-9])(?:[\x20-]{{1,2}}(?:{_WORDS}|[0-9])){{0,2}})"
_HIDDEN_IP = re.compile(rf"(?i)(?<![^\W_]){_GROUP}(?:(?:{_DOT}|\.){_GROUP}){{3}}(?![^\W_])")
#: What such an ip has unless the hint of an address shows it: a full stop beside a digit word.
_SPELLED_STOP = re.compile(rf"(?i)\.(?:(?<=[ehnortx]\.)[0-9]|{_WORDS})")
_AT_RE, _DOT_RE = re.compile(f"(?i){_AT}"), re.compile(f"(?i){_DOT}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _email_spans(text: str) -> list[tuple[int, int]]:
    """From each @ back over its local part, so that runs without one cost nothing."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        if at >= floor:
            s = at
            while s > floor and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at)):
                out.append((s, m.end()))
                floor = m.end()
            elif s < at:
                floor = max(floor, at)
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain identifiers, by kind and then by start."""
    out = [("email", a, b) for a, b in _email_spans(text)] if "@" in text else []
    if _IP_HINT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    if _CARD_HINT.search(text):
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Apply ascending, disjoint edits; each new character stands for the whole span that it replaces."""
        parts, s, e, at = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            s += self.start[at:a] + [self.start[a]] * len(new)
            e += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        out = Mapped.__new__(Mapped)
        out.text = "".join(parts) + self.text[at:]
        out.start, out.end = s + self.start[at:], e + self.end[at:]
        return out

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def fold_glyphs(t: Mapped) -> Mapped:
    def one(c: str) -> str:
        if c in _DROPPED:
            return ""
        digit = unicodedata.decimal(c, None)
        return _LOOKALIKE.get(c) or (unicodedata.normalize("NFKC", c) if digit is None else str(digit))

    return t.replace([(m.start(), m.end(), one(m[0])) for m in _GLYPH.finditer(t.text)])


def fold_digit_words(t: Mapped) -> Mapped:
    """Runs of digit words become digits; what separates two of them is dropped."""
    edits = []
    for m in _SPELLED.finditer(t.text):
        at = m.start()
        for w in re.finditer(rf"(?i){_WORDS}|[0-9]+", m[0]):
            a, b = m.start() + w.start(), m.start() + w.end()
            if a > at:
                edits.append((at, a, ""))
            if not w[0].isdigit():
                edits.append((a, b, _DIGIT_WORDS[w[0].lower()]))
            at = b
    return t.replace(edits)


def fold_ips(t: Mapped) -> Mapped:
    """Digit words and dot disguises of an ip; unlike in other runs of digit words its full stops stay."""
    edits = []
    if not (_HIDDEN_HINT.search(t.text) or _SPELLED_STOP.search(t.text)):
        return t
    for m in _HIDDEN_IP.finditer(t.text):
        at = m.start()
        for w in re.finditer(rf"(?i){_WORDS}|[0-9]+|{_DOT}|\.", m[0]):
            a, b = m.start() + w.start(), m.start() + w.end()
            if a > at:
                edits.append((at, a, ""))
            if not w[0].isdigit():
                edits.append((a, b, _DIGIT_WORDS.get(w[0].lower(), ".")))
            at = b
    return t.replace(edits)


def fold_disguises(t: Mapped) -> Mapped:
    edits = []
    for m in _HIDDEN.finditer(t.text):
        body = m[0]
        if not m[1]:
            continue
        if "@" in body and not _DOT_RE.search(body) and not _AT_RE.search(body):
            continue
        plain_at = re.search(r"\s+at\s+", body, re.I)
        if plain_at and not re.search(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\sdot\s", body, re.I):
            continue  # an ordinary "at" before an ordinary file or host name
        found = [(x.start(), x.end(), "@") for x in _AT_RE.finditer(body)]
        found += [(x.start(), x.end(), ".") for x in _DOT_RE.finditer(body)]
        last = -1
        for a, b, new in sorted(found):
            if a >= last:
                edits.append((m.start() + a, m.start() + b, new))
                last = b
    return t.replace(edits)


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Plain spans, and all spans with those that only normalisation shows; each by kind, then start."""
    base = base_spans(text)
    glyphs, spelled, hidden = not text.isascii() and _GLYPH.search(text), _SPELLED.search(text), _HIDDEN_HINT.search(text)
    if not (glyphs or spelled or hidden or _SPELLED_STOP.search(text)):
        return base, base
    plain = fold_glyphs(Mapped(text))
    t, ips = fold_disguises(fold_digit_words(plain)), fold_ips(plain)
    if t.text == text == ips.text:
        return base, base
    found = [(k, *t.source(a, b)) for k, a, b in base_spans(t.text)]
    hidden_ips = [(k, *ips.source(a, b)) for k, a, b in base_spans(ips.text) if k == "ip"]
    every = []
    for kind in KINDS:
        own: list[tuple[int, int]] = []
        for spans in (base, found, hidden_ips):
            starts, ends = [a for a, _ in own], list(accumulate((b for _, b in own), max))
            own += [(a, b) for k, a, b in spans if k == kind and not ((i := bisect_right(starts, a)) and ends[i - 1] >= b)]
            own.sort()
        every += [(kind, a, b) for a, b in own]
    return base, every


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by the name of its kind; of overlapping ones the earliest, then longest, wins."""
    parts, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{k.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(parts) + text[at:]


def _shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of plain spans, their digest, and all spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [find_spans(t) for t in strings(b)]
            cols = [b.column("doc_id")]
            cols += [pa.array([sum(k == s[0] for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            cols.append(pa.array([hashlib.sha256(_shown(base).encode()).hexdigest() for base, _ in rows], pa.string()))
            cols.append(pa.array([_shown(every) for _, every in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with identifiers replaced and n_chars, where there is one, counted anew; a null text stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [None if t is None else redact(t, find_spans(t)[1]) for t in b.column("text").to_pylist()]
            cols = list(b.columns)
            names = b.schema.names
            cols[names.index("text")] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    done = docs.mapInArrow(trimmed(run), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return done


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
