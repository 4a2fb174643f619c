"""Document fingerprints from prefix polynomial hashes.

For code points c_0..c_{n-1} the prefix array P[i] = sum over j < i of (c_j + 1) * B^j modulo 2^31 - 1 answers the
hash of every span in constant time: (P[b] - P[a]) * B^-a. Two spans are equal if two such hashes, under two
bases, and their lengths are; the longest common extension of two positions is found by binary search.

A fingerprint is the length, the hash of the whole text under both bases, and a bottom sketch: the SKETCH
smallest distinct values of the mixed hashes of all spans of SPAN code points (a shorter text is one span).
Likeness estimates the share of common spans (Dice) from two sketches.

Defined results: null and empty texts have the fingerprint of length 0, whose likeness is 1 to itself and 0 to
others. Rows are ordered by doc_id, nulls first, repeated ids by a hash of their text; each row's next is the one that follows,
the last row's is the first; a single row is its own next. An empty table gives no rows. Texts of any length are hashed whole;
only doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, stored, strings, table, trimmed

P31 = (1 << 31) - 1
BASES = (1_103_515_245, 1_610_612_741)
SPAN = 16
SKETCH = 64
#: Text bytes of a block of neighbouring documents.
BLOCK_BYTES = 16 << 20

_M, _S = np.uint64(P31), np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^62; x, which is used up, has to be a temporary."""
    for _ in range(2):
        high = x >> _S
        x &= _M
        x += high
    x *= x != _M
    return x


class Powers:
    """B^i and B^-i modulo 2^31 - 1, grown as longer texts come."""

    def __init__(self, base: int):
        self.base = base
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, _mod(self.up * np.uint64(pow(self.base, k, P31)))])
            self.down = np.concatenate([self.down, _mod(self.down * np.uint64(pow(self.base, -k, P31)))])


_POWERS = tuple(Powers(b) for b in BASES)


class Prefixes:
    """Prefix arrays of a text under both bases."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self.p = []
        for pw in _POWERS:
            pw.upto(self.n + 1)
            terms = self.codes * pw.up[: self.n]  # below 2^52; one fold leaves less than 2^32
            high = terms >> _S
            terms &= _M
            terms += high
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            self.p.append(_mod(sums))

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Hashes of the code points in [a, b), wherever they stand."""
        return tuple((int(p[b]) - int(p[a])) * int(w.down[a]) % P31 for p, w in zip(self.p, _POWERS))

    def spans(self, length: int) -> np.ndarray:
        """Hashes under the first base of all spans of a length; a shorter text is a single span."""
        if self.n == 0:
            return np.empty(0, np.uint64)
        length = min(length, self.n)
        p = self.p[0]
        return _mod((p[length:] + _M - p[:-length]) * _POWERS[0].down[: self.n - length + 1])

    def fingerprint(self) -> Fingerprint:
        x = self.spans(SPAN)
        x = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        return Fingerprint(self.n, self.span(0, self.n), _smallest(x, SKETCH))


def _smallest(x: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, ascending."""
    take = 2 * k
    while take < len(x):
        found = np.unique(np.partition(x, take)[:take])
        if len(found) >= k:
            return found[:k]
        take *= 8
    return np.unique(x)[:k]


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common run from a[i] and b[j] on."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.span(i, i + mid) == b.span(j, j + mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


class Fingerprint:
    def __init__(self, n: int, whole: tuple[int, int], sketch: np.ndarray):
        self.n, self.whole, self.sketch = n, whole, sketch

    def __str__(self) -> str:
        return f"{self.n:x}.{self.whole[0]:08x}{self.whole[1]:08x}." + self.sketch.astype(">u4").tobytes().hex()

    @staticmethod
    def parse(s: str) -> Fingerprint:
        n, whole, sketch = s.split(".")
        return Fingerprint(int(n, 16), (int(whole[:8], 16), int(whole[8:], 16)), np.frombuffer(bytes.fromhex(sketch), ">u4").astype(np.uint64))

    def likeness(self, other: Fingerprint) -> float:
        """Estimated share of common spans: 1 for equal texts, 0 for texts without a common span."""
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        least = np.union1d(self.sketch, other.sketch)[:SKETCH]
        both = np.isin(least, self.sketch, assume_unique=True) & np.isin(least, other.sketch, assume_unique=True)
        j = float(both.sum()) / len(least)
        return 2 * j / (1 + j)


def in_order(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, doc_id, text), each block a run of documents in ascending doc_id, rows of one id by a hash of their text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-size // block_bytes)), "doc_id", "tie")
    return keyed.sortWithinPartitions("doc_id", "tie", "text").select(F.spark_partition_id().alias("block"), "doc_id", "text")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long"


class _Row:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text, self.pre = doc_id, text, Prefixes(text)
        self.fp = self.pre.fingerprint()

    def against(self, after: _Row) -> tuple:
        """The result of a document and the one that follows it."""
        k = len(self.text) // 4
        edited = self.text[: len(self.text) - k] + after.text[:k]
        pre = Prefixes(edited)
        fp = pre.fingerprint()
        return (
            self.doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(self.fp), str(fp), self.fp.likeness(fp), self.fp.likeness(after.fp),
            common_extension(self.pre, 0, pre, 0), common_extension(self.pre, 0, after.pre, 0),
        )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness (see op2).

    A block's task compares the rows inside it and hands on its first and last row; a block's last row then meets the first
    one of the next block, of the first block after the last.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block = None

        def rows(part: int, out: list[tuple], end: str = "", text: str = "") -> pa.RecordBatch:
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(out), pa.int32()), pa.array([end] * len(out), pa.string()), pa.array([text] * len(out), pa.string()), *cols], names=["block", "end", "text", *NAMES])

        for b in pieces(batches):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), strings(b)):
                now = _Row(doc_id, text)
                if held is None:
                    block = b.column("block")[0].as_py()
                    yield rows(block, [(doc_id, *[None] * 8)], "first", text)
                else:
                    out.append(held.against(now))
                held = now
            yield rows(block, out)
        if held is not None:
            yield rows(block, [(held.doc_id, *[None] * 8)], "last", held.text)

    done = stored(spark, in_order(docs).mapInArrow(trimmed(run), "block int, end string, text string, " + SCHEMA), "compared")
    ends = done.where("end <> ''").select("block", "end", "doc_id", "text")
    first, last = ends.where("end = 'first'"), ends.where("end = 'last'")
    w = W.orderBy("block")  # a number a block
    following = first.select("block", F.coalesce(F.lead("block").over(w), F.min("block").over(w)).alias("next"))
    met = last.select("block", "doc_id", "text").join(following, "block").join(first.select(F.col("block").alias("next"), F.col("text").alias("after")), "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 16):
            out = [_Row(i, t).against(_Row(None, a)) for i, t, a in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(_TYPES)], names=NAMES)

    return done.where("end = ''").select(*NAMES).unionByName(met.select("doc_id", "text", "after").mapInArrow(trimmed(close), SCHEMA))


def op2_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
