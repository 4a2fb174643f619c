"""Benchmark decontamination by spaced-seed hashing.

Words are Unicode lower-cased and stripped of ASCII punctuation. Every seed is a fixed mask over SPAN word positions;
the positions left out may differ without changing the hash, so an overlap with substituted words is still hit.
Hashes of the benchmark's masked windows fill a blocked Bloom filter, sized by their number up to 64 MiB, which is all that is sent
to the tasks. Documents' windows that pass it are joined with the benchmark's hashes exactly, and round every hit
of a diagonal the two word sequences are compared along it: matches count +1, substitutions -2, and the stretch
ends where the score falls 5 below its best. An overlap counts when MATCHED words match (all of them for a
shorter item) and at most a fifth of the stretch is substituted.

An item with fewer words than SPAN has one contiguous seed as long as itself. Defined results: null and empty
texts or items overlap nothing; of tied overlaps of a document with an item the earliest is reported; repeated
documents are reported once, and rows that share an item_id are texts of one item; an empty table gives no rows. Texts of any
length are scanned whole. Only doc_id, text, item_id are read, other columns may have any name.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, factors, mix, pieces, stored, strings, table, trimmed
from .url_filter import BlockedBloom

SPAN = 11
#: Positions that the three seeds look at.
SEEDS = ((0, 1, 2, 4, 7, 9, 10), (0, 2, 3, 5, 6, 8, 10), (0, 1, 3, 4, 6, 9, 10))
MATCHED = 13
#: Words kept on both sides of a hit, for the comparison.
AROUND = 64

_PUNCT = string.punctuation.encode()


def plain_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _PUNCT).split()


def seed_hashes(h: np.ndarray, offsets: tuple[int, ...], tag: int) -> np.ndarray:
    """Hash of every window of h under a mask; tag tells masks apart."""
    n = len(h) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, tag * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for c, o in zip(factors(len(offsets)), offsets):
        out += h[o : o + n] * c
    return mix(out)


def masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(tag, positions) of all seeds: the fixed ones and a contiguous one for each length of short items."""
    return list(enumerate(SEEDS)) + [(100 + n, tuple(range(n))) for n in short]


def item_seeds(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, text_key, words, n) and (hash, item_id, text_key, pos) of a benchmark table; text_key tells rows of one id apart."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wh = WordHash()
        for b in pieces(batches):
            w = [wh.array(plain_words(t)) for t in strings(b)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([x.tobytes() for x in w], pa.binary()), pa.array([len(x) for x in w], pa.int32())], names=["item_id", "words", "n"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, keys, hs, pos = [], [], [], []
            for item, key, raw in zip(b.column("item_id").to_pylist(), b.column("text_key").to_pylist(), b.column("words").to_pylist()):
                h = np.frombuffer(raw, np.uint64)
                for tag, m in masks([len(h)]) if 0 < len(h) < SPAN else masks([]):
                    s = seed_hashes(h, m, tag)
                    hs.append(s)
                    pos.append(np.arange(len(s), dtype=np.int32))
                    ids += [item] * len(s)
                    keys += [key] * len(s)
            cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
            cols = [pa.array(cat(hs, np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(cat(pos, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["hash", "item_id", "text_key", "pos"])

    words = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").mapInArrow(trimmed(cut), "item_id long, words binary, n int")
    words = words.withColumn("text_key", F.xxhash64("words")).dropDuplicates(["item_id", "text_key"])
    words = stored(items.sparkSession, words, "items")
    return words, words.select("item_id", "text_key", "words").mapInArrow(trimmed(seeds), "hash long, item_id long, text_key long, pos int")


def _segments(hits: np.ndarray, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of hits whose surroundings touch: (start, end, indices of hits)."""
    breaks = np.flatnonzero(np.diff(hits) > 2 * AROUND + SPAN) + 1
    for part in np.split(np.arange(len(hits)), breaks):
        yield max(0, int(hits[part[0]]) - AROUND), min(n, int(hits[part[-1]]) + SPAN + AROUND), part


def compare(a: np.ndarray, b: np.ndarray, at: int) -> tuple[int, int, int]:
    """Best stretch round position at of two aligned sequences: (start, end, matches)."""
    same = a == b

    def reach(s: np.ndarray) -> int:
        if not len(s):
            return 0
        score = np.cumsum(np.where(s, 1, -2))
        best = np.maximum(np.maximum.accumulate(score), 0)
        over = np.flatnonzero(best - score >= 5)
        score = score[: over[0]] if len(over) else score
        return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0

    end = at + reach(same[at:])
    start = at - reach(same[:at][::-1])
    return start, end, int(same[start:end].sum())


def seed_places(same: np.ndarray) -> np.ndarray:
    """Places of two aligned sequences where a seed hits; of those in one run of equal words, which all give the same stretch, the first."""
    hit = np.zeros(len(same), bool)
    for m in SEEDS:
        n = len(same) - m[-1]
        if n > 0:
            hit[:n] |= np.logical_and.reduce([same[o : o + n] for o in m])
    p = np.flatnonzero(hit)
    return p[np.unique(np.cumsum(~same)[p], return_index=True)[1]]


def overlaps(docs: DataFrame, items: DataFrame, blooms: int | None = None) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_matched): the best overlap of each document with each item."""
    spark = docs.sparkSession
    words, seeds = item_seeds(items)
    short = sorted(r.n for r in words.where(F.col("n").between(1, SPAN - 1)).select("n").distinct().collect())  # SPAN - 1 at most
    filled = BlockedBloom.of(seeds, "hash", blooms)
    blooms, bloom = filled.blocks, spark.sparkContext.broadcast(filled.bits.tobytes())
    all_masks = masks(short)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wh, f = WordHash(), BlockedBloom(blooms, bloom.value)
        for b in pieces(batches):
            out = []
            texts = [plain_words(t) for t in strings(b)]
            h = wh.array([w for t in texts for w in t])
            ends = np.cumsum([len(t) for t in texts])
            found = []  # windows across two documents are told by their ends and dropped
            for tag, m in all_masks:
                s = seed_hashes(h, m, tag)
                p = np.flatnonzero(f.may_hold(s))
                doc = np.searchsorted(ends, p, side="right")
                ok = p + m[-1] < ends[doc] if len(p) else np.zeros(0, bool)
                found.append((doc[ok], p[ok], s[p[ok]]))
            doc, pos, hs = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int),) * 3
            for d in np.unique(doc):
                mine = np.flatnonzero(doc == d)
                mine = mine[np.argsort(pos[mine], kind="stable")]
                base, n = int(ends[d]) - len(texts[d]), len(texts[d])
                local = pos[mine] - base
                for start, end, part in _segments(local, n):
                    out.append((b.column("doc_id")[int(d)].as_py(), start, h[base + start : base + end].tobytes(), hs[mine[part]].view(np.int64).tolist(), local[part].tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary()), pa.array([r[3] for r in out], pa.list_(pa.int64())), pa.array([r[4] for r in out], pa.list_(pa.int32()))],
                names=["doc_id", "start", "words", "hashes", "places"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    found = texts.mapInArrow(trimmed(scan), "doc_id long, start int, words binary, hashes array<bigint>, places array<int>")
    found = stored(spark, found.withColumn("segment", F.xxhash64("start", "words")), "segments")
    hits = found.select("doc_id", "segment", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("doc_id", "segment", F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))
    # a hash that a text and an item repeat joins once, and gives no more diagonals than both have places
    hits = hits.groupBy("doc_id", "segment", "hash").agg(F.collect_set("place").alias("places"))
    seeds = seeds.groupBy("hash", "item_id", "text_key").agg(F.collect_set("pos").alias("at"))
    shifts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform("at", lambda q: p - q))))
    joined = hits.join(seeds, "hash").select("doc_id", "segment", "item_id", "text_key", F.explode(shifts).alias("shift")).distinct()
    pairs = joined.join(found.select("doc_id", "segment", "start", "words").dropDuplicates(["doc_id", "segment"]), ["doc_id", "segment"])
    pairs = pairs.join(words.select("item_id", "text_key", F.col("words").alias("item_words")), ["item_id", "text_key"]).select("doc_id", "item_id", "start", "words", "item_words", "shift")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for r in b.to_pylist():
                d, i = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
                off = r["shift"] - r["start"]  # item position 0 stands there in the segment
                lo, hi = max(0, off), min(len(d), off + len(i))
                x, y = d[lo:hi], i[lo - off : hi - off]
                for p in [0] if len(i) < SPAN else seed_places(x == y).tolist():
                    a, e, m = compare(x, y, p)
                    if m >= min(MATCHED, len(i)) and 5 * (e - a - m) <= e - a:
                        out.append((r["doc_id"], r["item_id"], r["start"] + lo + a, e - a, m))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "start_word", "n_words", "n_matched"])

    checked = pairs.mapInArrow(trimmed(verify), "doc_id long, item_id long, start_word long, n_words long, n_matched long")
    best = checked.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("n_matched")).alias("m"), "start_word", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.start_word", "b.n_words", (-F.col("b.m")).alias("n_matched"))


def op10_spaced_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
