"""Token ids in one compressed file per shard: a wavelet matrix.

A shard holds the ids of a run of documents in ascending doc_id order. Plane k of its matrix keeps bit k (from
the top) of every id, in the order that the planes above leave: zeros first, then ones, each stable. The bits are
compressed with zstd in blocks of BLOCK, and the file holds the ones before each block, so rank is a look-up and one block's
popcount, select a binary search over the blocks. Opening a file reads its headers only; access, counting and occurrence
look-up unpack about one block a plane.

Files are rows (shard, blob) of a table in the cluster's shared folder, one blob per shard, so that any reader
that Spark has can fetch them. Shards come from a range partition on doc_id and, among equal ids, a hash of the text.

Defined results: a null or empty text holds only the end id; rows whose doc_id is null or repeated each keep
their place (nulls first, ties by a hash of the text); an empty table gives no shards and no rows. A text of any length is encoded
whole, in one shard. Other columns are not read, and may have any name.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, table, trimmed

#: Bits of a block.
BLOCK = 1 << 17
#: Text bytes a shard shall hold.
SHARD_BYTES = 12 << 20
_MAGIC = b"WMX1"
#: Words whose ids a worker remembers, twice over, before it forgets those not seen of late.
CACHE_IDS = 500_000
#: Text bytes, and words, that are handled together.
BLOCK_BYTES = 16 << 20
RUN = 64
MARK = "\x01"
#: A comma or full stop between an ASCII letter and white space or the end is a word of its own.
STOP_BEHIND = r"([A-Za-z])([.,])([ \t\n\v\f\r]|$)"


class Plane:
    """A bit vector in compressed blocks with the ones before each, which rank and select unpack one at a time."""

    def __init__(self, n: int, before: np.ndarray, at: np.ndarray, data: memoryview):
        self.n, self.before, self.at, self.data = n, before, at, data
        self.ones = int(before[-1])
        self.held: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint64))

    @staticmethod
    def encode(bit: np.ndarray) -> list[bytes]:
        """Header and blocks of a vector: ones up to each block's end and its length in bytes, then the blocks."""
        packed = np.packbits(bit, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)])
        parts = [packed[i : i + BLOCK // 8] for i in range(0, len(packed), BLOCK // 8)]
        blocks = [zstandard.compress(p.tobytes(), 1) for p in parts]
        ones = [int(np.bitwise_count(p.view(np.uint64)).sum()) for p in parts]
        return [np.cumsum([0, *ones]).astype("<u8").tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes(), *blocks]

    @staticmethod
    def read(n: int, data: memoryview) -> Plane:
        k = -(-n // BLOCK) + 1
        before, at = (np.frombuffer(data, "<u8", k, 8 * k * i).astype(np.int64) for i in (0, 1))
        return Plane(n, before, at, data[16 * k :])

    def block(self, b: int) -> np.ndarray:
        if self.held[0] != b:
            self.held = (b, np.frombuffer(zstandard.decompress(self.data[self.at[b] : self.at[b + 1]]), np.uint64))
        return self.held[1]

    def get(self, i: int) -> int:
        return int(self.block(i // BLOCK)[i % BLOCK >> 6]) >> (i & 63) & 1

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        b, r = i // BLOCK, i % BLOCK
        if not r:
            return int(self.before[b])
        words = self.block(b)
        n = int(self.before[b]) + int(np.bitwise_count(words[: r >> 6]).sum())
        return n + (int(words[r >> 6]) & (1 << (r & 63)) - 1).bit_count()

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * BLOCK, self.n) - self.before
        b = int(np.searchsorted(before, k, side="right")) - 1
        words = self.block(b) if bit else ~self.block(b)
        upto = np.cumsum(np.bitwise_count(words).astype(np.int64))
        w = int(np.searchsorted(upto, k - int(before[b]), side="right"))
        word, left = int(words[w]), k - int(before[b]) - (int(upto[w - 1]) if w else 0)
        for _ in range(left):
            word &= word - 1
        return b * BLOCK + w * 64 + (word & -word).bit_length() - 1

    def bits(self) -> np.ndarray:
        raw = b"".join(zstandard.decompress(self.data[x:y]) for x, y in zip(self.at[:-1].tolist(), self.at[1:].tolist()))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes
        self.zeros = [p.n - p.ones for p in planes]

    @staticmethod
    def encode(ids: np.ndarray) -> bytes:
        """The file of a sequence of ids."""
        ids = np.asarray(ids)
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        seq = ids.astype(np.uint16 if width <= 16 else np.uint32)
        parts, sizes = [], []
        for k in range(width - 1, -1, -1):
            bit = (seq >> k & 1).astype(bool)
            plane = Plane.encode(bit)
            parts += plane
            sizes.append(sum(map(len, plane)))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return _MAGIC + struct.pack("<QB", len(ids), width) + struct.pack(f"<{width}Q", *sizes) + b"".join(parts)

    @staticmethod
    def open(blob: bytes) -> WaveletMatrix:
        """The matrix of a file; only the headers are read."""
        if blob[:4] != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        n, width = struct.unpack_from("<QB", blob, 4)
        sizes = struct.unpack_from(f"<{width}Q", blob, 13)
        at, planes, data = 13 + 8 * width, [], memoryview(blob)
        for s in sizes:
            planes.append(Plane.read(n, data[at : at + s]))
            at += s
        return WaveletMatrix(n, planes)

    def access(self, i: int) -> int:
        v = 0
        for p, z in zip(self.planes, self.zeros):
            b, r = p.get(i), p.rank1(i)
            i, v = (z + r, v << 1 | 1) if b else (i - r, v << 1)
        return v

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        width = len(self.planes)
        if symbol < 0 or symbol >> width:
            return 0, 0
        for k, (p, z) in enumerate(zip(self.planes, self.zeros)):
            ra, rb = p.rank1(a), p.rank1(b)
            a, b = (z + ra, z + rb) if symbol >> width - 1 - k & 1 else (a - ra, b - rb)
        return a, b

    def count(self, symbol: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        a, b = self._range(symbol, start, self.n if end is None else end)
        return b - a

    def occurrence(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id, -1 if there are fewer."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i, width = a + k, len(self.planes)
        for level in range(width - 1, -1, -1):
            p, z = self.planes[level], self.zeros[level]
            i = p.select(1, i - z) if symbol >> width - 1 - level & 1 else p.select(0, i)
        return i

    def all(self) -> np.ndarray:
        """Every id in order: the planes undone from the last one up."""
        seq = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, p in enumerate(reversed(self.planes)):
            bit, out = p.bits(), np.empty_like(seq)
            z = self.n - p.ones
            out[~bit] = seq[:z]
            out[bit] = seq[z:] | (1 << k)
            seq = out
        return seq


class WordTokenizer:
    """ids of texts, from the ids of their distinct words.

    The vocabulary's pre-tokeniser never matches across white space and its normaliser works on single
    characters, so the ids of a text are those of its words in turn. Texts are cut at ASCII white space and their
    words numbered on the Arrow side; words met before come from memory, new ones go to the library many at a time.
    A run of words that hold letters only is parted again by the ids that end a word; if their number is not that of the
    words, and for words with other characters, a control character with an id of its own stands between the words.
    Ids take two bytes each. The strings of special tokens, which hold no white space, are ordinary text unless special.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks already fill the cores
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        vocab = self.tok.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids of more than two bytes")
        suffix = self.tok.model.end_of_word_suffix
        self.last = np.zeros(1 << 16, bool)
        if suffix:
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = self._ids(MARK)
        if len(self.mark) != 1:
            raise ValueError("the vocabulary lacks a single id for the mark")

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")

    def learn(self, todo: list[str]) -> None:
        """Put the ids of new words into memory."""
        letters, others = [], []
        for w in todo:
            (letters if w.isalpha() else others).append(w)
        for i in range(0, len(letters), RUN):
            part = letters[i : i + RUN]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                self._keep(part, ids, ends, ends)
            else:
                others += part
        for i in range(0, len(others), RUN):
            part = others[i : i + RUN]
            ids = self._ids(f" {MARK} ".join(part))
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            if len(ends) == len(part):
                self._keep(part, ids, ends, ends + 1)
            else:  # a word holds the mark itself
                self.young.update((w, self._ids(w).tobytes()) for w in part)

    def _keep(self, part: list[str], ids: np.ndarray, ends: np.ndarray, following: np.ndarray) -> None:
        raw, at = ids.tobytes(), [0, *(2 * following).tolist()]
        self.young.update((w, raw[a:e]) for w, a, e in zip(part, at, (2 * ends).tolist()))

    def of_words(self, words: list[str]) -> list[bytes]:
        """ids of distinct words. Words not asked for since the memory last filled up are forgotten."""
        young = self.young
        new = [w for w in words if w not in young]
        if len(young) + len(new) > CACHE_IDS:
            self.old, young, new = young, {}, words
            self.young = young
        if self.old:
            again = {w: self.old[w] for w in new if w in self.old}
            young.update(again)
            new = [w for w in new if w not in again]
        self.learn(new)
        return list(map(self.young.__getitem__, words))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; their number for each text)."""
        if not len(texts):
            return np.empty(0, "<u2"), np.empty(0, np.int64)
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, STOP_BEHIND, r"\1 \2\3"))
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = cut.flatten().dictionary_encode()
        parts = self.of_words(coded.dictionary.to_pylist())
        parts.append(np.array([end], "<u2").tobytes())
        seq = np.insert(coded.indices.to_numpy(), bounds[1:], len(parts) - 1)
        found = pa.array(parts, pa.large_binary()).take(pa.array(seq))  # the ids of all words, one behind the other
        offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(seq) + 1]
        ids = np.frombuffer(found.buffers()[2], "<u2", count=int(offsets[-1]) // 2)
        ends = offsets[bounds[1:] + np.arange(1, len(texts) + 1)] // 2
        return ids, np.diff(ends, prepend=0)


_loaded: dict[tuple[str, bool], WordTokenizer] = {}


def tokenizer(path: str, special: bool = False) -> WordTokenizer:
    if (path, special) not in _loaded:
        _loaded[path, special] = WordTokenizer(path, special)
    return _loaded[path, special]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, shard_bytes: int = SHARD_BYTES, special: bool = False) -> DataFrame:
    """Shards of all texts: (shard, doc_ids, lengths, n_ids, blob), stored in the shared folder; special as for WordTokenizer."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = texts.withColumn("tie", F.xxhash64("text"))
    dealt = texts.repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path, special)
        ids, lens, docs_, held = [], [], [], []

        def close() -> None:
            if held:
                got, n = tok.encode(pa.concat_arrays(held), end_id)
                ids.append(got)
                lens.extend(n.tolist())
                held.clear()

        for b in batches:
            docs_ += b.column("doc_id").to_pylist()
            held.append(b.column("text"))
            if sum(x.nbytes for x in held) >= BLOCK_BYTES:
                close()
        close()
        if docs_:
            blob = WaveletMatrix.encode(np.concatenate(ids))
            cols = [pa.array([docs_], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([sum(lens)], pa.int64()), pa.array([blob], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_ids", "lengths", "n_ids", "blob"])

    made = dealt.mapInArrow(trimmed(run), "doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, blob binary")
    path = shared_dir(spark, "wavelet")
    made.withColumn("shard", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema("doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, blob binary, shard int").parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """(shard, before): ids in all shards before it. One row a shard, so the running sum is small."""
    w = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return shards.select("shard", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(w), F.lit(0).cast("long"))).select("shard", "before")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the stored files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                ids = WaveletMatrix.open(one.column("blob")[0].as_py()).all().astype("<u4")
                lens = np.array(one.column("lengths")[0].as_py(), np.int64)
                ends = np.cumsum(lens)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())]
                cols = [one.column("doc_ids")[0].values, pa.array(ends - lens + one.column("before")[0].as_py()), pa.array(lens), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = shards.join(starts(shards), "shard").select("doc_ids", "lengths", "before", "blob")
    return joined.mapInArrow(trimmed(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    # as the library encodes: strings of special tokens in a text are those tokens
    return read_documents(write_shards(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), 2, special=True))
