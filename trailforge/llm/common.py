"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Rows here are whole documents or packed blocks, so a batch stays small.
BATCH_ROWS = 256
#: Settings while a table is written to the shared folder.
WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Text bytes in a piece of a batch.
PIECE_BYTES = 1 << 20
#: Words a worker remembers before it starts afresh; bounds its memory, never its results.
CACHE_WORDS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; where that is unset, one is made for a session on one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="trailforge-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    While it is written Python gets few rows at a time, as they can be long, and the shuffle files of this write go as it
    ends; the session has its own settings again afterwards.
    """
    path = shared_dir(spark, what)
    own = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by stored() that nothing will read again."""
    for df in tables:
        for f in {os.path.dirname(x) for x in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no plan refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives freed memory back to the system, as idle workers count for their executor too."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return whole


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Spark's batches in smaller ones, of about size bytes of text each; a longer text is a piece alone.

    Spark bounds the bytes of the batches that it sends, and this what is made of them at a time, so no setting of the
    session is touched.
    """
    for b in batches:
        i = b.schema.get_field_index("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if i >= 0 else None
        at, done = 0, 0
        while at < b.num_rows:
            end = min(at + rows, b.num_rows)
            if ends is not None:
                end = max(at + 1, min(end, int(np.searchsorted(ends, done + size, side="right"))))
                done = int(ends[end - 1])
            yield b.slice(at, end - at)
            at = end


#: Bytes of a word up to which it is hashed with all others at once.
SHORT_WORD = 32


def word_hashes(texts: pa.Array, known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of texts in turn, where each text's words begin, and the last ones end); null is empty."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    bounds = cut.offsets.to_numpy().astype(np.int64)
    flat = cut.flatten()
    if not len(flat):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    _, offsets, raw = flat.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(flat.type) else np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    full = ends[1:] > ends[:-1]  # white space at an end leaves an empty word
    begin, n, size = ends[:-1][full], np.diff(ends)[full], int(ends[-1])
    data = np.zeros(size + 8, np.uint8)
    data[:size] = np.frombuffer(raw, np.uint8, size) if size else 0
    eight = np.ndarray(size + 1, "<u8", data, 0, (1,))  # the eight bytes from each place on
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    h = mix((eight[begin] & masks[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for at in range(8, SHORT_WORD, 8):
        more = np.flatnonzero((n > at) & (n <= SHORT_WORD))
        h[more] = mix(h[more] * np.uint64(0xA0761D6478BD642F) + (eight[begin[more] + at] & masks[np.minimum(n[more] - at, 8)]))
    long = np.flatnonzero(n > SHORT_WORD)
    h[long] = known.array([data[b : b + k].tobytes() for b, k in zip(begin[long].tolist(), n[long].tolist())])
    return h, np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column, null as the empty text."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHash(dict):
    """word -> 64-bit hash, remembered for up to CACHE_WORDS words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def factors(n: int) -> np.ndarray:
    """n odd multipliers without a linear relation among them, for hashes of word sequences."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def crc_mod(n: int):
    """crc32 of the id as text, modulo n; a null id has no remainder and so matches none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed block: byte planes, which zstd shortens well."""
    parts = []
    for a in arrays:
        parts.append(np.array([len(a)], np.int64).tobytes() + a.dtype.str.encode().ljust(8) + np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.compress(b"".join(parts), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n, kind = int(np.frombuffer(raw, np.int64, 1, at)[0]), np.dtype(raw[at + 8 : at + 16].decode().strip())
        at += 16
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def least(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def order_of(*keys: np.ndarray) -> np.ndarray:
    """Stable order of rows by columns of non-negative integers, the first one leading.

    A column that leaves room in 64 bits is sorted together with the rows' numbers, which is much faster than to sort those by it.
    """
    n, order = len(keys[0]), None
    bits = np.uint64(max(1, n).bit_length())
    for key in reversed(keys):
        x = key if order is None else key[order]
        if n and int(x.max()) < 1 << 64 - int(bits):
            x = x.astype(np.uint64) << bits
            x |= np.arange(n, dtype=np.uint64)
            x.sort()
            x &= (np.uint64(1) << bits) - np.uint64(1)
            at = x.view(np.int64)
        else:
            at = np.argsort(x, kind="stable")
        order = at if order is None else order[at]
    return order


def changes(*keys: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for key in keys[1:]:
        new[1:] |= key[1:] != key[:-1]
    return new


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, number of each element among them) of non-negative integers."""
    order = order_of(x)
    x = x[order]
    new = changes(x)
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], at
