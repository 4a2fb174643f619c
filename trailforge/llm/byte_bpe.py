"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks that overlap; a short one is a single chunk. Every chunk is pre-tokenised by itself; where two neighbours
share a pre-token boundary inside their overlap they agree from there on, because a match depends only on
the text from its start to just behind its end. The pieces between the stitched boundaries are then encoded
by rank merging, and decoding concatenates the bytes of the ids. The chunks of a text of more than LONG characters are rows
of their own, pre-tokenised and merged in parallel; a text's ids are the same either way. The ids of one text are one value, so
they have to fit into a task.

Defined results: a null text counts as empty and has no ids; the digest of no ids is that of the empty
string. Repeated rows each get a row; an empty table gives none. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CACHE_WORDS, pieces, stored, strings, table, trimmed

#: Characters of a chunk, and those that it shares with the next one.
CHUNK = 1 << 12
OVERLAP = 1 << 8
#: Characters beyond which a text's chunks are spread over tasks.
LONG = 1 << 16
#: A match that ends this far before a chunk's end cannot depend on what the chunk doesn't show:
#: the longest fixed alternative of the pattern has three characters, the others end at a class change.
MARGIN = 8


def boundaries(pattern: regex.Pattern, text: str, start: int, end: int, last: bool) -> list[int]:
    """Ends of the matches in text[start:end] that the rest of the text cannot change."""
    ends = [m.end() for m in pattern.finditer(text[start:end])]
    limit = end - start if last else end - start - MARGIN
    return [start + e for e in ends if e <= limit]


def pre_tokenize(pattern: regex.Pattern, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The matches of pattern over a whole text, by overlapping chunks.

    The pattern has to cover every character, as the published byte-level patterns do.
    """
    n = len(text)
    if n <= chunk:
        return pattern.findall(text)
    spans = chunk_spans(n, chunk, overlap)
    cuts = boundaries(pattern, text, *spans[0], spans[0][1] == n)
    for a, b in spans[1:]:
        own = boundaries(pattern, text, a, b, b == n)
        known = set(own)
        meet = next((i for i in range(_first(cuts, a), len(cuts)) if cuts[i] in known), None)
        while meet is None:  # no common boundary yet: go on from the last sure one until one appears
            frm = cuts[-1] if cuts else 0
            size = max(chunk, 2 * (b - frm))
            to = min(n, frm + size)
            more = boundaries(pattern, text, frm, to, to == n)
            while not more and to < n:
                size *= 2
                to = min(n, frm + size)
                more = boundaries(pattern, text, frm, to, to == n)
            first = len(cuts)
            cuts += more
            if to == n:
                own, meet = [], len(cuts) - 1
            else:
                meet = next((i for i in range(first, len(cuts)) if cuts[i] in known), None)
                if meet is None and cuts[-1] >= b - MARGIN:
                    own, meet = [], len(cuts) - 1
        p = cuts[meet] if cuts else 0
        if own:
            cuts = cuts[: meet + 1] + [e for e in own if e > p]
    return [text[i:j] for i, j in zip([0, *cuts], cuts)]


def _first(cuts: list[int], a: int) -> int:
    import bisect

    return bisect.bisect_left(cuts, a)


class Pieces(dict):
    """pre-token -> its ids as bytes, by rank merging; forgotten when CACHE_WORDS are held."""

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[piece] = ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        return ids


class ByteBpe:
    """Encoder and decoder over a table of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = _column(dict(zip(ranks.values(), ranks)))
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ids_of = Pieces(self.core._core_bpe.encode_single_piece)  # merges the bytes of one pre-token, without any pattern
        self.pattern = regex.compile(pattern)
        self.text_of = _column({v: b"%d " % v for v in ranks.values()})

    def merged(self, pieces: list[str]) -> np.ndarray:
        """Ids of pre-tokens in turn."""
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, pieces)), "<u4")

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text: the pieces between its stitched boundaries, each merged by rank."""
        return self.merged(pre_tokenize(self.pattern, text))

    def decode(self, ids: np.ndarray) -> bytes:
        return _concat(self.bytes_of, ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals, one space between them."""
        return _concat(self.text_of, ids)[:-1]


def _column(values: dict[int, bytes]) -> pa.Array:
    return pa.array([values.get(i) for i in range(max(values, default=-1) + 1)], pa.large_binary())


def _concat(column: pa.Array, ids: np.ndarray) -> bytes:
    """The values at ids one behind the other: the data buffer of an Arrow take."""
    if len(ids) == 0:
        return b""
    taken = column.take(pa.array(np.asarray(ids, np.int64)))
    if taken.null_count:
        raise ValueError("an id is not in the vocabulary")
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    return taken.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes()


_loaded: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process and vocabulary."""
    key = (path, pattern)
    if key not in _loaded:
        _loaded[key] = ByteBpe(path, pattern)
    return _loaded[key]


def chunk_spans(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of a text of n characters: overlapping chunks, the last one ends it."""
    out, at = [], 0
    while at + chunk < n:
        out.append((at, at + chunk))
        at += chunk - overlap
    return [*out, (at, n)]


def _chunk_rows(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row, doc_id, no, n, start, part) of texts: their overlapping chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                spans = chunk_spans(len(text), chunk, overlap)
                for at in range(0, len(spans), 64):
                    some = spans[at : at + 64]
                    cols = [pa.array([row] * len(some), pa.int64()), pa.array([doc_id] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array([len(spans)] * len(some), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([x for x, _ in some], pa.int64()), pa.array([text[x:y] for x, y in some], pa.string())], names=["row", "doc_id", "no", "n", "start", "part"])

    return docs.select("row", "doc_id", "text").mapInArrow(trimmed(run), "row long, doc_id long, no int, n int, start long, part string")


def encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text): chunks are pre-tokenised and merged in parallel, wherever they are.

    The sure boundaries of each chunk's overlaps go to its neighbours; the first that both know is where they are stitched. A
    text with an overlap without a common boundary is pre-tokenised by the loop that looks for one further on.
    """
    chunks = _chunk_rows(docs.withColumn("row", F.monotonically_increasing_id()), chunk, overlap).repartition("row", "no")
    chunks = stored(docs.sparkSession, chunks, "chunks")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in pieces(batches, 16):
            head, tail = [], []
            for no, n, start, part in zip(*(b.column(c).to_pylist() for c in ("no", "n", "start", "part"))):
                ends = boundaries(bpe.pattern, part, 0, len(part), no + 1 == n)
                head.append([start + e for e in ends if e <= overlap] if no else [])
                tail.append([start + e for e in ends if e >= len(part) - overlap] if no + 1 < n else [])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "no", "n")), pa.array(head, kind), pa.array(tail, kind)], names=["row", "no", "n", "head", "tail"])

    known = chunks.mapInArrow(trimmed(borders), "row long, no int, n int, head array<bigint>, tail array<bigint>")
    w = W.partitionBy("row").orderBy("no")  # the chunks of one text
    known = known.withColumn("first", F.array_min(F.array_intersect(F.lag("tail").over(w), "head"))).withColumn("last", F.array_min(F.array_intersect("tail", F.lead("head").over(w))))
    lost = ((F.col("no") > 0) & F.col("first").isNull()) | ((F.col("no") + 1 < F.col("n")) & F.col("last").isNull())
    known = known.withColumn("lost", F.max(lost).over(W.partitionBy("row"))).select("row", "no", "first", "last", "lost")
    known = stored(docs.sparkSession, known, "borders")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in pieces(batches, 16):
            out = []
            for start, part, first, last in zip(*(b.column(c).to_pylist() for c in ("start", "part", "first", "last"))):
                begin, end = (first or start) - start, (start + len(part) if last is None else last) - start
                ends = [e for e in boundaries(bpe.pattern, part, 0, len(part), last is None) if begin < e <= end]
                out.append(bpe.merged([part[i:j] for i, j in zip([begin, *ends], ends)]).astype("int32"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "no")), pa.array(out, pa.list_(pa.int32()))], names=["row", "doc_id", "no", "ids"])

    sure = chunks.join(known.where("NOT lost"), ["row", "no"]).mapInArrow(trimmed(merge), "row long, doc_id long, no int, ids array<int>")
    sure = sure.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in pieces(batches, 1):
            parts = sorted(b.column("parts")[0].as_py(), key=lambda r: r["no"])
            text = "".join(r["part"][: chunk - overlap] for r in parts[:-1]) + parts[-1]["part"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bpe.encode(text).astype("int32")], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    odd = chunks.join(known.where("lost"), ["row", "no"]).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("no", "part")).alias("parts"))
    return sure.select("doc_id", "ids").unionByName(odd.select("doc_id", "parts").mapInArrow(trimmed(whole), "doc_id long, ids array<int>"))


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, long: int = LONG) -> DataFrame:
    """doc_id, n_tokens, ids of each text, or with digests=True the sha256 of the ids and of the decoded bytes.

    The chunks of a text of more than long characters are rows of their own, those of others are taken in turn.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def shown(bpe: ByteBpe, doc_ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
        cols = [doc_ids, pa.array([len(x) for x in found], pa.int64())]
        if digests:
            cols += [pa.array([hashlib.sha256(f(x)).hexdigest() for x in found], pa.string()) for f in (bpe.decimals, bpe.decode)]
        else:
            cols.append(pa.array([x.astype("int32") for x in found], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in pieces(batches):
            yield shown(bpe, b.column("doc_id"), [bpe.encode(t) for t in strings(b)])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in pieces(batches, 1):
            yield shown(bpe, b.column("doc_id"), [b.column("ids")[0].values.to_numpy()])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    large = F.coalesce(F.length("text") > long, F.lit(False))
    short = texts.where(~large).mapInArrow(trimmed(run), schema)
    return short.unionByName(encode_long(texts.where(large), path, pattern, CHUNK, OVERLAP).mapInArrow(trimmed(close), schema))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of a column ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in pieces(batches):
            out = [bpe.decode(np.array(x or [], np.int64)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, decoded binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)
