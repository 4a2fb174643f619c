"""URL filter: a blocked Bloom filter in front of an exact hash join.

The listed entries are host + path prefixes. A url can only match an entry that equals one of its own
candidates: a suffix of its host at a label boundary, with a prefix of its path of a length that some entry
has. Candidates are tested against a blocked Bloom filter of the canonical entries (one 512-bit block per key,
eight bits inside it); what passes goes to an exact hash join with the entries, which removes false positives.
The longest matching entry wins. Urls without a match are allowed: the list is all that the method knows.

The filter is sized by the list, up to MAX_BLOCKS, and that bounds what is broadcast; a longer list
costs false positives, not results. The join is an ordinary shuffled one unless Spark finds the list small.

Defined results: a null url, or one without "://", has an empty host and path and no rule; repeated rows each get
a row; equally long matching entries are decided by the smaller text; an empty table gives no rows, an empty list allows all. A url
of any length is judged whole. Only page_id and url are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, table

#: The rules of op5, as verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Least and largest number of 64-byte blocks: 64 KiB and 64 MiB. Beyond that (32 million keys) more keys cost false positives, not results.
BLOOM_BLOCKS, MAX_BLOCKS = 1 << 10, 1 << 20
_BITS = 8


def _places(hashes: np.ndarray, blocks: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and the k-th of its bits inside the block."""
    h = hashes.astype(np.uint64)
    block = (h >> np.uint64(32)) % np.uint64(blocks)
    g = mix(h)
    return block, (g >> np.uint64(7 * k)) & np.uint64(511)


def blocks_for(keys: int) -> int:
    """Blocks for a number of keys: sixteen bits a key, within the bounds."""
    return min(max(BLOOM_BLOCKS, 1 << (max(keys, 1) * 16 // 512).bit_length()), MAX_BLOCKS)


class BlockedBloom:
    def __init__(self, blocks: int = BLOOM_BLOCKS, data: bytes | None = None):
        self.blocks = blocks
        self.bits = np.zeros(blocks * 64, np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def add(self, hashes: np.ndarray) -> None:
        for k in range(_BITS):
            block, bits = _places(hashes, self.blocks, k)
            at = block * np.uint64(512) + bits
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """False only for keys that were not added. One bit is looked up for all keys, the others for those left."""
        left = np.arange(len(hashes))
        for k in range(_BITS):
            block, bits = _places(hashes[left], self.blocks, k)
            at = block * np.uint64(512) + bits
            left = left[(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out = np.zeros(len(hashes), bool)
        out[left] = True
        return out

    @staticmethod
    def of(keys: DataFrame, column: str, blocks: int | None = None) -> BlockedBloom:
        """Filter of a column of 64-bit hashes, by default sized by their number; each task sends one filter, merged in two tasks."""
        if blocks is None:
            blocks = blocks_for(keys.count())

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, some = BlockedBloom(blocks), False
            for b in batches:
                f.add(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                some = some or b.num_rows > 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([f.bits.tobytes()], pa.binary())], names=["bits"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = None
            for b in batches:
                for x in b.column(0):
                    one = np.frombuffer(x.as_py(), np.uint8)
                    bits = one.copy() if bits is None else bits | one
            if bits is not None:
                yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

        made = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull()).mapInArrow(build, "bits binary")
        merged = made.repartition(2).mapInArrow(merge, "bits binary")  # two filters come to the driver
        out = BlockedBloom(blocks)
        for row in merged.collect():
            out.bits |= np.frombuffer(row.bits, np.uint8)
        return out


def host_and_path(url) -> tuple:
    """Host, A-Z lower-cased, and path of a url column; both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, blocks: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page; rules has verdict, host, path."""
    spark = pages.sparkSession
    listed = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("entry", F.concat("host", "path"))
    listed = listed.withColumn("key", F.xxhash64("host", "path"))
    lengths = [r[0] for r in listed.select(F.length("path").alias("n")).distinct().collect()]  # path lengths: few whatever the list
    filled = BlockedBloom.of(listed, "key", blocks)
    blocks, bloom = filled.blocks, spark.sparkContext.broadcast(filled.bits.tobytes())

    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    own = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p"), F.xxhash64(h, p).alias("key")))))
    urls = urls.withColumn("own", own)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The candidates of each page that may be listed."""
        f = BlockedBloom(blocks, bloom.value)
        for b in batches:
            own = b.column("own")
            every = own.flatten()
            keep = f.may_hold(every.field("key").to_numpy(zero_copy_only=False).view(np.uint64)) if len(every) else np.zeros(0, bool)
            ends = np.append(0, np.cumsum(keep))[own.offsets.to_numpy() - own.offsets[0].as_py()]
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), every.filter(pa.array(keep)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path", "row")), hits], names=["page_id", "host", "path", "row", "own"])

    hits = urls.mapInArrow(passing, urls.schema).select("page_id", "host", "path", "row", F.explode_outer("own").alias("c"))
    # a page without candidates gets a key of its own, so that such pages do not meet in one task
    hits = hits.select("page_id", "host", "path", "row", F.coalesce("c.h", F.concat(F.lit("\x01"), F.col("row").cast("string"))).alias("h"), F.coalesce("c.p", F.lit("")).alias("p"))
    found = hits.join(listed.select(F.col("host").alias("h"), F.col("path").alias("p"), "entry", "verdict"), ["h", "p"], "left")
    best = found.groupBy("row", "page_id", "host", "path").agg(F.min(F.when(F.col("entry").isNotNull(), F.struct((-F.length("entry")).alias("n"), "entry", "verdict"))).alias("b"))
    return best.select("page_id", "host", "path", F.col("b.entry").alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path")))) for r in RULES])
    return judge(table(spark, sf_dir, "pages"), spark.range(0, 1, 1, 1).select(F.inline(rules)))


_URL = r"regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's')"
ORACLE = f"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract({_URL}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract({_URL}, '^[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
