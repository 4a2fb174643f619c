"""Set-similarity join of 5-word shingle sets by PartEnum signatures.

Sets are dealt into bands of size. If two sets of a and b shingles have a Jaccard similarity of 0.8 or more, they
differ in at most (a + b) / 9 elements; k is that bound for the largest sizes of a band. A hash deals the feature
domain into n1 first-level parts, so many that some part of a linked pair holds at most k2 of its differing
elements, and each of them into n2 = k2 + 2 second-level parts, two of which must then be equal. A signature is the hash of a
set's elements in one subset of two second-level parts, and all subsets are enumerated, so a linked pair shares one. A set gives the
signatures of its own band and, if a partner could be that large, of the next one. A part in which two second-level parts
are empty is no evidence: n1 holds some spare parts, and only a set with more such parts than that also gives its empty subsets.

Equal sets are one node throughout, so copies are never expanded. Before the shuffle a task keeps two sets of each of
its signatures as their representatives and sends the others on a way of their own (they are known to share it), so a
signature never brings more than two sets a chunk into one task. Signatures with the same sets are one group. The sets of a
group are compared with its best connected one; links give components. Where a group still holds several
components, its sets are dealt into blocks, and pairs of blocks are searched for sets that may be linked across components.
Parity sketches of a bit an element come first: the number of differing bits is a lower bound of the number of differing elements. What
they leave in question is compared exactly inside the task, and only links that join two components there are emitted, fewer than
there are sets. No cap is involved, and no link between components can be lost.

Defined results: null and empty texts have no shingles and link with nothing; fewer than five words make one
shingle; repeated ids or rows are copies of each other; rows with a null doc_id take part, and the smallest
non-null id names a component; an empty table gives no rows. Texts of any length are read whole. Only doc_id and text are
read, other columns may have any name. Shingles and sets are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHash, drop_stored, factors, least, mix, pack, pieces, release_shuffles, stored, table, trimmed, unpack, word_hashes
from .components import components
from .url_filter import BlockedBloom

WIDTH = 5
#: Signatures of a chunk, within which sets with a common one are brought together before the shuffle; of a bucket; and bits of
#: each that are kept, as a chance meeting costs a comparison, not a link.
CHUNK, BUCKET, SIG_BITS = 1 << 19, 1 << 20, 48
#: About how many bytes of text make a signature; it only sets the number of buckets. A chunk names its sets once in every bucket, so
#: more buckets than needed cost disk.
BYTES_PER_SIGNATURE = 16
#: Nodes whose sets a task remembers having sent, to send copies once.
SENT = 500_000
#: Sets, and their elements, in a block of a group; larger groups are cut into several.
GROUP = 2048
GROUP_ELEMENTS = 1 << 19
#: Node hashes, of eight bytes each, up to which a list of them is broadcast.
BROADCAST = 1 << 20
#: Sets that one set is compared with at a time.
AT_ONCE = 1024


def bands(upto: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each band, growing by one half."""
    out, low = [], 1
    while low <= upto:
        high = max(low, low * 3 // 2)
        out.append((low, high))
        low = high + 1
    return out


def parts_of(k: int) -> tuple[int, int, int]:
    """(n1, n2, spare first-level parts) for sets that differ in at most k elements."""
    if k <= 3:
        return 1, k + 2, 0
    spare = max(1, k // 16)
    return k // 2 + 1 + spare, 3, spare


_BANDS = bands(1 << 40)
_LOW = np.array([b[0] for b in _BANDS])
_PARTS = np.array([parts_of(2 * high // 9) for _, high in _BANDS])


def shingle_sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct shingle hashes of each text in turn, text of each) from word hashes and where texts begin and end."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    x = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64)
    for k, c in enumerate(factors(WIDTH)):
        x += h[k : k + len(x)] * c
    x = mix(x)
    for b, e in zip(bounds[:-1].tolist(), (bounds[1:] - WIDTH + 1).tolist()):
        if e > b:
            x[b:e].sort()
    inside = owner[: len(x)] == owner[WIDTH - 1 :][: len(x)]
    x, owner_x = x[inside], owner[: len(x)][inside]
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        whole = [mix((h[bounds[i] : bounds[i + 1]] * factors(WIDTH)[: n[i]]).sum(dtype=np.uint64, keepdims=True) + n[i].astype(np.uint64)) for i in short]
        x, owner_x = np.concatenate([x, *whole]), np.concatenate([owner_x, short])
        order = np.argsort(owner_x, kind="stable")
        x, owner_x = x[order], owner_x[order]
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (owner_x[1:] != owner_x[:-1])
    return x[first], owner_x[first]


def nodes_of(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; sets of size 0 get 0."""
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    begin = (np.cumsum(size) - size)[full]
    if len(begin):
        out[full] = mix(np.add.reduceat(mix(x + np.uint64(0x2545F4914F6CDD1D)), begin) + size[full].astype(np.uint64))
    return out


def _sums(values: np.ndarray, cell: np.ndarray, cells: int) -> np.ndarray:
    """64-bit sums of values by cell, from exact sums of their halves."""
    low = np.bincount(cell, weights=values & np.uint64(0xFFFFFFFF), minlength=cells).astype(np.uint64)
    return low + (np.bincount(cell, weights=values >> np.uint64(32), minlength=cells).astype(np.uint64) << np.uint64(32))


def signatures(x: np.ndarray, owner: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, owners) of sets in a band each: x are the sets' elements, owner the set of each element."""
    n1, n2, spare = _PARTS[band].T
    g = mix(x ^ np.uint64(0x5851F42D4C957F2D))
    cells = n1 * n2
    base = np.cumsum(cells) - cells
    part = (g >> np.uint64(32)) % n1[owner].astype(np.uint64)
    sub = (g & np.uint64(0xFFFFFF)) % n2[owner].astype(np.uint64)
    cell = base[owner] + part.astype(np.int64) * n2[owner] + sub.astype(np.int64)
    total = int(cells.sum())
    sums, count = _sums(mix(g), cell, total), np.bincount(cell, minlength=total)
    sigs, owners = [], []
    for m in np.unique(n2).tolist():
        mine = np.flatnonzero(n2 == m)
        rows = n1[mine]
        who = np.repeat(mine, rows)
        number = np.arange(len(who)) - np.repeat(np.cumsum(rows) - rows, rows)
        at = (base[who] + number * m)[:, None] + np.arange(m)
        s, filled = sums[at], count[at] > 0
        weak = np.bincount(who, weights=(~filled).sum(1) >= 2, minlength=len(n1)) > spare
        name = mix(number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (band[who].astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        for i, j in combinations(range(m), 2):
            tag = np.uint64((i * 64 + j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            keep = filled[:, i] | filled[:, j] | weak[who]
            sigs.append(mix(mix(s[keep, i] + tag) + s[keep, j] * np.uint64(0xE7037ED1A0B428DB) + name[keep]))
            owners.append(who[keep])
    return np.concatenate(sigs) if sigs else np.empty(0, np.uint64), np.concatenate(owners) if owners else np.empty(0, np.int64)


def all_signatures(x: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sets) of non-empty sets, numbered from 0, in each band in which they can meet a linked one."""
    band = np.searchsorted(_LOW, size, side="right") - 1
    own = signatures(x, owner, band)
    up = np.flatnonzero(size * 5 // 4 >= _LOW[band + 1])
    number = np.full(len(size), -1)
    number[up] = np.arange(len(up))
    mine = number[owner] >= 0
    above = signatures(x[mine], number[owner[mine]], band[up] + 1)
    return np.concatenate([own[0], above[0]]), np.concatenate([own[1], up[above[1]]])


def sketches(x: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity of the elements that fall on each bit, a bit an element at least; sketches of two lengths compare after folding."""
    bits = 1 << np.ceil(np.log2(np.maximum(size, 128))).astype(np.int64)
    base = np.cumsum(bits) - bits
    at = mix(x + np.uint64(0x1D8E4E27C47D124F)) & np.repeat(bits - 1, size).astype(np.uint64)
    odd = np.bincount(np.repeat(base, size) + at.astype(np.int64), minlength=int(bits.sum())) & 1
    raw = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return [raw[b : b + n] for b, n in zip((base // 8).tolist(), (bits // 8).tolist())]


def folded(raw: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, all of the shortest one's length in bytes."""
    out = np.empty((len(raw), width // 8), np.uint64)
    for i, r in enumerate(raw):
        w = np.frombuffer(r, np.uint64)
        out[i] = w if len(r) == width else np.bitwise_xor.reduce(w.reshape(-1, width // 8), axis=0)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


PACKED = "bucket long, blob binary"


def _packed(bucket: int, sig: np.ndarray, node: np.ndarray) -> tuple[int, bytes]:
    """A row of ascending signatures and their sets."""
    nodes, at = np.unique(node, return_inverse=True)
    return bucket, pack(sig[:1], least(np.diff(sig)), nodes, least(at))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, steps, nodes, at = unpack(blob)
    return np.cumsum(np.concatenate([first, steps.astype(np.uint64)])), nodes[at.astype(np.int64)]


def _rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    cols = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[c[1]]) for i, c in enumerate(cols)], names=[c[0] for c in cols])


def shared_signatures(docs: DataFrame) -> DataFrame:
    """(sig, node): the signatures that at least two different sets have; a row may occur twice.

    A chunk's signatures travel in packed rows, one for each bucket of signatures that it meets: never more rows than signatures,
    and few while buckets are few. Buckets are as many as hold BUCKET signatures each.
    """
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (BUCKET * BYTES_PER_SIGNATURE)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wh, sent, sigs, nodes, held = WordHash(), set(), [], [], 0

        def close() -> pa.RecordBatch:
            sig, node = np.concatenate(sigs) >> np.uint64(64 - SIG_BITS), np.concatenate(nodes)
            order = np.argsort(sig)
            sig, node = sig[order], node[order]
            third = np.zeros(len(sig), bool)  # a set beyond the first two with a signature
            third[2:] = sig[2:] == sig[:-2]
            rows = []
            if third.any():
                rows.append(_packed(-1 - int(node[third][0] >> np.uint64(33)), sig[third], node[third]))
            sig, node = sig[~third], node[~third]
            bucket = ((sig >> np.uint64(SIG_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            for part in np.split(np.arange(len(sig)), np.flatnonzero(np.diff(bucket)) + 1):
                rows.append(_packed(int(bucket[part[0]]), sig[part], node[part]))
            sigs.clear()
            nodes.clear()
            sent.clear()  # within a chunk every set is sent once
            return _rows_of(PACKED, rows)

        for b in pieces(batches):
            x, owner = shingle_sets(*word_hashes(b.column("text"), wh))
            size = np.bincount(owner, minlength=b.num_rows)
            node = nodes_of(x, size)
            fresh = np.zeros(b.num_rows, bool)
            for i in np.flatnonzero(size).tolist():
                me = int(node[i])
                if me not in sent:
                    sent.add(me)
                    fresh[i] = True
            if fresh.any():
                number = np.cumsum(fresh) - 1
                mine = fresh[owner]
                sig, who = all_signatures(x[mine], number[owner[mine]], size[fresh])
                sigs.append(sig)
                nodes.append(node[fresh][who])
                held += len(sig)
                if held >= CHUNK:
                    yield close()
                    held = 0
        if held:
            yield close()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in _by_key(batches, 1):
            parts = [_unpacked(r[0]) for r in rows]
            sig, node = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if bucket >= 0:
                order = np.argsort(sig)
                sig, node = sig[order], node[order]
                alike = np.zeros(len(sig), bool)
                alike[1:] = sig[1:] == sig[:-1]
                alike[:-1] |= alike[1:]
                sig, node = sig[alike], node[alike]
                first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.empty(0, np.int64)
                if len(first):
                    several = np.minimum.reduceat(node, first) < np.maximum.reduceat(node, first)
                    keep = np.repeat(several, np.diff(np.append(first, len(sig))))
                    sig, node = sig[keep], node[keep]
            for at in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + (1 << 16)].view(np.int64)) for a in (sig, node)], names=["sig", "node"])

    rows = texts.mapInArrow(trimmed(emit), PACKED).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(trimmed(meet), "sig long, node long")


def _sets(batches: Iterator[pa.RecordBatch], f: BlockedBloom) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, sizes of their sets, nodes, whether a node is in the filter and new to the task, elements of those that are)."""
    wh, sent = WordHash(), set()
    for b in pieces(batches):
        x, owner = shingle_sets(*word_hashes(b.column("text"), wh))
        size = np.bincount(owner, minlength=b.num_rows)
        node = nodes_of(x, size)
        want = (size > 0) & f.may_hold(node)
        for i in np.flatnonzero(want).tolist():
            if int(node[i]) in sent:
                want[i] = False
            elif len(sent) < SENT:
                sent.add(int(node[i]))
        yield b, size, node, want, x[want[owner]]


def set_table(docs: DataFrame, bloom: BlockedBloom) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, sketch) of all documents; the last only for nodes in the filter, once a task."""
    data, blocks = docs.sparkSession.sparkContext.broadcast(bloom.bits.tobytes()), bloom.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, size, node, want, x in _sets(batches, BlockedBloom(blocks, data.value)):
            sk = np.full(b.num_rows, None, object)
            sk[want] = sketches(x, size[want])
            cols = [b.column("doc_id"), b.column("text_key"), pa.array(size, pa.int64()), pa.array(node.view(np.int64), mask=size == 0), pa.array(sk, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "n_shingles", "node", "sketch"])

    return _texts(docs).mapInArrow(trimmed(run), "doc_id long, text_key long, n_shingles long, node long, sketch binary")


def member_table(docs: DataFrame, bloom: BlockedBloom) -> DataFrame:
    """(node, members) of the nodes in the filter, once a task, made from the texts again.

    Few sets are ever compared exactly; to store those of all documents would take more disk than the documents.
    """
    data, blocks = docs.sparkSession.sparkContext.broadcast(bloom.bits.tobytes()), bloom.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, size, node, want, x in _sets(batches, BlockedBloom(blocks, data.value)):
            members = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[want])), pa.int32()), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node[want].view(np.int64)), members], names=["node", "members"])

    return _texts(docs).mapInArrow(trimmed(run), "node long, members array<bigint>")


def likely(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """The pairs (a, b) that by their sketches may have a similarity of 0.8 or more; light has node, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            bound = (b.column("n").to_numpy() + b.column("m").to_numpy()).tolist()
            for i, (s, t) in enumerate(zip(b.column("s").to_pylist(), b.column("t").to_pylist())):
                x, y = folded([s, t], min(len(s), len(t)))
                keep[i] = 9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= bound[i]
            yield b.select(["a", "b"]).filter(pa.array(keep))

    x = pairs.join(light.select(F.col("node").alias("a"), "n", F.col("sketch").alias("s")), "a")
    x = x.join(light.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t")), "b")
    x = x.where("5 * n >= 4 * m AND 5 * m >= 4 * n")
    return x.select("a", "b", "n", "m", "s", "t").mapInArrow(trimmed(run), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is 0.8 or more; sets has node, members."""
    x = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    x = x.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    x = x.withColumn("i", F.size(F.array_intersect("x", "y")))
    return x.where(100 * F.col("i") >= 80 * (F.size("x") + F.size("y") - F.col("i"))).select("a", "b")


def _across(side: np.ndarray, label: np.ndarray, size: np.ndarray, sk: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places) of sets that may by their sketches be linked though their labels differ, read when asked for.

    With two sides only pairs across them are looked at; label may change between steps.
    """
    rows = np.flatnonzero(side == side[0])
    cols = np.flatnonzero(side != side[0])
    for at, x in enumerate(rows.tolist()):
        others = cols if len(cols) else rows[at + 1 :]
        others = others[(label[others] != label[x]) & (5 * size[others] >= 4 * size[x]) & (5 * size[x] >= 4 * size[others])]
        for j in range(0, len(others), AT_ONCE):
            ys = others[j : j + AT_ONCE]
            apart = np.bitwise_count(sk[ys] ^ sk[x]).sum(1, dtype=np.int64)
            ys = ys[9 * apart <= size[ys] + size[x]]
            if len(ys):
                yield x, ys


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows without it) of rows sorted by their first columns."""
    held, at = [], None
    for b in pieces(batches):
        for row in zip(*(list(c) if pa.types.is_list(c.type) else c.to_pylist() for c in b.columns)):  # lists stay in Arrow
            if row[:keys] != at:
                if held:
                    yield at, held
                held, at = [], row[:keys]
            held.append(row[keys:])
    if held:
        yield at, held


def in_question(rows: DataFrame) -> DataFrame:
    """(group, side, label, node) from (sig, node, label, blocks, n, sketch): sets to compare exactly.

    The sets of a signature are dealt into its number of blocks, and each pair of blocks is one key of the shuffle, so a
    task holds two blocks at a time. Signatures that leave the same sets in question give one group.
    """
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("h", mine).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("h", "k").alias("i"), F.greatest("h", "k").alias("j"), "h", "label", "node", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in _by_key(batches, 3):
            held.sort(key=lambda r: r[2])
            side, label, node, size = (np.array([r[k] for r in held], np.int64) for k in range(4))
            if len(held) < 2 or (i != j and (side == side[0]).all()):
                continue
            hit = np.zeros(len(held), bool)
            for x, ys in _across(side, label, size, folded([r[4] for r in held], min(len(r[4]) for r in held))):
                hit[x] = hit[ys] = True
            if hit.any():
                group = int(np.bitwise_xor.reduce(mix(node[hit].view(np.uint64) * np.uint64(2) + (side[hit] != side[0]).astype(np.uint64))).view(np.int64))
                n = int(hit.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group)), pa.array((side[hit] != side[0]).astype(np.int64)), pa.array(label[hit]), pa.array(node[hit])], names=["group", "side", "label", "node"])

    dealt = dealt.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(trimmed(run), "group long, side long, label long, node long").distinct()


def joining_links(rows: DataFrame) -> DataFrame:
    """(a, b) from (group, side, label, node, n, sketch, members): linked sets, fewer than the sets of each group.

    Found exactly inside a group's task; what an earlier link has joined there is not compared again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_key(batches, 1):
            side, label, node, size = (np.array([r[k] for r in held], np.int64) for k in range(4))
            sk = folded([r[4] for r in held], min(len(r[4]) for r in held))
            sets = [np.sort(r[5].values.to_numpy()) for r in held]
            out = []
            for x, ys in _across(side, label, size, sk):
                for y in ys.tolist():
                    if label[x] != label[y]:
                        i = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if 100 * i >= 80 * (int(size[x]) + int(size[y]) - i):
                            out.append((int(node[x]), int(node[y])))
                            label[label == label[y]] = label[x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], names=["a", "b"])

    rows = rows.select("group", "side", "label", "node", "n", "sketch", "members")
    return rows.repartition("group").sortWithinPartitions("group", "side", "node").mapInArrow(trimmed(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return groups_of(docs).select("doc_id", "n_shingles", "component_id")


def groups_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, component_id and label of every row; rows are linked if their labels are equal.

    The label tells components apart where rows of one id have different texts; without shingles it is null.
    """
    spark = docs.sparkSession
    shared = stored(spark, shared_signatures(docs), "signatures")
    release_shuffles(spark)
    # signatures with the same sets are one group, whose best connected set is the one that shares most signatures
    graded = stored(spark, shared.distinct().withColumn("degree", F.count("*").over(W.partitionBy("node"))), "graded")
    group = graded.groupBy("sig").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.max(F.struct("degree", "node")).alias("best"))
    group = group.groupBy("n", "h").agg(F.min(F.struct("sig", "best")).alias("g")).select("g.sig", F.col("g.best.node").alias("best"), "n")
    grouped = stored(spark, graded.join(group, "sig").select("sig", "node", "best", F.col("n").alias("in_group")), "groups")
    drop_stored(spark, shared, graded)
    release_shuffles(spark)
    nodes = grouped.select("node").distinct()
    all_docs = stored(spark, set_table(docs, BlockedBloom.of(nodes, "node")), "sets")
    light = all_docs.where("sketch IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    light = stored(spark, light, "sketches")

    def members(of: DataFrame) -> DataFrame:
        of = stored(spark, of, "wanted")
        few = F.broadcast(of) if of.count() <= BROADCAST else of  # beyond, sets are shuffled to their nodes
        mine = member_table(docs, BlockedBloom.of(of, "node")).join(few, "node", "left_semi")
        out = stored(spark, mine.dropDuplicates(["node"]), "members")
        drop_stored(spark, of)
        return out

    star = grouped.where("node <> best").select(F.least("node", "best").alias("a"), F.greatest("node", "best").alias("b")).distinct()
    maybe = stored(spark, likely(star, light), "likely")
    release_shuffles(spark)
    found = members(maybe.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = stored(spark, verified(maybe, found), "links")
    drop_stored(spark, maybe, found)
    release_shuffles(spark)
    label = components(links)
    # the best connected set of each group has been compared with all others; left are pairs among the others
    named = grouped.where("in_group > 2").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    named = stored(spark, named.join(split, "sig").select("sig", "node", "label").join(light.select("node", "n"), "node"), "named")
    drop_stored(spark, grouped)
    release_shuffles(spark)
    split = named.groupBy("sig").agg(F.count("*").alias("sets"), F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("sets") / GROUP), F.ceil(F.col("elements") / GROUP_ELEMENTS))
    split = split.select("sig", blocks.cast("int").alias("blocks"))
    wide = named.join(split, "sig").join(light.select("node", "sketch"), "node")
    open_ = stored(spark, in_question(wide.select("sig", "node", "label", "blocks", "n", "sketch")), "open")
    drop_stored(spark, named)
    release_shuffles(spark)
    found = members(open_.select("node").distinct())
    rest = joining_links(open_.join(light, "node").join(found, "node"))
    rest = stored(spark, rest, "links")
    drop_stored(spark, open_, light, found)
    release_shuffles(spark)
    # components of components: what the second step joins, in terms of the first one's labels
    both = rest.join(label.select(F.col("node").alias("a"), F.col("label").alias("x")), "a", "left").join(label.select(F.col("node").alias("b"), F.col("label").alias("y")), "b", "left")
    more = components(both.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("final"))
    ends = label.unionByName(rest.select(F.explode(F.array("a", "b")).alias("node")).join(label, "node", "left_anti").distinct().withColumn("label", F.col("node")))
    ends = stored(spark, ends.join(more, "label", "left").select("node", F.coalesce("final", "label").alias("label")), "components")
    return with_components(all_docs.select("doc_id", "text_key", "n_shingles", "node"), ends)


def with_components(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Documents with the smallest doc_id of their component, given the component labels of the nodes that have links."""
    one = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    one = one.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_ = one.groupBy("label").agg(F.min("least").alias("component_id"))
    one = one.join(least_, "label").select("node", "component_id", "label")
    named = nodes.join(one, "node", "left")
    return named.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")


def op3_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
