"""LM scoring with an Elias-Fano n-gram trie (order 3), built and queried in shards.

Model: P(w | u v) = a3 + g3 * (a2 + g2 * p1(w)) with a3 = l3 * c(u v w) / c(u v), g3 = 1 - l3, the same for order 2, and the add-0.1 unigram model
of the base score at the bottom. The weights l2 and l3 depend on how often the context occurred (half octaves of its count)
and are fitted by deleted estimation: every training event is taken out of the counts in turn, and the weights that
predict all of them best are found by expectation maximisation over a histogram of likelihood ratios, whose size is fixed.
Where a context says nothing about what follows, its weight goes to 0 and the score to the base score. All counts are over all
training documents, and the same model results however the trie is cut into shards.

A shard's trie is a file of levels: word ids; contexts v; below them followers w (bigrams) and predecessors u; below (v, u) the
followers again. Every level is a monotone sequence in Elias-Fano form: ids are made monotone by adding the base of
their parent's range, pointers are monotone already. A follower below (v, u) is stored as its rank among the followers of v,
which is all that it can be, and looked up by successor search in the parent's range. The terms a and g are 16-bit codes of
their logarithms. Readers map the file into memory (in scratch space of the task). Few look-ups work on the packed bits; where
they are about as many as a sequence's elements, it is decoded in one go and they are searched in what was decoded.

Flow: documents are tokenised once into chunks with a vocabulary of their own (stored). Chunks send their distinct words and bigrams
in packed rows, one a bucket that they meet, and get back total counts, and for a word its rank among those of its count,
from which its global id follows; ids show their words' counts. Then every chunk sends its distinct trigrams, with
training counts, to the shards of their contexts. A shard is chosen by the middle word v, for a frequent v by u too, and for a
frequent (u, v) by w too, so that none is larger than the others; totals travel with the trigrams. Blocks of trigrams are stored
and meet in their shards twice, for the fit of l3 and for the look-ups, one for each distinct trigram of a shard; these return a code for each trigram of a block, and a chunk sums them
by document. What is shuffled beside stored tables is a quarter of the chunks, or of the shards, at a time.

Defined results: a null or empty text is one end token; rows with a null doc_id train and are scored, held_out
false; repeated rows each get a row; with no training tokens every probability is the base one (V = N = 0); an empty table gives
no rows. A text of any length is part of one chunk. Words are identified by 64-bit hashes, bigrams by 56-bit ones. Only doc_id and text are
read, other columns may have any name.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, changes, crc_mod, drop_stored, least, mix, numbered, order_of, pack, pieces, release_shuffles, stored, table, trimmed, unpack, word_hashes

#: Tokens in a chunk, tokens in a shard, words or bigrams in a bucket.
CHUNK_TOKENS = 750_000
SHARD_TOKENS = 1_500_000
BUCKET = 1_000_000
BOS, END = np.uint64(1), np.uint64(2)
#: Ids of words that training lacks, of the begin and the end of a text; other words' ids follow.
UNKNOWN, BEGIN, STOP, FIRST_ID = 0, 1, 2, 3
#: Parts that the shuffles of trigrams are cut into.
ROUNDS = 4
#: Counts up to EXACT are classes of their own; beyond, classes are 1/STEP of a decade.
EXACT = 4096
#: Half octaves of context counts; bins of the likelihood ratio: none, then FINE to an octave round 1.
HALVES, BINS, FINE = 80, 4096, 64
STEP = 4096.0  # codes a decade
#: A sequence with fewer elements than DENSE to a look-up is decoded; ids below TABLE are numbered by a table.
DENSE, TABLE = 8, 1 << 22


class Bits:
    """Packed integers of a fixed width."""

    @staticmethod
    def pack(x: np.ndarray, width: int) -> np.ndarray:
        n = (len(x) * width + 63) // 64 + 1
        out = np.zeros(n, np.uint64)
        if width and len(x):
            at = np.arange(len(x), dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            low = x << shift
            np.bitwise_or.at(out, word, low)
            over = shift + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(out, word[over] + 1, x[over] >> (np.uint64(64) - shift[over]))
        return out

    @staticmethod
    def get(data: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
        if not width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = data[word] >> shift
        x |= np.where(shift == 0, np.uint64(0), data[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
        return x & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence: low bits packed, high parts in unary, with counts for select."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(high) + 1, dtype=np.int64) * 64 - self.ones

    @staticmethod
    def encode(x: np.ndarray) -> list[np.ndarray]:
        """Arrays of a sequence: a header and the two parts."""
        n = len(x)
        top = int(x[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (x >> np.uint64(width)).astype(np.int64) + np.arange(n)
        size = (int(high[-1]) if n else 0) + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[high] = 1
        packed = np.packbits(bits, bitorder="little").view(np.uint64)
        low = Bits.pack(x & np.uint64((1 << width) - 1), width)
        return [np.array([n, width], np.uint64), low, packed]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the k-th ones or zeros, from 0."""
        before = self.ones if one else self.zeros
        w = np.searchsorted(before, k, side="right") - 1
        left = k - before[w]
        word = self.high[w] if one else ~self.high[w]
        pos = np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= c
            left -= np.where(up, c, 0)
            step = np.where(up, half, 0)
            pos += step
            word = word >> step.astype(np.uint64)
        return w * 64 + pos

    def at(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | Bits.get(self.low, i, self.width)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.n)
        return ((ones - at).astype(np.uint64) << np.uint64(self.width)) | Bits.get(self.low, at, self.width)

    def take(self, i: np.ndarray) -> np.ndarray:
        """at(), for few or many."""
        return self.all()[i] if len(i) * DENSE >= self.n else self.at(i)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Index of each value, -1 where it is not an element."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.full(len(x), -1, np.int64)
        if len(x) * DENSE >= self.n:
            every = self.all()
            i = np.searchsorted(every, x)
            return np.where(every[np.minimum(i, self.n - 1)] == x, i, -1)
        i = self.successor(x)
        hit = i < self.n
        hit[hit] = self.at(i[hit]) == x[hit]
        return np.where(hit, i, -1)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element that is not below x; n if there is none."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        high = np.minimum(x >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64)
        total = int(self.zeros[-1])
        beyond = high >= total
        h = np.where(beyond, 0, high)
        # elements with a smaller high part stand before the h-th zero; those with the same one before the next
        i = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - h + 1, 0)
        end = np.minimum(self._select(h, False) - h, self.n)
        low = x & np.uint64((1 << self.width) - 1)
        # among the elements with the same high part, ascending in their low bits: binary search
        live = np.flatnonzero((i < end) & ~beyond)
        while len(live):
            mid = (i[live] + end[live]) >> 1
            less = Bits.get(self.low, mid, self.width) < low[live]
            i[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]
            live = live[i[live] < end[live]]
        return np.where(beyond, self.n, i)


class Level:
    """Children of numbered parents: pointers, and ids made monotone by the parent's base."""

    def __init__(self, starts: EliasFano, ids: EliasFano, span: int):
        self.starts, self.ids, self.span = starts, ids, span

    @staticmethod
    def encode(parent: np.ndarray, parents: int, child: np.ndarray, span: int) -> list[np.ndarray]:
        starts = np.searchsorted(parent, np.arange(parents + 1)).astype(np.uint64)
        return [*EliasFano.encode(starts), *EliasFano.encode(parent.astype(np.uint64) * np.uint64(span) + child.astype(np.uint64)), np.array([span], np.uint64)]

    def find(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Index of each child below its parent by successor search, -1 where there is none."""
        ok = np.flatnonzero((parent >= 0) & (child >= 0))
        out = np.full(len(parent), -1, np.int64)
        out[ok] = self.ids.places(parent[ok].astype(np.uint64) * np.uint64(self.span) + child[ok].astype(np.uint64))
        return out


class Numbers:
    """Places of ids in ascending distinct ones. Most ids that occur are small, and these are read from a table."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.int64)
        small = np.searchsorted(self.values, TABLE)
        self.table = np.full(int(self.values[small - 1]) + 1 if small else 0, -1, np.int32)
        self.table[self.values[:small]] = np.arange(small)

    @staticmethod
    def among(*ids: np.ndarray) -> Numbers:
        """The distinct ones of arrays of ids."""
        seen, large = np.zeros(TABLE, bool), []
        for x in ids:
            low = x < TABLE
            if low.all():
                seen[x] = True
            else:
                seen[x[low]] = True
                large.append(np.sort(x[~low]))
        high = np.sort(np.concatenate(large)) if large else np.empty(0, np.int64)
        return Numbers(np.concatenate([np.flatnonzero(seen), high[changes(high)]]))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Place of each id, -1 where it is none of the values."""
        if not len(x):
            return np.empty(0, np.int64)
        if x.max() < len(self.table):
            return self.table[x].astype(np.int64)
        low = x < len(self.table)
        out = np.full(len(x), -1, np.int64)
        out[low] = self.table[x[low]]
        high = x[~low].astype(np.int64)
        if len(self.values):
            i = np.minimum(np.searchsorted(self.values, high), len(self.values) - 1)
            out[~low] = np.where(self.values[i] == high, i, -1)
        return out


def _codes(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-16)) * STEP), 0, 65535).astype(np.uint16)


#: What each code stands for.
_VALUES = 10.0 ** (-np.arange(65536) / STEP)


def count_class(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, np.float64)
    return np.where(c <= EXACT, c, EXACT + np.rint(np.log10(np.maximum(c, EXACT) / EXACT) * STEP)).astype(np.int64)


def class_count(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.float64)
    return np.where(k <= EXACT, k, EXACT * 10.0 ** (np.maximum(k - EXACT, 0) / STEP))


def half_octave(total: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(2 * np.log2(np.maximum(total, 1)) + 1e-9), 0, HALVES - 1).astype(np.int64)


def ratio_cells(total: np.ndarray, high: np.ndarray, low: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Histogram (HALVES * BINS) of events by the half octave of their context's count and the ratio of two likelihoods."""
    r = high / low
    at = np.where(r > 0, np.clip(np.rint(FINE * np.log2(np.maximum(r, 1e-12))) + BINS // 2, 1, BINS - 1), 0).astype(np.int64)
    return np.bincount(half_octave(total) * BINS + at, weights=weight, minlength=HALVES * BINS)


def fitted_weights(cells: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weight of the higher order for each half octave; those without events take that of the next lower one."""
    r = 2.0 ** ((np.arange(BINS) - BINS // 2) / FINE)
    r[0] = 0.0
    n = cells.reshape(HALVES, BINS)
    total = n.sum(1)
    w = np.full(HALVES, 0.5)
    for _ in range(rounds):
        share = w[:, None] * r / (w[:, None] * r + 1 - w[:, None])
        w = np.minimum((n * share).sum(1) / (total + 1), 0.999)
    out, last = np.zeros(HALVES), 0.0
    for k in range(HALVES):
        last = w[k] if total[k] else last
        out[k] = last
    return out


class Words:
    """Global word ids, the more frequent the smaller, and the counts that they show.

    widths is how many words of a count class a bucket has at most; base holds the first id of each class.
    """

    def __init__(self, classes: np.ndarray, widths: np.ndarray, buckets: int, words: int, tokens: int, docs: int):
        order = np.argsort(-classes)
        self.classes, sizes = classes[order], widths[order].astype(np.int64) * buckets
        self.base = FIRST_ID + np.cumsum(sizes) - sizes
        self.shown = class_count(self.classes)
        self.buckets, self.words, self.tokens, self.docs = buckets, words, tokens, docs

    def ids(self, c: np.ndarray, rank: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.full(len(c), UNKNOWN, np.int64)
        seen = c > 0
        at = np.searchsorted(-self.classes, -count_class(c[seen]))
        out[seen] = self.base[at] + rank[seen].astype(np.int64) * self.buckets + bucket[seen]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        ids = np.asarray(ids, np.int64)
        out = np.where(ids == UNKNOWN, 0.0, float(self.docs))
        word = ids >= FIRST_ID
        if word.any():
            out[word] = self.shown[np.searchsorted(self.base, ids[word], side="right") - 1]
        return out

    def p1(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.tokens + 0.1 * (self.words + 1))

    def p1_without(self, c: np.ndarray) -> np.ndarray:
        """p1 when one of a word's own occurrences is taken out."""
        return (c - 1 + 0.1) / (self.tokens - 1 + 0.1 * (self.words + 1))


class Trie:
    """The levels of a shard, read from the bytes of its file."""

    @staticmethod
    def build(v: np.ndarray, u: np.ndarray, w: np.ndarray, c3: np.ndarray, c2: np.ndarray, t3: np.ndarray, words: Words, l2: np.ndarray, l3: np.ndarray) -> bytes:
        """File of a shard from distinct trigrams (v, u, w), given as ids and sorted, with the counts of the trigram, of (v, w) and of (u, v)."""
        numbers = Numbers.among(v, u, w)
        vocab = numbers.values
        k = max(len(vocab), 1)
        v, u, w = (numbers.of(x) for x in (v, u, w))
        t2 = words.counts(vocab) if len(vocab) else np.empty(0)
        t2 = np.where(vocab == STOP, 0, t2)  # nothing follows an end
        ctx = v[changes(v)]
        ctx = ctx[t2[ctx] > 0]
        key2, order = v * k + w, order_of(v * k + w)
        new = changes(key2[order])
        number2 = np.empty(len(v), np.int64)  # of the bigram of each trigram
        number2[order] = np.cumsum(new) - 1
        at2 = order[new]
        known2 = (c2[at2] > 0) & (t2[v[at2]] > 0)
        place2 = np.cumsum(known2) - 1
        at2 = at2[known2]
        key2, n2 = key2[at2], c2[at2]
        p2, w2 = np.searchsorted(ctx, v[at2]), w[at2]
        starts = np.searchsorted(p2, np.arange(len(ctx) + 1))
        new = changes(v, u)
        number3, first = np.cumsum(new) - 1, np.flatnonzero(new)
        known3 = t3[first] > 0
        place3 = np.cumsum(known3) - 1
        first = first[known3]
        pairs, t_pair = v[first] * k + u[first], t3[first].astype(np.float64)
        pv = np.searchsorted(ctx, v[first])
        seen = c3 > 0
        p3 = place3[number3[seen]]
        rank = place2[number2[seen]] - starts[pv[p3]]
        fan = int(np.diff(starts).max()) if len(ctx) else 1
        w2t = l2[half_octave(t2[ctx])]
        a2 = w2t[p2] * n2 / t2[ctx][p2]
        w3t = l3[half_octave(t_pair)]
        a3 = w3t[p3] * c3[seen] / t_pair[p3]
        parts = [
            *EliasFano.encode(vocab.astype(np.uint64)), *EliasFano.encode(ctx.astype(np.uint64)),
            *Level.encode(p2, len(ctx), w2, k), *Level.encode(pv, len(ctx), pairs % k, k), *Level.encode(p3, len(pairs), rank, max(fan, 1)),
            _codes(a2), _codes(1 - w2t), _codes(a3), _codes(1 - w3t),
        ]
        head = np.array([len(parts), *(x for p in parts for x in (p.dtype.itemsize, len(p)))], np.uint64)
        return head.tobytes() + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view(np.uint64)[0])
        sizes = raw[8 : 8 + 16 * n].view(np.uint64).reshape(n, 2)
        at, parts = 8 + 16 * n, []
        for size, count in sizes.tolist():
            parts.append(raw[at : at + size * count].view({2: np.uint16, 8: np.uint64}[size]))
            at += size * count + (-size * count) % 8
        take = iter(parts)

        def sequence() -> EliasFano:
            h, low, high = next(take), next(take), next(take)
            return EliasFano(int(h[0]), int(h[1]), low, high)

        def level() -> Level:
            return Level(sequence(), sequence(), int(next(take)[0]))

        self.words, self.contexts = sequence(), sequence()
        self.followers, self.predecessors, self.trigrams = level(), level(), level()
        self.a2, self.g2, self.a3, self.g3 = take

    def _index(self, *ids: np.ndarray) -> Iterator[np.ndarray]:
        """Index of each word id, -1 where it is not."""
        if sum(map(len, ids)) * DENSE >= self.words.n:
            numbers = Numbers(self.words.all())
            yield from (numbers.of(x) for x in ids)
        else:
            yield from (self.words.places(x) for x in ids)

    def probability(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """P(w | u v) for trigrams of ids, sorted by v and u, whose unigram probabilities are p1."""
        if not len(v):
            return np.empty(0)
        new = changes(v, u)
        run = np.cumsum(new) - 1
        v, u, w = self._index(v[new], u[new], w)
        c = np.full(len(v), -1, np.int64)
        c[v >= 0] = self.contexts.places(v[v >= 0])
        below = self.predecessors.find(c, u)
        begin = self.followers.starts.take(np.maximum(c, 0)).astype(np.int64) if self.contexts.n else np.zeros(len(c), np.int64)
        c, below, begin = c[run], below[run], begin[run]
        follow = self.followers.find(c, w)
        tri = self.trigrams.find(below, np.where(follow >= 0, follow - begin, -1))

        def pick(code: np.ndarray, i: np.ndarray, other: float) -> np.ndarray:
            out = np.full(len(i), other)
            out[i >= 0] = _VALUES[code[i[i >= 0]]]
            return out

        low = pick(self.a2, follow, 0.0) + pick(self.g2, c, 1.0) * p1
        return pick(self.a3, tri, 0.0) + pick(self.g3, below, 1.0) * low


def _by_frequency(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, the most frequent first so that their numbers pack well, and the number of each element."""
    vocab, at = numbered(h)
    c = np.bincount(at, minlength=len(vocab))
    order = order_of(c.max() - c) if len(c) else c
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return vocab[order], rank[at]


def _rows(schema: str, batches: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in batches], t) for i, t in enumerate(types)], names=names)


CHUNKS = "chunk long, n_tokens long, n_words long, n_train long, blob binary"


def tokenised(docs: DataFrame, held_out) -> DataFrame:
    """Chunks of documents: ids, held-out flags, lengths, vocabulary (hashes, the most frequent first) and tokens as indices into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wh = WordHash()
        ids: list = []
        held: list = []
        lens: list[np.ndarray] = []
        toks: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            vocab, at = _by_frequency(np.concatenate(toks))
            none = np.array([x is None for x in ids])
            blob = pack(np.array([x or 0 for x in ids], np.int64), none, np.array(held, bool), np.concatenate(lens).astype(np.uint32), vocab, least(at))
            chunk = int.from_bytes(os.urandom(7), "little")
            row = (chunk, size + len(ids), len(vocab), len(ids) - sum(held), blob)
            for x in (ids, held, lens, toks):
                x.clear()
            return _rows(CHUNKS, [row])

        for b in pieces(batches):
            a, bounds = word_hashes(b.column("text"), wh)
            ids += b.column("doc_id").to_pylist()
            held += b.column("held_out").to_pylist()
            lens.append(np.diff(bounds))
            toks.append(np.where(a <= END, a + np.uint64(3), a))  # the two reserved hashes stay free
            size += len(a)
            if size >= CHUNK_TOKENS:
                yield close()
                size = 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out")).mapInArrow(trimmed(run), CHUNKS)


class Chunk:
    """A chunk's documents as sequences of tokens with their bigrams, numbered in an order that does not change."""

    def __init__(self, blob: bytes):
        self.ids, self.none, self.held, lens, vocab, at = unpack(blob)
        self.lens = lens.astype(np.int64)
        n, self.n_words = len(self.lens), len(vocab)
        bos, end = len(vocab), len(vocab) + 1
        hashes = np.concatenate([vocab, [BOS, END]]).astype(np.uint64)
        stop = np.cumsum(self.lens + 1) - 1  # places of the end tokens
        self.seq = np.full(len(at) + n, end, np.int64)
        is_word = np.ones(len(self.seq), bool)
        is_word[stop] = False
        self.seq[is_word] = at
        self.doc = np.repeat(np.arange(n), self.lens + 1)
        self.begin = stop - self.lens
        self.prev = np.append(bos, self.seq)[:-1]
        self.prev[self.begin] = bos
        self.train = ~self.held[self.doc] if n else np.empty(0, bool)
        mixed = mix(vocab)
        self.word_order = np.argsort(mixed, kind="stable")
        self.word_keys = mixed[self.word_order]
        pair, at2 = numbered(self.prev * (len(vocab) + 2) + self.seq)
        keys = mix(mix(hashes[pair // (len(vocab) + 2)]) * np.uint64(0x9E3779B97F4A7C15) + hashes[pair % (len(vocab) + 2)]) >> np.uint64(8)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, place = keys[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pair_of = place[at2]
        self.bos, self.end = bos, end

    def word_counts(self) -> np.ndarray:
        """Training count of each word, in the order of word_keys."""
        t = self.seq[self.train]
        return np.bincount(t[t < self.n_words], minlength=self.n_words)[self.word_order]

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair_of[self.train], minlength=len(self.pair_keys))


TOTALS = "chunk long, key long, words long, tokens long, blob binary"


def _cut(keys: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bucket of each ascending key, runs of places with the same bucket)."""
    bucket = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return bucket, np.split(np.arange(len(keys)), np.flatnonzero(np.diff(bucket)) + 1) if len(keys) else []


def totals_of(chunks: DataFrame, word_buckets: int, pair_buckets: int) -> DataFrame:
    """For each chunk and bucket of words (even keys) or bigrams (odd ones): total training counts, and ranks of words.

    Rows with chunk -1 hold how many words of each count class a bucket has, and its words and tokens.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            c = Chunk(b.column("blob")[0].as_py())
            rows = []
            for odd, keys, n, bits, buckets in ((0, c.word_keys, c.word_counts(), 64, word_buckets), (1, c.pair_keys, c.pair_counts(), 56, pair_buckets)):
                bucket, parts = _cut(keys, bits, buckets)
                rows += [(b.column("chunk")[0].as_py(), int(bucket[p[0]]) * 2 + odd, 0, 0, pack(keys[p[:1]], least(np.diff(keys[p])), least(n[p]))) for p in parts]
            yield _rows(TOTALS, rows)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "key"):
            got = []
            for r in rows:
                first, steps, n = unpack(r[4])
                got.append((r[0], np.cumsum(np.concatenate([first, steps.astype(np.uint64)])), n))
            every, at = numbered(np.concatenate([g[1] for g in got]))
            c = np.bincount(at, weights=np.concatenate([g[2] for g in got]), minlength=len(every)).astype(np.int64)
            key, out = rows[0][1], []
            if key % 2 == 0:
                kind = count_class(c)
                order = order_of(kind)
                rank = np.empty(len(c), np.int64)
                first = np.searchsorted(kind[order], kind[order])
                rank[order] = np.arange(len(c)) - first
                classes, widths = np.unique(kind[c > 0], return_counts=True)
                out.append((-1, key, int((c > 0).sum()), int(c.sum()), pack(classes, widths)))
            for (chunk, *_), i in zip(got, np.split(at, np.cumsum([len(g[1]) for g in got])[:-1])):
                out.append((chunk, key, 0, 0, pack(least(c[i]), least(rank[i])) if key % 2 == 0 else pack(least(c[i]))))
            yield _rows(TOTALS, out)

    sent = chunks.select("chunk", "blob").mapInArrow(trimmed(emit), TOTALS)
    return sent.repartition(word_buckets + pair_buckets, "key").sortWithinPartitions("key").mapInArrow(trimmed(total), TOTALS)


def words_of(totals: DataFrame, buckets: int, docs: int) -> Words:
    """The word numbering, from a row for each count class."""

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            k, n = unpack(b.column("blob")[0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["class", "n"])

    stats = totals.where("chunk = -1")
    seen = stats.agg(F.sum("words").alias("w"), F.sum("tokens").alias("t")).first()
    rows = stats.select("blob").mapInArrow(widths, "class long, n long").groupBy("class").agg(F.max("n").alias("n")).toPandas()  # a row a class
    return Words(rows["class"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), buckets, (seen.w or 0) + (docs > 0), (seen.t or 0) + docs, docs)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[tuple]]:
    """Rows with the same key, from rows sorted by it."""
    held: list[tuple] = []
    for b in pieces(batches, 1):
        i = b.schema.get_field_index(key)
        row = tuple(c[0].as_py() for c in b.columns)
        if held and held[0][i] != row[i]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


GRAMS = "chunk long, shard int, blob binary"
#: Rows of grams_of() beside those of shards: documents' figures, and a histogram of ratios.
DOCS, RATIOS = -1, -2


class Home:
    """Which shard a trigram is kept in."""

    def __init__(self, shards: int, shard_tokens: int):
        self.n, self.size = shards, shard_tokens

    def of(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, t2: np.ndarray, t3: np.ndarray) -> np.ndarray:
        n = np.uint64(self.n)
        by_u = np.minimum(1 + 2 * t2.astype(np.int64) // self.size, self.n)
        by_w = np.minimum(1 + 2 * t3.astype(np.int64) // self.size, self.n)
        by_u, by_w = (np.where(v == UNKNOWN, self.n, x).astype(np.uint64) for x in (by_u, by_w))
        salt = lambda x, k: mix(x.astype(np.uint64) + np.uint64(k)) >> np.uint64(8)
        return ((mix(v.astype(np.uint64)) + salt(u, 0x632BE59B) % by_u + salt(w, 0x9BD9B4E0) % by_w) % n).astype(np.int64)


def grams_of(number: int, blob: bytes, totals: list[tuple[int, bytes]], words: Words, home: Home) -> Iterator[tuple]:
    """The rows that a chunk sends: its documents' figures, its histogram for order 2, and a block for every shard that it meets."""
    ch = Chunk(blob)
    got = [(k // 2, *unpack(t)) for k, t in totals if k % 2 == 0]
    c1, ids = np.zeros(ch.n_words + 2), np.empty(ch.n_words + 2, np.int64)
    if ch.n_words:
        c, rank = np.concatenate([g[1] for g in got]).astype(np.int64), np.concatenate([g[2] for g in got])
        c1[ch.word_order], ids[ch.word_order] = c, words.ids(c, rank, np.repeat([g[0] for g in got], [len(g[1]) for g in got]))
    c1[ch.n_words :], ids[ch.bos], ids[ch.end] = words.docs, BEGIN, STOP
    pairs = [unpack(t)[0] for k, t in totals if k % 2]
    c2 = (np.concatenate(pairs) if pairs else np.empty(0)).astype(np.int64)[ch.pair_of]
    t3 = np.append(0, c2)[:-1]  # how often the two tokens before stood together
    t3[ch.begin] = words.docs
    n = len(ch.lens)

    base = np.bincount(ch.doc, weights=np.log10(words.p1(c1[ch.seq])), minlength=n)
    n_known = np.bincount(ch.doc, weights=c1[ch.seq] > 0, minlength=n).astype(np.int64)
    n_train = ch.pair_counts()
    one = np.empty(len(n_train), np.int64)
    one[ch.pair_of] = np.arange(len(ch.seq))
    one, n_train = one[n_train > 0], n_train[n_train > 0]
    v, w, c = ch.prev[one], ch.seq[one], c2[one]
    t = c1[v] - 1
    ok = t > 0
    cells = ratio_cells(t[ok], (c[ok] - 1) / t[ok], words.p1_without(c1[w[ok]]), n_train[ok])
    some = np.flatnonzero(cells)
    yield number, RATIOS, pack(some, cells[some])

    every, at = numbered(ids)  # words that training lacks are one
    v, w = at[ch.prev], at[ch.seq]
    u = np.append(at[ch.bos], v)[:-1]
    u[ch.begin] = at[ch.bos]
    key = v * len(every) + u
    order = order_of(key, w)
    head = np.flatnonzero(changes(key[order], w[order]))
    c3 = np.add.reduceat(ch.train[order].astype(np.int64), head) if len(head) else head
    run = np.diff(np.append(head, len(key)))
    one = order[head]
    gv, gu, gw, c2, t3 = every[v[one]], every[u[one]], every[w[one]], c2[one], t3[one]
    shard = home.of(gv, gu, gw, words.counts(every)[v[one]], t3)
    by = order_of(shard)
    starts = head[by]
    docs = ch.doc[order][np.repeat(starts - (np.cumsum(run[by]) - run[by]), run[by]) + np.arange(len(key))] if len(key) else ch.doc
    yield number, DOCS, pack(ch.ids, ch.none, ch.held, ch.lens + 1, n_known, base, least(run[by]), least(docs))
    for g in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1) if len(by) else []:
        yield number, int(shard[g[0]]), pack(least(np.diff(gv[g], prepend=0)), least(gu[g]), least(gw[g]), least(c3[g]), least(c2[g]), least(t3[g]))


def _blocks(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """A shard's trigrams, block after block (v, u, w, training count, count of (v, w), count of (u, v)), and how many each block has."""
    parts = []
    for b in blobs:
        dv, *rest = unpack(b)
        parts.append([least(np.cumsum(dv.astype(np.int64))), *rest])
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts)], np.array([len(p[0]) for p in parts])


def _distinct(v: np.ndarray, u: np.ndarray, w: np.ndarray, c3: np.ndarray, c2: np.ndarray, t3: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct trigrams of a shard, sorted, in the same columns, and the number of each given one among them."""
    numbers = Numbers.among(v, u, w)
    k = max(len(numbers.values), 1)
    key, last = numbers.of(v) * k + numbers.of(u), numbers.of(w)
    order = order_of(key, last)
    new = changes(key[order], last[order])
    first, number = np.flatnonzero(new), np.empty(len(v), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[first]
    # what the counts of (v, w) and (u, v) are does not depend on the block, but for words that training lacks: there they are 0
    return [v[one], u[one], w[one], np.add.reduceat(c3[order], first), c2[one], t3[one]], number


def ratios_of(blobs: list[bytes], words: Words, l2: np.ndarray) -> np.ndarray:
    """A shard's histogram for order 3."""
    v, _, w, c3, c2, t3 = _distinct(*_blocks(blobs)[0])[0]
    ok = (c3 > 0) & (t3 > 1)
    v, w, c3, c2, t3 = v[ok], w[ok], c3[ok], c2[ok], t3[ok]
    t2 = words.counts(v) - 1
    p1 = words.p1_without(words.counts(w))
    l = np.where(t2 > 0, l2[half_octave(t2)], 0.0)
    low = l * (c2 - 1) / np.maximum(t2, 1) + (1 - l) * p1
    return ratio_cells(t3 - 1, (c3 - 1) / (t3 - 1), low, c3)


def answer(blobs: list[bytes], words: Words, l2: np.ndarray, l3: np.ndarray) -> Iterator[bytes]:
    """Builds the trie of a shard from its blocks, looks up each distinct trigram, and returns for each block the codes of its trigrams' probabilities."""
    rows, sizes = _blocks(blobs)
    grams, number = _distinct(*rows)
    del rows
    data = Trie.build(*grams, words, l2, l3)
    v, u, w = grams[:3]
    del grams
    with tempfile.TemporaryFile() as f:  # scratch of this task only
        f.write(data)
        f.flush()
        del data
        codes = _codes(Trie(np.memmap(f, np.uint8, mode="r").view(np.ndarray)).probability(v, u, w, words.p1(words.counts(w))))
    for mine in np.split(number, np.cumsum(sizes)[:-1]):
        yield pack(codes[mine])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores of all documents under a model of those for which held_out is not true."""
    spark = docs.sparkSession
    chunks = stored(spark, tokenised(docs, held_out), "chunks")
    size = chunks.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w"), F.sum("n_train").alias("d")).first()
    buckets, pair_buckets = max(1, -(-(size.w or 0) // BUCKET)), max(1, -(-(size.t or 0) // (2 * BUCKET)))
    totals = stored(spark, totals_of(chunks, buckets, pair_buckets), "totals")
    release_shuffles(spark)
    words = words_of(totals, buckets, size.d or 0)
    home = Home(max(1, -(-(size.t or 0) // shard_tokens)), shard_tokens)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "chunk"):
            for row in grams_of(rows[0][0], rows[0][2], [(r[1], r[2]) for r in rows[1:]], words, home):
                yield _rows(GRAMS, [row])

    # what is shuffled is a part of the chunks or of the shards at a time, as its files lie beside the stored tables
    rounds = ROUNDS if home.n >= ROUNDS else 1
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("key"), "blob").unionByName(totals.where("chunk <> -1").select("chunk", "key", "blob"))
    made = []
    for r in range(rounds):
        mine = both.where(F.pmod("chunk", F.lit(rounds)) == r).repartition("chunk").sortWithinPartitions("chunk", "key")
        made.append(stored(spark, mine.mapInArrow(trimmed(emit), GRAMS), "grams"))
    grams = reduce(DataFrame.unionByName, made)
    drop_stored(spark, chunks, totals)
    release_shuffles(spark)

    def shards(r: int) -> DataFrame:
        """The blocks of a round's shards, each shard's one after the other."""
        return grams.where((F.col("shard") >= 0) & (F.col("shard") % rounds == r)).repartition("shard").sortWithinPartitions("shard", "chunk")

    def histogram(rows: DataFrame, of) -> np.ndarray:
        """Sum of histograms over rows: at most HALVES * BINS sums come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(HALVES * BINS)
            for held in _runs(batches, "shard"):
                total += of([x[2] for x in held])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.float64())], names=["cell", "n"])

        out = np.zeros(HALVES * BINS)
        sums = stored(spark, rows.mapInArrow(trimmed(run), "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")), "histogram")
        found = sums.toPandas()
        drop_stored(spark, sums)
        out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
        return out

    def sent(blobs: list[bytes]) -> np.ndarray:
        out = np.zeros(HALVES * BINS)
        for at, n in map(unpack, blobs):
            out[at] += n
        return out

    l2 = fitted_weights(histogram(grams.where(F.col("shard") == RATIOS), sent))
    l3 = fitted_weights(sum(histogram(shards(r), lambda blobs: ratios_of(blobs, words, l2)) for r in range(rounds)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "shard"):
            for row, found in zip(rows, answer([x[2] for x in rows], words, l2, l3)):
                yield _rows(GRAMS, [(row[0], row[1], found)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "chunk"):
            ids, none, held, n_tokens, n_known, base, run, doc = unpack(rows[0][2])
            codes = np.concatenate([unpack(r[2])[0] for r in rows[1:]])
            total = np.bincount(doc, weights=np.repeat(codes / -STEP, run), minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=none), pa.array(held), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(ids), words.tokens, np.int64)), pa.array(base), pa.array(total)],
                names=[c.split()[0] for c in SCORES.split(", ")],
            )

    found = [stored(spark, shards(r).mapInArrow(trimmed(look_up), GRAMS), "found") for r in range(rounds)]
    every = reduce(DataFrame.unionByName, found, grams.where(F.col("shard") == DOCS))
    out = stored(spark, every.repartition("chunk").sortWithinPartitions("chunk", "shard").mapInArrow(trimmed(gather), SCORES), "scores")
    drop_stored(spark, *made, *found)
    return out


def op1_ef_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod(10) == 0)
