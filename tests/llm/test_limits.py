"""What operators leave on disk and in memory while they run."""

import os
import random
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trailforge.llm import common, ef_trie, partenum, prefix_hash


def shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x for d in dirs for _, _, names in os.walk(d.getPath()) for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def stored_bytes(df) -> int:
    return sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())


def test_stored_leaves_no_shuffle_files(spark):
    keys = list(common.WRITING)
    own, before = [spark.conf.get(k) for k in keys], shuffle_files(spark)
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept = common.stored(spark, df, "test")
    assert kept.agg(F.sum("count")).first()[0] == 1000 and df.count() == 7
    assert not {x for x in shuffle_files(spark) - before if x.split("_")[1] in {y.split("_")[1] for y in before}}
    before = shuffle_files(spark)
    common.stored(spark, df.where("k < 5"), "test")
    assert shuffle_files(spark) <= before and [spark.conf.get(k) for k in keys] == own


def test_workers_give_memory_back(monkeypatch):
    asked = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(asked.append)}))
    b = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["x"])
    assert list(common.trimmed(lambda batches: (x for x in batches))(iter([b, b]))) == [b, b] and asked == [0]


def test_trie_shuffles_a_part_at_a_time(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(ef_trie, "CHUNK_TOKENS", 100)
    made = []
    monkeypatch.setattr(ef_trie, "stored", lambda s, df, what: made.append((what, out := common.stored(s, df, what), out.count())) or out)
    cut = {r.doc_id: r.score for r in ef_trie.score(docs, ef_trie.crc_mod(10) == 0, 300).collect()}
    assert sum(w == "grams" for w, *_ in made) == ef_trie.ROUNDS
    rows = [n for w, _, n in made if w == "found"]
    assert len(rows) == ef_trie.ROUNDS and max(rows) < 0.7 * sum(rows)
    monkeypatch.setattr(ef_trie, "ROUNDS", 10**9)  # all at once
    whole = {r.doc_id: r.score for r in ef_trie.score(docs, ef_trie.crc_mod(10) == 0, 300).collect()}
    assert set(cut) == set(range(80)) and all(abs(cut[k] - whole[k]) < 1e-9 for k in cut)


def test_fingerprints_are_stored_in_half(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(string.ascii_letters) for _ in range(400)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = []
    monkeypatch.setattr(prefix_hash, "stored", lambda s, df, what: made.append(out := common.stored(s, df, what)) or out)
    n = prefix_hash.compare_with_next(docs).count()
    assert n == 600 and stored_bytes(made[0]) < 0.75 * 600 * (2 * (2 * 4 * prefix_hash.SKETCH + 20) + 64)


def test_signature_buckets_are_no_more_than_needed(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (40, 150, 400, 1200) for _ in range(20)]
    wh = common.WordHash()
    x, owner = partenum.shingle_sets(*common.word_hashes(pa.array(texts), wh))
    import numpy as np

    sig, _ = partenum.all_signatures(x, owner, np.bincount(owner, minlength=len(texts)))
    per = sum(map(len, texts)) / len(sig)
    assert per / 2 < partenum.BYTES_PER_SIGNATURE < 2 * per


def test_trie_looks_up_each_trigram_of_a_shard_once(monkeypatch):
    """Copies of a block in other chunks cost no look-ups, and as many look-ups as elements none on single bits."""
    r = np.random.default_rng(11)
    v, u, w = np.unique(r.integers(ef_trie.FIRST_ID, 60, (3, 4000)), axis=1)
    c2, t3 = 40 + v % 7 + w % 5, 30 + v % 7 + u % 5
    parts = [np.arange(len(v)), *(np.flatnonzero(r.random(len(v)) < 0.7) for _ in range(5))]
    blobs = [common.pack(common.least(np.diff(v[at], prepend=0)), *(common.least(x[at]) for x in (u, w, 1 + u % 3, c2, t3))) for at in parts]
    words = ef_trie.Words(np.array([500]), np.array([60]), 1, 60, 30000, 10)
    half = np.full(ef_trie.HALVES, 0.5)
    looked, selected, known = [], [], ef_trie.Trie.probability
    monkeypatch.setattr(ef_trie.Trie, "probability", lambda self, *x: looked.append(len(x[0])) or known(self, *x))
    select = ef_trie.EliasFano._select
    monkeypatch.setattr(ef_trie.EliasFano, "_select", lambda self, k, one: selected.append(len(k)) or select(self, k, one))
    got = [common.unpack(b)[0] for b in ef_trie.answer(blobs, words, half, half)]
    assert sum(looked) == len(v) and sum(selected) == 0
    assert all((g == got[0][at]).all() for g, at in zip(got, parts))
    c3 = sum(np.bincount(at, minlength=len(v)) for at in parts) * (1 + u % 3)
    want = 0.5 * c3 / t3 + 0.5 * (0.5 * c2 / 500 + 0.5 * words.p1(words.counts(w)))
    assert np.abs(got[0] / -ef_trie.STEP - np.log10(want)).max() < 1e-3
    monkeypatch.setattr(ef_trie, "DENSE", 0)  # the same, by search in the packed bits
    assert all((common.unpack(b)[0] == g).all() for b, g in zip(ef_trie.answer(blobs, words, half, half), got)) and sum(selected) > 0


def test_words_are_hashed_without_a_dictionary():
    r = random.Random(13)
    ws = ["".join(r.choice("abé") for _ in range(n)) for n in range(1, 45) for _ in range(40)]
    texts = [None, "", " \t", *(" ".join(r.choice(ws) for _ in range(50)) + r.choice(["", " ", "\n"]) for _ in range(80))]
    known = common.WordHash()
    h, bounds = common.word_hashes(pa.array(["x", *texts]).slice(1), known)
    plain = [common.words(t or "") for t in texts]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    of = {}
    for w, x in zip((w for p in plain for w in p), h.tolist()):
        assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of) and known.keys() == {w for w in of if len(w) > common.SHORT_WORD}
    alone = common.word_hashes(pa.array(list(of), pa.binary()).cast(pa.string()), known)[0]
    assert alone.tolist() == list(of.values())


def test_order_of_columns():
    r = np.random.default_rng(17)
    for top in (1, 5, 1 << 30, (1 << 64) - 1):  # the last leaves no room for rows' numbers
        a, b = r.integers(0, top, (2, 500), np.uint64, endpoint=True)
        assert (common.order_of(a, b) == np.lexsort((b, a))).all() and (common.order_of(a % np.uint64(9), b) == np.lexsort((b, a % np.uint64(9)))).all()
    assert len(common.order_of(np.empty(0, np.int64))) == 0 and [x.tolist() for x in common.numbered(np.array([7, 3, 7]))] == [[3, 7], [1, 0, 1]]


def test_sets_of_all_documents_are_not_stored(spark, monkeypatch):
    """Only sets that are compared exactly are written with their elements."""
    r = random.Random(19)
    texts = []
    for _ in range(20):
        shared = [f"{r.random():.9f}" for _ in range(400)]
        texts += [" ".join(shared + [f"{r.random():.9f}" for _ in range(n)]) for n in (400, 400, 0, 3)]  # two half alike, two linked
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = []
    monkeypatch.setattr(partenum, "stored", lambda s, df, what: made.append((what, out := common.stored(s, df, what), stored_bytes(out))) or out)
    got = {x.doc_id: x.component_id for x in partenum.near_duplicates(docs).collect()}
    assert got == {i: i - 1 if i % 4 == 3 else i for i in range(80)}
    size = {w: n for w, _, n in made if w == "sets"}
    assert size["sets"] < 40 * 400 * 8 / 2
