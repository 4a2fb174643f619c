import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.llm import byte_bpe, ef_trie, licence, line_crf, partenum, pii, prefix_hash, spaced_seed, url_filter, wavelet

CLASH = "doc_id long, text string, score double, predicted string, text_key string, label string, node string, row string, held_out string, sig long, item_id long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0.25, "p", "k", "l", "n", "r", "h", 7, 9) for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(1)
    w = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    w[50_000:50_000] = [f"q{k}" for k in range(40)]
    text = "\n".join(" ".join(w[k : k + 20]) for k in range(0, len(w), 20)) + "\nmail me at someone@example.org now.\nReleased under the MIT License\n"
    rows = [(1, text), (2, text.replace("w1 ", "w1x ")), (3, "short text of a few words here"), (4, None), (5, ""), (None, "short text of a few words here")]
    return rows, docs_of(spark, rows)


def test_very_long_texts_and_clashing_columns(spark, long_docs):
    import public_tokenizers as P

    rows, d = long_docs
    text = rows[0][1]
    by_id = lambda df: {r.doc_id: r for r in df.collect()}
    one = by_id(ef_trie.score(d, ef_trie.crc_mod(10) == 0))
    assert one[1].n_tokens == len(text.split()) + 1 and one[4].n_tokens == one[5].n_tokens == 1 and one[None].held_out is False and len(one) == 6
    two = by_id(prefix_hash.compare_with_next(d))
    assert two[1].n_chars == len(text) and two[4].n_chars == 0 and two[1].fingerprint != two[2].fingerprint
    three = by_id(partenum.near_duplicates(d))
    w = text.split()
    s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert three[1].n_shingles == len(s) and three[2].component_id == 1 and three[None].component_id == 3 and three[4].component_id == 4 and three[5].n_shingles == 0
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    four = by_id(line_crf.classify(d, line_crf.train(d, labels)))
    assert all(0 <= r.score <= 1 for r in four.values()) and four[1].predicted in (0, 1) and four[1].label == "l"
    five = url_filter.judge(spark.createDataFrame([(1, "http://a.com/" + "x" * 1_000_000, "v", "r"), (2, "http://shop.net/fr/" + "y" * 100_000, "v", "r")], "page_id long, url string, verdict string, rule string"), spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"))
    assert {r.page_id: r.rule for r in five.collect()} == {1: "com/", 2: "net/fr/"}
    path = P.path("byte_bpe_50k.tiktoken")
    six = by_id(byte_bpe.encode(d, path, P.PATTERN))
    assert list(six[1].ids) == byte_bpe.codec(path, P.PATTERN).core.encode_ordinary(text) and six[4].n_tokens == 0
    seven = by_id(pii.detect(d))
    assert seven[1].spans == f"email:{text.index('someone@')}:{text.index('someone@') + 19}" and seven[4].spans == ""
    eight = by_id(wavelet.read_documents(wavelet.write_shards(d, P.path("word_bpe_49k.json"), 2)))
    ids = wavelet.WordTokenizer(P.path("word_bpe_49k.json")).tok.encode(text, add_special_tokens=False).ids
    assert eight[1].n_tokens == len(ids) + 1 and eight[1].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) and eight[5].n_tokens == 1
    nine = by_id(licence.scan(d))
    assert nine[1].licences == ["MIT"] and nine[4].licences == []
    ten = spaced_seed.overlaps(d, spark.createDataFrame([(7, " ".join(f"q{k}" for k in range(40)), "x")], "item_id long, text string, doc_id string"))
    assert sorted(tuple(r) for r in ten.collect()) == [(1, 7, 50_000, 40, 40), (2, 7, 50_000, 40, 40)]


def test_session_is_left_as_it_was(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = docs_of(spark, [(1, "a b c"), (2, "d e f")])
    ef_trie.score(d, ef_trie.crc_mod(10) == 0).collect()
    partenum.near_duplicates(d).collect()
    pii.detect(d).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_repeated_rows_and_empty_urls(spark):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://x.com/a", None)] * 3 + [(None, None, "h"), (2, "", "h")], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()), key=str)
    assert got == sorted([(1, "com/", "allow")] * 3 + [(None, None, "allow"), (2, None, "allow")], key=str)
    assert url_filter.judge(pages.where("false"), rules).count() == 0 and url_filter.judge(pages, rules.where("false")).where("rule IS NOT NULL").count() == 0


def test_pii_takes_linear_time():
    for unit in ("a dot ", "a at ", "one two ", "1.", "1 ", "@", "a@", "+1 ", "one.", "a.b ", "( at ) ", "1 dot "):
        took = []
        for n in (20_000, 80_000):
            t = time.perf_counter()
            pii.find_spans(unit * (n // len(unit)))
            took.append(time.perf_counter() - t)
        assert took[1] < 12 * took[0] + 0.3, (unit, took)


def test_pii_recall_of_planted_disguises():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghklmnprstuvw") for _ in range(r.randint(3, 8)))
    names = "zero one two three four five six seven eight nine".split()
    glyph = {"a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "x": "х"}

    def luhn(d):
        for k in range(10):
            if pii.luhn(d + str(k)):
                return d + str(k)

    kinds = {
        "email": lambda: (word(), word(), r.choice(["com", "org", "net"])),
        "ip": lambda: [str(r.randint(0, 255)) for _ in range(4)],
        "card": lambda: luhn("4" + "".join(str(r.randrange(10)) for _ in range(14))),
        "phone": lambda: "".join(str(r.randrange(10)) for _ in range(10)),
    }
    shapes = {
        "email": [lambda x: f"{x[0]} at {x[1]} dot {x[2]}", lambda x: f"{x[0]} [at] {x[1]} [dot] {x[2]}", lambda x: f"{x[0]}(at){x[1]}(dot){x[2]}", lambda x: f"{x[0]} @ {x[1]} . {x[2]}", lambda x: f"{x[0]}＠{x[1]}.{x[2]}", lambda x: "".join(glyph.get(c, c) for c in x[0]) + f"@{x[1]}.{x[2]}"],
        "ip": [lambda x: " dot ".join(x), lambda x: "[.]".join(x), lambda x: " dot ".join(" ".join(names[int(c)] for c in p) for p in x), lambda x: ".".join("".join(chr(0x0660 + int(c)) for c in p) for p in x)],
        "card": [lambda x: " ".join(names[int(c)] for c in x), lambda x: "".join(chr(0xFF10 + int(c)) for c in x), lambda x: "-".join(names[int(c)] for c in x)],
        "phone": [lambda x: "+1 " + " ".join(names[int(c)] for c in x), lambda x: "+" + "".join(chr(0x0966 + int(c)) for c in "1" + x), lambda x: "＋1 " + x],
    }
    found = total = 0
    for kind, make in kinds.items():
        for shape in shapes[kind]:
            for _ in range(40):
                hidden = shape(make())
                lead = " ".join(["see"] + [word() for _ in range(5)]) + ": "
                _, every = pii.find_spans(f"{lead}{hidden}; and {word()} too")
                total += 1
                found += any(k == kind and a <= len(lead) + 2 and b >= len(lead) + len(hidden) - 2 for k, a, b in every)
    assert found >= 0.9 * total, (found, total)


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    crf = line_crf.Crf(np.zeros(3), rng.normal(size=(2, 2)), 1.0, 0.0)
    length = np.array([1, 4, 6])
    e = rng.normal(size=(3, 6))
    good, trans = crf.marginals(e, length, np.array([1.0, 2.0, 0.5]))
    want = np.zeros((2, 2))
    for d, weight in enumerate((1.0, 2.0, 0.5)):
        n, total, mine, pairs = length[d], 0.0, np.zeros(length[d]), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(e[d, i] / 2 * (1 if y[i] else -1) for i in range(n)) + sum(crf.t[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            mine += p * np.array(y)
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += p
        assert good[d, :n] == pytest.approx(mine / total)
        want += weight * pairs / total
    assert trans == pytest.approx(want)


def test_crf_sample_is_of_labels_with_documents(spark):
    rows = [(i, ("good words in a row here.\n" if i % 2 else "### $$$ %%%\n") * 3) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2000)], "doc_id long, quality int, toxic int")
    crf = line_crf.train(docs_of(spark, rows), labels, None, 50)
    assert np.abs(crf.w).sum() > 0


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    items = [[f"b{r.randrange(400)}" for _ in range(r.choice([4, 14, 25, 60]))] for _ in range(12)]
    docs = []
    for k in range(60):
        w = [f"b{r.randrange(400)}" for _ in range(r.randint(0, 80))]
        if k % 2:
            item = list(r.choice(items))
            for _ in range(r.choice([0, 0, 1, 2, len(item) // 3])):
                item[r.randrange(len(item))] = "changed"
            at, cut = r.randint(0, len(w)), r.randint(0, 3)
            w[at:at] = item[cut:]
        docs.append(w)
    want = set()
    for d, w in enumerate(docs):
        for i, item in enumerate(items):
            for shift in range(-len(item) + 1, len(w)):
                same = [shift + k >= 0 and shift + k < len(w) and w[shift + k] == x for k, x in enumerate(item)]
                if any(sum(same[a:b]) >= min(spaced_seed.MATCHED, len(item)) and all(same[a:b]) for a in range(len(item)) for b in [min(len(item), a + max(spaced_seed.MATCHED, min(len(item), spaced_seed.MATCHED)))]):
                    want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in spaced_seed.overlaps(docs_of(spark, [(d, " ".join(w)) for d, w in enumerate(docs)]), bench).collect()}
    assert want <= got and len(want) > 10  # every overlap without a substitution long enough, and others with some
    for d, i in got - want:
        assert any(x in docs[d] for x in items[i])


def test_likeness_against_dice(spark):
    r = random.Random(6)
    for _ in range(20):
        a = "".join(r.choice("abcdef ") for _ in range(r.randint(200, 1500)))
        cut = r.randint(0, len(a))
        b = a[:cut] + "".join(r.choice("abcdef ") for _ in range(r.randint(100, 800)))
        spans = lambda t: {t[k : k + prefix_hash.SPAN] for k in range(len(t) - prefix_hash.SPAN + 1)}
        x, y = spans(a), spans(b)
        dice = 2 * len(x & y) / (len(x) + len(y))
        got = prefix_hash.Prefixes(a).fingerprint().likeness(prefix_hash.Prefixes(b).fingerprint())
        assert got == pytest.approx(dice, abs=0.25)


def test_word_memory_overflows(monkeypatch):
    import public_tokenizers as P
    import pyarrow as pa

    monkeypatch.setattr(wavelet, "CACHE_IDS", 50)
    own, r = wavelet.WordTokenizer(P.path("word_bpe_49k.json"), True), random.Random(7)
    for _ in range(30):
        texts = [" ".join(f"{r.choice('abcdef')}{r.choice('ghijkl')}{r.randrange(9)}" for _ in range(40)) for _ in range(3)]
        ids, n = own.encode(pa.array(texts), 2)
        assert ids.tolist() == [i for t in texts for i in [*own.tok.encode(t, add_special_tokens=False).ids, 2]] and n.sum() == len(ids)
