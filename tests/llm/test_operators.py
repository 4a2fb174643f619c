import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailforge.llm import byte_bpe, ef_trie, licence, line_crf, partenum, pii, prefix_hash, spaced_seed, url_filter, wavelet

SCHEMA = "doc_id long, text string, score string, block string, node string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "a b c d e f g " * 400, "same words in here again", "same words in here again", "x\n\ny\tz é ∑"]


@pytest.fixture(scope="module")
def odd(spark):
    d = docs_of(spark, ODD)
    return d.unionByName(spark.createDataFrame([(None, "no id", None, None, None), (4, ODD[4], None, None, None)], SCHEMA))


def apply_all(spark, d):
    import public_tokenizers as P

    bench = spark.createDataFrame([(1, "a b c d e f g a b c d e f g"), (2, None), (3, "tiny item")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    yield "trie", ef_trie.score(d, ef_trie.crc_mod(10) == 0)
    yield "prefix", prefix_hash.compare_with_next(d)
    yield "partenum", partenum.near_duplicates(d)
    yield "crf", line_crf.classify(d, line_crf.train(d, labels))
    yield "bpe", byte_bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    yield "pii", pii.detect(d)
    yield "wavelet", wavelet.read_documents(wavelet.write_shards(d, P.path("word_bpe_49k.json"), 2))
    yield "licence", licence.scan(d)
    yield "seed", spaced_seed.overlaps(d, bench)


def test_odd_rows(spark, odd):
    for name, out in apply_all(spark, odd):
        n = out.count()
        assert n == (len(ODD) + 2 if name != "seed" else n), name


def test_empty_tables(spark):
    for name, out in apply_all(spark, docs_of(spark, []).where("false")):
        assert out.count() == 0, name


def brute_components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    s = [shingles(t) for t in texts]
    low = list(range(len(s)))
    for _ in s:
        for i in range(len(s)):
            for j in range(len(s)):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    low[i] = low[j] = min(low[i], low[j])
    return [(i, len(x), low[i]) for i, x in enumerate(s)]


def test_near_duplicates(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 6, 9, 14, 40, 120]))]
        for _ in range(rng.randint(1, 8)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                t[rng.choice([0, len(t) - 1, rng.randrange(len(t))])] = rng.choice(vocab)
            texts.append(" ".join(t))
        shared = [rng.choice(vocab) for _ in range(60)]
        texts += [" ".join(shared + [rng.choice(vocab) for _ in range(90)]) for _ in range(4)]
    got = sorted(tuple(r) for r in partenum.near_duplicates(docs_of(spark, texts + ["one two", "one two", ""])).collect())
    assert got == brute_components(texts + ["one two", "one two", ""])


def test_signature_guarantee():
    """Linked sets always share a subset signature of a common band, and sketches never overstate the difference."""
    rng = np.random.default_rng(5)
    linked = 0
    for _ in range(1500):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([a[: len(a) - drop], rng.integers(0, 1 << 63, int(rng.integers(0, len(a) // 8 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        linked += 1
        size = np.array([len(a), len(b)])
        x, owner = np.concatenate([a, b]), np.repeat([0, 1], size)
        sig, who = partenum.all_signatures(x, owner, size)
        assert len(np.intersect1d(sig[who == 0], sig[who == 1]))
        s, t = partenum.sketches(x, size)
        p, q = partenum.folded([s, t], min(len(s), len(t)))
        assert np.bitwise_count(p ^ q).sum() <= len(a) + len(b) - 2 * both
    assert linked > 300


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 5), (500, 600), (500, 1 << 60), (3000, 100)):
        x = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        h, low, high = ef_trie.EliasFano.encode(x)
        e = ef_trie.EliasFano(int(h[0]), int(h[1]), low, high)
        assert (e.at(np.arange(n)) == x).all()
        q = np.concatenate([x, rng.integers(0, top + 10, 200, dtype=np.uint64)])
        assert (e.successor(q) == np.searchsorted(x, q)).all()


@pytest.mark.parametrize("shard_tokens", [10_000_000, 300])
def test_trigram_scores(spark, shard_tokens):
    rng = random.Random(2)

    def sentence():  # words that mostly follow from the one before
        k, out = rng.randint(0, 60), []
        for _ in range(rng.randint(0, 60)):
            k = (3 * k + 1) % 61 if rng.random() < 0.8 else rng.randint(0, 60)
            out.append(f"w{k}" if k > 4 else "the")
        return " ".join(out)

    texts = [sentence() for _ in range(80)]
    got = {r.doc_id: r for r in ef_trie.score(docs_of(spark, texts), ef_trie.crc_mod(10) == 0, shard_tokens).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    from collections import Counter

    W = {i: [*t.split(), None] for i, t in enumerate(texts)}
    c = Counter(w for i, x in W.items() if not held[i] for w in x)
    N, V = sum(c.values()), len(c)
    tri, bi = Counter(), Counter()
    for i, x in W.items():
        if not held[i]:
            y = ["<", "<", *x]
            for u, v, w in zip(y, y[1:], y[2:]):
                tri[u, v, w] += 1
                bi[v, w] += 1
    ctx2, ctx3 = Counter(), Counter()
    for (v, _), n in bi.items():
        ctx2[v] += n
    for (u, v, _), n in tri.items():
        ctx3[v, u] += n
    half = lambda t: int(2 * np.log2(t) + 1e-9)

    def fit(events):  # (half octave, likelihood of the higher and the lower order, weight): expectation maximisation, one event at a time
        out, last = {}, 0.0
        for k in range(80):
            mine = [e[1:] for e in events if e[0] == k]
            lam = 0.5
            for _ in range(60 if mine else 0):
                lam = min(sum(n * lam * h / (lam * h + (1 - lam) * low) for h, low, n in mine) / (sum(n for *_, n in mine) + 1), 0.999)
            last = lam if mine else last
            out[k] = last
        return out

    p1 = lambda w: (c[w] + 0.1) / (N + 0.1 * (V + 1))
    p1_out = lambda w: (c[w] - 0.9) / (N - 1 + 0.1 * (V + 1))
    l2 = fit([(half(ctx2[v] - 1), (n - 1) / (ctx2[v] - 1), p1_out(w), n) for (v, w), n in bi.items() if ctx2[v] > 1])

    def low_out(v, w):
        t = ctx2[v] - 1
        lam = l2[half(t)] if t else 0.0
        return lam * (bi[v, w] - 1) / max(t, 1) + (1 - lam) * p1_out(w)

    l3 = fit([(half(ctx3[v, u] - 1), (n - 1) / (ctx3[v, u] - 1), low_out(v, w), n) for (u, v, w), n in tri.items() if ctx3[v, u] > 1])

    def p2(v, w):
        lam = l2[half(ctx2[v])] if ctx2[v] else 0.0
        return lam * bi[v, w] / max(ctx2[v], 1) + (1 - lam) * p1(w)

    def p3(v, u, w):
        lam = l3[half(ctx3[v, u])] if ctx3[v, u] else 0.0
        return lam * tri[u, v, w] / max(ctx3[v, u], 1) + (1 - lam) * p2(v, w)

    for i, x in W.items():
        base = sum(np.log10((c[w] + 0.1) / (N + 0.1 * (V + 1))) for w in x)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(c[w] > 0 for w in x), N)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        y = ["<", "<", *x]
        assert r.score == pytest.approx(sum(np.log10(p3(v, u, w)) for u, v, w in zip(y, y[1:], y[2:])), rel=2e-3)



def test_prefix_hashes(spark):
    a, b = prefix_hash.Prefixes("xxhello worldyy"), prefix_hash.Prefixes("hello world!")
    assert a.span(2, 13) == b.span(0, 11) and prefix_hash.common_extension(a, 2, b, 0) == 11
    texts = ["abcd" * 30, "", "héllo " * 20, "z"]
    got = {r.doc_id: r for r in prefix_hash.compare_with_next(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        f, g, h = (prefix_hash.Prefixes(x).fingerprint() for x in (t, e, nxt))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), str(f), str(g))
        assert (r.near_edited, r.near_next) == (f.likeness(g), f.likeness(h))
        assert prefix_hash.Fingerprint.parse(str(f)).likeness(g) == f.likeness(g)


def test_byte_bpe_chunks():
    import public_tokenizers as P

    c = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        s = "".join(rng.choice(["a", "b'", " ", "  ", "\n", "'ll", "'s", "9", "é", "!", "\t ", " x"]) for _ in range(rng.randint(0, 200)))
        assert byte_bpe.pre_tokenize(c.pattern, s, 40, 12) == c.pattern.findall(s)
        ids = c.encode(s)
        assert ids.tolist() == c.core.encode_ordinary(s) and c.decode(ids) == s.encode()
    for s in ("a" * 500, " " * 500, "'" * 100 + "ll" * 50):
        assert byte_bpe.pre_tokenize(c.pattern, s, 40, 12) == c.pattern.findall(s)


def test_pii():
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(2)
    for _ in range(3000):
        s = "".join(rng.choice("ab@.-+ 1é") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in email.finditer(s)] == [(a, b) for k, a, b in pii.base_spans(s) if k == "email"]
    for s, want in {"mail john (at) example (dot) com now": ("email", 5, 32), "+1 (456) 555-2186": ("phone", 0, 17), "ｊohn＠example．com": ("email", 0, 16), "4524132264652876": ("card", 0, 16), "1.2.3.4": ("ip", 0, 7)}.items():
        assert want in pii.find_spans(s)[1]
    for s in ("look at foo.com", "at the dot com", "one two three", "1.2.3.400"):
        assert pii.find_spans(s)[1] == []
    assert pii.redact("a x@y.zz b", pii.find_spans("a x@y.zz b")[1]) == "a [EMAIL] b"


def test_wavelet(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    x = np.random.default_rng(0).zipf(1.3, 3000) % 40000
    m = wavelet.WaveletMatrix.open(wavelet.WaveletMatrix.encode(x))
    assert (m.all() == x).all() and all(m.access(i) == x[i] for i in range(0, 3000, 97))
    for s in (0, 1, 2, 39999):
        p = np.flatnonzero(x == s)
        assert m.count(s) == len(p) and m.count(s, 100, 900) == ((p >= 100) & (p < 900)).sum()
        assert [m.occurrence(s, k) for k in range(min(9, len(p)))] == p[:9].tolist() and m.occurrence(s, len(p)) == -1
    texts = ["Hello, wörld. it's <|endoftext|>", "", "a\x1cb \x01 ΑΣ", "x y z"]
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    want, at = [], 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = wavelet.read_documents(wavelet.write_shards(docs_of(spark, texts), P.path("word_bpe_49k.json"), 2, 20))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_word_tokenizer_equals_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(1)
    lib, own = Tokenizer.from_file(path), wavelet.WordTokenizer(path)
    lib.encode_special_tokens = True
    letters = "aAbB éİßΣς,.'\x01\x1c\x85\u00a0\u2028\u0301\u0958\u200d\t\n\r 12٣%中가😀\u0000" + "'s"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    want = [[*lib.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    ids, n = own.encode(pa.array(texts), 2)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(partenum, "GROUP", 40)
    r = random.Random(5)
    texts = []
    for _ in range(300):
        w = [f"w{k}" for k in range(60)]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"x{r.randrange(4000)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(56)} for t in texts]
    low = list(range(300))
    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and low[i] != low[j]:
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    got = {x.doc_id: x.component_id for x in partenum.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(low))


def test_line_crf(spark):
    rng = random.Random(3)
    good = lambda: "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: good().split("\n")[0] + "\n" + "\n".join("XX$$$ ###YY &&& ***" * 3 for _ in range(3))
    texts = [good() if i % 2 else bad() for i in range(200)]
    d = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    crf = line_crf.train(d, labels)
    out = line_crf.classify(d, crf).where("doc_id >= 100").collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out) >= 95


def test_url_filter(spark):
    urls = [None, "nothing", "https://WWW.Example.com/en/a?x", "http://a.example.com/en/", "http://shop.net/fr/x#y", "http://shop.net?/fr/", "ftp://com/", "http://telecom/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    r = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = {x.page_id: (x.host, x.rule, x.verdict) for x in url_filter.judge(pages, r, 64).collect()}
    assert got == {0: ("", None, "allow"), 1: ("", None, "allow"), 2: ("www.example.com", "www.example.com/en/", "allow"), 3: ("a.example.com", "example.com/en/", "block"), 4: ("shop.net", "net/fr/", "block"), 5: ("shop.net", None, "allow"), 6: ("com", "com/", "allow"), 7: ("telecom", None, "allow")}
    f = url_filter.BlockedBloom(64)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64)
    f.add(keys)
    assert f.may_hold(keys).all()


def test_licence(spark):
    texts = ["Foo. All rights reserved.\nbar", "Redistribution and use in source and binary forms, with or without modification, are permitted; x\nNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products.", "Released under the MIT License", "mit license"]
    got = [r.licences for r in licence.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["Proprietary"], ["BSD-3-Clause"], ["MIT"], []]


def test_decontamination(spark):
    rng = random.Random(9)
    w = lambda n: [f"q{rng.randint(0, 5000)}" for _ in range(n)]
    item, other = w(30), w(40)
    changed = list(item)
    changed[7], changed[19] = "other", "words"
    texts = [" ".join(w(50) + item + w(20)), " ".join(w(5) + changed + w(70)), " ".join(w(100)), " ".join(w(20) + item[:10] + w(20)), " ".join(x.upper() + "," for x in other), "tiny item here"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "tiny item")], "item_id long, text string")
    got = sorted(tuple(r) for r in spaced_seed.overlaps(docs_of(spark, texts), bench).collect())
    assert got == [(0, 1, 50, 30, 30), (1, 1, 5, 30, 28), (4, 2, 0, 40, 40), (5, 3, 0, 2, 2)]


def test_decontamination_behind_a_weak_first_hit(spark):
    item = [f"q{k}" for k in range(60)]
    parts = {0: item[:12] + ["x1", "x2", "x3", "x4"] + item[16:], 1: item[:20] + ["x1", "x2", "x3"] + item[23:], 2: item[:12] + ["x1", "x2", "x3", "x4"] + item[16:28]}
    texts = [" ".join(["lead"] * 9 + parts[k] + ["tail"] * 9) for k in parts]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = sorted(tuple(r) for r in spaced_seed.overlaps(docs_of(spark, texts), bench).collect())
    assert got == [(0, 1, 25, 44, 44), (1, 1, 32, 37, 37)]


def test_decontamination_of_repeated_item_ids(spark):
    """Rows that share an id are texts of one item; each of them counts."""
    w = [f"q{k}" for k in range(60)]
    texts = [" ".join(w[:30]), " ".join(w[30:]), "nothing of it"]
    bench = spark.createDataFrame([(1, " ".join(w[:30])), (1, " ".join(w[30:])), (1, " ".join(w[:30])), (1, "")], "item_id long, text string")
    got = sorted(tuple(r) for r in spaced_seed.overlaps(docs_of(spark, texts), bench).collect())
    assert got == [(0, 1, 0, 30, 30), (1, 1, 0, 30, 30)]


MIT = """Copyright (c) 2020 Some One
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def test_licence_standard_texts(spark):
    want = [(MIT, "MIT"), (BSD.format("the copyright holder"), "BSD-3-Clause"), (BSD.format("Some Firm Inc."), "BSD-3-Clause"), (GPL, "GPL-3.0"), (APACHE, "Apache-2.0")]
    forms = [str, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.split("\n")) + " */\nint x;", lambda t: " ".join(t.replace("Copyright (c) 2020 Some One\n", "").split())]
    texts = [f(t) for t, _ in want for f in forms]
    got = [r.licences for r in licence.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[name] for _, name in want for _ in forms]
    far = "-" * 2000 + "All" + " " * 2000 + "rights reserved"
    cut = ["all rights\n\nreserved", "x all rights reserved", "All rights\nreserved", far]
    assert [r.licences for r in licence.scan(docs_of(spark, cut)).orderBy("doc_id").collect()] == [[], [], ["Proprietary"], ["Proprietary"]]


def test_pii_disguises():
    east = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    persian = str.maketrans("0123456789", "۰۱۲۳۴۵۶۷۸۹")
    deva = str.maketrans("0123456789", "०१२३४५६७८९")
    for digits in (east, persian, deva):
        assert pii.find_spans("c 4524132264652876 d".translate(digits))[1] == [("card", 2, 18)]
        assert pii.find_spans("+1 (456) 555-2186".translate(digits))[1] == [("phone", 0, 17)]
    for s in ("192[.]168[.]0[.]1", "192 dot 168 dot 0 dot 1", "192(dot)168.0.1", "one nine two.one six eight.zero.one", "one nine two dot one-six-eight dot zero dot one", "192.168.0.one", "192 . 168 . 0 . 1"):
        assert ("ip", 3, 3 + len(s)) in pii.find_spans(f"at {s} now")[1], s
        assert pii.redact(f"at {s} now", pii.find_spans(f"at {s} now")[1]) == "at [IP] now"
    assert ("ip", 7, 30) in pii.find_spans("room 5 192 dot 168 dot 0 dot 1")[1]
    assert pii.find_spans("mail john@example . com now")[1] == [("email", 5, 23)]
    spelled = ".".join("four five two four one three two two six four six five two eight seven six".split())
    assert ("card", 0, len(spelled)) in pii.find_spans(spelled)[1]
    for s in ("300 dot 168 dot 0 dot 1", "one. two. three. four.", "2 dot 3 dot 4", "wait . one two"):
        assert pii.find_spans(s)[1] == [], s


def test_trigram_scores_of_many_shards(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randint(0, 60))) for _ in range(120)]
    one, many = ({r.doc_id: r for r in ef_trie.score(docs_of(spark, texts), ef_trie.crc_mod(10) == 0, n).collect()} for n in (10_000_000, 300))
    for i in one:
        assert many[i].score == pytest.approx(one[i].score, rel=1e-9) and many[i].base_score == one[i].base_score


def test_scores_of_independent_words_fall_back_on_the_base(spark):
    rng = random.Random(11)
    for kinds, n in ((30, 100), (5000, 100)):
        texts = [" ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 60))) for _ in range(n)]
        got = [r for r in ef_trie.score(docs_of(spark, texts), ef_trie.crc_mod(10) == 0, 2000).collect() if r.held_out]
        assert sum(r.score for r in got) > 1.01 * sum(r.base_score for r in got)


def test_special_tokens_in_texts(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path, r = P.path("word_bpe_49k.json"), random.Random(6)
    lib, own = Tokenizer.from_file(path), wavelet.WordTokenizer(path, True)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", ".", ",", "a", "é", "'s", "\x01", "12", "words"]
    texts = ["end <|endoftext|> x", "", "<|endoftext|>", "a<|startoftext|>.", *("".join(r.choice(pieces) for _ in range(r.randint(0, 12))) for _ in range(2000))]
    want = [[*lib.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    ids, n = own.encode(pa.array(texts), 2)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    docs_of(spark, texts[:40]).write.parquet(str(tmp_path / "documents.parquet"))
    at, rows = 0, []
    for i, w in enumerate(want[:40]):
        rows.append((i, at, len(w), zlib.crc32(np.array(w, "<u4").tobytes())))
        at += len(w)
    assert sorted(tuple(x) for x in wavelet.op8_wavelet(spark, str(tmp_path)).collect()) == rows


def test_line_crf_learns_behind_400_lines(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(6)) + "."
    text = lambda bad: "\n".join([line() for _ in range(400)] + ["XX$$$ ###YY &&& ***" if bad else line() for _ in range(200)])
    d = docs_of(spark, [text(i % 2 == 0) for i in range(48)])
    crf = line_crf.train(d, spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r.score for r in line_crf.classify(d, crf).where("doc_id >= 40").collect()}
    assert min(out[i] for i in out if i % 2) > 0.7 > 0.3 > max(out[i] for i in out if i % 2 == 0)


def test_bpe_of_long_texts_in_parallel_chunks(spark):
    import public_tokenizers as P

    r = random.Random(12)
    words = ["alpha", " ", "  ", "\n\n", "naïve", "1234567", "…", "don't", "x" * 40, " \t", "日本語", "🙂"]
    mixed = "".join(r.choice(words) for _ in range(30_000))
    texts = [mixed, "a" * 90_000, " " * 90_000 + "end", "word " * 20_000, mixed[:5000] + "b" * 70_000 + mixed[:5000], "short", "", None]
    got = {x.doc_id: x for x in byte_bpe.encode(docs_of(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    core = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).core
    assert max(len(t or "") for t in texts) > byte_bpe.LONG and len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == core.encode_ordinary(t or "") and got[i].n_tokens == len(got[i].ids)
    d = {x.doc_id: x.decoded for x in byte_bpe.decode(byte_bpe.encode(docs_of(spark, texts), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    assert d == {i: (t or "").encode() for i, t in enumerate(texts)}
