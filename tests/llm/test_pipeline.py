import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailforge.llm import line_crf, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, text_key string"


def prose(r, n=40):
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(10)) + "." for _ in range(n // 10))


WORDS = [f"{a}{b}" for a in ("al", "be", "ga", "de", "ep", "ze", "et", "th", "io", "ka") for b in ("ra", "mo", "ni", "tu", "vel", "son", "lin", "dor", "mir", "nak")]
JUNK = "\n".join("$$$ ### 00 %%% @@@ ^^^ &&&" for _ in range(6))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    rows = []
    for i in range(160):
        rows.append([i, JUNK + f"\n{i}" if i % 4 == 0 else prose(r)])
    bench = [(k, " ".join(r.choice(WORDS) for _ in range(30))) for k in range(3)]
    good = [i for i in range(160) if i % 4]
    rows[good[5]][1] = rows[good[2]][1]  # an exact copy
    rows[good[9]][1] = rows[good[7]][1] + " one more word."  # a near copy
    rows[good[11]][1] += "\n" + bench[1][1] + "."  # a leak
    rows[good[13]][1] += "\nwrite to someone@example.org or john dot doe at mail dot com."
    rows += [[good[15], prose(r)], [good[17], rows[good[17]][1]], [None, rows[good[2]][1]], [1000, ""], [1001, None]]
    top = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", "k") for i, t in rows], SCHEMA).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(0, 160) if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
    return str(top), rows, good


def test_pipeline_against_brute_force(spark, folder):
    import public_tokenizers as P
    from trailforge.llm import byte_bpe

    sf, rows, good = folder
    docs = corpus_pipeline.table(spark, sf, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns, name
        kept = corpus_pipeline.stored(spark, out, "test")
    assert {(r.score, r.text_key) for r in kept.select("score", "text_key").distinct().collect()} == {("own", "k")}

    crf = line_crf.train(docs, corpus_pipeline.table(spark, sf, "labels"), corpus_pipeline.crc_mod(4) == 2)
    score = crf.score([t or "" for _, t in rows])
    left = [(i, t) for (i, t), s in zip(rows, score) if s >= 0.7]
    assert {i for i, _ in left} >= set(good) and not any(i is not None and i < 160 and i % 4 == 0 for i, _ in left)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in left]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    stays = []
    for g in dict.fromkeys(group):
        mine = [left[k] for k in range(len(left)) if group[k] == g]
        stays += [x for x in mine if x[0] is None] + ([min((x for x in mine if x[0] is not None), key=lambda x: x[0])] if any(x[0] is not None for x in mine) else [])
    stays = [x for x in stays if x[0] != good[11]]
    want = sorted(((i, t if t is None else pii.redact(t, pii.find_spans(t)[1])) for i, t in stays), key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    assert any(t and "[EMAIL]" in t for _, t in want) and all(r.n_chars == len(r.text or "") for r in kept.collect())

    ids = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    core = byte_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).core
    assert sorted(((r.doc_id, list(r.ids)) for r in ids), key=str) == sorted(((i, core.encode_ordinary(t or "")) for i, t in want), key=str)


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    sf, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
