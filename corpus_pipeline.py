"""A training-corpus pipeline over documents: quality, near duplicates, benchmark leaks, personal data, token ids.

run() writes what each stage returns to the shared folder and reads it back as the next stage's documents. Every
stage works on all that its predecessor kept. Rows with a null doc_id cannot be named as copies or leaks and so
pass the stages that drop documents by id. Null and empty texts are scored by the classifier like any other, and are copies or
leaks of nothing. Texts of any length are taken whole; further columns are carried along, whatever their names, and an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailforge.llm import byte_bpe, line_crf, partenum, pii, spaced_seed
from trailforge.llm.common import crc_mod, release_shuffles, stored, table


def free_name(df: DataFrame, name: str) -> str:
    """name, or the like that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def short(ids: DataFrame) -> DataFrame:
    """A list of ids, to be broadcast while it has few; a longer one meets the documents in a shuffle."""
    return F.broadcast(ids) if ids.count() <= partenum.BROADCAST else ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    crf = line_crf.train(docs, table(spark, sf_dir, "labels"), crc_mod(4) == 2)
    hidden = docs.toDF(*[c if c == "text" else f"own{i}" for i, c in enumerate(docs.columns)])  # a column may be named like a result
    return line_crf.classify(hidden, crf).where("predicted = 1").select(*hidden.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of rows that share it the one with the smallest
    hash of its text, and of equal rows one. Rows that share an id but are not linked are documents of their own.
    """
    found = stored(spark, partenum.groups_of(docs).where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "text_key", "label"), "groups")
    release_shuffles(spark)
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = found.join(first, "label").withColumn("stays", F.struct("doc_id", "text_key") == F.col("first"))
    several = stored(spark, several.groupBy("doc_id", "text_key").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")), "several")
    key = free_name(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    several = several.withColumnRenamed("text_key", key)
    alone = keyed.join(short(several.where("NOT stays OR rows > 1").select("doc_id", key)), ["doc_id", key], "left_anti")
    again = keyed.join(short(several.where("stays AND rows > 1").select("doc_id", key)), ["doc_id", key], "left_semi")
    again = again.groupBy("doc_id", key).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return alone.select(*docs.columns).unionByName(again)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap a benchmark item."""
    leaks = stored(spark, spaced_seed.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(short(leaks), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces identifiers, plain and disguised, by the name of their kind."""
    return pii.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids."""
    import public_tokenizers as P

    return byte_bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", personal_data),
    ("byte-level BPE encoding", token_ids),
]

#: None of the stages' decisions can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
