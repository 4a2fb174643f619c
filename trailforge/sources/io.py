"""Readers and writers."""

from __future__ import annotations

import copy
import json
import os
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicate import validate
from ..functions.text import repo_of

POOL = "instance_id string, repo string, agent string, model string, outcome string, steps array<struct<kind:string,content:string,command:string>>, submission_id string, source_path string, traj_id string, pos bigint"


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): trimmed lines, without blank ones and those that begin with #."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")))
    return lines.select(F.trim("value").alias("value")).where("value <> ''")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, instance_id, doc VARIANT) of raw trajectory files, one JSON document each."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_path"), F.parse_json("value").alias("doc"))
    return raw.withColumn("instance_id", F.try_variant_get("doc", "$.instance_id", "string"))


def truthy(v: Column) -> Column:
    """Whether a JSON value is neither null, false, zero nor empty."""
    shown = F.coalesce(F.to_json(v), F.lit("null"))
    return F.when(shown.rlike("^-?[0-9]"), F.coalesce(shown.try_cast("double"), F.lit(0.0)) != 0).otherwise(~shown.isin("null", "false", '""', "[]", "{}"))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(instance_id, outcome) of a label file: a JSON map of records, passed if resolved holds; a file that isn't there is an error."""
    doc = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.parse_json("value"), "$", "map<string,variant>").alias("m"))
    passed = F.coalesce(truthy(F.try_variant_get("r", "$.resolved", "variant")), F.lit(False))
    return doc.select(F.explode("m").alias("instance_id", "r")).select("instance_id", F.when(passed, "pass").otherwise("fail").alias("outcome"))


def ingest(raw: DataFrame, outcomes: DataFrame, submission_id: str, strict: bool = True) -> DataFrame:
    """Raw trajectories with their outcomes; in strict mode every one needs an outcome, else those without are left out."""
    if strict:
        lost = [r[0] for r in raw.join(outcomes, "instance_id", "left_anti").select("instance_id").take(5)]
        if lost:
            raise ValueError(f"no outcome for {lost}")
    x = raw.join(outcomes, "instance_id")
    return x.select("instance_id", repo_of(F.col("instance_id")).alias("repo"), "outcome", F.lit(submission_id).alias("submission_id"), "source_path", F.concat_ws("::", F.lit(submission_id), "instance_id").alias("traj_id"), "doc")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POOL).json(path)


def write_pool(pool: DataFrame, path: str) -> None:
    pool.write.mode("overwrite").partitionBy("submission_id").json(path)


def last_of(rows: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """One row a key, the last."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def find_trajectory(pool: DataFrame, traj_id: str) -> DataFrame:
    """A trajectory by id; its submission, the text before ::, prunes the partitions read."""
    return pool.where((F.col("submission_id") == traj_id.split("::")[0]) & (F.col("traj_id") == traj_id))


def missing_keys(listing: DataFrame, existing: DataFrame, suffix: str) -> DataFrame:
    """Keys of an object listing still to be fetched."""
    return listing.where(F.endswith("key", F.lit(suffix))).join(existing.select("key"), "key", "left_anti")


def resolve_instances(ids: DataFrame, dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instances with an image tag, in the order of the ids, and the ids that have none."""
    x = ids.join(dataset, "instance_id", "left")
    tagged = F.trim(F.coalesce("image_tag", F.lit(""))) != ""
    return x.where(tagged).orderBy("pos"), x.where(~tagged).select("instance_id")


RULES = "rule_id string, title string, body string, category string, support int, source_pair_ids array<string>, predicate string, validation struct<status:string,z:double,lift:double>"


def read_rules(spark: SparkSession, root: str) -> DataFrame:
    """Rules of a tree of JSON lines, the bucket being the name of the folder.

    A predicate that doesn't parse becomes null; z and lift are those of a scored validation.
    """

    @F.pandas_udf("boolean")
    def parses(texts: pd.Series) -> pd.Series:
        good = {t: validate(t) is None for t in texts.dropna().unique()}
        return texts.map(good).astype("boolean")

    x = spark.read.schema(RULES).option("recursiveFileLookup", True).json(root).withColumn("bucket", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    scored = F.col("validation.status") == "scored"
    kept = F.when(F.coalesce(parses(F.nullif("predicate", F.lit(""))), F.lit(False)), F.col("predicate"))
    return x.select(
        "bucket", "rule_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("support", F.lit(0)).alias("support"),
        "source_pair_ids", kept.alias("predicate"), F.when(scored, F.col("validation.z")).alias("z"), F.when(scored, F.col("validation.lift")).alias("lift"),
    )


def read_skill_lines(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, pos, line) of the packed files below root, one SKILL.md a bucket."""
    text = spark.read.text(f"{root}/{SKILLS}/*/SKILL.md", wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("bucket"), "value")
    return text.select("bucket", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


# Fixed value: the folder of the packed files.
SKILLS = "repo_conventions"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One text file in any store that Spark writes to, in place of what was there."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_skill_files(files: DataFrame, root: str, ids: DataFrame | None = None) -> int:
    """(bucket, text) as SKILL.md files below root, in place of all that was there, and (rule_id, strategy_id) as packed_ids.json.

    There is a file a repository, so they are written one by one from the driver, which holds one at a time.
    """
    spark = files.sparkSession
    rows = files.select("bucket", "text").toLocalIterator()
    fs, p = _file_system(spark, root)
    first = next(rows, None)  # the input is computed before the old files go
    fs.delete(p, True)
    n = 0
    while first is not None:
        write_file(spark, f"{root}/{SKILLS}/{first.bucket}/SKILL.md", first.text)
        first, n = next(rows, None), n + 1
    if ids is not None:
        pairs = ids.where("strategy_id IS NOT NULL").select("rule_id", "strategy_id").collect()  # one a strategy, of which there are few
        order = sorted(pairs, key=lambda r: int(r.rule_id.rsplit("/", 1)[1]))
        write_file(spark, f"{root}/packed_ids.json", json.dumps({r.rule_id: r.strategy_id for r in order}, indent=1))
    return n


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again, so that it is worked out once and survives lost executors.

    The folder is the cluster's spark.checkpoint.dir; a session on one machine may go without and gets a temporary one.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def merged(base: dict, over: dict) -> dict:
    """A configuration with another laid over it, level by level."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


# Defaults of the stages.
DEFAULTS = {
    "models": {"skill_learning": "deepseek/deepseek-v4-pro", "backbone": "deepseek/deepseek-v4-flash"},
    "pair": {"K": 4},
    "discover": {"workers": 16, "retry_on_guard_reject": 1, "rule_max_chars": 1000, "occurrence_bounds": [0.10, 0.90]},
    "merge": {"batch_size": 32},
    "judge": {"required_dims": ["is_discipline", "not_repo_conflicting"], "workers": 16},
    "audit": {"ngram": 6},
    "generalize": {"knn": 15, "min_fires": 20, "heterogeneity_alpha": 0.10, "workers": 12, "embedding_model": "all-MiniLM-L6-v2"},
    "retrieval": {"top_n": 3, "workers": 16, "issue_max_chars": 6000},
    "rollout": {"workers": 16},
}


def load_config(path: str | None = None) -> dict:
    """The defaults with those of a YAML file laid over them; without a file they are as they stand."""
    base = copy.deepcopy(DEFAULTS)
    if not path or not os.path.exists(path):
        return base
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("a configuration file needs PyYAML") from e
    with open(path) as f:
        return merged(base, yaml.safe_load(f) or {})
