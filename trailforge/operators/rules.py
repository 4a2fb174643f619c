"""Candidate rules: guards, routing, merging, judging and auditing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicate import validate
from ..functions.text import anchored, first_index, overlap_hits, single_bug_fact, slug_of_pair

# Fixed values.
KINDS = ("action", "fact")
CATEGORIES = ("lookup", "verification", "replay", "search_recipe")
ANALYSTS = ("skipped_step", "discipline_observer", "process_delta")
ALL_JUDGE_DIMS = ("is_discipline", "not_redundant_with_prior", "behavior_actionable", "not_repo_conflicting")
JUDGE_DIMS = ("is_discipline", "not_repo_conflicting")
MAX_CHARS, MERGE_BATCH = 1000, 32
TITLE_MAX, BODY_MAX = 120, 600
OCCURRENCE = (0.10, 0.90)


def evidence_ok(analyst: Column, ev: Column) -> Column:
    """Whether the evidence struct holds what its analyst has to cite."""
    need = {
        "skipped_step": ("fail_traj_id", "skipped_step_index", "gold_patch_hunk_ref"),
        "discipline_observer": ("pass_traj_id",),
        "process_delta": ("fail_traj_id", "pass_traj_id", "skipped_step_index", "cited_pass_step_index"),
    }
    out = F.lit(False)
    for name, fields in need.items():
        have = F.lit(True)
        for f in fields:
            have = have & ev[f].isNotNull()
        out = F.when(analyst == name, have).otherwise(out)
    return out


def coerced_evidence(ev: Column) -> Column:
    """Step references become the first integer that they hold."""
    return F.struct(
        ev["fail_traj_id"].alias("fail_traj_id"), ev["pass_traj_id"].alias("pass_traj_id"), first_index(ev["skipped_step_index"]).alias("skipped_step_index"),
        first_index(ev["cited_pass_step_index"]).alias("cited_pass_step_index"), ev["gold_patch_hunk_ref"].alias("gold_patch_hunk_ref"),
    )


def predicate_errors(candidates: DataFrame) -> DataFrame:
    """(predicate, error) of the distinct predicates, error null for good ones; parsed once each."""

    @F.pandas_udf("string")
    def errors(texts: pd.Series) -> pd.Series:
        return pd.Series([validate(t) for t in texts], dtype="object")

    return candidates.select("predicate").where("trim(coalesce(predicate, '')) <> ''").distinct().withColumn("error", errors("predicate"))


def guard(candidates: DataFrame, rates: DataFrame | None = None, max_chars: int = MAX_CHARS, bounds: tuple[float, float] = OCCURRENCE) -> DataFrame:
    """candidates with the first reason against them, null for good ones; a fact's invalid predicate is dropped.

    rates(predicate, rate), where given, bounds how often an action's predicate may hold.
    """
    x = candidates.join(predicate_errors(candidates), "predicate", "left")
    x = x.join(rates, "predicate", "left") if rates is not None else x.withColumn("rate", F.lit(None).cast("double"))
    rule, pred = F.col("rule"), F.trim(F.coalesce("predicate", F.lit("")))
    action = F.col("kind") == "action"
    rate = F.coalesce("rate", F.lit(0.0))
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "bad_kind"),
        F.when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "bad_category"),
        F.when(F.trim(F.coalesce(rule, F.lit(""))) == "", "empty_rule"),
        F.when(F.length(rule) > max_chars, "too_long"),
        F.when(action & single_bug_fact(rule, F.col("category")), "anti_fact"),
        F.when(action & (pred == ""), "predicate_missing"),
        F.when(action & F.col("error").isNotNull(), F.concat(F.lit("predicate_parse: "), "error")),
        *([F.when(action & ~rate.between(*bounds), F.concat(F.lit("predicate_occurrence: "), F.format_number(rate, 2), F.lit(f" outside [{bounds[0]:.2f}, {bounds[1]:.2f}]")))] if rates is not None else []),
        F.when(~action & ~anchored(rule), "fact_unanchored"),
    )
    kept = F.when(action, F.col("predicate")).when((pred != "") & F.col("error").isNull(), F.col("predicate"))
    return x.withColumn("reason", reason).withColumn("predicate", kept).select(*candidates.columns, "reason")


def route(candidates: DataFrame) -> DataFrame:
    """candidates with the bucket of their pair's repo."""
    return candidates.withColumn("bucket", slug_of_pair(F.col("pair_id")))


def batches(rows: DataFrame, by: list[str], order: str, size: int = MERGE_BATCH) -> DataFrame:
    """rows with the number of their batch of consecutive rows."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1) / size).cast("long"))


def halves(members: Column) -> Column:
    """The first half of an array, the smaller one, and the rest."""
    half = F.floor(F.size(members) / 2).cast("int")
    return F.array(F.slice(members, F.lit(1), half), F.slice(members, half + 1, F.size(members)))


def representative_predicate(rows: DataFrame, by: list[str]) -> DataFrame:
    """The most frequent predicate that is not blank, first seen on ties."""
    c = rows.where("trim(coalesce(predicate, '')) <> ''").groupBy(*by, "predicate").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return c.groupBy(*by).agg(F.max_by("predicate", F.struct("n", (-F.col("first")).alias("f"))).alias("predicate"))


def replies_to_rules(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rules of merge replies(bucket, category, batch, pos, title, body, indices) with support from their indices.

    Indices outside the batch count for nothing, repeated ones count again; rules beyond the length limits go.
    """
    c = candidates.select("bucket", "category", "batch", F.col("idx"), "pair_id", "predicate", F.col("pos").alias("cpos"))
    x = replies.select("*", F.posexplode("indices").alias("k", "idx")).join(c, ["bucket", "category", "batch", "idx"])
    pred = representative_predicate(x.withColumn("pos", F.col("cpos")), ["bucket", "category", "batch", "title"]).withColumnRenamed("predicate", "top")
    g = x.groupBy("bucket", "category", "batch", "title").agg(F.first("body").alias("body"), F.min("pos").alias("pos"), F.count("*").alias("support"), F.transform(F.sort_array(F.collect_list(F.struct("k", "pair_id"))), lambda s: s["pair_id"]).alias("source_pair_ids"))
    g = g.where(F.length("title").between(1, TITLE_MAX) & F.length("body").between(1, BODY_MAX))
    return g.join(pred, ["bucket", "category", "batch", "title"], "left").withColumnRenamed("top", "predicate")


def fold_titles(rules: DataFrame) -> DataFrame:
    """Rules of a bucket and category with the same title, case aside, folded into one, ordered by support.

    First title, longest body (earliest on ties), summed support, all source pairs in order, first predicate.
    """
    keys = ["bucket", "category"]
    g = rules.groupBy(*keys, F.lower("title").alias("fold")).agg(
        F.min_by("title", "pos").alias("title"), F.max_by("body", F.struct(F.length("body").alias("l"), (-F.col("pos")).alias("p"))).alias("body"), F.sum("support").alias("support"),
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source_pair_ids"))), lambda s: s["source_pair_ids"])).alias("source_pair_ids"),
        F.min_by("predicate", F.when(F.coalesce("predicate", F.lit("")) != "", F.col("pos"))).alias("predicate"), F.min("pos").alias("first"),
    )
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("support"), "first")) - 1
    return g.withColumn("rule_id", F.concat_ws(":", "bucket", "category", n.cast("string"))).select("rule_id", *keys, "title", "body", "support", "source_pair_ids", "predicate")


def judged(log: DataFrame, dims: tuple[str, ...] = JUDGE_DIMS) -> DataFrame:
    """(rule_id, keep) of the last verdict on each rule: all dims have to be 1; one that failed counts as its keep says.

    log(rule_id, pos, decision map, error).
    """
    last = log.groupBy("rule_id").agg(F.max_by(F.struct("decision", "error", "keep"), "pos").alias("d"))
    every = F.lit(True)
    for x in dims:
        every = every & (F.coalesce(F.try_element_at("d.decision", F.lit(x)).try_cast("int"), F.lit(0)) == 1)
    return last.select("rule_id", F.when(F.col("d.error").isNotNull() | F.col("d.decision").isNull(), F.coalesce("d.keep", F.lit(False))).otherwise(every).alias("keep"))


def to_judge(rules: DataFrame, log: DataFrame) -> DataFrame:
    """Rules without a verdict yet."""
    return rules.join(log.select("rule_id"), "rule_id", "left_anti")


def kept_rules(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rules whose verdict keeps them; without a verdict they go."""
    return rules.join(verdicts.where("keep"), "rule_id", "left_semi")


def audit(rules: DataFrame, pairs: DataFrame, patches: DataFrame, n: int = 6) -> DataFrame:
    """(rule_id, flagged, n_hits, hits): n-grams that a rule shares with the patches behind it, the first ten listed."""
    src = rules.select("rule_id", "body", F.explode("source_pair_ids").alias("pair_id")).join(pairs.select("pair_id", F.col("pass_traj_id").alias("traj_id")), "pair_id")
    hit = src.join(patches, "traj_id").select("rule_id", F.explode(overlap_hits(F.col("body"), F.col("patch"), n)).alias("hit")).distinct()
    found = hit.groupBy("rule_id").agg(F.count("*").alias("n_hits"), F.slice(F.array_sort(F.collect_set("hit")), 1, 10).alias("hits"))
    out = rules.select("rule_id").join(found, "rule_id", "left")
    return out.select("rule_id", F.col("n_hits").isNotNull().alias("flagged"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("hits", F.array().cast("array<string>")).alias("hits"))
