"""Stratified effect of a rule on held-out runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import fires, validate
from ..functions.stats import Z95


def strata(labeled: DataFrame, by: list[str]) -> DataFrame:
    """2x2 counts of each issue: a of n1 runs that fire passed, c of n0 others did."""
    fire, ok = F.col("fires"), F.col("passed")
    return labeled.groupBy(*by, "instance_id").agg(
        F.count_if(fire & ok).alias("a"), F.count_if(fire).alias("n1"), F.count_if(~fire & ok).alias("c"), F.count_if(~fire).alias("n0")
    )


def mh_risk_difference(s: DataFrame, by: list[str]) -> DataFrame:
    """Mantel-Haenszel risk difference with Sato's variance, over strata with both kinds of runs."""
    a, n1, c, n0 = (F.col(x).cast("double") for x in ("a", "n1", "c", "n0"))
    n = n1 + n0
    used = (F.col("n1") > 0) & (F.col("n0") > 0)

    def total(x: Column) -> Column:
        return F.sum(F.when(used, F.try_divide(x, n)).otherwise(0.0))

    sums = s.groupBy(*by).agg(
        total(n1 * n0).alias("w"), total(a * n0 - c * n1).alias("d"),
        F.sum(F.when(used, F.try_divide(n1 * n1 * c - n0 * n0 * a + n1 * n0 * (n0 - n1) / 2, n * n)).otherwise(0.0)).alias("p"),
        (total(a * (n0 - c) + c * (n1 - a)) / 2).alias("q"),
        F.count_if(used).alias("n_strata_used"), F.count_if(~used).alias("n_strata_empty"), F.sum(F.col("n1") + F.col("n0")).alias("n_labeled"), F.try_divide(F.sum(n1), F.sum(n)).alias("occurrence"),
    )
    lift = F.try_divide(F.col("d"), F.col("w"))
    se = F.sqrt(F.greatest(F.try_divide(lift * F.col("p") + F.col("q"), F.col("w") * F.col("w")), F.lit(0.0)))
    out = sums.withColumn("lift", lift).withColumn("se", F.when(lift.isNotNull(), se))
    return out.withColumn("ci_low", F.col("lift") - Z95 * F.col("se")).withColumn("ci_high", F.col("lift") + Z95 * F.col("se")).drop("w", "d", "p", "q")


def stratified_lift(labeled: DataFrame, by: list[str]) -> DataFrame:
    return mh_risk_difference(strata(labeled, by), by)


def excluded_runs(rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule_id, traj_id): both sides of a rule's source pairs; unknown pair ids are passed over."""
    src = rules.select("rule_id", F.explode("source_pair_ids").alias("pair_id")).join(pairs.select("pair_id", "fail_traj_id", "pass_traj_id"), "pair_id")
    return src.select("rule_id", F.explode(F.array("fail_traj_id", "pass_traj_id")).alias("traj_id")).distinct()


def mixed_issues(pool: DataFrame) -> DataFrame:
    """(instance_id, repo) of issues with both outcomes; the repo is that of the issue's last run."""
    g = pool.groupBy("instance_id").agg(F.max_by("repo", "pos").alias("repo"), F.bool_or(F.col("outcome") == "pass").alias("p"), F.bool_or(F.col("outcome") == "fail").alias("f"))
    return g.where("p AND f").select("instance_id", "repo")


def holdout(rules: DataFrame, pool: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule_id, traj_id, instance_id, passed): runs of the mixed issues of a rule's repo, without its sources."""
    runs = pool.where("outcome IN ('pass', 'fail')").select("traj_id", "instance_id", (F.col("outcome") == "pass").alias("passed"))
    runs = runs.join(mixed_issues(pool), "instance_id")
    mine = rules.select("rule_id", "repo").join(runs, "repo").drop("repo")
    return mine.join(excluded_runs(rules, pairs), ["rule_id", "traj_id"], "left_anti")


#: Predicates that are evaluated in one pass over the events; more are taken in several, so that a plan's size is bounded.
GROUP = 64


def score_rules(rules: DataFrame, pool: DataFrame, pairs: DataFrame, events: DataFrame) -> DataFrame:
    """rules with a struct validation; a rule without an effect gets the reason and is kept.

    rules(rule_id, repo, predicate, source_pair_ids): only its distinct predicates come to the driver, to be parsed.
    """
    spark = rules.sparkSession
    texts = sorted(r[0] for r in rules.select("predicate").where("coalesce(predicate, '') <> ''").distinct().toLocalIterator())
    errors = {t: e for t in texts if (e := validate(t))}
    good = [t for t in texts if t not in errors]
    held = holdout(rules, pool, pairs)
    fired = spark.createDataFrame([], "rule_id string, traj_id string").select("rule_id", F.col("traj_id").cast(pool.schema["traj_id"].dataType).alias("traj_id"))
    for at in range(0, len(good), GROUP):
        fired = fired.unionByName(fires(pool, events, {t: t for t in good[at : at + GROUP]}))
    labeled = held.join(rules.select("rule_id", "predicate"), "rule_id")
    labeled = labeled.join(fired.select(F.col("rule_id").alias("predicate"), "traj_id", F.lit(True).alias("fires")), ["predicate", "traj_id"], "left")
    effect = stratified_lift(labeled.withColumn("fires", F.coalesce("fires", F.lit(False))), ["rule_id"])
    wrong = spark.createDataFrame([(t, f"predicate_error: {e}") for t, e in errors.items()], "predicate string, message string")
    rules_ = rules.join(wrong, "predicate", "left")
    message = F.col("message")
    out = rules_.join(effect, "rule_id", "left")
    reason = (
        F.when(F.coalesce("predicate", F.lit("")) == "", "no_predicate").when(message.isNotNull(), message).when(F.col("lift").isNull(), "no_usable_strata").when(F.coalesce("se", F.lit(0.0)) <= 0, "zero_se")
    )
    out = out.withColumn("reason", reason)
    ok = F.col("reason").isNull()
    rounded = [F.when(ok, F.round(c, 4)).alias(c) for c in ("lift", "se", "ci_low", "ci_high", "occurrence")]
    record = F.struct(
        F.when(ok, "scored").otherwise("fallback").alias("status"), "reason", F.when(ok, F.round(F.try_divide("lift", "se"), 4)).alias("z"), *rounded, *(F.when(ok, F.col(c)).alias(c) for c in ("n_strata_used", "n_strata_empty", "n_labeled"))
    )
    return out.select(*rules.columns, record.alias("validation"))
