"""Packing, retrieval and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import mcnemar_column
from ..functions.text import RULE_BULLET, STRATEGIES_BUCKET, evidence_tag, residual_bullet, strategy_bullet

NULL_Z = -99.0
# Fixed value: what the strategies' file says of itself.
STRATEGIES_TEXT = "Transferable rules pooled across repositories by behavioral equivalence; z is the inverse-variance pooled estimate and HET marks heterogeneous evidence across repositories."


def by_z(z: str, *ties: str) -> list:
    """Order by z, highest first; a missing z counts as -99."""
    return [F.desc(F.coalesce(F.col(z), F.lit(NULL_Z))), *ties]


def strategy_bullets(strategies: DataFrame) -> DataFrame:
    tag = evidence_tag(F.col("support_total"), F.col("pooled_z"), F.coalesce(~F.col("homogeneous"), F.lit(False)))
    n = F.row_number().over(W.orderBy(*by_z("pooled_z", "strategy_id"))) - 1  # strategies are few
    return strategies.select(F.lit(STRATEGIES_BUCKET).alias("bucket"), n.alias("pos"), "strategy_id", strategy_bullet(F.col("title"), tag, F.col("trigger"), F.col("action"), F.col("anchor_examples")).alias("bullet"))


def residual_bullets(rules: DataFrame) -> DataFrame:
    tag = evidence_tag(F.col("support"), F.col("z"), F.lit(False))
    n = F.row_number().over(W.partitionBy("repo").orderBy(*by_z("z", "pos"))) - 1
    return rules.select(F.col("repo").alias("bucket"), n.alias("pos"), residual_bullet(F.col("title"), tag, F.col("body")).alias("bullet"))


def skill_files(bullets: DataFrame, descriptions: dict[str, str] | None = None) -> DataFrame:
    """(bucket, text): front matter and bullets of one file a bucket."""
    g = bullets.groupBy("bucket").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "bullet"))), lambda s: s["bullet"]).alias("b"))
    desc = F.concat(F.lit("Repository-specific residual rules for "), "bucket", F.lit(", ordered by z score."))
    for k, v in {STRATEGIES_BUCKET: STRATEGIES_TEXT, **(descriptions or {})}.items():
        desc = F.when(F.col("bucket") == k, F.lit(v)).otherwise(desc)
    # Fixed value: the front matter.
    head = F.concat(F.lit("---\nname: "), "bucket", F.lit("\naxis: repo_convention\nn_rules: "), F.col("n").cast("string"), F.lit("\ndescription: "), desc, F.lit("\n---\n\n"))
    return g.select("bucket", F.concat(head, F.array_join("b", "\n"), F.lit("\n")).alias("text"))


def packed_ids(bullets: DataFrame) -> DataFrame:
    """(rule_id, strategy_id): ids in the packed files and what they stand for."""
    return bullets.select(F.concat("bucket", F.lit("/skill/"), F.col("pos").cast("string")).alias("rule_id"), "strategy_id")


def parse_skill_lines(lines: DataFrame) -> DataFrame:
    """Rules from lines(bucket, pos, line) of packed files; only bullets are numbered."""
    x = lines.where(F.col("line").rlike(RULE_BULLET))
    i = F.row_number().over(W.partitionBy("bucket").orderBy("pos")) - 1
    part = lambda k: F.regexp_extract("line", RULE_BULLET, k)
    support = F.coalesce(F.regexp_extract(part(2), r"support (\d+)", 1).try_cast("int"), F.lit(0))
    return x.select(F.concat("bucket", F.lit("/skill/"), i.cast("string")).alias("rule_id"), "bucket", i.alias("i"), part(1).alias("title"), support.alias("support"), part(3).alias("body"), part(2).alias("tag"))


def _all_rules(rules: DataFrame, line: Column, head: Column | None, between: str) -> DataFrame:
    """One text of all rules, bucket by bucket in the order of the files; a head stands before each bucket's first rule."""
    shown = line if head is None else F.when(F.col("i") == 0, F.concat(head, F.lit("\n"), line)).otherwise(line)
    x = rules.agg(F.sort_array(F.collect_list(F.struct("bucket", "i", shown.alias("l")))).alias("all"))  # a prompt holds them all, so they are few
    return x.select(F.array_join(F.transform("all", lambda s: s["l"]), between).alias("text"))


def render_index(rules: DataFrame) -> DataFrame:
    """One row (index): ids and titles of all rules under their buckets."""
    line = F.concat(F.lit("- ["), "rule_id", F.lit("] "), "title")
    return _all_rules(rules, line, F.concat(F.lit("### "), "bucket"), "\n").withColumnRenamed("text", "index")


def corpus_block(rules: DataFrame) -> DataFrame:
    """One row (corpus): ids, tags, titles and bodies of all rules."""
    tag = F.when(F.coalesce("tag", F.lit("")) != "", F.concat(F.lit(" ("), "tag", F.lit(")"))).otherwise("")
    line = F.concat(F.lit("["), "rule_id", F.lit("]"), tag, F.lit(" "), "title", F.lit("\n"), "body")
    return _all_rules(rules, line, None, "\n\n").withColumnRenamed("text", "corpus")


def sanitized_selection(replies: DataFrame, rules: DataFrame, top_n: int) -> DataFrame:
    """(instance_id, pos, rule_id, reason): known ids, each once, the first top_n; replies(instance_id, selected)."""
    x = replies.select("instance_id", F.posexplode("selected").alias("p", "s")).select("instance_id", "p", "s.rule_id", "s.reason").join(rules.select("rule_id"), "rule_id", "left_semi")
    x = x.withColumn("k", F.row_number().over(W.partitionBy("instance_id", "rule_id").orderBy("p"))).where("k = 1")
    x = x.withColumn("pos", F.row_number().over(W.partitionBy("instance_id").orderBy("p")))
    return x.where(F.col("pos") <= top_n).select("instance_id", "pos", "rule_id", "reason")


def skill_blocks(selection: DataFrame, rules: DataFrame) -> DataFrame:
    """(instance_id, block): ids, titles and bodies of the selected rules, in the order of selection."""
    line = F.concat(F.lit("["), F.col("rule_id").cast("string"), F.lit("] "), "title", F.lit("\n"), "body")
    x = selection.join(rules.select("rule_id", "title", "body"), "rule_id").select("instance_id", F.struct("pos", line.alias("l")).alias("s"))
    return x.groupBy("instance_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["l"]), "\n\n").alias("block"))


def selected_rules(records: DataFrame) -> DataFrame:
    """(instance_id, pos, rule_id) of retrieval records(instance_id, selected)."""
    return records.select("instance_id", F.posexplode("selected").alias("pos", "s")).select("instance_id", "pos", "s.rule_id")


def blocks_of(ids: DataFrame, records: DataFrame, rules: DataFrame) -> DataFrame:
    """(instance_id, block) of all ids, empty where nothing was selected; an id without a retrieval record is an error."""
    lost = [r[0] for r in ids.select("instance_id").join(records.select("instance_id"), "instance_id", "left_anti").take(5)]
    if lost:
        raise ValueError(f"no retrieval record for {lost}; run the retrieve stage first")
    blocks = skill_blocks(selected_rules(records), rules)
    return ids.select("instance_id").join(blocks, "instance_id", "left").select("instance_id", F.coalesce("block", F.lit("")).alias("block"))


def todo(ids: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """Work that has no output yet; an output with an error counts as done."""
    return ids.join(done.select(key), key, "left_anti")


def compare_arms(ids: DataFrame, baseline: DataFrame, treated: DataFrame) -> DataFrame:
    """One row: pass@1 of both arms over the ids, discordant counts and the exact McNemar p; arms are (instance_id) solved."""
    n = ids.agg(F.count("*").alias("n"))
    base, new = baseline.select("instance_id").distinct(), treated.select("instance_id").distinct()
    only_new = new.join(base, "instance_id", "left_anti").agg(F.count("*").alias("b"))
    only_base = base.join(new, "instance_id", "left_anti").agg(F.count("*").alias("c"))
    one = n.join(base.agg(F.count("*").alias("n_base"))).join(new.agg(F.count("*").alias("n_new"))).join(only_new).join(only_base)
    return one.select("n", F.try_divide("n_base", "n").alias("pass_base"), F.try_divide("n_new", "n").alias("pass_new"), "b", "c", mcnemar_column(F.col("b"), F.col("c")).alias("p"))


def best_reward(ids: DataFrame, rewards: DataFrame) -> DataFrame:
    """The highest reward of each task over its runs, 0 without any."""
    return ids.join(rewards, "instance_id", "left").groupBy("instance_id").agg(F.coalesce(F.max("reward"), F.lit(0.0)).alias("reward"))


def rollout_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("exit_status") == "Submitted").alias("submitted"), F.count_if(F.coalesce("patch", F.lit("")) != "").alias("with_patch"), F.sum("cost").alias("cost"))


def retrieval_totals(records: DataFrame) -> DataFrame:
    return records.agg(F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.size(F.coalesce("selected", F.array().cast(records.schema["selected"].dataType))) == 0).alias("empty"))


def stage_yield(stages: DataFrame) -> DataFrame:
    """stages(n_in, n_out) with pair_yield, 0 without input."""
    return stages.withColumn("pair_yield", F.coalesce(F.try_divide("n_out", "n_in"), F.lit(0.0)))


def outcome_counts(transcript: DataFrame) -> DataFrame:
    return transcript.groupBy("stage", "sub", "outcome").agg(F.count("*").alias("n"))


def predictions(results: DataFrame) -> DataFrame:
    """The last patch of each instance."""
    return results.groupBy("instance_id").agg(F.max_by(F.struct("model", "patch"), "pos").alias("r")).select("instance_id", "r.model", "r.patch")


def with_condition(blocks: DataFrame, condition: str) -> DataFrame:
    """Blocks for an arm: the baseline gets an empty one."""
    return blocks.withColumn("block", F.when(F.lit(condition) == "baseline", F.lit("")).otherwise(F.col("block")))
