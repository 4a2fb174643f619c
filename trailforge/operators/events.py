"""Raw messages to steps, and steps to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.commands import classify_command, split_compound

MESSAGES = "array<variant>"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def command_of(tool_calls: Column) -> Column:
    """The command of the first tool call whose JSON arguments hold one; calls that don't parse are passed over."""
    found = F.transform(F.coalesce(tool_calls, F.array().cast("array<string>")), lambda a: _get(F.try_parse_json(a), "$.command"))
    return F.try_element_at(F.filter(found, lambda c: F.coalesce(c, F.lit("")) != ""), F.lit(1))


def model_of(doc: Column, submission_id: Column) -> Column:
    """Model of a raw trajectory: a string, an object's model_name, or the text behind the submission's second "_"."""
    named = F.coalesce(F.nullif(_get(doc, "$.info.config.model.model_name"), F.lit("")), F.when(F.schema_of_variant(F.coalesce(F.try_variant_get(doc, "$.info.config.model", "variant"), F.parse_json(F.lit("null")))) == "STRING", _get(doc, "$.info.config.model")))
    return F.coalesce(named, F.regexp_replace(submission_id, "^[^_]*_[^_]*_", ""))


def steps_of(raw: DataFrame) -> DataFrame:
    """(traj_id, pos, kind, content, command) from raw(traj_id, doc VARIANT), for both message dialects.

    A message with a role is an action if an assistant wrote it and the next message is a tool's, a thought
    without that, an observation from user or tool, and nothing otherwise. A message without a role and with a
    list as output is an action if it calls a function; a function's output is an observation.
    """
    m = raw.select("traj_id", F.posexplode(F.try_variant_get("doc", "$.messages", MESSAGES)).alias("pos", "m"))
    role, kind = _get(F.col("m"), "$.role"), _get(F.col("m"), "$.type")
    items = F.try_variant_get("m", "$.output", MESSAGES)
    m = m.select(
        "traj_id", "pos", role.alias("role"), kind.alias("type"), items.alias("items"), _get(F.col("m"), "$.content").alias("content"), _get(F.col("m"), "$.output").alias("output"), _get(F.col("m"), "$.extra.raw_output").alias("raw_output"),
        F.transform(F.try_variant_get("m", "$.tool_calls", MESSAGES), lambda c: _get(c, "$.function.arguments")).alias("calls"),
    )
    m = m.withColumn("next", F.lead("role").over(W.partitionBy("traj_id").orderBy("pos")))
    turn = F.col("role").isNull() & F.col("items").isNotNull()
    said = F.flatten(F.transform(F.filter("items", lambda i: _get(i, "$.type") == "message"), lambda i: F.coalesce(F.transform(F.try_variant_get(i, "$.content", MESSAGES), lambda p: F.coalesce(_get(p, "$.text"), F.lit(""))), F.array().cast("array<string>"))))
    called = F.transform(F.filter("items", lambda i: _get(i, "$.type") == "function_call"), lambda i: F.coalesce(_get(i, "$.arguments"), F.lit("")))
    m = m.withColumn("called", F.when(turn, called).otherwise(F.col("calls")))
    text = F.array_join(F.filter(said, lambda s: s != ""), "\n")
    step = (
        F.when(turn, F.when(F.size("called") > 0, "action").otherwise("thought"))
        .when(F.col("role").isNull() & (F.col("type") == "function_call_output"), "observation")
        .when(F.col("role") == "assistant", F.when(F.col("next") == "tool", "action").otherwise("thought"))
        .when(F.col("role").isin("user", "tool"), "observation")
    )
    content = F.when(turn, F.when(text == "", "None").otherwise(text)).when(F.col("role").isNull(), F.coalesce(F.nullif("output", F.lit("")), "raw_output", F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    kept = m.withColumn("kind", step).withColumn("content", content).where("kind IS NOT NULL")
    idx = F.row_number().over(W.partitionBy("traj_id").orderBy("pos")) - 1
    return kept.select("traj_id", idx.alias("step_idx"), "kind", "content", F.when(F.col("kind") == "action", command_of(F.col("called"))).alias("command"))


def next_role_steps(messages: DataFrame, traj: str, order: str, role: str, answer: str) -> DataFrame:
    """Step kinds of a flat message table: an assistant's message is an action when the next is by answer."""
    nxt = F.lead(role).over(W.partitionBy(traj).orderBy(order))
    kind = F.when(F.col(role) == "assistant", F.when(nxt == answer, "action").otherwise("thought")).when(F.col(role).isin("user", "tool"), "observation")
    return messages.withColumn("kind", kind).where("kind IS NOT NULL")


def extract_events(steps: DataFrame) -> DataFrame:
    """events(traj_id, i, step_idx, action_type, target, command) of action steps.

    Commands are cut into parts; each kind of part counts once a step, where it first stands.
    """
    parts = steps.where("kind = 'action' AND command IS NOT NULL").select("traj_id", "step_idx", "command", F.posexplode(split_compound(F.col("command"))).alias("part", "cmd"))
    seen = parts.withColumn("e", classify_command(F.col("cmd"))).where("e IS NOT NULL").select("traj_id", "step_idx", "part", "command", "e.action_type", "e.target")
    once = seen.groupBy("traj_id", "step_idx", "action_type", "target").agg(F.min("part").alias("part"), F.first("command").alias("command"))
    i = F.row_number().over(W.partitionBy("traj_id").orderBy("step_idx", "part")) - 1
    return once.select("traj_id", i.alias("i"), "step_idx", "action_type", "target", "command")


def excerpt(steps: DataFrame, max_chars: int, max_step_chars: int = 800) -> DataFrame:
    """(traj_id, excerpt): steps as lines until the budget is used, then a line that says so."""
    body = F.trim("content")
    body = F.when(F.length(body) > max_step_chars, F.concat(F.substring(body, 1, max_step_chars), F.lit("…"))).otherwise(body)
    line = F.concat(F.lit("["), F.col("step_idx").cast("string"), F.lit(" "), F.col("kind"), F.lit("] "), body)
    w = W.partitionBy("traj_id").orderBy("step_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = steps.select("traj_id", "step_idx", line.alias("line")).withColumn("used", F.sum(F.length("line") + 1).over(w))
    kept = F.sort_array(F.collect_list(F.when(F.col("used") <= max_chars, F.struct("step_idx", "line"))))
    cut = F.when(F.max("used") > max_chars, F.lit("\n... (truncated)")).otherwise(F.lit(""))
    return lines.groupBy("traj_id").agg(F.concat(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"), cut).alias("excerpt"))


def steps_window(steps: DataFrame, start: int, max_chars: int) -> DataFrame:
    """The excerpt from a step on; lines keep their own step numbers."""
    return excerpt(steps.where(F.col("step_idx") >= start), max_chars)


def submitted_patch(raw: DataFrame) -> DataFrame:
    """(traj_id, patch) from raw trajectories, "" where there is none."""
    return raw.select("traj_id", F.coalesce(_get(F.col("doc"), "$.info.submission"), F.lit("")).alias("patch"))
