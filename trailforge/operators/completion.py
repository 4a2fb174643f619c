"""Calls to language models as a join of prompts with a table of replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Requests with model, system and user in, the same rows with the columns of a reply out.
Responder = Callable[[DataFrame], DataFrame]
# Fixed value: characters of a prompt that a transcript shows.
PREVIEW = 300
REPLY = "prompt_key string, text string, in_tokens int, out_tokens int, finish_reason string"


def prompt_key(model: Column, system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", model, system, user), 256)


def replay(requests: DataFrame, replies: DataFrame, at: tuple[str, ...] = ()) -> DataFrame:
    """requests(model, system, user, ...) with the stored reply to each; without one the reply columns are null.

    Replies hold for a prompt wherever it is asked, or with `at` for the request that has the same values in those columns of both.
    """
    keyed = requests.withColumn("prompt_key", prompt_key(F.col("model"), F.col("system"), F.col("user")))
    return keyed.join(replies, ["prompt_key", *at], "left")


def live(requests: DataFrame, call: Callable[[str, str, str], tuple[str, int, int, str]], attempts: int = 4, wait: float = 2.0) -> DataFrame:
    """Replies by a function (model, system, user) -> (text, tokens in, tokens out, finish reason), with linear back-off."""
    keyed = requests.select(prompt_key(F.col("model"), F.col("system"), F.col("user")).alias("prompt_key"), "model", "system", "user").dropDuplicates(["prompt_key"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for p in parts:
            out = []
            for r in p.itertuples():
                for k in range(attempts):
                    try:
                        out.append((r.prompt_key, *call(r.model, r.system, r.user)))
                        break
                    except (ConnectionError, TimeoutError):
                        if k + 1 == attempts:
                            raise
                        time.sleep(wait * (k + 1))
            yield pd.DataFrame(out, columns=["prompt_key", "text", "in_tokens", "out_tokens", "finish_reason"])

    return keyed.mapInPandas(run, REPLY)


def replaying(replies: DataFrame) -> Responder:
    """Answers from a table of replies; requests without one get nulls."""
    return lambda requests: replay(requests, replies).drop("prompt_key")


def calling(call: Callable[[str, str, str], tuple[str, int, int, str]], attempts: int = 4, wait: float = 2.0) -> Responder:
    """Answers by a function, each distinct prompt once."""
    return lambda requests: replay(requests, live(requests, call, attempts, wait)).drop("prompt_key")


def cost_rows(answered: DataFrame, stage: str, extra: Column) -> DataFrame:
    """(ts, stage, sub, model, in_tokens, out_tokens, extra) of every reply that came; extra is a struct, shown as JSON."""
    return answered.where("text IS NOT NULL").select(F.current_timestamp().alias("ts"), F.lit(stage).alias("stage"), "sub", "model", "in_tokens", "out_tokens", F.to_json(extra).alias("extra"))


def transcript_rows(answered: DataFrame, stage: str, parsed: Column, accepted: Column, reason: Column) -> DataFrame:
    """One row a reply: what was asked, what came back and what the guard said."""
    outcome = F.when(~parsed, "parse_fail").when(accepted, "accepted").otherwise(F.concat(F.lit("guard_fail:"), reason))
    return answered.select(
        F.current_timestamp().alias("ts"), F.lit(stage).alias("stage"), "sub", "pair_id", "attempt", outcome.alias("outcome"), F.length("user").alias("prompt_user_chars"),
        F.substring("user", 1, PREVIEW).alias("prompt_user_preview"), F.col("text").alias("response"), parsed.alias("parse_ok"), (parsed & accepted).alias("guard_ok"),
        F.when(parsed & accepted, "").otherwise(reason).alias("guard_reason"),
    )


def split_truncated(batches: DataFrame) -> DataFrame:
    """Next round of batches(batch, members, finish_reason): a cut-off batch comes back in halves, one of a single member is dropped."""
    half = F.ceil(F.size("members") / 2).cast("int")
    cut = batches.where("finish_reason = 'length' AND size(members) > 1")
    parts = F.array(F.slice("members", F.lit(1), half), F.slice("members", half + 1, F.size("members")))
    return cut.select("batch", F.posexplode(parts).alias("half", "members")).select(F.concat_ws(".", "batch", F.col("half").cast("string")).alias("batch"), "members")
