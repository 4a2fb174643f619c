"""python -m trailforge.cli STAGE ...: one stage of the trajectory workflow over tables in Parquet.

Tables are read by name from --data; the stages that ask a language model read its replies from --replies (prompt_key, text,
in_tokens, out_tokens, finish_reason) and their system prompts from --prompts, a JSON object. Without a reply for a prompt, the prompts
that lack one are what --out/requests holds after discover, merge, judge, generalize and retrieve.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import completion, events, pairing, reports, rules, score
from .plans import stages
from .sources import io


def _text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file


class Run:
    """A call of the command: its arguments, tables and answers."""

    def __init__(self, spark: SparkSession, a: argparse.Namespace):
        self.spark, self.a, self.config = spark, a, io.load_config(a.config)
        self.prompts = json.loads(_text(spark, a.prompts)) if a.prompts else {}
        self.asked: list[DataFrame] = []

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.a.data}/{name}")

    def respond(self, requests: DataFrame) -> DataFrame:
        replies = self.spark.read.schema(completion.REPLY).parquet(self.a.replies) if self.a.replies else self.spark.createDataFrame([], completion.REPLY)
        keyed = requests.withColumn("prompt_key", completion.prompt_key(F.col("model"), F.col("system"), F.col("user")))
        self.asked.append(io.saved(keyed.join(replies.select("prompt_key"), "prompt_key", "left_anti").select("prompt_key", "model", "system", "user").distinct(), "requests"))
        return completion.replaying(replies)(requests)

    def model(self, role: str) -> str:
        return self.a.model or self.config["models"][role]

    def write(self, df: DataFrame, name: str | None = None) -> None:
        df.write.mode("overwrite").parquet(f"{self.a.out}/{name}" if name else self.a.out)

    def ingest(self) -> None:
        self.write(io.ingest(io.read_raw(self.spark, self.a.input), io.read_outcomes(self.spark, self.a.outcomes), self.a.submission, not self.a.no_strict))

    def events(self) -> None:
        self.write(events.extract_events(self.t("steps")))

    def pair(self) -> None:
        pool = self.t("pool")
        if self.a.eval_ids:
            pairing.assert_no_leak(pool, io.read_list(self.spark, self.a.eval_ids).withColumnRenamed("value", "instance_id"))
        self.write(pairing.select_pairs(pool, self.a.k or self.config["pair"]["K"]))

    def fork(self) -> None:
        self.write(pairing.localize_forks(self.t("pairs"), self.t("events"), self.t("pool")))

    def guard(self) -> None:
        self.write(rules.guard(self.t("candidates"), None, self.config["discover"]["rule_max_chars"], tuple(self.config["discover"]["occurrence_bounds"])))

    def discover(self) -> None:
        c = self.config["discover"]
        told = stages.analyst_messages(self.t("pairs"), self.t("forks"), self.t("steps"), self.t("patches"))
        d = stages.discover(told, self.prompts, self.respond, self.model("skill_learning"), None, c["retry_on_guard_reject"], c["rule_max_chars"], tuple(c["occurrence_bounds"]))
        for name in ("candidates", "failures", "transcript", "costs"):
            self.write(getattr(d, name), name)
        self.write(d.counts(), "counts")

    def merge(self) -> None:
        made, errors = stages.merge(self.t("candidates"), self.prompts["merge_rules"], self.respond, self.model("skill_learning"), self.config["merge"]["batch_size"])
        self.write(made, "rules")
        self.write(errors, "errors")

    def judge(self) -> None:
        dims = tuple(self.a.dims.split(",")) if self.a.dims else tuple(self.config["judge"]["required_dims"])
        table, log = self.t("rules"), self.t("judge_log")
        new = io.saved(stages.judge(table, log, self.prompts["judge"], self.respond, self.model("skill_learning")), "verdicts") if self.prompts else None
        log = log.unionByName(new, allowMissingColumns=True) if new is not None else log
        self.write(log, "judge_log")
        self.write(rules.kept_rules(table, rules.judged(log, dims)), "rules")

    def score(self) -> None:
        self.write(score.score_rules(self.t("rules"), self.t("pool"), self.t("pairs"), self.t("events")))

    def audit(self) -> None:
        self.write(rules.audit(self.t("rules"), self.t("pairs"), self.t("patches"), self.a.ngram or self.config["audit"]["ngram"]))

    def generalize(self) -> None:
        c = self.config["generalize"]
        g = stages.generalize(
            self.t("rules"), self.t("fired"), self.t("pool").count(), self.t("neighbours"), self.prompts, self.respond, self.model("skill_learning"), c["min_fires"], c["heterogeneity_alpha"], self.a.phi_cutoff, self.a.dry_run
        )
        for name in ("strategies", "residual", "components", "assigned"):
            if getattr(g, name) is not None:
                self.write(getattr(g, name), name)
        io.write_file(self.spark, f"{self.a.out}/summary.json", json.dumps(g.summary, indent=1))

    def pack(self) -> None:
        bullets = reports.strategy_bullets(self.t("strategies"))
        ids = reports.packed_ids(bullets)
        if not self.a.strategies_only:
            bullets = bullets.unionByName(reports.residual_bullets(self.t("residual")), allowMissingColumns=True)
        io.write_skill_files(reports.skill_files(bullets), self.a.out, ids)

    def retrieve(self) -> None:
        packed = reports.parse_skill_lines(io.read_skill_lines(self.spark, self.a.input))
        c = self.config["retrieval"]
        self.write(stages.retrieve(self.t("instances"), packed, self.prompts, self.respond, self.model("backbone"), c["top_n"]), "selections")

    def summarize(self) -> None:
        self.write(reports.compare_arms(self.t("ids"), self.t("baseline"), self.t("treated")))


STAGES = ("ingest", "events", "pair", "fork", "guard", "discover", "merge", "judge", "score", "audit", "generalize", "pack", "retrieve", "summarize")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trailforge")
    p.add_argument("stage")
    p.add_argument("--data", default=".")
    p.add_argument("--out", required=True)
    for name in ("--config", "--input", "--outcomes", "--replies", "--prompts", "--model", "--eval-ids", "--dims"):
        p.add_argument(name)
    p.add_argument("--submission", default="submission")
    for name in ("--no-strict", "--fail-on-flag", "--strategies-only", "--dry-run"):
        p.add_argument(name, action="store_true")
    p.add_argument("--k", type=int)
    p.add_argument("--ngram", type=int)
    p.add_argument("--phi-cutoff", type=float)
    a = p.parse_args(argv)
    if a.stage not in STAGES:
        print(f"unknown stage {a.stage}; one of {', '.join(STAGES)}", file=sys.stderr)
        return 2
    run = Run(SparkSession.builder.getOrCreate(), a)
    getattr(run, a.stage)()
    if run.asked:
        every = run.asked[0]
        for x in run.asked[1:]:
            every = every.unionByName(x)
        run.write(every.distinct(), "requests")
    flagged = a.stage == "audit" and a.fail_on_flag and run.spark.read.parquet(a.out).where("flagged").limit(1).count()
    return 1 if flagged else 0


if __name__ == "__main__":
    sys.exit(main())
