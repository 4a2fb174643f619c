"""The stages that ask a language model, as rounds of joined requests and replies.

A stage takes a responder: a function from requests(model, system, user, ...) to the same rows with text, in_tokens, out_tokens
and finish_reason, null where no reply came. completion.replaying answers from a table, completion.calling by a function.
Rounds are few by nature (a retry, the halving of a batch); what a round returns is written to the shared folder before the
next one reads it, so a reply is asked for once and a lost executor costs no calls. System prompts are parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import json_object_of, json_of
from ..operators import cluster, events, reports, rules
from ..operators.completion import Responder, cost_rows, transcript_rows
from ..sources.io import saved

# The analysts' tags, the sides that they see, the characters of an excerpt, and whether they see the patch.
ANALYSTS = (("skipped_step", "A-", ("fail",), 5000, True), ("discipline_observer", "A+", ("pass",), 5000, False), ("process_delta", "A_diff", ("fail", "pass"), 3500, False))
PATCH_SHOWN, ISSUE_SHOWN = 4000, 6000
REJECTED = "\n\n[GUARD REJECTED: {}] Fix the offending part (fact-shaped content in an action rule, an unanchored fact rule, or an unparseable / power-less predicate) and re-emit the full JSON."
EVIDENCE = "struct<fail_traj_id:string,pass_traj_id:string,skipped_step_index:string,cited_pass_step_index:string,gold_patch_hunk_ref:string>"
CANDIDATE = "pair_id string, analyst_type string, kind string, category string, rule string, evidence struct<fail_traj_id:string,pass_traj_id:string,skipped_step_index:int,cited_pass_step_index:int,gold_patch_hunk_ref:string>, predicate string"


def _text(v: Column, path: str) -> Column:
    """A string of a JSON value; null for other types."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _list(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- discovery -----------------------------------------------------------------------------------------------


def analyst_messages(pairs: DataFrame, forks: DataFrame, steps: DataFrame, patches: DataFrame) -> DataFrame:
    """(pair_id, analyst, sub, user): what each analyst is told of each pair; a pair without a fork starts at step 0."""
    fork = forks.select("pair_id", "n_shared", "shared_prefix", "fail_div_step", "pass_div_step", "fail_continuation", "pass_continuation")
    base = pairs.select("pair_id", "instance_id", "repo", "fail_traj_id", "pass_traj_id").join(fork, "pair_id", "left")
    base = base.join(patches.select(F.col("traj_id").alias("pass_traj_id"), F.substring("patch", 1, PATCH_SHOWN).alias("patch")), "pass_traj_id", "left")
    none, out = F.array().cast("array<string>"), []
    for name, sub, sides, chars, with_patch in ANALYSTS:
        x, parts, ids = base, [F.coalesce("shared_prefix", none).alias("shared_prefix_events"), F.coalesce("n_shared", F.lit(0)).alias("n_shared_events")], []
        for side in sides:
            start = base.select("pair_id", F.col(f"{side}_traj_id").alias("traj_id"), F.coalesce(f"{side}_div_step", F.lit(0)).alias("start"))
            window = steps.join(start, "traj_id").where("step_idx >= start").select(F.col("pair_id").alias("traj_id"), "step_idx", "kind", "content")
            seen = events.excerpt(window, chars).select(F.col("traj_id").alias("pair_id"), F.col("excerpt").alias(f"{side}_excerpt"))
            x = x.join(seen, "pair_id", "left")
            ids.append(F.col(f"{side}_traj_id"))
            parts += [
                F.col(f"{side}_traj_id"), F.coalesce(f"{side}_continuation", none).alias(f"{side}_continuation_events"), F.col(f"{side}_div_step").alias(f"{side}_divergence_step"),
                F.coalesce(f"{side}_excerpt", F.lit("")).alias(f"{side}_divergence_excerpt"),
            ]
        patch = [F.coalesce("patch", F.lit("")).alias("successful_patch")] if with_patch else []
        told = F.struct("pair_id", "instance_id", F.coalesce("repo", F.lit("")).alias("repo"), *ids, *patch, F.struct(*parts).alias("fork"))
        out.append(x.select("pair_id", F.lit(name).alias("analyst"), F.lit(sub).alias("sub"), F.to_json(told, {"ignoreNullFields": "false"}).alias("user")))
    return _union(out)


@dataclass
class Discovery:
    candidates: DataFrame
    failures: DataFrame
    transcript: DataFrame
    costs: DataFrame

    def counts(self) -> DataFrame:
        """(analyst_type, n_pairs, n_failures) of every analyst."""
        every = self.candidates.sparkSession.createDataFrame([(a[0],) for a in ANALYSTS], "analyst_type string")
        ok = self.candidates.groupBy("analyst_type").agg(F.countDistinct("pair_id").alias("n_pairs"))
        bad = self.failures.groupBy(F.col("analyst").alias("analyst_type")).agg(F.count("*").alias("n_failures"))
        x = every.join(ok, "analyst_type", "left").join(bad, "analyst_type", "left")
        return x.select("analyst_type", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.coalesce("n_failures", F.lit(0)).alias("n_failures"))


def discover(
    messages: DataFrame, prompts: dict[str, str], respond: Responder, model: str, rate_of: Callable[[DataFrame], DataFrame] | None = None, retries: int = 1, max_chars: int = rules.MAX_CHARS,
    bounds: tuple[float, float] = rules.OCCURRENCE,
) -> Discovery:
    """Candidates from analyst_messages(); a pair whose reply is rejected is asked again with the reason, one that fails leaves a row.

    rate_of(predicates) gives (predicate, rate) over the pool, for the bounds on how often a predicate holds.
    """
    system = F.create_map(*[F.lit(x) for a in ANALYSTS for x in (a[0], prompts[a[0]])])
    todo = messages.select("pair_id", "analyst", "sub", F.lit(model).alias("model"), system[F.col("analyst")].alias("system"), "user")
    kept, failed, said, paid = [], [], [], []
    for attempt in range(retries + 1):
        got = saved(respond(todo).withColumn("attempt", F.lit(attempt)), "replies")
        paid.append(cost_rows(got, "discover", F.struct("pair_id", "attempt")))
        failed.append(got.where("text IS NULL").select("pair_id", "analyst", F.lit("no reply").alias("error")))
        told = got.where("text IS NOT NULL").withColumn("v", json_of(F.col("text")))
        many = F.schema_of_variant("v").like("ARRAY%")
        one = told.where("v IS NOT NULL").select("pair_id", "analyst", F.posexplode(F.when(many, _list(F.col("v"))).otherwise(F.array("v"))).alias("pos", "o"))
        o = F.col("o")
        shaped = one.where(F.schema_of_variant("o").like("OBJECT%")).select(
            "pair_id", F.col("analyst").alias("analyst_type"), "pos", _text(o, "$.kind").alias("kind"), _text(o, "$.category").alias("category"), F.trim(_text(o, "$.rule")).alias("rule"),
            F.coalesce(F.try_variant_get(o, "$.evidence", EVIDENCE), F.from_json(F.lit("{}"), EVIDENCE)).alias("evidence"), _text(o, "$.predicate").alias("predicate"),
        )
        rates = rate_of(shaped.select("predicate").where("predicate IS NOT NULL").distinct()) if rate_of else None
        judged = saved(rules.guard(shaped, rates, max_chars, bounds), "guarded")
        strange = one.where(~F.schema_of_variant("o").like("OBJECT%")).select("pair_id", F.col("analyst").alias("analyst_type"), "pos", F.lit("not_an_object").alias("reason"))
        first = judged.select("pair_id", "analyst_type", "pos", "reason").unionByName(strange)
        first = first.groupBy("pair_id", "analyst_type").agg(F.bool_or(F.col("reason").isNull()).alias("ok"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("why"))
        done = told.join(first.withColumnRenamed("analyst_type", "analyst"), ["pair_id", "analyst"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        said.append(transcript_rows(done, "discover", parsed=F.col("v").isNotNull(), accepted=F.col("ok"), reason=F.when(F.col("v").isNull(), "json_parse").otherwise(F.coalesce("why", F.lit("empty")))))
        good = judged.where("reason IS NULL").withColumn("evidence", rules.coerced_evidence(F.col("evidence")))
        fits = F.coalesce(rules.evidence_ok(F.col("analyst_type"), F.col("evidence")), F.lit(False))
        kept.append(good.where(fits).select("pair_id", "analyst_type", "kind", "category", "rule", "evidence", "predicate"))
        failed.append(good.where(~fits).select("pair_id", F.col("analyst_type").alias("analyst"), F.lit("evidence is incomplete").alias("error")))
        again = F.when(F.col("v").isNull(), F.col("user")).otherwise(F.concat("user", F.replace(F.lit(REJECTED), F.lit("{}"), F.coalesce("why", F.lit("empty")))))
        todo = saved(done.where("NOT ok").select("pair_id", "analyst", "sub", "model", "system", again.alias("user")), "again")
    return Discovery(saved(_union(kept), "candidates"), _union(failed), _union(said), _union(paid))


# ---- merging and judging -------------------------------------------------------------------------------------


def merge(candidates: DataFrame, prompt: str, respond: Responder, model: str, size: int = rules.MERGE_BATCH, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, errors) of candidates(pair_id, category, rule, predicate, pos): each batch merged by a reply, equal titles folded.

    A reply that was cut off has its batch asked again in halves, until one candidate is left, which is dropped. done(bucket)
    has buckets that are finished already. A bucket with a batch that got no reply is in errors and makes no rules.
    """
    routed = rules.route(candidates).where("coalesce(category, '') <> ''")
    routed = routed.join(done.select("bucket"), "bucket", "left_anti") if done is not None else routed
    cut = rules.batches(routed, ["bucket", "category"], "pos", size)
    member = F.struct("pos", "pair_id", "rule", "predicate")
    todo = cut.groupBy("bucket", "category", F.lpad(F.col("batch").cast("string"), 9, "0").alias("batch")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    replies, lost = [], []
    while True:
        lines = F.transform("members", lambda m, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), m["rule"]))
        got = saved(respond(todo.select("*", F.lit(model).alias("model"), F.lit(prompt).alias("system"), F.array_join(lines, "\n\n").alias("user"))), "merges")
        lost.append(got.where("text IS NULL").select("bucket", F.concat(F.lit("no reply to batch "), "batch").alias("error")))
        replies.append(got.where("text IS NOT NULL AND coalesce(finish_reason, '') <> 'length'").select("bucket", "category", "batch", "members", "text"))
        todo = got.where("finish_reason = 'length' AND size(members) > 1").select("bucket", "category", "batch", F.posexplode(rules.halves(F.col("members"))).alias("half", "members"))
        todo = saved(todo.select("bucket", "category", F.concat_ws(".", "batch", F.col("half").cast("string")).alias("batch"), "members"), "halves")
        if todo.isEmpty():
            break
    errors = _union(lost).distinct()
    told = _union(replies).join(errors.select("bucket").distinct(), "bucket", "left_anti").withColumn("v", json_object_of(F.col("text"))).where("v IS NOT NULL")
    r = told.select("bucket", "category", "batch", "members", F.posexplode(_list(F.col("v"), "$.rules")).alias("j", "r"))
    idx = F.filter(F.coalesce(F.try_variant_get("r", "$.support_indices", "array<int>"), F.array().cast("array<int>")), lambda i: (i >= 0) & (i < F.size("members")))
    r = r.withColumn("backed", F.transform(idx, lambda i: F.get("members", i)))
    r = r.select(
        "bucket", "category", "batch", "j", F.trim(F.coalesce(_text(F.col("r"), "$.title"), F.lit(""))).alias("title"), F.trim(F.coalesce(_text(F.col("r"), "$.body"), F.lit(""))).alias("body"), "backed"
    ).where(F.size("backed") > 0)
    r = r.where(F.length("title").between(1, rules.TITLE_MAX) & F.length("body").between(1, rules.BODY_MAX))
    pos = F.row_number().over(W.partitionBy("bucket", "category").orderBy("batch", "j"))  # the rules of a bucket's category
    r = r.withColumn("pos", pos).withColumn("support", F.size("backed").cast("long")).withColumn("source_pair_ids", F.transform("backed", lambda m: m["pair_id"]))
    known = r.select("bucket", "category", "pos", F.posexplode("backed").alias("k", "m")).select("bucket", "category", F.col("pos").alias("rule_pos"), F.col("k").alias("pos"), "m.predicate")
    top = rules.representative_predicate(known, ["bucket", "category", "rule_pos"]).withColumnRenamed("rule_pos", "pos")
    r = r.join(top, ["bucket", "category", "pos"], "left")
    return rules.fold_titles(r), errors


def judge(rule_table: DataFrame, log: DataFrame, prompt: str, respond: Responder, model: str) -> DataFrame:
    """New rows of the log, (bucket, rule_id, section, keep, decision, error, pos), for rules without one.

    A reply that doesn't parse is asked for once more; then the rule is kept, with an error.
    """
    todo = rules.to_judge(rule_table, log).select("bucket", "rule_id", F.concat("title", F.lit("\n"), "body").alias("section"))
    todo = todo.select("*", F.lit(model).alias("model"), F.lit(prompt).alias("system"), F.to_json(F.struct("bucket", F.col("section").alias("rule"))).alias("user"))
    out = []
    for last in (False, True):
        got = saved(respond(todo).withColumn("v", F.to_json(json_object_of(F.col("text")))), "verdicts")
        said = F.from_json("v", "map<string,string>")
        good = got.where("v IS NOT NULL AND v <> '{}'").select("bucket", "rule_id", "section", F.lit(None).cast("boolean").alias("keep"), said.alias("decision"), F.lit(None).cast("string").alias("error"))
        out.append(good)
        todo = got.where("v IS NULL OR v = '{}'").select("bucket", "rule_id", "section", "model", "system", "user")
        if last:
            out.append(todo.select("bucket", "rule_id", "section", F.lit(True).alias("keep"), F.lit(None).cast("map<string,string>").alias("decision"), F.lit("judge_unavailable_fail_open").alias("error")))
    return _union(out).withColumn("pos", F.unix_micros(F.current_timestamp()))


# ---- generalisation ------------------------------------------------------------------------------------------

ASSIGN_BATCH = 8


def embedded(rule_table: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(id, v): the vector of each rule's title and body, by any function from a text column to a vector column."""
    return rule_table.select(F.col("rule_id").alias("id"), embed(F.concat("title", F.lit(". "), "body")).alias("v"))


def assignment_requests(choices: DataFrame, rule_table: DataFrame, prompt: str, model: str, batch: int = ASSIGN_BATCH) -> DataFrame:
    """(job, items, model, system, user): rules with their choices (see cluster.assignment_choices), batch of them a request."""
    titles = rule_table.select(F.col("rule_id").alias("m"), F.col("title").alias("mt"))
    named = choices.select("rule", "cluster", "place", F.posexplode("members").alias("k", "m")).join(titles, "m")
    groups = named.groupBy("rule", "cluster", "place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "mt"))), lambda s: s["mt"]), "; ").alias("shown"))
    jobs = groups.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("place", "cluster", "shown"))).alias("groups"))
    jobs = jobs.join(rule_table.select(F.col("rule_id").alias("rule"), "title", "body"), "rule")
    n = F.row_number().over(W.orderBy("rule")) - 1  # the rules that no cluster holds, few like all rules
    jobs = jobs.withColumn("job", F.floor(n / batch)).withColumn("i", (n % batch).cast("int"))
    shown = F.transform("groups", lambda g, k: F.concat(F.lit("  GROUP "), k.cast("string"), F.lit(": "), g["shown"]))
    lines = F.concat(F.lit("ITEM "), F.col("i").cast("string"), F.lit(":\nRULE: "), "title", F.lit(": "), "body", F.lit("\n"), F.array_join(shown, "\n"))
    item = F.struct("i", "rule", F.transform("groups", lambda g: g["cluster"]).alias("clusters"), lines.alias("lines"))
    one = jobs.groupBy("job").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return one.select("job", "items", F.lit(model).alias("model"), F.lit(prompt).alias("system"), F.array_join(F.transform("items", lambda x: x["lines"]), "\n").alias("user"))


def assignments(replies: DataFrame) -> DataFrame:
    """(rule_id, cluster) from answered assignment_requests(): items and groups that don't exist are passed over, the last answer counts."""
    v = json_object_of(F.col("text"))
    x = replies.select("items", F.posexplode(_list(v, "$.assignments")).alias("pos", "a"))
    whole = lambda path: F.when(F.schema_of_variant(F.try_variant_get("a", path, "variant")) == "BIGINT", F.try_variant_get("a", path, "int"))
    x = x.withColumn("item", F.get("items", whole("$.i"))).withColumn("cluster", F.get("item.clusters", whole("$.group"))).where("cluster IS NOT NULL")
    return x.groupBy(F.col("item.rule").alias("rule_id")).agg(F.max_by("cluster", "pos").alias("cluster"))


def strategy_requests(members: DataFrame, prompt: str, model: str) -> DataFrame:
    """(component, ids, model, system, user) of members(component, rule_id, repo, title, body, support, z, pos)."""
    z = F.when(F.col("z").isNotNull(), F.concat(F.lit(", z "), F.format_string("%+.2f", "z"))).otherwise(F.lit(""))
    line = F.concat(F.lit("("), "repo", F.lit(", support "), F.col("support").cast("string"), z, F.lit(") "), "title", F.lit(": "), "body")
    one = members.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("pos", "rule_id", "title", line.alias("line")))).alias("m"))
    user = F.array_join(F.transform("m", lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s["line"])), "\n\n")
    return one.select("component", F.transform("m", lambda s: s["rule_id"]).alias("ids"), F.get("m", F.lit(0))["title"].alias("first_title"), F.lit(model).alias("model"), F.lit(prompt).alias("system"), user.alias("user"))


def strategy_records(members: DataFrame, prompt: str, respond: Responder, model: str, alpha: float = 0.10) -> DataFrame:
    """A record for each component; one without title or action in its reply is asked again, then keeps its first rule's title."""
    todo, out = strategy_requests(members, prompt, model), []
    for last in (False, True):
        got = saved(respond(todo).withColumn("js", F.to_json(json_object_of(F.col("text")))), "strategies")
        v = F.try_parse_json("js")
        got = got.withColumn("title", F.nullif(_text(v, "$.title"), F.lit(""))).withColumn("action", F.nullif(_text(v, "$.action"), F.lit(""))).withColumn("merge_ok", F.col("title").isNotNull() & F.col("action").isNotNull())
        made = got if last else got.where("merge_ok")
        out.append(made.select(
            "component", F.concat(F.lit("strategy/"), F.col("component").cast("string")).alias("strategy_id"), "merge_ok", F.coalesce("title", "first_title").alias("title"), F.coalesce(_text(v, "$.trigger"), F.lit("")).alias("trigger"),
            F.coalesce("action", F.lit("")).alias("action"), F.coalesce(F.try_variant_get(v, "$.anchor_examples", "array<string>"), F.array().cast("array<string>")).alias("anchor_examples"),
            F.coalesce(F.try_variant_get(v, "$.outliers", "array<int>"), F.array().cast("array<int>")).alias("outliers"), F.col("ids").alias("member_rule_ids"),
        ))
        todo = got.where("NOT merge_ok").select("component", "ids", "first_title", "model", "system", "user")
    facts = members.groupBy("component").agg(F.sort_array(F.collect_set("repo")).alias("repos"), F.count("*").alias("n_members"), F.sum("support").alias("support_total"))
    top = cluster.majority_predicate(members, ["component"]).select("component", F.when(F.col("predicate").isNotNull(), F.struct("predicate", "agreement")).alias("predicate_majority"))
    return _union(out).join(facts, "component").join(cluster.pool_and_q(members, ["component"], alpha), "component").join(top, "component", "left")


@dataclass
class Generalised:
    summary: dict
    strategies: DataFrame | None = None
    residual: DataFrame | None = None
    components: DataFrame | None = None
    assigned: DataFrame | None = None


def generalize(
    rule_table: DataFrame, fired: DataFrame, n_pool: int, neighbours: DataFrame, prompts: dict[str, str], respond: Responder, model: str, min_fires: int = 20, alpha: float = 0.10, cutoff: float | None = None,
    dry_run: bool = False,
) -> Generalised:
    """Strategies across repositories from rules(rule_id, repo, title, body, support, z, lift, predicate, pos).

    fired(rule_id, traj_id) has the runs that a rule's predicate holds on, neighbours(a, b, distance) the rules with like texts.
    Without a cutoff and a second mode in the correlations the stage ends with "aborted"; dry_run ends before the first request.
    """
    counts = cluster.fire_counts(fired)
    powered = saved(cluster.powered(counts, n_pool, min_fires), "powered")
    pairs = saved(cluster.phi_pairs(fired.join(powered.select("rule_id"), "rule_id", "left_semi"), n_pool), "phi")
    n_rules, n_powered = rule_table.count(), powered.count()
    cutoff = cluster.valley_of(pairs) if cutoff is None else cutoff
    if cutoff is None:
        return Generalised({"aborted": "no_phi_cutoff", "n_rules": n_rules, "n_powered": n_powered})
    spark = rule_table.sparkSession
    label = cluster.cluster_rules(pairs, [r.rule_id for r in powered.select("rule_id").collect()], cutoff)  # the powered rules
    known = spark.createDataFrame(sorted(label.items()), "rule_id string, cluster int")
    unresolved = rule_table.select("rule_id").join(known, "rule_id", "left_anti")
    choices = saved(cluster.assignment_choices(unresolved, neighbours, known), "choices")
    n_jobs, n_unresolved = choices.select("rule").distinct().count(), unresolved.count()
    if dry_run:
        return Generalised({"dry_run": True, "phi_cutoff": cutoff, "n_rules": n_rules, "n_powered": n_powered, "n_unresolved": n_unresolved, "n_jobs": n_jobs})
    assigned = saved(assignments(respond(assignment_requests(choices, rule_table, prompts["assign"], model))), "assigned")
    member = saved(cluster.assemble(known, assigned, rule_table).join(rule_table, "rule_id"), "members")
    parts = cluster.component_table(member, pairs).withColumn("multi_repo", F.size("repos") >= 2)
    multi = member.join(parts.where("multi_repo").select("component"), "component", "left_semi")
    made = saved(strategy_records(multi, prompts["merge"], respond, model, alpha), "records")
    residual = member.join(parts.where("NOT multi_repo").select("component"), "component", "left_semi")
    n = made.agg(F.count_if(~F.col("merge_ok")).alias("bad"), F.count_if("homogeneous").alias("same"), F.count_if(~F.col("homogeneous")).alias("mixed"), F.count("*").alias("all")).first()
    n_merged = multi.count()
    summary = {
        "min_fires": min_fires, "phi_cutoff": cutoff, "n_rules": n_rules, "n_candidate_pairs": neighbours.count(), "n_phi_pairs": pairs.where("phi IS NOT NULL").count(), "n_powered": n_powered,
        "n_unresolved": n_unresolved, "n_auto_none": n_unresolved - n_jobs, "n_assigned": assigned.count(), "n_components": parts.count(), "n_strategy_components": n.all, "n_rules_merged": n_merged,
        "n_residual_rules": n_rules - n_merged, "merge_failed": n.bad, "n_homogeneous": n.same, "n_heterogeneous": n.mixed,
    }
    return Generalised(summary, made, residual, parts, assigned)


# ---- retrieval -----------------------------------------------------------------------------------------------


def retrieve(issues: DataFrame, packed: DataFrame, prompts: dict[str, str], respond: Responder, model: str, top_n: int = 3, done: DataFrame | None = None) -> DataFrame:
    """(instance_id, bug_summary, needed_guidance, selected, model, error) of issues(instance_id, problem_statement).

    Two requests an issue: one shows the titles of all packed rules, the next the answer and their texts. A missing reply is
    recorded as the error. {top_n} in the second prompt is the limit. done(instance_id) has issues to pass over.
    """
    todo = issues if done is None else reports.todo(issues, done)
    todo = todo.select("instance_id", F.substring(F.coalesce("problem_statement", F.lit("")), 1, ISSUE_SHOWN).alias("issue"))
    index, corpus = reports.render_index(packed), reports.corpus_block(packed)  # one row each
    report = F.concat(F.lit("BUG REPORT:\n"), "issue")
    ask = todo.crossJoin(F.broadcast(index)).where("index <> ''")
    ask = ask.select("instance_id", "issue", F.lit(model).alias("model"), F.lit(prompts["analyze"]).alias("system"), F.concat(report, F.lit("\n\nRULE INDEX:\n"), "index").alias("user"))
    one = saved(respond(ask).select("instance_id", "issue", "text", F.coalesce(F.to_json(json_object_of(F.col("text"))), F.lit("{}")).alias("analysis")), "analyses")
    user = F.concat(report, F.lit("\n\nANALYSIS:\n"), "analysis", F.lit("\n\nRULES:\n"), "corpus")
    ask = one.where("text IS NOT NULL").crossJoin(F.broadcast(corpus)).select("instance_id", F.lit(model).alias("model"), F.lit(prompts["select"].replace("{top_n}", str(top_n))).alias("system"), user.alias("user"))
    two = saved(respond(ask).select("instance_id", "text", F.lit(True).alias("asked")), "selections")
    picked = F.transform(_list(json_object_of(F.col("text")), "$.selected"), lambda s: F.struct(_text(s, "$.rule_id").alias("rule_id"), F.coalesce(_text(s, "$.reason"), F.lit("")).alias("reason")))
    chosen = reports.sanitized_selection(two.select("instance_id", picked.alias("selected")), packed, top_n)
    chosen = chosen.groupBy("instance_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rule_id", "reason"))), lambda s: F.struct(s["rule_id"].alias("rule_id"), s["reason"].alias("reason"))).alias("selected"))
    a = F.try_parse_json("analysis")
    x = todo.select("instance_id").join(one, "instance_id", "left").join(two.select("instance_id", F.col("text").alias("second"), "asked"), "instance_id", "left").join(chosen, "instance_id", "left")
    error = F.when(F.col("analysis").isNotNull() & F.col("text").isNull(), "no reply to the analysis").when(F.col("asked") & F.col("second").isNull(), "no reply to the selection").otherwise("")
    none = F.array().cast("array<struct<rule_id:string,reason:string>>")
    return x.select(
        "instance_id", F.coalesce(_text(a, "$.bug_summary"), F.lit("")).alias("bug_summary"), F.coalesce(F.try_variant_get(a, "$.needed_guidance", "array<string>"), F.array().cast("array<string>")).alias("needed_guidance"),
        F.coalesce("selected", none).alias("selected"), F.lit(model).alias("model"), error.alias("error"),
    )
