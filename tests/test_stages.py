import json

import pytest
from pyspark.sql import functions as F

from trailforge import cli
from trailforge.operators import completion, pairing, reports, rules
from trailforge.plans import stages
from trailforge.sources import io

PROMPTS = {"skipped_step": "A", "discipline_observer": "B", "process_delta": "C", "merge_rules": "M", "judge": "J", "assign": "S", "merge": "G", "analyze": "N", "select": "pick {top_n}"}


def fixed(answers):
    """A responder from a function of (system, user) to a reply text, its finish reason, or None."""

    def respond(requests):
        rows = requests.select("model", "system", "user").distinct().collect()
        out = []
        for r in rows:
            got = answers(r.system, r.user)
            if got is not None:
                text, reason = got if isinstance(got, tuple) else (got, "stop")
                out.append((r.model, r.system, r.user, text, 1, 2, reason))
        spark = requests.sparkSession
        keys = "model string, system string, user string, text string, in_tokens int, out_tokens int, finish_reason string"
        return requests.join(spark.createDataFrame(out, keys), ["model", "system", "user"], "left")

    return respond


def test_discovery_asks_again_and_isolates_failures(spark):
    pairs = spark.createDataFrame([("a__b-1::f::p", "a__b-1", "a/b", "f", "p"), ("a__b-2::f::p", "a__b-2", "a/b", "f", "p")], "pair_id string, instance_id string, repo string, fail_traj_id string, pass_traj_id string")
    forks = spark.createDataFrame([("a__b-1::f::p", 1, ["read:x"], 1, 1, ["edit:y"], ["run_test:z"])], "pair_id string, n_shared int, shared_prefix array<string>, fail_div_step int, pass_div_step int, fail_continuation array<string>, pass_continuation array<string>")
    steps = spark.createDataFrame([(t, i, "action", f"{t} step {i}") for t in "fp" for i in range(3)], "traj_id string, step_idx int, kind string, content string")
    patches = spark.createDataFrame([("p", "diff " * 2000)], "traj_id string, patch string")
    told = stages.analyst_messages(pairs, forks, steps, patches)
    seen = {(r.pair_id[-4 - 3 :][:1] + r.pair_id[5:6], r.analyst): json.loads(r.user) for r in told.collect()}
    assert len(seen) == 6 and told.count() == 6
    one = next(json.loads(r.user) for r in told.collect() if r.analyst == "skipped_step" and r.instance_id == "a__b-1") if "instance_id" in told.columns else next(m for m in (json.loads(r.user) for r in told.collect()) if m["instance_id"] == "a__b-1" and "successful_patch" in m)
    assert len(one["successful_patch"]) == 4000 and one["fork"]["fail_divergence_step"] == 1 and "f step 0" not in one["fork"]["fail_divergence_excerpt"] and "f step 2" in one["fork"]["fail_divergence_excerpt"]
    good = {"kind": "action", "category": "lookup", "rule": " look first ", "predicate": "exists(read)", "evidence": {"fail_traj_id": "f", "skipped_step_index": "4,6", "gold_patch_hunk_ref": "h", "pass_traj_id": "p"}}

    def answers(system, user):
        if system == "A":
            if "a__b-2" in user:
                return "no json at all"
            return json.dumps([dict(good, predicate="exists("), "text"]) if "GUARD REJECTED" not in user else "```json\n" + json.dumps(good) + "\n```"
        if system == "B":
            return json.dumps(dict(good, evidence={}))
        return None

    d = stages.discover(told, PROMPTS, fixed(answers), "m")
    got = d.candidates.collect()
    assert [(r.pair_id, r.analyst_type, r.rule, r.evidence.skipped_step_index) for r in got] == [("a__b-1::f::p", "skipped_step", "look first", 4)]
    fails = sorted((r.analyst, r.error) for r in d.failures.collect())
    assert [f for f in fails if f[0] == "discipline_observer"] == [("discipline_observer", "evidence is incomplete")] * 2
    assert ("process_delta", "no reply") in fails
    said = sorted((r.attempt, r.sub, r.outcome.split(":")[0]) for r in d.transcript.collect())
    assert (0, "A-", "guard_fail") in said and (1, "A-", "accepted") in said and said.count((0, "A-", "parse_fail")) == 1
    assert {r.analyst_type: r.n_pairs for r in d.counts().collect()} == {"skipped_step": 1, "discipline_observer": 0, "process_delta": 0}
    assert d.costs.count() == len(said)


def test_merge_halves_folds_and_reports(spark):
    cands = spark.createDataFrame([(f"a__b-{i}::f::p", "lookup", f"rule {i}", "exists(read)" if i else None, i) for i in range(5)] + [("c__d-1::f::p", "replay", "lost", None, 9)], "pair_id string, category string, rule string, predicate string, pos int")

    def answers(system, user):
        n = user.count("rule ")
        if "lost" in user:
            return None
        if n > 2:
            return "{", "length"
        return json.dumps({"rules": [{"title": "Look" if n == 2 else "look", "body": "b" * n, "support_indices": [*range(n), 7]}, {"title": "x" * 121, "body": "b", "support_indices": [0]}, {"title": "none", "body": "b", "support_indices": []}]})

    made, errors = stages.merge(cands, "M", fixed(answers), "m", 5)
    (r,) = made.collect()
    assert r.rule_id == "a__b:lookup:0" and r.title == "Look" and r.body == "bb" and r.support == 5 and sorted(r.source_pair_ids) == [f"a__b-{i}::f::p" for i in range(5)] and r.predicate == "exists(read)"
    assert [e.bucket for e in errors.collect()] == ["c__d"]
    assert stages.merge(cands, "M", fixed(answers), "m", 5, spark.createDataFrame([("a__b",)], "bucket string"))[0].count() == 0


def test_judge_fails_open(spark):
    table = spark.createDataFrame([("b", f"r{i}", "t", f"body {i}") for i in range(4)], "bucket string, rule_id string, title string, body string")
    log = spark.createDataFrame([("r0", 1, None, None, True)], "rule_id string, pos long, decision map<string,string>, error string, keep boolean")
    good = json.dumps({"is_discipline": 1, "not_repo_conflicting": 1, "behavior_actionable": 0})
    new = stages.judge(table, log, "J", fixed(lambda s, u: good if "body 1" in u else json.dumps({"is_discipline": 0}) if "body 2" in u else "?"), "m")
    new = io.saved(new, "log")
    assert {r.rule_id: r.error for r in new.collect()} == {"r1": None, "r2": None, "r3": "judge_unavailable_fail_open"}
    kept = rules.kept_rules(table, rules.judged(log.unionByName(new.select(*log.columns))))
    assert sorted(r.rule_id for r in kept.collect()) == ["r0", "r1", "r3"]
    strict = rules.judged(log.unionByName(new.select(*log.columns)), rules.ALL_JUDGE_DIMS)
    assert {r.rule_id: r.keep for r in strict.collect()} == {"r0": True, "r1": False, "r2": False, "r3": True}


def _rules(spark):
    rows = [("r0", "a__b", "T0", "B0", 3, 2.0, 0.2, 0), ("r1", "c__d", "T1", "B1", 2, 4.0, 0.4, 1), ("r2", "c__d", "T2", "B2", 1, None, None, 2), ("r3", "a__b", "T3", "B3", 1, None, None, 3), ("r4", "e__f", "T4", "B4", 5, 1.0, 0.1, 4)]
    return spark.createDataFrame([(*r, "exists(edit)") for r in rows], "rule_id string, repo string, title string, body string, support int, z double, lift double, pos int, predicate string")


def test_generalize(spark):
    r = _rules(spark)
    fired = [(x, t) for t in range(40) for x in (["r0"] if t % 2 else []) + (["r1"] if t % 2 else []) + (["r2"] if t == 0 else []) + (["r4"] if t % 4 < 2 else [])]
    fired = spark.createDataFrame(fired, "rule_id string, traj_id long")
    near = spark.createDataFrame([("r2", "r1", 0.1), ("r2", "r4", 0.2), ("r3", "r2", 0.1)], "a string, b string, distance double")
    assert stages.generalize(r, fired, 40, near, PROMPTS, fixed(lambda s, u: None), "m", 5).summary == {"aborted": "no_phi_cutoff", "n_rules": 5, "n_powered": 3}
    dry = stages.generalize(r, fired, 40, near, PROMPTS, fixed(lambda s, u: pytest.fail("asked")), "m", 5, cutoff=0.5, dry_run=True).summary
    assert dry == {"dry_run": True, "phi_cutoff": 0.5, "n_rules": 5, "n_powered": 3, "n_unresolved": 2, "n_jobs": 1}

    def answers(system, user):
        if system == "S":
            assert user.startswith("ITEM 0:\nRULE: T2: B2\n  GROUP 0: T") and "GROUP 1" in user
            return json.dumps({"assignments": [{"i": 5, "group": 0}, {"i": 0, "group": "0"}, {"i": 0, "group": 0}]})
        return json.dumps({"title": "All", "trigger": "when", "action": "do", "anchor_examples": ["a: x"], "outliers": [1]})

    g = stages.generalize(r, fired, 40, near, PROMPTS, fixed(answers), "m", 5, cutoff=0.5)
    (s,) = g.strategies.collect()
    assert s.title == "All" and s.merge_ok and s.repos == ["a__b", "c__d"] and s.member_rule_ids == ["r0", "r1", "r2"] and s.n_members == 3 and s.support_total == 6 and s.n_scored == 2 and s.pooled_lift == 0.3
    assert s.predicate_majority.agreement == "3/3" and sorted(x.rule_id for x in g.residual.collect()) == ["r3", "r4"]
    assert g.summary["n_assigned"] == 1 and g.summary["n_auto_none"] == 1 and g.summary["n_components"] == 3 and g.summary["merge_failed"] == 0 and g.summary["n_homogeneous"] == 1
    bad = stages.generalize(r, fired, 40, near, PROMPTS, fixed(lambda s, u: "{}"), "m", 5, cutoff=0.5).strategies.first()
    assert not bad.merge_ok and bad.title == "T0" and bad.action == ""


def test_pack_and_retrieve_on_disk(spark, tmp_path):
    s = spark.createDataFrame([("strategy/1", "One", "when", "do", ["x"], 7, 2.5, True), ("strategy/0", "Zero", "if", "go", [], 9, None, False)], "strategy_id string, title string, trigger string, action string, anchor_examples array<string>, support_total int, pooled_z double, homogeneous boolean")
    res = _rules(spark).select("repo", "pos", "title", "support", "z", "body")
    root, data = str(tmp_path / "packed"), tmp_path / "data"
    s.write.parquet(str(data / "strategies"))
    res.write.parquet(str(data / "residual"))
    assert cli.main(["pack", "--data", str(data), "--out", root]) == 0
    assert cli.main(["pack", "--data", str(data), "--out", root]) == 0  # in place of what was there
    assert json.loads((tmp_path / "packed/packed_ids.json").read_text()) == {"universal__strategies/skill/0": "strategy/1", "universal__strategies/skill/1": "strategy/0"}
    text = (tmp_path / "packed/repo_conventions/universal__strategies/SKILL.md").read_text()
    assert text.startswith("---\nname: universal__strategies\naxis: repo_convention\nn_rules: 2\ndescription: Transferable rules pooled") and text.endswith("- **One** (support 7, z +2.50) — Trigger: when Action: do Anchors: x\n- **Zero** (support 9, HET) — Trigger: if Action: go\n")
    assert sorted(p.name for p in (tmp_path / "packed/repo_conventions").iterdir()) == ["a__b", "c__d", "e__f", "universal__strategies"]
    packed = reports.parse_skill_lines(io.read_skill_lines(spark, root))
    assert packed.count() == 7
    index = reports.render_index(packed).first()["index"]
    assert index.startswith("### a__b\n- [a__b/skill/0] T0\n- [a__b/skill/1] T3\n### c__d\n")
    assert "[a__b/skill/0] (support 3, z +2.00) T0\nB0\n\n" in reports.corpus_block(packed).first()["corpus"]

    issues = spark.createDataFrame([("i1", "it fails"), ("i2", "no reply"), ("i3", "second lost")], "instance_id string, problem_statement string")

    def answers(system, user):
        if system == "N":
            return None if "no reply" in user else json.dumps({"bug_summary": "sum", "needed_guidance": ["g"]})
        assert system == "pick 2" and "ANALYSIS:\n{" in user
        return None if "second lost" in user else json.dumps({"selected": [{"rule_id": "a__b/skill/0", "reason": "r"}, {"rule_id": "made up"}, {"rule_id": "a__b/skill/0"}, {"rule_id": "universal__strategies/skill/1", "reason": 5}, {"rule_id": "c__d/skill/0"}]})

    got = io.saved(stages.retrieve(issues, packed, PROMPTS, fixed(answers), "m", 2), "records")
    rows = {r.instance_id: r for r in got.collect()}
    assert [(s.rule_id, s.reason) for s in rows["i1"].selected] == [("a__b/skill/0", "r"), ("universal__strategies/skill/1", "")] and rows["i1"].bug_summary == "sum" and rows["i1"].error == ""
    assert rows["i2"].error and rows["i3"].error and rows["i2"].selected == []
    blocks = {r.instance_id: r.block for r in reports.blocks_of(issues, got, packed).collect()}
    assert blocks["i1"] == "[a__b/skill/0] T0\nB0\n\n[universal__strategies/skill/1] Zero\nTrigger: if Action: go" and blocks["i2"] == ""
    with pytest.raises(ValueError):
        reports.blocks_of(issues, got.where("instance_id = 'i1'"), packed)


def test_outcomes_forks_and_rules(spark, tmp_path):
    f = tmp_path / "labels.json"
    f.write_text(json.dumps({"a": {"resolved": True}, "b": {"resolved": 1}, "c": {"resolved": "yes"}, "d": {"resolved": 0}, "e": {"resolved": ""}, "f": {}, "g": {"resolved": None}, "h": {"resolved": [0]}, "i": {"resolved": 0.0}, "j": {"resolved": False}}))
    assert {r.instance_id for r in io.read_outcomes(spark, str(f)).collect() if r.outcome == "pass"} == set("abch")
    with pytest.raises(Exception):
        io.read_outcomes(spark, str(tmp_path / "none.json"))
    pairs = spark.createDataFrame([("p1", "i", "r", "f", "p"), ("p2", "i", "r", "f", "gone"), ("p3", "i", "r", "f", "still")], "pair_id string, instance_id string, repo string, fail_traj_id string, pass_traj_id string")
    ev = spark.createDataFrame([(t, 0, 0, "read", "x.py", "cat x.py") for t in ("f", "p")], "traj_id string, i int, step_idx int, action_type string, target string, command string")
    pool = spark.createDataFrame([("f",), ("p",), ("still",)], "traj_id string")
    got = {r.pair_id: r for r in pairing.localize_forks(pairs, ev, pool).collect()}
    assert set(got) == {"p1", "p3"} and got["p1"].n_shared == 1 and got["p3"].n_shared == 0 and got["p3"].fail_div_step == 0
    assert [r.pair_id for r in pairing.skipped_pairs(pairs, pool).collect()] == ["p2"]
    (tmp_path / "rules/a__b").mkdir(parents=True)
    (tmp_path / "rules/a__b/rules.jsonl").write_text("\n".join(json.dumps(r) for r in [{"rule_id": "x", "predicate": "exists(", "validation": {"status": "scored", "z": 2.0, "lift": 0.1}}, {"rule_id": "y", "predicate": "exists(edit)", "validation": {"status": "fallback", "z": 3.0}}]))
    r = {x.rule_id: x for x in io.read_rules(spark, str(tmp_path / "rules")).collect()}
    assert r["x"].predicate is None and r["x"].z == 2.0 and r["y"].predicate == "exists(edit)" and r["y"].z is None and r["y"].bucket == "a__b" and r["y"].support == 0
    assert io.load_config(str(tmp_path / "none.yaml"))["discover"]["rule_max_chars"] == 1000


def test_live_calls_retry(spark, tmp_path):
    mark = tmp_path / "tried"

    def call(model, system, user):
        if not mark.exists():
            mark.write_text("x")
            raise ConnectionError
        return user.upper(), 1, 2, "stop"

    req = spark.createDataFrame([("m", "s", "hello"), ("m", "s", "hello")], "model string, system string, user string")
    got = completion.calling(call, wait=0.0)(req).collect()
    assert [(r.text, r.finish_reason) for r in got] == [("HELLO", "stop")] * 2


def test_command_line(spark, tmp_path):
    assert cli.main(["nothing", "--out", str(tmp_path)]) == 2
    pool = [(i, "a/b", f"t{m}-{i}", f"m{m}", "agent", "pass" if m > i % 3 else "fail", m * 10 + i) for i in range(6) for m in range(3)]
    spark.createDataFrame(pool, "instance_id long, repo string, traj_id string, model string, agent string, outcome string, pos int").write.parquet(str(tmp_path / "pool"))
    (tmp_path / "ids.txt").write_text("# ids\n99\n")
    assert cli.main(["pair", "--data", str(tmp_path), "--out", str(tmp_path / "pairs"), "--k", "1", "--eval-ids", str(tmp_path / "ids.txt")]) == 0
    assert spark.read.parquet(str(tmp_path / "pairs")).groupBy("instance_id").count().where("count > 1").count() == 0
    (tmp_path / "ids.txt").write_text("3\n")
    with pytest.raises(ValueError):
        cli.main(["pair", "--data", str(tmp_path), "--out", str(tmp_path / "pairs"), "--eval-ids", str(tmp_path / "ids.txt")])
    r = spark.createDataFrame([("x", "alpha beta gamma delta epsilon zeta eta", ["p"]), ("y", "nothing", ["p"])], "rule_id string, body string, source_pair_ids array<string>")
    r.write.parquet(str(tmp_path / "rules"))
    spark.createDataFrame([("p", "t")], "pair_id string, pass_traj_id string").write.mode("overwrite").parquet(str(tmp_path / "pairs"))
    spark.createDataFrame([("t", "+ alpha beta gamma delta epsilon zeta")], "traj_id string, patch string").write.parquet(str(tmp_path / "patches"))
    assert cli.main(["audit", "--data", str(tmp_path), "--out", str(tmp_path / "audit"), "--fail-on-flag"]) == 1
    assert [(x.rule_id, x.n_hits) for x in spark.read.parquet(str(tmp_path / "audit")).orderBy("rule_id").collect()] == [("x", 1), ("y", 0)]
    for name in ("ids", "baseline", "treated"):
        spark.createDataFrame([(k,) for k in range({"ids": 4, "baseline": 1, "treated": 3}[name])], "instance_id long").write.parquet(str(tmp_path / name))
    assert cli.main(["summarize", "--data", str(tmp_path), "--out", str(tmp_path / "sum")]) == 0
    assert spark.read.parquet(str(tmp_path / "sum")).first().b == 2
