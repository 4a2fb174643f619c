import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailforge.functions import predicate as P
from trailforge.functions.stats import chi2_sf, mcnemar_p
from trailforge.operators import cluster, pairing, reports, rules, score


def truth(node, events):
    """A plain evaluator to compare with."""

    def at(p):
        if p.kind == "first_edit":
            return [i for i, (k, _) in enumerate(events) if k == "edit"][:1]
        import re

        return [i for i, (k, c) in enumerate(events) if p.kind in ("any", k) and (not p.regex or re.search(p.regex, c, re.I))]

    if node.op in ("and", "or", "not"):
        parts = [truth(a, events) for a in node.args]
        return not parts[0] if node.op == "not" else all(parts) if node.op == "and" else any(parts)
    found = [at(a) for a in node.args]
    if node.op == "exists":
        return bool(found[0])
    if node.op == "count":
        return {">=": len(found[0]) >= node.n, "<": len(found[0]) < node.n, "==": len(found[0]) == node.n, ">": len(found[0]) > node.n, "<=": len(found[0]) <= node.n}[node.cmp]
    a, b = found
    pairs = list(itertools.product(a, b))
    return any(x < y for x, y in pairs) if node.op == "before" else any(x > y for x, y in pairs)


def test_predicates_against_plain_evaluation(spark):
    rng = random.Random(4)
    kinds, cmds = ["edit", "read", "search", "run_test"], ["a.py", "LIB/x", "été", "b.py -k q"]
    seqs = {f"t{k}": [(rng.choice(kinds), rng.choice(cmds)) for _ in range(rng.randint(0, 6))] for k in range(40)}
    texts = ["exists(edit(lib))", "count(any) >= 3", "before(read, first_edit)", "after(run_test, edit)", 'not exists(search) and count(read("\\\\w\\\\.py")) < 2', "exists(edit) or exists(read) and not exists(search)", 'exists(any("^\\\\w+$"))']
    pool = spark.createDataFrame([(t,) for t in seqs], "traj_id string")
    ev = spark.createDataFrame([(t, i, k, c) for t, s in seqs.items() for i, (k, c) in enumerate(s)], "traj_id string, i int, action_type string, command string")
    got = {r.traj_id: r for r in P.evaluate(pool, ev, {f"q{k}": t for k, t in enumerate(texts)}).collect()}
    for t, s in seqs.items():
        for k, x in enumerate(texts):
            assert got[t][f"q{k}"] == truth(P.parse(x), s), (x, s)


@pytest.mark.parametrize("bad", ["exists(nope)", "exists(edit", "count(edit) >= x", 'exists(read("("))', "exists(first_edit(x))", "exists(edit) exists(edit)", "", "?"])
def test_bad_predicates(bad):
    assert P.validate(bad)


def test_stats():
    assert chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    assert chi2_sf(9.487729, 4) == pytest.approx(0.05, abs=1e-6)
    assert mcnemar_p(0, 0) == 1.0 and mcnemar_p(0, 5) == pytest.approx(2 / 32)


def test_risk_difference(spark):
    rows = [("r", "i", k < 40, (k < 30) if k < 40 else (k < 50)) for k in range(80)] + [("r", "only", True, True)]
    m = score.stratified_lift(spark.createDataFrame(rows, "rule string, instance_id string, fires boolean, passed boolean"), ["rule"]).first()
    assert m.lift == pytest.approx(0.5) and m.n_strata_used == 1 and m.n_strata_empty == 1 and m.n_labeled == 81


def test_shared_prefix():
    k = lambda *x: [f"{a}\x01{b}" for a, b in x]
    a = k(("read", "a"), ("search", "b"), ("edit", "c"))
    assert pairing.shared_prefix(a, k(("read", "a"), ("search", "b"), ("run_test", "t"))) == (2, 2, 2)
    assert pairing.shared_prefix(k(("read", "a"), ("read", "z"), ("search", "b")), k(("read", "a"), ("search", "b"))) == (3, 2, 2)
    assert pairing.shared_prefix(k(("read", "a"), ("edit", "z"), ("search", "b")), k(("read", "a"), ("search", "b"))) == (1, 1, 1)
    assert pairing.shared_prefix([], a) == (0, 0, 0)


def test_linkage_and_valley(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, 5), rng.normal(5, 0.1, 4)])
    d = {(i, j): abs(x[i] - x[j]) for i in range(9) for j in range(i)}
    assert cluster.complete_linkage(list(range(9)), d, 2.0) == {i: int(i >= 5) for i in range(9)}
    h = [0] * 40
    h[20:24], h[36:39] = [5, 30, 40, 20], [4, 9, 3]
    valley = lambda counts: [r.cutoff for r in cluster.phi_valley(spark.createDataFrame([(k, n) for k, n in enumerate(counts) if n], "bin int, n long")).collect()]
    (cut,) = valley(h)
    assert 0.2 < cut < 0.85
    assert valley([0] * 40) == [] and valley([0] * 10 + [5, 9, 5] + [0] * 27) == []
    rng = np.random.default_rng(4)
    for _ in range(12):
        n = rng.integers(0, 6, 40)
        s = np.convolve(n, [1, 1, 1], "same")
        modes = [k for k in range(1, 39) if s[k] >= s[k - 1] and s[k] > s[k + 1]]
        low = [modes[-2] + int(np.argmin(s[modes[-2] : modes[-1] + 1]))] if len(modes) > 1 else []
        assert valley(n.tolist()) == pytest.approx([-1 + (2 * k + 1) / 40 for k in low])


def test_pooling(spark):
    rows = [("a", 0.2, 2.0), ("a", 0.4, 4.0), ("b", 0.3, 3.0), ("c", 0.1, None)]
    got = {r.c: r for r in cluster.pool_and_q(spark.createDataFrame(rows, "c string, lift double, z double"), ["c"]).collect()}
    assert got["a"].pooled_lift == 0.3 and got["a"].q == 2.0 and got["a"].q_p == pytest.approx(0.1573, abs=1e-4) and got["a"].homogeneous
    assert got["b"].n_scored == 1 and got["b"].pooled_z == pytest.approx(3.0) and got["b"].q is None
    assert got["c"].n_scored == 0 and got["c"].pooled_lift is None


def test_guards(spark):
    rows = [("action", "lookup", "look first", "exists(read)"), ("action", "lookup", "see a.py:12", "exists(read)"), ("action", "lookup", "x", "exists("), ("fact", "replay", "run `make`", "exists("), ("fact", "replay", "nothing here", None), (None, "lookup", "x", None), ("fact", "lookup", " ", None)]
    got = [(r.reason, r.predicate) for r in rules.guard(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, category string, rule string, predicate string")).orderBy("i").collect()]
    assert [g[0] and g[0].split(":")[0] for g in got] == [None, "anti_fact", "predicate_parse", None, "fact_unanchored", "bad_kind", "empty_rule"]
    assert got[3][1] is None


def test_fold_and_pack(spark):
    r = spark.createDataFrame([("b", "lookup", "T", "long body", 2, ["p1"], None, 0), ("b", "lookup", "t", "body", 3, ["p2"], "exists(edit)", 1), ("b", "lookup", "U", "u", 9, ["p3"], None, 2)], "bucket string, category string, title string, body string, support int, source_pair_ids array<string>, predicate string, pos int")
    got = {x.title: x for x in rules.fold_titles(r).collect()}
    assert got["T"].support == 5 and got["T"].body == "long body" and got["T"].source_pair_ids == ["p1", "p2"] and got["T"].predicate == "exists(edit)" and got["T"].rule_id == "b:lookup:1"
    res = spark.createDataFrame([("x__y", 0, "A  b", 3, None, "do\nit"), ("x__y", 1, "C", 4, 1.5, "now")], "repo string, pos int, title string, support int, z double, body string")
    files = reports.skill_files(reports.residual_bullets(res))
    assert "- **C** (support 4, z +1.50) — now\n- **A b** (support 3) — do it\n" in files.first().text
    back = reports.parse_skill_lines(files.select("bucket", F.posexplode(F.split("text", "\n")).alias("pos", "line"))).orderBy("i").collect()
    assert [(b.rule_id, b.title, b.support) for b in back] == [("x__y/skill/0", "C", 4), ("x__y/skill/1", "A b", 3)]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    row = e.entry(spark).first()
    assert row.n_strata_used == 19 and row.lift == pytest.approx(0.2917, abs=1e-4) and math.isfinite(row.z)


def test_registered_queries_over_all_ids_and_rules(spark):
    from trailforge.plans import demo, registry

    sf, q = "/root/testdata/sf0.001", registry.QUERIES
    keys = {int(r[0]) for r in demo.table(spark, sf, "orders").select("o_orderkey").collect()}
    pool = demo.pool(spark, sf).select("traj_id", "instance_id", "repo", "outcome").collect()
    assert {r[0] for r in q["leakage"](spark, sf).collect()} == {r.instance_id for r in pool} & keys
    pairs = registry._rule_table(spark, sf)[0].select("repo", "fail_traj_id", "pass_traj_id").collect()
    repos = {r.repo for r in pairs}
    names = [*demo.PREDICATES, "none", "bad"]
    outcomes = {}
    for r in pool:
        outcomes.setdefault(r.instance_id, set()).add(r.outcome)
    sources = {(p.repo, t) for p in pairs for t in (p.fail_traj_id, p.pass_traj_id)}
    held = {(f"{r.repo}:{n}", r.traj_id) for r in pool for n in names if r.repo in repos and {"pass", "fail"} <= outcomes[r.instance_id] and r.outcome in ("pass", "fail") and (r.repo, r.traj_id) not in sources}
    assert {(r.rule_id, r.traj_id) for r in q["holdout_anti"](spark, sf).collect()} == held
    got = {r.rule_id: (r.status, r.reason) for r in q["score_rules"](spark, sf).collect()}
    assert set(got) == {f"{x}:{n}" for x in repos for n in names}
    assert all(got[f"{x}:none"] == ("fallback", "no_predicate") and got[f"{x}:bad"][0] == "fallback" and got[f"{x}:bad"][1].startswith("predicate_error") for x in repos)


def test_mcnemar_in_sql_functions(spark):
    from trailforge.functions.stats import mcnemar_column

    cases = [(0, 0), (0, 5), (1, 0), (1, 1), (3, 3), (7, 2), (20, 21), (40, 13), (300, 350), (2000, 2100), (1500, 100)]
    got = spark.createDataFrame(cases, "b long, c long").select("b", "c", mcnemar_column(F.col("b"), F.col("c")).alias("p")).collect()
    assert len(got) == len(cases)
    for r in got:
        assert r.p == pytest.approx(mcnemar_p(r.b, r.c), rel=1e-9), r
    # counts of a large table: the exact p is the normal one there, up to its continuity correction
    b, c = 500_000_000, 500_050_000
    big = spark.createDataFrame([(b, c)], "b long, c long").select(mcnemar_column(F.col("b"), F.col("c")).alias("p")).first()
    assert big.p == pytest.approx(math.erfc((c - b - 1) / math.sqrt(b + c) / math.sqrt(2)), rel=1e-6)


def test_replay_of_prompts_that_recur(spark, tmp_path):
    from trailforge.plans import registry

    rows = [(1, 0, "user", "hi"), (1, 1, "user", "hi"), (2, 3, "user", "hi"), (2, 2, "user", "hi"), (3, 2, "user", "hi"), (3, 5, "user", "else"), (4, 0, "user", None), (4, 1, None, "x"), (5, None, "user", "hi")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(registry.QUERIES["replay_join"](spark, str(tmp_path)).collect(), key=str)
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLE["replay_join"]).fetchall(), key=str)
    assert sorted(map(tuple, got), key=str) == want and len(got) == len(rows)
