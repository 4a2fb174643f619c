
from pyspark.sql import functions as F

from trailforge.functions.commands import classify_command, split_compound, strip_wrappers
from trailforge.operators.events import extract_events, steps_of

CASES = [
    ("cd /x && grep -rn 'foo bar' src/", ("search", "foo bar")),
    ("rg -n needle src", ("search", "needle")),
    ("A=1 B=2 timeout -k5 10s pytest -x tests/test_a.py::t", ("run_test", "tests/test_a.py::t")),
    ("python -m unittest a.test_b", ("run_test", "unittest")),
    ("sed -i 's/a/b/' lib/a.py", ("edit", "lib/a.py")),
    ("sed -n 1,5p lib/a.py", ("read", "lib/a.py")),
    ("echo hi > notes.txt", ("edit", "notes.txt")),
    ("git apply fix.patch", ("edit", "fix.patch")),
    ("git diff HEAD", ("git", "diff")),
    ("git", ("git", "")),
    ("/usr/bin/python3 run.py", ("run_python", "run.py")),
    ("pip install -q numpy", ("install", "install")),
    ("make all", ("other", "")),
    ("pwd", None),
    ("cd /x &&", None),
    ("  ", None),
]
SPLITS = [
    ("a && b; c", ["a", "b", "c"]),
    ("echo 'x && y'; z", ["echo 'x && y'", "z"]),
    ('echo "a\\"; b" && c', ['echo "a\\"; b"', "c"]),
    ("a & b | c || d", ["a & b | c || d"]),
    ("a &&& b", ["a", "& b"]),
    ("echo 'open ; x", ["echo 'open ; x"]),
    ("cat <<E\na; b\nE", ["cat <<E\na; b\nE"]),
    (" ; ", []),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    got = {r.i: r.e and tuple(r.e) for r in df.select("i", classify_command(F.col("c")).alias("e")).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, e in CASES]


def test_split_and_strip(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(SPLITS)], "i int, c string")
    got = {r.i: r.e for r in df.select("i", split_compound(F.col("c")).alias("e")).collect()}
    assert [got[i] for i in range(len(SPLITS))] == [e for _, e in SPLITS]
    one = spark.range(1).select(strip_wrappers(F.lit("  cd a && X=1 timeout 5 cd b && ls ")).alias("s")).first().s
    assert one == "ls"


def test_events_of_steps(spark):
    steps = spark.createDataFrame([("t", 0, "observation", "ls"), ("t", 1, "action", "cat a.py && cat a.py; ls -l src"), ("t", 2, "action", None), ("t", 3, "action", "pytest tests")], "traj_id string, step_idx int, kind string, command string")
    got = [tuple(r) for r in extract_events(steps).orderBy("i").collect()]
    assert got == [("t", 0, 1, "read", "a.py", "cat a.py && cat a.py; ls -l src"), ("t", 1, 1, "search", "src", "cat a.py && cat a.py; ls -l src"), ("t", 2, 3, "run_test", "tests", "pytest tests")]


def test_both_dialects(spark):
    chat = '{"messages":[{"role":"system","content":"s"},{"role":"assistant","content":"go","tool_calls":[{"function":{"arguments":"{bad"}},{"function":{"arguments":"{\\"command\\":\\"ls\\"}"}}]},{"role":"tool","content":"out"},{"role":"assistant","content":"end"}]}'
    resp = '{"messages":[{"output":[{"type":"message","content":[{"text":"a"},{"text":"b"}]},{"type":"function_call","arguments":"{\\"command\\":\\"pwd\\"}"}]},{"type":"function_call_output","output":"","extra":{"raw_output":"r"}},{"output":[]}]}'
    raw = spark.createDataFrame([("c", chat), ("r", resp)], "traj_id string, j string").select("traj_id", F.parse_json("j").alias("doc"))
    got = {t: [(r.kind, r.content, r.command) for r in steps_of(raw).where(F.col("traj_id") == t).orderBy("step_idx").collect()] for t in "cr"}
    assert got["c"] == [("action", "go", "ls"), ("observation", "out", None), ("thought", "end", None)]
    assert got["r"] == [("action", "a\nb", "pwd"), ("observation", "r", None), ("thought", "None", None)]
