"""Shell commands to events, as Spark Columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary of events and the patterns that decide them, in the order in which they are tried.
ACTION_TYPES = ("read", "search", "edit", "run_test", "run_python", "install", "git", "submit", "other")
BOOKKEEPING = ("cd", "pwd", "export", "true", "set")
INSTALLERS = ("pip", "pip3", "conda", "apt", "apt-get")
PYTHONS = ("python", "python2", "python3", "ipython")
READERS = ("cat", "head", "tail", "less", "more", "nl", "sed", "awk")
SEARCHERS = ("grep", "egrep", "fgrep", "rg", "ack", "find", "ls", "which", "locate", "tree")
WRAPPERS = r"(?U)^(?:cd\s+\S+\s*&&\s*|(?:[A-Za-z_][A-Za-z0-9_]*=\S+\s+)+|timeout\s+(?:-\S+\s+)*\d+\S*\s+)+"
SUBMIT = r"COMPLETE_TASK_AND_SUBMIT_FINAL_OUTPUT|MINI_SWE_AGENT_FINAL_OUTPUT"
TEST_RUNNER = r"(?U)\b(?:pytest|py\.test|tox)\b|python3?\s+(?:-\S+\s+)*-m\s+(?:pytest|unittest)\b|\bruntests?\.py\b"
SED_INPLACE = r"(?U)\bsed\b[^|;&]*\s-[a-zA-Z]*i"
EDIT_REDIRECT = r"""(?U)^(?:cat|echo|printf|tee)\b.*?>>?\s*['"]?/?\S+\.(?:py|pyx|pyi|c|h|cpp|cfg|ini|txt|rst|json|yaml|yml|toml)\b"""
REDIRECT_TARGET = r"""(?U)>>?\s*['"]?(/?\S+?\.\w+)"""
PATCH = r"(?U)^(?:patch|git\s+apply)\b"
PATH_TOKEN = r"(?U)(/?[\w./-]+\.[A-Za-z]\w*)"
QUOTED = r"""['"]([^'"]+)['"]"""
TEST_TOKEN = r"(?U)(\S*test\S*)"

#: One part and what ends it: quoted runs are whole (an open quote takes the rest), & counts only when doubled.
_PART = r"""(?s)((?:"(?:[^"\\]|\\(?:.|\z))*+(?:"|\z)|'[^']*+(?:'|\z)|[^;&"']++|&(?!&))*+)(?:&&|;|\z)"""
SPLIT_LIMIT = 2000


def stripped(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_wrappers(cmd: Column) -> Column:
    """The command behind leading cd ... &&, environment assignments and timeout ..."""
    return stripped(F.regexp_replace(stripped(cmd), WRAPPERS, ""))


def split_compound(cmd: Column) -> Column:
    """Parts between top-level && and ;. Here-documents and very long commands stay whole."""
    parts = F.filter(F.transform(F.regexp_extract_all(cmd, F.lit(_PART), 1), stripped), lambda p: p != "")
    return F.when(F.contains(cmd, F.lit("<<")) | (F.length(cmd) > SPLIT_LIMIT), F.array(cmd)).otherwise(parts)


def _tokens(core: Column) -> Column:
    return F.split(core, r"(?U)\s+")


def first_path(core: Column) -> Column:
    return F.regexp_extract(core, PATH_TOKEN, 1)


def search_target(core: Column) -> Column:
    """The first quoted string, else the first word behind the program that is no option."""
    plain = F.filter(F.slice(_tokens(core), 2, 1 << 20), lambda t: ~F.startswith(t, F.lit("-")))
    return F.coalesce(F.nullif(F.regexp_extract(core, QUOTED, 1), F.lit("")), F.try_element_at(plain, F.lit(1)), F.lit(""))


def classify_command(cmd: Column) -> Column:
    """struct(action_type, target) of one command; null for bookkeeping and empty ones."""
    core = strip_wrappers(cmd)
    prog = F.substring_index(F.element_at(_tokens(core), 1), "/", -1)
    behind = F.when(F.contains(core, F.lit(" ")), F.regexp_replace(core, r"(?U)^\S+\s+", "")).otherwise(F.lit(""))
    test = F.regexp_replace(F.regexp_extract(behind, TEST_TOKEN, 1), r"""^['"]+|['"]+$""", "")
    target = F.coalesce(F.nullif(F.regexp_extract(core, REDIRECT_TARGET, 1), F.lit("")), first_path(core))

    def event(kind: str, what: Column) -> Column:
        return F.struct(F.lit(kind).alias("action_type"), what.alias("target"))

    nothing = F.lit("")
    return (
        F.when((core == "") | prog.isin(*BOOKKEEPING), F.lit(None))
        .when(core.rlike(SUBMIT), event("submit", nothing))
        .when(prog.isin(*INSTALLERS), event("install", search_target(core)))
        .when(core.rlike(TEST_RUNNER), event("run_test", test))
        .when(core.rlike(SED_INPLACE), event("edit", first_path(core)))
        .when(core.rlike(EDIT_REDIRECT), event("edit", target))
        .when(core.rlike(PATCH), event("edit", first_path(core)))
        .when(prog.isin(*PYTHONS), event("run_python", first_path(core)))
        .when(prog.isin(*READERS), event("read", first_path(core)))
        .when(prog.isin(*SEARCHERS), event("search", search_target(core)))
        .when(prog == "git", event("git", F.coalesce(F.try_element_at(_tokens(core), F.lit(2)), nothing)))
        .otherwise(event("other", nothing))
    )
