"""Scalar functions on ids and texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = ("the", "a", "an", "to", "of", "in", "for", "and", "or", "is", "be", "before", "after", "with", "not", "this", "that", "it")
FILE_LINE = r"(?U)\b[\w./_-]+\.(?:py|js|ts|go|rs|c|cpp|h)(?::\d+|\s+line\s+\d+)\b"
RARE_SYMBOL = r"(?U)\b__\w+__\b|\b[A-Z][a-z]+(?:[A-Z][a-z]+){2,}\b"
ANCHOR = r"(?U)`[^`]+`|\b[\w-]+/[\w./-]+|\b\w+\.\w{1,5}\b(?!\.)"
RULE_BULLET = r"^- \*\*(.+?)\*\* \(([^)]*)\) — (.+)$"
STRATEGIES_BUCKET = "universal__strategies"


def repo_slug(instance_id: Column) -> Column:
    return F.regexp_replace(instance_id, "-[^-]*$", "")


def repo_of(instance_id: Column) -> Column:
    return F.regexp_replace(repo_slug(instance_id), "^(.*?)__", "$1/")


def slug_of_pair(pair_id: Column) -> Column:
    return repo_slug(F.substring_index(pair_id, "::", 1))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def one_line(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case words and single signs, without stop words."""
    every = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z_][A-Za-z0-9_.]*|\S"), 0)
    return F.filter(every, lambda t: ~t.isin(*STOP_WORDS))


def ngrams(toks: Column, n: int) -> Column:
    """Distinct n-grams, joined by spaces. The tokens are bound once, not worked out again for every n-gram."""

    def of(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.array(toks), of))


def overlap_hits(a: Column, b: Column, n: int) -> Column:
    return F.array_sort(F.array_intersect(ngrams(tokens(a), n), ngrams(tokens(b), n)))


def anchor_key(action_type: Column, target: Column) -> Column:
    """What two events are compared by: type and short lower-case base name."""
    base = F.substring_index(F.trim(F.lower(target)), "/", -1)
    return F.concat(action_type, F.lit("\x01"), F.substring(F.regexp_replace(base, "['\"]", ""), 1, 24))


def compact(action_type: Column, target: Column) -> Column:
    return F.when(F.coalesce(target, F.lit("")) != "", F.concat(action_type, F.lit(":"), target)).otherwise(action_type)


# The texts that the next three put together.
def evidence_tag(support: Column, z: Column, het: Column) -> Column:
    shown = F.when(z.isNotNull(), F.concat(F.lit(", z "), F.format_string("%+.2f", z))).otherwise(F.lit(""))
    return F.concat(F.lit("support "), support.cast("string"), shown, F.when(F.coalesce(het, F.lit(False)), F.lit(", HET")).otherwise(F.lit("")))


def strategy_bullet(title: Column, tag: Column, trigger: Column, action: Column, anchors: Column) -> Column:
    first = F.transform(F.slice(F.coalesce(anchors, F.array().cast("array<string>")), 1, 2), one_line)
    shown = F.when(F.size(first) > 0, F.concat(F.lit(" Anchors: "), F.array_join(first, " | "))).otherwise(F.lit(""))
    return F.concat(F.lit("- **"), one_line(title), F.lit("** ("), tag, F.lit(") — Trigger: "), one_line(trigger), F.lit(" Action: "), one_line(action), shown)


def residual_bullet(title: Column, tag: Column, body: Column) -> Column:
    return F.concat(F.lit("- **"), one_line(title), F.lit("** ("), tag, F.lit(") — "), one_line(body))


def json_of(reply: Column) -> Column:
    """The JSON of a noisy reply as VARIANT: all of it, a fenced block, the outermost braces or brackets; null if none parses."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    brackets = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.coalesce(*(F.try_parse_json(F.nullif(F.trim(c), F.lit(""))) for c in (reply, fenced, braces, brackets)))


def json_object_of(reply: Column) -> Column:
    v = json_of(reply)
    return F.when(F.schema_of_variant(v).like("OBJECT%"), v)


def single_bug_fact(rule: Column, category: Column) -> Column:
    many = F.size(F.regexp_extract_all(rule, F.lit(RARE_SYMBOL), 0)) >= 3
    return (F.coalesce(category, F.lit("")) != "search_recipe") & (rule.rlike(FILE_LINE) | many)


def anchored(rule: Column) -> Column:
    return rule.rlike(ANCHOR)


def first_index(v: Column) -> Column:
    """The first integer in a step reference such as "4,6,10"."""
    return F.regexp_extract(v.cast("string"), r"(\d+)", 1).try_cast("int")


def problem_statement(title: Column, *sections: Column) -> Column:
    """A title and the sections that are not empty, with blank lines between them."""
    return F.concat_ws("\n\n", title, *(F.nullif(F.trim(s), F.lit("")) for s in sections))


def elided(x: Column, limit: int = 10_000) -> Column:
    """A long observation: both ends and how many characters are left out between them."""
    half = limit // 2
    cut = F.concat(F.substring(x, 1, half), F.lit("\n<"), (F.length(x) - limit).cast("string"), F.lit(" characters left out>\n"), F.right(x, F.lit(half)))
    return F.when(F.length(x) < limit, x).otherwise(cut)
