"""The sequence-predicate language: parsed on the driver, evaluated as Columns over per-trajectory features.

    expr := clause (("and" | "or") clause)*      both bind alike, from left to right
    clause := "not" clause | atom
    atom := "(" expr ")" | exists(E) | count(E) cmp N | before(E, E) | after(E, E)
    E := type | type(*) | type(word) | type("regex") | first_edit | any...

Evaluation needs, for each trajectory and pattern, how often and at which first and last position it matched.
All patterns of all predicates are matched in one pass against distinct (type, command) pairs.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .commands import ACTION_TYPES

COMPARATORS = {">=": "ge", ">": "gt", "<=": "le", "<": "lt", "==": "eq"}
# Fixed value: the tokens of the language; error texts are fixed too, as they end up in reasons.
_LEX = re.compile(r'\s*(?:("(?:[^"\\]|\\.)*")|([<>=]=|[<>])|([(),*])|([A-Za-z_][\w.\-/]*|[0-9]+))', re.ASCII)


class PredicateError(ValueError):
    """The text is no predicate; the message says why."""


@dataclass(frozen=True)
class Pattern:
    """What an event has to be: its type (or any, or first_edit) and a regular expression, empty for all."""

    kind: str
    regex: str = ""


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = ()
    cmp: str = ""
    n: int = 0

    def patterns(self) -> set[Pattern]:
        return set().union(*({a} if isinstance(a, Pattern) else a.patterns() for a in self.args))


def _lex(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise PredicateError(f"bad token at: {text[at : at + 20]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def parse(text: str) -> Node:
    todo = _lex(text)[::-1]

    def pop(*want: str) -> str:
        got = todo.pop() if todo else None
        if got is None or want and got not in want:
            raise PredicateError(f"expected {' or '.join(want) or 'more'}, got {got!r}")
        return got

    def pattern() -> Pattern:
        kind = pop()
        if kind == "first_edit":
            return Pattern(kind)
        if kind not in (*ACTION_TYPES, *EXTRA_TYPES, "any"):
            raise PredicateError(f"unknown action_type {kind!r}")
        if not todo or todo[-1] != "(":
            return Pattern(kind)
        pop("(")
        raw = pop()
        if raw == "*":
            source = ""
        elif raw[0] == '"':
            try:
                source = json.loads(raw)
            except ValueError as e:
                raise PredicateError(f"bad quoted pattern {raw}: {e}") from e
        else:
            source = re.escape(raw)
        pop(")")
        try:
            re.compile(source)
        except re.error as e:
            raise PredicateError(f"bad regex {source!r}: {e}") from e
        return Pattern(kind, source)

    def clause() -> Node:
        word = pop()
        if word == "not":
            return Node("not", (clause(),))
        if word == "(":
            inner = chain()
            pop(")")
            return inner
        if word not in ("exists", "count", "before", "after"):
            raise PredicateError(f"unexpected token {word!r}")
        pop("(")
        args = [pattern()]
        if word in ("before", "after"):
            pop(",")
            args.append(pattern())
        pop(")")
        if word != "count":
            return Node(word, tuple(args))
        cmp, n = pop(*COMPARATORS), pop()
        if not n.isdigit():
            raise PredicateError(f"count needs int, got {n!r}")
        return Node("count", tuple(args), cmp, int(n))

    def chain() -> Node:
        left = clause()
        while todo and todo[-1] in ("and", "or"):
            op = todo.pop()
            left = Node(op, (left, clause()))
        return left

    tree = chain()
    if todo:
        raise PredicateError(f"trailing tokens: {todo[::-1]}")
    return tree


#: Event types beyond those of commands, for other event logs.
EXTRA_TYPES = ("click", "error", "purchase", "signup", "view")


def validate(text: str) -> str | None:
    """None for a predicate, else why it is none."""
    try:
        parse(text)
    except PredicateError as e:
        return str(e)


def matches(p: Pattern, kind: Column, command: Column) -> Column:
    """Whether an event fits a pattern, position aside."""
    ok = F.lit(True) if p.kind == "any" else kind == ("edit" if p.kind == "first_edit" else p.kind)
    if p.kind != "first_edit" and p.regex not in ("", "*"):
        if java_safe(p.regex):
            ok = ok & F.coalesce(command, F.lit("")).rlike("(?iu)" + p.regex)
        else:
            ok = ok & _python_search(p.regex)(F.coalesce(command, F.lit("")))
    return ok


_SAFE = re.compile(r"(?:[A-Za-z0-9 _\-/=:;,\"'`~@%&<>!]|\\[.\-+*?()\[\]{}|^$/\\ ]|\.|\||\*|\+|\?|\(\?:|\(|\)|\[\^?[A-Za-z0-9_\-.]+\]|\^)*", re.ASCII)


def java_safe(regex: str) -> bool:
    """Whether Java reads a pattern as Python does: no classes by letter, anchors to the end, groups by name or sets within sets."""
    return _SAFE.fullmatch(regex) is not None and not re.search(r"[*+?]\+|\(\?(?!:)|\?\?|&&", regex)


def _python_search(regex: str):
    @F.pandas_udf("boolean")
    def search(s: pd.Series) -> pd.Series:
        return s.str.contains(re.compile(regex, re.IGNORECASE))

    return search


def features(events: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(traj_id, feat): for every pattern, by its place in the list, the count n and positions lo and hi of its matches."""
    kinds = events.select("action_type", "command").distinct()
    hits = [matches(p, F.col("action_type"), F.col("command")).alias(f"h{k}") for k, p in enumerate(patterns)]
    known = kinds.select("action_type", F.coalesce("command", F.lit("")).alias("cmd"), *hits).distinct()
    both = events.withColumn("cmd", F.coalesce("command", F.lit(""))).join(known, ["action_type", "cmd"])
    aggs = []
    for k, p in enumerate(patterns):
        at = F.when(F.col(f"h{k}"), F.col("i"))
        lo = F.min(at)
        hi, n = (lo, F.when(lo.isNotNull(), 1).otherwise(0)) if p.kind == "first_edit" else (F.max(at), F.count(at))
        aggs.append(F.struct(n.cast("long").alias("n"), lo.alias("lo"), hi.alias("hi")).alias(f"f{k}"))
    return both.groupBy("traj_id").agg(*aggs)


def label(node: Node, patterns: list[Pattern]) -> Column:
    """Truth of a tree over the columns of features(); a trajectory without a row there has no match."""

    def of(p: Pattern, field: str) -> Column:
        return F.col(f"f{patterns.index(p)}").getField(field)

    def total(p: Pattern) -> Column:
        return F.coalesce(of(p, "n"), F.lit(0))

    if node.op == "exists":
        return total(node.args[0]) > 0
    if node.op == "count":
        n = total(node.args[0])
        return {"ge": n >= node.n, "gt": n > node.n, "le": n <= node.n, "lt": n < node.n, "eq": n == node.n}[COMPARATORS[node.cmp]]
    if node.op == "before":
        return F.coalesce(of(node.args[0], "lo") < of(node.args[1], "hi"), F.lit(False))
    if node.op == "after":
        return F.coalesce(of(node.args[0], "hi") > of(node.args[1], "lo"), F.lit(False))
    parts = [label(a, patterns) for a in node.args]
    if node.op == "not":
        return ~parts[0]
    return reduce(lambda a, b: a & b if node.op == "and" else a | b, parts)


def evaluate(pool: DataFrame, events: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """pool with one boolean column per named predicate; trajectories without events count as empty sequences."""
    trees = {name: parse(text) for name, text in predicates.items()}
    patterns = sorted(set().union(*(t.patterns() for t in trees.values())), key=lambda p: (p.kind, p.regex))
    feats = features(events, patterns)
    return pool.join(feats, "traj_id", "left").select(*pool.columns, *(label(t, patterns).alias(name) for name, t in trees.items()))


def fires(pool: DataFrame, events: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule_id, traj_id) for every rule that holds on a trajectory; equal predicates are evaluated once."""
    distinct = {text: f"p{k}" for k, text in enumerate(sorted(set(rules.values())))}
    done = evaluate(pool.select("traj_id"), events, {c: t for t, c in distinct.items()})
    pairs = F.array(*[F.when(F.col(distinct[t]), F.lit(r)) for r, t in rules.items()])
    return done.select("traj_id", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("rule_id")).select("rule_id", "traj_id")


def occurrence_rate(pool: DataFrame, events: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """One row (name, rate) a predicate over all trajectories; 0 for an empty pool."""
    done = evaluate(pool, events, predicates)
    one = done.agg(*(F.coalesce(F.avg(F.col(n).cast("double")), F.lit(0.0)).alias(n) for n in predicates))
    return one.select(F.explode(F.create_map(*[x for n in predicates for x in (F.lit(n), F.col(n))])).alias("name", "rate"))
