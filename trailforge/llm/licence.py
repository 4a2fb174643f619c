"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences at blank lines, at semicolons and where a full stop, exclamation or question mark
precedes white space; at a line end a sentence may end or go on. A sentence is normalised (A-Z lower-cased, runs
of anything but letters and digits become one space) and mapped to the identifier of the known licence sentence
that it equals, the longest one if a sentence may end at several line ends. The identifiers of a text
in order are then matched against ordered rules: a rule holds if its identifiers occur in that order, with any
other sentences between them. Everything stays in one projection: no shuffle, join or Python.

Defined results: null and empty texts have no sentences and no licence; repeated rows each get a row; when rules
tie all are listed, in the order of the rules. Only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Identifiers of known licence sentences in normalised form.
SENTENCES = {
    "licensed under the apache license version 2 0": 1,
    "you may not use this file except in compliance with the license": 2,
    "you may obtain a copy of the license at": 3,
    "released under the mit license": 4,
    "permission is hereby granted free of charge to any person obtaining a copy of this software": 5,
    "the software is provided as is without warranty of any kind": 6,
    "this work is licensed under the gnu general public license version 3": 7,
    "this program is free software you can redistribute it and or modify it": 8,
    "licensed under cc by nc 4 0": 9,
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": 10,
    "all rights reserved": 11,
    "redistribution and use in source and binary forms with or without modification are permitted": 12,
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": 13,
}
#: Licence and the identifiers that have to follow one another.
RULES = [
    ("Apache-2.0", (1,)),
    ("Apache-2.0", (2, 3)),
    ("MIT", (4,)),
    ("MIT", (5, 6)),
    ("GPL-3.0", (7,)),
    ("GPL-3.0", (8, 6)),
    ("CC-BY-NC-4.0", (9,)),
    ("CC-BY-NC-4.0", (10,)),
    ("BSD-3-Clause", (12, 13)),
    ("Proprietary", (11,)),
]
#: Whole sentences of the standard texts, which go on behind those above or run into what follows them.
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_NOTICE = "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_HOLDER = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_COPY = "you may obtain a copy of the license at"
_APACHE_END = "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
_GPL = "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
WHOLE_SENTENCES = {
    "apache license version 2 0 january 2004": 1,
    "licensed under the apache license version 2 0 the license": 1,
    **{f"{_COPY} {p} www apache org licenses license 2 0{end}": 3 for p in ("http", "https") for end in ("", f" {_APACHE_END}")},
    _GRANT: 5,
    f"{_GRANT} {_NOTICE}": 5,
    f"{_AS_IS} noninfringement": 6,
    f"{_AS_IS} non infringement": 6,
    _BSD: 12,
    f"{_BSD} 1": 12,
    f"{_BSD} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": 12,
    _HOLDER: 13,
    f"this program is free software {_GPL}": 14,
    _GPL: 14,
    "gnu general public license version 3 29 june 2007": 14,
}
WHOLE_RULES = [("GPL-3.0", (14,))]
#: A cut and, after it, what is known: between words a space or a line end, before and behind a cut or a line end.
_CUT, _MARK = r"\n[^\p{L}\p{N}\n]*\n|;|[.!?][ \t\n]+", "\x01"
_BETWEEN = r"(?: ?\n ?| )"
_ANY_HOLDER = rf"neither{_BETWEEN}the{_BETWEEN}name{_BETWEEN}of{_BETWEEN}[\s\S]{{1,120}}?[ \n{_MARK}]nor{_BETWEEN}the{_BETWEEN}names{_BETWEEN}of"
_NAMED = re.compile("^neither the name of the copyright holder nor the names of")


def _pattern() -> str:
    every = sorted({**SENTENCES, **WHOLE_SENTENCES}, key=lambda x: (-len(x), x))
    body = [_ANY_HOLDER + _NAMED.sub("", x).replace(" ", _BETWEEN) if _NAMED.match(x) else x.replace(" ", _BETWEEN) for x in every]
    return rf"(?<=[{_MARK}\n] ?)(?:{'|'.join(body)})(?= ?[{_MARK}\n])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for kv in {**SENTENCES, **WHOLE_SENTENCES}.items() for x in kv])
    lines = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    lower = F.translate(lines, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r" + _MARK, "abcdefghijklmnopqrstuvwxyz\n ")
    cut = F.concat(F.lit(_MARK), F.regexp_replace(lower, _CUT, _MARK), F.lit(_MARK))
    plain = F.regexp_replace(cut, rf"[^\p{{L}}\p{{N}}\n{_MARK}]+", " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit(_pattern()), F.lit(0)), lambda s: F.regexp_replace(s, " ?\n ?", " "))
    found = F.transform(found, lambda s: F.regexp_replace(s, rf"^neither the name of [\s\S]{{1,120}}?[ {_MARK}]nor the names of", "neither the name of the copyright holder nor the names of"))
    return F.transform(found, lambda s: F.try_element_at(known, s))


def matched(ids: Column, rules: list[tuple[str, tuple[int, ...]]] = RULES + WHOLE_RULES) -> Column:
    """Licences whose rules hold for a sequence of identifiers, in the order of the rules."""
    line = F.concat(F.lit(","), F.array_join(ids.cast("array<string>"), ",,"), F.lit(","))
    found = [F.when(line.rlike("(?s)" + ".*".join(f",{i}," for i in seq)), F.lit(name)) for name, seq in rules]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def scan(docs: DataFrame, rules: list[tuple[str, tuple[int, ...]]] = RULES + WHOLE_RULES) -> DataFrame:
    """doc_id, sentence_ids and licences of every document."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(F.col("text")).alias("sentence_ids"))
    return seen.withColumn("licences", matched(F.col("sentence_ids"), rules))


def op9_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def _known() -> str:
    return ", ".join(f"('{s}', {i})" for s, i in SENTENCES.items())


def _rule_list() -> str:
    return ", ".join(f"CASE WHEN regexp_matches(line, '{'.*'.join(f',{i},' for i in seq)}') THEN '{name}' END" for name, seq in RULES)


def _names() -> str:
    return ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in RULES))


ORACLE = f"""
WITH known(sentence, id) AS (VALUES {_known()}),
cut AS (
  SELECT r, doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence
  FROM (SELECT row_number() OVER () AS r, doc_id,
               string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\n\\r;]+|[.!?]+[ \\t]+') AS s
        FROM documents)),
ids AS (
  SELECT r, doc_id, list(k.id ORDER BY pos) FILTER (WHERE k.id IS NOT NULL) AS ids
  FROM cut LEFT JOIN known k ON k.sentence = trim(regexp_replace(cut.sentence, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))
  GROUP BY r, doc_id),
lines AS (SELECT doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
                 ',' || coalesce(array_to_string(ids, ',,'), '') || ',' AS line FROM ids),
found AS (SELECT *, list_filter([{_rule_list()}], lambda x: x IS NOT NULL) AS f FROM lines)
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter([{_names()}], lambda x: list_contains(f, x)), ',') AS licences
FROM found"""
