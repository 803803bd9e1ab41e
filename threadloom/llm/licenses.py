"""License scans: ordered signature rules over normalised words, in built-in functions only.

A text becomes lower-case words. Each rule has words that
any text it fits must hold; documents with none of these phrases take no further work. In the others, each word that heads a rule opens a window of a few words, and the rules of
that head are tried there as regular expressions anchored at its start. Detections are then
resolved: sorted by start, longest and highest level first, one is dropped when an earlier
one of at least its level covers its interval. Everything happens inside the row, so there
is no shuffle, and a source that holds a third of all documents changes nothing.

Three plain phrases (the base) are counted at all their places, whatever the resolution says.

Defined results: null or empty text has no words, no places (first and last are null), empty
labels and score 0; each input row gives one output row, repeated rows and null ids included;
other columns of the input are kept in ``scan`` unless they clash with a result's name.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import ascii_lower, let, quoted, unused

WINDOW = 40  # words a rule can see
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Families of licenses: label, spellings, versions (empty: none).
FAMILIES = (
    ("apache", ("apache license", "apache software license", "apache"), ("1 0", "1 1", "2 0")),
    ("gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl", "lgpl"), ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1 0", "3 0", "3")),
    ("gfdl", ("gnu free documentation license", "free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1 0", "1 1", "1 2")),
    ("cpl", ("common public license",), ("1 0",)),
    ("bsl", ("boost software license",), ("1 0",)),
    ("artistic", ("artistic license",), ("1 0", "2 0")),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1")),
    ("osl", ("open software license",), ("1 0", "2 0", "3 0")),
    ("afl", ("academic free license",), ("2 1", "3 0")),
    ("zpl", ("zope public license",), ("2 0", "2 1")),
    ("php", ("php license",), ("3 0", "3 01")),
    ("python", ("python software foundation license", "python license"), ("2", "2 0")),
    ("ms-pl", ("microsoft public license",), ()),
    ("ms-rl", ("microsoft reciprocal license",), ()),
    ("mit", ("mit license", "x11 license", "expat license"), ()),
    ("isc", ("isc license",), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("ncsa", ("ncsa open source license",), ()),
    ("unlicense", ("the unlicense", "unlicense"), ()),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ()),
    ("postgresql", ("postgresql license",), ()),
    ("openssl", ("openssl license",), ()),
    ("bsd", ("bsd license", "new bsd license", "modified bsd license", "simplified bsd license"), ()),
    ("bsd-2-clause", ("2 clause bsd license", "bsd 2 clause license", "bsd 2 clause", "freebsd license"), ()),
    ("bsd-3-clause", ("3 clause bsd license", "bsd 3 clause license", "bsd 3 clause"), ()),
    ("bsd-4-clause", ("4 clause bsd license", "bsd 4 clause license", "bsd 4 clause"), ()),
    ("cc0", ("creative commons zero", "cc0"), ("1 0",)),
)
CC_TERMS = {"": "", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike", "nc sa": "noncommercial sharealike", "nc nd": "noncommercial noderivatives"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Opening words of well-known texts: pattern, label.
TEXTS = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("neither the name of .{1,80} nor the names of its contributors may be used", "bsd-3-clause"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("this library is free software you can redistribute it and or modify", "lgpl"),
    ("this software is provided as is without any express or implied warranty", "zlib"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache"),
    ("copyright .{0,80}?all rights reserved", "proprietary"),
    ("proprietary and confidential", "proprietary"),
    ("released into the public domain", "public-domain"),
)


class Rule(NamedTuple):
    head: str
    pattern: str
    label: str
    level: int


def _rule(words: str, label: str, level: int) -> Rule:
    return Rule(words.split(" ")[0], f"^{words}(?= |$)", label, level)


def rules() -> list[Rule]:
    """All rules in order; levels: 1 a name, 2 a name with its version, 3 a license text or tag."""
    out = []
    for label, spellings, versions in FAMILIES:
        for s in spellings:
            if " " in s or s in ("unlicense", "wtfpl", "cc0", "cddl", "eupl", "gfdl", "lgpl", "agpl", "gpl"):
                out.append(_rule(s, label, 1))
            for v in versions:
                shown = f"{label}-{v.replace(' ', '.')}"
                out.append(_rule(f"{s} (?:version |v |v)?{v}(?: only)?", shown, 2))
                if "gpl" in label:
                    out.append(_rule(f"{s} (?:version |v |v)?{v} or (?:any )?later(?: version)?", f"{shown}+", 2))
        for v in versions or ("",):
            tag = f"{label} {v}".strip().replace("-", " ")
            out.append(_rule(f"spdx license identifier {tag}(?: only| or later)?", f"{label}-{v.replace(' ', '.')}".strip("-"), 3))
    for terms, named in CC_TERMS.items():
        label = "-".join(["cc-by", *terms.split()])
        for short in (f"cc by {terms}".strip(), f"creative commons attribution {named}".strip()):
            out.append(_rule(short, label, 1))
            out += [_rule(f"{short} (?:license |international |version )?{v}", f"{label}-{v.replace(' ', '.')}", 2) for v in CC_VERSIONS]
    out += [_rule(p, label, 3) for p, label in TEXTS]
    return out


def needed(rule: Rule) -> str:
    """Words that every text the rule fits holds, between spaces: those its pattern opens with."""
    lead = re.match(r"\^(\w[\w ]*)(\(\?= \|\$\)$|\(|\.|$)", rule.pattern)
    if not lead or "|" in re.sub(r"\([^()]*\)", "", rule.pattern):
        return f" {rule.head} "
    return f" {lead[1]} " if lead[2].startswith("(?=") else f" {lead[1]}"


def gate_phrases(held: list[Rule]) -> list[str]:
    """Phrases of the gate: those of the rules and of the base, without any that holds another."""
    phrases = {needed(r) for r in held} | {f" {phrase} " for phrase in BASE}
    return sorted(p for p in phrases if not any(q != p and q in p for q in phrases))


def _table(held: list[Rule]) -> Column:
    rows = json.dumps([r._asdict() for r in held])
    return F.from_json(F.lit(rows), "array<struct<head:string,pattern:string,label:string,level:int>>")


def _detections(words: Column, held: list[Rule]) -> Column:
    """Resolved detections of one document: array of struct(start, end, level, label)."""
    heads = F.array(*(F.lit(h) for h in sorted({r.head for r in held})))
    table = _table(held)
    places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_contains(heads, F.element_at(words, i)))

    def at(i: Column) -> Column:
        def tried(window: Column) -> Column:
            fits = F.filter(table, lambda r: (r.head == F.element_at(words, i)) & F.rlike(window, r.pattern))
            return F.transform(fits, lambda r: F.struct((i - 1).alias("start"), (-(i - 1 + F.size(F.split(F.call_function("regexp_extract", window, r.pattern, F.lit(0)), " ")))).alias("neg_end"), (-r.level).alias("neg_level"), r.label.alias("label")))

        return let(F.array_join(F.slice(words, i, F.lit(WINDOW)), " "), tried)

    found = F.sort_array(F.flatten(F.transform(places, at)))
    reach = lambda level: F.lit(-1).alias(f"m{level}")
    start = F.struct(reach(1), reach(2), reach(3), F.expr("cast(array() as array<struct<start:int,end:int,level:int,label:string>>)").alias("out"))

    def step(s: Column, d: Column) -> Column:
        end, level = -d.neg_end, -d.neg_level
        covered = F.when(level == 1, s.m1 >= end).when(level == 2, s.m2 >= end).otherwise(s.m3 >= end)
        far = [F.when(level >= k, F.greatest(s[f"m{k}"], end)).otherwise(s[f"m{k}"]).alias(f"m{k}") for k in (1, 2, 3)]
        kept = F.array_append(s.out, F.struct(d.start.cast("int").alias("start"), end.cast("int").alias("end"), level.cast("int").alias("level"), d.label.alias("label")))
        return F.struct(*far, F.when(covered, s.out).otherwise(kept).alias("out"))

    return F.aggregate(found, start, step, lambda s: s.out)


def _base(words: Column) -> Column:
    """Places of base phrases: array of struct(start from 0, label)."""

    def places(parts: list[str], label: str) -> Column:
        is_it = lambda i: (F.element_at(words, i) == parts[0]) & (F.slice(words, i, F.lit(len(parts))) == F.array(*map(F.lit, parts)))
        return F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), is_it), lambda i: F.struct((i - 1).cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*(places(phrase.split(" "), label) for phrase, label in BASE.items()))


def scan(docs: DataFrame, text: str = "text", held: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``detections``.

    score is the level of the best detection over 3 (a base phrase counts as level 1), 0 where there is none.
    """
    held = rules() if held is None else held
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(quoted(text)), F.lit(""))), NOT_WORD, " ")), F.lit(" "))
    normal, resolved = unused(docs, "_norm"), unused(docs, "_r")
    norm = F.col(normal)
    gate = F.lit(False)
    for k in gate_phrases(held):
        gate = gate | F.contains(norm, F.lit(k))
    none = F.expr("cast(null as struct<base:array<struct<start:bigint,label:string>>,found:array<struct<start:int,end:int,level:int,label:string>>>)")
    result = F.when(gate, let(F.split(F.trim(norm), " "), lambda w: F.struct(_base(w).alias("base"), _detections(w, held).alias("found")))).otherwise(none)
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
    kept = [quoted(c) for c in docs.columns if c not in new]
    base, found = (F.coalesce(F.col(resolved)[part], F.array()) for part in ("base", "found"))
    label = lambda e: e.label
    return (
        docs.select(*kept, spaced.alias(normal))
        .select(*kept, F.when(norm == "  ", 0).otherwise(F.length(norm) - F.length(F.translate(norm, " ", "")) - 1).cast("long").alias("n_words"), result.alias(resolved))
        .select(
            *kept, "n_words",
            F.size(base).cast("long").alias("n_base"),
            F.array_min(F.transform(base, lambda e: e.start)).alias("first_word"),
            F.array_max(F.transform(base, lambda e: e.start)).alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(base, label))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform(base, label), F.transform(found, label)))), ",").alias("labels"),
            (F.greatest(F.coalesce(F.array_max(F.transform(found, lambda e: e.level)), F.lit(0)), F.when(F.size(base) > 0, 1).otherwise(0)) / 3.0).alias("score"),
            found.alias("detections"),
        )
    )
