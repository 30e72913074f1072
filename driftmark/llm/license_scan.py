"""License scan: Aho-Corasick over words, a shunting-yard parser over license expressions.

A text is lower-cased (A-Z) and reduced to its words, joined by one blank. One automaton finds every
notice phrase and every identifier tag in a single pass, overlapping ones included; a phrase only matches
whole words. After a tag ("SPDX-License-Identifier:", "License-Expression:") the rest of the line is read as
an expression of license ids, ``and``, ``or``, ``with`` and parentheses. The parser keeps the longest
beginning that is an expression and evaluates it with an operator stack: both sides of ``and`` apply, so
the stricter counts; of ``or`` the milder may be chosen; ``with`` an exception makes a copyleft milder.

A document is judged by itself: nothing is shuffled, and every batch is cut by bytes.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# The phrases of the contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Further phrases, in words, and how much a single find says about the text.
NAMED, GRANTED, DECLARED = 0.5, 0.8, 0.95
NOTICES = {
    "lesser general public license": ("lgpl", NAMED), "library general public license": ("lgpl", NAMED),
    "affero general public license": ("agpl", NAMED), "mozilla public license": ("mpl", NAMED),
    "eclipse public license": ("epl", NAMED), "bsd license": ("bsd", NAMED), "isc license": ("isc", NAMED),
    "zlib license": ("zlib", NAMED), "boost software license": ("bsl", NAMED), "artistic license": ("artistic", NAMED),
    "common development and distribution license": ("cddl", NAMED), "creative commons zero": ("cc0", NAMED),
    "cc by 4 0": ("cc-by", NAMED), "cc by sa 4 0": ("cc-by-sa", NAMED), "cc by nc 4 0": ("cc-by-nc", NAMED),
    "cc by nd 4 0": ("cc-by-nd", NAMED), "creative commons attribution": ("cc-by", NAMED),
    "released into the public domain": ("unlicense", GRANTED),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", GRANTED),
    "redistribution and use in source and binary forms": ("bsd", GRANTED),
    "permission to use copy modify and or distribute this software": ("isc", GRANTED),
    "you may not use this file except in compliance with the license": ("apache", GRANTED),
    "under the terms of the gnu general public license": ("gpl", GRANTED),
    "under the terms of the gnu lesser general public license": ("lgpl", GRANTED),
    "under the terms of the gnu affero general public license": ("agpl", GRANTED),
}
TAGS = ("spdx license identifier", "license expression")

# Classes of terms from mild to strict, and the class of every family of ids. "reference" is any LicenseRef- id.
CLASSES = ("public domain", "permissive", "weak copyleft", "copyleft", "network copyleft", "restricted", "unknown")
FAMILIES = {
    "cc0": 0, "unlicense": 0, "wtfpl": 0, "0bsd": 0, "mit": 1, "x11": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1,
    "ncsa": 1, "psf": 1, "python": 1, "postgresql": 1, "artistic": 1, "cc-by": 1, "mpl": 2, "epl": 2, "cddl": 2, "lgpl": 2,
    "ms-pl": 2, "gpl": 3, "eupl": 3, "cc-by-sa": 3, "agpl": 4, "cc-by-nc": 5, "cc-by-nd": 5, "cc-by-nc-sa": 5,
    "cc-by-nc-nd": 5, "busl": 5, "sspl": 5, "reference": 6,
}
_ID = re.compile(r"(?P<family>" + "|".join(sorted(map(re.escape, FAMILIES), key=len, reverse=True)) + r")(-\d+(-clause|(\.\d+)*))?(-only|-or-later|-patent|-clear)?\+?")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:-]+")
_EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*")
_BINDING = {"or": 1, "and": 2, "with": 3}


class Terms(NamedTuple):
    """What an expression comes to: its class and the families it names."""

    strictness: int
    families: frozenset[str]


def _operand(token: str) -> Terms | None:
    if re.fullmatch(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", token):
        return Terms(FAMILIES["reference"], frozenset(("reference",)))
    found = _ID.fullmatch(token)
    return found and Terms(FAMILIES[found["family"]], frozenset((found["family"],)))


def _apply(operator: str, left: Terms, right: Terms) -> Terms:
    if operator == "with":
        return Terms(left.strictness - 1 if 2 < left.strictness < 5 else left.strictness, left.families)
    pick = min if operator == "or" else max
    return Terms(pick(left.strictness, right.strictness), left.families | right.families)


def _whole(tokens: list[str]) -> int:
    """Length of the longest beginning of ``tokens`` that is an expression; 0 if there is none."""
    depth, operand, after_with, end, ids = 0, False, False, 0, False
    for i, token in enumerate(tokens):
        if not operand:
            if token == "(" and not after_with:
                depth += 1
            elif _EXCEPTION.fullmatch(token) if after_with else _operand(token):
                operand, ids, after_with = True, not after_with, False
            else:
                break
        elif token == ")" and depth:
            depth, ids = depth - 1, False
        elif token in _BINDING and (token != "with" or ids):
            operand, after_with = False, token == "with"
        else:
            break
        if operand and not depth:
            end = i + 1
    return end


def evaluate(expression: str) -> Terms | None:
    """The terms of the longest beginning of ``expression`` that is one; None when nothing of it is.

    ``with`` binds closest, then ``and``, then ``or``; equal operators work from the left. Letters of
    either case are alike. Unbalanced parentheses, unknown ids and left-over operators end it.
    """
    tokens = _TOKEN.findall(expression.lower())
    values: list[Terms] = []
    pending: list[str] = []

    def reduce() -> None:
        right, left = values.pop(), values.pop()
        values.append(_apply(pending.pop(), left, right))

    for token in tokens[:_whole(tokens)]:
        if token == "(":
            pending.append(token)
        elif token == ")":
            while pending[-1] != "(":
                reduce()
            pending.pop()
        elif token in _BINDING:
            while pending and pending[-1] != "(" and _BINDING[pending[-1]] >= _BINDING[token]:
                reduce()
            pending.append(token)
        else:
            values.append(_operand(token) or Terms(0, frozenset()))
    while pending:
        reduce()
    return values[0] if values else None


# Bytes that belong to words of lower-cased text: digits, a-z and all of non-ASCII; the rest reads as a blank.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _automaton() -> ahocorasick.Automaton:
    """Phrases with a blank on either side, so that only whole words match; blanks may be shared."""
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def _scan(raw: bytes, automaton: ahocorasick.Automaton) -> tuple:
    """One text: n_words, n_base, first, last, base labels, labels, score, terms, expressions."""
    words = raw.lower().translate(_WORD).split()
    # one byte is one character here, and phrases are ASCII, so places in it are places in the words
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = sorted((end + 1 - len(phrase) - 2, phrase) for end, phrase in automaton.iter(line))
    base, tags, weights = [], [], {}
    place, upto = 0, 0
    for at, phrase in hits:
        place, upto = place + line.count(" ", upto, at), at
        if phrase in BASE:
            base.append((place, BASE[phrase]))
            weights[BASE[phrase]] = max(weights.get(BASE[phrase], 0.0), NAMED)
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            weights[label] = max(weights.get(label, 0.0), weight)
        if phrase in TAGS:
            tags.append(place + len(phrase.split()) - 1)
    strict = max((FAMILIES[label] for label in weights), default=-1)
    expressions = 0
    if tags:
        last_words, found = set(tags), {}
        for k, run in enumerate(_RUN.finditer(raw)):
            if k in last_words:
                found[k] = run.end()
        for k in tags:
            stop = raw.find(b"\n", found[k])
            rest = raw[found[k]:stop if stop >= 0 else len(raw)]
            terms = evaluate(rest.decode("latin-1").lstrip(" \t:=\"'*<>"))
            if terms:
                expressions, strict = expressions + 1, max(strict, terms.strictness)
                weights.update({f: DECLARED for f in terms.families})
    doubt = 1.0
    for label in sorted(weights):
        doubt *= 1.0 - weights[label]
    places = [p for p, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted(weights)), 1.0 - doubt, CLASSES[strict] if weights else None, expressions)


_FOUND = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
          "score double, terms string, n_expressions bigint")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.int64())


def licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score, terms, n_expressions)`` of every row.

    ``n_base`` counts all places of the base phrases, ``first_word`` and ``last_word`` are the smallest and
    largest of them (null without one). ``labels`` adds what other notices and expressions name; ``terms`` is
    the strictest class that applies; ``score`` is 1 minus the product of the doubts that each label leaves.
    A null or empty text has no words, no labels and score 0. Repeated rows and null ids are judged each by
    itself, long texts are read whole, other columns, whatever their names, are not read; an empty table
    gives no rows.
    """
    source = documents.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("c1"))
    kind = source.schema["c0"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                text, cuts = memoryview(data), offsets.tolist()
                rows = [_scan(bytes(text[a:b]), automaton) for a, b in zip(cuts, cuts[1:])]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names)

    names = ["c0", *[f.split()[0] for f in _FOUND.split(", ")]]
    return source.mapInArrow(run, f"c0 {kind}, {_FOUND}").withColumnRenamed("c0", id_col)
