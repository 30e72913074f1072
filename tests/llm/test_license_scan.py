"""License scan against a plain search over word lists and a recursive evaluation of expressions."""
import random

import pytest
from pyspark.sql import functions as F

from driftmark.llm import license_scan as L

from . import brute

RANK = {"mit": 1, "gpl-3.0-only": 3, "lgpl-2.1": 2, "agpl-3.0": 4, "cc0-1.0": 0, "licenseref-house": 6}


def plain_places(text, phrase):
    w, p = brute.plain_words(text), phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]


def plain(text):
    places = {p: plain_places(text, p) for p in {*L.BASE, *L.NOTICES}}
    base = [(i, L.BASE[p]) for p in L.BASE for i in places[p]]
    labels = {x for _, x in base} | {L.NOTICES[p][0] for p in L.NOTICES if places[p]}
    at = [i for i, _ in base]
    return len(brute.plain_words(text)), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels))


def test_places_of_notices(spark):
    rng = random.Random(3)
    bits = [*L.BASE, *L.NOTICES, "the", "é", "license", "general", "public", "gnu", "MIT", "Apache", "under"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "\n", "-", ", ", "  ", "_"]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    rows += [(900, "MIT License license"), (901, "mit license mit license mit license"), (902, "emit license; mit licenses"), (903, "x " * 50_000 + "MIT\tLICENSE"), (904, "émit license")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in L.licenses(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()}
    assert got == {i: plain(t) for i, t in rows}
    assert got[901][1:4] == (3, 0, 4) and got[903][2] == 50_000 and got[902][1] == 0 and got[904][1] == 0


def written_out(rng, depth):
    """A random expression and its rank, by recursion."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice(list(RANK))
        if rng.random() < 0.2:
            return f"{name} WITH Classpath-exception-2.0", RANK[name] - (RANK[name] in (3, 4))
        return name.upper(), RANK[name]
    if rng.random() < 0.5:
        # a chain without parentheses: 'and' binds closer
        groups = [[written_out(rng, 0) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        return " or ".join(" AND ".join(t for t, _ in g) for g in groups), min(max(r for _, r in g) for g in groups)
    (a, x), (b, y) = written_out(rng, depth - 1), written_out(rng, depth - 1)
    return (f"(({a}) and ({b}))", max(x, y)) if rng.random() < 0.5 else (f"({a}) OR ({b})", min(x, y))


def test_expressions():
    rng = random.Random(8)
    for _ in range(500):
        text, rank = written_out(rng, 4)
        assert L.evaluate(text).strictness == rank, text
        assert L.evaluate(text + " unlisted words").strictness == rank
    assert L.evaluate("(MIT OR") is None and L.evaluate("") is None and L.evaluate("nothing") is None
    assert L.evaluate("MIT AND").families == {"mit"} and L.evaluate("mit) or gpl-2.0").families == {"mit"}
    assert L.evaluate("MIT WITH GPL-3.0").families == {"mit"}
    assert L.evaluate("(" * 50_000 + "MIT" + ")" * 50_000).families == {"mit"}


@pytest.mark.parametrize("text,labels,terms", [
    ("// SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode", "gpl,mit", "permissive"),
    ("SPDX license identifier = (Apache-2.0 AND LGPL-2.1-or-later)", "apache,lgpl", "weak copyleft"),
    ("License-Expression: GPL-2.0-only WITH Classpath-exception-2.0", "gpl", "weak copyleft"),
    ("SPDX-License-Identifier:\nMIT", "", None),
    ("SPDX-License-Identifier: whatever you like", "", None),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc", "restricted"),
    ("SPDX-License-Identifier: MIT\n released under the GNU Affero General Public License", "agpl,gpl,mit", "network copyleft")])
def test_labels_and_terms(spark, text, labels, terms):
    r = L.licenses(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (r.labels, r.terms) == (labels, terms) and (0 < r.score < 1) == bool(labels)


def test_odd_rows(spark):
    rows = [(None, "mit license"), (None, None), (1, None), (1, ""), (2, "mit license"), (2, "mit license"), (3, " \n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("c0", "c1", "n_words", "labels", "score")])
    got = sorted((tuple(r) for r in L.licenses(df).select("doc_id", "n_words", "n_base", "first_word", "labels", "score").collect()), key=repr)
    one, none = (2, 1, 0, "mit", 0.5), (0, 0, None, "", 0.0)
    assert got == sorted([(None, *one), (None, *none), (1, *none), (1, *none), (2, *one), (2, *one), (3, *none)], key=repr)
    assert L.licenses(df.limit(0)).count() == 0
