"""Ranked search and hard negatives against plain versions, and the odd cases both must take."""
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmark.llm import hard_negatives as H
from driftmark.llm import lexical_search as LS

from . import brute

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def plain_search(docs, items, top=10):
    words = [(i, brute.plain_words(t)) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n_docs, total = len(words), sum(len(w) for _, w, _ in words)
    df = Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in items:
        asked, scores = set(brute.plain_words(text)), []
        for i, w, c in words:
            m = 10 + 90 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **options):
    found = LS.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    return sorted([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(12)
    lexicon = ["".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 3))) for _ in range(400)]

    def draw(n):
        return " ".join(lexicon[min(int(rng.expovariate(0.02)), 399)] for _ in range(n))

    docs = [(i, draw(rng.choice([1, 5, 30, 30, 80, 300]))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(2000, None), (2001, ""), (2002, "--"), (2003, draw(20_000)), (2004, docs[9][1].upper())]
    rng.shuffle(docs)
    items = [(i, docs[i * 3][1] or "") for i in range(12)] + [(50, docs[3][1][:200]), (50, docs[3][1][:200]), (51, None), (52, ""), (53, "nowhere"), (54, draw(3))]
    return docs, items


def test_search_is_the_full_ranking(spark, library, monkeypatch):
    docs, items = library
    want = plain_search(docs, items)
    assert searched(spark, docs, items) == want and len(want) > 100
    # small buckets, little focus, one query to a block, other shares of seeds: the same rows
    monkeypatch.setattr(LS, "BUCKET_ROWS", 16)
    monkeypatch.setattr(LS, "FOCUS", 2)
    assert searched(spark, docs, items[:6], block_bytes=1, seed_share=0.3) == plain_search(docs, items[:6])
    assert searched(spark, docs, items[:6], top=3, seed_share=0.9) == plain_search(docs, items[:6], 3)


def test_bucket_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 30), replace=False)) for _ in range(500)]
    ends = np.r_[0, np.cumsum([len(r) for r in rows])]
    terms, impacts = np.concatenate(rows).astype(np.int32), rng.integers(1, 10 ** 9, ends[-1])
    length = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, ends[:-1]))
    bucket = LS._Bucket(np.arange(500), length, ends, terms, impacts)
    pruned = 0
    for _ in range(50):
        wanted = np.sort(rng.choice(np.arange(1, 70), 20, replace=False))
        score = np.array([impacts[a:b][np.isin(terms[a:b], wanted)].sum() for a, b in zip(ends, ends[1:])])
        least = np.sort(score)[-10]
        kept = bucket.survivors(wanted, float(least))
        assert set(np.flatnonzero(score >= least)) <= set(kept)
        asked = np.zeros(70, bool)
        asked[wanted] = True
        assert (bucket.scores(kept, asked) == score[kept]).all()
        pruned += 500 - len(kept)
    assert pruned > 50 * 250


def test_search_odd(spark):
    docs = [(None, "a b c"), (None, "a b c"), (None, None), (1, "a b c"), (1, "a b c"), (2, "a"), (3, "other words"), (4, "more words"), (5, "and words")]
    items = [(None, "a b"), (1, "words a"), (1, None)]
    assert searched(spark, docs, items) == plain_search(docs, items)
    extra = [F.lit("x").alias(c) for c in ("id", "n", "terms", "length", "rank", "score", "query", "item")]
    d, q = spark.createDataFrame(docs, DOCS).select("*", *extra), spark.createDataFrame(items, ITEMS).select("*", *extra)
    assert LS.search(d, q).columns == ["item_id", "rank", "doc_id", "score"] and LS.search(d, q).count() == len(plain_search(docs, items))
    for left, right in ((d.limit(0), q), (d, q.limit(0)), (d.filter("doc_id = 99"), q.filter("text is null"))):
        assert LS.search(left, right).count() == 0


VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain_negatives(rows, anchor=lambda i: i % 10 == 0, top=5):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
            if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, lab in rows:
        if anchor(i):
            first[i] = min(first.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, u) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(u, v)), i, other == lab) for i, v, other in rows if i != a)
        for s, p, _ in [x for x in scored if x[2]][:top]:
            fits = [(t, j) for t, j, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, r, j, -s, -t) for r, (t, j) in enumerate(fits[:top], 1)]
    return sorted(out)


def mined(spark, rows, **options):
    found = H.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 10 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def vectors(rng, n, dims=8):
    centres = rng.normal(size=(5, dims))
    return [(i, (centres[i % 5] * rng.choice([0.3, 1.0, 2.0]) + 0.4 * rng.normal(size=dims)).tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_negatives_are_the_full_ranking(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = vectors(rng, 400)
    rows += [(1000 + i, rows[10][1], 1) for i in range(150)] + [(2000 + i, rows[20][1], rows[20][2]) for i in range(40)]
    want = plain_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 300
    monkeypatch.setattr(H, "STEP_ROWS", 16)
    monkeypatch.setattr(H, "LIST_ROWS", 64)
    monkeypatch.setattr(H, "BLOCK_VALUES", 8 * 12)
    assert mined(spark, rows, clusters=3) == want


def test_bounds_hold_and_end_the_walk():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 6)) * rng.gamma(1.0, size=2000)[:, None]
    u = rng.normal(size=6) + 0.1 * rng.normal(size=(20, 6))
    centroid = H._centroids(u, 1)[0]
    phi = H._angles(u, H._lengths(u), centroid).max()
    size = H._lengths(x)
    bound = size * np.cos(np.maximum(0, H._angles(x, size, centroid) - phi))
    assert (u @ x.T <= H._lengths(u)[:, None] * bound[None, :] + 1e-9).all()
    fifth = np.sort(u @ x.T, axis=1)[:, -5]
    assert np.mean(H._lengths(u)[:, None] * bound[None, :] >= fifth[:, None]) < 0.2


def test_negatives_odd(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 60, 4)
    rows += [(None, [1.0] * 4, 1), (70, None, 1), (80, [1.0] * 4, None), (90, [1.0, None, 1.0, 1.0], 1), (100, [float("nan")] * 4, 1), (110, [float("inf")] * 4, 2),
             (120, [], 1), (130, [0.0] * 4, 2), (140, [1.0, 0.5], 1), (0, [0.5] * 4, 3), (0, rows[0][1], rows[0][2]), (31, rows[31][1], rows[31][2])]
    assert mined(spark, rows) == plain_negatives(rows)
    df = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in ("id", "vector", "asks", "list", "rank", "score", "cluster", "block")])
    assert H.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == len(plain_negatives(rows))
    for none in (df.limit(0), df.filter("vec_id = 11"), df.filter("embedding is null")):
        assert H.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    huge = [(i, [(-1.0) ** i * 1e30, 1e-3 * i], i % 2) for i in range(12)]
    assert all(-(1 << 63) <= r[5] < 1 << 63 for r in mined(spark, huge))


def test_text_ids(spark):
    rows = [(f"{i:03d}", v, lab) for i, v, lab in vectors(np.random.default_rng(3), 50)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, label int")
    got = sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id").endswith("0")).collect())
    want = [(f"{a:03d}", f"{p:03d}", r, f"{n:03d}", s, t) for a, p, r, n, s, t in plain_negatives([(int(i), v, lab) for i, v, lab in rows])]
    assert got == sorted(want)


def test_a_list_that_gets_a_row_sorts_no_other(monkeypatch):
    """Work follows the rows taken, not all that is held; scores stay exact in either precision."""
    n, top = 3000, 5
    lists = H._Lists(np.full(n, H._LEAST), np.full(n, H._MOST), top)
    rng = np.random.default_rng(8)
    owner, score, ids = rng.integers(0, n, 40_000), rng.integers(-50, 50, 40_000), rng.permutation(40_000)
    lists.add(owner, score, ids)
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(H.np, "lexsort", lambda keys: sizes.append(len(keys[0])) or sort(keys))
    lists.add(np.array([7, 7, 9]), np.array([60, 70, 60]), np.array([-1, -2, -3]))
    assert sizes and max(sizes) <= 3 + 2 * top
    rows = sorted([*zip(owner.tolist(), (-score).tolist(), ids.tolist()), (7, -60, -1), (7, -70, -2), (9, -60, -3)])
    want = [r for k, r in enumerate(rows) if k < top or rows[k - top][0] != r[0]]
    assert [(o, -s, i) for o, s, i in zip(*lists.rows())] == want


def test_long_vectors_are_scored_exactly(spark):
    rng = np.random.default_rng(12)
    rows = [(i, (v := np.array(x) * (300 if i % 3 else 1)).tolist(), lab) for i, x, lab in vectors(rng, 120)]
    assert mined(spark, rows) == plain_negatives(rows)
