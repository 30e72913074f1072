import hashlib
import random

import numpy as np
import pytest

from driftmark.operators import agreement as G


def kappa_by_matrix(a, b):
    counts = np.zeros((5, 5))
    for x, y in zip(a, b):
        counts[x + 2, y + 2] += 1
    weights = np.subtract.outer(np.arange(5), np.arange(5)) ** 2
    expected = np.outer(counts.sum(1), counts.sum(0)) / counts.sum()
    return 1 - (weights * counts).sum() / (weights * expected).sum()


def rated(spark, rows):
    return spark.createDataFrame([("k", *r) for r in rows], "k string, a int, b int")


def test_kappa_of_equal_opposite_and_random_ratings(spark):
    a = [-2, -1, 0, 1, 2, 0, 1]
    same = G.agreement(rated(spark, zip(a, a)), ["k"], "a", "b").first()
    assert same.kappa == pytest.approx(1.0) and same.exact == 1 and same.spearman == pytest.approx(1.0)
    assert G.agreement(rated(spark, [(x, -x) for x in a]), ["k"], "a", "b").first().kappa < 0
    rng = random.Random(0)
    pairs = [(rng.randint(-2, 2), rng.randint(-2, 2)) for _ in range(200)]
    got = G.agreement(rated(spark, pairs), ["k"], "a", "b").first()
    assert got.kappa == pytest.approx(kappa_by_matrix(*zip(*pairs)))
    assert got.within_one == pytest.approx(np.mean([abs(x - y) <= 1 for x, y in pairs])) and got.n == 200


def test_constant_raters_have_no_kappa_or_correlation(spark):
    row = G.agreement(rated(spark, [(1, 1)] * 12), ["k"], "a", "b").first()
    assert row.kappa is None and row.spearman is None and row.exact == 1


def test_consistency_has_one_row_per_dimension(spark):
    schema = "event_id string, guidance_tone int, overall_tone int, margins_tone int, demand_tone int"
    first = spark.createDataFrame([(f"e{i}", i % 5 - 2, 0, i % 3 - 1, 1) for i in range(20)], schema)
    second = spark.createDataFrame([(f"e{i}", i % 5 - 2, 0, -(i % 3 - 1), 1) for i in range(5, 25)], schema)
    got = {r.dimension: r for r in G.consistency(first, second).collect()}
    assert len(got) == 4 and {r.n for r in got.values()} == {15}
    assert got["guidance_tone"].kappa == pytest.approx(1.0) and got["margins_tone"].kappa == pytest.approx(-1.0)
    assert got["overall_tone"].spearman is None


def human_rows():
    rng = random.Random(4)
    rows = []
    for i in range(30):
        h = rng.randint(-2, 2)
        rows.append((i, h, max(-2, min(2, h + rng.choice([0, 0, 0, 1, -1]))), rng.randint(-2, 2)))
    return rows


def test_bootstrap_matches_a_loop_and_finds_the_better_reader(spark):
    rows = human_rows()
    df = spark.createDataFrame(rows, "doc int, human int, main int, other int")
    got = G.reading_verdict(G.bootstrap_kappa_difference(df, resamples=60, seed=3)).first()
    ordered = sorted(r[1:] for r in rows)
    diffs = []
    for rep in range(1, 61):
        drawn = [ordered[int(hashlib.md5(f"3|{rep}|{d}".encode()).hexdigest()[:15], 16) % 30] for d in range(1, 31)]
        h, m, o = zip(*drawn)
        diffs.append(kappa_by_matrix(h, m) - kappa_by_matrix(h, o))
    assert (got.low, got.high) == pytest.approx(tuple(np.percentile(diffs, [5, 95])))
    h, m, o = zip(*ordered)
    assert got.kappa_difference == pytest.approx(kappa_by_matrix(h, m) - kappa_by_matrix(h, o))
    assert got.replicates == 60 and got.n == 30 and got.verdict == "main agrees more"


def test_three_comparisons(spark):
    df = spark.createDataFrame(human_rows() + [(99, 1, None, 1)], "doc int, human int, main int, other int")
    got = {r.comparison: r for r in G.three_way(df).collect()}
    assert set(got) == {"main", "other", "raters"} and {r.n for r in got.values()} == {30}
    assert got["main"].kappa > got["other"].kappa


def test_label_sheet_is_checked(spark):
    def sheet(values):
        return spark.createDataFrame(list(enumerate(values)), "number int, guidance_tone string")

    good = G.human_labels(sheet(["1", "-2", "", "x", "2.0"] + ["0"] * 9))
    assert good.count() == 12 and good.filter("human = 2").count() == 1
    with pytest.raises(ValueError, match="10 rated documents"):
        G.human_labels(sheet(["1"] * 9 + [""]))
    with pytest.raises(ValueError, match="beside"):
        G.human_labels(sheet(["1"] * 10 + ["3"]))


def test_rater_comparison_uses_the_window_and_needs_ten(spark):
    schema = "event_id string, tone double, guidance_tone int"
    a = spark.createDataFrame([(f"e{i}", float(i), i % 5 - 2) for i in range(20)], schema)
    b = spark.createDataFrame([(f"e{i}", float(i * i), i % 5 - 2) for i in range(20)], schema)
    window = spark.createDataFrame([(f"e{i}",) for i in range(12)], "event_id string")
    row = G.rater_comparison(a, b, window).first()
    assert (row.n, row.rank_corr, row.same_guidance) == (12, pytest.approx(1.0), 1.0)
    assert G.rater_comparison(a, b, window.limit(9)).count() == 0
