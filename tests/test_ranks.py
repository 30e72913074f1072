import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftmark.functions.student_t import critical_975, two_sided_p
from driftmark.operators import ranks as R
from driftmark.operators.ordering import positions, previous_value, running_counts

# Thirteen published season coefficients and the summary printed for them.
SEASON_ICS = (0.21478331114939844, 0.2060014270894688, 0.16751105232696367, 0.03001940097541433, 0.072227453109808,
              -0.08756745610297563, -0.15961023535557495, 0.1647788330760308, 0.017985111286113208, 0.19066647424363364,
              -0.08994656040195312, 0.1167619369949017, -0.01622194260760027)


def test_summary_of_published_seasons(spark):
    ics = spark.createDataFrame([("tone", f"s{i:02d}", v) for i, v in enumerate(SEASON_ICS)], "signal string, season string, ic double")
    row = R.ic_summary(ics).first()
    assert row.mean_ic == pytest.approx(0.06364529275258682, rel=1e-12)
    assert row.ic_t == pytest.approx(1.8282861640427335, rel=1e-12)
    assert row.ic_p == pytest.approx(0.0924583457215318, rel=1e-10)
    assert row.ic_t_crit == pytest.approx(2.1788128296672284, rel=1e-12)
    assert row.ic_pos_share == pytest.approx(0.6923076923076923) and row.seasons == 13


def test_few_seasons(spark):
    one = spark.createDataFrame([("a", "s", 0.1)], "signal string, season string, ic double")
    row = R.ic_summary(one).first()
    assert row.ic_t is None and row.ic_p is None and row.ic_t_crit is None and row.seasons == 1


def test_student_t_probabilities(spark):
    # reference points: exact tails of t(1) and t(2), a table value, and the normal limit
    df = spark.createDataFrame([(1.0, 1), (2.0, 2), (2.262157, 9), (1.96, 5_000_000), (6.0, 5_000_000)], "t double, n int")
    got = [r.p for r in df.select(two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.5) and got[1] == pytest.approx(1 - 2 / np.sqrt(6))
    assert got[2] == pytest.approx(0.05, abs=1e-7) and got[3] == pytest.approx(0.0499958, abs=1e-6)
    assert got[4] == pytest.approx(1.97318e-9, rel=1e-3)
    crit = spark.range(1).select(critical_975(F.lit(9)).alias("a"), critical_975(F.lit(30_000)).alias("b")).first()
    assert crit.a == pytest.approx(2.2621571628, abs=1e-9) and crit.b == pytest.approx(1.960043, abs=1e-5)


def noisy_rows(n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        season = "s1" if rng.random() < 0.6 else rng.choice(["s2", "s3"])
        value = rng.choice([-2.0, -1.0, 0.0, 0.0, 0.0, 1.0, 2.0])
        rows.append(("sig", season, f"e{i}", f"T{i % 9}", i % 40, value, round(value * 0.2 + rng.gauss(0, 1), 2)))
    return rows


ROWS = "signal string, season string, event_id string, ticker string, minute int, value double, car double"


def with_time(df):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return df.withColumn("published_at", start + F.make_dt_interval(mins=F.col("minute")))


def test_spearman_matches_pandas_in_one_piece_and_in_slices(spark):
    rows = noisy_rows()
    df = spark.createDataFrame(rows, ROWS)
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
    want = {s: g["value"].rank().corr(g["car"].rank()) for s, g in pdf.groupby("season")}
    for split in (None, 7):
        got = {r.season: r.ic for r in R.ic_by_season(df, "car", slices=split).collect()}
        assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_match_pandas_and_do_not_depend_on_slices_or_row_order(spark):
    rows = noisy_rows()
    pdf = pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
    pdf = pdf.sort_values(["minute", "ticker", "event_id"])
    rank = pdf.groupby("season")["value"].rank(method="first")
    size = pdf.groupby("season")["value"].transform("size")
    want = dict(zip(pdf["event_id"], np.ceil(rank / size * 5).clip(1, 5).astype(int)))
    for split, order in ((None, rows), (9, rows[::-1])):
        df = with_time(spark.createDataFrame(order, ROWS)).repartition(7)
        got = {r.event_id: r.quantile for r in R.quantile_in_season(df, 5, slices=split).collect()}
        assert got == want


def test_perfect_signal(spark):
    rows = [("sig", s, f"{s}{i}", "T", i, float(i), i - 9.5) for s in ("s1", "s2") for i in range(20)]
    df = with_time(spark.createDataFrame(rows, ROWS))
    assert {round(r.ic, 12) for r in R.ic_by_season(df, "car").collect()} == {1.0}
    row = R.hit_rate(R.quantile_in_season(df), "car").first()
    assert row.hit_rate == 1.0 and row.hit_n == 16 and row.top_q_car == pytest.approx(8.0)


def test_thin_or_constant_seasons_are_absent(spark):
    rows = ([("sig", "thin", f"a{i}", "T", i, float(i), float(i)) for i in range(9)]
            + [("sig", "flat", f"b{i}", "T", i, 1.0, float(i)) for i in range(20)]
            + [("sig", "ok", f"c{i}", "T", i, float(i % 2), float(i)) for i in range(10)])
    assert [r.season for r in R.ic_by_season(spark.createDataFrame(rows, ROWS), "car").collect()] == ["ok"]


def test_pooled_after_cutoff_needs_more_than_ten(spark):
    rows = [("sig", float(i), float(i * i), i >= 10) for i in range(20)]
    df = spark.createDataFrame(rows, "signal string, value double, car double, post_cutoff boolean")
    row = R.pooled_ic(df, "car").first()
    assert row.pooled_ic == pytest.approx(1.0) and row.post_cutoff_n == 10 and row.post_cutoff_pooled_ic is None


def test_rank_test_p_value(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=50)
    y = 0.3 * x + rng.normal(size=50)
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y)], "period string, value double, car double")
    row = R.rank_test(df, ["period"], "value", "car").first()
    rho = pd.Series(x).rank().corr(pd.Series(y).rank())
    t = rho * np.sqrt(48 / (1 - rho * rho))
    grid = np.linspace(-abs(t), abs(t), 400_001)
    density = (1 + grid ** 2 / 48) ** -24.5
    whole = np.linspace(-400, 400, 4_000_001)
    mass = np.trapezoid(density, grid) / np.trapezoid((1 + whole ** 2 / 48) ** -24.5, whole)
    assert row.rho == pytest.approx(rho) and row.p == pytest.approx(1 - mass, abs=1e-8)


def test_running_counts_positions_and_previous_value_in_slices(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, rng.randint(1, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, n int").repartition(6)
    whole = {(r.k, r.v): (r.below, r.total) for r in running_counts(df, ["k"], "v", "n", 1).collect()}
    cut = {(r.k, r.v): (r.below, r.total) for r in running_counts(df, ["k"], "v", "n", 6).collect()}
    assert whole == cut and len(cut) == 2000
    last = {}
    for k, v, n in sorted(rows, key=lambda x: x[1]):
        assert cut[(k, v)][0] == last.get(k, 0)
        last[k] = last.get(k, 0) + n
    place = {(r.k, r.v): r.position for r in positions(df, ["k"], ["v"], 5).collect()}
    before = {(r.k, r.v): r.prev for r in previous_value(df, ["k"], ["v"], "n", "prev", 7).collect()}
    seen, prev = {}, {}
    for k, v, n in sorted(rows, key=lambda x: x[1]):
        seen[k] = seen.get(k, 0) + 1
        assert place[(k, v)] == seen[k] and before[(k, v)] == prev.get(k)
        prev[k] = n


def test_extreme_quantiles_are_those_of_the_whole_sort(spark):
    df = with_time(spark.createDataFrame(noisy_rows(), ROWS)).repartition(5)
    lone = with_time(spark.createDataFrame([("sig", f"t{n}", f"x{n}-{i}", "T", i, 1.0, 0.5) for n in (1, 2, 4, 7) for i in range(n)], ROWS))
    rows = df.unionByName(df.withColumns({"signal": F.lit("free"), "value": F.col("value") + F.col("car") / 100})).unionByName(lone)
    for q in (2, 5):
        want = {(r.signal, r.event_id): r.quantile for r in R.quantile_in_season(rows, q).collect() if r.quantile in (1, q)}
        for slices in (None, 4):
            got = R.extreme_quantiles(rows, q, slices=slices).collect()
            assert {(r.signal, r.event_id): r.quantile for r in got} == want and len(got) == len(want)
