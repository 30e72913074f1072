import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftmark.plans import reports as P


def test_three_periods_and_small_sample_flags(spark):
    rng = random.Random(1)
    rows = []
    for i in range(248):
        car = rng.gauss(0, 1)
        new = i >= 200
        other = car + rng.gauss(0, 0.3) if new else rng.gauss(0, 1)
        rows.append((dt.date(2026, 8, 5) if new else dt.date(2025, 1, 15), rng.gauss(0, 1), other, car))
    df = spark.createDataFrame(rows, "t0 date, tone double, other double, car double")
    got = {(r.period[0], r.signal): r for r in P.period_table(df, ["tone", "other"], "car", "2026-06-30", "2023-12-31").collect()}
    assert set(p for p, _ in got) == {"2", "3"}
    assert got[("3", "other")].flagged and got[("3", "other")].small and not got[("2", "other")].small
    assert got[("3", "other")].documents == 48 and not got[("3", "tone")].flagged


def test_thin_period_shows_no_number_and_equal_cutoffs_make_two_periods(spark):
    rows = [(dt.date(2023, 1, 1), float(i), float(i)) for i in range(9)] + [(dt.date(2025, 1, 1), float(i), float(i * i)) for i in range(12)]
    df = spark.createDataFrame(rows, "t0 date, tone double, car double")
    got = {r.period[0]: r for r in P.period_table(df, ["tone"], "car", "2024-06-30", "2024-06-30").collect()}
    assert set(got) == {"1", "3"} and got["1"].too_few and got["1"].rank_corr is None
    assert got["3"].rank_corr == pytest.approx(1.0) and got["3"].p == 0.0


def test_multiple_testing(spark):
    p = {"a": 0.09, "b": 0.053, "c": 0.015, "d": 0.4, "e": 0.5, "f": 0.6, "g": None}
    summary = spark.createDataFrame(list(p.items()), "signal string, ic_p double")
    got = {r.signal: r for r in P.multiple_testing_flags(summary, list(p)).collect()}
    assert len(got) == 6 and got["a"].bar == pytest.approx(0.05 / 6)
    assert [s for s in sorted(got) if got[s].nominal] == ["c"] and [s for s in sorted(got) if got[s].near] == ["a", "b"]
    assert not any(r.survives for r in got.values())


def test_verdict_noise_and_tidy_tables(spark):
    schema = ("signal string, mean_ic double, ic_p double, seasonal_net_sharpe double, ff_alpha_t double, ffe_alpha_t double, "
              "event_median_names_long double, `ff_beta_Mkt-RF` double")
    s = spark.createDataFrame([("tone", 0.08, 0.079, 0.21, 0.2, -2.32, 2.0, 0.4), ("lm", 0.0, None, 0.9, 2.5, 1.0, None, 0.1)], schema)
    row = P.main_test_verdict(s, "tone").first()
    assert not row.significant and row.book == "little"
    assert P.main_test_verdict(s.withColumn("ic_p", F.lit(0.01)), "lm").first().asDict() == {
        "signal": "lm", "mean_ic": 0.0, "ic_p": 0.01, "significant": True, "book": "profitable"}
    assert P.main_test_verdict(s, "lm").count() == 0
    assert sorted((r.signal, r.book) for r in P.noise_flags(s, ["tone", "lm"]).collect()) == [("lm", "seasonal"), ("tone", "event")]
    tidy = {(r.signal, r.measure): r.value for r in P.stats_table(s, ["tone", "lm"]).collect()}
    assert tidy[("tone", "ff_beta_Mkt-RF")] == 0.4 and tidy[("lm", "ic_p")] is None
    assert P.thin_book_table(s, "lm").count() == 0 and P.thin_book_table(s, "tone").count() == 1
    both = {r.measure: r for r in P.model_comparison(s, s.withColumn("mean_ic", F.lit(0.5)), "tone", "lm").collect()}
    assert (both["mean_ic"].main, both["mean_ic"].other, both["mean_ic"].baseline) == (0.08, 0.5, 0.0)
    topics = {(r.signal, r.measure): r.value for r in P.topic_table(s, ["tone"]).collect()}
    assert topics[("tone", "seasonal_net_sharpe")] == 0.21


def test_chart_frames(spark):
    d = [dt.date(2024, 1, i) for i in (1, 2, 3)]
    books = spark.createDataFrame([("seasonal", "a", d[0], 0.1), ("seasonal", "a", d[2], 0.1), ("seasonal", "b", d[1], -0.5)],
                                  "kind string, signal string, date date, net double")
    got = {(r.signal, r.date.day): r.wealth for r in P.wealth_chart(books, ["a", "b"]).collect()}
    assert got == pytest.approx({("a", 1): 1.1, ("a", 2): 1.1, ("a", 3): 1.21, ("b", 1): 1.0, ("b", 2): 0.5, ("b", 3): 0.5})
    ics = spark.createDataFrame([("a", 0.1), ("a", 0.3), ("b", 0.2)], "signal string, ic double")
    row = P.ic_chart(ics).collect()
    assert len(row) == 1 and row[0].half_width == pytest.approx(1.96 * 0.1)
    delays = spark.createDataFrame([(5, 0.45, 0.1), (0, 1.41, 0.2)], "delay_days int, sharpe_net double, ann_return_net double")
    assert [r.delay_days for r in P.entry_delay_table(delays).collect()] == [0, 5]
    cons = spark.createDataFrame([("guidance_tone", 40, 0.8, 1.0, 0.83, 0.86)], "dimension string, n long, exact double, within_one double, spearman double, kappa double")
    assert {r.measure: r.value for r in P.consistency_table(cons).collect()}["kappa"] == 0.86
