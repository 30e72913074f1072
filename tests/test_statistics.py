import datetime as dt

import numpy as np
import pytest
from conftest import business_days
from pyspark.sql import functions as F

from driftmark.operators.event_time_book import book_exposure
from driftmark.operators.factor_model import FACTORS, factor_regression
from driftmark.operators.performance import perf_stats, wealth_curve

START = dt.date(2020, 1, 1)


def series(spark, values, signal="s"):
    days = business_days(START, len(values))
    return spark.createDataFrame([(signal, d, v if v is None else float(v)) for d, v in zip(days, values)],
                                 "signal string, date date, ret double")


def test_drawdown_sharpe_and_growth(spark):
    r = np.array([0.03, 0.02, -0.2, 0.05, -0.1, 0.4])
    row = perf_stats(series(spark, [*r[:3], None, *r[3:]]), ["signal"]).first()
    assert row.max_drawdown == pytest.approx(0.8 * 1.05 * 0.9 - 1) and row.total_return == pytest.approx(np.prod(1 + r) - 1)
    assert row.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * np.sqrt(252)) and row.days == 6


def test_drawdown_peak_starts_at_the_first_wealth(spark):
    assert perf_stats(series(spark, [-0.3, 0.02, 0.01]), ["signal"]).first().max_drawdown == 0.0


def test_sharpe_standard_error_and_flat_or_short_series(spark):
    r = [0.004 * ((7 * k) % 11 - 4) for k in range(189)]
    row = perf_stats(series(spark, r), ["signal"]).first()
    assert row.sharpe_se == pytest.approx(np.sqrt((1 + row.sharpe ** 2 / 2) / 0.75))
    flat = perf_stats(series(spark, [0.25] * 5), ["signal"]).first()
    assert flat.sharpe is None and flat.sharpe_se is None and flat.ann_return == pytest.approx(63)
    assert perf_stats(series(spark, [-0.2]), ["signal"]).count() == 0


def test_ruin_leaves_growth_undefined_not_broken(spark):
    row = perf_stats(series(spark, [0.2, 0.05, -1.25, 0.3, 0.1]), ["signal"]).first()
    assert row.total_return == pytest.approx(1.2 * 1.05 * -0.25 * 1.3 * 1.1 - 1) and row.cagr is None


def regression_data(spark, n=275):
    rng = np.random.default_rng(412)
    x = rng.uniform(-0.02, 0.025, (n, 6))
    noise = rng.laplace(0, 0.002, n)
    y = -0.0012 + 1.3 * x[:, 0] + 0.7 * x[:, 2] - 0.9 * x[:, 4] + noise - 0.4 * np.r_[0, 0, noise[:-2]]
    days = business_days(START, n)
    factors = spark.createDataFrame([(d, *map(float, row)) for d, row in zip(days, x)],
                                    "date date, " + ", ".join(f"`{f}` double" for f in FACTORS))
    return x, y, factors, series(spark, y)


def test_six_factor_regression_against_a_loop(spark):
    x, y, factors, daily = regression_data(spark)
    row = factor_regression(daily, factors, ["signal"]).first()
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    u = y - design @ beta
    k, n = design.shape[1], len(y)
    middle = np.zeros((k, k))
    for t in range(n):
        for s in range(max(0, t - 5), min(n, t + 6)):
            middle += (1 - abs(t - s) / 6) * u[t] * u[s] * np.outer(design[t], design[s])
    bread = np.linalg.inv(design.T @ design)
    se = np.sqrt(np.diag(bread @ middle @ bread))
    assert row.alpha_ann == pytest.approx(beta[0] * 252) and row.alpha_t == pytest.approx(beta[0] / se[0])
    assert row["beta_Mkt-RF"] == pytest.approx(1.3, abs=0.05) and row["t_Mom"] == pytest.approx(beta[6] / se[6])
    assert row.n == 275 and row.r2 == pytest.approx(1 - u @ u / ((y - y.mean()) ** 2).sum())


def test_regression_uses_the_factors_that_exist_and_needs_sixty_days(spark):
    _, _, factors, daily = regression_data(spark)
    row = factor_regression(daily, factors.select("date", "`Mkt-RF`"), ["signal"]).first()
    assert "beta_SMB" not in row.asDict() and row["beta_Mkt-RF"] is not None
    short = daily.orderBy("date").limit(59)
    assert factor_regression(short, factors, ["signal"]).count() == 0
    assert factor_regression(daily, None, ["signal"]) is None


def test_exposure_counts_names_and_one_leg_days(spark):
    positions = spark.createDataFrame([("s", "KK", 4, -1, 3), ("s", "LL", 1, 1, 1), ("s", "MM", 6, 1, 4)], "signal string, ticker string, t0_pos int, leg int, n long")
    # (long, short, names long, names short) by day: long alone, both, a held name without a return, nothing, short alone
    days = [(0.02, None, 1, 0)] * 3 + [(0.01, -0.03, 5, 3)] * 4 + [(None, 0.04, 1, 3), (None, None, 0, 0), (None, 0.0, 0, 3)]
    daily = spark.createDataFrame([("s", p, *day) for p, day in enumerate(days)],
                                  "signal string, pos int, long double, short double, names_long long, names_short long")
    row = book_exposure(positions, daily).first()
    assert (row.event_positions_long, row.event_positions_short) == (5, 3)
    assert row.event_median_names_long == 1.0 and row.event_median_names_short == 3.0
    assert row.event_share_one_leg == pytest.approx(5 / 10) and row.event_share_both_legs == pytest.approx(4 / 10)


def test_dependent_factors_share_their_effect_without_a_python_worker(spark):
    x, y, factors, daily = regression_data(spark, 200)
    constant = factors.withColumns({"SMB": F.col("`Mkt-RF`") * 2, "HML": F.lit(0.25), "CMA": F.col("RMW") - F.col("`Mkt-RF`"), "Mom": F.lit(0.0)})
    found = factor_regression(daily, constant, ["signal"])
    assert "Python" not in found._jdf.queryExecution().toString() and "Pandas" not in found._jdf.queryExecution().toString()
    row, n = found.first(), len(y)
    design = np.column_stack([np.ones(n), x[:, 0], 2 * x[:, 0], np.full(n, 0.25), x[:, 3], x[:, 3] - x[:, 0], np.zeros(n)])
    inverse = np.linalg.pinv(design.T @ design, hermitian=True, rcond=1e-12)
    beta = inverse @ (design.T @ y)
    score = design * (y - design @ beta)[:, None]
    middle = score.T @ score
    for lag in range(1, 6):
        middle += (1 - lag / 6) * (score[lag:].T @ score[:-lag] + score[:-lag].T @ score[lag:])
    error = np.sqrt(np.diag(inverse @ middle @ inverse))
    assert [row.alpha_ann / 252, *[row[f"beta_{f}"] for f in FACTORS]] == pytest.approx(beta, rel=1e-6, abs=1e-12)
    assert [row.alpha_t, *[row[f"t_{f}"] for f in FACTORS[:-1]]] == pytest.approx((beta / np.where(error > 0, error, 1))[:-1], rel=1e-5) and row.t_Mom is None


@pytest.mark.parametrize("slices", [1, 7])
def test_wealth_of_a_series_cut_into_stretches(spark, slices):
    rng = np.random.default_rng(31)
    values = {"up": rng.normal(0.002, 0.03, 211), "ruin": np.r_[rng.normal(0, 0.1, 60), -1.7, rng.normal(0, 0.1, 40), -2.2, rng.normal(0, 0.1, 30)], "one": np.array([0.4])}
    rows = None
    for name, r in values.items():
        rows = series(spark, r, name) if rows is None else rows.unionByName(series(spark, r, name))
    curve = wealth_curve(rows.repartition(5), ["signal"], slices=slices)
    assert set(curve.columns) == {"signal", "date", "ret", "wealth", "drawdown"}
    for name, r in values.items():
        got = curve.filter(F.col("signal") == name).orderBy("date").collect()
        wealth = np.cumprod(1 + r)
        assert [x.wealth for x in got] == pytest.approx(wealth) and [x.drawdown for x in got] == pytest.approx(wealth / np.maximum.accumulate(wealth) - 1)
    stats = {r.signal: r for r in perf_stats(rows, ["signal"], slices=slices).collect()}
    assert set(stats) == {"up", "ruin"} and stats["ruin"].max_drawdown < -1 and stats["up"].days == 211
