"""Report tables: tidy rows for comparison, flags, verdicts and chart data."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.performance import wealth_curve
from driftmark.operators.ranks import rank_test

# Significance levels and sample sizes the notes use.
ALPHA, NEAR = 0.05, 0.10
NOISE_T = 2
GOOD_SHARPE = 0.5
TOO_FEW, SMALL = 10, 100
NORMAL_95 = 1.96

MAIN_TEST = ("mean_ic", "ic_t", "ic_p", "ic_t_crit", "ic_pos_share", "seasons",
             "seasonal_net_sharpe", "seasonal_net_sharpe_se")
ALL_MEASURES = (
    "n_events", "mean_ic", "ic_t", "ic_p", "ic_pos_share", "seasons", "hit_rate", "top_q_car", "bottom_q_car",
    "seasonal_net_ann_return", "seasonal_net_ann_vol", "seasonal_net_sharpe", "seasonal_gross_sharpe",
    "seasonal_net_sharpe_se", "seasonal_net_max_drawdown", "seasonal_turnover", "seasonal_periods_positive",
    "event_net_sharpe", "event_net_sharpe_se", "event_net_max_drawdown", "event_median_names_long",
    "event_median_names_short", "event_share_one_leg", "ffe_alpha_ann", "ffe_alpha_t", "ff_alpha_ann", "ff_alpha_t",
    "ff_beta_Mkt-RF", "ff_beta_SMB", "ff_beta_HML", "ff_beta_RMW", "ff_beta_CMA", "ff_beta_Mom", "ff_r2",
    "post_cutoff_pooled_ic", "post_cutoff_n")
TOPIC = ("mean_ic", "ic_t", "ic_p", "hit_rate", "seasonal_net_sharpe", "event_net_sharpe")
THIN_BOOK = ("event_median_names_long", "event_median_names_short", "event_share_one_leg", "event_net_sharpe",
             "event_net_sharpe_se")
COMPARED = ("n_events", "post_cutoff_n", "mean_ic", "ic_t", "ic_t_crit", "ic_p", "hit_rate", "event_net_sharpe",
            "seasonal_net_sharpe", "post_cutoff_pooled_ic")


def measures(summary: DataFrame, names: Sequence[str], signals: Sequence[str] | None = None) -> DataFrame:
    """Tidy rows ``(signal, measure, value)`` of the named statistics that exist."""
    chosen = summary if signals is None else summary.filter(F.col("signal").isin(*signals))
    present = [n for n in names if n in summary.columns]
    wide = chosen.select("signal", *[F.col(f"`{n}`").cast("double").alias(n) for n in present])
    return wide.unpivot("signal", [F.col(f"`{n}`") for n in present], "measure", "value")


def main_test_table(summary: DataFrame, signals: Sequence[str]) -> DataFrame:
    return measures(summary, MAIN_TEST, signals)


def stats_table(summary: DataFrame, signals: Sequence[str]) -> DataFrame:
    return measures(summary, ALL_MEASURES, signals)


def topic_table(summary: DataFrame, topics: Sequence[str]) -> DataFrame:
    return measures(summary, TOPIC, topics)


def thin_book_table(summary: DataFrame, primary: str) -> DataFrame:
    """Empty when the book never held anything."""
    return measures(summary.filter(F.col("event_median_names_long").isNotNull()), THIN_BOOK, [primary])


def entry_delay_table(delays: DataFrame) -> DataFrame:
    return delays.select("delay_days", "sharpe_net").orderBy("delay_days")


def consistency_table(consistency: DataFrame) -> DataFrame:
    return consistency.unpivot(["dimension", "n"], ["exact", "within_one", "spearman", "kappa"], "measure", "value")


def main_test_verdict(summary: DataFrame, primary: str) -> DataFrame:
    """Whether the main test is significant and its seasonal book paid; no row without a p-value."""
    sharpe = F.col("seasonal_net_sharpe")
    return (summary.filter((F.col("signal") == primary) & F.col("ic_p").isNotNull())
            .select("signal", "mean_ic", "ic_p", (F.col("ic_p") < ALPHA).alias("significant"),
                    F.when(sharpe.isNull() | (sharpe < GOOD_SHARPE), "little").otherwise("profitable").alias("book")))


def multiple_testing_flags(summary: DataFrame, signals: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Which signals pass on their own, come near, or survive a bar of alpha / number of tests."""
    tested = summary.filter(F.col("signal").isin(*signals) & F.col("ic_p").isNotNull())
    together = Window.partitionBy(F.lit(0))
    p = F.col("ic_p")
    return (tested.withColumn("tests", F.count("*").over(together))
            .withColumn("bar", alpha / F.col("tests"))
            .select("signal", "ic_p", "tests", "bar", (p < alpha).alias("nominal"),
                    ((p >= alpha) & (p < NEAR)).alias("near"), ((p < alpha) & (p < F.col("bar"))).alias("survives")))


def noise_flags(summary: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Alphas with |t| above 2, of which a few are expected by chance: (signal, book, alpha_t)."""
    pairs = [(c, b) for c, b in (("ff_alpha_t", "seasonal"), ("ffe_alpha_t", "event")) if c in summary.columns]
    books = F.array(*[F.struct(F.lit(b).alias("book"), F.col(c).alias("alpha_t")) for c, b in pairs])
    return (summary.filter(F.col("signal").isin(*signals)).select("signal", F.inline(books))
            .filter(F.abs("alpha_t") > NOISE_T))


def period_label(t0: Column, cutoff_a: str, cutoff_b: str) -> Column:
    early, late = sorted([cutoff_a, cutoff_b])
    label = F.when(t0 <= F.lit(early).cast("date"), "1 up to early cutoff")
    if late > early:
        label = label.when(t0 <= F.lit(late).cast("date"), "2 between cutoffs")
    return label.otherwise("3 after late cutoff")


def period_table(panel: DataFrame, signals: Sequence[str], target: str, cutoff_main: str, cutoff_other: str,
                 slices: int | None = None) -> DataFrame:
    """Rank correlation per period and score, with size and significance flags.

    Periods with fewer than ten documents show no number; small ones under a hundred are marked,
    and a small one at p <= 0.05 is flagged as the likely accident it is.
    """
    known = (panel.filter(F.col(target).isNotNull())
             .withColumn("period", period_label(F.col("t0"), cutoff_main, cutoff_other)))
    sizes = known.groupBy("period").agg(F.count("*").alias("documents"))
    long = known.select("period", target, *signals).unpivot(["period", target], list(signals), "signal", "value")
    tests = rank_test(long, ["period", "signal"], "value", target, slices=slices)
    enough = F.col("documents") >= TOO_FEW
    small = enough & (F.col("documents") < SMALL)
    grid = sizes.select("period", "documents", F.explode(F.array(*[F.lit(s) for s in signals])).alias("signal"))
    return (grid.join(tests, ["period", "signal"], "left")
            .select("period", "signal", "documents", F.when(enough, F.col("rho")).alias("rank_corr"),
                    F.when(enough, F.col("p")).alias("p"), (~enough).alias("too_few"), small.alias("small"),
                    F.coalesce(small & (F.col("p") <= ALPHA), F.lit(False)).alias("flagged"))
            .orderBy("period", "signal"))


def model_comparison(main: DataFrame, other: DataFrame, primary: str, baseline: str) -> DataFrame:
    """``(measure, main, other, baseline)`` from two summaries."""
    a = measures(main, COMPARED, [primary]).select("measure", F.col("value").alias("main"))
    b = measures(other, COMPARED, [primary]).select("measure", F.col("value").alias("other"))
    c = measures(main, COMPARED, [baseline]).select("measure", F.col("value").alias("baseline"))
    return a.join(b, "measure", "left").join(c, "measure", "left")


def wealth_chart(books: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Growth of 1 per (kind, signal, date); a date one signal lacks counts as a zero return."""
    chosen = books.filter(F.col("signal").isin(*signals) & F.col("net").isNotNull())
    present = chosen.groupBy("kind").agg(F.collect_set("signal").alias("signals"))
    days = chosen.select("kind", "date").distinct().join(present, "kind") \
        .select("kind", "date", F.explode("signals").alias("signal"))
    aligned = (days.join(chosen.select("kind", "signal", "date", "net"), ["kind", "signal", "date"], "left")
               .select("kind", "signal", "date", F.coalesce("net", F.lit(0.0)).alias("ret")))
    return wealth_curve(aligned, ["kind", "signal"]).select("kind", "signal", "date", "wealth")


def quantile_paths(quantiled: DataFrame, paths: DataFrame) -> DataFrame:
    """Mean CAR path per (signal, quantile, day).

    Documents are counted per (company, entry day, quantile) first; all of them share one path.
    """
    counts = quantiled.groupBy("signal", "quantile", "ticker", "t0_pos").agg(F.count("*").alias("n"))
    return (counts.join(paths, ["ticker", "t0_pos"]).filter(F.col("car").isNotNull())
            .groupBy("signal", "quantile", "day")
            .agg((F.sum(F.col("n") * F.col("car")) / F.sum("n")).alias("mean_car")))


def ic_chart(ics: DataFrame) -> DataFrame:
    """Mean IC with its 95% half width for signals with more than one season, smallest first."""
    return (ics.groupBy("signal").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"),
                                      F.count("*").alias("seasons"))
            .filter(F.col("seasons") > 1)
            .select("signal", "mean_ic", (NORMAL_95 * F.col("sd") / F.sqrt("seasons")).alias("half_width"))
            .orderBy("mean_ic"))
