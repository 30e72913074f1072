"""The whole evaluation: every signal, both books, one lineage per stage."""
from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators import ranks
from driftmark.operators.event_study import EventStudy
from driftmark.operators.event_time_book import EventTimeBook
from driftmark.operators.factor_model import factor_regression
from driftmark.operators.performance import STATS, long_series, perf_stats
from driftmark.operators.seasonal_book import SeasonalBook
from driftmark.session import checkpointed, together
from driftmark.sources import sinks

# Fixed value: trading days by which the delay sweep shifts every trade.
DELAYS = (0, 5, 10, 20, 40)
ROW_COLUMNS = ("event_id", "ticker", "published_at", "t0", "t0_pos", "season", "post_cutoff")


def _side_by_side(stats: DataFrame, prefix: str) -> DataFrame:
    """(signal, series, stats…) -> one row per signal with columns ``{prefix}_{series}_{stat}``."""
    return stats.groupBy("signal").agg(*[
        F.max(F.when(F.col("series") == series, F.col(stat))).alias(f"{prefix}_{series}_{stat}")
        for series in ("net", "gross") for stat in STATS])


def with_scores(events: DataFrame, *scores: DataFrame) -> DataFrame:
    """Events with the signal columns of each score table, null where there is no score."""
    for table in scores:
        events = events.join(table, "event_id", "left")
    return events


class Backtest:
    """Evaluation of several signals over one event study."""

    def __init__(self, study: EventStudy, signals: Sequence[str], *, training_cutoff: str,
                 factors: DataFrame | None = None, quantiles: int = 5, min_history: int = 40,
                 lookback_days: int = 100, min_names_per_leg: int = 3, cost_bps: float = 10,
                 borrow_bps_annual: float = 50, slices: int | None = None):
        self.study, self.factors, self.q, self.slices = study, factors, quantiles, slices
        self.cutoff = training_cutoff
        self.signals = [s for s in signals if s in study.events.columns]
        if not self.signals:
            raise ValueError("none of the signals is a column of the events")
        self.terms = dict(quantiles=quantiles, cost_bps=cost_bps, borrow_bps_annual=borrow_bps_annual)
        self.seasonal_terms = dict(rebalance_months=study.months, lookback_days=lookback_days,
                                   min_names_per_leg=min_names_per_leg)
        self.event_terms = dict(hold_days=study.hold_days, min_history=min_history, slices=slices)

    @cached_property
    def panel(self) -> DataFrame:
        return self.study.panel.withColumn("post_cutoff", F.col("t0") > F.lit(self.cutoff).cast("date"))

    @cached_property
    def rows(self) -> DataFrame:
        """(document, signal) rows with score and CAR."""
        target = self.study.target
        complete = self.panel.filter(F.col(target).isNotNull())
        return ranks.signal_rows(complete, self.signals, [*ROW_COLUMNS, target])

    def keep_rows(self) -> None:
        """Write the documents with a CAR, one row each, for statistics that read their scores several times.

        Without it every reader of ``rows`` derives the documents anew; the books take the rows as they are when first asked for.
        """
        target = self.study.target
        kept = checkpointed(self.panel.filter(F.col(target).isNotNull()).select(*ROW_COLUMNS, target, *self.signals))
        self.rows = ranks.signal_rows(kept, self.signals, [*ROW_COLUMNS, target])

    @cached_property
    def rank_table(self) -> DataFrame:
        """Rank correlations of every season, of all documents and of those after the cutoff."""
        return checkpointed(ranks.scoped_spearman(self.rows, self.study.target, slices=self.slices))

    @cached_property
    def ics(self) -> DataFrame:
        return ranks.season_ics(self.rank_table)

    @cached_property
    def seasonal(self) -> SeasonalBook:
        scored = ranks.signal_rows(self.panel, self.signals, ROW_COLUMNS)
        return SeasonalBook(self.rows, self.study.returns, self.study.calendar, scored=scored, **self.terms, **self.seasonal_terms)

    @cached_property
    def event_time(self) -> EventTimeBook:
        return EventTimeBook(self.rows, self.study.returns, self.study.market_returns, self.study.calendar,
                             **self.terms, **self.event_terms)

    @cached_property
    def books(self) -> DataFrame:
        """Daily rows of both books, ``kind`` = seasonal or event."""
        columns = ["signal", "date", "long", "short", "gross", "net"]
        together(lambda: self.seasonal.returns, lambda: self.event_time.returns)
        seasonal = self.seasonal.returns.select(F.lit("seasonal").alias("kind"), *columns)
        event = self.event_time.returns.select(F.lit("event").alias("kind"), *columns)
        return seasonal.unionByName(event)

    @cached_property
    def performance(self) -> DataFrame:
        """(kind, signal, series) statistics of net and gross returns."""
        return perf_stats(long_series(self.books, ["kind", "signal"]), ["kind", "signal", "series"])

    @cached_property
    def factor_rows(self) -> DataFrame | None:
        return factor_regression(self.books, self.factors, ["kind", "signal"], "net")

    def quantiled(self) -> DataFrame:
        return ranks.quantile_in_season(self.rows, self.q, slices=self.slices)

    def summary(self) -> DataFrame:
        """One row per signal with every statistic of the evaluation, also for a signal without scored rows."""
        # ten statistics follow from these rows: the one document-sized table a study writes
        self.keep_rows()
        target = self.study.target
        spark = self.panel.sparkSession
        extremes, *_ = together(lambda: ranks.extreme_quantiles(self.rows, self.q, slices=self.slices), lambda: self.rank_table, lambda: self.seasonal.returns, lambda: self.event_time.returns)
        out = spark.createDataFrame([(s,) for s in self.signals], "signal string")
        # a few rows per signal each; written, so that the joins below neither repeat nor plan what leads to them
        performance, regression, *parts = together(*[lambda make=make: None if (df := make()) is None else checkpointed(df) for make in (
            lambda: self.performance, lambda: self.factor_rows, lambda: ranks.pooled_ics(self.rank_table), lambda: ranks.ic_summary(self.ics),
            lambda: ranks.hit_rate(extremes, target, self.q), self.seasonal.period_stats, self.event_time.exposure)])
        for kind in ("seasonal", "event"):
            parts.append(_side_by_side(performance.filter(F.col("kind") == kind), kind))
            if regression is not None:
                prefix = "ff" if kind == "seasonal" else "ffe"
                named = regression.filter(F.col("kind") == kind).drop("kind")
                parts.append(named.select("signal", *[F.col(f"`{c}`").alias(f"{prefix}_{c}")
                                                      for c in named.columns if c != "signal"]))
        for part in parts:
            out = out.join(part, "signal", "left")
        return out.fillna(0, ["n_events", "post_cutoff_n", "seasons", "hit_n"])

    def entry_delay(self, signal: str, delays: Sequence[int] = DELAYS) -> DataFrame:
        """Sharpe ratio and annual return of the event-time book by entry delay."""
        daily = self.event_time.delayed_returns(delays).filter(F.col("signal") == signal)
        return (perf_stats(daily, ["delay_days"], "net")
                .select("delay_days", F.col("sharpe").alias("sharpe_net"), F.col("ann_return").alias("ann_return_net")))

    def daily_series(self) -> DataFrame:
        """``(series, date, ret)`` for ``{signal}_{kind}_{gross|net}``."""
        long = long_series(self.books, ["kind", "signal"])
        kind = F.when(F.col("kind") == "event", "event_time").otherwise(F.col("kind"))
        return long.select(F.concat_ws("_", "signal", kind, "series").alias("series"), "date", "ret")

    def daily_returns(self) -> DataFrame:
        names = [f"{s}_{kind}_{col}" for s in self.signals for kind in ("seasonal", "event_time")
                 for col in ("gross", "net")]
        return sinks.wide_daily(self.daily_series(), names, self.study.market_returns,
                                f"market_{self.study.market.market_ticker}")

    def scored_events(self) -> DataFrame:
        reason = ["tone_reason"] if "tone_reason" in self.panel.columns else []
        return self.panel.select("event_id", "ticker", "published_at", "t0", "season", "post_cutoff", "ar_day0",
                                 self.study.target, *self.signals, *reason)

    def meta(self, primary: str, rater: str | None = None, model_version: str | None = None) -> DataFrame:
        """Counts, first and last entry day, the terms of the run, the rater's label and exact models, and the primary
        signal's median days to trade."""
        lag = self.seasonal.days_to_trade().filter(F.col("signal") == primary).select("median_days_to_trade")
        return self.panel.agg(
            F.count("*").alias("n_events"), F.count_distinct("ticker").alias("n_tickers"),
            F.min("t0").alias("first_event"), F.max("t0").alias("last_event")) \
            .withColumn("hold_days", F.lit(self.study.hold_days)) \
            .withColumn("has_factors", F.lit(self.factors is not None)) \
            .withColumn("benchmark", F.lit(self.study.benchmark)) \
            .withColumn("cost_bps", F.lit(float(self.terms["cost_bps"]))) \
            .withColumn("borrow_bps", F.lit(float(self.terms["borrow_bps_annual"]))) \
            .withColumn("training_cutoff", F.lit(self.cutoff).cast("date")) \
            .withColumn("rater", F.lit(rater).cast("string")) \
            .withColumn("model_version", F.lit(model_version).cast("string")) \
            .withColumn("median_days_to_trade", lag.scalar())

    def write(self, folder: str, primary: str, fmt: str = "parquet", rater: str | None = None, model_version: str | None = None) -> None:
        """All result tables."""
        csv = fmt == "csv"
        holdings = self.seasonal.holdings
        sinks.write_tables({
            "summary": self.summary(), "ic_by_season": sinks.ic_table(self.ics, self.signals),
            "daily_returns": self.daily_returns(),
            "holdings": sinks.holdings_export(holdings) if csv else holdings,
            "events_scored": self.scored_events(), "entry_delay": self.entry_delay(primary),
            "meta": self.meta(primary, rater, model_version)}, folder, fmt)
