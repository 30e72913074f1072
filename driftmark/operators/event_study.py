"""Returns, abnormal returns and cumulative abnormal returns.

A window of returns depends only on (ticker, entry position). Abnormal returns are summed along the
calendar once per ticker; a CAR is the difference of two of these sums, whatever its horizon, so all
studies of a panel share one table. The finished windows, at most tickers x days, meet the documents once.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.calendar import assign_t0, last_position, season_label, trading_calendar
from driftmark.session import checkpointed

# Fixed value: an event with more than this share of its window missing has no CAR.
MAX_MISSING_SHARE = 0.2


def returns_from_prices(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Simple returns ``(ticker, pos, date, ret)`` against the previous calendar row.

    A missing day leaves two null returns; nothing is filled.
    """
    by_ticker = Window.partitionBy("ticker").orderBy("pos")
    close = F.nanvl(F.col("close"), F.lit(None).cast("double"))
    return (prices.select("ticker", "date", close.alias("close"))
            .join(F.broadcast(calendar), "date")
            .withColumn("prev_close", F.lag("close").over(by_ticker))
            .withColumn("prev_pos", F.lag("pos").over(by_ticker))
            .select("ticker", "pos", "date",
                    F.when(F.col("prev_pos") == F.col("pos") - 1,
                           F.try_divide("close", F.col("prev_close")) - 1).alias("ret")))


def benchmark_tickers(tickers: DataFrame, universe: DataFrame | None, mode: str, market_ticker: str) -> DataFrame:
    """``(ticker, bench)`` for every ticker of the panel.

    ``sector`` uses the sector fund where it has prices and the market elsewhere.
    """
    if mode == "market":
        return tickers.select("ticker", F.lit(market_ticker).alias("bench"))
    if mode != "sector":
        raise ValueError(f"unknown benchmark {mode!r}: use 'market' or 'sector'")
    funds = universe.select("ticker", F.col("sector_etf").alias("fund"))
    listed = tickers.select(F.col("ticker").alias("fund"), F.lit(True).alias("listed"))
    return (tickers.join(funds, "ticker", "left").join(listed, "fund", "left")
            .select("ticker", F.when(F.col("listed"), F.col("fund"))
                    .otherwise(F.lit(market_ticker)).alias("bench")))


def abnormal_returns(rets: DataFrame, bench: DataFrame) -> DataFrame:
    """``(ticker, pos, ar)``: stock return minus its benchmark's return on the same day."""
    hedge = rets.select(F.col("ticker").alias("bench"), "pos", F.col("ret").alias("bench_ret"))
    return (rets.join(bench, "ticker").join(hedge, ["bench", "pos"], "left")
            .select("ticker", "pos", (F.col("ret") - F.col("bench_ret")).alias("ar")))


def running_abnormal(tickers: DataFrame, ar: DataFrame, calendar: DataFrame) -> DataFrame:
    """``(ticker, pos, ar, ar_sum, ar_days)`` for every ticker and calendar day: abnormal returns up to and with that day.

    A sum over any stretch of days is the difference of two of these rows, so one table serves every
    holding period. A missing return adds nothing to the sum and is not counted.
    """
    days = F.explode(F.sequence(F.lit(0), last_position(calendar)))
    upto = Window.partitionBy("ticker").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (tickers.select("ticker", days.alias("pos")).join(ar, ["ticker", "pos"], "left")
            .select("ticker", "pos", "ar", F.sum(F.coalesce("ar", F.lit(0.0))).over(upto).alias("ar_sum"), F.count("ar").over(upto).alias("ar_days")))


def event_windows(running: DataFrame, hold_days: int) -> DataFrame:
    """Day-0 return and CAR[+1,+H] for each ``(ticker, t0_pos)``.

    Both are null when the window runs past the calendar or too much of it is missing.
    """
    by_pos = Window.partitionBy("ticker").orderBy("pos")
    end = F.lead(F.struct("ar_sum", "ar_days"), hold_days).over(by_pos)
    seen = F.col("end.ar_days") - F.col("ar_days")
    complete = F.col("end").isNotNull() & ((hold_days - seen) / hold_days <= MAX_MISSING_SHARE)
    return (running.withColumn("end", end)
            .select("ticker", F.col("pos").alias("t0_pos"), F.when(complete, F.col("ar")).alias("ar_day0"),
                    F.when(complete, F.col("end.ar_sum") - F.col("ar_sum")).alias(f"car_1_{hold_days}")))


def window_paths(entries: DataFrame, running: DataFrame, hold_days: int) -> DataFrame:
    """``entries`` (ticker, t0_pos, the CAR and more) with ``day`` 0..H and ``car`` up to that day.

    Day 0 is 0 and rejected windows are null. Each step is met by its day, none is summed again.
    """
    sums = running.select("ticker", "pos", "ar_sum")
    days = (entries.withColumn("complete", F.col(f"car_1_{hold_days}").isNotNull())
            .join(sums.select("ticker", F.col("pos").alias("t0_pos"), F.col("ar_sum").alias("base")), ["ticker", "t0_pos"])
            .withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(hold_days)))).withColumn("pos", F.col("t0_pos") + F.col("day")))
    car = F.when(F.col("complete"), F.col("ar_sum") - F.col("base"))
    return days.join(sums, ["ticker", "pos"], "left").withColumn("car", car).drop("complete", "base", "pos", "ar_sum")


class PricePanel:
    """Calendar, returns and running abnormal returns of one price panel, each written out once for all studies."""

    def __init__(self, prices: DataFrame, market_ticker: str = "SPY"):
        # a date, so that the calendar has one row per day and may be broadcast
        self.prices, self.market_ticker = prices.withColumn("date", F.to_date("date")), market_ticker
        self._running: dict[tuple, tuple] = {}

    @cached_property
    def calendar(self) -> DataFrame:
        return checkpointed(trading_calendar(self.prices))

    @cached_property
    def returns(self) -> DataFrame:
        return checkpointed(returns_from_prices(self.prices, self.calendar))

    @cached_property
    def tickers(self) -> DataFrame:
        return self.returns.select("ticker").distinct()

    @property
    def market_returns(self) -> DataFrame:
        return (self.returns.filter(F.col("ticker") == self.market_ticker)
                .select("pos", "date", F.col("ret").alias("market")))

    def running_abnormal(self, universe: DataFrame | None, benchmark: str) -> DataFrame:
        """The running sums of returns above one benchmark, whatever the holding period of a study."""
        key = (benchmark, None if benchmark == "market" else id(universe))
        if key not in self._running:
            bench = benchmark_tickers(self.tickers, universe, benchmark, self.market_ticker)
            ar = abnormal_returns(self.returns, bench)
            # the universe is kept, so that its id stays its own
            self._running[key] = (checkpointed(running_abnormal(self.tickers, ar, self.calendar)), universe)
        return self._running[key][0]


class EventStudy:
    """The frames of one study.

    ``windows`` (tickers x days) feed every later operator, so they are written out once and
    read back; the documents stay lazy and are not read for them. While the windows are small the documents meet them in a
    broadcast join and are never shuffled.
    """

    def __init__(self, events: DataFrame, prices: DataFrame | PricePanel, universe: DataFrame | None = None, *,
                 benchmark: str = "market", market_ticker: str = "SPY", hold_days: int = 20,
                 entry_lag_days: int = 0, rebalance_months: Sequence[int] = (3, 6, 9, 12)):
        self.market = prices if isinstance(prices, PricePanel) else PricePanel(prices, market_ticker)
        self.events, self.universe, self.benchmark = events, universe, benchmark
        self.hold_days, self.entry_lag_days = hold_days, entry_lag_days
        self.months = tuple(rebalance_months)
        self.target = f"car_1_{hold_days}"

    @property
    def calendar(self) -> DataFrame:
        return self.market.calendar

    @property
    def returns(self) -> DataFrame:
        return self.market.returns

    @property
    def market_returns(self) -> DataFrame:
        return self.market.market_returns

    @cached_property
    def running(self) -> DataFrame:
        return self.market.running_abnormal(self.universe, self.benchmark)

    @cached_property
    def dated(self) -> DataFrame:
        """Documents with an entry day inside the calendar."""
        return assign_t0(self.events, self.calendar, self.entry_lag_days).filter(F.col("t0_pos").isNotNull())

    @cached_property
    def windows(self) -> DataFrame:
        """One row per (ticker, entry position)."""
        return checkpointed(event_windows(self.running, self.hold_days))

    @cached_property
    def panel(self) -> DataFrame:
        """Documents with t0, season, day-0 return and CAR."""
        return (self.dated.join(self.windows, ["ticker", "t0_pos"])
                .withColumn("season", season_label(F.col("t0"), self.months)))

    @property
    def paths(self) -> DataFrame:
        """CAR paths of the (ticker, t0_pos) that documents use; all documents of a pair share one path."""
        entries = self.windows.join(self.dated.select("ticker", "t0_pos").distinct(), ["ticker", "t0_pos"], "left_semi")
        return window_paths(entries, self.running, self.hold_days).select("ticker", "t0_pos", "day", "car")

    def document_paths(self) -> DataFrame:
        """``(event_id, day, car)``."""
        documents = self.panel.select("event_id", "ticker", "t0_pos", self.target)
        return window_paths(documents, self.running, self.hold_days).select("event_id", "day", "car")
