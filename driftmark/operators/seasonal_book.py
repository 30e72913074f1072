"""The seasonal book: rank companies by their latest document, trade at each rebalance.

Documents are reduced to the latest per (signal, rebalance, company) before anything else, so what
follows is bounded by companies times rebalances and no busy company reaches a single task whole.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.calendar import rebalance_dates
from driftmark.session import checkpointed


def tiebreak(event_id: Column) -> Column:
    """First eight hex digits of md5(id) as a number: arbitrary but stable."""
    return F.conv(F.substring(F.md5(event_id), 1, 8), 16, 10).cast("long")


def latest_documents(rows: DataFrame, rebalances: DataFrame, lookback_days: int) -> DataFrame:
    """Latest document per (signal, rebalance, ticker) with t0 in [R - lookback, R).

    ``rows``: signal, event_id, ticker, t0, published_at, value. The window is unrolled into the
    days it covers (rebalances x lookback days, calendar-sized) and joined on equality by broadcast;
    documents of a busy company combine on the map side before the only shuffle.
    """
    newest = F.struct("t0", "published_at", "event_id")
    covered = rebalances.select(
        "rebalance",
        F.explode(F.sequence(F.date_sub("rebalance", lookback_days), F.date_sub("rebalance", 1))).alias("t0"))
    return (rows.join(F.broadcast(covered), "t0")
            .groupBy("signal", "rebalance", "ticker")
            .agg(F.max_by(F.struct("event_id", "t0", "value"), newest).alias("doc"))
            .select("signal", "rebalance", "ticker", "doc.*"))


def hold_days(calendar: DataFrame, rebalances: DataFrame) -> DataFrame:
    """``(rebalance, end, first_pos, pos, date)``: each trading day after its last rebalance.

    ``end`` is the next rebalance, or the last trading day.
    """
    order = Window.orderBy("pos")
    marked = (calendar.join(F.broadcast(rebalances.withColumn("date", F.col("rebalance"))), "date", "left")
              .withColumn("held", F.last("rebalance", ignorenulls=True)
                          .over(order.rowsBetween(Window.unboundedPreceding, -1)))
              .filter(F.col("held").isNotNull()))
    period = Window.partitionBy("held")
    return marked.select(F.col("held").alias("rebalance"), F.max("date").over(period).alias("end"),
                         F.min("pos").over(period).alias("first_pos"), "pos", "date")


def seasonal_legs(latest: DataFrame, periods: DataFrame, q: int, min_names: int) -> DataFrame:
    """``(signal, rebalance, ticker, side, weight, rank, k, period_no)``; side is +1 or -1.

    Top and bottom floor(n/q) companies by (value, tie-breaker). Periods with fewer than
    ``min_names`` per leg or without a day to hold are skipped; ``period_no`` counts the rest.
    """
    book = Window.partitionBy("signal", "rebalance")
    ranked = (latest.join(F.broadcast(periods.select("rebalance").distinct()), "rebalance", "left_semi")
              .withColumn("rank", F.row_number().over(book.orderBy("value", tiebreak(F.col("event_id")), "ticker")))
              .withColumn("n", F.count("*").over(book))
              .withColumn("k", F.floor(F.col("n") / q))
              .filter(F.col("k") >= min_names))
    side = F.when(F.col("rank") <= F.col("k"), -1).when(F.col("rank") > F.col("n") - F.col("k"), 1)
    legs = (ranked.withColumn("side", side).filter(F.col("side").isNotNull())
            .withColumn("weight", F.col("side") / F.col("k")))
    numbered = Window.partitionBy("signal").orderBy("rebalance")
    order = (legs.select("signal", "rebalance").distinct()
             .withColumn("period_no", F.row_number().over(numbered)))
    return (legs.join(order, ["signal", "rebalance"])
            .select("signal", "rebalance", "period_no", "ticker", "side", "weight", "rank", "k"))


def turnover(legs: DataFrame) -> DataFrame:
    """``(signal, rebalance, turnover)``: sum of absolute weight changes since the last traded period."""
    periods = legs.select("signal", "rebalance", "period_no").distinct()
    change = (legs.select("signal", "ticker", F.explode(F.array(
        F.struct(F.col("period_no").alias("period_no"), F.col("weight").alias("delta")),
        F.struct((F.col("period_no") + 1).alias("period_no"), (-F.col("weight")).alias("delta")))).alias("move"))
        .groupBy("signal", "move.period_no", "ticker").agg(F.sum("move.delta").alias("delta"))
        .groupBy("signal", "period_no").agg(F.sum(F.abs("delta")).alias("turnover")))
    return periods.join(change, ["signal", "period_no"]).select("signal", "rebalance", "turnover")


def seasonal_returns(legs: DataFrame, moves: DataFrame, periods: DataFrame, rets: DataFrame,
                     cost_bps: float, borrow_bps_annual: float) -> DataFrame:
    """Daily ``long, short, gross, cost, net`` of the seasonal book.

    Legs are equal-weighted over the names with a return that day. Trading cost falls on the
    first day held, the borrow fee on every day.
    """
    held_rets = (rets.join(F.broadcast(periods.select("pos", "rebalance")), "pos")
                 .join(legs.select("signal", "rebalance", "ticker", "side"), ["rebalance", "ticker"])
                 .groupBy("signal", "pos")
                 .agg(F.avg(F.when(F.col("side") == 1, F.col("ret"))).alias("long"),
                      F.avg(F.when(F.col("side") == -1, F.col("ret"))).alias("short")))
    days = moves.join(F.broadcast(periods), "rebalance")
    cost = (F.when(F.col("pos") == F.col("first_pos"), F.col("turnover") * cost_bps / 1e4).otherwise(0.0)
            + borrow_bps_annual / 1e4 / 252)
    return (days.join(held_rets, ["signal", "pos"], "left")
            .withColumn("gross", F.coalesce(F.col("long") - F.col("short"), F.lit(0.0)))
            .withColumn("cost", cost)
            .select("signal", "rebalance", "pos", "date", "long", "short", "gross", "cost",
                    (F.col("gross") - F.col("cost")).alias("net")))


def holdings_report(legs: DataFrame, moves: DataFrame, periods: DataFrame, daily: DataFrame) -> DataFrame:
    """One row per traded period with names, turnover and the period's net return."""
    def names(side: int) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "ticker"))))
        return F.transform(kept, lambda s: s["ticker"])

    members = legs.groupBy("signal", "rebalance").agg(
        F.max("k").alias("n_per_leg"), names(1).alias("longs"), names(-1).alias("shorts"))
    grown = daily.groupBy("signal", "rebalance").agg((F.product(1 + F.col("net")) - 1).alias("period_net"))
    ends = periods.select("rebalance", "end").distinct()
    return (members.join(moves, ["signal", "rebalance"]).join(grown, ["signal", "rebalance"])
            .join(F.broadcast(ends), "rebalance")
            .select("signal", "rebalance", "end", "n_per_leg", "turnover", "longs", "shorts", "period_net"))


class SeasonalBook:
    """All frames of the seasonal book for every signal in ``rows``.

    The latest documents and the legs (signals x rebalances x names) and the daily returns (signals x days)
    feed all the rest and are written out once.
    """

    def __init__(self, rows: DataFrame, rets: DataFrame, calendar: DataFrame, *,
                 rebalance_months: Sequence[int] = (3, 6, 9, 12), lookback_days: int = 100, quantiles: int = 5,
                 min_names_per_leg: int = 3, cost_bps: float = 10, borrow_bps_annual: float = 50,
                 scored: DataFrame | None = None):
        """``scored``: the documents with a score, whether they have a return or not; by default ``rows``."""
        rebalances = rebalance_dates(calendar, rebalance_months)
        self._scored = (rows if scored is None else scored, rebalances, lookback_days)
        self._rets = rets
        self._leg_terms = (quantiles, min_names_per_leg)
        self._costs = (cost_bps, borrow_bps_annual)
        self.periods = hold_days(calendar, rebalances)
        self._rows = rows

    @cached_property
    def latest(self) -> DataFrame:
        return checkpointed(latest_documents(self._rows, *self._scored[1:]))

    @cached_property
    def legs(self) -> DataFrame:
        return checkpointed(seasonal_legs(self.latest, self.periods, *self._leg_terms))

    @cached_property
    def turnover(self) -> DataFrame:
        return turnover(self.legs)

    @cached_property
    def returns(self) -> DataFrame:
        return checkpointed(seasonal_returns(self.legs, self.turnover, self.periods, self._rets, *self._costs))

    @cached_property
    def holdings(self) -> DataFrame:
        return holdings_report(self.legs, self.turnover, self.periods, self.returns)

    def days_to_trade(self) -> DataFrame:
        """Median calendar days between the latest scored document and the rebalances that were traded, per signal."""
        traded = self.legs.select("signal", "rebalance").distinct()
        return (latest_documents(*self._scored).join(traded, ["signal", "rebalance"], "left_semi")
                .groupBy("signal")
                .agg(F.median(F.date_diff("rebalance", "t0")).alias("median_days_to_trade")))

    def period_stats(self) -> DataFrame:
        """Mean turnover, share of periods that made money and the number of periods, per signal."""
        return self.holdings.groupBy("signal").agg(
            F.avg("turnover").alias("seasonal_turnover"),
            F.avg((F.col("period_net") > 0).cast("double")).alias("seasonal_periods_positive"),
            F.count("*").alias("seasonal_periods"))
