"""The event-time book: each extreme document is held for days +1..+H.

Membership compares a score with strictly earlier ones only. Positions are collapsed to
(signal, company, entry day, leg) with counts before they are spread over the days held.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators.calendar import last_position
from driftmark.operators.history import historical_midrank
from driftmark.session import checkpointed


def day_legs(rows: DataFrame, quantiles: int, min_history: int, slices: int | None = None) -> DataFrame:
    """``(signal, t0_pos, value, n_prior, hist_pct, leg)`` for each distinct score of a day."""
    enough = F.col("n_prior") >= min_history
    leg = (F.when(enough & (F.col("hist_pct") <= F.lit(1 / quantiles)), -1)
           .when(enough & (F.col("hist_pct") >= F.lit(1 - 1 / quantiles)), 1)
           .otherwise(0))
    return historical_midrank(rows, slices).withColumn("leg", leg)


def document_legs(rows: DataFrame, legs: DataFrame) -> DataFrame:
    """The legs on the documents themselves."""
    return rows.join(legs, ["signal", "t0_pos", "value"])


def positions_from(rows: DataFrame, legs: DataFrame) -> DataFrame:
    """``(signal, ticker, t0_pos, leg, n)`` for documents that open a position.

    A higher score of a day never stands lower in the history, so a day's legs are two limits: one row per
    signal and day, which meets the documents by broadcast.
    """
    limits = legs.filter(F.col("leg") != 0).groupBy("signal", "t0_pos").agg(
        F.max(F.when(F.col("leg") == -1, F.col("value"))).alias("low"), F.min(F.when(F.col("leg") == 1, F.col("value"))).alias("high"))
    leg = F.when(F.col("value") <= F.col("low"), -1).when(F.col("value") >= F.col("high"), 1)
    return (rows.join(F.broadcast(limits), ["signal", "t0_pos"]).withColumn("leg", leg).filter(F.col("leg").isNotNull())
            .groupBy("signal", "ticker", "t0_pos", "leg").agg(F.count("*").alias("n")))


def event_time_returns(positions: DataFrame, rets: DataFrame, market: DataFrame, calendar: DataFrame,
                       hold_days: int, cost_bps: float, borrow_bps_annual: float,
                       by: Sequence[str] = ("signal",)) -> DataFrame:
    """Daily ``long, short, gross, cost, net, names_long, names_short`` per book.

    An empty leg is replaced by the market. Entries and exits cost their share of the leg that
    day; an exit that leaves the leg empty costs nothing. The frame runs from the first to the
    last day with a held return. Positions opened on the last day cannot be held and are ignored.
    """
    by = list(by)
    last = last_position(calendar)
    open_ = positions.withColumn("last", last).filter(F.col("t0_pos") < F.col("last"))
    until = F.least(F.col("t0_pos") + hold_days, F.col("last"))
    held = (open_.select(*by, "ticker", "leg", "n", F.explode(F.sequence(F.col("t0_pos") + 1, until)).alias("pos"))
            .groupBy(*by, "ticker", "leg", "pos").agg(F.sum("n").alias("n"))
            .join(rets.select("ticker", "pos", "ret"), ["ticker", "pos"], "left")
            .select(*by, "pos", "leg", "n", F.when(F.col("ret").isNotNull(), F.col("n")).otherwise(0).alias("valid"),
                    F.coalesce(F.col("n") * F.col("ret"), F.lit(0.0)).alias("earned"),
                    F.lit(0).cast("long").alias("flow")))
    flows = (open_.select(*by, "leg", "n", "last",
                          F.explode(F.array(F.col("t0_pos") + 1, until + 1)).alias("pos"))
             .filter(F.col("pos") <= F.col("last"))
             .select(*by, "pos", "leg", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("valid"),
                     F.lit(0.0).alias("earned"), F.col("n").alias("flow")))

    def on(leg: int, column: str):
        return F.coalesce(F.sum(F.when(F.col("leg") == leg, F.col(column))), F.lit(0))

    per_day = held.unionByName(flows).groupBy(*by, "pos").agg(
        *[on(leg, c).alias(f"{c}_{name}") for leg, name in ((1, "long"), (-1, "short"))
          for c in ("n", "valid", "earned", "flow")])
    active = F.col("valid_long") + F.col("valid_short") > 0
    span = (per_day.filter(active).groupBy(*by)
            .agg(F.min("pos").alias("first"), F.max("pos").alias("final"))
            .select(*by, F.explode(F.sequence("first", "final")).alias("pos")))
    days = (span.join(per_day, [*by, "pos"], "left")
            .fillna(0, [f"{c}_{s}" for c in ("n", "valid", "earned", "flow") for s in ("long", "short")])
            .join(F.broadcast(calendar), "pos")
            .join(F.broadcast(market.select("pos", "market")), "pos", "left"))

    def leg_return(side: str):
        return F.when(F.col(f"valid_{side}") > 0, F.col(f"earned_{side}") / F.col(f"valid_{side}"))

    def leg_turnover(side: str):
        return F.when(F.col(f"valid_{side}") > 0, F.col(f"flow_{side}") / F.col(f"valid_{side}")).otherwise(0.0)

    long, short, bench = F.col("long"), F.col("short"), F.col("market")
    gross = (F.when(long.isNotNull() & short.isNotNull(), long - short)
             .when(long.isNotNull(), long - bench)
             .when(short.isNotNull(), bench - short))
    cost = ((leg_turnover("long") + leg_turnover("short")) * cost_bps / 1e4
            + F.when(active, borrow_bps_annual / 1e4 / 252).otherwise(0.0))
    return (days.withColumn("long", leg_return("long")).withColumn("short", leg_return("short"))
            .withColumn("gross", F.coalesce(gross, F.lit(0.0))).withColumn("cost", cost)
            .select(*by, "pos", "date", "long", "short", "gross", "cost",
                    (F.col("gross") - F.col("cost")).alias("net"),
                    F.col("n_long").alias("names_long"), F.col("n_short").alias("names_short")))


def book_exposure(positions: DataFrame, daily: DataFrame) -> DataFrame:
    """How concentrated the event-time book is, per signal.

    Names count whether or not they had a return that day; whole-book and one-leg days are
    judged on the legs' returns.
    """
    counts = positions.groupBy("signal").agg(
        F.sum(F.when(F.col("leg") == 1, F.col("n")).otherwise(0)).alias("event_positions_long"),
        F.sum(F.when(F.col("leg") == -1, F.col("n")).otherwise(0)).alias("event_positions_short"))
    holds = (F.col("names_long") > 0) | (F.col("names_short") > 0)
    has_long, has_short = F.col("long").isNotNull(), F.col("short").isNotNull()
    shape = daily.groupBy("signal").agg(
        F.median(F.when(holds, F.col("names_long"))).alias("event_median_names_long"),
        F.median(F.when(holds, F.col("names_short"))).alias("event_median_names_short"),
        F.avg((has_long & has_short).cast("double")).alias("event_share_both_legs"),
        F.avg((has_long != has_short).cast("double")).alias("event_share_one_leg"))
    return counts.join(shape, "signal", "left")


class EventTimeBook:
    """All frames of the event-time book for every signal in ``rows``.

    The positions (at most one row per signal, company, day and leg) and the daily returns are
    written out once.
    """

    def __init__(self, rows: DataFrame, rets: DataFrame, market: DataFrame, calendar: DataFrame, *,
                 hold_days: int = 20, quantiles: int = 5, min_history: int = 40,
                 cost_bps: float = 10, borrow_bps_annual: float = 50, slices: int | None = None):
        self._market_inputs = (rets, market, calendar)
        self._terms = (hold_days, cost_bps, borrow_bps_annual)
        self._membership = (quantiles, min_history, slices)
        self.rows = rows

    @cached_property
    def legs(self) -> DataFrame:
        return day_legs(self.rows, *self._membership)

    @cached_property
    def positions(self) -> DataFrame:
        return checkpointed(positions_from(self.rows, self.legs))

    @cached_property
    def returns(self) -> DataFrame:
        return checkpointed(event_time_returns(self.positions, *self._market_inputs, *self._terms))

    def documents(self) -> DataFrame:
        return document_legs(self.rows, self.legs)

    def exposure(self) -> DataFrame:
        return book_exposure(self.positions, self.returns)

    def delayed_returns(self, delays: Sequence[int]) -> DataFrame:
        """Daily returns when every trade starts later; membership does not change."""
        rets, market, calendar = self._market_inputs
        shifted = (self.positions
                   .withColumn("delay_days", F.explode(F.array(*[F.lit(int(d)) for d in delays])))
                   .withColumn("t0_pos", F.col("t0_pos") + F.col("delay_days")))
        return event_time_returns(shifted, rets, market, calendar, *self._terms, by=("signal", "delay_days"))
