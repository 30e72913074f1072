"""Trading calendar, entry days and rebalance dates.

The calendar has one row per trading day, so every frame built from it alone is bounded by
the number of days and may be broadcast.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the session closes at 16:00 wall-clock time.
CLOSING_HOUR = 16


def trading_calendar(prices: DataFrame) -> DataFrame:
    """``(pos, date)``: every date in the price panel with its position."""
    days = prices.agg(F.array_sort(F.collect_set("date")).alias("days"))
    return days.select(F.posexplode("days").alias("pos", "date"))


def last_position(calendar: DataFrame) -> Column:
    return calendar.agg(F.max("pos")).scalar()


def entry_days(calendar: DataFrame, entry_lag_days: int = 0) -> DataFrame:
    """Every calendar day up to the last trading day with the entry day it leads to."""
    order = Window.orderBy("pos")
    trading = (calendar
               .withColumn("previous", F.lag("date").over(order))
               .withColumn("t0", F.lead("date", entry_lag_days).over(order) if entry_lag_days else F.col("date")))
    first = F.coalesce(F.date_add("previous", 1), F.col("date"))
    return (trading
            .select(F.explode(F.sequence(first, F.col("date"))).alias("day"),
                    (F.col("pos") + entry_lag_days).alias("t0_pos"), "t0")
            .filter(F.col("t0").isNotNull()))


def assign_t0(events: DataFrame, calendar: DataFrame, entry_lag_days: int = 0) -> DataFrame:
    """Add ``t0_pos`` and ``t0``: the first trading day whose close comes after publication.

    A document at or after 16:00 counts for the next calendar day. Both columns are null
    past the end of the calendar and without a publication time. An equi-join on the calendar day replaces the as-of search.
    """
    published = F.col("published_at")
    candidate = F.date_add(F.to_date(published),
                           F.when(F.hour(published) >= CLOSING_HOUR, 1).otherwise(0))
    first_day = calendar.agg(F.min("date")).scalar()
    # greatest() passes over nulls: a document without a time must not become one of the first day
    return (events.withColumn("day", F.when(candidate.isNotNull(), F.greatest(candidate, first_day)))
            .join(F.broadcast(entry_days(calendar, entry_lag_days)), "day", "left")
            .drop("day"))


def season_label(date: Column, months: Sequence[int]) -> Column:
    """The next rebalance month strictly after ``date``'s month, as ``yyyy-MM``."""
    later = F.filter(F.array(*[F.lit(m) for m in sorted(months)]), lambda m: m > F.month(date))
    return F.when(F.size(later) > 0, F.format_string("%d-%02d", F.year(date), F.get(later, F.lit(0)))) \
        .otherwise(F.format_string("%d-%02d", F.year(date) + 1, F.lit(min(months))))


def rebalance_dates(calendar: DataFrame, months: Sequence[int], start=None, end=None) -> DataFrame:
    """First trading day of each listed month, after trimming the calendar to [start, end]."""
    days = calendar
    if start is not None:
        days = days.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.filter(F.col("date") <= F.lit(end).cast("date"))
    return (days.groupBy(F.year("date").alias("year"), F.month("date").alias("month"))
            .agg(F.min("date").alias("rebalance"))
            .filter(F.col("month").isin([int(m) for m in months]))
            .select("rebalance"))
