"""Performance of daily return series of any length."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.ordering import PART, PLACE, ranged

# Fixed value: trading days per year.
TRADING_DAYS = 252

STATS = ("ann_return", "cagr", "ann_vol", "sharpe", "sharpe_se", "max_drawdown", "total_return", "days")


def wealth_curve(daily: DataFrame, keys: Sequence[str], ret: str = "ret", slices: int | None = None) -> DataFrame:
    """Add ``wealth`` (growth of 1) and ``drawdown`` from the running peak, which starts at the first wealth.

    A blocked scan: the rows lie sorted in range partitions, each partition's stretch of a series is
    grown on its own, and one row per stretch (its growth, its highest and lowest point) carries wealth and
    peak to the next. Of a stretch that starts below zero the lowest point is the peak. A series of any
    length is so cut; a null return leaves wealth as it was.
    """
    placed = ranged(daily, keys, ["date"], slices)
    inside = Window.partitionBy(*keys, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    grown = placed.withColumn("grown", F.coalesce(F.product(1 + F.col(ret)).over(inside), F.lit(1.0)))
    along = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    stretches = (grown.groupBy(*keys, PART).agg(F.max_by("grown", PLACE).alias("growth"), F.max("grown").alias("top"), F.min("grown").alias("low"))
                 .withColumn("start", F.coalesce(F.product("growth").over(along), F.lit(1.0)))
                 .withColumn("summit", F.when(F.col("start") >= 0, F.col("start") * F.col("top")).otherwise(F.col("start") * F.col("low")))
                 .select(*keys, PART, "start", F.max("summit").over(along).alias("before")))
    curve = grown.join(stretches, [*keys, PART]).withColumn("wealth", F.col("start") * F.col("grown"))
    return (curve.withColumn("drawdown", F.try_divide("wealth", F.greatest(F.col("before"), F.max("wealth").over(inside))) - 1)
            .drop("grown", "start", "before", PART, PLACE))


def perf_stats(daily: DataFrame, keys: Sequence[str], ret: str = "ret", slices: int | None = None) -> DataFrame:
    """Annual return, volatility, Sharpe ratio with its standard error, growth, drawdown, days.

    Null returns are dropped; a series with fewer than two rows has no statistics.
    """
    curve = wealth_curve(daily.filter(F.col(ret).isNotNull()).select(*keys, "date", ret), keys, ret, slices)
    sums = (curve.groupBy(*keys).agg(
        (F.avg(ret) * TRADING_DAYS).alias("ann_return"),
        (F.stddev_samp(ret) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("ann_vol"),
        F.max_by("wealth", "date").alias("wealth"),
        F.min("drawdown").alias("max_drawdown"), F.count("*").alias("days"))
        .filter(F.col("days") >= 2)
        .withColumn("years", F.col("days") / TRADING_DAYS)
        .withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol"))))
    growth = F.nanvl(F.pow("wealth", 1 / F.col("years")), F.lit(None).cast("double")) - 1
    se = F.sqrt((1 + F.lit(0.5) * F.col("sharpe") * F.col("sharpe")) / F.col("years"))
    return sums.select(*keys, "ann_return", growth.alias("cagr"), "ann_vol", "sharpe", se.alias("sharpe_se"),
                       "max_drawdown", (F.col("wealth") - 1).alias("total_return"), "days")


def long_series(daily: DataFrame, keys: Sequence[str], columns: Sequence[str] = ("net", "gross")) -> DataFrame:
    """Unpivot the return columns of a book into ``(keys…, date, series, ret)``."""
    return daily.select(*keys, "date", *columns).unpivot([*keys, "date"], list(columns), "series", "ret")
