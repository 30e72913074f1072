"""Rank statistics: Spearman correlation, information coefficients, quantiles and hit rates.

Signals are handled in long form ``(…, signal, value)``, so one job serves all of them.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.functions.student_t import critical_975, two_sided_p
from driftmark.operators.ordering import positions, running_counts
from driftmark.session import checkpointed


def signal_rows(panel: DataFrame, signals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Unpivot signal columns into ``(keep…, signal, value)`` without null scores."""
    wide = panel.select(*keep, *[F.col(s).cast("double").alias(s) for s in signals])
    return (wide.unpivot(list(keep), list(signals), "signal", "value")
            .withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
            .filter(F.col("value").isNotNull()))


def _pairs(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """The distinct complete (x, y) of each group with counts, written once."""
    number = [F.col(c).cast("double").alias(a) for c, a in ((x, "x_value"), (y, "y_value"))]
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, *number)
    return checkpointed(complete.groupBy(*keys, "x_value", "y_value").agg(F.count("*").alias("pair_n")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, *, slices: int | None = None) -> DataFrame:
    """``(keys…, n, x_varies, rho)`` by group: Pearson correlation of average ranks; see :func:`_rank_moments`.

    ``rho`` is null when either side is constant.
    """
    return _rank_moments(_pairs(df, keys, x, y), keys, slices)


def _rank_moments(pairs: DataFrame, keys: Sequence[str], slices: int | None) -> DataFrame:
    """The correlation from counted pairs, which may come more than once.

    The counts of the distinct y lie sorted in one table, whose running sums give centred average ranks. They
    are joined to the pairs, which are then summed by x: all the correlation needs of an x is its count and the
    sum of the ranks beside it. So the ranks of x are met in the sorted table of these sums, and no pair is joined to
    them. Few distinct y make a small table that adaptive execution broadcasts; with many the join shuffles, and a
    value that still stands out is split.
    """
    centred = F.col("below") + (F.col("ties") + 1) / 2 - (F.col("total") + 1) / 2
    counts = pairs.groupBy(*keys, "y_value").agg(F.sum("pair_n").alias("ties"))
    of_y = running_counts(counts, keys, "y_value", "ties", slices).select(*keys, "y_value", centred.alias("rank_y"))
    weighted = F.col("pair_n") * F.col("rank_y")
    by_x = pairs.join(of_y, [*keys, "y_value"]).groupBy(*keys, "x_value").agg(
        F.sum("pair_n").alias("ties"), F.sum(weighted).alias("y"), F.sum(weighted * F.col("rank_y")).alias("yy"))
    ranked = running_counts(by_x, keys, "x_value", "ties", slices).withColumn("rank_x", centred)
    sums = ranked.groupBy(*keys).agg(
        F.sum("ties").alias("n"), F.sum(F.col("rank_x") * F.col("y")).alias("xy"),
        F.sum(F.col("ties") * F.col("rank_x") * F.col("rank_x")).alias("xx"), F.sum("yy").alias("yy"))
    spread = F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))
    return sums.select(*keys, "n", (F.col("xx") > 0).alias("x_varies"),
                       F.try_divide(F.col("xy"), spread).alias("rho"))


def ic_by_season(rows: DataFrame, target: str, *, min_n: int = 10, slices: int | None = None) -> DataFrame:
    """Information coefficient per (signal, season): at least ``min_n`` rows and a varying signal."""
    return (spearman(rows, ["signal", "season"], "value", target, slices=slices)
            .filter((F.col("n") >= min_n) & F.col("x_varies"))
            .select("signal", "season", "n", F.col("rho").alias("ic")))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean IC with its t statistic, p-value, critical value and positive share per signal."""
    stats = ics.groupBy("signal").agg(
        F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"),
        F.avg(F.coalesce((F.col("ic") > 0).cast("double"), F.lit(0.0))).alias("ic_pos_share"),
        F.count("*").alias("seasons"))
    t = F.when(F.col("sd") > 0, F.col("mean_ic") / F.col("sd") * F.sqrt("seasons"))
    freedom = F.col("seasons") - 1
    return (stats.withColumn("ic_t", t)
            .select("signal", "mean_ic", "ic_t", two_sided_p(F.col("ic_t"), freedom).alias("ic_p"),
                    critical_975(freedom).alias("ic_t_crit"), "ic_pos_share", "seasons"))


def rank_test(rows: DataFrame, keys: Sequence[str], x: str, y: str, *, slices: int | None = None) -> DataFrame:
    """Spearman correlation with its two-sided p-value per group."""
    rho = F.col("rho")
    t = F.when(F.col("n") > 2, rho * F.sqrt(F.try_divide(F.col("n") - 2, 1 - rho * rho)))
    p = F.when(F.abs(rho) >= 1, 0.0).otherwise(two_sided_p(t, F.col("n") - 2))
    return (spearman(rows, keys, x, y, slices=slices)
            .select(*keys, "n", "rho", F.when(rho.isNotNull() & (F.col("n") > 2), p).alias("p")))


def scoped_spearman(rows: DataFrame, target: str, *, slices: int | None = None) -> DataFrame:
    """``(signal, scope, season, n, x_varies, rho)``: each season, all documents, and those after the cutoff, in one go.

    ``rows`` carry ``season`` and ``post_cutoff``; season is null in the scopes ``all`` and ``post``.
    """
    def scope(name: str, season: Column) -> Column:
        return F.struct(F.lit(name).alias("scope"), season.alias("scope_season"))

    pooled = F.lit("")
    scopes = [scope("season", F.col("season")), scope("all", pooled)]
    every = F.when(F.col("post_cutoff"), F.array(*scopes, scope("post", pooled))).otherwise(F.array(*scopes))
    pairs = _pairs(rows, ["signal", "season", "post_cutoff"], "value", target)
    scoped = pairs.select("signal", "x_value", "y_value", "pair_n", F.inline(every))
    return (_rank_moments(scoped, ["signal", "scope", "scope_season"], slices)
            .withColumnRenamed("scope_season", "season"))


def season_ics(scoped: DataFrame, min_n: int = 10) -> DataFrame:
    """The seasons of :func:`scoped_spearman` as information coefficients; see :func:`ic_by_season`."""
    return (scoped.filter((F.col("scope") == "season") & (F.col("n") >= min_n) & F.col("x_varies"))
            .select("signal", "season", "n", F.col("rho").alias("ic")))


def pooled_ics(scoped: DataFrame) -> DataFrame:
    """One row per signal from the pooled scopes: all documents, and those after the cutoff if more than ten."""
    def pick(scope_name: str, column: Column) -> Column:
        return F.max(F.when(F.col("scope") == scope_name, column))

    return scoped.filter(F.col("scope") != "season").groupBy("signal").agg(
        pick("all", F.col("n")).alias("n_events"),
        pick("all", F.col("rho")).alias("pooled_ic"),
        F.coalesce(pick("post", F.col("n")), F.lit(0)).alias("post_cutoff_n"),
        pick("post", F.when(F.col("n") > 10, F.col("rho"))).alias("post_cutoff_pooled_ic"))


def pooled_ic(rows: DataFrame, target: str, *, slices: int | None = None) -> DataFrame:
    """Spearman correlation over all documents, and over those after the cutoff if more than ten.

    ``rows`` carry ``post_cutoff``.
    """
    scope = F.explode(F.when(F.col("post_cutoff"), F.array(F.lit("all"), F.lit("post")))
                      .otherwise(F.array(F.lit("all"))))
    scoped = rows.filter(F.col(target).isNotNull()).select("signal", "value", target, scope.alias("scope"))
    return pooled_ics(spearman(scoped, ["signal", "scope"], "value", target, slices=slices))


def quantile_in_season(rows: DataFrame, q: int = 5, *, slices: int | None = None) -> DataFrame:
    """Add ``quantile`` 1..q of each document inside (signal, season), for evaluation only.

    Ties are ordered by publication time, ticker and id.
    """
    order = ["value", "published_at", "ticker", "event_id"]
    placed = positions(rows, ["signal", "season"], order, slices)
    bucket = F.ceil(F.col("position") / F.col("total") * q)
    return (placed.withColumn("quantile", F.greatest(F.least(bucket, F.lit(q)), F.lit(1)).cast("int"))
            .drop("position", "total"))


def extreme_quantiles(rows: DataFrame, q: int = 5, *, slices: int | None = None) -> DataFrame:
    """The rows of :func:`quantile_in_season` in the first and the last quantile.

    Only counted scores are sorted: they tell the quantiles of a score's first and last document. Two scores per
    (signal, season) can lie across the edge of an outer quantile; the documents of these alone are put in order.
    """
    keys = ["signal", "season"]

    def bucket(position: Column) -> Column:
        return F.greatest(F.least(F.ceil(position / F.col("total") * q), F.lit(q)), F.lit(1)).cast("int")

    counts = rows.groupBy(*keys, "value").agg(F.count("*").alias("ties"))
    first, last = bucket(F.col("below") + 1), bucket(F.col("below") + F.col("ties"))
    # one row per signal and season
    edges = running_counts(counts, keys, "value", "ties", slices).withColumn("first", first).withColumn("last", last).groupBy(*keys).agg(
        F.max("total").alias("total"), F.max(F.when(F.col("last") == 1, F.col("value"))).alias("low"), F.min(F.when(F.col("first") == q, F.col("value"))).alias("high"),
        F.collect_list(F.when((F.col("first") != F.col("last")) & ((F.col("first") == 1) | (F.col("last") == q)), F.struct("value", "below"))).alias("split"))
    placed = rows.join(F.broadcast(edges), keys).withColumn("cut", F.get(F.filter("split", lambda s: s["value"] == F.col("value")), F.lit(0))).drop("split")
    whole = F.when(F.col("value") <= F.col("low"), 1).when(F.col("value") >= F.col("high"), q)
    sure = placed.filter(F.col("cut").isNull()).withColumn("quantile", whole.cast("int")).filter(F.col("quantile").isNotNull())
    tied = positions(placed.filter(F.col("cut").isNotNull()).withColumnRenamed("total", "documents"), [*keys, "value"], ["published_at", "ticker", "event_id"], slices)
    tied = (tied.drop("total").withColumnRenamed("documents", "total").withColumn("quantile", bucket(F.col("cut.below") + F.col("position")))
            .filter(F.col("quantile").isin(1, q)))
    return sure.select(*rows.columns, "quantile").unionByName(tied.select(*rows.columns, "quantile"))


def hit_rate(quantiled: DataFrame, target: str, q: int = 5) -> DataFrame:
    """Share of extreme-quantile documents whose return had the predicted sign, per signal."""
    top, bottom = F.col("quantile") == q, F.col("quantile") == 1
    sums = quantiled.filter(top | bottom).groupBy("signal").agg(
        F.count_if((top & (F.col(target) > 0)) | (bottom & (F.col(target) < 0))).alias("hits"),
        (F.count_if(top) + F.count_if(bottom)).alias("hit_n"),
        F.avg(F.when(top, F.col(target))).alias("top_q_car"),
        F.avg(F.when(bottom, F.col(target))).alias("bottom_q_car"))
    return sums.select("signal", F.try_divide("hits", F.col("hit_n")).alias("hit_rate"), "hit_n",
                       "top_q_car", "bottom_q_car")
