"""Agreement between raters on the ordinal scale -2..2, and its bootstrap.

Two ratings of one document take at most 25 combinations, so every comparison starts from counts
per combination.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.answers import LEVELS
from driftmark.operators.ranks import spearman

# Least number of labelled documents, resamples, interval ends.
MIN_LABELS = 10
RESAMPLES = 2000
INTERVAL = (0.05, 0.95)


def weighted_kappa(a: Column, b: Column, n: Column) -> Column:
    """Quadratic-weighted kappa as an aggregate over counted pairs; null without expected disagreement."""
    gap = F.sum(n * (a - b) * (a - b))
    expected = F.sum(n * a * a) + F.sum(n * b * b) - 2 * F.sum(n * a) * F.sum(n * b) / F.sum(n)
    return F.when(expected > 0, 1 - gap / expected)


def agreement(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """``(keys…, n, exact, within_one, spearman, kappa)``; needs at least one key."""
    rated = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = rated.groupBy(*keys, a, b).agg(F.count("*").alias("n"))
    x, y, n = F.col(a).cast("double"), F.col(b).cast("double"), F.col("n")
    shares = pairs.groupBy(*keys).agg(
        F.sum(n).alias("rated"),
        (F.sum(F.when(x == y, n).otherwise(0)) / F.sum(n)).alias("exact"),
        (F.sum(F.when(F.abs(x - y) <= 1, n).otherwise(0)) / F.sum(n)).alias("within_one"),
        weighted_kappa(x, y, n).alias("kappa"))
    ranks = spearman(rated, keys, a, b).select(*keys, F.col("rho").alias("spearman"))
    return (shares.join(ranks, list(keys))
            .select(*keys, F.col("rated").alias("n"), "exact", "within_one", "spearman", "kappa"))


def three_way(ratings: DataFrame, human: str = "human", main: str = "main", other: str = "other") -> DataFrame:
    """Agreement of main and human, other and human, main and other: one row per ``comparison``."""
    def pair(name: str, a: str, b: str) -> Column:
        return F.struct(F.lit(name).alias("comparison"), F.col(a).alias("rating_a"), F.col(b).alias("rating_b"))

    rated = ratings.filter(F.col(main).isNotNull() & F.col(other).isNotNull())
    long = rated.select(F.inline(F.array(pair("main", human, main), pair("other", human, other),
                                         pair("raters", main, other))))
    return agreement(long, ["comparison"], "rating_a", "rating_b")


def consistency(first: DataFrame, second: DataFrame,
                dimensions: Sequence[str] = ("guidance_tone", "overall_tone", "margins_tone", "demand_tone")) -> DataFrame:
    """Agreement of two passes over the same documents, one row per dimension."""
    def long(df: DataFrame, out: str) -> DataFrame:
        return (df.select("event_id", *[F.col(d).cast("int").alias(d) for d in dimensions])
                .unpivot("event_id", list(dimensions), "dimension", out))

    both = long(first, "pass_1").join(long(second, "pass_2"), ["event_id", "dimension"])
    return agreement(both, ["dimension"], "pass_1", "pass_2")


def rater_comparison(main: DataFrame, other: DataFrame, window: DataFrame, score: str = "tone",
                     guidance: str = "guidance_tone", slices: int | None = None) -> DataFrame:
    """Two raters on the documents of ``window``: n, rank correlation, same and within one.

    Fewer than ten common documents give no row.
    """
    a = main.select("event_id", F.col(score).alias("score_a"), F.col(guidance).alias("guidance_a"))
    b = other.select("event_id", F.col(score).alias("score_b"), F.col(guidance).alias("guidance_b"))
    both = (a.join(b, "event_id").join(window.select("event_id"), "event_id", "left_semi")
            .withColumn("sample", F.lit("all")))
    gap = F.abs(F.col("guidance_a") - F.col("guidance_b"))
    shares = both.groupBy("sample").agg(
        F.count("*").alias("n"), F.avg((gap == 0).cast("double")).alias("same_guidance"),
        F.avg((gap <= 1).cast("double")).alias("within_one"))
    ranks = (spearman(both, ["sample"], "score_a", "score_b", slices=slices)
             .select("sample", F.col("rho").alias("rank_corr")))
    return (shares.join(ranks, "sample").filter(F.col("n") >= 10)
            .select("n", "rank_corr", "same_guidance", "within_one"))


def human_labels(sheet: DataFrame, label: str = "guidance_tone") -> DataFrame:
    """Filled rows of a label sheet with ``human`` as a whole number; refuses thin or odd sheets."""
    score = F.col(label).cast("string").try_cast("double")
    filled = sheet.withColumn("human_score", score).filter(F.col("human_score").isNotNull())
    check = filled.agg(F.count("*").alias("n"),
                       F.count_if(~F.col("human_score").cast("int").isin(*LEVELS)).alias("odd")).first()
    if check["n"] < MIN_LABELS:
        raise ValueError(f"{MIN_LABELS} rated documents are the least, the sheet has {check['n']}")
    if check["odd"]:
        raise ValueError(f"the sheet has values of {label} beside {LEVELS}")
    return filled.withColumn("human", F.col("human_score").cast("int")).drop("human_score")


def label_chain(sheet: DataFrame, key: DataFrame, main: DataFrame, other: DataFrame, label: str = "guidance_tone") -> DataFrame:
    """``(event_id, human, main, other)`` from four tables: the filled sheet by number, the key from number to
    event, and the scored events of both raters.

    Rows that any of the tables lacks, or whose rating is missing, drop out; a rating loses its fraction.
    """
    def ratings(table: DataFrame, name: str) -> DataFrame:
        return table.select("event_id", F.col(label).cast("int").alias(name)).filter(F.col(name).isNotNull())

    return (human_labels(sheet, label).select("number", "human").join(key.select("number", "event_id"), "number")
            .join(ratings(main, "main"), "event_id").join(ratings(other, "other"), "event_id").drop("number"))


def bootstrap_kappa_difference(ratings: DataFrame, human: str = "human", main: str = "main", other: str = "other",
                               resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Kappa of both raters with the human, their difference and its 90% bootstrap interval.

    A draw is 60 bits of md5(seed, replicate, draw) modulo n, so a replicate can be repeated anywhere.
    Ratings are first counted per (human, main, other), at most 125 combinations, whose running counts
    become literals: a draw finds its combination by itself, and draws are counted where they are made.
    """
    filled = ratings.select(*[F.col(c).cast("int").alias(a) for c, a in
                              ((human, "h"), (main, "m"), (other, "o"))]).dropna()
    cells = sorted(filled.groupBy("h", "m", "o").agg(F.count("*").alias("n")).collect())
    spark, rows = ratings.sparkSession, sum(c.n for c in cells)
    kinds = "h int, m int, o int"
    named = spark.createDataFrame([(i, *c[:3], c.n) for i, c in enumerate(cells)], f"cell int, {kinds}, n bigint")
    upper = [int(u) for u in np.cumsum([c.n for c in cells])] or [0]
    draws = spark.range(resamples * rows).select(F.expr(f"id div {max(rows, 1)} + 1").alias("rep"), (F.col("id") % max(rows, 1) + 1).alias("draw"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string")))
    place = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % max(rows, 1)
    # at most 125 comparisons, compiled with the rest of the row
    # (never null, or the join would test the whole draw for it a second time)
    cell = F.coalesce(sum(((F.col("place") >= u).cast("int") for u in upper), F.lit(0)), F.lit(-1))
    drawn = (draws.select("rep", place.alias("place")).groupBy("rep", cell.cast("int").alias("cell"))
             .agg(F.count("*").alias("n")).join(F.broadcast(named.drop("n")), "cell").select("rep", "h", "m", "o", "n"))
    # the full data joins as replicate 0
    everything = named.select(F.lit(0).cast("long").alias("rep"), "h", "m", "o", "n").unionByName(drawn)
    kappas = everything.groupBy("rep").agg(
        F.sum("n").alias("n"),
        weighted_kappa(F.col("h").cast("double"), F.col("m").cast("double"), F.col("n")).alias("kappa_main"),
        weighted_kappa(F.col("h").cast("double"), F.col("o").cast("double"), F.col("n")).alias("kappa_other"))
    difference = F.col("kappa_main") - F.col("kappa_other")
    full, sampled = F.col("rep") == 0, F.when(F.col("rep") > 0, difference)
    return (kappas.agg(
        F.max(F.when(full, F.col("n"))).alias("n"),
        F.max(F.when(full, F.col("kappa_main"))).alias("kappa_main"),
        F.max(F.when(full, F.col("kappa_other"))).alias("kappa_other"),
        F.max(F.when(full, difference)).alias("kappa_difference"),
        F.percentile(sampled, F.array(*[F.lit(p) for p in INTERVAL])).alias("interval"),
        F.count(sampled).alias("replicates"))
        .select("n", "kappa_main", "kappa_other", "kappa_difference",
                F.col("interval")[0].alias("low"), F.col("interval")[1].alias("high"), "replicates"))


def reading_verdict(comparison: DataFrame) -> DataFrame:
    """Add ``verdict`` to the bootstrap row."""
    verdict = (F.when(F.col("low") > 0, "main agrees more")
               .when(F.col("high") < 0, "other agrees more")
               .when(F.abs("kappa_difference") < 0.1, "about equal")
               .when(F.col("kappa_difference") > 0, "inconclusive, leans main")
               .otherwise("inconclusive, leans other"))
    return comparison.withColumn("verdict", verdict)
