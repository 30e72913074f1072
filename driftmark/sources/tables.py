"""Readers for the stored tables."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.sources import schemas


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.UNIVERSE).csv(path, header=True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events from CSV; a time that cannot be read is null, and ``unread_time`` then holds its text."""
    raw = spark.read.schema(schemas.EVENTS.replace("published_at TIMESTAMP_NTZ", "published_at STRING")).csv(path, header=True)
    text, time = F.col("published_at"), F.col("published_at").try_cast("timestamp_ntz")
    return raw.withColumn("unread_time", F.when(time.isNull() & (F.trim(text) != ""), text)).withColumn("published_at", time)


def time_report(events: DataFrame) -> DataFrame:
    """One row per source: events, those without a time, those whose time cannot be read, and one such text."""
    return events.groupBy("source").agg(
        F.count("*").alias("events"), F.count_if(F.col("published_at").isNull() & F.col("unread_time").isNull()).alias("without_time"),
        F.count("unread_time").alias("unreadable"), F.min("unread_time").alias("example"))


def in_window(events: DataFrame, start: str, end: str, analysis_start: str | None = None) -> DataFrame:
    """Documents published from the start day up to and including the end day."""
    first = F.lit(analysis_start or start).cast("timestamp_ntz")
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return events.filter((F.col("published_at") >= first) & (F.col("published_at") < after))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Long prices ``(ticker, date, close)``; a wide matrix (one column per ticker) is unpivoted."""
    stored = spark.read.parquet(path)
    if {"ticker", "close"} <= set(stored.columns):
        return stored.select("ticker", F.to_date("date").alias("date"), F.col("close").cast("double").alias("close"))
    index = next(c for c in stored.columns if c.lower() in ("date", "__index_level_0__"))
    tickers = [c for c in stored.columns if c != index]
    wide = stored.select(F.to_date(F.col(f"`{index}`")).alias("date"),
                         *[F.col(f"`{t}`").cast("double").alias(t) for t in tickers])
    long = wide.unpivot("date", [F.col(f"`{t}`") for t in tickers], "ticker", "close")
    return long.select("ticker", "date", F.nanvl("close", F.lit(None).cast("double")).alias("close"))


def assemble_prices(*series: DataFrame) -> DataFrame:
    """One price panel from several long frames ``(ticker, date, close)``.

    Times of day go, share classes get their dot back, tickers without any close are left out.
    The first frame that has a close for a day wins.
    """
    dated = [s.select(F.translate("ticker", "-", ".").alias("ticker"), F.to_date("date").alias("date"),
                      F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double")).alias("close"),
                      F.lit(i).alias("source_no")) for i, s in enumerate(series)]
    union = dated[0]
    for s in dated[1:]:
        union = union.unionByName(s)
    rank = F.when(F.col("close").isNotNull(), F.col("source_no"))
    one = union.groupBy("ticker", "date").agg(F.min_by("close", rank).alias("close"))
    known = one.filter(F.col("close").isNotNull()).select("ticker").distinct()
    return one.join(known, "ticker", "left_semi")


def panel_tickers(universe: DataFrame, market_ticker: str) -> DataFrame:
    """Every ticker the price panel needs: companies, sector funds and the market."""
    named = universe.select(F.explode(F.array("ticker", "sector_etf", F.lit(market_ticker))).alias("ticker"))
    return named.filter(F.col("ticker").isNotNull()).distinct()


def missing_tickers(wanted: DataFrame, prices: DataFrame) -> DataFrame:
    """Wanted tickers still without any close."""
    priced = prices.filter(F.col("close").isNotNull()).select("ticker").distinct()
    return wanted.select("ticker").distinct().join(priced, "ticker", "left_anti")


def read_factors(spark: SparkSession, path: str) -> DataFrame | None:
    """The factor table, or None when there is none."""
    try:
        return spark.read.csv(path, header=True, schema=schemas.FACTORS, enforceSchema=False)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_answer_lines(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON lines: half-written lines are skipped, the last record per key wins.

    Line order is file time, file, place in the file.
    """
    lines = (spark.read.schema(schemas.ANSWERS + ", broken STRING")
             .option("columnNameOfCorruptRecord", "broken").json(path)
             .select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path",
                                   "_metadata.file_block_start",
                                   F.monotonically_increasing_id().alias("line")).alias("place")))
    columns = [c for c in lines.columns if c not in ("key", "broken", "place")]
    return (lines.filter(F.col("broken").isNull() & F.col("key").isNotNull())
            .groupBy("key").agg(F.max_by(F.struct(*columns), "place").alias("last"))
            .select("key", "last.*"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Sentiment dictionary ``(word, positive, negative)``; a class holds where its flag is not 0."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.upper("Word").alias("word"),
                      (F.col("Positive").cast("double") != 0).alias("positive"),
                      (F.col("Negative").cast("double") != 0).alias("negative"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LABELS).csv(path, header=True)
