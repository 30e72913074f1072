"""Result tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.sources.tables import read_labels


def wide_daily(series: DataFrame, names: Sequence[str], market: DataFrame | None = None,
               market_name: str = "market") -> DataFrame:
    """One row per date with one column per series, aligned on all dates, and the market beside them.

    ``series``: (series, date, ret).
    """
    wide = series.groupBy("date").pivot("series", list(names)).agg(F.first("ret"))
    if market is None:
        return wide
    return wide.join(F.broadcast(market.select("date", F.col("market").alias(market_name))), "date", "left")


def ic_table(ics: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Seasons down, signals across."""
    return ics.groupBy("season").pivot("signal", list(signals)).agg(F.first("ic"))


def holdings_export(holdings: DataFrame) -> DataFrame:
    """Holdings with names joined by blanks, as flat files want them."""
    return (holdings.withColumn("longs", F.array_join("longs", " "))
            .withColumn("shorts", F.array_join("shorts", " ")))


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Write each table under ``folder``; csv gets a header."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            writer.option("header", True).csv(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")


def write_review(texts: DataFrame, key: DataFrame, sheet: DataFrame, folder: str) -> None:
    """Blind sample under ``folder``: texts, an empty label sheet, and the key kept apart.

    A sheet that already holds scores is never overwritten.
    """
    try:
        filled = read_labels(sheet.sparkSession, f"{folder}/labels").filter(F.trim("guidance_tone") != "").limit(1).count()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        filled = 0
    if filled:
        raise ValueError(f"the label sheet in {folder} is partly filled in and stays as it is")
    texts.write.mode("overwrite").parquet(f"{folder}/texts")
    key.write.mode("overwrite").parquet(f"{folder}/key")
    sheet.write.mode("overwrite").option("header", True).csv(f"{folder}/labels")
