"""Daily factor files: banner, header line, numeric rows, footer.

Each file is one row; its lines are worked on inside the row, so many files are many tasks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_factor_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, raw)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"),
                                                        F.col("value").alias("raw"))


def _first(lines: Column, test, start: Column) -> Column:
    """1-based place of the first line after ``start`` that passes ``test``; past the end if none does."""
    tested = F.transform(lines, lambda line, i: F.when((i + 1 > start) & test(line), i + 1))
    return F.coalesce(F.array_min(F.array_compact(tested)), F.size(lines) + 1)


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda cell: F.trim(cell))


def parse_factor_files(files: DataFrame) -> DataFrame:
    """``(file, date, factor, value)`` with percent turned into decimals.

    The header is the first line that starts with a comma and holds a letter. Rows end at the
    first line that is blank or does not start with a digit.
    """
    lines = files.select("file", F.split("raw", "\r?\n").alias("lines"))
    header = _first(F.col("lines"), lambda x: F.trim(x).startswith(",") & x.rlike("[A-Za-z]"), F.lit(0))
    marked = lines.withColumn("header", header).filter(F.col("header") <= F.size("lines"))
    stop = _first(F.col("lines"), lambda x: ~F.trim(x).rlike("^[0-9]"), F.col("header"))
    body = (marked.withColumn("stop", stop)
            .select("file", _cells(F.element_at("lines", F.col("header"))).alias("names"),
                    F.explode(F.slice("lines", F.col("header") + 1, F.col("stop") - F.col("header") - 1)).alias("row"))
            .withColumn("cells", _cells(F.col("row"))))
    pairs = F.arrays_zip(F.slice("names", 2, F.size("names") - 1).alias("factor"),
                         F.slice("cells", 2, F.size("names") - 1).alias("cell"))
    return (body.select("file", F.to_date(F.element_at("cells", 1), "yyyyMMdd").alias("date"), F.inline(pairs))
            .select("file", "date", "factor", (F.col("cell").cast("double") / 100).alias("value")))


def factor_table(parsed: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Wide table ``(date, factor…)`` of the named factors."""
    return parsed.groupBy("date").pivot("factor", list(factors)).agg(F.first("value"))


def join_factors(main: DataFrame, momentum: DataFrame) -> DataFrame:
    """Both factor sets on their common dates."""
    return main.join(momentum, "date")
