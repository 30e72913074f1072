"""Expanding-history mid-rank: where a score stood among all strictly earlier ones.

Counting earlier smaller values is a two-sided inequality. Instead of joining on it, the scores are
collapsed to (signal, day, value) with counts and written once in range partitions of (signal, value).
Inside a partition a scan goes up the values and keeps one number per day, the scores filed so far on it;
what lies on earlier days is their running sum. A day-by-partition grid adds the counts of all lower
partitions. Each score is so shuffled twice, once to be counted and once to be sorted, and the memory of a
task is a batch and the calendar.

A kept index holds the counted scores by spans of days; a question reads the spans up to its last day.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.operators.ordering import PART, ranged, with_columns

# Layout of a kept index: it serves this many trading days, in folders of so many.
INDEX_DAYS, SPAN_DAYS = 2 ** 13, 64
# Rows that a scan compares with one another at once.
_BLOCK = 256
_BEFORE = np.tri(_BLOCK, k=-1, dtype=bool)


def _ties(values: np.ndarray, n: np.ndarray, last: float | None, carried: int) -> np.ndarray:
    """The counts before each row among the rows of its value; ``carried`` of them lie before the first row if ``last`` is its value."""
    def differ(a, b):
        return (a != b) & ~(np.isnan(a) & np.isnan(b))

    before, new = np.cumsum(n) - n, np.ones(len(n), dtype=bool)
    new[1:] = differ(values[1:], values[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
    goes_on = last is not None and not differ(values[0], last)
    return before - before[first] + np.where(first == 0, carried if goes_on else 0, 0)


def _earlier_in_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to rows sorted by (signal, value, t0_pos) ``earlier``, the scores on earlier days of the signal's rows before, and ``same``, those of them with an equal value."""
    filed, signal, last, carried = np.zeros(1, dtype=np.int64), None, None, 0
    for batch in batches:
        names = batch.column("signal").dictionary_encode()
        code, days, values, n = names.indices.to_numpy(), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("t0_pos", "value", "n"))
        earlier, same = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        edges = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1), len(n)] if len(n) else []
        for start, end in zip(edges, edges[1:]):
            if (name := names.dictionary[int(code[start])].as_py()) != signal:
                filed, signal, last, carried = np.zeros(1, dtype=np.int64), name, None, 0
            same[start:end] = _ties(values[start:end], n[start:end], last, carried)
            last, carried = values[end - 1], int(same[end - 1] + n[end - 1])
            if (top := int(days[start:end].max()) + 1) > len(filed):
                filed = np.concatenate([filed, np.zeros(top - len(filed), dtype=np.int64)])
            for at in range(start, end, _BLOCK):
                rows = slice(at, min(at + _BLOCK, end))
                d, w = days[rows], n[rows]
                among = (d[None, :] < d[:, None]) & _BEFORE[:len(d), :len(d)]
                earlier[rows] = (np.cumsum(filed) - filed)[d] + (among @ w.astype(np.float64)).astype(np.int64)
                np.add.at(filed, d, w)
        yield with_columns(batch, earlier=earlier, same=same)


def _history_around(parts: DataFrame) -> DataFrame:
    """For each (signal, range, day): ``lower``, earlier scores in all lower ranges, and ``n_prior``, those in all ranges."""
    totals = parts.groupBy("signal", PART, "t0_pos").agg(F.sum("n").alias("n"))
    span = totals.groupBy("signal").agg(F.collect_set(PART).alias("ranges"), F.collect_set("t0_pos").alias("days"))
    grid = (span.select("signal", F.explode("ranges").alias(PART), "days")
            .select("signal", PART, F.explode("days").alias("t0_pos")))
    earlier = (Window.partitionBy("signal", PART).orderBy("t0_pos")
               .rowsBetween(Window.unboundedPreceding, -1))
    day = Window.partitionBy("signal", "t0_pos")
    lower = day.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return (grid.join(totals, ["signal", PART, "t0_pos"], "left")
            .withColumn("earlier_n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .select("signal", PART, "t0_pos", F.coalesce(F.sum("earlier_n").over(lower), F.lit(0)).alias("lower"),
                    F.sum("earlier_n").over(day).alias("n_prior")))


def _midranks(cells: DataFrame, slices: int | None) -> DataFrame:
    """``cells``, counted scores, with ``n_prior`` and ``hist_pct``."""
    parts = ranged(cells.filter("signal IS NOT NULL AND t0_pos IS NOT NULL"), ["signal"], ["value"], slices, then=["t0_pos"],
                   scan=_earlier_in_slice, adds="earlier long, same long")
    # the rows before a row hold its earlier equals beside the earlier smaller ones
    rank = F.col("earlier") + F.col("lower") - F.lit(0.5) * F.col("same")
    return (parts.join(_history_around(parts), ["signal", PART, "t0_pos"])
            .withColumn("hist_pct", F.when(F.col("n_prior") > 0, rank / F.col("n_prior"))))


def historical_midrank(rows: DataFrame, slices: int | None = None) -> DataFrame:
    """``(signal, t0_pos, value, n_prior, hist_pct)`` for every distinct score of a day.

    ``hist_pct`` is (earlier smaller + half of earlier equal) / earlier, null without history.
    """
    return _midranks(collapsed(rows), slices).select("signal", "t0_pos", "value", "n_prior", "hist_pct")


def collapsed(rows: DataFrame) -> DataFrame:
    """``(signal, t0_pos, value, n)``: the scores of each day with counts."""
    return rows.groupBy("signal", "t0_pos", "value").agg(F.count("*").alias("n"))


def append_history(cells: DataFrame, path: str) -> None:
    """File the counted scores of new days in the index at ``path``, in folders by span of days.

    What was filed before is not touched; a day must be filed once and whole.
    """
    fits = F.when(F.col("t0_pos") < INDEX_DAYS, F.col("t0_pos")).otherwise(F.raise_error(F.lit("the index has no more days")).cast("int"))
    filed = cells.withColumn("t0_pos", fits).withColumn("span", F.floor(F.col("t0_pos") / SPAN_DAYS).cast("int"))
    filed.select("signal", "t0_pos", F.col("value").cast("double").alias("value"), "n", "span").write.mode("append").partitionBy("span").parquet(path)


def midrank_from_index(spark: SparkSession, path: str, cells: DataFrame, slices: int | None = None) -> DataFrame:
    """:func:`historical_midrank` of ``cells`` from the index, in which all earlier days are filed.

    Of the index only the spans of days before the last asked one are read, and days filed later change no
    answer. The scores found are counted with the asked ones as a whole history is.
    """
    index = spark.read.schema("signal string, t0_pos int, value double, n long, span int").parquet(path)
    last = cells.agg(F.max("t0_pos").alias("last"))
    kept = index.filter((F.col("span") <= last.select(F.floor(F.col("last") / SPAN_DAYS).cast("int")).scalar()) & (F.col("t0_pos") < last.scalar()))
    asks = cells.select("signal", "t0_pos", F.col("value").cast("double").alias("value"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    every = (kept.select("signal", "t0_pos", "value", "n", F.lit(False).alias("asked")).unionByName(asks)
             .groupBy("signal", "t0_pos", "value").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")))
    return _midranks(every, slices).filter("asked").select("signal", "t0_pos", "value", "n_prior", "hist_pct")
