"""The answer ledger: every answer ever given, append-only, in folders by rater and key bucket.

A reader names its model, prompt version and repetition, and opens no other rater's folders. Keys are
dealt over a fixed number of buckets; a question about some keys is first joined to the buckets they lie in,
which prunes the other folders when the plan runs.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("key string, event_id string, model string, prompt_version string, rep int, guidance_tone int, "
          "margins_tone int, demand_tone int, overall_tone int, guidance_mentioned boolean, margins_mentioned boolean, "
          "demand_mentioned boolean, reason string, reason_truncated boolean, model_id string, error string, "
          "ingested_at timestamp")
COLUMNS = tuple(f.strip().split(" ")[0] for f in SCHEMA.split(","))
RATER = ("model", "prompt_version", "rep")
# Part of the stored layout: a ledger is read with the number it was written with.
BUCKET, BUCKETS = "bucket", 64


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def append_answers(answers: DataFrame, path: str) -> None:
    """Add answers, each task's file as soon as the task is done.

    With this commit algorithm a finished task moves its files into the table by itself, so a run that
    dies or is cancelled later leaves them there. A task that runs twice can leave answers twice;
    readers take the last good one per key.
    """
    (answers.withColumn(BUCKET, bucket_of(F.col("key"))).write.mode("append")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*RATER, BUCKET).parquet(path))


def read_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger with its ``bucket``, or None before the first run; a folder without a finished file is empty."""
    try:
        stored = spark.read.schema(f"{SCHEMA}, {BUCKET} int").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return stored.select(*COLUMNS, BUCKET)


def answers_of(spark: SparkSession, path: str, model: str, prompt_version: str, rep: int = 1) -> DataFrame | None:
    """One rater's answers; no other rater's folders are opened."""
    stored = read_answers(spark, path)
    return stored and stored.filter((F.col("model") == model) & (F.col("prompt_version") == prompt_version) & (F.col("rep") == rep))


def answered_keys(ledger: DataFrame, keyed: DataFrame) -> DataFrame:
    """The keys with a good answer, read only from the buckets that the keys of ``keyed`` lie in."""
    # at most BUCKETS rows; the comparison, always true, tells the optimizer that pruning by them can pay
    asked = keyed.select(bucket_of(F.col("key")).alias(BUCKET)).distinct().filter(F.col(BUCKET) >= 0)
    return ledger.filter(F.col("error").isNull()).join(F.broadcast(asked), BUCKET, "left_semi").select("key")
