"""The corpus pipeline: raw documents to token ids, one written table per stage.

In every stage repeated rows and null ids are judged by their own text, extra columns stay under any
name, long texts are read whole and an empty table gives an empty one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import decontaminate, line_templates, pieces, quality, simhash
from driftmark.llm.storage import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts have no words and go."""
    return quality.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; ``n_chars`` follows the text, and what is left empty goes. Null texts stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    cut = line_templates.drop_recurring_lines(docs).toDF(*names, "n_lines", "n_dropped").filter(f"n_dropped = 0 or trim({text}) <> ''")
    return cut.select(*[(F.length(text).cast("bigint") if c == "n_chars" else F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by SimHash (four words, at most 4 of 64 bits), the one with the smallest id.

    Null and empty texts have fingerprint zero and form one group; a null id comes last.
    """
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left; null and empty texts have none."""
    return pieces.encode(docs)


STAGES = [("quality rules", good_documents), ("line dedup", without_boilerplate), ("SimHash near-dedup", first_of_group),
          ("decontamination", without_benchmark), ("encoding", token_ids)]
#: No SQL: tokenization, fingerprints and the piece search cannot be expressed; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in ``sf_dir``; every table but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
