"""Session helpers: where written tables live, and lineage cuts."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; without one, a folder of the warehouse.

    Both are seen by every executor; no machine's own temporary folder is used. Tables of one
    application lie in a folder of their own, which :func:`discard_tables` removes.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tables"
    return f"{folder.rstrip('/')}/driftmark-{spark.sparkContext.applicationId}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write a calendar-sized ``df`` to the shared folder and continue from the written table.

    Parquet keeps column pruning and size statistics for the plans that follow. Document-sized frames
    stay lazy.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*work: Callable[[], T]) -> list[T]:
    """The results of independent pieces of work that run jobs of their own, side by side.

    A job with few tasks leaves most of a cluster idle; the next one need not wait for it.
    """
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        return [done.result() for done in [pool.submit(inheritable_thread_target(w)) for w in work]]


def discard_tables(spark: SparkSession) -> None:
    """Delete what this application wrote; frames that read it end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
