"""Where intermediate tables live: the folder the cluster names in ``spark.checkpoint.dir``.

Tables lie in the application's folder, which ``driftmark.session.discard_tables`` removes; the files of
``checkpoint()`` are left to Spark's own cleaner.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftmark import session


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; only where none is named, one below the warehouse."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and continue from the files."""
    shared_folder(df.sparkSession)
    path = f"{session.shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
