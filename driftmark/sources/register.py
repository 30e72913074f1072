"""The event register: local manifests, upserts, and the stored register by month of publication."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.session import checkpointed
from driftmark.sources.schemas import EVENT_COLUMNS, EVENTS, MANIFEST

MONTH, UNDATED = "month", "undated"
# Files that one task of a manifest opens, and characters of text it sends on at a time.
MANIFEST_FILES, READ_CHARS = 256, 16 << 20


def manifest_events(manifest: DataFrame) -> DataFrame:
    """Manifest rows as events; the id is ``{ticker}_call_{yyyyMMddHHmm}``."""
    missing = sorted(set(MANIFEST) - set(manifest.columns))
    if missing:
        raise ValueError(f"a manifest needs the columns {', '.join(missing)} as well")
    published = F.col("published_at").cast("timestamp_ntz")
    return manifest.select(
        F.concat("ticker", F.lit("_call_"), F.date_format(published, "yyyyMMddHHmm")).alias("event_id"), "ticker",
        published.alias("published_at"), F.lit("local_transcript").alias("source"),
        F.lit("transcript").alias("form"), F.lit("").alias("url"), "path")


def _opened(file: str) -> tuple[fs.FileSystem, str]:
    file = re.sub("^file:/+", "/", file)
    return fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)


def write_texts(texts: DataFrame, folder: str) -> DataFrame:
    """Write each row's ``text`` to its ``path`` below ``folder``, in the tasks that hold the rows; ``(path, bytes)`` comes back.

    A path is written whole or, when its task fails, again. Lazy: nothing is written before the result is read.
    """
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for path, text in zip(batch["path"], batch["text"]):
                store, name = _opened(f"{folder}/{path}")
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                data = (text or "").encode()
                with store.open_output_stream(name) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    return texts.select("path", "text").mapInPandas(write, "path string, bytes bigint")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Events with their texts; relative paths count from the manifest's folder. A row whose file is missing
    fails the read and is named.

    The manifest is the list of files: its rows, paths without texts, are dealt over tasks of about
    ``MANIFEST_FILES``, and each task opens the files of its rows. No folder is listed, no other file is
    opened and no text is shuffled. The store must be one that pyarrow knows (a shared disk, HDFS, S3, GCS).
    """
    folder = re.sub("^file:/+", "/", path.rsplit("/", 1)[0])
    events = manifest_events(spark.read.csv(path, header=True))
    place = F.regexp_replace("path", "^file:/+", "/")
    file = F.when(place.startswith("/") | place.contains("://"), place).otherwise(F.concat(F.lit(folder + "/"), place))
    located = events.withColumn("file", file)
    tasks = max(1, -(-located.count() // MANIFEST_FILES))
    columns = located.columns[:-1]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, size, texts = 0, 0, []
            for n, (event, name) in enumerate(zip(batch["event_id"], batch["file"]), 1):
                try:
                    store, place = _opened(name)
                    with store.open_input_stream(place) as source:
                        texts.append(source.read().decode("utf-8", "replace"))
                except Exception as failure:
                    raise FileNotFoundError(f"no text for manifest row {event}: {name}") from failure
                size += len(texts[-1])
                # texts of any length leave in pieces of bounded size
                if size >= READ_CHARS or n == len(batch):
                    yield batch.iloc[at:n][columns].assign(text=texts)
                    at, size, texts = n, 0, []

    schema = T.StructType([*located.schema.fields[:-1], T.StructField("text", T.StringType())])
    return located.repartition(tasks, "file").mapInPandas(read, schema)


def upsert_events(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Union in which the existing row of an id wins, then the new one that sorts first by its columns.

    Copies of one id combine on the map side, so a much-repeated id costs one row per task.
    """
    columns = [c for c in EVENT_COLUMNS if c in new.columns] + [c for c in new.columns if c not in EVENT_COLUMNS]
    union = new.select(F.lit(1).alias("arrival"), *columns)
    if existing is not None:
        union = union.unionByName(existing.select(F.lit(0).alias("arrival"), *columns))
    rest = [c for c in columns if c != "event_id"]
    first = F.min_by(F.struct(*rest), F.struct("arrival", *rest))
    return union.groupBy("event_id").agg(first.alias("row")).select("event_id", "row.*").select(*columns)


def with_month(events: DataFrame) -> DataFrame:
    """Add the partition of the stored register: the month of publication as ``yyyy-MM``, ``undated`` without a time."""
    return events.withColumn(MONTH, F.coalesce(F.date_format("published_at", "yyyy-MM"), F.lit(UNDATED)))


def read_register(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored register with its ``month``, or None before the first upsert. A filter on ``month`` prunes folders."""
    try:
        return spark.read.schema(f"{EVENTS}, {MONTH} STRING").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def upsert_register(spark: SparkSession, new: DataFrame, path: str) -> list[str]:
    """Put the events of ``new`` into the register at ``path`` and return the months that were written.

    An id that the register holds, in whatever month, keeps its row. Of the stored rows only the ids are
    read for that, and the whole rows of the touched months; only these months are overwritten, all other
    files stay as they are. Within a month rows lie in the order (time, ticker, id); a month of many
    rows is written by many tasks. What is written is staged first, so a failure leaves a whole copy.
    Rows without an id are one event, as in :func:`upsert_events`.
    """
    stored = read_register(spark, path)
    fresh = with_month(upsert_events(None, new.select(*EVENT_COLUMNS)))
    if stored is not None:
        ids = stored.select(F.col("event_id").alias("known_id"))
        fresh = fresh.join(ids, F.col("event_id").eqNullSafe(F.col("known_id")), "left_anti")
    fresh = checkpointed(fresh)
    # bounded by the calendar
    touched = sorted(r[0] for r in fresh.select(MONTH).distinct().collect())
    if not touched:
        return []
    if stored is not None:
        fresh = fresh.unionByName(stored.filter(F.col(MONTH).isin(touched)))
    order = [MONTH, "published_at", "ticker", "event_id"]
    staged = checkpointed(fresh)
    (staged.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path))
    return touched
