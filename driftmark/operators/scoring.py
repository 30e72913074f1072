"""Incremental document scoring with a user-supplied rater.

The answer ledger is append-only. A run scores only documents without a good answer for the same
model, prompt version and repetition: one job over the open documents, dealt into tasks of a stated
number of documents. Every task commits its answers, good or bad, when it is done, so what a run loses by
dying is the batches of the tasks at work, and the next run goes on with what is still open. A rater
that has reached a limit says so by :class:`LimitReached`, which ends the run early.
"""
from __future__ import annotations

import json
import threading
import time
import uuid
import warnings
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmark.functions.answers import answer_key, parse_answers
from driftmark.functions.text import rater_text
from driftmark.sources import ledger
from driftmark.sources.ledger import read_answers  # noqa: F401 - read from here by older callers

ANSWER_COLUMNS, ANSWER_SCHEMA = ledger.COLUMNS, ledger.SCHEMA
# Documents of one task: what a worker that dies has to rate again.
TASK_DOCUMENTS = 200
# Seconds in which tasks at work may still end by themselves after one of them has met the limit.
GRACE = 2.0


class LimitReached(Exception):
    """Raised by a rater whose provider takes no more documents for now: the document stays open."""


# A rater reads one document, (text, row without the text), or a batch of them, (frame with the column
# rater_text); it answers with JSON texts or dicts, one per document.
Rater = Callable[[str, dict], str | dict]
BatchRater = Callable[[pd.DataFrame], Sequence[str | dict]]


def latest_answers(answers: DataFrame) -> DataFrame:
    """Good answers, the last one per key; a hot key is reduced before the shuffle."""
    columns = [c for c in answers.columns if c != "key"]
    good = answers.filter(F.col("error").isNull()) if "error" in answers.columns else answers
    return (good.groupBy("key").agg(F.max_by(F.struct(*columns), "ingested_at").alias("last"))
            .select("key", "last.*"))


def with_keys(events: DataFrame, model: str, prompt_version: str, rep: int = 1) -> DataFrame:
    return events.withColumn("key", answer_key(F.col("event_id"), F.lit(model), F.lit(prompt_version), F.lit(rep)))


def open_documents(events: DataFrame, answers: DataFrame | None, model: str, prompt_version: str,
                   rep: int = 1) -> DataFrame:
    """Documents this rater has not answered yet, with their ``key``."""
    keyed = with_keys(events, model, prompt_version, rep)
    if answers is None:
        return keyed
    good = answers.filter(F.col("error").isNull()) if "error" in answers.columns else answers
    return keyed.join(good.select("key").distinct(), "key", "left_anti")


def _answer(given: object) -> str:
    """A rater's answer as JSON text."""
    if isinstance(given, str):
        return given
    if isinstance(given, dict):
        return json.dumps(given)
    raise TypeError(f"a rater answers with text or a dict, not {type(given).__name__}")


def _limit(failure: Exception) -> bool:
    # by name: a rater may bring the class along in its own copy of this module
    return any(c.__name__ == LimitReached.__name__ for c in type(failure).__mro__)


def apply_rater(documents: DataFrame, rater: Rater | BatchRater, batched: bool = False, limit: Callable[[str], None] | None = None) -> DataFrame:
    """``(key, event_id, answer, failure)``; a document whose rating fails does not stop the others.

    The rater sees all columns of ``documents`` but its text, which is ``rater_text``. A batch whose rating
    fails, or that has another number of answers, is a failure of each of its documents. After
    :class:`LimitReached` the task asks no more: its other documents have no row and stay open, and
    ``limit`` is told.
    """
    def single(record: dict) -> tuple[str | None, str | None]:
        text = record.pop("rater_text")
        try:
            return _answer(rater(text, record)), None
        except Exception as failure:  # noqa: BLE001 - any failure only concerns this document
            if _limit(failure):
                raise
            return None, f"{type(failure).__name__}: {failure}"

    def together(batch: pd.DataFrame) -> list[tuple[str | None, str | None]]:
        try:
            given = list(rater(batch))
            if len(given) != len(batch):
                raise ValueError(f"{len(given)} answers for {len(batch)} documents")
        except Exception as failure:  # noqa: BLE001
            if _limit(failure):
                raise
            return [(None, f"{type(failure).__name__}: {failure}")] * len(batch)
        out = []
        for answer in given:
            try:
                out.append((_answer(answer), None))
            except TypeError as failure:
                out.append((None, f"TypeError: {failure}"))
        return out

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for batch in batches:
            rows = []
            try:
                if batched and not stopped:
                    rows = together(batch)
                for record in batch.to_dict("records") if not batched and not stopped else ():
                    rows.append(single(record))
            except Exception as failure:  # noqa: BLE001 - only a limit comes here
                stopped = True
                if limit:
                    limit(f"{failure}")
            answers, failures = zip(*rows) if rows else ((), ())
            yield pd.DataFrame({"key": batch["key"][:len(rows)], "event_id": batch["event_id"][:len(rows)],
                                "answer": list(answers), "failure": list(failures)}, dtype=object)

    return documents.mapInPandas(rate, "key string, event_id string, answer string, failure string")


def score_documents(documents: DataFrame, rater: Rater | BatchRater, model: str, prompt_version: str, rep: int = 1,
                    max_chars: int | None = None, anonymize: bool = True, batched: bool = False,
                    limit: Callable[[str], None] | None = None) -> DataFrame:
    """Rows for the answer ledger. ``documents``: key, event_id, ticker, name, text and what else the rater may see."""
    shown = rater_text(F.col("text"), F.col("ticker"), F.col("name"), max_chars, anonymize)
    rated = apply_rater(documents.withColumn("rater_text", shown).drop("text"), rater, batched, limit)
    parsed = parse_answers(rated, "answer").withColumn("error", F.coalesce("failure", "error"))
    return parsed.select(
        "key", "event_id", F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"),
        F.lit(rep).alias("rep"), *ANSWER_COLUMNS[5:-1], F.current_timestamp().alias("ingested_at"))


def in_tasks(keyed: DataFrame, documents: int, per_task: int) -> DataFrame:
    """Documents dealt into tasks of about ``per_task``, each of one bucket of the ledger or of a few whole ones."""
    tasks = 1
    while tasks * per_task < documents:
        tasks *= 2
    # a power of two, like the number of buckets: tasks and buckets are parts of one another
    return keyed.repartitionById(tasks, F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int"))


def _run_until_limit(spark: SparkSession, job: Callable[[], None], met: Callable[[], bool], grace: float) -> None:
    """Run ``job``; once ``met``, give its tasks ``grace`` seconds and cancel what is then still open."""
    tag, failures = f"driftmark-scoring-{uuid.uuid4().hex}", []

    def work() -> None:
        spark.sparkContext.addJobTag(tag)
        try:
            job()
        except Exception as failure:  # noqa: BLE001 - raised below, unless the run was ended on purpose
            failures.append(failure)

    thread = threading.Thread(target=work)
    thread.start()
    while thread.is_alive() and not met():
        thread.join(0.1)
    end = time.monotonic() + grace
    while thread.is_alive() and time.monotonic() < end:
        thread.join(0.1)
    ended = thread.is_alive()
    while thread.is_alive():
        spark.sparkContext.cancelJobsWithTag(tag)
        thread.join(0.5)
    if failures and not (ended and met()):
        raise failures[0]


def score_into(spark: SparkSession, events: DataFrame, rater: Rater | BatchRater, path: str, model: str, prompt_version: str,
               rep: int = 1, max_chars: int | None = None, anonymize: bool = True, batched: bool = False,
               task_documents: int = TASK_DOCUMENTS, grace: float = GRACE) -> DataFrame:
    """Score what is open into the ledger at ``path``; this rater's good answers to ``events`` come back.

    The texts are read once. When a task meets the limit of the rater, tasks at work may end within
    ``grace`` seconds, no further ones are started, and a warning tells so; what was answered stays.
    """
    keyed = with_keys(events, model, prompt_version, rep)
    stored = ledger.answers_of(spark, path, model, prompt_version, rep)
    todo = keyed if stored is None else keyed.join(ledger.answered_keys(stored, keyed), "key", "left_anti")
    met = spark.sparkContext.accumulator(0)
    dealt = in_tasks(todo, todo.select("key").count(), task_documents)
    answers = score_documents(dealt, rater, model, prompt_version, rep, max_chars, anonymize, batched, lambda _: met.add(1))
    _run_until_limit(spark, lambda: ledger.append_answers(answers, path), lambda: met.value > 0, grace)
    if met.value:
        warnings.warn("the rater has reached its limit; the same call goes on where this one stopped", stacklevel=2)
    good = latest_answers(ledger.answers_of(spark, path, model, prompt_version, rep).drop(ledger.BUCKET))
    return good.join(keyed.select("key"), "key", "left_semi")


def hash_sample(df: DataFrame, n: int, seed: int, key: str = "event_id") -> DataFrame:
    """A random sample of ``n`` rows that is the same everywhere: the smallest md5(seed|id)."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("draw", draw).orderBy("draw", key).limit(n)


def first_documents(events: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by time, for a trial run."""
    return events.orderBy("published_at", "ticker", "event_id").limit(n)


def review_sample(documents: DataFrame, n: int = 30, seed: int = 11, max_chars: int | None = None,
                  anonymize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A blind reading sample: (numbered texts, the key kept apart, an empty label sheet)."""
    drawn = (hash_sample(documents, n, seed)
             .withColumn("number", F.row_number().over(Window.orderBy("draw", "event_id"))))
    shown = rater_text(F.col("text"), F.col("ticker"), F.col("name"), max_chars, anonymize)
    texts = drawn.select("number", shown.alias("text"))
    sheet = drawn.select("number", F.lit(None).cast("int").alias("guidance_tone"), F.lit("").alias("notes"))
    return texts, drawn.select("number", "event_id"), sheet


def model_ids(answers: DataFrame, events: DataFrame, model: str, configured: str | None = None) -> DataFrame:
    """One row ``model_version``: the distinct exact models behind the first-pass answers in use."""
    used = (answers.filter((F.col("model") == model) & (F.coalesce("rep", F.lit(1)) == 1)
                           & F.col("model_id").isNotNull() & (F.col("model_id") != ""))
            .join(events.select("event_id"), "event_id", "left_semi"))
    joined = F.array_join(F.array_sort(F.collect_set("model_id")), ", ")
    return used.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit(configured)).alias("model_version"))
