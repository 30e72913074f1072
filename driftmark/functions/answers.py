"""Rater answers: keys, parsing and validation."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Answer fields, allowed scores, length of the kept reason and its replacement.
TOPICS = ("guidance", "margins", "demand")
SCORES = ("guidance", "margins", "demand", "overall")
LEVELS = (-2, -1, 0, 1, 2)
REASON_CUT = "(reason cut off at the length limit)"

_FIELDS = ", ".join([f"{s}_tone STRING" for s in SCORES] + [f"{t}_mentioned STRING" for t in TOPICS])
_FULL = f"{_FIELDS}, reason STRING, model_id STRING, broken STRING"
_SCORES_ONLY = f"{_FIELDS}, model_id STRING, broken STRING"
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}


def answer_key(event_id: Column, model: Column, prompt_version: Column, rep: Column) -> Column:
    """sha1 of ``event|model|prompt version|repetition``."""
    return F.sha1(F.concat_ws("|", event_id, model, prompt_version, rep.cast("string")))


def parse_answers(df: DataFrame, answer: str) -> DataFrame:
    """Parse JSON answers into score columns, ``reason``, ``reason_truncated`` and ``error``.

    An answer cut off inside its trailing reason keeps the scores before it. Scores must be
    numbers that are -2 to 2 without their fraction and every topic needs its flag; other answers carry an ``error``.
    """
    text = F.col(answer)
    head = F.substring_index(text, '"reason"', 1)
    closed = F.concat(F.regexp_replace(F.rtrim(head), r",*\z", ""), F.lit("}"))
    # exploding the one-element array keeps later filters from repeating the parsing
    parsed = (df.select("*", F.explode(F.array(F.from_json(text, _FULL, _OPTIONS))).alias("full"))
              .withColumn("whole", F.col("full").isNotNull() & F.col("full.broken").isNull()))
    second = F.when(~F.col("whole") & text.contains('"reason"'), F.from_json(closed, _SCORES_ONLY, _OPTIONS))
    parsed = (parsed.select("*", F.explode(F.array(second)).alias("rescued"))
              .withColumn("saved", F.col("rescued").isNotNull() & F.col("rescued.broken").isNull()))

    def field(name: str) -> Column:
        return F.when(F.col("whole"), F.col(f"full.{name}")).when(F.col("saved"), F.col(f"rescued.{name}"))

    out = parsed
    for s in SCORES:
        number = field(f"{s}_tone").try_cast("double")
        out = out.withColumn(f"{s}_tone", F.when(number.between(-1e9, 1e9), number).cast("int"))
    for t in TOPICS:
        flag = F.lower(field(f"{t}_mentioned"))
        out = out.withColumn(f"{t}_mentioned", F.when(flag.isNotNull(), ~flag.isin("false", "0", "")))
    out = (out.withColumn("reason", F.when(F.col("whole"), F.coalesce("full.reason", F.lit("")))
                          .when(F.col("saved"), F.lit(REASON_CUT)))
           .withColumn("reason_truncated", ~F.col("whole") & F.col("saved"))
           .withColumn("model_id", field("model_id")))
    in_range = [F.coalesce(F.col(f"{s}_tone").isin(*LEVELS), F.lit(False)) for s in SCORES]
    flags = [F.col(f"{t}_mentioned").isNotNull() for t in TOPICS]
    error = F.when(~F.col("whole") & ~F.col("saved"), "not readable")
    for s, ok in zip(SCORES, in_range):
        error = error.when(~ok, f"{s}_tone missing or out of range")
    for t, ok in zip(TOPICS, flags):
        error = error.when(~ok, f"{t}_mentioned missing")
    return out.withColumn("error", error).drop("full", "whole", "rescued", "saved")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull())
