"""Signals from rater answers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.operators.ordering import previous_value

# Fixed value: weight of the other scores as tie-breaker behind guidance.
TIE_WEIGHT = 0.1


def tone_score() -> Column:
    """Guidance plus a small tie-breaker from the other three scores, mentioned or not."""
    others = (F.col("overall_tone") + F.col("margins_tone") + F.col("demand_tone")) / F.lit(3.0)
    return F.col("guidance_tone") + F.lit(TIE_WEIGHT) * others


def build_signals(scores: DataFrame, events: DataFrame, prefix: str = "tone",
                  slices: int | None = None) -> DataFrame:
    """One row per scored document: composite, topic scores and change since the last document.

    A topic the document does not mention counts 0 in its own column. ``{prefix}_delta`` is
    null for a company's first document.
    """
    known = scores.join(events.select("event_id", "ticker", "published_at"), "event_id")
    with_last = previous_value(known, ["ticker"], ["published_at", "event_id"], "guidance_tone",
                               "last_guidance", slices)

    def topic(name: str) -> Column:
        return F.when(F.col(f"{name}_mentioned"), F.col(f"{name}_tone")).otherwise(0).cast("double")

    columns = [
        "event_id",
        tone_score().alias(prefix),
        F.col("guidance_tone").cast("double").alias(f"{prefix}_guidance"),
        topic("margins").alias(f"{prefix}_margins"),
        topic("demand").alias(f"{prefix}_demand"),
        F.col("overall_tone").cast("double").alias(f"{prefix}_overall"),
        (F.col("guidance_tone") - F.col("last_guidance")).cast("double").alias(f"{prefix}_delta"),
    ]
    if "reason" in scores.columns:
        columns.append(F.col("reason").alias(f"{prefix}_reason"))
    return with_last.select(*columns)
