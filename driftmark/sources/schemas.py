"""Explicit schemas of the stored tables."""
from __future__ import annotations

UNIVERSE = "ticker STRING, name STRING, sector STRING, sector_etf STRING, cik LONG"
EVENTS = ("event_id STRING, ticker STRING, published_at TIMESTAMP_NTZ, source STRING, form STRING, "
          "url STRING, path STRING")
EVENT_COLUMNS = ("event_id", "ticker", "published_at", "source", "form", "url", "path")
PRICES = "ticker STRING, date DATE, close DOUBLE"
FACTORS = "date DATE, `Mkt-RF` DOUBLE, SMB DOUBLE, HML DOUBLE, RMW DOUBLE, CMA DOUBLE, RF DOUBLE, Mom DOUBLE"
MANIFEST = ("ticker", "published_at", "path")
LABELS = "number INT, guidance_tone STRING, notes STRING"
ANSWERS = ("key STRING, event_id STRING, model STRING, prompt_version STRING, rep INT, "
           "guidance_tone INT, margins_tone INT, demand_tone INT, overall_tone INT, "
           "guidance_mentioned BOOLEAN, margins_mentioned BOOLEAN, demand_mentioned BOOLEAN, "
           "reason STRING, reason_truncated BOOLEAN, model_id STRING, input_tokens LONG, output_tokens LONG")
