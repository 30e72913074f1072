"""Documents in blocks of bounded size that ask the whole corpus about their keys.

A block is the documents of one hash of their ids, about ``BLOCK_BYTES`` of text. Operators that need to
know, of millions of keys (words, word windows), what other documents hold, make one row per block and
part of the key space instead of one row per key: the block's distinct keys of that part, sorted, in a
binary column. A part gathers the rows of all blocks, answers each of them in the order it asked, and
the answers meet the block's documents again. All three steps are ordinary groupings, so Spark shuffles,
retries and spills them; the texts are shuffled once and that shuffle serves every step.

A key costs one entry per block, however many documents repeat it, so a window or word found in a third
of all documents adds one entry per block to its part. At sizes where blocks times parts grows beyond
what a shuffle has segments for, raise ``block_bytes`` with the memory of a task.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
# Text whose keys one part answers for.
PART_BYTES = 16 << 20


def blocked(documents: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, id, text) rows and the number of key parts; rows of one id share a block, null texts are empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = documents.select(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, parts = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size / PART_BYTES))
    block = F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)).cast("long")
    return documents.select(block.alias("block"), F.col(id_col).alias("id"), text.alias("text")), parts


def part_cuts(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted 64-bit keys of each part begin, and the end: equal ranges of the key space."""
    borders = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.r_[0, np.searchsorted(sorted_keys, borders), len(sorted_keys)]
