"""SimHash near-duplicates with pigeonring candidate pruning.

A document's 64-bit fingerprint is the bitwise majority of its shingles' hashes. Two fingerprints link
when they differ in at most ``radius`` bits. The 64 bits form a ring of ``SEGMENTS`` segments. If all
segments together hold at most ``radius`` differences, some start on the ring has a chain whose first
*l* segments hold at most ``l * radius / SEGMENTS`` differences for every *l*: that is what candidates
must show. With the default radius of 4 the first two segments of the chain must agree and the next
three may differ in one bit, so two of these three agree too: 12 starts x 3 choices = 36 exact keys of
four segments (about 21 bits) find every pair. The rest of the ring prunes candidates before the full
count of differing bits.

Only distinct fingerprints are compared, so exact copies cost one row. A bucket is compared inside a
task, by numpy, and sends out the links of a spanning forest at most. A bucket beyond ``BUCKET_ROWS``
is split into blocks and every pair of blocks becomes a task of its own: nothing is dropped or emitted
pair by pair.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import written

SEED = 42
SHINGLE = 4
RADIUS = 4
SEGMENTS = 12
# A bucket of more fingerprints is compared in blocks of half this size.
BUCKET_ROWS = 4096
# Up to this many rows a bucket is compared pair by pair, beyond it by walking its components.
_PAIRWISE = 48


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the XXH64 values of the word shingles of ``text``, A-Z lower-cased; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        values = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-size].tolist()]
        values = [digest(joined[i:j], SEED) for i, j in zip(starts, (ends[size - 1:] - 1).tolist())]
    bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(values)
    return int.from_bytes(np.packbits(majority, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): one row per input row, ``fp`` the fingerprint's 64 bits as a signed long. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values.view(np.int64))], ["id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    source = documents.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` nearly equal parts of 64 bits."""
    cuts = [round(i * 64 / count) for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def chain_masks(radius: int, segments: int) -> list[np.uint64]:
    """Bit masks such that fingerprints within ``radius`` agree on all bits of at least one mask.

    For each start of the ring: the segments whose cumulative budget is still 0, and of those with a
    budget of 1 all but one (the one that holds the difference).
    """
    budgets = [(length + 1) * radius // segments for length in range(segments)]
    exact, single = budgets.count(0), budgets.count(1)
    parts = [np.uint64(((1 << width) - 1) << shift) for shift, width in _segments(segments)]
    masks = []
    for start in range(segments):
        ring = [parts[(start + i) % segments] for i in range(exact + single)]
        choices = combinations(ring[exact:], max(single - 1, 0)) if single else [()]
        for kept in choices:
            masks.append(np.bitwise_or.reduce([*ring[:exact], *kept], dtype=np.uint64))
    return masks


def within_ring(difference: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """True where some chain of ring segments stays within its budgets all the way round."""
    each = [np.bitwise_count(difference & np.uint64(((1 << width) - 1) << shift)).astype(np.int8)
            for shift, width in _segments(segments)]
    found = np.zeros(difference.shape, bool)
    for start in range(segments):
        total = np.zeros(difference.shape, np.int8)
        alive = np.ones(difference.shape, bool)
        for length in range(segments):
            total = total + each[(start + length) % segments]
            alive &= total <= (length + 1) * radius // segments
            if not alive.any():
                break
        found |= alive
    return found


def _linked(difference: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """Candidates must pass the ring before all their bits are counted."""
    found = within_ring(difference, radius, segments)
    found[found] = np.bitwise_count(difference[found]) <= radius
    return found


def _walk(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of one large bucket: every fingerprint is reached once."""
    left, links = values, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                reached = left[near]
                links += [(at, to) for to in reached]
                frontier += list(reached)
                left = left[~near]
    return links


def bucket_links(key: np.ndarray, fp: np.ndarray, radius: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal ``key`` (sorted): all of small runs, a spanning forest of large ones."""
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    one, two = [], []
    small = np.repeat(sizes <= _PAIRWISE, sizes)
    after = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1
    for lag in range(1, int(sizes[sizes <= _PAIRWISE].max(initial=1))):
        at = np.flatnonzero(small & (after >= lag))
        at = at[_linked(fp[at] ^ fp[at + lag], radius, segments)]
        one.append(fp[at])
        two.append(fp[at + lag])
    for start, size in zip(starts[sizes > _PAIRWISE], sizes[sizes > _PAIRWISE]):
        links = np.array(_walk(fp[start:start + size], radius), np.uint64).reshape(-1, 2)
        one.append(links[:, 0])
        two.append(links[:, 1])
    return (np.concatenate(one), np.concatenate(two)) if one else (np.zeros(0, np.uint64),) * 2


def fingerprint_links(classes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): enough links between the distinct longs in ``fp`` to connect all that are within ``radius`` bits."""
    masks = chain_masks(radius, segments)
    session = classes.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the masked bits are spread by a multiplication and moved per mask, so that masks keep apart
        moves = [np.uint64((i + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64)) for i in range(len(masks))]
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask, move in zip(masks, moves):
                key = (fp & mask) * np.uint64(0x9E3779B97F4A7C15) + move
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            if not rows.shape[1]:
                continue
            # the last bucket may go on in the next batch
            last = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0))
            cut = last[-1] + 1 if len(last) else 0
            held = rows[:, cut:]
            yield from links(rows[:, :cut])
        if held is not None:
            yield from links(held)

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1]:
            run = np.cumsum(np.r_[0, (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])
            one, two = bucket_links(run, np.ascontiguousarray(rows[2]).view(np.uint64), radius, segments)
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["a", "b"])

    keys = classes.select("fp").mapInArrow(keyed, "key bigint, fp bigint")
    sizes = keys.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1")
    blocks = F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / BUCKET_ROWS)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Spark sizes the keys as the fingerprints they come from, dozens of times too low: neither side may be broadcast
    spread = (keys.join(sizes.hint("merge"), "key").withColumn("blocks", F.when(F.col("rows") > BUCKET_ROWS, blocks).otherwise(1))
              .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).cast("bigint").alias("block"), "fp"))
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    return (spread.repartition(parts, "key", "block").sortWithinPartitions("key", "block")
            .mapInArrow(compare, "a bigint, b bigint").distinct())


def _labelled(documents: DataFrame, id_col: str, text_col: str, radius: int, segments: int, size: int) -> DataFrame:
    """(id, text_hash, fp, root, component_id) for every row of ``documents``."""
    prints = written(fingerprints(documents, id_col, text_col, size))
    classes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    found = components(fingerprint_links(classes, radius, segments))
    roots = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    # written out, so that a large component's fingerprints meet a plain table and can be split
    lows = written(roots.groupBy("root").agg(F.min("first").alias("component_id")))
    return prints.join(roots.join(lows, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    segments: int = SEGMENTS, size: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``documents``; other columns are ignored.

    ``fingerprint`` is 16 hex digits; ``component_id`` is the smallest id reachable over links, the own
    included. Null and empty texts have fingerprint zero and link like any other. Repeated ids keep
    their rows; a null id keeps its row and counts as no id, so a component of null ids only is null.
    An empty table gives no rows.
    """
    return _labelled(documents, id_col, text_col, radius, segments, size).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
               segments: int = SEGMENTS, size: int = SHINGLE) -> DataFrame:
    """One row of each near-duplicate component, with all its columns: the one with the smallest id.

    Among rows of one id the smallest text hash decides, among equal rows any; a null id comes last.
    """
    return first_rows(documents, _labelled(documents, id_col, text_col, radius, segments, size), id_col, text_col)


def first_rows(documents: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows :func:`keep_first` keeps, for (id, text_hash, root) rows in ``found``."""
    chosen = (found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("s"))
              .select(F.col("s.id").alias("s_id"), F.col("s.text_hash").alias("s_hash")))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(id_col).alias("id"),
                            F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    kept = rows.join(chosen, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left_semi")
    return kept.groupBy("id", "text_hash").agg(F.first("row").alias("row")).select("row.*")
