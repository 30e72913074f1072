"""Hard negatives for contrastive training, by lists that the anchors of a cluster share (MAXIMUS).

Anchors are grouped by direction. Within a cluster no anchor is further from the centroid than the angle
phi, so the inner product of any of its anchors u with a row x at the angle theta from the centroid is at
most |u| |x| cos(max(0, theta - phi)). For a cluster the rows are sorted by this bound once; every anchor of
the cluster walks the list from the top and stops where the bound can no longer reach what it holds: the
result is certified, nothing is approximate.

The walk is made twice: for the best rows of the anchor's own label, the positives, then for the rows of
other labels whose score lies in the band that each positive sets. Rows are never shuffled: a task takes
its share of the table batch by batch and carries the lists of the anchors along, so what it emits is
bounded by the anchors, not by the rows. Anchors are worked on in blocks of bounded size, clusters side by
side and a cluster of many anchors cut by a hash; a block is what tasks are sent. Centroids are fitted on
a bounded sample of the anchors (``SAMPLE_VALUES`` numbers); they decide the order of the work, not its result.
"""
from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import shared_folder, written

# Numbers in the sample that centroids are fitted on, and in one block of anchors.
SAMPLE_VALUES, BLOCK_VALUES = 1 << 21, 1 << 19
MOST_CLUSTERS = 256
# Rows a cluster sorts at a time, rows of a step along its list, tasks per core.
LIST_ROWS, STEP_ROWS, TASKS = 16_384, 1024, 4

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column as doubles, short vectors ended by zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.slice(int(ends[0]), int(ends[-1] - ends[0])).to_numpy(zero_copy_only=False).astype(np.float64)
    counts = np.diff(ends)
    out = np.zeros((len(counts), dims))
    row = np.repeat(np.arange(len(counts)), counts)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], counts)] = np.floor(scale * flat)
    return out


def _products(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; what leaves 64 bits counts as the nearest 64-bit number."""
    if not u.size or not x.size:
        return np.zeros((len(u), len(x)), np.int64)
    if np.abs(u).max() * np.abs(x).max() * u.shape[1] < 2 ** 53:
        return (u @ x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(u) @ whole(x).T, _LEAST, _MOST).astype(np.int64)


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _angles(x: np.ndarray, length: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Angle of every row to the unit vector ``centroid``; rows without length are at 0."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.arccos(np.clip(np.where(length > 0, x @ centroid / length, 1.0), -1.0, 1.0))


def _centroids(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means from the first ``k`` different rows."""
    length = _lengths(sample)
    with np.errstate(invalid="ignore"):
        unit = sample[(length > 0) & np.isfinite(length)] / length[(length > 0) & np.isfinite(length)][:, None]
    unit = np.unique(unit, axis=0) if len(unit) else np.eye(1, max(1, sample.shape[1]))
    centre = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(unit @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, unit)
        size = _lengths(sums)
        centre[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return centre


class _Lists:
    """The best ``top`` (score, id) of every list, each taking scores within its own band."""

    def __init__(self, low: np.ndarray, high: np.ndarray, top: int) -> None:
        self.low, self.high, self.top = low, high, top
        self.least = low.copy()
        self.count = np.zeros(len(low), np.int64)
        self.score = np.zeros((len(low), top), np.int64)
        self.id: np.ndarray | None = None

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take the rows that belong to the best of their list; ``least`` rises where a list is full.

        Only the lists that get a row are sorted anew.
        """
        good = (score >= self.least[owner]) & (score <= self.high[owner])
        if not good.any():
            return
        if self.id is None:
            self.id = np.zeros(self.score.shape, ids.dtype if ids.dtype.kind in "iu" else object)
        lists, own = np.unique(owner[good], return_inverse=True)
        held = np.arange(self.top) < self.count[lists][:, None]
        own, score, ids = (np.concatenate(x) for x in ((np.nonzero(held)[0], own), (self.score[lists][held], score[good]), (self.id[lists][held], ids[good])))
        order = np.lexsort((ids, ~score, own))
        own, score, ids = own[order], score[order], ids[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        keep = rank < self.top
        at = lists[own[keep]], rank[keep]
        self.score[at], self.id[at] = score[keep], ids[keep]
        self.count[lists] = np.minimum(np.bincount(own, minlength=len(lists)), self.top)
        full = lists[self.count[lists] == self.top]
        self.least[full] = np.maximum(self.least[full], self.score[full, -1])

    def rows(self) -> tuple[np.ndarray, np.ndarray, list]:
        """(owner, score, id) of all that is held."""
        held = np.arange(self.top) < self.count[:, None]
        return np.nonzero(held)[0], self.score[held], self.id[held].tolist() if self.id is not None else []


def _walk(points: DataFrame, anchors: dict, low: np.ndarray, high: np.ndarray, lists: int, top: int, same: bool, scale: float) -> DataFrame:
    """``(list, id, score)``: a task's best rows of every list; anchor i owns the lists i * lists to (i + 1) * lists - 1."""
    schema = T.StructType([T.StructField("list", T.LongType()), points.schema["id"], T.StructField("score", T.LongType())])
    sent = points.sparkSession.sparkContext.broadcast((anchors, low, high))
    kind = to_arrow_type(points.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, low, high = sent.value
        found = _Lists(low, high, top)
        u, ids, labels, length = a["vectors"], a["ids"], a["labels"], _lengths(a["vectors"])
        members = [np.flatnonzero(a["cluster"] == c) for c in range(len(a["centroids"]))]
        narrow_u, longest = u.astype(np.float32), length.max(initial=0.0)
        spread = [_angles(u[m], length[m], c).max() if len(m) else 0.0 for m, c in zip(members, a["centroids"])]
        for batch in batches:
            for at in range(0, batch.num_rows, LIST_ROWS):
                part = batch.slice(at, LIST_ROWS)
                x = _matrix(part.column(2), u.shape[1], scale)
                x_ids = part.column(0).to_numpy(zero_copy_only=False)
                x_labels, size = part.column(1).to_numpy(zero_copy_only=False), _lengths(x)
                narrow = longest * size.max(initial=0.0) < 2 ** 24
                narrow_x = x.astype(np.float32) if narrow else None
                for m, phi, centroid in zip(members, spread, a["centroids"]):
                    if not len(m):
                        continue
                    bound = size * np.cos(np.maximum(0.0, _angles(x, size, centroid) - phi))
                    bound = np.nan_to_num(bound + 1e-9 * size, nan=np.inf, posinf=np.inf)
                    order = np.argsort(-bound, kind="stable")
                    for k in range(0, len(order), STEP_ROWS):
                        need = found.least.reshape(-1, lists)[m].min(axis=1).astype(np.float64)
                        going = ~(length[m] * bound[order[k]] * (1 + 1e-9 * np.sign(bound[order[k]])) + 1 < need)
                        m, need = m[going], need[going]
                        if not len(m):
                            break
                        rows = order[k:k + STEP_ROWS]
                        # whole numbers below 2 ** 24, as are all sums on the way: single precision is exact
                        score = narrow_u[m] @ narrow_x[rows].T if narrow else _products(u[m], x[rows])
                        good = score >= (need.astype(np.float32) if narrow else found.least.reshape(-1, lists)[m].min(axis=1))[:, None]
                        if labels.dtype != object:
                            good &= (labels[m][:, None] == x_labels[rows][None, :]) == same
                        i, j = np.nonzero(good)
                        if not len(i):
                            continue
                        score, i, j = score[i, j].astype(np.int64), m[i], rows[j]
                        fits = ((labels[i] == x_labels[j]) == same) & (ids[i] != x_ids[j])
                        score, i, j = score[fits], i[fits], j[fits]
                        found.add((i[:, None] * lists + np.arange(lists)).ravel(), np.repeat(score, lists), np.repeat(x_ids[j], lists))
        owner, score, kept = found.rows()
        if len(owner):
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(kept, kind), pa.array(score, pa.int64())], schema.names)

    return points.mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _anchor_blocks(anchors: DataFrame, dims: int, scale: float, clusters: int | None) -> Iterator[dict]:
    """The anchors in blocks for the tasks: ids, labels, integer vectors, the cluster of each and the centroids."""
    spark = anchors.sparkSession
    per_block = max(1, BLOCK_VALUES // max(1, dims))
    total = anchors.count()
    if not total:
        return
    kept = anchors.orderBy(F.xxhash64("id"), "id").limit(max(1, SAMPLE_VALUES // max(1, dims))).toArrow()
    sample = _matrix(kept.column("vector").combine_chunks(), dims, scale)
    centre = _centroids(sample, clusters or min(MOST_CLUSTERS, math.ceil(math.sqrt(total))))
    sent = spark.sparkContext.broadcast(centre)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argmax(np.nan_to_num(_matrix(batch.column(2), dims, scale)) @ sent.value.T, axis=1) if batch.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names)

    names = [*anchors.columns, "cluster"]
    placed = written(anchors.mapInArrow(assign, T.StructType([*anchors.schema.fields, T.StructField("cluster", T.IntegerType())])))
    # at most one row per centroid
    counts = dict(placed.groupBy("cluster").count().collect())
    first, parts, block, room = {}, {}, 0, per_block
    for c in sorted(counts):
        if counts[c] > room and room < per_block:
            block, room = block + 1, per_block
        first[c], parts[c] = block, max(1, math.ceil(counts[c] / per_block))
        block, room = (block + parts[c], per_block) if parts[c] > 1 else (block, room - counts[c])
    deal = F.create_map(*[F.lit(v) for c in first for v in (c, first[c])])[F.col("cluster")]
    cut = F.create_map(*[F.lit(v) for c in parts for v in (c, parts[c])])[F.col("cluster")]
    path = f"{shared_folder(spark)}/anchors-{uuid.uuid4().hex}"
    placed.withColumn("block", deal + F.pmod(F.xxhash64("id"), cut).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    stored = spark.read.schema(T.StructType([*placed.schema.fields, T.StructField("block", T.IntegerType())])).parquet(path)
    for b in range(block + 1):
        got = stored.filter(F.col("block") == b).orderBy("id").toArrow()
        if got.num_rows:
            cluster = got.column("cluster").to_numpy()
            used, cluster = np.unique(cluster, return_inverse=True)
            yield {"ids": got.column("id").to_numpy(), "labels": got.column("label").to_numpy(), "cluster": cluster, "centroids": centre[used],
                   "vectors": _matrix(got.column("vector").combine_chunks(), dims, scale)}


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
                   id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", clusters: int | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    The score of a row is the inner product of floor(``scale`` * component) with the anchor's; higher comes
    first, then the smaller id. For each of an anchor's first ``positives`` rows of its label, the first
    ``negatives`` rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's.

    Rows with a null label, null vector or a component that is null or not finite take no part, nor do
    rows without an id. A shorter vector is read as ending in zeros. Repeated rows count each by itself as
    positives and negatives; an anchor that repeats is one anchor, with its smallest (label, vector), and no
    row of its own id is its positive or negative. A score outside 64 bits counts as the nearest 64-bit
    number. Empty tables give no rows; other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    points = (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), is_anchor.alias("asks"))
              .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite))
    dims = points.agg(F.max(F.size("vector"))).first()[0]
    whole = T.StructType([T.StructField("anchor_id", points.schema["id"].dataType), T.StructField("positive_id", points.schema["id"].dataType), T.StructField("rank", T.IntegerType()),
                          T.StructField("negative_id", points.schema["id"].dataType), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])
    out = None
    if dims is not None:
        anchors = points.filter("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")
        rows = points.select("id", "label", "vector").coalesce(max(1, TASKS * spark.sparkContext.defaultParallelism))
        for block in _anchor_blocks(anchors, dims, scale, clusters):
            n = len(block["ids"])
            open_low, open_high = np.full(n, _LEAST), np.full(n, _MOST)
            best = _ranked(_walk(rows, block, open_low, open_high, 1, positives, True, scale), positives)
            # at most `positives` rows per anchor of the block
            kept = best.select(F.col("list"), F.col("rank") - 1, "id", "score").collect()
            lower, upper = np.full(n * positives, _MOST), np.full(n * positives, _LEAST)
            for i, slot, _, score in kept:
                least, most = -(-low * score // 100), high * score // 100
                if least <= most:
                    lower[i * positives + slot], upper[i * positives + slot] = max(least, _LEAST), min(most, _MOST)
            if not (lower <= upper).any():
                continue
            ids = block["ids"].tolist()
            pairs = spark.createDataFrame([(i * positives + slot, ids[i], found, score) for i, slot, found, score in kept],
                                          T.StructType([T.StructField("list", T.LongType()), *[whole[c] for c in ("anchor_id", "positive_id", "positive_score")]]))
            found = _ranked(_walk(rows, block, lower, upper, positives, negatives, False, scale), negatives)
            # the block's pairs: bounded by the block
            part = found.join(F.broadcast(pairs), "list").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            part = written(part)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], whole)
