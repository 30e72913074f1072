"""Ranked lexical search: the best documents of every query by integer impacts, with norm buckets (LEMP).

A document is a vector of impacts, one per term that some query asks for: the term's weight times its
saturated frequency, exactly the integer it adds to a score. A query is the 0/1 vector of its terms, so a
score is their inner product and never exceeds sqrt(terms of the query) times the document's length.

1. Terms of the documents are counted in one pass over the texts and written as compact rows; what the
   weights need (documents, words, document frequencies) is summed from them.
2. The impact vectors are sorted by length into range partitions, ties by a hash, so that copies spread,
   and written. The longest ones, a share of all rows, give every query a threshold: its tenth best score
   so far, which the tenth best of all can only exceed.
3. The rest is read from where the largest sqrt(terms) * length can still reach a threshold; Parquet skips
   what lies below. Within a task the rows come longest first in buckets. A bucket whose longest vector
   cannot reach a query's threshold is pruned for it (Cauchy-Schwarz). Inside a bucket the query's heaviest
   coordinates are summed, and a row survives only if this sum plus the most that the remaining
   coordinates can add reaches the threshold. Survivors are scored again in 64-bit integers, and their
   scores raise the threshold. A task emits at most the wanted number of rows per query.

Queries are worked on in blocks of bounded bytes, whatever their number: the block's terms and thresholds
are what tasks are sent. Everything between the steps lies in written tables.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import written
from .words import slices

TOP = 10
# The weights of the contract.
SCALE, HALF, LENGTH_PERCENT, UNIT = 1_000_000_000, 8, 90, 1000
# Query text of one block; a longer query is a block of its own.
BLOCK_BYTES = 4 << 20
# Rows of one bucket, and the heaviest coordinates that are summed before the bound is asked.
BUCKET_ROWS, FOCUS = 4096, 12
# Share of the rows, the longest, from which the first thresholds come.
SEED_SHARE = 1 / 32

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[str]:
    """Maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters."""
    return [w.decode("utf-8", "surrogatepass") for w in _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())]


def _blocks(queries: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The queries in blocks of about ``block_bytes`` of text; the driver holds one block at a time."""
    block, size = [], 0
    for item, text in queries.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        block.append((item, list(dict.fromkeys(terms_of(text)))))
        size += len(text or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _term_rows(documents: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document with a term: all its terms counted, those of the block listed."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["id"], *[T.StructField(c, t) for c, t in (
        ("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.IntegerType())))]])
    sent = source.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                text, cuts = memoryview(data), offsets.tolist()
                rows, n, terms, tfs, ends = [], [], [], [], [0]
                for row, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    words = bytes(text[a:b]).lower().translate(_WORD).split()
                    if not words:
                        continue
                    counts = Counter(filter(None, map(known.get, words)))
                    rows.append(row)
                    n.append(len(words))
                    terms.extend(counts.keys())
                    tfs.extend(counts.values())
                    ends.append(len(terms))
                if rows:
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(rows)), pa.array(n, pa.int64()), *lists], schema.names)

    return source.mapInArrow(run, schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the flat values of a list column."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.slice(int(ends[0]), int(ends[-1] - ends[0])).to_numpy()


def _impacts(rows: DataFrame, weights: np.ndarray, documents: int, words: int) -> DataFrame:
    """``(id, length, terms, impacts)``: each term's integer share of a score; rows without a term of the block go."""
    schema = T.StructType([rows.schema["id"], T.StructField("length", T.DoubleType()), rows.schema["terms"],
                           T.StructField("impacts", T.ArrayType(T.LongType()))])
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(np.diff(batch.column(2).offsets.to_numpy()) > 0)) if batch.num_rows else batch
            if not batch.num_rows:
                continue
            ends, terms = _lists(batch.column(2))
            tf = _lists(batch.column(3))[1].astype(np.int64)
            # the product may outgrow 64 bits in a long text, so it is made of Python integers there
            n = batch.column(1).to_numpy()
            if int(n.max()) <= (1 << 62) // (LENGTH_PERCENT * documents):
                m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * n * documents // words
            else:
                m = np.array([100 - LENGTH_PERCENT + LENGTH_PERCENT * int(x) * documents // words for x in n], np.int64)
            impact = weight[terms] * (SCALE * tf // (UNIT * tf + HALF * np.repeat(m, np.diff(ends))))
            length = np.sqrt(np.add.reduceat(impact.astype(np.float64) ** 2, ends[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms)),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(impact))], schema.names)

    return rows.filter(F.size("terms") > 0).mapInArrow(run, schema)


class _Bucket:
    """Rows of one bucket by row and by term."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        self.ids, self.length, self.ends, self.terms, self.impacts = ids, length, ends, terms, impacts
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.row_of, self.by_term, sorted_terms = row[order], impacts[order], terms[order]
        self.known, at = np.unique(sorted_terms, return_index=True)
        self.upto = np.r_[at, len(order)]
        self.heaviest = np.maximum.reduceat(self.by_term, at) if len(at) else self.by_term

    def survivors(self, wanted: np.ndarray, least: float) -> np.ndarray:
        """Rows whose score for the sorted terms ``wanted`` can reach ``least``."""
        at = np.searchsorted(self.known, wanted)
        at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == wanted)]
        if not len(at):
            return at
        at = at[np.argsort(-self.heaviest[at], kind="stable")]
        focus, rest = at[:FOCUS], at[FOCUS:]
        summed, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for k in focus:
            rows, impact = self.row_of[self.upto[k]:self.upto[k + 1]], self.by_term[self.upto[k]:self.upto[k + 1]].astype(np.float64)
            summed[rows] += impact
            squares[rows] += impact * impact
        # what the other coordinates can add: by Cauchy-Schwarz over them, and by the largest of each
        left = np.sqrt(np.maximum(self.length ** 2 * (1 + 1e-9) - squares, 0.0) * len(rest))
        bound = summed + np.minimum(left, float(self.heaviest[rest].sum()))
        return np.flatnonzero((bound * (1 + 1e-9) + 1 >= least) & (bound > 0))

    def scores(self, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows`` for the terms marked in ``asked``, in 64-bit integers."""
        counts = self.ends[rows + 1] - self.ends[rows]
        total = np.cumsum(counts)
        flat = np.arange(total[-1]) + np.repeat(self.ends[rows] - (total - counts), counts)
        return np.add.reduceat(np.where(asked[self.terms[flat]], self.impacts[flat], 0), total - counts)


def _search(vectors: DataFrame, queries: list[np.ndarray], thresholds: np.ndarray, n_terms: int, top: int) -> DataFrame:
    """``(query, id, score)``: a task's best rows per query among those that can reach the thresholds."""
    schema = T.StructType([T.StructField("query", T.IntegerType()), vectors.schema["id"], T.StructField("score", T.LongType())])
    sent = vectors.sparkSession.sparkContext.broadcast((queries, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_terms, start = sent.value
        least = start.astype(np.float64).copy()
        width = np.sqrt([len(q) for q in asked_terms])
        best: list[list[tuple]] = [[] for _ in asked_terms]
        asked = np.zeros(n_terms, bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(at, BUCKET_ROWS)
                length = part.column(1).to_numpy()
                alive = np.flatnonzero(width * length.max() * (1 + 1e-9) + 1 >= least)
                if not len(alive):
                    continue
                ends, terms = _lists(part.column(2))
                bucket = _Bucket(np.asarray(part.column(0).to_pylist(), object), length, ends, terms, _lists(part.column(3))[1])
                for q in alive:
                    rows = bucket.survivors(asked_terms[q], least[q])
                    if not len(rows):
                        continue
                    asked[asked_terms[q]] = True
                    score = bucket.scores(rows, asked)
                    asked[asked_terms[q]] = False
                    good = score >= max(least[q], 1)
                    if good.any():
                        found = sorted([*best[q], *zip((-score[good]).tolist(), bucket.ids[rows[good]].tolist())], key=lambda x: (x[0], x[1] is not None, x[1]))
                        best[q] = found[:top]
                        if len(best[q]) == top:
                            least[q] = max(least[q], -best[q][-1][0])
        flat = [(q, i, -s) for q, found in enumerate(best) for s, i in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), kinds)], schema.names)

    kinds = (pa.int32(), to_arrow_type(schema["id"].dataType), pa.int64())
    return vectors.mapInArrow(run, schema)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(documents: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", query_col: str = "text", block_bytes: int = BLOCK_BYTES,
           seed_share: float = SEED_SHARE) -> DataFrame:
    """``(item, rank, id, score)``: each query's ``top`` highest-scoring documents with a score above 0.

    Equal scores are ranked by ascending id (a null id first); repeated documents are ranked each by
    itself, and so are repeated queries, whose rows look alike. A null or empty text has no terms: such a
    document is in no result and in no count, such a query has no rows. Empty tables give no rows; texts of
    any length are counted whole; other columns, whatever their names, are not read.
    """
    spark = documents.sparkSession
    out = None
    item = T.StructField("item", queries.schema[item_col].dataType)
    for block in _blocks(queries, item_col, query_col, block_bytes):
        names = {t: i for i, t in enumerate(dict.fromkeys(t for _, terms in block for t in terms), 1)}
        rows = written(_term_rows(documents, id_col, text_col, {t.encode("utf-8", "surrogatepass"): i for t, i in names.items()}))
        n_docs, n_words = rows.agg(F.count("*"), F.sum("n")).first()
        # at most one row per term of the block
        df = dict(rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()) if n_docs else {}
        weights = np.zeros(len(names) + 1, np.int64)
        for term, held in df.items():
            weights[term] = math.floor(UNIT * math.log((2 * n_docs + 2) / (2 * held + 1)))
        # a term without weight adds to no score
        wanted = [np.array(sorted(i for i in (names[t] for t in terms) if weights[i] > 0), np.int64) for _, terms in block]
        if not any(len(w) for w in wanted):
            continue
        vectors = _impacts(rows, weights, n_docs, n_words).filter("length > 0")
        buckets = max(1, math.ceil(n_docs / (8 * BUCKET_ROWS)), spark.sparkContext.defaultParallelism)
        spread = F.xxhash64("id", "terms")
        sorted_rows = (vectors.withColumn("place", spread).repartitionByRange(buckets, F.desc("length"), "place")
                       .sortWithinPartitions(F.desc("length")).drop("place"))
        vectors = written(sorted_rows)
        cut = vectors.agg(F.percentile_approx("length", 1 - seed_share)).first()[0]
        if cut is None:
            continue
        zero = np.zeros(len(wanted), np.int64)
        seeds = written(_best(_search(vectors.filter(F.col("length") >= cut), wanted, zero, len(names) + 1, top), top))
        least = zero.copy()
        # at most one row per query of the block
        for q, score in seeds.filter(F.col("rank") == top).select("query", "score").collect():
            least[q] = score
        width = np.sqrt([len(w) for w in wanted])
        reach = float(np.min(np.where(width > 0, least / np.maximum(width, 1), np.inf))) * (1 - 1e-6) - 1
        rest = _search(vectors.filter((F.col("length") < cut) & (F.col("length") >= reach)), wanted, least, len(names) + 1, top)
        best = _best(seeds.drop("rank").unionByName(rest), top)
        ids = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], T.StructType([T.StructField("query", T.IntegerType()), item]))
        # the block's items: bounded by the block
        part = best.join(F.broadcast(ids), "query").select("item", "rank", "id", "score")
        part = part.withColumnsRenamed({"item": item_col, "id": id_col})
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = T.StructType([T.StructField(item_col, item.dataType), T.StructField("rank", T.IntegerType()),
                             T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], kind)
    return out
