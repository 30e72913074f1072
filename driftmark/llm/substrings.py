"""Substring dedup on a De Bruijn graph of the words.

Nodes are runs of ``SPAN - 1`` words and edges are runs of ``SPAN`` words: an edge is a window. An edge
whose words also start in a document with a smaller id is repeated, and the words it covers are removed
there; windows are judged on the texts as they are, not on what is left.

Only few edges repeat, so two exchanges (see :mod:`blocks`) find them. First each block asks which of
its minimizers, the smallest hash of the ``SEED`` -word runs inside an edge, occur elsewhere: equal edges have
equal minimizers, and an edge with a minimizer of its own is unique. Then it asks for the remaining
edges, by 96 bits of hash, where they occur first. The answers are source coordinates: document and
word. Consecutive edges whose source coordinates advance in step compact into one path; that lock-step
is what verifies a long span. :func:`repeated_paths` joins the paths of all documents on their
sources and cuts them where some occurrence enters or leaves, which leaves the nonbranching paths of
the graph with their multiplicities.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, blocked, part_cuts
from .words import Words, slices, sliding_min

SPAN = 13
SEED = 5
_LAST = np.iinfo(np.int64).max


class _Edges:
    """All complete edges of a block: minimizer, hash, check, document row, id, word position."""

    def __init__(self, table: pa.Table, span: int) -> None:
        ids = table.column("id")
        self.null = ids.combine_chunks().is_null().to_numpy(zero_copy_only=False)
        # a null id is nobody's smaller one: it takes part as the largest and loses nothing
        self.ids = ids.fill_null(_LAST).combine_chunks().cast(pa.int64()).to_numpy(zero_copy_only=False)
        self.counts = np.zeros(len(self.ids), np.int64)
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        seed = min(SEED, span)
        for first, last, data, offsets in slices(table.column("text")):
            words = Words(data, offsets)
            self.counts[first:last] = words.counts
            at = np.flatnonzero(words.complete(span))
            value = words.hashes()
            edge = words.grams(value, span)
            check = (words.grams(words.hashes(1), span, 1)[at] >> np.uint64(32)).astype(np.uint32)
            low = sliding_min(words.grams(value, seed), span - seed + 1)
            row = words.doc[at]
            for column, values in zip(columns, (low[at], edge[at], check, row + first, at - words.first[row])):
                column.append(values)
        kinds = (np.uint64, np.uint64, np.uint32, np.int64, np.int64)
        self.low, self.edge, self.check, self.row, self.at = (
            np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(columns, kinds))
        self.id = self.ids[self.row] if len(self.row) else np.zeros(0, np.int64)

    def keep(self, where: np.ndarray) -> None:
        for name in ("low", "edge", "check", "row", "at", "id"):
            setattr(self, name, getattr(self, name)[where])

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers, whether two ids of this block share them, and the place of each edge's."""
        found, which = np.unique(self.low, return_inverse=True)
        lowest, highest = np.full(len(found), _LAST), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(lowest, which, self.id)
        np.maximum.at(highest, which, self.id)
        return found, lowest < highest, which

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first occurrence, by (id, position), of each distinct edge, and each edge's place among them."""
        order = np.lexsort((self.at, self.id, self.check, self.edge))
        edge, check = self.edge[order], self.check[order]
        new = np.r_[True, (edge[1:] != edge[:-1]) | (check[1:] != check[:-1])] if len(order) else np.zeros(0, bool)
        which = np.zeros(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return order[new], which


def _bits(table: pa.Table, count: int, kind: str) -> np.ndarray:
    """The flags that the parts' answers of one kind hold, in asking order."""
    rows = table.filter(pa.compute.equal(table.column("kind"), kind)).sort_by("part")
    found = [np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool)
             for f, n in zip(rows.column("flags").to_pylist(), rows.column("size").to_pylist())]
    out = np.concatenate(found) if found else np.zeros(0, bool)
    assert len(out) == count, "an answer does not match its question"
    return out


def _asked(edges: _Edges, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keep the edges whose minimizer repeats; distinct edges as in :meth:`_Edges.distinct`."""
    found, here, which = edges.minimizers()
    edges.keep((here | _bits(answers, len(found), "seed"))[which])
    return edges.distinct()


_QUESTION = "part bigint, block bigint, size bigint, keys binary, checks binary, ids binary, places binary"
_ANSWER = "block bigint, part bigint, kind string, size bigint, flags binary, ids binary, places binary"


def _questions(block: int, parts: int, keys: np.ndarray, *more: np.ndarray) -> Iterator[dict]:
    cuts = part_cuts(keys, parts)
    for part in range(parts):
        cut = slice(cuts[part], cuts[part + 1])
        extra = [m[cut].tobytes() for m in more] or [b"", b"", b""]
        if cuts[part] < cuts[part + 1]:
            yield dict(zip(("part", "block", "size", "keys", "checks", "ids", "places"),
                           (part, block, int(cuts[part + 1] - cuts[part]), keys[cut].tobytes(), *extra)))


def _rows(rows: list[dict], like: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in like.split(", "))])
    return pa.Table.from_pylist(rows, schema)


def _gathered(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _split_answers(table: pa.Table, kind: str, flags: np.ndarray, ids: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.Table:
    """One answer per question, in the order of its keys."""
    sizes = table.column("size").to_numpy()
    ends = np.cumsum(sizes)
    out = []
    for block, part, size, end in zip(table.column("block").to_pylist(), table.column("part").to_pylist(), sizes.tolist(), ends.tolist()):
        mine = flags[end - size:end]
        out.append({"block": block, "part": part, "kind": kind, "size": size, "flags": np.packbits(mine).tobytes(),
                    "ids": b"" if ids is None else ids[end - size:end][mine].tobytes(),
                    "places": b"" if places is None else places[end - size:end][mine].astype(np.uint32).tobytes()})
    return _rows(out, _ANSWER)


def _answer_seeds(table: pa.Table) -> pa.Table:
    """A minimizer is flagged if another block asked for it too."""
    _, which, counts = np.unique(_gathered(table, "keys", np.uint64), return_inverse=True, return_counts=True)
    return _split_answers(table, "seed", counts[which] > 1)


def _answer_edges(table: pa.Table) -> pa.Table:
    """An edge is flagged if another block holds it under a smaller id; ids and places tell where it occurs first."""
    keys, checks = _gathered(table, "keys", np.uint64), _gathered(table, "checks", np.uint32)
    ids, places = _gathered(table, "ids", np.int64), _gathered(table, "places", np.uint32)
    order = np.lexsort((places, ids, checks, keys))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])]
    first = np.zeros(len(order), np.int64)
    first[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return _split_answers(table, "edge", ids[first] < ids, ids[first], places[first])


def removals(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN,
             block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept_text, paths) for every row of ``documents``.

    ``kept_text`` joins the words that stay by one blank. ``paths`` lists the compacted repeated paths:
    first word, number of edges, source id, source word. Ids are integers. A null or empty text has no
    words. Rows that repeat an id are judged against smaller ids only, so equal rows keep their text
    alike; a row without an id keeps all its words and is no source. Texts shorter than ``span`` words have
    no edges. Other columns are not read, an empty table gives no rows.
    """
    docs, parts = blocked(documents, id_col, text_col, block_bytes)

    def ask_seeds(table: pa.Table) -> pa.Table:
        found, _, _ = _Edges(table, span).minimizers()
        return _rows(list(_questions(table.column("block")[0].as_py(), parts, found)), _QUESTION)

    def ask_edges(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([], _QUESTION)
        edges = _Edges(table, span)
        first, _ = _asked(edges, answers)
        return _rows(list(_questions(table.column("block")[0].as_py(), parts, edges.edge[first], edges.check[first],
                                     edges.id[first], edges.at[first].astype(np.uint32))), _QUESTION)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"id": table.column("id"), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()),
                             "kept_text": pa.array([], pa.string()), "paths": pa.array([], path_type)})
        edges = _Edges(table, span)
        first, which = _asked(edges, answers)
        flags = _bits(answers, len(first), "edge")
        told = answers.filter(pa.compute.equal(answers.column("kind"), "edge")).sort_by("part")
        source, place = edges.id[first], edges.at[first]
        source[flags], place[flags] = _gathered(told, "ids", np.int64), _gathered(told, "places", np.uint32)
        again = (source[which] < edges.id) & ~edges.null[edges.row]
        row, at, source, place = edges.row[again], edges.at[again], source[which][again], place[which][again]
        order = np.lexsort((at, row))
        row, at, source, place = row[order], at[order], source[order], place[order]
        # compact: next edge of the document, source coordinates in step
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
        heads = np.flatnonzero(new)
        steps = np.diff(np.r_[heads, len(row)])
        lists = np.searchsorted(row[heads], np.arange(len(table) + 1))
        paths = pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(at[heads]), pa.array(steps), pa.array(source[heads]), pa.array(place[heads])], ["start", "edges", "source", "source_start"]))
        ends = np.r_[0, np.cumsum(edges.counts)]
        depth = np.zeros(ends[-1] + 1, np.int64)
        np.add.at(depth, ends[row[heads]] + at[heads], 1)
        np.add.at(depth, ends[row[heads]] + at[heads] + steps + span - 1, -1)
        gone = np.cumsum(depth)[:-1] > 0
        removed = np.diff(np.r_[0, np.cumsum(gone)][ends])
        kept = []
        for i, text in enumerate(table.column("text")):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            if removed[i]:
                mine = gone[ends[i]:ends[i + 1]].tolist()
                words = [w for w, g in zip(words, mine) if not g]
            kept.append(b" ".join(words))
        return pa.table({"id": table.column("id"), "n_words": edges.counts, "n_removed": removed,
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "paths": paths})

    path_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "edges", "source", "source_start")]))
    seeds = docs.groupBy("block").applyInArrow(ask_seeds, _QUESTION).groupBy("part").applyInArrow(_answer_seeds, _ANSWER)
    edges = (docs.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(ask_edges, _QUESTION)
             .groupBy("part").applyInArrow(_answer_edges, _ANSWER))
    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, n_words bigint, n_removed bigint, kept_text string, paths array<struct<start:bigint,edges:bigint,source:bigint,source_start:bigint>>"
    return (docs.groupBy("block").cogroup(seeds.unionByName(edges).groupBy("block")).applyInArrow(cut, out)
            .withColumnRenamed("id", id_col))


def repeated_paths(removed: DataFrame) -> DataFrame:
    """(source, start, edges, copies): the nonbranching repeated paths behind the result of :func:`removals`.

    Paths are joined on their source document; a path is cut wherever an occurrence enters or leaves.
    ``copies`` counts the occurrences apart from the source itself. A source has at most two borders per
    word, whatever the number of its copies. Documents without repeated paths, as null and empty texts are, add nothing;
    repeated rows count as often as they are given, no rows give none.
    """
    paths = removed.select(F.explode("paths").alias("p")).select("p.*")
    borders = paths.select("source", F.explode(F.array(
        F.struct(F.col("source_start").alias("start"), F.lit(1).alias("step")),
        F.struct((F.col("source_start") + F.col("edges")).alias("start"), F.lit(-1).alias("step")))).alias("b")).select("source", "b.*")
    sums = borders.groupBy("source", "start").agg(F.sum("step").alias("step"), F.sum(F.greatest("step", F.lit(0))).alias("entered"))
    order = W.partitionBy("source").orderBy("start")
    return (sums.withColumn("copies", F.sum("step").over(order)).withColumn("edges", F.lead("start").over(order) - F.col("start"))
            .filter("copies > 0").select("source", "start", "edges", "copies"))
