"""Quality rules: plain text statistics and tokenizer fertility.

A public SentencePiece vocabulary is run over the words of each text. Text of one language yields a
steady number of characters per token, few byte-fallback tokens and a broad mix of tokens; random letters,
encoded data, punctuation and encodings gone wrong do not. What is steady depends on the language, the register
and the vocabulary, so the bands are measured: :func:`bands` takes the 10th, 50th and 90th percentile of each measure
per language, and per main script of the letters for languages too rare to have their own, over all documents
that pass the plain rules. A band reaches from the median to ``TIMES`` times the distance of the outer
percentile, and at least the share of the median that ``LEAST_WIDTH`` names. Up to a tenth of a
language may be noise without moving its band. Where the script is rare as well, the wide bands of
``LANGUAGES`` and ``SCRIPTS`` hold.

Percentiles come from counts per bin (bounded in number), so they are exact to the bin, the same for every
layout, and a hot language costs one row per bin and task. Documents with equal statistics, as all
copies have, count once. The measured rows are written once; the bands are joined to them.

Work is done per slice of an Arrow batch: every distinct word of a slice is tokenized once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from .storage import written
from .words import Words, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MIN_WORDS = 50
REPEAT_PERCENT = 50
_MIX = 1024
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))
#: A band reaches so many times the distance of the outer percentile from the median.
TIMES = 4.0
#: Least reach of a band below and above the median, as a share of the median.
LEAST_WIDTH = (0.22, 1.5)
ENTROPY_WIDTH = 0.25
#: Least byte-fallback share that is accepted everywhere.
BYTE_SHARE = 0.05
#: Different documents from which a language or script has a band of its own.
MIN_DOCUMENTS = 100
#: Bands where there are fewer: fewest and most characters per token, most byte fallback, least relative entropy.
LANGUAGES = {"en": (1.2, 6.0, 0.10, 0.35), "de": (1.2, 5.5, 0.10, 0.35), "fr": (1.1, 5.5, 0.10, 0.35), "es": (1.1, 5.5, 0.10, 0.35)}
SCRIPTS = {"latin": (1.0, 6.5, 0.15, 0.35), "cyrillic": (0.9, 5.0, 0.20, 0.35), "other": (0.25, 4.0, 0.95, 0.30)}
# Bins per unit; characters per token beyond _LONGEST share a bin.
_BINS = {"chars": 200, "share": 1000, "entropy": 1000}
_LONGEST = 64

_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offsets])


def _repeated_lines(words: Words) -> np.ndarray:
    """Lines that hold a word and equal an earlier line of their document."""
    data, offsets = words.data, words.offsets
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([breaks, breaks + 1, offsets]))
    edges = edges[edges <= len(data)]
    lines = Words.__new__(Words)
    lines.data = data
    lines.start, lines.end = edges[:-1], edges[1:]
    keep = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    lines.start, lines.end = lines.start[keep], lines.end[keep]
    row = np.searchsorted(offsets, lines.start, side="right") - 1
    value = lines.hashes()
    order = np.lexsort((value, row))
    same = (value[order][1:] == value[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][same], minlength=words.rows)


def _repeated_words(words: Words, values: np.ndarray, size: int = 3) -> np.ndarray:
    """Words inside a window of ``size`` words that their document holds twice or more."""
    covered = np.zeros(len(values), bool)
    at = np.flatnonzero(words.complete(size))
    if len(at):
        gram, row = words.grams(values, size)[at], words.doc[at]
        order = np.lexsort((gram, row))
        same = (gram[order][1:] == gram[order][:-1]) & (row[order][1:] == row[order][:-1])
        again = at[order[np.r_[same, False] | np.r_[False, same]]]
        for step in range(size):
            covered[again + step] = True
    return _per_row(covered, words.first)


def _relative_entropy(row: np.ndarray, token: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Shannon entropy of each row's tokens over that of as many different tokens; 1 below two tokens.

    From ``_MIX`` tokens on the comparison stays the same: a long text repeats its language's tokens.
    """
    rows = len(tokens)
    pair, count = np.unique(row.astype(np.int64) << 32 | token, return_counts=True)
    spent = np.bincount(pair >> 32, weights=count * np.log2(count), minlength=rows)
    most = np.log2(np.clip(tokens, 2, _MIX))
    return np.where(tokens < 2, 1.0, (np.log2(np.maximum(tokens, 1)) - spent / np.maximum(tokens, 1)) / most)


class _Tokens:
    """Token ids of words under one vocabulary file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def lists(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids behind each other, and the count per word."""
        found = self.model.encode(words, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int64, int(counts.sum())), counts


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start+1, … of all ranges behind each other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _measure(data: np.ndarray, offsets: np.ndarray, tokens: _Tokens) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    values = words.hashes()
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    out = {"n_words": words.counts, "word_chars": _per_row(heads[words.end] - heads[words.start], words.first),
           "n_symbols": _per_row(_SYMBOLS[data], offsets), "n_dup_lines": _repeated_lines(words),
           "n_repeat_words": _repeated_words(words, values)}
    _, first, which = np.unique(values, return_index=True, return_inverse=True)
    text = data.tobytes()
    ids, counts = tokens.lists([text[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first].tolist(), words.end[first].tolist())])
    each = counts[which]
    byte = _per_row(tokens.is_byte[ids], np.r_[0, np.cumsum(counts)])
    out["n_tokens"] = _per_row(each, words.first)
    out["n_byte_tokens"] = _per_row(byte[which], words.first)
    spread = ids[_ranges((np.cumsum(counts) - counts)[which], each)]
    out["entropy"] = _relative_entropy(np.repeat(words.doc, each), spread, out["n_tokens"])
    lead = data >> 4
    letters = {"latin": (data < 0x80) & ((data & 0xDF) >= 65) & ((data & 0xDF) <= 90) | (data >= 0xC3) & (data <= 0xCA),
               "cyrillic": (data >= 0xD0) & (data <= 0xD3), "other": (data >= 0xCE) & (lead >= 0xC) & ~((data >= 0xD0) & (data <= 0xD3))}
    tally = np.stack([_per_row(letters[name], offsets) for name in SCRIPTS])
    out["script"] = np.argmax(tally, axis=0)
    return out


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens",
              "chars_per_token", "byte_share", "entropy", "script", "reason")


def _measured(documents: DataFrame, text_col: str, lang_col: str | None, vocabulary: str) -> DataFrame:
    """``documents`` as ``c0``, ``c1``, … with what is measured, ``base_failed`` and the ``language``."""
    source = documents.toDF(*[f"c{i}" for i in range(len(documents.columns))])
    text_at = documents.columns.index(text_col)
    lang = F.col(f"c{documents.columns.index(lang_col)}").cast("string") if lang_col else F.lit(None).cast("string")
    if dict(source.dtypes)[f"c{text_at}"] != "string":
        source = source.withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    schema = T.StructType([*source.schema.fields, *[T.StructField(c, T.LongType()) for c in _COLUMNS],
                           T.StructField("entropy", T.DoubleType()), T.StructField("script", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, names = _Tokens(vocabulary), list(SCRIPTS)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(text_at)):
                found = _measure(data, offsets, tokens)
                columns = batch.slice(first, last - first).columns
                columns += [pa.array(found[c].astype(np.int64)) for c in _COLUMNS]
                columns += [pa.array(found["entropy"]), pa.array([names[i] for i in found["script"]], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    tokens = F.greatest("n_tokens", F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return source.mapInArrow(run, schema).withColumns({
        "base_failed": failed, "chars_per_token": F.col("word_chars") / tokens, "byte_share": F.col("n_byte_tokens") / tokens,
        "language": F.lower(F.trim(lang))})


def bands(measured: DataFrame) -> DataFrame:
    """(by, name, documents, fewest_chars, most_chars, most_bytes, least_entropy) per language and per script.

    ``measured`` has the ``STATISTICS`` and a ``language``; rows that fail the plain rules do not count, rows with equal
    statistics count once. A null language has no band, a language or script below ``MIN_DOCUMENTS`` none of
    its own; an empty table gives no rows.
    """
    seen = measured.filter(~F.col("base_failed")).select(
        "language", "script", "n_words", "word_chars", "n_tokens", "n_byte_tokens", "n_repeat_words",
        F.least("chars_per_token", F.lit(_LONGEST)).alias("chars"), F.col("byte_share").alias("share"), "entropy").distinct()
    group = F.explode(F.array(F.struct(F.lit("language").alias("by"), F.col("language").alias("name")),
                              F.struct(F.lit("script").alias("by"), F.col("script").alias("name"))))
    bins = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) * n).alias("bin")) for m, n in _BINS.items()]))
    counts = (seen.select(group.alias("g"), *_BINS).select("g.*", bins.alias("m")).filter("name is not null")
              .groupBy("by", "name", "m.measure", "m.bin").agg(F.count("*").alias("n")))
    line = Window.partitionBy("by", "name", "measure")
    ranked = counts.select("*", F.sum("n").over(line.orderBy("bin")).alias("up_to"), F.sum("n").over(line).alias("documents"))

    def at(measure: str, tenths: int) -> F.Column:
        reached = (F.col("measure") == measure) & (10 * F.col("up_to") >= tenths * F.col("documents"))
        return F.min(F.when(reached, F.col("bin"))) / _BINS[measure]

    found = ranked.groupBy("by", "name").agg(F.max("documents").alias("documents"), *[
        at(m, t).alias(f"{m}{t}") for m in _BINS for t in (1, 5, 9)])
    below, above = (F.greatest(TIMES * (F.col("chars5") - F.col("chars1")), LEAST_WIDTH[0] * F.col("chars5")),
                    F.greatest(TIMES * (F.col("chars9") - F.col("chars5")), LEAST_WIDTH[1] * F.col("chars5")))
    loss = F.greatest(TIMES * (F.col("entropy5") - F.col("entropy1")), ENTROPY_WIDTH * F.col("entropy5"))
    return found.filter(F.col("documents") >= MIN_DOCUMENTS).select(
        "by", "name", "documents", (F.col("chars5") - below).alias("fewest_chars"), (F.col("chars5") + above).alias("most_chars"),
        (F.col("share5") + F.greatest(TIMES * (F.col("share9") - F.col("share5")), F.lit(BYTE_SHARE))).alias("most_bytes"),
        (F.col("entropy5") - loss).alias("least_entropy"))


_LIMITS = ("fewest_chars", "most_chars", "most_bytes", "least_entropy")


def _verdicts(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``reason``: the language's band where it has one, else the script's, else a wide one."""
    for by, key in (("language", "language"), ("script", "script")):
        side = limits.filter(F.col("by") == by).select(F.col("name").alias(f"{by}_name"), *[F.col(c).alias(f"{by}_{c}") for c in _LIMITS])
        measured = measured.join(side, F.col(key) == F.col(f"{by}_name"), "left")
    wide = {by: {c: F.create_map(*[F.lit(x) for name, band in known.items() for x in (name, band[i])])[F.col(by)] for i, c in enumerate(_LIMITS)}
            for by, known in (("language", LANGUAGES), ("script", SCRIPTS))}
    limit = {c: F.coalesce(f"language_{c}", f"script_{c}", wide["language"][c], wide["script"][c]) for c in _LIMITS}
    return measured.withColumn("reason", (
        F.when(F.col("n_words") < MIN_WORDS, "few words").when(F.col("base_failed"), "repeated words")
        .when(F.col("chars_per_token") < limit["fewest_chars"], "short tokens").when(F.col("chars_per_token") > limit["most_chars"], "long tokens")
        .when(F.col("byte_share") > limit["most_bytes"], "byte fallback").when(F.col("entropy") < limit["least_entropy"], "low entropy")))


def judged(documents: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY,
           limits: DataFrame | None = None) -> DataFrame:
    """``documents`` as ``c0``, ``c1``, … in their order, whatever their names, with the ``STATISTICS`` behind them.

    ``base_failed`` tells of the plain rules, ``kept`` of all, ``reason`` why not (null when kept). ``limits``
    are the :func:`bands` of another corpus; without them the documents' own are measured. A null
    or empty text has no words, fails the base rules and is not kept. A null or rare language is
    judged by script. Repeated rows are judged each by itself, an empty table gives no rows, long texts
    are read whole.
    """
    found = written(_measured(documents, text_col, lang_col, vocabulary))
    limits = written(bands(found)) if limits is None else limits
    return _verdicts(found, limits).select(*[f"c{i}" for i in range(len(documents.columns))], *_COLUMNS[:5], "base_failed",
                                           F.col("reason").isNull().alias("kept"), *STATISTICS[7:])


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
            vocabulary: str = VOCABULARY, limits: DataFrame | None = None) -> DataFrame:
    """The id and the ``STATISTICS`` of every row; other columns are not read, texts are not written. See :func:`judged`."""
    wanted = [c for c in dict.fromkeys([id_col, text_col, lang_col]) if c]
    found = _measured(documents.select(*wanted), text_col, lang_col, vocabulary)
    found = written(found.select(F.col(f"c{wanted.index(id_col)}").alias("id"), *found.columns[len(wanted):]))
    limits = written(bands(found)) if limits is None else limits
    return _verdicts(found, limits).select(F.col("id").alias(id_col), *_COLUMNS[:5], "base_failed",
                                           F.col("reason").isNull().alias("kept"), *STATISTICS[7:])


def keep_good(documents: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY,
              limits: DataFrame | None = None) -> DataFrame:
    """The rows of ``documents`` that the rules keep, with all their columns.

    Rows that pass the plain rules are written once with their statistics; no text is shuffled. See :func:`judged`.
    """
    found = written(_measured(documents, text_col, lang_col, vocabulary).filter("not base_failed"))
    limits = written(bands(found)) if limits is None else limits
    return _verdicts(found, limits).filter("reason is null").select(
        *[F.col(f"c{i}") for i in range(len(documents.columns))]).toDF(*documents.columns)
