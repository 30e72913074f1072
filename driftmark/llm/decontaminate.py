"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words: A-Z lower-cased, then runs of characters other than ASCII control, blank and
punctuation. Of the k-gram hashes in every run of ``WINDOW`` words only the smallest is kept, so any
run of that many words shared by a document and an item leaves them a fingerprint in common. Matching
fingerprints are then extended: the windows around a match are compared word by word, and the words of
a window that an item really holds are hit. An item of fewer words is one window and is fingerprinted
whole.

Fingerprints of a document are distinct before they are joined, so a passage that a third of all
documents share costs one row per document. The benchmark side is broadcast only after a count shows
that its fixed-width rows stay below ``BROADCAST_ROWS``; beyond it both sides are shuffled.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

WINDOW = 10
GRAM = 4
BROADCAST_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ASCII characters that are neither digits nor letters, as blanks
_OUTSIDE = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    plain = F.translate(text, _UPPER + _OUTSIDE, _UPPER.lower() + " " * len(_OUTSIDE))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _gram(length: int) -> int:
    """Gram size for windows of ``length`` words: shorter windows than the usual are one gram."""
    return GRAM if length == WINDOW else length


def _grams(hashes: Column, length: int) -> Column:
    """Hashes of all grams for windows of ``length`` words, in order; empty where the text is shorter."""
    size = _gram(length)
    each = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(
        F.lit(length), *[F.get(hashes, i + j) for j in range(size)]))
    return F.when(F.size(hashes) >= length, each).otherwise(F.array().cast("array<bigint>"))


def _winnow(grams: Column, length: int) -> Column:
    """The smallest hash of every window of grams, distinct."""
    width = length - _gram(length) + 1
    if width == 1:
        return F.array_distinct(grams)
    return F.when(F.size(grams) >= width, F.array_distinct(_sliding_min(grams, width))).otherwise(F.array().cast("array<bigint>"))


def _sliding_min(values: Column, width: int) -> Column:
    """Smallest of every ``width`` neighbours, by doubling: three passes for a width of seven."""
    def halved(step: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(F.sequence(F.lit(0), F.size(a) - 1 - step), lambda i: F.least(F.get(a, i), F.get(a, i + step)))

    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = let(values, halved(step)), have + step
    return values


def fingerprints(words_: Column, lengths: list[int]) -> Column:
    """Winnowed fingerprints of an array of words for each window length."""
    def kept(hashes: Column, length: int) -> Column:
        return let(_grams(hashes, length), lambda grams: _winnow(grams, length))

    return let(F.transform(words_, lambda w: F.xxhash64(w)), lambda hashes: F.concat(*[kept(hashes, n) for n in lengths]))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast a narrow table whose row count is within the bound; else both sides are shuffled, as exploded ones are sized too low."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def _starts(words_: Column, found: Column, length: Column, lengths: list[int]) -> Column:
    """Starts of the windows around the matches in ``found`` (sorted out by window length)."""
    def around(n: int) -> Column:
        reach = n - _gram(n)
        hits = let(F.transform(words_, lambda w: F.xxhash64(w)), lambda hashes: let(_grams(hashes, n), lambda grams: F.filter(
            F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(found, F.get(grams, i)))))
        return F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(
            F.greatest(i - reach, F.lit(0)), F.least(i, F.size(words_) - n)))))
    out = F.array().cast("array<int>")
    for n in lengths:
        out = F.when((length == n) & (F.size(words_) >= n), around(n)).otherwise(out)
    return out


def _window(words_: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words_, start + 1, length), " ")


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their counts, hits): see :func:`decontamination`.

    ``hits`` has the columns id, text_hash, item, start, length: windows of a document, in words, that
    an item holds.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col).cast("string")).alias("words")).filter("size(words) > 0")
    # at most WINDOW lengths; the usual one is always there
    lengths = sorted({WINDOW} | {r[0] for r in items.select(F.least(F.size("words"), F.lit(WINDOW))).distinct().collect()})
    length = F.least(F.size("words"), F.lit(WINDOW))
    windows = written(items.select("item", "words", length.alias("length")).select("item", "length", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size("words") - F.col("length")), lambda i: _window(F.col("words"), i, F.col("length"))))).alias("window")))
    marks = items.select(length.alias("length"), fingerprints(F.col("words"), lengths).alias("prints"))
    marks = _bounded(marks.select("length", F.explode("prints").alias("print")).distinct())

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = source.withColumn("text_hash", F.xxhash64("text"))
    prints = written(keyed.select("id", "text_hash", let(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), fingerprints(w, lengths).alias("prints"))).alias("t")).select("id", "text_hash", "t.*"))
    matches = (prints.select("id", "text_hash", F.explode("prints").alias("print")).join(marks, "print")
               .groupBy("id", "text_hash", "length").agg(F.collect_set("print").alias("found")))
    matched = matches.withColumnsRenamed({"id": "m_id", "text_hash": "m_hash"})
    starts = (keyed.join(matched, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")))
              .select("id", "text_hash", "length", "found", words(F.col("text")).alias("words"))
              .select("id", "text_hash", "length", "words", F.explode(_starts(F.col("words"), F.col("found"), F.col("length"), lengths)).alias("start"))
              .select("id", "text_hash", "length", "start", _window(F.col("words"), F.col("start"), F.col("length")).alias("window")))
    hits = starts.join(windows, ["length", "window"]).select("id", "text_hash", "item", "start", "length").distinct()
    return prints.select("id", "text_hash", "n_words"), hits


def decontamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) for every row of ``documents``.

    ``items`` lists the ids of the items with a window in the document as strings, sorted. A null or empty text has no
    words. Repeated rows and ids, null ids too, get a row each, judged by their own text. Other columns are
    not read. An item without words, or an empty benchmark, hits nothing; no documents give no rows.
    """
    counted, hits = contaminated(documents, benchmark, id_col, text_col, item_col, item_text_col)
    hits = written(hits)
    covered = (hits.select("id", "text_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at"))
               .distinct().groupBy("id", "text_hash").agg(F.count("*").alias("n_hit")))
    named = (hits.select("id", "text_hash", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("item")).alias("items")))
    rename = {"id": "r_id", "text_hash": "r_hash"}
    found = covered.withColumnsRenamed(rename).join(named, F.col("r_id").eqNullSafe(F.col("id")) & (F.col("r_hash") == F.col("text_hash"))).select("r_id", "r_hash", "n_hit", "items")
    none = F.array().cast("array<string>")
    return (counted.join(found, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
            .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                    F.coalesce("items", none).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that hold no window of an item, with all their columns.

    Null and empty texts have no words and stay, as do repeated rows and null ids, each by its own text; without items all
    rows stay, an empty table gives no rows.
    """
    _, hits = contaminated(documents, benchmark, id_col, text_col)
    hits = hits.select(F.col("id").alias("h_id"), F.col("text_hash").alias("h_hash")).distinct()
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col(id_col).alias("id"),
                            F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"))
    return rows.join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left_anti").select("row.*")
