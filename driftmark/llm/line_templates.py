"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line falls to a leaf by its token count and then by its first ``DEPTH`` tokens; a token with a digit
is a variable field from the start, unless the line has no other. Every line with a token is judged; one without
blanks is taken by characters where its script sets no blanks. Within a leaf, a position whose tokens have no majority is a
variable field as well; the majority tokens of the others are the leaf's template. A line follows the
template if enough of its tokens, fields left out, agree with it. A generalised line that recurs as it is is a
template of its own, so a leaf may have several. Lines whose template recurs across documents are dropped.

Copies of a document must not make all its lines look like boilerplate. So every line has a sketch of its
document without the line's own leaf: the smallest of the other leaves under ``SKETCH`` orders. Copies and
near copies agree in most of it, documents that share less than half their lines in few. A template recurs
if its lines come from ``MIN_DOCUMENTS`` documents of which no two agree in more than ``ALIKE`` orders,
however many copies of them there are.

A first pass keeps one number per line. Only lines of recurring leaves are fetched and taken apart.
Leaves are counted by partial aggregation, and the joins on them are plain inner joins that adaptive
execution splits, so a line found in a third of all documents is no burden to one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import let
from .storage import written

DEPTH = 3
MIN_DOCUMENTS = 5
SKETCH = 32
# Sketches that agree in more places are of copies or near copies.
ALIKE = 14
# Parts in which the documents of a leaf are compared before what is left of the parts is.
_PARTS = 256
AGREEMENT = 0.7
FIELD = "<*>"
# Thai, Lao, Khmer, kana, Chinese characters and the like
_UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]"
_BLANKS = "\t\n\x0b\x0c\r"


def _tokens(line: Column) -> Column:
    """The tokens between blanks; the characters of a line without blanks in a script that sets none."""
    def parted(tokens: Column) -> Column:
        return F.when((F.size(tokens) == 1) & tokens[0].rlike(_UNSPACED), F.split(tokens[0], "")).otherwise(tokens)

    return let(F.array_remove(F.split(F.translate(line, _BLANKS, " " * len(_BLANKS)), " "), ""), parted)


def _field(token: Column) -> Column:
    """A token, or the field mark if it holds a digit."""
    return F.when(F.translate(token, "0123456789", "") == token, token).otherwise(F.lit(FIELD))


def _general(tokens: Column) -> Column:
    """Tokens with their fields marked; a line of nothing but fields keeps its tokens."""
    return let(F.transform(tokens, _field), lambda g: F.when(F.forall(g, lambda t: t == FIELD), tokens).otherwise(g))


def _leaf(line: Column) -> Column:
    """The leaf of a line as a hash, for up to ``DEPTH`` tokens the line's own; null for a line without tokens."""
    def named(t: Column) -> Column:
        first = F.when(F.size(t) > DEPTH, F.transform(F.slice(t, 1, DEPTH), _field)).otherwise(_general(t))
        return F.when(F.size(t) > 0, let(first, lambda g: F.xxhash64(F.size(t), *[F.get(g, F.lit(i)) for i in range(DEPTH)])))

    return let(_tokens(line), named)


def _lows(leaves: Column) -> Column:
    """The two smallest leaves of a document in every order, as the order's values; null where there are fewer."""
    def low(order: int) -> Column:
        return let(F.transform(leaves, lambda leaf: F.xxhash64(leaf, F.lit(order))), lambda v: let(F.array_min(v), lambda first: F.struct(
            first.alias("one"), F.array_min(F.filter(v, lambda x: x != first)).alias("two"))))

    return F.array(*[low(order) for order in range(SKETCH)])


def _sketch(lows: Column, leaf: Column) -> Column:
    """The sketch of a line of this leaf; -1 where its document has no other leaf."""
    each = [F.when(lows[j]["one"] == F.xxhash64(leaf, F.lit(j)), lows[j]["two"]).otherwise(lows[j]["one"]) for j in range(SKETCH)]
    return F.array(*[F.coalesce(v.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), F.lit(-1)) for v in each])


def _apart(sketches: Column) -> Column:
    """Up to ``MIN_DOCUMENTS`` sketches, in sorting order, of which no two are alike."""
    def alike(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) > ALIKE

    return F.aggregate(F.array_sort(sketches), F.array().cast("array<array<int>>"), lambda kept, s: F.when(
        (F.size(kept) >= MIN_DOCUMENTS) | F.exists(kept, lambda k: alike(k, s)), kept).otherwise(F.concat(kept, F.array(s))))


def _recurring(rows: DataFrame, *names: str) -> DataFrame:
    """The ``names`` of (names, sketch) rows that recur across independent documents.

    They are written out, so that the lines that join them meet a plain table and a hot leaf can be split.
    """
    part = F.pmod(F.xxhash64("sketch"), F.lit(_PARTS)).alias("part")
    parts = rows.select(*names, "sketch").distinct().groupBy(*names, part).agg(_apart(F.collect_list("sketch")).alias("apart"))
    return written(parts.groupBy(*names).agg(_apart(F.flatten(F.collect_list("apart"))).alias("apart"))
                   .filter(F.size("apart") >= MIN_DOCUMENTS).select(*names))


def recurring_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, lines): for documents with any, the numbers of the lines whose template recurs.

    Null texts, empty texts and lines without a token have none. Rows alike in id and text give one row, a null id is one
    like any other; other columns are not read, an empty table gives no rows.
    """
    keyed = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    keyed = keyed.withColumn("text_hash", F.xxhash64("text"))
    leaves = written(keyed.select("id", "text_hash", F.transform(F.split("text", "\n"), _leaf).alias("leaves")))
    lines = leaves.select("id", "text_hash", F.posexplode("leaves").alias("line", "leaf")).filter("leaf is not null")
    # leaves of few documents, copies or not, need no sketches
    often = written(leaves.distinct().select(F.explode(F.array_distinct("leaves")).alias("leaf")).filter("leaf is not null")
                    .groupBy("leaf").agg(F.count("*").alias("documents")).filter(F.col("documents") >= MIN_DOCUMENTS).select("leaf"))
    found = lines.join(often, "leaf").groupBy("id", "text_hash").agg(F.collect_set(F.struct("line", "leaf")).alias("found"))
    others = leaves.distinct().select(F.col("id").alias("l_id"), F.col("text_hash").alias("l_hash"), "leaves")
    same = F.col("id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash"))
    # the lows, far larger than Spark sizes them, are made behind the join, so that no side brings them along
    lows = _lows(F.array_distinct(F.array_compact("leaves"))).alias("lows")
    lines = written(found.join(others, same).select("id", "text_hash", lows, "found").select("id", "text_hash", "lows", F.inline("found"))
                    .select("id", "text_hash", "line", "leaf", _sketch(F.col("lows"), F.col("leaf")).alias("sketch")))
    wanted = (lines.join(_recurring(lines, "leaf"), "leaf").groupBy("id", "text_hash")
              .agg(F.collect_set(F.struct("line", "leaf", "sketch")).alias("found"))
              .withColumnsRenamed({"id": "f_id", "text_hash": "f_hash"}))
    key = F.col("id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash"))
    parted = (keyed.join(wanted, key).select("id", "text_hash", F.split("text", "\n").alias("all"), "found")
              .select("id", "text_hash", F.explode(F.transform("found", lambda f: F.struct(
                  f["line"].alias("line"), f["leaf"].alias("leaf"), f["sketch"].alias("sketch"),
                  _general(_tokens(F.get("all", f["line"]))).alias("tokens")))).alias("f"))
              .select("id", "text_hash", "f.*").distinct())
    parted = written(parted)
    # the same line in copies of a document votes once
    votes = parted.select("leaf", "sketch", "tokens").distinct().select("leaf", F.posexplode("tokens").alias("at", "token"))
    votes = votes.groupBy("leaf", "at", "token").agg(F.count("*").alias("votes"))
    fixed = votes.groupBy("leaf", "at").agg(
        F.max(F.struct("votes", "token")).alias("top"), F.sum("votes").alias("all"))
    token = F.when(2 * F.col("top.votes") > F.col("all"), F.col("top.token")).otherwise(FIELD)
    templates = written(fixed.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", token.alias("token")))).alias("template")))
    words_ = F.size(F.filter("tokens", lambda t: t != FIELD))
    agreeing = F.size(F.filter(F.zip_with("tokens", "template", lambda a, b: (a == b["token"]) & (a != FIELD)), lambda same: same))
    matched = written(parted.join(templates, "leaf").filter(agreeing >= AGREEMENT * words_).select("id", "text_hash", "line", "leaf", "sketch"))
    by_leaf = matched.join(_recurring(matched, "leaf"), "leaf").select("id", "text_hash", "line")
    # generalised lines that recur as they are; lines of their leaf follow the one they agree with
    kinds = written(parted.withColumn("kind", F.xxhash64("tokens")))
    exact = _recurring(kinds, "leaf", "kind")
    forms = kinds.select("leaf", "kind", "tokens").distinct()
    own = forms.join(exact, ["leaf", "kind"]).groupBy("leaf").agg(F.collect_set("tokens").alias("templates"))

    def follows(template: Column) -> Column:
        return F.size(F.filter(F.zip_with("tokens", template, lambda a, b: (a == b) & (a != FIELD)), lambda same: same)) >= AGREEMENT * words_

    told = written(forms.join(own, "leaf").filter(F.exists("templates", follows)).select("leaf", "kind"))
    by_line = kinds.join(told, ["leaf", "kind"]).select("id", "text_hash", "line")
    return by_leaf.unionByName(by_line).groupBy("id", "text_hash").agg(F.collect_set("line").alias("lines"))


def drop_recurring_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with recurring lines dropped from the text, plus n_lines and n_dropped.

    All columns stay, in order and under any name; lines are split at line feeds and joined by them
    again. A null text stays null and has no lines; an empty text is one empty line. A document may lose
    all its lines and then has the empty text. Repeated rows and ids, null ids too, are kept and treated by their own text. An
    empty table gives no rows.
    """
    drops = recurring_lines(documents, id_col, text_col).withColumnsRenamed({"id": "_d_id", "text_hash": "_d_hash"})
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
                           F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    joined = row.withColumn("_hash", F.xxhash64("_text")).join(
        drops, F.col("_id").eqNullSafe(F.col("_d_id")) & (F.col("_hash") == F.col("_d_hash")), "left")
    cut = joined.select("_row", "_text", F.split("_text", "\n").alias("_lines"),
                        F.coalesce("lines", F.array().cast("array<int>")).alias("_drops"))
    kept = F.filter("_lines", lambda line, i: ~F.array_contains(F.col("_drops"), i))
    text = F.when(F.size("_drops") > 0, F.array_join(kept, "\n")).otherwise(F.col("_text"))
    columns = [(text if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in documents.columns]
    return cut.select(*columns, F.coalesce(F.size("_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
                      F.size("_drops").cast("bigint").alias("n_dropped"))
