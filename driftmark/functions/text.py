"""Text columns: dictionary tone, identity masking, page text and volume."""
from __future__ import annotations

from collections.abc import Sequence
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token shape, negating words and how far back they reach.
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
NEGATORS = ("NO", "NOT", "NONE", "NEITHER", "NEVER", "NOBODY")
NEGATION_REACH = 3

# What the masking looks for and what it writes.
LEGAL_SUFFIX_AT_END = r"\b(Inc|Corp|Corporation|Company|Co|plc|Holdings)\.?$"
LEGAL_SUFFIX_AFTER = r"(?:,? (?:Inc|Corp|Corporation|Company|Co|plc)\.?)?"
MONTH = (r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?"
         r"|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\.?")
FULL_DATE = rf"\b{MONTH}\s+\d{{1,2}},?\s+(?:19|20)\d{{2}}\b"
YEAR = r"\b(?:19|20)\d{2}\b"
FISCAL_YEAR = r"\b(?:fiscal|FY)\s?'?\d{2}\b"

# A character reference in a page; numbers that pages write for Windows characters.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
WINDOWS = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))


def tokens(text: Column) -> Column:
    """Upper-case words in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), F.upper)


def _negated(words: Column, i: Column) -> Column:
    """Whether one of the words just before position ``i`` negates."""
    before = F.slice(words, F.greatest(i - (NEGATION_REACH - 1), F.lit(1)), F.least(i, F.lit(NEGATION_REACH)))
    return F.exists(before, lambda w: w.isin(*NEGATORS))


def _tone_columns(pos: Column, neg: Column, words: Column, prefix: str) -> list[Column]:
    return [F.when(pos + neg > 0, (pos - neg) / (pos + neg)).otherwise(0.0).alias(prefix),
            pos.alias(f"{prefix}_pos"), neg.alias(f"{prefix}_neg"), words.alias(f"{prefix}_words")]


def word_tone(docs: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str],
              keep: Sequence[str], prefix: str = "lm") -> DataFrame:
    """Net tone (p - n) / (p + n), counts of both and of all words, without a shuffle.

    A positive word with a negator among the three words before it counts as negative. A word on
    both lists is positive first.
    """
    pos, neg = [w.upper() for w in positive], [w.upper() for w in negative]

    def mark(word: Column, i: Column) -> Column:
        return (F.when(word.isin(pos), F.when(_negated(F.col("words"), i), -1).otherwise(1))
                .when(word.isin(neg), -1).otherwise(0))

    marked = (docs.select(*keep, tokens(F.col(text)).alias("words"))
              .withColumn("marks", F.transform("words", mark)))
    return (marked.select(*keep, F.size(F.filter("marks", lambda m: m == 1)).alias("p"),
                          F.size(F.filter("marks", lambda m: m == -1)).alias("n"), F.size("words").alias("w"))
            .select(*keep, *_tone_columns(F.col("p"), F.col("n"), F.col("w"), prefix)))


def word_tone_joined(docs: DataFrame, text: str, lexicon: DataFrame, key: str, prefix: str = "lm") -> DataFrame:
    """The same with a dictionary frame of any size: ``lexicon`` is (word, positive, negative), ``key`` unique.

    Words are exploded with their negation flag and joined; the counts of a document combine on
    the map side before the shuffle.
    """
    words = docs.select(key, tokens(F.col(text)).alias("words"))
    flagged = F.transform("words", lambda w, i: F.struct(w.alias("word"), _negated(F.col("words"), i).alias("negated")))
    lists = lexicon.groupBy(F.upper("word").alias("word")).agg(
        F.max(F.col("positive")).alias("positive"), F.max(F.col("negative")).alias("negative"))
    every = words.select(key, F.explode_outer(flagged).alias("t")).select(key, "t.*").join(lists, "word", "left")
    positive, negative = F.coalesce("positive", F.lit(False)), F.coalesce("negative", F.lit(False))
    good, bad = positive & ~F.col("negated"), (positive & F.col("negated")) | (~positive & negative)
    counts = every.groupBy(key).agg(F.count_if(good).cast("int").alias("p"), F.count_if(bad).cast("int").alias("n"),
                                    F.count("word").cast("int").alias("w"))
    return counts.select(key, *_tone_columns(F.col("p"), F.col("n"), F.col("w"), prefix))


def quoted(text: Column) -> Column:
    """A regex that matches ``text`` literally."""
    inner = F.replace(text, F.lit(r"\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(r"\Q"), inner, F.lit(r"\E"))


def mask_identity(text: Column, ticker: Column, name: Column) -> Column:
    """Hide company, ticker and calendar clues, in that order.

    The full name goes first, then the name without its legal suffix, each with an optional legal
    suffix behind it and only if longer than two characters.
    """
    core = F.trim(F.regexp_replace(name, LEGAL_SUFFIX_AT_END, ""))
    for shown in (name, core):
        pattern = F.concat(F.lit("(?iU)"), quoted(shown), F.lit(LEGAL_SUFFIX_AFTER))
        text = F.when(F.length(shown) > 2, F.regexp_replace(text, pattern, F.lit("the Company"))).otherwise(text)
    alone = F.concat(F.lit("(?<![A-Za-z])"), quoted(ticker), F.lit("(?![A-Za-z])"))
    text = F.when(ticker.isNotNull(), F.regexp_replace(text, alone, F.lit("TICKER"))).otherwise(text)
    text = F.regexp_replace(text, "(?U)" + FULL_DATE, "[DATE]")
    text = F.regexp_replace(text, "(?U)" + YEAR, "[YEAR]")
    return F.regexp_replace(text, "(?iU)" + FISCAL_YEAR, "fiscal [YEAR]")


def rater_text(text: Column, ticker: Column, name: Column, max_chars: int | None = None,
               anonymize: bool = True) -> Column:
    """What a rater sees: the whole text, or what its own limit admits, masked afterwards."""
    cut = text if max_chars is None else F.substring(text, 1, max_chars)
    return mask_identity(cut, ticker, name) if anonymize else cut


def volume_estimate(docs: DataFrame, text: str, max_chars: int | None = None) -> DataFrame:
    """Documents and rough millions of tokens (four characters each) a rater would read."""
    read = F.length(text) if max_chars is None else F.least(F.length(text), F.lit(max_chars))
    return docs.agg(F.count("*").alias("documents"), (F.sum(read) / 4e6).alias("million_tokens"))


def _named(names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])


def decode_references(text: Column) -> Column:
    """Decode numeric and named character references that end in a semicolon, each once; unknown names stay."""
    common = _named({n: chr(c) for n, c in name2codepoint.items()})
    rest = _named({n[:-1]: c for n, c in html5.items() if n.endswith(";") and n[:-1] not in name2codepoint})

    def number(digits: Column, base: int) -> Column:
        code = F.conv(digits, base, 10).cast("long")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return (F.when(code.between(0x80, 0x9F), F.substr(F.lit(WINDOWS), (code - 0x7F).cast("int"), F.lit(1)))
                .when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd"))

    def one(mark: Column) -> Column:
        name = F.regexp_extract(mark, "^&(.*);$", 1)
        return (F.when(F.lower(name).startswith("#x"), number(F.substr(name, F.lit(3)), 16))
                .when(name.startswith("#"), number(F.substr(name, F.lit(2)), 10))
                .otherwise(F.coalesce(common[name], rest[name], mark)))

    marks = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), one)
    between = F.zip_with(F.split(text, REFERENCE), marks, lambda t, m: F.concat(t, F.coalesce(m, F.lit(""))))
    return F.array_join(between, "")


def html_to_text(html: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags go, character references are decoded,
    blanks and line breaks are collapsed.

    A ``<`` opens a tag only before a letter, ``/``, ``!`` or ``?``; a script, style or comment that is not closed goes to the
    end of the page.
    """
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", " ")
    text = F.regexp_replace(text, r"<[A-Za-z/!?][^>]*>", " ")
    text = F.replace(decode_references(text), F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)\s*\n\s*", "\n")
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
