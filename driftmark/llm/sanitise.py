"""Sanitisation of personal data by what terms disclose.

Mail and network addresses, card and phone numbers are found by pattern. They are the protected
entities; a word that all but names one is as telling as the entity. How much a term *t* discloses of an
entity *e* is the share of e's information that it carries,

    disclosure = PMI(e; t) / -log p(e),   PMI = log(p(e | t) / p(e)),

estimated from the whole corpus: in how many documents e occurs, t occurs anywhere, and t occurs within
``CONTEXT`` words of e. At 1 the term names the entity for certain. Few observations are shrunk to the
background rate: p(e | t) is taken with ``PRIOR`` more documents of t that hold e as often as any document does, so one
meeting of rare words counts for less than many, and in a large corpus, where it is less likely to be chance, for more.
Copies are no evidence: meetings are counted by different sketches of the text.

Terms from ``GENERALISE`` on become spans of kind ``term`` wherever they occur, in every text; they are
replaced by their class, and from ``REMOVE`` on taken out. The telling terms are joined to the texts; a bitmap of
fixed size, through which they are looked up first, keeps other words out of the shuffle.

Contexts keep the work linear in the text however many entities a document lists. Counts are combined
per batch and per task before they are shuffled, so a hot entity or a frequent word costs one row per
task.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 25
PRIOR = 1.0
GENERALISE = 0.85
REMOVE = 0.95
# Bits of the bitmap of telling terms (1 MB); two of them per term.
_BITS = 1 << 23
_HELD_ROWS = 100_000
# Terms counted in a worker before it hands them on.
_HELD_TERMS = 400_000

# The patterns of the four kinds. Possessive loops and the look-behind keep them linear;
# they match the same spans as without.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]{3,}")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @ sign, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def entities(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by kind and start; offsets in code points, ``value`` in normal form."""
    found = [("email", a, b, text[a:b].lower()) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match[0].split(".")):
                found.append(("ip", *match.span(), match[0]))
        for match in _CARD.finditer(text):
            digits = match[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *match.span(), digits))
        for match in _PHONE.finditer(text):
            digits = "".join(_DIGIT.findall(match[0]))
            if 9 <= len(digits) <= 15:
                found.append(("phone", *match.span(), digits))
    return found


def _contexts(text: str, found: list[tuple[str, int, int, str]]) -> list[dict]:
    """The different terms around each entity, those inside any entity left out."""
    taken = sorted((a, b) for _, a, b, _ in found)
    terms, k = [], 0
    for match in _TERM.finditer(text):
        a, b = match.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(s < b and a < e for s, e in taken[k:k + len(KINDS)]):
            terms.append((a, b, match[0].lower()))
    starts = [t[0] for t in terms]
    out = []
    for kind, a, b, value in found:
        low, high = bisect_left(starts, a), bisect_left(starts, b)
        near = terms[max(0, low - CONTEXT):high + CONTEXT]
        out.append({"kind": kind, "value": value, "terms": sorted({t for _, _, t in near})})
    return out


def _sketch(text: str) -> int:
    """Smallest hash of the text's five-word runs: alike in copies and mostly so in near copies."""
    words = text.lower().split()
    runs = (" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(r) for r in runs) >> 1


_FOUND = ("id {kind}, text_hash bigint, sketch bigint, base array<struct<kind:string,start:int,end:int>>, "
          "contexts array<struct<kind:string,value:string,terms:array<string>>>")


def _found(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    context_type = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("terms", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches, bases, contexts = [], [], []
            for text in batch.column(2):
                text = text.as_py()
                found = entities(text)
                sketches.append(_sketch(text) if found else None)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in found])
                contexts.append(_contexts(text, found) if found else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sketches, pa.int64()), pa.array(bases, base_type), pa.array(contexts, context_type)],
                ["id", "text_hash", "sketch", "base", "contexts"])

    return source.mapInArrow(run, _FOUND.format(kind=source.schema["id"].dataType.simpleString()))


def term_documents(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, documents): in how many rows each term occurs; null and empty texts have none, an empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update({t.lower() for t in set(_TERM.findall(text.as_py()))})
                if len(counts) > _HELD_TERMS:
                    yield pack(counts)
                    counts.clear()
        if counts:
            yield pack(counts)

    def pack(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "documents"])

    source = documents.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    return source.mapInArrow(run, "term string, documents bigint").groupBy("term").agg(F.sum("documents").alias("documents"))


def disclosures(documents: DataFrame, found: DataFrame, text_col: str = "text", threshold: float = GENERALISE,
                prior: float = PRIOR) -> DataFrame:
    """(kind, value, term, disclosure) of the pairs at or above ``threshold``; no entities or texts give no rows."""
    total = F.lit(float(max(found.count(), 1)))
    near = found.select("id", "text_hash", "sketch", F.explode("contexts").alias("c")).select("id", "text_hash", "sketch", "c.kind", "c.value", "c.terms")
    pairs = (near.select("id", "text_hash", "sketch", "kind", "value", F.explode("terms").alias("term")).distinct()
             .groupBy("kind", "value", "term", "sketch").agg(F.count("*").alias("both"))
             .groupBy("kind", "value", "term").agg(F.sum("both").alias("both"), F.count("*").alias("sketches")))
    holding = near.select("id", "text_hash", "kind", "value").distinct().groupBy("kind", "value").agg(F.count("*").alias("holding"))
    every = term_documents(documents, text_col).withColumnRenamed("documents", "every")
    joined = pairs.join(holding, ["kind", "value"]).join(every, "term")
    rate = F.least(F.col("holding") / total, F.lit(1.0))
    seen = F.col("sketches") * F.greatest(F.col("every") / F.col("both"), F.lit(1.0))
    given = (F.col("sketches") + prior * rate) / (seen + prior)
    # an entity in every document carries no information; whatever goes with it discloses nothing
    return joined.withColumn("disclosure", F.when(rate < 1, 1 - F.log(given) / F.log(rate)).otherwise(0.0)).filter(
        F.col("disclosure") >= threshold).select("kind", "value", "term", "disclosure")


def _bitmap(told: DataFrame) -> np.ndarray:
    """Bits of the terms in ``told``: 1 MB at most, whatever their number."""
    key = F.xxhash64("term")
    places = F.explode(F.array(*[F.shiftrightunsigned(key, n).bitwiseAND(F.lit(_BITS - 1)) + 1 for n in (0, 23)]))
    parts = told.select(places.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(_BITS // 8, np.uint8)
    for row in parts.collect():
        bits = np.frombuffer(bytes(row.bits), np.uint8)
        out[(row.part - 1) * 4096:(row.part - 1) * 4096 + len(bits)] = bits
    return out


def _occurrences(documents: DataFrame, told: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, start, end, disclosure) of the terms in ``told`` wherever they occur."""
    bits = _bitmap(told)
    text = F.col(text_col).cast("string")
    source = documents.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), text.alias("text")).filter("text <> ''")
    names = ["id", "text_hash", "term", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            rows: list[tuple] = []
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                words = set(_TERM.findall(text))
                if len(known) > _HELD_TERMS:
                    known.clear()
                for word in words:
                    if word not in known:
                        key = xxhash.xxh64_intdigest(word.lower().encode(), 42)
                        known[word] = all(bits[(p := key >> n & _BITS - 1) >> 3] >> (p & 7) & 1 for n in (0, 23))
                if not any(map(known.__getitem__, words)):
                    continue
                for match in _TERM.finditer(text):
                    if known[match[0]]:
                        rows.append((k, match[0].lower(), *match.span()))
                        if len(rows) >= _HELD_ROWS:
                            yield pack(batch, rows)
                            rows = []
            yield pack(batch, rows)

    def pack(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, terms, starts, ends = zip(*rows) if rows else ((), (), (), ())
        own = batch.take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(terms, pa.string()), pa.array(starts, pa.int32()),
                                           pa.array(ends, pa.int32())], names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text_hash bigint, term string, start int, end int").join(told, "term").drop("term")


def spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = GENERALISE) -> DataFrame:
    """(id, text_hash, base, terms) for every row of ``documents``.

    ``base`` lists kind, start, end of the entities by kind and start; ``terms`` lists start, end and
    disclosure of the disclosing terms outside of them by start, in documents with and without entities. Offsets are
    code points, ends exclusive. A null or empty text has no spans. Rows of one id and text are alike; a null id keeps
    its row. Other columns are not read, an empty table gives no rows.
    """
    found = written(_found(documents, id_col, text_col))
    told = written(disclosures(documents, found, text_col, threshold).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    hits = (_occurrences(documents, told, id_col, text_col).distinct().groupBy("id", "text_hash")
            .agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))
            .withColumnsRenamed({"id": "h_id", "text_hash": "h_hash"}))
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    outside = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left").select(
        F.col("id").alias(id_col), "text_hash", "base", F.coalesce(outside, none).alias("terms"))


def described(list_: Column, kind: Column | None = None) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.array_join(F.transform(list_, lambda s: F.concat_ws(
        ":", s["kind"] if kind is None else kind, s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(id, text): texts with entities replaced by their kind, telling terms by their class or by nothing.

    The leftmost of overlapping spans counts, of those at one place the longest. A class is ``<NUMBER>`` for a term with a digit, ``<NAME>``
    for a capitalised one and ``<TERM>`` for any other. Null texts come back empty, repeated rows as often as they are
    given, null ids with theirs; other columns are not read and an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    cuts = spans(documents, id_col, text_col, threshold).distinct().select(F.col(id_col).alias("c_id"), F.col("text_hash").alias("c_hash"), "base", "terms")
    joined = rows.join(cuts, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))).select("id", "text", "base", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, base, terms in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                cut = [(s["start"], -s["end"], f"<{s['kind'].upper()}>") for s in base]
                for s in terms:
                    word = text[s["start"]:s["end"]]
                    name = "<NUMBER>" if _DIGIT.search(word) else "<NAME>" if word[0].isupper() else "<TERM>"
                    cut.append((s["start"], -s["end"], "" if s["disclosure"] >= remove else name))
                kept, at = [], 0
                for start, end, name in sorted(cut):
                    if start >= at:
                        kept += [text[at:start], name]
                        at = -end
                out.append("".join([*kept, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    return joined.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").toDF(id_col, text_col)
