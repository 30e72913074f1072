"""Resolution of WARC revisit records that say "not modified".

A revisit holds no payload: it stands for the latest earlier full response of the same canonical URL.
It is an as-of join, made of equality steps so that one URL may hold a third of all records: inside a
(URL, time bucket) the last response is carried forward by a window; one row per URL and bucket tells
which response a bucket hands on to later ones. Only record numbers travel this way; headers and
digests are fetched by number, payloads not at all.

The response found must pass the revisit's validators: its ETag if both have one (weakly compared), else
the modification date, else the payload digest. Then the revisit's headers update the stored ones,
except those that describe a body or a connection.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

BUCKET_SECONDS = 3600
# Header fields that a not-modified answer must not change.
NOT_PERMITTED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag",
                 "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """One spelling per resource: host in lower case without ``www.`` and the scheme's port, no scheme or
    fragment, query parameters in order, ``/`` for an empty path. Null stays null."""
    rest = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(rest, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?]*", 0))
    port = F.when(scheme == "https", F.regexp_replace(host, r":443$", "")).otherwise(F.regexp_replace(host, r":80$", ""))
    host = F.regexp_replace(F.regexp_replace(port, r"^[^@]*@", ""), r"^www\.", "")
    tail = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.substring_index(tail, "?", 1)
    asked = F.array_join(F.array_sort(F.array_remove(F.split(F.regexp_extract(tail, r"(?s)\?(.*)$", 1), "&"), "")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then are equal the first in sorting order stays. Null gives no headers."""
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))
    first = F.transform(names, lambda n: F.filter(F.array_sort(F.map_entries(headers)), lambda e: F.lower(e["key"]) == n)[0]["value"])
    return F.coalesce(F.map_from_arrays(names, first), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """``stored`` headers updated by the permitted ones of ``fresh``; both with lower-case names."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(*NOT_PERMITTED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def latest_responses(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """(record_id, response_id): for each revisit the latest earlier response of its URL, null if there is none.

    ``records`` has record_id, url (canonical), at (timestamp), is_response. Records at one instant are
    ordered by number.
    """
    seconds = F.unix_micros(F.col("at").cast("timestamp"))
    rows = records.select("record_id", "url", "is_response", seconds.alias("micros")).withColumn(
        "bucket", F.floor(F.col("micros") / (bucket_seconds * 1_000_000)))
    mine = F.when(F.col("is_response"), F.struct("micros", "record_id"))
    earlier = W.partitionBy("url", "bucket").orderBy("micros", "record_id").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.withColumn("found", F.last(mine, ignorenulls=True).over(earlier)).filter("not is_response")
    handed = rows.filter("is_response").groupBy("url", "bucket").agg(F.max(F.struct("micros", "record_id")).alias("handed"))
    # revisits without a response in their bucket ask for the latest bucket before
    open_ = inside.filter("found is null").select("url", "bucket").distinct().withColumn("handed", F.lit(None).cast(handed.schema["handed"].dataType))
    line = handed.withColumn("asks", F.lit(0)).unionByName(open_.withColumn("asks", F.lit(1)))
    before = W.partitionBy("url").orderBy("bucket", F.desc("asks")).rowsBetween(W.unboundedPreceding, -1)
    carried = (line.withColumn("carried", F.last("handed", ignorenulls=True).over(before)).filter("asks = 1")
               .select(F.col("url").alias("c_url"), F.col("bucket").alias("c_bucket"), "carried"))
    return inside.join(carried, (F.col("url") == F.col("c_url")) & (F.col("bucket") == F.col("c_bucket")), "left").select(
        "record_id", F.coalesce("found.record_id", "carried.record_id").alias("response_id"))


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Every revisit of ``records`` with what it stands for.

    ``records`` has record_id (unique), url, captured_at, kind (``response``, ``revisit``, others are
    not read), status, headers (map), payload_digest. A full response is a ``response`` with status 200.
    Gives record_id, url (canonical), outcome, response_id, payload_digest, headers. The outcome is
    ``resolved``, ``mismatch`` (a validator differs: nothing is merged, no digest), ``unverified`` (no validator in
    common: merged) or ``unresolved`` (no earlier response, or no URL or time: own headers). Rows that repeat a
    response's number would repeat its revisits, so of those the row with the largest digest counts. Empty tables
    give no rows; other columns are not read.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.col("captured_at").alias("at"), "kind", "status",
                          lowered(F.col("headers")).alias("headers"), "payload_digest")
    rows = rows.withColumn("is_response", (F.col("kind") == "response") & (F.coalesce("status", F.lit(0)) == 200))
    placed = rows.filter("url is not null and at is not null and (is_response or kind = 'revisit')")
    latest = latest_responses(placed, bucket_seconds).withColumnRenamed("record_id", "l_id")
    latest = latest.groupBy("l_id").agg(F.max("response_id").alias("response_id"))
    revisits = rows.filter("kind = 'revisit'").join(latest, F.col("record_id").eqNullSafe(F.col("l_id")), "left")
    # written out, so that revisits of one response meet a plain table and can be split
    stored = written(rows.filter("is_response").groupBy(F.col("record_id").alias("r_id"))
              .agg(F.max_by(F.struct(F.col("headers"), F.col("payload_digest").alias("digest")), F.coalesce("payload_digest", F.lit(""))).alias("stored")))
    # revisits without a response would all meet in the task of the null key
    found = revisits.filter("response_id is not null").join(stored, F.col("response_id") == F.col("r_id"), "left")
    both = found.unionByName(revisits.filter("response_id is null"), allowMissingColumns=True)
    old, new = F.col("stored.headers"), F.col("headers")

    def same(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), a == b)

    valid = F.coalesce(same(_weak(old["etag"]), _weak(new["etag"])), same(F.trim(old["last-modified"]), F.trim(new["last-modified"])),
                       same(F.col("stored.digest"), F.col("payload_digest")))
    outcome = (F.when(F.col("r_id").isNull(), "unresolved").when(valid.isNull(), "unverified").when(valid, "resolved").otherwise("mismatch"))
    merged = F.when(outcome.isin("resolved", "unverified"), merged_headers(old, new)).otherwise(new)
    digest = F.when(outcome.isin("resolved", "unverified"), F.col("stored.digest"))
    return both.select("record_id", "url", outcome.alias("outcome"), "response_id", digest.alias("payload_digest"), merged.alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a page table: one full response per page, and one revisit an hour and a bit later or before.

    Every seventh revisit comes before its response, every fifth has another ETag, every third has a date
    instead of an ETag; revisits spell the URL another way. A null page_id gives records without id and time, a null
    URL or page records that resolve to nothing or to the empty page; repeated pages give repeated records, other columns are
    not read, an empty table gives no rows.
    """
    n = F.col("page_id")
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    when = F.concat(F.lit("day "), n % 28)
    base = F.lit(1_700_000_000) + n * 60

    def headers(*pairs: tuple[str, Column]) -> Column:
        return F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])

    response = pages.select(
        (2 * n).alias("record_id"), "url", F.timestamp_seconds(base).alias("captured_at"), F.lit("response").alias("kind"), F.lit(200).alias("status"),
        headers(("Content-Type", F.lit("text/html")), ("Content-Length", F.length(html).cast("string")), ("ETag", tag),
                ("Last-Modified", when), ("X-Cache", F.lit("miss"))).alias("headers"), F.sha1(html).alias("payload_digest"))
    plain = headers(("ETag", F.when(n % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))), ("X-Cache", F.lit("hit")), ("Content-Length", F.lit("0")))
    dated = headers(("last-modified", when), ("Age", (n % 100).cast("string")), ("x-cache", F.lit("hit")))
    revisit = pages.select(
        (2 * n + 1).alias("record_id"), F.regexp_replace("url", r"^http://(www\.)?", "HTTPS://www.").alias("url"),
        F.timestamp_seconds(base + F.when(n % 7 == 0, -60).otherwise(3700)).alias("captured_at"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"), F.when(n % 3 == 0, dated).otherwise(plain).alias("headers"), F.sha1(html).alias("payload_digest"))
    return response.unionByName(revisit)
