"""Revisit records against a plain search, and the pipeline against its operators' plain versions."""
import datetime as dt
import random

import corpus_pipeline
from driftmark.llm import pieces, quality, revisits
from pyspark.sql import functions as F

from . import brute
from .test_documents import frame, odd

RECORDS = "record_id bigint, url string, captured_at timestamp, kind string, status int, headers map<string,string>, payload_digest string"


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a?b=2&a=1#x", "HTTPS://example.com:443/a?a=1&b=2", "example.com/a?a=1&&b=2"]
    other = ["http://example.com", "https://user@example.com/?", "http://example.com/#"]
    df = spark.createDataFrame([(u,) for u in [*same, *other, None]], "u string")
    got = [r[0] for r in df.select(revisits.canonical_url(F.col("u"))).collect()]
    assert got == ["example.com/a?a=1&b=2"] * 3 + ["example.com/"] * 3 + [None]


def test_latest_earlier_response(spark):
    rng = random.Random(6)
    start, rows = dt.datetime(2024, 1, 1), []
    for n in range(400):
        # one URL holds a third of all records; times tie
        url = "http://hot.org/" if n % 3 == 0 else f"http://site{rng.randint(0, 20)}.org/"
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        rows.append((n, url, start + dt.timedelta(minutes=rng.randint(0, 900)), kind, rng.choice([200, 200, 404]) if kind == "response" else 304,
                     {"ETag": f'"{rng.randint(0, 2)}"'}, None))
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for n, url, at, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(r[2], r[0], r[5]) for r in rows if r[1] == url and r[3] == "response" and r[4] == 200 and (r[2], r[0]) < (at, n)]
            best = max(earlier, default=None, key=lambda e: e[:2])
            assert got[n].response_id == (best[1] if best else None)
            mine = rows[n][5]["ETag"]
            assert got[n].outcome == ("unresolved" if not best else "resolved" if best[2]["ETag"] == mine else "mismatch")


def test_headers_and_validators(spark):
    at = dt.datetime(2024, 5, 1)
    full = {"ETag": 'W/"a"', "etag": '"b"', "Content-Length": "9", "Last-Modified": "yesterday", "X": "1"}
    rows = [(1, "http://a/", at, "response", 200, full, "d1"), (1, "http://a/", at, "response", 200, full, "d0"),
            (2, "http://a/", at + dt.timedelta(days=3), "revisit", 304, {"etag": '"a"', "content-length": "0", "x": "2", "Age": "5"}, None),
            (2, "http://a/", at + dt.timedelta(days=3), "revisit", 304, {"etag": '"a"'}, None),
            (3, "http://a/", at + dt.timedelta(days=3), "revisit", 304, {"last-modified": "today"}, None),
            (4, "http://a/", at + dt.timedelta(days=3), "revisit", 304, None, "d1"), (5, "http://a/", at + dt.timedelta(days=3), "revisit", None, None, None),
            (6, None, at, "revisit", 304, None, None), (7, "http://a/", None, "revisit", 304, None, None), (None, "http://b/", at, "revisit", 304, None, None),
            (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, RECORDS).withColumns({"bucket": F.lit(1), "found": F.lit(2), "at": F.lit(3)})
    got = sorted(((r.record_id, r.outcome, r.payload_digest, len(r.headers)) for r in revisits.resolve(df).collect()), key=repr)
    assert got == sorted([(2, "resolved", "d1", 5), (2, "resolved", "d1", 4), (3, "mismatch", None, 1), (4, "resolved", "d1", 4), (5, "unverified", "d1", 4),
                          (6, "unresolved", None, 0), (7, "unresolved", None, 0), (None, "unresolved", None, 0)], key=repr)
    merged = next(r.headers for r in revisits.resolve(df).collect() if r.record_id == 2 and len(r.headers) == 5)
    assert merged == {"etag": 'W/"a"', "content-length": "9", "last-modified": "yesterday", "x": "2", "age": "5"}
    assert revisits.resolve(df.limit(0)).count() == 0


def test_pipeline_is_its_stages(spark, texts, tmp_path):
    rng = random.Random(9)
    bench = [(1, " ".join(brute.words(texts[30][1])[10:24])), (2, "never seen anywhere in these documents at all I think")]
    docs = frame(spark, texts).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rows = list(texts)
    rng.shuffle(rows)
    verdict = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    rows = [(i, t) for i, t in rows if verdict[i] and not brute.quality(t)[-1]]
    drops = brute.recurring_lines(rows)
    rows = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in d) if d else t) for (i, t), d in zip(rows, drops)]
    rows = [(i, t) for (i, t), d in zip(rows, drops) if not d or t.strip()]
    first = {root for _, _, root in brute.near_duplicates(rows)}
    rows = [(i, t) for i, t in rows if i in first]
    rows = [(i, t) for (i, t), r in zip(rows, brute.decontamination(rows, bench)) if not r[5]]
    model = pieces.Pieces.from_file(pieces.VOCABULARY)
    assert set(got) == {i for i, _ in rows} and 30 < len(rows) < len(texts)
    assert all(model.decode(model.encode(t)) == t and list(model.encode(t)) == got[i].ids for i, t in rows)


def test_stages_keep_the_columns(spark, texts):
    docs = frame(spark, texts[:20]).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, docs, "").schema.simpleString() == docs.schema.simpleString(), name


def test_stages_odd(spark, tmp_path):
    """Nulls everywhere, repeated rows, columns named like inner ones, no rows at all, no items at all."""
    docs = odd(spark).select("*", *[F.lit(k).alias(k) for k in ("n_lines", "n_dropped", "n_words", "language", "reason")], F.lit(1).cast("bigint").alias("n_chars"))
    left = {"quality rules": 0, "line dedup": 9, "SimHash near-dedup": 3, "decontamination": 5, "encoding": 9}  # four rows hold the item
    for n, items in enumerate([[(1, "f g h i j k l m n o p"), (2, "b c d e f g h i j k"), (None, "never"), (3, None)], []]):
        spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/{n}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, f"{tmp_path}/{n}")
            assert got.count() == (9 if not items and name == "decontamination" else left[name]), name
            assert name == "encoding" or got.columns == docs.columns
            assert stage(spark, docs.limit(0), f"{tmp_path}/{n}").count() == 0


def test_captures_odd(spark):
    pages = spark.createDataFrame([(1, "http://a/", None, 1), (None, "http://a/", "x", 2), (2, None, "", 3), (2, None, "", 3)],
                                  "page_id bigint, url string, html string, record_id int")
    got = revisits.captures(pages)
    assert got.count() == 8 and got.filter("record_id is null and captured_at is null").count() == 2
    assert revisits.resolve(got).count() == 4 and revisits.captures(pages.limit(0)).count() == 0
