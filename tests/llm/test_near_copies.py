"""The pipeline's SimHash stage against fingerprints compared pair by pair."""
import random

import corpus_pipeline
import pytest
from driftmark.llm import simhash

from . import brute
from .test_documents import frame, odd


@pytest.fixture(scope="module")
def copies():
    """Copies with a few words changed, some of them copied again, and many that share a passage only."""
    rng = random.Random(21)
    rows, passage = [], " ".join(f"p{rng.randint(0, 999)}" for _ in range(80))
    for _ in range(40):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 300))]
        rows += [" ".join(words)] * 2
        for _ in range(3):
            words = list(words)
            words[rng.choice([0, -1])] = f"c{rng.randint(0, 5000)}"
            rows.append(" ".join(words))
    rows += [passage + " " + " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 60))) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("bucket", [4096, 8])
def test_one_document_of_each_group_stays(spark, copies, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    got = {r.doc_id for r in corpus_pipeline.first_of_group(spark, frame(spark, copies), "").collect()}
    assert got == {root for _, _, root in brute.near_duplicates(copies)} and 60 < len(got) < 180


def test_stage_odd(spark):
    """Null and empty texts form one group, a row without an id goes where its group has one with, columns stay."""
    kept = corpus_pipeline.first_of_group(spark, odd(spark), "")
    assert kept.columns == odd(spark).columns
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert kept.count() == len(set(brute.groups([brute.fingerprint(t) for _, t in rows])))
    assert corpus_pipeline.first_of_group(spark, odd(spark).limit(0), "").count() == 0


def test_no_side_of_the_key_join_is_broadcast(spark):
    """Spark sizes the keys as the fingerprints they come from; broadcast, they fill the driver."""
    links = simhash.fingerprint_links(spark.range(50).selectExpr("id * 3 as fp"))
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
