import json

import pytest
from pyspark.sql import functions as F

from driftmark.functions import answers as A
from driftmark.functions import text as X
from driftmark.operators.signals import build_signals

POS, NEG = ["strong", "improved", "record"], ["decline", "loss", "weak"]
TEXTS = ["Improved harvest, record yield; a weak market and one loss followed", "Never so improved", "Grain and barley",
         "none improved although costs weren't weak but later on strong", "neither wheat nor rye strong", "", None]


def test_tone_and_negation_by_literals_and_by_join(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    lexicon = spark.createDataFrame([(w, w in POS, w in NEG) for w in POS + NEG], "word string, positive boolean, negative boolean")
    want = {0: (2, 2, 0.0), 1: (0, 1, -1.0), 2: (0, 0, 0.0), 3: (1, 2, -1 / 3), 4: (1, 0, 1.0), 5: (0, 0, 0.0), 6: (0, 0, 0.0)}
    for table in (X.word_tone(docs, "text", POS, NEG, ["id"]), X.word_tone_joined(docs, "text", lexicon, "id")):
        got = {r.id: (r.lm_pos, r.lm_neg, pytest.approx(r.lm)) for r in table.collect()}
        assert got == want
    words = {r.id: r.lm_words for r in X.word_tone(docs, "text", POS, NEG, ["id"]).collect()}
    assert words[1] == 3 and words[3] == 10 and words[6] == 0


def test_a_word_on_both_lists_is_positive_first(spark):
    docs = spark.createDataFrame([(1, "record")], "id int, text string")
    row = X.word_tone(docs, "text", ["record"], ["record"], ["id"]).first()
    assert (row.lm_pos, row.lm_neg) == (1, 0)


def mask(spark, text, ticker, name):
    df = spark.createDataFrame([(text, ticker, name)], "text string, ticker string, name string")
    return df.select(X.mask_identity(F.col("text"), F.col("ticker"), F.col("name"))).first()[0]


def test_masking_hides_identity_and_dates(spark):
    out = mask(spark, "On 3 and Sept. 4 2019 Norsk Fjord plc, listed as NFJ since 1987, told FY19 was dull; norsk fjord shrugged.", "NFJ", "Norsk Fjord plc")
    assert out == "On 3 and [DATE] the Company, listed as TICKER since [YEAR], told fiscal [YEAR] was dull; the Company shrugged."


def test_short_ticker_does_not_eat_words(spark):
    out = mask(spark, "M+M rose, M fell; Mr M. met ROM and 5M", "M", "M+M")
    assert out == "the Company rose, TICKER fell; Mr TICKER. met ROM and 5TICKER"


def test_masking_edge_cases(spark):
    assert mask(spark, "ACME corp and Acme Holdings grew", "X", "Acme Holdings") == "the Company and the Company grew"
    assert mask(spark, "GE rose", "ZZ", "GE") == "GE rose"          # names of two letters stay
    assert mask(spark, "a.b\\Ec grew", "ZZ", "a.b\\Ec") == "the Company grew"
    assert mask(spark, "plain since 1999", "ZZ", None) == "plain since [YEAR]"
    assert mask(spark, "axb (A.B)", "A.B", "none such") == "axb (TICKER)"


def test_rater_limit_cuts_before_masking(spark):
    df = spark.createDataFrame([("Acme in 2024",)], "t string")
    args = F.col("t"), F.lit("ZZ"), F.lit("Acme")
    got = df.select(X.rater_text(*args, max_chars=10), X.rater_text(*args), X.rater_text(*args, max_chars=4, anonymize=False)).first()
    assert tuple(got) == ("the Company in 20", "the Company in [YEAR]", "Acme")


def test_page_text(spark):
    cases = {'<STYLE>b{}</STYLE><script>"<p>"\n</script ><!-- x\n --><h1>Tea&nbsp;&amp; milk</h1>\n \n<p>5 &lt; 6 &amp;gt;</p>\t': "Tea & milk\n5 < 6 &gt;",
             "3 < 4 and 5 > 2": "3 < 4 and 5 > 2", "&pound;&euro;&eacute;&#163;&#x1F600;&#38;amp;": "£€é£😀&amp;",
             "a<script>never closed <p>": "a", "b<!-- neither": "b", "&none; &amp &#0;&#xD800;&#150;&#99999999;": "&none; &amp \ufffd\ufffd–&#99999999;", "": ""}
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {r.h: r.t for r in df.select("h", X.html_to_text(F.col("h")).alias("t")).collect()} == cases


def test_volume(spark):
    docs = spark.createDataFrame([("a" * 8,), ("b" * 100,)], "t string")
    assert X.volume_estimate(docs, "t", 20).first().million_tokens == pytest.approx(28 / 4e6)
    assert X.volume_estimate(docs, "t").first().million_tokens == pytest.approx(108 / 4e6)


GOOD = {"guidance_tone": -1, "guidance_mentioned": True, "margins_tone": 0, "margins_mentioned": False,
        "demand_tone": -1, "demand_mentioned": True, "overall_tone": 1, "reason": "r" * 400}


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, answer string")
    return [r for r in A.parse_answers(df, "answer").orderBy("id").collect()]


def test_answers_parse_and_validate(spark):
    full = json.dumps(GOOD)
    cut = full[:full.index('"reason"')] + '"reason": "The outlook was withdrawn because of very very'
    rows = parse(spark, full, cut, '{"guidance_tone": -2, "guid', json.dumps(GOOD | {"guidance_tone": 3}),
                 json.dumps({k: v for k, v in GOOD.items() if k != "demand_mentioned"}), "not json", None,
                 json.dumps({k: v for k, v in GOOD.items() if k != "reason"}))
    assert rows[0].error is None and rows[0].guidance_tone == -1 and rows[0].margins_mentioned is False and len(rows[0].reason) == 400
    assert rows[1].error is None and rows[1].reason_truncated and rows[1].demand_tone == -1 and rows[1].reason == A.REASON_CUT
    assert [r.error for r in rows[2:7]] == ["not readable", "guidance_tone missing or out of range", "demand_mentioned missing",
                                            "not readable", "not readable"]
    assert rows[7].error is None and rows[7].reason == ""


def test_accepted_and_rejected_split_the_rows(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),), ("{",)], "answer string")
    parsed = A.parse_answers(df, "answer")
    assert A.accepted(parsed).count() == 1 and A.rejected(parsed).first().error == "not readable"


def test_answer_key(spark):
    key = spark.range(1).select(A.answer_key(F.lit("e"), F.lit("m"), F.lit("v1"), F.lit(1))).first()[0]
    import hashlib
    assert key == hashlib.sha1(b"e|m|v1|1").hexdigest()


def test_signals_and_change_since_the_last_document(spark):
    events = spark.createDataFrame([("k8", "K", "2019-02-11"), ("k9", "K", "2019-02-12"), ("q1", "Q", "2018-07-30")],
                                   "event_id string, ticker string, at string").select(
        "event_id", "ticker", F.col("at").cast("timestamp_ntz").alias("published_at"))
    scores = spark.createDataFrame(
        [("k9", -2, -1, 2, 1, True, True, False, "x"), ("k8", 1, 2, 2, 2, True, True, True, ""), ("q1", 0, 1, 0, 0, True, True, True, "")],
        "event_id string, guidance_tone int, margins_tone int, demand_tone int, overall_tone int, guidance_mentioned boolean, "
        "margins_mentioned boolean, demand_mentioned boolean, reason string")
    got = {r.event_id: r for r in build_signals(scores, events, slices=5).collect()}
    assert got["k9"].tone_delta == -3 and got["k8"].tone_delta is None and got["q1"].tone_delta is None
    # the tie-breaker uses the score of a topic that counts 0 in its own column
    assert got["k9"].tone == pytest.approx(-2 + 0.1 * 2 / 3) and got["k9"].tone_demand == 0 and got["k9"].tone_margins == -1
