import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftmark.operators import scoring as S
from driftmark.sources import factor_files as FF
from driftmark.sources import filings as L
from driftmark.sources import ledger as B
from driftmark.sources import register as E
from driftmark.sources import sinks
from driftmark.sources import tables as T

FILING_PAGE = "company_no long, form array<string>, items array<string>, filingDate array<string>, " \
              "accessionNumber array<string>, acceptanceDateTime array<string>"


def filing_setup(spark):
    old = (4711, ["10-K", "8-K", "8-K"], ["2.02", "9.01,2.02", "12.02"], ["2017-03-09", "2017-05-20", "2017-06-02"],
           ["0000004711-17-000003", "0000004711-17-000008", "0000004711-17-000009"], ["2017-05-20T20:59:01.250Z"] * 3)
    new = (86, ["8-K", "8-K", "8-K"], ["2.02", None, "2.02"], ["2019-10-31", "2019-11-01", "2020-02-29"],
           ["0000000086-19-000401", "0000000086-19-000402", "0000004711-17-000008"], ["2019-10-31T11:00:59.999Z"] * 3)
    return L.filing_rows(spark.createDataFrame([old], FILING_PAGE), spark.createDataFrame([new], FILING_PAGE))


def test_filings_of_old_and_new_company_numbers(spark):
    directory = spark.createDataFrame([("wool", 85, 0), ("wool", 86, 1), ("HAY-C", 12, 2)], "ticker string, company_no long, place int")
    universe = spark.createDataFrame([("WOOL", 4711), ("HAY.C", None), ("LOST", None)], "ticker string, cik long")
    candidates = L.company_candidates(universe, directory)
    # a ticker that is listed twice keeps its last number and gives one candidate
    assert sorted((r.ticker, r.candidate, r.company_no) for r in candidates.collect()) == [
        ("HAY.C", 0, 12), ("WOOL", 0, 4711), ("WOOL", 1, 86)]
    chosen = L.filing_events(L.earnings_filings(candidates, filing_setup(spark), "2016-02-01", "2019-12-31"))
    got = {r.event_id: r for r in chosen.collect()}
    assert sorted(got) == ["WOOL_0000000086-19-000401", "WOOL_0000004711-17-000008"]
    assert got["WOOL_0000004711-17-000008"].url.endswith("/data/4711/000000471117000008/")
    assert got["WOOL_0000000086-19-000401"].published_at == dt.datetime(2019, 10, 31, 11, 0, 59)
    existing = spark.createDataFrame([("WOOL_0000000086-19-000401",)], "event_id string")
    assert [r.event_id for r in L.not_collected(chosen, existing).collect()] == ["WOOL_0000004711-17-000008"]
    assert L.earnings_filings(candidates, filing_setup(spark), "2016-02-01", "2018-01-01").count() == 1


def test_press_release_prefers_the_first_exhibit(spark):
    def page(kind):
        return (f"<TABLE><tr class=a><td>cover</td><td><a HREF='x'>no</a></td></tr><tr><td><a href=\"q/one.txt\">1</a></td><td>EX-99.4</td></tr>\n"
                f'<tr><td><a href="q/two.HTML">2</a></td><td>\n <i>{kind}</i>\t\n</td></tr><tr><td><a href="q/p.pdf">3</a></td><td>EX-99</td></tr></TABLE>')
    df = spark.createDataFrame([(page("Ex-99.1"),), (page("EX-99.7"),), (page("GRAPHIC"),), ("<tr><td>EX-99</td></tr>",)], "h string")
    assert [r[0] for r in df.select(L.press_release_link(F.col("h"))).collect()] == ["q/two.HTML", "q/one.txt", "q/one.txt", None]


def test_links_are_resolved(spark):
    df = spark.createDataFrame([("https://a.b/c", "F/"), ("/top", "F/"), ("/top", "http://farm.org/x/y/"), ("leaf.htm", "F/")], "h string, folder string")
    got = [r[0] for r in df.select(L.resolve_link(F.col("h"), F.col("folder"))).collect()]
    assert got == ["https://a.b/c", L.SITE + "/top", "http://farm.org/top", "F/leaf.htm"]


def test_factor_files(spark, tmp_path):
    raw = ("Weekly file\r\nsee notes\n\n,Mkt-RF , SMB, RF \n19991203, 1.25 ,-3.5,0.004\n19991210,0,  2.00,0.005\n\nEnd of file\n19991217,7,7,7\n")
    (tmp_path / "one.csv").write_text(raw)
    (tmp_path / "two.csv").write_text(raw.replace("199912", "200001"))
    parsed = FF.parse_factor_files(FF.read_factor_files(spark, str(tmp_path)))
    table = {str(r.date): r for r in FF.factor_table(parsed, ["Mkt-RF", "SMB", "RF"]).collect()}
    assert sorted(table) == ["1999-12-03", "1999-12-10", "2000-01-03", "2000-01-10"]
    assert table["1999-12-03"]["Mkt-RF"] == pytest.approx(0.0125) and table["2000-01-10"].RF == pytest.approx(0.00005)
    mom = spark.createDataFrame([(dt.date(2000, 1, 10), 0.1)], "date date, Mom double")
    assert FF.join_factors(FF.factor_table(parsed, ["SMB"]), mom).count() == 1


def test_event_window_is_half_open(spark):
    times = {"a": "2008-02-29 23:59:00", "b": "2010-10-10 00:00:00", "c": "2012-06-30 23:59:59", "d": "2012-07-01 00:00:00", "e": None}
    ev = spark.createDataFrame(list(times.items()), "event_id string, at string").select(
        "event_id", F.col("at").cast("timestamp_ntz").alias("published_at"))
    assert sorted(r.event_id for r in T.in_window(ev, "2008-01-01", "2012-06-30", "2010-10-10").collect()) == ["b", "c"]
    assert sorted(r.event_id for r in T.in_window(ev, "2008-01-01", "2012-06-30").collect()) == ["a", "b", "c"]


def test_upsert_keeps_the_existing_row(spark):
    schema = "event_id string, ticker string, published_at string, source string, form string, url string, path string"

    def rows(*r):
        return spark.createDataFrame([(e, t, p, "s", "f", "", "p") for e, t, p in r], schema) \
            .withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))

    old = rows(("x", "OLD", "2024-01-02"))
    new = rows(("x", "NEW", "2024-01-01"), ("y", "B", "2024-01-05"), ("y", "B", "2024-01-04"), ("z", "A", "2024-01-04"))
    got = E.upsert_events(old, new)
    assert {r.event_id: r.ticker for r in got.collect()} == {"x": "OLD", "y": "B", "z": "A"}
    assert got.filter("event_id = 'y'").first().published_at == dt.datetime(2024, 1, 4)
    assert E.upsert_events(None, new).count() == 3


def test_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.txt").write_text("hello\nworld")
    (tmp_path / "m.csv").write_text("ticker,published_at,path\nAAA,2024-01-25 17:05,sub/t.txt\n")
    (tmp_path / "two words+1").mkdir()
    (tmp_path / "two words+1" / "ü.txt").write_text("second")
    (tmp_path / "n.csv").write_text("ticker,published_at,path\nBBB,2001-02-03 04:05,two words+1/ü.txt\n")
    assert E.read_manifest(spark, str(tmp_path / "n.csv")).first().text == "second"
    (tmp_path / "o.csv").write_text("ticker,published_at,path\nCCC,2001-02-03 04:05,gone.txt\n")
    with pytest.raises(Exception, match="gone.txt"):
        E.read_manifest(spark, str(tmp_path / "o.csv")).collect()
    row = E.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert row.event_id == "AAA_call_202401251705" and row.text == "hello\nworld" and row.form == "transcript"
    with pytest.raises(ValueError, match="path"):
        E.manifest_events(spark.createDataFrame([("A", "2024-01-01")], "ticker string, published_at string"))


def test_readers(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,name,sector,sector_etf,cik\nA,Alpha,Tech,XLK,12\nB,Beta,Tech,XLK,\n")
    uni = T.read_universe(spark, str(tmp_path / "u.csv"))
    assert {r.ticker: r.cik for r in uni.collect()} == {"A": 12, "B": None}
    assert sorted(r.ticker for r in T.panel_tickers(uni, "SPY").collect()) == ["A", "B", "SPY", "XLK"]
    wide = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, None), (dt.date(2024, 1, 2), float("nan"), 2.0)], "date date, `BRK.B` double, A double")
    wide.write.parquet(str(tmp_path / "wide"))
    got = {(r.ticker, r.date.day): r.close for r in T.read_prices(spark, str(tmp_path / "wide")).collect()}
    assert got == {("BRK.B", 1): 1.0, ("BRK.B", 2): None, ("A", 1): None, ("A", 2): 2.0}
    (tmp_path / "lm.csv").write_text("Word,Positive,Negative\ngood,2009,0\nbad,0,2014\nplain,0,0\n")
    lexicon = T.read_lexicon(spark, str(tmp_path / "lm.csv"))
    assert {r.word: (r.positive, r.negative) for r in lexicon.collect()} == {"GOOD": (True, False), "BAD": (False, True), "PLAIN": (False, False)}
    assert T.read_factors(spark, str(tmp_path / "absent.csv")) is None
    (tmp_path / "f.csv").write_text("date,Mkt-RF,SMB,HML,RMW,CMA,RF,Mom\n2024-01-02,0.1,0,0,0,0,0,0.2\n")
    assert T.read_factors(spark, str(tmp_path / "f.csv")).first()["Mom"] == 0.2


def test_price_assembly(spark):
    schema = "ticker string, date date, close double"
    d = dt.date(2024, 1, 1)
    a = spark.createDataFrame([("BRK-B", d, 1.0), ("C", d, None)], schema)
    b = spark.createDataFrame([("BRK-B", d, 2.0), ("D", d, 3.0), ("D", d.replace(day=2), None)], schema)
    got = T.assemble_prices(a, b)
    assert {(r.ticker, r.date.day): r.close for r in got.collect()} == {("BRK.B", 1): 1.0, ("D", 1): 3.0, ("D", 2): None}
    wanted = spark.createDataFrame([("BRK.B",), ("C",)], "ticker string")
    assert [r.ticker for r in T.missing_tickers(wanted, got).collect()] == ["C"]


def test_answer_lines_skip_broken_lines_and_keep_the_last(spark, tmp_path):
    lines = [json.dumps({"key": "k1", "guidance_tone": 1}), json.dumps({"key": "k3", "guidance_tone": 0}),
             json.dumps({"key": "k1", "guidance_tone": 2}), '{"key": "k2", "guid']
    (tmp_path / "cache.jsonl").write_text("\n".join(lines))
    got = {r.key: r.guidance_tone for r in T.read_answer_lines(spark, str(tmp_path / "cache.jsonl")).collect()}
    assert got == {"k1": 2, "k3": 0}


def documents(spark, n=6):
    return spark.createDataFrame([(f"e{i}", "AAA", "Alpha Inc.", f"Alpha document {i} of 2024") for i in range(n)],
                                 "event_id string, ticker string, name string, text string")


def test_scoring_resumes_where_it_stopped(spark, tmp_path):
    def good_answer(text, row):
        assert "Alpha" not in text and "2024" not in text
        return json.dumps({"guidance_tone": 1, "guidance_mentioned": True, "margins_tone": 0, "margins_mentioned": True,
                           "demand_tone": 0, "demand_mentioned": True, "overall_tone": 0, "reason": text, "model_id": "m-1"})

    def limited(text, row):
        if row["event_id"] in ("e4", "e5"):
            raise RuntimeError("usage limit reached")
        return good_answer(text, row)

    path = str(tmp_path / "answers")
    first = S.score_into(spark, documents(spark), limited, path, "m", "v1")
    assert first.count() == 4
    failed = S.read_answers(spark, path).filter("error is not null")
    assert {r.error for r in failed.collect()} == {"RuntimeError: usage limit reached"}
    todo = S.open_documents(documents(spark), S.read_answers(spark, path), "m", "v1")
    assert sorted(r.event_id for r in todo.collect()) == ["e4", "e5"]
    second = S.score_into(spark, documents(spark), good_answer, path, "m", "v1")
    assert second.count() == 6 and S.read_answers(spark, path).count() == 8
    assert second.first().reason.startswith("the Company document")
    assert S.open_documents(documents(spark), S.read_answers(spark, path), "m", "v2").count() == 6
    assert S.model_ids(S.read_answers(spark, path), documents(spark), "m").first().model_version == "m-1"
    assert S.model_ids(S.read_answers(spark, path), documents(spark), "other", "cfg").first().model_version == "cfg"


ANSWER = {"guidance_tone": 1, "guidance_mentioned": True, "margins_tone": 0, "margins_mentioned": True, "demand_tone": 0,
          "demand_mentioned": True, "overall_tone": 0, "reason": ""}


def calls_in(folder):
    """The event ids a counting rater was asked about, in all processes."""
    return sorted(line for f in folder.iterdir() for line in f.read_text().split())


def counting(folder, answer):
    def rater(text, row):
        import os
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(row["event_id"] + "\n")
        return answer(row["event_id"])
    return rater


def test_a_killed_worker_costs_the_batch_of_its_task(spark, tmp_path):
    path, docs, asked = str(tmp_path / "answers"), documents(spark, 200), tmp_path / "asked"
    asked.mkdir()

    def deadly(event_id):
        import os
        import time
        if event_id == "e7":
            time.sleep(4)
            os._exit(1)
        return ANSWER

    with pytest.raises(Exception):
        S.score_into(spark, docs, counting(asked, deadly), path, "m", "v1", task_documents=10)
    saved = {r.event_id for r in S.read_answers(spark, path).collect()}
    first = calls_in(asked)
    assert len(first) == len(set(first)) and saved < set(first) and len(set(first) - saved) <= 4 * 25
    assert len(saved) > 50
    assert S.score_into(spark, docs, counting(asked, lambda e: ANSWER), path, "m", "v1", task_documents=10).count() == 200
    # what finished tasks had saved was not rated again
    again = calls_in(asked)
    assert len(again) == len(first) + 200 - len(saved) and S.read_answers(spark, path).count() == 200


@pytest.mark.parametrize("batched", [False, True])
def test_a_limit_ends_the_run_and_keeps_what_was_answered(spark, tmp_path, batched):
    path, docs, asked = str(tmp_path / "answers"), documents(spark, 400), tmp_path / "asked"
    asked.mkdir()

    def allowed(event_id):
        if int(event_id[1:]) >= 150:
            raise S.LimitReached("come back tomorrow")
        return ANSWER

    one = counting(asked, allowed)
    rater = (lambda frame: [one("", {"event_id": e}) for e in frame["event_id"]]) if batched else one
    with pytest.warns(UserWarning, match="limit"):
        got = S.score_into(spark, docs, rater, path, "m", "v1", batched=batched, task_documents=5, grace=0.5)
    saved = S.read_answers(spark, path)
    assert saved.filter("error is not null").count() == 0 and got.count() == saved.count()
    # the documents nobody asked about are still open, and far fewer were asked than are open
    assert saved.count() <= len(calls_in(asked)) < 400
    assert S.score_into(spark, docs, lambda text, row: ANSWER, path, "m", "v1", task_documents=100).count() == 400


def test_the_ledger_prunes_raters_and_buckets(spark, tmp_path):
    path, docs = str(tmp_path / "answers"), documents(spark, 300)
    for model in ("m", "other/model"):
        S.score_into(spark, docs, lambda text, row: ANSWER, path, model, "v1")
    ledger = B.answers_of(spark, path, "m", "v1")
    assert ledger.count() == 300 and "PartitionFilters: [isnotnull(model" in ledger._jdf.queryExecution().toString()
    few = S.with_keys(docs.filter("event_id in ('e1', 'e2')"), "m", "v1")
    known = B.answered_keys(ledger, few)
    plan = known._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "PartitionFilters" in plan
    buckets = {r[0] for r in few.select(B.bucket_of(F.col("key"))).collect()}
    read = {r[0] for r in B.read_answers(spark, path).join(known, "key", "left_semi").select("bucket").distinct().collect()}
    assert read == buckets and 0 < known.count() < 60
    assert B.answers_of(spark, path, "other/model", "v1").count() == 300 and B.answers_of(spark, path, "m", "v2").count() == 0


def test_the_register_rewrites_touched_months_only(spark, tmp_path):
    path = str(tmp_path / "register")
    schema = "event_id string, ticker string, published_at string, source string, form string, url string, path string"

    def rows(*r):
        return spark.createDataFrame([(e, t, p, "s", "f", "", "p") for e, t, p in r], schema) \
            .withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))

    def files():
        return {r[0]: r[1] for r in E.read_register(spark, path).select("month", F.struct("_metadata.file_path", "_metadata.file_modification_time")).collect()}

    assert E.read_register(spark, path) is None
    assert E.upsert_register(spark, rows(("a", "A", "2007-03-05"), ("b", "B", "2007-03-04"), ("c", "C", "2007-05-01"), ("n", "N", None)), path) == ["2007-03", "2007-05", "undated"]
    before = files()
    # known ids stay, in whatever month they now say they are; ids that arrive twice count once
    assert E.upsert_register(spark, rows(("a", "NEW", "2007-05-09"), ("d", "D", "2007-05-02"), ("d", "E", "2007-05-02"), ("n", "N", "2007-06-01")), path) == ["2007-05"]
    after = files()
    assert {m for m in before if before[m] != after[m]} == {"2007-05"} and set(after) == set(before)
    got = {r.event_id: (r.ticker, r.month) for r in E.read_register(spark, path).collect()}
    assert got == {"a": ("A", "2007-03"), "b": ("B", "2007-03"), "c": ("C", "2007-05"), "n": ("N", "undated"), "d": ("D", "2007-05")}
    assert E.upsert_register(spark, rows(("a", "X", "2011-01-01")), path) == [] and files() == after
    march = E.read_register(spark, path).filter("month = '2007-03'")
    assert [r.event_id for r in march.collect()] == ["b", "a"] and len(march.select("_metadata.file_path").distinct().collect()) == 1


def test_a_folder_without_a_finished_file_is_empty(spark, tmp_path):
    (tmp_path / "answers" / "_temporary").mkdir(parents=True)
    assert S.read_answers(spark, str(tmp_path / "answers")).count() == 0 and S.read_answers(spark, str(tmp_path / "none")) is None


def test_raters_may_answer_with_dicts_and_in_batches(spark, tmp_path):
    docs = documents(spark, 6).withColumn("year", F.lit(2024))

    def batch(frame):
        assert {"event_id", "name", "year", "rater_text", "ticker"} <= set(frame.columns) and "text" not in frame.columns
        return [ANSWER | {"overall_tone": int(e[1:]) % 2} if e != "e3" else 5 for e in frame["event_id"]]

    got = S.score_into(spark, docs, batch, str(tmp_path / "a"), "m", "v1", batched=True)
    assert {r.event_id: r.overall_tone for r in got.collect()} == {f"e{i}": i % 2 for i in range(6) if i != 3}
    failed = S.read_answers(spark, str(tmp_path / "a")).filter("error is not null").collect()
    assert [(r.event_id, r.error) for r in failed] == [("e3", "TypeError: a rater answers with text or a dict, not int")]
    none = S.score_into(spark, docs, lambda frame: [], str(tmp_path / "b"), "m", "v1", batched=True)
    assert none.count() == 0 and S.read_answers(spark, str(tmp_path / "b")).count() == 6


def test_samples_repeat_and_hide_the_ids(spark):
    docs = documents(spark, 50)
    a, b = (sorted(r.event_id for r in S.hash_sample(d, 10, 7).collect()) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == 10
    assert a != sorted(r.event_id for r in S.hash_sample(docs, 10, 8).collect())
    texts, key, sheet = S.review_sample(docs, 10, 7)
    assert sorted(r.number for r in texts.collect()) == list(range(1, 11)) and "event_id" not in texts.columns + sheet.columns
    assert sorted(r.event_id for r in key.collect()) == a and all("Alpha" not in r.text for r in texts.collect())


def test_sinks(spark, tmp_path):
    d = dt.date(2024, 1, 1)
    series = spark.createDataFrame([("a", d, 0.1), ("b", d.replace(day=2), 0.2)], "series string, date date, ret double")
    market = spark.createDataFrame([(0, d, 0.5)], "pos int, date date, market double")
    wide = {r.date.day: r for r in sinks.wide_daily(series, ["a", "b"], market, "market_SPY").collect()}
    assert wide[1].a == 0.1 and wide[1].b is None and wide[2].b == 0.2 and wide[1].market_SPY == 0.5
    holdings = spark.createDataFrame([(["A", "B"], ["C"])], "longs array<string>, shorts array<string>")
    sinks.write_tables({"h": sinks.holdings_export(holdings)}, str(tmp_path), "csv")
    assert spark.read.csv(str(tmp_path / "h"), header=True).first().longs == "A B"


def test_review_sheet_with_scores_is_not_overwritten(spark, tmp_path):
    folder = str(tmp_path / "review")
    sample = S.review_sample(documents(spark, 12), 10, 7)
    sinks.write_review(*sample, folder)
    sinks.write_review(*sample, folder)
    sheet = T.read_labels(spark, folder + "/labels")
    assert sheet.count() == 10 and sheet.filter("guidance_tone is not null").count() == 0
    filled = spark.createDataFrame([(1, "2", "")], "number int, guidance_tone string, notes string")
    filled.write.mode("append").option("header", True).csv(folder + "/labels")
    with pytest.raises(ValueError, match="partly filled"):
        sinks.write_review(*sample, folder)
