"""Queries that write whole tables and read them back through the readers, and joins of separate score tables.

Everything is written below the session's shared folder. The SQL beside them sees the tables as they
were before.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import text as X
from driftmark.operators import agreement as G
from driftmark.operators import scoring as S
from driftmark.operators.event_study import EventStudy
from driftmark.operators.history import append_history, collapsed, midrank_from_index
from driftmark.plans import catalogue as C
from driftmark.plans import oracle as O
from driftmark.plans import reports as P
from driftmark.plans.study import Backtest, with_scores
from driftmark.plans.warehouse import EARLY_CUTOFF, HOLD_WEEKS, LATE_CUTOFF, MARKET, Warehouse
from driftmark.session import checkpointed, shared_folder
from driftmark.sources import factor_files as FF
from driftmark.sources import filings as L
from driftmark.sources import ledger, sinks
from driftmark.sources import register as R
from driftmark.sources import tables as T


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def universe_table(spark: SparkSession, folder: str) -> DataFrame:
    path = place(spark, "universe")
    Warehouse(spark, folder).universe.write.option("header", True).csv(path)
    return T.read_universe(spark, path)


def price_table(spark: SparkSession, folder: str) -> DataFrame:
    """The price panel written wide, one column per ticker, and read long."""
    w, path = Warehouse(spark, folder), place(spark, "prices")
    w.prices.groupBy("date").pivot("ticker").agg(F.first("close")).write.parquet(path)
    return C.tidy(T.read_prices(spark, path).filter(F.col("close").isNotNull()), digits=7)


def factor_table(spark: SparkSession, folder: str) -> DataFrame:
    """Two factor sets joined on their dates, written as one CSV table and read back."""
    every, path = C.split_returns(Warehouse(spark, folder)), place(spark, "factors")
    joined = FF.join_factors(every.drop("Mom"), every.filter(F.col("Mom").isNotNull()).select("date", "Mom"))
    columns = [F.col(f"`{c}`") if c in joined.columns else F.lit(None).cast("double").alias(c) for c in ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF", "Mom")]
    joined.select("date", *columns).write.option("header", True).csv(path)
    return C.tidy(T.read_factors(spark, path).drop("RF"), digits=8)


def answer_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Answers as JSON lines, every third written again later, every fifth followed by a line cut off."""
    w, path = Warehouse(spark, folder), place(spark, "answers")
    rows = w.table("orders").select(F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("event_id"))

    def lines(df: DataFrame, score: int) -> DataFrame:
        record = F.to_json(F.struct(F.concat(F.lit("k"), "event_id").alias("key"), "event_id", F.lit(score).alias("guidance_tone")))
        return df.select(F.explode(F.when(F.col("n") % 5 == 0, F.array(record, F.substring(record, 1, 12))).otherwise(F.array(record))).alias("value"))

    lines(rows, 1).write.text(path)
    lines(rows.filter("n % 3 = 0"), 2).write.mode("append").text(path)
    return T.read_answer_lines(spark, path).select("key", "event_id", "guidance_tone")


def answers_by_event(spark: SparkSession, folder: str) -> DataFrame:
    """The append-only table after two runs, its last good answers in the order of the events."""
    w, path = Warehouse(spark, folder), place(spark, "answers")
    d = w.documents_on_orders

    def run(df: DataFrame, when: str, error) -> None:
        given = {"event_id": F.col("event_id"), "model": F.lit(C.MODEL), "prompt_version": F.lit(C.PROMPT), "rep": F.lit(1), "guidance_tone": F.col("guidance_tone"),
                 "error": error, "ingested_at": F.lit(when).cast("timestamp")}
        kinds = [f.strip().split(" ") for f in S.ANSWER_SCHEMA.split(",")]
        rows = S.with_keys(df, C.MODEL, C.PROMPT).withColumn("event_id", F.col("event_id"))
        ledger.append_answers(rows.select(*[F.col("key") if n == "key" else given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds]), path)

    number = F.col("event_id").cast("long")
    run(d, "2024-01-01", F.when(number % 4 == 0, "limit reached"))
    run(d.filter(number % 6 == 0).withColumn("guidance_tone", F.lit(0)), "2024-01-02", F.lit(None))
    last = S.latest_answers(ledger.read_answers(spark, path)).select("event_id", F.col("guidance_tone").alias("answer"))
    return d.select("event_id", "published_at").join(last, "event_id").orderBy("published_at", "event_id")


def lexicon_table(spark: SparkSession, folder: str) -> DataFrame:
    """A dictionary file of all benchmark words, class years as flags."""
    path = place(spark, "lexicon")
    words = (Warehouse(spark, folder).table("benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("w"))
             .groupBy(F.lower("w").alias("Word")).agg(F.when(F.min("item_id") % 3 == 0, 2009).otherwise(0).alias("Positive"),
                                                      F.when(F.max("item_id") % 4 == 1, 2014).otherwise(0).alias("Negative")))
    words.write.option("header", True).csv(path)
    return T.read_lexicon(spark, path)


def cut_rater_text(spark: SparkSession, folder: str) -> DataFrame:
    """What a rater with a limit of 400 characters sees; the limit is the operator."""
    shown = X.rater_text(F.col("text"), F.upper("lang"), F.col("source"), 400)
    return Warehouse(spark, folder).table("documents").select("doc_id", shown.alias("masked"))


def filing_union(spark: SparkSession, folder: str) -> DataFrame:
    """Filings from recent and older pages together."""
    pages = C.filing_pages(Warehouse(spark, folder))
    recent = F.array_max("filingDate") >= "1999-01-01"
    return L.filing_rows(pages.filter(recent), pages.filter(~recent)).select("company_no", "accessionNumber", "form", "items", "filingDate")


def event_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Events beside two score tables, each of which lacks some of them."""
    w = Warehouse(spark, folder)
    number = F.col("event_id").cast("long")
    main = w.scored.filter(number % 5 != 0).select("event_id", "tone")
    other = w.scored.filter(number % 7 != 0).select("event_id", F.col("guidance_other").alias("tone_other"))
    return C.tidy(with_scores(w.documents_on_orders.select("event_id", "ticker", "published_at"), main, other))


def two_rater_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Period table over two raters with score tables of their own, on the events both have scored."""
    w = Warehouse(spark, folder)
    events = w.documents_on_orders.select("event_id", "ticker", "published_at")
    main = w.scored.select("event_id", F.col("tone").alias("main"))
    other = w.scored.filter(F.col("event_id").cast("long") % 4 != 0).select("event_id", F.col("guidance_other").alias("other"))
    panel = EventStudy(with_scores(events, main), w.market, hold_days=HOLD_WEEKS).panel.join(other, "event_id")
    return C.tidy(P.period_table(panel, ["main", "other"], f"car_1_{HOLD_WEEKS}", LATE_CUTOFF, EARLY_CUTOFF), digits=7)


def written_results(spark: SparkSession, folder: str) -> DataFrame:
    """All result tables of a study written out; the daily returns come back."""
    path = place(spark, "results")
    C.backtest(spark, folder).write(path, "tone")
    return C.tidy(spark.read.parquet(f"{path}/daily_returns"))


def report_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The tidy tables of the report from one summary."""
    summary = checkpointed(C.backtest_summary(spark, folder))
    tables = {"stats": P.stats_table(summary, C.SIGNALS), "topics": P.topic_table(summary, C.SIGNALS[1:]), "thin": P.thin_book_table(summary, "tone")}
    out = None
    for name, table in tables.items():
        named = table.select(F.lit(name).alias("report"), "signal", "measure", "value")
        out = named if out is None else out.unionByName(named)
    return out


def entry_delay_report(spark: SparkSession, folder: str) -> DataFrame:
    return C.tidy(P.entry_delay_table(C.backtest(spark, folder).entry_delay("tone")), digits=8)


def consistency_report(spark: SparkSession, folder: str) -> DataFrame:
    return P.consistency_table(C.consistency(spark, folder))


def events_file(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as an event file in which every 89th time cannot be read and every 97th is missing."""
    d, path, n = Warehouse(spark, folder).documents_on_orders, place(spark, "events"), F.col("event_id").cast("long")
    time = F.when(n % 89 == 0, F.concat(F.lit("day "), (n % 7).cast("string"))).when(n % 97 != 0, F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    d.select("event_id", "ticker", time.alias("published_at"), F.concat(F.lit("list-"), (n % 3).cast("string")).alias("source"), F.lit("f").alias("form"),
             F.lit("u").alias("url"), F.lit("p").alias("path")).write.option("header", True).csv(path)
    return T.read_events(spark, path)


def events_from_file(spark: SparkSession, folder: str) -> DataFrame:
    """The events of the window, as read from their file."""
    return T.in_window(events_file(spark, folder), "1995-01-01", "2000-06-30", "1997-07-01").select("event_id", "ticker", "published_at")


def event_time_report(spark: SparkSession, folder: str) -> DataFrame:
    return T.time_report(events_file(spark, folder))


def register_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Events of twelve months put into the register, then a second batch for the last three of them.

    The register comes back with whether a row's file is one that the first batch wrote.
    """
    path, n = place(spark, "register"), F.col("event_id") % 12
    e = Warehouse(spark, folder).table("events")

    def batch(kept: Column, source: str) -> DataFrame:
        return e.filter(kept).select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("ticker"),
                                     (F.col("ts") + F.make_ym_interval(F.lit(0), n.cast("int"))).alias("published_at"),
                                     F.lit(source).alias("source"), F.lit("log").alias("form"), F.lit("").alias("url"), F.col("props").alias("path"))

    file = ["_metadata.file_path", "_metadata.file_modification_time"]
    R.upsert_register(spark, batch(F.col("event_id") % 5 != 0, "first"), path)
    # the list of files as it was; a file of a register is few rows of this list
    before = checkpointed(R.read_register(spark, path).select(*file).distinct().withColumn("as_it_was", F.lit(True)))
    R.upsert_register(spark, batch(n >= 9, "second"), path)
    rows = R.read_register(spark, path).select("event_id", "ticker", "published_at", "source", "month", *file)
    return (rows.join(before, ["file_path", "file_modification_time"], "left")
            .select("event_id", "ticker", "published_at", "source", "month", F.coalesce("as_it_was", F.lit(False)).alias("file_kept")))


def manifest_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a file of its own beside a manifest, read back through the manifest."""
    path, c = place(spark, "texts"), Warehouse(spark, folder).table("conversations")
    minutes = F.col("conv_id") * 10 + F.col("turn")
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(minutes / 1440).cast("int"), mins=(minutes % 1440).cast("int"))
    turns = c.select(F.upper("role").alias("ticker"), start.alias("published_at"), F.concat(F.concat_ws("/", F.lit("c"), "conv_id", "turn"), F.lit(".txt")).alias("path"), "text")
    R.write_texts(turns, path).agg(F.sum("bytes")).collect()
    turns.drop("text").write.option("header", True).csv(f"{path}/manifest")
    return R.read_manifest(spark, f"{path}/manifest").select("event_id", "path", "text")


def label_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Human labels beside two raters, from a label sheet, its key and both raters' scored events, all stored apart."""
    w, path = Warehouse(spark, folder), place(spark, "review")
    event, number = F.concat(F.lit("d"), "doc_id").alias("event_id"), (F.col("doc_id") + 1000).cast("int").alias("number")
    labels = w.table("labels")
    given = F.when(F.col("doc_id") % 7 != 0, (F.col("quality") - F.col("toxic")).cast("string"))
    sinks.write_review(labels.select(number, F.lit("text").alias("text")), labels.select(number, event),
                       labels.select(number, given.alias("guidance_tone"), F.lit("").alias("notes")), path)
    tone = X.word_tone(w.table("documents"), "text", C.POSITIVE, C.NEGATIVE, ["doc_id", "n_chars"])
    main = F.when(F.col("lm") > 0.3, 1).when(F.col("lm") < -0.3, -1).otherwise(0).cast("double")
    other = (F.col("n_chars") % 3 - 1).cast("double")
    sinks.write_tables({"main": tone.filter("doc_id % 11 != 0").select(event, main.alias("guidance_tone")),
                        "other": tone.select(event, F.when(F.col("doc_id") % 13 != 0, other).alias("guidance_tone"))}, path)
    stored = [spark.read.parquet(f"{path}/{name}") for name in ("key", "main", "other")]
    return G.label_chain(T.read_labels(spark, f"{path}/labels"), *stored)


def history_kept_index(spark: SparkSession, folder: str) -> DataFrame:
    """The history mid-rank from a kept index: the earlier days are filed and answered first, then the later ones."""
    path, cells = place(spark, "history"), checkpointed(collapsed(C.backtest(spark, folder).rows))
    half = F.col("t0_pos") < 170
    answers = []
    for batch in (cells.filter(half), cells.filter(~half)):
        append_history(batch, path)
        answers.append(midrank_from_index(spark, path, batch))
    return C.tidy(answers[0].unionByName(answers[1]))


def written_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All other result tables of a study as they were written, in one tidy table."""
    path = place(spark, "results")
    C.backtest(spark, folder).write(path, "tone", rater=C.MODEL, model_version="build")
    text, none = F.lit(None).cast("string"), F.lit(None).cast("double")

    def numbers(name: str, key: Column, columns: list[str], digits: int) -> DataFrame:
        table = spark.read.parquet(f"{path}/{name}").select(key.cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in columns])
        return C.tidy(table.unpivot("key", columns, "measure", "value"), "value", digits=digits).select(F.lit(name).alias("table"), "key", "measure", text.alias("text"), "value")

    holdings = spark.read.parquet(f"{path}/holdings")
    sides = [holdings.select(F.lit("holdings").alias("table"), F.concat_ws(" ", "signal", F.date_format("rebalance", "yyyy-MM-dd")).alias("key"), F.lit(side).alias("measure"),
                             F.array_join(side, " ").alias("text"), none.alias("value")) for side in ("longs", "shorts")]
    meta = spark.read.parquet(f"{path}/meta").select(F.lit("meta").alias("table"), F.lit("run").alias("key"), F.lit("terms").alias("measure"), F.concat_ws(
        " ", "benchmark", "rater", "model_version", F.date_format("training_cutoff", "yyyy-MM-dd"), F.date_format("first_event", "yyyy-MM-dd"),
        F.date_format("last_event", "yyyy-MM-dd"), F.when(F.col("has_factors"), "factors").otherwise("no factors")).alias("text"), none.alias("value"))
    parts = [numbers("summary", F.col("signal"), list(SUMMARY_MEASURES), 7), numbers("ic_by_season", F.col("season"), list(C.SIGNALS), 9),
             numbers("events_scored", F.col("event_id"), ["ar_day0", f"car_1_{HOLD_WEEKS}", *C.SIGNALS], 9),
             numbers("entry_delay", F.col("delay_days"), ["sharpe_net", "ann_return_net"], 8),
             numbers("meta", F.lit("run"), ["n_events", "n_tickers", "hold_days", "cost_bps", "borrow_bps", "median_days_to_trade"], 9), meta, *sides]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Measures of the summary that a book without factors has.
SUMMARY_MEASURES = ("n_events", "pooled_ic", "post_cutoff_n", "mean_ic", "ic_t", "seasons", "hit_rate", "hit_n", "seasonal_net_sharpe", "event_net_sharpe",
                    "event_net_max_drawdown", "event_gross_days", "seasonal_periods")

QUERIES = {f.__name__: f for f in (
    events_from_file, event_time_report, register_upsert, manifest_texts, label_chain, written_tables, history_kept_index,
    universe_table, price_table, factor_table, answer_lines, answers_by_event, lexicon_table, cut_rater_text, filing_union,
    event_scores, two_rater_periods, written_results, report_tables, entry_delay_report, consistency_report)}

_PERIOD_TAIL = O.PERIODS[len(O.ROWS):]


def _report(name: str, measures, where: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS report, signal, '{m}' AS measure, CAST(\"{m}\" AS DOUBLE) AS value FROM summary {where}" for m in measures)


_EVENTS_FILE = O.BASE + """, listed AS (SELECT event_id, ticker, CASE WHEN okey % 89 <> 0 AND okey % 97 <> 0 THEN published_at END AS published_at,
  'list-' || okey % 3 AS source, CASE WHEN okey % 89 = 0 THEN 'day ' || okey % 7 END AS unread FROM docs)"""


def _numbers(name: str, key: str, measures, source: str) -> list[str]:
    return [f"SELECT '{name}' AS \"table\", CAST({key} AS VARCHAR) AS key, '{m}' AS measure, NULL::VARCHAR AS text, CAST(\"{m}\" AS DOUBLE) AS value FROM {source}" for m in measures]


def _held(side: str) -> str:
    return f"SELECT 'holdings', signal || ' ' || strftime(rebalance, '%Y-%m-%d'), '{side}', {side}, NULL::DOUBLE FROM held"


_WRITTEN = " UNION ALL ".join((
    *_numbers("summary", "signal", SUMMARY_MEASURES, "summary_rows"), *_numbers("ic_by_season", "season", C.SIGNALS, "season_rows"),
    *_numbers("events_scored", "event_id", ("ar_day0", f"car_1_{HOLD_WEEKS}", *C.SIGNALS), "event_rows"),
    *_numbers("entry_delay", "delay_days", ("sharpe_net", "ann_return_net"), "(SELECT * FROM delay_rows WHERE signal = 'tone')"),
    *_numbers("meta", "'run'", ("n_events", "n_tickers", "hold_days", "cost_bps", "borrow_bps", "median_days_to_trade"), "meta_rows"),
    """SELECT 'meta', 'run', 'terms', benchmark || ' rater-a build ' || training_cutoff || ' ' || first_event || ' ' || last_event || ' no factors', NULL::DOUBLE FROM meta_rows""",
    _held("longs"), _held("shorts")))

ORACLE = {
    "events_from_file": _EVENTS_FILE + """ SELECT event_id, ticker, published_at FROM listed
        WHERE published_at >= TIMESTAMP '1997-07-01' AND published_at < TIMESTAMP '2000-07-01'""",
    "event_time_report": _EVENTS_FILE + """ SELECT source, count(*) AS events, count(*) FILTER (published_at IS NULL AND unread IS NULL) AS without_time,
        count(unread) AS unreadable, min(unread) AS example FROM listed GROUP BY 1""",
    "history_kept_index": O.ORACLE["history_midrank"],
    "register_upsert": """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS ticker, moment AS published_at,
        CASE WHEN event_id % 5 <> 0 THEN 'first' ELSE 'second' END AS source, strftime(moment, '%Y-%m') AS month, event_id % 12 < 9 AS file_kept
        FROM (SELECT *, ts + to_months(CAST(event_id % 12 AS INTEGER)) AS moment FROM events) WHERE event_id % 5 <> 0 OR event_id % 12 >= 9""",
    "manifest_texts": """SELECT upper(role) || '_call_' || strftime(TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn), '%Y%m%d%H%M') AS event_id,
        'c/' || conv_id || '/' || turn || '.txt' AS path, coalesce(text, '') AS text FROM conversations""",
    "label_chain": O.LABELS + """ SELECT 'd' || doc_id AS event_id, human, main, other FROM ratings WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0""",
    "written_tables": f"""WITH summary_rows AS ({O.SUMMARY}), season_rows AS ({O.ORACLE['ic_season_table']}), event_rows AS ({O.ORACLE['scored_events']}),
        delay_rows AS ({O.DELAYS}), meta_rows AS ({O.ORACLE['run_meta']}), held AS ({O.ORACLE['seasonal_holdings']}) """ + _WRITTEN,
    "universe_table": """SELECT DISTINCT p_brand AS ticker, p_brand AS name, 'SEC' || CAST(substr(p_brand, 7) AS INT) % 5 AS sector,
        'SEC' || CAST(substr(p_brand, 7) AS INT) % 5 AS sector_etf, CAST(substr(p_brand, 7) AS BIGINT) AS cik FROM part""",
    "price_table": O.BASE + f" SELECT ticker, date, {O.r('close', 7)} AS close FROM prices",
    "factor_table": O.BASE + O.SPLITS + " SELECT date, " + ", ".join(
        f'{O.r(chr(34) + c + chr(34), 8)} AS "{c}"' for c in ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "Mom")) + ' FROM factors WHERE "Mom" IS NOT NULL',
    "answer_lines": """SELECT 'k' || o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS event_id,
        CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS guidance_tone FROM orders""",
    "answers_by_event": O.BASE + """ SELECT event_id, published_at, CAST(CASE WHEN okey % 6 = 0 THEN 0 ELSE guidance_tone END AS INTEGER) AS answer
        FROM docs WHERE okey % 4 <> 0 OR okey % 6 = 0""",
    "lexicon_table": """SELECT word, min(item_id) % 3 = 0 AS positive, max(item_id) % 4 = 1 AS negative FROM (
        SELECT item_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: upper(x))) AS word FROM benchmark) GROUP BY 1""",
    "cut_rater_text": "WITH " + O.masked_of("SELECT doc_id, substr(text, 1, 400) AS body, upper(lang) AS ticker, source AS name, source AS core FROM documents")
        + " SELECT doc_id, masked FROM masked",
    "filing_union": """SELECT o_custkey AS company_no, printf('%010d-24-%06d', o_orderkey, o_orderkey % 1000) AS "accessionNumber",
        CASE WHEN o_orderstatus = 'F' THEN '8-K' ELSE '10-Q' END AS form,
        CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN '2.02,9.01' WHEN '3' THEN '12.02' WHEN '4' THEN '7.01,2.02' WHEN '5' THEN '5.02' END AS items,
        strftime(o_orderdate, '%Y-%m-%d') AS "filingDate" FROM orders""",
    "event_scores": O.BASE + f""" SELECT event_id, ticker, published_at, {O.r('CASE WHEN okey % 5 <> 0 THEN tone END')} AS tone,
        CASE WHEN okey % 7 <> 0 THEN guidance_other END AS tone_other FROM scored""",
    "two_rater_periods": O.PANEL + """,
sig AS (
  SELECT * FROM (SELECT 'main' AS signal, tone AS value, * FROM panel UNION ALL SELECT 'other', CAST(guidance_other AS DOUBLE), * FROM panel)
  WHERE car IS NOT NULL AND okey % 4 <> 0)""" + _PERIOD_TAIL,
    "written_results": O.DAILY,
    "report_tables": f"WITH summary AS ({O.SUMMARY}) " + " UNION ALL ".join((
        _report("stats", P.ALL_MEASURES, ""), _report("topics", P.TOPIC, "WHERE signal <> 'tone'"),
        _report("thin", P.THIN_BOOK, "WHERE signal = 'tone' AND event_median_names_long IS NOT NULL"))),
    "entry_delay_report": f"SELECT delay_days, sharpe_net FROM ({O.ORACLE['entry_delay_sweep']}) WHERE signal = 'tone'",
    "consistency_report": f"WITH c AS ({O.ORACLE['consistency']}) " + " UNION ALL ".join(
        f"SELECT dimension, n, '{m}' AS measure, {m} AS value FROM c" for m in ("exact", "within_one", "spearman", "kappa")),
}
