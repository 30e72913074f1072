"""Registered queries: each takes (spark, folder) and runs over whole tables."""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import answers as A
from driftmark.functions import text as X
from driftmark.operators import agreement as G
from driftmark.operators import ranks as R
from driftmark.operators import scoring as S
from driftmark.operators.calendar import assign_t0, rebalance_dates, season_label
from driftmark.operators.event_study import EventStudy, PricePanel
from driftmark.operators.factor_model import factor_regression
from driftmark.operators.history import historical_midrank
from driftmark.operators.performance import long_series, perf_stats
from driftmark.operators.signals import build_signals
from driftmark.plans import reports as P
from driftmark.plans.study import Backtest, with_scores
from driftmark.plans.warehouse import EARLY_CUTOFF, HOLD_WEEKS, LATE_CUTOFF, MARKET, Warehouse, fund_close
from driftmark.session import checkpointed, shared_folder, together
from driftmark.sources import factor_files as FF
from driftmark.sources import filings as L
from driftmark.sources import ledger
from driftmark.sources import register as E
from driftmark.sources import sinks
from driftmark.sources import tables as T

SIGNALS = ("tone", "guidance_tone", "size")
MODEL, PROMPT = "rater-a", "v1"
SEED = 7

# A small dictionary of words found in the documents.
POSITIVE = ("the", "and", "la", "de", "und", "is", "are", "that", "est", "of", "on", "in", "whou", "les")
NEGATIVE = ("or", "was", "be", "ist", "nicht", "il", "un", "une", "der", "by", "for", "with", "the", "an")

LISTED = (frozenset(w.upper() for w in POSITIVE), frozenset(w.upper() for w in NEGATIVE))

# Put behind every page, so that the hard cases of page text occur.
PAGE_END = ("<p>3 < 4 and 5 > 2 &pound;7&nbsp;&eacute;&#163; &#x20AC;&#38;amp; &amp;lt; &nosuch; &#150;</p>"
            "<STYLE>a{}</STYLE ><!-- left <b>out</b> --><script>var x = 'no end';")

Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Round the named double columns (all doubles if none is named) and drop negative zeros."""
    chosen = set(columns) or {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if c in chosen else F.col(f"`{c}`")
                       for c in df.columns])


def backtest(spark: SparkSession, folder: str, factors: DataFrame | None = None) -> Backtest:
    return Backtest(Warehouse(spark, folder).study, SIGNALS, training_cutoff=LATE_CUTOFF, factors=factors)


# -- alignment and returns -------------------------------------------------------------------

def returns_calendar_row(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(Warehouse(spark, folder).market.returns.select("ticker", "pos", "date", "ret"))


def undated_some(w: Warehouse) -> DataFrame:
    """Documents of which every 97th has lost its publication time."""
    kept = F.when(F.col("event_id").cast("long") % 97 != 0, F.col("published_at"))
    return w.documents_on_orders.withColumn("published_at", kept)


def assign_entry_day(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return assign_t0(undated_some(w), w.market.calendar).select("event_id", "t0_pos", "t0")


def assign_entry_day_lagged(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return assign_t0(undated_some(w), w.market.calendar, 2).select("event_id", "t0_pos", "t0")


def car_query(study: EventStudy) -> DataFrame:
    return tidy(study.panel.select("event_id", "ticker", "t0", "ar_day0", F.col(study.target).alias("car")))


def event_car(spark: SparkSession, folder: str) -> DataFrame:
    return car_query(Warehouse(spark, folder).study)


def event_car_to_calendar_end(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty positions ahead, so the last documents run past the calendar."""
    w = Warehouse(spark, folder)
    return car_query(EventStudy(w.scored, w.market, hold_days=20))


def sector_benchmark_car(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return car_query(EventStudy(w.scored, w.market, w.universe, benchmark="sector", hold_days=HOLD_WEEKS))


def car_paths(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(Warehouse(spark, folder).study.document_paths())


def season_labels(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return w.study.dated.select("event_id", "t0", season_label(F.col("t0"), w.study.months).alias("season"))


def rebalance_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed to start in the middle of a rebalance month."""
    return rebalance_dates(Warehouse(spark, folder).market.calendar, (3, 6, 9, 12), "1996-03-15", "2000-12-31")


def post_cutoff_counts(spark: SparkSession, folder: str) -> DataFrame:
    panel = backtest(spark, folder).panel
    return panel.groupBy("season", "post_cutoff").agg(F.count("*").alias("documents"))


def events_in_window(spark: SparkSession, folder: str) -> DataFrame:
    events = Warehouse(spark, folder).documents_on_orders
    return T.in_window(events, "1995-01-01", "2000-06-30", "1997-07-01").select("event_id", "published_at")


# -- rank statistics -------------------------------------------------------------------------

def ic_by_season(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).ics)


def ic_summary(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(R.ic_summary(backtest(spark, folder).ics), digits=8)


def ic_season_table(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(sinks.ic_table(backtest(spark, folder).ics, SIGNALS))


def pooled_spearman(spark: SparkSession, folder: str) -> DataFrame:
    b = backtest(spark, folder)
    return tidy(R.pooled_ic(b.rows, b.study.target))


def quantile_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    b = backtest(spark, folder)
    return tidy(R.hit_rate(b.quantiled(), b.study.target))


def quantile_members(spark: SparkSession, folder: str) -> DataFrame:
    return backtest(spark, folder).quantiled().select("signal", "event_id", "quantile")


def car_path_by_quintile(spark: SparkSession, folder: str) -> DataFrame:
    b = backtest(spark, folder)
    return tidy(P.quantile_paths(b.quantiled(), b.study.paths))


def period_split_ic(spark: SparkSession, folder: str) -> DataFrame:
    b = backtest(spark, folder)
    table = P.period_table(b.panel, SIGNALS, b.study.target, LATE_CUTOFF, EARLY_CUTOFF)
    return tidy(table, digits=7)


def multiple_testing_flags(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(P.multiple_testing_flags(R.ic_summary(backtest(spark, folder).ics), SIGNALS), digits=8)


def ic_chart(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(P.ic_chart(backtest(spark, folder).ics))


# -- texts, pages and answers ----------------------------------------------------------------

def lm_tone(spark: SparkSession, folder: str) -> DataFrame:
    docs = Warehouse(spark, folder).table("documents")
    return tidy(X.word_tone(docs, "text", POSITIVE, NEGATIVE, ["doc_id"]))


def lm_tone_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The same through the join a large dictionary needs; the dictionary comes from the benchmark texts."""
    w = Warehouse(spark, folder)
    words = (w.table("benchmark").select("item_id", F.explode(X.tokens(F.col("text"))).alias("word"))
             .groupBy("word").agg((F.min("item_id") % 3 == 0).alias("positive"),
                                  (F.max("item_id") % 3 == 1).alias("negative")))
    return tidy(X.word_tone_joined(w.table("documents"), "text", words, "doc_id"))


def mask_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Each document loses its own first two words as the name and its fourth as the ticker."""
    docs = Warehouse(spark, folder).table("documents")
    word = F.split("text", r"\s+", 5)
    name = F.concat_ws(" ", F.get(word, F.lit(0)), F.get(word, F.lit(1)), F.lit("Inc."))
    masked = X.mask_identity(F.concat(F.col("text"), F.lit(" On January 30, 2025 fiscal '24 ended; since 1999.")),
                             F.get(word, F.lit(3)), name)
    return docs.select("doc_id", masked.alias("masked"))


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a bare less-than sign, all sorts of character references and a script that never ends."""
    pages = Warehouse(spark, folder).table("pages")
    return pages.select("page_id", X.html_to_text(F.concat("html", F.lit(PAGE_END))).alias("text"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every link of every page, made absolute."""
    pages = Warehouse(spark, folder).table("pages")
    links = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("place", "href")
    base = F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("/"))
    return pages.select("page_id", base.alias("base"), links) \
        .select("page_id", "place", L.resolve_link(F.col("href"), F.col("base")).alias("link"))


def volume_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(X.volume_estimate(Warehouse(spark, folder).table("documents"), "text"))


def answer_texts(w: Warehouse) -> DataFrame:
    """Answers as a rater would write them: every 11th cut in its reason, every 13th before it,
    every 17th with a score out of range."""
    d = w.documents_on_orders
    key = F.col("event_id").cast("long")
    overall = F.when(key % 17 == 0, 3).otherwise(F.col("overall_tone"))
    whole = F.format_string(
        '{"guidance_tone": %d, "guidance_mentioned": true, "margins_tone": %d, "margins_mentioned": %s, '
        '"demand_tone": %d, "demand_mentioned": %s, "overall_tone": %d, "reason": "order %s"}',
        "guidance_tone", "margins_tone", F.col("margins_mentioned").cast("string"), "demand_tone",
        F.col("demand_mentioned").cast("string"), overall, "event_id")
    answer = (F.when(key % 13 == 0, F.substring(whole, 1, 40))
              .when(key % 11 == 0, F.regexp_replace(whole, '"}$', ""))
              .otherwise(whole))
    return d.select("event_id", answer.alias("answer"))


ANSWER_OUT = ("event_id", "guidance_tone", "margins_tone", "demand_tone", "overall_tone", "margins_mentioned",
              "demand_mentioned", "reason", "reason_truncated")


def parsed_answers(spark: SparkSession, folder: str) -> DataFrame:
    parsed = A.parse_answers(answer_texts(Warehouse(spark, folder)), "answer")
    return A.accepted(parsed).select(*ANSWER_OUT)


def rejected_answers(spark: SparkSession, folder: str) -> DataFrame:
    parsed = A.parse_answers(answer_texts(Warehouse(spark, folder)), "answer")
    return A.rejected(parsed).select("event_id", "error")


def balance_rater(text: str, row: dict) -> dict:
    """A word-list rater: which of the two lists a masked text draws more words from. It fails on texts with neither."""
    heard = [w.upper() for w in re.findall(X.WORD, text)]
    p, n = sum(w in LISTED[0] for w in heard), sum(w in LISTED[1] for w in heard)
    if not p + n:
        raise ValueError("no listed word")
    return {"guidance_tone": (p > n) - (p < n), "guidance_mentioned": True, "margins_tone": p % 5 - 2, "margins_mentioned": True,
            "demand_tone": 0, "demand_mentioned": False, "overall_tone": n % 5 - 2,
            "reason": f"{len(text)} characters from {row['name']}"}


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The incremental job over all documents with masking, half of them answered by an earlier run."""
    docs = Warehouse(spark, folder).table("documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.upper("lang").alias("ticker"), F.col("source").alias("name"), "text", "doc_id")
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    S.score_into(spark, docs.filter("doc_id % 2 = 0"), balance_rater, path, MODEL, PROMPT)
    answers = S.score_into(spark, docs, balance_rater, path, MODEL, PROMPT)
    return answers.select("key", "event_id", "guidance_tone", "margins_tone", "overall_tone", "reason")


def answer_log(w: Warehouse) -> DataFrame:
    """An append-only log: one line per order line, later lines replace earlier ones."""
    lines = w.table("lineitem")
    columns = [F.col("l_orderkey").cast("string").alias("event_id"), F.lit(MODEL).alias("model"),
               F.lit(PROMPT).alias("prompt_version"), F.lit(1).alias("rep"),
               (F.col("l_linenumber") % 5 - 2).cast("int").alias("guidance_tone"),
               F.concat(F.lit("build-"), F.lower("l_returnflag")).alias("model_id"),
               F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("ingested_at")]
    rows = lines.select(*columns)
    return rows.withColumn("key", A.answer_key(F.col("event_id"), F.col("model"), F.col("prompt_version"), F.col("rep")))


def latest_answers(spark: SparkSession, folder: str) -> DataFrame:
    return S.latest_answers(answer_log(Warehouse(spark, folder))).select("key", "event_id", "guidance_tone", "model_id")


def stored_log(spark: SparkSession, w: Warehouse) -> str:
    """The log of all order lines as a ledger, beside another rater's answers to every order."""
    path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    when = F.col("ingested_at.l_shipdate").cast("timestamp").alias("ingested_at")
    given = {"ingested_at": when} | {c: F.col(c) for c in ("key", "event_id", "model", "prompt_version", "rep", "guidance_tone", "model_id")}
    kinds = [f.strip().split(" ") for f in ledger.SCHEMA.split(",")]
    log = answer_log(w).select(*[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds])
    ledger.append_answers(log, path)
    other = w.table("orders").select(F.col("o_orderkey").cast("string").alias("event_id"))
    empty = [F.lit(None).cast(k).alias(n) for n, k in kinds if n not in ("key", "event_id", "model", "prompt_version", "rep")]
    ledger.append_answers(S.with_keys(other, "rater-b", PROMPT).select("key", "event_id", F.lit("rater-b").alias("model"), F.lit(PROMPT).alias("prompt_version"), F.lit(1).alias("rep"), *empty)
                          .select(*ledger.COLUMNS), path)
    return path


def incremental_todo(spark: SparkSession, folder: str) -> DataFrame:
    """Orders without an answer of this rater in the stored ledger."""
    w = Warehouse(spark, folder)
    orders = w.table("orders").select(F.col("o_orderkey").cast("string").alias("event_id"))
    keyed = S.with_keys(orders, MODEL, PROMPT)
    stored = ledger.answers_of(spark, stored_log(spark, w), MODEL, PROMPT)
    return keyed.join(ledger.answered_keys(stored, keyed), "key", "left_anti").select("key", "event_id")


def model_version(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return S.model_ids(answer_log(w), w.documents_on_orders, MODEL, "configured")


def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of 40 documents; the limit is the operator."""
    return S.hash_sample(Warehouse(spark, folder).documents_on_orders, 40, SEED).select("event_id", "ticker")


def first_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 earliest documents; the limit is the operator."""
    return S.first_documents(Warehouse(spark, folder).documents_on_orders, 50).select("event_id", "ticker", "published_at")


def review_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The blind reading sample of 30 texts with its key."""
    docs = Warehouse(spark, folder).table("documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.upper("lang").alias("ticker"),
        F.col("source").alias("name"), "text")
    texts, key, _ = S.review_sample(docs, 30, 11)
    return texts.join(key, "number").select("number", "event_id", F.length("text").alias("characters"))


# -- signals ---------------------------------------------------------------------------------

def order_signals(w: Warehouse) -> DataFrame:
    d = w.documents_on_orders
    scores = d.select("event_id", "guidance_tone", "margins_tone", "demand_tone", "overall_tone",
                      "guidance_mentioned", "margins_mentioned", "demand_mentioned")
    return build_signals(scores, d)


def build_tone_signals(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(order_signals(Warehouse(spark, folder)).drop("tone_delta"))


def signal_delta(spark: SparkSession, folder: str) -> DataFrame:
    return order_signals(Warehouse(spark, folder)).select("event_id", "tone_delta")


# -- books -----------------------------------------------------------------------------------

def history_midrank(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(historical_midrank(backtest(spark, folder).rows))


def event_time_legs(spark: SparkSession, folder: str) -> DataFrame:
    return backtest(spark, folder).event_time.documents().select("signal", "event_id", "n_prior", "leg")


def event_time_returns(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).event_time.returns)


def book_exposure(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).event_time.exposure())


def entry_delay_sweep(spark: SparkSession, folder: str) -> DataFrame:
    daily = backtest(spark, folder).event_time.delayed_returns((0, 5, 10, 20, 40))
    return tidy(perf_stats(daily, ["signal", "delay_days"], "net")
                .select("signal", "delay_days", F.col("sharpe").alias("sharpe_net"),
                        F.col("ann_return").alias("ann_return_net")), digits=8)


def seasonal_holdings(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(sinks.holdings_export(backtest(spark, folder).seasonal.holdings))


def seasonal_turnover(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).seasonal.turnover)


def seasonal_period_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).seasonal.period_stats())


def seasonal_returns(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).seasonal.returns)


def days_to_trade(spark: SparkSession, folder: str) -> DataFrame:
    return backtest(spark, folder).seasonal.days_to_trade()


def book_performance(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).performance, digits=8)


def fund_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Performance of every price series of the panel."""
    return tidy(perf_stats(Warehouse(spark, folder).market.returns, ["ticker"]))


def wealth_chart(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(P.wealth_chart(backtest(spark, folder).books, SIGNALS))


def daily_return_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).daily_returns())


def run_meta(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    return backtest(spark, folder).meta("tone", MODEL, S.model_ids(answer_log(w), w.documents_on_orders, MODEL, "configured").first()[0])


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(backtest(spark, folder).scored_events())


# -- factors ---------------------------------------------------------------------------------

# The two-way splits behind the factors: side -> condition on an order line.
SPLITS = {
    "all": "true",
    "small": "p_size <= 25", "large": "p_size > 25",
    "r": "l_returnflag = 'R'", "n": "l_returnflag = 'N'",
    "o": "l_linestatus = 'O'", "f": "l_linestatus <> 'O'",
    "cheap": "l_discount >= 0.05", "dear": "l_discount < 0.05",
    "taxed": "l_tax >= 0.04", "untaxed": "l_tax < 0.04",
}


def split_returns(w: Warehouse) -> DataFrame:
    """Weekly factor columns from two-way splits of the order lines, one pass over them."""
    lines = w.table("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_returnflag",
                                       "l_linestatus", "l_discount", "l_tax")
    parts = w.table("part").select("p_partkey", "p_size")
    closes = (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
              .agg(*[fund_close(F.when(F.expr(kept), F.col("l_extendedprice")),
                                F.when(F.expr(kept), F.col("l_quantity"))).alias(name) for name, kept in SPLITS.items()])
              .unpivot("date", list(SPLITS), "ticker", "close")
              .filter(F.col("close").isNotNull()))
    panel = PricePanel(checkpointed(closes), "all")

    def side(name: str) -> Column:
        return F.max(F.when(F.col("ticker") == name, F.col("ret")))

    return panel.returns.groupBy("date").agg(
        side("all").alias("Mkt-RF"), (side("small") - side("large")).alias("SMB"),
        (side("r") - side("n")).alias("HML"), (side("o") - side("f")).alias("RMW"),
        (side("cheap") - side("dear")).alias("CMA"), (side("taxed") - side("untaxed")).alias("Mom"))


def factor_returns(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(split_returns(Warehouse(spark, folder)))


def one_factor_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Every brand's returns on the market with Newey-West errors."""
    panel = Warehouse(spark, folder).market
    market = panel.market_returns.select("date", F.col("market").alias("Mkt-RF"))
    brands = panel.returns.filter(F.col("ticker").startswith("Brand"))
    return tidy(factor_regression(brands, market, ["ticker"]), digits=7) \
        .withColumnsRenamed({"beta_Mkt-RF": "beta_mkt", "t_Mkt-RF": "t_mkt"})


def six_factor_regression(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    brands = w.market.returns.filter(F.col("ticker").startswith("Brand"))
    return tidy(factor_regression(brands, split_returns(w), ["ticker"]), digits=6)


def factor_file_text(w: Warehouse) -> DataFrame:
    """Factor files as published, one per year: banner, header, rows in percent, footer."""
    row = F.format_string("%s,%10.4f,%10.4f", F.date_format("date", "yyyyMMdd"), F.col("Mkt-RF") * 100, F.col("SMB") * 100)
    body = F.array_join(F.array_sort(F.collect_list(row)), "\n")
    return (split_returns(w).filter(F.col("Mkt-RF").isNotNull() & F.col("SMB").isNotNull())
            .groupBy(F.year("date").alias("year")).agg(body.alias("body"))
            .select(F.concat(F.lit("factors-"), F.col("year")).alias("file"),
                    F.concat(F.lit("Created from weekly splits\n\n, Mkt-RF , SMB\n"), "body",
                             F.lit("\n\nCopyright 2024, all rights\n20240101,9,9\n")).alias("raw")))


def factor_files(spark: SparkSession, folder: str) -> DataFrame:
    parsed = FF.parse_factor_files(factor_file_text(Warehouse(spark, folder)))
    return tidy(FF.factor_table(parsed, ["Mkt-RF", "SMB"]), digits=8) \
        .withColumnsRenamed({"Mkt-RF": "mkt_rf", "SMB": "smb"})


# -- agreement -------------------------------------------------------------------------------

def rater_agreement(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    d = w.documents_on_orders
    main = d.select("event_id", (F.col("guidance_tone") + 0.1 * F.col("overall_tone")).alias("tone"), "guidance_tone")
    other = d.select("event_id", (F.col("guidance_other") + 0.1 * F.col("demand_tone")).alias("tone"),
                     F.col("guidance_other").alias("guidance_tone"))
    return tidy(G.rater_comparison(main, other, T.in_window(d, "1996-01-01", "2000-12-31")))


def weighted_kappa(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the two raters per company."""
    d = Warehouse(spark, folder).documents_on_orders
    return tidy(G.agreement(d, ["ticker"], "guidance_tone", "guidance_other"))


def consistency(spark: SparkSession, folder: str) -> DataFrame:
    """Two passes of one rater; the second moves a score where the order key says so."""
    d = Warehouse(spark, folder).documents_on_orders
    tones = ["guidance_tone", "overall_tone", "margins_tone", "demand_tone"]
    nudge = F.when(F.col("event_id").cast("long") % 6 == 0, 1).otherwise(0)
    second = d.select("event_id", *[F.least(F.col(t) + nudge, F.lit(2)).alias(t) for t in tones])
    return tidy(G.consistency(d.select("event_id", *tones), second))


def label_ratings(w: Warehouse) -> DataFrame:
    """Human labels (quality minus toxicity) beside two raters that follow the text's length and tone."""
    tone = X.word_tone(w.table("documents"), "text", POSITIVE, NEGATIVE, ["doc_id", "n_chars"])
    main = F.when(F.col("lm") > 0.3, 1).when(F.col("lm") < -0.3, -1).otherwise(0)
    other = (F.col("n_chars") % 3 - 1).cast("int")
    sheet = w.table("labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("guidance_tone"))
    return G.human_labels(sheet).join(tone.select("doc_id", main.alias("main"), other.alias("other")), "doc_id")


def human_check(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(G.three_way(label_ratings(Warehouse(spark, folder))))


def bootstrap_kappa_ci(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(G.reading_verdict(G.bootstrap_kappa_difference(label_ratings(Warehouse(spark, folder)), seed=SEED)))


# -- ingest ----------------------------------------------------------------------------------

def events_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The register holds error events; all events arrive again with a later source tag."""
    e = Warehouse(spark, folder).table("events")

    def rows(source: str) -> DataFrame:
        return e.select(F.col("event_id").cast("string").alias("event_id"),
                        F.col("event_type").alias("ticker"), F.col("ts").alias("published_at"),
                        F.lit(source).alias("source"), F.lit("log").alias("form"), F.lit("").alias("url"),
                        F.col("props").alias("path"))

    return E.upsert_events(rows("register").filter(F.col("ticker") == "error"), rows("arrival"))


def manifest_register(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns registered as a local manifest."""
    c = Warehouse(spark, folder).table("conversations")
    minutes = F.col("conv_id") * 10 + F.col("turn")
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.floor(minutes / 1440).cast("int"), mins=(minutes % 1440).cast("int"))
    manifest = c.select(F.upper("role").alias("ticker"), start.alias("published_at"), F.concat_ws("/", F.lit("c"), "conv_id", "turn").alias("path"))
    return E.manifest_events(manifest).select("event_id", "ticker", "published_at", "path")


# Filing pages hold this many filings, as the directory service pages its answers.
PAGE_FILINGS = 500


def filing_pages(w: Warehouse) -> DataFrame:
    """Orders as filings in struct-of-arrays pages of at most 500 accession numbers per customer."""
    o = w.table("orders")
    page = F.floor(F.col("o_orderkey") / PAGE_FILINGS)
    row = F.struct(
        F.when(F.col("o_orderstatus") == "F", "8-K").otherwise("10-Q").alias("form"),
        F.when(F.col("o_orderpriority").startswith("1"), F.lit(None).cast("string"))
        .when(F.col("o_orderpriority").startswith("2"), "2.02,9.01")
        .when(F.col("o_orderpriority").startswith("3"), "12.02")
        .when(F.col("o_orderpriority").startswith("4"), "7.01,2.02").otherwise("5.02").alias("items"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("filingDate"),
        F.format_string("%010d-24-%06d", F.col("o_orderkey"), F.col("o_orderkey") % 1000).alias("accessionNumber"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"),
                 F.format_string("T%02d:05:12.000Z", F.col("o_orderkey") % 24)).alias("acceptanceDateTime"))
    arrays = F.collect_list(row).alias("rows")
    return (o.groupBy(F.col("o_custkey").alias("company_no"), page.alias("page")).agg(arrays)
            .select("company_no", *[F.col(f"rows.{f}").alias(f) for f in L.FILING_FIELDS]))


def filing_directory(w: Warehouse) -> tuple[DataFrame, DataFrame]:
    """Companies are pairs of customers: the even number is pinned, the odd one is where the ticker points, listed twice."""
    c = w.table("customer").select("c_custkey")
    even = c.filter(F.col("c_custkey") % 2 == 0)
    universe = even.select(F.concat(F.lit("C."), "c_custkey").alias("ticker"),
                           F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey")).alias("cik"))
    listed = even.select(F.concat(F.lit("c-"), "c_custkey").alias("ticker"), "c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    return universe, listed.select("ticker", (F.col("c_custkey") + F.col("place")).alias("company_no"), "place")


def filing_selection(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    candidates = L.company_candidates(*filing_directory(w))
    chosen = L.earnings_filings(candidates, L.filing_rows(filing_pages(w)), "1996-01-01", "2000-12-31")
    known = w.table("lineitem").groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag")).filter("flag = 'R'") \
        .join(w.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")) \
        .select(F.format_string("C.%d_%010d-24-%06d", F.col("o_custkey"), F.col("o_orderkey"),
                                F.col("o_orderkey") % 1000).alias("event_id"))
    return L.not_collected(L.filing_events(chosen), known)


def press_release_links(spark: SparkSession, folder: str) -> DataFrame:
    """Index pages written from each order's lines, one table row per line number, then the press
    release picked from each."""
    lines = (Warehouse(spark, folder).table("lineitem").groupBy("l_orderkey", "l_linenumber")
             .agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("item"))
             .select("l_orderkey", "l_linenumber", "item.*"))
    kind = (F.when(F.col("l_partkey") % 5 == 0, "EX-99.1").when(F.col("l_partkey") % 5 == 1, "ex-99.2")
            .when(F.col("l_partkey") % 5 == 2, "EX-99").when(F.col("l_partkey") % 5 == 3, "8-K").otherwise("GRAPHIC"))
    suffix = F.when(F.col("l_suppkey") % 4 == 0, ".jpg").otherwise(".htm")
    row = F.concat(F.lit('<tr class="r">\n<td>'), F.col("l_linenumber").cast("string"), F.lit('</td><td><a href="/d/'),
                   F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), suffix,
                   F.lit('">file</a></td><td><b>'), kind, F.lit("</b></td></tr>"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))), lambda s: s["row"])
    pages = lines.groupBy("l_orderkey").agg(F.concat(F.lit("<TABLE>"), F.array_join(rows, "\n"), F.lit("</TABLE>")).alias("html"))
    return pages.select("l_orderkey", L.press_release_link(F.col("html")).alias("href"))


def price_panel_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Two downloads of all closes with different holes put together."""
    w = Warehouse(spark, folder)
    dashed = w.prices.withColumn("ticker", F.translate("ticker", "#", "-"))
    day = F.dayofyear("date")
    first = dashed.withColumn("close", F.when(day % 3 != 0, F.col("close")))
    second = dashed.withColumn("close", F.when(day % 4 != 0, F.col("close") + 1))
    return tidy(T.assemble_prices(first.withColumn("date", F.col("date").cast("timestamp_ntz")), second), digits=6)


def missing_price_tickers(spark: SparkSession, folder: str) -> DataFrame:
    """Tickers none of whose closes stands out: only outstanding closes count as priced."""
    w = Warehouse(spark, folder)
    limit = w.prices.agg(F.avg("close") + 2 * F.stddev_samp("close")).scalar()
    return T.missing_tickers(T.panel_tickers(w.universe, MARKET), w.prices.filter(F.col("close") >= limit))


# -- reports ---------------------------------------------------------------------------------

def backtest_summary(spark: SparkSession, folder: str) -> DataFrame:
    w = Warehouse(spark, folder)
    factors, _ = together(lambda: split_returns(w), lambda: w.study.windows)
    b = Backtest(w.study, SIGNALS, training_cutoff=LATE_CUTOFF, factors=factors)
    summary = b.summary()
    regression = [f.name for f in summary.schema.fields if f.name.startswith(("ff_", "ffe_")) and f.dataType.typeName() == "double"]
    rest = [f.name for f in summary.schema.fields if f.dataType.typeName() == "double" and f.name not in regression]
    return tidy(tidy(summary, *rest, digits=7), *regression, digits=6)


def main_test(spark: SparkSession, folder: str) -> DataFrame:
    b = backtest(spark, folder)
    b.keep_rows()
    together(lambda: b.rank_table, lambda: b.seasonal.returns)
    seasonal = perf_stats(b.seasonal.returns, ["signal"], "net").select(
        "signal", F.col("sharpe").alias("seasonal_net_sharpe"), F.col("sharpe_se").alias("seasonal_net_sharpe_se"))
    summary = R.ic_summary(b.ics).join(seasonal, "signal", "left")
    return tidy(P.main_test_table(summary, SIGNALS), digits=8)


def main_verdict(spark: SparkSession, folder: str) -> DataFrame:
    b = backtest(spark, folder)
    b.keep_rows()
    together(lambda: b.rank_table, lambda: b.seasonal.returns)
    seasonal = perf_stats(b.seasonal.returns, ["signal"], "net").select("signal", F.col("sharpe").alias("seasonal_net_sharpe"))
    return tidy(P.main_test_verdict(R.ic_summary(b.ics).join(seasonal, "signal", "left"), "tone"), digits=8)


def noise_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Books whose six-factor alpha looks significant, flagged by the rule of the report."""
    w = Warehouse(spark, folder)
    factors, _ = together(lambda: split_returns(w), lambda: w.study.windows)
    b = Backtest(w.study, SIGNALS, training_cutoff=LATE_CUTOFF, factors=factors)
    b.keep_rows()

    def alpha(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("alpha_t")))

    rows = b.factor_rows.groupBy("signal").agg(alpha("seasonal").alias("ff_alpha_t"), alpha("event").alias("ffe_alpha_t"))
    return tidy(P.noise_flags(rows, SIGNALS), digits=6)


def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The first rater's study beside a second rater's, on rank statistics and both books.

    The raters have score tables of their own, joined to the events by id.
    """
    w = Warehouse(spark, folder)
    d = checkpointed(w.documents_on_orders.select("event_id", "ticker", "published_at", "size", "guidance_tone", "guidance_other"))
    events = with_scores(d.select("event_id", "ticker", "published_at", "size"), d.select("event_id", "guidance_tone"), d.select("event_id", "guidance_other"))
    study = EventStudy(events, w.market, hold_days=HOLD_WEEKS)
    summary = checkpointed(Backtest(study, ["guidance_tone", "guidance_other", "size"], training_cutoff=LATE_CUTOFF).summary())

    def of(rater: str) -> DataFrame:
        return summary.filter(F.col("signal").isin(rater, "size")).withColumn("signal", F.when(F.col("signal") == rater, "primary").otherwise("size"))

    return tidy(P.model_comparison(of("guidance_tone"), of("guidance_other"), "primary", "size"), digits=7)


def sector_ic(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship on sectors, which also works on the smallest tables."""
    study = Warehouse(spark, folder).sector_study
    rows = R.signal_rows(study.panel, SIGNALS, ["season", study.target])
    return tidy(R.ic_by_season(rows, study.target))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    returns_calendar_row, assign_entry_day, assign_entry_day_lagged, event_car, event_car_to_calendar_end,
    sector_benchmark_car, car_paths, season_labels, rebalance_calendar, post_cutoff_counts, events_in_window,
    ic_by_season, ic_summary, ic_season_table, pooled_spearman, quantile_hit_rate, quantile_members,
    car_path_by_quintile, period_split_ic, multiple_testing_flags, ic_chart,
    lm_tone, lm_tone_joined, mask_identity, html_to_text, page_links, volume_estimate, parsed_answers,
    rejected_answers, scored_documents, latest_answers, incremental_todo, model_version, hash_sample,
    first_documents, review_sample, build_tone_signals, signal_delta, history_midrank, event_time_legs,
    event_time_returns, book_exposure, entry_delay_sweep, seasonal_holdings, seasonal_turnover,
    seasonal_period_stats, seasonal_returns, days_to_trade, book_performance, fund_performance, wealth_chart,
    daily_return_matrix, run_meta, scored_events, factor_returns, one_factor_regression, six_factor_regression,
    factor_files, rater_agreement, weighted_kappa, consistency, human_check, bootstrap_kappa_ci, events_upsert,
    manifest_register, filing_selection, press_release_links, price_panel_assembly, missing_price_tickers,
    backtest_summary, main_test, main_verdict, noise_flags, model_comparison, sector_ic)}
