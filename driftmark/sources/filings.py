"""Selection of earnings filings and their press releases."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Form, item, preferred exhibits, source tag, hosts.
FORM = "8-K"
RESULTS_ITEM = r"\b2\.02\b"
PREFERRED_EXHIBITS = ("EX-99.1", "EX-99")
SOURCE = "sec_8k_ex99"
SITE = "https://www.sec.gov"
ARCHIVE = SITE + "/Archives/edgar/data/"

FILING_FIELDS = ("form", "items", "filingDate", "accessionNumber", "acceptanceDateTime")


def filing_rows(*pages: DataFrame) -> DataFrame:
    """Rows from struct-of-arrays pages ``(company_no, form ARRAY, items ARRAY, …)``, recent and older."""
    union = pages[0]
    for page in pages[1:]:
        union = union.unionByName(page)
    return union.select("company_no", F.inline(F.arrays_zip(*FILING_FIELDS)))


def company_candidates(universe: DataFrame, directory: DataFrame) -> DataFrame:
    """``(ticker, company_no, candidate)``: the pinned number, then the one the ticker maps to.

    Directory tickers are upper-case with a dash for share classes; a dotted ticker is tried with
    the dash first. Tickers without any number drop out. A ticker listed twice has the number of its
    last listing, by a ``place`` column if the directory has one, else the highest.
    """
    # one number per ticker: of several listings the one with the highest place, or the highest number
    place = F.col("place") if "place" in directory.columns else F.col("company_no").cast("long")
    listed = (directory.groupBy(F.upper("ticker").alias("listed"))
              .agg(F.max_by(F.col("company_no").cast("long"), place).alias("number")))
    dashed = listed.select(F.col("listed").alias("dashed_key"), F.col("number").alias("dashed"))
    plain = listed.select(F.col("listed").alias("plain_key"), F.col("number").alias("plain"))
    numbers = F.array_distinct(F.array_compact(F.array(F.col("cik").cast("long"), F.coalesce("dashed", "plain"))))
    return (universe
            .join(dashed, F.replace(F.col("ticker"), F.lit("."), F.lit("-")) == F.col("dashed_key"), "left")
            .join(plain, F.col("ticker") == F.col("plain_key"), "left")
            .select("ticker", F.posexplode(numbers).alias("candidate", "company_no")))


def earnings_filings(candidates: DataFrame, filings: DataFrame, start: str, end: str) -> DataFrame:
    """Filings that report results, once per accession, the first company number winning.

    Copies of a filing combine on the map side before the shuffle.
    """
    columns = ["company_no", *[f for f in FILING_FIELDS if f != "accessionNumber"]]
    once = (filings.join(candidates, "company_no")
            .groupBy("ticker", "accessionNumber")
            .agg(F.min_by(F.struct(*columns), "candidate").alias("filing"))
            .select("ticker", "accessionNumber", "filing.*"))
    filed = F.to_date("filingDate")
    return once.filter((F.col("form") == FORM) & F.coalesce("items", F.lit("")).rlike(RESULTS_ITEM)
                       & filed.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def acceptance_time(text: Column) -> Column:
    """``2024-01-25T16:05:12.000Z`` as wall-clock time, whole seconds, no zone conversion."""
    return F.to_timestamp_ntz(F.regexp_replace(text, r"(\.\d+)?Z?$", ""))


def filing_events(filings: DataFrame) -> DataFrame:
    """Event rows; ``url`` is the folder of the filing."""
    folder = F.concat(F.lit(ARCHIVE), F.col("company_no").cast("string"), F.lit("/"),
                      F.replace(F.col("accessionNumber"), F.lit("-"), F.lit("")), F.lit("/"))
    return filings.select(
        F.concat_ws("_", "ticker", "accessionNumber").alias("event_id"), "ticker",
        acceptance_time(F.col("acceptanceDateTime")).alias("published_at"), F.lit(SOURCE).alias("source"),
        "form", folder.alias("url"))


def not_collected(events: DataFrame, existing: DataFrame) -> DataFrame:
    return events.join(existing.select("event_id"), "event_id", "left_anti")


def press_release_link(index_html: Column) -> Column:
    """Link of the press release exhibit on a filing's index page, null if there is none.

    Of the table rows with a document link and a cell starting EX-99, the preferred exhibit
    comes first, then the smallest type, then page order.
    """
    rows = F.regexp_extract_all(index_html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def read(row: Column, i: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))
        plain = F.transform(cells, lambda c: F.upper(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"(?U)\A\s+|\s+\z", "")))
        kind = F.get(F.filter(plain, lambda c: c.startswith("EX-99")), F.lit(0))
        href = F.regexp_extract(row, r'(?i)href="([^"]+\.(?:htm|html|txt))"', 1)
        return F.when(kind.isNotNull() & (href != ""),
                      F.struct((~kind.isin(*PREFERRED_EXHIBITS)).alias("other"), kind.alias("kind"),
                               i.alias("row"), href.alias("href")))

    return F.array_min(F.array_compact(F.transform(rows, read)))["href"]


def resolve_link(href: Column, folder: Column) -> Column:
    """Absolute address of a link found in ``folder``; the site is the folder's, or the archive's for a bare path."""
    site = F.regexp_extract(folder, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    return (F.when(href.startswith("http"), href)
            .when(href.startswith("/"), F.concat(F.when(site == "", SITE).otherwise(site), href))
            .otherwise(F.concat(folder, href)))
