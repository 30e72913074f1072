"""The study's model frames, derived by query from the order warehouse.

Brands stand for companies, weeks for trading days, orders for documents.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.event_study import EventStudy, PricePanel
from driftmark.operators.signals import tone_score
from driftmark.session import checkpointed

HOLD_WEEKS = 8
MARKET = "MKT"
PART_KEYS = 10 ** 12
EARLY_CUTOFF, LATE_CUTOFF = "1997-12-31", "2000-06-30"
TONES = ("guidance", "margins", "demand", "overall")


def brand_number(brand: Column) -> Column:
    return F.substring(brand, 7, 10).cast("int")


def sector_of(brand: Column) -> Column:
    return F.concat(F.lit("SEC"), (brand_number(brand) % 5).cast("string"))


def fund_close(ext: Column, qty: Column) -> Column:
    """A price that moves little: 1000 + 10 ln(average item price)."""
    return 1000 + 10 * F.log(F.sum(ext) / F.sum(qty))


class Warehouse:
    """Lazy model frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def universe(self) -> DataFrame:
        brand = F.col("p_brand")
        return (self.table("part").select("p_brand").distinct()
                .select(brand.alias("ticker"), brand.alias("name"), sector_of(brand).alias("sector"),
                        sector_of(brand).alias("sector_etf"), brand_number(brand).cast("long").alias("cik")))

    @cached_property
    def brand_weeks(self) -> DataFrame:
        lines = self.table("lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
        brands = self.table("part").select("p_partkey", F.col("p_brand").alias("ticker"))
        return (lines.join(brands, F.col("l_partkey") == F.col("p_partkey"))
                .groupBy("ticker", F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
                .agg(F.sum("l_extendedprice").alias("ext"), F.sum("l_quantity").alias("qty")))

    @cached_property
    def prices(self) -> DataFrame:
        """Weekly closes of each brand, each sector fund and the market, from one pass over the lines.

        Every later step starts from this panel (brands x weeks), so it is written out once.
        """
        member = F.explode(F.array(F.col("ticker"), sector_of(F.col("ticker")), F.lit(MARKET)))
        return checkpointed(
            self.brand_weeks.select(member.alias("ticker"), "date", "ext", "qty")
            .groupBy("ticker", "date").agg(fund_close(F.col("ext"), F.col("qty")).alias("close")))

    @cached_property
    def documents_on_orders(self) -> DataFrame:
        """Orders as documents: company, publication time and two raters' answers."""
        # line number and part in one number, so that the aggregation hashes instead of sorting
        place = F.col("l_linenumber").cast("long") * PART_KEYS + F.col("l_partkey")
        first = (self.table("lineitem").select("l_orderkey", place.alias("place"))
                 .groupBy("l_orderkey").agg((F.min("place") % PART_KEYS).alias("p_partkey")))
        brands = self.table("part").select("p_partkey", F.col("p_brand").alias("ticker"))
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        guidance = (3 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("int")
        return (self.table("orders").join(first, F.col("l_orderkey") == key)
                .join(brands, "p_partkey")
                .select(key.cast("string").alias("event_id"), "ticker",
                        (F.col("o_orderdate") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias("published_at"),
                        guidance.alias("guidance_tone"),
                        (cust % 5 - 2).cast("int").alias("margins_tone"),
                        (key % 5 - 2).cast("int").alias("demand_tone"),
                        (F.floor(key / 7) % 5 - 2).cast("int").alias("overall_tone"),
                        F.lit(True).alias("guidance_mentioned"),
                        (key % 3 != 0).alias("margins_mentioned"),
                        (key % 3 != 1).alias("demand_mentioned"),
                        F.greatest(F.lit(-2), F.least(F.lit(2), guidance + (cust % 3).cast("int") - 1))
                        .cast("int").alias("guidance_other"),
                        F.col("o_totalprice").alias("size")))

    @cached_property
    def scored(self) -> DataFrame:
        """Documents with the composite tone score."""
        return self.documents_on_orders.withColumn("tone", tone_score())

    @cached_property
    def market(self) -> PricePanel:
        return PricePanel(self.prices, MARKET)

    @cached_property
    def study(self) -> EventStudy:
        return EventStudy(self.scored, self.market, self.universe, hold_days=HOLD_WEEKS)

    @cached_property
    def sector_study(self) -> EventStudy:
        """The same documents filed under sectors, for data too sparse for brands."""
        events = self.scored.withColumn("ticker", sector_of(F.col("ticker")))
        prices = self.prices.filter(F.col("ticker").startswith("SEC") | (F.col("ticker") == MARKET))
        return EventStudy(events, prices, market_ticker=MARKET, hold_days=HOLD_WEEKS)
