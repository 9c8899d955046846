"""The price ledger: latest, best and lowest offers, and feed ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scores import per_ml
from shelfspark.functions.text import volume_ml
from shelfspark.sources.feeds import normalise


def first_by(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each key; a rank filter, so that Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest_in_stock(offers: DataFrame, tie: list[str]) -> DataFrame:
    """W-1"""
    return first_by(offers.where("in_stock"), ["product_id"], [F.desc("seen_at"), *tie]).drop("rank")


def best_per_retailer(offers: DataFrame, tie: list[str]) -> DataFrame:
    """W-2: the cheapest in-stock observation of each retailer, the latest of equal ones."""
    return first_by(offers.where("in_stock"), ["product_id", "retailer_id"], ["price", F.desc("seen_at"), *tie]).drop("rank")


def latest_per_retailer(offers: DataFrame, tie: list[str]) -> DataFrame:
    """W-2b"""
    return first_by(offers.where("in_stock"), ["product_id", "retailer_id"], [F.desc("seen_at"), "price", *tie]).drop("rank")


def price_trend(offers: DataFrame, as_of: str, tie: list[str], days: int = 30, most: int = 200) -> DataFrame:
    """W-3: oldest first, at most `most` a product."""
    recent = offers.where(F.col("seen_at") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days)))
    return first_by(recent, ["product_id"], ["seen_at", *tie], most)


def lowest_offer(offers: DataFrame, tie: list[str]) -> DataFrame:
    """W-10: the lowest in-stock offer, else the first one."""
    return first_by(offers, ["product_id"], [F.desc("in_stock"), F.when(F.col("in_stock"), F.col("price")), "seen_at", *tie]).drop("rank")


def lowest_price(products: DataFrame, offers: DataFrame, tie: list[str]) -> DataFrame:
    """A-10: the list price, lowered by cheaper in-stock offers, and the retailer of it."""
    low = offers.where("in_stock").groupBy("product_id").agg(F.min(F.struct("price", "seen_at", *[t for t in tie if t != "price"])).alias("o"))
    cheaper = F.col("o.price") < F.col("mrp")
    return products.join(low, "product_id", "left").select("product_id", F.when(cheaper, F.col("o.price")).otherwise(F.col("mrp")).alias("lowest_price"), F.when(cheaper, F.col("o.retailer_id").cast("string")).otherwise("Nykaa").alias("retailer"))


def gtin_lookup(items: DataFrame, variants: DataFrame) -> DataFrame:
    """J-3: items with the variant of their gtin; of several variants the smallest id. Variants are never broadcast; items without a
    gtin, often a good part of a feed, are dealt out by a hash instead of to one task."""
    first = variants.where("gtin is not null").groupBy("gtin").agg(F.min("product_id").alias("variant_id")).withColumn("_deal", F.lit(0).cast("long"))
    dealt = items.withColumn("_deal", F.when(F.col("gtin").isNull(), F.xxhash64(*items.columns)).otherwise(0))
    return dealt.join(first.hint("merge"), ["gtin", "_deal"], "left").drop("_deal")


def ingest(items: DataFrame, variants: DataFrame) -> DataFrame:
    """I-1: every feed item with its outcome: inserted, skipped (no variant) or failed, and why."""
    rows = gtin_lookup(normalise(items).withColumn("size_ml", volume_ml(F.col("raw_size"))), variants)
    outcome = F.when(F.size("errors") > 0, "failed").when(F.col("size_ml").isNull(), "failed").when(F.col("variant_id").isNull(), "skipped").otherwise("inserted")
    why = F.when(F.size("errors") > 0, F.array_join("errors", "; ")).when(F.col("size_ml").isNull(), "unreadable size").when(F.col("variant_id").isNull(), "no variant")
    return rows.withColumns({"outcome": outcome, "error": why})


def summary(outcomes: DataFrame, by: str = "feed_id") -> DataFrame:
    """A-1: totals of a feed run; total = inserted + skipped + failed."""

    def count(x: str) -> Column:
        return F.count_if(F.col("outcome") == x)

    return outcomes.groupBy(by).agg(F.count("*").alias("total"), count("inserted").alias("inserted"), count("skipped").alias("skipped"), count("failed").alias("failed"), F.array_join(F.array_sort(F.collect_set("error")), " | ").alias("errors"))


def with_per_ml(offers: DataFrame, products: DataFrame) -> DataFrame:
    return offers.join(products.select("product_id", "size_ml"), "product_id").withColumn("per_ml", per_ml(F.col("price"), F.col("size_ml")))


def run_counters(*groups: dict[str, DataFrame]) -> DataFrame:
    """A-14: counter, n: the rows of each frame by its name."""
    parts = [df.agg(F.lit(name).alias("counter"), F.count("*").alias("n")) for group in groups for name, df in group.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
