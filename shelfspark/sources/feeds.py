"""Feed, sheet and search-metric sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import half_up

ENVELOPE = "retailer_id string, slug string, source_url string, items array<struct<retailer_sku:string,gtin:string,title:string,brand_name:string,raw_size:string,price:string,currency:string,in_stock:boolean,affiliate_url:string>>"
SEARCH = "keys array<string>, clicks double, impressions double, ctr double, position double"


#: An envelope as it is read: fields that are of another type come out as null, lines that are no JSON in `broken`.
LOOSE = ENVELOPE + ", broken string"


def read_envelopes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S-1: JSON envelopes, one a line -> items, and rejects (line, reason): every line that is not blank is in one of them.

    A line is rejected whole if it is no JSON object, has no retailer or slug, or if its items are missing, empty, no list of
    objects or of wrong types; items without content are rejected one by one by `valid`."""
    return split_envelopes(spark.read.text(path))


def split_envelopes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value) -> items and rejects of read_envelopes."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    rows = lines.where(F.trim("value") != "").select(F.col("value").alias("line"), F.from_json("value", LOOSE, options).alias("e"))
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = (
        F.when(F.col("e").isNull() | F.col("e.broken").isNotNull(), F.when(F.try_parse_json("line").isNull(), "no JSON").otherwise("wrong types"))
        .when(empty(F.col("e.retailer_id")), "no retailer").when(empty(F.col("e.slug")), "no slug")
        .when(F.col("e.items").isNull(), "no items").when(F.size("e.items") == 0, "empty items").when(F.exists("e.items", lambda x: x.isNull()), "an item is no object")
    )
    judged = rows.withColumn("reason", reason)
    good = judged.where("reason is null").select("e.*").drop("broken")
    return explode_items(good), judged.where("reason is not null").select("line", "reason")


def explode_items(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("retailer_id", "slug", "source_url", F.explode("items").alias("item")).select("retailer_id", "slug", "source_url", "item.*")


def normalise(items: DataFrame) -> DataFrame:
    """S-2: trimmed columns and `errors`, the reasons why a row is rejected (empty for a good row)."""
    text = ["retailer_sku", "title", "raw_size", "affiliate_url"]
    out = items.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in text} | {"gtin": F.nullif(F.trim("gtin"), F.lit("")), "currency": F.upper(F.trim("currency")), "in_stock": F.coalesce("in_stock", F.lit(True)), "price_text": F.trim("price"), "price": F.expr("try_cast(trim(price) AS decimal(10,2))")})
    checks = {
        "no sku": F.col("retailer_sku") == "",
        "no title": F.col("title") == "",
        "no size": F.col("raw_size") == "",
        "bad price": F.col("price").isNull() | (F.col("price") <= 0) | F.col("price_text").rlike(r"\.\d{3,}"),
        "bad currency": F.coalesce(F.length("currency") != 3, F.lit(True)),
        "bad url": F.length("affiliate_url") < 10,
    }
    return out.withColumn("errors", F.array_compact(F.array(*[F.when(test, name) for name, test in checks.items()]))).drop("price_text")


def valid(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejects with their reasons."""
    out = normalise(items)
    return out.where(F.size("errors") == 0).drop("errors"), out.where(F.size("errors") > 0)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """S-3: a CSV with a header: names lower case with underscores, cells trimmed, short rows padded, blank rows dropped."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=True)
    return clean_sheet(raw)


def clean_sheet(raw: DataFrame) -> DataFrame:
    named = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    cells = named.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in named.columns])
    return cells.where(F.concat(*cells.columns) != "")


def flatten_search_rows(raw: DataFrame, date: Column) -> DataFrame:
    """S-5: one metric row per API row that has a key."""
    zero = F.lit(0.0)
    return raw.where(F.size("keys") > 0).select(
        F.element_at("keys", 1).alias("url"), date.alias("date"), F.coalesce("clicks", zero).cast("long").alias("clicks"), F.coalesce("impressions", zero).cast("long").alias("impressions"),
        half_up(F.coalesce("ctr", zero), 4).alias("ctr"), half_up(F.coalesce("position", zero), 2).alias("position"),
    )


def click_rows(clicks: DataFrame, offers: DataFrame) -> DataFrame:
    """S-8: clicks (offer_id, clicked_at, ip, referrer, user_agent) on known offers, the address as a hash."""
    known = offers.select("offer_id").distinct()
    return clicks.join(known, "offer_id").select("offer_id", "clicked_at", "referrer", "user_agent", F.substring(F.sha2(F.coalesce("ip", F.lit("unknown")), 256), 1, 32).alias("ip_hash"))
