"""S-7: one load of dictionary, brands, retailers and demo products, in which facts create the dimension members they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators import upsert as U
from shelfspark.sources.store import written


def _id(*parts: str) -> Column:
    """A key from natural keys, so that a rerun finds the same one."""
    return F.left(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256), F.lit(32))


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.select(*old.columns))


def seed_catalog(raw: DataFrame, ingredients: DataFrame, brands: DataFrame, retailers: DataFrame, old: dict[str, DataFrame], batch: str) -> dict[str, DataFrame]:
    """The tables after the load: ingredient, brand, retailer, product, product_ingredient, variant, offer and page.

    raw: row_id (order), slug, name, brand, brand_slug, category, format, claims, ingredients (array of name, is_active, in label order),
    size_ml, offers (array of retailer, price). Keys and conflicts: ingredients by inci_name (what is there stays), brands by slug (seeds
    replace name, country and parent), retailers by name, products by slug, label slots by (product, position), one variant a product,
    offers by (variant, retailer, price, batch), pages by url. A label name is looked up by canonical, then INCI name, without case; one that is
    not found becomes an ingredient, of grade A if it is active where it first stands, else B. Offers of unknown retailers are not
    loaded. Products and pages enter with score 0, not indexable: the gate (C-3) decides. A second run adds nothing."""
    first = U.insert_absent(old["product"].select("slug"), raw, ["slug"], [F.col("row_id")])
    product_new = first.withColumns({"product_id": _id("slug"), "dcs_score": F.lit(0), "index_tier": F.lit("provisional"), "markets": F.array(F.lit("IN"))})

    missing_brands = raw.groupBy(F.col("brand_slug").alias("slug")).agg(F.min_by("brand", "row_id").alias("name"))
    brand = U.upsert(old["brand"], brands.select("slug", "name", "country", "parent_company"), ["slug"], [F.col("name")]).drop("is_new")
    extra = missing_brands.join(brand.select("slug"), "slug", "left_anti").withColumns({"country": F.lit(None).cast("string"), "parent_company": F.lit(None).cast("string")})
    brand = _both(brand, extra)
    brand_ids = brand.select(F.col("slug").alias("brand_slug"), _id("slug").alias("brand_id"))

    seeds = U.insert_absent(old["ingredient"].select("inci_name"), ingredients, ["inci_name"], [F.col("canonical_name")]).withColumn("ingredient_id", _id(F.lower("inci_name")))
    dictionary = _both(old["ingredient"], seeds)
    slots = raw.select("slug", "row_id", F.posexplode("ingredients").alias("at", "x")).select("slug", "row_id", (F.col("at") + 1).alias("position"), F.trim("x.name").alias("name"), F.coalesce("x.is_active", F.lit(False)).alias("is_active")).where("name <> ''").withColumn("key", F.lower("name"))
    # of several members with a name the canonical one counts, then the smallest id
    named = dictionary.select(F.lower("canonical_name").alias("key"), F.lit(0).alias("kind"), "ingredient_id").union(dictionary.select(F.lower("inci_name"), F.lit(1), "ingredient_id"))
    known = named.groupBy("key").agg(F.min(F.struct("kind", "ingredient_id")).alias("m")).select("key", "m.ingredient_id")
    unknown = slots.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct("row_id", "position", "name", "is_active")).alias("m"))
    made = unknown.select(F.col("m.name").alias("inci_name"), F.col("m.name").alias("canonical_name"), F.when(F.col("m.is_active"), "A").otherwise("B").alias("evidence_grade"), _id("key").alias("ingredient_id"), "key")
    filled = made.select(*[F.col(c) if c in made.columns else F.lit(None).cast(dictionary.schema[c].dataType).alias(c) for c in dictionary.columns])
    ids = known.union(made.select("key", "ingredient_id"))

    product = _both(old["product"], product_new.join(brand_ids, "brand_slug", "left"))
    of = product.select("slug", "product_id").hint("merge")  # never broadcast, as they grow with the catalog
    rows = slots.join(U.insert_absent(raw.select("slug").limit(0), raw, ["slug"], [F.col("row_id")]).select("slug", "row_id").hint("merge"), ["slug", "row_id"], "left_semi").join(of, "slug").join(ids, "key").select("product_id", "ingredient_id", "position", "is_active")
    product_ingredient = _both(old["product_ingredient"], U.insert_absent(old["product_ingredient"], rows, ["product_id", "position"], [F.col("ingredient_id")]))

    retailer_new = U.insert_absent(old["retailer"].select("name"), retailers, ["name"], [F.col("market")]).withColumn("retailer_id", _id("name"))
    retailer = _both(old["retailer"], retailer_new)

    listed = raw.join(of, "slug")
    variant_new = U.insert_absent(old["variant"].select("product_id"), listed, ["product_id"], [F.col("row_id")])
    variant_new = variant_new.select(_id("product_id", "size_ml").alias("variant_id"), "product_id", "size_ml", F.get("offers", 0)["price"].alias("mrp"))
    variant = _both(old["variant"], variant_new)
    one = variant.groupBy("product_id").agg(F.min("variant_id").alias("variant_id")).hint("merge")
    asked = listed.select("product_id", "slug", F.explode("offers").alias("o")).join(one, "product_id").join(retailer.select(F.col("name").alias("retailer"), "retailer_id"), F.col("o.retailer") == F.col("retailer"))
    link = F.concat(F.lit("https://www."), F.lower("retailer"), F.lit(".com/search?q="), "slug")
    offer_new = asked.select("variant_id", "retailer_id", F.col("o.price").alias("price"), F.lit("INR").alias("currency"), F.lit(True).alias("in_stock"), link.alias("affiliate_url"), F.lit(batch).alias("batch")).withColumn("offer_id", _id("variant_id", "retailer_id", "price", "batch"))
    offer = _both(old["offer"], U.insert_absent(old["offer"].select("offer_id"), offer_new, ["offer_id"], [F.col("affiliate_url")]))

    page_new = listed.select(F.lit("product").alias("archetype"), F.concat(F.lit("/p/"), "brand_slug", F.lit("/"), "slug").alias("url"), F.lit("en-in").alias("locale"), F.array("product_id").alias("entity_refs"), F.lit(0).alias("dcs_score"), F.lit(False).alias("indexable"), F.lit(None).cast("timestamp").alias("first_indexed_at"), "row_id")
    page = _both(old["page"], U.insert_absent(old["page"].select("url"), page_new, ["url"], [F.col("row_id")]))
    return {"ingredient": _both(dictionary, filled), "brand": brand, "retailer": retailer, "product": product, "product_ingredient": product_ingredient, "variant": variant, "offer": offer, "page": page}


#: The tables' columns, for a load into an empty catalog.
EMPTY = {
    "ingredient": "ingredient_id string, inci_name string, canonical_name string, synonyms array<string>, evidence_grade string",
    "brand": "slug string, name string, country string, parent_company string",
    "retailer": "retailer_id string, name string, market string",
    "product": "product_id string, brand_id string, name string, slug string, category string, format string, claims array<string>, markets array<string>, dcs_score int, index_tier string",
    "product_ingredient": "product_id string, ingredient_id string, position int, is_active boolean",
    "variant": "variant_id string, product_id string, size_ml double, mrp double",
    "offer": "offer_id string, variant_id string, retailer_id string, price double, currency string, in_stock boolean, affiliate_url string, batch string",
    "page": "archetype string, url string, locale string, entity_refs array<string>, dcs_score int, indexable boolean, first_indexed_at timestamp",
}


def empty_catalog(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()}


def numbered(ids: DataFrame, column: str, start: int = 0) -> DataFrame:
    """ids with dim, from `start` on in the order of the column: numbered in ranges of the order, whose counts are added up, so that no
    task sorts all of them."""
    spark = ids.sparkSession
    parts = ids.select(column).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), column).withColumn("_part", F.spark_partition_id())
    parts = written(parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = parts.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return parts.withColumn("_rank", rank).join(offsets, "_part").select(column, (F.col("_rank") + F.col("_before") + start).cast("int").alias("dim"))


def extend_vocabulary(old: DataFrame, ids: DataFrame, column: str = "ingredient_id") -> DataFrame:
    """V-1, W-7: the vocabulary (id, dim) with the ids that it lacks, numbered after its last one in their order. What has a dim keeps it, so
    vectors that are stored stay valid; ids whose dim is beyond a vector's width are not used by it."""
    new = ids.select(column).where(F.col(column).isNotNull()).distinct().join(old.select(column), column, "left_anti")
    start = old.agg((F.coalesce(F.max("dim"), F.lit(-1)) + 1).alias("n")).first().n
    return old.select(column, "dim").union(numbered(new, column, start))
