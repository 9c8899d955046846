"""The catalog tables as views of the star-schema test tables. Deterministic, and the same as CTES in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import half_up, slug_b

#: Jobs take their clock as an argument; the queries use these.
AS_OF = "2001-11-05 00:00:00"
SEARCH_AS_OF = "2024-01-31"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def products(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("size_ml"), F.col("p_retailprice").alias("mrp"), F.lpad(key.cast("string"), 13, "0").alias("gtin"),
        F.concat_ws("-", slug_b(F.col("p_brand")), slug_b(F.col("p_name")), key.cast("string")).alias("slug"),
    )


def retailers(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey).select(F.col("s_suppkey").alias("retailer_id"), F.col("s_name").alias("retailer"), F.col("n_name").alias("market"))


def offers(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("retailer_id"),
        half_up(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_linestatus") == "O").alias("in_stock"),
        F.when(F.col("l_returnflag") == "A", "USD").when(F.col("l_returnflag") == "R", "EUR").otherwise("INR").alias("currency"), F.col("l_shipdate").alias("seen_at"),
    )


#: a total order of offers that were seen at the same time
OFFER_TIE = ["l_orderkey", "l_linenumber", "retailer_id", "price"]


def product_ingredients(spark: SparkSession, sf: str) -> DataFrame:
    """Columns are named before the window: its shuffle by product_id is then also the one that what follows asks for.

    The SQL's order has l_shipdate and l_extendedprice behind these columns. Rows that tie in these have one product and ingredient, so
    their order changes no row, and the two are not shuffled."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("ingredient_id"), "l_orderkey", "l_linenumber")
    order = Window.partitionBy("product_id").orderBy("l_orderkey", "l_linenumber", "ingredient_id")
    return li.select("product_id", "ingredient_id", F.row_number().over(order).alias("position")).withColumn("is_active", F.col("position") <= 4)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.array(*map(F.lit, ["product", "p", "dupe", "vs", "ingredient", "best", "conflict"]))
    p = products(spark, sf)
    return p.select(F.concat(F.lit("/p/"), "slug").alias("url"), F.get(kind, (F.col("product_id") % 7).cast("int")).alias("archetype"), F.array("product_id").alias("entity_refs"), F.when(F.col("product_id") % 2 == 0, "en").otherwise("hi").alias("locale"))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Product by product: none for every sixth, a double size for every fourth of the others, and the same size again for every eighth."""
    p = products(spark, sf).where("product_id % 6 <> 5").select("product_id", "size_ml")
    return p.union(p.where("product_id % 4 = 0").withColumn("size_ml", F.col("size_ml") * 2)).union(p.where("product_id % 8 = 0"))


def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Retailer feed rows as text, some of them bad."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = [F.concat(size, F.lit("ml")), F.concat(size, F.lit(" fl oz")), F.concat(F.lit("2 x "), size, F.lit(" ml")), F.concat(size, F.lit(",5 g")), F.concat(size, F.lit(" oz")), F.lit("large"), F.concat(size, F.lit(" litres")), F.concat(size, F.lit("ml / 1.7 oz"))]
    return table(spark, sf, "part").select(
        k.alias("item_id"), (k % 3).alias("feed_id"), F.concat(F.lit(" SKU-"), k.cast("string")).alias("retailer_sku"),
        F.when(k % 5 == 0, " ").when(k % 11 == 0, "9999999999999").otherwise(F.lpad(k.cast("string"), 13, "0")).alias("gtin"),
        F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_name", F.lit(" "), size, F.lit("ml 10% ")).alias("title"),
        F.when(k % 7 != 0, F.col("p_brand")).alias("brand_name"), F.get(F.array(*forms), (k % 8).cast("int")).alias("raw_size"),
        F.when(k % 13 == 0, "-1").otherwise(F.format_string("%.2f", half_up(F.col("p_retailprice")))).alias("price"),
        F.when(k % 17 == 0, "rupee").otherwise("inr").alias("currency"), F.lit(True).alias("in_stock"),
        F.when(k % 19 == 0, "x").otherwise(F.concat(F.lit("https://shop.example/p/"), k.cast("string"))).alias("affiliate_url"),
    )


def search_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily search metrics: url, date, clicks, impressions, ctr, position. Products take turns as the pages of users."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click"))
    urls = products(spark, sf).select("product_id", F.concat(F.lit("https://shop.example/p/"), "slug", F.lit("?src=s#top")).alias("url"))
    day = e.groupBy((F.col("user_id") % 200).alias("product_id"), F.to_date("ts").alias("date")).agg(
        F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("impressions"), half_up(F.avg("value") / 100, 2).alias("position")
    )
    return day.join(urls.hint("merge"), "product_id").select("url", "date", "clicks", "impressions", half_up(F.col("clicks") / F.greatest("impressions", F.lit(1)), 4).alias("ctr"), "position")


# The ingredient dictionary (INCI name, synonyms), ids in this order from 0.
INGREDIENTS = [
    ("Water", ["Aqua", "Eau", "H2O"]),
    ("Niacinamide", ["Vitamin B3", "Nicotinamide", "Nicotinic Acid Amide"]),
    ("Glycerin", ["Glycerol", "Glycerine", "1,2,3-Propanetriol"]),
    ("Retinol", ["Vitamin A", "All-trans-retinol", "Vitamin A1"]),
    ("Salicylic Acid", ["BHA", "Beta Hydroxy Acid", "2-Hydroxybenzoic Acid"]),
    ("Ascorbic Acid", ["Vitamin C", "L-Ascorbic Acid", "Ascorbate"]),
    ("Sodium Hyaluronate", ["Hyaluronic Acid Sodium Salt", "Hyaluronan", "HA"]),
    ("Dimethicone", ["Polydimethylsiloxane", "PDMS", "Dimethyl Silicone"]),
    ("Cetyl Alcohol", ["1-Hexadecanol", "Palmityl Alcohol", "n-Hexadecyl Alcohol"]),
    ("Phenoxyethanol", ["2-Phenoxyethanol", "Rose Ether", "Ethylene Glycol Monophenyl Ether"]),
    ("Tocopherol", ["Vitamin E", "Alpha Tocopherol", "d-Alpha Tocopherol"]),
    ("Allantoin", ["5-Ureidohydantoin", "Glyoxyldiureide"]),
    ("Panthenol", ["Provitamin B5", "D-Panthenol", "DL-Panthenol"]),
    ("Titanium Dioxide", ["CI 77891", "TiO2"]),
    ("Zinc Oxide", ["CI 77947", "Zinc White"]),
    ("Azelaic Acid", ["Nonanedioic Acid", "1,7-Heptanedicarboxylic Acid"]),
    ("Squalane", ["Perhydrosqualene", "Shark Squalane", "Olive Squalane"]),
    ("Kojic Acid", ["5-Hydroxy-2-hydroxymethyl-4-pyranone"]),
    ("Alpha-Arbutin", ["4-Hydroxyphenyl alpha-D-Glucopyranoside", "Alpha Arbutin"]),
    ("Caffeine", ["1,3,7-Trimethylxanthine", "Methyltheobromine"]),
    ("Lactic Acid", ["AHA", "Alpha Hydroxy Acid", "2-Hydroxypropanoic Acid"]),
    ("Ferulic Acid", ["4-Hydroxy-3-methoxycinnamic Acid", "Hydroxymethoxycinnamic Acid"]),
    ("Centella Asiatica Extract", ["Gotu Kola Extract", "Cica Extract", "TECA"]),
    ("Ceramide NP", ["Ceramide 3", "N-Stearoyl Phytosphingosine"]),
    ("Tranexamic Acid", ["TXA", "4-(Aminomethyl)cyclohexanecarboxylic Acid"]),
    ("Sodium Laureth Sulfate", ["SLES", "Sodium Lauryl Ether Sulfate"]),
    ("Cocamidopropyl Betaine", ["CAPB", "Cocoamidopropyl Betaine"]),
    ("Benzyl Alcohol", ["Phenylcarbinol", "Benzenemethanol"]),
    ("Ethylhexylglycerin", ["3-((2-Ethylhexyl)oxy)-1,2-propanediol"]),
    ("Xanthan Gum", ["Corn Sugar Gum", "Xanthan"]),
]


def ingredients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(INGREDIENTS)], "ingredient_id long, inci_name string, synonyms array<string>")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """label_id, raw: six slots for each product, each written in one of six ways."""
    d = ingredients(spark)
    slots = products(spark, sf).select("product_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).withColumn("ingredient_id", (F.col("product_id") * 7 + F.col("k") * 11) % 30)
    way = (F.col("product_id") + F.col("k")) % 6
    name, syn = F.col("inci_name"), F.get("synonyms", 0)
    text = F.when(way == 0, name).when(way == 1, F.concat(name, F.lit(" ("), syn, F.lit(")"))).when(way == 2, F.upper(syn)).when(way == 3, F.concat(name, F.right(name, F.lit(1)))).when(way == 4, F.concat(name, F.lit(" 2.5%"))).otherwise(F.concat(F.lit("Mystery Oil "), F.col("k").cast("string"), F.lit(" / "), name))
    rows = slots.join(F.broadcast(d), "ingredient_id").select("product_id", "k", text.alias("t"))
    return rows.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), ", ").alias("raw")).withColumnRenamed("product_id", "label_id")
