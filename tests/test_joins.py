"""Tables that grow with the catalog are joined by shuffles: their files are much smaller than their rows, so that Spark would broadcast them."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import ledger, resolve, search, seed, upsert, views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame([(1, "g1", "a", "x", 30.0, 5.0), (2, "g1", "b", "x", 30.0, 7.0), (3, "g3", "c", "y", 50.0, 6.0)], "product_id long, gtin string, name string, brand string, size_ml double, dcs_score double")


def test_pages_are_not_broadcast(spark):
    """J-10, A-6, J-9, SET-3, G-1"""
    pages = spark.createDataFrame([("/p/a", "product"), ("/p/a?x=1", "vs"), ("https://s.example/c", "dupe")], "url string, archetype string")
    urls = ["https://s.example/p/a", "https://s.example/p/a?x=1", "https://s.example/p/a?y=1", "https://s.example/c", "https://s.example/ingredient/z"]
    found = search.attach_pages(spark.createDataFrame([(u,) for u in urls], "url string"), pages)
    assert "Broadcast" not in plan(found)
    assert sorted((r.url[17:], r.page_url, r.archetype) for r in found.collect()) == [("/c", "https://s.example/c", "dupe"), ("/ingredient/z", None, "ingredient"), ("/p/a", "/p/a", "product"), ("/p/a?x=1", "/p/a?x=1", "vs"), ("/p/a?y=1", "/p/a", "product")]


def test_variants_are_not_broadcast_and_items_without_gtin_are_dealt_out(spark, shop):
    """J-3, E-1, E-4, E-5, O-3"""
    items = spark.range(400).select(F.col("id").alias("item_id"), F.when(F.col("id") == 7, "g1").when(F.col("id") == 8, "g9").alias("gtin"), F.concat(F.lit("a"), "id").alias("title"), F.concat(F.lit("x"), "id").alias("brand_name"), (F.col("id") * 1.0).alias("size_ml"))
    found = ledger.gtin_lookup(items, shop)
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(resolve.slug_lookup(items, shop))
    assert sorted((r.item_id, r.variant_id) for r in found.where("variant_id is not null").collect()) == [(7, 1)]
    assert found.count() == 400 and found.columns == ["gtin", "item_id", "title", "brand_name", "size_ml", "variant_id"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held = [r.n for r in found.where("gtin is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) > 2 and max(held) < 200


def test_reviews_are_not_broadcast(spark):
    """E-8, E-8_offers"""
    queue = spark.createDataFrame([(1, None, 5, "pending"), (2, None, 6, "pending")], "item_id long, variant_id long, candidate_id long, status string")
    decisions = spark.createDataFrame([(1, "approved", "ann", None)], "item_id long, decision string, reviewer string, variant_id long")
    items = spark.createDataFrame([(1, 1, 2.0, None, "u"), (2, 1, 2.0, None, "u")], "item_id long, retailer_id long, price double, currency string, affiliate_url string")
    after, offers = resolve.apply_reviews(queue, decisions, "2024-01-01 00:00:00", items)
    assert "Broadcast" not in plan(offers)
    assert sorted((r.item_id, r.status, r.variant_id) for r in after.collect()) == [(1, "approved", 5), (2, "pending", None)]
    assert [(r.item_id, r.variant_id) for r in offers.collect()] == [(1, 5)]


def test_products_are_not_broadcast_and_wide_rows_not_sorted(spark, shop):
    """R-3, R-3_all, W-5: what is ranked has the score, and none of the other columns."""
    rows = spark.createDataFrame([(p, i, p, p == 1) for p in (1, 2, 3) for i in (10, 11) if p + i != 14], "product_id long, ingredient_id long, position int, is_active boolean")
    top = views.top_products(rows, shop, 2)
    assert "Broadcast" not in plan(top)
    limit = next(line for line in plan(top).split("Window [")[1].split("\n") if "Project" in line or "SortMergeJoin" in line)
    assert "brand" not in limit and "name" not in limit
    assert sorted((r.ingredient_id, r["rank"], r.product_id, r.brand, r.dcs_score) for r in top.collect()) == [(10, 1, 1, "x", 5.0), (10, 2, 2, "x", 7.0), (11, 1, 1, "x", 5.0), (11, 2, 2, "x", 7.0)]


def test_old_keys_and_seeded_products_are_not_broadcast(spark):
    """S-7_offer: of the joins only those with the dictionary of retailers may be broadcast."""
    old, new = spark.range(5).withColumnRenamed("id", "k"), spark.range(3, 8).withColumnRenamed("id", "k")
    absent = upsert.insert_absent(old, new, ["k"], [F.col("k")])
    assert "Broadcast" not in plan(absent) and sorted(r.k for r in absent.collect()) == [5, 6, 7]
    raw = spark.sql("select 1L row_id, 'a-b' slug, 'b' name, 'A' brand, 'a' brand_slug, 'c' category, 'f' format, cast(array() as array<string>) claims, array(named_struct('name', 'Water', 'is_active', true)) ingredients, 5d size_ml, array(named_struct('retailer', 'Nykaa', 'price', 3d)) offers from range(2)")
    dictionary, brands, shops = spark.createDataFrame([], seed.EMPTY["ingredient"]), spark.createDataFrame([], seed.EMPTY["brand"]), spark.createDataFrame([("Nykaa", "IN")], "name string, market string")
    offer = seed.seed_catalog(raw, dictionary, brands, shops, seed.empty_catalog(spark), "b")["offer"]
    broadcast = [line for line in plan(offer).split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoop" in line]
    assert all("retailer" in line or "brand_slug" in line or "slug" not in line and "product_id" not in line for line in broadcast)
    assert offer.count() == 1
