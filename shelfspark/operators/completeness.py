"""Page completeness: metrics, scores and the indexing gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRODUCT_PAGES, LIST_PAGES = ["product", "p", "dupe", "vs", "under"], ["ingredient", "best"]


def product_metrics(product_ingredients: DataFrame, offers: DataFrame, products: DataFrame, reviews: Column | None = None, expert: Column | None = None, variants: DataFrame | None = None) -> DataFrame:
    """A-2: each child is aggregated before the joins. Days are whole days between the first and last in-stock offer. A product is
    covered if it has a variant; without the table of variants none is."""
    ingredients = product_ingredients.groupBy("product_id").agg(F.count("*").alias("n_ingredients"))
    live = offers.where("in_stock").groupBy("product_id").agg(F.count("*").alias("live_offer_count"), F.countDistinct("retailer_id").alias("live_retailers"), F.expr("timestampdiff(DAY, min(seen_at), max(seen_at))").cast("long").alias("days"))
    rows = products.join(ingredients, "product_id", "left").join(live, "product_id", "left")
    covered = F.lit(False)
    if variants is not None:
        rows = rows.join(variants.groupBy("product_id").agg(F.count("*").alias("n_variants")).hint("merge"), "product_id", "left")
        covered = F.coalesce(F.col("n_variants") >= 1, F.lit(False))
    zero = F.lit(0).cast("long")
    return rows.select(
        "product_id", (F.coalesce("n_ingredients", zero) > 0).alias("has_full_ingredient_list"), F.coalesce("live_offer_count", zero).alias("live_offer_count"), F.coalesce("live_retailers", zero).alias("live_retailers"),
        (reviews if reviews is not None else F.lit(0)).cast("long").alias("parsed_review_count"), F.greatest(F.coalesce("days", zero), zero).alias("price_history_days"),
        covered.alias("has_image_and_variant_coverage"), (expert if expert is not None else F.lit(False)).alias("has_expert_annotation"),
    )


def page_metrics(pages: DataFrame, metrics: DataFrame) -> DataFrame:
    """C-2: product pages take their first product's metrics, lists have a list by nature, others nothing."""
    m = metrics.select(F.col("product_id").alias("_p"), *[c for c in metrics.columns if c != "product_id"])
    product, listing = F.col("archetype").isin(PRODUCT_PAGES), F.col("archetype").isin(LIST_PAGES)
    joined = pages.withColumn("_p", F.when(product, F.get("entity_refs", 0))).join(m, "_p", "left").drop("_p")
    numbers = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("live_offer_count", "parsed_review_count", "price_history_days")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_image_and_variant_coverage", "has_expert_annotation")}
    return joined.withColumns(numbers | flags | {"has_full_ingredient_list": F.coalesce("has_full_ingredient_list", listing)})


def score(metrics: DataFrame) -> DataFrame:
    """C-1: dcs_score, mandatory_passed, indexable, index_tier, robots_meta and reasons."""
    parts = [("has_full_ingredient_list", 30), ("live_offer_count >= 2", 20), ("parsed_review_count >= 15", 20), ("price_history_days >= 30", 10), ("has_image_and_variant_coverage", 10), ("has_expert_annotation", 10)]
    total = sum((F.when(F.expr(test), points).otherwise(0) for test, points in parts), F.lit(0))
    needs = {
        "ingredient list missing": ~F.col("has_full_ingredient_list"),
        "fewer than 2 offers": F.col("archetype").isin("product", "p") & (F.col("live_offer_count") < 2),
        "expert annotation missing": F.col("archetype").isin(LIST_PAGES) & ~F.col("has_expert_annotation"),
    }
    out = metrics.withColumn("dcs_score", total).withColumn("reasons", F.array_compact(F.array(*[F.when(t, n) for n, t in needs.items()], F.when(total < 70, "score below 70"))))
    passed = ~F.exists("reasons", lambda r: r != "score below 70")
    out = out.withColumn("mandatory_passed", passed).withColumn("indexable", passed & (F.col("dcs_score") >= 70))
    return out.withColumns({"index_tier": F.when(F.col("indexable"), "indexed").otherwise("provisional"), "robots_meta": F.when(F.col("indexable"), "index, follow").otherwise("noindex, follow")})


def promote(pages: DataFrame, scored: DataFrame, as_of: str) -> DataFrame:
    """C-3: pages (url, first_indexed_at) after scoring; the first indexing time is set once and kept."""
    s = scored.select("url", "dcs_score", "indexable", "index_tier")
    now = F.lit(as_of).cast("timestamp")
    return pages.drop("dcs_score", "indexable", "index_tier").join(s, "url").withColumn("first_indexed_at", F.coalesce("first_indexed_at", F.when(F.col("indexable"), now)))


def sync_products(products: DataFrame, scored: DataFrame) -> DataFrame:
    """C-3: products with the score and tier of their page (archetypes product and p, first entity); of several pages the last by url.
    Products without one keep theirs."""
    page = scored.where(F.col("archetype").isin("product", "p")).select(F.get("entity_refs", 0).alias("product_id"), "url", F.col("dcs_score").alias("_score"), F.col("index_tier").alias("_tier")).where("product_id is not null")
    last = page.groupBy("product_id").agg(F.max_by(F.struct("_score", "_tier"), "url").alias("_p"))
    out = products.join(last, "product_id", "left")
    return out.withColumns({"dcs_score": F.coalesce("_p._score", "dcs_score"), "index_tier": F.coalesce("_p._tier", "index_tier")}).drop("_p")
