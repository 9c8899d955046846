"""Entity resolution: deterministic, fuzzy, then embedding matches of feed items to variants."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scores import combined_score, name_score, quick_ratio, size_score
from shelfspark.functions.text import clean_title, slug_a
from shelfspark.operators.ledger import first_by, gtin_lookup
from shelfspark.operators.nearest import nearest
from shelfspark.sources.store import written

THRESHOLD, LOOK_FURTHER, BAND = 0.85, 0.70, 0.15


def slug_lookup(items: DataFrame, variants: DataFrame) -> DataFrame:
    """J-4: items (brand_name, title, size_ml) with the variant of the same brand slug, name slug and size."""
    keyed = items.withColumns({"brand_slug": slug_a(F.col("brand_name")), "name_slug": slug_a(clean_title(F.col("title"), F.col("brand_name")))})
    own = variants.groupBy(slug_a(F.col("brand")).alias("brand_slug"), slug_a(F.col("name")).alias("name_slug"), "size_ml").agg(F.min("product_id").alias("slug_variant"))
    return keyed.join(own.hint("merge"), ["brand_slug", "name_slug", "size_ml"], "left").drop("brand_slug", "name_slug")


def tier1(items: DataFrame, variants: DataFrame) -> DataFrame:
    """E-1: by gtin, else by slugs; confidence 1."""
    found = slug_lookup(gtin_lookup(items, variants), variants)
    method = F.when(F.col("variant_id").isNotNull(), "gtin").when(F.col("slug_variant").isNotNull(), "brand_slug_size")
    return found.withColumn("method", method).withColumn("variant_id", F.coalesce("variant_id", "slug_variant")).drop("slug_variant")


def size_band(items: DataFrame, variants: DataFrame, band: float = BAND, **extra) -> DataFrame:
    """J-5: items with the variants whose size is within the band around theirs.

    Sizes fall into buckets of a power of 1 + band; an item looks into its own and the neighbours that the band may reach,
    an equi-join, and then compares."""
    step = math.log(1 + band)

    def bucket(x):
        return F.floor(F.log(x) / step)

    left = items.where("size_ml > 0").withColumn("_b", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(1)), lambda o: bucket(F.col("size_ml")) + o)))
    right = variants.where("size_ml > 0").select(F.col("product_id").alias("cand_id"), F.col("name").alias("cand_name"), F.col("size_ml").alias("cand_size"), bucket(F.col("size_ml")).alias("_b"), *[F.col(c).alias(a) for a, c in extra.items()])
    return left.join(right, "_b").where(F.col("cand_size").between(F.col("size_ml") * (1 - band), F.col("size_ml") * (1 + band))).drop("_b")


def tier2(items: DataFrame, variants: DataFrame, most: int = 50, mode: str = "levenshtein") -> DataFrame:
    """E-2: the best of the `most` variants nearest in size, by name and size. Distinct titles are paired and scored.

    In mode difflib a bound of the score, from the characters in common, spares the candidates that cannot be the best.
    Nearness is (difference, id), so of one size only the `most` smallest ids can be among the nearest: variants are cut to
    those before the join, which then grows with the sizes in the band and not with the catalog. The nearest depend on the size
    alone and are found once for each; of equal names and sizes the smallest id is the best, so the others go.
    """
    titled = items.select("item_id", "size_ml", clean_title(F.col("title"), F.col("brand_name")).alias("clean"))
    kinds = titled.select("clean", "size_ml").distinct()
    possible = first_by(variants.where("size_ml > 0"), ["size_ml"], ["product_id"], most).drop("rank")
    near = size_band(kinds.select("size_ml").distinct(), possible).withColumn("diff", F.abs(F.col("cand_size") - F.col("size_ml")))
    nearest_ = first_by(near, ["size_ml"], ["diff", "cand_id"], most).groupBy("size_ml", "diff", "cand_name", "cand_size").agg(F.min("cand_id").alias("cand_id"))
    few = kinds.join(nearest_, "size_ml")
    if mode == "difflib":
        few = _worth_scoring(written(few))
    pairs = few.select("clean", "cand_name").distinct().withColumn("name_score", name_score(F.col("clean"), F.col("cand_name"), mode))
    scored = few.join(pairs, ["clean", "cand_name"]).withColumn("score", combined_score(F.col("name_score"), size_score(F.col("size_ml"), F.col("cand_size"))))
    best = first_by(scored, ["clean", "size_ml"], [F.desc("score"), "diff", "cand_id"]).select("clean", "size_ml", F.col("cand_id").alias("t2_id"), F.col("score").alias("t2_score"))
    return titled.join(best, ["clean", "size_ml"]).select("item_id", "t2_id", "t2_score")


def _worth_scoring(few: DataFrame) -> DataFrame:
    """Of the candidates of each (clean, size_ml) those whose bound of the score reaches the score of the one with the highest bound."""
    key = ["clean", "size_ml"]
    names = written(few.select("clean", "cand_name").distinct().withColumn("quick", quick_ratio(F.col("clean"), F.col("cand_name"))))
    bounded = written(few.join(names, ["clean", "cand_name"]).withColumn("most", combined_score(F.col("quick"), size_score(F.col("size_ml"), F.col("cand_size")))).drop("quick"))
    head = first_by(bounded, key, [F.desc("most"), "diff", "cand_id"]).select(*key, "cand_name", "cand_size")
    first = head.select("clean", "cand_name").distinct().withColumn("name_score", name_score(F.col("clean"), F.col("cand_name"), "difflib"))
    reached = head.join(first, ["clean", "cand_name"]).select(*key, combined_score(F.col("name_score"), size_score(F.col("size_ml"), F.col("cand_size"))).alias("least"))
    return bounded.join(reached, key).where(F.col("most") >= F.col("least")).drop("most", "least")


def tier3(items: DataFrame, variants: DataFrame, embed, k: int = 5, probes: int | None = None) -> DataFrame:
    """E-3: 0.7 cosine + 0.3 size over the k nearest by cosine in the size band. embed: a column function text -> unit vector.

    Each distinct name is embedded once. Distinct (title, size) pairs look up buckets of sizes, as in J-5, by cells (`nearest`);
    probes: cells that they visit in each bucket, all if None. Cosines are compared at nine digits, ties go to the smaller id: of one name
    and size only the k smallest ids can be among the nearest, and the others are not compared."""
    kinds = items.select(clean_title(F.col("title"), F.col("brand_name")).alias("clean"), "size_ml", "item_id")
    asked = written(kinds.where("size_ml > 0").select("clean", "size_ml").distinct()).withColumn("id", F.xxhash64("clean", "size_ml"))
    shop = variants.where("size_ml > 0").select(F.col("product_id").alias("id"), "name", F.col("size_ml").alias("x"))
    shop = written(first_by(shop, ["name", "x"], ["id"], k).drop("rank"))
    names = asked.select(F.col("clean").alias("text")).union(shop.select("name")).distinct().withColumn("v", embed(F.col("text")))
    step = math.log(1 + BAND)
    bucket = lambda x: F.floor(F.log(x) / step)
    vectors = shop.join(names, F.col("name") == F.col("text")).select("id", "x", "v", bucket(F.col("x")).alias("b"))
    around = F.explode(F.transform(F.sequence(F.lit(-2), F.lit(1)), lambda o: bucket(F.col("size_ml")) + o))
    queries = asked.join(names, F.col("clean") == F.col("text")).select("id", "v", (F.col("size_ml") * (1 - BAND)).alias("low"), (F.col("size_ml") * (1 + BAND)).alias("high"), around.alias("b"))
    found = nearest(vectors, queries, "b", k, probes, digits=9, other=False, cells=probes is not None).withColumnsRenamed({"id": "cand_id", "query_id": "id"})
    few = found.join(shop.select(F.col("id").alias("cand_id"), F.col("x").alias("cand_size")), "cand_id").join(asked, "id")
    cos = F.greatest(F.least("similarity", F.lit(1.0)), F.lit(0.0))
    few = few.withColumn("score", combined_score(cos, size_score(F.col("size_ml"), F.col("cand_size"))))
    best = first_by(few, ["clean", "size_ml"], [F.desc("score"), "cand_id"]).select("clean", "size_ml", F.col("cand_id").alias("t3_id"), F.col("score").alias("t3_score"))
    return kinds.join(best, ["clean", "size_ml"]).select("item_id", "t3_id", "t3_score")


def resolve(items: DataFrame, variants: DataFrame, embed=None, mode: str = "levenshtein") -> DataFrame:
    """E-4: item_id, tier, method, candidate_id, confidence. Each tier sees only what the ones before left.

    What tiers 1 and 2 leave is written, as every later tier reads it."""
    one = written(tier1(items, variants).select("item_id", "title", "brand_name", "size_ml", "variant_id", "method"))
    done = one.where("variant_id is not null").select("item_id", F.lit("tier1").alias("tier"), "method", F.col("variant_id").alias("candidate_id"), F.lit(1.0).alias("confidence"))
    rest = one.where("variant_id is null").select("item_id", "title", "brand_name", "size_ml")
    two = written(rest.join(tier2(rest, variants, mode=mode), "item_id", "left"))
    if embed is None:
        two = two.withColumns({"t3_id": F.lit(None).cast("long"), "t3_score": F.lit(None).cast("double")})
    else:
        ask = two.where(F.col("t2_score").isNull() | ((F.col("t2_score") >= LOOK_FURTHER) & (F.col("t2_score") < THRESHOLD)))
        two = two.join(tier3(ask.select("item_id", "title", "brand_name", "size_ml"), variants, embed), "item_id", "left")
    third = F.col("t3_score") >= F.coalesce("t2_score", F.lit(0.0))
    none = F.col("t2_score").isNull() & F.col("t3_score").isNull()
    later = two.select(
        "item_id", F.when(none, "none").when(third, "tier3").otherwise("tier2").alias("tier"), F.when(none, "no_match").when(third, "embedding").otherwise("fuzzy").alias("method"),
        F.when(third, F.col("t3_id")).otherwise(F.col("t2_id")).alias("candidate_id"), F.when(third, F.col("t3_score")).otherwise(F.coalesce("t2_score", F.lit(0.0))).alias("confidence"),
    )
    return done.union(later)


def route(resolved: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """E-5: auto-linked rows and queue rows (pending, confidence null if 0) in one frame; filter on `linked` for two sinks."""
    linked = F.col("confidence") >= threshold
    return resolved.select("item_id", "tier", "method", linked.alias("linked"), F.when(linked, F.col("candidate_id")).alias("variant_id"), F.when(~linked, F.col("candidate_id")).alias("candidate_id"), F.when(linked, F.col("confidence")).otherwise(F.nullif("confidence", F.lit(0.0))).alias("confidence"), F.when(~linked, "pending").alias("status"))


def apply_reviews(queue: DataFrame, decisions: DataFrame, reviewed_at: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """E-8: the queue after decisions (item_id, decision, reviewer, variant_id), and the offers that approvals append: an approved
    item with a variant and a price over 0, as its feed row (items) has it. Append them to the ledger (S-6)."""
    d = decisions.select("item_id", "decision", "reviewer", F.col("variant_id").alias("chosen"))
    after = queue.join(d.hint("merge"), "item_id", "left").select(
        *[c for c in queue.columns if c not in ("status", "variant_id")], F.coalesce("decision", "status").alias("status"),
        F.when(F.col("decision") == "approved", F.coalesce("chosen", "candidate_id")).otherwise(F.col("variant_id")).alias("variant_id"),
        F.when(F.col("decision").isNotNull(), F.lit(reviewed_at).cast("timestamp")).alias("reviewed_at"), F.col("reviewer").alias("reviewed_by"),
    )
    approved = after.where("status = 'approved' and variant_id is not null and reviewed_at is not null").join(items.select("item_id", "retailer_id", "price", "currency", "affiliate_url").hint("merge"), "item_id")
    offers = approved.where("price > 0").select(
        "item_id", "variant_id", "retailer_id", "price", F.coalesce("currency", F.lit("INR")).alias("currency"), F.lit(True).alias("in_stock"),
        F.coalesce(F.nullif("affiliate_url", F.lit("")), F.lit("#")).alias("affiliate_url"), F.col("reviewed_at").alias("seen_at"),
    )
    return after, offers
