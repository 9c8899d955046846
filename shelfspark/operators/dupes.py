"""Formula vectors and the graph of alternatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.scores import ingredient_weight, per_ml, price_delta_pct
from shelfspark.functions.text import half_up
from shelfspark.operators.ledger import first_by
from shelfspark.operators.pairs import similar_by_rounds, similar_in_tiles
from shelfspark.sources.store import discard, written

METHOD = "v1_inci_weighted"


DIMS = 3000


def formula_vectors(product_ingredients: DataFrame, vocabulary: DataFrame | None = None, dims: int = DIMS) -> DataFrame:
    """V-1: product_id, ingredient_id, weight of unit vectors; an ingredient's last position counts (W-8). With a vocabulary
    (ingredient_id, dim) only ingredients with a dim under `dims` count; a product without any has no vector."""
    if vocabulary is not None:
        product_ingredients = product_ingredients.join(vocabulary.where(F.col("dim") < dims).select("ingredient_id"), "ingredient_id", "left_semi")
    raw = product_ingredients.groupBy("product_id", "ingredient_id").agg(F.max(F.struct("position", "is_active")).alias("p"))
    weighted = raw.select("product_id", "ingredient_id", ingredient_weight(F.col("p.position"), F.col("p.is_active")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("product_id")))
    return weighted.withColumn("norm", norm).where("norm > 0").select("product_id", "ingredient_id", (F.col("w") / F.col("norm")).alias("weight"))


def dense_vectors(vectors: DataFrame, vocabulary: DataFrame, dims: int = DIMS) -> DataFrame:
    """product_id, v (array<float> of `dims`): the vectors of formula_vectors as arrays, for an index that stores them so."""
    rows = vectors.join(vocabulary.where(F.col("dim") < dims), "ingredient_id")
    sparse = rows.groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return sparse.select("product_id", cell.alias("v"))


def pairwise_cosine(vectors: DataFrame, block: str, min_similarity: float = 0.0) -> DataFrame:
    """V-2, J-6: a, b, similarity of products that share a block and an ingredient, a < b, from min_similarity on. Without a threshold
    every such pair is a row, so the result grows with the square of a common ingredient's products; shuffles carry labels only."""
    return similar_pairs(vectors, block, min_similarity)


def similar_pairs(vectors: DataFrame, block: str, min_similarity: float, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of pairwise_cosine with at least min_similarity; vectors have length 1. wanted (product_id): only pairs with
    one of these products at least. Labels are written once; pairs are found in tiles of them (`pairs`)."""
    return similar_in_tiles(written(asked_labels(labels_of(vectors, block), wanted)), min_similarity)


def labels_of(vectors: DataFrame, block: str) -> DataFrame:
    """block, product_id, items, weights: a row for each product."""
    labels = vectors.groupBy(F.col(block).alias("block"), "product_id").agg(F.collect_list(F.struct("ingredient_id", "weight")).alias("label"))
    return labels.select("block", "product_id", F.col("label.ingredient_id").alias("items"), F.col("label.weight").alias("weights"))


def asked_labels(labels: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Labels with asked: whether they are of wanted products; without `wanted` all are."""
    if wanted is None:
        return labels.withColumn("asked", F.lit(True))
    asked = wanted.select("product_id", F.lit(True).alias("asked")).distinct()
    return labels.join(asked, "product_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from both of its ends. One read of the pairs, as they are costly to find."""
    ends = [F.struct(F.col(x).alias("product_id"), F.col(y).alias("other_id"), "similarity") for x, y in ("ab", "ba")]
    return pairs.select(F.inline(F.array(*ends)))


def dupe_candidates(vectors: DataFrame, products: DataFrame, k: int = 20, min_similarity: float = 0.60) -> DataFrame:
    """V-3, W-4: each product's k most similar ones of its category. Filtering first changes nothing, as similarity is the sort key.
    Of several rounds each is merged into the lists of those before, so that never more than these are kept."""
    blocked = vectors.join(products.select("product_id", "category"), "product_id")
    best, rounds = None, similar_by_rounds(written(asked_labels(labels_of(blocked, "category"))), min_similarity)
    for left, near in enumerate(rounds, 1 - len(rounds)):
        rows = both_ways(near())
        top = _best(rows if best is None else rows.unionByName(best.drop("rank")), k)
        if not left:
            return top
        before, best = best, written(top)
        if before is not None:
            discard(before)


def _best(rows: DataFrame, k: int) -> DataFrame:
    return first_by(rows, ["product_id"], [F.desc(half_up(F.col("similarity"), 9)), "other_id"], k)


def refresh_candidates(old: DataFrame, vectors: DataFrame, products: DataFrame, changed: DataFrame, k: int = 20, min_similarity: float = 0.60) -> DataFrame:
    """V-5: the lists of dupe_candidates after the vectors or categories of `changed` (product_id) have changed, appeared or gone.

    old: the lists before, a table that is read several times; vectors, products: as they are now. Changed products are compared with all
    others; elsewhere rows on them are replaced. A list that was full and has not k rows left at or before its old last one may have lost its
    place to a product that was never listed: those products are compared anew, too. Equal to a full rebuild. Labels are made once."""
    blocked = vectors.join(products.select("product_id", "category"), "product_id")
    gone = changed.select("product_id").distinct()
    names = gone.withColumnRenamed("product_id", "other_id")
    labels = written(asked_labels(labels_of(blocked, "category"), gone))
    new = written(both_ways(similar_in_tiles(labels, min_similarity)))
    stay = old.join(gone, "product_id", "left_anti").select("product_id", "other_id", "similarity")
    kept = stay.join(names, "other_id", "left_anti").select("product_id", "other_id", "similarity")
    merged = written(kept.union(new.join(gone, "product_id", "left_anti").select("product_id", "other_id", "similarity")))
    key = lambda s, o: F.struct((-half_up(s, 9)).alias("s"), o.alias("o"))  # noqa: E731  smaller is better
    full = stay.groupBy("product_id").agg(F.count("*").alias("n"), F.max(key(F.col("similarity"), F.col("other_id"))).alias("last")).where(F.col("n") >= k)
    safe = merged.join(full, "product_id").where(key(F.col("similarity"), F.col("other_id")) <= F.col("last")).groupBy("product_id").agg(F.count("*").alias("m")).where(F.col("m") >= k)
    repair = written(full.select("product_id").join(safe, "product_id", "left_anti"))
    again = written(asked_labels(labels.drop("asked"), repair))
    discard(labels)
    again = both_ways(similar_in_tiles(again, min_similarity)).join(repair, "product_id", "left_semi")
    return _best(merged.join(repair, "product_id", "left_anti").unionByName(again).unionByName(new.join(gone, "product_id", "left_semi")), k)


def price_deltas(pairs: DataFrame, latest: DataFrame, products: DataFrame) -> DataFrame:
    """V-4: pairs (a, b) with the price difference per ml of their latest in-stock offers; 0 without two of one currency."""
    o = latest.join(products.select("product_id", "size_ml"), "product_id").select("product_id", "price", "size_ml", "currency")
    for side in ("a", "b"):
        pairs = pairs.join(o.select(F.col("product_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("price", "size_ml", "currency")]), side, "left")
    delta = price_delta_pct(F.col("price_a"), F.col("size_ml_a"), F.col("price_b"), F.col("size_ml_b"))
    return pairs.withColumn("price_delta_pct", F.when(F.col("currency_a") == F.col("currency_b"), delta).otherwise(0.0)).drop(*[f"{c}_{s}" for c in ("price", "size_ml", "currency") for s in "ab"])


def dupe_edges(candidates: DataFrame, latest: DataFrame, products: DataFrame, as_of: str) -> DataFrame:
    """V-5: one row per canonical pair a < b."""
    pairs = candidates.select(F.least("product_id", "other_id").alias("a"), F.greatest("product_id", "other_id").alias("b"), "similarity")
    one = pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return price_deltas(one, latest, products).select("a", "b", half_up(F.col("similarity"), 4).alias("similarity"), "price_delta_pct", F.lit(METHOD).alias("method_version"), F.lit(as_of).cast("timestamp").alias("computed_at"))


def edges_of(edges: DataFrame) -> DataFrame:
    """J-11: every edge seen from both of its ends; the difference changes its sign."""
    ends = [F.struct(F.col(x).alias("product_id"), F.col(y).alias("other_id"), "similarity", d.alias("price_delta_pct")) for x, y, d in (("a", "b", F.col("price_delta_pct")), ("b", "a", -F.col("price_delta_pct")))]
    return edges.select(F.inline(F.array(*ends)))


def ranked_dupes(edges: DataFrame, products: DataFrame, latest: DataFrame, k: int = 10) -> DataFrame:
    """W-9: each product's k best alternatives with their latest offer."""
    top = first_by(edges_of(edges), ["product_id"], [F.desc("similarity"), "other_id"], k)
    other = products.select(F.col("product_id").alias("other_id"), F.col("name").alias("other_name"), F.col("slug").alias("other_slug"))
    offer = latest.select(F.col("product_id").alias("other_id"), F.col("price").alias("other_price"), F.col("currency").alias("other_currency"))
    return top.join(other, "other_id").join(offer, "other_id", "left")


def ingredient_sets(product_ingredients: DataFrame, names: DataFrame | None = None) -> DataFrame:
    key = "ingredient_id"
    rows = product_ingredients.select("product_id", key)
    if names is not None:
        rows, key = rows.join(names, key).select("product_id", "inci_name"), "inci_name"
    return rows.groupBy("product_id").agg(F.sort_array(F.collect_set(key)).alias("items"))


def of_pairs(pairs: DataFrame) -> DataFrame:
    """product_id of each product in pairs (a, b), once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("product_id")).distinct()


def set_similarity(pairs: DataFrame, sets: DataFrame, lowest: DataFrame) -> DataFrame:
    """V-6: Jaccard per cent, savings per ml and the shared and unique ingredients of pairs (a, b). What the pairs' ends take is written once."""
    about = written(sets.join(lowest.select("product_id", per_ml(F.col("price"), F.col("size_ml")).alias("pml")), "product_id", "left"))
    for side in ("a", "b"):
        pairs = pairs.join(about.select(F.col("product_id").alias(side), F.col("items").alias(f"items_{side}"), F.col("pml").alias(f"pml_{side}")), side)
    shared = F.array_intersect("items_a", "items_b")
    return pairs.select(
        "a", "b", half_up(F.size(shared) / F.size(F.array_union("items_a", "items_b")) * 100, 0).cast("long").alias("match_pct"),
        half_up((F.col("pml_a") - F.col("pml_b")) / F.nullif("pml_a", F.lit(0.0)) * 100, 0).cast("long").alias("savings_pct"),
        shared.alias("shared"), F.array_except("items_a", "items_b").alias("unique_a"), F.array_except("items_b", "items_a").alias("unique_b"),
    )
