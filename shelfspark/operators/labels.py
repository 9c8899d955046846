"""Ingredient labels: slots, candidates and dictionary matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.text import half_up
from shelfspark.operators.fuzzy import fuzzy_pairs

# Words that are no ingredient.
NOISE = ["may contain", "peut contenir", "+/-", "and", "oder", "et", ""]
PERCENT = r"\d+(?:\.\d+)?\s*%"
REVIEW = 0.70


def _spaces(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _clean(x: Column) -> Column:
    return _spaces(F.regexp_replace(F.regexp_replace(x, r"(?i)\band\b", " "), PERCENT, " "))


def bare(slot: Column) -> Column:
    """A slot without brackets and percentages."""
    text = F.regexp_replace(F.regexp_replace(slot, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    return _spaces(F.regexp_replace(text, PERCENT, " "))


def candidates(slot: Column) -> Column:
    """N-2: slash parts, then aliases in parentheses, then in brackets, without noise."""
    round_ = F.regexp_extract_all(slot, F.lit(r"\(([^)]*)\)"), F.lit(1))
    square = F.regexp_extract_all(F.regexp_replace(slot, r"\([^)]*\)", " "), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    parts = F.transform(F.concat(F.split(bare(slot), "/"), round_, square), _clean)
    return F.filter(parts, lambda c: ~F.lower(c).isin(NOISE))


def primary(slot: Column) -> Column:
    """N-3"""
    return F.trim(F.element_at(F.split(bare(slot), "/"), 1))


def tokenize(labels: DataFrame) -> DataFrame:
    """N-1: label_id, raw -> label_id, position (from 1, of slots kept), raw_token, candidates."""
    slots = labels.select("label_id", F.posexplode(F.split("raw", ",")).alias("at", "slot")).withColumn("raw_token", F.trim("slot"))
    kept = slots.where("raw_token <> ''").withColumn("candidates", candidates(F.col("raw_token"))).where(F.size("candidates") > 0)
    return kept.select("label_id", F.row_number().over(Window.partitionBy("label_id").orderBy("at")).alias("position"), "raw_token", "candidates")


def dictionary_keys(ingredients: DataFrame) -> DataFrame:
    """N-4: kind (0 name, 1 synonym), key, ingredient_id; the smallest id wins a key."""
    names = ingredients.select(F.lit(0).alias("kind"), F.upper(F.trim("inci_name")).alias("key"), "ingredient_id")
    synonyms = ingredients.select(F.lit(1).alias("kind"), F.explode("synonyms").alias("s"), "ingredient_id").select("kind", F.upper(F.trim("s")).alias("key"), "ingredient_id")
    return names.union(synonyms).groupBy("kind", "key").agg(F.min("ingredient_id").alias("ingredient_id"))


def exact_matches(tokens: DataFrame, keys: DataFrame) -> DataFrame:
    """N-5: the dictionary is small and fixed by hand; it is broadcast below Spark's own threshold."""
    each = tokens.select("label_id", "position", F.posexplode("candidates").alias("at", "c")).withColumn("key", F.upper(F.trim("c")))
    order = Window.partitionBy("label_id", "position").orderBy("kind", "at")
    best = each.join(keys, "key").withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("label_id", "position", "ingredient_id", F.when(F.col("kind") == 0, "exact").otherwise("synonym").alias("match_method"), F.lit(1.0).alias("confidence"))


def fuzzy_matches(tokens: DataFrame, keys: DataFrame, threshold: float = 0.85, mode: str = "levenshtein") -> DataFrame:
    """N-6: the best key of each slot's candidates. Distinct candidate strings meet the keys in an index of segments."""
    each = tokens.select("label_id", "position", F.posexplode("candidates").alias("at", "c")).withColumn("cand", F.upper(F.trim("c")))
    pairs = fuzzy_pairs(each.select("cand").distinct(), keys.select("key").distinct(), threshold, mode).join(keys, "key")
    order = Window.partitionBy("label_id", "position").orderBy(F.desc("score"), "at", "kind", "key")
    best = each.join(pairs.select("cand", "kind", "key", "ingredient_id", "score"), "cand").withColumn("r", F.row_number().over(order)).where("r = 1")
    return best.select("label_id", "position", "ingredient_id", F.lit("fuzzy").alias("match_method"), half_up(F.col("score"), 4).alias("confidence"))


def normalize_labels(labels: DataFrame, ingredients: DataFrame, threshold: float = 0.85, mode: str = "levenshtein") -> DataFrame:
    """N-7: each slot with its ingredient, method, confidence and review flag."""
    tokens, keys = tokenize(labels), dictionary_keys(ingredients)
    exact = exact_matches(tokens, keys)
    fuzzy = fuzzy_matches(tokens.join(exact, ["label_id", "position"], "left_anti"), keys, threshold, mode)
    names = ingredients.select("ingredient_id", "inci_name")
    out = tokens.select("label_id", "position", "raw_token").join(exact.union(fuzzy), ["label_id", "position"], "left").join(names, "ingredient_id", "left")
    confidence = F.coalesce("confidence", F.lit(0.0))
    return out.select("label_id", "position", "raw_token", "ingredient_id", "inci_name", F.coalesce("match_method", F.lit("unmatched")).alias("match_method"), confidence.alias("confidence"), (F.col("match_method").isNull() | (confidence < REVIEW)).alias("flagged"))


def load_rows(normalized: DataFrame, active: int = 4) -> tuple[DataFrame, DataFrame]:
    """N-8, N-9: rows of known ingredients with is_active, and those for review."""
    known = normalized.where("ingredient_id is not null").select("label_id", "position", "ingredient_id", (F.col("position") <= active).alias("is_active"))
    return known, normalized.where("ingredient_id is null")
