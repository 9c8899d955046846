"""Numeric columns: weights, price differences, similarities and grades."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.text import half_up


def position_weight(position: Column) -> Column:
    """exp(-0.2 * (position - 1)); a position below 1 is an error."""
    return F.when(position >= 1, F.exp(-0.2 * (position - 1))).otherwise(F.raise_error(F.lit("position must be at least 1")).cast("double"))


def ingredient_weight(position: Column, is_active: Column) -> Column:
    return position_weight(position) * F.when(is_active, 2.0).otherwise(1.0)


def price_delta_pct(price_a: Column, size_a: Column, price_b: Column, size_b: Column) -> Column:
    """How much dearer a is than b per ml, in percent; 0 where it cannot be said."""
    a, b = price_a / F.nullif(size_a, F.lit(0.0)), price_b / F.nullif(size_b, F.lit(0.0))
    usable = (size_a > 0) & (size_b > 0) & (price_b > 0)
    return F.coalesce(F.when(usable, half_up((a - b) / F.nullif(b, F.lit(0.0)) * 100, 2)), F.lit(0.0))


def size_score(a: Column, b: Column) -> Column:
    dev = F.abs(a - b) / F.nullif(b, F.lit(0.0))
    return F.when(b == 0, 0.0).when(dev == 0, 1.0).when(dev <= 0.05, 1.0 - dev / 0.05 * 0.2).when(dev <= 0.15, 0.5).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two strings, upper case and trimmed. Use it on distinct pairs."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x.strip().upper(), y.strip().upper()).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def quick_ratio(a: Column, b: Column) -> Column:
    """At least name_ratio: twice the characters that both strings have, as often as both do, by their lengths. Native."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))

    def count(s, c):
        return F.length(s) - F.length(F.replace(s, c, F.lit("")))

    both = F.aggregate(F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")), F.lit(0), lambda n, c: n + F.least(count(x, c), count(y, c)))
    return F.coalesce(2.0 * both / F.nullif(F.length(x) + F.length(y), F.lit(0)), F.lit(1.0))


def name_score(a: Column, b: Column, mode: str = "levenshtein") -> Column:
    """0 to 1. levenshtein: native; difflib: a pandas UDF."""
    if mode == "difflib":
        return name_ratio(a, b)
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def combined_score(name: Column, size: Column) -> Column:
    return half_up(0.70 * name + 0.30 * size, 4)


def per_ml(price: Column, ml: Column) -> Column:
    return price / F.coalesce(F.nullif(ml, F.lit(0.0)), F.lit(30.0))


def main_function(functions: Column) -> Column:
    """The first function that an ingredient has; Active/Solvent without one."""
    return F.coalesce(F.nullif(F.get(functions, 0), F.lit("")), F.lit("Active/Solvent"))


def safety_grade(comedogenic: Column) -> Column:
    return F.when(comedogenic <= 1, "A").when(comedogenic <= 3, "B").otherwise("C")


# Category names as sources write them.
CATEGORY_ALIASES = {
    "serum": "Serums", "serums": "Serums", "standard": "Serums",
    "moisturizer": "Moisturizers", "moisturizers": "Moisturizers", "economy": "Moisturizers",
    "sunscreen": "Sunscreens", "sunscreens": "Sunscreens", "promo": "Sunscreens",
    "cleanser": "Cleansers", "cleansers": "Cleansers", "large": "Cleansers",
}


def category(x: Column) -> Column:
    """One of four categories; Serums for a name that is not known."""
    names = F.create_map(*[F.lit(v) for pair in CATEGORY_ALIASES.items() for v in pair])
    return F.coalesce(F.element_at(names, F.lower(F.trim(x))), F.lit("Serums"))


def skin_fit(types: Column, skin_type: Column) -> Column:
    return F.when(F.array_contains(types, skin_type), 5).otherwise(2)


def embed(model=None, dims: int = 384):
    """A column function text -> unit vector. model: an object with encode(list of texts); without one, hashed tokens."""
    import numpy as np

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        import zlib

        if model is not None:
            rows = np.asarray(model.encode([t or "" for t in texts]), np.float64)
        else:
            rows = np.zeros((len(texts), dims))
            for i, t in enumerate(texts):
                for token in (t or "").lower().split():
                    rows[i, zlib.crc32(token.encode()) % dims] += 1
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        return pd.Series(list((rows / np.where(norm == 0, 1, norm)).astype(np.float32)))

    return run
