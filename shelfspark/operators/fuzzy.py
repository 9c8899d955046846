"""Fuzzy matches of strings against a large dictionary, by an index of segments.

Two strings of n and m characters that reach the threshold are at most D(n, m) edits apart. A key is cut into D + 1 even segments,
so an edit script of D edits leaves one of them whole; and for one whole segment i, at most i of the edits lie before it
and at most D - i after it, which bounds where it can stand in the other string. Keys and candidates meet in an
equi-join on (m, D, i, segment), and are then scored. Nothing is lost, whatever the threshold: where D reaches the length of
a key, its empty segments meet every string of a fitting length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scores import name_score, quick_ratio

_E = 1e-9


def _int(x: Column) -> Column:
    return x.cast("int")


def length_range(n: Column, threshold: float, mode: str) -> tuple[Column, Column]:
    """The lengths that a string of n characters can match. levenshtein: 1 - d / max(n, m); difflib: 2 * matches / (n + m)."""
    most = 1 / threshold if mode == "levenshtein" else (2 - threshold) / threshold
    return F.greatest(_int(F.ceil(n / most - _E)), F.lit(1)), _int(F.floor(n * most + _E))


def edits(n: Column, m: Column, threshold: float, mode: str) -> Column:
    """Most insertions, deletions and replacements between strings that match. What difflib leaves unmatched is deleted or inserted."""
    return _int(F.floor((1 - threshold) * (F.greatest(n, m) if mode == "levenshtein" else n + m) + _E))


def _segment(m: Column, d: Column, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of segment i of d + 1: the last ones have one character more."""
    k = d + 1
    base, short = _int(F.floor(m / k)), k - m % k
    return i * base + F.greatest(i - short, F.lit(0)), base + F.when(i >= short, 1).otherwise(0)


def _key_lengths(lengths: DataFrame, threshold: float, mode: str) -> DataFrame:
    """_m -> _m, _d: the numbers of edits that a key of this length may be cut for."""
    m = F.col("_m")
    low, high = length_range(m, threshold, mode)
    ds = F.array_distinct(F.transform(F.sequence(low, F.greatest(low, high)), lambda n: edits(n, m, threshold, mode)))
    return lengths.select("*", F.explode(ds).alias("_d"))


def _key_segments(keys: DataFrame, key: str, threshold: float, mode: str) -> DataFrame:
    rows = _key_lengths(keys.withColumn("_m", F.length(key)).where("_m > 0"), threshold, mode)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_d"))).alias("_i"))
    start, size = _segment(F.col("_m"), F.col("_d"), F.col("_i"))
    return rows.withColumn("_s", F.substring(F.col(key), start + 1, size))


def _text_segments(texts: DataFrame, text: str, threshold: float, mode: str, lengths: DataFrame) -> DataFrame:
    """lengths: the (_m, _d) that keys have, at most a few for each length of a key: others are not looked up."""
    n = F.length(text)
    low, high = length_range(n, threshold, mode)
    rows = texts.where(n > 0).select(text, n.alias("_n"), F.explode(F.sequence(low, F.greatest(low, high))).alias("_m"))
    rows = rows.withColumn("_d", edits(F.col("_n"), F.col("_m"), threshold, mode)).join(F.broadcast(lengths), ["_m", "_d"])
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_d"))).alias("_i"))
    start, size = _segment(F.col("_m"), F.col("_d"), F.col("_i"))
    late, rest = F.col("_n") - F.col("_m"), F.col("_d") - F.col("_i")
    first = F.greatest(start - F.col("_i"), start + late - rest, F.lit(0))
    last = F.least(start + F.col("_i"), start + late + rest, F.col("_n") - size)
    at = F.explode(F.when(first <= last, F.sequence(first, F.greatest(first, last))))
    rows = rows.select("*", size.alias("_size"), at.alias("_at"))
    return rows.select(text, "_m", "_d", "_i", F.substring(F.col(text), F.col("_at") + 1, F.col("_size")).alias("_s")).distinct()


def fuzzy_pairs(texts: DataFrame, keys: DataFrame, threshold: float, mode: str = "levenshtein", text: str = "cand", key: str = "key") -> DataFrame:
    """Every (text, key) whose score reaches the threshold, with `score`. texts, keys: distinct strings; empty ones match nothing.

    In mode difflib an upper bound (characters in common) is compared first, natively."""
    on = ["_m", "_d", "_i", "_s"]
    cut = _key_segments(keys.select(key), key, threshold, mode)
    lengths = _key_lengths(keys.select(F.length(key).alias("_m")).where("_m > 0").distinct(), threshold, mode)
    met = _text_segments(texts.select(text), text, threshold, mode, lengths).join(cut, on).select(text, key).distinct()
    if mode == "difflib":
        met = met.where(quick_ratio(F.col(text), F.col(key)) >= threshold - _E)
    return met.withColumn("score", name_score(F.col(text), F.col(key), mode)).where(F.col("score") >= threshold)
