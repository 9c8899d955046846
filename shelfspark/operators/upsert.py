"""Keyed writes as snapshots, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """U-1: the snapshot after new rows replace old ones by key; of several new rows the first in order counts.
    is_new says that the key was not there."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    had = old.select(*keys).distinct().withColumn("_had", F.lit(True)).hint("merge")
    fresh = last.join(had, keys, "left").withColumn("is_new", F.col("_had").isNull()).drop("_had")
    kept = old.join(last.select(*keys), keys, "left_anti").withColumn("is_new", F.lit(False))
    return kept.unionByName(fresh.select(*kept.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """U-2: the rows to append: of each key that old lacks, the first in order. Old keys are never broadcast."""
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return first.join(old.select(*keys).hint("merge"), keys, "left_anti")


def find_or_create(dimension: DataFrame, wanted: DataFrame, key: str, id_col: str) -> DataFrame:
    """U-3: wanted keys with their ids; a new key's id is a hash of it, so that a rerun finds the same."""
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(dimension.select(key, F.col(id_col).cast("string").alias("_id")), key, "left").select(key, F.coalesce("_id", F.left(F.sha2(key, 256), F.lit(32))).alias(id_col), F.col("_id").isNull().alias("is_new"))


def violations(df: DataFrame, unique: dict[str, list[str]] | None = None, ranges: dict[str, tuple] | None = None, allowed: dict[str, list] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """DQ-1: rule, key, n of everything that breaks a rule."""
    parts = []
    for rule, cols in (unique or {}).items():
        parts.append(df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"), "n"))
    for c, (low, high) in (ranges or {}).items():
        parts.append(df.where(~F.col(c).between(low, high)).groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(f"range {c}").alias("rule"), "key", "n"))
    for c, values in (allowed or {}).items():
        parts.append(df.where(~F.col(c).isin(values)).groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(f"value {c}").alias("rule"), "key", "n"))
    for c, (other, key) in (foreign or {}).items():
        lost = df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias(c)), c, "left_anti")
        parts.append(lost.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(f"foreign {c}").alias("rule"), "key", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
