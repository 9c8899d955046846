"""Search performance: load and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import archetype_from_path, half_up, relative_path
from shelfspark.operators.upsert import upsert
from shelfspark.sources.feeds import flatten_search_rows


def attach_pages(metrics: DataFrame, pages: DataFrame) -> DataFrame:
    """J-10: a metric's page by its path, else by its whole URL; archetype of the page, else of the path. Pages grow with the catalog and
    are never broadcast: Spark takes their file's size for theirs, but their text is many times as long."""
    p = pages.select(F.col("url").alias("page_url"), F.col("archetype").alias("page_archetype"))
    path = relative_path(F.col("url"))
    keyed = metrics.withColumn("path", F.coalesce(path, "url")).withColumn("bare", F.coalesce(F.try_parse_url("url", F.lit("PATH")), "url"))
    for i, key in enumerate(("path", "bare", "url")):
        keyed = keyed.join(p.select(F.col("page_url").alias(f"p{i}"), F.col("page_archetype").alias(f"a{i}")).hint("merge"), F.col(key) == F.col(f"p{i}"), "left")
    return keyed.withColumns({"page_url": F.coalesce("p0", "p1", "p2"), "archetype": F.coalesce("a0", "a1", "a2", archetype_from_path(F.col("path")))}).drop("p0", "p1", "p2", "a0", "a1", "a2", "bare")


def load_search(raw: DataFrame, pages: DataFrame, existing: DataFrame, as_of: str, date: str | None = None) -> DataFrame:
    """G-1: a day's API rows into the table by url and date. The day is two days before as_of unless given, when its figures are final."""
    day = F.date_sub(F.lit(as_of).cast("date"), 2) if date is None else F.lit(date).cast("date")
    rows = attach_pages(flatten_search_rows(raw, day), pages)
    return upsert(existing, rows, ["url", "date"], [F.desc("impressions"), F.desc("clicks"), F.col("position")])


def page_stats(pages: DataFrame) -> DataFrame:
    """A-5"""
    return pages.groupBy("archetype").agg(F.count("*").alias("total_pages"), F.count_if("indexable").alias("indexed_pages"))


def search_stats(search: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A-6"""
    recent = search.where(F.col("archetype").isNotNull() & (F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return recent.groupBy("archetype").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.avg("ctr").alias("avg_ctr"), F.avg("position").alias("avg_position"))


def scorecard(pages: DataFrame, search: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """A-7, J-9"""
    both = page_stats(pages).join(search_stats(search, as_of, days), "archetype", "full")
    total, imps = F.coalesce("total_pages", F.lit(0)), F.coalesce("impressions", F.lit(0))
    return both.select(
        "archetype", total.alias("total_pages"), F.coalesce("indexed_pages", F.lit(0)).alias("indexed_pages"), half_up(F.coalesce(F.col("indexed_pages") / F.nullif("total_pages", F.lit(0)), F.lit(0.0)) * 100, 2).alias("index_rate"),
        imps.alias("impressions"), F.coalesce("clicks", F.lit(0)).alias("clicks"), half_up(F.when(imps > 0, F.col("clicks") / F.nullif(imps, F.lit(0))).otherwise(F.coalesce("avg_ctr", F.lit(0.0))) * 100, 4).alias("ctr"),
        half_up(F.coalesce("avg_position", F.lit(0.0)), 2).alias("avg_position"),
    )
