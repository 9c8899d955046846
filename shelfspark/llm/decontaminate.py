"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

Items are partitioned by the number n of their distinct word shingles (powers of two). An item contained at
threshold t has at most (1 - t) * n shingles that a document lacks, so of any floor((1 - t) * n) + 1 of its shingles
a containing document has at least one. The bottom sketch of an item is its smallest hash values, as many as the
largest item of its partition needs: a document that has none of them cannot contain the item, however long the
document is, and the search misses nothing. Documents are probed with all their shingles; candidate pairs are
then verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm._common import observed, prepare, row_key, scratch, table

SPLIT = r"[^\p{L}\p{N}]+"
#: Most bytes of the items' side that are broadcast; beyond, the joins shuffle.
BROADCAST_BYTES = 32 << 20


def plain(text: Column) -> Column:
    """Lower-case letters and digits, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), SPLIT, " "))


def shingles(text: Column, *widths: int) -> Column:
    """Runs of so many words, one from each word on, for each width: the pattern looks ahead at a shingle and takes its
    first word."""
    word = "[^ ]++"
    runs = [F.regexp_extract_all(plain(text), F.lit(f"(?=({' '.join([word] * w)})){word}"), F.lit(1)) for w in widths]
    return F.concat(*runs) if len(runs) > 1 else runs[0]


def item_shingles(text: Column, width: int) -> Column:
    """An item's shingles; an item of fewer words is one shingle of its own length."""
    short = F.array_compact(F.array(F.nullif(plain(text), F.lit(""))))
    runs = shingles(text, width)
    return F.when(F.size(runs) > 0, runs).otherwise(short)


def sketches(grams: DataFrame, threshold: float) -> DataFrame:
    """(item_id, gram), distinct -> item_id, h: the bottom sketch of each item, as large as its size partition asks for."""
    rows = grams.select("item_id", F.xxhash64("gram").alias("h")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n")).withColumn("partition", F.ceil(F.log2("n")))
    least = F.floor(F.lit(1 - threshold) * F.pow(F.lit(2.0), F.col("partition")) + 1e-9) + 1
    ranked = rows.join(sizes, "item_id").withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
    return ranked.where(F.col("r") <= least).select("item_id", "h")


def _small(df: DataFrame) -> DataFrame:
    """A written table (with `bytes` observed), broadcast if it is small."""
    return F.broadcast(df) if (observed(df)["bytes"] or 0) <= BROADCAST_BYTES else df


def contaminated(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Pairs doc_id, item_id, n_shared, n_shingles, containment (of the item's distinct shingles) at or over threshold.

    An item of fewer words than a shingle is one shingle of its own length, and is looked for at that length. Null texts and
    texts without words match nothing. Rows that share an id are one document (or item); rows with a null id are left out, as
    they cannot be named.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    theirs = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null")
    size = F.sum(F.octet_length("gram").cast("long") + 48)
    grams = scratch(theirs.select("item_id", F.explode(item_shingles(F.col("text"), width)).alias("gram")).distinct(), bytes=size)
    words = F.regexp_count("gram", F.lit(" ")) + 1
    # at most width - 1 numbers
    short = sorted(r.w for r in grams.select(words.alias("w")).where(F.col("w") < width).distinct().collect())
    sketch = scratch(sketches(grams, threshold), bytes=F.count(F.lit(1)) * 16)
    probes = own.select("doc_id", F.explode(shingles(F.col("text"), width, *short)).alias("gram")).select("doc_id", F.xxhash64("gram").alias("h"))
    pairs = scratch(probes.join(_small(sketch), "h").select("doc_id", "item_id").distinct())

    named = scratch(pairs.select("doc_id").distinct(), bytes=F.sum(F.octet_length(F.col("doc_id").cast("string")).cast("long") + 16))
    known = scratch(grams.select("gram").distinct(), bytes=size)
    texts = own.join(_small(named), "doc_id", "left_semi")
    # rows of one id may share shingles
    held = texts.select("doc_id", F.explode(F.array_distinct(shingles(F.col("text"), width, *short))).alias("gram")).join(_small(known), "gram", "left_semi").distinct()
    # a pair's shingles are those of its item: a shingle that many items have meets only the pairs that were found
    counts = pairs.join(grams, "item_id").join(held, ["doc_id", "gram"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    verified = counts.join(grams.groupBy("item_id").agg(F.count("*").alias("n_shingles")), "item_id")
    return verified.where(F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9).select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x benchmark -> the contaminated documents with the items they hold."""
    prepare(spark)
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a benchmark item. Rows are judged one by one, also where ids are null or repeated; so
    are items without an id."""
    prepare(spark)
    items = table(spark, sf_dir, "benchmark").select(row_key("item_id").alias("item_id"), "text")
    found = contaminated(docs.select(row_key().alias("_key"), "text"), items, id_col="_key").select(F.col("doc_id").alias("_key")).distinct()
    return docs.withColumn("_key", row_key()).join(found, "_key", "left_anti").select(*docs.columns)


def _words_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM {source} WHERE text IS NOT NULL AND {key} IS NOT NULL"""


OP7_SQL = f"""
WITH dw AS ({_words_sql("documents", "doc_id")}),
bw AS (SELECT *, least(len(ws), 5) AS k FROM ({_words_sql("benchmark", "item_id")}) WHERE len(ws) > 0),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram FROM dw JOIN (SELECT DISTINCT k FROM bw) ON len(ws) >= k),
b AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS gram FROM bw),
s AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN b USING (gram) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, k AS n_shared, n AS n_shingles, round(k / n, 6) AS containment
FROM c JOIN s USING (item_id) WHERE k >= 0.8 * n - 1e-9
"""
