"""Mixing sources to target weights by Pareto order sampling.

Sources share a number of words by weight; a source's target stops at `most` times its size, and what is over is shared
again by weight until none is above. The targets' factor and the sums it follows from are two numbers; sources are never collected.

In a source each document expects e = min(most, c * its weight) copies, with c such that the words expected are the target.
floor(e) copies are certain. For the rest, of probability p, documents are ranked by Pareto's order: random odds divided by inclusion odds,
(u / (1 - u)) / (p / (1 - p)), u being a hash of the document. The sample has a fixed size: in that order documents are
taken whole until the target is reached, and the last one gives only the words that are missing. A source is dealt to ranges of
the order, so that one that holds much of the table is split.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm._common import discard, observed, prepare, scratch, table, text_bytes
from shelfspark.llm.running import running_sums

#: By code point of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word there is; copies of a document at most.
SHARE, MOST = Decimal("1.5"), 2


def word_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of bytes besides \\x20 and \\x09-\\x0D in each text."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    start = ~blank
    start[1:] &= blank[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    start[first] = ~blank[first]
    sums = np.concatenate([[0], np.cumsum(start)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """documents -> doc_id, source, size (words; null text: 0), u (a hash of id, source and text, in (0, 1)), weight."""
    h = F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("source"), F.col("text"))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    w = weight.cast("double") if weight is not None else F.lit(1.0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), u.alias("u"), w.alias("weight"), "text")

    def run(batches):
        for b in batches:
            sizes = pa.array(word_counts(*text_bytes(b.column(4))), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], sizes], ["doc_id", "source", "u", "weight", "size"])

    return rows.mapInArrow(run, "doc_id long, source string, u double, weight double, size long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Decimal = SHARE, most: int = MOST) -> DataFrame:
    """(source, size) rows, any number a source -> source, at (its place by code point, null last), source_size, target.

    With no words at all, targets are 0. The reshared factor only grows, so a source that once stops stays so.
    """
    grouped = scratch(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one")).withColumn("none", F.col("source").isNull()))
    placed = running_sums(grouped, [], ["none", "source"], {"at": "one"}).drop("_part", "one", "none")
    cases = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = scratch(placed.withColumn("w", F.element_at(cases, (F.col("at") % len(weights) + 1).cast("int"))))
    size, w = F.col("source_size").cast("decimal(38,0)"), F.col("w").cast("decimal(18,0)")
    words, whole = rows.agg(F.sum(size), F.sum(w)).first()
    left, among = share * (words or 0), whole or 1
    while True:
        # above its limit: left * w / among > most * size
        over = w * F.lit(left).cast("decimal(38,2)") > size * F.lit(most * among).cast("decimal(38,0)")
        stopped, free = rows.agg(F.sum(F.when(over, size)), F.sum(F.when(~over, w))).first()
        new_left, new_among = share * (words or 0) - most * (stopped or 0), free
        if not new_among or (new_left, new_among) == (left, among):
            break
        left, among = new_left, new_among
    target = F.when(over, F.col("source_size") * float(most)).otherwise(F.col("w") * F.lit(float(left)) / F.lit(float(among)))
    return rows.select("source", "at", "source_size", target.alias("target"))


def copy_factors(docs: DataFrame, most: int) -> DataFrame:
    """(at, target, size, weight) of documents -> at, c: e = min(most, c * weight) gives the target in expectation.

    Documents that stop at `most` leave their excess to the others of the source, until none is above.
    """
    w = F.col("weight") * F.col("size")
    c = scratch(docs.groupBy("at").agg((F.max("target") / F.sum(w)).alias("c")))
    before = -1
    while True:
        over = F.col("weight") * F.col("c") > most
        state = docs.join(c, "at").groupBy("at").agg(F.max("target").alias("target"), F.sum(F.when(~over, w)).alias("free"), F.sum(F.when(over, F.col("size") * most).otherwise(0)).alias("full"), F.count_if(over).alias("n"), F.max("c").alias("old"))
        old, c = c, scratch(state.select("at", F.coalesce((F.col("target") - F.col("full")) / F.nullif("free", F.lit(0.0)), F.col("old")).alias("c"), "n"), n=F.sum("n"))
        discard(old)
        if observed(c)["n"] in (before, 0, None):
            return c.select("at", "c")
        before = observed(c)["n"]


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Decimal = SHARE, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """documents -> doc_id, size, source_size, target, taken, copies (certain), sampled (words of the sampled copy); a row for each row.

    weight: a document's share beside others of its source (positive; a null counts as 1); without one all are alike. Null and empty sources are two
    sources. Rows that repeat are documents of their own and change places in a tie without changing the result; a null doc_id
    is an id. A document without words gives none. An empty table gives no rows. Columns besides doc_id, source and text are not read.
    """
    prepare(docs.sparkSession)
    rows = scratch(sized(docs, F.coalesce(weight, F.lit(1.0)) if weight is not None else None))
    targets = scratch(source_targets(rows, weights, share, most).withColumnRenamed("source", "source_"))
    rows = rows.join(targets, rows.source.eqNullSafe(targets.source_)).drop("source", "source_")
    if weight is None:
        e = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    else:
        rows = scratch(rows)
        factors = copy_factors(rows.where("size > 0"), most)
        rows, e = rows.join(factors, "at", "left"), F.coalesce(F.col("c") * F.col("weight"), F.lit(0.0))
    rows = rows.withColumn("e", F.least(e, F.lit(float(most)))).withColumn("copies", F.floor("e"))
    p, u = F.col("e") - F.col("copies"), F.col("u")
    # a document that no sampling is left for comes last, and gives nothing to the sum
    rows = scratch(rows.withColumn("order", F.when(p > 0, (u / (1 - u)) * ((1 - p) / p)).otherwise(F.lit(float("inf")))).withColumn("open", F.when(p > 0, F.col("size")).otherwise(F.lit(0).cast("long"))))
    certain = scratch(rows.groupBy("at").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("copies") * F.col("size"))).alias("missing")))
    ranked = running_sums(rows.select("at", "order", "doc_id", "size", "open", "copies", "source_size", "target"), ["at"], ["order", "doc_id", "size"], {"before": "open"})
    sampled = F.greatest(F.lit(0), F.least(F.col("missing") - F.col("before"), F.col("open")))
    out = ranked.join(certain, "at").withColumn("sampled", sampled)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("sampled")).alias("taken"), "copies", "sampled")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, size, source_size, target, taken, copies, sampled."""
    return mix_sources(table(spark, sf_dir, "documents"))
