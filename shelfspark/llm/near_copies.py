"""Near copies by word shingles: SimHash links first, then an exact self-join at Jaccard 4/5 with prefix filtering.

SimHash's trie join links the closest copies; its links are verified on the shingles, and most families of copies are one
component from then on. 64 bits cannot find every pair at 0.8, so a prefix join finds the rest: all shingles have one
order, and of a set of n shingles the first floor(n / 5) + 1 are its prefix. Two sets whose similarity is 0.8 or more share
a shingle of their prefixes, whatever the order is; shingles that a sample shows to be frequent come last, which only
decides the cost. Equal sets are one from the start. Sets that share a prefix shingle are linked in two rounds:
first each with the least of the group, then pairs whose components still differ, within neighbouring classes of size. A family
of copies makes no pairs in the second round.

Pairs are cut by an exact bound before texts are compared: a parity signature has one bit for each residue of a shingle's
hash, flipped by each shingle, so two sets differ in at least as many shingles as their signatures do in bits.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import connected_components, discard, observed, partitions, prepare, row_key, scratch, shingle_hashes, text_bytes
from shelfspark.llm.simhash import links as simhash_links
from shelfspark.llm.simhash import majority

#: One row in SAMPLE_RATE says how frequent shingles are; HOT_ROWS of its rows make a shingle frequent.
SAMPLE_RATE = 16
HOT_ROWS = 3
#: Most frequent shingles that workers keep (16 bytes each); rarer ones are ordered by hash.
HOT_MOST = 400_000
#: Words of 64 bits in a parity signature.
SIGNATURE = 32
#: Partners of one text that are compared in one task.
TOGETHER = 256
#: Most rows of the wanted texts' keys that are broadcast (about 16 bytes each).
BROADCAST_ROWS = 1_000_000


def _sets(docs: DataFrame, name: str, text_col: str, width: int, make, fields: str) -> DataFrame:
    """name and what make(hashes of the text's shingles) gives, one row per row."""
    schema = T.StructType([docs.schema[name], *T.StructType.fromDDL(fields).fields])

    def run(batches):
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            data = raw.tobytes()
            made = [make(shingle_hashes(data[x:y], width)) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            cols = list(zip(*made, strict=True)) or [()] * (len(schema) - 1)
            kinds = [pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else pa.int64() for f in schema.fields[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], schema.names)

    return docs.select(name, text_col).mapInArrow(run, schema)


def _hot(docs: DataFrame, id_col: str, text_col: str, width: int) -> np.ndarray:
    """Shingles of at least HOT_ROWS rows of the sample, the least frequent first."""
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE_RATE)) == 0)
    seen = _sets(sample, id_col, text_col, width, lambda h: (np.unique(h).view(np.int64),), "h array<long>").select(F.explode("h").alias("h"))
    often = seen.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= HOT_ROWS).orderBy(F.desc("k"), "h").limit(HOT_MOST)
    return often.toArrow().column("h").to_numpy()[::-1].view(np.uint64)


def signature(h: np.ndarray) -> np.ndarray:
    """Parity of the number of distinct hashes in each residue class, SIGNATURE words."""
    bits = 64 * SIGNATURE
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text_col: str, width: int) -> DataFrame:
    """Of pairs (a, b) of keys, those of similarity 0.8 or more. sets: key, n, bits, x (the hash of one text of the set).

    The texts of all b, compressed, go to their a in one shuffle, at most about TOGETHER of them to a task; a's own text comes
    first there.
    """
    spark = docs.sparkSession
    pairs = scratch(pairs.distinct())
    side = {c: sets.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"}
    differ = sum((F.bit_count(F.get("bits_a", i).bitwiseXOR(F.get("bits_b", i))) for i in range(1, SIGNATURE)), F.bit_count(F.get("bits_a", 0).bitwiseXOR(F.get("bits_b", 0))))
    near = pairs.join(side["a"], "a").join(side["b"], "b").where(9 * differ <= F.col("n_a") + F.col("n_b")).select("a", "b")
    near = scratch(near)
    many = near.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > TOGETHER)
    part = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("k", F.lit(1)) / TOGETHER))
    dealt = scratch(near.join(many, "a", "left").select("a", part.alias("part"), "b"))
    sent = dealt.select("a", "part", F.col("b").alias("key")).union(dealt.select("a", "part", F.col("a").alias("key")).distinct())
    sent = scratch(sent.join(sets.select("key", "x"), "key").select("x", "a", "part", "key"), n=F.count(F.lit(1)))
    discard(pairs, near)
    if not observed(sent)["n"]:
        return sent.select("a", F.col("key").alias("b"))
    held = F.broadcast(sent) if observed(sent)["n"] <= BROADCAST_ROWS else sent

    def pack(batches):
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(data[x:y], 1) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())], ["x", "z"])

    read = docs.select(F.xxhash64(text_col).alias("x"), text_col).join(F.broadcast(sent.select("x").distinct()) if held is not sent else sent.select("x").distinct(), "x", "left_semi")
    packed = read.mapInArrow(pack, "x long, z binary").join(held, "x").select("a", "part", (F.col("a") != F.col("key")).alias("other"), "key", "z")

    def compare(batches):
        last, own = (None, None, None), None
        for b in batches:
            found = []
            for a, part, key, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True):
                if (a, part, key) == last:  # rows of equal texts
                    continue
                last = a, part, key
                h = np.unique(shingle_hashes(zlib.decompress(z.as_py()), width))
                if a == key:
                    own = h
                elif 9 * len(np.intersect1d(own, h, assume_unique=True)) >= 4 * (len(own) + len(h)):
                    found.append((a, key))
            cols = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    dealt = packed.repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "other", "key")
    return scratch(dealt.mapInArrow(compare, "a long, b long"))


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of keys that SimHash links: sets of one fingerprint with the least of them, and these along the trie's links."""
    least = scratch(sets.groupBy("fp").agg(F.min("key").alias("first")))
    same = sets.select("fp", "key").join(least, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    trie = simhash_links(least.select("fp"))
    ends = {c: least.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "ab"}
    across = trie.join(ends["a"], "a").join(ends["b"], "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return same.union(across)


def _forest(parts: DataFrame) -> DataFrame:
    """Links with the components of parts (node, component)."""
    return parts.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """docs -> id, component_id: the smallest id that links of Jaccard similarity 0.8 or more reach, one row per row.

    Texts that are null or have no words are copies of each other. A null id keeps its row, but is not the smallest of a component.
    """
    hot = _hot(docs, id_col, text_col, width)
    order = np.argsort(hot)
    held = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def describe(every):
        known, rank = held.value
        fp = int(np.uint64(majority(every)).view(np.int64))
        h = np.unique(every)
        key = xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)
        bits = signature(h)
        if len(known) and len(h):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            h = h[np.argsort(np.where(known[at] == h, rank[at] + 1, 0), kind="stable")]
        return key, len(h), fp, bits, h[: len(h) // 5 + 1].view(np.int64)

    named = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x")).alias("row"), F.col(text_col).alias("text"))
    rows = scratch(_sets(named, "row", "text", width, describe, "key long, n long, fp long, bits array<long>, prefix array<long>").select("row.id", "row.x", "key", "n", "fp", "bits", "prefix"))
    sets = scratch(rows.groupBy("key").agg(F.min(F.struct("x", "n", "fp")).alias("s"), F.first("bits").alias("bits")).select("key", "s.*", "bits"))
    marks = rows.select("key", "n", F.posexplode("prefix").alias("at", "h"))
    again = scratch(marks.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h"))
    shared = scratch(marks.join(again, "h").distinct())

    def labelled(parts):
        return scratch(shared.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component"))

    def pairs(left, right, on="h", only=F.lit(True)):
        # the places allow a similarity of 0.8 where h is the first shingle that both share
        most = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at"))
        near = left.alias("l").join(right.alias("r"), on).where((F.col("l.label") != F.col("r.label")) & (F.col("l.key") != F.col("r.key")) & (9 * most >= 4 * (F.col("l.n") + F.col("r.n"))) & only)
        return near.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b"))

    links = _verified(_simhash_pairs(sets), docs, sets, text_col, width)
    parts = scratch(connected_components(links))
    first_round = labelled(parts)
    least = scratch(first_round.groupBy("h").agg(F.min(F.struct("label", "key", "n", "at")).alias("m"))).select("h", "m.key", "m.n", "m.at", "m.label")
    more = _verified(pairs(first_round, least), docs, sets, text_col, width)
    parts = scratch(connected_components(_forest(parts).union(more)))
    second_round = labelled(parts)
    mixed = scratch(second_round.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h"))
    # sizes of similar sets are within a factor of 5/4, so a set meets those of its own class of size and of the next one
    left = scratch(second_round.join(mixed, "h").withColumn("class", F.floor(F.log("n") / math.log(1.25) + 1e-9)))
    above = left.select("h", "key", "n", "at", "label", F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class"), F.col("class").alias("own"))
    once = (F.col("l.class") != F.col("r.own")) | (F.col("l.key") < F.col("r.key"))
    more = _verified(pairs(left, above, ["h", "class"], once), docs, sets, text_col, width)
    parts = connected_components(_forest(parts).union(more)) if not more.isEmpty() else parts

    first = rows.groupBy("key").agg(F.min("id").alias("first"))
    label = scratch(first.join(parts, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("component", "key").alias("label")))
    component = scratch(label.groupBy("label").agg(F.min("first").alias("component_id")))
    classes = scratch(label.join(component, "label").select("key", "component_id"))
    return rows.join(classes, "key").select(F.col("id").alias(id_col), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies (five-word shingles, Jaccard similarity 0.8 or more): the one
    with the smallest id, null ids last, then by the text's hash. Of rows that agree in id and text one stays."""
    prepare(spark)
    key = row_key()
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", key.alias("key")).alias("name"), "text")
    found = scratch(near_copies(named, "name"))
    gone = scratch(found.where("name <> component_id").select(F.col("name.key").alias("_key")).distinct())
    kept = docs.withColumn("_key", key).join(gone, "_key", "left_anti")
    twice = scratch(found.where("name = component_id").groupBy(F.col("name.key").alias("_key")).count().where("count > 1").select("_key"))
    if not twice.isEmpty():
        kept = kept.join(twice, "_key", "left_anti").unionByName(kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"]))
    return kept.select(*docs.columns)
