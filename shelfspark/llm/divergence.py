"""Audit of sources by their term distributions: the distance of each pair of sources of a language, and each source's top terms.

Terms are counted in the task that reads the texts and summed by (lang, source, term). A language keeps the terms that
enough of its documents have. All figures are integers: p = 1 + floor(SCALE * (count + 5) / (N + 5 V)).

Top terms come from dominance skybands. A term's value p - q grows with its count in the group and falls with its count in
the language, and ties go to the earlier term; so a term that k others dominate in (higher group count, lower language count,
earlier UTF-8) is not among the first k. Each partition keeps the terms that fewer than k of its own dominate, the kept terms are dealt
to a few partitions a group and go through the same sieve, and what is left is ranked exactly.

Distances between pairs are sums over blocks of (terms x sources): a task fills a dense block and adds up |p - q| for all of its pairs
of sources. A term that no source of a block has adds the distance of the two least values, which is counted, not written.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import partitions, prepare, scratch, table, text_bytes
from shelfspark.llm.running import running_sums

LEAST_DOCS, TOP, SCALE, PRIOR = 30, 50, 1_000_000_000, 5
#: Bytes that belong to terms, in lower case; all others become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Text is cut at a blank after so many bytes, and counts are given out when they take about so many.
SLICE, FLUSH = 1 << 20, 64 << 20
#: Sources in one block; least rows that a table of two blocks has on average; partitions that a group's skybands are merged in.
BLOCK, BLOCK_ROWS, MERGE = 256, 10_000, 8


def term_slices(text: bytes):
    """Lists of the terms of a text whose other bytes are blanks, slice by slice."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE) if len(text) - at > SLICE else len(text)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """documents -> lang, source, term, n (occurrences), docs; a row with an empty term for each (lang, source). Null text, lang and source are ''."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches):
        sums, size = {}, 0

        def given():
            for (lang, source), (counts, seen) in sums.items():
                terms = pa.array([b"", *counts], pa.binary()).cast(pa.string())
                same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), np.int64))) for x in (lang, source)]
                numbers = [pa.array(x, pa.int64()) for x in ([0, *counts.values()], [0, *map(seen.__getitem__, counts)])]
                yield pa.RecordBatch.from_arrays([*same, terms, *numbers], ["lang", "source", "term", "n", "docs"])

        for b in batches:
            raw, offs = text_bytes(b.column(2))
            data, offs = raw.tobytes().translate(TERM_BYTES), offs.tolist()
            for lang, source, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), offs, offs[1:], strict=False):
                if (group := sums.get((lang, source))) is None:
                    group = sums[lang, source] = Counter(), Counter()
                    size += 1000
                counts, seen = group
                before, own = len(counts), set()
                for terms in term_slices(data[x:y]):
                    counts.update(terms)
                    own.update(terms)
                seen.update(own)
                size += (len(counts) - before) * 200
                if max(map(len, own), default=0) > 100:
                    size += sum(len(t) for t in own if len(t) > 100)
                if size > FLUSH:
                    yield from given()
                    sums, size = {}, 0
        yield from given()

    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count, total, kept):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), by whole numbers in decimals."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + F.lit(PRIOR).cast("decimal(1,0)"))
    return F.lit(1).cast("long") + F.call_function("div", above, (total + PRIOR * kept).cast("decimal(38,0)"))


def skyband(g: np.ndarray, lang: np.ndarray, k: int) -> np.ndarray:
    """Which of the terms, given in UTF-8 order with their counts, fewer than k others dominate; as places.

    In the order of falling group count, rising language count and rising place, all that dominate a term come before it, and if k
    do, then k of those kept do.
    """
    order = np.lexsort((np.arange(len(g)), lang, -g))
    kept_lang, kept_at, n = np.empty(len(g), np.int64), np.empty(len(g), np.int64), 0
    for i in order.tolist():
        if n < k or np.count_nonzero((kept_lang[:n] <= lang[i]) & (kept_at[:n] < i)) < k:
            kept_lang[n], kept_at[n], n = lang[i], i, n + 1
    return np.sort(kept_at[:n])


def sieve(rows: DataFrame, k: int) -> DataFrame:
    """(lang, source, term, n, lang_n, ...) sorted by (lang, source, term) within partitions -> the skyband of each group in each partition."""

    def run(batches):
        held, size = [], 0

        def kept(t):
            if t.num_rows <= k:
                return t
            places = skyband(t["n"].to_numpy(), t["lang_n"].to_numpy(), k)
            return t.take(pa.array(places))

        group = None
        for b in batches:
            if not b.num_rows:
                continue
            lang, source = b.column(0).to_pylist(), b.column(1).to_pylist()
            starts = [0, *[i for i in range(1, len(lang)) if lang[i] != lang[i - 1] or source[i] != source[i - 1]], len(lang)]
            for x, y in zip(starts, starts[1:], strict=False):
                if (lang[x], source[x]) != group:
                    if held:
                        yield from kept(pa.Table.from_batches(held)).to_batches()
                    group, held, size = (lang[x], source[x]), [], 0
                held.append(b.slice(x, y - x))
                size += y - x
                if size > 20_000:  # a part of the group that is sieved stays sorted by term
                    held = kept(pa.Table.from_batches(held)).combine_chunks().to_batches()
                    size = 0
        if held:
            yield from kept(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def top_terms(cells: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, term, n, lang_n, p, q) -> lang, source, item, value, rank of the first `top` terms with p > q."""
    key = ["lang", "source", "term"]
    first = sieve(cells.where("n > 0").sortWithinPartitions(*key), top)
    merged = sieve(first.repartition(partitions(cells.sparkSession), "lang", "source", F.pmod(F.xxhash64("term"), F.lit(MERGE))).sortWithinPartitions(*key), top)
    value = F.col("p") - F.col("q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return merged.where("p > q").select("lang", "source", F.col("term").alias("item"), value.alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def pair_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, at, term, p) of counts over zero, (lang, at, p0, kept) of all sources -> lang, a, b (a < b), value: sum of |p_a - p_b| over kept terms.

    at numbers a language's sources. Rows of a block of sources go to each pair of blocks, dealt by terms into tables of
    at most so many rows (on average) that their sums, a row for each pair, are fewer than their rows.
    """
    spark = cells.sparkSession
    cells, groups = (x.withColumn("block", F.floor(F.col("at") / BLOCK).cast("int")) for x in (cells, groups))
    sizes = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.least(F.count("*"), F.lit(2 * BLOCK)).alias("members"))
    filled = cells.groupBy("lang").agg(F.count("*").alias("cells"))
    rows_each = F.greatest(F.lit(BLOCK_ROWS), 8 * F.col("members") * F.col("members"))
    plan = scratch(sizes.join(filled, "lang", "left").select("lang", "blocks", F.ceil(F.coalesce("cells", F.lit(1)) / rows_each).cast("long").alias("parts")))
    partners = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))).alias("t")
    rows = cells.join(plan, "lang").select("lang", "at", "term", "p", F.pmod(F.xxhash64("term"), "parts").alias("part"), partners).select("lang", "t.i", "t.j", "part", "at", "term", "p")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    sources = groups.join(plan, "lang").select("lang", "at", "p0", "kept", "parts", partners).select("lang", "t.i", "t.j", parts, "at", "p0")
    out = "lang string, a long, b long, value long, seen long"
    names = ["lang", "a", "b", "value", "seen"]

    def block(found: pa.Table, members: pa.Table) -> pa.Table:
        at, p0 = members["at"].to_numpy(), members["p0"].to_numpy()
        order = np.argsort(at)
        at, p0 = at[order], p0[order]
        i, j = members["i"][0].as_py(), members["j"][0].as_py()
        terms = pa.concat_arrays(found["term"].chunks or [pa.array([], pa.string())]).dictionary_encode()
        row, col = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(at, found["at"].to_numpy())
        seen = len(terms.dictionary)
        sums = np.zeros((len(at), len(at)), np.int64)
        by_row = np.argsort(row, kind="stable")
        row, col, p = row[by_row], col[by_row], found["p"].to_numpy()[by_row]
        step = max(1, 1_000_000 // max(1, len(at)))
        for low in range(0, seen, step):
            x, y = np.searchsorted(row, [low, low + step])
            dense = np.repeat(p0[None, :], min(step, seen - low), 0)
            dense[row[x:y] - low, col[x:y]] = p[x:y]
            for s in range(len(at)):
                sums[s] += np.abs(dense - dense[:, s : s + 1]).sum(0)
        a, b = np.meshgrid(np.arange(len(at)), np.arange(len(at)), indexing="ij")
        use = (a < b) & (at[a] // BLOCK == i) & (at[b] // BLOCK == j)
        n = int(use.sum())
        return pa.table([pa.array([members["lang"][0].as_py()] * n, pa.string()), pa.array(at[a[use]]), pa.array(at[b[use]]), pa.array(sums[use]), pa.array(np.full(n, seen))], names)

    key = ["lang", "i", "j", "part"]
    sums = sources.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(lambda members, found: block(found, members), out)
    summed = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    info = groups.select("lang", "at", "p0", "kept")
    both = summed.join(info.withColumnsRenamed({"at": "a", "p0": "pa"}), ["lang", "a"]).join(info.drop("kept").withColumnsRenamed({"at": "b", "p0": "pb"}), ["lang", "b"])
    return both.select("lang", "a", "b", (F.col("value") + F.abs(F.col("pa") - F.col("pb")) * (F.col("kept") - F.col("seen"))).alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """documents -> lang, source, part ('pair' or 'term'), item, value, rank; see the module.

    Null text, lang and source are ''. Rows that repeat are documents of their own. A language with one source has no pairs; one that keeps
    no term has distances 0. An empty table gives no rows. Columns besides text, lang and source are not read.
    """
    prepare(docs.sparkSession)
    counts = scratch(term_counts(docs))
    terms = scratch(counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("in_docs")).where(F.col("in_docs") >= least_docs).drop("in_docs"))
    zero = F.lit(0).cast("long")
    langs = scratch(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
    cells = scratch(counts.where("term <> ''").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "lang_total")], F.lit(1).cast("long").alias("one"))
    groups = scratch(running_sums(groups, ["lang"], ["source"], {"at": "one"}).drop("_part", "one"))
    some = F.greatest("kept", F.lit(1))  # p0 of a language without terms is not used
    groups = scratch(groups.withColumn("p0", smoothed(F.lit(0), F.col("total"), some)))
    full = cells.join(groups, ["lang", "source"]).withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", smoothed(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    full = scratch(full.select("lang", "source", "term", "n", "lang_n", "p", "q", "at"))
    distances = scratch(pair_distances(full.select("lang", "at", "term", "p"), groups.select("lang", "at", "p0", "kept")))
    ways = distances.select("lang", "a", "b", "value").union(distances.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "at", "source")
    pairs = ways.join(names.withColumnRenamed("at", "a"), ["lang", "a"]).join(names.withColumnsRenamed({"at": "b", "source": "item"}), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    named = top_terms(full.drop("at"), top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(named)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> lang, source, part, item, value, rank: each source's distances and the terms that mark it."""
    return source_divergence(table(spark, sf_dir, "documents"))


#: documents in DuckDB
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
l AS (SELECT lang, count(*) AS v, sum(ln) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v)::HUGEINT)::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (k.ln + 5)) // (l.n + 5 * l.v)::HUGEINT)::BIGINT AS q
      FROM g JOIN kept k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
