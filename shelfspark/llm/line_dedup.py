"""Line dedup by winnowing over line hashes.

The lines of a text that are not blank (compared without blanks around them) are hashed. In each window of `run`
lines the least hash is a fingerprint: a run of that many lines that occurs twice has the same fingerprint at the
same place in both. Runs of fewer lines that reach `words` words or, for one line, `long_line` characters are windows too, and
the least hash of each is its fingerprint: so a passage of that many words is found however it is broken into lines.
Fingerprints that occur once end the search. The others' places are joined, and matches are extended both ways: the up to
2 * run - 1 lines around a fingerprint hold every window that it stands for, each is compared whole, and adjoining
windows add up to the longest match. Of equal windows the first in the order of (id, line) stays and the lines of all
later ones are deleted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import prepare, scratch, table
from shelfspark.llm.suffix_dedup import _keyed, _packed, _unpack

BLANKS = " \t\r\x0b\x0c"
_U = np.uint64


def _lines(text: str) -> tuple[list[str], list[int], list[str]]:
    """All lines, the places of those not blank, and these without blanks around them."""
    lines = text.split("\n")
    bare = [x.strip(BLANKS) for x in lines]
    at = [i for i, x in enumerate(bare) if x]
    return lines, at, [bare[i] for i in at]


def fingerprints(hashes: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """(place, first window, windows) of each window minimum; of equal hashes the first counts."""
    n = len(hashes) - run + 1
    if n <= 0:
        return []
    low = np.lib.stride_tricks.sliding_window_view(hashes, run).argmin(1) + np.arange(n)
    head = np.flatnonzero(np.concatenate([[True], np.diff(low) != 0]))
    return list(zip(low[head].tolist(), head.tolist(), np.diff([*head, n]).tolist(), strict=True))


def short_windows(words: list[int], run: int, least: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest windows of under `run` lines from each line on that reach `least` words."""
    out = []
    for p in range(len(words)):
        n = 0
        for q in range(p, min(p + run - 1, len(words))):
            n += words[q]
            if n >= least:
                out.append((p, q - p + 1))
                break
    return out


def repeated_lines(rows: DataFrame, run: int, long_line: int, words: int) -> DataFrame:
    """rows (id, key, text) -> key, start, n: lines (counting those not blank) that repeat an earlier window."""

    def winnow(batches):
        for b in batches:
            out = []
            for i, (key, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                _, _, bare = _lines(text)
                h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in bare], np.uint64)
                signed = h.view(np.int64).tolist()
                out += [(i, key, signed[p], s, run, signed[s : s + n + run - 1]) for p, s, n in fingerprints(h, run)]
                some = short_windows([len(x.encode("utf-8", "surrogatepass").split()) for x in bare], run, words)
                have = set(some)
                some += [(p, 1) for p, x in enumerate(bare) if len(x) >= long_line and (p, 1) not in have]
                out += [(i, key, int(h[p : p + n].min().view(np.int64)), p, n, signed[p : p + n]) for p, n in some]
            at, *cols = zip(*out, strict=True) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "key", "fp", "start", "size", "around"])

    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("key long, fp long, start int, size int, around array<long>").fields])
    marks = scratch(rows.select("id", "key", "text").mapInArrow(winnow, schema))
    # small sides are written first: both sides of each join are then shuffles that Spark can split at a hot key
    again = scratch(marks.groupBy("fp", "size").agg(F.count("*").alias("k")).where("k > 1").select("fp", "size"))
    joined = marks.join(again, ["fp", "size"], "left_semi")
    shift = F.explode(F.sequence(F.lit(0), F.size("around") - F.col("size"))).alias("o")
    windows = joined.select("id", "key", "start", "size", "around", shift).select("id", "key", (F.col("start") + F.col("o")).alias("start"), "size", F.xxhash64(F.slice("around", F.col("o") + 1, F.col("size"))).alias("w"), F.element_at("around", F.col("o") + 1).alias("l"))
    windows = scratch(windows)
    place = F.struct("id", "key", "start")
    first = scratch(windows.groupBy("w", "l", "size").agg(F.min(place).alias("first"), F.count("*").alias("k")).where("k > 1").drop("k"))
    return windows.join(first, ["w", "l", "size"]).where(place > F.col("first")).select("key", "start", F.col("size").alias("n"))


def drop_repeated_lines(docs: DataFrame, run: int = 3, long_line: int = 200, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> docs with n_lines, n_removed and, in text_col, what is left: one row per row.

    Null texts stay null, blank lines stay. Rows that agree in id and text count as one document, so that neither
    repeats the other. Null ids come first in the order. Columns n_lines and n_removed are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    rows = _keyed(docs.where(F.col(text_col).isNotNull()), id_col, text_col, rest=True)
    gone = repeated_lines(rows, run, long_line, words).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    held = _packed(rows, "rest", "key").join(gone, "key", "left").select("rest", "z", "gone")

    def delete(batches):
        for b in batches:
            out = []
            for z, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, at, _ = _lines(_unpack(z).decode("utf-8", "surrogatepass"))
                drop = {at[p] for x in gone or () for p in range(x["start"], x["start"] + x["n"])}
                out.append((len(lines), len(drop), "\n".join([x for i, x in enumerate(lines) if i not in drop])))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["rest", "n_lines", "n_removed", "text"])

    kept = held.mapInArrow(delete, T.StructType([rows.schema["rest"], *T.StructType.fromDDL("n_lines long, n_removed long, text string").fields]))
    whole = kept.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns], "n_lines", "n_removed")
    nothing = F.lit(0).cast("long")
    return whole.union(docs.where(F.col(text_col).isNull()).select(*docs.columns, nothing.alias("n_lines"), nothing.alias("n_removed")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    prepare(spark)
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated lines from the texts; a document of which nothing is left goes. n_chars follows the text."""
    prepare(spark)
    kept = drop_repeated_lines(docs).where(f"n_removed = 0 or trim(BOTH '{BLANKS}\n' FROM text) <> ''")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


OP5_SQL = """
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
nb AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
c AS (SELECT *, len(string_split_regex(s, '[ \t\n\r\x0B\x0C]+')) AS n FROM nb),
w AS (SELECT doc_id, p, 3 AS size, s || chr(10) || lead(s, 1) OVER o || chr(10) || lead(s, 2) OVER o AS k FROM nb WINDOW o AS (PARTITION BY doc_id ORDER BY p)
  UNION ALL SELECT doc_id, p, 1, s FROM c WHERE length(s) >= 200 OR n >= 50
  UNION ALL SELECT doc_id, p, 2, s || chr(10) || s2 FROM (SELECT *, lead(s) OVER o AS s2, n + lead(n) OVER o AS n2 FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)) WHERE n < 50 AND n2 >= 50),
r AS (SELECT doc_id, p, size, row_number() OVER (PARTITION BY size, k ORDER BY doc_id, p) AS nth FROM w WHERE k IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE nth > 1 AND o < size),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l WHERE NOT EXISTS (SELECT 1 FROM nb JOIN gone USING (doc_id, p) WHERE nb.doc_id = l.doc_id AND nb.i = l.i) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id) END AS n_lines,
  (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
