"""Suffix-array dedup: repeated byte windows by a depth-limited most-significant-digit radix sort.

Every window of `depth` bytes is a suffix cut at the threshold; two are equal if they agree in every digit. The passes
go from large digits to small ones, and a suffix leaves the sort as soon as it is alone in its group or is known
to repeat, so that only few suffixes are ever written out:

1. The first digit of a window is the least of its 32-byte grams (by hash). Neighbouring windows share it: about one row
   for 85 windows. Grams that occur once in the corpus end the sort for all of their windows.
2. The second digit is all that the windows of one gram cover. If it occurs again, so does each of these windows.
3. What is left (windows near the ends of a repeat) is sorted by quarters of the window, in memory for groups of
   up to `group_cap` different contexts. Larger ones are told apart before they are dealt, and are a distributed aggregate
   over their windows instead.

Groups that reach full depth are exactly the repeated windows. Digits are compared by 64-bit hashes; windows that reach full
depth by 128 bits, the second 64 of them from a hash of its own over the whole window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import discard, observed, partitions, prepare, scratch, table, text_bytes

GRAM = 32
#: Contexts of one gram that are sorted in one task.
GROUP_CAP = 20_000
#: Bytes of contexts in an Arrow batch.
BATCH = 8 << 20
CHUNK = 1 << 20
DIGITS = 4
_powers: dict[tuple[int, str], np.ndarray] = {}
_U = np.uint64
#: Of each of the two hashes: its base and its values of bytes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64) for seed in (20, 21)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class _Hashes:
    """Hashes of any substrings of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, raw: np.ndarray, lane: int = 0):
        n, self.lane = len(raw) + 1, lane
        if len(_powers.get((lane, "up"), ())) < n:
            size = max(n, CHUNK + 4096)
            for name, base in (("up", _BASES[lane]), ("down", pow(_BASES[lane], -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[lane, name] = np.multiply.accumulate(steps)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(_BYTES[lane][raw] * _powers[lane, "up"][: n - 1], out=self.prefix[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[begin]) * _powers[self.lane, "down"][begin])


def anchors(raw: np.ndarray, offs: np.ndarray, depth: int, gram: int = GRAM):
    """Yields (doc, start, windows, at, gram hash, context hash) arrays: the windows start .. start + windows - 1 of
    a document have their least gram at the same place, `at` bytes after start. Of equal grams the first counts."""
    width = depth - gram + 1
    doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    for a in range(0, len(raw), CHUNK):
        seg = raw[a : min(a + CHUNK, len(raw)) + depth - 1]
        n = len(seg) - depth + 1
        if n <= 0:
            break
        hashes, grams = _Hashes(seg), len(seg) - gram + 1
        at = np.arange(grams)
        h = hashes.of(at, at + gram)
        key = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max, np.uint64)
        key[:grams] = (h & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        tiles = key.reshape(-1, width)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)
        doc = doc_of[a : a + n]
        good = np.flatnonzero(offs[doc + 1] - a - np.arange(n) >= depth)
        if not len(good):
            continue
        head = np.flatnonzero(np.concatenate([[True], (np.diff(least[good]) != 0) | (np.diff(good) != 1)]))
        first, last = good[head], good[np.concatenate([head[1:] - 1, [len(good) - 1]])]
        pos = least[first]
        context = _mix(hashes.of(first, last + depth) + (pos - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        yield doc[first], first + a - offs[doc[first]], last - first + 1, pos - first, h[pos], context


def repeated_windows(raw: np.ndarray, begin: np.ndarray, n: np.ndarray, at: np.ndarray, group: np.ndarray, weight: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """MSD passes over the windows of several contexts: (context, window) of those that occur twice or more.

    begin: a context's first byte in raw; n: its windows; at: the place of its gram; weight: times it occurs.
    """
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    win = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    key = _mix(group[row].view(np.uint64) + (at[row] - win).astype(np.uint64) * _U(0xA0761D6478BD642F))
    hashes, s = _Hashes(raw), begin[row] + win
    cuts = [depth * d // DIGITS for d in range(DIGITS + 1)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        key = _mix(key * _U(0xE7037ED1A0B428DB) + hashes.of(s + lo, s + hi))
        _, where = np.unique(key, return_inverse=True)
        stay = np.bincount(where, weights=weight[row])[where] > 1
        row, win, s, key = row[stay], win[stay], s[stay], key[stay]
    if len(row):
        # equal in the second hash too
        first, second = (np.unique(x, return_inverse=True)[1] for x in (key, _Hashes(raw, 1).of(s, s + depth)))
        _, where = np.unique(first * (second.max() + 1) + second, return_inverse=True)
        stay = np.bincount(where, weights=weight[row])[where] > 1
        row, win = row[stay], win[stay]
    return row, win


def _keyed(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """key: names a row. The id if it is a number that is never null nor repeated, else a hash of id and text
    (rows that agree in both repeat each other wholly, and have the same result). rest: a struct of all columns but
    the text goes along."""
    others = [F.struct(*[c for c in docs.columns if c != text_col]).alias("rest")] if rest else []
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *others)
    if rows.schema["id"].dataType.typeName() in ("long", "integer"):
        if rows.select("id").where("id is null").isEmpty() and rows.groupBy("id").count().where("count > 1").isEmpty():
            return rows.withColumn("key", F.col("id").cast("long"))
    return rows.withColumn("key", F.xxhash64("id", "text"))


def _packed(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with text compressed, for a shuffle."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw, offs = text_bytes(b.column(0))
            data = raw.tobytes()
            texts = [zip_.compress(data[x:y]) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.binary())], [*columns, "z"])

    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("z", T.BinaryType())])
    return rows.select("text", *columns).mapInArrow(run, schema)


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def repeated_spans(rows: DataFrame, depth: int = 200, group_cap: int = GROUP_CAP) -> DataFrame:
    """rows (key, text) -> key, start, n: windows start .. start + n - 1 of a text occur elsewhere as well."""

    def sample(batches):
        for b in batches:
            raw, offs = text_bytes(b.column(1))
            keys = b.column(0).to_numpy()
            for doc, start, n, at, h, c in anchors(raw, offs, depth):
                cols = [keys[doc], start, n.astype(np.int32), at.astype(np.int32), h.view(np.int64), c.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "start", "n", "at", "h", "c"])

    first = scratch(rows.select("key", "text").where(F.octet_length("text") >= depth).mapInArrow(sample, "key long, start long, n int, at int, h long, c long"))
    # pass 1: grams that occur again
    # written first, so that both sides of the join are shuffles that Spark can split at a hot gram
    again = scratch(first.groupBy("h").agg(F.count("*").alias("k"), (F.min("c") != F.max("c")).alias("mixed")).where("k > 1").select("h", "mixed"))
    second = scratch(first.join(again, "h"))
    discard(first, again)
    # pass 2: contexts that occur again; of each context one row goes on where its gram has several
    groups = second.groupBy("h", "c").agg(F.count("*").alias("k"), F.first("mixed").alias("mixed"), F.min(F.struct("key", "start", "n", "at")).alias("one"))
    groups = scratch(groups)
    whole = second.join(groups.where("k > 1").select("h", "c"), ["h", "c"], "left_semi").select("key", "start", F.col("n").cast("long").alias("n"))
    open_ = groups.where("mixed").select("h", F.least("k", F.lit(2)).cast("int").alias("k"), "one.*")
    # pass 3: the windows of these contexts. Grams with many contexts are named first: no task gets one of them whole
    many = scratch(open_.groupBy("h").agg(F.count("*").alias("contexts")).where(F.col("contexts") > group_cap).select("h"), n=F.count(F.lit(1)))
    some_large = observed(many)["n"] > 0
    small = open_.join(many, "h", "left_anti") if some_large else open_
    dealt = _context_texts(rows, small, depth).repartition(partitions(rows.sparkSession), "h").sortWithinPartitions("h")
    spans = whole.union(scratch(dealt.mapInArrow(_small_groups(depth), "key long, start long, n long")))
    if some_large:
        texts = _context_texts(rows, open_.join(many, "h", "left_semi"), depth)
        windows = scratch(texts.mapInArrow(_window_rows(depth), "w long, w2 long, k int, key long, start long"))
        twice = scratch(windows.groupBy("w", "w2").agg(F.sum("k").alias("s")).where("s > 1").select("w", "w2"))
        spans = spans.union(windows.where("k = 1").join(twice, ["w", "w2"], "left_semi").select("key", "start", F.lit(1).cast("long").alias("n")))
    return spans


def _context_texts(rows: DataFrame, open_: DataFrame, depth: int) -> DataFrame:
    """The bytes of each context in open_ (h, k, key, start, n, at)."""
    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("h", "k", "start", "n", "at")).alias("open"))
    held = _packed(rows.where(F.octet_length("text") >= depth), "key").join(wanted, "key")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def contexts(batches):
        out, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["h", "k", "key", "start", "n", "at", "text"])

        for b in batches:
            for key, z, some in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = _unpack(z.as_py())
                for x in some:
                    out.append((x["h"], x["k"], key, x["start"], x["n"], x["at"], text[x["start"] : x["start"] + x["n"] + depth - 1]))
                    size += x["n"] + depth
                    if size > BATCH:
                        yield batch()
                        out, size = [], 0
        if out:
            yield batch()

    return held.select("key", "z", "open").mapInArrow(contexts, "h long, k int, key long, start long, n int, at int, text binary")


def _columns(table_: pa.Table):
    raw, offs = text_bytes(table_.column("text").combine_chunks().view(pa.string()) if table_.num_rows else pa.array([], pa.string()))
    n, at = table_.column("n").to_numpy().astype(np.int64), table_.column("at").to_numpy().astype(np.int64)
    return raw, offs[:-1], n, at, table_.column("h").to_numpy(), table_.column("k").to_numpy()


def _small_groups(depth: int):
    """Sorts the contexts of each gram (rows come sorted by h); runs of windows come out."""

    def solved(rows: pa.Table):
        raw, begin, n, at, h, k = _columns(rows)
        row, win = repeated_windows(raw, begin, n, at, h, k, depth)
        own = k[row] == 1
        row, win = row[own], win[own]
        order = np.lexsort((win, row))
        row, win = row[order], win[order]
        head = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(win) != 1)])) if len(row) else np.zeros(0, int)
        size = np.diff(np.concatenate([head, [len(row)]]))
        r, w = row[head], win[head]
        return pa.RecordBatch.from_arrays([pa.array(rows.column("key").to_numpy()[r]), pa.array(rows.column("start").to_numpy()[r] + w), pa.array(size.astype(np.int64))], ["key", "start", "n"])

    def run(batches):
        held, held_rows = [], 0
        for b in batches:
            held.append(b)
            held_rows += b.num_rows
            if held_rows < 4000:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1], "left"))  # the last group may go on
            if cut:
                yield solved(rows.slice(0, cut).combine_chunks())
            rest = rows.slice(cut).combine_chunks()
            held, held_rows = rest.to_batches(), rest.num_rows
        if held_rows:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    return run


def _window_rows(depth: int):
    def run(batches):
        for b in batches:
            raw, begin, n, at, h, k = _columns(pa.Table.from_batches([b]))
            row = np.repeat(np.arange(len(n)), n)
            win = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = begin[row] + win
            w = _mix(_mix(h[row].view(np.uint64) + (at[row] - win).astype(np.uint64) * _U(0xA0761D6478BD642F)) + _Hashes(raw).of(s, s + depth))
            cols = [pa.array(w.view(np.int64)), pa.array(_Hashes(raw, 1).of(s, s + depth).view(np.int64)), pa.array(k[row]), pa.array(b.column(2).to_numpy()[row]), pa.array(b.column(3).to_numpy()[row] + win)]
            yield pa.RecordBatch.from_arrays(cols, ["w", "w2", "k", "key", "start"])

    return run


def drop_repeats(docs: DataFrame, depth: int = 200, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, group_cap: int = GROUP_CAP) -> DataFrame:
    """docs -> id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary): one row per row.

    Each byte goes that lies in a string of `depth` bytes which also starts anywhere else, same text included. A null
    text is empty; a text shorter than depth stays whole; repeated rows remove each other wholly if long enough. kept
    is binary, as a removed run may begin or end inside a character.
    """
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, depth, group_cap).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    joined = _packed(rows, "id", "key").join(spans, "key", "left").select("id", "z", "spans")
    ident = T.StructField(id_col, docs.schema[id_col].dataType)
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]
    fields = [ident, *[T.StructField(c, T.LongType()) for c in names[1:4]], T.StructField("kept_sha256", T.StringType())]

    def run(batches):
        for b in batches:
            out = []
            for z, some in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = _unpack(z)
                runs: list[list[int]] = []
                for lo, hi in sorted((x["start"], x["start"] + x["n"] + depth - 1) for x in some or ()):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                edges = [0, *[e for r in runs for e in r], len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            arrays = [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[4], pa.binary())] if with_kept else [])], names)

    return joined.mapInArrow(run, T.StructType([*fields, *([T.StructField("kept", T.BinaryType())] if with_kept else [])]))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    prepare(spark)
    return drop_repeats(table(spark, sf_dir, "documents"))
