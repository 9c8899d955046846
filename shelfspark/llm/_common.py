"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The paths written inside the innermost scratch_scope; outside of one, tables last until the session ends.
_scope: ContextVar[list[str] | None] = ContextVar("scratch_scope", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings the operators want: small Arrow batches (texts can be very long) and importable workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    workers = spark.sparkContext.environment
    paths = workers.get("PYTHONPATH", "").split(":")
    if root not in paths:
        workers["PYTHONPATH"] = ":".join([root, *[p for p in paths if p]])
    # workers last from task to task: what they free goes back to the system
    workers.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    workers.setdefault("MALLOC_ARENA_MAX", "2")
    workers.setdefault("MALLOC_TRIM_THRESHOLD_", "1000000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(df: DataFrame, **sums) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage, survives lost executors.

    sums: aggregates that are taken while df is written; see observed().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    seen = Observation() if sums else None
    (df.observe(seen, *[c.alias(k) for k, c in sums.items()]) if sums else df).write.parquet(path)
    _filesystem(spark, path)[0].deleteOnExit(_filesystem(spark, path)[1])
    if (tables := _scope.get()) is not None:
        tables.append(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    table_._scratch_path, table_._sums = path, seen.get if sums else {}
    return table_


def observed(table_: DataFrame) -> dict:
    """What scratch(df, name=aggregate) has seen, by name."""
    return table_._sums


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more (what was built on them has been written)."""
    for t in tables:
        fs, path = _filesystem(t.sparkSession, t._scratch_path)
        fs.delete(path, True)


@contextmanager
def scratch_scope():
    """Collects the paths of the scratch tables written inside, for delete_paths once their results have been written."""
    tables: list[str] = []
    token = _scope.set(tables)
    try:
        yield tables
    finally:
        _scope.reset(token)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        fs, path = _filesystem(spark, paths.pop())
        fs.delete(path, True)


def reads_any(df: DataFrame, paths: list[str]) -> bool:
    """Whether df's plan reads files under one of the paths. Looks at the roots of its relations only, not at their files."""
    leaves, roots = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            found = leaf.relation().location().rootPaths()
            roots += [found.apply(k).toUri().getPath() for k in range(found.size())]
    return any(r.rstrip("/") == (own := _filesystem(df.sparkSession, p)[1].toUri().getPath().rstrip("/")) or r.startswith(own + "/") for r in roots for p in paths)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.deleteOnExit(p)


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """Names a row by id and text, also where ids are null or repeated; rows that agree in both share it."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.hex(F.xxhash64(text_col)), F.coalesce(F.length(text_col), F.lit(-1)).cast("string"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column as one array, and n+1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The hash of each run of `width` words; of all words if they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h64 = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h64(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((h64(joined[a:b], seed) for a, b in zip(begins, ends, strict=True)), np.uint64, len(begins))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, edges (a long, b long) with a <> b -> (node, component = smallest node).

    Alternating large-star and small-star rounds; each node's minimum comes from a partial aggregate that is
    joined back, so that no neighbourhood is ever gathered in one task. Edges and minima are written to scratch: both sides of
    the joins on a hot node are then shuffles that Spark can split.
    """
    e = scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}
    before = None
    for _ in range(max_rounds):
        # every edge has a > b: upward edges are those turned round
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = scratch(e.withColumnsRenamed({"a": "up", "b": "a"}).join(low, "a").select(F.col("up").alias("a"), F.col("m").alias("b")).distinct())
        # every edge again has a > b; small star: link all lower neighbours of a node to the least of them
        least = scratch(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, scratch(small.union(least.select("a", F.col("m").alias("b"))).distinct(), **state)
        discard(old, low, large, least)
        if before == observed(e):
            break
        before = observed(e)
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
