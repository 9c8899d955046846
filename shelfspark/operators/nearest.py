"""Nearest rows by cosine, in blocks, by cells around sampled centres or over all cells.

Each block (a label, a bucket of sizes) is cut into cells: rows go to the nearest of a few centres, picked far from each other
in a bounded sample of the block. A query goes to the cells of its nearest centres (multi-probe), or to all of them: that is
the exact mode. Cells are dealt in parts of bounded size, and so are the queries of a cell, so a hot block is many
tasks; a task scores its part by one matrix product and gives out its best rows. `probes_for` measures how many cells a
query must visit on a sample of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Centres of a block, rows of the sample they are picked from, and bytes of all samples on the driver: where they do not do for all
#: blocks, the largest ones have centres and each other block is one cell.
CENTRES, SAMPLE, SAMPLE_BYTES = 32, 128, 64 << 20
#: Rows and queries of one part.
PART = 4096


def _matrix(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(rows)
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def centres(vectors: DataFrame, block: str) -> dict:
    """block -> matrix of centres, picked from a sample of each of the largest blocks, drawn by hash."""
    one = vectors.select(F.size("v").alias("n")).first()
    if one is None:
        return {}
    order = Window.partitionBy(block).orderBy(F.xxhash64("id"), "id")
    rows = vectors.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE).select(block, "id", "v")
    most = max(1, SAMPLE_BYTES // (SAMPLE * 8 * max(1, one.n)))
    sizes = vectors.groupBy(block).count().orderBy(F.desc("count"), block).limit(most).select(block)
    got, out = rows.join(F.broadcast(sizes), block).toArrow(), {}
    names, ids, every = np.array(got.column(block).to_pylist(), object), got.column("id").to_numpy(), _matrix(got.column("v"))
    for b in dict.fromkeys(names.tolist()):
        at = np.flatnonzero(names == b)
        m = every[at[np.argsort(ids[at], kind="stable")]]
        chosen, far = [0], 1 - m @ m[0]
        while len(chosen) < min(CENTRES, len(m)) and far.max() > 1e-9:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, 1 - m @ m[chosen[-1]])
        out[b] = m[chosen]
    return out


def in_cells(df: DataFrame, block: str, held, probes: int | None) -> DataFrame:
    """df with cell and probe (0: the nearest centre): one row for each of the `probes` nearest cells, all cells if None."""
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("probe", T.IntegerType())])
    at_v, at_b = df.columns.index("v"), df.columns.index(block)

    def run(batches):
        known = held.value
        for b in batches:
            if not b.num_rows:
                continue
            names, rows, cells, ranks = np.array(b.column(at_b).to_pylist(), object), [], [], []
            v = _matrix(b.column(at_v))
            for name in set(names.tolist()):
                at = np.flatnonzero(names == name)
                if name not in known:
                    rows, cells, ranks = [*rows, at], [*cells, np.zeros(len(at), int)], [*ranks, np.zeros(len(at), int)]
                    continue
                order = np.argsort(-np.round(v[at] @ known[name].T, 9), axis=1, kind="stable")[:, :probes]
                rows.append(np.repeat(at, order.shape[1]))
                cells.append(order.ravel())
                ranks.append(np.tile(np.arange(order.shape[1]), len(at)))
            some = b.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(ranks), pa.int32())], schema.names)

    return df.mapInArrow(run, schema)


def nearest(vectors: DataFrame, queries: DataFrame, block: str, k: int = 5, probes: int | None = None, digits: int = 6, other: bool = True, cells: bool = True) -> DataFrame:
    """query_id, id, similarity, rank, probe: the k rows nearest to each query by cosine among those of its block.

    vectors: id, block, v (unit vectors of one length) and, if asked for, x; queries: id, block, v and low, high: only rows with x
    from low to high count. other: rows with the query's id do not. probes: cells that a query visits; None: all, which is exact.
    cells: without, a block is one cell, so that a query that would visit all cells is one row for each part of the block.
    Similarities are rounded to `digits`, ties go to the smaller id. Null vectors take no part.
    """
    spark, banded = vectors.sparkSession, "x" in vectors.columns
    vectors, queries = vectors.where("v is not null"), queries.where("v is not null")
    held = spark.sparkContext.broadcast(centres(vectors, block) if cells else {})
    number = F.lit(0.0)
    mine = in_cells(vectors.select("id", block, "v", (F.col("x") if banded else number).alias("x")), block, held, 1)
    asked = in_cells(queries.select("id", block, "v", *[(F.col(c) if banded else number).cast("double").alias(c) for c in ("low", "high")]), block, held, probes)
    sizes = mine.groupBy(block, "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(asked.groupBy(block, "cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("turns")), [block, "cell"])

    def dealt(df, own, n, each):
        rows = df.join(sizes, [block, "cell"]).withColumn(own, F.pmod(F.xxhash64("id"), F.col(n)).cast("int"))
        return rows.withColumn(each[0], F.explode(F.sequence(F.lit(0), F.col(each[1]) - 1))).drop("parts", "turns")

    key = [block, "cell", "part", "turn"]
    left = dealt(mine, "part", "parts", ("turn", "turns")).select(*key, "id", "v", "x")
    right = dealt(asked, "turn", "turns", ("part", "parts")).select(*key, "id", "v", "low", "high", "probe")

    def score(c: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "id", "similarity", "probe"]
        if not c.num_rows or not q.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int32())], names)
        ids, q_ids = c["id"].to_numpy(), q["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, m, x = ids[order], _matrix(c["v"])[order], c["x"].to_numpy()[order]
        s, scale = _matrix(q["v"]) @ m.T, 10.0**digits
        s = np.sign(s) * np.floor(np.abs(s) * scale + 0.5) / scale
        if banded:
            s[(x[None, :] < q["low"].to_numpy()[:, None]) | (x[None, :] > q["high"].to_numpy()[:, None])] = -np.inf
        if other:
            s[q_ids[:, None] == ids[None, :]] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(s, best, 1)
        row, col = np.nonzero(value > -np.inf)
        return pa.table([pa.array(q_ids[row]), pa.array(ids[best[row, col]]), pa.array(value[row, col]), pa.array(q["probe"].to_numpy()[row])], names)

    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda c, q: score(c, q), "query_id long, id long, similarity double, probe int")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank", "probe")


def probes_for(vectors: DataFrame, queries: DataFrame, block: str, k: int = 5, recall: float = 0.95, sample: int = 256) -> int:
    """The least number of cells a query with which the share `recall` of the true neighbours of a bounded sample of queries is found."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(sample)
    ranks = np.sort([r.probe for r in nearest(vectors, some, block, k).select("probe").collect()])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1 if len(ranks) else 1
