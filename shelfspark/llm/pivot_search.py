"""Exact top-k search by inner product with a pivot table.

Vectors become whole numbers, floor(scale * x). For any pivot p the distance of a query and a candidate is at least
|d(q, p) - d(c, p)|; the largest such value over many pivots, with the two norms, bounds the score that the candidate can
have: (|q|^2 + |c|^2 - bound^2) / 2 (without pivots the bound is 0).

Candidates are dealt to tiles, and each tile is a task that gets all queries as a stream. A tile sorts its candidates by
their nearest pivot into blocks of BLOCK neighbours; the table has each block's least and greatest distance to every
pivot. A query takes its blocks in its own order of bounds, in rounds that grow: its best ones first, which set its k-th score,
and it stops where the next bound is below that score. Queries that take the same block in a round share a product.

Blocks are matrix products of doubles. Those are exact: whole numbers whose norms are under 2^26 have products and partial
sums under 2^53. Vectors with larger norms are scored with Python's integers (search_large).

Pivots are picked far from each other in a bounded sample (PIVOT_SAMPLE rows). Queries are stated rows of the table; each goes to every
tile, so for N rows of which a share are queries the shuffle is N / tile rows times that share of the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm._common import observed, partitions, prepare, scratch, table

PIVOTS = 32
PIVOT_SAMPLE = 2048
#: Components of the candidates of a tile, and the fewest rows that are worth a tile of their own.
TILE, LEAST_TILE = 1 << 23, 4096
BLOCK = 64
#: Queries that pass over a tile together.
QUERIES = 256
#: Blocks of a query's first round; each round has twice as many as the one before.
FIRST = 4
#: Squared norm, once scaled, below which products are exact in doubles.
FAST = float(1 << 52)


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float = 256.0, more: tuple[Column, ...] = ()) -> DataFrame:
    """The columns with v (array<double> of whole numbers) instead of the vector: floor(scale * component). Null vectors and those
    with a component that is null or not finite, also once scaled, take no part, nor do rows with a null id."""

    def whole(c):
        y = F.lit(scale) * c.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    fit = F.forall(F.col(vec_col), lambda c: F.coalesce(F.abs(F.lit(scale) * c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & fit).select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), whole).alias("v"), *more)


def _fast(m: np.ndarray) -> np.ndarray:
    """Rows whose products are exact in doubles."""
    with np.errstate(over="ignore"):
        return (m**2).sum(1) < FAST


def search_large(q: np.ndarray, q_rows: np.ndarray, c: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """query's row, candidate id, score of each query's k best, for components of any size: products in floating point with a
    bound of their error choose the candidates that Python's integers then score. A score beyond a long counts as the nearest long,
    in its rank too."""
    out: list[tuple[int, int, int]] = []
    edge = 2.0**63
    size = np.sqrt((c**2).sum(1))
    for v, i in zip(q, q_rows.tolist(), strict=True):
        with np.errstate(all="ignore"):
            near = c @ v
            off = 4 * (len(v) + 4) * 2.0**-52 * size * np.sqrt((v**2).sum())
            low = np.where(c_rows == i, -np.inf, np.clip(np.nan_to_num(near - off, nan=-np.inf), -edge, edge * (1 - 1e-6)))
            least = np.sort(low)[-k:][0] if len(low) else -np.inf
            at = np.flatnonzero((~(np.maximum(near + off, -edge) < least) | (near > edge * (1 - 1e-6))) & (c_rows != i))
        mine = [int(x) for x in v]
        scores = (sum(int(x) * y for x, y in zip(c[j].tolist(), mine, strict=True)) for j in at)
        scored = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), int(c_ids[j])) for s, j in zip(scores, at, strict=True))[:k]
        out += [(i, j, -s) for s, j in scored]
    return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows of a sample."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


class Tile:
    """The candidates of one tile, of one dimension, with their pivot table. evaluated counts scored pairs."""

    def __init__(self, c: np.ndarray, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray):
        far, self.pivots, self.evaluated = distances(c, pivots), pivots, 0
        near = far.argmin(1) if len(pivots) else np.zeros(len(c), np.int64)
        order = np.lexsort((far[np.arange(len(c)), near], near)) if len(pivots) else np.argsort((c**2).sum(1), kind="stable")
        self.c, self.rows, self.ids, far = c[order], rows[order], ids[order], far[order]
        self.starts = np.arange(0, len(c), BLOCK)
        self.low, self.high = np.minimum.reduceat(far, self.starts), np.maximum.reduceat(far, self.starts)
        self.norm = np.maximum.reduceat((self.c**2).sum(1), self.starts)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each query can have in each block."""
        far = distances(q, self.pivots)
        least = np.zeros((len(q), len(self.starts)))
        for p in range(far.shape[1]):
            np.maximum(least, self.low[None, :, p] - far[:, p, None], out=least)
            np.maximum(least, far[:, p, None] - self.high[None, :, p], out=least)
        terms = (q**2).sum(1)[:, None] + self.norm[None, :]
        return (terms - least**2) / 2 + 1e-9 * terms + 1  # distances are rounded: relative to the terms, not to what is left

    def search(self, q: np.ndarray, q_rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's k best, without its own row, ties to the smaller id; -inf where there are fewer."""
        best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        upper = self.bounds(q)
        order = np.argsort(-upper, axis=1)

        def evaluate(block: int, some: np.ndarray) -> None:
            part = slice(self.starts[block], self.starts[block] + BLOCK)
            scores = q[some] @ self.c[part].T
            scores[q_rows[some][:, None] == self.rows[part][None, :]] = -np.inf
            self.evaluated += scores.size
            better = np.flatnonzero((scores >= best[some, -1:]).any(1) & (scores.max(1) > -np.inf))
            if len(better):
                rows = some[better]
                values = np.concatenate([best[rows], scores[better]], 1)
                names = np.concatenate([who[rows], np.broadcast_to(self.ids[part], (len(rows), scores.shape[1]))], 1)
                names = np.where(values > -np.inf, names, np.iinfo(np.int64).max)
                at = np.lexsort((names, -values), axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(values, at, 1), np.take_along_axis(names, at, 1)

        going, done, step = np.arange(len(q)), 0, FIRST
        while len(going) and done < len(self.starts):
            blocks = order[going, done : done + step]
            turn = np.argsort(blocks, axis=None, kind="stable")
            queries, blocks = np.repeat(going, blocks.shape[1])[turn], blocks.ravel()[turn]
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                some = queries[lo:hi]
                some = some[upper[some, blocks[lo]] >= best[some, -1]]
                if len(some):
                    evaluate(int(blocks[lo]), some)
            done, step = done + step, 2 * step
            if done < len(self.starts):
                # bounds fall along a query's order: below its k-th score it stops
                going = going[upper[going, order[going, done]] >= best[going, -1]]
        return best, who


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows by dimension: dimension -> (places, matrix)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, begin = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    out = {}
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out[d] = rows, flat[begin[rows][:, None] + np.arange(d)[None, :]]
    return out


def top_k(vectors: DataFrame, asked: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row where `asked` holds with every other row.

    Only vectors of the query's length are compared; an empty vector scores 0 with the others. Of rows that repeat an id each is a
    candidate, also of each other; each that is asked has ranks of its own under the shared id.
    """
    numbered = vectors.select(id_col, vec_col, F.coalesce(asked, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("row"))
    # written once: a row keeps its number
    rows = scratch(usable(numbered, id_col, vec_col, more=("asked", "row")), n=F.count(F.lit(1)), size=F.sum(F.size("v")))
    n, size = observed(rows)["n"], observed(rows)["size"] or 0
    tiles = max(1, -(-size // TILE), min(n // LEAST_TILE, partitions(vectors.sparkSession)))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").toArrow()
    tables = {d: pick_pivots(m[_fast(m)], pivots) for d, (_, m) in _matrix(sample.column("v").combine_chunks()).items()} if sample.num_rows else {}

    def search(batches):
        tile, held, made, asked, waiting = None, [], None, [], 0

        def build():
            out = {}
            if held:
                ids, rows_ = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (2, 3))
                for d, (at, m) in _matrix(pa.chunked_array([b.column(4) for b in held]).combine_chunks()).items():
                    few = _fast(m)
                    fast = Tile(m[few], rows_[at][few], ids[at][few], tables.get(d, np.zeros((0, d)))) if few.any() else None
                    out[d] = fast, m, rows_[at], ids[at], few
            return out

        def answer():
            ids, rows_ = (np.concatenate([b.column(i).to_numpy() for b in asked]) for i in (2, 3))
            names = dict(zip(rows_.tolist(), ids.tolist(), strict=True))
            for d, (at, q) in _matrix(pa.chunked_array([b.column(4) for b in asked]).combine_chunks()).items():
                if d not in made:
                    continue
                fast, m, c_rows, c_ids, few = made[d]
                q_rows, mine = rows_[at], _fast(q)
                found = [search_large(q[~mine], q_rows[~mine], m, c_rows, c_ids, k)] if not mine.all() else []
                if not few.all():
                    found.append(search_large(q[mine], q_rows[mine], m[~few], c_rows[~few], c_ids[~few], k))
                if fast is not None and mine.any():
                    best, who = fast.search(q[mine], q_rows[mine], k)
                    real = best > -np.inf
                    found.append((np.repeat(q_rows[mine], real.sum(1)).tolist(), who[real], best[real].astype(np.int64)))
                for part in found:
                    part = ([names[r] for r in part[0]], *part)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], ["query_id", "row", "vec_id", "score"])

        for whole in batches:
            keys = whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                b, key = whole.slice(lo, hi - lo), int(keys[lo])
                if key // 2 != tile or key % 2 == 0 and made is not None:
                    if asked:
                        yield from answer()
                    tile, held, made, asked, waiting = key // 2, [], None, [], 0
                if key % 2 == 0:
                    held.append(b)
                    continue
                if made is None:
                    made, held = build(), []
                asked.append(b)
                waiting += b.num_rows
                if waiting >= QUERIES:
                    yield from answer()
                    asked, waiting = [], 0
        if asked:
            yield from answer()

    own = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int").alias("tile"), F.lit(0).alias("side"), "id", "row", "v")
    every = rows.where("asked").select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit(1).alias("side"), "id", "row", "v")
    dealt = own.union(every).repartition(tiles, "tile").sortWithinPartitions("tile", "side")
    found = dealt.mapInArrow(search, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings -> query_id, rank, vec_id, score; queries: rows whose vec_id is divisible by 50."""
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.r AS q, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
