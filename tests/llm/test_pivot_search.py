import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import pivot_search as ps

SF = "/root/testdata/sf0.01"


def evaluated(c, k=5):
    ids = np.random.default_rng(1).permutation(len(c))
    q, q_ids = c[:40], ids[:40]
    tile = ps.Tile(c, ids, ids, ps.pick_pivots(c[:500], 16))
    best, who = tile.search(q, q_ids, k)
    for i in range(40):
        want = sorted((-int(s), int(x)) for s, x in zip(c @ q[i], ids, strict=True) if x != q_ids[i])[:k]
        assert want == [(-int(s), int(x)) for s, x in zip(best[i], who[i], strict=True)]
    return tile.evaluated / (40 * len(c))


def test_tile_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    centres = rng.integers(-900, 900, (60, 8)).astype(float)
    clustered = centres[rng.integers(0, 60, 6000)] + rng.integers(-5, 5, (6000, 8))
    assert evaluated(clustered) < 0.25
    assert evaluated(rng.integers(-90, 90, (6000, 64)).astype(float)) <= 1


def test_bounds_hold_where_terms_cancel():
    rng = np.random.default_rng(4)
    c = 3e7 + rng.integers(-3, 3, (300, 1)).astype(float)  # large terms, small differences
    evaluated(np.concatenate([c, np.full((300, 1), 5.0)], 1))


def test_against_sql(spark, monkeypatch):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f"select query_id, rank, vec_id, score from ({ps.OP6_SQL})").fetchall())
    for least, queries in ((4096, 256), (50, 3)):
        monkeypatch.setattr(ps, "LEAST_TILE", least)
        monkeypatch.setattr(ps, "QUERIES", queries)
        assert sorted(map(tuple, ps.op6_topk(spark, SF).collect())) == want


def test_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (50, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (7, [1.0], 1), (8, [], 1), (9, [-0.999, 0.001], 1), (None, [1.0, 1.0], 1), (2, [1.0, 0.0], 1)]
    v = spark.createDataFrame(rows, schema).selectExpr("*", "1 as id", "2 as v", "3 as score")
    asked = F.col("vec_id").isin(0, 50, 7)
    got = [tuple(r) for r in ps.top_k(v, asked).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 2, 65536), (0, 4, 9, -65536)]
    assert ps.top_k(v.where("false"), asked).count() == 0


@pytest.mark.parametrize("big", [1.0, 1e6])
def test_rows_that_repeat_an_id(spark, big):
    """Each row is a candidate of the others, also of those with its id, and each query row has its own ranks."""
    rows = [(0, [1.0 * big, 0.0]), (0, [0.0, 1.0]), (2, [1.0, 1.0]), (0, [1.0 * big, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for r, (i, q) in enumerate(rows):
        best = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q, c, strict=True)), j) for s, (j, c) in enumerate(rows) if s != r)[:2]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best) if i == 0]
    assert sorted(map(tuple, ps.top_k(v, F.col("vec_id") == 0, k=2).collect())) == sorted(want)


def test_scores_beyond_a_long(spark):
    """Such a score counts as the nearest long; other queries are not touched."""
    v = spark.createDataFrame([(0, [1e18, 0.0]), (1, [1e18, 1.0]), (2, [2e18, 0.0]), (3, [-1e18, 5.0]), (4, [0.0, 1.0]), (5, [1e307, 0.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ps.top_k(v, F.col("vec_id").isin(0, 4)).collect()))
    top, low = (1 << 63) - 1, -(1 << 63)
    assert got == [(0, 1, 1, top), (0, 2, 2, top), (0, 3, 4, 0), (0, 4, 3, low), (4, 1, 3, 5 * 65536), (4, 2, 1, 65536), (4, 3, 0, 0), (4, 4, 2, 0)]


def brute(rows, k=5):
    v = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows]
    out = []
    for i, q in v:
        best = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in v if j != i and len(c) == len(q))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_lengths_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(ps, "PIVOT_SAMPLE", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=2 + i % 4).tolist()) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ps.top_k(v, F.lit(True)).collect())) == brute(rows)


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 10.0 ** (i % 7)).tolist()) for i in range(60)]
    rows += [(60, [1e6 + 1 / 256, 0.0, 0.0]), (61, [1e6, 0.0, 0.0]), (62, [1e6, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ps.top_k(v, F.lit(True)).collect())) == brute(rows)
