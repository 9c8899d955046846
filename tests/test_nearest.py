"""Nearest rows by cells against brute force, and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import scores as S
from shelfspark.functions.text import clean_title
from shelfspark.operators import nearest as K
from shelfspark.operators import resolve as E
from shelfspark.plans import adapters as A

SF = "/root/testdata/sf0.01"
ROWS = "id long, b string, v array<float>"


def unit(m):
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def clustered(seed, n, dims=16, kinds=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, dims))
    return unit(middle[rng.integers(0, kinds, n)] + 0.15 * rng.normal(size=(n, dims)))


def half_up(x, digits):
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def brute(m, blocks, asked, k=5):
    out = {}
    for i in asked:
        s = half_up(m.astype(float) @ m[i].astype(float), 6)
        out[i] = [j for _, j in sorted((-s[j], j) for j in range(len(m)) if j != i and blocks[j] == blocks[i])[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.mark.parametrize("part", [4096, 50])
def test_exact_mode(spark, monkeypatch, part):
    """A hot block, ties by equal rows, blocks of one row, nulls."""
    monkeypatch.setattr(K, "PART", part)
    m = clustered(1, 700)
    m[50:60] = m[40]
    blocks = ["hot" if i % 3 else str(i % 50) for i in range(700)]
    rows = [(i, b, v.tolist()) for i, (b, v) in enumerate(zip(blocks, m, strict=True))]
    df = spark.createDataFrame([*rows, (9999, "hot", None)], ROWS)
    asked = list(range(0, 700, 7))
    got = found(K.nearest(df, df.where(F.col("id") % 7 == 0), "b"))
    want = brute(m, blocks, asked)
    assert got == {i: w for i, w in want.items() if w}


def test_recall_of_the_cells(spark):
    """Few cells find 0.95 of the neighbours of clustered rows; the number follows a sample of the queries."""
    m = clustered(2, 3000)
    df = spark.createDataFrame([(i, "one", v.tolist()) for i, v in enumerate(m)], ROWS)
    queries = df.where("id % 10 = 0")
    probes = K.probes_for(df, queries, "b", sample=64)
    got, want = found(K.nearest(df, queries, "b", probes=probes)), brute(m, ["one"] * 3000, range(0, 3000, 10))
    recall = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    print(probes, recall)
    assert probes < K.CENTRES // 2 and recall >= 0.9


def test_recall_on_the_test_table(spark):
    v = A.table(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("b"), F.col("embedding").alias("v"))
    queries = v.where("id % 20 = 0")
    probes = K.probes_for(v, queries, "b")
    got, want = found(K.nearest(v, queries, "b", probes=probes)), found(K.nearest(v, queries, "b"))
    recall = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    print(probes, recall)
    assert recall >= 0.9


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    one = spark.createDataFrame([(1, "b", [1.0, 0.0])], ROWS)
    assert K.nearest(df, df, "b").count() == K.nearest(one, df, "b").count() == K.nearest(df, one, "b").count() == K.nearest(one, one, "b").count() == 0


def vector(text, dims=384):
    """S.embed() by its definition."""
    import zlib

    v = np.zeros(dims)
    for token in text.lower().split():
        v[zlib.crc32(token.encode()) % dims] += 1
    return (v / (np.linalg.norm(v) or 1)).astype(np.float32).astype(float)


def size_score(a, b):
    dev = abs(a - b) / b
    return 1.0 if dev == 0 else 1 - dev / 0.05 * 0.2 if dev <= 0.05 else 0.5 if dev <= 0.15 else 0.0


def third(items, variants):
    """Tier 3 from the definition: 0.7 cosine + 0.3 size over the five nearest by cosine within 15 % of the size."""
    out = {}
    vecs = {t: vector(t) for t in {i.clean for i in items} | {v.name for v in variants}}
    for i in items:
        if not i.size_ml:
            continue
        near = [v for v in variants if v.size_ml > 0 and i.size_ml * (1 - E.BAND) <= v.size_ml <= i.size_ml * (1 + E.BAND)]
        best = sorted((-half_up(vecs[i.clean] @ vecs[v.name], 9), v.product_id, v.size_ml) for v in near)[:5]
        scored = sorted((-(np.floor((0.7 * min(max(-c, 0), 1) + 0.3 * size_score(i.size_ml, s)) * 1e4 + 0.5) / 1e4), p) for c, p, s in best)
        if scored:
            out[i.item_id] = (scored[0][1], round(-scored[0][0], 4))
    return out


def some_items(spark, n=150):
    from shelfspark.functions.text import volume_ml
    from shelfspark.sources.feeds import normalise

    return normalise(A.feed_items(spark, SF)).withColumn("size_ml", volume_ml(F.col("raw_size"))).orderBy("item_id").limit(n)


def test_tier3_against_the_definition(spark):
    items, variants = some_items(spark), A.products(spark, SF)
    got = {r.item_id: (r.t3_id, round(r.t3_score, 4)) for r in E.tier3(items, variants, S.embed()).collect()}
    plain = items.select("item_id", "size_ml", clean_title(F.col("title"), F.col("brand_name")).alias("clean")).collect()
    want = third([r for r in plain if r.clean is not None], variants.collect())
    assert got == want and len(want) > 50


def test_cascade_with_embeddings(spark):
    """E-4 with all three tiers: tier 3 is asked where tier 2 is between its thresholds or has nothing, and wins at its score or more."""
    items, variants = some_items(spark, 400), A.products(spark, SF)
    got = {r.item_id: (r.tier, r.candidate_id, round(r.confidence, 4)) for r in E.resolve(items, variants, S.embed()).collect()}
    one = {r.item_id: r.variant_id for r in E.tier1(items, variants).collect()}
    rest = items.join(spark.createDataFrame([(i,) for i, v in one.items() if v is None], "item_id long"), "item_id", "left_semi")
    two = {r.item_id: (r.t2_id, r.t2_score) for r in E.tier2(rest, variants).collect()}
    plain = rest.select("item_id", "size_ml", clean_title(F.col("title"), F.col("brand_name")).alias("clean")).collect()
    ask = [r for r in plain if r.clean is not None and (r.item_id not in two or E.LOOK_FURTHER <= two[r.item_id][1] < E.THRESHOLD)]
    three = third(ask, variants.collect())
    want = {}
    for i, v in one.items():
        if v is not None:
            want[i] = ("tier1", v, 1.0)
        elif i in three and three[i][1] >= two.get(i, (None, 0.0))[1]:
            want[i] = ("tier3", *three[i])
        elif i in two:
            want[i] = ("tier2", two[i][0], round(two[i][1], 4))
        else:
            want[i] = ("none", None, 0.0)
    assert got == want and {t for t, *_ in want.values()} >= {"tier1", "tier2"}


def test_embeddings_by_the_definition(spark):
    """E-6, E-7: the vectors themselves."""
    from shelfspark.plans.registry import QUERIES

    for r in QUERIES["E-6"](spark, SF).limit(200).collect():
        assert np.allclose(r.v, vector(r.name, 64), atol=1e-6)
    names = A.products(spark, SF).select("product_id", "name").orderBy("product_id").limit(100)
    for r in names.withColumn("v", S.embed()(F.col("name"))).collect():
        assert np.allclose(r.v, vector(r.name), atol=1e-6)
