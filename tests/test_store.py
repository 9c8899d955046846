"""The append-only ledger and tables merged by bucket, also when a run is lost on its way."""

import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import dupes as D
from shelfspark.operators import seed as Z
from shelfspark.operators import upsert as U
from shelfspark.sources import store
from shelfspark.sources.store import KeyedTable, Ledger

OFFERS = "offer_id long, price double, seen_at timestamp"


def offers(spark, ids):
    return spark.range(ids[0], ids[1]).select(F.col("id").alias("offer_id"), F.lit(1.5).alias("price"), F.timestamp_seconds(F.col("id") * 40_000).alias("seen_at"))


def test_a_batch_is_appended_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(FileNotFoundError):
        ledger.read()
    ledger.append(offers(spark, (0, 50)), "monday")
    ledger.append(offers(spark, (50, 60)), "tuesday")
    with pytest.raises(FileExistsError):
        ledger.append(offers(spark, (0, 99)), "monday")
    for name in ("", "../x", "a/b"):
        with pytest.raises(ValueError):
            ledger.append(offers(spark, (0, 1)), name)
    got = ledger.read()
    assert sorted(r.offer_id for r in got.collect()) == list(range(60)) and ledger.batches() == ["monday", "tuesday"]
    assert got.where("batch = 'tuesday'").count() == 10
    monthly = Ledger(spark, str(tmp_path / "monthly"), unit="month")
    monthly.append(offers(spark, (0, 99)), "b")
    assert monthly.read().select("seen_month").distinct().count() == 2


def test_a_lost_append_leaves_nothing_and_can_be_done_again(spark, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    ledger.append(offers(spark, (0, 5)), "one")
    with monkeypatch.context() as m:
        m.setattr(store, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # lost after its rows were written
            ledger.append(offers(spark, (5, 9)), "two")
    bad = offers(spark, (5, 9)).withColumn("price", F.when(F.col("offer_id") == 8, F.raise_error(F.lit("lost task"))).otherwise(F.lit(2.0)))
    with pytest.raises(Exception, match="lost task"):
        ledger.append(bad, "two")
    assert ledger.batches() == ["one"] and ledger.read().count() == 5
    ledger.append(offers(spark, (5, 9)), "two")
    assert sorted(r.offer_id for r in ledger.read().collect()) == list(range(9))


def test_a_merge_touches_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 16)
    rng = random.Random(1)
    state = {i: float(i) for i in range(500)}
    table.merge(spark.createDataFrame(list(state.items()), "k long, v double"), [F.col("v")], "first")
    before = table.state()["folders"]
    for n in range(3):
        new = {rng.randrange(600): rng.random() for _ in range(3)}
        state |= new
        touched = table.merge(spark.createDataFrame([*new.items(), *[(k, 1e9) for k in new]], "k long, v double"), [F.col("v")], f"batch-{n}")
        after = table.state()["folders"]
        assert {int(b) for b in after if after[b] != before.get(b)} == set(touched) and len(touched) <= 3
        before = after
    assert {r.k: r.v for r in table.read().collect()} == state
    # what a small batch reads and writes: its own buckets' rows
    folder = after[str(touched[0])]
    assert spark.read.parquet(os.path.dirname(folder)).count() == table.read(touched).count() < 500


def test_a_lost_merge_changes_nothing_and_a_batch_counts_once(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), [F.col("v")], "one")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    with monkeypatch.context() as m:
        m.setattr(store, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            table.merge(new, [F.col("v")], "two")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "b")]
    assert table.merge(new, [F.col("v")], "two") and table.merge(new, [F.col("v")], "two") == []
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    again = U.upsert(table.read(), new, ["k"], [F.col("v")]).drop("is_new")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.read().collect()))


def test_of_two_merges_at_once_one_fails(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.merge(spark.createDataFrame([(1, "a")], "k long, v string"), [F.col("v")], "one")
    shutil.copy(tmp_path / "t/versions/000000000001.json", tmp_path / "t/versions/000000000002.json")  # version 2 as another run published it
    table.state = lambda: {"version": 1, "folders": KeyedTable.state(table)["folders"], "batches": ["one"], "schema": KeyedTable.state(table)["schema"]}
    with pytest.raises(FileExistsError):
        table.merge(spark.createDataFrame([(1, "b")], "k long, v string"), [F.col("v")], "two")


RAW = "row_id long, slug string, name string, brand string, brand_slug string, category string, format string, claims array<string>, ingredients array<struct<name:string,is_active:boolean>>, size_ml double, offers array<struct<retailer:string,price:double>>"


def test_seed_load_twice(spark):
    raw = spark.createDataFrame([
        (1, "a", "A", "Acme", "acme", "c", "f", ["x"], [("Aqua", False), ("New Oil", True), ("VITAMIN b3", True), (" ", False)], 30.0, [("Nykaa", 5.0), ("Nobody", 1.0)]),
        (2, "b", "B", "Acme", "acme", "c", "f", [], [("new oil", False), ("Plain", False)], 50.0, [("Nykaa", 7.0), ("Tira", 8.0)]),
        (3, "a", "A again", "Acme", "acme", "c", "f", [], [("Aqua", False)], 99.0, [("Nykaa", 5.0)]),
        (4, "none", "N", "Zed", "zed", None, None, None, None, None, None),
    ], RAW)
    seeds = spark.createDataFrame([("Aqua", "Water", ["Eau"], "B"), ("Niacinamide", "Vitamin B3", [], "A")], "inci_name string, canonical_name string, synonyms array<string>, evidence_grade string")
    brands = spark.createDataFrame([("acme", "Acme Ltd", "IN", None)], Z.EMPTY["brand"])
    shops = spark.createDataFrame([("Nykaa", "IN"), ("Tira", "IN")], "name string, market string")
    one = {k: store.written(v) for k, v in Z.seed_catalog(raw, seeds, brands, shops, Z.empty_catalog(spark), "b1").items()}
    rows = {k: sorted(map(str, v.collect())) for k, v in one.items()}
    assert {k: len(v) for k, v in rows.items()} == {"ingredient": 4, "brand": 2, "retailer": 2, "product": 3, "product_ingredient": 5, "variant": 3, "offer": 3, "page": 3}
    assert {r.inci_name: r.evidence_grade for r in one["ingredient"].collect()} == {"Aqua": "B", "Niacinamide": "A", "New Oil": "A", "Plain": "B"}
    assert {r.slug: r.name for r in one["brand"].collect()} == {"acme": "Acme Ltd", "zed": "Zed"}
    assert {r.dcs_score for r in one["product"].collect()} == {0} and not any(r.indexable for r in one["page"].collect())
    two = Z.seed_catalog(raw, seeds, brands, shops, one, "b1")
    assert {k: sorted(map(str, v.collect())) for k, v in two.items()} == rows
    later = Z.seed_catalog(raw, seeds, brands, shops, one, "b2")
    assert later["offer"].count() == 6 and later["variant"].count() == 3


def test_vocabulary_is_stable_and_bounds_the_vectors(spark):
    rng = random.Random(4)
    pi = [(p, i, k + 1, k < 2) for p in range(40) for k, i in enumerate(rng.sample(range(60), 6))]
    df = spark.createDataFrame(pi, "product_id long, ingredient_id long, position int, is_active boolean")
    first = Z.extend_vocabulary(spark.createDataFrame([], "ingredient_id long, dim int"), df.where("ingredient_id > 20"))
    both = Z.extend_vocabulary(first, df)
    old, new = ({r.ingredient_id: r.dim for r in v.collect()} for v in (first, both))
    assert old.items() <= new.items() and sorted(new.values()) == list(range(len(new)))
    assert [i for i, _ in sorted(old.items(), key=lambda x: x[1])] == sorted(old)
    dims = 25
    vectors = D.formula_vectors(df, both, dims)
    dense = {r.product_id: r.v for r in D.dense_vectors(vectors, both, dims).collect()}
    assert all(len(v) == dims for v in dense.values())
    assert set(dense) == {p for p, i, *_ in pi if new[i] < dims}
    sparse = {(r.a, r.b): r.similarity for r in D.pairwise_cosine(vectors.withColumn("block", F.lit(0)), "block").collect()}
    for a in dense:
        assert abs(sum(x * x for x in dense[a]) - 1) < 1e-5
        for b in dense:
            if a < b:
                assert abs(sum(x * y for x, y in zip(dense[a], dense[b], strict=True)) - sparse.get((a, b), 0.0)) < 1e-5


def test_written_leaves_no_shuffle_files_and_settled_no_tables(spark, tmp_path):
    """J-6, V-2, V-5_refresh, V-6, V-7, O-5: what was dealt out to make a table does not stay on the disk beside it."""

    def shuffled():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle")}

    before, option = shuffled(), spark.conf.get(store.SHUFFLES_GO)
    table = store.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(store.SHUFFLES_GO) == option
    assert sorted(r["count"] for r in table.collect()) == [142] + [143] * 6

    made = []

    def make():
        made.append(store.written(spark.range(9)))
        made.append(store.settled(lambda: store.written(spark.range(4))))
        return made[0].join(made[1], "id")

    kept = store.settled(make)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3]
    assert not any(store._names(spark, t._folder) for t in made) and store._names(spark, kept._folder)
