"""Sources, sinks and properties that must hold between runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import completeness as C
from shelfspark.operators import dupes as D
from shelfspark.operators import ledger as L
from shelfspark.operators import upsert as U
from shelfspark.plans import adapters as A
from shelfspark.sources import feeds
from shelfspark.streaming.ingest import replay_feed

SF = "/root/testdata/sf0.001"


def test_envelopes(spark, tmp_path):
    item = {"retailer_sku": " NYK-001 ", "gtin": " ", "title": "Test Product 30ml", "brand_name": "Test Brand", "raw_size": "30ml", "price": "599.00", "currency": "inr", "affiliate_url": "https://x.example/1"}
    bad = item | {"price": "-1", "currency": "rs", "affiliate_url": "x", "retailer_sku": ""}
    (tmp_path / "feed.json").write_text(json.dumps({"retailer_id": "r1", "slug": "r", "items": [item, bad, item | {"price": "1.234"}]}))
    items, lines = feeds.read_envelopes(spark, str(tmp_path / "feed.json"))
    assert lines.count() == 0
    good, rejects = feeds.valid(items)
    (g,) = good.collect()
    assert (g.retailer_sku, g.gtin, float(g.price), g.currency, g.in_stock) == ("NYK-001", None, 599.0, "INR", True)
    assert sorted(r.errors for r in rejects.collect()) == [["bad price"], ["no sku", "bad price", "bad currency", "bad url"]]


def test_every_line_of_a_feed_is_an_item_or_a_reject(spark, tmp_path):
    head = '{"retailer_id":"r","slug":"s"'
    lines = {
        "{bad": "no JSON", head: "no JSON", "[1]": "wrong types", "null": "wrong types", '"text"': "wrong types", head + "}": "no items", head + ',"items":null}': "no items", head + ',"items":[]}': "empty items",
        head + ',"items":{"title":"a"}}': "wrong types", head + ',"items":["a"]}': "wrong types", head + ',"items":[null]}': "an item is no object", head + ',"items":[{"in_stock":"maybe"}]}': "wrong types",
        '{"slug":"s","items":[{"title":"a"}]}': "no retailer", '{"retailer_id":" ","slug":"s","items":[{}]}': "no retailer", '{"retailer_id":"r","items":[{}]}': "no slug",
    }
    good = [head + ',"items":[{"title":"a"},{"price":5.50}],"more":1}', head + ',"items":[{}]}']
    (tmp_path / "feed.json").write_text("\n".join(["", *lines, "  ", *good]))
    items, rejects = feeds.read_envelopes(spark, str(tmp_path / "feed.json"))
    assert {r.line: r.reason for r in rejects.collect()} == lines
    assert sorted((r.title or "", r.price or "") for r in items.collect()) == [("", ""), ("", "5.5"), ("a", "")]


@pytest.mark.parametrize(
    "raw, ml",
    [("2 litres", 2000.0), ("1.7 oz", 50.27), ("1 fl. oz", 29.57), ("1.7fl oz", 50.27), ("30ml / 1.7 oz", 30.0), ("large", None), ("50", None), (" ", None), ("2 x 50ml", 100.0), ("2 X 1,5 l", 3000.0), ("1 floz", 29.57), ("3 Fluid Ounces", 88.72),
     ("50 gm", 50.0), ("50GR", 50.0), ("0.5 kg", 500.0), ("2 Kilograms", 2000.0), ("10 milliliters", 10.0), ("10 Millilitre", 10.0), ("1 fl.  oz.", 29.57), ("7 grams", 7.0), ("1 liter", 1000.0)],
)
def test_golden_sizes(spark, raw, ml):
    from shelfspark.functions.text import volume_ml

    assert spark.createDataFrame([(raw,)], "r string").select(volume_ml(F.col("r"))).first()[0] == ml


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Brand Name, Product \n Acme , Serum\n,\nShort\n")
    rows = feeds.read_sheet(spark, str(tmp_path / "s.csv")).collect()
    assert [tuple(r) for r in rows] == [("Acme", "Serum"), ("Short", "")] and rows[0].__fields__ == ["brand_name", "product"]


def test_search_rows(spark):
    raw = spark.createDataFrame([(["u", "x"], 3.0, None, 0.12345, 4.567), ([], 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)], feeds.SEARCH)
    assert [tuple(r) for r in feeds.flatten_search_rows(raw, F.lit("2024-01-01")).collect()] == [("u", "2024-01-01", 3, 0, 0.1235, 4.57)]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = U.upsert(old, new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "a", False), (2, "d", False), (3, "e", True)]
    again = U.upsert(once.drop("is_new"), new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, again.collect())) == [(1, "a", False), (2, "d", False), (3, "e", False)]
    assert U.insert_absent(once.drop("is_new"), new, ["k"], [F.col("v")]).count() == 0


def test_feed_totals_and_stream(spark):
    items, products = A.feed_items(spark, SF), A.products(spark, SF)
    for r in L.summary(L.ingest(items, products)).collect():
        assert r.total == r.inserted + r.skipped + r.failed
    batch = sorted((r.item_id, r.outcome) for r in L.ingest(items, products).collect())
    assert sorted((r.item_id, r.outcome) for r in replay_feed(spark, items, products).collect()) == batch


def test_cosine(spark):
    rows = [(p, i, k + 1, k < 4) for p, order in ((1, [1, 2, 3]), (2, [1, 2, 3]), (3, [7, 8]), (4, [3, 2, 1])) for k, i in enumerate(order)]
    vectors = D.formula_vectors(spark.createDataFrame(rows, "product_id long, ingredient_id long, position int, is_active boolean")).withColumn("block", F.lit(0))
    got = {(r.a, r.b): r.similarity for r in D.pairwise_cosine(vectors, "block").collect()}
    assert abs(got[1, 2] - 1) < 1e-9 and (1, 3) not in got and all(0 <= x <= 1 for x in got.values())


@pytest.mark.parametrize("least", [0.3, 0.6, 0.9])
def test_similar_pairs(spark, least):
    """Every product holds ingredient 0, at any position; some hold little else, some are copies, one has a block of its own."""
    draw = random.Random(5)
    labels = {p: draw.sample([0] * (p % 3 > 0) + list(range(1, 12)), draw.randint(1, 8)) for p in range(60)}
    labels |= {60: [0], 61: [0], 62: labels[3], 63: labels[3], 64: labels[3]}
    rows = [(p, i, k + 1, draw.random() < 0.3) for p, order in labels.items() for k, i in enumerate(order)]
    vectors = D.formula_vectors(spark.createDataFrame(rows, "product_id long, ingredient_id long, position int, is_active boolean"))
    vectors = vectors.withColumn("block", F.when(F.col("product_id") == 64, 9).otherwise(F.col("product_id") % 2))
    want = {(r.a, r.b): r.similarity for r in D.pairwise_cosine(vectors, "block").where(F.col("similarity") >= least + 1e-9).collect()}
    got = {(r.a, r.b): r.similarity for r in D.similar_pairs(vectors, "block", least).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_gate(spark):
    rows = [("product", True, 3, 20, 45, True, True), ("product", True, 2, 15, 0, False, False), ("product", True, 2, 5, 35, False, False), ("product", False, 2, 25, 30, True, True), ("product", True, 1, 20, 35, True, True), ("ingredient", True, 2, 20, 30, False, False)]
    names = "archetype string, has_full_ingredient_list boolean, live_offer_count int, parsed_review_count int, price_history_days int, has_image_and_variant_coverage boolean, has_expert_annotation boolean"
    got = [(r.dcs_score, r.mandatory_passed, r.indexable) for r in C.score(spark.createDataFrame(rows, names)).collect()]
    assert got == [(100, True, True), (70, True, True), (60, True, False), (70, False, False), (80, False, False), (80, False, False)]
    pages = spark.createDataFrame([("u", None), ("v", "2020-01-01 00:00:00")], "url string, t string").select("url", F.col("t").cast("timestamp").alias("first_indexed_at"))
    scored = spark.createDataFrame([("u", 90, True, "indexed"), ("v", 10, False, "provisional")], "url string, dcs_score int, indexable boolean, index_tier string")
    kept = {r.url: str(r.first_indexed_at) for r in C.promote(pages, scored, "2024-01-01").collect()}
    assert kept == {"u": "2024-01-01 00:00:00", "v": "2020-01-01 00:00:00"}


def test_sheet_tables_keep_what_is_there_and_the_first_row_of_a_key(spark):
    from shelfspark.operators.views import sheet_tables

    rows = [
        (1, "Acme", "Gel", "Rs 100", "50 ml", "Facewash", "SPF 50", "x" * 200, None),
        (2, "ACME", "gel", "Rs 90", "50 ml", "Sunscreen", None, " ", "https://a.example"),
        (3, "Old", "Cream", "", "", "Moisturizer", None, None, None),
        (4, "Acme", "Mask", "Rs 10", "5 ml", "Masks", None, None, None),
        (5, "", "Mask", "Rs 10", "5 ml", "Facewash", None, None, None),
    ]
    sheet = spark.createDataFrame(rows, "row_id int, brand string, product string, price string, size string, tab string, spf_pa string, dupe_edge string, page string")
    old = {t: spark.createDataFrame([(k,)], f"{c} string") for t, k, c in (("brand", "old", "slug"), ("product", "old-cream", "slug"), ("page", "/p/none", "url"))}
    out = {t: df.collect() for t, df in sheet_tables(sheet, old).items()}
    assert [(r.slug, r.name) for r in out["brand"]] == [("acme", "Acme")]
    assert {(r.dcs_score, r.indexable) for r in out["page"]} == {(0, False)} and {(r.dcs_score, r.index_tier) for r in out["product"]} == {(0, "provisional")}
    assert [(r.slug, r.category, r.format, r.claims) for r in out["product"]] == [("acme-gel", "cleanser", "cleanser", ["SPF 50", "x" * 150])]
    assert sorted(r.url for r in out["page"]) == ["/p/acme-gel", "/p/old-cream"]
    assert sorted(r.row_id for r in out["variant"]) == [1, 2, 3]
    assert {r.row_id: r.affiliate_url for r in out["offer"]} == {1: "https://www.nykaa.com/search?q=acme-gel", 2: "https://a.example", 3: "https://www.nykaa.com/search?q=old-cream"}


def test_compare_takes_up_to_four_products(spark):
    from shelfspark.operators.views import compare

    products = spark.createDataFrame([(i, s, s.upper(), "B", 10.0 * i, ["Dry"] if i == 1 else None) for i, s in enumerate("abcde", 1)], "product_id long, slug string, name string, brand string, size_ml double, skin_types array<string>")
    lowest = products.selectExpr("product_id", "60D as price")
    listed = spark.createDataFrame([(1, 7, 1, True), (1, 8, 2, False), (2, 8, 1, True), (2, 7, 2, True), (3, 7, 1, False)], "product_id long, ingredient_id long, position int, is_active boolean")
    scored = spark.createDataFrame([("/p/a", 80)], "url string, dcs_score int")
    pairs = spark.createDataFrame([("a-vs-b", ["a", "b"]), ("a-vs-b-vs-c-vs-d-vs-e", list("abcde"))], "pair string, slugs array<string>")
    got = {(r.pair, r.side): r for r in compare(pairs, products, lowest, listed, scored).collect()}
    assert len(got) == 6
    first = got["a-vs-b", "a"]
    assert (first.shared, first.unique, first.actives, first.skin_fit, first.dcs_score, first.cheaper) == ([7, 8], [], [7], [2, 5, 2], 80, False)
    assert got["a-vs-b", "b"].cheaper and got["a-vs-b", "b"].dcs_score == 0
    last = got["a-vs-b-vs-c-vs-d-vs-e", "d"]
    assert (last.shared, last.unique, last.actives, last.skin_fit, last.cheaper) == ([], [], [], [2, 2, 2], True)


def test_new_products_need_a_free_slug_and_unknown_slots_go_to_review(spark):
    from shelfspark.operators.views import create_products

    ask = "request_id int, brand_name string, name string, category string, format string, claims array<string>, raw_ingredients string, size_ml double, price double, currency string, retailer_name string"
    rows = [(1, "New & Co", "Gel", "c", "f", None, "Water, Zzzz", 10.0, 5.0, "INR", "Nykaa"), (2, "new  co", "Gel", "c", "f", None, "Water", 10.0, 5.0, "INR", "Nykaa"), (3, "Old", "Cream", "c", "f", None, "Water", 10.0, 5.0, "INR", "Nykaa"), (4, "Old", "Mask", "c", "f", None, None, 10.0, 5.0, "INR", "Tira")]
    brands = spark.createDataFrame([("old", "b1")], "brand_slug string, brand_id string")
    shops = spark.createDataFrame([("Nykaa", "r1")], "retailer_name string, retailer_id string")
    have = spark.createDataFrame([("old-cream",)], "slug string")
    dictionary = spark.createDataFrame([(0, "Water", ["Aqua"])], "ingredient_id long, inci_name string, synonyms array<string>")
    out = create_products(spark.createDataFrame(rows, ask), brands, have, shops, dictionary, "2024-01-01")
    got = {r.request_id: r for r in out["summary"].collect()}
    assert {i: r.status for i, r in got.items()} == {1: "created", 2: "exists", 3: "exists", 4: "created"}
    assert (got[1].slug, got[1].ingredients, got[1].review, got[1].dcs_score, got[1].brand_new, got[1].page_url) == ("new-co-gel", 2, 1, 40, True, "/p/new-co/new-co-gel")
    assert (got[4].ingredients, got[4].dcs_score, got[4].brand_new, got[4].retailer_new) == (0, 10, False, True)
    assert out["review"].count() == 1 and out["variant"].count() == 2 and out["vector"].count() == 1


def test_a_slug_may_hold_vs(spark):
    from shelfspark.operators.views import compare

    products = spark.createDataFrame([(1, "day-vs-night", "A", "B", 10.0, None), (2, "b", "B", "B", 10.0, None)], "product_id long, slug string, name string, brand string, size_ml double, skin_types array<string>")
    pairs = spark.createDataFrame([("day-vs-night-vs-b", ["day-vs-night", "b"])], "pair string, slugs array<string>")
    none = spark.createDataFrame([], "product_id long, ingredient_id long, position int, is_active boolean")
    got = compare(pairs, products, products.selectExpr("product_id", "60D as price"), none, spark.createDataFrame([], "url string, dcs_score int")).collect()
    assert sorted((r.side, r.slug) for r in got) == [("a", "day-vs-night"), ("b", "b")]


def test_pages_without_entities_have_no_siblings(spark):
    from shelfspark.operators.views import page_metadata, siblings

    rows = [(f"u{i}", "vs", refs, "en", True, 80) for i, refs in enumerate([[], [], None, None, [1], [1], [2]])] + [("v", "best", [1], "hi", True, 80), ("w", "vs", [1], "hi", False, 80)]
    pages = spark.createDataFrame(rows, "url string, archetype string, entity_refs array<long>, locale string, indexable boolean, dcs_score int")
    assert sorted((r.url, r.sibling) for r in siblings(pages).collect()) == sorted([("u4", "u4"), ("u4", "u5"), ("u5", "u4"), ("u5", "u5"), ("u6", "u6"), ("v", "v"), ("w", "u4"), ("w", "u5")])
    meta = {r.url: [h.url for h in r.hreflang] for r in page_metadata(pages).collect()}
    assert len(meta) == 9 and meta["u0"] == meta["u2"] == [] and meta["w"] == ["u4", "u5"]


def test_the_gate_decides_on_sheets(spark):
    """A sheet's page opens only if the gate lets it; a label, two offers and reviews are not in the sheet."""
    from shelfspark.operators.views import gate_sheet, sheet_tables

    rows = [(1, "Acme", "Gel", "Rs 100", "50 ml", "Facewash", None, None, None), (2, "Acme", "Gel", "Rs 90", "50 ml", "Facewash", None, None, None), (3, "Acme", "Cream", "Rs 10", "", "Facewash", None, None, None)]
    sheet = spark.createDataFrame(rows, "row_id int, brand string, product string, price string, size string, tab string, spf_pa string, dupe_edge string, page string")
    old = {t: spark.createDataFrame([], "slug string") for t in ("brand", "product")} | {"page": spark.createDataFrame([], "url string")}
    labels = spark.createDataFrame([("acme-gel",)], "product_id string")
    out = gate_sheet(sheet_tables(sheet, old), labels, "2024-01-01")
    assert {r.url: (r.dcs_score, r.indexable, r.first_indexed_at) for r in out["page"].collect()} == {"/p/acme-gel": (60, False, None), "/p/acme-cream": (10, False, None)}
    assert {r.slug: (r.dcs_score, r.index_tier) for r in out["product"].collect()} == {"acme-gel": (60, "provisional"), "acme-cream": (10, "provisional")}


def test_products_follow_their_pages(spark):
    products = spark.createDataFrame([(1, 0, "x"), (2, 5, "y"), (3, 6, "z")], "product_id long, dcs_score int, index_tier string")
    scored = spark.createDataFrame([("/a", "product", [1], 60, "provisional"), ("/b", "p", [1, 2], 90, "indexed"), ("/c", "vs", [2], 99, "indexed"), ("/d", "product", [], 99, "indexed"), ("/e", "product", None, 99, "indexed")], "url string, archetype string, entity_refs array<long>, dcs_score int, index_tier string")
    assert sorted(map(tuple, C.sync_products(products, scored).collect())) == [(1, 90, "indexed"), (2, 5, "y"), (3, 6, "z")]


def test_ingredients_by_both_slugs(spark):
    from shelfspark.operators.views import ingredient_by_slug

    d = spark.createDataFrame([(5, "Aqua", "Water"), (3, "Water", None), (4, "Niacinamide", "Vitamin B3"), (7, "X", "X")], "ingredient_id long, inci_name string, canonical_name string")
    wanted = spark.createDataFrame([("water",), ("AQUA",), ("vitamin  b3",), ("x",), ("none",)], "wanted string")
    assert sorted((r.wanted, r.ingredient_id) for r in ingredient_by_slug(wanted, d).collect()) == [("AQUA", 5), ("vitamin  b3", 4), ("water", 3), ("x", 7)]
