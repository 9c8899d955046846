"""Values that the column functions must give."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import scores as S
from shelfspark.functions import text as X
from shelfspark.operators import labels as N


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "ml"),
    [("2 litres", 2000.0), ("1 fl. oz", 29.57), ("30ml / 1.7 oz", 30.0), ("1.7 oz", 50.27), ("1.7fl oz", 50.27), ("2 x 50ml", 100.0), ("1,7 fl oz", 50.27), ("1 kg", 1000.0), ("30 gel", 30.0), ("large", None), ("50", None), ("", None)],
)
def test_volume(spark, raw, ml):
    assert one(spark, X.volume_ml(F.col("a")), a=raw) == ml


def test_volume_strict(spark):
    assert one(spark, X.volume_ml(F.col("a"), strict=True), a="30 gel") is None


@pytest.mark.parametrize(("a", "b", "delta"), [((599, 30), (549, 30), 9.11), ((200, 20), (300, 50), 66.67), ((5, 5), (5, 5), 0.0), ((5, 0), (5, 5), 0.0), ((5, 5), (0, 5), 0.0)])
def test_price_delta(spark, a, b, delta):
    assert one(spark, S.price_delta_pct(*map(F.col, "abcd")), a=float(a[0]), b=float(a[1]), c=float(b[0]), d=float(b[1])) == delta


@pytest.mark.parametrize(("a", "b", "score"), [(30.0, 30.0, 1.0), (30.0, 34.0, 0.5), (30.0, 60.0, 0.0), (5.0, 0.0, 0.0)])
def test_size_score(spark, a, b, score):
    assert one(spark, S.size_score(F.col("a"), F.col("b")), a=a, b=b) == score


def test_weights_and_scores(spark):
    assert one(spark, S.ingredient_weight(F.col("a"), F.lit(True)), a=1) == 2.0
    assert one(spark, S.combined_score(F.col("a"), F.col("b")), a=0.9, b=1.0) == 0.93
    assert 0.8 <= one(spark, S.size_score(F.col("a"), F.col("b")), a=30.0, b=31.0) <= 1


@pytest.mark.parametrize(("raw", "price", "mrp"), [("439 (MRP 499)", 439.0, 499.0), ("439 599", 439.0, 599.0), ("599 439", 599.0, 599.0), ("not confirmed", 599.0, 599.0), ("", 599.0, 599.0)])
def test_price_and_mrp(spark, raw, price, mrp):
    assert tuple(one(spark, X.price_and_mrp(F.col("a")), a=raw)) == (price, mrp)


def test_slugs_and_titles(spark):
    assert one(spark, X.slug_a(F.col("a")), a=" Crème  de_la -- Mer! ") == "crème-de-la-mer"
    assert one(spark, X.slug_b(F.col("a")), a="Crème!") == "cr-me"
    assert one(spark, X.slug_b(F.col("a")), a="!!") == "product"
    assert one(spark, X.clean_title(F.col("a"), F.col("b")), a="Minimalist Niacinamide 10% Serum, 30 ml", b="minimalist") == "Niacinamide Serum"


@pytest.mark.parametrize(("path", "kind"), [("/p/x", "product"), ("/ingredient/x", "ingredient"), ("/dupe/x", "dupe"), ("/DUPES/x", "dupe"), ("/best/x", "best"), ("/vs/x", "vs"), ("/conflict/x", "conflict"), ("/under/x", "under"), ("/q", "other")])
def test_archetypes(spark, path, kind):
    assert one(spark, X.archetype_from_path(F.col("a")), a=path) == kind


def test_labels(spark):
    d = spark.createDataFrame([(0, "Water", ["Aqua", "Eau"]), (1, "Niacinamide", ["Vitamin B3"]), (2, "Glycerin", ["Glycerol"])], "ingredient_id long, inci_name string, synonyms array<string>")
    raw = spark.createDataFrame([(1, "Aqua / Water / Eau, Niacinamide (Vitamin B3) 10%, Glycerin (vegetable)"), (2, "Niacinamiide, Glycerol,, may contain, Nothing"), (3, ""), (4, None)], "label_id long, raw string")
    tokens = {(r.label_id, r.position): r.candidates for r in N.tokenize(raw).collect()}
    assert tokens[1, 2] == ["Niacinamide", "Vitamin B3"] and tokens[1, 1] == ["Aqua", "Water", "Eau"]
    for mode in ("levenshtein", "difflib"):
        got = {(r.label_id, r.position): (r.inci_name, r.match_method, r.flagged) for r in N.normalize_labels(raw, d, mode=mode).collect()}
        assert got == {(1, 1): ("Water", "exact", False), (1, 2): ("Niacinamide", "exact", False), (1, 3): ("Glycerin", "exact", False), (2, 1): ("Niacinamide", "fuzzy", False), (2, 2): ("Glycerin", "synonym", False), (2, 3): (None, "unmatched", True)}
