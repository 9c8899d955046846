"""Fuzzy matches against all pairs."""

import difflib
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.scores import quick_ratio
from shelfspark.functions.text import clean_title, volume_ml
from shelfspark.operators import labels as N
from shelfspark.operators import resolve as E
from shelfspark.operators.fuzzy import fuzzy_pairs
from shelfspark.plans import adapters as A
from shelfspark.plans.registry import QUERIES
from shelfspark.sources.feeds import normalise

SF = "/root/testdata/sf0.01"


def strings(seed, n, letters="abcdé €"):
    rng = random.Random(seed)
    out = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 28))) for _ in range(n)}
    for s in list(out)[: n // 2]:
        t = list(s)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        out.add("".join(t))
    return sorted({s.strip().upper() for s in out} - {""})


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score(a, b, mode):
    return 1 - lev(a, b) / max(len(a), len(b)) if mode == "levenshtein" else difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("mode", ["levenshtein", "difflib"])
@pytest.mark.parametrize("threshold", [0.45, 0.6, 0.85, 1.0])
def test_every_pair_at_the_threshold(spark, mode, threshold):
    texts, keys = strings(1, 60), strings(2, 60) + strings(1, 60)[::3] + strings(3, 30, "ab")
    keys = sorted(set(keys))
    want = {(a, b): score(a, b, mode) for a in texts for b in keys}
    want = {k: v for k, v in want.items() if v >= threshold}
    got = fuzzy_pairs(spark.createDataFrame([(t,) for t in [*texts, ""]], "cand string"), spark.createDataFrame([(k,) for k in [*keys, ""]], "key string"), threshold, mode).collect()
    assert len(got) == len(want)
    assert {(r.cand, r.key): round(r.score, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_bound_of_the_ratio(spark):
    pairs = [(a, b) for a in strings(5, 20) for b in strings(6, 20)] + [("", ""), ("", "a")]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", quick_ratio(F.col("a"), F.col("b")).alias("q")).collect():
        assert r.q + 1e-9 >= difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert abs(r.q - difflib.SequenceMatcher(None, r.a, r.b).quick_ratio()) < 1e-9


@pytest.mark.parametrize("mode", ["levenshtein", "difflib"])
def test_labels_against_the_definition(spark, mode):
    """N-6 and N-7 whole: each slot's best key of all keys."""
    keys = [(r.kind, r.key, r.ingredient_id) for r in N.dictionary_keys(A.ingredients(spark)).collect()]
    tokens = [(r.label_id, r.position, [c.strip().upper() for c in r.candidates]) for r in N.tokenize(A.labels(spark, SF)).collect()]
    known, memo = {k for _, k, _ in keys}, {}
    want = {}
    for label, position, cands in tokens:
        if any(c in known for c in cands):
            continue
        found = []
        for at, c in enumerate(cands):
            if c not in memo:
                memo[c] = [(score(c, k, mode), kind, k, i) for kind, k, i in keys if score(c, k, mode) >= 0.85] if c else []
            found += [(-s, at, kind, k, i) for s, kind, k, i in memo[c]]
        if found:
            s, _, _, _, i = min(found)
            want[label, position] = (i, round(-s + 1e-12, 4))
    got = {(r.label_id, r.position): (r.ingredient_id, round(r.confidence, 4)) for r in N.normalize_labels(A.labels(spark, SF), A.ingredients(spark), mode=mode).where("match_method = 'fuzzy'").collect()}
    assert got.keys() == want.keys() and got
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-4 for k in want)


def test_a_large_dictionary(spark):
    """From 10^5 to 10^6 keys: near-linear, with exact matches of what was changed."""
    name = F.concat_ws(" ", F.left(F.sha2(F.col("id").cast("string"), 256), F.lit(9)), F.left(F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 256), F.lit(9)))
    took = {}
    for n in (100_000, 1_000_000):
        keys = spark.range(n).select(F.upper(name).alias("key"))
        texts = spark.range(0, n, n // 2000).select(F.upper(F.concat(F.left(name, F.lit(7)), F.lit("#"), F.substring(name, 9, 30))).alias("cand"))
        began = time.time()
        got = fuzzy_pairs(texts, keys, 0.85).agg(F.count("*").alias("n"), F.countDistinct("cand").alias("c"), F.min("score").alias("s")).first()
        took[n] = time.time() - began
        assert got.c == 2000 and got.n == 2000 and got.s >= 0.9
    print(took)
    assert took[1_000_000] < 20 * took[100_000] + 20


def size_score(a, b):
    dev = abs(a - b) / b if b else 9
    return 1.0 if dev == 0 else 1 - dev / 0.05 * 0.2 if dev <= 0.05 else 0.5 if dev <= 0.15 else 0.0


def combined(name, size):
    return math.floor((0.70 * name + 0.30 * size) * 10000 + 0.5) / 10000


def ratio(a, b):
    return difflib.SequenceMatcher(None, a.strip().upper(), b.strip().upper()).ratio()


def test_combined_score_by_the_ratio(spark):
    for r in QUERIES["F-12_difflib"](spark, SF).collect():
        assert r.score == pytest.approx(combined(ratio(r.na, r.nb), size_score(r.sa, r.sb)), abs=1e-9)


def test_tiers_by_the_ratio(spark):
    """E-2 and E-4 in mode difflib: every item's best of all of its fifty candidates, though most pairs are not scored."""
    shop = [(v.product_id, v.name, v.size_ml) for v in A.products(spark, SF).collect()]
    sized = normalise(A.feed_items(spark, SF)).withColumn("size_ml", volume_ml(F.col("raw_size")))
    one = {r.item_id: r.variant_id for r in E.tier1(sized, A.products(spark, SF)).collect()}
    items = [r for r in sized.select("item_id", "size_ml", clean_title(F.col("title"), F.col("brand_name")).alias("clean")).collect() if one[r.item_id] is None]
    memo, want = {}, {}
    for i in items:
        if not i.size_ml or i.clean is None:
            continue
        if (i.clean, i.size_ml) not in memo:
            near = sorted((abs(s - i.size_ml), p, n, s) for p, n, s in shop if i.size_ml * 0.85 <= s <= i.size_ml * 1.15)[:50]
            scored = [(-combined(ratio(i.clean, n), size_score(i.size_ml, s)), diff, p) for diff, p, n, s in near]
            memo[i.clean, i.size_ml] = (min(scored)[2], -min(scored)[0]) if scored else None
        if memo[i.clean, i.size_ml]:
            want[i.item_id] = memo[i.clean, i.size_ml]
    got = {r.item_id: (r.t2_id, r.t2_score) for r in QUERIES["E-2_difflib"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)
    whole = {r.item_id: (r.tier, r.candidate_id, r.confidence) for r in QUERIES["E-4_difflib"](spark, SF).collect()}
    for i, v in one.items():
        expected = ("tier1", v, 1.0) if v is not None else ("tier2", *want[i]) if i in want else ("none", None, 0.0)
        assert whole[i][:2] == expected[:2] and abs(whole[i][2] - expected[2]) < 1e-9
