import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfspark.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall((text or "").translate(UPPER))
        docs[lang].update(set(found))
        n[lang, source].update(found)
    kept = {lang: [t for t, k in docs[lang].items() if k >= least] for lang, _ in groups}
    p = {}
    for key in groups:
        total = sum(n[key][t] for t in kept[key[0]])
        p[key] = {t: 1 + 10**9 * (n[key][t] + 5) // (total + 5 * len(kept[key[0]])) for t in kept[key[0]]}
    q = {}
    for lang, terms in kept.items():
        c = {t: sum(n[g][t] for g in groups if g[0] == lang) for t in terms}
        q[lang] = {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(terms)) for t in terms}
    out = set()
    for lang, source in groups:
        pairs = [(b, sum(abs(p[lang, source][t] - p[lang, b][t]) for t in kept[lang])) for x, b in groups if x == lang and b != source]
        terms = [(t, v - q[lang][t]) for t, v in p[lang, source].items() if n[lang, source][t] and v > q[lang][t]]
        for part, items, last in (("pair", pairs, None), ("term", terms, top)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last]
            out |= {(lang, source, part, item, v, i) for i, (item, v) in enumerate(items, 1)}
    return out


def documents(seed=1, n=600):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ["wort", "Été", "ÀB", "z", "\U0001f600", "ab", "\x7fq", "Ｚ"] for b in ["x", "Y", "ß", "ee", "o", "p", "qq", "É"]]
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "b", "c", "B", "", None, "é"])
        words = rng.choices(vocab, [1 + hash_(source, v) for v in range(len(vocab))], k=rng.randrange(40))
        rows.append((i, rng.choice([" ", "\n", ". ", "_1-"]).join(words), rng.choice(["en", "de", None]), source, 1))
    return [*rows, (None, None, "en", "nothing", None), (1, "", "zz", "alone", 1), (2, "rare words only", "yy", "s1", 1), (3, "", "yy", "s2", 1), *rows[:30]]


def hash_(source, v):
    return sum(map(ord, f"{source}{v}")) % 7


def got(spark, rows, least, top):
    out = [tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, DOCS), least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("least, top", [(3, 5), (30, 50)])
def test_matches_brute_force(spark, least, top):
    rows = documents()
    assert got(spark, rows, least, top) == brute(rows, least, top)


def test_blocks_and_slices(spark, monkeypatch):
    """Many blocks of sources and terms, texts cut at blanks, counts given out often: the same rows."""
    for name, v in (("BLOCK", 2), ("BLOCK_ROWS", 16), ("SLICE", 50), ("FLUSH", 3000)):
        monkeypatch.setattr(divergence, name, v)
    rows = documents(4, 300)
    assert got(spark, rows, 3, 7) == brute(rows, 3, 7)


@pytest.mark.parametrize("seed", range(4))
def test_skyband(seed):
    rng = np.random.default_rng(seed)
    n, k = 400, 7
    g, lang = rng.integers(1, 12, n), rng.integers(1, 12, n)
    want = [i for i in range(n) if sum(g[j] >= g[i] and lang[j] <= lang[i] and j < i for j in range(n)) < k]
    assert divergence.skyband(g, lang, k).tolist() == want


def test_empty_table_and_more_columns(spark):
    assert got(spark, [], 1, 5) == set()
    wide = spark.createDataFrame([("a B a", "en", "s", "x", 1, 2), ("b", "en", "t", "y", 1, 2)], "text string, lang string, source string, term string, at int, n int")
    out = {tuple(r) for r in divergence.source_divergence(wide, 1, 5).collect()}
    assert out == brute([(1, "a B a", "en", "s", 1), (2, "b", "en", "t", 1)], 1, 5)


def test_large_counts_are_exact(spark):
    """Counts whose product with the scale exceeds 64 bits."""
    from pyspark.sql import functions as F

    n, total, kept = 10**12 + 7, 3 * 10**13 + 1, 10**6
    got = spark.range(1).select(divergence.smoothed(F.lit(n), F.lit(total), F.lit(kept))).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)
