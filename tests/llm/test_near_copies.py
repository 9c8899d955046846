import random

import pytest

from shelfspark.llm import near_copies as nc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in parent}


def texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    shared = [rng.choice(vocab) for _ in range(30)]
    out = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 300))]
        base[len(base) // 2 : len(base) // 2] = shared if rng.random() < 0.5 else []
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # copies on both sides of 0.8, and chains of them
            base = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            out.append("  ".join(base).upper())
    rng.shuffle(out)
    return [*out, None, "", " \t\n", "One", "one", "one two", "x " * 500, "x " * 900]


@pytest.mark.parametrize(("hot_rows", "rate", "together"), [(16, 16, 256), (2, 1, 1)])
def test_stage_against_brute_force_jaccard(spark, monkeypatch, hot_rows, rate, together):
    monkeypatch.setattr(nc, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(nc, "SAMPLE_RATE", rate)
    monkeypatch.setattr(nc, "TOGETHER", together)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in nc.near_copies(docs).collect()} == want
    assert {r.doc_id for r in nc.simhash_stage(spark, docs, "").collect()} == {i for i in want if want[i] == i}


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "p q r s t"
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in [(None, a), (3, a), (3, b), (5, b), (7, a)]], DOCS)
    assert sorted((r.doc_id or 0, r.component_id) for r in nc.near_copies(docs).collect()) == [(0, 3), (3, 3), (3, 3), (5, 3), (7, 3)]
    assert nc.near_copies(docs.where("false")).count() == 0


def test_stage_on_repeated_and_null_ids(spark):
    a, b, c = "a b c d e f g h", "p q r s t", "k l m n o p q"
    rows = [(None, a), (3, a), (3, b), (5, b), (7, a), (None, c), (None, c), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOCS)
    kept = nc.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, c), (3, a), (3, b), (9, "")]


def test_signature_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 5, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        assert np.bitwise_count((nc.signature(a) ^ nc.signature(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
