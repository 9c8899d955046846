import random

import numpy as np
import pytest
import xxhash

from shelfspark.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, bits=4):
    parent = {i: i for i, _ in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, f in items:
        for j, g in items:
            if i < j and (f ^ g).bit_count() <= bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in items}


def texts():
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)]
    out = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(vocab)
            out.append("\n".join(other).upper().replace("É", "é"))
    return [*out, *out[:5], None, "", " \t\n", "One", "one  two", "x " * 5000, "  a b c d"]


def test_matches_brute_force(spark):
    rows = [(i, t, None, "s", None) for i, t in enumerate(texts())]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    want = brute_components(fps)
    assert got == {i: (f, want[i]) for i, f in fps}


@pytest.mark.parametrize("cap", [3, 200_000])
def test_links_keep_the_components_of_all_pairs(spark, cap):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = [0, 15]
    for c in centres.tolist():  # clusters in which most members are near, and chains that leave the ball
        x = c
        for _ in range(40):
            y = x if rng.random() < 0.3 else c
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False).tolist():
                y ^= 1 << b
            fps.append(y)
            x = y
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, group_cap=cap).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {x: x for x in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert {x: root(x) for x in fps} == brute_components([(x, x) for x in fps])


def test_trie_join_links_one_large_group():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 9, 300, dtype=np.uint64) | np.uint64(1 << 40))
    links = simhash.trie_join(fps, 4)
    assert len(links) == len(fps) - 1


def test_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e", None, None, None), (3, "a b c d e", "x", None, 1), (3, "a b c d e", "x", None, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3)]
    clash = docs.selectExpr("*", "1 as fp", "2 as component_id", "3 as a", "4 as t")
    assert simhash.near_duplicates(clash).count() == 3
