import hashlib
import random

import pytest

from shelfspark.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts, depth):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for t in data:
        for s in range(len(t) - depth + 1):
            seen[t[s : s + depth]] = seen.get(t[s : s + depth], 0) + 1
    out = []
    for t in data:
        gone = bytearray(len(t) + 1)
        for s in range(len(t) - depth + 1):
            if seen[t[s : s + depth]] > 1:
                gone[s : s + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "δέλτα", "eps", "a", "bb", "zeta\n"]
    long = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(k))
    passages = [long(rng.randint(20, 60)) for _ in range(6)]
    texts = [None, "", "x", "ab" * 400, "x" * 900, long(2000)]
    for _ in range(n):
        parts = [long(rng.randint(0, 30)) for _ in range(rng.randint(1, 4))]
        for i in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 60) if rng.random() < 0.4 else 0
            parts.insert(rng.randint(0, len(parts)), p[a:] if rng.random() < 0.8 else p.replace("gamma", "GAMMA", 1))
        texts.append(" ".join(parts))
    return [*texts, *texts[6:9]]


@pytest.mark.parametrize(("cap", "chunk", "depth"), [(20_000, 1 << 20, 200), (4, 1500, 200), (20_000, 700, 90)])
def test_against_brute_force(spark, monkeypatch, cap, chunk, depth):
    monkeypatch.setattr(sd, "CHUNK", chunk)
    texts = corpus(depth, 120)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    if chunk != 1 << 20:  # workers import the module anew: the small chunks are tried here
        import numpy as np

        data = [(t or "").encode() for t in texts]
        raw, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
        covered = {}
        for d, s, n, *_ in sd.anchors(raw, offs, depth):
            for x, y, z in zip(d.tolist(), s.tolist(), n.tolist(), strict=True):
                for w in range(y, y + z):
                    covered[x, w] = covered.get((x, w), 0) + 1
        assert covered == {(i, w): 1 for i, t in enumerate(data) for w in range(len(t) - depth + 1)}
    got = sorted(sd.drop_repeats(docs, depth, group_cap=cap).collect())
    want = brute(texts, depth)
    assert [tuple(r[1:]) for r in got] == want
    assert sum(w[1] > 0 for w in want) > 20


def test_edges(spark):
    assert sd.drop_repeats(spark.createDataFrame([], DOCS)).count() == 0
    t = "".join(random.Random(2).choice("abcdef") for _ in range(230))
    rows = [(1, t, None, None, None), (1, t, None, None, None), (None, t[:199], None, None, None), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as h", "3 as start", "4 as id")
    got = sorted((r.n_bytes, r.n_removed) for r in sd.drop_repeats(docs, with_kept=True).collect())
    assert got == [(0, 0), (199, 0), (230, 230), (230, 230)]


def test_a_collision_of_the_first_hash_removes_nothing(monkeypatch):
    """With a first hash that only sees lengths, windows are equal by the second."""
    import numpy as np

    monkeypatch.setattr(sd, "_BYTES", [np.full(256, 7, np.uint64), sd._BYTES[1]])
    raw = np.frombuffer(b"abcdefgh" + b"abcdefgX" + b"abcdefgh", np.uint8)
    begin, n, one = np.array([0, 8, 16]), np.array([1, 1, 1]), np.ones(3, np.int64)
    row, win = sd.repeated_windows(raw, begin, n, np.zeros(3, np.int64), np.zeros(3, np.int64), one, 8)
    assert row.tolist() == [0, 2] and win.tolist() == [0, 0]
