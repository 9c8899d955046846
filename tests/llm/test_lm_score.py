import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from shelfspark.llm import lm_score

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def segmentations(pieces, s):
    """Every way to write s, as lists of pieces."""
    if not s:
        yield []
        return
    for i in range(1, len(s) + 1):
        if s[:i] in pieces:
            yield from ([s[:i], *rest] for rest in segmentations(pieces, s[i:]))
    if s[0] not in pieces:
        yield from ([*[f"<0x{b:02X}>" for b in s[0].encode()], *rest] for rest in segmentations(pieces, s[1:]))


def brute_probability(probs, s):
    return sum(math.prod(probs[p] for p in way) for way in segmentations(probs, s))


def brute_learn(counts, ends, names, rounds):
    """Expectation maximisation by enumeration: probabilities of the pieces, and of an end."""
    probs, end = dict.fromkeys(names, 1 / (len(names) + 1)), 1 / (len(names) + 1)
    for _ in range(rounds):
        n = dict.fromkeys(names, 1.0)
        for w, c in counts.items():
            whole = brute_probability(probs, "▁" + w)
            for way in segmentations(probs, "▁" + w):
                for p in way:
                    n[p] += c * math.prod(probs[q] for q in way) / whole
        total = sum(n.values()) + ends + 1
        probs, end = {p: x / total for p, x in n.items()}, (ends + 1) / total
    return probs, end


TOY = {p: x for p, x in {"▁": 0.1, "▁a": 0.1, "a": 0.2, "b": 0.1, "ab": 0.1, "aba": 0.05, "▁ab": 0.05}.items()} | {f"<0x{b:02X}>": math.exp(-7) for b in range(256)}


@pytest.mark.parametrize("short", [64, 0])
def test_lattice_sums_all_segmentations(monkeypatch, short):
    monkeypatch.setattr(lm_score, "SHORT", short)
    monkeypatch.setattr(lm_score, "TOGETHER", 3)
    lattice = lm_score.Lattice(list(TOY))
    scores = np.append(np.log(list(TOY.values())), -25.0)
    some = ["a", "abab", "abaé", "q", "aababa", "€", "a𝄞b", "", "\x1f", "bé"]
    weights = np.arange(1.0, len(some) + 1)
    got, counts = lattice.run(some, scores, weights)
    want = Counter()
    for w, k, x in zip(some, weights, got, strict=True):
        whole = brute_probability(TOY, "▁" + w)
        assert x == pytest.approx(math.log(whole))
        for way in segmentations(TOY, "▁" + w):
            for p in way:
                want[p] += k * math.prod(TOY[q] for q in way) / whole
    assert counts[:-1] == pytest.approx([want[p] for p in TOY])
    assert math.isfinite(lattice.run(["ab" * 20000], scores)[0][0])


@pytest.mark.parametrize("hot, flush", [(0, 50), (3, 1 << 25), (200_000, 1 << 25)])
def test_against_brute_force(spark, monkeypatch, hot, flush):
    """Words over SHORT are joined, however few words there are; counts are given out by bytes too."""
    monkeypatch.setattr(lm_score, "FLUSH_BYTES", flush)
    names = [*TOY, "the", "▁t", "he", "t", "h", "e", "c", "▁cat", "at", "s"]
    monkeypatch.setattr(lm_score, "HOT", hot)
    monkeypatch.setattr(lm_score, "vocabulary", lambda path: names)
    texts = ["The cat sat on the mat", "the CAT", None, "", "un\x1cseen\twörds\nhere the", "the " * 300, "zzqx zzqx", "the cat", "ab" * 9, "the" * 6]
    monkeypatch.setattr(lm_score, "SHORT", 12)
    rows = [(i if i != 7 else 1, t) for i, t in enumerate(texts)] + [(None, "cat")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as n", "2 as word", "3 as row")
    taught = [t for i, t in rows if i is not None and i < 5]
    seen, ends = Counter(w for t in taught for w in words(t)), len(taught)
    n, v = sum(seen.values()) + ends, len(seen) + 1
    probs, end = brute_learn(seen, ends, names, 2)
    want = []
    for i, t in rows:
        ws = words(t)
        base = sum(math.log10((c + 1) / (n * 1.0 + v + 1)) for c in [*(seen[w] for w in ws), ends])
        full = sum(math.log10(brute_probability(probs, "▁" + w)) for w in ws) + math.log10(end)
        want.append((i or -1, len(ws) + 1, sum(seen[w] > 0 for w in ws) + 1, n, round(base, 6), round(full, 6)))
    learn = docs.doc_id.isNotNull() & (docs.doc_id < 5)
    got = lm_score.score_documents(docs, learn, "", rounds=2).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a")], DOCS)
    assert lm_score.score_documents(docs.where("false"), docs.doc_id > 0, MODEL).count() == 0
    (r,) = lm_score.score_documents(docs, docs.doc_id < 0, MODEL).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_held_out(spark):
    rows = lm_score.op8_lm_score(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    # learning makes held-out texts likelier than pieces that are all alike
    (docs, learn) = lm_score.table(spark, "/root/testdata/sf0.01", "documents"), lm_score.crc_mod("doc_id", 7) != 2
    flat = {r.doc_id: r.score for r in lm_score.score_documents(docs, learn, MODEL, rounds=0).collect()}
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(flat[r.doc_id] for r in held)
