import hashlib
import random
import zlib

import pytest

from shelfspark.llm import prefix_trie
from shelfspark.llm.running import running_sums

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The definition, conversation by conversation and prefix by prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    kids, sums = {k: 0 for k in members}, {k: [0, 0] for k in members}
    for k in sorted(members, key=len, reverse=True):
        sums[k][0] += kids[k] == 0
        sums[k][1] += (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        if k:
            kids[k[:-1]] += 1
            sums[k[:-1]][0] += sums[k][0]
            sums[k[:-1]][1] += sums[k][1]
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), kids[k], *sums[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(spark, rows, fold, schema=TURNS):
    nodes = prefix_trie.conversation_trie(spark.createDataFrame(rows, schema), fold).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes}
    assert len(out) == len(nodes)
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(140):
        if rng.random() < 0.1:
            continue
        copy = rng.random() < 0.3
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            text = "same" if copy or turn == 0 else rng.choice(["a", "b", "é" * 3, "", None])
            rows.append((c, turn if rng.random() < 0.95 else None, rng.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("fold", [1, 5, 1000])
def test_matches_brute_force(spark, fold):
    rows = conversations(fold)
    assert got(spark, rows, fold) == brute(rows)


def test_one_conversation_over_many_parts(spark, monkeypatch):
    """A long conversation, and conversations that are its beginnings: a deep chain of branches."""
    rows = [(10, t, "user", f"t{t}") for t in range(400)]
    rows += [(c, t, "user", f"t{t}") for c in range(11, 60) for t in range(c * 3)]
    assert got(spark, rows, 3) == brute(rows)


def test_copies_and_repeated_rows(spark, monkeypatch):
    """Thousands of copies end in one node; rows that repeat are turns of their own; ids in many pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    rows = [(c, t, "user", "hi") for c in range(300) for t in range(9)] + [(7, 3, "user", "hi")] * 20 + [(1000, 0, "a", "x")]
    assert got(spark, rows, 4) == brute(rows)


def test_nulls_empty_tables_and_more_columns(spark):
    rows = [(None, 0, "user", "lost"), (5, None, None, None), (6, 1, "user", None), (6, None, "user", "null turns are first"), (9, 2, "x" * 5000, "y" * 50000)]
    assert got(spark, rows, 2) == brute(rows)
    assert got(spark, [], 2) == {}
    wide = [(*r, "p", 1, 2) for r in rows]
    assert got(spark, wide, 2, TURNS + ", part string, depth long, id long") == brute(rows)


def test_turnless(spark):
    """c takes all of its turns' places from a conversation that is absent."""
    c = next(c for c in range(1, 2000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    want = brute(rows)
    assert list(want) == [(c, 0)]
    assert got(spark, rows, 2) == want


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(5), rng.randrange(100)) for _ in range(3000)]
    out = running_sums(spark.createDataFrame(rows, "g string, o long, v long").repartition(7), ["g"], ["o"], {"s": "v"}).collect()
    for g in "ab":
        mine = sorted((r for r in out if r.g == g), key=lambda r: (r._part, r.s, r.v))
        total = 0
        for r in sorted(mine, key=lambda r: (r.o, r.s, r.v)):
            assert r.s == total
            total += r.v
    assert sorted((r.g, r.o, r.v) for r in out) == sorted(rows)
