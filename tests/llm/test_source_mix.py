import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm.source_mix import mix_sources, source_targets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        among = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / among > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / among for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in order if s not in free)
    return target


def documents(seed=3):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "\U0001f600", "", None, "tiny", "￿"]
    rows = [(i, " ".join(["w"] * min(900, int(rng.paretovariate(0.9)))), "en", rng.choice(sources[:7] + ["a"] * 4), 1) for i in range(900)]
    rows += [(1000, "one", "en", "tiny", 1), (1001, None, None, "￿", None), (1002, " \t\n\x0b", None, "￿", None), (1003, "x\x1cy z w \x85 q", None, None, None)]
    return [*rows, *rows[:40], (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (2000, "x " * 20000, "en", "b", 1)]


def result(spark, rows, **more):
    out = mix_sources(spark.createDataFrame(rows, DOCS), **more).collect()
    assert len(out) == len(rows)
    return out


def test_sizes_targets_and_words_taken(spark):
    rows = documents()
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = brute_targets(dict(sizes))
    got = result(spark, rows)
    by_size = Counter((r.doc_id, r.size, r.source_size) for r in got)
    assert by_size == Counter((d, len(WORDS.findall(t or "")), sizes[s]) for d, t, _, s, _ in rows)
    targets = {r.source_size: r.target for r in got}
    assert len(set(sizes.values())) == len(sizes)  # so that the size names the source
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size] += r.taken
    for s, n in sizes.items():
        assert targets[n] == pytest.approx(want[s])
        assert taken[n] == round(want[s])


def test_runs_agree(spark):
    rows = documents(5)
    other = rows[:]
    random.Random(1).shuffle(other)
    a, b = (Counter(tuple(r) for r in result(spark, x)) for x in (rows, other))
    assert a == b


def test_all_but_one_document_are_whole_copies(spark):
    rows = [(i, "w " * (i % 30 + 1), "en", "ab"[i % 2], 1) for i in range(400)]
    odd = Counter(r.source_size for r in result(spark, rows) if r.taken % r.size)
    assert all(n <= 1 for n in odd.values())


def test_inclusion_is_even(spark):
    """Equal documents of one source: the share that is taken twice is the probability, wherever they stand."""
    rows = [(i, "w w", "en", "only", 1) for i in range(4000)]
    twice = [r.doc_id for r in result(spark, rows) if r.taken == 4]
    assert len(twice) == 2000
    assert abs(sum(i < 2000 for i in twice) - 1000) < 100


def test_weights_of_documents(spark):
    """Unequal probabilities: heavy documents stop at two copies, the others share what is left in proportion."""
    rows = [(i, "w " * 10, "en", "s", 1) for i in range(3000)]
    weight = F.when(F.col("doc_id") < 500, 50.0).when(F.col("doc_id") < 1500, 2.0).otherwise(1.0)
    got = result(spark, rows, weight=weight)
    assert sum(r.taken for r in got) == 45000
    of = lambda a, b: sum(r.taken for r in got if a <= r.doc_id < b) / 10
    assert of(0, 500) == 1000
    c = (4500 - 1000) / (1000 * 2 + 1500)
    assert abs(of(500, 1500) - 1000 * 2 * c) < 120 and abs(of(1500, 3000) - 1500 * c) < 120


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"s{i:03}": rng.choice([0, 1, 5, 10_000_000_000, rng.randrange(1000)]) for i in range(300)}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_empty_and_wordless_tables_and_more_columns(spark):
    assert result(spark, []) == []
    assert [(r.size, r.target, r.taken) for r in result(spark, [(1, None, None, None, None), (2, " ", "x", "y", 1)])] == [(0, 0.0, 0)] * 2
    wide = spark.createDataFrame([(1, "a b", "s", 1, 2, 3.0, "x")], "doc_id int, text string, source string, size int, at int, u double, target string")
    assert [(r.doc_id, r.size, r.target, r.taken) for r in mix_sources(wide).collect()] == [(1, 2, 3.0, 3)]
