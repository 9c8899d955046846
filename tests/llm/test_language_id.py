import random
import zlib

import numpy as np

from shelfspark.llm import language_id as li

DOCS = "doc_id long, text string, lang string"


def brute_nats(model_texts, text):
    """PPM (orders 3 to 0, method C, exclusion) from the definition; the start of a text is a symbol of contexts."""
    counts = {}
    for t in model_texts:
        s = [li.START] * 3 + list(t)
        for i in range(3, len(s)):
            for o in range(4):
                counts.setdefault(tuple(s[i - o : i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - o : i])][s[i]] += 1

    def dist(ctx):
        if ctx is None:
            return {b: 1 / 256 for b in range(256)}
        lower = dist(ctx[1:] if ctx else None)
        own = counts.get(ctx)
        if not own:
            return lower
        n, q = sum(own.values()), len(own)
        left = sum(p for s, p in lower.items() if s not in own)
        return {s: own[s] / (n + q) if s in own else q / (n + q) * p / left for s, p in lower.items()}

    s, total = [li.START] * 3 + list(text), 0.0
    for i in range(3, len(s)):
        total -= np.log(dist(tuple(s[i - 3 : i]))[s[i]])
    return total


def test_code_lengths_follow_the_definition(spark, monkeypatch):
    train = {"aa": [b"abracadabra", b"abab cab", b"a"], "bb": [b"xyz abx zyx", b"zz yx"]}
    rows = [(i, t.decode(), lang) for lang, ts in train.items() for i, t in enumerate(ts)]
    model = li.train(spark.createDataFrame(rows, DOCS))
    texts = [b"abra", b"", b"q", b"zyx\xc3\xa9 abra", b"x", b"y", b"abcxyz" * 9]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    for chunk in (1 << 20, 5, 1):
        monkeypatch.setattr(li, "CHUNK", chunk)
        got = li.code_lengths(model, raw, offs)
        want = [[brute_nats(train[x], t) for x in ("aa", "bb")] for t in texts]
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_query_against_brute_force(spark, tmp_path):
    """lang_pred and score of whole texts, learned from the rows that are not held out."""
    rng = random.Random(4)
    sounds = {"en": "the ing and ver wh ough", "de": "sch ein ung ich über", "fr": "eau oui ça ent les"}
    rows = []
    for i in range(120):
        lang = rng.choice(list(sounds))
        text = "".join(rng.choice(sounds[lang].split()) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 60)))
        rows.append((i if i % 30 else None, text, lang if i % 5 else None))
    rows += [(200, None, "en"), (201, "", "en"), (202, "1 2 3", "de"), (203, "QZ 1", None), (204, "это", None), (1, "the the", "fr")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2 for i, *_ in rows]
    names = sorted(sounds)
    taught = {x: [t.encode() for (_, t, lang), h in zip(rows, held, strict=True) if lang == x and t and not h] for x in names}
    want = []
    for (i, t, _), h in zip(rows, held, strict=True):
        nats = np.array([brute_nats(taught[x], (t or "").encode()) for x in names])
        letters = any(c.isalpha() for c in t or "")
        best = int(nats.argmin())
        want.append((-1 if i is None else i, h, names[best] if letters else "und", round(1 / np.exp(nats.min() - nats).sum(), 3) if letters else 0.0))
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, round(r.score, 3)) for r in li.op2_language_id(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_many_languages_keep_all_contexts(spark):
    """No context of the sample is given up, however many languages there are."""
    rng = random.Random(8)
    texts = {f"l{k}": ["".join(rng.choice("abcdefghijklmnop" if k % 2 else "ijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(3)] for k in range(40)}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    model = li.train(spark.createDataFrame(rows, DOCS))
    seen = {tuple(s[i - 3 : i + 1]) for ts in texts.values() for t in ts for s in [[li.START] * 3 + list(t.encode())] for i in range(3, len(s))}
    assert len(model.costs[3].starts) - 1 == len(seen)
    some = [ts[0].encode() for ts in texts.values()]
    got = li.code_lengths(model, np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
    assert got.argmin(1).tolist() == [model.languages.index(x) for x in texts]
    assert np.allclose(got[3, 7], brute_nats([t.encode() for t in texts[model.languages[7]]], some[3]), rtol=1e-4)


def test_held_out_accuracy(spark):
    docs = li.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = docs.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 !", "en"), (None, "the cat", "en"), (5, "的", None), (6, "the " * 30000, "en"), (6, "the cat", "en")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as lang_pred", "2 as score", "3 as _l")
    model = li.train(docs)
    got = [(r.doc_id, r.lang_pred) for r in li.identify(docs, model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "en"), (6, "en"), (6, "en")]
    nothing = li.train(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in li.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert li.identify(docs.where("false"), model).count() == 0
    kept = li.language_stage(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 5, 6, 6]


def test_two_hundred_languages_are_kept_by_what_each_has_seen():
    """Codes that a language has not seen take no room: 200 languages of one alphabet each against the same counts in one."""
    rng = np.random.default_rng(3)
    n = 200_000
    codes = np.unique(rng.integers(0, 60, (n, 4)) @ np.array([li.BASE**3, li.BASE**2, li.BASE, 1]))
    which = rng.integers(0, 200, len(codes))
    many = li.build([f"l{i:03}" for i in range(200)], which, codes, np.ones(len(codes), np.int64))
    one = li.build(["l"], np.zeros(len(codes), np.int64), codes, np.ones(len(codes), np.int64))
    assert many.nbytes() < 3 * one.nbytes()
    assert many.nbytes() < 120 * len(codes)
    some = codes[:500]
    wide = many.cost(some)
    assert wide.shape == (500, 200) and (wide[np.arange(500), which[:500]] <= wide.min(1) + 5).all()


def test_a_long_labelled_text_counts_by_its_bytes(spark):
    rows = [(i, "short text " * 3, "a") for i in range(50)] + [(i, f"{chr(200 + i)} long " * 20000, "b") for i in range(100, 140)]
    docs = spark.createDataFrame(rows, DOCS)
    small, whole = li.train(docs, max_bytes=1_000_000), li.train(docs)
    assert small.languages == whole.languages == ["a", "b"]
    texts = [t.encode() for _, t, lang in rows if lang == "b"]
    known = lambda m: sum(bool((m.costs[0].places.find(np.frombuffer(t[1:2], np.uint8).astype(np.int64)) >= 0).all()) for t in texts)
    assert 0 < known(small) < known(whole) == 40
