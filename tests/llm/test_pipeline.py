import os
import random

import numpy as np
from test_line_dedup import brute as brute_lines
from test_near_copies import brute as brute_copies
from test_packing import check

import corpus_pipeline
from shelfspark.llm import language_id
from shelfspark.llm._common import shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(9)
    en, de = [f"the{i} " for i in range(300)], [f"schön{i} " for i in range(300)]
    items = [(i, "".join(rng.choice(en) for _ in range(rng.randint(12, 40)))) for i in range(5)]
    rows = []
    for i in range(90):
        lang, words = (("en", en), ("de", de))[i % 3 == 0]
        lines = ["".join(rng.choice(words) for _ in range(rng.randint(3, 40))).strip() for _ in range(rng.randint(1, 6))]
        if rows and rng.random() < 0.3:
            other = rng.choice(rows)[1].split("\n")
            lines = other if rng.random() < 0.5 else [*other[:4], *lines]
        if rng.random() < 0.15:
            lines[0] += " " + rng.choice(items)[1]
        rows.append((i, "\n".join(lines), lang if i % 7 else None, "s", 0))
    rows += [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "123 456", "en", "s", 0)]
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def shingles(text):
    words = [w for w in __import__("regex").split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    rows, items = make(spark, tmp_path)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {i: t for i, t, *_ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        out = spark.read.parquet(f"{tmp_path}/out{k}")
        got = {r.doc_id: r.text for r in out.collect()} if k < 4 else out.collect()
        if name == "language_id":
            held = {i for i, *_ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2}
            model = language_id.train(docs.where(~docs.doc_id.isin(list(held))))
            want = {}
            for i, t in kept.items():
                raw = np.frombuffer((t or "").encode(), np.uint8)
                nats = language_id.code_lengths(model, raw, np.array([0, len(raw)]))[0]
                if t and any(c.isalpha() for c in t) and 1 / np.exp(-(nats - nats.min())).sum() >= 0.5:
                    want[i] = t
        elif name == "line_dedup":
            want = {i: t for i, t in brute_lines(list(kept.items()), 3, 200).items() if t == kept[i] or t.strip()}
            assert {r.doc_id: r.n_chars for r in out.collect()} == {i: len(t) for i, t in want.items()}
        elif name == "simhash":
            parts = brute_copies(list(kept.items()))
            want = {i: t for i, t in kept.items() if parts[i] == i}
        elif name == "decontamination":
            tests = [shingles(t) for _, t in items]
            want = {i: t for i, t in kept.items() if not any(s and len(s & shingles(t)) >= 0.8 * len(s) for s in tests)}
        else:
            check(list(kept.items()), got)
            continue
        assert got == want and out.columns == docs.columns
        assert 0 < len(got) < len(kept) or name == "line_dedup" and got != kept
        docs, kept = out, want


def test_run_leaves_its_result_only(spark, tmp_path):
    make(spark, tmp_path)
    home = shared_dir(spark)
    before = set(os.listdir(home))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    (folder,) = set(os.listdir(home)) - before
    assert [f for f in os.listdir(f"{home}/{folder}") if not f.startswith(".")] == ["packing"]
    assert out.count()


def test_stages_chained_without_a_write(spark, tmp_path):
    """Stages that are called on each other's results before anything is read give what run() gives."""
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    want = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, docs.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_a_run_leaves_other_results_alone(spark, tmp_path):
    """Scratch tables of a result that has not been read yet outlive a whole run."""
    from shelfspark.llm.line_dedup import op5_line_dedup

    rows, _ = make(spark, tmp_path)
    lazy = op5_line_dedup(spark, str(tmp_path))
    corpus_pipeline.run(spark, str(tmp_path))
    corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count()
    assert lazy.count() == len(rows)


def test_decontamination_sees_rows_without_an_id(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "x " + words, None, "s", 1), (None, "clean text of some words here", None, "s", 1), (4, words, None, "s", 1), (4, "other words", None, "s", 1)], DOCS)
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, str(tmp_path))
    assert sorted(r.text for r in kept.collect()) == ["clean text of some words here", "other words"]
