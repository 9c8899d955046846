import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from shelfspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, packed, capacity=packing.CAPACITY):
    """Each document's ids lie in its pieces, once and in order; sequences are gapless and within capacity."""
    want = {i: whole(t) for i, t in rows}
    got, seqs = {}, {}
    for r in packed:
        got.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
        used += at
    return used, len(seqs)


def test_pieces_and_sequences(spark):
    odd = ["a<|endoftext|>b <|startoftext|>", "don't we'LL  x\ty z\r\n ẃ ́e  é\x1cq", "Ünïcödé ΣΑΣ 的的 🙂 12ab", " \n ", "x" * 9000]
    words = [f"w{i} thé{i % 97}, the" for i in range(9000)]
    rows = [(i, t) for i, t in enumerate([*odd, None, "", " ".join(words), *[" ".join(words[i : i + i * 3 % 700]) for i in range(1, 300)]])]
    packed = packing.pack(spark.createDataFrame(rows, DOCS), PATH, with_ids=True)
    used, n = check(rows, packed.collect())
    assert n * 4096 < 1.06 * used + 4096
    seqs = packing.sequences(packed).collect()
    assert sum(s.length for s in seqs) == used and all(len(s.ids) == 4 * s.length <= 4 * 4096 for s in seqs)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    used, n = check(rows, packing.op9_packing(spark, "/root/testdata/sf0.01").collect())
    assert used == sum(len(whole(t)) for _, t in rows)
    assert n * 4096 - used < 0.05 * used


def test_padding_and_pieces():
    rng = np.random.default_rng(1)
    sizes = np.minimum(rng.lognormal(6, 1, 40000).astype(int) + 1, 60000).tolist()
    bins, tokens, parts = 0, 0, 0
    per_class = {}
    for n in sizes:
        cuts = packing.cut(n)
        assert all(slot >= size for j, size in cuts for slot in [4096 // j])
        for j, size in cuts:
            per_class[j] = per_class.get(j, 0) + 1
            tokens += size
            parts += 1
    bins = sum(-(-k // j) for j, k in per_class.items())
    assert tokens == sum(sizes)
    assert bins * 4096 < 1.05 * tokens and parts < 2.2 * len(sizes)


def test_cut():
    for n in range(1, 5000):
        for slack in (0, 1 / 16, 1):
            parts = packing.cut(n, 64, slack)
            assert sum(s for _, s in parts) == n and all(64 // (j + 1) < s <= 64 // j for j, s in parts)
            if slack == 1:
                assert len(parts) == -(-n // 64)


def test_edges(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], DOCS).selectExpr("*", "1 as start", "2 as `class`", "3 as sequence_id")
    got = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in got) == 6 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
