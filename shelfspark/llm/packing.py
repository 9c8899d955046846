"""Harmonic packing of token sequences.

Piece lengths come in reciprocal classes of the capacity C: class j holds lengths in (C / (j + 1), C / j], and exactly j
pieces fill a bin of it. A document over C gives whole bins first. What is left of it, as any shorter document, goes whole into
its class if its slot of floor(C / j) tokens wastes no more than the share `slack`; else it is cut once to the slot of
the next class, and the rest goes on. Rests are short, and short classes lie close together, so most documents stay whole or
give two pieces; padding is under `slack` in each full bin (slack 1 never cuts within a bin, slack 0 leaves next to
no padding). Bins of a class need nothing but the running number of a piece in its class. The number is found in two steps,
independently in salted parts of each class and then by adding up the parts' counts, so no class is gathered anywhere.
Each class has at most one bin that is not full (fewer than 2 * sqrt(C) in all, however large the table); these are put
together, first fit, the fullest first.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import partitions, prepare, scratch, table

CAPACITY = 4096
END_ID = 2
#: Most of a slot that a piece may leave empty.
SLACK = 1 / 16
#: Most cached strings in a worker; the cache starts anew beyond.
CACHE = 250_000
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable ASCII and the precomposed Latin letters, whose lower case and normal form are the same everywhere.
LATIN = re.compile("[!-~À-įı-ſ]*")
LATIN_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")
_tokenizers: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """A tokenizer of the `tokenizers` library that drops white space between pre-tokens, with a cache.

    Such a tokenizer encodes the parts between blanks and line feeds independently, so each distinct part is
    encoded once and kept as bytes (little-endian, 32 bits an id). A lower-casing byte-level BPE with word ends also
    has a faster way for parts in Latin script: the same merges as byte ranks, in which byte 0xFF, which no UTF-8 text
    has, is the word end. All other parts go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        usual = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"].get("Regex") == SPLIT
        self.ranks = self._ranks(spec["model"]) if usual and spec["model"].get("end_of_word_suffix") == "</w>" else None

    def _ranks(self, model: dict):
        """A byte BPE with the same merges, and the ids of its ranks."""
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}

        def raw(piece: str) -> bytes:
            end = piece.endswith("</w>") and len(piece) > 4
            return bytes(names[c] for c in (piece[:-4] if end else piece)) + b"\xff" * end

        vocab = model["vocab"]
        order = [raw(c + "</w>") for c in names]
        order += [raw(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        order += [bytes([b]) for b in range(256)]
        ranks = {piece: i for i, piece in enumerate(dict.fromkeys(order))}
        ids = np.zeros(len(ranks), "<u4")
        for name, i in vocab.items():
            if all(c in names for c in name.removesuffix("</w>")) and (r := ranks.get(raw(name))) is not None:
                ids[r] = i
        self.ids = ids
        return tiktoken.Encoding("byte ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _encode_new(self, new: list[str]) -> None:
        cache, rest = self.cache, new
        if self.ranks is not None:
            rest, single, latin, pieces, ids = [], self.ranks.encode_single_piece, LATIN.fullmatch, LATIN_SPLIT.findall, self.ids
            flat, ends, names = [], [], []
            for part in new:
                if latin(part) and "<|" not in part:
                    for word in pieces(part.lower()):
                        flat += single(word.encode() + b"\xff")
                    ends.append(4 * len(flat))
                    names.append(part)
                else:
                    rest.append(part)
            data, at = ids[np.array(flat, np.int64)].tobytes(), 0
            for part, end in zip(names, ends, strict=True):
                cache[part] = data[at:end]
                at = end
        for at in range(0, len(rest), 2000):
            some = rest[at : at + 2000]
            cache.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache = {"": b""}
        parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
        cache = self.cache
        self._encode_new(list({p for part in parts for p in part if p not in cache}))
        return [b"".join([cache[p] for p in part]) for part in parts]


def worker_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this process, whose cache lasts from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def cut(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[tuple[int, int]]:
    """(class j, length) of the pieces of a document of n tokens, in order."""
    out = [(1, capacity)] * (n // capacity)
    n %= capacity
    while n:
        j = capacity // n
        slot = capacity // j
        if slot - n <= slack * slot:
            out.append((j, n))
            break
        size = capacity // (j + 1)
        out.append((capacity // size, size))
        n -= size
    return out


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, class (and ids, binary, if asked for). Null text: empty."""
    ident = docs.schema[id_col]
    fields = [ident, *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "class")]]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        tok = worker_tokenizer(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                row, cols, ids = [], [], []
                for i, data in enumerate(tok.encode(b.column(1).to_pylist())):
                    data += end
                    total, start = len(data) // 4, 0
                    for j, size in cut(total, capacity):
                        piece = data[4 * start : 4 * (start + size)]
                        row.append(i)
                        cols.append((start, size, zlib.crc32(piece), total, j))
                        if with_ids:
                            ids.append(piece)
                        start += size
                values = np.array(cols, np.int64).reshape(-1, 5)
                arrays = [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(values[:, k]) for k in range(5)]]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.binary())] if with_ids else [])], [f.name for f in schema.fields])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def place(cut_pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces (which must not change when read twice: a written table)."""
    spark = cut_pieces.sparkSession
    salts = salts or max(64, partitions(spark))
    salted = cut_pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("class", "_salt").agg(F.count("*").alias("_n"))  # at most classes x salts rows
    before = Window.partitionBy("class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = Window.partitionBy("class", "_salt").orderBy(id_col, "start", "ids_crc32")
    numbered = salted.withColumn("_rank", F.row_number().over(rank) - 1).join(F.broadcast(offsets), ["class", "_salt"])
    number = F.col("_rank") + F.col("_before")
    placed = numbered.withColumn("_number", number).withColumn("sequence_id", F.floor(number / F.col("class")) * (capacity + 1) + F.col("class"))
    inside = Window.partitionBy("sequence_id").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)  # a bin: as many rows as its class says
    placed = scratch(placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("_salt", "_rank", "_before", "_number"))
    # at most one bin a class: a few rows
    sizes = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("_n").alias("n")).collect()}
    last = [(n // j) * (capacity + 1) + j for j, n in sizes.items() if n % j]
    if not last:
        return placed
    filled = placed.where(F.col("sequence_id").isin(last)).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    moved = spark.createDataFrame(first_fit([(r["sequence_id"], r["n"]) for r in filled], capacity), "sequence_id long, _to long, _base long")
    joined = placed.join(F.broadcast(moved), "sequence_id", "left")
    return joined.withColumns({"sequence_id": F.coalesce("_to", "sequence_id"), "offset": F.col("offset") + F.coalesce("_base", F.lit(0))}).select(*placed.columns)


def first_fit(bins: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(bin, tokens) -> (bin, bin that takes its pieces, tokens before them), the fullest first."""
    out, hosts = [], []
    for name, n in sorted(bins, key=lambda b: (-b[1], b[0])):
        host = next((h for h in hosts if h[1] + n <= capacity), None)
        if host is None:
            hosts.append(host := [name, 0])
        out.append((name, host[0], host[1]))
        host[1] += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs -> their pieces with sequence_id and offset.

    sequence_id names class and bin: bin * (capacity + 1) + class. A repeated row is packed as often as it comes, a
    null text is the end token alone, a null id is kept. with_ids adds the token ids of each piece; sequences(...)
    puts them together.
    """
    return place(scratch(pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids)), id_col, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids (binary): the filled sequences of pack(..., with_ids=True); at most capacity tokens each."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.unhex(joined).alias("ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    import public_tokenizers

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("class")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: packs all that is left."""
    import public_tokenizers

    prepare(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("class")
