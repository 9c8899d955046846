"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language, orders 3 to 0 and a uniform order below. A symbol that a
context has not seen costs the context's escape (method C: distinct / (count + distinct)) and then its share of the
shorter context's distribution over the symbols that the longer one has not seen. The statistics are frozen after
training, so the cost of a byte depends on the three bytes before it alone.

The trees are kept sparsely, in bytes and in languages: for each order the cost of each (string of bytes, language) pair that
was seen, and the escape of each (context, language) pair. A pair that was not seen costs its context's escape and then what
the shorter string costs, so nothing is left out. A seen pair takes 6 bytes and a string 20 to 40 more, on the driver and on each worker,
however many languages there are; a task widens only the distinct strings of the chunk at hand. What is seen follows the
sample: training reads about max_docs labelled rows and at most about max_bytes of text a language (all where there is no
more), chosen by a hash of the row, whole texts; the counts are aggregated by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import crc_mod, prepare, table, text_bytes

START, BASE = 256, 257
#: Bytes of text worked on at once, and most cells of (bytes or strings, languages) then.
CHUNK, CELLS = 1 << 20, 1 << 23


class _Places:
    """key -> place in a sorted array of distinct keys, -1 for others: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.mask = (1 << max(4, int(2 * len(keys)).bit_length())) - 1
        self.keys, self.at = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] == -1)
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]], self.at[slot[placed]] = keys[left[placed]], left[placed]
            stay = np.ones(len(left), bool)
            stay[placed] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.at[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.at[slot[left[same]]]
            left = left[~same & (there != -1)]
        return out


class _Pairs:
    """Values of (string, language) pairs, sorted by string: a row of pairs for each string."""

    def __init__(self, strings: np.ndarray, langs: np.ndarray, values: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]])) if len(strings) else np.zeros(0, np.int64)
        self.places, self.starts = _Places(strings[first]), np.append(first, len(strings)).astype(np.int64)
        self.langs, self.values = langs.astype(np.uint16), values.astype(np.float32)

    def rows(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in strings, language, value) of all pairs of these strings."""
        at = self.places.find(strings)
        there = np.flatnonzero(at >= 0)
        low, n = self.starts[at[there]], np.diff(self.starts)[at[there]]
        flat = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(there) else np.zeros(0, np.int64)
        return np.repeat(there, n), self.langs[flat].astype(np.int64), self.values[flat]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.places.keys, self.places.at, self.starts, self.langs, self.values))


@dataclass
class PpmModel:
    languages: list[str]
    costs: list[_Pairs]  # by order: nats of strings of order + 1 bytes
    escapes: list[_Pairs]  # by order: nats of contexts of order bytes

    def cost(self, codes: np.ndarray, order: int = 3) -> np.ndarray:
        """Nats of the last byte of each string of order + 1 bytes, for each language."""
        if order < 0:
            return np.full((len(codes), len(self.languages)), np.log(256), np.float32)
        which, shorter = pd.factorize(codes % BASE**order if order else codes)
        out = self.cost(shorter, order - 1)[which]
        row, lang, nats = self.escapes[order].rows(codes // BASE)
        out[row, lang] += nats
        row, lang, nats = self.costs[order].rows(codes)
        out[row, lang] = nats
        return out

    def nbytes(self) -> int:
        return sum(x.nbytes() for x in [*self.costs, *self.escapes])


def _ngram_codes(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte: the three symbols before it (START outside the text) and itself, as one number."""
    n = len(raw)
    code, doc_start = raw.astype(np.int64), np.repeat(offs[:-1], np.diff(offs))
    at = np.arange(n) - doc_start
    for back, scale in ((1, BASE), (2, BASE**2), (3, BASE**3)):
        prev = np.full(n, START, np.int64)
        prev[back:] = raw[: max(n - back, 0)]
        code += np.where(at >= back, prev, START) * scale
    return code


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 2000, max_bytes: int = 32 << 20) -> PpmModel:
    """Rows with a null or empty text or a null language teach nothing. Without any row the model knows no language."""
    named = labelled.select(F.col(id_col).cast("string").alias("_i"), F.col(lang_col).alias("_l"), F.col(text_col).alias("_t")).where("_l is not null and length(_t) > 0")
    # a row is in the sample by its own hash, at a rate set by its language's count: no ranking, no large group.
    # Broadcast: one row a language, as many as the model has columns
    most = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.count("*"), F.lit(float(max_bytes)) / F.sum(F.octet_length("_t").cast("double")))
    rates = named.groupBy("_l").agg((F.lit(2.0**63) * most).alias("_r"))
    rows = named.join(F.broadcast(rates), "_l").where(F.abs(F.xxhash64("_i", "_t").cast("double")) <= F.col("_r")).select("_l", "_t")

    def count(batches):
        for b in batches:
            langs = np.array(b.column("_l").to_pylist(), object)
            for lang in sorted(set(langs)):
                raw, offs = text_bytes(b.column("_t").filter(pa.array(langs == lang)))
                codes, n = np.unique(_ngram_codes(raw, offs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # bounded by the sample: max_docs texts and about max_bytes a language
    named = got.column("lang").combine_chunks().dictionary_encode()
    return build(named.dictionary.to_pylist(), named.indices.to_numpy(), got.column("code").to_numpy(), got.column("n").to_numpy())


def build(names: list[str], which: np.ndarray, codes: np.ndarray, n: np.ndarray) -> PpmModel:
    """The frozen trees from counts n of (place of the language in names, three bytes of context and a byte)."""
    languages = sorted(names)
    model, nl = PpmModel(languages, [], []), len(languages)
    li = np.array([languages.index(x) for x in names], np.int64)[which]
    lower = shorter = None  # nats of the pairs of the order before, sorted
    for order in range(4 if nl else 0):
        pairs, where = np.unique(codes % BASE ** (order + 1) * nl + li, return_inverse=True)
        count = np.bincount(where, n)
        gram, lang = pairs // nl, pairs % nl
        contexts, c = np.unique(gram // BASE * nl + lang, return_inverse=True)
        # the language has seen the shorter string too
        short = np.full(len(pairs), np.log(256)) if order == 0 else lower[np.searchsorted(shorter, gram % BASE**order * nl + lang)]
        total, distinct, covered = np.bincount(c, count), np.bincount(c), np.bincount(c, np.exp(-short))
        # the shorter context's share of what this one has not seen
        escape = -np.log(distinct / (total + distinct)) + np.log(np.maximum(1 - covered, 1e-12))
        lower, shorter = -np.log(count / (total + distinct)[c]), pairs
        model.costs.append(_Pairs(gram, lang, lower))
        model.escapes.append(_Pairs(contexts // nl, contexts % nl, escape))
    return model


def code_lengths(model: PpmModel, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Nats of each text under each language; works through the bytes in chunks, whatever a text's length."""
    n_docs, nl = len(offs) - 1, len(model.languages)
    out = np.zeros((n_docs, nl))
    chunk = max(1, min(CHUNK, CELLS // max(1, nl)))
    for a in range(0, len(raw), chunk):
        b = min(a + chunk, len(raw))
        lo = max(0, a - 3)
        first, last = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b, "left")
        own = np.clip(offs[np.searchsorted(offs, lo, "right") - 1 : last + 1], lo, b) - lo
        which, codes = pd.factorize(_ngram_codes(raw[lo:b], own)[a - lo :])  # the first codes lack what is before lo
        rows = model.cost(codes)[which]
        docs = np.arange(first, last)
        docs = docs[np.diff(offs)[docs] > 0]
        out[docs] += np.add.reduceat(rows, np.maximum(offs[docs] - a, 0), axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (posterior of the best language, 0 to 1) and bits_per_byte; other columns stay.

    `und` with score 0 for a null text, a text without a letter, or a model without languages. Ties go to the
    language that sorts first. Columns of the same names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("lang_pred", "score", "bits_per_byte")
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def predict(batches):
        m = held.value
        for b in batches:
            column = b.column(text_col)
            raw, offs = text_bytes(column)
            letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
            has = letter[offs[1:]] > letter[offs[:-1]]
            for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
                has[i] = any(ch.isalpha() for ch in column[int(i)].as_py())
            n = len(has)
            if m.languages:
                nats = code_lengths(m, raw, offs)
                best = nats.argmin(1) if n else np.zeros(0, int)
                low = nats[np.arange(n), best]
                score = 1 / np.exp(-(nats - low[:, None])).sum(1)
                bits = low / np.log(2) / np.maximum(np.diff(offs), 1)
            else:
                has, best, score, bits = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n)
            names = np.array([*m.languages, "und"], object)[np.where(has, best, len(m.languages))]
            new = [pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0)), pa.array(np.where(has, bits, 0.0))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema=pa.schema([*b.schema, ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]))

    return rest.mapInArrow(predict, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows: `und` and texts with no clear winner (score under 0.5) go.

    Learns as op2 does, from the labelled rows of docs.
    """
    prepare(spark)
    held = crc_mod("doc_id", 4) == 2
    model = train(docs.where(~held))
    named = identify(docs, model)
    return named.where("lang_pred <> 'und' and score >= 0.5").select(*docs.columns)
