"""Language-model scoring by subword lattice likelihood.

A text is lower-cased (A-Z) and split into words. Each word, with a mark in front, is a lattice over the pieces of an
existing subword vocabulary: a log-space forward recursion sums the probabilities of all its segmentations. A character
that no piece covers is spelled with the vocabulary's byte pieces. No piece crosses a word, so the marginal probability of
a text is the product of its words' and of one end, which has a share beside the pieces.

The vocabulary has no scores of its own. The pieces' unigram probabilities are learned here by expectation maximisation:
forward and backward sums give the expected count of each piece over all segmentations of all training words, weighted
by the words' counts in the whole corpus; one is added to each count. A round's result has a row a piece.

Words are counted once, each distinct word is scored once, and texts get the sums. The most frequent words (at most HOT of
them, none longer than SHORT) are looked up where the text is read, which takes the hot keys out of the join; all others, and
long words as texts without blanks have them, are joined. What a task holds is bounded by bytes as by words.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm._common import crc_mod, prepare, scratch, table

HOT = 200_000
#: Distinct words, and bytes of words over SHORT, that a task counts before it gives them out.
FLUSH, FLUSH_BYTES = 500_000, 32 << 20
ROUNDS = 3
#: Words that a lattice pass takes at once, and the longest (with its mark) that goes this way.
TOGETHER, SHORT = 40_000, 64
MARK = "▁"
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_worker: dict[str, Lattice] = {}


def split_words(text: str | None) -> list[str]:
    """Words of a text; bytes.split() splits at exactly \\x20 and \\x09-\\x0D, bytes.lower() lowers exactly A-Z."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def vocabulary(model_path: str) -> list[str]:
    """The pieces of a sentencepiece vocabulary, without control pieces and the unknown one."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i))]


class Lattice:
    """Marginal log probabilities (natural) of words, and expected counts of pieces."""

    def __init__(self, pieces: list[str]):
        names = {p: i for i, p in enumerate(pieces)}
        self.size = len(pieces)
        # a vocabulary without byte pieces spells with an extra entry, whose score is the last one
        self.byte_ids = np.array([names.pop(f"<0x{b:02X}>", len(pieces)) for b in range(256)])
        self.names, self.longest = names, max(map(len, names), default=0)
        found: dict[int, int] = {}
        for p, i in names.items():
            h = 0
            for ch in p:
                h = (h * _STEP + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
                found.setdefault(h, -1)  # a prefix: longer pieces may follow
            found[h] = i
        self.keys = np.array(sorted(found), np.uint64)
        self.ids = np.array([found[int(h)] for h in self.keys], np.int64)

    def _arcs(self, codes: np.ndarray, sizes: np.ndarray, scores: np.ndarray):
        """(words, begin, end, piece ids (words x ids), score) by begin, then end; sizes fall from word to word."""
        for i in range(codes.shape[1]):
            rows = np.arange(np.searchsorted(-sizes, -i, "left"))
            spelled, h = rows, np.zeros(len(rows), np.uint64)
            for j in range(i + 1, i + 1 + self.longest):
                long = sizes[rows] >= j
                rows, h = rows[long], h[long]
                if not len(rows):
                    break
                h = h * _U(_STEP) + codes[rows, j - 1] + _U(1)
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                rows, h, ids = rows[hit], h[hit], self.ids[at[hit]]
                good = ids >= 0
                if j == i + 1:
                    spelled = np.setdiff1d(spelled, rows[good], assume_unique=True)
                if good.any():
                    yield rows[good], i, j, ids[good][:, None], scores[ids[good]]
            if len(spelled):
                c = codes[spelled, i].astype(np.int64)
                for size, top, low, high in ((1, 0, 0, 0x80), (2, 0xC0, 0x80, 0x800), (3, 0xE0, 0x800, 0x10000), (4, 0xF0, 0x10000, 0x110000)):
                    some = (c >= low) & (c < high)
                    if some.any():
                        tail = [0x80 | (c[some] >> (6 * k) & 0x3F) for k in range(size - 2, -1, -1)]
                        ids = self.byte_ids[np.stack([top | c[some] >> (6 * (size - 1)), *tail], 1)]
                        yield spelled[some], i, i + 1, ids, scores[ids].sum(1)

    def run(self, words: list[str], scores: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The words' log probabilities; and with weights, the weighted expected counts of the pieces. scores: of the pieces,
        then of a byte that has none."""
        out, counts = np.zeros(len(words)), np.zeros(self.size + 1)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        for r in np.flatnonzero(sizes > SHORT).tolist():
            out[r] = self._long(MARK + words[r], scores, counts, 0 if weights is None else weights[r])
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= SHORT]
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            n = sizes[some]
            flat = np.frombuffer("".join([MARK + words[r] for r in some.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.zeros((len(some), int(n[0])), np.uint64)
            codes[np.arange(n[0])[None, :] < n[:, None]] = flat
            alpha = np.full((len(some), int(n[0]) + 1), -np.inf)
            alpha[:, 0] = 0
            arcs = []
            for arc in self._arcs(codes, n, scores):
                rows, i, j, _, s = arc
                alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + s)
                if weights is not None:
                    arcs.append(arc)
            total = alpha[np.arange(len(some)), n]
            out[some] = total
            if weights is not None:
                beta = np.full_like(alpha, -np.inf)
                beta[np.arange(len(some)), n] = 0
                for rows, i, j, ids, s in reversed(arcs):
                    ahead = s + beta[rows, j]
                    beta[rows, i] = np.logaddexp(beta[rows, i], ahead)
                    share = np.exp(alpha[rows, i] + ahead - total[rows]) * weights[some[rows]]
                    counts += np.bincount(ids.ravel(), np.repeat(share, ids.shape[1]), len(counts))
        return out, counts

    def _long(self, s: str, scores: np.ndarray, counts: np.ndarray, weight: float) -> float:
        """One word of any length; memory grows with its length only."""
        n, names, at = len(s), self.names, scores.tolist()
        alive = self.__dict__.setdefault("alive", {p[:k] for p in names for k in range(1, len(p) + 1)})

        def arcs(i):
            if s[i] not in names:
                ids = self.byte_ids[list(s[i].encode("utf-8", "surrogatepass"))].tolist()
                yield i + 1, ids, sum([at[x] for x in ids])
            j = i + 1
            while j <= n and (part := s[i:j]) in alive:
                if (x := names.get(part)) is not None:
                    yield j, [x], at[x]
                j += 1

        def plus(a, b):
            return max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)

        alpha = np.full(n + 1, -np.inf)
        alpha[0] = 0.0
        for i in range(n):
            here = float(alpha[i])
            for j, _, p in arcs(i):
                alpha[j] = plus(float(alpha[j]), here + p)
        total = float(alpha[n])
        if weight:
            beta = np.full(n + 1, -np.inf)
            beta[n] = 0.0
            for i in range(n - 1, -1, -1):
                for j, ids, p in arcs(i):
                    ahead = p + float(beta[j])
                    beta[i] = plus(float(beta[i]), ahead)
                    for x in ids:
                        counts[x] += weight * math.exp(float(alpha[i]) + ahead - total)
        return total


def worker_lattice(pieces) -> Lattice:
    """This process's lattice; it lasts from task to task."""
    name, names = pieces.value
    if name not in _worker:
        _worker.clear()
        _worker[name] = Lattice(names)
    return _worker[name]


def word_counts(docs: DataFrame, text_col: str, learn: Column) -> DataFrame:
    """word, n for every word of docs; n counts the rows where `learn` holds. Each task sums up as it reads."""

    def count(batches):
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        long_bytes = 0

        def flush():
            other = [w for w in seen[0] if w not in seen[1]]
            out = pa.RecordBatch.from_arrays([pa.array([*seen[1], *other], pa.string()), pa.array([*seen[1].values(), *[0] * len(other)], pa.int64())], ["word", "n"])
            for s in seen:
                s.clear()
            return out

        for b in batches:
            for t, teaches in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = split_words(t)
                seen[bool(teaches)].update(words)
                if max(map(len, words), default=0) > SHORT:
                    long_bytes += sum(4 * len(w) for w in words if len(w) > SHORT)
                if len(seen[0]) + len(seen[1]) > FLUSH or long_bytes > FLUSH_BYTES:
                    yield flush()
                    long_bytes = 0
        yield flush()

    return docs.select(text_col, learn).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_many(batches, size: int):
    """Arrow batches put together to at least `size` rows, or fewer of FLUSH_BYTES."""
    held, rows, taken = [], 0, 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        taken += b.nbytes
        if rows >= size or taken >= FLUSH_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, taken = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def learn_scores(counts: DataFrame, ends: int, pieces, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces (and of a byte without a piece), and of an end, after rounds of expectation and
    maximisation over counts (word, n). The first round weighs all pieces alike."""
    size = len(pieces.value[1])
    scores, end = np.full(size + 1, -math.log(size + 1)), -math.log(size + 1)
    scores[-1] = -25.0
    for _ in range(rounds):
        held = counts.sparkSession.sparkContext.broadcast(scores)

        def expect(batches, held=held):
            lattice, sums = worker_lattice(pieces), np.zeros(size + 1)
            for t in _by_many(batches, TOGETHER):
                sums = sums + lattice.run(t.column(0).to_pylist(), held.value, t.column(1).to_numpy().astype(float))[1]
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["piece", "n"])

        taught = counts.where("n > 0")
        got = taught.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("piece") < size).toArrow()  # at most a row a piece
        n = np.ones(size)
        n[got.column("piece").to_numpy()] += got.column("n").to_numpy()
        whole = n.sum() + ends + 1
        scores, end = np.append(np.log(n / whole), -25.0), math.log((ends + 1) / whole)
        held.destroy()
    return scores, end


def score_documents(docs: DataFrame, learn: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """docs -> id, n_tokens, n_known, train_tokens, base_score, score (log10). learn: says which rows teach the model.

    A null text is empty: one end. Each row gets its own scores, ids may be null or repeat. Without training rows, N and
    V are zero: each token of base_score costs log10(1 / 1), and the pieces stay as likely as one another.
    """
    spark = docs.sparkSession
    counts = scratch(word_counts(docs, text_col, learn))
    ends = docs.where(learn).count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, distinct = totals.n + ends, totals.v + (1 if ends else 0)
    pieces = spark.sparkContext.broadcast((uuid.uuid4().hex, vocabulary(model_path)))
    scores, end_score = learn_scores(counts, ends, pieces, rounds)
    shared = spark.sparkContext.broadcast(scores)

    def judge(batches):
        lattice = worker_lattice(pieces)
        for t in _by_many(batches, TOGETHER):
            lat, _ = lattice.run(t.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in t.columns], pa.array(lat / math.log(10))], ["word", "n", "lat"])

    words = scratch(counts.mapInArrow(judge, "word string, n long, lat double"))
    denominator = math.log10(n_train + distinct + 1)

    # the least count of a hot word: a histogram of at most 64 * 16 rows says how many words lie above
    level = F.floor(F.log2("n") * 16).cast("int")
    above, cut, short = 0, 1 << 30, F.length("word") <= SHORT
    for r in sorted(words.where((F.col("n") > 0) & short).groupBy(level.alias("l")).count().collect(), reverse=True):
        if above + r["count"] > HOT:
            break
        above, cut = above + r["count"], r["l"]
    hot = words.where((F.col("n") > 0) & short & (level >= cut)).toArrow()  # at most HOT rows, each of at most SHORT characters
    terms = np.stack([np.log10(hot.column("n").to_numpy() + 1.0) - denominator, hot.column("lat").to_numpy()]) if hot.num_rows else np.zeros((2, 0))
    known = spark.sparkContext.broadcast((dict(zip(hot.column("word").to_pylist(), range(hot.num_rows), strict=True)), terms))

    def local(batches):
        hot_words, terms = known.value
        for b in batches:
            rare_words, rare_n, ends_at, sizes, found, places, times = [], [], [0], [], [], [], []
            for t in b.column(1).to_pylist():
                words = Counter(split_words(t))
                at = [hot_words.get(w, -1) for w in words]
                k = list(words.values())
                rare = [(w, n) for w, n, x in zip(words, k, at, strict=True) if x < 0] if -1 in at else []
                rare_words += [w for w, _ in rare]
                rare_n += [n for _, n in rare]
                places += at
                times += k
                sizes.append(sum(k))
                found.append(len(k))
                ends_at.append(len(rare_words))
            at, k, row = np.array(places, np.int64), np.array(times, np.int64), np.repeat(np.arange(len(found)), found)
            at, k, row = at[at >= 0], k[at >= 0], row[at >= 0]
            sums = [np.bincount(row, k * x, len(found)).astype(float) for x in (np.ones(len(at)), terms[0][at], terms[1][at])]
            rare = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rare_words, pa.string()), pa.array(rare_n, pa.int64())], ["word", "k"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64()), rare], ["id", "n_tokens", "n_known", "base", "lat", "rare"])

    id_type = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(local, f"id {id_type}, n_tokens long, n_known long, base double, lat double, rare array<struct<word:string,k:long>>")
    texts = scratch(read.withColumn("row", F.monotonically_increasing_id()))  # written once: a row keeps its number

    rare = texts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.k").join(words, "word")
    k = F.col("k")
    seen = F.when(F.col("n") > 0, k).otherwise(0)
    both = rare.groupBy("row").agg(F.sum(seen).alias("r_n_known"), F.sum(k * (F.log10(F.col("n") + 1.0) - denominator)).alias("r_base"), F.sum(k * F.col("lat")).alias("r_lat"))

    def total(c, end):
        return F.col(c) + F.coalesce(f"r_{c}", F.lit(0)) + F.lit(end)

    return texts.drop("rare").join(both, "row", "left").select(
        F.col("id").alias(id_col),
        (F.col("n_tokens") + 1).alias("n_tokens"),
        total("n_known", int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        total("base", math.log10(ends + 1) - denominator).alias("base_score"),
        total("lat", end_score / math.log(10)).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import public_tokenizers

    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 7) == 2
    return score_documents(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model")).withColumn("held_out", held_out)
