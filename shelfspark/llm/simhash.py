"""SimHash near-duplicates: a binary trie self-join over the distinct fingerprints.

Two fingerprints within `bits` differing bits agree on at least r of r + bits blocks. For every choice of r blocks
the fingerprints are dealt by those blocks' bits: a group is a subtree of the trie that reads these bits first, and
both sides of a pair enter it with no error. In a group, pairs of trie nodes are traversed together: the bits in
which the nodes' common prefixes differ are counted, and a pair over the budget is pruned with all below it, as is a
pair of nodes whose leaves are all linked to each other already. So a group of copies yields a spanning forest of
links, never all of its pairs, and the components are exact.

A group over `group_cap` fingerprints is not joined in one task: its members are dealt again to pairs of nodes eight
bits further down (those still within the budget), as often as needed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm._common import connected_components, partitions, prepare, scratch, shingle_hashes, table, text_bytes

LEAVES = 16
ALL = (1 << 64) - 1


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; zero without words."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    if len(hashes) < 2:
        return int(hashes.sum())
    hashes = hashes.astype(">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4) -> DataFrame:
    """Adds fp, the fingerprint as a signed long; a null text has no words and so zero. A column fp is replaced."""
    rest = docs.drop("fp")
    schema = T.StructType([*[f for f in rest.schema.fields if f.name != text_col], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            raw, offs = text_bytes(b.column(text_col))
            data = raw.tobytes()
            fps = [fingerprint(data[x:y], width) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            keep = b.drop_columns([text_col])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], schema=pa.schema([*keep.schema, ("fp", pa.int64())]))

    return rest.mapInArrow(run, schema)


class _Forest:
    """Components of the members of one group, by union and find."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.parent, self.links = fps, np.arange(len(fps)), []

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while (over := self.parent[up] != up).any():
            up = np.where(over, self.parent[up], up)
        self.parent[at] = up
        return up

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((int(self.fps[i]), int(self.fps[j])))

    def close(self, ai: np.ndarray, bi: np.ndarray, bits: int) -> None:
        """Compares two small sets of leaves."""
        near = np.bitwise_count(self.fps[ai][:, None] ^ self.fps[bi][None, :]) <= bits
        near &= self.roots(ai)[:, None] != self.roots(bi)[None, :]
        for x, y in zip(*np.nonzero(near), strict=True):
            self.link(int(ai[x]), int(bi[y]))


def trie_join(fps: np.ndarray, bits: int, sides: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join the members of a group as all pairs within `bits` would. fps: sorted, distinct, unsigned.

    sides: None, or the members of two nodes, of which only pairs across count.
    """
    forest = _Forest(fps)

    def depth(node: np.ndarray) -> int:
        return 64 - int(fps[node[0]] ^ fps[node[-1]]).bit_length()

    def halves(node: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        mid = int(np.searchsorted(fps[node] >> np.uint64(63 - d) & np.uint64(1), 1))
        return node[:mid], node[mid:]

    todo = [(np.arange(len(fps)), None)] if sides is None else [sides] if len(sides[0]) and len(sides[1]) else []
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) <= LEAVES:
                forest.close(a, a, bits)
                continue
            left, right = halves(a, depth(a))
            todo += [(left, right), (left, None), (right, None)]  # the last comes first: near leaves are linked early
            continue
        da, db = depth(a), depth(b)
        shared = min(da, db)
        if shared and (int(fps[a[0]] ^ fps[b[0]]) >> (64 - shared)).bit_count() > bits:
            continue
        la, lb = forest.roots(a), forest.roots(b)
        if la[0] == lb[0] and (la == la[0]).all() and (lb == lb[0]).all():
            continue
        if len(a) * len(b) <= LEAVES * LEAVES:
            forest.close(a, b, bits)
        elif db == 64 or (da <= db and len(a) > 1):
            todo += [(x, b) for x in halves(a, da)]
        else:
            todo += [(a, x) for x in halves(b, db)]
    return forest.links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choices(n: int, bits: int) -> list[int]:
    """Masks of the blocks that a group's members agree on: more blocks, and so longer keys, for more fingerprints."""
    intact = 2 if n <= 1 << 23 else 3 if n <= 1 << 29 else 4
    edges = [round(i * 64 / (intact + bits)) for i in range(intact + bits + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(blocks, intact)]


def links(fps: DataFrame, bits: int = 4, group_cap: int = 200_000) -> DataFrame:
    """fps (fp long, distinct) -> links (a, b) whose components are those of all pairs within `bits` differing bits."""
    spark = fps.sparkSession
    masks = _choices(fps.count(), bits)
    steps = []  # for each choice of blocks: the masks of the levels below, eight more bits each
    for m in masks:
        levels, rest = [m], [i for i in range(63, -1, -1) if not m >> i & 1]
        for at in range(0, len(rest), 8):
            levels.append(levels[-1] | sum(1 << i for i in rest[at : at + 8]))
        steps.append(levels)

    def group_key(t):
        return F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(masks[t]))).alias("p"))

    rows = fps.select("fp", F.explode(F.array(*[group_key(t) for t in range(len(masks))])).alias("k")).select("k.t", "k.p", F.col("k.p").alias("q"), "fp")
    found, level = [], 0
    while True:
        dealt = rows.repartition(partitions(spark), "t", "p", "q").sortWithinPartitions("t", "p", "q", "fp")
        out = scratch(dealt.mapInArrow(_traverse(steps, level, bits, group_cap), "t int, p long, q long, fp long, a long, b long"))
        found.append(out.where("t is null").select("a", "b"))
        deferred = out.where("t is not null")
        if deferred.isEmpty():
            break
        rows, level = _descend(deferred, steps, level, bits), level + 1
    all_links = found[0]
    for more in found[1:]:
        all_links = all_links.union(more)
    return all_links


def _descend(deferred: DataFrame, steps: list[list[int]], level: int, bits: int) -> DataFrame:
    """Members of groups that are too large, dealt to the pairs of nodes eight bits further down."""

    def pick(values):
        return F.element_at(F.array(*[F.lit(_signed(v)) for v in values]), F.col("t") + 1)

    def spread(mask):
        at = [i for i in range(63, -1, -1) if mask >> i & 1]
        return [_signed(sum(1 << at[j] for j in range(len(at)) if e >> j & 1)) for e in range(1 << len(at))]

    below = [s[min(level + 1, len(s) - 1)] for s in steps]
    ends = F.element_at(F.array(*[F.array(*map(F.lit, spread(b & ~s[level] & ALL))) for b, s in zip(below, steps, strict=True)]), F.col("t") + 1)
    own = F.when(F.col("fp").bitwiseAND(pick([s[level] for s in steps])) == F.col("p"), F.col("q")).otherwise(F.col("p"))
    paired = deferred.select("t", "fp", F.col("fp").bitwiseAND(pick(below)).alias("x"), own.alias("o"), F.explode(ends).alias("e")).withColumn("y", F.col("o").bitwiseOR(F.col("e")))
    return paired.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits).select("t", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "fp")


def _traverse(steps, level, bits, cap):
    def run(batches):
        held: list[np.ndarray] = []  # the rows of the group that is not over yet
        held_n, last, over = 0, None, False

        def result(t, p, q, fp, a, b):
            cols = [pa.array(t, pa.int32()), *[pa.array(x, pa.int64()) for x in (p, q, fp, a, b)]]
            return pa.RecordBatch.from_arrays(cols, ["t", "p", "q", "fp", "a", "b"])

        def joined(key, fps):
            fps = np.unique(fps.view(np.uint64))
            t, p, q = key
            if p == q:
                return trie_join(fps, bits)
            mask = steps[t][level]
            side = (fps & np.uint64(mask)) == np.uint64(p & ALL)
            return trie_join(fps, bits, (np.flatnonzero(side), np.flatnonzero(~side)))

        for batch in batches:
            t, p, q, fp = (batch.column(i).to_numpy() for i in range(4))
            if not len(fp):
                continue
            new = np.flatnonzero((t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            edges, deferred = [], []
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(fp)], strict=True):
                key = (int(t[lo]), int(p[lo]), int(q[lo]))
                if key != last:
                    if last is not None and not over and held_n > 1:
                        edges += joined(last, np.concatenate(held))
                    held, held_n, last, over = [], 0, key, False
                held.append(fp[lo:hi])
                held_n += hi - lo
                if over or held_n > cap:
                    deferred.append((key, np.concatenate(held)))
                    held, over = [], True
            if edges:
                pairs = np.array(edges, np.uint64).view(np.int64)
                yield result([None] * len(pairs), [None] * len(pairs), [None] * len(pairs), [None] * len(pairs), pairs[:, 0], pairs[:, 1])
            for (kt, kp, kq), fps in deferred:
                n = len(fps)
                yield result([kt] * n, [kp] * n, [kq] * n, fps, [None] * n, [None] * n)
        if last is not None and not over and held_n > 1 and (edges := joined(last, np.concatenate(held))):
            pairs = np.array(edges, np.uint64).view(np.int64)
            nothing = [None] * len(pairs)
            yield result(nothing, nothing, nothing, nothing, pairs[:, 0], pairs[:, 1])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4, group_cap: int = 200_000) -> DataFrame:
    """docs -> id, fp, component_id: the smallest id that links of at most `bits` differing bits reach, one row per row.

    Texts that are null or have no words have fingerprint zero and link like any other. Repeated rows share their
    fingerprint and so their component. A null id keeps its row, but is not the smallest of a component.
    """
    fp = scratch(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, width))
    first = fp.groupBy("fp").agg(F.min(id_col).alias("first"))
    parts = connected_components(links(fp.select("fp").distinct(), bits, group_cap))
    # written: both sides of the joins on a component's label and on a fingerprint are then shuffles that Spark can split
    named = scratch(first.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("label")))
    least = scratch(named.groupBy("label").agg(F.min("first").alias("component_id")))
    classes = scratch(named.join(least, "label").select("fp", "component_id"))
    return fp.join(classes, "fp").select(id_col, "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, fingerprint (16 hex digits), component_id."""
    prepare(spark)
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
