"""The prefix trie of rebuilt conversations, with sums over subtrees by centroid decomposition.

Turns are numbered by running sums over ranges, so a conversation of any length is split. A prefix is named by its depth
and 128 bits: the exclusive or of the hashes of its turns, each hashed with its place, which again adds up over parts. Nodes are
then one aggregate of (conversation, prefix) rows.

Nodes in a row that have the same members form a chain, named by their smallest member and their number of members; the forest of
chains' parent edges has at most two chains for each distinct conversation. It is split by centroids: in each component
the centroid is the deepest chain with over half of the component's members below it. All chains with over half lie on the path
from it to the component's top. The total of what the component has below the centroid is added to each chain on that path;
then the component is split into the part above and one component for each child of the centroid, none of which
has over half of the members. After log2(members / fold_members) levels every component is small, and a task folds it from the leaves up.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm._common import discard, observed, partitions, prepare, scratch, table
from shelfspark.llm.running import running_sums

#: A component with no more members than this is folded in one task; it has at most twice as many chains, and one for each level.
FOLD_MEMBERS = 256
#: conv_ids in one piece of a node's list of ends: 2 to this power.
PIECE_BITS = 12


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, part, pos (from 1), content (128 bits, hex), bytes. Null roles and texts are empty.

    Rows without conv_id are left out. Rows that tie in turn are ordered by the first 64 characters of role and of text,
    then by hash: no key of the ranges is long.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.left(role, F.lit(64)).alias("r"), F.left(text, F.lit(64)).alias("t"),
        F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32)).alias("content"), F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )
    out = running_sums(rows, ["conv_id"], ["turn", "r", "t", "content"], {"before": "one"}, "part")
    return out.select("conv_id", "part", (F.col("before") + 1).alias("pos"), "content", "bytes")


def rebuilt(rows: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, part, depth, content, bytes, is_end), and conversations (conv_id, length).

    Conversation c takes its first h turns from conversation c - c % group, h = crc32(c) % heads. rows must be written.
    """
    sizes = scratch(rows.groupBy("conv_id").agg(F.count("*").alias("n")))
    c = F.col("conv_id")
    base = sizes.where(c % group == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    own = c == F.col("base")
    convs = sizes.withColumn("base", c - c % group).withColumn("h", F.when(own, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % heads)).join(base, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = scratch(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    kept = rows.join(convs, "conv_id").where("pos > h").select("conv_id", "part", (F.col("head") + F.col("pos") - F.col("h")).alias("depth"), "content", "bytes", "length")
    first = rows.where((c % group == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "base")
    taken = first.join(convs.where("conv_id <> base"), "base").where("pos <= h").select("conv_id", F.lit(-1).alias("part"), F.col("pos").alias("depth"), "content", "bytes", "length")
    turns = kept.union(taken).withColumn("is_end", F.col("depth") == F.col("length")).drop("length")
    return turns, convs.select("conv_id", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds to each turn its prefix's name (q1, q2), the name of the prefix before it (p1, p2) and the bytes so far. Conversations are whole over parts."""
    named = scratch(turns.select("*", F.xxhash64("depth", "content").alias("t1"), F.xxhash64("content", F.lit("second"), "depth").alias("t2")).drop("content"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = named.groupBy("conv_id", "part").agg(F.bit_xor("t1").alias("o1"), F.bit_xor("t2").alias("o2"), F.sum("bytes").alias("ob"))
    offsets = scratch(totals.select("conv_id", "part", *[F.coalesce(f("o" + x).over(before), zero).alias("o" + x) for x, f in (("1", F.bit_xor), ("2", F.bit_xor), ("b", F.sum))]))
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = named.join(offsets, ["conv_id", "part"])
    rows = rows.withColumn("q1", F.col("o1").bitwiseXOR(F.bit_xor("t1").over(so_far))).withColumn("q2", F.col("o2").bitwiseXOR(F.bit_xor("t2").over(so_far))).withColumn("so_far", F.col("ob") + F.sum("bytes").over(so_far))
    return rows.select("conv_id", "depth", "bytes", "is_end", "q1", "q2", F.col("q1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("q2").bitwiseXOR(F.col("t2")).alias("p2"), "so_far")


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, q1, q2) of last turns -> depth, q1, q2, ends_sha256 of the ascending ids.

    Ids come as pieces of at most 2^PIECE_BITS ids, which a task reads in order; it holds one digest, not a node's list.
    """
    key = ["depth", "q1", "q2"]
    pieces = ends.groupBy(*key, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    dealt = pieces.repartition(partitions(ends.sparkSession), *key).sortWithinPartitions(*key, "piece")

    def run(batches):
        node, state = None, None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if k != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = k, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*key, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], [*key, "ends_sha256"])

    return dealt.mapInArrow(run, "depth long, q1 long, q2 long, ends_sha256 string")


def fold(small: DataFrame, values: list[str]) -> DataFrame:
    """Sums over subtrees in each component, from the leaves up: a task reads a component's chains, the deepest first."""
    fields = ["comp", "id", "up", "a", *values, *["acc_" + v for v in values]]
    dealt = small.select(*fields).repartition(partitions(small.sparkSession), "comp").sortWithinPartitions("comp", F.desc("a"))

    def run(batches):
        comp, sums = None, {}
        none = (0,) * len(values)
        for b in batches:
            out = []
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for c, i, up, _, *numbers in zip(*cols, strict=True):
                c, i, up = tuple(c.values()), tuple(i.values()), tuple(up.values()) if up else None
                if c != comp:
                    comp, sums = c, {}
                own = tuple(x + y for x, y in zip(numbers, sums.pop(i, none), strict=False))
                if up:
                    sums[up] = tuple(x + y for x, y in zip(own, sums.get(up, none), strict=True))
                out.append((*i, *(x + y for x, y in zip(own, numbers[len(values) :], strict=True))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["conv_id", "n_convs", *values])

    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ["conv_id", "n_convs", *values]))


def subtree_sums(chains: DataFrame, lineage: DataFrame, values: list[str], fold_members: int = FOLD_MEMBERS) -> DataFrame:
    """conv_id, n_convs and, for each value, its sum over the subtree, by centroid decomposition of the forest of chains.

    chains: id struct(c, n), up (its parent, null at the top), a (depth of its first node), values; lineage: r, id: the
    chains on the path to each conversation r. Both written; they are joined and grouped by component, never gathered.
    """
    state = chains.select("id", "up", "a", *values, *[F.lit(0).cast("long").alias("acc_" + v) for v in values], F.col("id.n").alias("kw"))
    root = chains.where("up is null").select("id").first()  # the one row of the root, if there are conversations
    c, n = root.id if root else (None, None)
    state, done = state.withColumn("comp", F.struct(F.lit(c).cast("long").alias("c"), F.lit(n).cast("long").alias("n"))).withColumn("total", F.lit(n).cast("long")), []
    wide = F.col("total") > fold_members
    small = state.where(~wide)
    level = scratch(state.where(wide), rows=F.count(F.lit(1)))
    ready = []
    while observed(level)["rows"]:
        heavy = F.col("kw") * 2 > F.col("total")
        centroids = scratch(level.where(heavy).groupBy("comp").agg(F.max(F.struct("a", "id", "kw")).alias("g")))
        split = level.join(centroids, "comp")
        at, child = F.col("id") == F.col("g.id"), F.coalesce(F.col("up") == F.col("g.id"), F.lit(False))
        tops = scratch(split.where(child).select(F.col("id").alias("top"), "comp", F.col("a").alias("top_a"), F.col("kw").alias("top_kw")))
        # which child's subtree a chain is in: the one on the path to its smallest member
        under = scratch(lineage.join(tops, lineage.id == tops.top).select(F.col("r"), F.col("comp").alias("in_comp"), "top", "top_a", "top_kw"))
        found = split.join(under, (F.col("id.c") == F.col("r")) & (F.col("comp") == F.col("in_comp")) & (F.col("a") >= F.col("top_a")), "left")
        below = child | F.col("top").isNotNull()
        moved = scratch(found.select(
            "id", "up", "a", *values, *["acc_" + v for v in values], F.col("comp").alias("old"), at.alias("at"), (at | below).alias("low"), (heavy & ~at).alias("on_path"),
            F.when(at | child, F.col("id")).when(below, F.col("top")).otherwise(F.col("comp")).alias("comp"),
            F.when(heavy & ~at, F.col("kw") - F.col("g.kw")).otherwise(F.col("kw")).alias("kw"),
            F.when(child, F.col("kw")).when(below, F.col("top_kw")).when(at, F.lit(0)).otherwise(F.col("total") - F.col("g.kw")).alias("total"),
        ))
        totals = scratch(moved.where("low").groupBy("old").agg(*[F.sum(v).alias("sum_" + v) for v in values]))
        both = moved.join(totals, "old").withColumns({"acc_" + v: F.col("acc_" + v) + F.when(F.col("at") | F.col("on_path"), F.col("sum_" + v)).otherwise(0) for v in values})
        after = scratch(both.drop("old", "low", "on_path", *["sum_" + v for v in values]))
        done.append(after.where("at").select(F.col("id.c").alias("conv_id"), F.col("id.n").alias("n_convs"), *[F.col("acc_" + v).alias(v) for v in values]))
        ready.append(after.where(~F.col("at") & ~wide).drop("at"))
        spent, level = level, scratch(after.where(~F.col("at") & wide).drop("at"), rows=F.count(F.lit(1)))
        discard(spent, centroids, tops, under, moved, totals)
    for more in ready:
        small = small.unionByName(more)
    out = fold(small, values)
    for more in done:
        out = out.union(more)
    return out


def conversation_trie(turns: DataFrame, fold_members: int = FOLD_MEMBERS) -> DataFrame:
    """(conv_id, turn, role, text) -> the nodes of the trie of rebuilt conversations; see op11_conversation_trie.

    Rows without conv_id take no part; rows that repeat are further turns. A table without conversations has no node. Columns besides these
    four are not read. c % 5 of a negative conv_id is SQL's remainder (towards zero).
    """
    prepare(turns.sparkSession)
    steps, convs = rebuilt(scratch(numbered_turns(turns)), 5, 9)
    path = scratch(prefixes(steps))
    zero, key = F.lit(0).cast("long"), ["depth", "q1", "q2"]
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("q1"), zero.alias("q2"), "conv_id", "n_convs", zero.alias("bytes"), zero.alias("so_far"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = path.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("bytes", "so_far", "p1", "p2")])
    nodes = scratch(nodes.withColumn("depth", F.col("depth").cast("long")).unionByName(root))
    above = (F.col("depth") - 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")
    children = scratch(nodes.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    linked = scratch(nodes.join(children, key, "left").join(parents, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    up = F.when(F.col("parent_n").isNotNull(), F.struct(F.col("parent_conv_id").alias("c"), F.col("parent_n").alias("n")))
    chains = linked.groupBy("conv_id", "n_convs").agg(F.min("depth").alias("a"), F.min(F.col("so_far") - F.col("bytes")).alias("start"), F.max("so_far").alias("stop"), F.min("n_children").alias("least"), F.min_by(up, "depth").alias("up"))
    chains = scratch(chains.select(
        F.struct(F.col("conv_id").alias("c"), F.col("n_convs").alias("n")).alias("id"), "up", "a", "start",
        (F.col("least") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * (F.col("stop") - F.col("start"))).alias("saved_tokens"),
    ))
    first = (F.col("parent_n") > F.col("n_convs")) & (F.col("n_convs") > 1)
    tops = linked.where(first).select(*key, F.struct(F.col("conv_id").alias("c"), F.col("n_convs").alias("n")).alias("id"))
    lineage = scratch(path.select(F.col("conv_id").alias("r"), *key).join(tops, key).select("r", "id"))
    values = ["n_leaves", "saved_tokens"]
    sums = subtree_sums(chains, lineage, values, fold_members)
    sums = scratch(sums.join(chains.select(F.col("id.c").alias("conv_id"), F.col("id.n").alias("n_convs"), "start"), ["conv_id", "n_convs"]).withColumnsRenamed({"n_leaves": "leaves", "saved_tokens": "saved"}))
    ends = path.where("is_end").select("conv_id", "depth", "q1", "q2").union(convs.where("length = 0").select("conv_id", zero, zero, zero))
    digests = scratch(end_digests(ends))
    out = linked.join(sums, ["conv_id", "n_convs"]).join(digests, key, "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("so_far") - F.col("bytes") - F.col("start"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: conversations in DuckDB: nodes are compared by whole prefixes (a chain of digests); crc32 is spelled out bit by bit.
OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: xor(xor(a, greatest(b, 0)) >> 1, (xor(a, greatest(b, 0)) & 1) * 3988292384)), 4294967295) % 9 AS h FROM s),
k AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS head FROM h LEFT JOIN s b ON b.c = h.base),
r AS (SELECT k.c, t.pos AS d, role, text FROM k JOIN t ON t.c = k.base WHERE t.pos <= k.h
      UNION ALL SELECT k.c, k.head + t.pos - k.h, role, text FROM k JOIN t ON t.c = k.c WHERE t.pos > k.h),
x AS (SELECT c, d, strlen(text) AS bytes, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS key FROM r
      UNION ALL SELECT c, 0, 0, [] FROM k),
n AS (SELECT key, any_value(d) AS d, min(c) AS c, count(*) AS members, any_value(bytes) AS bytes FROM x GROUP BY key),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM x GROUP BY c) m JOIN x USING (c, d) GROUP BY key),
kids AS (SELECT key[:-2] AS key, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN kids USING (key)),
up AS (SELECT a.key, sum((b.children = 0)::BIGINT) AS leaves, sum((b.members - 1) * b.bytes) AS saved FROM f a JOIN f b ON b.key[:a.d] = a.key GROUP BY a.key)
SELECT f.c AS conv_id, f.d::BIGINT AS depth, p.c AS parent_conv_id, f.members AS n_convs, f.children AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN up USING (key) LEFT JOIN e USING (key) LEFT JOIN n p ON f.d > 0 AND p.key = f.key[:-2]
"""
