"""Secret scan with corpus-wide ownership frequency, DataFrame functions only.

Three kinds of base spans come from patterns. Beside them, every long token with letters and digits is a
candidate of the kind `owned`. The hashes of all candidate values (the assigned value, else the match) are counted over
the whole corpus by distinct owners and repositories: a value that many owners or very many repositories share is a widely
copied example, any other is specific to its owners and looks live. Candidates of the kind `owned` become spans where their value
is owner-specific; base spans always stay, and are told apart in n_live and n_copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.llm._common import partitions, prepare, scratch, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+/_-]+"
#: kind, pattern, group of the value, least length of that value, a pattern that some place of a text must match first
KINDS = [
    ("assign", ASSIGN, 1, 12, r"(?i:password|passwd|secret|token|api_?key)"),
    ("access", ACCESS, 0, 18, r"AKIA[A-Z0-9]{14}"),
    ("hex", HEX, 0, 16, r"[0-9a-f]{16}"),
    ("owned", TOKEN, 0, 20, r"[A-Za-z0-9+/_-]{20}"),
]
def _matches(text: Column, kind: int) -> Column:
    """The leftmost matches of a kind, each with the length of the gap before it (from splitting at the pattern)."""
    _, pattern, group, least, somewhere = KINDS[kind]
    if group == 0:  # runs of one class (after a fixed head): the shorter ones need not be matched at all
        pattern = f"{pattern[:-1]}{{{least - 4 if pattern.startswith('AKIA') else least},}}"
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))

    def one(x, i):
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), F.xxhash64(x["v"]).alias("h"),
            ((F.length(x["v"]) >= least) & ((x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]")) if kind == 3 else F.lit(True))).alias("good"),
        )

    # the text behind the last match has no n
    found = F.filter(F.transform(rows, one), lambda m: m["n"].isNotNull())
    return F.when(text.rlike(somewhere), found).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,h:bigint,good:boolean>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, copied_owners: int = 3, copied_repos: int = 50) -> DataFrame:
    """docs -> id, found: array of (start, kind, end, n_owners, n_repos, live), one row per row.

    kind counts through KINDS; live: fewer than copied_owners distinct owners and fewer than copied_repos distinct repositories
    have the value. repo_col: what counts as a repository; without one each row is its own. Null texts have no spans; null
    owners count as one owner. An empty table gives no rows. A match is a row from the first step on, so a text costs in
    proportion to its length and n log n to its matches, however long it is.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.col(repo_col).cast("string") if repo_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), repo.alias("repo"), text.alias("t"))
    matched = rows.select("id", "owner", "repo", F.concat(*[_matches(F.col("t"), k) for k in range(4)]).alias("m"))
    kept = scratch(matched.withColumn("row", F.monotonically_increasing_id()))

    # places are running sums; those of one text are one window, dealt once for both windows
    own = kept.select("row", "owner", F.coalesce("repo", F.col("row").cast("string")).alias("repo"), F.explode("m").alias("m")).select("row", "owner", "repo", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = own.repartition(partitions(docs.sparkSession), "row")
    placed = dealt.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before).cast("int")).where("good").withColumn("start", F.col("end") - F.col("n"))
    # a token of the kind `owned` is dropped if a base span that begins before its end ends behind its start
    base = F.col("kind") < 3
    sweep = Window.partitionBy("row").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), base).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = scratch(placed.withColumn("reach", F.max(F.when(base, F.col("end"))).over(sweep)).where(base | F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))).select("row", "owner", "repo", "start", "kind", "end", "h"))

    # distinct at each step before the next: a value that a third of all rows hold stays spread
    places = spans.select("h", "owner", "repo").distinct()
    owners = places.groupBy("h", "owner").agg(F.count("*").alias("repos"))
    counts = owners.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    live = (F.col("n_owners") < copied_owners) & (F.col("n_repos") < copied_repos)
    judged = spans.join(counts, "h").withColumn("live", live)
    shown = judged.where("kind < 3 or live").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos", "live"))).alias("f"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,n_owners:bigint,n_repos:bigint,live:boolean>>")
    return kept.select("row", "id").join(shown, "row", "left").select(F.col("id").alias(id_col), F.coalesce("f", none).alias("found"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_copied, most_owners, most_repos.

    The owner is source, each row is a repository; most_* are the greatest counts of the document's spans."""
    prepare(spark)
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(k):
        return lambda s: s["kind"] == k

    def count(test):
        return F.size(F.filter("found", test)).cast("long")

    return found.select(
        "doc_id",
        *[count(of_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(4)],
        F.sha2(joined(F.filter("found", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["n_owners"])), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.transform("found", lambda s: s["n_repos"])), F.lit(0)).alias("most_repos"),
    )


def _matches_sql(kind: int) -> str:
    name, pattern, group, least, _ = KINDS[kind]
    p = pattern.replace("'", "''")
    # a match of fewer characters is dropped after matching, as in the definition
    return f"""SELECT doc_id, row, owner, {kind} AS kind, '{name}' AS name, s AS start, s + n AS "end", v FROM (
    SELECT doc_id, row, owner, v, n, sum(gap + n) OVER (PARTITION BY row ORDER BY i) - n AS s FROM (
      SELECT doc_id, row, owner, unnest(range(1, len(m) + 1)) AS i, unnest(list_transform(m, lambda x: length(x))) AS n, unnest(v) AS v,
        unnest(list_transform(g[:len(m)], lambda x: length(x))) AS gap
      FROM (SELECT doc_id, row, owner, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM t)))
  WHERE length(v) >= {least}""" + (" AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')" if kind == 3 else "")


OP3_SQL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_matches_sql(k) for k in range(3))}),
more AS ({_matches_sql(3)}),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = m.row AND b.start < m."end" AND m.start < b."end")),
freq AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT row) AS repos FROM cand GROUP BY v),
judged AS (SELECT c.*, owners, repos, owners < 3 AND repos < 50 AS live FROM cand c JOIN freq f USING (v) WHERE c.kind < 3 OR owners < 3 AND repos < 50),
per AS (SELECT row, max(owners) AS most_owners, max(repos) AS most_repos, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_owned,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
  string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM judged GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_owned, 0) AS n_owned,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM t LEFT JOIN per USING (row)
"""
