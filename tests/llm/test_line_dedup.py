import random
import re

import duckdb

from shelfspark.llm import line_dedup as ld

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def brute(rows, run, long_line, words=50):
    units, seen = {}, {}
    for i, t in rows:
        if t is not None:
            lines = t.split("\n")
            at = [j for j, x in enumerate(lines) if x.strip(ld.BLANKS)]
            units[i] = (lines, at, [lines[j].strip(ld.BLANKS) for j in at])
    gone = {i: set() for i in units}
    for i in sorted(units):
        _, at, bare = units[i]
        for p in range(len(bare)):
            for n in range(1, run + 1):
                w = tuple(bare[p : p + n])
                size = [len(re.split("[ \t-\r]+", x)) for x in w]
                reaches = sum(size) >= words > sum(size[:-1])
                if len(w) < n or n < run and not reaches and not (n == 1 and len(w[0]) >= long_line):
                    continue
                if seen.setdefault((n, w), (i, p)) < (i, p):
                    gone[i] |= {at[q] for q in range(p, p + n)}
    return {i: "\n".join(x for j, x in enumerate(units[i][0]) if j not in gone[i]) for i in units}


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {k} " + "é" * (k % 40) for k in range(40)] + ["", "  ", "x" * 50]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 12))]
        if rows and rng.random() < 0.5:
            other = rng.choice(rows)[1].split("\n")
            a = rng.randint(0, len(other))
            lines[3:3] = other[a : a + rng.randint(1, 6)]
        rows.append((i, "\n".join(lines)))
    rows += [(80, None), (81, ""), (82, "q\n" * 20000), (83, "a\nb\nc")]
    docs = spark.createDataFrame([(i, t, None, None, 1) for i, t in rows], DOCS).selectExpr("*", "1 as key", "2 as fp", "3 as id", "4 as start")
    for run, long_line, words in ((3, 45, 50), (2, 10**6, 3), (5, 20, 9), (4, 10**6, 6)):
        got = {r.doc_id: r.text for r in ld.drop_repeated_lines(docs, run, long_line, words).collect()}
        assert got == brute(rows, run, long_line, words) | {80: None}


def test_a_passage_of_fifty_words_in_two_lines(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    rows = [(1, f"x\n{a}\n{b}\ny"), (2, f"p\n{a}\n\n {b}\nq"), (3, f"{a}\nother\n{b}")]
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "p\n\nq", 3: rows[2][1]}


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({ld.OP5_SQL})").fetchall())
    assert sorted(map(tuple, ld.op5_line_dedup(spark, SF).select(cols).collect())) == want
    assert sum(w[2] > 0 for w in want) > 10


def test_edges(spark):
    assert ld.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, "a\nb\nc"), (None, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in rows], DOCS)
    got = sorted((r.doc_id or 0, r.text) for r in ld.drop_repeated_lines(docs).collect())
    assert got == [(0, "x"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d"), (3, "")]
    kept = ld.line_stage(spark, docs.where("doc_id > 1 or doc_id is null"), "")
    assert kept.columns == docs.columns
