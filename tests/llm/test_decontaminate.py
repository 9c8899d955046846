import duckdb

from shelfspark.llm import decontaminate as dc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cols = ["doc_id", "item_id", "n_shared", "n_shingles", "containment"]
    want = sorted(con.execute(f"select {', '.join(cols)} from ({dc.OP7_SQL})").fetchall())
    got = sorted(tuple(r) for r in dc.op7_decontamination(spark, SF).select(*cols).collect())
    assert got == want and len(want) > 10


def item(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def test_threshold_sizes_and_edges(spark, monkeypatch):
    items = [(1, item(14)), (2, item(59, 100)), (3, item(4, 500)), (4, None), (5, ""), (None, item(9)), (6, "Solo!"), (7, " .. "), (8, "e, f"), (8, "e, f g")]
    docs = [
        (1, f"{item(300, 900)} {item(14).upper()}! {item(300, 2000)}"),
        (2, f"{item(3000, 9000)} {item(12)}"),  # 8 of 10 shingles
        (3, item(11)),  # 7 of 10
        (4, item(48, 111)),  # 44 of 55
        (5, item(47, 112)),  # 43 of 55
        (6, None), (7, ""), (8, f"x {item(4, 500)} y"), (None, item(14)),
        (11, "w500 w501 w502"), (12, item(3, 501)), (13, "a solo"), (14, "solos"), (15, "e f"), (16, "e f g"), (17, "f e"),
        (9, item(14)), (9, item(14)),
        (10, item(8)), (10, item(14, 4)),  # rows of one id add up
    ]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).selectExpr("*", "1 as h", "2 as gram", "3 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    # rows of item 8 are one item of two shingles, of two and of three words
    want = [(1, 1), (2, 1), (4, 2), (8, 3), (9, 1), (10, 1), (13, 6), (16, 8)]
    for size in (32 << 20, -1):
        monkeypatch.setattr(dc, "BROADCAST_BYTES", size)
        assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(frame, bench).collect()) == want
    assert dc.contaminated(frame.where("false"), bench).count() == 0
    assert dc.contaminated(frame, bench.where("false")).count() == 0


def test_a_shingle_of_many_items(spark):
    """Items that share a shingle: only pairs that the sketches found are counted."""
    items = [(i, f"which of the following is {item(6, 10 * i)}") for i in range(40)]
    docs = [(i, f"{item(50, 5000)} which of the following is {item(6, 10 * i)}", None, None, None) for i in range(0, 40, 2)] + [(99, "which of the following is it", None, None, None)]
    got = sorted((r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(i, i) for i in range(0, 40, 2)]
