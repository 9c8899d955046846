"""One query per operator, by its id, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.functions import scores as S
from shelfspark.functions import text as X
from shelfspark.operators import completeness as C
from shelfspark.operators import dupes as D
from shelfspark.operators import labels as N
from shelfspark.operators import ledger as L
from shelfspark.operators import nearest as K
from shelfspark.operators import resolve as E
from shelfspark.operators import search as G
from shelfspark.operators import seed as Z
from shelfspark.operators import upsert as U
from shelfspark.operators import views as V
from shelfspark.plans import adapters as A
from shelfspark.plans.oracle import clean_title, embedded, half_up, slug_a, slug_b, sql, volume_ml
from shelfspark.sources import feeds
from shelfspark.sources.store import settled, written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TIE = A.OFFER_TIE


def query(name: str, body: str | None = None, *needs: str):
    def add(f):
        QUERIES[name] = f
        if body:
            ORACLE_SQL[name] = sql(body, *needs)
        return f

    return add


def joined(c: str, sep: str = "|"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# -- sources, sinks, loads


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    items = A.feed_items(s, d)
    fields = ["retailer_sku", "gtin", "title", "brand_name", "raw_size", "price", "currency", "in_stock", "affiliate_url"]
    return items.groupBy(F.col("feed_id").cast("string").alias("retailer_id"), (F.col("item_id") % 50).alias("part")).agg(F.collect_list(F.struct(*fields)).alias("items")).select("retailer_id", F.concat(F.lit("r"), "retailer_id").alias("slug"), F.lit(None).cast("string").alias("source_url"), "items")


@query("S-1", "SELECT feed_id::VARCHAR AS retailer_id, retailer_sku, title, raw_size, price FROM feed", "feed")
def s1(s, d):
    return _read_feed(s, d)[0].select("retailer_id", "retailer_sku", "title", "raw_size", "price")


def _read_feed(s, d):
    """Writes the envelopes as JSON lines, with bad lines among them, and reads them back."""
    from shelfspark.sources.store import new_folder

    k = F.col("p_partkey").cast("string")
    bad = [F.concat(F.lit('{"retailer_id":"'), k), F.concat(F.lit('{"slug":"'), k, F.lit('","items":[{"title":"x"}]}')), F.concat(F.lit('{"retailer_id":"'), k, F.lit('","slug":"s","items":[]}')), F.concat(F.lit('{"retailer_id":"'), k, F.lit('","slug":"s"}')), F.concat(F.lit('{"retailer_id":"'), k, F.lit('","slug":"s","items":"none"}'))]
    lines = A.table(s, d, "part").where("p_partkey % 8 < 5").select(F.get(F.array(*bad), (F.col("p_partkey") % 8).cast("int")).alias("value"))
    folder = new_folder(s, "feed")
    _envelopes(s, d).select(F.to_json(F.struct("retailer_id", "slug", "source_url", "items")).alias("value")).union(lines).write.text(folder)
    return feeds.read_envelopes(s, folder)


@query("S-1_rejects", """SELECT ['{"retailer_id":"' || p_partkey, '{"slug":"' || p_partkey || '","items":[{"title":"x"}]}', '{"retailer_id":"' || p_partkey || '","slug":"s","items":[]}', '{"retailer_id":"' || p_partkey || '","slug":"s"}', '{"retailer_id":"' || p_partkey || '","slug":"s","items":"none"}'][p_partkey % 8 + 1] AS line,
 ['no JSON', 'no retailer', 'empty items', 'no items', 'wrong types'][p_partkey % 8 + 1] AS reason FROM part WHERE p_partkey % 8 < 5""")
def s1_rejects(s, d):
    return _read_feed(s, d)[1]


@query("S-2", "SELECT item_id, retailer_sku, gtin, title, price, currency, array_to_string(errors, '|') AS errors FROM feed_ok", "feed_ok")
def s2(s, d):
    return feeds.normalise(A.feed_items(s, d)).select("item_id", "retailer_sku", "gtin", "title", F.col("price").cast("double").alias("price"), "currency", joined("errors").alias("errors"))


@query("S-3", f"SELECT p_partkey::VARCHAR AS part_key, p_name AS product_name, {half_up('p_retailprice')} AS price FROM part WHERE p_partkey % 10 <> 3")
def s3(s, d):
    blank = F.col("p_partkey") % 10 == 3
    raw = A.table(s, d, "part").select(*[F.when(~blank, F.concat(F.lit(" "), c, F.lit(" "))).alias(n) for n, c in (("Part Key", F.col("p_partkey").cast("string")), (" Product Name", F.col("p_name")), ("Price", X.half_up(F.col("p_retailprice")).cast("string")))])
    return feeds.clean_sheet(raw).withColumn("price", F.col("price").cast("double"))


def _sheet(s, d):
    p = A.table(s, d, "part")
    k = F.col("p_partkey")
    price = F.when(k % 5 == 0, F.lit("not confirmed")).when(k % 5 == 1, F.concat(F.format_string("%.2f", X.half_up(F.col("p_retailprice"))), F.lit(" (MRP "), F.format_string("%.2f", X.half_up(F.col("p_retailprice") + 100)), F.lit(")"))).otherwise(F.format_string("Rs %.2f", X.half_up(F.col("p_retailprice"))))
    return p.select(k.alias("row_id"), F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", k.cast("string")).alias("product"), price.alias("price"), F.concat(F.col("p_size").cast("string"), F.when(k % 3 == 0, " fl oz").otherwise(" ml")).alias("size"), F.col("p_type").alias("tab"))


_SHEET = f"""(SELECT p_partkey AS row_id, p_brand AS brand, p_name || ' ' || p_partkey AS product, CASE WHEN p_partkey % 5 = 0 THEN 599.0 ELSE {half_up('p_retailprice')} END AS price,
 CASE WHEN p_partkey % 5 = 0 THEN 599.0 WHEN p_partkey % 5 = 1 THEN {half_up('(p_retailprice + 100)')} ELSE {half_up('p_retailprice')} END AS mrp, {half_up("(p_size * CASE WHEN p_partkey % 3 = 0 THEN 29.57 ELSE 1.0 END)")} AS size_ml, p_type AS tab FROM part)"""


@query("S-4", f"SELECT {slug_b('brand')} || '-' || {slug_b('product')} AS slug, brand, product, tab AS category, size_ml, mrp, price, '/p/' || {slug_b('brand')} || '-' || {slug_b('product')} AS url FROM {_SHEET}")
def s4(s, d):
    return V.sheet_catalog(_sheet(s, d)).select("slug", "brand", "product", "category", "size_ml", "mrp", "price", "url")


def _tabbed(s, d):
    k, p = F.col("p_partkey"), A.table(s, d, "part")
    extra = p.select(k.alias("row_id"), F.col("p_name").alias("product"), F.when(k % 7 == 0, "Other").otherwise(F.get(F.array(*map(F.lit, V.TABS)), (k % 3).cast("int"))).alias("tab"), F.when(k % 2 == 0, "SPF 50").otherwise(" ").alias("spf_pa"), F.when(k % 3 == 0, F.repeat("p_name", 20)).alias("dupe_edge"), F.when(k % 4 == 0, F.concat(F.lit("https://shop.example/"), k.cast("string"))).alias("page"))
    return _sheet(s, d).drop("product", "tab").join(extra, "row_id")


def _sheet_tables(s, d):
    seen = A.table(s, d, "part").where("p_size < 5").select(F.concat_ws("-", X.slug_b(F.col("p_brand")), X.slug_b(F.col("p_name"))).alias("slug"), X.slug_b(F.col("p_brand")).alias("b")).distinct()
    old = {"brand": seen.where("b like 'brand-1%'").select(F.col("b").alias("slug")).distinct(), "product": seen.select("slug"), "page": seen.select(F.concat(F.lit("/p/"), "slug").alias("url"))}
    none = A.product_ingredients(s, d).select(F.lit(None).cast("string").alias("product_id")).limit(0)
    return V.gate_sheet(V.sheet_tables(_tabbed(s, d), old), none, A.AS_OF)


_TABS = ", ".join(f"('{tab}', '{c}', '{f}')" for tab, (c, f) in V.TABS.items())
_SLUG4 = f"{slug_b('p_brand')} || '-' || {slug_b('p_name')}"
_TABBED = f"""(SELECT x.*, p_brand AS brand, p_name AS product, {slug_b('p_brand')} AS brand_slug, {_SLUG4} AS slug, price, mrp, size_ml, category, format, CASE WHEN x.row_id % 2 = 0 THEN 'SPF 50' END AS spf_pa, CASE WHEN x.row_id % 3 = 0 THEN left(repeat(p_name, 20), 150) END AS dupe_edge, CASE WHEN x.row_id % 4 = 0 THEN 'https://shop.example/' || x.row_id END AS page
 FROM (SELECT *, p_partkey AS row_id, CASE WHEN p_partkey % 7 = 0 THEN 'Other' ELSE ['{"', '".join(V.TABS)}'][p_partkey % 3 + 1] END AS tab_ FROM part) x JOIN (SELECT row_id, price, mrp, size_ml FROM {_SHEET}) USING (row_id) JOIN (VALUES {_TABS}) v(tab_, category, format) USING (tab_))"""
_SEEN4 = f"(SELECT {_SLUG4} FROM part WHERE p_size < 5)"
# what the gate gives without a label: variants, and two offers or more
_DCS4 = f"(SELECT slug AS s, (10 + CASE WHEN count(*) > 1 THEN 20 ELSE 0 END)::INTEGER AS dcs FROM {_TABBED} GROUP BY 1)"
_CLAIMS = "array_to_string(list_filter([spf_pa, dupe_edge], lambda c: c IS NOT NULL), '|')"


@query("S-4_brand", f"SELECT brand_slug AS slug, arg_min(brand, row_id) AS name, 'IN' AS country, min(row_id) AS row_id FROM {_TABBED} WHERE brand_slug NOT IN (SELECT {slug_b('p_brand')} FROM part WHERE p_size < 5 AND {slug_b('p_brand')} LIKE 'brand-1%') GROUP BY 1")
def s4_brand(s, d):
    return _sheet_tables(s, d)["brand"]


@query("S-4_product", f"SELECT slug, brand_slug, product AS name, category, format, {_CLAIMS} AS claims, 'IN' AS markets, dcs AS dcs_score, 'provisional' AS index_tier, row_id FROM {_TABBED} JOIN {_DCS4} ON s = slug WHERE slug NOT IN {_SEEN4} QUALIFY row_number() OVER (PARTITION BY slug ORDER BY row_id) = 1")
def s4_product(s, d):
    return _sheet_tables(s, d)["product"].withColumns({"claims": joined("claims"), "markets": joined("markets")})


@query("S-4_variant", f"SELECT row_id, slug AS product_slug, size_ml, mrp FROM {_TABBED}")
def s4_variant(s, d):
    return _sheet_tables(s, d)["variant"]


@query("S-4_offer", f"SELECT row_id, slug AS product_slug, 'Direct Brand Site' AS retailer, price, 'INR' AS currency, true AS in_stock, coalesce(page, 'https://www.nykaa.com/search?q=' || slug) AS affiliate_url FROM {_TABBED}")
def s4_offer(s, d):
    return _sheet_tables(s, d)["offer"]


@query("S-4_page", f"SELECT 'product' AS archetype, '/p/' || slug AS url, 'en-in' AS locale, slug AS entity_refs, dcs AS dcs_score, false AS indexable, 'provisional' AS index_tier, NULL::TIMESTAMP AS first_indexed_at, row_id FROM {_TABBED} JOIN {_DCS4} ON s = slug WHERE slug NOT IN {_SEEN4} QUALIFY row_number() OVER (PARTITION BY slug ORDER BY row_id) = 1")
def s4_page(s, d):
    return _sheet_tables(s, d)["page"].withColumn("entity_refs", joined("entity_refs"))


@query("S-5", "SELECT url, date, clicks, impressions, ctr, position FROM search", "search")
def s5(s, d):
    raw = A.search_rows(s, d).select(F.array("url").alias("keys"), F.col("clicks").cast("double").alias("clicks"), F.col("impressions").cast("double").alias("impressions"), "ctr", "position", "date")
    return feeds.flatten_search_rows(raw, F.col("date"))


@query("S-6", "SELECT seen_at::DATE AS seen_date, count(*) AS n, round(sum(price), 2) AS total FROM offers GROUP BY 1", "offers")
def s6(s, d):
    """Appends the offers in two batches, each of them once, and reads the ledger back."""
    from shelfspark.sources.store import Ledger, new_folder

    ledger, offers = Ledger(s, new_folder(s, "ledger"), unit="month"), A.offers(s, d)
    for half in (0, 1):
        ledger.append(offers.where(F.col("l_orderkey") % 2 == half), f"half-{half}")
    return ledger.read().groupBy("seen_date").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


_SEED_BATCH = "seed-1"


def _seeded(s, d):
    """The load of part as demo products. Every third product was loaded by a run before, whose tables are written."""
    k, name = F.col("p_partkey"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    slots = [F.struct(F.lit(" water ").alias("name"), F.lit(False).alias("is_active")), F.struct(F.lit("Vitamin B3").alias("name"), F.lit(True).alias("is_active")), F.struct(F.concat(F.lit("Oil "), (k % 7).cast("string")).alias("name"), (k % 2 == 0).alias("is_active"))]
    offers = F.array(F.struct(F.lit("Nykaa").alias("retailer"), F.col("p_retailprice").alias("price")), F.struct(F.lit("Nobody").alias("retailer"), F.lit(1.0).alias("price")))
    raw = A.table(s, d, "part").select(k.alias("row_id"), F.concat_ws("-", X.slug_b(F.col("p_brand")), X.slug_b(name)).alias("slug"), name.alias("name"), F.col("p_brand").alias("brand"), X.slug_b(F.col("p_brand")).alias("brand_slug"), F.col("p_type").alias("category"), F.lit("cream").alias("format"), F.array().cast("array<string>").alias("claims"), F.array(*slots).alias("ingredients"), F.col("p_size").cast("double").alias("size_ml"), offers.alias("offers"))
    seeds = A.ingredients(s).select("inci_name", F.when(F.col("inci_name") == "Niacinamide", "Vitamin B3").otherwise(F.col("inci_name")).alias("canonical_name"), "synonyms", F.lit("B").alias("evidence_grade"))
    brands = s.createDataFrame([("brand-11", "Brand Eleven", "IN", "Parent"), ("new-brand", "New Brand", "FR", None)], Z.EMPTY["brand"])
    shops = s.createDataFrame([("Nykaa", "IN"), ("Tira", "IN")], "name string, market string")
    state = Z.empty_catalog(s) | {"brand": s.createDataFrame([("brand-11", "Old name", None, None)], Z.EMPTY["brand"])}
    first = Z.seed_catalog(raw.where("row_id % 3 = 0"), seeds, brands, shops, state, _SEED_BATCH)
    return Z.seed_catalog(raw, seeds, brands, shops, {name: written(df) for name, df in first.items()}, _SEED_BATCH)


_SEED_SLUG = f"{slug_b('p_brand')} || '-' || {slug_b("(p_name || ' ' || p_partkey)")}"
_sid = "left(sha256({0}), 32)".format


@query("S-7", f"SELECT {_sid(_SEED_SLUG)} AS product_id, {_sid(slug_b('p_brand'))} AS brand_id, p_name || ' ' || p_partkey AS name, {_SEED_SLUG} AS slug, p_type AS category, 0 AS dcs_score, 'provisional' AS index_tier FROM part")
def s7(s, d):
    return _seeded(s, d)["product"].select("product_id", "brand_id", "name", "slug", "category", "dcs_score", "index_tier")


@query("S-7_ingredient", f"SELECT {_sid('lower(inci_name)')} AS ingredient_id, inci_name, 'B' AS evidence_grade FROM ing UNION ALL SELECT DISTINCT {_sid("('oil ' || p_partkey % 7)")}, 'Oil ' || p_partkey % 7, CASE WHEN arg_min(p_partkey % 2, (p_partkey % 3 > 0, p_partkey)) = 0 THEN 'A' ELSE 'B' END FROM part GROUP BY p_partkey % 7", "ing")
def s7_ingredient(s, d):
    return _seeded(s, d)["ingredient"].select("ingredient_id", "inci_name", "evidence_grade")


@query("S-7_brand", f"SELECT DISTINCT {slug_b('p_brand')} AS slug, CASE WHEN {slug_b('p_brand')} = 'brand-11' THEN 'Brand Eleven' ELSE p_brand END AS name, CASE WHEN {slug_b('p_brand')} = 'brand-11' THEN 'IN' END AS country FROM part UNION SELECT 'brand-11', 'Brand Eleven', 'IN' UNION SELECT 'new-brand', 'New Brand', 'FR'")
def s7_brand(s, d):
    return _seeded(s, d)["brand"].select("slug", "name", "country")


@query("S-7_slots", f"SELECT {_sid(_SEED_SLUG)} AS product_id, n AS position, {_sid("(CASE n WHEN 1 THEN 'water' WHEN 2 THEN 'niacinamide' ELSE 'oil ' || p_partkey % 7 END)")} AS ingredient_id, n = 2 OR n = 3 AND p_partkey % 2 = 0 AS is_active FROM part, (VALUES (1), (2), (3)) v(n)")
def s7_slots(s, d):
    return _seeded(s, d)["product_ingredient"].select("product_id", "position", "ingredient_id", "is_active")


@query("S-7_offer", f"SELECT {_sid(_SEED_SLUG)} AS product_id, p_size::DOUBLE AS size_ml, p_retailprice AS mrp, {_sid("'Nykaa'")} AS retailer_id, p_retailprice AS price, 'https://www.nykaa.com/search?q=' || {_SEED_SLUG} AS affiliate_url FROM part")
def s7_offer(s, d):
    t = _seeded(s, d)
    return t["variant"].join(t["offer"].hint("merge"), "variant_id").select("product_id", "size_ml", "mrp", "retailer_id", "price", "affiliate_url")


@query("S-7_page", f"SELECT '/p/' || {slug_b('p_brand')} || '/' || {_SEED_SLUG} AS url, {_sid(_SEED_SLUG)} AS product_id, 0 AS dcs_score, false AS indexable FROM part")
def s7_page(s, d):
    return _seeded(s, d)["page"].select("url", F.get("entity_refs", 0).alias("product_id"), "dcs_score", "indexable")


@query("S-8", "SELECT event_id, event_id % 500 AS offer_id, ts AS clicked_at, left(sha256(CASE WHEN user_id % 10 = 0 THEN 'unknown' ELSE user_id::VARCHAR END), 32) AS ip_hash FROM events WHERE event_type = 'click' AND event_id % 500 IN (SELECT p_partkey FROM part)")
def s8(s, d):
    e = A.table(s, d, "events").where("event_type = 'click'")
    clicks = e.select((F.col("event_id") % 500).alias("offer_id"), F.col("ts").alias("clicked_at"), F.col("event_id").cast("string").alias("referrer"), F.lit(None).cast("string").alias("user_agent"), F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("ip"))
    rows = feeds.click_rows(clicks, A.table(s, d, "part").select(F.col("p_partkey").alias("offer_id")))
    return rows.select(F.col("referrer").cast("long").alias("event_id"), "offer_id", "clicked_at", "ip_hash")


@query("U-1", "SELECT o_custkey AS k, max_by(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS v, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS is_new FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal, false FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u1(s, d):
    old = A.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("1900-01-01").cast("timestamp").alias("t"), F.lit(0).cast("long").alias("o"))
    new = A.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("o"))
    return U.upsert(old, new, ["k"], [F.desc("t"), F.desc("o")]).select("k", "v", "is_new")


@query("U-1_merge", "SELECT o_custkey AS k, max_by(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def u1_merge(s, d):
    """The same on a table by buckets: two batches, the second of them sent twice."""
    from shelfspark.sources.store import KeyedTable, new_folder

    zero = [F.lit("1900-01-01").cast("timestamp").alias("t"), F.lit(0).cast("long").alias("o")]
    old = A.table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), *zero)
    new = A.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderdate").alias("t"), F.col("o_orderkey").alias("o"))
    table = KeyedTable(s, new_folder(s, "keyed"), ["k"], 16)
    for rows, batch in ((old, "customers"), (new, "orders"), (new, "orders")):
        table.merge(rows, [F.desc("t"), F.desc("o")], batch)
    return table.read().select("k", "v")


@query("U-2", "SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def u2(s, d):
    old = A.table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return U.insert_absent(old, A.table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o")), ["k"], [F.col("o")]).select("k", "o")


@query("U-3", "SELECT DISTINCT p_brand AS brand, CASE WHEN i IS NULL THEN left(sha256(p_brand), 32) ELSE i::VARCHAR END AS id, i IS NULL AS is_new FROM part LEFT JOIN (SELECT p_brand, min(p_partkey) AS i FROM part WHERE p_partkey < 10 GROUP BY 1) USING (p_brand)")
def u3(s, d):
    p = A.table(s, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey")
    return U.find_or_create(p.where("p_partkey < 10").groupBy("brand").agg(F.min("p_partkey").alias("id")), p, "brand", "id")


@query("DQ-1", """SELECT 'duplicate offer' AS rule, l_orderkey || '|' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'range l_tax', l_tax::VARCHAR, count(*) FROM lineitem WHERE l_tax NOT BETWEEN 0 AND 0.05 GROUP BY l_tax UNION ALL SELECT 'value l_returnflag', l_returnflag, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 2
 UNION ALL SELECT 'foreign l_suppkey', l_suppkey::VARCHAR, count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000) GROUP BY 2""")
def dq1(s, d):
    return U.violations(A.table(s, d, "lineitem"), {"duplicate offer": ["l_orderkey", "l_linenumber"]}, {"l_tax": (0, 0.05)}, {"l_returnflag": ["A", "N"]}, {"l_suppkey": (A.table(s, d, "supplier").where("s_acctbal > 1000"), "s_suppkey")})


# -- columns


@query("F-1", f"SELECT item_id, raw_size, {volume_ml('raw_size')} AS ml FROM feed", "feed")
def f1(s, d):
    return A.feed_items(s, d).select("item_id", "raw_size", X.volume_ml(F.col("raw_size")).alias("ml"))


@query("F-2", f"SELECT page_id, {slug_a('url')} AS slug, {slug_a('html')} AS html_slug FROM pages")
def f2(s, d):
    return A.table(s, d, "pages").select("page_id", X.slug_a(F.col("url")).alias("slug"), X.slug_a(F.col("html")).alias("html_slug"))


@query("F-3", f"SELECT page_id, {slug_b('url')} AS slug FROM pages")
def f3(s, d):
    return A.table(s, d, "pages").select("page_id", X.slug_b(F.col("url")).alias("slug"))


@query("F-4", f"SELECT item_id, {clean_title('title', 'brand_name')} AS clean FROM feed", "feed")
def f4(s, d):
    return A.feed_items(s, d).select("item_id", X.clean_title(F.col("title"), F.col("brand_name")).alias("clean"))


@query("F-5", f"SELECT row_id, price, mrp FROM {_SHEET}")
def f5(s, d):
    return _sheet(s, d).select("row_id", X.price_and_mrp(F.col("price")).alias("p")).select("row_id", "p.price", "p.mrp")


@query("F-6", f"SELECT row_id, size_ml FROM {_SHEET}")
def f6(s, d):
    return _sheet(s, d).select("row_id", X.sheet_size_ml(F.col("size")).alias("size_ml"))


@query("F-7", "SELECT product_id, ingredient_id, position, round(exp(-0.2 * (position - 1)), 9) AS w FROM pi", "pi")
def f7(s, d):
    return A.product_ingredients(s, d).select("product_id", "ingredient_id", "position", F.round(S.position_weight(F.col("position")), 9).alias("w"))


@query("F-8", "SELECT product_id, ingredient_id, position, round(exp(-0.2 * (position - 1)) * CASE WHEN is_active THEN 2 ELSE 1 END, 9) AS w FROM pi", "pi")
def f8(s, d):
    return A.product_ingredients(s, d).select("product_id", "ingredient_id", "position", F.round(S.ingredient_weight(F.col("position"), F.col("is_active")), 9).alias("w"))


def _skin_types(products):
    k = F.col("product_id")
    return products.withColumn("skin_types", F.array_compact(F.array(*[F.when(k % n == 0, t) for n, t in zip((2, 3, 5), V.SKIN_TYPES, strict=True)])))


_PAIR = "(SELECT a.product_id AS a, b.product_id AS b, a.mrp AS pa, a.size_ml AS sa, b.mrp AS pb, CASE WHEN b.product_id % 9 = 0 THEN 0 ELSE b.size_ml END AS sb, a.name AS na, b.name AS nb FROM products a JOIN products b ON b.product_id = a.product_id + 1)"


def _pairs(s, d):
    p = A.products(s, d)
    b = p.select(F.col("product_id").alias("b"), F.col("mrp").alias("pb"), F.when(F.col("product_id") % 9 == 0, 0.0).otherwise(F.col("size_ml")).alias("sb"), F.col("name").alias("nb"))
    return p.select(F.col("product_id").alias("a"), F.col("mrp").alias("pa"), F.col("size_ml").alias("sa"), F.col("name").alias("na")).join(b, F.col("b") == F.col("a") + 1)


@query("F-9", f"SELECT a, b, CASE WHEN sa > 0 AND sb > 0 AND pb > 0 THEN {half_up('((pa / sa - pb / nullif(sb, 0)) / (pb / nullif(sb, 0)) * 100)')} ELSE 0.0 END AS delta FROM {_PAIR}", "products")
def f9(s, d):
    return _pairs(s, d).select("a", "b", S.price_delta_pct(F.col("pa"), F.col("sa"), F.col("pb"), F.col("sb")).alias("delta"))


_SIZE = "(CASE WHEN sb = 0 THEN 0.0 WHEN sa = sb THEN 1.0 WHEN abs(sa - sb) / sb <= 0.05 THEN 1.0 - abs(sa - sb) / sb / 0.05 * 0.2 WHEN abs(sa - sb) / sb <= 0.15 THEN 0.5 ELSE 0.0 END)::DOUBLE"
_NAME = "(1 - levenshtein(upper(trim(na)), upper(trim(nb))) / greatest(length(trim(na)), length(trim(nb)), 1))"


@query("F-10", f"SELECT a, b, round({_SIZE}, 9) AS score FROM {_PAIR}", "products")
def f10(s, d):
    return _pairs(s, d).select("a", "b", F.round(S.size_score(F.col("sa"), F.col("sb")), 9).alias("score"))


@query("F-11", f"SELECT a, b, round({_NAME}, 9) AS score FROM {_PAIR}", "products")
def f11(s, d):
    return _pairs(s, d).select("a", "b", F.round(S.name_score(F.col("na"), F.col("nb")), 9).alias("score"))


@query("F-11_difflib")
def f11_difflib(s, d):
    names = _pairs(s, d).select("na", "nb").distinct()
    return names.withColumn("score", S.name_score(F.col("na"), F.col("nb"), "difflib"))


@query("F-12", f"SELECT a, b, {half_up(f'(0.7::DOUBLE * {_NAME} + 0.3::DOUBLE * {_SIZE})', 4)} AS score FROM {_PAIR}", "products")
def f12(s, d):
    return _pairs(s, d).select("a", "b", S.combined_score(S.name_score(F.col("na"), F.col("nb")), S.size_score(F.col("sa"), F.col("sb"))).alias("score"))


@query("F-12_difflib")
def f12_difflib(s, d):
    return _pairs(s, d).select("a", "b", "na", "nb", "sa", "sb", S.combined_score(S.name_score(F.col("na"), F.col("nb"), "difflib"), S.size_score(F.col("sa"), F.col("sb"))).alias("score"))


@query("F-13", "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1), '#.*', '') AS path FROM pages")
def f13(s, d):
    return A.table(s, d, "pages").select("page_id", X.relative_path(F.col("url")).alias("path"))


_ARCH = "CASE WHEN starts_with(lower({0}), '/p/') THEN 'product' WHEN starts_with(lower({0}), '/ingredient/') THEN 'ingredient' WHEN starts_with(lower({0}), '/dupes/') OR starts_with(lower({0}), '/dupe/') THEN 'dupe' WHEN starts_with(lower({0}), '/best/') THEN 'best' WHEN starts_with(lower({0}), '/vs/') THEN 'vs' WHEN starts_with(lower({0}), '/conflict/') THEN 'conflict' WHEN starts_with(lower({0}), '/under/') THEN 'under' ELSE 'other' END"
_KINDS = "['/P/', '/ingredient/', '/dupes/', '/dupe/', '/best/', '/vs/', '/conflict/', '/under/', '/x/'][page_id % 9 + 1] || page_id"


@query("F-14", f"SELECT page_id, {_ARCH.format('(' + _KINDS + ')')} AS archetype FROM pages")
def f14(s, d):
    heads = F.array(*map(F.lit, ["/P/", "/ingredient/", "/dupes/", "/dupe/", "/best/", "/vs/", "/conflict/", "/under/", "/x/"]))
    return A.table(s, d, "pages").select("page_id", X.archetype_from_path(F.concat(F.get(heads, (F.col("page_id") % 9).cast("int")), F.col("page_id").cast("string"))).alias("archetype"))


@query("F-15", "SELECT p_partkey AS k, CASE WHEN p_size * 2 >= 70 AND p_partkey % 3 > 0 THEN 'index, follow' ELSE 'noindex, follow' END AS robots FROM part")
def f15(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("k"), X.robots(F.col("p_size") * 2, F.col("p_partkey") % 3 > 0).alias("robots"))


@query("F-16", "SELECT a, b, round(pb / CASE WHEN sb = 0 THEN 30 ELSE sb END, 6) AS per_ml FROM " + _PAIR, "products")
def f16(s, d):
    return _pairs(s, d).select("a", "b", F.round(S.per_ml(F.col("pb"), F.col("sb")), 6).alias("per_ml"))


@query("F-17", "SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'Active/Solvent' END AS main_function, CASE WHEN p_size % 6 <= 1 THEN 'A' WHEN p_size % 6 <= 3 THEN 'B' ELSE 'C' END AS grade FROM part")
def f17(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("k"), S.main_function(F.when(F.col("p_partkey") % 3 == 0, F.array("p_type", F.lit("Other"))).when(F.col("p_partkey") % 3 == 1, F.array())).alias("main_function"), S.safety_grade(F.col("p_size") % 6).alias("grade"))


@query("F-18", "SELECT p_partkey AS k, CASE p_type WHEN 'ECONOMY' THEN 'Moisturizers' WHEN 'PROMO' THEN 'Sunscreens' WHEN 'LARGE' THEN 'Cleansers' ELSE 'Serums' END AS category FROM part")
def f18(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("k"), S.category(F.col("p_type")).alias("category"))


@query("F-19", "SELECT product_id, CASE WHEN bool_or(ingredient_id % 7 = 3) THEN 5 ELSE 2 END AS fit FROM pi GROUP BY 1", "pi")
def f19(s, d):
    types = A.product_ingredients(s, d).groupBy("product_id").agg(F.collect_set(F.col("ingredient_id") % 7).alias("types"))
    return types.select("product_id", S.skin_fit(F.col("types"), F.lit(3)).alias("fit"))


@query("F-20", "SELECT url, '/go/' || product_id AS link, CASE WHEN archetype = 'product' THEN 0.8 ELSE 0.6 END::DOUBLE AS priority, 'daily' AS changefreq FROM pages_", "pages_")
def f20(s, d):
    return V.sitemap_columns(A.pages(s, d)).select("url", F.concat(F.lit("/go/"), F.get("entity_refs", 0).cast("string")).alias("link"), "priority", "changefreq")


@query("F-21", "SELECT product_id, name, slug FROM (SELECT *, row_number() OVER (ORDER BY name, product_id) AS r FROM products WHERE category = 'PROMO' AND name ILIKE '%ring%') WHERE r > 5 AND r <= 55", "products")
def f21(s, d):
    return V.product_filter(A.products(s, d), category="PROMO", q="ring", limit=50, offset=5).select("product_id", "name", "slug")


def _faceted(s, d):
    """products with lowest price, skin types and active ingredients (as i and their number)."""
    low = L.best_per_retailer(A.offers(s, d), TIE).groupBy("product_id").agg(F.min("price").alias("lowest"))
    rows = A.product_ingredients(s, d).where("is_active").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("I"), F.col("ingredient_id").cast("string")).alias("i")))).alias("x"))
    return _skin_types(A.products(s, d)).join(low, "product_id").join(rows.select("product_id", F.col("x.i").alias("actives")), "product_id", "left")


_FACETED = """(SELECT *, lower(concat_ws(' ', brand, name, acts)) AS words FROM products JOIN (SELECT product_id AS pid, min(price) AS p FROM best GROUP BY 1) ON pid = product_id
 LEFT JOIN (SELECT product_id AS aid, string_agg('I' || ingredient_id, ' ' ORDER BY position) AS acts FROM pi WHERE is_active GROUP BY 1) ON aid = product_id)"""


@query("F-22", f"SELECT product_id, name FROM {_FACETED} WHERE category = 'LARGE' AND p < 1100 AND product_id % 3 = 0 AND contains(words, 'i1')", "products", "best", "pi")
def f22(s, d):
    return V.faceted(_faceted(s, d), category="LARGE", budget=1100, q="i1", skin="Dry").select("product_id", "name")


@query("F-22_suggestions", f"SELECT product_id, name FROM {_FACETED} WHERE contains(words, 'i1') ORDER BY name, product_id LIMIT 8", "products", "best", "pi")
def f22_suggestions(s, d):
    """The first eight are the feature."""
    return V.suggestions(_faceted(s, d), " I1 ").select("product_id", "name")


@query("F-23", "SELECT url, archetype, locale FROM pages_ JOIN (SELECT DISTINCT '/p/' || slug AS u FROM products JOIN (SELECT DISTINCT user_id FROM events) ON user_id = product_id) ON u = url", "pages_", "products")
def f23(s, d):
    wanted = A.table(s, d, "events").select(F.col("user_id").alias("product_id")).distinct().join(A.products(s, d), "product_id").select(F.concat(F.lit("/p/"), "slug").alias("url"))
    return A.pages(s, d).join(wanted, "url").select("url", "archetype", "locale")


@query("F-24", f"SELECT a, b, {half_up('similarity * 100', 0)}::BIGINT AS match_pct, {half_up('(-price_delta_pct)', 0)}::BIGINT AS savings_pct FROM edges", "edges")
def f24(s, d):
    return _edges(s, d).select("a", "b", X.half_up(F.col("similarity") * 100, 0).cast("long").alias("match_pct"), X.half_up(-F.col("price_delta_pct"), 0).cast("long").alias("savings_pct"))


@query("F-25", r"SELECT p_partkey AS k, regexp_replace(lower(p_name), '\s+', '-', 'g') AS slug FROM part")
def f25(s, d):
    return A.table(s, d, "part").select(F.col("p_partkey").alias("k"), X.slug_c(F.col("p_name")).alias("slug"))


@query("F-26", "SELECT url, CASE WHEN dcs_score >= 70 THEN 'indexed' ELSE 'provisional' END AS tier FROM scored", "scored")
def f26(s, d):
    return _scored(s, d).select("url", F.when(F.col("dcs_score") >= 70, "indexed").otherwise("provisional").alias("tier"))


@query("F-27", f"SELECT url, date, date >= DATE '{A.SEARCH_AS_OF}' - 7 AS in_week, date = DATE '{A.SEARCH_AS_OF}' - 2 AS is_load_day FROM search", "search")
def f27(s, d):
    as_of = F.lit(A.SEARCH_AS_OF).cast("date")
    return A.search_rows(s, d).select("url", "date", (F.col("date") >= F.date_sub(as_of, 7)).alias("in_week"), (F.col("date") == F.date_sub(as_of, 2)).alias("is_load_day"))


# -- labels


@query("N-1", "SELECT label_id, position, raw_token FROM tokens", "tokens")
def n1(s, d):
    return N.tokenize(A.labels(s, d)).select("label_id", F.col("position").cast("long").alias("position"), "raw_token")


@query("N-2", "SELECT label_id, position, array_to_string(cands, '|') AS candidates FROM tokens", "tokens")
def n2(s, d):
    return N.tokenize(A.labels(s, d)).select("label_id", F.col("position").cast("long").alias("position"), joined("candidates").alias("candidates"))


@query("N-3", "SELECT label_id, position, cands[1] AS first_word FROM tokens", "tokens")
def n3(s, d):
    return N.tokenize(A.labels(s, d)).select("label_id", F.col("position").cast("long").alias("position"), N.primary(F.col("raw_token")).alias("first_word"))


@query("N-4", "SELECT kind, key, keys.ingredient_id, count(label_id) AS used FROM keys LEFT JOIN each ON c = key GROUP BY ALL", "keys", "each")
def n4(s, d):
    used = N.tokenize(A.labels(s, d)).select(F.explode("candidates").alias("c")).groupBy(F.upper(F.trim("c")).alias("key")).agg(F.count("*").alias("used"))
    return N.dictionary_keys(A.ingredients(s)).join(used, "key", "left").select("kind", "key", "ingredient_id", F.coalesce("used", F.lit(0).cast("long")).alias("used"))


@query("N-5", "SELECT * FROM exact", "exact")
def n5(s, d):
    return N.exact_matches(N.tokenize(A.labels(s, d)), N.dictionary_keys(A.ingredients(s))).withColumn("position", F.col("position").cast("long"))


@query("N-6", "SELECT * FROM fuzzy", "fuzzy")
def n6(s, d):
    return _normal(s, d).where("match_method = 'fuzzy'").select("label_id", "position", "ingredient_id", "match_method", "confidence")


def _normal(s, d, mode="levenshtein"):
    return N.normalize_labels(A.labels(s, d), A.ingredients(s), mode=mode).withColumn("position", F.col("position").cast("long"))


@query("N-6_difflib")
def n6_difflib(s, d):
    return _normal(s, d, "difflib")


@query("N-7", "SELECT * FROM norm", "norm")
def n7(s, d):
    return _normal(s, d)


@query("N-8", "SELECT label_id, position, ingredient_id FROM norm WHERE ingredient_id IS NOT NULL", "norm")
def n8(s, d):
    return N.load_rows(_normal(s, d))[0].select("label_id", "position", "ingredient_id")


@query("N-9", "SELECT label_id, position, ingredient_id, position <= 4 AS is_active FROM norm WHERE ingredient_id IS NOT NULL", "norm")
def n9(s, d):
    return N.load_rows(_normal(s, d))[0]


# -- joins


@query("J-1", "SELECT product_id, retailer, market, price, currency FROM offers JOIN retailers USING (retailer_id) JOIN products USING (product_id) WHERE in_stock", "offers", "retailers", "products")
def j1(s, d):
    return A.offers(s, d).where("in_stock").join(A.retailers(s, d), "retailer_id").join(A.products(s, d).select("product_id"), "product_id").select("product_id", "retailer", "market", "price", "currency")


@query("J-2", "SELECT product_id, (SELECT count(*) FROM offers o WHERE o.product_id = p.product_id AND in_stock) AS offers, (SELECT count(*) FROM pi WHERE pi.product_id = p.product_id) AS ingredients FROM products p", "products", "offers", "pi")
def j2(s, d):
    return V.admin_products(A.products(s, d), A.offers(s, d).where("in_stock"), A.product_ingredients(s, d)).select("product_id", "offers", "ingredients")


@query("J-3", "SELECT item_id, variant_id FROM feed_ok", "feed_ok")
def j3(s, d):
    return L.gtin_lookup(feeds.normalise(A.feed_items(s, d)), A.products(s, d)).select("item_id", "variant_id")


def _sized(s, d):
    return feeds.normalise(A.feed_items(s, d)).withColumn("size_ml", X.volume_ml(F.col("raw_size")))


_SLUGGED = f"(SELECT item_id, min(p.product_id) AS slug_variant FROM feed_ok f LEFT JOIN products p ON {slug_a('p.brand')} = {slug_a('f.brand_name')} AND {slug_a('p.name')} = {slug_a(clean_title('f.title', 'f.brand_name'))} AND p.size_ml = f.size_ml GROUP BY 1)"


@query("J-4", f"SELECT item_id, slug_variant FROM {_SLUGGED}", "feed_ok", "products")
def j4(s, d):
    return E.slug_lookup(_sized(s, d), A.products(s, d)).select("item_id", "slug_variant")


_SIZES = "(SELECT size_ml, min(product_id) AS product_id, count(*) AS n FROM products GROUP BY 1)"


@query("J-5", f"SELECT a.size_ml, a.n AS items, b.size_ml AS cand_size, b.product_id AS cand, b.n AS cands FROM {_SIZES} a JOIN {_SIZES} b ON b.size_ml BETWEEN a.size_ml * 0.85 AND a.size_ml * 1.15", "products")
def j5(s, d):
    """Every item and candidate, by distinct size: a product belongs to the class of its size, and the classes are joined."""
    sizes = A.products(s, d).groupBy("size_ml").agg(F.min("product_id").alias("product_id"), F.count("*").alias("n")).withColumn("name", F.lit(None).cast("string"))
    return E.size_band(sizes.select("size_ml", F.col("n").alias("items")), sizes, cands="n").select("size_ml", "items", "cand_size", F.col("cand_id").alias("cand"), "cands")


@query("J-6", f"SELECT a, b, {half_up('similarity', 6)} AS similarity FROM cos WHERE similarity >= 0.3", "cos")
def j6(s, d):
    blocked = D.formula_vectors(A.product_ingredients(s, d)).join(A.products(s, d).select("product_id", "category"), "product_id")
    return D.similar_pairs(blocked, "category", 0.3).select("a", "b", X.half_up(F.col("similarity"), 6).alias("similarity"))


@query("J-7", f"""SELECT query_id, id, similarity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
 SELECT q.vec_id AS query_id, v.vec_id AS id, {half_up("list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))", 6)} AS similarity FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def j7(s, d):
    v = A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return K.nearest(v, v.where("id % 100 = 0"), "label").select("query_id", "id", "similarity", "rank")


@query("J-7_cells")
def j7_cells(s, d):
    """The index: as many cells as a sample of the queries needs for 0.95 of its neighbours."""
    v = A.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    queries = v.where("id % 100 = 0")
    return K.nearest(v, queries, "label", probes=K.probes_for(v, queries, "label")).select("query_id", "id", "similarity", "rank")


def _shared_refs(s, d):
    """Scored pages of which up to four share archetype and entities, some have none and some a null."""
    k = F.get("entity_refs", 0)
    none = F.when(k % 10 == 0, F.array().cast("array<long>")).when(k % 10 != 5, F.array(F.floor(k / 28) * 7 + k % 7))
    return _scored(s, d).withColumn("entity_refs", none)


_REFS = "(SELECT url, archetype, locale, indexable, dcs_score, CASE WHEN entity_refs[1] % 10 NOT IN (0, 5) THEN entity_refs[1] // 28 * 7 + entity_refs[1] % 7 END AS ref FROM scored)"


@query("J-8", f"SELECT a.url, b.url AS sibling, b.locale FROM {_REFS} a JOIN {_REFS} b ON a.archetype = b.archetype AND a.ref = b.ref WHERE b.indexable", "scored")
def j8(s, d):
    return V.siblings(_shared_refs(s, d)).select("url", "sibling", "locale")


@query("J-9", "SELECT archetype, coalesce(n, 0) AS total_pages, coalesce(c, 0)::BIGINT AS clicks FROM (SELECT archetype, count(*) AS n FROM scored GROUP BY 1) FULL JOIN (SELECT archetype, sum(clicks) AS c FROM search JOIN pages_ ON page_url = pages_.url GROUP BY 1) USING (archetype)", "scored", "search", "pages_")
def j9(s, d):
    return G.scorecard(_scored(s, d), _loaded(s, d), A.SEARCH_AS_OF, 365).select("archetype", "total_pages", "clicks")


@query("J-10", "SELECT search.url, date, pages_.url AS page_url, archetype FROM search LEFT JOIN pages_ ON page_url = pages_.url", "search", "pages_")
def j10(s, d):
    return _loaded(s, d).select("url", "date", "page_url", "archetype")


@query("J-11", "SELECT a AS product_id, b AS other_id, price_delta_pct FROM edges UNION ALL SELECT b, a, -price_delta_pct FROM edges", "edges")
def j11(s, d):
    return D.edges_of(_edges(s, d)).select("product_id", "other_id", "price_delta_pct")


@query("J-12", "SELECT slug FROM products WHERE slug NOT IN (SELECT slug FROM products WHERE product_id % 3 = 0)", "products")
def j12(s, d):
    p = A.products(s, d)
    return V.fallback_only(p, p.where("product_id % 3 = 0")).select("slug")


@query("J-13", "SELECT product_id, name, price, currency, seen_at FROM products LEFT JOIN latest USING (product_id)", "products", "latest")
def j13(s, d):
    return A.products(s, d).join(L.latest_in_stock(A.offers(s, d), TIE), "product_id", "left").select("product_id", "name", "price", "currency", "seen_at")


@query("J-14", f"SELECT c AS wanted, min(ingredient_id) AS ingredient_id FROM each JOIN ing ON {slug_a('c')} = {slug_a('inci_name')} OR ingredient_id % 3 = 0 AND {slug_a('c')} = {slug_a('synonyms[1]')} GROUP BY c", "each", "ing")
def j14(s, d):
    """Every third ingredient's canonical name is its first synonym."""
    wanted = N.tokenize(A.labels(s, d)).select(F.explode("candidates").alias("c")).select(F.upper(F.trim("c")).alias("wanted")).distinct()
    named = A.ingredients(s).withColumn("canonical_name", F.when(F.col("ingredient_id") % 3 == 0, F.get("synonyms", 0)).otherwise(F.col("inci_name")))
    return V.ingredient_by_slug(wanted, named).select("wanted", "ingredient_id")


# -- aggregates


@query("A-1", "SELECT feed_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'inserted') AS inserted, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed, string_agg(DISTINCT error, ' | ' ORDER BY error) AS errors FROM feed_ok GROUP BY 1", "feed_ok")
def a1(s, d):
    return L.summary(L.ingest(A.feed_items(s, d), A.products(s, d)))


def _metrics(s, d, only=lambda rows: rows):
    """only: keeps some products' rows of a frame with product_id."""
    return C.product_metrics(only(A.product_ingredients(s, d)), only(A.offers(s, d)), only(A.products(s, d)), F.col("product_id") % 30, F.col("product_id") % 4 == 0, only(A.variants(s, d)))


def _scored(s, d, only=lambda rows: rows):
    pages = only(A.pages(s, d).withColumn("product_id", F.get("entity_refs", 0))).drop("product_id")
    return C.score(C.page_metrics(pages, _metrics(s, d, only)))


@query("A-2", "SELECT * FROM metrics", "metrics")
def a2(s, d):
    return _metrics(s, d)


@query("A-3", "SELECT brand, count(*) AS products FROM products GROUP BY 1", "products")
def a3(s, d):
    return V.brand_list(A.products(s, d))


@query("A-4", """SELECT product_id, dcs_score, created_at, (SELECT count(*) FROM offers o WHERE o.product_id = p.product_id) AS offers, (SELECT count(*) FROM pi WHERE pi.product_id = p.product_id) AS ingredients
 FROM (SELECT p.product_id, coalesce(s.dcs_score, 0) AS dcs_score, TIMESTAMP '2000-01-01' + INTERVAL (p.product_id % 97) DAY AS created_at FROM products p LEFT JOIN scored s ON s.entity_refs[1] = p.product_id AND s.archetype IN ('product', 'p')) p
 ORDER BY dcs_score DESC, created_at DESC, product_id LIMIT 100 OFFSET 20""", "products", "offers", "pi", "scored")
def a4(s, d):
    """Limit and offset are the feature. Scores are those that the gate gave the products' pages."""
    created = F.lit("2000-01-01").cast("timestamp") + F.make_interval(days=(F.col("product_id") % 97).cast("int"))
    products = C.sync_products(A.products(s, d).select("product_id", F.lit(0).alias("dcs_score"), F.lit("").alias("index_tier"), created.alias("created_at")), _scored(s, d))
    return V.admin_page(V.admin_products(products, A.offers(s, d), A.product_ingredients(s, d)), 100, 20).select("product_id", "dcs_score", "created_at", "offers", "ingredients")


@query("A-5", "SELECT archetype, count(*) AS total_pages, count(*) FILTER (WHERE indexable) AS indexed_pages FROM scored GROUP BY 1", "scored")
def a5(s, d):
    return G.page_stats(_scored(s, d))


def _loaded(s, d):
    return G.attach_pages(A.search_rows(s, d), A.pages(s, d))


_STATS = f"(SELECT archetype, sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, avg(ctr) AS avg_ctr, avg(position) AS avg_position FROM search JOIN pages_ ON page_url = pages_.url WHERE date >= DATE '{A.SEARCH_AS_OF}' - 14 GROUP BY 1)"


@query("A-6", f"SELECT archetype, impressions, clicks, round(avg_ctr, 6) AS avg_ctr, round(avg_position, 6) AS avg_position FROM {_STATS}", "search", "pages_")
def a6(s, d):
    return G.search_stats(_loaded(s, d), A.SEARCH_AS_OF, 14).withColumns({"avg_ctr": F.round("avg_ctr", 6), "avg_position": F.round("avg_position", 6)})


@query("A-7", f"SELECT archetype, n AS total_pages, x AS indexed_pages, {half_up('(x / n * 100)')} AS index_rate, coalesce(impressions, 0) AS impressions, coalesce(clicks, 0) AS clicks, {half_up('(CASE WHEN impressions > 0 THEN clicks / impressions ELSE coalesce(avg_ctr, 0) END * 100)', 4)} AS ctr, {half_up('coalesce(avg_position, 0)')} AS avg_position FROM (SELECT archetype, count(*) AS n, count(*) FILTER (WHERE indexable) AS x FROM scored GROUP BY 1) LEFT JOIN {_STATS} USING (archetype)", "scored", "search", "pages_")
def a7(s, d):
    return G.scorecard(_scored(s, d), _loaded(s, d), A.SEARCH_AS_OF, 14)


@query("A-8", "SELECT archetype, count(*) AS urls, greatest(ceil(count(*) / 100), 1)::BIGINT AS pages FROM scored WHERE indexable AND dcs_score >= 70 GROUP BY 1", "scored")
def a8(s, d):
    return V.sitemap_counts(_scored(s, d), 100)


@query("A-9", "SELECT product_id, round(sqrt(sum(w * w)), 6) AS norm FROM (SELECT product_id, ingredient_id, exp(-0.2 * (max(position) - 1)) * CASE WHEN max(position) <= 4 THEN 2.0 ELSE 1.0 END AS w FROM pi GROUP BY ALL) GROUP BY 1", "pi")
def a9(s, d):
    last = A.product_ingredients(s, d).groupBy("product_id", "ingredient_id").agg(F.max("position").alias("position"))
    w = S.ingredient_weight(F.col("position"), F.col("position") <= 4)
    return last.groupBy("product_id").agg(F.round(F.sqrt(F.sum(w * w)), 6).alias("norm"))


@query("A-10", "SELECT product_id, CASE WHEN o.price < mrp THEN o.price ELSE mrp END AS lowest_price, CASE WHEN o.price < mrp THEN o.rid::VARCHAR ELSE 'Nykaa' END AS retailer FROM products LEFT JOIN (SELECT product_id, price, retailer_id AS rid FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, seen_at, l_orderkey, l_linenumber, retailer_id) AS r FROM offers WHERE in_stock) WHERE r = 1) o USING (product_id)", "products", "offers")
def a10(s, d):
    return L.lowest_price(A.products(s, d), A.offers(s, d), TIE)


@query("A-11", "SELECT product_id, string_agg(ingredient_id::VARCHAR, '|' ORDER BY position) AS actives FROM pi WHERE is_active GROUP BY 1", "pi")
def a11(s, d):
    rows = A.product_ingredients(s, d).where("is_active").groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("position", "ingredient_id"))).alias("x"))
    return rows.select("product_id", joined("x.ingredient_id").alias("actives"))


@query("A-12", "SELECT product_id, string_agg(DISTINCT m::BIGINT::VARCHAR, '|' ORDER BY length(m::BIGINT::VARCHAR), m::BIGINT::VARCHAR) AS sizes FROM (SELECT product_id, unnest(CASE WHEN product_id % 4 = 0 THEN [size_ml, size_ml * 2] ELSE [size_ml] END) AS m FROM products WHERE product_id % 6 <> 5) GROUP BY 1", "products")
def a12(s, d):
    return V.variant_sizes(A.variants(s, d)).select("product_id", F.array_join(F.transform("sizes", lambda x: x.cast("long").cast("string")), "|").alias("sizes"))


@query("A-13", "SELECT lower(brand) AS brand, count(*) AS n FROM products GROUP BY 1", "products")
def a13(s, d):
    return A.products(s, d).groupBy(F.lower("brand").alias("brand")).agg(F.count("*").alias("n"))


@query("A-14", f"""SELECT 'edges' AS counter, count(*) AS n FROM edges UNION ALL SELECT 'new edges', count(*) FROM edges WHERE (a + b) % 2 = 0 UNION ALL SELECT 'products queued', count(DISTINCT product_id) FROM pi
 UNION ALL SELECT 'search rows', count(*) FROM search WHERE date = DATE '{A.SEARCH_AS_OF}' - 2 UNION ALL SELECT 'new search rows', count(*) FROM search WHERE date = DATE '{A.SEARCH_AS_OF}' - 2 AND clicks = 0
 UNION ALL SELECT 'seeds', count(*) FROM ing UNION ALL SELECT 'new seeds', count(*) FROM ing WHERE ingredient_id % 4 <> 0""", "edges", "pi", "search", "ing")
def a14(s, d):
    edges, seeds = written(_edges(s, d)), A.ingredients(s)
    upserted = U.upsert(edges.where("(a + b) % 2 = 1"), edges, ["a", "b"], [F.desc("computed_at")])
    day = F.date_sub(F.lit(A.SEARCH_AS_OF).cast("date"), 2)
    return L.run_counters(
        {"edges": upserted, "products queued": A.product_ingredients(s, d).select("product_id").distinct(), "search rows": g1(s, d).where(F.col("date") == day), "seeds": seeds},
        {"new edges": upserted.where("is_new"), "new search rows": g1(s, d).where("is_new"), "new seeds": U.insert_absent(seeds.where("ingredient_id % 4 = 0"), seeds, ["inci_name"], [F.col("ingredient_id")])},
    )


# -- ranks


def _cols(*c):
    return ["product_id", "retailer_id", "price", "currency", "seen_at", *c]


_O = "product_id, retailer_id, price, currency, seen_at"


@query("W-1", f"SELECT {_O} FROM latest", "latest")
def w1(s, d):
    return L.latest_in_stock(A.offers(s, d), TIE).select(_cols())


@query("W-2", f"SELECT {_O} FROM best", "best")
def w2(s, d):
    return L.best_per_retailer(A.offers(s, d), TIE).select(_cols())


@query("W-2b", f"SELECT {_O} FROM (SELECT *, row_number() OVER (PARTITION BY product_id, retailer_id ORDER BY seen_at DESC, price, l_orderkey, l_linenumber) AS r FROM offers WHERE in_stock) WHERE r = 1", "offers")
def w2b(s, d):
    return L.latest_per_retailer(A.offers(s, d), TIE).select(_cols())


@query("W-3", f"SELECT {_O}, rank FROM (SELECT *, (row_number() OVER (PARTITION BY product_id ORDER BY seen_at, l_orderkey, l_linenumber, retailer_id, price))::INTEGER AS rank FROM offers WHERE seen_at >= TIMESTAMP '{A.AS_OF}' - INTERVAL 900 DAY) WHERE rank <= 5", "offers")
def w3(s, d):
    return L.price_trend(A.offers(s, d), A.AS_OF, TIE, 900, 5).select(_cols("rank"))


def _candidates(s, d):
    return D.dupe_candidates(D.formula_vectors(A.product_ingredients(s, d)), A.products(s, d))


def _edges(s, d):
    return D.dupe_edges(_candidates(s, d), L.latest_in_stock(A.offers(s, d), TIE), A.products(s, d), A.AS_OF)


@query("W-4", "SELECT product_id, other_id, rank::INTEGER AS rank FROM cand", "cand")
def w4(s, d):
    return _candidates(s, d).select("product_id", "other_id", "rank")


@query("W-5", "SELECT ingredient_id, product_id, position, rank FROM (SELECT *, (row_number() OVER (PARTITION BY ingredient_id ORDER BY position, mrp DESC, product_id))::INTEGER AS rank FROM (SELECT ingredient_id, product_id, min(position) AS position, any_value(mrp) AS mrp FROM pi JOIN products USING (product_id) GROUP BY 1, 2)) WHERE rank <= 20", "pi", "products")
def w5(s, d):
    return V.top_products(A.product_ingredients(s, d), A.products(s, d).withColumn("dcs_score", F.col("mrp"))).select("ingredient_id", "product_id", F.col("position").cast("long").alias("position"), "rank")


_T2 = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, diff, cand) AS r2 FROM (SELECT *, {half_up(f"(0.7::DOUBLE * {_NAME} + 0.3::DOUBLE * {_SIZE})", 4)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY diff, cand) AS r1 FROM (
 SELECT item_id, {clean_title("title", "brand_name")} AS na, f.size_ml AS sa, p.product_id AS cand, p.name AS nb, p.size_ml AS sb, abs(p.size_ml - f.size_ml) AS diff FROM feed_ok f JOIN products p ON f.size_ml > 0 AND p.size_ml BETWEEN f.size_ml * 0.85 AND f.size_ml * 1.15)) WHERE r1 <= 50)) WHERE r2 = 1)"""


@query("W-6", f"SELECT item_id, cand AS t2_id, score AS t2_score FROM {_T2}", "feed_ok", "products")
def w6(s, d):
    return E.tier2(_sized(s, d), A.products(s, d))


_VOCAB = "(SELECT ingredient_id, (row_number() OVER (ORDER BY ingredient_id % 3 > 0, ingredient_id) - 1)::INTEGER AS dim FROM (SELECT DISTINCT ingredient_id FROM pi))"


def _vocabulary(s, d):
    """Numbered in two runs: ids divisible by three first, then all; the first ones keep their numbers."""
    ids = A.product_ingredients(s, d).select("ingredient_id")
    none = s.createDataFrame([], "ingredient_id long, dim int")
    return Z.extend_vocabulary(Z.extend_vocabulary(none, ids.where("ingredient_id % 3 = 0")), ids)


@query("W-7", f"SELECT ingredient_id, dim FROM {_VOCAB}", "pi")
def w7(s, d):
    return _vocabulary(s, d)


@query("W-8", "SELECT product_id, ingredient_id, max(position) AS position FROM pi GROUP BY 1, 2", "pi")
def w8(s, d):
    return A.product_ingredients(s, d).groupBy("product_id", "ingredient_id").agg(F.max("position").cast("long").alias("position"))


@query("W-9", "SELECT d.product_id, other_id, similarity, price_delta_pct, rank::INTEGER AS rank, p.name AS other_name, l.price AS other_price FROM dupes d JOIN products p ON p.product_id = other_id LEFT JOIN latest l ON l.product_id = other_id", "dupes", "latest", "products")
def w9(s, d):
    return D.ranked_dupes(_edges(s, d), A.products(s, d), L.latest_in_stock(A.offers(s, d), TIE)).select("product_id", "other_id", "similarity", "price_delta_pct", "rank", "other_name", "other_price")


@query("W-10", f"SELECT {_O} FROM lowest", "lowest")
def w10(s, d):
    return L.lowest_offer(A.offers(s, d), TIE).select(_cols())


# -- orders, sets


@query("O-1", "SELECT archetype, url, ((row_number() OVER (PARTITION BY archetype ORDER BY url) - 1) // 100)::BIGINT AS shard FROM scored WHERE indexable AND dcs_score >= 70", "scored")
def o1(s, d):
    return V.sitemap(_indexed(s, d), 100).select("archetype", "url", "shard")


def _indexed(s, d):
    return C.promote(A.pages(s, d).withColumn("first_indexed_at", F.lit(None).cast("timestamp")), _scored(s, d), A.AS_OF)


@query("O-2", "SELECT url, priority, changefreq FROM (SELECT url, CASE WHEN archetype = 'product' THEN 0.8 ELSE 0.6 END::DOUBLE AS priority, 'daily' AS changefreq FROM scored WHERE indexable AND locale = 'en' ORDER BY url LIMIT 500)", "scored")
def o2(s, d):
    return V.global_sitemap(_indexed(s, d), "en", 500).select("url", "priority", "changefreq")


@query("O-3", f"SELECT item_id, tier, confidence FROM (SELECT * FROM (SELECT f.item_id, 'tier2' AS tier, t.score AS confidence FROM feed_ok f JOIN {_T2} t USING (item_id) JOIN {_SLUGGED} USING (item_id) WHERE variant_id IS NULL AND slug_variant IS NULL UNION ALL SELECT f.item_id, 'none', NULL FROM feed_ok f LEFT JOIN {_T2} t USING (item_id) JOIN {_SLUGGED} USING (item_id) WHERE variant_id IS NULL AND slug_variant IS NULL AND t.score IS NULL) WHERE confidence IS NULL OR confidence < 0.85) ORDER BY item_id DESC LIMIT 100", "feed_ok", "products")
def o3(s, d):
    return E.route(_resolved(s, d)).where("status = 'pending'").orderBy(F.desc("item_id")).limit(100).select("item_id", "tier", "confidence")


@query("O-4", f"SELECT product_id, retailer_id, per_ml, rank FROM (SELECT *, (row_number() OVER (PARTITION BY product_id ORDER BY per_ml, retailer_id))::INTEGER AS rank FROM (SELECT product_id, retailer_id, {half_up('(price / size_ml)', 6)} AS per_ml FROM best JOIN products USING (product_id))) WHERE rank <= 3", "best", "products")
def o4(s, d):
    rows = L.with_per_ml(L.best_per_retailer(A.offers(s, d), TIE), A.products(s, d)).withColumn("per_ml", X.half_up(F.col("per_ml"), 6))
    return L.first_by(rows, ["product_id"], ["per_ml", "retailer_id"], 3).select("product_id", "retailer_id", "per_ml", "rank")


_SETS = "(SELECT product_id, list(DISTINCT ingredient_id) AS s FROM pi GROUP BY 1)"
_V6 = f"""(SELECT a, b, {half_up("(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) * 100)", 0)}::BIGINT AS match_pct, {half_up("((o.price / p.size_ml - u.price / q.size_ml) / (o.price / p.size_ml) * 100)", 0)}::BIGINT AS savings_pct,
 len(list_intersect(x.s, y.s))::INTEGER AS shared, (len(x.s) - len(list_intersect(x.s, y.s)))::INTEGER AS unique_a, (len(y.s) - len(list_intersect(x.s, y.s)))::INTEGER AS unique_b
 FROM (SELECT a, b FROM edges) JOIN {_SETS} x ON x.product_id = a JOIN {_SETS} y ON y.product_id = b JOIN lowest o ON o.product_id = a JOIN lowest u ON u.product_id = b JOIN products p ON p.product_id = a JOIN products q ON q.product_id = b)"""


def _settled_edges(s, d):
    """The pairs of the edges, and a function that keeps the rows of their products: what is built on the pairs takes no others."""
    pairs = settled(lambda: _edges(s, d).select("a", "b"))
    named = written(D.of_pairs(pairs))
    return pairs, lambda rows: rows.join(named, "product_id", "left_semi")


def _set_similarity(s, d):
    pairs, only = _settled_edges(s, d)
    low = L.lowest_offer(only(A.offers(s, d)), TIE).join(only(A.products(s, d)).select("product_id", "size_ml"), "product_id")
    out = D.set_similarity(pairs, D.ingredient_sets(only(A.product_ingredients(s, d))), low)
    return out.select("a", "b", "match_pct", "savings_pct", *[F.size(c).alias(c) for c in ("shared", "unique_a", "unique_b")])


@query("O-5", f"SELECT a, b, match_pct, rank FROM (SELECT *, (row_number() OVER (PARTITION BY a ORDER BY match_pct DESC, b))::INTEGER AS rank FROM {_V6})", "edges", "pi", "lowest", "products")
def o5(s, d):
    return _set_similarity(s, d).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("match_pct"), "b"))).select("a", "b", "match_pct", "rank")


@query("SET-1", "SELECT slug, CASE WHEN product_id % 3 = 0 THEN 'live' ELSE 'fallback' END AS origin FROM products", "products")
def set1(s, d):
    p = A.products(s, d)
    live = p.where("product_id % 3 = 0")
    return live.withColumn("origin", F.lit("live")).unionByName(V.fallback_only(p, live).withColumn("origin", F.lit("fallback"))).select("slug", "origin")


@query("SET-2", f"SELECT a, b, shared, unique_a, unique_b FROM {_V6}", "edges", "pi", "lowest", "products")
def set2(s, d):
    return _set_similarity(s, d).select("a", "b", "shared", "unique_a", "unique_b")


@query("SET-3", "SELECT archetype FROM pages_ UNION SELECT archetype FROM search JOIN pages_ ON page_url = pages_.url", "pages_", "search")
def set3(s, d):
    return G.scorecard(_scored(s, d), _loaded(s, d), A.SEARCH_AS_OF, 365).select("archetype")


@query("SET-4", "SELECT DISTINCT product_id FROM pi", "pi")
def set4(s, d):
    return A.product_ingredients(s, d).select("product_id").distinct()


# -- composites


@query("V-1", "SELECT product_id, ingredient_id, round(weight, 6) AS weight FROM vec", "vec")
def v1(s, d):
    return D.formula_vectors(A.product_ingredients(s, d)).withColumn("weight", F.round("weight", 6))


_NARROW = 64


@query("V-1_dense", f"SELECT product_id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY product_id)), 3) AS weight FROM (SELECT product_id, dim, exp(-0.2 * (max(position) - 1)) * CASE WHEN max(position) <= 4 THEN 2.0 ELSE 1.0 END AS w FROM pi JOIN {_VOCAB} USING (ingredient_id) WHERE dim < {_NARROW} GROUP BY ALL)", "pi")
def v1_dense(s, d):
    """The cells over zero of arrays that are narrower than the vocabulary: what lies beyond is not used, also not in the length."""
    vocabulary = _vocabulary(s, d)
    dense = D.dense_vectors(D.formula_vectors(A.product_ingredients(s, d), vocabulary, _NARROW), vocabulary, _NARROW)
    return dense.select("product_id", F.posexplode("v").alias("dim", "weight")).where("weight > 0").withColumn("weight", F.round(F.col("weight").cast("double"), 3))


@query("V-2", f"SELECT a, b, {half_up('similarity', 6)} AS similarity FROM cos", "cos")
def v2(s, d):
    blocked = D.formula_vectors(A.product_ingredients(s, d)).join(A.products(s, d).select("product_id", "category"), "product_id")
    return D.pairwise_cosine(blocked, "category").withColumn("similarity", X.half_up(F.col("similarity"), 6))


@query("V-3", f"SELECT product_id, other_id, {half_up('similarity', 6)} AS similarity FROM cand", "cand")
def v3(s, d):
    return _candidates(s, d).select("product_id", "other_id", X.half_up(F.col("similarity"), 6).alias("similarity"))


@query("V-4", "SELECT a, b, price_delta_pct FROM edges", "edges")
def v4(s, d):
    return _edges(s, d).select("a", "b", "price_delta_pct")


@query("V-5", f"SELECT a, b, similarity, price_delta_pct, 'v1_inci_weighted' AS method_version, TIMESTAMP '{A.AS_OF}' AS computed_at FROM edges", "edges")
def v5(s, d):
    return _edges(s, d)


@query("V-5_refresh", f"SELECT product_id, other_id, {half_up('similarity', 6)} AS similarity, rank::INTEGER AS rank FROM cand", "cand")
def v5_refresh(s, d):
    """The lists are made from labels of which some lack their last slots, and are then refreshed for these products."""
    whole, shop = A.product_ingredients(s, d), A.products(s, d)
    changed = F.col("product_id") % 20 == 0
    old = settled(lambda: D.dupe_candidates(D.formula_vectors(whole.where(~changed | (F.col("position") <= 3))), shop))
    out = D.refresh_candidates(old, D.formula_vectors(whole), shop, shop.where(changed).select("product_id"))
    return out.select("product_id", "other_id", X.half_up(F.col("similarity"), 6).alias("similarity"), "rank")


@query("V-6", f"SELECT * FROM {_V6}", "edges", "pi", "lowest", "products")
def v6(s, d):
    return _set_similarity(s, d)


_LIST = "coalesce(list_transform({0}, lambda i: i::VARCHAR), [])"
_V7 = f"""SELECT pair, side, z.slug, z.name, z.brand, {half_up('z.per_ml', 4)} AS per_ml, z.per_ml <= o.per_ml AS cheaper, array_to_string(list_filter(CASE side WHEN 'a' THEN z.ids ELSE o.ids END, lambda i: list_contains(CASE side WHEN 'a' THEN o.ids ELSE z.ids END, i)), '|') AS shared,
 array_to_string(list_filter(z.ids, lambda i: NOT list_contains(o.ids, i)), '|') AS "unique", array_to_string(z.act, '|') AS actives, z.fit AS skin_fit, z.dcs_score
 FROM (SELECT p.slug || '-vs-' || q.slug AS pair, x.side, CASE side WHEN 'a' THEN a ELSE b END AS pid, CASE side WHEN 'a' THEN b ELSE a END AS oid FROM edges JOIN products p ON p.product_id = a JOIN products q ON q.product_id = b JOIN (VALUES ('a'), ('b')) x(side) ON true) e
 JOIN spec z ON z.product_id = pid JOIN spec o ON o.product_id = oid"""
_SPEC = f"""spec AS (SELECT p.product_id, p.slug, p.name, p.brand, l.price / p.size_ml AS per_ml, {_LIST.format('ids')} AS ids, {_LIST.format('act')} AS act, dcs_score, concat_ws('|', CASE WHEN p.product_id % 2 = 0 THEN 5 ELSE 2 END, CASE WHEN p.product_id % 3 = 0 THEN 5 ELSE 2 END, CASE WHEN p.product_id % 5 = 0 THEN 5 ELSE 2 END) AS fit
 FROM products p JOIN lowest l USING (product_id) JOIN scored ON scored.url = '/p/' || p.slug LEFT JOIN (SELECT product_id, list(ingredient_id ORDER BY position) AS ids, list(ingredient_id ORDER BY position) FILTER (WHERE act) AS act FROM (SELECT product_id, ingredient_id, min(position) AS position, bool_or(is_active) AS act FROM pi GROUP BY ALL) GROUP BY 1) USING (product_id))"""


@query("V-7")
def v7(s, d):
    edges, only = _settled_edges(s, d)
    p = _skin_types(only(A.products(s, d)))
    slug = {x: p.select(F.col("product_id").alias(x), F.col("slug").alias(f"slug_{x}")) for x in "ab"}
    pairs = edges.join(slug["a"], "a").join(slug["b"], "b").select(F.concat("slug_a", F.lit("-vs-"), "slug_b").alias("pair"), F.array("slug_a", "slug_b").alias("slugs"))
    out = V.compare(pairs, p, L.lowest_offer(only(A.offers(s, d)), TIE), only(A.product_ingredients(s, d)), written(_scored(s, d, only).select("url", "dcs_score")))
    return out.withColumns({"per_ml": X.half_up(F.col("per_ml"), 4)} | {c: joined(c) for c in ("shared", "unique", "actives", "skin_fit")})


ORACLE_SQL["V-7"] = sql("", "edges", "lowest", "products", "pi", "scored").rstrip() + f", {_SPEC} {_V7}"


@query("E-1", f"SELECT item_id, CASE WHEN variant_id IS NOT NULL THEN 'gtin' WHEN slug_variant IS NOT NULL THEN 'brand_slug_size' END AS method, coalesce(variant_id, slug_variant) AS variant_id FROM feed_ok JOIN {_SLUGGED} USING (item_id)", "feed_ok", "products")
def e1(s, d):
    return E.tier1(_sized(s, d), A.products(s, d)).select("item_id", "method", "variant_id")


@query("E-2", f"SELECT item_id, cand AS t2_id, score AS t2_score FROM {_T2} JOIN {_SLUGGED} USING (item_id) JOIN (SELECT item_id, variant_id FROM feed_ok) USING (item_id) WHERE variant_id IS NULL AND slug_variant IS NULL", "feed_ok", "products")
def e2(s, d):
    rest = E.tier1(_sized(s, d), A.products(s, d)).where("variant_id is null")
    return E.tier2(rest, A.products(s, d))


@query("E-2_difflib")
def e2_difflib(s, d):
    rest = E.tier1(_sized(s, d), A.products(s, d)).where("variant_id is null")
    return E.tier2(rest, A.products(s, d), mode="difflib")


@query("E-3")
def e3(s, d):
    rest = E.tier1(_sized(s, d), A.products(s, d)).where("variant_id is null")
    return E.tier3(rest, A.products(s, d), S.embed())


def _resolved(s, d, embed=None):
    return E.resolve(_sized(s, d), A.products(s, d), embed)


_RES = f"""(SELECT item_id, CASE WHEN v IS NOT NULL THEN 'tier1' WHEN score IS NULL THEN 'none' ELSE 'tier2' END AS tier, coalesce(v, cand) AS candidate_id, CASE WHEN v IS NOT NULL THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS confidence
 FROM (SELECT item_id, coalesce(variant_id, slug_variant) AS v, cand, score FROM feed_ok JOIN {_SLUGGED} USING (item_id) LEFT JOIN {_T2} USING (item_id)))"""


# tier 3 of what tiers 1 and 2 leave: 0.7 cosine + 0.3 size over the five nearest by cosine in the size band
_T3 = f"""(WITH two AS (SELECT f.item_id, coalesce(variant_id, slug_variant) AS v, t.cand AS t2_id, t.score AS t2, {clean_title("title", "brand_name")} AS clean, f.size_ml FROM feed_ok f JOIN {_SLUGGED} USING (item_id) LEFT JOIN {_T2} t USING (item_id)),
 kinds AS (SELECT DISTINCT clean, size_ml FROM two WHERE v IS NULL AND size_ml > 0 AND (t2 IS NULL OR t2 >= 0.70 AND t2 < 0.85)), emb AS {embedded("(SELECT clean AS text FROM kinds UNION SELECT name FROM products)")},
 near AS (SELECT q.text AS clean, c.text AS name, {half_up("sum(q.w * c.w)", 9)} AS cos FROM emb q JOIN emb c USING (dim) WHERE q.text IN (SELECT clean FROM kinds) AND c.text IN (SELECT name FROM products) GROUP BY 1, 2),
 found AS (SELECT k.clean, k.size_ml AS sa, p.size_ml AS sb, p.product_id AS cand, coalesce(cos, 0.0) AS cos FROM kinds k JOIN products p ON p.size_ml BETWEEN k.size_ml * 0.85 AND k.size_ml * 1.15 LEFT JOIN near n ON n.clean = k.clean AND n.name = p.name QUALIFY row_number() OVER (PARTITION BY k.clean, k.size_ml ORDER BY coalesce(cos, 0.0) DESC, p.product_id) <= 5),
 three AS (SELECT clean, sa AS size_ml, cand AS t3_id, {half_up(f"(0.7::DOUBLE * greatest(least(cos, 1.0), 0.0) + 0.3::DOUBLE * {_SIZE})", 4)} AS t3 FROM found QUALIFY row_number() OVER (PARTITION BY clean, sa ORDER BY t3 DESC, cand) = 1)
 SELECT two.*, t3_id, t3 FROM two LEFT JOIN three ON v IS NULL AND (t2 IS NULL OR t2 >= 0.70 AND t2 < 0.85) AND three.clean = two.clean AND three.size_ml = two.size_ml)"""


@query("E-4", f"""SELECT item_id, CASE WHEN v IS NOT NULL THEN 'tier1' WHEN t2 IS NULL AND t3 IS NULL THEN 'none' WHEN t3 >= coalesce(t2, 0) THEN 'tier3' ELSE 'tier2' END AS tier, CASE WHEN v IS NOT NULL THEN v WHEN t3 >= coalesce(t2, 0) THEN t3_id ELSE t2_id END AS candidate_id,
 CASE WHEN v IS NOT NULL THEN 1.0 WHEN t3 >= coalesce(t2, 0) THEN t3 ELSE coalesce(t2, 0.0) END::DOUBLE AS confidence FROM {_T3}""", "feed_ok", "products")
def e4(s, d):
    """All three tiers; the embedding is that of hashed tokens."""
    return _resolved(s, d, S.embed()).select("item_id", "tier", "candidate_id", "confidence")


@query("E-4_difflib")
def e4_difflib(s, d):
    return E.resolve(_sized(s, d), A.products(s, d), mode="difflib").select("item_id", "tier", "candidate_id", "confidence")


@query("E-4_embedding")
def e4_embedding(s, d):
    return _resolved(s, d, S.embed())


@query("E-5", f"SELECT item_id, tier, confidence >= 0.85 AS linked, CASE WHEN confidence >= 0.85 THEN candidate_id END AS variant_id, nullif(confidence, 0) AS confidence, CASE WHEN confidence < 0.85 THEN 'pending' END AS status FROM {_RES}", "feed_ok", "products")
def e5(s, d):
    return E.route(_resolved(s, d)).select("item_id", "tier", "linked", "variant_id", "confidence", "status")


@query("E-6")
def e6(s, d):
    return A.products(s, d).select("name").distinct().select("name", S.embed(dims=64)(F.col("name")).alias("v"))


@query("E-7")
def e7(s, d):
    p = A.products(s, d)
    names = p.select("name").distinct().withColumn("v", S.embed()(F.col("name")))
    return p.select("product_id", "name").join(names, "name").select("product_id", F.size("v").alias("dims"))


@query("E-8", f"SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, CASE WHEN item_id % 3 = 0 THEN candidate_id END AS variant_id, CASE WHEN item_id % 3 < 2 THEN 'ann' END AS reviewed_by FROM {_RES} WHERE confidence < 0.85", "feed_ok", "products")
def e8(s, d):
    return _reviewed(s, d)[0].select("item_id", "status", "variant_id", "reviewed_by")


def _reviewed(s, d):
    queue = E.route(_resolved(s, d)).where("status = 'pending'")
    k = F.col("item_id") % 3
    decisions = A.feed_items(s, d).where(k < 2).select("item_id", F.when(k == 0, "approved").otherwise("rejected").alias("decision"), F.lit("ann").alias("reviewer"), F.lit(None).cast("long").alias("variant_id"))
    items = feeds.normalise(A.feed_items(s, d)).withColumn("retailer_id", F.col("feed_id"))
    return E.apply_reviews(queue, decisions, A.AS_OF, items)


@query("E-8_offers", f"SELECT item_id, candidate_id AS variant_id, feed_id AS retailer_id, price, currency, affiliate_url, TIMESTAMP '{A.AS_OF}' AS seen_at FROM {_RES} JOIN feed_ok USING (item_id) WHERE confidence < 0.85 AND item_id % 3 = 0 AND candidate_id IS NOT NULL AND price > 0", "feed_ok", "products")
def e8_offers(s, d):
    """What the approvals append, read back from the ledger."""
    from shelfspark.sources.store import Ledger, new_folder

    ledger = Ledger(s, new_folder(s, "ledger"))
    ledger.append(_reviewed(s, d)[1], "reviews")
    return ledger.read().select("item_id", "variant_id", "retailer_id", F.col("price").cast("double").alias("price"), "currency", "affiliate_url", "seen_at")


@query("I-1", "SELECT item_id, outcome, error, CASE WHEN outcome = 'inserted' THEN variant_id END AS variant_id, size_ml FROM feed_ok", "feed_ok")
def i1(s, d):
    return L.ingest(A.feed_items(s, d), A.products(s, d)).select("item_id", "outcome", "error", F.when(F.col("outcome") == "inserted", F.col("variant_id")).alias("variant_id"), "size_ml")


@query("I-2", "SELECT n_name AS slug, s_suppkey AS retailer_id FROM supplier JOIN nation ON s_name ILIKE '%' || lpad(n_nationkey::VARCHAR, 3, '0') || '%'")
def i2(s, d):
    return V.retailers_like(A.table(s, d, "supplier"), A.table(s, d, "nation").select(F.col("n_name").alias("slug"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("part"))).select("slug", "retailer_id")


@query("C-1", "SELECT url, dcs_score, ok AS mandatory_passed, indexable FROM scored", "scored")
def c1(s, d):
    return _scored(s, d).select("url", "dcs_score", "mandatory_passed", "indexable")


@query("C-2", "SELECT url, archetype, has_full_ingredient_list, live_offer_count, parsed_review_count, price_history_days, has_image_and_variant_coverage, has_expert_annotation FROM pm", "pm")
def c2(s, d):
    return C.page_metrics(A.pages(s, d), _metrics(s, d)).select("url", "archetype", "has_full_ingredient_list", "live_offer_count", "parsed_review_count", "price_history_days", "has_image_and_variant_coverage", "has_expert_annotation")


@query("C-3", f"SELECT url, dcs_score, indexable, CASE WHEN entity_refs[1] % 5 = 0 THEN TIMESTAMP '2000-01-01' WHEN indexable THEN TIMESTAMP '{A.AS_OF}' END AS first_indexed_at FROM scored", "scored")
def c3(s, d):
    old = A.pages(s, d).withColumn("first_indexed_at", F.when(F.get("entity_refs", 0) % 5 == 0, F.lit("2000-01-01").cast("timestamp")))
    return C.promote(old, _scored(s, d), A.AS_OF).select("url", "dcs_score", "indexable", "first_indexed_at")


@query("C-3_product", "SELECT p.product_id, coalesce(s.dcs_score, 0) AS dcs_score, CASE WHEN s.indexable THEN 'indexed' WHEN s.indexable IS NULL AND p.product_id % 2 = 0 THEN 'old' ELSE 'provisional' END AS index_tier FROM products p LEFT JOIN scored s ON s.entity_refs[1] = p.product_id AND s.archetype IN ('product', 'p')", "products", "scored")
def c3_product(s, d):
    products = A.products(s, d).select("product_id", F.lit(0).alias("dcs_score"), F.when(F.col("product_id") % 2 == 0, "old").otherwise("provisional").alias("index_tier"))
    return C.sync_products(products, _scored(s, d))


@query("G-1", f"SELECT search.url, date, clicks, impressions, ctr, CASE WHEN date = DATE '{A.SEARCH_AS_OF}' - 2 OR clicks = 0 THEN position ELSE 0 END AS position, archetype, pages_.url AS page_url, date = DATE '{A.SEARCH_AS_OF}' - 2 AND clicks = 0 AS is_new FROM search JOIN pages_ ON page_url = pages_.url", "search", "pages_")
def g1(s, d):
    """The table has all days, but of the loaded day only pages with clicks; their stale positions are 0 and are replaced."""
    rows, target = A.search_rows(s, d), F.col("date") == F.date_sub(F.lit(A.SEARCH_AS_OF).cast("date"), 2)
    zero = F.when(F.col("clicks") > 0, F.lit(0.0)).otherwise(F.col("position"))
    existing = G.attach_pages(rows.where(~target | (F.col("clicks") > 0)).withColumn("position", zero), A.pages(s, d))
    raw = rows.where(target).select(F.array("url").alias("keys"), F.col("clicks").cast("double").alias("clicks"), F.col("impressions").cast("double").alias("impressions"), "ctr", "position")
    return G.load_search(raw, A.pages(s, d), existing, A.SEARCH_AS_OF).select("url", "date", "clicks", "impressions", "ctr", "position", "archetype", "page_url", "is_new")


def _lines(c: str, *fields: str):
    """Array of structs -> text: fields by colons, entries by bars; doubles as counts of thousandths, times as seconds."""
    forms = {"price": lambda x: F.round(x * 1000).cast("long"), "seen_at": F.unix_seconds, "dcs_score": lambda x: F.round(x * 1000).cast("long")}
    return F.array_join(F.transform(c, lambda e: F.concat_ws(":", *[forms.get(f, lambda x: x)(e[f].cast("timestamp") if f == "seen_at" else e[f]).cast("string") for f in fields])), "|")


_MILLI, _SECS = "round({0} * 1000)::BIGINT", "epoch(seen_at::TIMESTAMP)::BIGINT"
_INGS = "(SELECT product_id, string_agg(position || ':' || ingredient_id || ':' || is_active, '|' ORDER BY position) AS ingredients, coalesce(string_agg(ingredient_id::VARCHAR, '|' ORDER BY position) FILTER (WHERE is_active), '') AS actives FROM pi GROUP BY 1)"
_P, _TREND_DAYS = _MILLI.format("price"), 900


@query("R-1", f"""SELECT product_id, name, brand, slug, dcs_score, CASE WHEN dcs_score >= 70 AND indexable THEN 'index, follow' ELSE 'noindex, follow' END AS robots, coalesce(ingredients, '') AS ingredients, coalesce(offers, '') AS offers, coalesce(history, '') AS history
 FROM products JOIN scored ON scored.url = '/p/' || slug LEFT JOIN {_INGS} USING (product_id)
 LEFT JOIN (SELECT product_id, string_agg({_P} || ':' || retailer_id || ':' || currency || ':' || {_SECS}, '|' ORDER BY price, retailer_id, currency, seen_at) AS offers FROM best GROUP BY 1) USING (product_id)
 LEFT JOIN (SELECT product_id, string_agg(rank || ':' || {_SECS} || ':' || {_P} || ':' || currency || ':' || retailer_id, '|' ORDER BY rank) AS history FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seen_at, l_orderkey, l_linenumber, retailer_id, price) AS rank FROM offers WHERE seen_at >= TIMESTAMP '{A.AS_OF}' - INTERVAL {_TREND_DAYS} DAY) WHERE rank <= 200 GROUP BY 1) USING (product_id)""", "products", "scored", "pi", "best", "offers")
def r1(s, d):
    """A trend of 900 days: the test tables have years of offers."""
    out = V.product_detail(A.products(s, d), A.product_ingredients(s, d), A.offers(s, d), _scored(s, d), A.AS_OF, TIE, _TREND_DAYS)
    return out.select("product_id", "name", "brand", "slug", "dcs_score", "robots", _lines("ingredients", "position", "ingredient_id", "is_active").alias("ingredients"), _lines("offers", "price", "retailer_id", "currency", "seen_at").alias("offers"), _lines("history", "rank", "seen_at", "price", "currency", "retailer_id").alias("history"))


_R2 = f"""SELECT product_id, name, coalesce(ingredients, '') AS ingredients, coalesce(actives, '') AS actives, coalesce(offers, '') AS offers, CASE WHEN low.price < mrp THEN low.price ELSE mrp END AS lowest_price, CASE WHEN low.price < mrp THEN low.rid::VARCHAR ELSE 'Nykaa' END AS retailer FROM products LEFT JOIN {_INGS} USING (product_id)
 LEFT JOIN (SELECT product_id, price, retailer_id AS rid FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, seen_at, l_orderkey, l_linenumber, retailer_id) AS r FROM offers WHERE in_stock) WHERE r = 1) low USING (product_id)
 LEFT JOIN (SELECT product_id, string_agg({_P} || ':' || {_SECS} || ':' || retailer_id || ':' || currency, '|' ORDER BY price, seen_at, l_orderkey, l_linenumber, retailer_id, currency) AS offers FROM offers WHERE in_stock GROUP BY 1) USING (product_id)"""


def _listed(s, d, products):
    out = V.product_list(products, A.offers(s, d), A.product_ingredients(s, d), TIE)
    return out.select("product_id", "name", "lowest_price", "retailer", joined("actives").alias("actives"), _lines("ingredients", "position", "ingredient_id", "is_active").alias("ingredients"), _lines("offers", "price", "seen_at", "retailer_id", "currency").alias("offers"))


@query("R-2", _R2, "products", "offers", "pi")
def r2(s, d):
    return _listed(s, d, V.product_filter(A.products(s, d), limit=None))


@query("R-2_page", f"SELECT * FROM ({_R2} WHERE category = 'SMALL' AND name ILIKE '%r%' ORDER BY name, product_id LIMIT 20 OFFSET 5)", "products", "offers", "pi")
def r2_page(s, d):
    """The list's page: filters, limit and offset are the feature."""
    return _listed(s, d, V.product_filter(A.products(s, d), "SMALL", q="r", limit=20, offset=5))


@query("R-3", f"""SELECT wanted, ingredient_id, inci_name, coalesce(products, 0) AS products, coalesce(top, '') AS top FROM (SELECT c AS wanted, min(ingredient_id) AS ingredient_id FROM each JOIN ing ON {slug_a('c')} = {slug_a('inci_name')} GROUP BY c) JOIN ing USING (ingredient_id)
 LEFT JOIN (SELECT ingredient_id, count(*) AS products, string_agg(rank || ':' || product_id || ':' || slug || ':' || position || ':' || act || ':' || {_MILLI.format('mrp')}, '|' ORDER BY rank) FILTER (WHERE rank <= 20) AS top FROM (SELECT *, row_number() OVER (PARTITION BY ingredient_id ORDER BY position, mrp DESC, product_id) AS rank
  FROM (SELECT ingredient_id, product_id, min(position) AS position, bool_or(is_active) AS act, any_value(mrp) AS mrp, any_value(slug) AS slug FROM pi JOIN products USING (product_id) GROUP BY 1, 2)) GROUP BY 1) USING (ingredient_id)""", "each", "ing", "pi", "products")
def r3(s, d):
    wanted = N.tokenize(A.labels(s, d)).select(F.explode("candidates").alias("c")).select(F.upper(F.trim("c")).alias("wanted")).distinct()
    out = V.ingredient_detail(A.product_ingredients(s, d), A.products(s, d).withColumn("dcs_score", F.col("mrp")), wanted=wanted, ingredients=A.ingredients(s))
    return out.select("wanted", "ingredient_id", "inci_name", F.col("products").cast("long").alias("products"), _lines("top", "rank", "product_id", "slug", "position", "is_active", "dcs_score").alias("top"))


@query("R-3_all", "SELECT ingredient_id, count(*) AS products, min(position) AS best_position FROM (SELECT ingredient_id, product_id, min(position) AS position FROM pi GROUP BY 1, 2) GROUP BY 1", "pi")
def r3_all(s, d):
    out = V.ingredient_detail(A.product_ingredients(s, d), A.products(s, d).withColumn("dcs_score", F.col("mrp")))
    return out.select("ingredient_id", "products", F.array_min(F.transform("top", lambda t: t["position"])).cast("long").alias("best_position"))


@query("R-4", f"SELECT x.url, CASE WHEN x.indexable THEN 'index, follow' ELSE 'noindex, follow' END AS robots, coalesce(string_agg(y.locale || '=' || y.url, '|' ORDER BY y.locale, y.url), '') AS hreflang FROM {_REFS} x LEFT JOIN {_REFS} y ON x.archetype = y.archetype AND x.ref = y.ref AND y.indexable GROUP BY x.url, x.indexable", "scored")
def r4(s, d):
    out = V.page_metadata(_shared_refs(s, d))
    return out.select("url", "robots", F.array_join(F.transform("hreflang", lambda h: F.concat(h["locale"], F.lit("="), h["url"])), "|").alias("hreflang"))


def _created(s, d):
    p, k = A.products(s, d), F.col("product_id")
    name = F.concat_ws(" ", "name", F.col("size_ml").cast("int").cast("string"))
    asked = p.select(k.alias("request_id"), F.col("brand").alias("brand_name"), name.alias("name"), "category", F.lit("cream").alias("format"), F.array().cast("array<string>").alias("claims"), "size_ml", F.col("mrp").alias("price"), F.lit("INR").alias("currency"), F.when(k % 2 == 0, "Nykaa").otherwise("Tira").alias("retailer_name"))
    asked = asked.join(A.labels(s, d).select(F.col("label_id").alias("request_id"), F.col("raw").alias("raw_ingredients")), "request_id")
    old = p.where("size_ml < 5").select(F.concat_ws("-", X.slug_a(F.col("brand"), False), X.slug_a(name, False)).alias("slug")).distinct()
    brands = p.select(X.slug_a(F.col("brand"), False).alias("brand_slug")).where("brand_slug like 'brand1%'").distinct().withColumn("brand_id", F.col("brand_slug"))
    shops = p.select(F.lit("Nykaa").alias("retailer_name"), F.lit("r1").alias("retailer_id")).distinct()
    return V.create_products(asked, brands, old, shops, A.ingredients(s), A.AS_OF)


_NAME5 = "p_name || ' ' || p_size"
_NEW = f"""(SELECT *, s NOT IN (SELECT {slug_a('p_brand', False)} || '-' || {slug_a(_NAME5, False)} FROM part WHERE p_size < 5) AND row_number() OVER (PARTITION BY s ORDER BY p_partkey) = 1 AS ok FROM (SELECT *, {slug_a('p_brand', False)} AS bs, {slug_a('p_brand', False)} || '-' || {slug_a(_NAME5, False)} AS s, {_NAME5} AS n, CASE WHEN p_partkey % 2 = 0 THEN 'Nykaa' ELSE 'Tira' END AS shop FROM part))"""


@query("R-5", f"""SELECT p_partkey AS request_id, s AS slug, n AS name, p_brand AS brand_name, CASE WHEN ok THEN 'created' ELSE 'exists' END AS status, CASE WHEN ok THEN bs NOT LIKE 'brand1%' END AS brand_new, CASE WHEN ok THEN shop <> 'Nykaa' END AS retailer_new, CASE WHEN ok THEN '/p/' || bs || '/' || s END AS page_url, CASE WHEN ok THEN 'https://www.' || lower(shop) || '.com/p/' || s END AS affiliate_url,
 CASE WHEN ok THEN CASE WHEN known > 0 THEN 40 ELSE 10 END END AS dcs_score, CASE WHEN ok THEN 'provisional' END AS index_tier, CASE WHEN ok THEN 1 END::BIGINT AS offers, CASE WHEN ok THEN coalesce(slots, 0) END AS ingredients, CASE WHEN ok THEN coalesce(slots - known, 0) END AS review
 FROM {_NEW} LEFT JOIN (SELECT label_id, count(*) AS slots, count(ingredient_id) AS known FROM norm GROUP BY 1) ON label_id = p_partkey""", "norm")
def r5(s, d):
    return _created(s, d)["summary"]


@query("R-5_rows", f"SELECT s AS slug, p_size::DOUBLE AS size_ml, p_retailprice AS mrp, CASE shop WHEN 'Nykaa' THEN 'r1' ELSE left(sha256('Tira'), 32) END AS retailer_id, CASE WHEN bs LIKE 'brand1%' THEN bs ELSE left(sha256(bs), 32) END AS brand_id, listed, vector FROM {_NEW} LEFT JOIN (SELECT label_id, string_agg(position || ':' || ingredient_id || ':' || (position <= 4), '|' ORDER BY position) AS listed FROM norm WHERE ingredient_id IS NOT NULL GROUP BY 1) a ON a.label_id = p_partkey LEFT JOIN (SELECT label_id, string_agg(ingredient_id || ':' || round(10000 * w / sqrt(t))::BIGINT, '|' ORDER BY ingredient_id) AS vector FROM (SELECT *, sum(w * w) OVER (PARTITION BY label_id) AS t FROM (SELECT label_id, ingredient_id, exp(-0.2 * (max(position) - 1)) * CASE WHEN max(position) <= 4 THEN 2.0 ELSE 1.0 END AS w FROM norm WHERE ingredient_id IS NOT NULL GROUP BY ALL)) GROUP BY 1) v ON v.label_id = p_partkey WHERE ok", "norm")
def r5_rows(s, d):
    """The rows that the batch adds, put together by product."""
    t = _created(s, d)
    slot = F.concat_ws(":", *[F.col(x).cast("string") for x in ("position", "ingredient_id", "is_active")])
    listed = t["product_ingredient"].groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("position", slot.alias("t")))).alias("x")).select("product_id", joined("x.t").alias("listed"))
    entry = F.concat_ws(":", F.col("ingredient_id").cast("string"), F.round(F.col("weight") * 10000).cast("long").cast("string"))
    vector = t["vector"].groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("ingredient_id", entry.alias("t")))).alias("x")).select("product_id", joined("x.t").alias("vector"))
    rows = t["product"].join(t["variant"], "product_id").join(t["offer"].select("product_id", "retailer_id"), "product_id").join(listed, "product_id", "left").join(vector, "product_id", "left")
    return rows.select("slug", "size_ml", "mrp", "retailer_id", "brand_id", "listed", "vector")


@query("ST-1", "SELECT item_id, outcome, CASE WHEN outcome = 'inserted' THEN variant_id END AS variant_id, size_ml FROM feed_ok", "feed_ok")
def st1(s, d):
    from shelfspark.streaming.ingest import replay_feed

    out = replay_feed(s, A.feed_items(s, d), A.products(s, d))
    return out.withColumn("variant_id", F.when(F.col("outcome") == "inserted", F.col("variant_id")))


@query("ST-2", "SELECT event_id % 500 AS offer_id, ts AS clicked_at, NULL::VARCHAR AS referrer, NULL::VARCHAR AS user_agent, left(sha256(user_id::VARCHAR), 32) AS ip_hash FROM events WHERE event_type = 'click' AND event_id % 500 IN (SELECT p_partkey FROM part)")
def st2(s, d):
    from shelfspark.streaming.ingest import replay_clicks

    e = A.table(s, d, "events").where("event_type = 'click'")
    clicks = e.select((F.col("event_id") % 500).alias("offer_id"), F.col("ts").alias("clicked_at"), F.lit(None).cast("string").alias("referrer"), F.lit(None).cast("string").alias("user_agent"), F.col("user_id").cast("string").alias("ip"))
    return replay_clicks(s, clicks, A.table(s, d, "part").select(F.col("p_partkey").alias("offer_id")))
