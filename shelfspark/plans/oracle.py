"""SQL of the queries for DuckDB: the adapters as CTEs, and a body for each query (beside the query in queries.py)."""

from __future__ import annotations

from shelfspark.functions import text
from shelfspark.plans.adapters import INGREDIENTS


def half_up(x: str, digits: int = 2) -> str:
    s = f"{10**digits}.0"
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def slug_b(x: str) -> str:
    return f"coalesce(nullif(left(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), 100), ''), 'product')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_rows = ", ".join(f"({i}::BIGINT, {_text(n)}, [{', '.join(map(_text, s))}])" for i, (n, s) in enumerate(INGREDIENTS))
_bare = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '\d+(?:\.\d+)?\s*%', ' ', 'g'), '\s+', ' ', 'g'))"
_clean = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\band\b', ' ', 'g'), '\d+(?:\.\d+)?\s*%', ' ', 'g'), '\s+', ' ', 'g'))"
UNIT = text.UNIT[1:-1]
_num = r"(\d+(?:[.,]\d+)?)"


def volume_ml(raw: str) -> str:
    t = rf"regexp_replace(trim({raw}), '\s+', ' ', 'g')"
    multi, single = rf"(?i){_num}\s*[x×]\s*{_num}\s*({UNIT})", rf"(?i){_num}\s*({UNIT})"

    def n(p, g):
        return f"replace(nullif(regexp_extract({t}, '{p}', {g}), ''), ',', '.')::DOUBLE"

    def f(p, g):
        u = f"lower(regexp_extract({t}, '{p}', {g}))"
        return f"(CASE WHEN {u} = '' THEN NULL WHEN contains({u}, 'o') AND contains({u}, 'z') OR contains({u}, 'ounce') THEN 29.5735 WHEN {u} IN ('kg', 'l') OR {u} LIKE 'kilo%' OR {u} LIKE 'lit%' THEN 1000.0 ELSE 1.0 END)::DOUBLE"

    return half_up(f"coalesce({n(multi, 1)} * {n(multi, 2)} * {f(multi, 3)}, {n(single, 1)} * {f(single, 2)})")


def slug_a(x: str, collapse: bool = True) -> str:
    out = rf"regexp_replace(regexp_replace(trim(lower({x})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g')"
    return f"trim(regexp_replace({out}, '-+', '-', 'g'), '-')" if collapse else f"trim({out}, '-')"


def clean_title(title: str, brand: str) -> str:
    t = f"(CASE WHEN coalesce(starts_with(lower(trim({title})), lower({brand})), false) THEN substring(trim({title}), length({brand}) + 1) ELSE trim({title}) END)"
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({t}, '(?i){_num}\s*({UNIT})', '', 'g'), '\d+(?:\.\d+)?\s*%', '', 'g'), '\s+', ' ', 'g'), ' ,;-+')"


def cand_list(slot: str) -> str:
    parts = f"list_concat(list_concat(string_split({_bare.format(slot)}, '/'), regexp_extract_all({slot}, '\\(([^)]*)\\)', 1)), regexp_extract_all(regexp_replace({slot}, '\\([^)]*\\)', ' ', 'g'), '\\[([^\\]]*)\\]', 1))"
    return f"list_filter(list_transform({parts}, lambda c: {_clean.format('c')}), lambda c: lower(c) NOT IN ('may contain', 'peut contenir', '+/-', 'and', 'oder', 'et', ''))"


_crc = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _crc[_i] = _c


def crc32(x: str) -> str:
    """As zlib's, of a text's UTF-8 bytes."""
    parts = f"list_transform(range(len(hex({x})) // 2), lambda i: ('0x' || substring(hex({x}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {parts}), lambda c, b: xor(c >> 8, ({_crc}::BIGINT[])[(xor(c, b) & 255)::INTEGER + 1])), 4294967295::BIGINT)"


def embedded(texts: str, dims: int = 384) -> str:
    """(text, dim, w) of a subquery with text, as scores.embed without a model makes them: hashed tokens, unit vectors of floats."""
    tokens = f"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS token FROM {texts}"
    each = f"SELECT text, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '')) AS token FROM (SELECT DISTINCT text FROM {texts})"
    return f"(SELECT text, dim, (n / sqrt(sum(n * n) OVER (PARTITION BY text)))::FLOAT::DOUBLE AS w FROM (SELECT text, dim, count(*)::DOUBLE AS n FROM ({each}) JOIN (SELECT token, {crc32('token')} % {dims} AS dim FROM ({tokens})) USING (token) GROUP BY 1, 2))"


#: name -> (what it needs, body)
CTES: dict[str, tuple[list[str], str]] = {
    "products": ([], f"SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_size::DOUBLE AS size_ml, p_retailprice AS mrp, lpad(p_partkey::VARCHAR, 13, '0') AS gtin, {slug_b('p_brand')} || '-' || {slug_b('p_name')} || '-' || p_partkey AS slug FROM part"),
    "retailers": ([], "SELECT s_suppkey AS retailer_id, s_name AS retailer, n_name AS market FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "offers": ([], f"SELECT l_orderkey, l_linenumber, l_partkey AS product_id, l_suppkey AS retailer_id, {half_up('(l_extendedprice / l_quantity)')} AS price, l_linestatus = 'O' AS in_stock, CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'R' THEN 'EUR' ELSE 'INR' END AS currency, l_shipdate AS seen_at FROM lineitem"),
    "pi": ([], "SELECT *, position <= 4 AS is_active FROM (SELECT l_partkey AS product_id, l_suppkey AS ingredient_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS position FROM lineitem)"),
    "pages_": (["products"], "SELECT '/p/' || slug AS url, ['product', 'p', 'dupe', 'vs', 'ingredient', 'best', 'conflict'][product_id % 7 + 1] AS archetype, [product_id] AS entity_refs, CASE WHEN product_id % 2 = 0 THEN 'en' ELSE 'hi' END AS locale, product_id FROM products"),
    "feed": ([], f"""SELECT k AS item_id, k % 3 AS feed_id, ' SKU-' || k AS retailer_sku, CASE WHEN k % 5 = 0 THEN ' ' WHEN k % 11 = 0 THEN '9999999999999' ELSE lpad(k::VARCHAR, 13, '0') END AS gtin,
  ' ' || p_brand || ' ' || p_name || ' ' || s || 'ml 10% ' AS title, CASE WHEN k % 7 <> 0 THEN p_brand END AS brand_name,
  [s || 'ml', s || ' fl oz', '2 x ' || s || ' ml', s || ',5 g', s || ' oz', 'large', s || ' litres', s || 'ml / 1.7 oz'][k % 8 + 1] AS raw_size,
  CASE WHEN k % 13 = 0 THEN '-1' ELSE printf('%.2f', {half_up('p_retailprice')}) END AS price, CASE WHEN k % 17 = 0 THEN 'rupee' ELSE 'inr' END AS currency, true AS in_stock,
  CASE WHEN k % 19 = 0 THEN 'x' ELSE 'https://shop.example/p/' || k END AS affiliate_url FROM (SELECT *, p_partkey AS k, p_size::VARCHAR AS s FROM part)"""),
    "feed_ok": (["feed"], f"""SELECT *, CASE WHEN len(errors) > 0 OR size_ml IS NULL THEN 'failed' WHEN variant_id IS NULL THEN 'skipped' ELSE 'inserted' END AS outcome,
  CASE WHEN len(errors) > 0 THEN array_to_string(errors, '; ') WHEN size_ml IS NULL THEN 'unreadable size' WHEN variant_id IS NULL THEN 'no variant' END AS error
  FROM (SELECT f.* EXCLUDE (retailer_sku, gtin, title, price, currency), trim(retailer_sku) AS retailer_sku, nullif(trim(gtin), '') AS gtin, trim(title) AS title, price::DOUBLE AS price, upper(currency) AS currency,
    list_filter([CASE WHEN price::DOUBLE <= 0 THEN 'bad price' END, CASE WHEN length(currency) <> 3 THEN 'bad currency' END, CASE WHEN length(affiliate_url) < 10 THEN 'bad url' END], lambda e: e IS NOT NULL) AS errors,
    {volume_ml("raw_size")} AS size_ml, p_partkey AS variant_id FROM feed f LEFT JOIN part ON nullif(trim(gtin), '') = lpad(p_partkey::VARCHAR, 13, '0'))"""),
    "search": (["products"], f"""SELECT 'https://shop.example/p/' || slug || '?src=s#top' AS url, date, clicks, impressions, {half_up("(clicks / greatest(impressions, 1))", 4)} AS ctr, position, '/p/' || slug AS page_url
  FROM (SELECT user_id % 200 AS product_id, ts::DATE AS date, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS impressions, {half_up("(avg(value) / 100)")} AS position
    FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) JOIN products USING (product_id)"""),
    "ing": ([], f"SELECT * FROM (VALUES {_rows}) t(ingredient_id, inci_name, synonyms)"),
    "labels_": (["products", "ing"], """SELECT product_id AS label_id, string_agg(CASE (product_id + k) % 6 WHEN 0 THEN inci_name WHEN 1 THEN inci_name || ' (' || synonyms[1] || ')' WHEN 2 THEN upper(synonyms[1]) WHEN 3 THEN inci_name || right(inci_name, 1) WHEN 4 THEN inci_name || ' 2.5%' ELSE 'Mystery Oil ' || k || ' / ' || inci_name END, ', ' ORDER BY k) AS raw
  FROM products, (SELECT unnest(range(6)) AS k) JOIN ing ON ingredient_id = (product_id * 7 + k * 11) % 30 GROUP BY product_id"""),
    "tokens": (["labels_"], f"""SELECT label_id, row_number() OVER (PARTITION BY label_id ORDER BY i) AS position, raw_token, cands FROM (
  SELECT label_id, i, raw_token, {cand_list("raw_token")} AS cands FROM (SELECT label_id, unnest(range(len(s))) AS i, trim(unnest(s)) AS raw_token FROM (SELECT label_id, string_split(raw, ',') AS s FROM labels_)) WHERE raw_token <> '') WHERE len(cands) > 0"""),
    "keys": (["ing"], "SELECT kind, key, min(ingredient_id) AS ingredient_id FROM (SELECT 0 AS kind, upper(trim(inci_name)) AS key, ingredient_id FROM ing UNION ALL SELECT 1, upper(trim(unnest(synonyms))), ingredient_id FROM ing) GROUP BY kind, key"),
    "each": (["tokens"], "SELECT label_id, position, unnest(range(len(cands))) AS n, upper(trim(unnest(cands))) AS c FROM tokens"),
    "exact": (["each", "keys"], "SELECT label_id, position, ingredient_id, CASE WHEN kind = 0 THEN 'exact' ELSE 'synonym' END AS match_method, 1.0::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY label_id, position ORDER BY kind, n) AS r FROM each JOIN keys ON c = key) WHERE r = 1"),
    "fuzzy": (["exact"], f"""SELECT label_id, position, ingredient_id, 'fuzzy' AS match_method, {half_up("score", 4)} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY label_id, position ORDER BY score DESC, n, kind, key) AS r
  FROM (SELECT e.*, k.*, 1 - levenshtein(c, key) / greatest(length(c), length(key), 1) AS score FROM each e JOIN keys k ON true WHERE NOT EXISTS (SELECT 1 FROM exact x WHERE x.label_id = e.label_id AND x.position = e.position)) WHERE score >= 0.85) WHERE r = 1"""),
    "norm": (["fuzzy"], "SELECT t.label_id, t.position, t.raw_token, m.ingredient_id, inci_name, coalesce(match_method, 'unmatched') AS match_method, coalesce(confidence, 0.0)::DOUBLE AS confidence, match_method IS NULL AS flagged FROM tokens t LEFT JOIN (SELECT * FROM exact UNION ALL SELECT * FROM fuzzy) m USING (label_id, position) LEFT JOIN ing USING (ingredient_id)"),
    "vec": (["pi"], "SELECT product_id, ingredient_id, w / sqrt(sum(w * w) OVER (PARTITION BY product_id)) AS weight FROM (SELECT product_id, ingredient_id, exp(-0.2 * (max(position) - 1)) * CASE WHEN max(position) <= 4 THEN 2.0 ELSE 1.0 END AS w FROM pi GROUP BY ALL)"),
    "cos": (["vec", "products"], "SELECT x.product_id AS a, y.product_id AS b, greatest(least(sum(x.weight * y.weight), 1.0), -1.0) AS similarity FROM (vec JOIN products USING (product_id)) x JOIN (vec JOIN products USING (product_id)) y ON x.category = y.category AND x.ingredient_id = y.ingredient_id AND x.product_id < y.product_id GROUP BY ALL"),
    "cand": (["cos"], f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {half_up('similarity', 9)} DESC, other_id) AS rank FROM (SELECT a AS product_id, b AS other_id, similarity FROM cos WHERE similarity >= 0.6 UNION ALL SELECT b, a, similarity FROM cos WHERE similarity >= 0.6)) WHERE rank <= 20"),
    "latest": (["offers"], "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY seen_at DESC, l_orderkey, l_linenumber, retailer_id, price) AS r FROM offers WHERE in_stock) WHERE r = 1"),
    "best": (["offers"], "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, retailer_id ORDER BY price, seen_at DESC, l_orderkey, l_linenumber, retailer_id, price) AS r FROM offers WHERE in_stock) WHERE r = 1"),
    "lowest": (["offers"], "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY in_stock DESC, CASE WHEN in_stock THEN price END NULLS FIRST, seen_at, l_orderkey, l_linenumber, retailer_id, price) AS r FROM offers) WHERE r = 1"),
    "edges": (["cand", "latest"], f"""SELECT a, b, {half_up("similarity", 4)} AS similarity, CASE WHEN x.currency = y.currency THEN {half_up("((x.price / p.size_ml - y.price / q.size_ml) / (y.price / q.size_ml) * 100)")} ELSE 0.0 END AS price_delta_pct
  FROM (SELECT least(product_id, other_id) AS a, greatest(product_id, other_id) AS b, max(similarity) AS similarity FROM cand GROUP BY ALL) e JOIN products p ON p.product_id = a JOIN products q ON q.product_id = b LEFT JOIN latest x ON x.product_id = a LEFT JOIN latest y ON y.product_id = b"""),
    "dupes": (["edges"], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY similarity DESC, other_id) AS rank FROM (SELECT a AS product_id, b AS other_id, similarity, price_delta_pct FROM edges UNION ALL SELECT b, a, similarity, -price_delta_pct FROM edges)) WHERE rank <= 10"),
    "metrics": (["pi", "offers", "products"], """SELECT product_id, coalesce(n, 0) > 0 AS has_full_ingredient_list, coalesce(k, 0) AS live_offer_count, coalesce(r, 0) AS live_retailers, (product_id % 30)::BIGINT AS parsed_review_count, greatest(coalesce(d, 0), 0) AS price_history_days, product_id % 6 <> 5 AS has_image_and_variant_coverage, product_id % 4 = 0 AS has_expert_annotation
  FROM products LEFT JOIN (SELECT product_id, count(*) AS n FROM pi GROUP BY 1) USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS k, count(DISTINCT retailer_id) AS r, date_sub('day', min(seen_at), max(seen_at)) AS d FROM offers WHERE in_stock GROUP BY 1) USING (product_id)"""),
    "pm": (["metrics", "pages_"], """SELECT url, archetype, entity_refs, locale, CASE WHEN u THEN coalesce(has_full_ingredient_list, false) ELSE archetype IN ('ingredient', 'best') END AS has_full_ingredient_list, CASE WHEN u THEN live_offer_count ELSE 0 END AS live_offer_count, CASE WHEN u THEN parsed_review_count ELSE 0 END AS parsed_review_count, CASE WHEN u THEN price_history_days ELSE 0 END AS price_history_days, u AND has_image_and_variant_coverage AS has_image_and_variant_coverage, u AND has_expert_annotation AS has_expert_annotation
  FROM (SELECT *, archetype IN ('product', 'p', 'dupe', 'vs', 'under') AS u FROM pages_) JOIN metrics USING (product_id)"""),
    "scored": (["pm"], """SELECT *, ok AND dcs_score >= 70 AS indexable FROM (SELECT *, (CASE WHEN has_full_ingredient_list THEN 30 ELSE 0 END + CASE WHEN live_offer_count >= 2 THEN 20 ELSE 0 END + CASE WHEN parsed_review_count >= 15 THEN 20 ELSE 0 END + CASE WHEN price_history_days >= 30 THEN 10 ELSE 0 END + CASE WHEN has_image_and_variant_coverage THEN 10 ELSE 0 END + CASE WHEN has_expert_annotation THEN 10 ELSE 0 END)::INTEGER AS dcs_score,
  has_full_ingredient_list AND NOT (archetype IN ('product', 'p') AND live_offer_count < 2) AND NOT (archetype IN ('ingredient', 'best') AND NOT has_expert_annotation) AS ok FROM pm)"""),
}


def sql(body: str, *needs: str) -> str:
    """WITH every CTE that the body needs."""
    order: list[str] = []

    def add(name):
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return (f"WITH {', '.join(f'{n} AS ({CTES[n][1]})' for n in order)} " if order else "") + body
