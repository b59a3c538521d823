"""Queries over scans, preprocessing, texts, numbers and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, kv, numeric, stem, text
from ..operators import filters, preprocess, profile, rank
from ..sources import tables
from ..streaming import ingest
from .bindings import STAR, points, POINTS, query, read, rounded, star


@query("s02_projection", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s02(spark, sf):
    return tables.scan(spark, sf, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"]).filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s04_head", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def s04(spark, sf):
    return read(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("s05_row_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'part', count(*) FROM part")
def s05(spark, sf):
    one = lambda n: read(spark, sf, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("documents").unionByName(one("lineitem")).unionByName(one("part"))


@query("s05_schema")
def s05b(spark, sf):
    return tables.schema_of(read(spark, sf, "lineitem"))


SAMPLED = "CAST('0x' || substr(md5(p_partkey::VARCHAR || ':3'), 1, 8) AS BIGINT) < CAST(floor(0.4 * 4294967296) AS BIGINT)"


@query("s07_catalog", f"SELECT p_partkey, p_name, p_brand FROM part WHERE {SAMPLED}")
def s07(spark, sf):
    part = read(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return tables.catalog(part, tables.sample_hash(part, "p_partkey", 0.4, 3), "p_partkey", ["p_name", "p_brand"])


@query("s08_item_locations", f"SELECT item_id, min(item_location_id) AS item_location_id FROM {STAR} GROUP BY item_id")
def s08(spark, sf):
    return tables.first_by(star(spark, sf).select("item_id", "item_location_id"), "item_id", ["item_location_id"])


@query("s09_geo_pairs", f"SELECT search_location_id, item_location_id, count(*) AS n FROM {STAR} GROUP BY ALL")
def s09(spark, sf):
    return tables.geo_pairs(star(spark, sf)).groupBy("search_location_id", "item_location_id").agg(F.count("*").alias("n"))


@query("s09_geo_pairs_lookup", f"WITH s AS {STAR}, l AS (SELECT item_id, min(item_location_id) AS item_location_id FROM s GROUP BY item_id) SELECT search_location_id, l.item_location_id, count(*) AS n FROM s LEFT JOIN l USING (item_id) GROUP BY ALL")
def s09b(spark, sf):
    pairs = star(spark, sf)
    places = tables.first_by(pairs.select("item_id", "item_location_id"), "item_id", ["item_location_id"])
    return tables.geo_pairs(pairs, places).groupBy("search_location_id", "item_location_id").agg(F.count("*").alias("n"))


@query("s11_first_row", "SELECT source, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def s11(spark, sf):
    return tables.first_by(read(spark, sf, "documents", "source", "doc_id", "n_chars"), "source", ["doc_id"])


@query("s12_extra_items", f"SELECT p_partkey, p_name FROM part WHERE NOT ({SAMPLED})")
def s12(spark, sf):
    part = read(spark, sf, "part", "p_partkey", "p_name")
    return tables.extra_items(part, tables.sample_hash(part, "p_partkey", 0.4, 3), "p_partkey", ["p_name"])


@query("s29_sample", "SELECT event_id, event_type FROM events WHERE CAST('0x' || substr(md5(event_id::VARCHAR || ':0'), 1, 8) AS BIGINT) < CAST(floor(0.25 * 4294967296) AS BIGINT)")
def s29(spark, sf):
    return tables.sample_hash(read(spark, sf, "events", "event_id", "event_type"), "event_id", 0.25)


# --- preprocessing -----------------------------------------------------------------------------------------------


def raw_items(spark, sf):
    """part as a raw item table, with decimals and a key-value text."""
    booking = F.when(F.col("p_size") % 2 == 0, " Онлайн-запись").otherwise("")
    params = F.concat(F.lit("Вид услуги "), "p_type", F.lit(" Гарантия Тип услуги "), "p_brand", booking, F.lit(" Цена от "), F.col("p_size").cast("string"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_title_raw"), F.col("p_retailprice").cast("decimal(18,2)").alias("item_price"), (F.col("p_size") % 3 + 112).alias("item_category_id"), params.alias("item_infm_params_text"), F.lit(0).alias("search_category"))


@query("p06_transform_items", "SELECT p_partkey AS item_id, p_name AS item_title_raw, p_retailprice::DECIMAL(18,2)::DOUBLE AS item_price, p_size % 3 + 112 = 114 AS item_is_service, p_type AS item_category, p_brand AS item_subcategory, []::VARCHAR[] AS item_subjects, p_size % 2 = 0 AS item_online_booking, p_type || '; ' || p_brand AS item_params_text FROM part")
def p06(spark, sf):
    return preprocess.transform(raw_items(spark, sf))


def raw_queries(spark, sf):
    """customer as a raw query table."""
    k = F.col("c_custkey")
    subject = F.when(k % 3 > 0, F.concat(F.lit(" Предмет или специальность "), "c_mktsegment")).otherwise("")
    params = F.concat(F.when(k % 4 == 0, "Вид услуги ").otherwise(F.concat(F.lit("Вид услуги "), "c_name")), subject, F.when(k % 5 == 0, " Онлайн-запись Нет").when(k % 5 == 1, " Онлайн-запись").otherwise(""))
    return read(spark, sf, "customer").select(k.alias("query_id"), F.col("c_mktsegment").alias("search_query"), F.col("c_nationkey").alias("search_location_id"), params.alias("search_infm_params_text"), F.lit(0).alias("search_is_delivery_search"))


@query("p06_transform_queries", "SELECT c_custkey AS query_id, c_mktsegment AS search_query, c_nationkey AS search_location_id, CASE WHEN c_custkey % 4 = 0 THEN 'No category' ELSE c_name END AS filter_category, []::VARCHAR[] AS filter_subcategory, CASE WHEN c_custkey % 3 > 0 THEN [c_mktsegment] ELSE []::VARCHAR[] END AS filter_subject, c_custkey % 5 = 1 AS filter_online_booking FROM customer")
def p06b(spark, sf):
    return preprocess.transform(raw_queries(spark, sf))


@query("s27_describe_changes", "SELECT * FROM (VALUES ('dropped', 'search_category'), ('dropped', 'item_infm_params_text'), ('cast', 'item_price'), ('added', 'item_is_service'), ('added', 'item_category'), ('added', 'item_subcategory'), ('added', 'item_subjects'), ('added', 'item_online_booking'), ('added', 'item_params_text')) t(change, \"column\")")
def s27(spark, sf):
    return preprocess.describe_changes(raw_items(spark, sf))


@query("f18_kv_pairs", "SELECT p_partkey AS item_id, unnest([{'key': 'Вид услуги', 'value': p_type}, {'key': 'Гарантия', 'value': ''}, {'key': 'Тип услуги', 'value': p_brand}] || CASE WHEN p_size % 2 = 0 THEN [{'key': 'Онлайн-запись', 'value': ''}] ELSE [] END || [{'key': 'Цена', 'value': 'от ' || p_size}], recursive := true) FROM part")
def f18(spark, sf):
    return raw_items(spark, sf).select("item_id", F.inline(kv.split_params("item_infm_params_text")))


@query("f18_kv_udtf", "SELECT 'Вид услуги' AS key, count(*) AS n FROM part UNION ALL SELECT 'Гарантия', count(*) FROM part UNION ALL SELECT 'Тип услуги', count(*) FROM part UNION ALL SELECT 'Цена', count(*) FROM part UNION ALL SELECT 'Онлайн-запись', count(*) FROM part WHERE p_size % 2 = 0")
def f18b(spark, sf):
    spark.udtf.register("kv_params", kv.ParamRows)
    raw_items(spark, sf).createOrReplaceTempView("_raw_items")
    return spark.sql("SELECT key, count(*) AS n FROM _raw_items, LATERAL kv_params(item_infm_params_text) GROUP BY key")


@query("f04_stem_terms")
def f04(spark, sf):
    words = raw_items(spark, sf).select(F.explode(text.tokens(F.col("item_infm_params_text"))).alias("word")).distinct()
    return words.select("word", stem.stem_word("word").alias("stem"))


# --- texts and numbers -------------------------------------------------------------------------------------------

CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[\x{{1F000}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{FE0F}}\x{{2B00}}-\x{{2BFF}}]', ' ', 'g'), 'https?://[^\s\x{{A0}}]+|www\.[^\s\x{{A0}}]+|[^\s\x{{A0}}]+@[^\s\x{{A0}}]+\.[\p{{L}}\p{{N}}_]+|&[a-z]{{2,6}};', ' ', 'g'), '(?:\+7|8)[\s\-(]*[0-9]{{3}}[\s\-)]*[0-9]{{3}}[\s\-]*[0-9]{{2}}[\s\-]*[0-9]{{2}}', ' ', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"


@query("f01_clean_text", f"SELECT doc_id, {CLEAN.format('text')} AS clean FROM documents")
def f01(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query("f02_doc_text", f"SELECT page_id, {CLEAN.format('''coalesce(url, '') || ' ' || coalesce(html, '')''')} AS doc FROM pages")
def f02(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.doc_text(F.col("url"), F.col("html")).alias("doc"))


TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"


@query("f03_token_counts", f"SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens, len(list_distinct({TOKENS.format('text')})) AS n_distinct FROM documents")
def f03(spark, sf):
    t = text.tokens(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query("f10_haversine", f"WITH p AS {POINTS} SELECT s_suppkey, round(2 * 6371 * asin(sqrt(pow(sin((radians(55.75) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(55.75)) * pow(sin((radians(37.62) - radians(lon)) / 2), 2))), 6) AS km FROM p")
def f10(spark, sf):
    km = numeric.haversine_km(F.col("lat"), F.col("lon"), F.lit(55.75), F.lit(37.62))
    return rounded(points(spark, sf).select("s_suppkey", km.alias("km")))


@query("f11_crc_fold")
def f11(spark, sf):
    return star(spark, sf).select("search_query").distinct().select("search_query", numeric.crc_bucket(F.col("search_query"), 5).alias("fold"), numeric.category_code(F.col("search_query")).alias("code"))


@query("f13_price_log", "SELECT p_partkey, round(CASE WHEN p_retailprice > 0 AND p_retailprice < 1e9 THEN ln(1 + p_retailprice) END, 6) AS price_log, round(greatest(least(log10(p_retailprice), 3.0), 2.9), 6) AS clipped FROM part")
def f13(spark, sf):
    p = F.col("p_retailprice")
    return rounded(read(spark, sf, "part").select("p_partkey", numeric.valid_price_log(p).alias("price_log"), numeric.clip(F.log10(p), 2.9, 3.0).alias("clipped")))


@query("f14_query_features", r"SELECT conv_id, turn, len(regexp_extract_all(text, '[^\s\x{A0}]+')) AS q_words, length(text) AS q_chars FROM conversations")
def f14(spark, sf):
    from ..operators.features import query_features

    return read(spark, sf, "conversations").select("conv_id", "turn", *(v.alias(k) for k, v in query_features(F.col("text")).items()))


@query("f15_share", "SELECT l_returnflag, round(CASE WHEN sum(l_quantity) > 0 THEN sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) / sum(l_quantity) END, 6) AS share FROM lineitem GROUP BY 1")
def f15(spark, sf):
    part = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0))
    return rounded(read(spark, sf, "lineitem").groupBy("l_returnflag").agg(numeric.share(part, F.sum("l_quantity")).alias("share")))


@query("f29_id_lists", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS ids, count(*) AS n FROM orders GROUP BY 1")
def f29(spark, sf):
    lists = rank.id_list(read(spark, sf, "orders").withColumn("r", F.col("o_orderkey")), "o_custkey", "o_orderkey", "r", "ids")
    return lists.withColumn("n", F.size(arrays.split_ids(F.col("ids"))).cast("long"))


@query("f30_id_formats", "SELECT c_custkey, regexp_full_match(c_name, '.{16}') AS is_query_id, regexp_full_match(substr(md5(c_name), 1, 10 + (c_custkey % 8)::INT), '[0-9a-f]{16}') AS is_item_id FROM customer")
def f30(spark, sf):
    short = F.substring(F.md5("c_name"), F.lit(1), (10 + F.col("c_custkey") % 8).cast("int"))
    return read(spark, sf, "customer").select("c_custkey", text.is_query_id(F.col("c_name")).alias("is_query_id"), text.is_item_id(short).alias("is_item_id"))


@query("f33_contains", "SELECT p_partkey, contains(lower(trim(p_name)), 'widget') AS has_word, strlen(p_name) AS n_bytes, lower(trim(p_name)) = p_name AS same FROM part")
def f33(spark, sf):
    n = F.lower(F.trim("p_name"))
    return read(spark, sf, "part").select("p_partkey", n.contains("widget").alias("has_word"), F.octet_length("p_name").cast("long").alias("n_bytes"), (n == F.col("p_name")).alias("same"))


@query("f34_percent", "SELECT o_orderstatus, printf('%.1f%%', 100 * share) AS share, printf('%+.1f', 100 * (share - 0.3)) AS over FROM (SELECT o_orderstatus, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1)")
def f34(spark, sf):
    shares = rounded(profile.value_counts(read(spark, sf, "orders"), "o_orderstatus"))
    return shares.select("o_orderstatus", text.percent(F.col("share"), 1).alias("share"), text.points(F.col("share") - 0.3, 1).alias("over"))


@query("u05_distinct_folded", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN [c_mktsegment, 'x'] ELSE [c_mktsegment, 'Building', 'x'] END AS v FROM customer")
def u05(spark, sf):
    values = F.array("c_mktsegment", F.lit("Building"), F.lower("c_mktsegment"), F.lit(""), F.lit("x"), F.lit(None).cast("string"), F.lit("X"))
    return read(spark, sf, "customer").select("c_custkey", arrays.distinct_folded(values).alias("v"))


# --- filters -----------------------------------------------------------------------------------------------------

WANTED = """(SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'ECONOMY' WHEN l_orderkey % 3 = 1 THEN 'economy' END AS f_cat,
 CASE WHEN l_orderkey % 2 = 0 THEN ['Brand#1', 'Brand#2', 'Brand#17'] ELSE []::VARCHAR[] END AS f_sub, CASE WHEN l_orderkey % 5 < 2 THEN ['Red', 'ring'] ELSE []::VARCHAR[] END AS f_subj,
 l_orderkey % 7 = 0 AS f_book, p_type AS i_cat, p_brand AS i_sub, string_split(p_name, ' ') AS i_subj, p_size % 2 = 0 AS i_book FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EXACT = "(f_cat IS NULL OR f_cat = i_cat) AND (len(f_sub) = 0 OR list_contains(f_sub, i_sub)) AND (len(f_subj) = 0 OR list_has_any(f_subj, i_subj)) AND (NOT f_book OR i_book)"


def wanted(spark, sf):
    k, none = F.col("l_orderkey"), F.array().cast("array<string>")
    both = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = lambda *x: F.array(*map(F.lit, x))
    return both.select("l_orderkey", "l_linenumber", F.when(k % 3 == 0, "ECONOMY").when(k % 3 == 1, "economy").alias("f_cat"), F.when(k % 2 == 0, words("Brand#1", "Brand#2", "Brand#17")).otherwise(none).alias("f_sub"), F.when(k % 5 < 2, words("Red", "ring")).otherwise(none).alias("f_subj"), (k % 7 == 0).alias("f_book"), F.col("p_type").alias("i_cat"), F.col("p_brand").alias("i_sub"), F.split("p_name", " ").alias("i_subj"), (F.col("p_size") % 2 == 0).alias("i_book"))


FIELDS = ("f_cat", "f_sub", "f_subj", "f_book", "i_cat", "i_sub", "i_subj", "i_book")


@query("p09_combo_keys", f"WITH w AS {WANTED} SELECT coalesce(f_cat, '') AS category, array_to_string(list_sort(f_sub), ',') AS subcategories, array_to_string(list_sort(f_subj), ',') AS subjects, f_book AS booking, count(*) AS n FROM w GROUP BY ALL")
def p09(spark, sf):
    w = wanted(spark, sf)
    keyed = w.groupBy(filters.combo_key(*map(F.col, FIELDS[:4])).alias("k")).agg(F.count("*").alias("n"))
    return keyed.select("k.category", F.array_join("k.subcategories", ",").alias("subcategories"), F.array_join("k.subjects", ",").alias("subjects"), "k.booking", "n")


@query("p10_hard_mask", f"WITH w AS {WANTED} SELECT i_cat, i_book, count(*) AS n, count(*) FILTER ({EXACT}) AS passing FROM w GROUP BY ALL")
def p10(spark, sf):
    return wanted(spark, sf).groupBy("i_cat", "i_book").agg(F.count("*").alias("n"), F.count_if(filters.hard_mask(*map(F.col, FIELDS))).alias("passing"))


LOW = "list_transform({0}, lambda x: lower(x))"


@query("p11_tristate", f"""WITH w AS {WANTED}, m AS (SELECT CASE WHEN f_cat IS NOT NULL THEN lower(f_cat) = lower(i_cat) END AS category,
 CASE WHEN len(f_sub) > 0 THEN list_contains({LOW.format('f_sub')}, lower(i_sub)) END AS subcategory, CASE WHEN len(f_subj) > 0 THEN list_has_any({LOW.format('f_subj')}, {LOW.format('i_subj')}) END AS subject,
 CASE WHEN f_book THEN i_book END AS online_booking FROM w) SELECT category, subcategory, subject, online_booking, count(*) AS n FROM m GROUP BY ALL""")
def p11(spark, sf):
    m = filters.match_filters(*map(F.col, FIELDS))
    return wanted(spark, sf).select(*(v.alias(k) for k, v in m.items())).groupBy(*m).agg(F.count("*").alias("n"))


@query("p12_filter_features", f"""WITH w AS {WANTED} SELECT l_orderkey, l_linenumber, i_sub, CASE WHEN f_cat IS NOT NULL THEN (f_cat = i_cat)::INT::DOUBLE END AS flt_category, CASE WHEN len(f_sub) > 0 THEN list_contains(f_sub, i_sub)::INT::DOUBLE END AS flt_subcategory,
 CASE WHEN len(f_subj) > 0 THEN list_has_any(f_subj, i_subj)::INT::DOUBLE END AS flt_subject, CASE WHEN f_book THEN i_book::INT::DOUBLE END AS flt_booking,
 (f_cat IS NOT NULL)::INT + (len(f_sub) > 0)::INT + (len(f_subj) > 0)::INT + f_book::INT AS flt_n_filters FROM w""")
def p12(spark, sf):
    made = filters.filter_features(*map(F.col, FIELDS))
    return wanted(spark, sf).select("l_orderkey", "l_linenumber", "i_sub", *(v.alias(k) for k, v in made.items()))


@query("p19_cardinality", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 4")
def p19(spark, sf):
    return filters.at_most(read(spark, sf, "lineitem", "l_orderkey"), "l_orderkey", 4).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("p21_known_points", f"WITH p AS {POINTS} SELECT s_suppkey, lat BETWEEN 41 AND 70 AND lon BETWEEN 19 AND 180 AS inside FROM p WHERE (lat <> 0 OR lon <> 0) AND lon IS NOT NULL")
def p21(spark, sf):
    known = points(spark, sf).filter((F.col("lat") != 0) | (F.col("lon") != 0)).dropna(subset=["lat", "lon"])
    return known.select("s_suppkey", filters.in_box(F.col("lat"), F.col("lon")).alias("inside"))


@query("a44_pass_rates", f"WITH w AS {WANTED} SELECT round(avg(CASE WHEN f_cat IS NOT NULL THEN (lower(f_cat) = lower(i_cat))::INT END), 6) AS category, round(avg(CASE WHEN f_book THEN i_book::INT END), 6) AS booking, round(avg((f_cat IS NOT NULL OR len(f_sub) > 0 OR len(f_subj) > 0 OR f_book)::INT), 6) AS any_filter FROM w")
def a44(spark, sf):
    m = filters.match_filters(*map(F.col, FIELDS))
    any_filter = F.col("f_cat").isNotNull() | (F.size("f_sub") > 0) | (F.size("f_subj") > 0) | F.col("f_book")
    return rounded(wanted(spark, sf).agg(F.avg(m["category"].cast("int")).alias("category"), F.avg(m["online_booking"].cast("int")).alias("booking"), F.avg(any_filter.cast("int")).alias("any_filter")))


@query("a45_null_policy", "SELECT round(avg(coalesce(CASE WHEN p_size % 5 > 0 THEN p_type END = 'ECONOMY', false)::INT), 6) AS strict, round(avg(coalesce(CASE WHEN p_size % 5 > 0 THEN p_type END = 'ECONOMY', true)::INT), 6) AS lenient FROM part")
def a45(spark, sf):
    same = F.when(F.col("p_size") % 5 > 0, F.col("p_type")) == "ECONOMY"
    return rounded(read(spark, sf, "part").agg(F.avg(F.coalesce(same, F.lit(False)).cast("int")).alias("strict"), F.avg(F.coalesce(same, F.lit(True)).cast("int")).alias("lenient")))


# --- streams -----------------------------------------------------------------------------------------------------


@query("st_windowed_counts", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st(spark, sf):
    out = ingest.windowed_counts(read(spark, sf, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
