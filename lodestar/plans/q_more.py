"""Queries over single joins, aggregates, sorts and projections of the inventory that no other query stands for."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, kv
from ..operators import bm25, features, pools, rank
from ..sources import tables
from .bindings import ASKED, CORPUS, STAR, asked, corpus, query, read, rounded, star
from .q_rank import GOLD, QUOTA, gold_among, quota_candidates
from .q_tables import raw_items, wanted, WANTED, FIELDS

# --- scans and projections ---------------------------------------------------------------------------------------


@query("s03_partitioned_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_tax), 4) AS tax FROM lineitem GROUP BY 1")
def s03(spark, sf):
    return read(spark, sf, "lineitem", "l_returnflag", "l_tax").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_tax"), 4).alias("tax"))


@query("s10_eval_positives", "SELECT o_orderkey AS event_id, l_partkey AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F'")
def s10(spark, sf):
    line = read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").filter("l_returnflag = 'R'")
    return read(spark, sf, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'F'").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("event_id"), F.col("l_partkey").alias("item_id"))


@query("s13_benchmark_queries", "SELECT item_id, length(text) AS n FROM benchmark")
def s13(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.length("text").alias("n"))


@query("p05_column_order", "SELECT c_custkey AS query_id, c_nationkey AS search_location_id, c_name AS item_name FROM customer")
def p05(spark, sf):
    from ..operators.preprocess import order_columns

    return order_columns(read(spark, sf, "customer").select(F.col("c_name").alias("item_name"), F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("search_location_id")))


@query("p07_query_projection", f"SELECT search_query, min(event_id) AS event_id, arg_min(search_location_id, (event_id, search_location_id)) AS search_location_id FROM {STAR} GROUP BY 1")
def p07(spark, sf):
    return tables.first_by(star(spark, sf).select("search_query", "event_id", "search_location_id"), "search_query", ["event_id", "search_location_id"])


@query("p08_event_meta", f"WITH s AS {STAR}, m AS (SELECT DISTINCT event_id, search_query, search_location_id FROM s), c AS (SELECT event_id, count(*) AS n FROM s GROUP BY 1) SELECT event_id, search_query, search_location_id, n FROM c JOIN m USING (event_id)")
def p08(spark, sf):
    pairs = star(spark, sf)
    return pairs.groupBy("event_id").agg(F.count("*").alias("n")).join(pairs.select("event_id", "search_query", "search_location_id").dropDuplicates(["event_id"]), "event_id")


PASS = "(f_cat IS NULL OR f_cat = i_cat) AND (len(f_sub) = 0 OR list_contains(f_sub, i_sub)) AND (len(f_subj) = 0 OR list_has_any(f_subj, i_subj)) AND (NOT f_book OR i_book)"


@query("p16_pool_variants", f"WITH w AS {WANTED}, x AS (SELECT {PASS} AS m, l_linenumber <= 2 AS g FROM w) SELECT 'none' AS variant, count(*) AS n FROM x UNION ALL SELECT 'filters', count(*) FROM x WHERE m UNION ALL SELECT 'geo', count(*) FROM x WHERE g UNION ALL SELECT 'filters+geo', count(*) FROM x WHERE m AND g")
def p16(spark, sf):
    from ..operators.filters import hard_mask

    rows, mask = wanted(spark, sf), hard_mask(*map(F.col, FIELDS))
    out = None
    for v in pools.VARIANTS:
        own = pools.members(rows, v, mask, F.col("l_linenumber") <= 2).agg(F.count("*").alias("n")).select(F.lit(v).alias("variant"), "n")
        out = own if out is None else out.unionByName(own)
    return out


@query("p17_feature_columns", "SELECT * FROM (VALUES ('sc_a'), ('q_words')) t(name)")
def p17(spark, sf):
    df = spark.createDataFrame([], "qid int, item_idx int, label int, fold int, sc_a double, it_category int, q_words int, st_text_item double")
    return spark.createDataFrame([(c,) for c in features.feature_columns(df, ("st_text_item",))], "name string")


@query("p23_part_slices", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 100000 AND 200000")
def p23(spark, sf):
    return read(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") == "O") & F.col("o_totalprice").between(100000, 200000)).select("o_orderkey", "o_orderpriority")


@query("p25_point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def p25(spark, sf):
    return read(spark, sf, "customer").filter("c_custkey = 77").select("c_custkey", "c_name", "c_mktsegment")


# --- joins -------------------------------------------------------------------------------------------------------


@query("j01_item_attributes", "SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j01(spark, sf):
    return read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").join(read(spark, sf, "part", "p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")


@query("j05_dictionary_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j05(spark, sf):
    places = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return read(spark, sf, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("j07_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j07(spark, sf):
    few = read(spark, sf, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer", "c_custkey").join(few, "c_custkey", "left_semi")


@query("j08_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j08(spark, sf):
    few = read(spark, sf, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer", "c_custkey").join(few, "c_custkey", "left_anti")


@query("j15_gold_labels", f"{QUOTA}, {GOLD} SELECT qid, doc_id, (gold.qid IS NOT NULL)::INT AS label FROM cand LEFT JOIN gold USING (qid, doc_id)")
def j15(spark, sf):
    return quota_candidates(spark, sf, gold=gold_among(spark, sf)).select("qid", "doc_id", "label")


@query("j17_zero_fill", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 GROUP BY 1")
def j17(spark, sf):
    n = read(spark, sf, "orders").filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf, "customer", "c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# --- aggregates --------------------------------------------------------------------------------------------------


@query("a02_count_distinct", f"SELECT count(DISTINCT event_id) AS events, count(DISTINCT search_query) AS texts, count(DISTINCT item_id) AS items, count(DISTINCT (search_location_id, item_location_id)) AS routes FROM {STAR}")
def a02(spark, sf):
    return star(spark, sf).agg(F.countDistinct("event_id").alias("events"), F.countDistinct("search_query").alias("texts"), F.countDistinct("item_id").alias("items"), F.countDistinct("search_location_id", "item_location_id").alias("routes"))


@query("a04_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def a04(spark, sf):
    return read(spark, sf, "part").select("p_brand", "p_type").dropDuplicates()


@query("a09_document_lengths", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS length FROM documents")
def a09(spark, sf):
    tf = bm25.terms(corpus(spark, sf), "doc_id", F.col("text"))
    return corpus(spark, sf).select("doc_id").join(tf.groupBy("doc_id").agg(F.sum("tf").alias("length")), "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0)))


@query("a10_document_frequency", r"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1")
def a10(spark, sf):
    return bm25.terms(corpus(spark, sf), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"))


@query("f07_query_terms", r"SELECT item_id AS qid, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL")
def f07(spark, sf):
    return bm25.terms(asked(spark, sf), "qid", F.col("text"))


@query("a31_group_sizes", "SELECT l_orderkey AS qid, count(*) AS n FROM lineitem GROUP BY 1")
def a31(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.count("*").alias("n"))


@query("a14_group_maximum", "SELECT l_orderkey, max(l_discount) AS best FROM lineitem GROUP BY 1")
def a14(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return read(spark, sf, "lineitem").withColumn("best", F.max("l_discount").over(w)).select("l_orderkey", "best").distinct()


@query("a42_unattached_text", "SELECT 0.0::DOUBLE AS rows_share, 0.0::DOUBLE AS words_share FROM (SELECT 1)")
def a42(spark, sf):
    loose = raw_items(spark, sf).select(kv.split_params("item_infm_params_text").alias("p"), "item_infm_params_text")
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    left = F.filter("p", lambda x: x["key"].isNull())
    n = F.aggregate(left, F.lit(0), lambda a, x: a + words(x["value"]))
    return rounded(loose.agg(F.avg((F.size(left) > 0).cast("int")).alias("rows_share"), (F.sum(n) / F.sum(words("item_infm_params_text"))).alias("words_share")))


@query("a43_filters_set", f"WITH w AS {WANTED} SELECT round(avg((f_cat IS NOT NULL)::INT), 6) AS category, round(avg((len(f_sub) > 0)::INT), 6) AS subcategory, round(avg((len(f_subj) > 0)::INT), 6) AS subject, round(avg(f_book::INT), 6) AS booking FROM w")
def a43(spark, sf):
    has = {"category": F.col("f_cat").isNotNull(), "subcategory": F.size("f_sub") > 0, "subject": F.size("f_subj") > 0, "booking": F.col("f_book")}
    return rounded(wanted(spark, sf).agg(*(F.avg(v.cast("int")).alias(k) for k, v in has.items())))


@query("a51_no_category_breakdown", f"WITH w AS {WANTED} SELECT CASE WHEN f_cat IS NULL THEN 'not set' WHEN f_cat = i_cat THEN 'same' ELSE 'other' END AS state, count(*) AS n, round(avg(i_book::INT), 6) AS booking FROM w GROUP BY 1")
def a51(spark, sf):
    state = F.when(F.col("f_cat").isNull(), "not set").when(F.col("f_cat") == F.col("i_cat"), "same").otherwise("other")
    return rounded(wanted(spark, sf).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.avg(F.col("i_book").cast("int")).alias("booking")))


# --- windows, sorts, sets ----------------------------------------------------------------------------------------


@query("w06_zero_based_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def w06(spark, sf):
    return rank.ranked(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", "o_orderkey").select("o_orderkey", (F.col("rank") - 1).alias("rank"))


@query("o02_rrf_top_k", "WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders UNION ALL SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) FROM orders), f AS (SELECT o_custkey, o_orderkey, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM l GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rrf DESC, o_orderkey) AS rank FROM f) WHERE rank <= 5")
def o02(spark, sf):
    orders = read(spark, sf, "orders")
    by_price = rank.ranked(orders, ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "rank")
    by_date = rank.ranked(orders, ["o_custkey"], "o_orderdate", "o_orderkey", descending=False).select("o_custkey", "o_orderkey", "rank")
    return rank.top_k(rounded(rank.rrf(by_price.unionByName(by_date), "o_custkey", "o_orderkey"), 9), ["o_custkey"], "rrf", "o_orderkey", 5)


@query("o07_multi_key_sort", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 200")
def o07(spark, sf):
    return read(spark, sf, "lineitem").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(200).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("o11_shuffle", "SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || ':7'), p_partkey) AS place FROM part")
def o11(spark, sf):
    return read(spark, sf, "part", "p_partkey").withColumn("place", F.row_number().over(Window.orderBy(rank.hash_order(F.col("p_partkey"), 7), "p_partkey")))


@query("o13_sampled_statistics", "SELECT count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE CAST('0x' || substr(md5(event_id::VARCHAR || ':9'), 1, 8) AS BIGINT) < CAST(floor(0.5 * 4294967296) AS BIGINT)")
def o13(spark, sf):
    return rounded(tables.sample_hash(read(spark, sf, "events", "event_id", "value"), "event_id", 0.5, 9).agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query("u02_added_columns", "SELECT p_partkey, length(p_name) AS a, p_size * 2 AS b FROM part")
def u02(spark, sf):
    return read(spark, sf, "part").withColumns({"a": F.length("p_name"), "b": F.col("p_size") * 2}).select("p_partkey", "a", "b")


@query("u04_gold_in_top", "SELECT o_custkey, len(list_intersect(list(o_orderkey) FILTER (r <= 3), list(o_orderkey) FILTER (o_orderstatus = 'F'))) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def u04(spark, sf):
    top = rank.ranked(read(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")
    lists = top.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("rank") <= 3, F.col("o_orderkey"))).alias("t"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("g"))
    return lists.filter(F.size("g") > 0).select("o_custkey", F.size(F.array_intersect("t", "g")).alias("hits"))


@query("u06_first_seen_order", f"SELECT search_query, row_number() OVER (ORDER BY first_event, search_query) AS place FROM (SELECT search_query, min(event_id) AS first_event FROM {STAR} GROUP BY 1)")
def u06(spark, sf):
    first = star(spark, sf).groupBy("search_query").agg(F.min("event_id").alias("e"))
    return first.select("search_query", F.row_number().over(Window.orderBy("e", "search_query")).alias("place"))


@query("f27_sorted_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1")
def f27(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("f28_overlap", f"WITH w AS {WANTED} SELECT l_orderkey, l_linenumber, i_sub, list_has_any(f_subj, i_subj) AS shares, list_contains(f_sub, i_sub) AS holds FROM w")
def f28(spark, sf):
    return wanted(spark, sf).select("l_orderkey", "l_linenumber", "i_sub", arrays.overlaps(F.col("f_subj"), F.col("i_subj")).alias("shares"), arrays.holds(F.col("f_sub"), F.col("i_sub")).alias("holds"))


@query("r05_filter_pools", f"WITH d AS {CORPUS}, q AS {ASKED} SELECT q.lang AS pool, doc_id FROM (SELECT DISTINCT lang FROM q) q JOIN d ON q.lang = d.lang")
def r05(spark, sf):
    none = F.array().cast("array<string>")
    items = corpus(spark, sf).select("doc_id", F.col("lang").alias("item_category"), F.lit("").alias("item_subcategory"), none.alias("item_subjects"), F.lit(False).alias("item_online_booking"))
    keys = asked(spark, sf).select(F.col("lang").alias("pool")).distinct().withColumn("filter", F.struct(F.col("pool").alias("category"), none.alias("subcategories"), none.alias("subjects"), F.lit(False).alias("booking")))
    return pools.members_by_filters(keys, items, "pool", "doc_id")


@query("r22_text_vectors", "SELECT vec_id, label, len(embedding) AS dims, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM embeddings")
def r22(spark, sf):
    return rounded(read(spark, sf, "embeddings").select("vec_id", "label", F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("first")))
