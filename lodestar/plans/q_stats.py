"""Queries over locations, training statistics, splits, features and rerankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import standardise
from ..functions.text import coverage, tokens
from ..operators import features, geo, network, pools, rerank, split, stats
from .bindings import ASKED, CORPUS, POINTS, STAR, asked, corpus, points, query, read, rounded, star

# --- locations ---------------------------------------------------------------------------------------------------

CENTRES = f"(SELECT loc, median(lat) AS lat, median(lon) AS lon FROM {POINTS} WHERE (lat <> 0 OR lon <> 0) AND lat IS NOT NULL AND lon IS NOT NULL GROUP BY loc)"
KM = "2 * 6371 * asin(sqrt(pow(sin((radians({1}.lat) - radians({0}.lat)) / 2), 2) + cos(radians({0}.lat)) * cos(radians({1}.lat)) * pow(sin((radians({1}.lon) - radians({0}.lon)) / 2), 2)))"
NEAR = f"(SELECT a.loc, b.loc AS nb, {KM.format('a', 'b')} AS dist_km FROM {CENTRES} a JOIN {CENTRES} b ON a.loc <> b.loc WHERE {KM.format('a', 'b')} <= 400)"


def near(spark, sf):
    return geo.neighbours(geo.centroids(points(spark, sf)), 400.0)


@query("a06_centroids", f"SELECT loc, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {CENTRES}")
def a06(spark, sf):
    return rounded(geo.centroids(points(spark, sf)))


@query("a07_centroids_of_union", f"SELECT loc, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon FROM (SELECT loc, lat, lon FROM {POINTS} WHERE lon <> 0 UNION ALL SELECT c_nationkey, (c_acctbal / 200)::DOUBLE, (c_custkey % 90)::DOUBLE FROM customer WHERE c_acctbal <> 0 OR c_custkey % 90 <> 0) GROUP BY loc")
def a07(spark, sf):
    others = read(spark, sf, "customer").select(F.col("c_nationkey").alias("loc"), (F.col("c_acctbal") / 200).alias("lat"), (F.col("c_custkey") % 90).cast("double").alias("lon"))
    return rounded(geo.centroids(points(spark, sf).select("loc", "lat", "lon").unionByName(others)))


@query("j10_neighbours", f"SELECT loc, nb, round(dist_km, 6) AS dist_km, row_number() OVER (PARTITION BY loc ORDER BY round(dist_km, 6), nb) AS nb_rank FROM {NEAR}")
def j10(spark, sf):
    return rounded(near(spark, sf))


#: item locations seen by a corpus are all but one region's nations; the others are regions
KNOWN = "(SELECT n_nationkey AS loc FROM nation WHERE n_regionkey <> 4)"


def known(spark, sf):
    return read(spark, sf, "nation").filter("n_regionkey <> 4").select(F.col("n_nationkey").alias("loc"))


COVER = """SELECT {0} region, loc, n FROM (SELECT {0} search_location_id AS region, item_location_id AS loc, count(*) AS n, sum(count(*)) OVER (PARTITION BY {0} search_location_id ORDER BY count(*) DESC, item_location_id ROWS UNBOUNDED PRECEDING) AS cum,
 sum(count(*)) OVER (PARTITION BY {0} search_location_id) AS total FROM {1} WHERE search_location_id NOT IN (SELECT loc FROM {2}) GROUP BY {0} search_location_id, item_location_id) WHERE (cum - n) / total < 0.8 - 1e-9"""


@query("a08_region_cover", COVER.format("", STAR, KNOWN))
def a08(spark, sf):
    return geo.region_cover(star(spark, sf), known(spark, sf), 0.8)


@query("r08_region_cover_by_fold", f"WITH f AS (SELECT s.*, g.fold FROM {STAR} s JOIN (SELECT unnest(range(5))::INT AS fold) g ON g.fold <> s.event_id % 5) {COVER.format('fold,', 'f', KNOWN)}")
def r08(spark, sf):
    pairs = star(spark, sf).withColumn("fold", (F.col("event_id") % 5).cast("int"))
    return geo.region_cover_by_fold(pairs, known(spark, sf), 0.8)


GEO_SQL = f"""WITH cov AS ({COVER.format('', STAR, KNOWN)}), near AS {NEAR}, k AS {KNOWN}, q AS (SELECT c_custkey AS qid, c_nationkey AS here FROM customer),
city AS (SELECT qid, here AS loc FROM q WHERE here IN (SELECT loc FROM k)), reg AS (SELECT qid, cov.loc FROM q JOIN cov ON cov.region = q.here WHERE q.here NOT IN (SELECT loc FROM k) AND cov.loc IN (SELECT loc FROM k)),
nb AS (SELECT qid, nb AS loc FROM city JOIN near ON near.loc = city.loc WHERE nb IN (SELECT loc FROM k))"""


def located(spark, sf, mode):
    places = known(spark, sf)
    return geo.query_locations(read(spark, sf, "customer").withColumnRenamed("c_custkey", "qid"), "qid", "c_nationkey", places, geo.region_cover(star(spark, sf), places, 0.8), near(spark, sf), mode)


@query("p14_locations_city", f"{GEO_SQL} SELECT qid, loc FROM city UNION SELECT qid, loc FROM reg")
def p14(spark, sf):
    return located(spark, sf, "city")


@query("p14_locations_city_and_neighbours", f"{GEO_SQL} SELECT qid, loc FROM city UNION SELECT qid, loc FROM reg UNION SELECT qid, loc FROM nb")
def p14b(spark, sf):
    return located(spark, sf, "city+neighbors")


@query("p15_locations_neighbours", f"{GEO_SQL} SELECT DISTINCT qid, loc FROM nb")
def p15(spark, sf):
    return located(spark, sf, "neighbors")


@query("p22_is_region", f"SELECT c_custkey, c_nationkey NOT IN (SELECT loc FROM {KNOWN}) AS is_region FROM customer")
def p22(spark, sf):
    places = known(spark, sf).select(F.col("loc").alias("c_nationkey"), F.lit(True).alias("k"))
    return read(spark, sf, "customer", "c_custkey", "c_nationkey").join(places, "c_nationkey", "left").select("c_custkey", F.col("k").isNull().alias("is_region"))


@query("j09_geo_features", f"WITH s AS {STAR}, p AS {POINTS}, near AS {NEAR}, c AS {CENTRES} SELECT event_id, item_id, s.l_suppkey, (search_location_id = item_location_id)::INT AS geo_same_loc, (near.nb IS NOT NULL)::INT AS geo_is_neighbor, round({KM.format('c', 'p')}, 6) AS geo_dist_km FROM s JOIN p ON s.l_suppkey = p.s_suppkey LEFT JOIN near ON near.loc = search_location_id AND near.nb = item_location_id LEFT JOIN c ON c.loc = search_location_id")
def j09(spark, sf):
    rows = star(spark, sf).join(points(spark, sf).select(F.col("s_suppkey").alias("l_suppkey"), "lat", "lon"), "l_suppkey")
    out = features.geo_features(rows, "search_location_id", "item_location_id", near(spark, sf), geo.centroids(points(spark, sf)), "lat", "lon")
    return rounded(out.select("event_id", "item_id", "l_suppkey", "geo_same_loc", "geo_is_neighbor", "geo_dist_km"))


# --- statistics of pairs -----------------------------------------------------------------------------------------

ST = """round(ln(1 + text_events), 6) AS st_text_freq_log, text_item::DOUBLE AS st_text_item, round(CASE WHEN text_pos > 0 THEN text_mc / text_pos END, 6) AS st_text_mc_share,
 round(ln(1 + item_pop), 6) AS st_item_pop_log, round(CASE WHEN loc_pos > 0 THEN loc_loc / loc_pos END, 6) AS st_loc_share, round(ln(1 + loc_pos), 6) AS st_loc_pos_log"""
COUNTS = f"""s AS {STAR}, c AS (SELECT event_id, search_query, search_location_id, item_id, item_location_id, item_microcat_id, l_suppkey,
 (SELECT count(DISTINCT event_id) FROM s x WHERE x.search_query = s.search_query) - {{0}} AS text_events,
 count(*) OVER (PARTITION BY search_query) - {{1}} AS text_pos, count(*) OVER (PARTITION BY search_query, item_id) - {{2}} AS text_item, count(*) OVER (PARTITION BY search_query, item_microcat_id) - {{3}} AS text_mc,
 count(*) OVER (PARTITION BY item_id) - {{2}} AS item_pop, count(*) OVER (PARTITION BY search_location_id, item_location_id) - {{4}} AS loc_loc, count(*) OVER (PARTITION BY search_location_id) - {{1}} AS loc_pos FROM s)"""


@query("r11_train_stats", f"WITH {COUNTS.format(0, 0, 0, 0, 0)} SELECT event_id, item_id, l_suppkey, {ST} FROM c")
def r11(spark, sf):
    pairs = star(spark, sf)
    return rounded(stats.train_stats(pairs, pairs, False).select("event_id", "item_id", "l_suppkey", "st_text_freq_log", "st_text_item", "st_text_mc_share", "st_item_pop_log", "st_loc_share", "st_loc_pos_log"))


@query("r11_train_stats_leave_one_out", f"WITH {COUNTS.format(1, 'count(*) OVER (PARTITION BY event_id)', 'count(*) OVER (PARTITION BY event_id, item_id)', 'count(*) OVER (PARTITION BY event_id, item_microcat_id)', 'count(*) OVER (PARTITION BY event_id, item_location_id)')} SELECT event_id, item_id, l_suppkey, {ST} FROM c")
def r11b(spark, sf):
    pairs = star(spark, sf)
    return rounded(stats.train_stats(pairs, pairs, True).select("event_id", "item_id", "l_suppkey", "st_text_freq_log", "st_text_item", "st_text_mc_share", "st_item_pop_log", "st_loc_share", "st_loc_pos_log"))


@query("a01_pair_counts", f"SELECT search_query, count(*) AS text_pos, count(DISTINCT event_id) AS text_events, count(DISTINCT item_id) AS items FROM {STAR} GROUP BY 1")
def a01(spark, sf):
    return star(spark, sf).groupBy("search_query").agg(F.count("*").alias("text_pos"), F.countDistinct("event_id").alias("text_events"), F.countDistinct("item_id").alias("items"))


@query("a03_dedup_repeats", f"SELECT search_query, item_id, count(*) AS n_repeats FROM {STAR} GROUP BY ALL")
def a03(spark, sf):
    return stats.dedup_repeats(star(spark, sf), ["search_query", "item_id"])


@query("j21_overlap_funnel", f"WITH s AS {STAR}, c AS (SELECT DISTINCT item_id FROM s WHERE search_location_id IN (SELECT loc FROM {KNOWN})) SELECT count(*) AS pairs, count(DISTINCT item_id) AS items, count(*) FILTER (item_id IN (SELECT item_id FROM c)) AS known_pairs, count(DISTINCT CASE WHEN item_id IN (SELECT item_id FROM c) THEN item_id END) AS known_items FROM s WHERE search_location_id NOT IN (SELECT loc FROM {KNOWN})")
def j21(spark, sf):
    pairs, places = star(spark, sf), known(spark, sf).withColumnRenamed("loc", "search_location_id")
    seen = pairs.join(places, "search_location_id", "left_semi").select("item_id").distinct().withColumn("k", F.lit(1))
    rest = pairs.join(places, "search_location_id", "left_anti").join(seen, "item_id", "left")
    return rest.agg(F.count("*").alias("pairs"), F.countDistinct("item_id").alias("items"), F.count("k").alias("known_pairs"), F.countDistinct(F.when(F.col("k") == 1, F.col("item_id"))).alias("known_items"))


@query("j20_random_pairs", "WITH a AS (SELECT p_partkey, p_type, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || ':1'), p_partkey) AS n FROM part), b AS (SELECT p_type, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR || ':2'), p_partkey) AS n FROM part) SELECT a.p_partkey, a.p_type = b.p_type AS same FROM a JOIN b USING (n)")
def j20(spark, sf):
    from pyspark.sql.window import Window

    from ..operators.rank import hash_order

    part = read(spark, sf, "part", "p_partkey", "p_type")
    numbered = lambda seed: part.withColumn("n", F.row_number().over(Window.orderBy(hash_order(F.col("p_partkey"), seed), "p_partkey")))
    b = numbered(2).select("n", F.col("p_type").alias("other"))
    return numbered(1).join(b, "n").select("p_partkey", (F.col("p_type") == F.col("other")).alias("same"))


# --- split -------------------------------------------------------------------------------------------------------

CONFIG = split.SplitConfig(val_text_fraction=0.2, seen_text_share=0.37, catalog_size=500, max_positives=3)
SPLIT = f"""WITH s AS {STAR}, texts AS (SELECT search_query, row_number() OVER (ORDER BY md5(search_query || ':42'), search_query) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT search_query FROM s)),
held AS (SELECT search_query FROM texts WHERE n <= floor(total * 0.2)), nu AS (SELECT count(DISTINCT event_id) AS n FROM s WHERE search_query IN (SELECT search_query FROM held)),
later AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY search_query ORDER BY md5(search_query || '/' || event_id || ':42')) AS n FROM (SELECT DISTINCT search_query, event_id FROM s WHERE search_query NOT IN (SELECT search_query FROM held))) WHERE n > 1),
seen AS (SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY md5(event_id::VARCHAR || ':43'), event_id) AS n FROM (SELECT DISTINCT event_id FROM later)) WHERE n <= (SELECT round_even(n * 0.37::DOUBLE / (1 - 0.37::DOUBLE), 0) FROM nu)),
sp AS (SELECT *, CASE WHEN search_query IN (SELECT search_query FROM held) THEN 'new text' WHEN event_id IN (SELECT event_id FROM seen) THEN 'known text' END AS slice FROM s)"""


@query("r15_split", f"{SPLIT} SELECT event_id, item_id, l_suppkey, slice, CASE WHEN slice IS NULL THEN 'train' ELSE 'val' END AS part FROM sp")
def r15(spark, sf):
    return split.split_by_text(star(spark, sf), CONFIG).select("event_id", "item_id", "l_suppkey", "slice", "part")


@query("a29_split_report", f"{SPLIT} SELECT name, count(DISTINCT event_id) AS events, count(*) AS pairs, count(DISTINCT search_query) AS texts FROM (SELECT *, unnest(CASE WHEN slice IS NULL THEN ['train'] ELSE ['val: ' || slice, 'val'] END) AS name FROM sp) GROUP BY 1")
def a29(spark, sf):
    return split.report(split.split_by_text(star(spark, sf), CONFIG))


CATALOG = "cat AS (SELECT item_id FROM (SELECT DISTINCT item_id FROM s) ORDER BY md5(item_id::VARCHAR || ':42'), item_id LIMIT 500)"


@query("r15_eval_set", f"{SPLIT}, {CATALOG}, v AS (SELECT event_id, item_id, l_suppkey, count(*) OVER (PARTITION BY event_id) AS n FROM sp WHERE slice IS NOT NULL AND item_id IN (SELECT item_id FROM cat)) SELECT event_id, item_id, l_suppkey FROM v WHERE n <= 3")
def r15b(spark, sf):
    parts = split.split_by_text(star(spark, sf), CONFIG)
    val = parts.filter("part = 'val'")
    return split.select_eval(val, split.sample_catalog(parts, val, CONFIG), CONFIG).select("event_id", "item_id", "l_suppkey")


@query("o10_catalog_keeping_positives", f"{SPLIT}, vp AS (SELECT DISTINCT item_id FROM sp WHERE slice = 'new text' AND search_location_id = item_location_id) SELECT item_id FROM vp UNION ALL (SELECT item_id FROM (SELECT DISTINCT item_id FROM s) WHERE item_id NOT IN (SELECT item_id FROM vp) ORDER BY md5(item_id::VARCHAR || ':42'), item_id LIMIT (SELECT greatest(0, 500 - count(*)) FROM vp))")
def o10b(spark, sf):
    parts = split.split_by_text(star(spark, sf), CONFIG)
    few = parts.filter("slice = 'new text' and search_location_id = item_location_id")
    return split.sample_catalog(parts, few, split.SplitConfig(catalog_mode="keep_positives", catalog_size=500))


# --- features ----------------------------------------------------------------------------------------------------


def processed_items(spark, sf):
    """part with the columns of processed items; suppliers' nations are locations."""
    k = F.col("p_partkey")
    c = {
        "item_id": k, "item_location_id": k % 25, "item_rating": F.when(k % 11 > 0, (k % 50) / 10.0), "item_rating_reviews_count": F.when(k % 13 > 0, k % 300), "item_price": F.when(k % 17 == 0, -1.0).otherwise(F.col("p_retailprice")),
        "item_microcat_id": F.col("p_size"), "item_category": F.col("p_type"), "item_is_service": k % 3 == 0, "item_is_phone_hidden": k % 4 == 0, "item_is_message_forbidden": k % 5 == 0, "title_len": F.length("p_name"), "desc_len": F.length("p_brand"),
    }
    return read(spark, sf, "part").select(*(v.alias(n) for n, v in c.items()))


@query("r10_item_features", """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 11 > 0 THEN round((p_partkey % 50) / 10.0, 6) END AS it_rating, round(ln(1 + CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 300 ELSE 0 END), 6) AS it_reviews_log, CASE WHEN p_partkey % 17 > 0 THEN round(ln(1 + p_retailprice), 6) END AS it_price_log,
 p_size AS it_microcat, (p_partkey % 3 = 0)::INT AS it_is_service, (p_partkey % 4 = 0)::INT AS it_phone_hidden, (p_partkey % 5 = 0)::INT AS it_msg_forbidden, length(p_name) AS it_title_len, round(ln(1 + length(p_brand)), 6) AS it_desc_len_log, round(ln(1 + count(*) OVER (PARTITION BY p_partkey % 25)), 6) AS geo_loc_size_log FROM part""")
def r10(spark, sf):
    made = features.item_features(processed_items(spark, sf))
    return rounded(made.select("item_id", "it_rating", "it_reviews_log", "it_price_log", "it_microcat", "it_is_service", "it_phone_hidden", "it_msg_forbidden", "it_title_len", "it_desc_len_log", "geo_loc_size_log"))


@query("r13_pair_features", f"""WITH {COUNTS.format(0, 0, 0, 0, 0)}, it AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 17 > 0 THEN round(ln(1 + p_retailprice), 6) END AS it_price_log, round(ln(1 + count(*) OVER (PARTITION BY p_partkey % 25)), 6) AS geo_loc_size_log FROM part)
SELECT event_id, item_id, l_suppkey, (search_location_id = item_location_id)::INT AS geo_same_loc, it_price_log, geo_loc_size_log, length(search_query) AS q_chars, len(regexp_extract_all(search_query, '[^ ]+')) AS q_words, round(CASE WHEN loc_pos > 0 THEN loc_loc / loc_pos END, 6) AS st_loc_share, text_item::DOUBLE AS st_text_item, round(it_price_log - max(it_price_log) OVER (PARTITION BY event_id), 6) + 0.0 AS sc_price_gap FROM c JOIN it USING (item_id)""")
def r13(spark, sf):
    pairs = star(spark, sf)
    own = rounded(features.item_features(processed_items(spark, sf)).select("item_id", "it_price_log", "geo_loc_size_log"))
    rows = stats.train_stats(pairs, pairs, False).join(own, "item_id").withColumns(features.query_features(F.col("search_query")))
    rows = features.score_gaps(rows.withColumn("sc_price", F.col("it_price_log")), ["sc_price"], ["event_id"])
    rows = rows.withColumn("geo_same_loc", (F.col("search_location_id") == F.col("item_location_id")).cast("int"))
    return rounded(rows.select("event_id", "item_id", "l_suppkey", "geo_same_loc", "it_price_log", "geo_loc_size_log", "q_chars", "q_words", "st_loc_share", "st_text_item", "sc_price_gap"))


# --- rerankers ---------------------------------------------------------------------------------------------------

#: candidates of an order are its lines; the returned ones are its positives
LINES = "(SELECT l_orderkey AS qid, l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey AS item_idx, (l_returnflag = 'R')::INT AS label, l_quantity, l_extendedprice, CASE WHEN l_partkey % 9 > 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)"


def lines(spark, sf):
    c = F.col
    return read(spark, sf, "lineitem").select(c("l_orderkey").alias("qid"), (c("l_linenumber") * 1000000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("item_idx"), (c("l_returnflag") == "R").cast("int").alias("label"), "l_quantity", "l_extendedprice", F.when(c("l_partkey") % 9 > 0, c("l_discount")).alias("l_discount"), "l_tax")


@query("a32_normalisation", f"WITH l AS {LINES}, m AS (SELECT median(l_discount) AS md, median(l_quantity) AS mq FROM l) SELECT 'l_discount' AS column_name, round(any_value(md), 6) AS median, round(avg(coalesce(l_discount, md)), 6) AS mean, round(stddev_pop(coalesce(l_discount, md)), 6) AS std, bool_or(l_discount IS NULL) AS has_nan FROM l, m UNION ALL SELECT 'l_quantity', round(any_value(mq), 6), round(avg(l_quantity), 6), round(stddev_pop(l_quantity), 6), false FROM l, m")
def a32(spark, sf):
    fitted = rerank.Preprocessor(["l_discount", "l_quantity"]).fit(lines(spark, sf)).stats
    return rounded(spark.createDataFrame([(k, v["median"], v["mean"], v["std"], v["has_nan"]) for k, v in fitted.items()], "column_name string, median double, mean double, std double, has_nan boolean"))


@query("f31_standardise", f"WITH l AS {LINES}, m AS (SELECT median(l_discount) AS md FROM l), s AS (SELECT any_value(md) AS md, avg(coalesce(l_discount, md)) AS mu, stddev_pop(coalesce(l_discount, md)) AS sd FROM l, m) SELECT qid, item_idx, round(greatest(least((coalesce(l_discount, md) - mu) / sd, 5), -5), 5) + 0.0 AS x_l_discount, (l_discount IS NULL)::INT::DOUBLE AS x_l_discount_missing FROM l, s")
def f31(spark, sf):
    rows = lines(spark, sf)
    made = rerank.Preprocessor(["l_discount"]).fit(rows).transform()
    return rounded(rows.select("qid", "item_idx", *(v.alias(k) for k, v in made.items())), 5)


@query("f31_fixed_standardise", "SELECT p_partkey, round(greatest(least((p_size - 25) / 10.0, 2), -2), 6) + 0.0 AS z FROM part")
def f31b(spark, sf):
    return rounded(read(spark, sf, "part").select("p_partkey", standardise(F.col("p_size"), 25, 25, 10, 2).alias("z")))


@query("f32_vocabulary", "WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 10 AND p_brand <> 'Brand#3')) SELECT p_partkey, coalesce(code, 0) AS code FROM part LEFT JOIN v USING (p_brand)")
def f32(spark, sf):
    part = read(spark, sf, "part")
    vocab = rerank.vocabulary(part.filter("p_size > 10 and p_brand <> 'Brand#3'"), "p_brand")
    return rerank.encode(part, "p_brand", vocab, "code").select("p_partkey", "code")


@query("r17_listwise_loss", f"WITH l AS {LINES}, p AS (SELECT qid, label, l_quantity / 10 - max(l_quantity / 10) OVER w - ln(sum(exp(l_quantity / 10)) OVER w / exp(max(l_quantity / 10) OVER w)) AS lp, label / greatest(sum(label) OVER w, 1) AS t FROM l WINDOW w AS (PARTITION BY qid)) SELECT qid, round(-sum(t * lp), 6) + 0.0 AS loss FROM p GROUP BY 1")
def r17(spark, sf):
    return rounded(rerank.listwise_loss(lines(spark, sf).withColumn("score", F.col("l_quantity") / 10)))


@query("r18_fit_listwise")
def r18(spark, sf):
    rows = lines(spark, sf)
    made = rerank.Preprocessor(["l_quantity", "l_discount"]).fit(rows).transform()
    data = rows.select("qid", "label", *(v.alias(k) for k, v in made.items()))
    names = [c for c in data.columns if c.startswith("x_")]
    w = rerank.fit_listwise(data, names)
    return spark.createDataFrame([(n, round(float(x), 4)) for n, x in zip(names, w, strict=True)], "feature string, weight double")


@query("a33_importance_share")
def a33(spark, sf):
    rows = lines(spark, sf).withColumn("l_discount", F.coalesce("l_discount", F.lit(-1.0)))
    return rounded(rerank.fit_boosted(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).shares(spark))


def fitted(spark, sf):
    """Rows with inputs of the network, its trained weights, what each epoch gave; columns of its numbers and codes."""
    rows = lines(spark, sf).withColumns({k: (F.col("item_idx") % 30).cast("int") for k in rerank.EMBEDDINGS})
    made = rerank.Preprocessor(["l_quantity", "l_tax"]).fit(rows).transform()
    rows, codes = rows.withColumns(made), {k: k for k in rerank.EMBEDDINGS}
    start = rerank.RerankMLP.random(len(made), {k: 30 for k in rerank.EMBEDDINGS})
    model, history = network.fit_mlp(rows, start, list(made), codes)
    return rows, model, history, list(made), codes


@query("r18_fit_network")
def r18_network(spark, sf):
    return spark.createDataFrame([(h["epoch"], round(h["loss"], 6)) for h in fitted(spark, sf)[2]], "epoch int, loss double")


@query("r19_mlp_score")
def r19(spark, sf):
    rows, model, _, numeric, codes = fitted(spark, sf)
    return rounded(rerank.predict(rows, model, numeric, codes).select("qid", "item_idx", "score"))


@query("r21_ensemble", f"WITH l AS {LINES}, f AS (SELECT qid, item_idx, " + " + ".join(f"(rank() OVER (PARTITION BY qid ORDER BY {s}) + (count(*) OVER (PARTITION BY qid, {s}) - 1) / 2) / count(*) OVER (PARTITION BY qid)" for s in ("l_quantity", "l_extendedprice")) + " AS score FROM l) SELECT qid, item_idx, round(score, 6) AS score FROM f")
def r21(spark, sf):
    return rounded(rerank.ensemble(lines(spark, sf), ["l_quantity", "l_extendedprice"]).select("qid", "item_idx", "score"))


RECALL = f"""WITH l AS {LINES}, np AS (SELECT qid, sum(label) AS n_pos FROM l GROUP BY 1 HAVING sum(label) > 0), top AS (SELECT qid, sum(label) AS hit FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY l_quantity DESC, item_idx) AS r FROM l) WHERE r <= 2 GROUP BY 1),
base AS (SELECT qid, sum(label) AS hit FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY l_extendedprice DESC, item_idx) AS r FROM l) WHERE r <= 2 GROUP BY 1),
ev AS (SELECT np.qid, coalesce(top.hit, 0) / n_pos AS model, coalesce(base.hit, 0) / n_pos AS base, CASE WHEN np.qid % 2 = 0 THEN 'tune' ELSE 'test' END AS part, np.qid % 5 = 0 AS is_region FROM np LEFT JOIN top USING (qid) LEFT JOIN base USING (qid))"""


def recalls(spark, sf):
    rows = lines(spark, sf)
    n_pos = rows.groupBy("qid").agg(F.sum("label").alias("n_pos")).filter("n_pos > 0")
    a, b = (rerank.top_k_recall(rows, s, n_pos, 2).withColumnRenamed("recall", n) for s, n in (("l_quantity", "model"), ("l_extendedprice", "base")))
    return a.join(b, "qid").withColumns({"part": F.when(F.col("qid") % 2 == 0, "tune").otherwise("test"), "is_region": F.col("qid") % 5 == 0})


@query("a26_recall_at_k", f"{RECALL} SELECT qid, round(model, 6) AS model, round(base, 6) AS base FROM ev")
def a26(spark, sf):
    return rounded(recalls(spark, sf).select("qid", "model", "base"))


@query("a27_report", f"{RECALL}, g AS (SELECT part, 'all' AS area, count(*) AS n, avg(model) AS model, avg(base) AS base FROM ev GROUP BY 1 UNION ALL SELECT part, CASE WHEN is_region THEN 'region' ELSE 'city' END, count(*), avg(model), avg(base) FROM ev GROUP BY 1, 2) SELECT part, area, n, round(model, 6) AS model, round(base, 6) AS base, round((model - base) * 100, 6) + 0.0 AS uplift_model FROM g")
def a27(spark, sf):
    return rounded(rerank.report(recalls(spark, sf), "part", "is_region", ["model", "base"], "base"))


# --- pools -------------------------------------------------------------------------------------------------------


@query("a17_pool_sizes", f"WITH d AS {CORPUS} SELECT lang AS want, loc, (SELECT count(*) FROM d x WHERE x.loc = k.loc) AS n, (SELECT count(*) FROM d x WHERE x.loc = k.loc AND x.lang = k.lang) AS n_passing FROM (SELECT DISTINCT a.lang, b.loc FROM {ASKED} a, d b) k")
def a17(spark, sf):
    keys = asked(spark, sf).select(F.col("lang").alias("want")).distinct()
    return pools.pool_sizes(corpus(spark, sf), "loc", keys, "want", F.col("lang") == F.col("want"), ["lang"])


@query("a18_cutoff_stats", f"""WITH d AS {CORPUS}, q AS {ASKED}, g AS (SELECT qid, q.lang = d.lang AS f, q.loc = d.loc AS g FROM q JOIN d ON d.loc IN (q.loc, (q.loc + 1) % 20) JOIN labels USING (doc_id) WHERE quality = 1), z AS (SELECT qid, (SELECT count(*) FROM d) AS n0, (SELECT count(*) FROM d WHERE d.lang = q.lang) AS n1, (SELECT count(*) FROM d WHERE d.loc = q.loc) AS n2, (SELECT count(*) FROM d WHERE d.loc = q.loc AND d.lang = q.lang) AS n3 FROM q),
p AS (SELECT qid, count(*) AS p0, count(*) FILTER (f) AS p1, count(*) FILTER (g) AS p2, count(*) FILTER (f AND g) AS p3, count(*) FILTER (f OR g) AS p4 FROM g GROUP BY 1),
l AS (SELECT qid, unnest(['none', 'filters', 'geo', 'filters+geo', 'geo+fill']) AS variant, unnest([p0, p1, p2, p3, p4]) AS passed, unnest([n0, n1, n2, n3, -1]) AS pool FROM p JOIN z USING (qid))
SELECT qid, variant, passed, pool, round(CASE WHEN variant <> 'geo+fill' THEN CASE WHEN pool <= 50 THEN passed::DOUBLE ELSE 50 * passed / pool END END, 6) AS random_hits FROM l""")
def a18(spark, sf):
    docs, asks = corpus(spark, sf), asked(spark, sf)
    # gold: good documents of the query's location and the next one
    a = asks.select("qid", F.col("lang").alias("ql"), F.col("loc").alias("qp"), F.explode(F.array("loc", (F.col("loc") + 1) % 20)).alias("loc"))
    good = docs.join(read(spark, sf, "labels").filter("quality = 1"), "doc_id")
    gold = a.join(good.select("lang", "loc"), "loc").select("qid", (F.col("ql") == F.col("lang")).alias("in_filters"), (F.col("qp") == F.col("loc")).alias("in_geo"))
    cells = docs.groupBy("lang", "loc").agg(F.count("*").alias("n"))
    by_lang, by_loc = cells.groupBy("lang").agg(F.sum("n").alias("n_filters")), cells.groupBy("loc").agg(F.sum("n").alias("n_geo"))
    sizes = asks.select("qid", "lang", "loc").join(by_lang, "lang", "left").join(by_loc, "loc", "left").join(cells.withColumnRenamed("n", "n_both"), ["lang", "loc"], "left").join(F.broadcast(cells.agg(F.sum("n").alias("n_all"))))
    return rounded(pools.cutoff_stats(gold, sizes.select("qid", "n_all", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_filters", "n_geo", "n_both"))), "qid", 50))


@query("a47_token_coverage", r"WITH b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) SELECT item_id, round(CASE WHEN len(b.w) > 0 THEN len(list_intersect(b.w, coalesce(d.w, []))) / len(b.w) END, 6) AS coverage FROM b LEFT JOIN d ON d.doc_id = b.item_id")
def a47(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), tokens(F.col("text")).alias("dw"))
    both = read(spark, sf, "benchmark").select("item_id", tokens(F.col("text")).alias("qw")).join(docs, "item_id", "left")
    return rounded(both.select("item_id", coverage(F.col("qw"), F.coalesce("dw", F.array().cast("array<string>"))).alias("coverage")))


