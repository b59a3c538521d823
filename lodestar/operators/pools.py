"""Candidate pools as joins, and what a cut-off costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import clean_list
from .filters import hard_mask

ALL, FILTERS, GEO, BOTH, NEIGHBORS, FILLED = "none", "filters", "geo", "filters+geo", "neighbors", "geo+fill"
VARIANTS = (ALL, FILTERS, GEO, BOTH)


def members(pairs: DataFrame, variant: str, mask: Column, in_geo: Column) -> DataFrame:
    """Pairs (query, item) that a variant lets through."""
    return {ALL: pairs, FILTERS: pairs.filter(mask), GEO: pairs.filter(in_geo), BOTH: pairs.filter(mask & in_geo)}[variant]


def members_by_filters(keys: DataFrame, items: DataFrame, key: str = "pool", item: str = "item_id") -> DataFrame:
    """(key, item): the items that pass each distinct filter combination, by equi-joins.

    keys: key and filter (as combo_key makes it). A combination meets items on its category, else on its types, else on
    its subjects; only those without any of these (booking or nothing at all: two at most) take the whole corpus.
    """
    k = keys.select(key, F.col("filter.category").alias("_c"), F.col("filter.subcategories").alias("_s"), F.col("filter.subjects").alias("_j"), F.col("filter.booking").alias("_b"))
    i = items.select(item, "item_category", "item_subcategory", clean_list(F.col("item_subjects")).alias("item_subjects"), "item_online_booking")
    mask = hard_mask(F.col("_c"), F.col("_s"), F.col("_j"), F.col("_b"), F.col("item_category"), F.col("item_subcategory"), F.col("item_subjects"), F.col("item_online_booking"))
    has_c, has_s, has_j = F.col("_c") != "", F.size("_s") > 0, F.size("_j") > 0
    by_category = k.filter(has_c).join(i, F.col("_c") == F.col("item_category"))
    by_type = k.filter(~has_c & has_s).withColumn("_x", F.explode("_s")).join(i, F.col("_x") == F.col("item_subcategory")).drop("_x")
    subjects = i.withColumn("_x", F.explode(F.array_distinct("item_subjects")))
    by_subject = k.filter(~has_c & ~has_s & has_j).withColumn("_y", F.explode("_j")).join(subjects, F.col("_y") == F.col("_x")).drop("_x", "_y")
    rest = k.filter(~has_c & ~has_s & ~has_j).join(i.withColumn("_b2", F.explode(F.array(F.lit(True), F.lit(False)))), F.col("_b") == F.col("_b2")).drop("_b2")
    out = [x.filter(mask).select(key, item) for x in (by_category, by_type, by_subject, rest)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).distinct()


def members_by_places(places: DataFrame, items: DataFrame, query: str = "qid", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Pools (query, pool) and their members (pool, item) for queries' locations (query, loc): queries of the same locations share a pool."""
    key = F.md5(F.array_join(F.array_sort(F.transform(F.collect_set("loc"), lambda x: x.cast("string"))), ","))
    pools = places.groupBy(query).agg(key.alias("pool"))
    distinct = places.join(pools, query).select("pool", "loc").distinct()
    return pools, distinct.join(items.select(F.col("item_location_id").alias("loc"), item), "loc").select("pool", item).distinct()


def pool_sizes(items: DataFrame, loc: str, keys: DataFrame, key: str, mask: Column, by: Sequence[str], slots: int = 64) -> DataFrame:
    """(key, loc, n, n_passing): items of each location, and those that pass each distinct filter key.

    by: the items' columns that mask reads. Items are counted by location and these first; keys meet the counts by slots.
    """
    counted = items.groupBy(loc, *by).agg(F.count("*").alias("_n")).withColumn("_slot", F.pmod(F.xxhash64(loc, *by), F.lit(slots)))
    spread = keys.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return counted.join(spread, "_slot").groupBy(key, loc).agg(F.sum("_n").alias("n"), F.sum(F.when(mask, F.col("_n")).otherwise(0)).alias("n_passing"))


def cutoff_stats(gold: DataFrame, sizes: DataFrame, query: str, top_k: int) -> DataFrame:
    """(query, variant, passed, pool, random_hits).

    gold: one row per positive (query, in_filters, in_geo); sizes: (query, n_all, n_filters, n_geo, n_both). A random order
    finds all that passed if the pool has no more than top_k items, else top_k / pool of them. The filled variant has no
    pool of its own: -1, and no random order.
    """
    f, g = F.col("in_filters"), F.col("in_geo")
    passed = gold.groupBy(query).agg(F.count("*").alias("p_all"), F.count_if(f).alias("p_filters"), F.count_if(g).alias("p_geo"), F.count_if(f & g).alias("p_both"), F.count_if(f | g).alias("p_fill"))
    rows = F.array(*(F.struct(F.lit(v).alias("variant"), F.col(p).alias("passed"), n.cast("long").alias("pool")) for v, p, n in ((ALL, "p_all", F.col("n_all")), (FILTERS, "p_filters", F.col("n_filters")), (GEO, "p_geo", F.col("n_geo")), (BOTH, "p_both", F.col("n_both")), (FILLED, "p_fill", F.lit(-1)))))
    long = passed.join(sizes, query).select(query, F.inline(rows))
    random = F.when(F.col("variant") != FILLED, F.when(F.col("pool") <= top_k, F.col("passed").cast("double")).otherwise(top_k * F.col("passed") / F.col("pool")))
    return long.withColumn("random_hits", random)
