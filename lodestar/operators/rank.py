"""Ranking: top-k, fusion, fill, quotas, fractional ranks, gaps, hash sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import rrf_weight


#: Rows that a task of gathered() has, about.
TASK_ROWS = 1_000_000


def gathered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with each group's rows in one task, and as many tasks as its rows need: a fixed number's would grow with the table. df is counted."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(-(-n // TASK_ROWS), min(cores, n // 10_000), 1), *by)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df persisted and counted, with a broadcast hint if it has no more than `rows` rows."""
    df = df.persist()
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, by: Sequence[str], score: str, tie: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """Rank from 1 within by; ties go to the smaller tie key."""
    order = F.desc(score) if descending else F.asc(score)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order, F.asc(tie))))


def top_k(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    """The k best of each group. The rank filter reaches below the shuffle (WindowGroupLimit), so k rows of a group leave each task."""
    return ranked(df, by, score, tie, name).filter(F.col(name) <= k)


def rank_pool(scores: DataFrame, pools: DataFrame, members: DataFrame, query: str, pool: str, item: str, depth: int, inside: bool = False) -> DataFrame:
    """The first depth members of each query's pool, members without a score counting as 0 (score, then smaller item).

    scores (query, item, score > 0); pools (query, pool); members (pool, item). Only the first `depth` members of a
    pool can pad its queries besides those that have scores, so no query meets its whole pool. inside: all scores are of
    members; a query's best `depth` of them suffice.
    """
    own = scores.select(query, item, "score") if inside else pools.join(scores, query).join(members, [pool, item], "left_semi").select(query, item, "score")
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy(pool).orderBy(item)))
    # depth zeros and as many scored ones suffice, as scored members may stand among the first
    deep = own.groupBy(query).agg(F.count("*").alias("_scored"))
    padding = pools.join(first.filter(F.col("_n") <= 2 * depth), pool).select(query, item, F.lit(0.0).alias("score"))
    missing = padding.join(deep, query, "left").filter(F.coalesce("_scored", F.lit(0)) < depth).select(query, item, "score")
    both = own.unionByName(missing.join(own.select(query, item), [query, item], "left_anti"))
    return top_k(both, [query], "score", item, depth)


def rrf(lists: DataFrame, query: str, item: str, k: int = 60, rank: str = "rank") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query, item, rank from 1): (query, item, rrf)."""
    return lists.groupBy(query, item).agg(F.sum(rrf_weight(F.col(rank), k)).alias("rrf"))


def fill(parts: Sequence[tuple[DataFrame, int]], query: str, item: str) -> DataFrame:
    """Lists in order of priority, each with the length up to which it may fill: (query, item, cand_rank from 0, source).

    An item counts in the first list that has it; places that a list leaves free pass on to later ones only. Lists have
    (query, item, rank from 1).
    """
    out: DataFrame | None = None
    for source, (own, cap) in enumerate(parts):
        own = own.select(query, item, "rank")
        if out is None:
            out = own.filter(F.col("rank") <= cap).select(query, item, (F.col("rank") - 1).cast("long").alias("cand_rank"), F.lit(source).alias("source"))
            continue
        held = out.groupBy(query).agg(F.count("*").alias("_held"))
        fresh = own.join(out.select(query, item), [query, item], "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
        placed = fresh.join(held, query, "left").withColumn("cand_rank", (F.coalesce("_held", F.lit(0)) + F.col("_r") - 1).cast("long"))
        out = out.unionByName(placed.filter(F.col("cand_rank") < cap).select(query, item, "cand_rank", F.lit(source).alias("source")))
    assert out is not None
    return out


def list_ranks(candidates: DataFrame, ranked_lists: DataFrame, query: str, item: str, names: Sequence[str], k: int) -> DataFrame:
    """candidates with rank_<name> from 0 in each named list's first k, -1 if it isn't there. ranked_lists: (query, item, list, rank from 1)."""
    wide = ranked_lists.filter(F.col("rank") <= k).groupBy(query, item).pivot("list", list(names)).agg(F.min("rank"))
    joined = candidates.join(wide.withColumnsRenamed({n: f"_{n}" for n in names}), [query, item], "left")
    return joined.withColumns({f"rank_{n}": F.coalesce(F.col(f"_{n}") - 1, F.lit(-1)).cast("int") for n in names}).drop(*(f"_{n}" for n in names))


def fractional_rank(score: str, by: Sequence[str]) -> Column:
    """Ascending average rank over the group's size: equal scores share theirs."""
    group = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, score))
    return (F.rank().over(group.orderBy(score)) + (ties - 1) / 2) / F.count("*").over(group)


def gap_to_best(score: str, by: Sequence[str]) -> Column:
    """score less its group's maximum: 0 for the best."""
    return F.col(score) - F.max(score).over(Window.partitionBy(*by))


def id_list(df: DataFrame, by: str, item: str, rank: str = "rank", name: str = "answer") -> DataFrame:
    """One string of ids for each group, in order of rank."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).cast("string").alias("i"))))
    return df.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["i"]), " ").alias(name))


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order, the same in other engines."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows (or all) by the order of a hash of their key.

    Rows are counted by the first 16 bits of the hash; whole buckets pass by a filter, and only the bucket in which the
    sample ends is sorted. df must give the same rows when read again.
    """
    order = hash_order(F.col(key), seed)
    bucket = F.coalesce(F.substring(order, 1, 4), F.lit(""))  # null keys come first, as in a sort
    taken = 0
    for name, count in sorted(tuple(r) for r in df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()):  # 65,537 rows at most
        if taken + count > n:
            border = df.filter(bucket == name).orderBy(order, key).limit(n - taken)
            return df.filter(bucket < name).unionByName(border)
        taken += count
    return df


def places(df: DataFrame, order: Sequence[Column], weight: str | None = None, ranges: int = 256) -> DataFrame:
    """df with place (from 1) in the whole order, and covered: the sum of weight up to each row.

    Some rows, drawn by a hash, cut the order into ranges; rows are numbered inside their range and moved by what the
    ranges before hold, so no task sorts more than its range. order must tell rows apart, and df must give the same rows when read again.
    """
    key = df.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    drawn = key.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(ranges - 1)
    bounds = drawn.agg(F.collect_list("_key")).scalar()
    # never null: the join on it would else test that it isn't, for each row below the aggregates that df may have
    at = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))), F.lit(0))
    own = key.withColumn("_bounds", bounds).withColumn("_range", at).drop("_bounds")
    add = F.col(weight) if weight else F.lit(1)
    held = own.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(add).alias("_w"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    start = held.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"))
    inside = Window.partitionBy("_range").orderBy("_key")
    moved = own.join(F.broadcast(start), "_range").withColumn("place", (F.row_number().over(inside) + F.col("_n")).cast("long"))
    if weight:
        moved = moved.withColumn("covered", F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_w"))
    return moved.drop("_key", "_range", "_n", "_w")


def keep_and_fill(df: DataFrame, key: str, keep: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Keys of keep, filled up to n with others of df by the order of a hash. Both are persisted, as they are read several times."""
    kept = df.join(keep.select(key).distinct(), key, "left_semi").select(key).distinct().persist()
    others = df.select(key).distinct().join(kept, key, "left_anti").persist()
    return kept.unionByName(sample_exact(others, key, max(0, n - kept.count()), seed))


def thin_negatives(df: DataFrame, by: Sequence[str], label: str, rank: str, item: str, best: int = 50, random: int = 50, seed: int = 0) -> DataFrame:
    """All positives, the best-ranked negatives, and some of the rest by the order of a hash."""
    order = Window.partitionBy(*by, label).orderBy(rank)
    numbered = df.withColumn("_n", F.row_number().over(order)).withColumn("_rest", F.col("_n") > best)
    chance = Window.partitionBy(*by, label, "_rest").orderBy(hash_order(F.concat_ws("/", *by, item), seed))
    drawn = numbered.withColumn("_d", F.row_number().over(chance))
    return drawn.filter((F.col(label) == 1) | ~F.col("_rest") | (F.col("_d") <= random)).drop("_n", "_rest", "_d")


def groups_with_positive(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    return df.withColumn("_best", F.max(label).over(Window.partitionBy(*by))).filter("_best > 0").drop("_best")
