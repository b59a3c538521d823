"""The answer table and the rules it must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import split_ids
from ..functions.text import is_item_id, is_query_id
from .rank import id_list

MAX_ITEMS = 50


def make_answer(queries: DataFrame, ranked: DataFrame, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """(query, answer): ids in order of rank for each query, '' for one without predictions."""
    lists = id_list(ranked, query, item)
    return queries.select(query).distinct().join(lists, query, "left").select(query, F.coalesce("answer", F.lit("")).alias("answer"))


def check_answer(answer: DataFrame, queries: DataFrame, items: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(rule, n) of all broken rules; no rows if all is well. answer: (query_id, answer); queries: query_id; items: item_id."""
    spark = answer.sparkSession
    if answer.columns != ["query_id", "answer"]:
        return spark.createDataFrame([("columns", 1)], "rule string, n long")
    got = answer.select("query_id").distinct()
    wanted = queries.select("query_id").distinct()
    rows = answer.withColumn("_ids", split_ids(F.col("answer")))
    per_row = rows.agg(
        (F.count("*") - F.countDistinct("query_id")).alias("repeated query_id"),
        F.count_if(~is_query_id(F.col("query_id"))).alias("query_id format"),
        F.count_if(F.size("_ids") > max_items).alias("too many items"),
        F.count_if(F.size("_ids") != F.size(F.array_distinct("_ids"))).alias("repeated items"),
    )
    each = rows.select(F.explode("_ids").alias("item_id"))
    unknown = each.join(items.select("item_id").distinct(), "item_id", "left_anti").agg(F.count("*").alias("n"))
    format_ = each.agg(F.count_if(~is_item_id(F.col("item_id"))).alias("n"))
    names = per_row.columns
    out = per_row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").cast("long").alias("n")) for n in names))))
    for rule, df in (("missing query_id", wanted.join(got, "query_id", "left_anti").agg(F.count("*").alias("n"))), ("extra query_id", got.join(wanted, "query_id", "left_anti").agg(F.count("*").alias("n"))), ("unknown items", unknown), ("item_id format", format_)):
        out = out.unionByName(df.select(F.lit(rule).alias("rule"), F.col("n").cast("long")))
    return out.filter("n > 0")


def fill_summary(answer: DataFrame, top_k: int = MAX_ITEMS) -> DataFrame:
    """How many answers are full, short and empty, and the mean length."""
    n = F.size(split_ids(F.col("answer")))
    return answer.agg(F.count_if(n >= top_k).alias("full"), F.count_if((n > 0) & (n < top_k)).alias("short"), F.count_if(n == 0).alias("empty"), F.avg(n).alias("mean_items"))


def compare_answers(new: DataFrame, old: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, overlap): share of the new answer's items that the old one had."""
    both = new.join(old.select(query, F.col("answer").alias("_old")), query)
    a, b = split_ids(F.col("answer")), split_ids(F.col("_old"))
    return both.select(query, (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))).alias("overlap"))
