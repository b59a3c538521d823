"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step looks only at rows that an earlier, cheaper one left undecided: a text whose length or whose (length,
prefix hash) nobody shares has no copy, so its full content is never hashed. Only keys are shuffled, never texts, as
long as the surviving groups are few enough to send to every task (BROADCAST_ROWS, counted first); beyond that the
same join is shuffled.

Null counts as the empty text. Of equal texts the largest id stays; a null id only if the group has no other. Rows
that repeat an id with the same text count as copies, and all rows of the id that stays are marked kept
(drop_copies leaves one). An empty table gives no rows; further columns are carried unchanged (own names start
with `_ed_`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters that the prefix hash reads.
PREFIX = 128
KEY = ["_ed_len", "_ed_prefix"]


def _keyed(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"_ed_len": F.octet_length(text), "_ed_prefix": F.xxhash64(F.substring(text, 1, PREFIX))})


def _survivors(keyed: DataFrame) -> DataFrame:
    """(length, prefix hash) of more than one row, found among lengths of more than one row."""
    lengths = common.small(common.cut(keyed.groupBy("_ed_len").count().filter("count > 1").select("_ed_len")))
    return keyed.join(lengths, "_ed_len", "left_semi").groupBy(*KEY).count().filter("count > 1").select(*KEY)


def _digested(keyed: DataFrame, text_col: str) -> DataFrame:
    """Rows with _ed_sha, the full hash: null where the prefix hash has already shown that there is no copy."""
    alive = common.small(common.cut(_survivors(keyed.select(*KEY))).withColumn("_ed_alive", F.lit(True)))
    full = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    return keyed.join(alive, KEY, "left").withColumn("_ed_sha", F.when(F.col("_ed_alive"), full)).drop("_ed_alive")


def copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per group of equal texts with at least two rows: _ed_sha, keep_id, group_size, keep_rows (rows with that id)."""
    keyed = _keyed(df.select(F.col(id_col).alias("_ed_id"), text_col), text_col)
    by_id = _digested(keyed, text_col).filter(F.col("_ed_sha").isNotNull()).groupBy("_ed_sha", "_ed_id").count()
    best = F.max(F.struct(F.col("_ed_id").alias("id"), F.col("count").alias("n")))
    groups = by_id.groupBy("_ed_sha").agg(best.alias("best"), F.sum("count").alias("group_size"))
    return groups.filter("group_size > 1").select("_ed_sha", F.col("best.id").alias("keep_id"), "group_size", F.col("best.n").alias("keep_rows"))


def mark_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of df with keep_id, group_size, kept, and keep_rows (how many rows of df repeat the kept id and text)."""
    groups = common.small(common.cut(copy_groups(df, id_col, text_col)))
    rows = _digested(_keyed(df, text_col), text_col).join(groups, "_ed_sha", "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        *df.columns,
        F.when(alone, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col(id_col).eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.coalesce("keep_rows", F.lit(1)).cast("long").alias("keep_rows"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each group of equal texts."""
    marked = mark_copies(df, id_col, text_col).filter("kept")
    once = marked.filter("keep_rows = 1").select(*df.columns)
    again = marked.filter("keep_rows > 1").dropDuplicates([id_col, text_col]).select(*df.columns)
    return once.unionByName(again) if marked.filter("keep_rows > 1").limit(1).count() else once


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_copies(docs)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return marked.select("doc_id", "keep_id", "group_size", "kept", sha.alias("text_sha256"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLE_SQL = {
    "op7_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
}
