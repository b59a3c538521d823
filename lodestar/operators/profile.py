"""Profiles of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ngrams, tokens
from .rank import places


def missing(df: DataFrame) -> DataFrame:
    """(column, missing, share) in one pass; NaN counts as missing."""
    kinds = dict(df.dtypes)
    gone = {c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)) for c in df.columns}
    wide = df.agg(F.count("*").alias("_n"), *(F.count_if(v).alias(c) for c, v in gone.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns))
    return wide.select("_n", F.inline(rows)).select("column", "missing", (F.col("missing") / F.greatest("_n", F.lit(1))).alias("share"))


def duplicates(df: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """(key, duplicates): rows less distinct values of each key; nulls are values."""
    count = {n: F.count("*") - F.countDistinct(F.struct(*c)) for n, c in keys.items()}
    wide = df.agg(*(v.alias(n) for n, v in count.items()))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("key"), F.col(n).alias("duplicates")) for n in keys))))


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(counter, n, share) of rows that meet each condition."""
    wide = df.agg(F.count("*").alias("_n"), *(F.count_if(v).alias(k) for k, v in conditions.items()))
    rows = wide.select("_n", F.inline(F.array(*(F.struct(F.lit(k).alias("counter"), F.col(k).alias("n")) for k in conditions))))
    return rows.select("counter", "n", (F.col("n") / F.greatest("_n", F.lit(1))).alias("share"))


def order_statistics(df: DataFrame, columns: dict[str, Column], at: Sequence[float]) -> DataFrame:
    """(name, values): each column's exact quantiles, interpolated, nulls left out; no row for a column without values.

    Values are counted before they are put in order, and no task holds a whole column.
    """
    long = df.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in columns.items()))))
    counts = long.filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    own = places(counts, [F.col("name"), F.col("value")], "n")
    # one row a column: how many values it has, and how many the columns before it have
    sizes = counts.groupBy("name").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("first", F.sum("size").over(Window.orderBy("name")) - F.col("size"))
    own = own.join(F.broadcast(sizes), "name").withColumn("upto", F.col("covered") - F.col("first"))
    spots = [F.lit(float(q)) * (F.col("size") - 1) for q in at]
    reached = [F.min(F.when(F.col("upto") > edge(x), F.col("value"))).alias(f"{side}{i}") for i, x in enumerate(spots) for side, edge in (("l", F.floor), ("u", F.ceil))]
    ends = own.groupBy("name", "size").agg(*reached)
    return ends.select("name", F.array(*(F.col(f"l{i}") + (F.col(f"u{i}") - F.col(f"l{i}")) * (x - F.floor(x)) for i, x in enumerate(spots))).alias("values"))


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> DataFrame:
    """(q, value): exact, interpolated; null for a column without values."""
    row = order_statistics(df, {column: F.col(column)}, at).agg(F.first("values").alias("v"))
    return row.select(F.inline(F.arrays_zip(F.array(*(F.lit(float(q)) for q in at)).alias("q"), F.coalesce("v", F.array(*(F.lit(None).cast("double") for _ in at))).alias("value"))))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins, values outside clipped into the first and last."""
    at = F.floor((value - low) / ((high - low) / bins))
    return df.filter(value.isNotNull()).groupBy(F.greatest(F.least(at, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n, share)."""
    counts = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def concentration(df: DataFrame, key: str) -> DataFrame:
    """(key, n, place, cum_share): what the most frequent keys cover together."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return places(counts, [-F.col("n"), F.col(key)], "n").withColumn("cum_share", F.col("covered") / counts.agg(F.sum("n")).scalar()).drop("covered")


def density(df: DataFrame, x: Column, y: Column, width: float) -> DataFrame:
    """(cx, cy, n): counts in square cells."""
    return df.groupBy(F.floor(x / width).alias("cx"), F.floor(y / width).alias("cy")).agg(F.count("*").alias("n"))


def ngram_counts(df: DataFrame, text: Column, n: int) -> DataFrame:
    # the words are a column of their own, else each n-gram would split the text anew
    words = df.select(tokens(text).alias("_words"))
    return words.select(F.explode_outer(ngrams(F.col("_words"), n)).alias("ngram")).filter("ngram is not null").groupBy("ngram").agg(F.count("*").alias("n"))


def token_frequency(df: DataFrame, text: Column, stop: Sequence[str] = (), longer_than: int = 2) -> DataFrame:
    words = df.select(F.explode_outer(tokens(text)).alias("token")).filter((F.length("token") > longer_than) & ~F.col("token").isin(*stop))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def degrees(df: DataFrame, key: str) -> DataFrame:
    """(degree, n): how many keys have how many rows."""
    return df.groupBy(key).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))
