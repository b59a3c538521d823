"""How the driver's tables stand for corpus, queries, pairs and locations; and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# pairs: an order is an event, a part an item, nations are locations
STAR = """(SELECT l_orderkey AS event_id, c_mktsegment || '|' || o_orderpriority AS search_query, c_nationkey AS search_location_id,
  l_partkey AS item_id, s_nationkey AS item_location_id, p_type AS item_microcat_id, l_suppkey
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def star(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    orders = read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    customer = read(spark, sf, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    supplier = read(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    part = read(spark, sf, "part", "p_partkey", "p_type")
    # orders meet customers first, so lines, the largest table, aren't dealt by customer
    asks = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", F.concat_ws("|", "c_mktsegment", "o_orderpriority").alias("search_query"))
    both = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(asks, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.col("l_orderkey").alias("event_id"), "search_query", F.col("c_nationkey").alias("search_location_id"), F.col("l_partkey").alias("item_id"), F.col("s_nationkey").alias("item_location_id"), F.col("p_type").alias("item_microcat_id"), "l_suppkey")


# suppliers have coordinates that follow from their keys, some of them unknown
POINTS = """(SELECT s_nationkey AS loc, s_suppkey,
  CASE WHEN s_suppkey % 17 = 0 THEN 0.0 ELSE 45.0 + (s_nationkey * 7) % 20 + (s_suppkey % 10) / 10.0 END::DOUBLE AS lat,
  CASE WHEN s_suppkey % 17 = 0 THEN 0.0 WHEN s_suppkey % 23 = 0 THEN NULL ELSE 30.0 + (s_nationkey * 11) % 25 + (s_suppkey % 7) / 10.0 END::DOUBLE AS lon
 FROM supplier)"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    lat = F.when(k % 17 == 0, 0.0).otherwise(45.0 + (n * 7) % 20 + (k % 10) / 10.0)
    lon = F.when(k % 17 == 0, 0.0).when(k % 23 == 0, None).otherwise(30.0 + (n * 11) % 25 + (k % 7) / 10.0)
    return read(spark, sf, "supplier", "s_suppkey", "s_nationkey").select(n.alias("loc"), "s_suppkey", lat.alias("lat"), lon.alias("lon"))


# documents are a corpus with a location (source) and a category (language); benchmark texts are its queries
CORPUS = "(SELECT doc_id, text, lang, CAST(substr(source, 4) AS INT) AS loc FROM documents)"
ASKED = "(SELECT item_id AS qid, text, CAST(item_id % 20 AS INT) AS loc, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS lang FROM benchmark)"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "text", "lang", "source").select("doc_id", "text", "lang", F.substring("source", 4, 10).cast("int").alias("loc"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("item_id")
    lang = F.when(q % 4 == 0, "en").when(q % 4 == 1, "fr").when(q % 4 == 2, "de").otherwise("es")
    return read(spark, sf, "benchmark").select(q.alias("qid"), "text", (q % 20).cast("int").alias("loc"), lang.alias("lang"))
