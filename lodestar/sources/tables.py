"""Where tables are, and the scans the pipelines start from."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Paths:
    """The folders of one deployment; any file system that Spark reads."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name in ("dataset", "processed", "split", "embeddings", "rerank", "results"):
            return f"{self.root}/{name}"
        raise AttributeError(name)


def scan(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, with only the columns asked for in its ReadSchema."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def schema_of(df: DataFrame) -> DataFrame:
    """(position, column, type), from metadata alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def first_by(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first by a stated order, not by file position."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def catalog(items: DataFrame, members: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Items of a catalogue, one row each."""
    return first_by(items, key, order).join(members.select(key).distinct(), key, "left_semi")


def extra_items(items: DataFrame, members: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Items outside a catalogue, one row each, sorted."""
    return first_by(items, key, order).join(members.select(key).distinct(), key, "left_anti").orderBy(key)


def geo_pairs(pairs: DataFrame, item_locations: DataFrame | None = None, item: str = "item_id") -> DataFrame:
    """(search_location_id, item_location_id): the pairs' own, or looked up by item where pairs lack it."""
    if item_locations is not None:
        pairs = pairs.drop("item_location_id").join(item_locations, item, "left")
    return pairs.select("search_location_id", "item_location_id")


def sample_hash(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows whose key's md5 falls under the share: the same ones in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return df.filter(bits < int(share * 2**32))


def read_json_config(spark: SparkSession, path: str) -> dict:
    """A small JSON file of any file system."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


ANSWER = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("answer", T.StringType())])


def read_answer(spark: SparkSession, path: str) -> DataFrame:
    """An earlier answer file: (query_id, answer) as text, '' for an empty answer."""
    df = spark.read.schema(ANSWER).option("header", True).csv(path)
    return df.withColumn("answer", F.coalesce("answer", F.lit("")))
