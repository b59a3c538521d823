"""Where results go."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd", mode: str = "overwrite") -> None:
    """Parquet, written task by task; partition_by lays out folds and parts for pruning."""
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """One CSV file with a header and plain line ends; doubles with fixed digits if asked. For small reports and answers."""
    if digits is not None:
        df = df.select(*(F.format_string(f"%.{digits}f", F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))
    df.coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("emptyValue", "").option("encoding", "UTF-8").csv(path)


def write_json_config(spark: SparkSession, config: dict, path: str) -> None:
    text = json.dumps(config, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_events(gold: DataFrame, path: str, event: str, item: str) -> None:
    """Events with their positives as a sorted list."""
    write_table(gold.groupBy(event).agg(F.array_sort(F.collect_set(item)).alias("positives"), F.countDistinct(item).alias("n_pos")), path)


def write_split(split: DataFrame, evaluation: DataFrame, catalog: DataFrame, config_json: str, path: str) -> None:
    """train_pairs, val_pairs, val_eval, catalog and config of a split."""
    write_table(split.filter("part = 'train'").drop("part", "slice"), f"{path}/train_pairs.parquet")
    write_table(split.filter("part = 'val'").drop("part"), f"{path}/val_pairs.parquet")
    write_table(evaluation, f"{path}/val_eval.parquet")
    write_table(catalog.orderBy("item_id"), f"{path}/catalog.parquet")
    write_json_config(split.sparkSession, json.loads(config_json), f"{path}/config.json")


def missing_vectors(wanted: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """Rows of wanted that a vector store lacks: new keys, and keys whose text has changed (md5)."""
    stamped = wanted.withColumn("text_md5", F.md5(F.coalesce(F.col(text), F.lit(""))))
    try:
        known = wanted.sparkSession.read.parquet(path).select(key, "text_md5")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return stamped
        raise
    return stamped.join(known, [key, "text_md5"], "left_anti")


def append_vectors(made: DataFrame, path: str) -> None:
    """Adds (key, text_md5, vector) to a vector store."""
    made.write.mode("append").parquet(path)


def read_vectors(spark: SparkSession, path: str, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Vectors of wanted's current texts."""
    stamped = wanted.select(key, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"))
    return spark.read.parquet(path).join(stamped, [key, "text_md5"], "left_semi").dropDuplicates([key])


class Stage:
    """Intermediate tables of one run in a folder of their own: later steps read them instead of growing one huge plan. Closing deletes the folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path, self.n = spark, f"{root}/stage-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
