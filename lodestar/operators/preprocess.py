"""Raw tables to processed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kv

# --- fixed values: the columns of the raw tables that are dropped, cast, replaced and parsed ---------------------
DROP = ("search_category", "search_is_delivery_search")
DECIMALS = ("item_price", "item_latitude", "item_longitude")
PARSED = {"search_infm_params_text": kv.search_filters, "item_infm_params_text": kv.item_params}
SERVICE_ID, SERVICE_COLUMN, SERVICE_FLAG = 114, "item_category_id", "item_is_service"
QUERY_PREFIXES = ("query_id", "search_", "filter_")
# ----------------------------------------------------------------------------------------------------------------


def drop_degenerate(df: DataFrame) -> DataFrame:
    return df.drop(*DROP)


def cast_decimals(df: DataFrame) -> DataFrame:
    decimal = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns({c: F.col(c).cast("double") for c in DECIMALS if c in decimal})


def add_service_flag(df: DataFrame) -> DataFrame:
    """The category id gives way, in its place, to whether it is that of services."""
    return df.select(*((F.col(c) == SERVICE_ID).alias(SERVICE_FLAG) if c == SERVICE_COLUMN else F.col(c) for c in df.columns))


def parse_params(df: DataFrame) -> DataFrame:
    for column, fields in PARSED.items():
        if column in df.columns:
            df = df.withColumn("_pairs", kv.split_params(F.col(column)))
            df = df.withColumns(fields(F.col("_pairs"))).drop("_pairs", column)
    return df


def order_columns(df: DataFrame) -> DataFrame:
    first = [c for c in df.columns if c.startswith(QUERY_PREFIXES)]
    return df.select(*first, *(c for c in df.columns if c not in first))


def transform(df: DataFrame) -> DataFrame:
    """All of it; columns that a table lacks are skipped, so one plan serves queries, items and pairs."""
    for f in (drop_degenerate, cast_decimals, add_service_flag, parse_params, order_columns):
        df = df.transform(f)
    return df


def describe_changes(df: DataFrame) -> DataFrame:
    """(change, column) of what transform would do, from the schema alone."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    rows = [("dropped", c) for c in (*DROP, *PARSED) if c in kinds]
    rows += [("cast", c) for c in DECIMALS if isinstance(kinds.get(c), T.DecimalType)]
    rows += [("added", SERVICE_FLAG)] if SERVICE_COLUMN in kinds else []
    rows += [("added", name) for column, fields in PARSED.items() if column in kinds for name in fields(F.col(column))]
    return df.sparkSession.createDataFrame(rows, "change string, column string")


def process(spark: SparkSession, src: str, dst: str, compression: str = "zstd") -> None:
    """One table, read and written partition by partition."""
    transform(spark.read.parquet(src)).write.mode("overwrite").option("compression", compression).parquet(dst)


def missing_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that don't exist, in whatever file system they are."""
    conf = spark._jsc.hadoopConfiguration()
    at = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return [p for p, x in zip(paths, at, strict=True) if not x.getFileSystem(conf).exists(x)]
