"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The matrix says how many rows partition p sends to shard s. Its row sums are the partitions' counts, its column sums
the shards' exact sizes, and it is distributed as under a uniform random permutation of all rows: the shards' sizes
are split over the two halves of the partitions by a multivariate hypergeometric draw, each half again, down to
single partitions. Each task draws only the branch that leads to its own partition, from seeds that belong to the
branch, so the matrix is never held anywhere; what all tasks get is one count per partition.

Then each partition permutes its rows and deals them out by its row of the matrix, rows are exchanged, and each shard
permutes what it got: rows are sorted by a random key, in buckets of bounded size, and numbered.

The rows are checkpointed in the shared folder first: counts and dealing see the same partitions, and a task that runs
again deals the same rows to the same shards (the checkpoint goes when the driver ends). Nulls in any column, repeated rows and empty texts are rows like all
others; texts of any
length are carried whole; rows of equal keys go by their first column; an empty table gives no rows; further columns are
carried (a clashing `shard` or `slot` is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

#: Rows that a bucket of the second permutation holds on average.
BUCKET_ROWS = 20_000
#: numpy's hypergeometric generator takes populations below this; above, _law gives the distribution itself.
NUMPY_BELOW = 10**9


def _law(good: int, bad: int, n: int) -> tuple[int, np.ndarray]:
    """Least value and cumulated (not scaled) probabilities of a hypergeometric number, from ratios of neighbours about its mode.

    Values further off than 12 spreads and 40 are left out: all of them together are rarer than a double can tell.
    """
    total = good + bad
    spread = (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5
    mode, reach = (n + 1) * (good + 1) // (total + 2), int(12 * spread) + 40
    least, most = max(0, n - bad, mode - reach), min(n, good, mode + reach)
    k = np.arange(least, most, dtype=np.int64)
    step = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    height = np.append(0, np.cumsum(step))
    return least, np.cumsum(np.exp(height - height.max()))


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if not n or not good:
        return 0
    if good + bad < NUMPY_BELOW:
        return int(rng.hypergeometric(good, bad, n))
    least, law = _law(good, bad, n)
    return least + int(np.searchsorted(law, rng.random() * law[-1], side="right"))


def split_margins(sizes: list[int], n: int, rng: np.random.Generator) -> list[int]:
    """How many of n rows, drawn without replacement from shards of these sizes, each shard takes."""
    out, left = [], sum(sizes)
    for size in sizes:
        left -= size
        out.append(_draw(rng, size, left, n))
        n -= out[-1]
    return out


def matrix_row(before: np.ndarray, sizes: list[int], p: int, seed: int) -> list[int]:
    """Row p of the matrix. before: rows of all earlier partitions, one more than there are partitions."""
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split_margins(sizes, int(before[mid] - before[lo]), np.random.default_rng((seed, lo, hi)))
        if p < mid:
            hi, sizes = mid, left
        else:
            lo, sizes = mid, [a - b for a, b in zip(sizes, left, strict=True)]
    return sizes


def shard_sizes(n: int, shards: int) -> list[int]:
    """Equal but for at most one row."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def deal(df: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 within the shard). Carry narrow columns: df is written once and exchanged once."""
    df = df.drop("shard", "slot")
    common.shared_dir(df.sparkSession)
    kept = df.checkpoint()  # unlike a table, it has the same partitions whenever it is read
    common.delete_at_exit(df.sparkSession, kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    key, bucket, rank, start = (common.fresh(df, c) for c in ("_key", "_bucket", "_rank", "_start"))
    counts = {r["p"]: r["n"] for r in kept.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0, *(counts.get(p, 0) for p in range(max(counts, default=-1) + 1))]).astype(np.int64)
    n = int(before[-1])
    sizes, buckets = shard_sizes(n, shards), n // (shards * BUCKET_ROWS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        own = int(before[p + 1] - before[p]) if p < len(before) - 1 else 0
        rng = np.random.default_rng((seed, p))
        to = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix_row(before, sizes, p, seed))) if own else np.empty(0, np.int32)
        at = 0
        for batch in batches:
            m = batch.num_rows
            if at + m > own:
                raise ValueError("partitions changed between counting and dealing")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + m]), pa.array(rng.integers(0, 1 << 62, m))], names=[*batch.schema.names, "shard", key])
            at += m
        if at < own:
            raise ValueError("partitions changed between counting and dealing")

    schema = T.StructType([*kept.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(key, T.LongType())])
    dealt = kept.mapInArrow(run, schema).withColumn(bucket, F.floor(F.col(key) / (2.0**62 / buckets)).cast("int"))
    sizes_of = dealt.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    starts = sizes_of.select("shard", bucket, (F.sum("n").over(Window.partitionBy("shard").orderBy(bucket)) - F.col("n")).alias(start))
    place = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(key, *kept.columns[:1]))
    return dealt.withColumn(rank, place).join(starts, ["shard", bucket]).select(*(f"`{c}`" for c in kept.columns), "shard", (F.col(start) + F.col(rank) - 1).cast("long").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    return deal(docs).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {"op5_sharding": op5_sharding}
ORACLE_SQL: dict[str, str] = {}
