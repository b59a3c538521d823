"""Shared pieces: input tables, lineage cuts, size-checked broadcasts and Arrow batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a broadcast side may have at most; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lowers A-Z and leaves every other byte alone.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Tables of cut() that are still there.
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. One of our own only in local mode, where there is no other machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if own is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="lodestar-")
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later jobs neither recompute it nor lose it with an
    executor, and see its true size. Tables go when the driver ends, or before by forget().

    A checkpoint would carry the estimated size of its plan along, which multiplies with every join of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def delete_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(lambda: [_delete(spark, p) for p in list(_written)])
    _written.add(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that cut() has written, once nothing will read them again."""
    for df in tables:
        _delete(df.sparkSession, df._lodestar_path)


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.discard(path)


def bounded_batches(spark: SparkSession, rows: int = 2000, mb: int = 8) -> None:
    """Bounds what one Arrow batch to a Python worker holds, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has no more than `rows` rows (counted; so cut it before), else df as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores behind it until df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text: the remainder decides what is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def held_out(mod: int, rest: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc_of_id(id_col), F.lit(mod)) == rest, F.lit(False))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def add_columns(df: DataFrame, input_col: str, made: dict[str, str], kernel: Callable[[list], dict[str, list]], mb: float = 2) -> DataFrame:
    """df with further columns that kernel makes from the values of input_col, some at a time. A column of df with the name of a new one goes.

    made: SQL type by name. kernel gets at most ~mb MB of texts at once (or one longer text) and returns a list by name.
    """
    import pyarrow as pa

    bounded_batches(df.sparkSession)
    df = df.drop(*made)
    kinds = {"string": (pa.string(), T.StringType()), "double": (pa.float64(), T.DoubleType()), "bigint": (pa.int64(), T.LongType()), "int": (pa.int32(), T.IntegerType()), "binary": (pa.binary(), T.BinaryType())}
    at, names = df.columns.index(input_col), [*df.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(at).to_pylist(), mb):
                values = kernel(batch.column(at)[part].to_pylist())
                own = [c[part] for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(values[k], kinds[v][0]) for k, v in made.items())], names=names)

    schema = T.StructType([*df.schema.fields, *(T.StructField(k, kinds[v][1]) for k, v in made.items())])
    return df.mapInArrow(run, schema)


def slices(values: list, mb: float = 2) -> list[slice]:
    """Stretches of values of at most ~mb MB in all (or one longer value)."""
    out, start, held = [], 0, 0
    for i, x in enumerate(values):
        n = len(x) if x else 0
        if held and held + n > mb * 1e6:
            out.append(slice(start, i))
            start, held = i, 0
        held += n + 1
    return [*out, slice(start, len(values))] if values else out
