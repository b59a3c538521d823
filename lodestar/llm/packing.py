"""Conflict-constrained best-fit packing of documents into sequences of fixed capacity.

A document's size is its UTF-8 bytes plus one separator. Longer documents are cut into pieces of the full capacity
and a rest; nothing is dropped. A bin may not hold two pieces of one source, nor of one duplicate cluster: each bin
carries a bitmap of its sources and one of its clusters. Pieces are placed by falling size; bins are kept ordered
by what room they have left, and the search starts at the tightest bin that is large enough and goes on to its
successors until one shares neither source nor cluster with the piece. If there is none, a bin is opened.

The table is dealt by a hash of row identity into groups of about GROUP_ROWS pieces, each packed by one task: groups
are as large at 100 TB as in a test, whatever source or cluster is frequent, and the constraint, which concerns
single bins, holds everywhere. A group wastes at most what its last, half-filled bins leave.

A null text counts as empty (size 1). A null source or cluster conflicts with nothing. Rows that repeat an id are
packed each; ties go by id, piece, source and cluster; texts of any length are cut; an empty table gives no rows. Further columns are not carried.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY = 8192
GROUP_ROWS = 4096
SCHEMA = "piece int, size bigint, bin bigint, offset bigint, bin_used bigint"


def pack(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece, which must come by falling size. Bins are numbered in the order of their opening."""
    bit_of_source = {s: 1 << i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    # a cluster of one piece can't conflict and needs no bit
    bit_of_cluster = {c: 1 << i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    room: list[tuple[int, int]] = []  # (what is left, bin) in order
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = bit_of_source.get(source, 0), bit_of_cluster.get(cluster, 0)
        at = bisect_left(room, (size, -1))
        while at < len(room) and (has_source[room[at][1]] & s or has_cluster[room[at][1]] & c):
            at += 1
        if at < len(room):
            left, b = room.pop(at)
            has_source[b] |= s
            has_cluster[b] |= c
        else:
            left, b = capacity, len(has_source)
            has_source.append(s)
            has_cluster.append(c)
        if left > size:
            insort(room, (left - size, b))
        out.append(b)
    return out


def pack_group(rows: pa.Table, names: list[str], capacity: int) -> pa.Table:
    """One group: its rows with bin, offset in the bin, and what the bin holds in all. Arrow keeps 64-bit keys beside nulls exact."""
    rows = rows.sort_by([("size", "descending"), *((c, "ascending") for c in (names[0], "piece", "source", "cluster"))])
    size = rows.column("size").to_numpy()
    local = np.array(pack(size.tolist(), rows.column("source").to_pylist(), rows.column("cluster").to_pylist(), capacity), np.int64)
    order = np.argsort(local, kind="stable")
    ends = np.cumsum(size[order])
    first = np.searchsorted(local[order], np.arange(local.max() + 1))
    before = np.append(0, ends)[first]  # of all earlier bins
    offset = np.empty(len(size), np.int64)
    offset[order] = ends - size[order] - before[local[order]]
    used = np.bincount(local, size).astype(np.int64)[local]
    group = rows.column("_group")[0].as_py()
    out = rows.append_column("bin", pa.array(group * (1 << 24) + local)).append_column("offset", pa.array(offset)).append_column("bin_used", pa.array(used))
    return out.select(names)


def best_fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source: str | Column | None = "source", cluster: str | Column | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """id_col, source, cluster, piece, size, bin, offset, bin_used: one row per piece. cluster is by default a hash of the text, so that copies conflict."""
    as_col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    cluster = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if cluster is None else as_col(cluster)
    whole = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    rows = df.select(F.col(id_col), as_col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"), whole.alias("_whole"), F.xxhash64(id_col, whole).alias("_row"))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_whole") - 1) / capacity).cast("int"))).alias("piece"))
    groups = pieces.count() // group_rows + 1
    size = F.least(F.lit(capacity), F.col("_whole") - F.col("piece").cast("long") * capacity)
    grouped = pieces.select(id_col, "source", "cluster", "piece", size.cast("long").alias("size"), F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)).alias("_group"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, source string, cluster bigint, {SCHEMA}"
    names = [id_col, "source", "cluster", *(x.split()[0] for x in SCHEMA.split(", "))]
    return grouped.groupBy("_group").applyInArrow(lambda rows: pack_group(rows, names, capacity), schema)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
