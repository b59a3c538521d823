"""Exact dense retrieval.

Every query meets every vector, so work is quadratic; memory isn't. Queries and corpus are cut into blocks by a hash of their
keys, each pair of blocks is one task's group, and only a query's k best of a block leave it. Single precision finds what
may be among the best, double precision scores it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import dot
from .rank import top_k

#: Rows of a block of queries and of the corpus; rows and columns that are multiplied at once; columns that share a maximum.
BLOCK, CORPUS_BLOCK = 32_768, 131_072
ROWS, COLUMNS, STRIP = 512, 4096, 64


def pair_scores(pairs: DataFrame, queries: DataFrame, query: str, corpus: DataFrame, item: str, vector: str = "embedding") -> DataFrame:
    """Dot products of given (query, item) pairs, by two joins."""
    q, d = queries.select(query, F.col(vector).alias("_q")), corpus.select(item, F.col(vector).alias("_d"))
    return pairs.join(q, query).join(d, item).withColumn("score", dot(F.col("_q"), F.col("_d"))).drop("_q", "_d")


def search(queries: DataFrame, query: str, corpus: DataFrame, item: str, k: int, vector: str = "embedding", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(query, item, score, rank): each query's k best of the corpus, scores rounded so that ties are the same everywhere.

    Ties go to the smaller item. Keys are unique.
    """
    kinds = {f.name: f.dataType for f in [*queries.schema.fields, *corpus.schema.fields]}
    schema = T.StructType([T.StructField(query, kinds[query]), T.StructField(item, kinds[item]), T.StructField("score", T.DoubleType())])
    own, out_schema = queries.select(F.col(query).alias("_key"), F.col(vector).alias("_v")), _arrow(schema)
    n, m, cores = own.count(), corpus.count(), queries.sparkSession.sparkContext.defaultParallelism
    # small tables are cut finer, so that all cores have a block
    across, down = max(-(-m // CORPUS_BLOCK), 1), max(-(-n // BLOCK), min(2 * cores, -(-n // 1024)), 1)

    def blocks(rows: DataFrame, mine: str, count: int, other: str, others: int) -> DataFrame:
        at = F.pmod(F.xxhash64("_key"), F.lit(count)).alias(mine)
        return rows.select("_key", "_v", at, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other))

    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(table.column("_key").to_pylist())
        return keys, np.concatenate([np.asarray(x.flatten(), np.float64) for x in table.column("_v").chunks]).reshape(len(keys), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out_schema.empty_table()
        (ids, q), (items, c) = vectors(left), vectors(right)
        order = np.argsort(items, kind="stable")  # a smaller place is a smaller item
        items, c = items[order], c[order]
        self_at = np.full(len(ids), -1)
        if exclude_self:
            place = np.minimum(np.searchsorted(items, ids), len(items) - 1)
            self_at = np.where(items[place] == ids, place, -1)
        parts = [pa.table([pa.array(ids[row], out_schema.field(0).type), pa.array(items[place], out_schema.field(1).type), pa.array(score)], schema=out_schema) for row, place, score in _nearest(q, c, self_at, k, digits)]
        return pa.concat_tables(parts)

    left = blocks(own, "_a", down, "_b", across)
    right = blocks(corpus.select(F.col(item).alias("_key"), F.col(vector).alias("_v")), "_b", across, "_a", down)
    # an exchange by number: adaptive execution would put small groups into one task
    seats = F.split(F.lit(",".join(map(str, _seats(queries.sparkSession, across * down, tasks := min(across * down, 10_000))))), ",")
    deal = lambda df: df.select("_key", "_v", F.get(seats, (F.col("_a") * across + F.col("_b")).cast("int")).cast("long").alias("_g")).repartition(tasks, "_g")
    found = deal(left).groupBy("_g").cogroup(deal(right).groupBy("_g")).applyInArrow(run, schema)
    return top_k(found, [query], "score", item, k)


def _nearest(q: np.ndarray, c: np.ndarray, self_at: np.ndarray, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, score) of each row's k best of c, some rows at a time. self_at: the place that a row may not have, -1 for none."""
    q32, c32 = q.astype(np.float32), c.astype(np.float32)
    # bounds of what single precision may be off by: inputs, products, sums
    norm = np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    off = (2 * 10.0**-digits + (q.shape[1] + 4) * 1.2e-7 * norm).astype(np.float32)
    room = np.empty(ROWS * COLUMNS, np.float32)  # used again and again: a fresh one costs as much as the product
    for a in range(0, len(q), ROWS):
        rows, mine = slice(a, a + ROWS), np.arange(a, min(a + ROWS, len(q)))
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, place, score
        least = np.full(len(mine), -np.inf, np.float32)
        for b in range(0, len(c), COLUMNS):
            width = len(c32[b : b + COLUMNS])
            near = np.matmul(q32[rows], c32[b : b + COLUMNS].T, out=room[: len(mine) * width].reshape(-1, width))
            hit = np.flatnonzero((self_at[mine] >= b) & (self_at[mine] < b + COLUMNS))
            near[hit, self_at[mine[hit]] - b] = -np.inf
            if near.shape[1] % STRIP:
                near = np.pad(near, ((0, 0), (0, -near.shape[1] % STRIP)), constant_values=-np.inf)
            # most strips hold nothing good enough: only those whose maximum is are looked into
            strips = near.reshape(len(mine), -1, STRIP)
            top = strips.max(axis=2)
            floor = least
            fresh = ~np.isfinite(least)
            if fresh.any():  # the k-th best of these columns, or of their maxima, is a bound, too
                some = top[fresh] if top.shape[1] > k else near[fresh]
                if some.shape[1] > k:
                    floor = least.copy()
                    floor[fresh] = np.partition(some, -k, axis=1)[:, -k] - off[mine][fresh]
            i, strip = np.nonzero(top >= floor[:, None])
            within = strips[i, strip]
            at, place = np.nonzero(within >= floor[i, None])
            i, j = i[at], strip[at] * STRIP + place
            good = near[i, j] > -np.inf
            i, j = i[good], j[good] + b
            for cut in range(0, len(i), 1 << 18):
                x, y = i[cut : cut + (1 << 18)], j[cut : cut + (1 << 18)]
                score = np.round(np.einsum("ij,ij->i", q[a + x], c[y]), digits) + 0.0
                best = [np.append(o, v) for o, v in zip(best, (x, y, score), strict=True)]
                keep = np.lexsort((best[1], -best[2], best[0]))
                row = best[0][keep]
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                nth = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                best = [v[keep[nth < k]] for v in best]
                full = nth[nth < k] == k - 1
                least[best[0][full]] = best[2][full].astype(np.float32) - off[mine][best[0][full]]
        yield a + best[0], best[1], best[2]


def _seats(spark: SparkSession, groups: int, tasks: int) -> list[int]:
    """A number for each group, by which repartition(tasks, number) gives all tasks as many groups, but for one; hashes of a group's own number leave some idle and others with several."""
    of: list[list[int]] = [[] for _ in range(tasks)]
    start = 0
    while min(map(len, of)) < -(-groups // tasks):
        for seat, at in spark.range(start, start + 16 * groups).select("id", F.pmod(F.hash("id"), F.lit(tasks))).toArrow().to_pandas().itertuples(index=False):
            of[at].append(seat)
        start += 16 * groups
    return [of[g % tasks][g // tasks] for g in range(groups)]


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
