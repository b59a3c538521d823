"""The retriever protocol: a name, scores within pools, scores of pairs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bm25, dense


class Retriever(Protocol):
    name: str

    def scores(self, queries: DataFrame, pools: DataFrame, members: DataFrame) -> DataFrame:
        """(qid, item_id, score); what it leaves out scores 0. queries: qid, query; pools: qid, pool; members: pool, item_id."""

    def pair_scores(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(qid, item_id, score) of given pairs."""


class BM25:
    """docs: item_id, doc. keep: what makes a table of the index that is read again and again."""

    name = "BM25"

    def __init__(self, docs: DataFrame, k1: float = 1.2, b: float = 0.75, stemming: bool = True, digits: int = 6, keep: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.stemming, self.digits = stemming, digits
        self.index = keep(bm25.postings(docs, "item_id", F.col("doc"), k1, b, stemming))

    def scores(self, queries: DataFrame, pools: DataFrame, members: DataFrame) -> DataFrame:
        found = bm25.scores(queries, "qid", F.col("query"), self.index, "item_id", self.stemming)
        return found.withColumn("score", F.round("score", self.digits))

    def pair_scores(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        return bm25.pair_scores(pairs.select("qid", "item_id"), queries, "qid", F.col("query"), self.index, "item_id", self.stemming)


class Dense:
    """Vectors of items (item_id, vector) and of query texts (query, vector), of length one."""

    def __init__(self, name: str, items: DataFrame, queries: DataFrame, digits: int = 6):
        self.name, self.items, self.queries, self.digits = name, items, queries, digits

    def scores(self, queries: DataFrame, pools: DataFrame, members: DataFrame) -> DataFrame:
        return self.pair_scores(pools.join(members, "pool").select("qid", "item_id"), queries)

    def pair_scores(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        asked = queries.select("qid", "query").join(self.queries, "query").select("qid", "vector")
        found = dense.pair_scores(pairs.select("qid", "item_id"), asked, "qid", self.items, "item_id", "vector")
        return found.withColumn("score", F.round("score", self.digits))


def build_retrievers(docs: DataFrame, vectors: dict[str, tuple[DataFrame, DataFrame]] | None = None, k1: float = 1.2, b: float = 0.75, stemming: bool = True, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[Retriever]:
    return [BM25(docs, k1, b, stemming, keep=keep), *(Dense(n, i, q) for n, (i, q) in (vectors or {}).items())]
