"""Candidates of queries from several pools with quotas, ranks, labels and thinned negatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import fill, list_ranks, rank_pool, ranked, rrf, thin_negatives

GEO, NEIGHBORS, EXTRA, FUSED = "geo", "nb", "extra", "RRF"


def search(scores: dict[str, DataFrame], pools: DataFrame, members: DataFrame, query: str, pool: str, item: str, top_k: int, rrf_k: int = 60, depth: int = 200, inside: bool = False) -> DataFrame:
    """(query, retriever, item, rank): the first top_k of each retriever in the query's pool, and of their fusion.

    scores: (query, item, score) by retriever. Pool members that a retriever gives no score rank behind as zeros. inside: as
    for rank_pool.
    """
    lists: DataFrame | None = None
    for name, own in scores.items():
        got = rank_pool(own, pools, members, query, pool, item, depth, inside).select(query, F.lit(name).alias("retriever"), item, "rank")
        lists = got if lists is None else lists.unionByName(got)
    assert lists is not None
    out = lists.filter(F.col("rank") <= top_k)
    if len(scores) > 1:
        fused = ranked(rrf(lists, query, item, rrf_k), [query], "rrf", item).filter(F.col("rank") <= top_k)
        out = out.unionByName(fused.select(query, F.lit(FUSED).alias("retriever"), item, "rank"))
    return out


def quotas(k: int, quota: float, nb_quota: float) -> tuple[int, int, int]:
    """Up to where each pool may fill: geo, with neighbours, in all."""
    k_geo = round(k * (1 - quota - nb_quota))
    return k_geo, k_geo + round(k * nb_quota), k


def generate(found: dict[str, DataFrame], query: str, item: str, k: int = 300, quota: float = 0.2, nb_quota: float = 0.0, gold: DataFrame | Callable[[DataFrame], DataFrame] | None = None, neg_top: int | None = None, neg_random: int = 0, seed: int = 0) -> DataFrame:
    """(query, item, cand_rank from 0, source, rank_<retriever>_<pool>..., label).

    found: search() results by pool (geo, nb, extra). source: 0 geo, 2 neighbours, 1 elsewhere. gold: (query, item) of
    positives, for labels, or what picks them from (query, item) of candidates, so that the other pairs needn't be made;
    with neg_top negatives are thinned.
    Lists are read several times, so they are persisted; spark.catalog.clearCache() frees them.
    """
    found = {p: df.persist() for p, df in found.items() if p != NEIGHBORS or nb_quota > 0}
    caps = quotas(k, quota, nb_quota)
    fused = {p: df.filter(F.col("retriever") == FUSED).select(query, item, "rank") for p, df in found.items()}
    parts = [(fused[GEO], caps[0])] + ([(fused[NEIGHBORS], caps[1])] if nb_quota > 0 else []) + [(fused[EXTRA], caps[2])]
    codes = [0, 2, 1] if nb_quota > 0 else [0, 1]
    placed = fill(parts, query, item)
    code = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(codes) for x in (i, c))), F.col("source"))
    placed = placed.withColumn("source", code)
    lists: DataFrame | None = None
    names: list[str] = []
    for p, df in found.items():
        own = df.withColumn("list", F.concat_ws("_", "retriever", F.lit(p)))
        lists = own if lists is None else lists.unionByName(own)
        names += [f"{r}_{p}" for r in _retrievers(df)]
    assert lists is not None
    out = list_ranks(placed, lists, query, item, names, k)
    if gold is None:
        return out
    if callable(gold):  # k rows a query, read twice
        out = out.persist()
    hit = (gold(out.select(query, item)) if callable(gold) else gold).select(query, item).distinct().withColumn("label", F.lit(1))
    out = out.join(hit, [query, item], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return thin_negatives(out, [query], "label", "cand_rank", item, neg_top, neg_random, seed) if neg_top is not None else out


def _retrievers(df: DataFrame) -> Sequence[str]:
    """The retrievers' names, a handful."""
    return sorted(r[0] for r in df.select("retriever").distinct().collect())


def recall_of_candidates(candidates: DataFrame, n_pos: DataFrame, query: str, first: int = 50) -> DataFrame:
    """(query, recall, recall_first) of candidates with labels; n_pos: (query, n_pos)."""
    found = candidates.groupBy(query).agg(F.sum("label").alias("_all"), F.sum(F.when(F.col("cand_rank") < first, F.col("label")).otherwise(0)).alias("_first"))
    joined = n_pos.join(found, query, "left")
    return joined.select(query, (F.coalesce("_all", F.lit(0)) / F.col("n_pos")).alias("recall"), (F.coalesce("_first", F.lit(0)) / F.col("n_pos")).alias("recall_first"))
