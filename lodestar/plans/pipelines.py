"""The whole search pipeline over one folder of tables: preprocess, split, retrieve, evaluate, candidates, features, train, rerank.

Each step reads tables, writes tables and can be run by itself (python -m lodestar <step> --help). Raw tables are
dataset/{benchmark_queries, benchmark_items, train}.parquet under the root.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import category_code, crc_bucket
from ..functions.text import doc_text
from ..operators import answer, candidates, evaluate, features, filters, geo, network, pools, preprocess, rank, rerank, split, stats
from ..operators.retrievers import Retriever, build_retrievers
from ..sources import sinks, tables

DATASETS = ("benchmark_queries", "benchmark_items", "train")
EVENT = ("search_query", "search_location_id", "filter_category", "filter_subcategory", "filter_subject", "filter_online_booking")
ITEM_KEY = ("item_title_raw", "item_description_raw")


@dataclass(frozen=True)
class Search:
    """Knobs of retrieval and candidates."""

    variant: str = pools.GEO
    fill: str | None = pools.FILTERS
    top_k: int = 50
    rrf_k: int = 60
    rrf_depth: int = 200
    region_cover: float = 0.95
    nb_radius: float = 50.0
    k1: float = 1.2
    b: float = 0.75
    stemming: bool = True
    k: int = 500
    k_geo: int = 330
    k_nb: int = 85
    neg_top: int = 50
    neg_random: int = 50
    folds: int = 5
    max_positives: int = 50


def run_preprocess(spark: SparkSession, p: tables.Paths, dry_run: bool = False) -> DataFrame | None:
    """Processed tables of all that is there; with dry_run only (dataset, change, column)."""
    here = [d for d in DATASETS if not preprocess.missing_inputs(spark, [f"{p.dataset}/{d}.parquet"])]
    if not here:
        raise FileNotFoundError(f"none of {DATASETS} in {p.dataset}")
    if dry_run:
        told = [preprocess.describe_changes(tables.scan(spark, p.dataset, d)).select(F.lit(d).alias("dataset"), "change", "column") for d in here]
        out = told[0]
        for x in told[1:]:
            out = out.unionByName(x)
        return out
    for d in here:
        preprocess.process(spark, f"{p.dataset}/{d}.parquet", f"{p.processed}/{d}.parquet")
    return None


def event_id(df: DataFrame) -> DataFrame:
    """df with event_id, a hash of text, location and normalised filters."""
    combo = filters.combo_key(*(F.col(c) for c in EVENT[2:]))
    return df.withColumn("event_id", F.xxhash64("search_query", "search_location_id", F.to_json(combo)))


def run_split(spark: SparkSession, p: tables.Paths, config: split.SplitConfig) -> DataFrame:
    """Writes the split; returns its report."""
    rows = event_id(tables.scan(spark, p.processed, "train", [*EVENT, "item_id"]))
    pairs = rows.groupBy("event_id", "item_id").agg(*(F.first(c).alias(c) for c in EVENT), F.count("*").alias("n_repeats")) if config.dedup else rows.withColumn("n_repeats", F.lit(1))
    parts = split.split_by_text(pairs, config).persist()
    val = parts.filter("part = 'val'")
    catalog = split.sample_catalog(parts, val, config).persist()
    chosen = split.select_eval(val, catalog, config)
    sinks.write_split(parts, chosen, catalog, config.to_json(), p.split)
    return split.report(parts)


def item_documents(items: DataFrame) -> DataFrame:
    return items.select("item_id", doc_text(F.col("item_title_raw"), F.col("item_description_raw")).alias("doc"))


def catalog_items(spark: SparkSession, p: tables.Paths) -> DataFrame:
    """Items of train that are in the split's catalogue, one row each."""
    train = tables.scan(spark, p.processed, "train")
    own = train.select(*(c for c in train.columns if c.startswith("item_")))
    return tables.catalog(own, tables.scan(spark, p.split, "catalog"), "item_id", [*ITEM_KEY, "item_location_id"])


def benchmark_items(spark: SparkSession, p: tables.Paths) -> DataFrame:
    return tables.first_by(tables.scan(spark, p.processed, "benchmark_items"), "item_id", [*ITEM_KEY, "item_location_id"])


def build_queries(df: DataFrame, key: str) -> DataFrame:
    """(qid, query, location, filter): one row per key."""
    combo = filters.combo_key(*(F.col(c) for c in EVENT[2:]))
    first = F.min(F.struct(F.col("search_query").alias("query"), F.col("search_location_id").alias("location"), combo.alias("filter")))
    return df.groupBy(F.col(key).alias("qid")).agg(first.alias("x")).select("qid", "x.*")


def bridges(spark: SparkSession, p: tables.Paths, items: DataFrame, s: Search, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Regions (region, loc) and neighbours (loc, nb) for a corpus; regions are learnt from pairs (default: all of train)."""
    train = tables.scan(spark, p.processed, "train")
    pairs = train.select("search_location_id", "item_location_id") if pairs is None else pairs
    known = items.select(F.col("item_location_id").alias("loc")).union(pairs.select("item_location_id")).distinct()
    at = [x.select(F.col("item_location_id").alias("loc"), F.col("item_latitude").alias("lat"), F.col("item_longitude").alias("lon")) for x in (train, items)]
    return geo.region_cover(pairs, known, s.region_cover).select("region", "loc"), geo.neighbours(geo.centroids(at[0].unionByName(at[1])), s.nb_radius)


def pool_of(kind: str, queries: DataFrame, items: DataFrame, regions: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pools (qid, pool) and members (pool, item_id) of a variant."""
    if kind == pools.ALL:
        return queries.select("qid", F.lit("all").alias("pool")), items.select(F.lit("all").alias("pool"), "item_id")
    if kind == pools.FILTERS:
        keyed = queries.withColumn("pool", F.to_json("filter"))
        keys = keyed.select("pool", "filter").dropDuplicates(["pool"])
        return keyed.select("qid", "pool"), pools.members_by_filters(keys, items)
    places = items.select(F.col("item_location_id").alias("loc"))
    mode = "neighbors" if kind == pools.NEIGHBORS else "city"
    own = geo.query_locations(queries, "qid", "location", places, regions, near, mode)
    by_place, in_place = pools.members_by_places(own, items)
    if kind in (pools.GEO, pools.NEIGHBORS):
        return by_place, in_place
    if kind != pools.BOTH:
        raise ValueError(f"unknown variant: {kind}")
    by_filter, in_filter = pool_of(pools.FILTERS, queries, items, regions, near)
    both = by_place.withColumnRenamed("pool", "g").join(by_filter.withColumnRenamed("pool", "f"), "qid").withColumn("pool", F.concat_ws("/", "g", "f"))
    pairs = both.select("g", "f", "pool").distinct()
    inside = pairs.join(in_place.withColumnRenamed("pool", "g"), "g").join(in_filter.withColumnRenamed("pool", "f"), ["f", "item_id"])
    return both.select("qid", "pool"), inside.select("pool", "item_id")


def search(queries: DataFrame, items: DataFrame, retrievers: list[Retriever], kind: str, regions: DataFrame, near: DataFrame, top_k: int, s: Search, keep: sinks.Stage, depth: int | None = None) -> DataFrame:
    """(qid, retriever, item_id, rank) within one variant's pools."""
    by, inside = map(keep, pool_of(kind, queries, items, regions, near))
    scores = {r.name: keep(r.scores(queries, by, inside)) for r in retrievers}
    return keep(candidates.search(scores, by, inside, "qid", "pool", "item_id", top_k, s.rrf_k, depth or s.rrf_depth))


def final_name(retrievers: list[Retriever]) -> str:
    return candidates.FUSED if len(retrievers) > 1 else retrievers[0].name


def save_results(spark: SparkSession, p: tables.Paths, name: str, result: DataFrame, queries: DataFrame, items: DataFrame, config: dict, top_k: int) -> DataFrame:
    """Writes answer, predictions and config if the answer keeps all rules; returns its summary."""
    made = answer.make_answer(queries.select("query_id"), result.select(F.col("qid").alias("query_id"), "item_id", "rank")).persist()
    broken = answer.check_answer(made, queries, items, top_k).collect()
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['n']}" for r in broken))
    sinks.write_csv(made, f"{p.results}/{name}/answer.csv")
    sinks.write_table(result, f"{p.results}/{name}/predictions.parquet")
    sinks.write_json_config(spark, config, f"{p.results}/{name}/config.json")
    return answer.fill_summary(made, top_k)


def run_retrieve(spark: SparkSession, p: tables.Paths, s: Search, vectors: dict | None = None, name: str = "first_stage") -> DataFrame:
    """First-stage answer of the benchmark; returns its fill summary."""
    with sinks.Stage(spark, p.root) as keep:
        return spark.createDataFrame(_retrieve(spark, p, s, vectors, name, keep).toPandas())


def _retrieve(spark: SparkSession, p: tables.Paths, s: Search, vectors: dict | None, name: str, keep: sinks.Stage) -> DataFrame:
    items = keep(benchmark_items(spark, p))
    raw = tables.scan(spark, p.processed, "benchmark_queries")
    queries = keep(build_queries(raw, "query_id"))
    regions, near = map(keep, bridges(spark, p, items, s))
    found = build_retrievers(item_documents(items), vectors, s.k1, s.b, s.stemming, keep)
    own = final_name(found)
    pick = lambda kind: search(queries, items, found, kind, regions, near, s.top_k, s, keep).filter(F.col("retriever") == own).select("qid", "item_id", "rank")
    parts = [(pick(s.variant), s.top_k)] + ([(pick(s.fill), s.top_k)] if s.fill else [])
    result = keep(rank.fill(parts, "qid", "item_id").withColumn("rank", F.col("cand_rank") + 1))
    return save_results(spark, p, name, result, raw, items, s.__dict__ | {"retrievers": [r.name for r in found]}, s.top_k)


def gold_events(spark: SparkSession, p: tables.Paths) -> tuple[DataFrame, DataFrame]:
    """Queries and positives (qid, item_id) of the split's evaluation set."""
    val = tables.scan(spark, p.split, "val_eval")
    return build_queries(val, "event_id"), val.select(F.col("event_id").alias("qid"), "item_id").distinct()


def run_evaluate(spark: SparkSession, p: tables.Paths, s: Search, vectors: dict | None = None, name: str = "evaluation") -> DataFrame:
    """Recall of each retriever and variant on validation events; writes per-event rows, returns (retriever, variant, recall, hit_rate)."""
    with sinks.Stage(spark, p.root) as keep:
        _evaluate(spark, p, s, vectors, name, keep)
    per_event = tables.scan(spark, f"{p.results}/{name}", "per_event")
    table = per_event.groupBy("retriever", "variant").agg(F.avg("recall").alias("recall"), F.avg((F.col("recall") > 0).cast("double")).alias("hit_rate"))
    sinks.write_csv(table, f"{p.results}/{name}/recall.csv", 6)
    return table


def _evaluate(spark: SparkSession, p: tables.Paths, s: Search, vectors: dict | None, name: str, keep: sinks.Stage) -> None:
    items = keep(catalog_items(spark, p))
    queries, gold = map(keep, gold_events(spark, p))
    train = tables.scan(spark, p.split, "train_pairs")
    places = tables.first_by(tables.scan(spark, p.processed, "train", ["item_id", "item_location_id"]), "item_id", ["item_location_id"])
    regions, near = map(keep, bridges(spark, p, items, s, tables.geo_pairs(train, places)))
    found = build_retrievers(item_documents(items), vectors, s.k1, s.b, s.stemming, keep)
    tops = {v: search(queries, items, found, v, regions, near, s.top_k, s, keep) for v in pools.VARIANTS}
    every = None
    for v, df in tops.items():
        own = df.withColumn("variant", F.lit(v))
        every = own if every is None else every.unionByName(own)
    for r in [x.name for x in found] + ([candidates.FUSED] if len(found) > 1 else []):
        main, extra = (tops[v].filter(F.col("retriever") == r).select("qid", "item_id", "rank") for v in (pools.GEO, pools.FILTERS))
        filled = rank.fill([(main, s.top_k), (extra, s.top_k)], "qid", "item_id")
        every = every.unionByName(filled.select("qid", F.lit(r).alias("retriever"), "item_id", (F.col("cand_rank") + 1).cast("int").alias("rank"), F.lit(pools.FILLED).alias("variant")))
    sinks.write_table(evaluate.recall(evaluate.hits(keep(every), gold, "qid", "item_id", s.top_k)), f"{p.results}/{name}/per_event.parquet")


def run_candidates(spark: SparkSession, p: tables.Paths, s: Search, part: str, vectors: dict | None = None) -> None:
    """Candidates and events of a part: train, val or benchmark. Labels and thinning where positives are known; train's regions per fold come from other folds."""
    with sinks.Stage(spark, p.root) as keep:
        _candidates(spark, p, s, part, vectors, keep)


def _candidates(spark: SparkSession, p: tables.Paths, s: Search, part: str, vectors: dict | None, keep: sinks.Stage) -> None:
    quota, nb_quota = 1 - (s.k_geo + s.k_nb) / s.k, s.k_nb / s.k
    items = keep((benchmark_items if part == "benchmark" else catalog_items)(spark, p))
    found = build_retrievers(item_documents(items), vectors, s.k1, s.b, s.stemming, keep)
    gold = None
    if part == "benchmark":
        queries = build_queries(tables.scan(spark, p.processed, "benchmark_queries"), "query_id")
        regions, near = bridges(spark, p, items, s)
    else:
        train = tables.scan(spark, p.split, "train_pairs")
        places = tables.first_by(tables.scan(spark, p.processed, "train", ["item_id", "item_location_id"]), "item_id", ["item_location_id"])
        pairs = train.drop("item_location_id").join(places, "item_id", "left")
        regions, near = bridges(spark, p, items, s, pairs.select("search_location_id", "item_location_id"))
        if part == "val":
            queries, gold = gold_events(spark, p)
        else:
            few = filters.at_most(train.join(items.select("item_id"), "item_id", "left_semi"), "event_id", s.max_positives)
            queries, gold = build_queries(few, "event_id"), few.select(F.col("event_id").alias("qid"), "item_id").distinct()
            known = items.select(F.col("item_location_id").alias("loc")).union(pairs.select("item_location_id")).distinct()
            by_fold = geo.region_cover_by_fold(pairs.withColumn("fold", crc_bucket(F.col("search_query"), s.folds)), known, s.region_cover, "fold", s.folds)
            # a region of a fold gets a name of its own, and so do that fold's queries
            name = lambda loc, fold: F.concat_ws("@", F.col(loc).cast("string"), fold.cast("string"))
            cities = known.withColumnRenamed("loc", "location")
            regions = by_fold.select(name("region", F.col("fold")).alias("region"), F.col("loc").cast("string").alias("loc"))
            text_places = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
            is_city = queries.join(cities.withColumn("_c", F.lit(True)), "location", "left")
            queries = is_city.withColumn("location", F.when(F.col("_c"), F.col("location").cast("string")).otherwise(name("location", crc_bucket(F.col("query"), s.folds)))).drop("_c")
            items = text_places(items, "item_location_id")
            near = text_places(text_places(near, "loc"), "nb")
    queries, regions, near = map(keep, (queries, regions, near))
    gold = None if gold is None else keep(gold)
    kinds = {candidates.GEO: pools.GEO, candidates.NEIGHBORS: pools.NEIGHBORS, candidates.EXTRA: pools.FILTERS}
    lists = {name: search(queries, items, found, kind, regions, near, s.k, s, keep, max(s.rrf_depth, s.k)) for name, kind in kinds.items()}
    if len(found) == 1:  # one list is its own fusion
        lists = {n: df.unionByName(df.withColumn("retriever", F.lit(candidates.FUSED))) for n, df in lists.items()}
    thin = {"neg_top": s.neg_top, "neg_random": s.neg_random} if part == "train" else {}
    made = candidates.generate(lists, "qid", "item_id", s.k, quota, nb_quota, gold, **thin)
    sinks.write_table(made, f"{p.rerank}/{part}_candidates.parquet")
    events = queries.select("qid", "query", F.col("location").cast("string").alias("location"), "filter")
    if gold is not None:
        events = events.join(gold.groupBy("qid").agg(F.array_sort(F.collect_set("item_id")).alias("positives"), F.countDistinct("item_id").alias("n_pos")), "qid")
    events = events.withColumns({"fold": crc_bucket(F.col("query"), s.folds), "val_part": F.when(crc_bucket(F.col("query"), 2) == 0, "tune").otherwise("test")})
    sinks.write_table(events, f"{p.rerank}/{part}_events.parquet")


def run_features(spark: SparkSession, p: tables.Paths, s: Search, part: str, vectors: dict | None = None) -> None:
    """The feature table of a part's candidates: scores, gaps, ranks, places, item, filters, query and statistics, the latter without the event itself in train."""
    with sinks.Stage(spark, p.root) as keep:
        _features(spark, p, s, part, vectors, keep)


def _features(spark: SparkSession, p: tables.Paths, s: Search, part: str, vectors: dict | None, keep: sinks.Stage) -> None:
    items = keep((benchmark_items if part == "benchmark" else catalog_items)(spark, p))
    cand, events = tables.scan(spark, p.rerank, f"{part}_candidates"), tables.scan(spark, p.rerank, f"{part}_events")
    asked = keep(events.withColumn("location", F.split("location", "@")[0].cast("long")))
    rows = cand
    names = []
    for r in build_retrievers(item_documents(items), vectors, s.k1, s.b, s.stemming, keep):
        rows = rows.join(r.pair_scores(cand.select("qid", "item_id"), asked).withColumnRenamed("score", f"sc_{r.name}"), ["qid", "item_id"], "left")
        names.append(f"sc_{r.name}")
    rows = keep(features.score_gaps(rows, names))
    rows = rows.withColumnsRenamed({c: f"sc_{c}" for c in rows.columns if c.startswith("rank_")}).withColumnRenamed("cand_rank", "sc_cand_rank")
    rows = rows.withColumns({"sc_source_quota": (F.col("source") == 1).cast("int"), "sc_source_nb": (F.col("source") == 2).cast("int")}).drop("source")
    wide = items.withColumns({"title_len": F.length(F.coalesce("item_title_raw", F.lit(""))), "desc_len": F.length(F.coalesce("item_description_raw", F.lit("")))})
    rows = rows.join(features.item_features(wide), "item_id").join(asked.select("qid", F.col("query").alias("search_query"), F.col("location").alias("search_location_id"), "filter", "fold", "val_part"), "qid")
    f = F.col("filter")
    rows = rows.withColumns(filters.filter_features(f["category"], f["subcategories"], f["subjects"], f["booking"], F.col("item_category"), F.col("item_subcategory"), F.col("item_subjects"), F.col("item_online_booking")))
    regions, near = map(keep, bridges(spark, p, items, s))
    train = tables.scan(spark, p.processed, "train")
    centres = geo.centroids(train.select(F.col("item_location_id").alias("loc"), F.col("item_latitude").alias("lat"), F.col("item_longitude").alias("lon")).unionByName(items.select(F.col("item_location_id").alias("loc"), F.col("item_latitude").alias("lat"), F.col("item_longitude").alias("lon"))))
    rows = features.geo_features(keep(rows), "search_location_id", "item_location_id", near, centres, "item_latitude", "item_longitude")
    in_regions = regions.select(F.col("region").alias("search_location_id"), F.lit(1).alias("is_region")).distinct()
    rows = rows.join(in_regions, "search_location_id", "left").withColumn("is_region", F.coalesce("is_region", F.lit(0)))
    rows = rows.withColumns(features.query_features(F.col("search_query")))
    attrs = tables.first_by(train.select("item_id", "item_microcat_id", "item_location_id"), "item_id", ["item_microcat_id", "item_location_id"])
    source = tables.scan(spark, p.split, "train_pairs")
    if part == "benchmark":
        source = source.unionByName(tables.scan(spark, p.split, "val_pairs"), allowMissingColumns=True)
    pairs = source.select("event_id", "search_query", "search_location_id", "item_id").join(attrs, "item_id", "left")
    key = rows.withColumnRenamed("qid", "event_id") if part == "train" else rows.withColumn("event_id", F.lit(0).cast("long"))
    rows = stats.train_stats(keep(key), keep(pairs), part == "train")
    rows = rows.withColumnRenamed("event_id", "qid") if part == "train" else rows.drop("event_id")
    rows = rows.withColumns({"cat_query_category": category_code(F.col("filter")["category"]), "cat_item_loc": F.col("item_location_id"), "cat_query_loc": F.col("search_location_id")})
    keep = [c for c in rows.columns if c in ("qid", "item_id", "label", "fold", "val_part", "is_region") or c.startswith(("sc_", "geo_", "it_", "flt_", "q_", "st_", "cat_"))]
    sinks.write_table(rows.select(*keep), f"{p.rerank}/{part}_features.parquet")


DROPPED = ("st_text_item", "st_item_pop_log", "item_id")


#: The feature table's column for each of the network's embeddings.
CODES = {"microcat": "it_microcat", "category": "it_category", "query_category": "cat_query_category", "item_loc": "cat_item_loc", "query_loc": "cat_query_loc"}
#: Kinds of reranker and the rounds (for the network: epochs) that each takes by default.
KINDS = {"listwise": 60, "boosted": 20, "mlp": 15}


def run_train(spark: SparkSession, p: tables.Paths, name: str = "listwise", drop: tuple[str, ...] = DROPPED, rounds: int | None = None, top_k: int = 50, kind: str = "listwise", baseline: str | None = None) -> DataFrame:
    """Fits a reranker of the kind to train's features and reports recall on validation, beside that of an earlier model (baseline) if named; returns the report."""
    rounds, at = rounds or KINDS[kind], f"{p.root}/models/{name}"
    df = rank.groups_with_positive(tables.scan(spark, p.rerank, "train_features"), ["qid"]).persist()
    prep = rerank.Preprocessor(features.feature_columns(df, drop)).fit(df)
    columns = prep.transform()
    names = list(columns)
    made = df.select("qid", "label", *set(CODES.values()), *(v.alias(k) for k, v in columns.items())).persist()
    model = {"kind": kind, "preprocessor": json.loads(prep.to_json()), "features": names}
    events = tables.scan(spark, p.rerank, "val_events").select("qid", "n_pos", "val_part")
    if kind == "listwise":
        model["weights"] = [float(w) for w in rerank.fit_listwise(made, names, rounds=rounds)]
    elif kind == "boosted":
        model["boosted"] = json.loads(rerank.fit_boosted(made, names, rounds=rounds).to_json())
    else:
        sizes = {}
        for key, column in CODES.items():
            sinks.write_table(rerank.vocabulary(df, column), f"{at}/vocab_{key}.parquet")
            sizes[key] = tables.scan(spark, at, f"vocab_{key}").count() + 1
        tune = events.filter("val_part = 'tune'").select("qid", "n_pos")

        def recall(net: rerank.RerankMLP) -> float:
            own = scored(spark, p, "val", {**model, "weights": net.weights}, name)
            return rerank.top_k_recall(own, "score", tune, top_k, item="item_id").agg(F.avg("recall")).first()[0] or 0.0

        net, _ = network.fit_mlp(_coded(spark, made, at), rerank.RerankMLP.random(len(names), sizes), names, {k: f"code_{k}" for k in CODES}, epochs=rounds, measure=recall)
        model["weights"] = {k: v.tolist() for k, v in net.weights.items()}
    sinks.write_json_config(spark, model, f"{at}/model.json")
    val = scored(spark, p, "val", model, name)
    region = val.groupBy("qid").agg(F.max("is_region").alias("is_region"))
    per_event = events.join(region, "qid", "left").withColumn("is_region", F.coalesce("is_region", F.lit(0)))
    measured = [("model", val, "score", top_k), ("first_stage", val, "first", top_k), ("ceiling", val, "score", 10**6)]
    if baseline:
        measured.append(("baseline", scored(spark, p, "val", read_model(spark, p, baseline), baseline), "score", top_k))
    for measure, rows, column, k in measured:
        per_event = per_event.join(rerank.top_k_recall(rows, column, events.select("qid", "n_pos"), k, item="item_id").withColumnRenamed("recall", measure), "qid")
    table = rerank.report(per_event, "val_part", "is_region", [m[0] for m in measured], "baseline" if baseline else "first_stage")
    sinks.write_csv(table, f"{at}/recall.csv", 6)
    return table


def read_model(spark: SparkSession, p: tables.Paths, name: str) -> dict:
    return tables.read_json_config(spark, f"{p.root}/models/{name}/model.json")


def _coded(spark: SparkSession, df: DataFrame, at: str) -> DataFrame:
    """df with code_<key>, the number of each category in the vocabularies under `at`."""
    for key, column in CODES.items():
        df = rerank.encode(df, column, tables.scan(spark, at, f"vocab_{key}"), f"code_{key}")
    return df


def scored(spark: SparkSession, p: tables.Paths, part: str, model: dict, name: str) -> DataFrame:
    """A part's features with the score of a model, whatever its kind; name: whose vocabularies it reads."""
    df = tables.scan(spark, p.rerank, f"{part}_features").withColumn("first", -F.col("sc_cand_rank"))
    made, names = rerank.Preprocessor.from_json(json.dumps(model["preprocessor"])).transform(), model["features"]
    if model["kind"] == "listwise":
        total = sum((made[n] * float(w) for n, w in zip(names, model["weights"], strict=True)), F.lit(0.0))
        return df.withColumn("score", F.round(total, 9))
    wide = df.withColumns(made)
    if model["kind"] == "boosted":
        return wide.withColumn("score", F.round(rerank.Boosted.from_json(json.dumps(model["boosted"])).score(), 9)).drop(*made)
    wide = _coded(spark, wide, f"{p.root}/models/{name}")
    codes = {k: f"code_{k}" for k in CODES}
    return rerank.predict(wide, rerank.RerankMLP(model["weights"]), names, codes).drop(*made, *codes.values())


def run_rerank(spark: SparkSession, p: tables.Paths, models: list[str], top_k: int = 50, name: str = "reranked", compare: str | None = None) -> DataFrame:
    """The final answer of the benchmark, from one model or the sum of several models' fractional ranks; returns its summary (or overlap with an earlier answer)."""
    rows: DataFrame | None = None
    for i, m in enumerate(models):
        own = scored(spark, p, "benchmark", read_model(spark, p, m), m).select("qid", "item_id", F.col("score").alias(f"s{i}"))
        rows = own if rows is None else rows.join(own, ["qid", "item_id"])
    assert rows is not None
    rows = rerank.ensemble(rows, [f"s{i}" for i in range(len(models))]) if len(models) > 1 else rows.withColumn("score", F.col("s0"))
    result = rank.top_k(rows, ["qid"], "score", "item_id", top_k)
    raw, items = tables.scan(spark, p.processed, "benchmark_queries"), benchmark_items(spark, p)
    summary = save_results(spark, p, name, result.select("qid", "item_id", "rank"), raw, items, {"models": models}, top_k)
    if compare is None:
        return summary
    new = tables.read_answer(spark, f"{p.results}/{name}/answer.csv")
    return answer.compare_answers(new, tables.read_answer(spark, compare)).agg(F.avg("overlap").alias("overlap"))
