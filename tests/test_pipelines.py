"""The command line from raw tables to a checked answer, on a small made-up marketplace."""

import random
from decimal import Decimal

import pytest

from lodestar import __main__ as cli
from lodestar.operators import pools
from lodestar.plans import pipelines
from lodestar.sources import tables

TOPICS = {"стрижка": ("Красота", "Стрижка"), "массаж": ("Красота", "Массаж"), "ремонт": ("Стройка", "Ремонт"), "доставка": ("Перевозки", "Груз")}
CITIES = {1: (55.7, 37.6), 2: (55.9, 37.7), 3: (59.9, 30.3), 4: (56.8, 60.6)}
REGION = 900
ITEM = """item_id string, item_title_raw string, item_description_raw string, item_infm_params_text string, item_price decimal(18,2), item_latitude decimal(10,6), item_longitude decimal(10,6),
 item_location_id long, item_category_id int, item_microcat_id int, item_rating double, item_rating_reviews_count long, item_is_phone_hidden boolean, item_is_message_forbidden boolean"""
QUERY = "search_query string, search_location_id long, search_category int, search_is_delivery_search int, search_infm_params_text string"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    r = random.Random(0)
    items = []
    for i in range(120):
        topic, (cat, sub) = list(TOPICS.items())[i % 4]
        loc = r.choice(list(CITIES))
        lat, lon = CITIES[loc]
        params = f"Вид услуги {cat} Тип услуги {sub}" + (" Онлайн-запись" if i % 3 == 0 else "")
        items.append((f"{i:016x}", f"{topic.title()} {r.choice(['срочно', 'дешево', 'дома'])}", f"{topic} номер {i} звоните 8 912 345-67-89", params, Decimal(r.choice([-1, 100, 5000])), Decimal(str(lat)), Decimal(str(lon)), loc, r.choice([114, 114, 40]), i % 5, r.choice([None, 4.5]), r.choice([None, 7]), i % 2 == 0, False))

    def asks(n):
        out = []
        for _ in range(n):
            topic, (cat, _) = r.choice(list(TOPICS.items()))
            text = " ".join(filter(None, [topic, r.choice(["срочно", "дешево", "дома", "", "рядом", "недорого"])]))
            out.append((text, r.choice([*CITIES, REGION]), 114, 0, r.choice(["", f"Вид услуги {cat}", "Онлайн-запись"])))
        return out

    train = []
    for q in asks(260):
        fits = [x for x in items if q[0].split()[0] in x[2] and (q[1] == REGION or x[7] == q[1]) and (q[4] != "Онлайн-запись" or "Онлайн" in x[3])]
        train += [(*q, *x) for x in r.sample(fits, min(2, len(fits)))]
    at = tmp_path_factory.mktemp("market")
    spark.createDataFrame(items + items[:3], ITEM).write.parquet(f"{at}/dataset/benchmark_items.parquet")
    spark.createDataFrame([(f"q{n:015d}", *q) for n, q in enumerate(asks(12))], f"query_id string, {QUERY}").write.parquet(f"{at}/dataset/benchmark_queries.parquet")
    spark.createDataFrame(train, f"{QUERY}, {ITEM}").write.parquet(f"{at}/dataset/train.parquet")
    return str(at)


def run(spark, *argv):
    cli.main([str(a) for a in argv], spark)


def test_from_raw_tables_to_answer(spark, root, tmp_path):
    run(spark, "preprocess", root, "--dry-run")
    run(spark, "preprocess", root)
    run(spark, "make_split", root, "--catalog-size", 100, "--val-text-fraction", 0.25)
    p = tables.Paths(root)
    train, val = (tables.scan(spark, p.split, x) for x in ("train_pairs", "val_pairs"))
    assert train.count() and val.count() and not train.join(val.select("event_id"), "event_id", "left_semi").count()

    few = ["--no-stemming", "--top-k", 5]
    run(spark, "retrieve_benchmark", root, *few)
    first = tables.read_answer(spark, f"{p.results}/first_stage/answer.csv")
    assert first.count() == 12 and all(len(r["answer"].split()) == 5 for r in first.collect())

    run(spark, "evaluate_retrievers", root, *few)
    per_event = tables.scan(spark, f"{p.results}/evaluation", "per_event")
    mean = {r["variant"]: r["avg(recall)"] for r in per_event.groupBy("variant").avg("recall").collect()}
    assert set(mean) == {*pools.VARIANTS, pools.FILLED} and mean[pools.FILLED] >= mean[pools.GEO] and mean[pools.GEO] > mean[pools.ALL]

    size = ["--k", 20, "--k-geo", 12, "--k-nb", 4, "--neg-top", 5, "--neg-random", 3, "--no-stemming", "--rrf-depth", 20]
    run(spark, "build_candidates", root, *size)
    cand = tables.scan(spark, p.rerank, "val_candidates")
    assert {r["n"] for r in cand.groupBy("qid").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} <= set(range(1, 21))
    assert cand.filter("label = 1").count() > 0 and cand.filter("source = 2").count() > 0
    run(spark, "build_features", root, *size)
    wide = tables.scan(spark, p.rerank, "val_features")
    for c in ("sc_BM25", "sc_BM25_gap", "sc_rank_BM25_geo", "sc_source_nb", "geo_same_loc", "geo_is_neighbor", "geo_dist_km", "it_price_log", "flt_category", "flt_n_filters", "q_words", "st_text_mc_share", "is_region"):
        assert c in wide.columns
    assert wide.filter("sc_BM25_gap > 0").count() == 0 and wide.filter("is_region = 1 and geo_dist_km is not null").count() == 0
    run(spark, "train_reranker", root, "--rounds", 5)
    run(spark, "train_reranker", root, "--name", "trees", "--kind", "boosted", "--rounds", 1)
    run(spark, "train_reranker", root, "--name", "net", "--kind", "mlp", "--rounds", 2, "--baseline", "listwise")
    report = {r["area"]: r for r in spark.read.csv(f"{p.root}/models/net/recall.csv", header=True).filter("val_part = 'test'").collect()}
    assert 0 <= float(report["all"]["model"]) <= float(report["all"]["ceiling"]) and "baseline" in report["all"]
    run(spark, "rerank_benchmark", root, "--top-k", 5, "--models", "listwise", "trees", "net", "--name", "together")
    assert tables.read_answer(spark, f"{p.results}/together/answer.csv").count() == 12
    run(spark, "rerank_benchmark", root, "--top-k", 5, "--compare", f"{p.results}/first_stage/answer.csv")
    assert tables.read_answer(spark, f"{p.results}/reranked/answer.csv").count() == 12


def test_filter_pools_equal_the_mask(spark, root):
    p = tables.Paths(root)
    items = pipelines.benchmark_items(spark, p)
    queries = pipelines.build_queries(tables.scan(spark, p.processed, "benchmark_queries"), "query_id")
    by, inside = pipelines.pool_of(pools.FILTERS, queries, items, None, None)
    rows = {r["item_id"]: r for r in items.collect()}
    members = {}
    for r in inside.collect():
        members.setdefault(r["pool"], set()).add(r["item_id"])
    for r in queries.join(by, "qid").collect():
        f = r["filter"]
        want = {i for i, x in rows.items() if (not f["category"] or x["item_category"] == f["category"]) and (not f["subcategories"] or x["item_subcategory"] in f["subcategories"]) and (not f["subjects"] or set(f["subjects"]) & set(x["item_subjects"])) and (not f["booking"] or x["item_online_booking"])}
        assert members.get(r["pool"], set()) == want


def test_missing_dataset(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run(spark, "preprocess", tmp_path)
