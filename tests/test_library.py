"""Functions and operators on hand-made rows, invariants, sinks and streams; and every query against its SQL."""

import datetime
import json
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import arrays, kv, numeric, stem, text
from lodestar.operators import answer, bm25, candidates, dense, evaluate, filters, geo, network, pools, preprocess, profile, rank, rerank, split, stats
from lodestar.plans import registry
from lodestar.session import session, step
from lodestar.sources import sinks, tables
from lodestar.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, schema="x string", rows=(("",),)):
    return spark.createDataFrame(list(rows), schema).select(column.alias("v")).first()["v"]


# --- key-value texts ---------------------------------------------------------------------------------------------

CASES = [
    ("Онлайн-запись Тип услуги СПА-услуги, массаж Вид услуги Красота, здоровье", [("Онлайн-запись", ""), ("Тип услуги", "СПА-услуги, массаж"), ("Вид услуги", "Красота, здоровье")]),
    ("Вид услуги Доставка еды Мероприятия Дни рождения", [("Вид услуги", "Доставка еды"), ("Мероприятия", "Дни рождения")]),
    ("Вид услуги", [("Вид услуги", "")]),
    ("просто текст", [(None, "просто текст")]),
    ("Гарантия Да Цена от 100 до 200", [("Гарантия", "Да"), ("Цена", "от 100 до 200")]),
    ("Есть портфолио хвост", [(None, "Есть портфолио хвост")]),
    ("Есть портфолио Да хвост", [("Есть портфолио", "Да"), (None, "хвост")]),
    ("Цена лучшая Марка авто BMW", [(None, "Цена лучшая"), ("Марка авто", "BMW")]),
    ("Слова в описании любой текст", [("Слова в описании", "любой текст")]),
    ("Тип услуги автосервиса Кузов\u00a0\u2003Марка Лада", [("Тип услуги автосервиса", ""), ("Кузов", ""), ("Марка", "Лада")]),
    ("", []), (None, []),
]


@pytest.mark.parametrize(("line", "pairs"), CASES)
def test_segments(line, pairs):
    assert kv.SEGMENTER.pairs(line) == pairs


def test_dictionary_size():
    assert {k: len(v) for k, v in kv.KEYS.items()} == {"category": 2, "content": 36, "attribute": 43, "flag": 36, "numeric": 31, "schedule": 8, "address": 3, "meta": 5, "search": 8}


def test_segments_as_columns(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in df.select("i", kv.split_params("t").alias("p")).collect()}
    assert got == {i: p for i, (_, p) in enumerate(CASES)}


def test_filter_fields(spark):
    lines = [
        "Вид услуги Красота Тип услуги Спа Тип услуги СПА Тип услуги Массаж Предмет или специальность Йога Онлайн-запись", "Вид услуги Тип услуги", "Онлайн-запись Нет Услуга Другое Услуга Стрижка", None,
    ]
    df = spark.createDataFrame([(t, t) for t in lines], "search_infm_params_text string, item_infm_params_text string")
    q = [tuple(r)[2:] for r in kv.process_queries(df).collect()]
    assert q == [("Красота", ["Спа", "Массаж"], ["Йога"], True), ("No category", ["No subcategory"], [], False), (None, [], [], False), (None, [], [], False)]
    i = [tuple(r)[2:] for r in kv.process_items(df).collect()]
    assert i == [("Красота", "Спа", ["Йога"], True, "Красота; Спа; Массаж; Йога"), ("No category", "No subcategory", [], False, ""), (None, None, [], False, "Стрижка"), (None, None, [], False, "")]


def test_stemmer():
    known = {"услуги": "услуг", "красота": "красот", "важность": "важност", "массажа": "массаж", "программирование": "программирован", "ёлки": "елк", "делается": "дела", "красивейший": "красив", "прочитавши": "прочита", "длинный": "длин", "в": "в", "bmw": "bmw"}
    assert {w: stem.stem(w) for w in known} == known


# --- texts, numbers, arrays --------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [("Звоните 8 (912) 345-67-89 😀 срочно", "Звоните срочно"), ("сайт https://a.b/c?d=1 и www.x.ru конец", "сайт и конец"), ("почта имя@дом.рф &nbsp; есть", "почта есть"), ("  a \u00a0\n b ", "a b"), ("+7 912 3456789", ""), ("☀️ 12345", "12345")],
)
def test_clean_text(spark, dirty, clean):
    assert one(spark, text.clean_text(F.col("x")), rows=[(dirty,)]) == clean


def test_doc_text_of_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), (None, None)], "t string, d string")
    assert [r[0] for r in df.select(text.doc_text(F.col("t"), F.col("d"))).collect()] == ["a", "b", ""]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("x")), rows=[("Ёж-1 ½_a, ПЛАН\u00b2 e\u0301",)]) == ["ёж", "1", "½_a", "план²", "e"]
    assert one(spark, text.ngrams(text.tokens(F.col("x")), 2), rows=[("a b c",)]) == ["a b", "b c"]
    assert one(spark, text.ngrams(text.tokens(F.col("x")), 4), rows=[("a b c",)]) == []
    assert one(spark, text.word_count(F.col("x")), rows=[("a\u00a0b  c",)]) == 3


def test_coverage(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["a"], ["c"]), ([], ["a"], ["c"])], "q array<string>, f array<string>, g array<string>")
    assert [r[0] for r in df.select(text.coverage(F.col("q"), F.col("f"), F.col("g"))).collect()] == [0.5, None]


def test_crc(spark):
    for s in ("", "Красота", "a|b"):
        assert one(spark, numeric.crc_bucket(F.col("x"), 5), rows=[(s,)]) == zlib.crc32(s.encode()) % 5
        assert one(spark, numeric.category_code(F.col("x")), rows=[(s,)]) == zlib.crc32(s.encode()) % 1_000_003
    assert one(spark, numeric.category_code(F.col("x")), rows=[(None,)]) == 0


def test_guards(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (-1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(numeric.share(F.col("a"), F.col("b"))).collect()] == [0.5, None, None]
    assert [r[0] for r in df.select(numeric.clip(F.col("b"), 0.5, 1.0)).collect()] == [1.0, 0.5, None]
    assert [r[0] is None for r in df.select(numeric.valid_price_log(F.col("a"))).collect()] == [False, False, True]


def test_lists(spark):
    df = spark.createDataFrame([(["b", None, "", "B", "a"], ["x", None]), (None, ["b"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(arrays.distinct_folded(F.col("a"))).collect()] == [["b", "a"], [], []]
    assert [r[0] for r in df.select(arrays.overlaps(F.col("a"), F.col("b"))).collect()] == [False, False, False]


# --- filters -----------------------------------------------------------------------------------------------------


def test_match_null_and_case(spark):
    rows = [("Красота", ["спа"], [], True, "красота", None, None, None), (None, [], ["Йога"], False, "x", "y", ["йога"], True)]
    df = spark.createDataFrame(rows, "c string, s array<string>, j array<string>, b boolean, ic string, isub string, ij array<string>, ib boolean")
    cols = [F.col(c) for c in df.columns]
    got = df.select(*(v.alias(k) for k, v in filters.match_filters(*cols).items())).collect()
    assert [tuple(r) for r in got] == [(True, False, None, False), (None, None, True, None)]
    assert [r[0] for r in df.select(filters.hard_mask(*cols)).collect()] == [False, False]  # exact: case matters
    assert [tuple(r) for r in df.select(*(v.alias(k) for k, v in filters.filter_features(*cols).items())).collect()] == [(0.0, 0.0, None, 0.0, 3), (None, None, 0.0, None, 1)]


# --- ranking -----------------------------------------------------------------------------------------------------


def test_best_lists_of_copied_queries_keep_no_pairs(spark, monkeypatch):
    """Many queries of few texts; lists by two settings in pools, over blocks, ties by key, against all pairs."""
    monkeypatch.setattr(bm25, "UNITS", 2)
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9))) if i % 11 else None, r.choice("xy")) for i in range(90)]
    asked = [(q, ["a b a", "c", "h g zz", "zz", None][q % 5], "xyz"[q // 5 % 3]) for q in range(45)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, pool string"), spark.createDataFrame(asked, "qid long, text string, pool string")
    settings = {"a": (1.2, 0.75), "b": (2.0, 0.0)}
    search = bm25.Searcher(q, "qid", F.col("text"), d, "doc_id", F.col("text"), settings)
    words = {i: (t or "").split() for i, t, _ in docs}
    df = {w: sum(w in x for x in words.values()) for w in "abcdefgh"}
    mean = sum(map(len, words.values())) / len(words)

    def score(text, i, k1, b):
        return sum(np.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * words[i].count(w) * (k1 + 1) / (words[i].count(w) + k1 * (1 - b + b * len(words[i]) / mean)) for w in (text or "").split() if w in words[i])

    for pool in (None, "pool"):
        want = set()
        for qid, text, p in asked:
            for name, setting in settings.items():
                own = sorted((-round(score(text, i, *setting), 6), i) for i, _, at in docs if (pool is None or at == p) and set((text or "").split()) & set(words[i]))
                want |= {(qid, i, name, -s) for s, i in own[:4]}
        assert {tuple(x) for x in search.scores(4, pool).collect()} == want
    every = {(x["qid"], x["doc_id"]): x["score"] for x in search.scores(None, "pool").filter("name = 'a'").collect()}
    assert every == {(qid, i): pytest.approx(score(text, i, 1.2, 0.75), abs=1e-6) for qid, text, p in asked for i, _, at in docs if at == p}


def test_searcher_splits_each_text_once(spark):
    """Counts and all searches read numbers that one pass keeps; each search split all texts again."""
    seen = spark.sparkContext.accumulator(0)

    def read_text(x):
        seen.add(1)
        return x

    d = spark.createDataFrame([(i, None if i == 3 else f"a b{i % 3} c{i}" if i % 4 else "", str(i % 2)) for i in range(20)], "doc_id long, text string, pool string").repartition(8)
    q = spark.createDataFrame([(0, "a b1", "0"), (1, "c7 c5 a", "1"), (2, None, "1")], "qid long, text string, pool string")
    search = bm25.Searcher(q, "qid", F.col("text"), d, "doc_id", F.udf(read_text, "string")("text"), {"x": (1.2, 0.75), "y": (2.0, 0.0)})
    for pool in (None, "pool"):
        got = {(r["qid"], r["doc_id"], r["name"]): r["score"] for r in search.scores(100, pool).collect()}
        for name, k1, b in (("x", 1.2, 0.75), ("y", 2.0, 0.0)):
            index = bm25.postings(d, "doc_id", F.col("text"), k1, b)
            want = bm25.scores(q, "qid", F.col("text"), index, "doc_id").join(q.select("qid", F.col("pool").alias("p")), "qid").join(d.select("doc_id", "pool"), "doc_id")
            rows = {(r["qid"], r["doc_id"], name): round(r["score"], 6) for r in (want if pool is None else want.filter("p = pool")).collect()}
            assert {k: v for k, v in got.items() if k[2] == name} == pytest.approx(rows) and rows
    assert seen.value == 20
    spark.catalog.clearCache()


def test_rank_pool_against_whole_pools(spark):
    r = random.Random(4)
    members = [(p, i) for p in "abc" for i in range(r.randint(0, 15))]
    pool_of = {q: r.choice("abc") for q in range(12)}
    scores = {(q, i): r.randint(1, 4) / 2 for q in pool_of for i in range(16) if r.random() < 0.3}
    got = rank.rank_pool(spark.createDataFrame([(*k, v) for k, v in scores.items()], "q long, i long, score double"), spark.createDataFrame(list(pool_of.items()), "q long, pool string"), spark.createDataFrame(members, "pool string, i long"), "q", "pool", "i", 5)
    want = set()
    for q, p in pool_of.items():
        own = sorted((-scores.get((q, i), 0.0), i) for pp, i in members if pp == p)[:5]
        want |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(own)}
    assert {(x["q"], x["i"], x["score"], x["rank"]) for x in got.collect()} == want


def test_rrf_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "q int, i int, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "q int, i int, rank int")
    x, y = ({(r["i"], round(r["rrf"], 12)) for r in rank.rrf(p.unionByName(q), "q", "i").collect()} for p, q in ((a, b), (b, a)))
    assert x == y and max(x, key=lambda t: t[1])[0] == 6


def test_places_against_a_sort(spark):
    r = random.Random(5)
    rows = [(k, r.randint(1, 4)) for k in [None, *(f"k{i:04d}" for i in range(700))]]
    df = spark.createDataFrame(rows, "k string, n long").repartition(7)
    got = [tuple(x) for x in rank.places(df, [-F.col("n"), F.col("k")], "n", ranges=9).orderBy("place").select("k", "n", "place", "covered").collect()]
    rows.sort(key=lambda x: (-x[1], x[0] or ""))
    assert got == [(k, n, i + 1, sum(m for _, m in rows[: i + 1])) for i, (k, n) in enumerate(rows)]
    assert rank.places(df.filter("n < 0"), [F.col("k")]).count() == 0
    assert rank.places(df.filter("k = 'k0003'"), [F.col("k")]).first()["place"] == 1


def test_places_compares_counted_keys_only(spark):
    counts = spark.range(100).select((F.col("id") % 7).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    plan = rank.places(counts, [F.col("k")], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "filter(" in line for line in plan.splitlines())


def test_sample_exact_is_the_head_of_the_sort(spark):
    df = spark.createDataFrame([(None,), *((i,) for i in range(5000))], "k long")
    for n in (0, 1, 777, 5001, 9000):
        whole = df.orderBy(rank.hash_order(F.col("k"), 4), "k").limit(n)
        assert sorted(map(str, rank.sample_exact(df, "k", n, 4).collect())) == sorted(map(str, whole.collect()))


def test_order_statistics_against_numpy(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(0, 50, 3001).astype(float), r.normal(size=3001)
    df = spark.createDataFrame([(x, y if i % 3 else None, None) for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))], "a double, b double, c double")
    got = {x["name"]: x["values"] for x in profile.order_statistics(df, {c: F.col(c) for c in "abc"}, [0.0, 0.37, 0.5, 1.0]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx(np.quantile(a, [0, 0.37, 0.5, 1])) and got["b"] == pytest.approx(np.quantile(b[np.arange(3001) % 3 > 0], [0, 0.37, 0.5, 1]))
    assert [x["value"] for x in profile.quantiles(df, "c", [0.5]).collect()] == [None]


def test_fill_passes_places_on(spark):
    ranked = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "q int, i int, rank int")
    got = rank.fill([(ranked([1, 2, 3]), 2), (ranked([2]), 4), (ranked([3, 2, 9, 8, 7]), 5)], "q", "i").orderBy("cand_rank").collect()
    assert [(r["i"], r["cand_rank"], r["source"]) for r in got] == [(1, 0, 0), (2, 1, 0), (3, 2, 2), (9, 3, 2), (8, 4, 2)]


def test_quotas_round_to_even():
    assert candidates.quotas(500, 0.17, 0.17) == (330, 415, 500) and candidates.quotas(5, 0.5, 0.0) == (2, 2, 5)


def test_thin_negatives(spark):
    df = spark.createDataFrame([(1, i, i, int(i in (3, 9))) for i in range(10)], "q int, i int, r int, label int")
    got = {r["i"] for r in rank.thin_negatives(df, ["q"], "label", "r", "i", 2, 3).collect()}
    assert {3, 9, 0, 1} <= got and len(got) == 7


def test_fractional_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, 3.0)], "q int, s double")
    assert sorted(r[0] for r in df.select(rank.fractional_rank("s", ["q"])).collect()) == [0.375, 0.375, 0.75, 1.0]


def test_ensemble_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rank, "TASK_ROWS", 50)
    df = spark.createDataFrame([(q, i, float(i), float(-i % 7)) for q in range(200) for i in range(5)], "qid int, item_idx int, a double, b double")
    got = rerank.ensemble(df, ["a", "b"])
    assert got.rdd.getNumPartitions() == 20 and got.count() == 1000


def test_dense_search_is_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    v = np.random.default_rng(0).normal(size=(20, 4)).round(1)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r["qid"], r["rank"]): r["vec_id"] for r in dense.search(df.withColumnRenamed("vec_id", "qid"), "qid", df, "vec_id", 3, exclude_self=True).collect()}
    s = np.round(v.astype(np.float32).astype(float) @ v.astype(np.float32).astype(float).T, 6)
    for q in range(20):
        order = sorted((-s[q, i], i) for i in range(20) if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [i for _, i in order]


def test_network_steps_stay_in_single_precision():
    """Gradients keep the inputs' precision, and equal those in double; codes many and few."""
    r = np.random.default_rng(2)
    start = rerank.RerankMLP.random(2, {k: 5 if k != "microcat" else 90 for k in rerank.EMBEDDINGS}, hidden=(8, 4)).weights
    x, first, label = r.normal(size=(30, 2)), np.arange(0, 30, 3), np.tile([1.0, 0.0, 0.0], 10)
    codes = {k: r.integers(0, 5 if k != "microcat" else 90, 30) for k in rerank.EMBEDDINGS}
    loss, double = network.gradients(start, x, codes, first, label)
    value, single = network.gradients({k: v.astype(np.float32) for k, v in start.items()}, x.astype(np.float32), codes, first, label)
    assert value == pytest.approx(loss, abs=1e-5) and {g.dtype for g in single.values()} == {np.dtype(np.float32)}
    assert all(single[k] == pytest.approx(double[k], abs=1e-5) for k in double)


def test_dense_search_over_blocks_with_copies_and_negatives(spark, monkeypatch):
    """pairs of blocks; many exact copies, scores below zero, blocks with fewer than k rows."""
    for name, n in (("BLOCK", 7), ("CORPUS_BLOCK", 9), ("ROWS", 3), ("COLUMNS", 4)):
        monkeypatch.setattr(dense, name, n)
    v = np.random.default_rng(3).normal(size=(12, 4)).round(1).repeat(4, axis=0).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r["qid"], r["rank"]): (r["vec_id"], r["score"]) for r in dense.search(df.withColumnRenamed("vec_id", "qid"), "qid", df, "vec_id", 10, exclude_self=True).collect()}
    s = np.round(v.astype(float) @ v.astype(float).T, 6) + 0.0
    assert got == {(q, n + 1): (i, pytest.approx(-x)) for q in range(48) for n, (x, i) in enumerate(sorted((-s[q, i], i) for i in range(48) if i != q)[:10])}


@pytest.mark.parametrize("groups, tasks", [(16, 16), (24, 24), (50, 7)])
def test_pairs_of_blocks_are_dealt_evenly(spark, groups, tasks):
    """Each task has its share of the groups; hashes of the groups' numbers left some idle and gave others several."""
    seats = dense._seats(spark, groups, tasks)
    assert len(set(seats)) == groups
    dealt = spark.createDataFrame([(x,) for x in seats], "g long").repartition(tasks, "g").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == tasks and {n for _, n in dealt} <= {groups // tasks, -(-groups // tasks)}


@pytest.mark.parametrize("strip, columns", [(2, 6), (4, 10), (64, 4096)])
def test_nearest_looks_into_every_strip_that_may_matter(monkeypatch, strip, columns):
    """strips' maxima as bounds, widths that strips don't divide, copies, and a row's own place."""
    for name, n in (("ROWS", 5), ("COLUMNS", columns), ("STRIP", strip)):
        monkeypatch.setattr(dense, name, n)
    v = np.random.default_rng(5).normal(size=(20, 4)).round(1).repeat(2, axis=0)
    at, s = np.arange(40), np.round(v @ v.T, 6)
    got = {}
    for row, place, score in dense._nearest(v, v, at, 3, 6):
        for r, p, x in zip(row, place, score, strict=True):
            got.setdefault(r, []).append((-x, p))
    assert {r: sorted(x) for r, x in got.items()} == {q: [(pytest.approx(x), i) for x, i in sorted((-s[q, i], i) for i in range(40) if i != q)[:3]] for q in range(40)}


def test_hits_in_class_are_hits_of_all_pairs(spark):
    """No pairs of equal labels are made; null and lone labels have no positives."""
    rows = [(i, None if i % 9 == 0 else 99 if i == 1 else i % 3) for i in range(40)]
    labels = spark.createDataFrame(rows, "vec_id long, label int")
    tops = spark.createDataFrame([(q, n, (q * 7 + n * n) % 40, r) for q in range(40) for n in range(1, 6) for r in ("a", "b")], "qid long, rank int, vec_id long, retriever string")
    gold = spark.createDataFrame([(a, b) for a, x in rows for b, y in rows if a != b and x is not None and x == y], "qid long, vec_id long")
    want = evaluate.hits(tops, gold, "qid", "vec_id", 4, ["retriever"])
    got = evaluate.hits_in_class(tops, labels, "vec_id", "label", "qid", 4, ["retriever"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


# --- geo ---------------------------------------------------------------------------------------------------------


def test_neighbours_against_all_pairs(spark):
    r = random.Random(1)
    places = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(150)] + [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, 10.0, 179.99), (203, 10.0, -179.99), (204, -90.0, 0.0), (205, -89.95, 120.0)]
    df = spark.createDataFrame(places, "loc int, lat double, lon double")
    for km in (50.0, 700.0, 3000.0):
        def far(a, b):
            p, q = np.radians([a[1], a[2]]), np.radians([b[1], b[2]])
            h = np.sin((q[0] - p[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((q[1] - p[1]) / 2) ** 2
            return 2 * 6371 * np.arcsin(np.sqrt(h))
        want = {(a[0], b[0]) for a in places for b in places if a[0] != b[0] and far(a, b) <= km}
        assert {(x["loc"], x["nb"]) for x in geo.neighbours(df, km).collect()} == want
    assert geo.neighbours(df, 0).count() == 0


def test_region_cover(spark):
    pairs = spark.createDataFrame([(100, 1)] * 6 + [(100, 2)] * 3 + [(100, 3)] + [(1, 2)], "search_location_id int, item_location_id int")
    known = spark.createDataFrame([(1,), (2,), (3,)], "loc int")
    cover = lambda c: {(r["region"], r["loc"]) for r in geo.region_cover(pairs, known, c).collect()}
    assert cover(0.6) == {(100, 1)} and cover(0.9) == {(100, 1), (100, 2)} and cover(0.95) == {(100, 1), (100, 2), (100, 3)} and cover(0.0) == set()


# --- statistics, split, pools ------------------------------------------------------------------------------------


def test_leave_one_out_is_the_statistic_without_the_event(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 8), r.choice("ab"), r.randint(0, 1), r.randint(0, 4), r.randint(0, 2), r.randint(0, 2)) for _ in range(60)]
    rows = [(e, f"t{e % 3}", e % 2, i, m, loc) for e, _, _, i, m, loc in rows]
    schema = "event_id int, search_query string, search_location_id int, item_id int, item_microcat_id int, item_location_id int"
    pairs = spark.createDataFrame(rows, schema)
    cols = [*stats.COUNTERS, "text_events"]
    loo = {tuple(x[c] for c in pairs.columns): tuple(x[c] for c in cols) for x in stats.counters(pairs, pairs, True).collect()}
    for e in range(9):
        own = [x for x in rows if x[0] == e]
        if own:
            rest = spark.createDataFrame([x for x in rows if x[0] != e], schema)
            for x in stats.counters(spark.createDataFrame(own, schema), rest, False).collect():
                assert loo[tuple(x[c] for c in pairs.columns)] == tuple(x[c] for c in cols)


def test_counters_deal_rows_by_event_and_item_only(spark):
    r = random.Random(4)
    value = lambda n: None if r.random() < 0.1 else r.randint(0, n)
    rows = [(value(30), None if r.random() < 0.1 else r.choice("abc"), value(2), value(6), value(3), value(2)) for _ in range(300)]
    schema = "event_id int, search_query string, search_location_id int, item_id int, item_microcat_id int, item_location_id int"
    pairs = spark.createDataFrame(rows, schema)
    at = {k: i for i, k in enumerate(pairs.columns)}

    def count(row, keys):
        return 0 if any(row[at[k]] is None for k in keys) else sum(all(x[at[k]] == row[at[k]] for k in keys) for x in rows)

    def wanted(row):
        own = {n: count(row, of) - count(row, ("event_id", *less)) for n, (of, less) in stats.COUNTERS.items()}
        events = 0 if row[1] is None else len({x[0] for x in rows if x[1] == row[1]} - {None})
        return (*own.values(), events - (row[0] is not None))

    got = stats.counters(pairs, pairs, True)
    cols = [*stats.COUNTERS, "text_events"]
    assert sorted((str(tuple(x[c] for c in pairs.columns)), tuple(x[c] for c in cols)) for x in got.collect()) == sorted((str(x), wanted(x)) for x in rows)
    # neither an event nor an item is dealt together with another key of the counters
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" in plan and "hashpartitioning(event_id" in plan
    assert not any(s in re.sub(r"#\d+L?", "", plan) for s in ("hashpartitioning(event_id, item", "hashpartitioning(search_query, item_id"))


def test_split_contracts(spark):
    rows = [(e, f"text {e % 40}", i) for e in range(400) for i in range(3)]
    config = split.SplitConfig(val_text_fraction=0.1, catalog_size=2)
    got = split.split_by_text(spark.createDataFrame(rows, "event_id int, search_query string, item_id int"), config)
    part = {}
    for r in got.collect():
        part.setdefault(r["event_id"], set()).add((r["part"], r["slice"]))
    assert all(len(x) == 1 for x in part.values())
    kind = {e: next(iter(x)) for e, x in part.items()}
    unseen = {e % 40 for e, k in kind.items() if k == ("val", split.UNSEEN)}
    train = {e % 40 for e, k in kind.items() if k[0] == "train"}
    seen = [e for e, k in kind.items() if k == ("val", split.SEEN)]
    assert len(unseen) == 4 and not unseen & train and {e % 40 for e in seen} <= train
    n_unseen = sum(k == ("val", split.UNSEEN) for k in kind.values())
    assert len(seen) == round(n_unseen * 0.37 / 0.63)
    with pytest.raises(ValueError):
        split.sample_catalog(got, got, split.SplitConfig(catalog_mode="other"))
    assert split.SplitConfig.from_json(config.to_json()) == config


def test_split_and_catalog_make_pairs_twice(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [(e, f"text {e % 40}", i) for e in range(100) for i in range(3)]
    pairs = spark.createDataFrame(rows, "event_id int, search_query string, item_id int").mapInArrow(counted, "event_id int, search_query string, item_id int")
    assert split.split_by_text(pairs, split.SplitConfig(val_text_fraction=0.1)).count() == 300
    assert made.value <= 2 * len(rows)
    spark.catalog.clearCache()
    made.value = 0
    assert split.sample_catalog(pairs, pairs.filter("item_id = 1"), split.SplitConfig(catalog_mode="keep_positives", catalog_size=2)).count() == 2
    assert made.value <= 2 * len(rows)
    spark.catalog.clearCache()


def test_cutoff_random_order(spark):
    gold = spark.createDataFrame([(1, True, False), (1, False, True)], "q int, in_filters boolean, in_geo boolean")
    sizes = spark.createDataFrame([(1, 100, 10, 50, 0)], "q int, n_all int, n_filters int, n_geo int, n_both int")
    got = {r["variant"]: (r["passed"], r["pool"], r["random_hits"]) for r in pools.cutoff_stats(gold, sizes, "q", 20).collect()}
    assert got == {"none": (2, 100, 0.4), "filters": (1, 10, 1.0), "geo": (1, 50, 0.4), "filters+geo": (0, 0, 0.0), "geo+fill": (2, -1, None)}


# --- rerankers ---------------------------------------------------------------------------------------------------


def test_preprocessor_round_trip(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, None), (30.0, float("nan"))], "a double, geo_dist_km double")
    p = rerank.Preprocessor(["a", "geo_dist_km"]).fit(df)
    assert p.stats["a"]["median"] == 2.0 and not p.stats["a"]["has_nan"] and p.stats["geo_dist_km"]["has_nan"] and p.stats["geo_dist_km"]["std"] == 1.0
    again = rerank.Preprocessor.from_json(p.to_json())
    assert again.stats == p.stats
    got = [tuple(r) for r in df.select(*(v.alias(k) for k, v in again.transform().items())).collect()]
    assert [x[2] for x in got] == [0.0, 1.0, 1.0] and abs(sum(x[0] for x in got)) < 1e-9


def test_listwise_loss_against_numpy(spark):
    rows = [(1, 0.5, 1), (1, -1.0, 0), (1, 2.0, 1), (2, 3.0, 0)]
    got = {r["qid"]: r["loss"] for r in rerank.listwise_loss(spark.createDataFrame(rows, "qid int, score double, label int")).collect()}
    s = np.array([0.5, -1.0, 2.0])
    lp = s - np.log(np.exp(s).sum())
    assert got[1] == pytest.approx(-(lp[0] + lp[2]) / 2) and got[2] == 0


def test_fit_listwise_learns(spark):
    r = np.random.default_rng(0)
    rows = []
    for q in range(60):
        x = r.normal(size=(6, 2))
        best = int(np.argmax(2 * x[:, 0] - x[:, 1]))
        rows += [(q, int(i == best), float(a), float(b)) for i, (a, b) in enumerate(x)]
    w = rerank.fit_listwise(spark.createDataFrame(rows, "qid int, label int, a double, b double"), ["a", "b"], rounds=15)
    assert w[0] > 0.5 and w[1] < -0.2


def shuffled(spark):
    """Rows that all stages so far have shuffled."""
    none = spark.sparkContext._jvm.java.util.ArrayList()
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_fit_listwise_shuffles_groups_once_and_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(rerank, "BLOCK", 7)  # groups lie across batches and blocks
    monkeypatch.setattr(rank, "TASK_ROWS", 300)
    r = np.random.default_rng(1)
    rows = [(q if q else None, int(r.random() < 0.3), *map(float, r.normal(size=2))) for q in range(200) for _ in range(1 + q % 9)]
    df = spark.createDataFrame(rows, "qid int, label int, a double, b double").cache()
    before = shuffled(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = rerank.fit_listwise(df, ["a", "b"], rounds=12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shuffled(spark) - before < 2 * len(rows)
    groups = {}
    for q, y, *x in rows:
        groups.setdefault(q, []).append((y, x))
    groups = [(np.array([y for y, _ in g]), np.array([x for _, x in g])) for g in groups.values() if any(y for y, _ in g)]
    w, m, v = (np.zeros(2) for _ in range(3))
    for t in range(1, 13):
        g = 1e-4 * w
        for y, x in groups:
            e = np.exp(x @ w - (x @ w).max())
            g = g + (e / e.sum() - y / y.sum()) @ x / len(groups)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert got == pytest.approx(w)


def test_fit_boosted_learns_what_a_line_cannot(spark):
    r = random.Random(3)
    rows = [(q, x, y, int((x > 0.5) != (y > 0.5) and r.random() < 0.9)) for q in range(150) for x, y in [(r.random(), r.random()) for _ in range(8)]]
    df = spark.createDataFrame(rows, "qid int, x double, y double, label int").withColumn("z", F.lit(1.0))
    model = rerank.Boosted.from_json(rerank.fit_boosted(df, ["x", "y", "z"], rounds=8).to_json())
    loss = lambda s: rerank.listwise_loss(df.withColumn("score", s)).agg(F.avg("loss")).first()[0]
    # no scores lose less than a group's positives in equal shares; trees close most of the way there, a line can't
    least = df.groupBy("qid").agg(F.sum("label").alias("n")).agg(F.sum(F.when(F.col("n") > 0, F.log("n"))) / F.count("*")).first()[0]
    weights = rerank.fit_listwise(df, ["x", "y"], rounds=10)
    closed = lambda s: (loss(F.lit(0.0)) - loss(s)) / (loss(F.lit(0.0)) - least)
    assert closed(model.score()) > 0.5 and closed(F.col("x") * float(weights[0]) + F.col("y") * float(weights[1])) < 0.2
    share = dict(map(tuple, model.shares(spark).collect()))
    assert sum(share.values()) == pytest.approx(1) and share["z"] == 0 and min(share["x"], share["y"]) > 0.2


def test_leaf_steps_are_newtons(spark):
    rows = [(q, float(i), int(i >= 6)) for q in range(40) for i in range(8)]
    df = spark.createDataFrame(rows, "qid int, x double, label int")
    model = rerank.fit_boosted(df, ["x"], rounds=1, depth=1, rate=1.0, least=1)
    root = model.trees[0]
    assert 5 <= root["at"] < 6
    h = 1 / 8 * 7 / 8
    # 6 rows below at gradient 0 - 1/8, 2 above at 1/2 - 1/8, times 40 queries
    assert root["left"]["value"] == pytest.approx(240 * -1 / 8 / (240 * h + 1e-3))
    assert root["right"]["value"] == pytest.approx(80 * 3 / 8 / (80 * h + 1e-3))


def test_mlp_matches_numpy(spark):
    sizes = dict.fromkeys(rerank.EMBEDDINGS, 5)
    model = rerank.RerankMLP.random(2, sizes, hidden=(7,), text_in=4, text_dim=3, seed=1)
    assert model.weights["w0"].shape[1] == 2 + 64 + 1 + 9
    rows = [(i, float(i), -1.0, i % 5, [0.1 * i] * 4, [1.0] * 4) for i in range(11)]
    df = spark.createDataFrame(rows, "i int, a double, b double, code int, q array<double>, d array<double>")
    got = {r["i"]: r["score"] for r in rerank.predict(df, model, ["a", "b"], dict.fromkeys(rerank.EMBEDDINGS, "code"), "q", "d").collect()}
    want = model.score(np.array([[r[1], r[2]] for r in rows]), {k: np.array([r[3] for r in rows]) for k in sizes}, np.array([r[4] for r in rows]), np.array([r[5] for r in rows]))
    assert [got[i] for i in range(11)] == pytest.approx(list(want))


# --- answers, preprocessing, sources, sinks, streams -------------------------------------------------------------


def test_network_gradients():
    r = np.random.default_rng(3)
    sizes = dict.fromkeys(rerank.EMBEDDINGS, 4)
    w = rerank.RerankMLP.random(2, sizes, hidden=(6, 5), text_in=3, text_dim=2, seed=1).weights
    n, starts = 12, np.array([0, 5, 7])
    args = (r.normal(size=(n, 2)), {k: r.integers(0, 4, n) for k in sizes}, starts, np.array([1, 0, 0, 1, 0, 0, 1, 1, 0, 0, 0, 0.0]), r.normal(size=(n, 3)), r.normal(size=(n, 3)))
    loss, g = network.gradients(w, *args)
    s = rerank.RerankMLP(w).score(args[0], args[1], args[4], args[5])
    groups = [(s[a:b], args[3][a:b]) for a, b in ((0, 5), (5, 7), (7, 12))]
    assert loss == pytest.approx(np.mean([-(t / t.sum() * (x - np.log(np.exp(x).sum()))).sum() for x, t in groups]))
    assert set(g) == set(w)
    for k in w:
        at = tuple(r.integers(0, d) for d in w[k].shape)
        moved = []
        for step in (1e-6, -1e-6):
            other = {**w, k: w[k].copy()}
            other[k][at] += step
            moved.append(network.gradients(other, *args)[0])
        assert (moved[0] - moved[1]) / 2e-6 == pytest.approx(g[k][at], abs=1e-6), k


def test_network_learns_what_a_line_cannot(spark):
    r = random.Random(7)
    rows = []
    for q in range(600):
        made = [(r.uniform(-1, 1), r.uniform(-1, 1), r.randrange(5)) for _ in range(8)]
        win = max(range(8), key=lambda i: made[i][0] * made[i][1])
        rows += [(q, i, int(i == win and q % 50 > 0), *made[i]) for i in range(8)]  # some groups have no positive
    df = spark.createDataFrame(rows, "qid long, item_idx int, label int, x double, y double, c int").withColumns({k: F.col("c") for k in rerank.EMBEDDINGS}).cache()
    codes, val = {k: k for k in rerank.EMBEDDINGS}, df.filter("qid >= 400 and qid % 50 > 0")
    n_pos = val.groupBy("qid").agg(F.sum("label").alias("n_pos"))
    recall = lambda scored: rerank.top_k_recall(scored, "score", n_pos, 2).agg(F.avg("recall")).first()[0]
    start = rerank.RerankMLP.random(2, dict.fromkeys(rerank.EMBEDDINGS, 5), hidden=(16,))
    train = df.filter("qid < 400")
    model, history = network.fit_mlp(train, start, ["x", "y"], codes, rate=0.02, groups=32, dropout=0.0, measure=lambda m: recall(rerank.predict(val, m, ["x", "y"], codes)), patience=4)
    assert history[-1]["loss"] < 0.7 * history[0]["loss"]
    w = rerank.fit_listwise(train, ["x", "y"], rounds=10)
    straight = recall(val.withColumn("score", F.col("x") * float(w[0]) + F.col("y") * float(w[1])))
    assert recall(rerank.predict(val, model, ["x", "y"], codes)) > straight + 0.2
    assert max(h["measure"] for h in history) == pytest.approx(recall(rerank.predict(val, model, ["x", "y"], codes)))
    same, none = network.fit_mlp(train.filter("label > 1"), start, ["x", "y"], codes)
    assert none == [] and same is start


def test_answer_rules(spark):
    q = spark.createDataFrame([("q" * 16,), ("r" * 16,)], "query_id string")
    items = spark.createDataFrame([(f"{i:016x}",) for i in range(60)], "item_id string")
    good = spark.createDataFrame([("q" * 16, f"{1:016x} {2:016x}"), ("r" * 16, "")], "query_id string, answer string")
    assert answer.check_answer(good, q, items).count() == 0
    bad = spark.createDataFrame([("q" * 16, " ".join(f"{i:016x}" for i in range(51))), ("q" * 16, f"{1:016x} {1:016x} {99:016x} XYZ"), ("short", None)], "query_id string, answer string")
    got = {r["rule"]: r["n"] for r in answer.check_answer(bad, q, items).collect()}
    assert got == {"repeated query_id": 1, "query_id format": 1, "too many items": 1, "repeated items": 1, "missing query_id": 1, "extra query_id": 1, "unknown items": 2, "item_id format": 1}
    assert [r["rule"] for r in answer.check_answer(good.withColumnRenamed("answer", "a"), q, items).collect()] == ["columns"]


def test_transform_skips_what_is_missing(spark):
    df = spark.createDataFrame([(1, 2, 114)], "item_price int, search_location_id int, item_category_id int")
    out = preprocess.transform(df)
    assert out.columns == ["search_location_id", "item_price", "item_is_service"] and out.first()["item_is_service"] is True


def test_paths_and_required_inputs(spark, tmp_path):
    (tmp_path / "x").mkdir()
    assert tables.Paths("s3a://b").processed == "s3a://b/processed"
    assert preprocess.missing_inputs(spark, [str(tmp_path / "x"), str(tmp_path / "y")]) == [str(tmp_path / "y")]


def test_answer_file_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a" * 16, "x y"), ("b" * 16, "")], "query_id string, answer string")
    sinks.write_csv(df, str(tmp_path / "answer"))
    raw = next((tmp_path / "answer").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"query_id,answer\n") and b"\r" not in raw
    assert sorted(map(tuple, tables.read_answer(spark, str(tmp_path / "answer")).collect())) == sorted(map(tuple, df.collect()))
    sinks.write_csv(spark.createDataFrame([(1, 0.5)], "a int, b double"), str(tmp_path / "report"), 6)
    assert "0.500000" in next((tmp_path / "report").glob("part-*.csv")).read_text()


def test_split_sink_and_config(spark, tmp_path):
    rows = spark.createDataFrame([(e, f"t{e % 5}", e % 7) for e in range(50)], "event_id int, search_query string, item_id int")
    config = split.SplitConfig(catalog_size=4)
    parts = split.split_by_text(rows, config)
    val = parts.filter("part = 'val'")
    catalog = split.sample_catalog(parts, val, config)
    sinks.write_split(parts, split.select_eval(val, catalog, config), catalog, config.to_json(), str(tmp_path))
    assert tables.read_json_config(spark, f"{tmp_path}/config.json") == json.loads(config.to_json())
    assert tables.scan(spark, str(tmp_path), "catalog").count() == 4
    assert tables.scan(spark, str(tmp_path), "train_pairs").count() + tables.scan(spark, str(tmp_path), "val_pairs").count() == 50


def test_vector_store_encodes_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "vectors")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    todo = sinks.missing_vectors(docs, path, "id", "t")
    assert todo.count() == 2
    sinks.append_vectors(todo.select("id", "text_md5", F.array(F.lit(1.0)).alias("vector")), path)
    docs = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "c")], "id int, t string")
    assert {r["id"] for r in sinks.missing_vectors(docs, path, "id", "t").collect()} == {2, 3}
    assert {r["id"] for r in sinks.read_vectors(spark, path, docs, "id", "t").collect()} == {1}


def test_partitioned_sink_prunes(spark, tmp_path):
    sinks.write_table(spark.range(20).withColumn("fold", F.col("id") % 4), str(tmp_path / "t"), ["fold"])
    plan = spark.read.parquet(str(tmp_path / "t")).filter("fold = 2")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


def test_stream_ingests_new_files_once(spark, tmp_path):
    src, dst, log = (str(tmp_path / x) for x in ("src", "dst", "log"))
    spark.range(5).write.mode("append").parquet(src)
    ingest.ingest(spark, src, dst, log, lambda df: df.withColumn("twice", F.col("id") * 2))
    spark.range(5, 8).write.mode("append").parquet(src)
    ingest.ingest(spark, src, dst, log, lambda df: df.withColumn("twice", F.col("id") * 2))
    assert sorted(r["twice"] for r in spark.read.parquet(dst).collect()) == [2 * i for i in range(8)]


def test_windowed_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 30)
    spark.createDataFrame([(at, "a", 1.0), (at + datetime.timedelta(hours=3), "a", 2.0)], "ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select n, total from windowed").collect()
    assert [(r["n"], r["total"]) for r in rows] == [(1, 1.0)]  # the later window is still open


def test_profile_of_nothing(spark):
    none = spark.createDataFrame([], "a int, b double")
    assert {(r["column"], r["missing"], r["share"]) for r in profile.missing(none).collect()} == {("a", 0, 0.0), ("b", 0, 0.0)}
    nan = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert profile.missing(nan).first()["missing"] == 2


def test_session_and_step(spark):
    said = []
    with step("work", said.append):
        assert session().conf.get("spark.sql.session.timeZone") == "UTC"
    assert said[0].startswith("work: ")


def test_plans_push_down_and_broadcast_nothing_unbounded(spark, sf_dir):
    plan = registry.QUERIES["s02_projection"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan
    plan = registry.QUERIES["o05_top_items"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in registry.QUERIES["j10_neighbours"](spark, sf_dir)._jdf.queryExecution().toString()


# --- every query against its SQL ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, db, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in registry.ORACLE:
        want = db.sql(registry.ORACLE[name])
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols
        assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    spark.catalog.clearCache()


def test_boosting_shuffles_its_rows_once_and_cuts_at_exact_quantiles(spark):
    r = random.Random(5)
    rows = [(q, r.gauss(0, 50), float(r.randint(-2, 2)), int(r.random() < 0.3)) for q in range(900) for _ in range(6)]
    df = spark.createDataFrame(rows, "qid int, x double, y double, label int")
    taught = {q for q, _, _, y in rows if y}
    x = np.array([v for q, v, _, _ in rows if q in taught])
    data = rerank.packed(df, ["x", "y"], "qid", "label")
    cuts = rerank._cuts(data, 2)
    # the smallest value with a share of i / 32 of the rows up to it
    assert list(cuts[0]) == [np.sort(x)[-(-i * len(x) // 32) - 1] for i in range(1, 32)]
    assert list(cuts[1]) == [-2, -1, 0, 1]
    model = rerank.fit_boosted(df, ["x", "y"], rounds=2, depth=2)
    assert {t["at"] for t in model.trees} <= {*cuts[0], *cuts[1]}
    # a depth-first replay of the second tree's root: the best gain over all cuts at the scores after the first
    scored = spark.createDataFrame([(q, a, b, y) for q, a, b, y in rows if q in taught], df.schema).withColumn("s", rerank.Boosted(["x", "y"], model.trees[:1], [0, 0]).score())
    got = scored.toPandas()
    e = np.exp(got.s - got.groupby("qid").s.transform("max"))
    g = (got.label / got.groupby("qid").label.transform("sum") - e / e.groupby(got.qid).transform("sum")).to_numpy()
    best = max((g[m].sum() ** 2 / m.sum() + g[~m].sum() ** 2 / (~m).sum(), f, c) for f, name in enumerate("xy") for c in cuts[f] for m in [(got[name] <= c).to_numpy()])
    assert (model.trees[1]["feature"], model.trees[1]["at"]) == best[1:]
    with pytest.raises(ValueError, match="nulls"):
        rerank.fit_boosted(df.withColumn("y", F.when(F.col("x") > 0, F.col("y"))), ["x", "y"], rounds=1)
