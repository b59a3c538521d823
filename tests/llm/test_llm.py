"""Operators against brute force, and their edge cases: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, components, elias_fano, exact_dedup, langid, lm, media, minhash, packing, sharding, shingles, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum dolor " * 20000
ODD = [
    (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (4, ""), (5, "  \t\n "),
    (6, "One TWO three four five six"), (7, LONG), (None, "a null id"), (8, "éà ß 日本語 🙂"), (9, "!!! 123"), (10, "x"),
]


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- exact dedup -------------------------------------------------------------------------------------------------


def test_exact_dedup(spark, odd, none):
    clash = odd.withColumns({"count": F.lit(1), "key": F.lit("x"), "group": F.lit(2)})
    rows = exact_dedup.mark_copies(clash).collect()
    assert len(rows) == len(ODD)
    size = collections.Counter(t or "" for _, t in ODD)
    keep = {k: max((i for i, t in ODD if (t or "") == k and i is not None), default=None) for k in size}
    for r in rows:
        assert (r["group_size"], r["keep_id"]) == (size[r["text"] or ""], keep[r["text"] or ""])
    assert exact_dedup.mark_copies(none).count() == 0
    left = exact_dedup.drop_copies(clash)
    assert left.columns == clash.columns and left.count() == len(size)


def test_exact_dedup_repeated_kept_row(spark):
    left = exact_dedup.drop_copies(table(spark, [(5, "a"), (5, "a"), (1, "a"), (2, "b")])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(2, "b"), (5, "a")]


def test_exact_dedup_shuffled_join_is_the_same(docs, monkeypatch):
    want = sorted(map(tuple, exact_dedup.mark_copies(docs.select("doc_id", "text")).collect()))
    monkeypatch.setattr(exact_dedup.common, "small", lambda df, rows=0: df)
    assert sorted(map(tuple, exact_dedup.mark_copies(docs.select("doc_id", "text")).collect())) == want


# --- media -------------------------------------------------------------------------------------------------------


def test_g711_tables():
    assert media.MULAW[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.ALAW[[0x2A, 0xAA, 0xD5, 0x55]].tolist() == [-32256, 32256, 8, -8]
    assert sorted(set(np.abs(media.MULAW.astype(int)))) == sorted(abs(int(x)) for x in media.MULAW[:128])


def test_adpcm_against_samplewise():
    blocks = np.random.default_rng(1).integers(0, 256, (3, media.BLOCK), dtype=np.uint8)
    for block, got in zip(blocks, media.adpcm_decode(blocks), strict=True):
        value, index = int(np.frombuffer(block[:2].tobytes(), "<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for nibble in (byte & 15, byte >> 4):
                step = media.IMA_STEP[index]
                d = step >> 3
                for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                    d += part if nibble & bit else 0
                value = max(-32768, min(32767, value - d if nibble & 8 else value + d))
                index = max(0, min(88, index + (media.IMA_INDEX * 2)[nibble]))
                want.append(value)
        assert got.tolist() == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "adpcm"])
def test_media_round_trip(odd, none, codec):
    emit = ("payload_sha256", "media", "media_sha256", "pcm", "pcm_samples", "tail_crc32", "feature", "n_bytes")
    got = collections.Counter()
    for r in media.telephony_media(odd.withColumn("media", F.lit(1)), codec=codec, emit=emit).collect():
        kind, rate, payload = media.read_wav(r["media"])
        assert (kind, rate) == (codec, 8000)
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
        assert len(r["pcm"]) == 2 * r["pcm_samples"] and r["tail_crc32"] == zlib.crc32(payload[-32:])
        got[(r["doc_id"], payload)] += 1
    assert got == collections.Counter((i, media.pad((t or "").encode())) for i, t in ODD)
    assert media.telephony_media(none).count() == 0


@pytest.mark.parametrize(("a", "b"), [(8000, 16000), (16000, 8000), (8000, 11025), (44100, 8000), (8000, 12000)])
def test_resample(a, b):
    """A tone below both Nyquist limits stays what it is; rows don't hear each other; the sum of one filter place by place."""
    t = np.arange(a // 10)
    tone = np.rint(9000 * np.sin(2 * np.pi * 440 * t / a)).astype(np.int16)
    one, two, three = media.resample(np.concatenate([tone, tone[:7], tone]), a, b, np.cumsum([0, len(tone), 7, len(tone)]))
    want = 9000 * np.sin(2 * np.pi * 440 * np.arange(len(one)) / b)
    inner = slice(60, -60)
    assert len(one) == -(-len(tone) * b // a) and len(two) == -(-7 * b // a) and one.tolist() == three.tolist()
    assert np.abs(one[inner] - want[inner]).max() < 60
    weight = media.low_pass(b // math.gcd(a, b), a // math.gcd(a, b))
    reach = weight.shape[1] // 2
    for n in (0, 5, len(one) - 1):
        whole, phase = divmod(n * (a // math.gcd(a, b)), b // math.gcd(a, b))
        near = [(whole + k, w) for k, w in zip(range(-reach + 1, reach + 1), weight[phase], strict=True)]
        assert abs(sum(float(w) * tone[i] for i, w in near if 0 <= i < len(tone)) - one[n]) <= 1


def test_resample_damps_what_the_new_rate_cannot_hold():
    t = np.arange(4000)
    high = np.rint(9000 * np.sin(2 * np.pi * 6500 * t / 16000)).astype(np.int16)
    assert np.abs(media.resample(high, 16000, 8000)[0][60:-60]).max() < 300 and media.resample(high, 8000, 8000)[0] is not None


def test_media_store(odd, tmp_path):
    rows = media.store(odd, f"{tmp_path}/m").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        payload = media.read_wav(r["media"])[2]
        pcm = media.resample(media.MULAW[np.frombuffer(payload, np.uint8)], 8000, 16000)[0]
        assert r["pcm"] == pcm.tobytes() and len(r["pcm"]) == 4 * len(payload)


def test_media_query(spark, docs, sf_dir):
    want = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = media.op9_telephony_media(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        payload = media.pad(want[r["doc_id"]])
        stored = media.wav(payload, "mulaw", 8000)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) == (len(want[r["doc_id"]]), len(payload), len(stored), zlib.crc32(payload[-32:]))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())


# --- sharding ----------------------------------------------------------------------------------------------------


def test_matrix_margins():
    counts = np.random.default_rng(2).integers(0, 50, 37)
    before = np.append(0, np.cumsum(counts))
    sizes = sharding.shard_sizes(int(before[-1]), 5)
    rows = np.array([sharding.matrix_row(before, sizes, p, 3) for p in range(37)])
    assert rows.sum(1).tolist() == counts.tolist() and rows.sum(0).tolist() == sizes


def test_split_beyond_exact_generator():
    got = sharding.split_margins([3 * 10**9, 10**9], 2 * 10**9, np.random.default_rng(0))
    assert sum(got) == 2 * 10**9 and abs(got[0] - 1.5e9) < 1e6


@pytest.mark.parametrize(("good", "bad", "n"), [(5, 7, 4), (3, 200, 100), (400, 300, 250), (1, 1, 2), (9, 0, 4)])
def test_hypergeometric_law(good, bad, n):
    least, law = sharding._law(good, bad, n)
    want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(least, least + len(law))]
    assert np.allclose(np.diff(law / law[-1], prepend=0), want, atol=1e-12) and abs(sum(want) - 1) < 1e-9


def test_small_draws_from_large_populations():
    rng, total = np.random.default_rng(5), 2 * 10**9
    got = np.array([sharding._draw(rng, total // 8, total - total // 8, 3) for _ in range(20000)])
    want = [math.comb(3, k) * 0.125**k * 0.875 ** (3 - k) for k in range(4)]
    assert abs(got.mean() - 0.375) < 0.02 and np.abs(np.bincount(got, minlength=4) / len(got) - want).max() < 0.015


def test_sharding_carries_clashing_columns(spark):
    df = spark.createDataFrame([(i, i * 2, "x", -i, 5) for i in range(50)], "doc_id long, _key long, _bucket string, _RANK int, n int")
    rows = sharding.deal(df, 3).collect()
    assert sorted((r["doc_id"], r["_key"], r["_bucket"], r["_RANK"], r["n"]) for r in rows) == [(i, i * 2, "x", -i, 5) for i in range(50)]


def test_sharding_query(spark, docs, sf_dir):
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert (r["law"], r["grown_shard"]) == ("rows", None)
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_sharding(spark, odd, none):
    many = spark.range(0, 3001, 1, 7).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(9).alias("slot"))
    for df, shards in ((many, 8), (odd, 4), (none, 3)):
        rows = sharding.deal(df, shards).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert len(rows) == df.count()
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    a, b = (sorted(map(tuple, sharding.deal(many, 8).collect())) for _ in range(2))
    assert a == b


def test_sharding_is_uniform(spark):
    rows = sharding.deal(spark.range(0, 8000, 1, 4).withColumnRenamed("id", "doc_id"), 4).collect()
    seen = np.zeros((4, 4))
    for r in rows:
        seen[r["doc_id"] // 2000, r["shard"]] += 1
    assert abs(seen - 500).max() < 100
    order = [r["slot"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.05


# --- packing -----------------------------------------------------------------------------------------------------


def naive(items, capacity):
    """Best fit by looking at all bins."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if capacity - sum(x[0] for x in b) >= size and all((source is None or source != x[1]) and (cluster is None or cluster != x[2]) for x in b)]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        bins[i].append((size, source, cluster))
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_against_naive(seed):
    r = np.random.default_rng(seed)
    items = sorted(((int(s), [None, "a", "b", "c", "d"][k], int(c)) for s, k, c in zip(r.integers(1, 100, 300), r.integers(0, 5, 300), r.integers(0, 40, 300), strict=True)), key=lambda x: -x[0])
    assert packing.pack(*map(list, zip(*items, strict=True)), 100) == naive(items, 100)


def test_packing(spark, odd, none):
    df = odd.withColumns({"source": F.when(F.col("doc_id") > 4, "s"), "bin": F.lit(1), "size": F.lit(2)})
    rows = packing.best_fit(df, capacity=4096).collect()
    want = collections.Counter()
    for i, t in ODD:
        want[i] += len((t or "").encode()) + 1
    got = collections.Counter()
    by = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["size"]
        by[r["bin"]].append(r)
    assert got == want
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0]["bin_used"] <= 4096
        assert sorted(r["offset"] for r in own) == list(np.cumsum([0, *(r["size"] for r in sorted(own, key=lambda r: r["offset"]))])[:-1])
        for c in ("source", "cluster"):
            v = [r[c] for r in own if r[c] is not None]
            assert len(v) == len(set(v))
    assert packing.best_fit(none.withColumn("source", F.lit("x"))).count() == 0


def test_packing_keeps_large_keys_beside_nulls(spark):
    big = 2**62
    rows = [(big + 1, "a", "s", big + 1), (big + 2, "b", "t", big + 2), (None, "c", None, None), (big + 3, "d", "u", None)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string, source string, cl long"), cluster="cl", capacity=100).collect()
    assert {(r["doc_id"], r["cluster"]) for r in got} == {(i, c) for i, _, _, c in rows} and len({r["bin"] for r in got}) == 1


def test_packing_query(spark, docs, sf_dir):
    rows = packing.op2_best_fit_packing(spark, sf_dir).collect()
    source = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["bin"] >> 24].append(r)
    assert sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t in source.values())
    for own in by.values():
        own.sort(key=lambda r: (-r["size"], r["doc_id"], r["piece"]))
        bins = naive([(r["size"], source[r["doc_id"]][0], source[r["doc_id"]][1]) for r in own], 8192)
        assert [r["bin"] & ((1 << 24) - 1) for r in own] == bins


# --- language ID -------------------------------------------------------------------------------------------------


def test_language_id(docs, odd, none):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = langid.train(docs.filter(~held))
    got = langid.identify(docs.filter(held), model).select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    rows = langid.identify(odd.withColumn("score", F.lit("old")), model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) and isinstance(r["score"], float)
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none.withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_score_of_other_languages(spark, docs):
    model = langid.train(docs.filter("lang is not null"))
    other = ["Привет как дела сегодня хорошо " * 20, "日本語のテキスト" * 30, "qzxv kjhg wxzq pfff grrr " * 9]
    assert max(model.predict(other)["score"]) < 0.25 < min(model.predict([r["text"] for r in docs.filter("n_chars > 40").limit(200).collect()])["score"])


def test_language_machines_see_their_sides_only(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate([("en", "the cat %d and the dog" % k) for k in range(30)] + [("de", "der hund und die katze")] * 30 + [("fr", "le chat et le chien")] * 3 + [("en", None), ("fr", "123"), (None, "x")])]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    assert model.families == {"germanic": ["de", "en"], "romance": ["fr"]} and len(model.between) == 1 and len(model.within["germanic"]) == 1
    assert model.predict(["the dog", "die hund", "le chien", "", None])["lang_pred"] == ["en", "de", "fr", "und", "und"]
    one = langid.train(spark.createDataFrame(rows[:30], "doc_id long, text string, lang string"))
    assert one.predict(["the dog"])["lang_pred"] == ["en"]


def test_language_query(spark, docs, sf_dir):
    rows = langid.op4_language_id(spark, sf_dir).collect()
    want = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(want) and set(rows[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_features_of_long_texts():
    text = "abc déf " * 300_000
    a, b = langid.features([text])[0], langid.features(["abc déf " * 100])[0]
    assert float(a @ b) > 0.999


# --- BPE ---------------------------------------------------------------------------------------------------------


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def vocab_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


TRICKY = [
    "It's ΣΑΣ οδος Σ", "a<|endoftext|>b <|startoftext|>", "x\x1cy\x85z\xa0w v", "İstanbul ½ ²3 ﬁ ＡＢ", "日本語 テスト 123", "e\u0301 café", "'sabc 'S don't I'LL", "_a_ __ --x--", "🙂🙂 ok", "\ufeffhi\u200bthere", "ǅ ǆ ŉ ß ẞ", "१२३ ٣", "a" * 5000,
]


def test_bpe(spark, odd, none, vocab_path):
    t = library(vocab_path)
    df = odd.union(table(spark, [(100 + i, x) for i, x in enumerate(TRICKY)])).withColumn("ids", F.lit(1))
    rows = bpe.encode(df, vocab_path, emit=("n_tokens", "ids", "decoded", "ids_sha256")).collect()
    assert len(rows) == df.count()
    want = collections.Counter()
    for r in df.collect():
        e = t.encode(r["text"] or "", add_special_tokens=False)
        want[(r["doc_id"], tuple(e.ids), t.decode(e.ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest() for r in rows)
    assert bpe.encode(none, vocab_path).count() == 0


def test_bpe_special_tokens_of_any_look(spark, tmp_path):
    """A tokenizer that folds case but not its special tokens."""
    tokenizers = pytest.importorskip("tokenizers")
    vocab = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz[]")} | {"[CLS]": 40, "ab": 41, "[UNK]": 42}
    t = tokenizers.Tokenizer(tokenizers.models.BPE(vocab, [("a", "b")], unk_token="[UNK]"))
    t.normalizer, t.pre_tokenizer = tokenizers.normalizers.Lowercase(), tokenizers.pre_tokenizers.WhitespaceSplit()
    t.add_special_tokens([tokenizers.AddedToken("[CLS]", normalized=False)])
    path = f"{tmp_path}/t.json"
    t.save(path)
    texts = ["[CLS] AB Abba", "x[CLS]Y [cls] [Cls]", "AB[CL", ""]
    rows = bpe.encode(table(spark, list(enumerate(texts))), path, emit=("ids", "decoded")).collect()
    assert {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in rows} == {i: ((e := t.encode(x, add_special_tokens=False).ids), t.decode(e, skip_special_tokens=False)) for i, x in enumerate(texts)}


def test_bpe_query(spark, docs, sf_dir, vocab_path):
    t = library(vocab_path)
    want = {}
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op3_bpe(spark, sf_dir).collect()} == want


def test_bpe_decode_join(spark, vocab_path):
    t = library(vocab_path)
    ids = [t.encode(x, add_special_tokens=False).ids for x in TRICKY[:6]] + [[], None]
    df = spark.createDataFrame(list(enumerate(ids)), "k long, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df, vocab_path, "k").collect()}
    assert got == {k: t.decode(x or [], skip_special_tokens=False) for k, x in enumerate(ids)}


# --- toxicity ----------------------------------------------------------------------------------------------------


def test_toxicity(spark, none, odd):
    clean = ["the quiet river runs past the old mill number %d" % i for i in range(300)]
    bad = ["the quiet river you gruntling%s fool idiot runs past mill %d" % ("abcdefgh"[i % 8], i) for i in range(60)]
    rows = list(enumerate(clean + bad))
    labels = spark.createDataFrame([(i, int(i >= 300)) for i, _ in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(table(spark, rows), labels)
    got = toxicity.score(table(spark, [(1, "a gruntlingzz idiot"), (2, "the quiet mill"), (3, None), (4, "")]), model).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    clash = toxicity.score(odd.withColumn("score", F.lit("old")), model)
    assert clash.count() == len(ODD) and dict(clash.dtypes)["score"] == "double"
    blank = toxicity.train(table(spark, rows), labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score(odd, blank).collect()} == {0.0}


def test_toxicity_beyond_the_voters(spark):
    """Words that no voter has, but that come with those that voters have, make a text toxic."""
    r = np.random.default_rng(4)
    plain, slurs = [f"word{x}y" for x in "abcdefghijklmnopqrstuvwxyz"], [f"zorp{x}" for x in "abcdefgh"]
    rows, labels = [], []
    for i in range(400):
        own = [plain[k] for k in r.integers(0, 26, 30)]
        if i % 4 == 0:
            own += ["idiot", "moron", *(slurs[k] for k in r.integers(0, 8, 2))]
        rows.append((i, " ".join(own)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.train(table(spark, rows + rows[:8]), spark.createDataFrame(labels, "doc_id long, toxic int"), mined=0)
    texts = ["worda wordb zorpa zorpb zorpc", "worda wordb wordc wordd worde", "zorpa zorpb zorpc worda wordb", LONG]
    assert not any(set(w.split()) & set(model.voters.words) for w in texts)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table(spark, [(k, t) for k, t in enumerate(texts)] * 2), model).collect()}
    assert got[0] == got[2] > 0.3 > got[1] and got[3] < 0.3


def test_label_model_recovers_labels():
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.15
    votes = np.column_stack([np.where(y, r.random(4000) < a, r.random(4000) < b) for a, b in ((0.8, 0.02), (0.7, 0.05), (0.6, 0.01), (0.9, 0.05))]).astype(float)
    post = toxicity.label_model(votes)
    assert ((post > 0.5) == y).mean() > 0.97


def test_label_model_against_enumeration():
    """Tree, rates and posterior of one round, one row at a time."""
    r = np.random.default_rng(1)
    first = r.random((300, 4)) < 0.4
    votes = np.column_stack([first, first[:, 1] ^ (r.random(300) < 0.1)]).astype(float)  # the last copies the second
    post = r.random(300)
    parent = toxicity.dependence_tree(votes, post)
    assert sorted(parent)[0] == -1 and (parent[4] == 1 or parent[1] == 4)
    rate = toxicity.rates(votes, post, parent)
    for y in (0, 1):
        for i in range(5):
            own = [p if y else 1 - p for p in post]
            overall = (sum(o * v[i] for o, v in zip(own, votes, strict=True)) + 0.5) / (sum(own) + 1)
            for a in (0, 1):
                rows = [(o, v[i]) for o, v in zip(own, votes, strict=True) if (v[parent[i]] if parent[i] >= 0 else 0) == a]
                assert abs(rate[y, a, i] - (sum(o * x for o, x in rows) + overall) / (sum(o for o, _ in rows) + 1)) < 1e-9
    got = toxicity.posterior(votes, 0.2, rate, parent)
    for v, p in zip(votes, got, strict=True):
        like = [1 - 0.2, 0.2]
        for y in (0, 1):
            for i in range(5):
                q = rate[y, int(v[parent[i]]) if parent[i] >= 0 else 0, i]
                like[y] *= q if v[i] else 1 - q
        assert abs(p - like[1] / sum(like)) < 1e-9


def test_toxicity_query(docs, spark, sf_dir):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, sf_dir).collect()
    assert len(rows) == docs.count() and set(rows[0].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)
    known = [r for r in rows if not r["held_out"] and r["doc_id"] in labels]
    bad, good = ([r["score"] for r in known if labels[r["doc_id"]] == y] for y in (1, 0))
    assert sum(x >= 0.3 for x in good) <= 0.02 * len(good) and np.mean(bad) > 5 * np.mean(good)


# --- url filter --------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = [
        "http://A.Example.NET/en/1?x=/y", "http://b.net/en/", "http://example.net/en", "https://x.example.com/de/3", "http://w.org/fr/9#top", "http://w.org/es/9", None, "", "no scheme/net/",
        "http://notexample.net", "http://casino-win.example.org/en/4", "a://b://c/d", "http://EXAMPLE.com/de/?q", "http://host.net.au/x", "http://é.com/%20/" + "z/" * 9,
    ]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    assert [got[i]["host"] for i in (0, 6, 8, 11, 12)] == ["a.example.net", "", "", "b:", "example.com"] and got[0]["path"] == "/en/1"
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.net/en/", "net/", "net/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None, "example.com/de/", None, None]
    assert [got[i]["verdict"] for i in (0, 1, 3, 4, 5, 6)] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.xyz/{'ads' if i % 2 else 'news'}/{i}") for i in range(200)] + [(1000 + i, f"http://h.xyz/v/{chr(97 + i % 26)}{chr(97 + i // 26)}x/p") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    rules = (("block", "h.xyz/ads/1"), ("allow", "h.xyz/news/1"))
    got = {r["page_id"]: r for r in url_filter.judge(df, rules=rules).collect()}
    assert got[55]["rule"] is None and got[55]["verdict"] == "block" and got[54]["verdict"] == "allow"
    assert {got[1000 + i]["template"] for i in range(200)} == {"/v/*/p"} and got[55]["template"] == "/ads/{n}"


def test_url_tree_tells_paths_of_a_host_apart(spark):
    """What no list of hosts can do: labels come from pages, and branches of like rates are merged with each other only."""
    rate = {"a": 0.9, "b": 0.92, "c": 0.1, "d": 0.08}
    bad, good = "<p>Win at the CASINO now</p>", "<script>casino</script><p>" + "quiet words " * 30 + "</p>"
    rows = [(1000 * k + i, f"http://h.xyz/{s}/{i}", bad if i < 100 * rate[s] else good) for k, s in enumerate(rate) for i in range(100)]
    rows += [(9000 + i, f"http://h.xyz/new/{i}", None if i % 2 else "") for i in range(4)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string"), html_col="html").collect()}
    assert {(got[1000 * k + 99]["template"], got[1000 * k + 99]["verdict"]) for k in range(4)} == {("/+2/{n}", "block"), ("/+1/{n}", "allow")}
    assert {(got[i]["template"], got[i]["verdict"]) for i in range(9000, 9004)} == {("/new/{n}", "allow")}


def test_url_seeds_decide_their_own_pages(spark):
    urls = ["http://casino-win.xyz/", "http://h.xyz/free-bets/1", "http://h.xyz/x", "http://www.xyz/" + "long/" * 50_000]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow"}


# --- near duplicates ---------------------------------------------------------------------------------------------


def brute(rows, width, percent):
    """Components over all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[top(i)] = min(k, low.get(top(i), k))
    return {(k, len(sets[i]), low[top(i)]) for i, (k, _) in enumerate(rows)}


def family(n, seed, edits=(0, 9), words=120):
    r = np.random.default_rng(seed)
    base = [f"w{x}" for x in r.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in r.integers(0, words, r.integers(*edits)):
            own[at] = f"v{r.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("limit", [minhash.GROUP_SHINGLES, 2000, 60])
def test_near_dedup_against_all_pairs(spark, limit):
    texts = family(40, 1) + family(25, 2) + family(6, 3) + [t + " " + u for t, u in zip(family(20, 4, words=60), family(20, 5, (25, 40), 60), strict=True)] + ["a b", "A B", "", None, "b a", "z"]
    order = np.random.default_rng(9).permutation(len(texts))
    rows = [(int(k), texts[i]) for k, i in enumerate(order)]
    got = minhash.near_copies(table(spark, rows).withColumn("kept", F.lit("old")), width=3, percent=85, group_shingles=limit).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_large_groups_keep_links_without_longer_prefixes(spark):
    r = np.random.default_rng(3)
    rows = []
    for k in range(0, 160, 2):  # pairs of similarity 0.81, of which some share no prefix of eight values
        own = [f"w{k}x{at}" for at in range(200)]
        rows.append((k, " ".join(own)))
        for at in r.permutation(np.arange(5, 195, 3))[:7]:
            own[at] = f"v{k}x{at}"
        rows.append((k + 1, " ".join(own)))
    got = minhash.near_copies(table(spark, rows), width=3, percent=80, group_shingles=300).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, k - k % 2) for k, _ in rows}


def test_near_dedup_edges(spark, odd, none):
    got = minhash.near_copies(odd, width=3, percent=85).collect()
    assert len(got) == len(ODD)
    comp = {(r["doc_id"], r["component_id"]) for r in got}
    assert {(1, 1), (2, 1), (6, 1), (3, 3), (4, 4), (5, 5), (None, None)} <= comp
    assert minhash.near_copies(none).count() == 0
    left = minhash.drop_near_copies(odd.filter("doc_id is not null").withColumn("component_id", F.lit(1)), width=3, percent=85)
    assert sorted({r["doc_id"] for r in left.collect()}) == [1, 3, 4, 5, 7, 8, 9, 10]


def test_shingles_against_sets():
    texts = ["The cat sat", "the CAT sat down  on\tthe mat", "", " x ", "cat sat", "the cat sat the cat sat", "n\u00a0b s"]
    for width in (1, 3, 5):
        sets = shingles.shingle_sets([t.encode() for t in texts], width)
        want = []
        for t in texts:
            w = WORD.findall(t.translate(LOWER))
            want.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
        assert [len(s) for s in sets] == [len(s) for s in want]
        for i in range(len(texts)):
            for j in range(len(texts)):
                assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (200, 150)] + [(300, i) for i in range(301, 340)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 150, 150: 150} | {i: 300 for i in range(300, 340)}
    assert got == want


# --- language model ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "top"), [(1, 5), (1000, 2**63), (5000, 6000), (3, 0), (1000, 2**64 - 1), (0, 0)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    e, _ = elias_fano.EliasFano.load(np.frombuffer(elias_fano.EliasFano.build(v, top).dump(), np.uint8))
    assert e.get(np.arange(n)).tolist() == v.tolist()
    q = np.concatenate([v, r.integers(0, top, 500, dtype=np.uint64, endpoint=True)])
    assert e.successor(q).tolist() == np.searchsorted(v, q).tolist()
    assert (e.find(q) >= 0).tolist() == np.isin(q, v).tolist()


def trigram_logs(train, p1, min_count):
    """log10 probabilities of a text's tokens, by counts of all training token lists (0: a text's start)."""
    two = collections.Counter(x for own in train for x in zip([0, *own], own, strict=False))
    three = collections.Counter(x for own in train for x in zip([0, *own], own, own[1:], strict=False))

    def discounted(counts, least):
        ctx, kept, lost = collections.Counter(), {k: c for k, c in counts.items() if c >= least}, collections.Counter()
        for k, c in counts.items():
            ctx[k[:-1]] += c
        for k, c in kept.items():
            lost[k[:-1]] += c - 0.75
        return lambda k, lower: ((kept[k] - 0.75) / ctx[k[:-1]] if k in kept else 0) + (1 - lost[k[:-1]] / ctx[k[:-1]] if ctx[k[:-1]] else 1) * lower

    p2, p3 = discounted(two, min_count), discounted(three, 2)

    def logs(own):
        two = [p2((a, w), p1(w)) for a, w in zip([0, *own], own, strict=False)]
        three = [p3((a, b, w), p) for a, b, w, p in zip([0, *own], own, own[1:], two[1:], strict=False)]
        return [math.log10(p) for p in two[:1] + three]

    return logs


def test_lm_against_counts(spark, odd, none):
    texts = [(i, t) for i, t in ODD] + [(20 + i, "the cat sat on the mat and the cat ran " * (i % 3 + 1)) for i in range(30)]
    df = table(spark, texts).withColumn("held", F.col("doc_id") % 4 == 1)
    model = lm.train(df.filter("held is null or not held"))
    rows = lm.score(df.withColumn("score", F.lit("x")), model).collect()
    flow = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in texts]
    train = [own for (i, _), own in zip(texts, flow, strict=True) if i is None or i % 4 != 1]
    one = collections.Counter(w for own in train for w in own)
    total, distinct = sum(one.values()), len(one)
    assert (model.total, model.distinct) == (total, distinct)
    p1 = lambda w: (one[w] + 0.5) / (total + 0.5 * (distinct + 1))
    logs = trigram_logs(train, p1, 2)
    want = collections.Counter()
    for (i, _), own in zip(texts, flow, strict=True):
        base = sum(math.log10(p1(w)) for w in own)
        full = sum(logs(own))
        want[(i, len(own), sum(one[w] > 0 for w in own), round(base, 5))] += 1
        near = [r["score"] for r in rows if r["doc_id"] == i and r["n_tokens"] == len(own) and abs(r["base_score"] - base) < 1e-6 * abs(base) + 1e-9]
        assert near and min(abs(x - full) for x in near) < 2e-4 * len(own)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in rows) == want
    blank = lm.train(none)
    assert lm.score(none, model).count() == 0 and lm.score(odd, blank).count() == len(ODD)


def test_lm_probabilities_sum_to_one(spark):
    texts = ["a b a b c", "a b c c", "b a"]
    model = lm.train(table(spark, list(enumerate(texts))))
    # one more word after "a": scores of texts that differ in the last word only
    options = ["a", "b", "c", "unseen"]
    rows = {r["doc_id"]: r["score"] for r in lm.score(table(spark, [(k, "a " + w) for k, w in enumerate(options)] + [(9, "a")]), model).collect()}
    assert len(rows) == 5 and all(x < 0 for x in rows.values())


def test_lm_query_keeps_bigrams_seen_once(spark, tmp_path):
    texts = [(i, f"a{i % 7} b{i % 5} c{i} d{i % 3}") for i in range(40)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lm.op6_lm_scoring(spark, str(tmp_path)).collect()
    flow = {i: [*t.split(), None] for i, t in texts}
    train = [own for i, own in flow.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for own in train for w in own)
    logs = trigram_logs(train, lambda w: (one[w] + 0.5) / (sum(one.values()) + 0.5 * (len(one) + 1)), 1)
    assert len(rows) == 40 and set(rows[0].asDict()) == {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    for r in rows:
        assert abs(r["score"] - sum(logs(flow[r["doc_id"]]))) < 2e-4 * len(flow[r["doc_id"]])


def test_lm_segments_of_every_level(spark, monkeypatch):
    """Many segments give the scores of one, and a trigram context's probabilities sum to one."""
    r = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{x}" for x in r.zipf(1.5, 30) if x < 40)) for i in range(60)]
    options = [f"w{x}" for x in range(1, 40)]
    df = table(spark, texts)
    asked = table(spark, [(k, "w1 w2 " + w) for k, w in enumerate(options)] + [(100 + i, t) for i, t in texts])
    small = {x["doc_id"]: x["score"] for x in lm.score(asked, lm.train(df, min_count=1)).collect()}
    monkeypatch.setattr(lm, "SEGMENT_WORDS", 4)
    monkeypatch.setattr(lm, "SEGMENT_PAIRS", 100)
    model = lm.train(df, min_count=1)
    assert len(model.vocabulary) > 3 and len(model.bigrams) > 3 and len(model.trigrams) > 3
    assert {x["doc_id"]: x["score"] for x in lm.score(asked, model).collect()} == pytest.approx(small, abs=1e-9)
    train = [[*t.split(), None] for _, t in texts]
    one = collections.Counter(w for own in train for w in own)
    logs = trigram_logs(train, lambda w: (one[w] + 0.5) / (sum(one.values()) + 0.5 * (len(one) + 1)), 1)
    for i, t in [*enumerate("w1 w2 " + w for w in options), *((100 + i, t) for i, t in texts)]:
        own = [*t.split(), None]
        assert abs(small[i] - sum(logs(own))) < 2e-4 * len(own)
    # of all words, the end and an unknown one after "w1 w2"
    assert sum(10 ** logs(["w1", "w2", w])[2] for w in [*one, "unseen"]) == pytest.approx(1)


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline
    from lodestar.llm import common

    docs = common.table(spark, sf_dir, "documents").withColumns({"_score": F.lit("old"), "component_id": F.lit(1)})
    other = [None, "", "123 456", LONG, "Привет как дела сегодня хорошо " * 9]
    extra = [(10**7 + k, t) for k, t in enumerate(other)]
    extra = table(spark, extra + extra[3:4] + [(None, "and a null id of the text")]).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("src0"), "n_chars": F.lit(0).cast("long"), "_score": F.lit("old"), "component_id": F.lit(1)})
    now, sizes = docs.unionByName(extra), []
    for name, stage in corpus_pipeline.STAGES:
        made = common.cut(stage(spark, now, sf_dir))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns and made.filter("doc_id is null").count() == 1
        sizes.append(made.select("doc_id").distinct().count())
        now = made
    # of the extra ones, only LONG and the null id are in a learned language
    assert sizes[0] == docs.count() + 2 and sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 0


def test_pipeline_stages_of_nothing(spark, tmp_path):
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "one two three four five six", None, None, 3), (1, "one two three four five six", None, None, 3), (2, None, None, None, None)]
    for data, left in (([], [0, 0, 0, 0, 0]), (rows, [3, 3, 2, 2, 2])):
        now, sizes = spark.createDataFrame(data, kind), []
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, str(tmp_path))
            sizes.append(now.count())
        assert sizes == left
