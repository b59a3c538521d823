"""Language-model scoring with an Elias-Fano n-gram trie.

Words are 64-bit hashes. Level one of the trie is the vocabulary: sorted hashes as Elias-Fano segments and exact counts.
Level two holds, context after context, the word numbers that follow it, each added to the last number of the context
before, so that the whole level is one monotone sequence, with monotone pointers to where each context begins; a bigram is
looked up by a successor search for (its context's base + word number) within the context's range. Level three does the
same with bigrams, by their places in level two, as contexts; those without followers of their own are left out by one
more monotone sequence. Smoothed log-probabilities and back-off weights are stored in 16 bits.

Probabilities: unigrams (c + 0.5) / (N + 0.5 (V + 1)); bigrams of at least min_count occurrences, and trigrams of two or
more whose bigrams are kept, by absolute discounting (D = 0.75), interpolated with the next lower order; what discounts
and rarer n-grams leave goes to the back-off weight of their context, so each context's probabilities sum to one. The
query keeps every bigram (min_count = 1); train's default drops those seen once.

Counts are taken over all training rows in Spark. All levels are built in segments by executors, which write each to a file of
its own in the shared folder; nothing passes through the driver. Workers map the files in place if the folder is a mounted
one, else each machine fetches them once and maps its copy; no machine holds them in heap memory. The files grow with the
corpus.

A null or empty text is one end token. Rows that repeat are counted and scored each; a null id counts as training; an
empty table gives no rows; texts are read whole, however long; further columns are carried, but for those named as the new ones.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .elias_fano import EliasFano
from .shingles import U, mix, words

END = mix(np.array([0xE2D], U))[0]
MIN_COUNT, TRIGRAM_COUNT, DISCOUNT = 2, 2, 0.75
#: Words of a vocabulary segment, and n-grams (counted once for each task) of a segment of a higher level, at most on average.
SEGMENT_WORDS, SEGMENT_PAIRS = 1 << 20, 4 << 20
#: Tokens that a counting task gathers before it emits distinct ones.
GATHER = 4_000_000
#: Steps of log10 probabilities: 16 bits reach down to -16.
STEPS = 4096


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each closed by END; the index of each text's first token."""
    hashes, counts = words([t or b"" for t in texts])
    ends = np.cumsum(counts + 1) - 1
    out = np.full(len(hashes) + len(texts), END, U)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = hashes
    return out, np.append(0, ends[:-1] + 1) if len(ends) else ends


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 * STEPS), 65535).astype(np.uint16)


def _mapped(where: str) -> np.ndarray:
    """A segment's bytes: mapped where it lies, or from the machine's own copy if only its name is given."""
    return np.memmap(where if "/" in where else SparkFiles.get(where), np.uint8, "r").view(np.ndarray)


class Vocabulary:
    """Level one, memory-mapped. index: for each segment its least hash, first word number, file."""

    def __init__(self, index: tuple[tuple[int, int, str], ...]):
        self.least = np.array([x[0] for x in index], U)
        self.first = [x[1] for x in index]
        self.segments, self.counts = [], []
        for _, _, where in index:
            data = _mapped(where)
            codes, at = EliasFano.load(data)
            self.segments.append(codes)
            self.counts.append(data[at : at + 8 * codes.n].view(np.uint64))
        self.starts = np.array([*self.first, self.first[-1] + self.segments[-1].n if index else 0], np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of sorted hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        edge = [*np.searchsorted(hashes, self.least), len(hashes)]
        for k, codes in enumerate(self.segments):
            if edge[k] < edge[k + 1]:
                at = codes.find(hashes[edge[k] : edge[k + 1]])
                out[edge[k] : edge[k + 1]] = np.where(at >= 0, at + self.first[k], -1)
        return out

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of word numbers; 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        which = np.searchsorted(self.starts, numbers, side="right") - 1
        for k in np.unique(which[numbers >= 0]).tolist():
            own = (which == k) & (numbers >= 0)
            out[own] = self.counts[k][numbers[own] - self.first[k]]
        return out


class Followers:
    """What follows each of a run of contexts: word numbers as one monotone sequence, their probabilities, back-off weights."""

    def __init__(self, data: np.ndarray, at: int = 0):
        self.pointers, at = EliasFano.load(data, at)
        self.codes, at = EliasFano.load(data, at)
        n = self.pointers.n - 1
        self.gamma = data[at : at + 2 * n].view(np.uint16)
        at += 2 * n
        self.end = at + 2 * self.codes.n
        self.probability = data[at : self.end].view(np.uint16)

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, gamma: np.ndarray, probability: np.ndarray) -> bytes:
        """context: of each follower, ascending, below len(gamma); word: ascending within a context."""
        size = np.bincount(context, minlength=len(gamma))
        pointers = np.append(0, np.cumsum(size))
        # each context's word numbers go on from one behind the last of the context before
        last = np.flatnonzero(np.append(np.diff(context), 1)) if len(context) else np.empty(0, np.int64)
        lift = np.append(0, np.cumsum(word[last] + 1)[:-1]) if len(last) else np.empty(0, np.int64)
        codes = EliasFano.build((word + np.repeat(lift, size[size > 0])).astype(U))
        return EliasFano.build(pointers.astype(U)).dump() + codes.dump() + quantise(np.log10(np.maximum(gamma, 1e-15))).tobytes() + quantise(np.log10(probability)).tobytes()

    def _base(self, begin: np.ndarray) -> np.ndarray:
        base = np.zeros(len(begin), U)
        later = begin > 0
        base[later] = self.codes.get(begin[later] - 1) + U(1)
        return base

    def score(self, contexts: np.ndarray, which: np.ndarray, numbers: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of word numbers after contexts[which], and their places here (-1: none). lower: log10 of the next lower order."""
        begin, end = self.pointers.get(contexts).astype(np.int64), self.pointers.get(contexts + 1).astype(np.int64)
        base = self._base(begin)
        value, place = lower - self.gamma[contexts].astype(float)[which] / STEPS, np.full(len(which), -1, np.int64)
        asked = np.flatnonzero((begin < end)[which] & (numbers >= 0))
        found = self.codes.find(base[which[asked]] + numbers[asked].astype(U))
        hit = (found >= begin[which[asked]]) & (found < end[which[asked]])
        value[asked[hit]] = self.probability[found[hit]].astype(float) / -STEPS
        place[asked[hit]] = found[hit]
        return value, place

    def words(self, places: np.ndarray) -> np.ndarray:
        """Word numbers of the followers at these places."""
        context = self.pointers.successor(places + 1) - 1
        return (self.codes.get(places) - self._base(self.pointers.get(context).astype(np.int64))).astype(np.int64)


class Bigrams:
    """Level two, memory-mapped. index: for each segment its first context and file. Bigrams are numbered through all segments."""

    def __init__(self, index: tuple[tuple[int, str], ...]):
        self.first = np.array([x[0] for x in index], np.int64)
        self.segments, self.often = [], []
        for _, where in index:
            data = _mapped(where)
            self.segments.append(Followers(data))
            self.often.append(data[self.segments[-1].end :])
        self.starts = np.cumsum([0, *(s.codes.n for s in self.segments)])

    def score(self, contexts: np.ndarray, which: np.ndarray, numbers: np.ndarray, log_unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of word numbers after contexts[which], and the bigrams' numbers (-1: none); contexts sorted, which ascending."""
        out, place = np.empty(len(which)), np.full(len(which), -1, np.int64)
        edge = [*np.searchsorted(contexts, self.first), len(contexts)]
        for k, segment in enumerate(self.segments):
            if edge[k] == edge[k + 1]:
                continue
            a, b = np.searchsorted(which, [edge[k], edge[k + 1]])
            out[a:b], own = segment.score(contexts[edge[k] : edge[k + 1]] - self.first[k], which[a:b] - edge[k], numbers[a:b], log_unigram[a:b])
            place[a:b] = np.where(own >= 0, own + self.starts[k], -1)
        return out, place

    def _by_segment(self, bigrams: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        edge = np.searchsorted(bigrams, self.starts)
        for k in np.flatnonzero(np.diff(edge)).tolist():
            own = slice(edge[k], edge[k + 1])
            yield k, own, bigrams[own] - self.starts[k]

    def words(self, bigrams: np.ndarray) -> np.ndarray:
        """Second word of each bigram; bigrams sorted."""
        out = np.empty(len(bigrams), np.int64)
        for k, own, places in self._by_segment(bigrams):
            out[own] = self.segments[k].words(places)
        return out

    def repeated(self, bigrams: np.ndarray) -> np.ndarray:
        """Whether each occurs more than once in training; bigrams sorted, -1 (no bigram) first."""
        out = np.zeros(len(bigrams), bool)
        for k, own, places in self._by_segment(bigrams):
            out[own] = self.often[k][places >> 3] >> (places & 7).astype(np.uint8) & 1
        return out


class Trigrams:
    """Level three, memory-mapped. Segment k has the bigrams from k * span; of these, only those that have followers of their own."""

    def __init__(self, files: tuple[str, ...], bigrams: int):
        self.span, self.segments = _span(bigrams, len(files)), []
        for where in files:
            data = _mapped(where)
            owners, at = EliasFano.load(data)
            self.segments.append((owners, Followers(data, at)))

    def score(self, contexts: np.ndarray, which: np.ndarray, numbers: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 probability of word numbers after the bigrams contexts[which]; contexts sorted, which ascending. lower: by level two."""
        out = lower.copy()
        edge = np.searchsorted(contexts, np.arange(len(self.segments) + 1) * self.span)
        for k, (owners, followers) in enumerate(self.segments):
            a, b = np.searchsorted(which, [edge[k], edge[k + 1]])
            if a == b:
                continue
            own = owners.find(contexts[edge[k] : edge[k + 1]] - k * self.span)
            at = own[which[a:b] - edge[k]]
            has = np.flatnonzero(at >= 0)
            used, again = np.unique(at[has], return_inverse=True)
            out[a + has] = followers.score(used, again, numbers[a:b][has], lower[a:b][has])[0]
        return out


def _span(bigrams: int, segments: int) -> int:
    return max(-(-bigrams // segments), 1)


@functools.lru_cache(2)
def _vocabulary(index: tuple) -> Vocabulary:
    return Vocabulary(index)


@functools.lru_cache(2)
def _bigrams(index: tuple) -> Bigrams:
    return Bigrams(index)


@functools.lru_cache(2)
def _trigrams(files: tuple, bigrams: int) -> Trigrams:
    return Trigrams(files, bigrams)


def _written(blobs: DataFrame, order: str) -> dict[int, str]:
    """Writes binary rows (order, blob) to files of their own in the shared folder, from the tasks that made them; where workers find each.

    A folder that all machines mount is mapped in place. Files of other stores are fetched by every machine.
    """
    spark = blobs.sparkSession
    top = f"{common.shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    common.delete_at_exit(spark, top)
    # the text format writes bytes as they are, and one more behind them
    blobs.select(order, F.col("blob").cast("string")).write.partitionBy(order).text(top)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for folder in fs.listStatus(hadoop.Path(top)):
        name = folder.getPath().getName()
        if not name.startswith(f"{order}="):
            continue
        (own,) = [x.getPath() for x in fs.listStatus(folder.getPath()) if x.getPath().getName().startswith("part-")]
        k = int(name.partition("=")[2])
        if fs.getScheme() == "file":
            out[k] = own.toUri().getPath()
        else:
            unique = hadoop.Path(folder.getPath(), f"{uuid.uuid4().hex}.bin")
            fs.rename(own, unique)
            spark.sparkContext.addFile(unique.toString())
            out[k] = unique.getName()
    return out


class Model:
    """What tasks need to score: indexes of the levels' files, and totals."""

    def __init__(self, vocabulary: tuple, total: int, distinct: int):
        self.vocabulary, self.total, self.distinct = vocabulary, total, distinct
        self.bigrams: tuple | None = None
        self.trigrams: tuple | None = None

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def numbered(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of the distinct tokens (-1: unknown), which of them each token is, and its context (their number at a text's start); first tokens."""
        flow, first = tokens(texts)
        unique, which = np.unique(flow, return_inverse=True)
        context = np.roll(which, 1)
        context[first] = len(unique)
        return _vocabulary(self.vocabulary).find(unique), which, context, first

    def paired(self, numbers: np.ndarray, which: np.ndarray, context: np.ndarray, unigram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the number of its pair with the token before (-1: that one is unknown); of the pairs, which ascend as
        bigrams do, log10 probability and bigram (-1: none)."""
        contexts = np.append(numbers, self.distinct)  # ascending but for the unknown, as hashes are
        known = np.flatnonzero(contexts[context] >= 0)
        wide = len(numbers)
        pair, again = np.unique(context[known] * wide + which[known], return_inverse=True)
        of, word = pair // wide, pair % wide
        used, at = np.unique(of, return_inverse=True)
        log10, bigram = _bigrams(self.bigrams).score(contexts[used], at, numbers[word], unigram[word])
        pairs = np.full(len(which), -1, np.int64)
        pairs[known] = again
        return pairs, log10, bigram

    def score(self, texts: list[bytes | None]) -> dict[str, list]:
        if not texts:
            return {k: [] for k in SCORED}
        numbers, which, context, first = self.numbered(texts)
        counts = _vocabulary(self.vocabulary).count(numbers)
        unigram = self.unigram(counts)
        base = unigram[which]
        log10 = base.copy()
        if self.bigrams:
            pairs, of_pair, bigram = self.paired(numbers, which, context, unigram)
            log10[pairs >= 0] = of_pair[pairs[pairs >= 0]]
            before = _before(pairs, first)
            asked = np.flatnonzero((before >= 0) & (bigram[before] >= 0)) if self.trigrams and len(bigram) else ()
            if len(asked):
                wide = len(numbers)
                three, at, again = np.unique(before[asked] * wide + which[asked], return_index=True, return_inverse=True)
                used, of = np.unique(three // wide, return_inverse=True)
                level = _trigrams(self.trigrams, int(_bigrams(self.bigrams).starts[-1]))
                log10[asked] = level.score(bigram[used], of, numbers[three % wide], log10[asked[at]])[again]
        sums = lambda x: np.add.reduceat(x, first).tolist()
        n = np.diff(np.append(first, len(which)))
        return {"n_tokens": n.tolist(), "n_known": sums((counts > 0).astype(np.int64)[which]), "base_score": sums(base), "score": sums(log10)}


def _before(pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each token the pair that ends in the token before; -1 for a text's first token."""
    out = np.roll(pairs, 1)
    out[first] = -1
    return out


SCORED = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}


def _vocabulary_of(rows: DataFrame) -> Model:
    """Level one from rows (_text)."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            word, c = np.unique(np.concatenate(held), return_counts=True)
            for a in range(0, len(word), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(word[a : a + 100_000].view(np.int64)), pa.array(c[a : a + 100_000])], names=["h", "c"])

        for batch in batches:
            for part in common.slices(batch.column(0).to_pylist(), 4):
                held.append(tokens(batch.column(0)[part].to_pylist())[0])
                n += len(held[-1])
                if n > GATHER:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    counts = common.cut(rows.select("_text").mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    segments = 1
    while segments * SEGMENT_WORDS < distinct:
        segments *= 2
    shift = 64 - (segments.bit_length() - 1)

    def build(group: pa.Table) -> pa.Table:
        word, c = group.column("h").to_numpy().view(U), group.column("c").to_numpy()
        order = np.argsort(word)
        blob = EliasFano.build(word[order], (1 << 64) - 1).dump() + c[order].astype(np.uint64).tobytes()
        return pa.table({"k": pa.array([group.column("k")[0].as_py()], pa.int32()), "blob": [blob]})

    k = F.shiftrightunsigned("h", shift).cast("int") if segments > 1 else F.lit(0)
    keyed = counts.select("h", "c", k.alias("k"))
    files = _written(keyed.groupBy("k").applyInArrow(build, "k int, blob binary"), "k")
    index, first = [], 0
    for r in keyed.groupBy("k").agg(F.count("*").alias("n")).orderBy("k").collect():
        index.append((r["k"] << shift if segments > 1 else 0, first, files[r["k"]]))
        first += r["n"]
    common.forget(counts)
    return Model(tuple(index), total, distinct)


def _counted(rows: DataFrame, shards: int, codes: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(k, pairs, counts): distinct codes and their counts, packed, for each shard and GATHER tokens or so; an empty row for each shard.

    codes: of texts, the shard of each n-gram and its code within the shard.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            shard, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if shards > 1:
                order = np.argsort(shard, kind="stable")
                shard, code = shard[order], code[order]
            edge = np.searchsorted(shard, np.arange(shards + 1, dtype=shard.dtype)).tolist()
            for k in range(shards):
                if edge[k] < edge[k + 1]:
                    own, c = np.unique(code[edge[k] : edge[k + 1]], return_counts=True)
                    small = np.minimum(c, 255).astype(np.uint8)
                    large = c[small == 255].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([EliasFano.build(own).dump()]), pa.array([small.tobytes() + large.tobytes()])], names=["k", "pairs", "counts"])

        for batch in batches:
            for part in common.slices(batch.column(0).to_pylist(), 4):
                held.append(codes(batch.column(0)[part].to_pylist()))
                n += len(held[-1][0])
                if n > GATHER:
                    yield from out()
                    n = 0
        if n:
            yield from out()

    found = rows.select("_text").mapInArrow(count, "k int, pairs binary, counts binary")
    empty = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("k"), F.lit(EliasFano.build(np.empty(0, U)).dump()).alias("pairs"), F.lit(b"").alias("counts"))
    return found.union(empty)


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of a shard's rows, and their counts."""
    flat, counts = [], []
    for packed, c in zip(group.column("pairs").to_pylist(), group.column("counts").to_pylist(), strict=True):
        codes, _ = EliasFano.load(np.frombuffer(packed, np.uint8))
        flat.append(codes.get(np.arange(codes.n, dtype=U)))
        own = np.frombuffer(c, np.uint8, codes.n).astype(np.int64)
        own[own == 255] = np.frombuffer(c[codes.n :], np.int64)
        counts.append(own)
    flat = np.concatenate(flat)
    order = np.argsort(flat, kind="stable")
    flat, c = flat[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.diff(flat, prepend=flat[0] + U(1))) if len(flat) else np.empty(0, np.int64)
    return flat[first], np.add.reduceat(c, first) if len(first) else c


def _bigrams_of(rows: DataFrame, model: Model, documents: int, min_count: int) -> None:
    """Level two from rows (_text), added to the model."""
    wide, shards = U(model.distinct + 1), model.total // SEGMENT_PAIRS + 1
    span = -(-(model.distinct + 1) // shards)  # contexts of a segment; word numbers follow hashes, so spans are alike

    def codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
        numbers, which, context, _ = model.numbered(texts)
        before = np.append(numbers, model.distinct)[context]
        return (before // span).astype(np.uint32), (before % span).astype(U) * wide + numbers.astype(U)[which]

    def build(group: pa.Table) -> pa.Table:
        k = group.column("k")[0].as_py()
        flat, c = _merged(group)
        kept = c >= min_count
        flat, c = flat[kept], c[kept]
        context, word = (flat // wide).astype(np.int64), (flat % wide).astype(np.int64)
        n = max(min(span, model.distinct + 1 - k * span), 0)
        numbers = np.arange(k * span, k * span + n)
        vocabulary = _vocabulary(model.vocabulary)
        seen = np.where(numbers < model.distinct, vocabulary.count(np.minimum(numbers, model.distinct - 1)), documents).astype(float)
        gamma = 1 - np.bincount(context, c - DISCOUNT, n) / np.maximum(seen, 1)
        probability = (c - DISCOUNT) / seen[context] + gamma[context] * 10 ** model.unigram(vocabulary.count(word))
        blob = Followers.build(context, word, gamma, probability) + np.packbits(c > 1, bitorder="little").tobytes()
        return pa.table({"k": pa.array([k], pa.int32()), "blob": [blob]})

    files = _written(_counted(rows, shards, codes).groupBy("k").applyInArrow(build, "k int, blob binary"), "k")
    model.bigrams = tuple((k * span, files[k]) for k in sorted(files))


def _trigrams_of(rows: DataFrame, model: Model) -> None:
    """Level three from rows (_text), added to the model.

    A trigram seen twice has both its bigrams seen twice. So only what follows repeated bigrams is counted, and followers that
    don't make a repeated bigram with the word before count as one, REST, which adds up to their context's count only.
    """
    rest, wide, shards = model.distinct, U(model.distinct + 1), model.total // SEGMENT_PAIRS + 1

    def level() -> tuple[Bigrams, int]:
        two = _bigrams(model.bigrams)
        return two, _span(int(two.starts[-1]), shards)

    def codes(texts: list) -> tuple[np.ndarray, np.ndarray]:
        two, span = level()
        numbers, which, context, first = model.numbered(texts)
        pairs, _, bigram = model.paired(numbers, which, context, np.zeros(len(numbers)))
        often = np.zeros(len(bigram), bool)
        often[bigram >= 0] = two.repeated(bigram[bigram >= 0])
        before = _before(pairs, first)
        own = np.flatnonzero((before >= 0) & often[before])
        word = np.where(often[pairs[own]], numbers[which[own]], rest)  # every word before is known here, so each token has a pair
        of = bigram[before[own]]
        return (of // span).astype(np.uint32), (of % span).astype(U) * wide + word.astype(U)

    def build(group: pa.Table) -> pa.Table:
        two, span = level()
        k = group.column("k")[0].as_py()
        flat, c = _merged(group)
        owner, word = (flat // wide).astype(np.int64), (flat % wide).astype(np.int64)
        every, of = np.unique(owner, return_inverse=True)
        seen = np.bincount(of, c, len(every))
        kept = (c >= TRIGRAM_COUNT) & (word != rest)
        c, word = c[kept], word[kept]
        used, context = np.unique(of[kept], return_inverse=True)
        owners, seen = every[used], seen[used]
        gamma = 1 - np.bincount(context, c - DISCOUNT, len(owners)) / seen
        middle = two.words(owners + k * span)[context]
        order = np.lexsort((word, middle))
        unigram = model.unigram(_vocabulary(model.vocabulary).count(word[order]))
        begin, which = np.unique(middle[order], return_inverse=True)
        lower = np.empty(len(word))
        lower[order] = two.score(begin, which, word[order], unigram)[0]
        probability = (c - DISCOUNT) / seen[context] + gamma[context] * 10**lower
        blob = EliasFano.build(owners.astype(U)).dump() + Followers.build(context, word, gamma, probability)
        return pa.table({"k": pa.array([k], pa.int32()), "blob": [blob]})

    files = _written(_counted(rows, shards, codes).groupBy("k").applyInArrow(build, "k int, blob binary"), "k")
    model.trigrams = tuple(files[k] for k in sorted(files))


def train(rows: DataFrame, text_col: str = "text", min_count: int = MIN_COUNT) -> Model:
    """A model of all rows."""
    common.bounded_batches(rows.sparkSession)
    rows = rows.select(F.col(text_col).cast("binary").alias("_text"))
    model = _vocabulary_of(rows)
    if model.distinct:
        _bigrams_of(rows, model, rows.count(), min_count)
        _trigrams_of(rows, model)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df without text_col, with n_tokens, n_known, base_score and score."""
    rows = df.drop("_text").withColumn("_text", F.col(text_col).cast("binary")).drop(text_col)
    return common.add_columns(rows, "_text", SCORED, model.score).drop("_text")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", common.held_out(5, 1).alias("held_out"))
    model = train(docs.filter("not held_out"), min_count=1)
    return score(docs, model).withColumn("train_tokens", F.lit(model.total).cast("long"))


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
