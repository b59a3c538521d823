"""Byte-pair encoding and decoding by a table of distinct words.

A word is a run without white space: no token spans white space in the tokenizers this is for (checked when one is
loaded), so a text's encoding is that of its words, joined.

1. Each task splits its documents, block by block of some MB. A block leaves its distinct words, dealt into buckets
   by a hash, and its documents as positions in the block's own word list, compressed.
2. Each bucket gathers its words of all blocks, encodes each distinct one once, and answers every block.
3. Answers join their block; documents take their words' ids by position, and their pieces from the vocabulary, which
   every task has: its size is that of the tokenizer's file. decode() does the same for any table of ids by a join of ids with
   pieces. encode() doesn't use that join: rows of distinct ids by block and bucket grow faster than the input (see README).

The input is read twice, for words and for positions, and must give the same rows in the same order (as files do;
anything else is told and should be written to a table first). So a text is never shuffled, and a word is shuffled once for each block, whatever its frequency. No task
holds more than a block or a bucket, and both are sized to the input.

A null text counts as empty: no tokens. A text of any length is encoded whole, in a block of its own if need be. Repeated rows
return each, alike; an empty table gives no rows; of further columns none is carried, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of text that a block holds at most (or one longer text), that a bucket answers for, and documents of a chunk.
BLOCK_BYTES, BUCKET_BYTES, CHUNK = 12 << 20, 32 << 20, 256
#: str.split() also splits at these, which are no white space for the tokenizers library.
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
EMIT = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}
ARROW = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32()), "string": pa.string()}


@functools.lru_cache(4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if t.encode("a  b", add_special_tokens=False).ids != t.encode("a", add_special_tokens=False).ids + t.encode("b", add_special_tokens=False).ids or t.decoder is not None:
        raise ValueError(f"{path}: for tokenizers that drop white space and have no decoder")
    return t


@functools.lru_cache(4)
def special(path: str) -> re.Pattern | None:
    """Finds a tokenizer's added tokens, in any case: a word that holds one must not be folded before it is encoded."""
    added = sorted(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    return re.compile("|".join(map(re.escape, added)), re.I) if added else None


def split_words(text: str | None) -> list[str]:
    """The words of a text in order."""
    if not text:
        return []
    if any(c in text for c in SEPARATORS):
        return [w for w in SPACE.split(text) if w]
    return text.split()


class Index(dict):
    """Numbers for keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.uint32, len(keys))


def packed(x: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def text_blob(words: list[str]) -> tuple[bytes, int]:
    raw = "\n".join(words).encode()
    return pa.compress(raw, "zstd", asbytes=True), len(raw)


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece), all of the tokenizer: its size is fixed by its file."""
    t = tokenizer(path)
    return spark.createDataFrame(sorted((i, p) for p, i in t.get_vocab(with_added_tokens=True).items()), "id int, piece string")


def decode(df: DataFrame, path: str, key: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """key and the decoded text of each row's ids, by a join of single ids with the vocabulary. key must tell rows apart; a null or empty list gives ''."""
    pieces = F.broadcast(vocabulary(df.sparkSession, path))
    single = df.select(key, F.posexplode_outer(ids_col).alias("pos", "id")).join(pieces, "id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "piece"))))
    return single.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias(text_col))


def _blocks(df: DataFrame, id_col: str, text_col: str, buckets: int, folds: str | None, want_docs: bool) -> DataFrame:
    """folds: a tokenizer's file if it doesn't tell capitals from small letters. Either a block's documents (ids, lens, blob of positions), or its words by bucket (lens: how many, bytes; blob of words, at: their positions).

    A block's name holds a checksum of its word list, so both readings are sure to speak of the same positions.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = "block string, bucket int, ids array<" + kind + ">, lens array<int>, blob binary, at binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0
        index, docs, held, id_type = Index(), [], 0, None

        def row(name: str, bucket: int | None, ids: list, lens: list[int], blob: bytes, at: bytes) -> pa.RecordBatch:
            values = [pa.array([name]), pa.array([bucket], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([lens], pa.list_(pa.int32())), pa.array([blob], pa.binary()), pa.array([at], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["block", "bucket", "ids", "lens", "blob", "at"])

        def close() -> Iterator[pa.RecordBatch]:
            # capitals of plain words don't matter to a tokenizer that lowers them, but special tokens' strings do
            lower, added = Index(), special(folds) if folds else None
            to = lower.numbers([w.lower() if folds and w.isascii() and not (added and added.search(w)) else w for w in index])
            name = f"{part}-{turn}-{zlib.crc32(chr(10).join(lower).encode())}-{len(docs)}"
            for a in range(0, len(docs) if want_docs else 0, CHUNK):
                own = docs[a : a + CHUNK]
                yield row(name, None, [i for i, _ in own], [len(x) for _, x in own], packed(to[np.concatenate([x for _, x in own])] if len(to) else np.empty(0, np.uint32)), b"")
            by: dict[int, list[str]] = {}
            for w in () if want_docs else lower:
                by.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
            for k, words in by.items():
                words.sort()
                blob, n = text_blob(words)
                yield row(name, k, [], [len(words), n], blob, packed(lower.numbers(words)))

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append((i, index.numbers(split_words(text))))
                held += len(text or "")
                if held > BLOCK_BYTES:
                    yield from close()
                    index, docs, held, turn = Index(), [], 0, turn + 1
        if docs:
            yield from close()

    return df.select(id_col, text_col).mapInArrow(run, schema)


def _answers(words: DataFrame, path: str) -> DataFrame:
    """(block, lens, blob, at): numbers of ids of each word, the ids, and the words' positions in the block."""

    def run(bucket: pa.Table) -> pa.Table:
        asked, table = [], Index()
        for blob, lens in zip(bucket.column("blob").to_pylist(), bucket.column("lens").to_pylist(), strict=True):
            asked.append(table.numbers(pa.decompress(blob, lens[1], "zstd", asbytes=True).decode().split("\n")))
        # each distinct word once
        distinct, encoded = list(table), []
        for a in range(0, len(distinct), 4096):  # the library's own objects are large
            encoded += [np.array(e.ids, np.uint32) for e in tokenizer(path).encode_batch_fast(distinct[a : a + 4096], add_special_tokens=False)]
        size = np.array([len(x) for x in encoded], np.int64)
        flat, start = np.concatenate(encoded), np.cumsum(size) - size
        blobs, sizes = [], []
        for own in asked:
            n = size[own]
            at = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            blobs.append(packed(np.append(n, flat[at])))
            sizes.append([len(n), int(n.sum())])
        return pa.table({"block": bucket.column("block"), "lens": pa.array(sizes, pa.list_(pa.int32())), "blob": pa.array(blobs, pa.binary()), "at": bucket.column("at")})

    return words.groupBy("bucket").applyInArrow(run, "block string, lens array<int>, blob binary, at binary")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", emit: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """id_col and the outputs named in emit (keys of EMIT) for each row of df. path: a tokenizer file of the tokenizers library, at the same place on all machines."""
    if not set(emit) <= set(EMIT):
        raise ValueError(f"emit: of {sorted(EMIT)}")
    common.bounded_batches(df.sparkSession)
    folds = path if tokenizer(path).encode("A", add_special_tokens=False).ids == tokenizer(path).encode("a", add_special_tokens=False).ids else None
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = functools.partial(_blocks, df, id_col, text_col, total // BUCKET_BYTES + 1, folds)
    answers = _answers(blocks(False).select("block", "bucket", "lens", "blob", "at"), path)
    docs = blocks(True).select("block", "ids", "lens", "blob")
    want = list(emit)
    texts = bool({"decoded", "decoded_sha256"} & set(want))
    pieces: dict[int, str] = {i: piece for piece, i in tokenizer(path).get_vocab(with_added_tokens=True).items()} if texts else {}

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        sizes = answers.column("lens").to_pylist()
        n = sum(x[0] for x in sizes)
        if not docs.num_rows or (not n and any(map(sum, docs.column("lens").to_pylist()))):
            raise ValueError("the input gave other rows, or another order, when it was read again: write it to a table first")
        count, ids, decoded = np.zeros(n, np.int64), [""] * n, [""] * n
        for blob, (words, tokens), at in zip(answers.column("blob").to_pylist(), sizes, answers.column("at").to_pylist(), strict=True):
            numbers, places = unpacked(blob, words + tokens), unpacked(at, words)
            count[places] = numbers[:words]
            flat, a = numbers[words:].tolist(), 0
            for place, m in zip(places.tolist(), numbers[:words].tolist(), strict=True):
                own = flat[a : a + m]
                a += m
                ids[place] = " ".join(map(str, own))
                if texts:
                    decoded[place] = " ".join([pieces[i] for i in own])
        columns: dict[str, list] = {k: [] for k in want}
        blank = bool((count == 0).any())
        for lens, blob in zip(docs.column("lens").to_pylist(), docs.column("blob").to_pylist(), strict=True):
            flow, a = unpacked(blob, sum(lens)), 0
            for m in lens:
                own = flow[a : a + m]
                a += m
                if blank:
                    own = own[count[own] > 0]
                at = own.tolist()
                digits = " ".join([ids[i] for i in at])
                text = " ".join([decoded[i] for i in at]) if texts else ""
                for k in want:
                    columns[k].append(
                        int(count[own].sum()) if k == "n_tokens"
                        else hashlib.sha256(digits.encode()).hexdigest() if k == "ids_sha256"
                        else np.array(digits.split(), np.int32) if k == "ids"
                        else text if k == "decoded"
                        else hashlib.sha256(text.encode()).hexdigest()
                    )
        own_ids = pa.concat_arrays([x for c in docs.column("ids").chunks for x in [c.flatten()]]) if docs.num_rows else pa.array([], docs.schema.field("ids").type.value_type)
        return pa.table([own_ids, *(pa.array(columns[k], ARROW[EMIT[k]]) for k in want)], names=[id_col, *want])

    kind = df.schema[id_col].dataType.simpleString()
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{k} {EMIT[k]}" for k in want)]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), emit=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE_SQL: dict[str, str] = {}
