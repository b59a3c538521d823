"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on the full shingle sets.

1. Each text's set of distinct word shingles is hashed, with a signature of TREES x DEPTH MinHash values. Texts of
   equal sets form a class, whose smallest id stands for it: copies are counted, never paired.
2. The forest: for every tree, classes are sorted by their DEPTH values of that tree. Neighbours in an order whose
   longest common prefix has at least `depths[0]` values are candidates, so whatever shares such a prefix is joined
   by a chain of neighbours: a region of the order. The sort is by range partitions with the id as last key, so a
   region of any size is spread over tasks.
3. Regions that touch are merged to groups (connected components of the candidates). Within a group, links are
   confirmed exactly, on full sets recomputed from the texts: not all pairs, but every pair that could still connect
   two parts of the group (see link_group).
4. A group with more than GROUP_SHINGLES shingles in all is first split with longer common prefixes, and links inside
   the pieces are confirmed. That only orders the work: then whatever isn't in the group's largest confirmed component
   is held, in blocks, against all of the group, so longer prefixes lose no link: exact at any size.

With TREES = 16 and three values, a pair of similarity 0.85 (0.8) is missed with probability 3e-7 (1e-5).

Nulls and texts without words have an empty set and are linked with nothing; a null id is left out of linking. Rows
that repeat an id and text are one class, and each returns. An empty table gives no rows; further columns are carried
by near_copies (own names are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import connected
from .shingles import U, mix, shingle_sets

TREES, DEPTH = 16, 8
DEPTHS = (3, 4, 6, 8)
#: What one task compares at most in a group: so many shingles are 24 MB.
GROUP_SHINGLES = 3_000_000
#: Texts of a group's rest that are always held against the group at once, however long.
BLOCK_TEXTS = 16
FACTORS = mix(np.arange(1, TREES * DEPTH + 1, dtype=U)) | U(1)
SHIFTS = mix(np.arange(1001, 1001 + TREES * DEPTH, dtype=U))


def signature(own: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima of 32-bit hashes of a set."""
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, U)
    for a in range(0, len(own), 256):
        np.minimum(low, ((own[a : a + 256, None] * FACTORS + SHIFTS) >> U(32)).min(0), out=low)
    return low.astype(">u4")  # big-endian: bytes sort as numbers


def _signed(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """_id, n_shingles, _set (digest of the set), _sig for each row; the last two null for an empty set."""

    def kernel(texts: list[bytes | None]) -> dict[str, list]:
        sets = shingle_sets([t or b"" for t in texts], width)
        return {
            "n_shingles": [len(s) for s in sets],
            "_set": [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets],
            "_sig": [signature(s).tobytes() if len(s) else None for s in sets],
        }

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    return common.add_columns(rows, "_text", {"n_shingles": "bigint", "_set": "binary", "_sig": "binary"}, kernel).drop("_text")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of a and b."""
    return np.logical_and.accumulate(a == b, axis=1).sum(1)


def forest_links(reps: DataFrame, depth: int = DEPTHS[0]) -> DataFrame:
    """Candidates (a, b, lcp): neighbours in any tree's order with at least depth common values. reps: _id, _sig."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = batch.num_rows, batch.column(0).to_numpy()
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, TREES, 4 * DEPTH)
            labels = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * DEPTH), n * TREES, [None, pa.py_buffer(np.ascontiguousarray(sigs))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), labels, pa.array(np.repeat(ids, TREES))], names=["tree", "label", "_id"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "lcp", "tree", "label"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        last: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            own = batch.column(1).to_pylist()
            label = np.frombuffer(b"".join(own), ">u4").reshape(-1, DEPTH)
            if last is None:  # this partition's first entry, for its predecessor's last
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((int(ids[0]), None, 0, int(tree[0]), own[0]), kinds, strict=True)], names=names)
            else:
                tree, ids, label = np.append(last[0], tree), np.append(last[1], ids), np.vstack([last[2], label])
            lcp = np.where(tree[1:] == tree[:-1], _common(label[1:], label[:-1]), 0)
            near = np.flatnonzero(lcp >= depth)
            yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(ids[near + 1]), pa.array(lcp[near].astype(np.int32)), pa.nulls(len(near), pa.int32()), pa.nulls(len(near), pa.binary())], names=names)
            last = tree[-1:], ids[-1:], label[-1:], own[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((int(last[1][0]), None, 1, int(last[0][0]), last[3]), kinds, strict=True)], names=names)

    order = ["tree", "label", "_id"]
    entry = common.cut(reps.select("_id", "_sig").mapInArrow(entries, "tree int, label binary, _id long"))
    found = common.cut(entry.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(neighbours, "a long, b long, lcp int, tree int, label binary"))
    common.forget(entry)
    inner = found.filter("tree is null").select("a", "b", "lcp")
    # first and last entries of the partitions, two rows each: a last one's neighbour is the next first one
    ends = found.filter("tree is not null").withColumns({"next": F.lead(F.struct("a", "tree", "label", "lcp")).over(Window.orderBy("tree", "label", "a", "lcp"))})
    shared = F.lit(0)
    for d in range(depth, DEPTH + 1):
        shared = F.when(F.substring("label", 1, 4 * d) == F.substring("next.label", 1, 4 * d), d).otherwise(shared)
    outer = ends.filter("lcp = 1 and next.lcp = 0 and tree = next.tree").select("a", F.col("next.a").alias("b"), shared.cast("int").alias("lcp")).filter("lcp > 0")
    return inner.union(outer).filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("lcp").alias("lcp"))


def link_group(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of each set (a number) under 100 * intersection >= percent * union.

    A pivot is compared with all sets at once. Pivots are all sets outside the largest component: a pair of different
    components has at least one such end, so no connecting link is left untested, and a group of copies of one
    text takes a pivot or two.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    popular = np.add.reduceat(np.bincount(flat)[flat], starts) / sizes
    order = np.argsort(-popular, kind="stable")
    part, tried = np.arange(len(sets)), np.zeros(len(sets), bool)
    mark = np.zeros(flat.max() + 1, bool)
    while True:
        largest = np.bincount(part).argmax()
        open_ = order[~tried[order] & ((part[order] != largest) | (not tried.any()))]
        if not len(open_):
            return part
        p = open_[0]
        tried[p] = True
        own = flat[starts[p] : starts[p] + sizes[p]]
        mark[own] = True
        both = np.add.reduceat(mark[flat].astype(np.int64), starts)
        mark[own] = False
        linked = np.unique(part[100 * both >= percent * (sizes + sizes[p] - both)])
        if len(linked) > 1:
            part[np.isin(part, linked)] = linked.min()


def _exact_groups(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the confirmed components of each group: every member with the smallest of its component. texts: _group, _id, _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(ids: list[int], own: list[np.ndarray]) -> pa.RecordBatch:
            part = link_group(own, percent)
            low: dict[int, int] = {}
            for i, p in zip(ids, part.tolist(), strict=True):
                low[p] = min(i, low.get(p, i))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([low[p] for p in part.tolist()], pa.int64())], names=["a", "b"])

        now, ids, own = None, [], []
        for batch in batches:
            made = []
            column = batch.column(2)
            for part in common.slices(column.to_pylist()):
                made += shingle_sets([t or b"" for t in column[part].to_pylist()], width)
            for g, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), made, strict=True):
                if g != now and ids:
                    yield close(ids, own)
                    ids, own = [], []
                now = g
                ids.append(i)
                own.append(s)
        if ids:
            yield close(ids, own)

    return texts.repartition("_group").sortWithinPartitions("_group").mapInArrow(run, "a long, b long").filter("a <> b")


def _held_against(texts: DataFrame, block: list[tuple[int, int, bytes]], width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what block's members (_group, _id, _text) are linked with in their own groups, on full sets.

    block goes to every task. A task gives each member of texts one link for each part of the block it isn't known to
    join yet, not one for each pair.
    """
    queries: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (g, i, _), s in zip(block, shingle_sets([t for _, _, t in block], width), strict=True):
        queries.setdefault(g, []).append((i, s))
    packed = {}
    for g, own in queries.items():
        sizes = np.array([len(s) for _, s in own], np.int64)
        flat = np.concatenate([s for _, s in own])
        order = np.argsort(flat, kind="stable")
        packed[g] = np.array([i for i, _ in own], np.int64), sizes, flat[order], np.repeat(np.arange(len(own)), sizes)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = {g: np.arange(len(x[0])) for g, x in packed.items()}
        for batch in batches:
            a, b = [], []
            batch = batch.take(pa.array([k for k, g in enumerate(batch.column(0).to_pylist()) if g in packed], pa.int64()))
            sets = shingle_sets([t or b"" for t in batch.column(2).to_pylist()], width)
            for g, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                ids, sizes, values, owner = packed[g]
                low = np.searchsorted(values, s)
                n = np.searchsorted(values, s, side="right") - low
                both = np.bincount(owner[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(ids))
                near = np.flatnonzero(100 * both >= percent * (len(s) + sizes - both))
                part = joined[g]
                linked, first = np.unique(part[near], return_index=True)
                if len(linked) > 1:
                    part[np.isin(part, linked)] = linked[0]
                other = [j for j in ids[near[first]].tolist() if j != i]
                a += [i] * len(other)
                b += other
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return texts.select("_group", "_id", "_text").mapInArrow(run, "a long, b long")


def _whole_links(texts: DataFrame, links: DataFrame, pivots: list[int], width: int, percent: int, block_shingles: int) -> DataFrame:
    """Links that connect the confirmed components of groups too large for one task. texts: _group, _id, _text, n_shingles.

    links are those confirmed so far, inside pieces of the groups. As in link_group, a pair of different components has
    at least one end outside its group's largest component, so such members are held against all of their group, block
    by block, until each is tried or has joined the largest: no pair of a group is left out. First of all come the pivots,
    one for each piece that is itself too large for a task. A block has about block_shingles, and is all that is sent to every task.
    """
    state = common.cut(texts.select("_group", "_id", "n_shingles").distinct().withColumn("_tried", F.lit(False)))
    links = common.cut(links.join(state.select(F.col("_id").alias("a")).distinct(), "a", "left_semi"))
    while True:
        part = connected(links)
        own = state.join(part, state["_id"] == part["node"], "left").withColumn("_part", F.coalesce("component", "_id"))
        most = own.groupBy("_group", "_part").agg(F.sum("n_shingles").alias("s")).groupBy("_group").agg(F.max(F.struct("s", "_part")).alias("_most"))
        own = common.cut(own.join(most, "_group").select("_group", "_id", "n_shingles", "_tried", (~F.col("_tried") & (F.col("_part") != F.col("_most._part"))).alias("_open")))
        common.forget(state, links)
        n, total = own.filter("_open").agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
        if not n:
            return part.select(F.col("node").alias("a"), F.col("component").alias("b"))
        now = own.filter(F.col("_id").isin(pivots)) if pivots else own.filter("_open").orderBy(F.xxhash64("_id"), "_id").limit(max(BLOCK_TEXTS, block_shingles * n // max(total, 1)))
        now = common.cut(now.select("_id").distinct())
        block = [(r["_group"], r["_id"], bytes(r["_text"])) for r in texts.join(common.small(now), "_id", "left_semi").select("_group", "_id", "_text").distinct().collect()]
        seen = common.small(now.select("_id", F.lit(True).alias("_now")))
        state = common.cut(own.join(seen, "_id", "left").select("_group", "_id", "n_shingles", F.coalesce("_now", "_tried").alias("_tried")))
        links = common.cut(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_held_against(texts, block, width, percent)))
        common.forget(own, part, now)
        pivots = []


def near_links(df: DataFrame, signed: DataFrame, id_col: str, text_col: str, width: int, percent: int, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Confirmed links (a, b) that connect classes; signed as _signed gives it. Each class is its smallest id."""
    reps = signed.filter("_set is not null and _id is not null").groupBy("_set").agg(F.min(F.struct("_id", "n_shingles", "_sig")).alias("r")).select("r.*")
    reps = common.cut(reps)
    candidates = common.cut(forest_links(reps))
    weight = reps.select(F.col("_id").alias("node"), "n_shingles")
    text = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))

    def with_text(members: DataFrame) -> DataFrame:
        own = common.small(members.select(F.col("node").alias("_id"), F.col("component").alias("_group"), "n_shingles"))
        # a repeated id may stand for several texts: its class is the one of so many shingles, and one row of it is enough
        return text.join(own, "_id").select("_group", "_id", "_text", "n_shingles")

    links, pending, whole = None, None, None
    for depth in DEPTHS:
        edges = candidates.filter(F.col("lcp") >= depth)
        if pending is not None:
            edges = edges.join(pending.select(F.col("node").alias("a")), "a", "left_semi")
        groups = connected(edges).join(weight, "node")
        large = common.small(common.cut(groups.groupBy("component").agg(F.sum("n_shingles").alias("s")).filter(F.col("s") > group_shingles).select("component")))
        fits = common.cut(groups.join(large, "component", "left_anti"))
        made = _exact_groups(with_text(fits), width, percent)
        links = made if links is None else links.union(made)
        if not large.limit(1).count():
            pending = None
            break
        pending = common.cut(groups.join(large, "component", "left_semi"))
        whole = pending if whole is None else whole
    if whole is None:
        return links
    pivots = [] if pending is None else [r["i"] for r in pending.groupBy("component").agg(F.min_by("node", F.xxhash64("node")).alias("i")).collect()]
    links = common.cut(links)
    return links.union(_whole_links(common.cut(with_text(whole)), links, pivots, width, percent, group_shingles // 4))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """df's rows: id_col, n_shingles, component_id, kept. percent: the least similarity in hundredths, confirmed in whole numbers."""
    signed = common.cut(_signed(df, id_col, text_col, width))
    links = near_links(df, signed, id_col, text_col, width, percent, group_shingles)
    parts = connected(links)
    classes = signed.filter("_set is not null and _id is not null").groupBy("_set").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"))
    # a class of one row that no link reaches needs no entry
    named = classes.join(parts, classes["_rep"] == parts["node"], "left").filter("_n > 1 or component is not null").select("_set", F.coalesce("component", "_rep").alias("_comp"))
    named = common.small(common.cut(named))
    own = F.coalesce("_comp", "_id")
    kind = df.schema[id_col].dataType
    return signed.join(named, "_set", "left").select(F.col("_id").cast(kind).alias(id_col), "n_shingles", own.cast(kind).alias("component_id"), own.eqNullSafe(F.col("_id")).alias("kept"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df without the documents whose component holds a smaller id."""
    gone = common.cut(near_copies(df, id_col, text_col, width, percent).filter("not kept").select(id_col).distinct())
    return df.join(common.small(gone), id_col, "left_anti").select(*df.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(common.table(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
