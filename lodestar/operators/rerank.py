"""Rerankers: preprocessing, vocabularies, scoring, a listwise linear scorer, losses, ensembles, recall."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.numeric import clip
from .profile import order_statistics
from .rank import fractional_rank, gathered, places

# fixed values: features read as logarithms, widths of the embeddings and of the location affinity
LOG_FEATURES = ("geo_dist_km",)
EMBEDDINGS = {"microcat": 16, "category": 8, "query_category": 8, "item_loc": 16, "query_loc": 16}
AFFINITY_DIM = 16


class Preprocessor:
    """Median in place of null, population standard deviation, clipping at 5, a flag for columns that had nulls."""

    def __init__(self, columns: Sequence[str], stats: dict[str, dict] | None = None):
        self.columns, self.stats = list(columns), stats or {}

    def _raw(self, c: str) -> F.Column:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0)))) if c in LOG_FEATURES else x

    def fit(self, df: DataFrame) -> Preprocessor:
        """Medians, then moments with them filled in, over all rows."""
        first = df.agg(*(F.max(self._raw(c).isNull()).alias(f"n{i}") for i, c in enumerate(self.columns))).first()
        middle = {r["name"]: r["values"][0] for r in order_statistics(df, {c: self._raw(c) for c in self.columns}, [0.5]).collect()}
        median = [middle.get(c, 0.0) for c in self.columns]
        filled = [F.coalesce(self._raw(c), F.lit(float(median[i]))) for i, c in enumerate(self.columns)]
        second = df.agg(*(F.avg(x).alias(f"a{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled))).first()
        self.stats = {c: {"median": float(median[i]), "mean": float(second[f"a{i}"] or 0), "std": float(second[f"s{i}"] or 0) or 1.0, "has_nan": bool(first[f"n{i}"])} for i, c in enumerate(self.columns)}
        return self

    def transform(self) -> dict[str, F.Column]:
        out = {}
        for c in self.columns:
            s, x = self.stats[c], self._raw(c)
            out[f"x_{c}"] = clip((F.coalesce(x, F.lit(s["median"])) - s["mean"]) / s["std"], -5, 5)
            if s["has_nan"]:
                out[f"x_{c}_missing"] = x.isNull().cast("double")
        return out

    def to_json(self) -> str:
        return json.dumps({"columns": self.columns, "stats": self.stats}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Preprocessor:
        d = json.loads(text)
        return cls(d["columns"], d["stats"])


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes from 1 in the order of values."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return places(values, [F.col("value")]).withColumnRenamed("place", "code")


def encode(df: DataFrame, column: str, vocab: DataFrame, name: str) -> DataFrame:
    """df with the code of a column's value; 0 for an unknown one."""
    codes = vocab.select(F.col("value").alias(column), F.col("code").alias(name))
    return df.join(codes, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


class RerankMLP:
    """A scorer with embeddings, a location affinity and a text part, in numpy; network.fit_mlp trains it.

    weights: arrays by name: emb_<category>, aff_query, aff_item, proj_q, proj_d (with _b for their biases), w0, b0, w1, b1 ...
    Inputs: numeric, category codes (keys of EMBEDDINGS), query and item vectors.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {k: np.asarray(v, np.float64) for k, v in weights.items()}

    def score(self, numeric: np.ndarray, codes: dict[str, np.ndarray], query: np.ndarray | None = None, item: np.ndarray | None = None) -> np.ndarray:
        w = self.weights
        affinity = (w["aff_query"][codes["query_loc"]] * w["aff_item"][codes["item_loc"]]).sum(1, keepdims=True)
        parts = [numeric, *(w[f"emb_{k}"][codes[k]] for k in EMBEDDINGS), affinity]
        if "proj_q" in w:
            q, d = query @ w["proj_q"].T + w["proj_q_b"], item @ w["proj_d"].T + w["proj_d_b"]
            parts += [q, d, q * d]
        x = np.concatenate(parts, axis=1)
        n = sum(k[0] == "w" and k[1:].isdigit() for k in w)
        for i in range(n):
            x = x @ w[f"w{i}"].T + w[f"b{i}"]
            if i < n - 1:
                x = np.maximum(x, 0)
        return x[:, 0]

    @classmethod
    def random(cls, n_num: int, sizes: dict[str, int], hidden: Sequence[int] = (256, 128), text_in: int = 0, text_dim: int = 64, seed: int = 0) -> RerankMLP:
        r = np.random.default_rng(seed)
        w = {f"emb_{k}": r.normal(0, 0.1, (sizes[k], d)) for k, d in EMBEDDINGS.items()}
        w |= {"aff_query": r.normal(0, 0.1, (sizes["query_loc"], AFFINITY_DIM)), "aff_item": r.normal(0, 0.1, (sizes["item_loc"], AFFINITY_DIM))}
        if text_in:
            w |= {"proj_q": r.normal(0, 0.1, (text_dim, text_in)), "proj_d": r.normal(0, 0.1, (text_dim, text_in)), "proj_q_b": np.zeros(text_dim), "proj_d_b": np.zeros(text_dim)}
        wide = n_num + sum(EMBEDDINGS.values()) + 1 + (3 * text_dim if text_in else 0)
        for i, h in enumerate((*hidden, 1)):
            w |= {f"w{i}": r.normal(0, wide**-0.5, (h, wide)), f"b{i}": np.zeros(h)}
            wide = h
        return cls(w)


def predict(df: DataFrame, model: RerankMLP, numeric: Sequence[str], codes: dict[str, str], query_vector: str | None = None, item_vector: str | None = None, name: str = "score") -> DataFrame:
    """df with the model's score, in Arrow batches. codes: column of each category's code."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
            x = np.column_stack([np.asarray(col(c).to_numpy(zero_copy_only=False), np.float64) for c in numeric]) if numeric else np.empty((batch.num_rows, 0))
            own = {k: np.asarray(col(c).to_numpy(zero_copy_only=False), np.int64) for k, c in codes.items()}
            vectors = [np.array(col(c).to_pylist(), np.float64) if c else None for c in (query_vector, item_vector)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x, own, *vectors))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def listwise_loss(df: DataFrame, by: str = "qid", score: str = "score", label: str = "label") -> DataFrame:
    """(by, loss): softmax over a group's scores against its positives in equal shares; 0 for a group without positives."""
    group = Window.partitionBy(by)
    top = F.max(score).over(group)
    log_p = F.col(score) - top - F.log(F.sum(F.exp(F.col("_s") - F.col("_top"))).over(group))
    target = F.col(label) / F.greatest(F.sum(label).over(group), F.lit(1))
    own = df.withColumns({"_s": F.col(score), "_top": top}).withColumns({"_lp": log_p, "_t": target})
    return own.groupBy(by).agg((-F.sum(F.col("_t") * F.col("_lp"))).alias("loss"))


def packed(df: DataFrame, features: Sequence[str], by: str, label: str) -> DataFrame:
    """(sizes, target, x, groups, nulls): df's groups that have a positive, whole and some thousand rows together; target is a positive's equal share.

    Groups are brought together once, so rounds over them shuffle nothing. Rows with a null feature only count among their
    group's positives, and in nulls. A task holds one block or one group.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    n = len(features)
    own = df.select(F.col(by).alias("_by"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_label"), *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)))

    def block(table: pa.Table) -> pa.RecordBatch:
        key = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        target, x = table.column(1).to_numpy(), np.column_stack([np.ones(table.num_rows), *(table.column(i + 2).to_numpy() for i in range(n))])[:, 1:]
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
        total = np.add.reduceat(target, np.cumsum(sizes) - sizes)
        groups, total = int((total > 0).sum()), np.repeat(total, sizes)
        keep = (total > 0) & ~np.isnan(x).any(1)
        sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
        return pa.RecordBatch.from_pydict({"sizes": [sizes[sizes > 0].tobytes()], "target": [(target[keep] / total[keep]).tobytes()], "x": [x[keep].tobytes()], "groups": [groups], "nulls": [int(((total > 0) & ~keep).sum())]}, schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, need = 0, BLOCK
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < need:
                continue
            table = pa.Table.from_batches(held)
            key = table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            last = int(np.append(-1, np.flatnonzero(key[1:] != key[:-1]))[-1]) + 1  # the last key may go on in the next batch
            if last:
                yield block(table.slice(0, last))
                held, rows = table.slice(last).to_batches(), rows - last
            need = max(BLOCK, 2 * rows)
        if held:
            yield block(pa.Table.from_batches(held))

    return gathered(own, ["_by"]).sortWithinPartitions("_by").mapInArrow(run, "sizes binary, target binary, x binary, groups long, nulls long")


#: Rows of a block of groups, and bins of a feature.
BLOCK, BINS = 8192, 32
PACKED = pa.schema([("sizes", pa.binary()), ("target", pa.binary()), ("x", pa.binary()), ("groups", pa.int64()), ("nulls", pa.int64())])


def _blocks(batches: Iterator[pa.RecordBatch], kinds: Sequence[type]) -> Iterator[list[np.ndarray]]:
    """The arrays of each row, those of empty blocks left out."""
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(len(kinds))), strict=True):
            out = [np.frombuffer(x.as_buffer(), k) for x, k in zip(row, kinds, strict=True)]
            if len(out[0]):
                yield out


def _softmax(score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = np.cumsum(sizes) - sizes
    e = np.exp(score - np.repeat(np.maximum.reduceat(score, first), sizes))
    return e / np.repeat(np.add.reduceat(e, first), sizes)


def _added(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of what part makes of each task's rows; the driver holds one array a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"v": [part(batches).astype(np.float64).tobytes()]})

    return np.sum([np.frombuffer(r["v"]) for r in df.mapInArrow(run, "v binary").collect()], axis=0)


def fit_listwise(df: DataFrame, features: Sequence[str], by: str = "qid", label: str = "label", rounds: int = 60, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a linear scorer under the listwise loss, by gradient descent with Adam; each round is one pass over all groups as packed() has them.

    The network is trained by network.fit_mlp.
    """
    n = len(features)
    data = packed(df, features, by, label).persist()
    w, m, v = (np.zeros(n) for _ in range(3))

    def gradient(w: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(n)
            for sizes, target, x in _blocks(batches, (np.int64, np.float64, np.float64)):
                x = x.reshape(-1, n)
                total += (_softmax(x @ w, sizes) - target) @ x
            return total

        return _added(data.select("sizes", "target", "x"), part)

    try:
        groups = data.agg(F.sum("groups")).first()[0] or 0
        for t in range(1, rounds + 1):
            g = gradient(w) / max(groups, 1) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    finally:
        data.unpersist()
    return w


class Boosted:
    """Regression trees whose outputs add up to a score. A tree is a node: {value}, or {feature, at, left, right}; values <= at go left."""

    def __init__(self, features: Sequence[str], trees: list[dict], importance: Sequence[float]):
        self.features, self.trees, self.importance = list(features), trees, [float(x) for x in importance]

    def score(self) -> F.Column:
        """The score as one expression of the features' columns."""

        def branch(node: dict) -> F.Column:
            if "value" in node:
                return F.lit(float(node["value"]))
            return F.when(F.col(self.features[node["feature"]]) <= node["at"], branch(node["left"])).otherwise(branch(node["right"]))

        return sum((branch(t) for t in self.trees), F.lit(0.0))

    def shares(self, spark) -> DataFrame:
        """(feature, share): what each feature's splits gained, of all gains."""
        total = sum(self.importance) or 1.0
        return spark.createDataFrame([(f, x / total) for f, x in zip(self.features, self.importance, strict=True)], "feature string, share double")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "trees": self.trees, "importance": self.importance}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        d = json.loads(text)
        return cls(d["features"], d["trees"], d["importance"])


def _cuts(data: DataFrame, n: int) -> list[np.ndarray]:
    """At most BINS - 1 cuts of each of the n features of packed data: all values if they are at most BINS, else exact quantiles of all rows.

    Quantiles are found byte by byte of the values' ordered bits, from counts alone; nothing is sorted or shuffled.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * n
        for _, x in _blocks(batches, (np.int64, np.float64)):
            for f, column in enumerate(x.reshape(-1, n).T):
                if len(seen[f]) <= BINS:  # one more than fit says enough
                    seen[f] = np.union1d(seen[f], column + 0.0)[: BINS + 1]
        yield pa.RecordBatch.from_pydict({"v": [v.tobytes() for v in seen]})

    found = data.select("sizes", "x").mapInArrow(distinct, "v binary").collect()  # a task's n rows follow each other
    values = [np.unique(np.concatenate([np.zeros(0), *(np.frombuffer(r["v"]) for r in found[f::n])])) for f in range(n)]
    many = [f for f in range(n) if len(values[f]) > BINS]
    prefix, rest = {f: np.zeros(BINS - 1, np.uint64) for f in many}, {}
    for shift in range(56, -8, -8) if many else ():
        wanted = [np.unique(prefix[f]) for f in many]

        def counts(batches: Iterator[pa.RecordBatch], wanted=wanted, shift=np.uint64(shift)) -> np.ndarray:
            total = [np.zeros(256 * len(w)) for w in wanted]
            for _, x in _blocks(batches, (np.int64, np.float64)):
                x = x.reshape(-1, n)
                for t, f, w in zip(total, many, wanted, strict=True):
                    bits = (x[:, f] + 0.0).view(np.uint64)
                    key = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> shift
                    above = key >> np.uint64(8)
                    at = np.minimum(np.searchsorted(w, above), len(w) - 1)
                    hit = w[at] == above
                    t += np.bincount(at[hit] * 256 + (key[hit] & np.uint64(255)).astype(np.int64), minlength=len(t))
            return np.concatenate(total)

        own = np.split(_added(data.select("sizes", "x"), counts), np.cumsum([256 * len(w) for w in wanted])[:-1])
        for f, w, t in zip(many, wanted, own, strict=True):
            upto = np.cumsum(t.reshape(-1, 256), axis=1)
            if f not in rest:  # the first byte's counts tell how many rows there are
                rest[f] = np.ceil(np.arange(1, BINS) * upto[0, -1] / BINS) - 1
            row = np.searchsorted(w, prefix[f])
            byte = (upto[row] <= rest[f][:, None]).sum(1)
            rest[f] = rest[f] - np.where(byte > 0, upto[row, byte - 1], 0)
            prefix[f] = prefix[f] << np.uint64(8) | byte.astype(np.uint64)
    for f in many:
        key = np.unique(prefix[f])
        values[f] = np.append(np.where(key >> np.uint64(63), key ^ np.uint64(1 << 63), ~key).view(np.float64), np.inf)
    return [v[:-1] for v in values]


def _placed(bins: np.ndarray, levels: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each column's node below the given levels of a tree, numbered from left to right."""
    at, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for feature, last in levels:
        at = 2 * at + ((bins[feature[at], rows] if len(feature) > 1 else bins[feature[0]]) > last[at])
    return at


def _summed(bins: np.ndarray, trees: Sequence[tuple[list, np.ndarray]]) -> np.ndarray:
    """What trees, as (levels, values), give each column of bins."""
    return sum((values[_placed(bins, levels)] for levels, values in trees), np.zeros(bins.shape[1]))


def _grown(data: DataFrame, later: Sequence[tuple[list, np.ndarray]], cuts: Sequence[np.ndarray], depth: int, rate: float, least: int) -> tuple[dict, np.ndarray, tuple[list, np.ndarray]]:
    """(tree, its gains by feature, the same tree for _summed): a regression tree of the gradient, one pass over data a level.

    later: trees that aren't in data's scores yet.

    A split gains by how much it lowers the squares' sum; of equal ones the first feature's lowest stays. A leaf's step is Newton's.
    """
    n = len(cuts)
    root: dict = {}
    nodes, levels, gains, values, sums = [root], [], np.zeros(n), np.zeros(2**depth), [None]
    step = lambda t: float(rate * t[1] / (t[2] + 1e-3))
    for level in range(depth):

        def histograms(batches: Iterator[pa.RecordBatch], size=BINS * len(nodes)) -> np.ndarray:
            total = np.zeros((n, 3, size))
            for sizes, target, score, bins in _blocks(batches, STEPPED):
                bins = bins.reshape(n, -1)
                p = _softmax(score + _summed(bins, later), sizes)
                at, g, h = _placed(bins, levels) * BINS, target - p, p * (1 - p)
                for f in range(n):
                    for i, w in enumerate((None, g, h)):
                        total[f, i] += np.bincount(at + bins[f], w, size)
            return total.ravel()

        made = _added(data.select("sizes", "target", "score", "bins"), histograms).reshape(n, 3, len(nodes), BINS)
        feature, last = np.zeros(len(nodes), np.int64), np.full(len(nodes), BINS)  # a leaf's rows all go left
        below, inner = [], []
        for i, node in enumerate(nodes):
            upto = np.cumsum(made[:, :, i], axis=2)
            whole = upto[0, :, -1]
            best, gain = None, 1e-10 * whole[1] ** 2 / max(whole[0], 1)  # no more than rounding can make
            for f in range(n) if node is not None else ():
                left, right = upto[f, :, : len(cuts[f])], upto[f, :, -1:] - upto[f, :, : len(cuts[f])]
                fits = np.flatnonzero((left[0] >= max(least, 1)) & (right[0] >= max(least, 1)))
                if len(fits):
                    own = left[1, fits] ** 2 / left[0, fits] + right[1, fits] ** 2 / right[0, fits] - whole[1] ** 2 / whole[0]
                    if own.max() > gain:
                        best, gain = (f, int(fits[own.argmax()])), own.max()
            if best is None:
                if node is not None:
                    node["value"] = values[i << (depth - level)] = step(whole if sums[i] is None else sums[i])
                below, inner = [*below, None, None], [*inner, None, None]
                continue
            f, j = best
            gains[f] += gain
            feature[i], last[i] = f, j
            node |= {"feature": f, "at": float(cuts[f][j]), "left": {}, "right": {}}
            below, inner = [*below, node["left"], node["right"]], [*inner, upto[f, :, j], upto[f, :, -1] - upto[f, :, j]]
        levels, nodes, sums = [*levels, (feature, last)], below, inner
    for i, node in enumerate(nodes):
        if node is not None:
            node["value"] = values[i] = step(sums[i])
    return root, gains, (levels, values)


#: Arrays of a row of what _grown reads.
STEPPED = (np.int64, np.float64, np.float64, np.uint8)


def fit_boosted(df: DataFrame, features: Sequence[str], by: str = "qid", label: str = "label", rounds: int = 20, depth: int = 3, rate: float = 0.3, least: int = 20) -> Boosted:
    """Gradient boosting under the listwise loss: each round's tree is fitted to the loss's gradient at the scores so far.

    Groups are packed once and features cut into bins once; trees are grown on histograms of all rows' bins, a pass over all groups a
    level, and passes shuffle nothing. Each leaf's step is Newton's, from the sums of its rows. Groups without a positive teach
    nothing. features must have no nulls. depth is 1 or more.
    """
    n, every = len(features), max(1, round((rounds / depth) ** 0.5))
    data = packed(df, features, by, label).persist()
    kept, trees, later = [data], [], []
    model = Boosted(features, [], np.zeros(n))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sizes, target, x in _blocks(batches, (np.int64, np.float64, np.float64)):
            own = [np.searchsorted(c, v).astype(np.uint8) for c, v in zip(cuts, x.reshape(-1, n).T, strict=True)]
            yield pa.RecordBatch.from_pydict({"sizes": [sizes.tobytes()], "target": [target.tobytes()], "score": [np.zeros(len(target)).tobytes()], "bins": [np.concatenate(own).tobytes()]})

    schema = "sizes binary, target binary, score binary, bins binary"
    try:
        if data.agg(F.sum("nulls")).first()[0]:
            raise ValueError("fit_boosted: features have nulls")
        cuts = _cuts(data, n)
        base = scored = data.select("sizes", "target", "x").mapInArrow(binned, schema).persist()
        kept.append(base)
        for t in range(rounds):
            tree, gains, made = _grown(scored, later, cuts, depth, rate, least)
            data.unpersist()  # base was read whole by now
            model.trees.append(tree)
            model.importance = [a + float(b) for a, b in zip(model.importance, gains / (gains.sum() or 1.0), strict=True)]
            trees, later = [*trees, made], [*later, made]
            if len(later) == every and t + 1 < rounds:
                # always from base: each table made from the last one would nest all plans before it

                def summed(batches: Iterator[pa.RecordBatch], trees=trees) -> Iterator[pa.RecordBatch]:
                    for sizes, target, score, bins in _blocks(batches, STEPPED):
                        yield pa.RecordBatch.from_pydict({"sizes": [sizes.tobytes()], "target": [target.tobytes()], "score": [(score + _summed(bins.reshape(n, -1), trees)).tobytes()], "bins": [bins.tobytes()]})

                if scored is not base:
                    kept.pop().unpersist()
                scored, later = base.mapInArrow(summed, schema).persist(), []
                kept.append(scored)
    finally:
        for x in kept:
            x.unpersist()
    return model


def ensemble(df: DataFrame, scores: Sequence[str], by: Sequence[str] = ("qid",), name: str = "score") -> DataFrame:
    """Sum of the scores' fractional ranks within each query. Sorts of all scores run in one task, so its rows are bounded."""
    df = gathered(df, by)
    return df.withColumn(name, sum((fractional_rank(s, by) for s in scores), F.lit(0.0)))


def top_k_recall(df: DataFrame, score: str, n_pos: DataFrame, k: int, by: str = "qid", item: str = "item_idx", label: str = "label") -> DataFrame:
    """(by, recall): share of all the event's positives among its k best; events without candidates get 0."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item))
    found = df.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(by).agg(F.sum(label).alias("_hit"))
    return n_pos.join(found, by, "left").select(by, (F.coalesce("_hit", F.lit(0)) / F.col("n_pos")).alias("recall"))


def report(per_event: DataFrame, part: str, region: str, measures: Sequence[str], baseline: str | None = None) -> DataFrame:
    """(part, region, n, means, uplift of each over the baseline in points): by part, and by part and region, in one pass (grouping sets)."""
    means = [F.avg(m).alias(m) for m in measures]
    both = per_event.rollup(part, region).agg(F.count("*").alias("n"), F.grouping(part).alias("_p"), F.grouping(region).alias("_r"), *means).filter("_p = 0")
    name = F.when(F.col("_r") == 1, "all").when(F.col(region).cast("boolean"), "region").otherwise("city")
    up = {f"uplift_{m}": (F.col(m) - F.col(baseline)) * 100 for m in measures if baseline and m != baseline}
    return both.select(part, name.alias("area"), "n", *measures).withColumns(up)
