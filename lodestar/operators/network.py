"""Training of the reranker network under the listwise loss (R18): gradients in numpy, epochs in Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rerank import EMBEDDINGS, RerankMLP

#: Numbers of the model's state that travel in one row.
CHUNK = 8192


def gradients(w: dict[str, np.ndarray], numeric: np.ndarray, codes: dict[str, np.ndarray], starts: np.ndarray, label: np.ndarray, query: np.ndarray | None = None, item: np.ndarray | None = None, dropout: float = 0.0, random: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean listwise loss of groups (rows from each of starts on; each has a positive) and its gradient by every weight."""
    asked, offered = w["aff_query"][codes["query_loc"]], w["aff_item"][codes["item_loc"]]
    parts = [numeric, *(w[f"emb_{k}"][codes[k]] for k in EMBEDDINGS), (asked * offered).sum(1, keepdims=True)]
    if "proj_q" in w:
        q, d = query @ w["proj_q"].T + w["proj_q_b"], item @ w["proj_d"].T + w["proj_d_b"]
        parts += [q, d, q * d]
    inputs, masks = [np.concatenate(parts, axis=1)], []
    layers = sum(k[0] == "w" and k[1:].isdigit() for k in w)
    for i in range(layers):
        z = inputs[-1] @ w[f"w{i}"].T + w[f"b{i}"]
        if i < layers - 1:
            mask = (z > 0).astype(z.dtype)
            if dropout:
                mask *= (random.random(z.shape) >= dropout).astype(z.dtype) / (1 - dropout)
            masks.append(mask)
            inputs.append(z * mask)
    s, sizes = z[:, 0], np.diff(np.append(starts, len(z)))
    log_e = s - np.repeat(np.maximum.reduceat(s, starts), sizes)
    log_p = log_e - np.repeat(np.log(np.add.reduceat(np.exp(log_e), starts)), sizes)
    target = label / np.repeat(np.add.reduceat(label, starts), sizes)
    back = ((np.exp(log_p) - target) / len(starts))[:, None].astype(z.dtype)
    out = {}
    for i in reversed(range(layers)):
        out[f"w{i}"], out[f"b{i}"] = back.T @ inputs[i], back.sum(0)
        back = back @ w[f"w{i}"]
        if i:
            back = back * masks[i - 1]
    own = dict(zip(["numeric", *EMBEDDINGS, "affinity", "q", "d", "qd"], np.split(back, np.cumsum([p.shape[1] for p in parts])[:-1], axis=1), strict=False))

    def gathered(name: str, which: np.ndarray, value: np.ndarray) -> None:
        # a product with the codes' indicators where they are few, as it adds faster than add.at
        if len(w[name]) <= 64:
            out[name] = (which == np.arange(len(w[name]))[:, None]).astype(value.dtype) @ value
        else:
            out[name] = np.zeros_like(w[name])
            np.add.at(out[name], which, value)

    for k in EMBEDDINGS:
        gathered(f"emb_{k}", codes[k], own[k])
    gathered("aff_query", codes["query_loc"], own["affinity"] * offered)
    gathered("aff_item", codes["item_loc"], own["affinity"] * asked)
    if "proj_q" in w:
        for name, x, g in (("proj_q", query, own["q"] + own["qd"] * d), ("proj_d", item, own["d"] + own["qd"] * q)):
            out[name], out[f"{name}_b"] = g.T @ x, g.sum(0)
    return float(-(target * log_p).sum() / len(starts)), out


class State:
    """Weights and AdamW's two moments as one vector."""

    def __init__(self, weights: dict[str, np.ndarray], flat: np.ndarray | None = None, step: int = 0):
        self.shapes = {k: v.shape for k, v in weights.items()}
        size = sum(v.size for v in weights.values())
        self.flat = np.concatenate([*(v.ravel() for v in weights.values()), np.zeros(2 * size)]) if flat is None else flat
        self.step = step

    def weights(self) -> dict[str, np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes.values()])
        return {k: x.reshape(s) for (k, s), x in zip(self.shapes.items(), np.split(self.flat[: ends[-1]], ends[:-1]), strict=True)}

    def update(self, gradient: dict[str, np.ndarray], rate: float, decay: float) -> None:
        w, m, v = np.split(self.flat, 3)  # views
        g = np.concatenate([gradient[k].ravel() for k in self.shapes])
        self.step += 1
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w -= rate * decay * w + rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def fit_mlp(df: DataFrame, model: RerankMLP, numeric: Sequence[str], codes: dict[str, str], by: str = "qid", label: str = "label", query_vector: str | None = None, item_vector: str | None = None, epochs: int = 15, rate: float = 1e-3, decay: float = 1e-5, groups: int = 256, dropout: float = 0.1, measure: Callable[[RerankMLP], float] | None = None, patience: int = 2, seed: int = 0) -> tuple[RerankMLP, list[dict]]:
    """The network trained from model's weights on, and (loss, measure) of each epoch.

    In an epoch each task takes AdamW steps over its own groups, so many at a time, in an order drawn anew; the tasks' weights and
    moments are averaged by how many groups each had. With one task that is plain AdamW. With measure (larger is better) the best epoch's
    model is returned and training ends after `patience` epochs without a better one. Groups without a positive teach nothing. Features
    must have no nulls. Steps are in single precision, the model's state in double. A task holds the model and one step's rows; the
    driver holds the model.
    """
    vectors = [c for c in (query_vector, item_vector) if c]
    own = df.select(F.col(by).cast("string").alias("_by"), F.col(label).cast("double").alias("_label"), *(F.col(c).cast("float").alias(f"n{i}") for i, c in enumerate(numeric)), *(F.col(c).cast("int").alias(f"c_{k}") for k, c in codes.items()), *(F.col(c).cast("array<float>").alias(f"v{i}") for i, c in enumerate(vectors)))
    # a group is one row of lists: epochs sort groups, not their rows, and those without a positive are never read again
    packed = own.groupBy("_by").agg(F.collect_list(F.struct(*(c for c in own.columns if c != "_by"))).alias("_rows")).filter(F.exists("_rows", lambda r: r["_label"] > 0))
    data = packed.persist()
    state, best, best_at, history = State(model.weights), (-np.inf, model), 0, []

    def trainer(start: State, epoch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = State(model.weights, start.flat.copy(), start.step)
            random = np.random.default_rng([seed, epoch])
            seen, loss = 0, 0.0

            def learn(lists: pa.ListArray) -> None:
                nonlocal seen, loss
                rows, size = lists.flatten(), np.asarray(lists.value_lengths())
                x = np.column_stack([np.asarray(rows.field(f"n{i}")) for i in range(len(numeric))]) if numeric else np.empty((len(rows), 0), np.float32)
                of = {k: np.asarray(rows.field(f"c_{k}")) for k in codes}
                texts = [np.array(rows.field(f"v{i}").to_pylist(), np.float32) for i in range(len(vectors))]
                first = np.append(0, np.cumsum(size)[:-1])
                single = {k: v.astype(np.float32) for k, v in now.weights().items()}
                value, g = gradients(single, x, of, first, np.asarray(rows.field("_label")), *texts, *([None] * (2 - len(texts))), dropout=dropout, random=random)
                now.update(g, rate, decay)
                seen, loss = seen + len(first), loss + value * len(first)

            held: list[pa.Array] = []
            for batch in batches:
                held.append(batch.column(0))
                if sum(map(len, held)) < groups:
                    continue
                lists = pa.concat_arrays(held)
                whole = len(lists) // groups * groups
                for k in range(0, whole, groups):
                    learn(lists.slice(k, groups))
                held = [lists.slice(whole)] if whole < len(lists) else []
            if held:
                learn(pa.concat_arrays(held))
            if seen:
                for k in range(0, len(now.flat), CHUNK):
                    yield pa.RecordBatch.from_pydict({"k": [k], "n": [float(seen)], "loss": [loss], "step": [now.step], "state": [(now.flat[k : k + CHUNK] * seen).tobytes()]}, schema=TRAINED)

        return run

    def added(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer()) for x in group.column("state")], axis=0)
        sums = {c: [np.sum(group.column(c).to_numpy())] for c in ("n", "loss")}
        return pa.table({"k": [group.column("k")[0].as_py()], **sums, "step": [max(group.column("step").to_pylist())], "state": [total.tobytes()]}, schema=TRAINED)

    schema = "k long, n double, loss double, step long, state binary"
    try:
        for epoch in range(epochs):
            order = data.sortWithinPartitions(F.xxhash64("_by", F.lit(seed), F.lit(epoch)), "_by").select("_rows")
            rows = order.mapInArrow(trainer(state, epoch), schema).groupBy("k").applyInArrow(added, schema).orderBy("k").collect()  # the model's state, once
            if not rows:
                break
            n = rows[0]["n"]
            state = State(model.weights, np.concatenate([np.frombuffer(r["state"]) for r in rows]) / n, rows[0]["step"])
            made = RerankMLP(state.weights())
            value = measure(made) if measure else float(epoch)
            history.append({"epoch": epoch, "loss": rows[0]["loss"] / n, "measure": value if measure else None})
            if value > best[0]:
                best, best_at = (value, made), epoch
            elif epoch - best_at >= patience:
                break
    finally:
        data.unpersist()
    return best[1], history


TRAINED = pa.schema([("k", pa.int64()), ("n", pa.float64()), ("loss", pa.float64()), ("step", pa.int64()), ("state", pa.binary())])

