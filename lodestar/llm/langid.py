"""Language identification by hierarchical discrimination.

Texts become hashed counts of byte 2-, 3- and 4-grams (lower case, all but letters blanked), square-rooted and
scaled to length one, over the whole text. A first layer of linear support vector machines tells language families
apart, a second, one-versus-one within the family, the closely related languages. Each machine's margin becomes a
probability; the score is that of the family times that of the language, times the share of the text's byte pairs that
rows of that language (one in a hundred at least) have, too: a text of no learned language has a low score.

Machines are fitted to at most `per_language` labelled rows of each language (and of each family as many in all, shared
by its languages), chosen by a hash of their id: each machine by one task, which gets the sparse features of its two sides;
the driver holds counts by language and the weights. With k languages the machines are at most k (k - 1) / 2. Predictions
run over Arrow batches. A null text, or one without a letter, is `und` with score 0; so is every text if there was nothing
to learn from. Ties go to the first language by
name; texts of any length are read whole, in stretches. Columns of the input are carried (columns named as the new ones
are replaced); repeated rows are predicted each, alike; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of each n-gram order's hash space.
BITS = 12
ORDERS = (2, 3, 4)
DIMS = len(ORDERS) << BITS
#: Bound on the rows of each language that the machines are fitted to.
PER_LANGUAGE = 600

# --- fixed values: families of ISO 639-1 codes; a code that isn't listed is a family of its own ---------------
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "indo-aryan": ("hi", "bn", "mr", "pa", "gu", "ur"),
    "turkic": ("tr", "az", "kk", "uz"),
}
# -------------------------------------------------------------------------------------------------------------
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
LETTER = re.compile(r"[^\W\d_]")
#: Blanks ASCII bytes that are no letters.
BLANK = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def features(texts: list[str]) -> np.ndarray:
    """One row of DIMS floats for each text."""
    data = [x.lower().encode("utf-8", "replace").translate(BLANK) for x in texts]
    out = np.zeros((len(data), DIMS), np.float32)
    for i, own in enumerate(data):
        for a in range(0, len(own), 1 << 20):  # long texts in stretches that overlap by the longest order less one
            x = np.frombuffer(b" " + own[a : a + (1 << 20) + 3] + b" ", np.uint8).astype(np.uint32)
            last = len(own) - a <= (1 << 20) + 3
            for k, n in enumerate(ORDERS):
                code = x[: len(x) - n + 1].copy()
                for j in range(1, n):
                    code = (code << np.uint32(8)) | x[j : len(x) - n + 1 + j]
                if not last:
                    code = code[: 1 << 20]
                code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
                out[i, k << BITS : (k + 1) << BITS] += np.bincount(code, minlength=1 << BITS)
            if last:
                break
    # blanks alone say nothing of the language
    np.sqrt(out, out=out)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-9)[:, None]
    return out


@dataclass
class Machine:
    """A linear machine for `yes` against `no`, with the slope that makes a probability of its margin."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float
    slope: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias), -30, 30)))


def fit_machine(yes: str, no: str, x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> Machine:
    """Squared hinge loss with classes of equal weight, by accelerated gradient descent. y: 1 or -1."""
    each = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds):
        margin = y * (x @ ahead[:-1] + ahead[-1])
        pull = -2 * each * y * np.maximum(0, 1 - margin)
        grad = np.append(x.T @ pull + penalty * ahead[:-1], pull.sum()).astype(np.float32)
        new = ahead - grad / 4.1  # rows have length one, so 4 and the penalty bound the curvature
        ahead, w = new + k / (k + 3) * (new - w), new
    margin = y * (x @ w[:-1] + w[-1])
    slopes = np.geomspace(0.5, 20, 30)
    loss = [float((each * np.logaddexp(0, -a * margin)).sum()) for a in slopes]
    return Machine(yes, no, w[:-1], float(w[-1]), float(slopes[int(np.argmin(loss))]))


def _vote(machines: list[Machine], names: list[str], x: np.ndarray) -> np.ndarray:
    """Mean probability of each name over its duels; columns as names."""
    if len(names) == 1:
        return np.ones((len(x), 1))
    out = np.zeros((len(x), len(names)))
    at = {n: i for i, n in enumerate(names)}
    for m in machines:
        p = m.probability(x)
        out[:, at[m.yes]] += p
        out[:, at[m.no]] += 1 - p
    return out / (len(names) - 1)


@dataclass
class Model:
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]
    #: By language: which places of byte pairs its rows have.
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, x in enumerate(texts) if x and LETTER.search(x)] if self.families else []
        for a in range(0, len(rows), 256):
            own = rows[a : a + 256]
            x = features([texts[i] for i in own])
            names = list(self.families)
            votes = _vote(self.between, names, x)
            best = votes.argmax(1)
            for f in set(best.tolist()):
                mine = np.flatnonzero(best == f)
                members = self.families[names[f]]
                inner = _vote(self.within[names[f]], members, x[mine])
                top = inner.argmax(1)
                for j, t, p in zip(mine.tolist(), top.tolist(), (inner.max(1) * votes[mine, f]).tolist(), strict=True):
                    langs[own[j]], scores[own[j]] = members[t], p * self.familiar(members[t], x[j])
        return {"lang_pred": langs, "score": scores}

    def familiar(self, lang: str, x: np.ndarray) -> float:
        """Share of a text's byte pairs that rows of the language have, too: machines only tell learned languages apart."""
        if lang not in self.seen:
            return 1.0
        pairs = x[: 1 << BITS] ** 2
        return float(min(1.0, pairs[self.seen[lang]].sum() / max(float(pairs.sum()), 1e-9)))


def families_of(langs: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        out.setdefault(FAMILY_OF.get(code, code), []).append(code)
    return out


def duels(families: dict[str, list[str]]) -> list[tuple[str, str, bool]]:
    """All machines to fit: two names, and whether they are families."""
    out = [(a, b, True) for a, b in itertools.combinations(families, 2)]
    return out + [(a, b, False) for own in families.values() for a, b in itertools.combinations(own, 2)]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """labelled: rows to learn from; those without language or letter are left out."""
    labelled = labelled.filter(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not counts:
        return Model({}, [], {})
    spark = labelled.sparkSession
    space = 1 << 30
    # a tenth more than the bound, so that rows without letters leave enough
    bound = spark.createDataFrame([(k, min(space, int(1.1 * per_language / n * space) + 1)) for k, n in counts.items()], "_l string, _bound bigint")
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(space))
    chosen = labelled.select(order.alias("_o"), F.col(lang_col).cast("string").alias("_l"), F.col(text_col).alias("_t")).join(common.small(bound), "_l").filter("_o < _bound").select("_o", "_l", "_t")

    def kernel(texts: list[str | None]) -> dict[str, list]:
        ok = [bool(x and LETTER.search(x)) for x in texts]
        own = features([x for x, k in zip(texts, ok, strict=True) if k]).astype(np.float16)
        made = iter([(np.flatnonzero(x).astype(np.uint16).tobytes(), x[x > 0].tobytes()) for x in own])
        pairs = [next(made) if k else (None, None) for k in ok]
        return {"_at": [x for x, _ in pairs], "_x": [x for _, x in pairs]}

    rows = common.cut(common.add_columns(chosen, "_t", {"_at": "binary", "_x": "binary"}, kernel).filter("_x is not null").select("_o", "_l", "_at", "_x"))

    def support(group: pa.Table) -> pa.Table:
        own, least = np.zeros(DIMS, np.int64), group.num_rows // 100
        for at in group.column("_at").to_pylist():
            own[np.frombuffer(at, np.uint16)] += 1
        return pa.table({"l": group.column("_l")[:1], "seen": [np.packbits(own[: 1 << BITS] > least).tobytes()]})

    seen = {r["l"]: np.unpackbits(np.frombuffer(bytes(r["seen"]), np.uint8)).astype(bool) for r in rows.groupBy("_l").applyInArrow(support, "l string, seen binary").collect()}
    families = families_of(list(seen))
    every = duels(families)
    if not every:
        common.forget(rows)
        return Model(families, [], {f: [] for f in families}, seen)
    # (machine, its side, rows of a language that it may see)
    share = lambda f: -(-per_language // len(families[f]))
    sides = []
    for k, (a, b, between) in enumerate(every):
        for side, name in ((1, a), (-1, b)):
            for lang in families[name] if between else [name]:
                sides.append((k, side, lang, share(name) if between else per_language))
    plan = spark.createDataFrame(sides, "_k int, _side int, _l string, _most int")

    def fit(group: pa.Table) -> pa.Table:
        own = sorted(zip(*(group.column(c).to_pylist() for c in ("_l", "_o", "_at", "_x", "_side", "_most")), strict=True))
        own = [r for _, rows in itertools.groupby(own, key=lambda r: r[0]) for n, r in enumerate(rows) if n < r[5]]
        x, y = np.zeros((len(own), DIMS), np.float32), np.array([r[4] for r in own], np.float32)
        for i, r in enumerate(own):
            x[i, np.frombuffer(r[2], np.uint16)] = np.frombuffer(r[3], np.float16)
        k = group.column("_k")[0].as_py()
        m = fit_machine(every[k][0], every[k][1], x, y)
        return pa.table({"k": pa.array([k], pa.int32()), "weights": [m.weights.astype(np.float32).tobytes()], "bias": [m.bias], "slope": [m.slope]})

    fitted = rows.join(common.small(plan), "_l").groupBy("_k").applyInArrow(fit, "k int, weights binary, bias double, slope double").collect()
    common.forget(rows)
    machines = {r["k"]: Machine(*every[r["k"]][:2], np.frombuffer(bytes(r["weights"]), np.float32), r["bias"], r["slope"]) for r in fitted}
    within = {f: [machines[k] for k, (a, _, between) in enumerate(every) if not between and a in own] for f, own in families.items()}
    return Model(families, [machines[k] for k, (_, _, between) in enumerate(every) if between], within, seen)


def identify(df: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """df with two columns of these names: the language and its score."""
    lang, score = names
    return common.add_columns(df, text_col, {lang: "string", score: "double"}, lambda texts: dict(zip(names, model.predict(texts).values(), strict=True)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = common.held_out(3, 1)
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
