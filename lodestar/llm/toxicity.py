"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters look at a whole text and either fire or abstain: words of a small English lexicon, words and word beginnings
mined from labelled rows (inflected insults of any language share a beginning), patterns of writing, and the given label,
whose errors are estimated like the others'. The label model treats the true label as hidden: given it, voters form a tree of
dependences (Chow and Liu's: the strongest correlations that the label leaves unexplained), and each voter's rate of firing
depends on the label and on its parent in the tree. Expectation-maximisation estimates tree and rates. A logistic
regression on the text (its distinct words and their beginnings, hashed to 2^BITS places, and what voters find) is then
fitted to the posterior labels, so words that no voter has can make a text toxic.

Mining and fitting read at most about `sample` labelled rows of each label, chosen by a hash of their id; the fit is one task.
Scores need the text alone, and all of it, however long. A null or empty text has the score of no features; all texts have
score 0 if there are no labels of both kinds. Several labels of one document: the highest counts; rows that repeat a
labelled id are learned from each. Mined features of equal weight go by their spelling, equal rows of the sample are
alike. Columns are carried (those named as the new ones are replaced); repeated rows are scored each, alike; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# --- fixed values: common English insults -----------------------------------------------------------------------
LEXICON = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile",
    "fool", "jerk", "garbage", "filth", "vermin", "pig", "hate", "shut", "ugly", "coward",
)
# ----------------------------------------------------------------------------------------------------------------
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Bound on the labelled rows of each label that are read, and on mined voters of each kind (words, beginnings).
SAMPLE, MINED = 6_000, 96
#: A mined voter fires on that many toxic rows at least, and that much oftener (log odds) there than on clean ones.
LEAST_ROWS, LEAST_ODDS = 4, 2.5
THRESHOLD = 0.3
#: Bits of the classifier's hash space, and lengths of the word beginnings that it sees besides whole words.
BITS, STEMS, VOTE = 16, (3, 4, 5, 6, 7), 3
PATTERNS = ("shouting", "exclaiming", "addressing")


def parts(text: str) -> tuple[set[str], dict[int, set[str]]]:
    words = set(WORD.findall(text.lower()))
    return words, {n: {w[:n] for w in words if len(w) >= n} for n in PREFIXES}


def patterns(text: str) -> list[bool]:
    """More capitals than small letters; many exclamation marks; a second person next to an exclamation."""
    lower, upper = (sum(map(text.count, x)) for x in (common.LOWER, common.UPPER))
    marks = text.count("!")
    return [upper > max(10, lower), marks > 3 and marks * 50 > len(text), marks > 0 and bool(re.search(r"\byou\b[^.]{0,40}!", text, re.I))]


@dataclass
class Voters:
    words: list[str] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.at_word = {w: i for i, w in enumerate(self.words)}
        self.at_start = {w: len(self.words) + i for i, w in enumerate(self.starts)}
        self.set_word = set(self.words)
        self.set_start = {n: {w for w in self.starts if len(w) == n} for n in PREFIXES}

    def __len__(self) -> int:
        return len(self.words) + len(self.starts) + len(PATTERNS)

    def fired(self, text: str | None) -> list[int]:
        """Numbers of the voters that fire."""
        if not text:
            return []
        words, starts = parts(text)
        out = [self.at_word[w] for w in words & self.set_word]
        for n in PREFIXES:
            out += [self.at_start[w] for w in starts[n] & self.set_start[n]]
        return out + [len(self) - len(PATTERNS) + i for i, yes in enumerate(patterns(text)) if yes]

    def places(self, word: str) -> list[int]:
        """Where the classifier counts a word that voters have, behind the hashed places: a voter is worth VOTE other features."""
        own = [self.at_word[word]] if word in self.set_word else []
        own += [self.at_start[word[:n]] for n in PREFIXES if word[:n] in self.set_start[n]]
        return [(1 << BITS) + i for i in own] * VOTE

    def marks(self, text: str | None) -> list[int]:
        """The same for patterns of writing."""
        return [(1 << BITS) + len(self) - len(PATTERNS) + i for i, yes in enumerate(patterns(text or "")) if yes] * VOTE

    def matrix(self, fired: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(fired), len(self)), np.float32)
        for i, own in enumerate(fired):
            out[i, own] = 1
        return out


def dependence_tree(votes: np.ndarray, post: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """Each voter's parent: the tree of largest mutual information between voters given the label (-1: the root)."""
    m = votes.shape[1]
    info = np.zeros((m, m))
    for own in (post, 1 - post):
        n = own.sum() + 4 * smooth
        both = (votes.T * own) @ votes + smooth
        one = own @ votes + 2 * smooth
        for a, b, joint in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, n - one[:, None] - one[None, :] + both)):
            p = (one if a else n - one)[:, None] * (one if b else n - one)[None, :]
            info += joint * np.log(np.maximum(joint * n / p, 1e-12))
    parent, best = np.full(m, -1), info[0].copy()
    source, out = np.zeros(m, int), np.arange(m) > 0
    while out.any():  # Prim's algorithm
        i = int(np.where(out, best, -np.inf).argmax())
        parent[i], out[i] = source[i], False
        nearer = out & (info[i] > best)
        best[nearer], source[nearer] = info[i][nearer], i
    return parent


def rates(votes: np.ndarray, post: np.ndarray, parent: np.ndarray, smooth: float = 0.5) -> np.ndarray:
    """How often each voter fires, by label (0, 1) and by its parent's vote (0, 1)."""
    above = np.where(parent[None, :] >= 0, votes[:, parent], 0)
    out = np.empty((2, 2, votes.shape[1]))
    for y, own in enumerate((1 - post, post)):
        for a, with_parent in enumerate((1 - above, above)):
            n = own @ with_parent
            overall = (own @ votes + smooth) / (own.sum() + 2 * smooth)
            out[y, a] = (own @ (with_parent * votes) + 2 * smooth * overall) / (n + 2 * smooth)
    return out


def posterior(votes: np.ndarray, prior: float, rate: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of votes."""
    above = np.where(parent[None, :] >= 0, votes[:, parent], 0)
    odds = np.full(len(votes), np.log(prior / (1 - prior)))
    for y, sign in ((1, 1), (0, -1)):
        for a, with_parent in enumerate((1 - above, above)):
            fire, quiet = np.log(rate[y, a]), np.log(1 - rate[y, a])
            odds += sign * ((with_parent * votes) @ (fire - quiet) + with_parent @ quiet)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def label_model(votes: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Posterior probability of label 1 for each row of 0/1 votes; the last voter is the given label, and starts the estimate."""
    post = np.where(votes[:, -1] > 0, 0.9, 0.05)
    for turn in range(rounds):
        if turn in (0, rounds // 4, rounds // 2):  # then the tree stays, so that likelihood rises
            parent = dependence_tree(votes, post)
        prior = float(np.clip(post.mean(), 1e-3, 0.5))
        post = posterior(votes, prior, np.clip(rates(votes, post, parent), 1e-6, 1 - 1e-6), parent)
    return post


def places(word: str) -> tuple[int, ...]:
    """Where a word of a text counts: its own place, and those of its beginnings."""
    own = (zlib.crc32(b"=" + word.encode()), *(zlib.crc32(b"^" + word[:n].encode()) for n in STEMS if len(word) >= n))
    return tuple(x >> (32 - BITS) for x in own)


def features(voters: Voters, text: str | None) -> list[int]:
    """Places of all distinct words of a text and of what voters have of them; a place counts as often as words have it."""
    out = [x for w in sorted(set(WORD.findall((text or "").lower()))) for x in (*places(w), *voters.places(w))]
    return out + voters.marks(text)


def fit_linear(rows: list[np.ndarray], target: np.ndarray, size: int, ridge: float = 3.0, rounds: int = 50, pace: float = 0.1) -> np.ndarray:
    """Logistic regression of hashed features (places of each row) on soft targets, by gradients of adaptive pace; the last weight is the bias."""
    w, m, v = (np.zeros(size + 1) for _ in range(3))
    w[-1] = np.log(max(target.mean(), 1e-6) / max(1 - target.mean(), 1e-6))
    held = np.cumsum([len(x) for x in rows])
    blocks = [np.arange(len(rows))[held // 4_000_000 == k] for k in range(int(held[-1]) // 4_000_000 + 1)]
    for turn in range(1, rounds + 1):
        grad = ridge / len(rows) * w
        grad[-1] = 0
        for own in blocks:  # some million features at a time
            if len(own):
                flat = np.concatenate([rows[i] for i in own])
                at = np.repeat(np.arange(len(own)), [len(rows[i]) for i in own])
                odds = np.bincount(at, w[flat], len(own)) + w[-1]
                miss = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target[own]) / len(rows)
                grad[:size] += np.bincount(flat, miss[at], size)
                grad[-1] += miss.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= pace * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray | None
    #: What each word seen so far by this process adds.
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        if self.weights is None:
            return {"score": [0.0] * len(texts), "predicted": [0] * len(texts)}
        w, known = self.weights.tolist(), self.known
        if len(known) > 1_000_000:
            known.clear()

        def odds(text: str | None) -> float:
            words = set(WORD.findall((text or "").lower()))
            for word in words.difference(known):
                known[word] = sum(w[i] for i in (*places(word), *self.voters.places(word)))
            # an exactly rounded sum has no order, so equal texts have equal sums everywhere
            return math.fsum(map(known.__getitem__, words)) + sum(w[i] for i in self.voters.marks(text)) + w[-1]

        score = 1 / (1 + np.exp(-np.clip(np.array([odds(t) for t in texts]), -30, 30)))
        return {"score": score.tolist(), "predicted": (score >= THRESHOLD).astype(int).tolist()}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """_text and _y of at most about `sample` rows of each label, by a hash of the id. labels must hold training rows only."""
    y = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    counts = {r["_y"]: r["count"] for r in y.groupBy("_y").count().collect()}
    order = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(3)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col("_y") == value) & (order <= int(min(1.0, sample / n) * (1 << 30))))
    # the sample's size has a bound, so it may be sent to every task
    return docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(y.filter(keep)), id_col).select("_text", "_y")


def mine(rows: DataFrame, mined: int) -> Voters:
    """Words and word beginnings that fire on label 1 far oftener than on label 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pos: Counter, neg: Counter) -> pa.RecordBatch:
            keys = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["f", "pos", "neg"])

        pos: Counter = Counter()
        neg: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, starts = parts(text or "")
                (pos if y else neg).update(["=" + w for w in words])
                for own in starts.values():
                    (pos if y else neg).update(["^" + w for w in own])
                if len(pos) + len(neg) > 500_000:
                    yield out(pos, neg)
                    pos.clear()
                    neg.clear()
        yield out(pos, neg)

    total = rows.agg(F.coalesce(F.sum("_y"), F.lit(0)), F.count("*")).first()
    n_pos, n_neg = total[0], total[1] - total[0]
    if not n_pos or not n_neg:
        return Voters()
    seen = rows.mapInArrow(count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    weight = (odds * F.sqrt("pos")).alias("weight")
    good = common.cut(seen.filter((F.col("pos") >= LEAST_ROWS) & (odds >= LEAST_ODDS)).select("f", weight))
    best = lambda kind: [r["f"][1:] for r in good.filter(F.col("f").startswith(kind)).orderBy(F.desc("weight"), "f").limit(mined).collect()]
    out = Voters(list(dict.fromkeys([*LEXICON, *best("=")])), best("^"))
    common.forget(good)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, mined: int = MINED) -> Model:
    rows = common.cut(labelled_sample(docs, labels, id_col, text_col, label_col, sample))
    voters = mine(rows, mined)
    if not len(voters.words):
        common.forget(rows)
        return Model(voters, None)

    def kernel(texts: list[str | None]) -> dict[str, list]:
        return {"_v": [np.array(sorted(voters.fired(t)), np.int16).tobytes() for t in texts], "_f": [np.array(features(voters, t), np.int32).tobytes() for t in texts]}

    def fit(group: pa.Table) -> pa.Table:
        own = sorted(zip(group.column("_y").to_pylist(), group.column("_v").to_pylist(), group.column("_f").to_pylist(), strict=True))
        y = np.array([r[0] > 0 for r in own], float)
        post = label_model(np.hstack([voters.matrix([np.frombuffer(r[1], np.int16).tolist() for r in own]), y[:, None].astype(np.float32)]))
        weights = fit_linear([np.frombuffer(r[2], np.int32) for r in own], post, (1 << BITS) + len(voters))
        return pa.table({"w": [weights.tobytes()]})

    seen = common.add_columns(rows, "_text", {"_v": "binary", "_f": "binary"}, kernel).select("_y", "_v", "_f")
    # the sample has a bound, so one task may have it
    fitted = seen.groupBy(F.lit(0).alias("_k")).applyInArrow(fit, "w binary").first()
    common.forget(rows)
    return Model(voters, np.frombuffer(bytes(fitted["w"])))


def score(df: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """df with two columns of these names: the score, and 1 where it reaches THRESHOLD."""
    own, predicted = names
    return common.add_columns(df, text_col, {own: "double", predicted: "int"}, lambda texts: dict(zip(names, model.predict(texts).values(), strict=True)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels").filter(~common.held_out(4, 2)))
    return score(docs.select("doc_id", "text", common.held_out(4, 2).alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
