"""Operator 8: document quality by a linear-chain conditional random field over lines.

Every line with a word gets features of its own and of its neighbours; a chain of
two states, good and bad, runs over a document's lines.  Training maximises the
likelihood of chains whose lines all carry their document's label.  For scoring,
forward and backward messages give every line's marginal, the marginals are
averaged by line length, and a logistic map, fitted on the training documents,
turns that into the probability that the document's label is 1.

Only text enters a score.  Labels come only from documents whose checksum puts
them outside the held-out fifth.  Training takes whole documents, the first by hash of
their id: at most ``sample`` of them, none of more than ``longest`` lines (or ten
times as many line feeds), and of
those the ones that fit into ``lines`` lines in all; so what reaches the driver is
bounded by ``lines``.  Chains are never cut.  Scoring covers whole texts.  A
document without words scores the training documents' share of label 1.  Null text
counts as empty; a null id is not held out; repeated rows give repeated results;
labels that are null, or repeated with another value, are left out; of labelled
rows that share an id one teaches; other columns are ignored.  Without any label
every score is 0.5.
"""

from __future__ import annotations

import math
from array import array
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.storage import materialize, table

from .common import text_or_empty

#: Bounds of the training sample: documents, lines in all, lines of a document.
SAMPLE, LINES, LONGEST = 4000, 200_000, 1000
#: Rounds, rate and ridge of the fit.
ROUNDS, RATE, RIDGE = 60, 0.3, 1e-3
THRESHOLD = 0.3

_MARKS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = b"0123456789"
OWN = ["marks", "shouts", "upper", "digits", "distinct", "seen", "word_length", "short_words", "length", "ended", "begins_alike", "stutter"]
#: Features that a line also takes over from the line before and the line after.
SHARED = [0, 1, 2, 4, 5, 10, 11]
N_FEATURES = 1 + len(OWN) + 2 * (len(SHARED) + 1)


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths in characters) of the lines of a text that have a word."""
    rows, sizes = array("d"), array("d")
    seen: set[str] = set()
    before = None
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        data = line.encode("utf-8", "surrogatepass")
        size = len(data)
        lengths = list(map(len, words))
        rows.extend((
            min(1.0, (size - len(data.translate(None, _MARKS))) / n),
            min(1.0, data.count(b"!") / n),
            (size - len(data.translate(None, _UPPER))) / size,
            (size - len(data.translate(None, _DIGITS))) / size,
            len(set(words)) / n if n > 3 else 1.0,
            float(line in seen),
            min(1.0, sum(lengths) / (12 * n)),
            sum(1 for x in lengths if x < 4) / n,
            min(1.0, math.log1p(n) / 6),
            float(line[-1] in ".!?"),
            float(words[0] == before),
            min(1.0, 2 * sum(map(eq, words, words[1:])) / n) if n > 1 else 0.0,
        ))
        sizes.append(len(line))
        seen.add(line)
        before = words[0]
    return np.array(rows).reshape(len(sizes), len(OWN)), np.array(sizes)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, a constant, and what the neighbouring lines show; a flag where there is none."""
    n = len(own)
    out = np.zeros((n, N_FEATURES))
    out[:, 0] = 1
    out[:, 1 : 1 + len(OWN)] = own
    at, m = 1 + len(OWN), len(SHARED)
    if n:
        out[1:, at : at + m] = own[:-1, SHARED]
        out[:-1, at + m : at + 2 * m] = own[1:, SHARED]
        out[0, at + 2 * m] = out[-1, at + 2 * m + 1] = 1
    return out


def potentials(own: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``with_neighbours(own) @ w`` without the wide matrix."""
    at, m = 1 + len(OWN), len(SHARED)
    u = own @ w[1:at] + w[0]
    if len(u):
        shared = own[:, SHARED]
        u[1:] += shared[:-1] @ w[at : at + m]
        u[:-1] += shared[1:] @ w[at + m : at + 2 * m]
        u[0] += w[at + 2 * m]
        u[-1] += w[at + 2 * m + 1]
    return u


def _pass(x: float, t: list[list[float]]) -> float:
    """The message over one transition, from good's lead over bad on one side to that on the other."""
    if x > 0:
        e = math.exp(-x)
        return math.log((math.exp(t[1][1]) + math.exp(t[0][1]) * e) / (math.exp(t[1][0]) + math.exp(t[0][0]) * e))
    e = math.exp(x)
    return math.log((math.exp(t[1][1]) * e + math.exp(t[0][1])) / (math.exp(t[1][0]) * e + math.exp(t[0][0])))


def marginals(u, t: list[list[float]]) -> array:
    """Each line's lead of good over bad, given the whole chain: forward and backward messages."""
    n = len(u)
    forward, x = array("d", bytes(8 * n)), 0.0
    for i in range(n):
        x = u[i] + (_pass(x, t) if i else 0.0)
        forward[i] = x
    back = [[t[0][0], t[1][0]], [t[0][1], t[1][1]]]
    x = 0.0
    for i in range(n - 2, -1, -1):
        x = _pass(u[i + 1] + x, back)
        forward[i] += x
    return forward


class Chains:
    """Chains of any length side by side: step by step, the longer chains first, without padding."""

    def __init__(self, sizes: list[int]):
        self.order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
        sizes = np.array([sizes[i] for i in self.order])
        self.alive = [int((sizes > i).sum()) for i in range(sizes[0])]
        self.start = np.concatenate([[0], np.cumsum(self.alive)]).tolist()
        rank = np.concatenate([np.arange(k) for k in self.alive])
        self.chain = np.array(self.order)[rank]
        self.rank = rank
        step = np.repeat(np.arange(len(self.alive)), self.alive)
        self.row = np.concatenate([[0], np.cumsum([x for _, x in sorted(zip(self.order, sizes.tolist()))])])[self.chain] + step
        self.later = np.flatnonzero(step > 0)
        self.before = np.array(self.start)[step[self.later] - 1] + rank[self.later]

    def expectations(self, u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of good, expected transitions); ``u`` in this order."""
        n, s = len(u), self.start
        node = np.stack([np.zeros(n), u], 1)
        alpha, beta = node.copy(), np.zeros((n, 2))

        def total(x, axis):
            m = x.max(axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)

        for i in range(1, len(self.alive)):
            k = self.alive[i]
            alpha[s[i] : s[i + 1]] += total(alpha[s[i - 1] : s[i - 1] + k, :, None] + t, 1)
        for i in range(len(self.alive) - 2, -1, -1):
            k = self.alive[i + 1]
            beta[s[i] : s[i] + k] = total(t + (node[s[i + 1] : s[i + 2]] + beta[s[i + 1] : s[i + 2]])[:, None, :], 2)
        z = total(alpha[: s[1]] + beta[: s[1]], 1)
        pair = alpha[self.before][:, :, None] + t + (node + beta)[self.later][:, None, :] - z[self.rank[self.later], None, None]
        return np.exp(alpha[:, 1] + beta[:, 1] - z[self.rank]), np.exp(pair).sum(0)


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """Weights, transitions and the final map from (own features, line lengths, label) of documents."""
    labels = np.array([y for *_, y in docs], np.float64)
    model = {"w": [0.0] * N_FEATURES, "t": [[0.0, 0.0], [0.0, 0.0]], "map": [1.0, 0.0], "prior": float(labels.mean()) if len(labels) else 0.5}
    docs = [d for d in docs if len(d[0])]
    if not docs or labels.min() == labels.max():
        return model
    sizes = [len(own) for own, *_ in docs]
    chains = Chains(sizes)
    x = np.concatenate([with_neighbours(own) for own, *_ in docs])[chains.row]
    y = np.array([y for *_, y in docs], np.float64)
    truth = y[chains.chain]
    moves = np.array(sizes) - 1
    seen = np.array([[float(((1 - y) * moves).sum()), 0.0], [0.0, float((y * moves).sum())]])
    theta, m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for r in range(1, ROUNDS + 1):
        w, t = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        p, expected = chains.expectations(x @ w, t)
        slope = np.concatenate([x.T @ (truth - p), (seen - expected).reshape(-1)]) / len(x) - RIDGE * theta
        m = 0.9 * m + 0.1 * slope
        v = 0.99 * v + 0.01 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    model["w"] = theta[:N_FEATURES].tolist()
    model["t"] = theta[N_FEATURES:].reshape(2, 2).tolist()
    raw = np.array([lead(own, sizes, model) for own, sizes, _ in docs])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([((y - p) * raw).sum() - 0.01 * a, (y - p).sum()])
        s = p * (1 - p)
        h = np.array([[(s * raw * raw).sum() + 0.01, (s * raw).sum()], [(s * raw).sum(), s.sum() + 0.01]])
        da, db = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + da, b + db
    model["map"] = [float(a), float(b)]
    return model


def lead(own: np.ndarray, sizes: np.ndarray, model: dict) -> float:
    """Log odds of the length-weighted mean of the lines' marginals."""
    u = array("d", potentials(own, np.array(model["w"])).tobytes())
    good = 1 / (1 + np.exp(-np.clip(marginals(u, model["t"]), -30, 30)))
    p = min(1 - 1e-6, max(1e-6, float((good * sizes).sum() / sizes.sum())))
    return math.log(p / (1 - p))


def score(text: str, model: dict) -> float:
    own, sizes = line_features(text)
    if not len(own):
        return model["prior"]
    a, b = model["map"]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * lead(own, sizes, model) + b))))


def held_out(key: Column) -> Column:
    """Whether a document belongs to the fifth from which no label is taken."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, longest: int = LONGEST, key: str = "doc_id", text: str = "text", label: str = "quality") -> dict:
    """Fit on at most ``sample`` labelled documents, and ``lines`` lines, outside the held-out fifth."""
    ids = F.col(key).cast("bigint")
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(ids)).groupBy(ids.alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    picked = usable.where("y = z").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", F.col("y").cast("int").alias("y"))
    rows = docs.where(F.col(key).isNotNull()).select(ids.alias("id"), text_or_empty(text)).join(F.broadcast(picked), "id")

    def run(batches):
        for b in batches:
            got = [line_features(t) if t.count("\n") < 10 * longest else None for t in b.column(1).to_pylist()]
            keep = [k for k, g in enumerate(got) if g is not None and len(g[0]) <= longest]
            own, sizes = ([got[k][i].astype("<f4").tobytes() for k in keep] for i in (0, 1))
            yield pa.record_batch([b.column(0).take(keep), b.column(2).take(keep), pa.array(own, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "y", "own", "sizes"])

    # a repeated row teaches once; rows of one id are reduced before they meet
    taught = rows.select("id", text, "y").mapInArrow(run, "id bigint, y int, own binary, sizes binary").groupBy("id", "y").agg(F.max(F.struct("own", "sizes")).alias("x"))
    taught = materialize(taught, "training-documents")
    # at most ``sample`` rows, then at most ``lines`` lines
    chosen, left = [], lines
    for r in taught.select("id", (F.octet_length("x.sizes") / 4).cast("bigint").alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        if r.n <= left:
            chosen.append(r.id)
            left -= r.n
    got = taught.where(F.col("id").isin(chosen)).select("id", "y", "x.own", "x.sizes").toArrow().to_pylist() if chosen else []
    return fit([(np.frombuffer(r["own"], "<f4").reshape(-1, len(OWN)).astype(np.float64), np.frombuffer(r["sizes"], "<f4").astype(np.float64), r["y"]) for r in sorted(got, key=lambda r: r["id"])])


def quality_scores(docs: DataFrame, model: dict, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""

    def run(batches):
        for b in batches:
            s = [score(t, model) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[key, "held_out", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_or_empty(text), held_out(F.col(key)).alias("held_out")).mapInArrow(run, f"{key} {kind}, held_out boolean, score double, predicted int")


def keep_by_quality(docs: DataFrame, model: dict, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([score(t or "", model) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
