"""Operator 10: exact top-k inner-product search by distributed histogram selection.

Candidates and queries are tables of blocks, a bounded number of vectors to a row.
A pass is one job over all pairs of a candidate block with a query block: every
pair is scored where it lies, a task adds its scores to histograms and sends only
the topmost bins that hold its own k best, since the global k-th best score can't
lie below them.  The bin of the k-th best becomes the query's next range, kept with
its block, until it is one integer wide: that is the k-th score itself.  The last
pass keeps what scores above it, and of the ties the smallest ids.  The driver
holds one number for each length of vectors, nothing else.

All vectors without a null or non-finite component take part, whatever their size;
rows without an id, or without a vector, don't.  Scaled components are integers as
``floor(scale * x)`` of doubles, or exact where that product is no double.  Scores
are exact: float64 where every sum stays below 2**53, else longs, else Python
integers.  A score among a query's k best that does not fit a long is an error
that names the two ids; scores that are no result may be of any size: ranges end
where longs do, since a score beyond is either no result or that error.  A candidate
needs as many components as the query.  Rows with the query's own id are not its
candidates.  A repeated row is a candidate as often as it occurs; a repeated query
id is answered once, for its smallest vector.  Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.operators.blocks import blocked, opened, spread
from argentum.storage import materialize, table

#: Vectors in a candidate block and in a query block.
BLOCK, QUERIES = 2048, 1024
_STATE = "block bigint, dim int, done boolean, data binary"
_SURE, _LONG = 2.0**61, 2**63


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def whole_numbers(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): doubles, or Python integers if a product is no double."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * m)
    if np.isfinite(out).all():
        return out
    exact = [math.floor(Fraction(x) * Fraction(scale)) for x in m.ravel().tolist()]
    return np.array(exact, object).reshape(m.shape)


def _integers(m: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape)


def _largest(m: np.ndarray) -> np.ndarray:
    """Each row's largest magnitude, as a double."""
    if not m.shape[1]:
        return np.zeros(len(m))
    most = np.abs(m).max(1)
    return most if most.dtype == np.float64 else np.array([float(x) if x < 2**1000 else math.inf for x in most])


def _kinds(m: np.ndarray) -> np.ndarray:
    """0: products of such rows add up to less than 2**53, 1: to less than 2**62, 2: to anything."""
    most, root = _largest(m), math.sqrt(max(1, m.shape[1]))
    return (most > 2.0**26 / root).astype(int) + (most > 2.0**30 / root)


def scores(c: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate rows, query rows, exact integer inner products), in parts by the size of the numbers."""
    of_c, of_q = _kinds(c), _kinds(q)
    for a in np.unique(of_c):
        for b in np.unique(of_q):
            rows, cols = np.flatnonzero(of_c == a), np.flatnonzero(of_q == b)
            x, y = c[rows], q[cols]
            if max(a, b) == 0:
                s = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
            elif max(a, b) == 1:
                s = x.astype(np.int64) @ y.astype(np.int64).T
            else:
                s = _integers(x) @ _integers(y).T
            yield rows, cols, s


def _norm(m: np.ndarray) -> float:
    """Length of the longest row, rounded up; infinite beyond doubles."""
    with np.errstate(over="ignore"):
        return float(_largest(m).max(initial=0) * math.sqrt(m.shape[1]) if m.dtype == object else np.sqrt((m * m).sum(1)).max(initial=0)) * 1.0001


def _norms(batches):
    for b in batches:
        for d, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.record_batch([pa.array([d], pa.int32()), pa.array([_norm(opened(data)[1])])], names=["dim", "norm"])


def _bounds(m: np.ndarray, longest: float) -> np.ndarray:
    """At least what any score of each row can be that fits a long; Python integers if twice that is no long."""
    out = np.array([_norm(m[i : i + 1]) * longest for i in range(len(m))])
    if out.max(initial=0) < _SURE:
        return np.ceil(out).astype(np.int64) + 1
    return np.array([int(x) + 2 if x < _LONG else _LONG for x in out.tolist()], object)


def _begin(batches, longest: dict[int, float], bins: int, k: int):
    """Every query block with its queries' first ranges."""
    for b in batches:
        for block, dim, data in zip(*(c.to_pylist() for c in b.columns)):
            ids, q = opened(data)
            bound = _bounds(q, longest[dim])
            state = {"low": -bound, "span": 2 * bound + 1, "width": np.maximum(1, -(-(2 * bound + 1) // bins)), "need": np.full(len(ids), k), "found": np.ones(len(ids), bool), "ended": np.zeros(len(ids), bool)}
            yield pa.record_batch([pa.array([block]), pa.array([dim], pa.int32()), pa.array([False]), pa.array([pickle.dumps((ids, q, state))], pa.binary())], names=["block", "dim", "done", "data"])


def _pairs(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query block, its data, candidate data): all pairs of blocks, the stated query set against all rows."""
    left = spread(candidates).select(F.col("dim").alias("c_dim"), F.col("data").alias("c_data"))
    right = queries.select("block", F.col("dim").alias("q_dim"), F.col("data").alias("q_data"))
    # no equality of keys: that would send all blocks of a length to one task
    return left.join(right, F.abs(F.col("c_dim") - F.col("q_dim")) < 1).select("block", "q_data", "c_data")


def _meetings(batches):
    """(query block, its ids, vectors and state, candidate ids and vectors) of pairs."""
    held: dict = {}
    for b in batches:
        for block, q_data, c_data in zip(*(c.to_pylist() for c in b.columns)):
            if block not in held:
                held[block] = opened(q_data)
            yield block, *held[block], *opened(c_data)


def _histograms(batches, bins: int, k: int):
    """(block, query, bin, n) of one task: for each query its topmost bins with k scores in all."""
    counts: dict = {}
    for block, q_ids, q, state, c_ids, c in _meetings(batches):
        if block not in counts:
            counts[block] = np.zeros(len(q_ids) * bins, np.int64)
        open_ = np.flatnonzero(~state["ended"])
        for rows, cols, s in scores(c, q[open_]):
            cols = open_[cols]
            own = c_ids[rows, None] != q_ids[cols]
            if s.dtype == object and (over := own & (s >= _LONG)).any():
                i, j = (int(x[0]) for x in np.nonzero(over))
                raise _beyond(q_ids[cols[j]], c_ids[rows[i]], s[i, j])
            s = s - state["low"][cols]
            inside = (s >= 0) & (s < state["span"][cols]) & own
            flat = (s // state["width"][cols] + cols * bins)[inside].astype(np.int64)
            counts[block] += np.bincount(flat, minlength=len(counts[block]))
    for block, flat in counts.items():
        c = flat.reshape(-1, bins)
        above = np.cumsum(c[:, ::-1], 1)[:, ::-1] - c
        q, x = np.nonzero((c > 0) & (above < k))
        yield pa.record_batch([pa.array(np.full(len(q), block), pa.int64()), pa.array(q, pa.int32()), pa.array(x, pa.int32()), pa.array(c[q, x])], names=["block", "q", "bin", "n"])


def _narrow(got: pd.DataFrame, queries: pd.DataFrame, bins: int) -> pd.DataFrame:
    """The block with its queries' ranges narrowed to the bin of the k-th best."""
    if queries.empty:
        return pd.DataFrame({"block": [], "dim": [], "done": [], "data": []})
    row = queries.iloc[0]
    ids, q, state = pickle.loads(row["data"])
    low, span, width, need = (state[x] for x in ("low", "span", "width", "need"))
    c = np.zeros((len(ids), bins), np.int64)
    c[got["q"].to_numpy(int), got["bin"].to_numpy(int)] = got["n"].to_numpy(np.int64)
    down = np.cumsum(c[:, ::-1], 1)[:, ::-1]
    open_ = ~state["ended"]
    state["found"] &= ~open_ | (down[:, 0] >= need)  # else fewer candidates than k: all stay
    go = open_ & state["found"]
    x = np.where(go, bins - 1 - np.argmax((down >= need[:, None])[:, ::-1], 1), 0)
    line = np.arange(len(x))
    state["need"] = np.where(go, need - (down[line, x] - c[line, x]), need)
    state["low"] = np.where(go, low + x * width, low)
    state["span"] = np.where(go, np.minimum(width, span - x * width), span)
    state["ended"] = (width == 1) | ~state["found"]
    state["width"] = np.where(state["ended"], width, np.maximum(1, -(-width // bins)))
    return pd.DataFrame({"block": [row["block"]], "dim": [row["dim"]], "done": [bool(state["ended"].all())], "data": [pickle.dumps((ids, q, state))]})


def _beyond(query, vector, score) -> ValueError:
    return ValueError(f"the score of query {query} with vector {vector} does not fit a long: {score}")


def _results(q_ids, c_ids, s) -> pa.RecordBatch:
    """(query_id, score, vec_id); scores that fit no long are refused."""
    if s.dtype == object:
        for q, c, x in zip(q_ids.tolist(), c_ids.tolist(), s.tolist()):
            if not -_LONG <= x < _LONG:
                raise _beyond(q, c, x)
    return pa.record_batch([pa.array(q_ids, pa.int64()), pa.array(s.astype(np.int64)), pa.array(c_ids, pa.int64())], names=["query_id", "score", "vec_id"])


def _select(batches, k: int):
    """Scores above each query's k-th, and the k smallest ids of a task that reach it exactly."""
    ties: dict = {}
    for block, q_ids, q, state, c_ids, c in _meetings(batches):
        least, found = state["low"], state["found"]
        for rows, cols, s in scores(c, q):
            own = c_ids[rows]
            other = own[:, None] != q_ids[cols]
            i, j = np.nonzero(((s > least[cols]) | ~found[cols]) & other)
            if len(i):
                yield _results(q_ids[cols[j]], own[i], s[i, j])
            i, j = np.nonzero((s == least[cols]) & found[cols] & other)
            order = np.lexsort((own[i], j))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(j, prepend=-1))
            rank = np.arange(len(j)) - np.repeat(first, np.diff(np.append(first, len(j))))
            for vec, col in zip(own[i[rank < k]].tolist(), cols[j[rank < k]].tolist()):
                ties.setdefault((int(q_ids[col]), int(least[col])), []).append(vec)
            for key, x in ties.items():
                if len(x) > 4 * k:
                    ties[key] = sorted(x)[:k]
    for (query, score), x in ties.items():
        best = np.array(sorted(x)[:k], np.int64)
        yield _results(np.full(len(best), query), best, np.array([score] * len(best), object))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, chunk_size: int = QUERIES, bins: int = 512, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, ties to smaller ids."""
    rows = usable(vectors, key, vector)
    change = lambda m: whole_numbers(m, scale)
    candidates = blocked(rows, BLOCK, "candidate-blocks", change)
    # at most one number for each length: n lengths take n * n / 2 components in all
    longest = {r.dim: r.norm for r in candidates.select("dim", "data").mapInArrow(_norms, "dim int, norm double").groupBy("dim").agg(F.max("norm").alias("norm")).collect()}
    asked = materialize(rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    asked = blocked(asked.coalesce(max(1, -(-asked.count() // chunk_size))), chunk_size, "query-blocks", change)
    states = materialize(asked.select("block", "dim", "data").mapInArrow(lambda it: _begin(it, longest, bins, k), _STATE), "ranges")
    while states.where("not done").limit(1).count():
        open_ = states.where("not done")
        counted = _pairs(candidates, open_).mapInArrow(lambda it: _histograms(it, bins, k), "block bigint, q int, bin int, n bigint")
        found = counted.groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))
        narrowed = found.groupBy("block").cogroup(open_.groupBy("block")).applyInPandas(lambda g, o: _narrow(g, o, bins), _STATE)
        states = materialize(narrowed.union(states.where("done")), "ranges")
    best = materialize(_pairs(candidates, states).mapInArrow(lambda it: _select(it, k), "query_id bigint, score bigint, vec_id bigint"), "best")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
