"""Average-linkage clustering under a distance limit, in rounds.

Two clusters that are each other's nearest may merge at once, wherever the others
are: no later merge brings a cluster nearer to them.  For the same reason a cluster
without a neighbour within the limit is done.  So all such pairs merge in a round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions import columns as C
from argentum.storage import drop_table, materialize

from .blocks import blocked, opened
from .numbering import numbered
from .vectors import normalized_mean

#: Bytes that the rows of clusters of places may take while a component is clustered.
KEPT_BYTES = 512 << 20
#: Numbers in one block of a product of vectors.
BLOCK_NUMBERS = 1 << 22
#: Clusters in a block of the search for nearest ones.
BLOCK = 4096
#: Products of a round, and clusters, up to which one task goes on without others.
ALONE_PAIRS, ALONE_CLUSTERS = 1 << 30, 1 << 16
#: Rounds end where this many times the clusters that merged or are done are less than those that were looked for.
LEAST_SHARE = 16
# Similarity at which centroids merge, linkage that vetoes a merge, and the quality gate.
MERGE_SIMILARITY, VETO_LINKAGE, LEAST_SIDE, GENERIC_SIMILARITY = 0.35, 0.79, 80.0, 0.40


def agglomerate(distance: np.ndarray, limit: float) -> np.ndarray:
    """Cluster numbers (each the smallest member's index) by average linkage up to ``limit``."""
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    owner, size = np.arange(n), np.ones(n)
    nearest = d.argmin(1) if n else np.zeros(0, int)
    gap = d[np.arange(n), nearest] if n else np.zeros(0)
    while n > 1:
        i = int(gap.argmin())
        if not gap[i] <= limit:
            break
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        owner[owner == j] = i
        gap[j] = np.inf
        stale = np.flatnonzero((nearest == i) | (nearest == j))
        for k in {i, *stale.tolist()} - {j}:
            nearest[k] = d[k].argmin()
            gap[k] = d[k, nearest[k]]
        closer = d[i] < gap
        nearest[closer], gap[closer] = i, d[i][closer]
    return owner


def agglomerate_places(lat: np.ndarray, lon: np.ndarray, limit: float, kept_bytes: int = KEPT_BYTES) -> np.ndarray:
    """What ``agglomerate`` gives for great-circle kilometres between points in degrees, without a matrix of them.

    A cluster's row, the sum of its members' distances to every point, gives its
    average distance to all clusters by one sum over each cluster's points.  Rows
    are worked out when a chain of nearest neighbours asks for them; those of the
    largest clusters, which cost most, are kept within ``kept_bytes``, and the row
    of a merged cluster is the sum of its parts' where both are kept.
    """
    n = len(lat)
    a, b = np.radians(lat), np.radians(lon)
    unit = np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], 1)
    name, parent = np.arange(n), np.arange(n)
    owner, size, left = np.arange(n), np.ones(n), n  # by place in the compacted table
    members = {i: np.array([i]) for i in range(n)}
    near, gap, gone = np.full(n, -1), np.full(n, np.inf), np.zeros(n, bool)
    kept: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        if i in kept:
            return kept[i]
        total = np.zeros(len(unit))
        for k in members[i]:
            chord = ((unit - unit[k]) ** 2).sum(1)
            total += np.arcsin(np.sqrt(np.minimum(1.0, chord / 4)))
        keep(i, 2 * C.EARTH_KM * total)
        return kept.get(i, 2 * C.EARTH_KM * total)

    def keep(i: int, total: np.ndarray) -> None:
        kept[i] = total
        while len(kept) > 1 and len(kept) * total.nbytes > kept_bytes:
            del kept[min(kept, key=lambda c: (size[c], c == i))]

    first, chain = 0, []
    while left > 1:
        if 10 * left < 7 * len(size):  # drop the clusters that are done, and their points
            alive = np.flatnonzero(~gone)
            to = np.full(len(size) + 1, -1)
            to[alive] = np.arange(len(alive))
            points = np.flatnonzero(to[owner] >= 0)
            moved = np.full(len(unit), -1)
            moved[points] = np.arange(len(points))
            unit, owner = unit[points], to[owner[points]]
            members = {int(to[c]): moved[m] for c, m in members.items() if to[c] >= 0}
            kept = {int(to[c]): r[points] for c, r in kept.items() if to[c] >= 0}
            size, name, gap, gone, near = size[alive], name[alive], gap[alive], gone[alive], to[near[alive]]
            chain, first = to[chain].tolist() if chain else [], 0
        if not chain:
            while gone[first]:
                first += 1
            chain.append(first)
        i = chain[-1]
        if near[i] < 0:
            d = np.bincount(owner, row(i), len(size)) / (size[i] * size)
            d[i] = np.inf
            d[gone] = np.inf
            near[i] = d.argmin()
            gap[i] = d[near[i]]
        if not gap[i] <= limit:
            gone[i], left = True, left - 1
            near[near == i] = -1
            kept.pop(i, None)
            chain.pop()
            continue
        j = int(near[i])
        if j not in chain:
            chain.append(j)
            continue
        j = chain[-2]
        del chain[-2:]
        i, j = (i, j) if name[i] < name[j] else (j, i)
        both = row(i) + row(j) if i in kept and j in kept else None
        kept.pop(i, None), kept.pop(j, None)
        owner[members[j]] = i
        members[i] = np.concatenate([members[i], members.pop(j)])
        size[i] += size[j]
        size[j] = 1  # no division by zero; it is gone
        if both is not None:
            keep(i, both)
        parent[name[j]] = name[i]
        gone[j], left = True, left - 1
        near[(near == i) | (near == j)] = -1
        near[i] = -1
    for k in range(n):  # a parent is smaller than its children
        parent[k] = parent[parent[k]]
    return parent


def nearest(rows: np.ndarray, others: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, product) of each row's largest product with ``others``, the first of equal ones; ``own`` is a place left out, or -1.

    Products in single precision leave out what is behind the largest by more than
    their error; the few others are told apart in double precision.  A row that
    nothing is left for has place -1.
    """
    place, best = np.full(len(rows), -1), np.full(len(rows), -np.inf)
    if len(others) > BLOCK:
        for at in range(0, len(others), BLOCK):
            here, product = nearest(rows, others[at : at + BLOCK], np.where((own >= at) & (own < at + BLOCK), own - at, -1))
            more = product > best
            place[more], best[more] = at + here[more], product[more]
        return place, best
    if not len(others):
        return place, best
    most, length = np.linalg.norm(others, axis=1).max(), np.linalg.norm(rows, axis=1)
    single = length.max(initial=0.0) * most < 1e30 and most < 1e30
    short = others.astype(np.float32) if single else None
    step = max(1, BLOCK_NUMBERS // len(others))
    for at in range(0, len(rows), step):
        q, o = rows[at : at + step], own[at : at + step]
        line = np.flatnonzero(o >= 0)
        if single:
            s = q.astype(np.float32) @ short.T
            s[line, o[line]] = -np.inf
            least = s.max(1) - ((q.shape[1] + 4) * 2.0**-23 * most * length[at : at + step] + 1e-30)
            close = s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
            if np.count_nonzero(close) <= 16 * len(q):
                i, j = np.divmod(np.flatnonzero(close & np.isfinite(s) if np.isneginf(least).any() else close), len(others))
                if len(i):
                    p = np.einsum("ij,ij->i", q[i], others[j])
                    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    top = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, first), np.diff(np.append(first, len(i)))))
                    of, k = np.unique(i[top], return_index=True)
                    place[at + of], best[at + of] = j[top[k]], p[top[k]]
                continue
        s = q @ others.T
        s[line, o[line]] = -np.inf
        j = s.argmax(1)
        best[at : at + step] = s[np.arange(len(q)), j]
        place[at : at + step] = np.where(np.isneginf(best[at : at + step]), -1, j)
    return place, best


def agglomerate_vectors(vectors: np.ndarray, limit: float, size: np.ndarray | None = None, near: np.ndarray | None = None, gap: np.ndarray | None = None) -> np.ndarray:
    """What ``agglomerate`` gives for the distances 1 - x.y, from the clusters' means alone.

    The average of 1 - x.y over two clusters is 1 less the product of their means,
    so no matrix of distances is held.  Merging any two clusters that are each
    other's nearest gives the same clusters as merging the closest pair of all, as
    no merge brings clusters nearer to a third one.  So rounds merge all such pairs
    at once, and clusters whose nearest has changed look again together.  For the
    same reason a cluster without a neighbour within the limit is done.  Where
    rounds find little, chains of nearest neighbours go on one search at a time,
    of which there are never more than a few a cluster.

    Vectors may be means of ``size`` vectors; ``near`` and ``gap`` say what is known
    of their nearest ones (place, or -1 if unknown, and distance).
    """
    n = len(vectors)
    mean, name, parent = np.array(vectors, np.float64), np.arange(n), np.arange(n)
    size = np.ones(n) if size is None else np.array(size, np.float64)
    near, gap = (np.full(n, -1), np.full(n, np.inf)) if near is None else (np.array(near), np.array(gap, np.float64))
    while len(mean) > 1:
        asked = np.flatnonzero(near < 0)
        near[asked], product = nearest(mean[asked], mean, asked)
        gap[asked] = 1.0 - product
        done = ~(gap <= limit)
        line = np.arange(len(mean))
        mutual = ~done & ~done[near] & (near[near] == line)
        head = np.flatnonzero(mutual & (line < near))
        tail = near[head]
        mean[head] = (size[head, None] * mean[head] + size[tail, None] * mean[tail]) / (size[head] + size[tail])[:, None]
        size[head] += size[tail]
        parent[name[tail]] = name[head]
        changed = done | mutual
        near[changed | changed[near]] = -1
        keep = ~done
        keep[tail] = False
        to = np.append(np.where(keep, np.cumsum(keep) - 1, -1), -1)
        mean, size, name, gap, near = mean[keep], size[keep], name[keep], gap[keep], to[near[keep]]
        if LEAST_SHARE * (np.count_nonzero(done) + len(head)) < len(asked):
            break
    gone = np.zeros(len(mean))  # infinite where a row is no cluster any more
    first, left, chain = 0, len(mean), []
    while left > 1:
        if 10 * left < 7 * len(mean):
            keep = np.flatnonzero(gone == 0)
            to = np.full(len(mean) + 1, -1)
            to[keep] = np.arange(len(keep))
            mean, size, name, gap, gone = mean[keep], size[keep], name[keep], gap[keep], gone[keep]
            near, chain, first = to[near[keep]], to[chain].tolist() if chain else [], 0
        if not chain:
            while gone[first]:
                first += 1
            chain.append(first)
        i = chain[-1]
        if near[i] < 0:
            d = 1.0 - mean @ mean[i] + gone
            d[i] = np.inf
            near[i] = d.argmin()
            gap[i] = d[near[i]]
        if not gap[i] <= limit:
            gone[i], left = np.inf, left - 1
            near[near == i] = -1
            chain.pop()
            continue
        j = int(near[i])
        if j not in chain:
            chain.append(j)
            continue
        # a neighbour further down the chain is as near as the last but one
        j = chain[-2]
        del chain[-2:]
        i, j = (i, j) if name[i] < name[j] else (j, i)
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        size[i] += size[j]
        parent[name[j]] = name[i]
        gone[j], left = np.inf, left - 1
        near[(near == i) | (near == j)] = -1
        near[i] = -1
    for k in range(n):  # a parent is smaller than its children
        parent[k] = parent[parent[k]]
    return parent


def _blocks(rows: DataFrame, n: int, size: int, name: str) -> DataFrame:
    """``n`` clusters (k, v) in full blocks, as far as partitions allow."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return blocked(rows.select(F.col("k").alias("id"), "v").coalesce(max(least, -(-n // size))), size, name)


def _nearest_of(asked: DataFrame, others: DataFrame) -> DataFrame:
    """(k, found): the smallest (gap, near) of each cluster in blocks ``asked`` among all in blocks ``others``."""
    tasks = 2 * asked.sparkSession.sparkContext.defaultParallelism
    left = asked.repartition(tasks).select(*(F.col(c).alias(f"a_{c}") for c in asked.columns))
    right = others.select(*(F.col(c).alias(f"b_{c}") for c in others.columns))
    # no equality of keys: that would send all blocks of a length to one task
    pairs = left.join(right, F.abs(F.col("a_dim") - F.col("b_dim")) < 1).select("a_block", "a_data", "b_data")

    def search(batches):
        last, ids, m, near, gap = None, None, None, None, None

        def best():
            known = near >= 0
            return pa.record_batch([pa.array(ids[known]), pa.array(gap[known]), pa.array(near[known])], names=["k", "gap", "near"])

        for b in batches:
            for x, one, other in zip(*(c.to_pylist() for c in b.columns)):
                if last != x:
                    if last is not None:
                        yield best()
                    last, (ids, m) = x, opened(one)
                    near, gap = np.full(len(ids), -1), np.full(len(ids), np.inf)
                names, w = opened(other)
                own = np.full(len(ids), -1)
                _, i, j = np.intersect1d(ids, names, assume_unique=True, return_indices=True)
                own[i] = j
                place, product = nearest(m, w, own)
                d = 1.0 - product
                closer = (place >= 0) & ((d < gap) | ((d == gap) & (names[place] < near)))
                near[closer], gap[closer] = names[place[closer]], d[closer]
        if last is not None:
            yield best()

    found = pairs.mapInArrow(search, "k bigint, gap double, near bigint")
    return found.groupBy("k").agg(F.min(F.struct("gap", "near")).alias("found"))


def _round(clusters: DataFrame, n: int, asked: int, eps: float) -> DataFrame:
    """Clusters after those that are each other's nearest have merged; ``done``: no neighbour within eps.

    ``near`` and ``gap`` are null where the nearest one has changed.
    """
    blocks = _blocks(clusters, n, BLOCK, "cluster-blocks")
    found = _nearest_of(blocks if asked == n else _blocks(clusters.where("near IS NULL"), asked, BLOCK, "asked-blocks"), blocks)
    now = clusters.select("k", "near", "gap").join(found, "k", "left").select("k", F.coalesce("near", "found.near").alias("near"), F.coalesce("gap", "found.gap").alias("gap"))
    now = materialize(now.withColumn("done", F.coalesce(~(F.col("gap") <= eps), F.lit(True))), "nearest")
    back = now.where("NOT done").select(F.col("k").alias("near"), F.col("near").alias("back"))
    told = materialize(now.join(back, "near", "left").withColumn("mutual", F.coalesce(~F.col("done") & (F.col("back") == F.col("k")), F.lit(False))).drop("back"), "told")
    changed = told.where("done OR mutual").select(F.col("k").alias("near"), F.lit(True).alias("changed"))
    known = ~F.col("done") & ~F.col("mutual") & F.col("changed").isNull()
    plan = told.join(changed, "near", "left").select(
        "k", "done", F.when(F.col("mutual"), F.least("k", "near")).otherwise(F.col("k")).alias("into"), F.when(known, F.col("near")).alias("near"), F.when(known, F.col("gap")).alias("gap")
    )
    parts = clusters.drop("near", "gap").join(plan, "k").groupBy("into").agg(F.sort_array(F.collect_list(F.struct("k", "n", "v", "members"))).alias("p"), F.max("done").alias("done"), F.max("near").alias("near"), F.max("gap").alias("gap"))
    one, two = F.col("p")[0], F.get("p", F.lit(1))
    mean = F.zip_with(one["v"], two["v"], lambda x, y: (one["n"] * x + two["n"] * y) / (one["n"] + two["n"]))
    pair = F.size("p") > 1
    after = parts.select(
        F.col("into").alias("k"), F.when(pair, one["n"] + two["n"]).otherwise(one["n"]).alias("n"), F.when(pair, mean).otherwise(one["v"]).alias("v"), F.when(pair, F.concat(one["members"], two["members"])).otherwise(one["members"]).alias("members"), "near", "gap", "done"
    )
    out = materialize(after, "clusters")
    for gone in (blocks, now, told):
        drop_table(gone)
    return out


def average_linkage_cosine(rows: DataFrame, eps: float, key: str = "id", vector: str = "embedding", alone_pairs: int = ALONE_PAIRS) -> DataFrame:
    """(id, cluster) for unit vectors; a cluster is named by its smallest id.

    Rounds over all executors merge the clusters that are each other's nearest,
    until no more than ``alone_pairs`` products are left to a round, or it finds
    little; the clusters left are merged in one task for each number of components.
    Equal unit vectors are one from the start.  Vectors that hold null or non-finite
    components stay alone.
    """
    points = materialize(rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")), "points")
    fit = F.col("id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    square = C.dot(F.col("v"), F.col("v"))
    copies = (F.abs(square - 1) < 1e-6) & (1 - square <= eps)
    distinct = points.where(fit).withColumn("own", F.when(~copies, F.monotonically_increasing_id())).groupBy("v", "own").agg(F.sort_array(F.collect_list("id")).alias("members"))
    named = numbered(distinct.select(F.col("members")[0].alias("first"), "v", F.size("members").cast("bigint").alias("n"), "members"), ["first", "v"], "k")
    clusters = materialize(named.select("k", "n", "v", "members", F.lit(None).cast("bigint").alias("near"), F.lit(None).cast("double").alias("gap")), "clusters")
    n = asked = clusters.count()
    finished = []
    while n > ALONE_CLUSTERS or n * asked > alone_pairs:
        before, after = (n, asked), _round(clusters, n, asked, eps)
        finished.append(after.where("done").select("members"))
        clusters = after.where("NOT done").drop("done")
        n, asked = clusters.agg(F.count("*"), F.count_if(F.col("near").isNull())).head()
        if LEAST_SHARE * (before[0] - n) < before[1]:
            break

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        k, known = pdf["k"].to_numpy(), pdf["near"].notna().to_numpy()
        near = np.full(len(k), -1)
        near[known] = np.searchsorted(k, pdf["near"].to_numpy()[known].astype(np.int64))
        return pd.DataFrame({"k": k, "into": k[agglomerate_vectors(np.stack(pdf["v"].to_numpy()), eps, pdf["n"].to_numpy(), near, pdf["gap"].to_numpy())]})

    into = materialize(clusters.select("k", "n", "v", "near", "gap", F.size("v").alias("dim")).groupBy("dim").applyInPandas(cluster, "k bigint, into bigint"), "merged")
    merged = clusters.select("k", "members").join(into, "k").groupBy("into").agg(F.flatten(F.collect_list("members")).alias("members")).select("members")
    whole = reduce(DataFrame.union, finished, merged).select(F.explode("members").alias("id"), F.array_min("members").alias("cluster"))
    return materialize(whole.union(points.where(~fit).select("id", F.col("id").alias("cluster"))), "linked")


def merge_centroids(sums: np.ndarray, sizes: np.ndarray, similarity: float = MERGE_SIMILARITY, veto: float = VETO_LINKAGE) -> np.ndarray:
    """Cluster numbers after merging the most similar centroids again and again.

    Sums and sizes say all that centroids and linkages need: one product of two sums
    gives both.  A vetoed pair stays out until one of its sides changes.  Every
    cluster holds its best partner among the later ones only, and looks again where
    that one has changed.  A merged cluster looks once, for itself and for the
    earlier ones; clusters that are gone leave the tables from time to time.
    """
    sums, sizes = sums.astype(np.float64).copy(), sizes.astype(np.float64).copy()
    n = left = len(sums)
    name, parent, alive = np.arange(n), np.arange(n), np.ones(n, bool)

    def lengths(x):
        length = np.linalg.norm(x, axis=-1)
        return np.where(length > 1e-12, length, 1.0)

    length = lengths(sums)

    def allowed(at):
        """Similarities of rows ``at`` to all clusters; those vetoed or gone are out."""
        product = sums[at] @ sums.T
        sim = product / (length[at][..., None] * length)
        sim[(1.0 - product / (sizes[at][..., None] * sizes) > veto) | ~alive] = -np.inf
        return sim

    best, partner, stale = np.full(n, -np.inf), np.zeros(n, int), np.zeros(n, bool)

    def look(i, sim):
        stale[i], best[i] = False, -np.inf
        if i + 1 < len(sim):
            partner[i] = i + 1 + sim[i + 1 :].argmax()
            best[i] = sim[partner[i]]

    step = max(1, BLOCK_NUMBERS // max(1, n))
    for at in range(0, n, step):
        rows = np.arange(at, min(n, at + step))
        sim = allowed(rows)
        sim[np.arange(n) <= rows[:, None]] = -np.inf
        partner[rows] = sim.argmax(1)
        best[rows] = sim[np.arange(len(rows)), partner[rows]]
    while n:
        if 10 * left < 7 * len(sums):
            to = np.append(np.where(alive, np.cumsum(alive) - 1, -1), -1)
            sums, sizes, length, name, best, partner, stale = (x[alive] for x in (sums, sizes, length, name, best, to[partner], stale))
            alive = np.ones(left, bool)
        i = int(best.argmax())
        if best[i] < similarity:
            break
        if stale[i]:  # its value is an upper bound
            look(i, allowed(i))
            continue
        j = int(partner[i])
        sums[i] += sums[j]
        sizes[i] += sizes[j]
        length[i] = lengths(sums[i])
        parent[name[j]] = name[i]
        alive[j], best[j], left = False, -np.inf, left - 1
        stale |= alive & ((partner == i) | (partner == j))
        now = allowed(i)
        closer = np.flatnonzero((now[:i] > best[:i]) | ((now[:i] == best[:i]) & (i < partner[:i]) & (now[:i] > -np.inf)))
        best[closer], partner[closer], stale[closer] = now[closer], i, False
        look(i, now)
    for k in range(n):  # a parent is smaller than its children
        parent[k] = parent[parent[k]]
    return parent


def merge_by_centroid(clusters: DataFrame, points: DataFrame, min_samples: int, similarity: float = MERGE_SIMILARITY, veto: float = VETO_LINKAGE) -> DataFrame:
    """(cluster, merged) for clusters of ``min_samples`` members or more."""
    spark = clusters.sparkSession
    large = clusters.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples)
    members = clusters.join(large, "cluster").join(points.select("id", "v"), "id")
    sums = members.select("cluster", "n", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "n", "pos").agg(F.sum("x").alias("s"))
    table = sums.groupBy("cluster", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("v"))
    got = sorted(((r.cluster, r.n, np.array(r.v)) for r in table.toLocalIterator()), key=lambda r: r[0])
    if not got:
        return spark.createDataFrame([], "cluster bigint, merged bigint")
    names = [c for c, _, _ in got]
    owner = merge_centroids(np.stack([v for _, _, v in got]), np.array([n for _, n, _ in got]), similarity, veto)
    return spark.createDataFrame([(c, names[o]) for c, o in zip(names, owner.tolist())], "cluster bigint, merged bigint")


def label_clusters(assigned: DataFrame, min_samples: int) -> DataFrame:
    """(id, cluster_id): numbers from 0 in order of the smallest member, null below ``min_samples``."""
    sized = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("first")).where(F.col("n") >= min_samples)
    names = numbered(sized.select("cluster", "first"), ["first"], "cluster_id").select("cluster", "cluster_id")
    return assigned.join(names, "cluster", "left").select("id", "cluster_id")


def cluster_faces(rows: DataFrame, eps: float = 0.6, min_samples: int = 3, similarity: float = MERGE_SIMILARITY) -> DataFrame:
    """(id, cluster_id): average linkage, then the centroid merge of the clusters that are large enough."""
    linked = materialize(average_linkage_cosine(rows, eps), "linked")
    points = rows.select(F.col("id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    merged = merge_by_centroid(linked, points, min_samples, similarity)
    out = linked.join(merged, "cluster", "left").select("id", F.coalesce("merged", "cluster").alias("cluster"))
    return label_clusters(out, min_samples)


def quality_gate(faces: DataFrame, least_side: float = LEAST_SIDE, generic: float = GENERIC_SIMILARITY) -> DataFrame:
    """Adds ``good``: large enough, and not too close to the mean of all faces."""
    mean = normalized_mean(faces).head()
    mean = list(mean["mean"]) if mean else []
    ok = C.bbox_min_side(F.col("bbox")) >= least_side
    if mean:
        ok = ok & ~(C.dot(F.col("embedding"), F.array(*map(F.lit, mean))) > generic)
    return faces.withColumn("good", ok)


def cluster_with_quality_gate(faces: DataFrame, eps: float = 0.6, min_samples: int = 3, similarity: float = MERGE_SIMILARITY, least_side: float = LEAST_SIDE, generic: float = GENERIC_SIMILARITY) -> DataFrame:
    """(id, cluster_id) of all faces; those held back by the gate have no cluster."""
    gated = materialize(quality_gate(faces, least_side, generic).select("id", "embedding", "good"), "gated")
    held = gated.where("NOT good").select("id", F.lit(None).cast("bigint").alias("cluster_id"))
    return cluster_faces(gated.where("good"), eps, min_samples, similarity).union(held)


def clustering_result(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count("*").alias("total_faces"), F.count("cluster_id").alias("clustered_faces"), F.countDistinct("cluster_id").alias("cluster_count"))
