"""Centroid clustering of integer vectors with ns-bounds.

Lloyd's rounds on whole vectors. Each vector carries, from the round of their last exact
evaluation, the distance to its own centroid and, for each group of GROUP centroids, the least
distance to those of the group that it doesn't belong to. The centroids of all rounds are
kept. A bound of round t is loosened in round r by the norm of the centroid's total
displacement, |c(r) - c(t)|, which is never more than the sum of the norms of the rounds'
displacements. Where the own distance is certainly below a group's bound the group is
passed over; else the own distance is evaluated, and the groups that still fail are
scanned exactly. Bounds are used with a margin for rounding, so every assignment equals that
of a full scan, ties included (the smaller number wins).

A round is one map over the vectors, written to the shared folder with its bounds, and one
aggregation to `clusters` x `size` sums; only those sums and the centroids pass the driver,
whatever the number of vectors. A hot vector or cluster is a partial sum like any other.

Vectors are rows of `size` components x, none null or not finite, taken as floor(scale * x).
Other rows are not clustered. Starting centroids are those with the smallest sha256 of
"<seed>:<id>"; rows that share it are told apart by their components. Defined cases: a row
with a null id never starts a centroid, but is clustered; fewer vectors than clusters give
as many clusters as vectors; repeated rows count each; an empty table gives an empty result; an integer beyond LARGEST is an error,
since its squared distances might not fit 64 bits; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import materialize, ship

GROUP = 10
LARGEST = 1 << 27
EXACT = 1 << 22             # components up to this give exact products in doubles
MARGIN = 1e-9

STATE = ("vec_id {kind}, v array<int>, cluster int, own double, own_round int, "
         "bounds array<double>, rounds array<int>")


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """vec_id, v: the vectors that are kept, as integers."""
    v = F.col("x")
    whole = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall(F.transform(v, lambda x: x * F.lit(float(scale))), lambda x: F.abs(x) < F.lit(float(LARGEST)))
    return rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter(whole).select(
        "vec_id", F.when(fits, scaled.cast("array<int>")).otherwise(
            F.raise_error(F.lit("a component is too large: squared distances might not fit 64 bits"))).alias("v"))


def _matrix(column) -> np.ndarray:
    """The rows of an Arrow list column, all of one length."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        d = (xf * xf).sum(axis=1)[:, None] - 2.0 * (xf @ cf.T) + (cf * cf).sum(axis=1)[None, :]
        return d.astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def to_own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the same row of c."""
    return ((x.astype(np.int64) - c) ** 2).sum(axis=1)


def assign(x: np.ndarray, state: tuple | None, history: list[np.ndarray], group: int = GROUP, counts: list | None = None):
    """State (cluster, own, own_round, bounds, rounds) of the vectors after the round
    len(history) - 1, given that of an earlier round. counts: a list that takes the number
    of distances evaluated."""
    now, c = len(history) - 1, history[-1]
    k, n = len(c), len(x)
    of = np.arange(k) // group
    groups = int(of[-1]) + 1
    done = 0
    if state is None:
        cluster = np.zeros(n, dtype=np.int32)
        own = np.zeros(n)
        own_round = np.full(n, now, dtype=np.int32)
        bounds, rounds = np.full((n, groups), -1.0), np.full((n, groups), now, dtype=np.int32)
        best = to_own(x, c[cluster])
        open_, done = np.ones(n, dtype=bool), n
    else:
        cluster, own, own_round, bounds, rounds = (a.copy() for a in state)
        # total displacements since round t, of each centroid and the largest of each group
        moved = np.stack([np.sqrt(to_own(c, h).astype(np.float64)) for h in history])
        largest = np.stack([moved[:, of == g].max(axis=1) for g in range(groups)], axis=1)
        lower = bounds - largest[rounds, np.arange(groups)[None, :]]
        upper = own + moved[own_round, cluster]
        open_ = ~(upper * (1 + MARGIN) < lower.min(axis=1) * (1 - MARGIN))
        best = np.zeros(n, dtype=np.int64)
        best[open_] = to_own(x[open_], c[cluster[open_]])
        done = int(open_.sum())
        own[open_], own_round[open_] = np.sqrt(best[open_].astype(np.float64)), now
    before = cluster.copy()
    was = best.copy()
    scanned = np.zeros((n, groups), dtype=bool)
    least = {}
    for g in range(groups):
        members = np.flatnonzero(of == g)
        fails = open_.copy()
        if state is not None:
            exact = np.sqrt(was.astype(np.float64))
            fails &= ~(exact * (1 + MARGIN) < lower[:, g] * (1 - MARGIN))
        rows = np.flatnonzero(fails)
        if not len(rows):
            continue
        d = squared(x[rows], c[members])
        done += d.size
        scanned[rows, g] = True
        nearest = d.argmin(axis=1)                              # the first of equal ones
        found, at = d[np.arange(len(rows)), nearest], members[nearest]
        better = (found < best[rows]) | ((found == best[rows]) & (at < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = at[better], found[better]
        least[g] = (rows, d, members)
    # bounds of the scanned groups leave out the centroid that the vector now belongs to
    for g, (rows, d, members) in least.items():
        rest = np.where(members[None, :] == cluster[rows][:, None], np.inf, d)
        bounds[rows, g], rounds[rows, g] = np.sqrt(rest.min(axis=1)), now
    own[open_], own_round[open_] = np.sqrt(best[open_].astype(np.float64)), now
    # the centroid a vector left counts for its group, where that was not scanned
    left = np.flatnonzero((cluster != before) & ~scanned[np.arange(n), of[before]])
    if len(left):
        g = of[before[left]]
        bounds[left, g] = np.minimum(lower[left, g], np.sqrt(was[left].astype(np.float64)))
        rounds[left, g] = now
    if counts is not None:
        counts.append(done)
    return cluster, own, own_round, bounds, rounds


def _assigned(history, first: bool, group: int, kind: str):
    def run(batches):
        import pyarrow as pa

        past = history.value
        for batch in batches:
            x = _matrix(batch.column(1))
            state = None
            if not first:
                cluster, own, own_round = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                state = (cluster, own, own_round, _matrix(batch.column(5)), _matrix(batch.column(6)))
            if len(x):
                cluster, own, own_round, bounds, rounds = assign(x, state, past, group)
                width = bounds.shape[1]
                offsets = pa.array(np.arange(len(x) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(own), pa.array(own_round, pa.int32()),
                     pa.ListArray.from_arrays(offsets, pa.array(bounds.ravel())),
                     pa.ListArray.from_arrays(offsets, pa.array(rounds.ravel(), pa.int32()))],
                    names=["vec_id", "v", "cluster", "own", "own_round", "bounds", "rounds"])
    return run


def _measured(history):
    def run(batches):
        import pyarrow as pa

        last = history.value[-1]
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(to_own(_matrix(batch.column(1)), last[cluster]), pa.int64())],
                    names=["vec_id", "cluster", "distance"])
    return run


def start_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def moved_centroids(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of each cluster's vectors; an empty one stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[
        F.sum(F.get("v", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(now.shape[1])])
    new = now.copy()
    for r in sums.collect():
        new[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(now.shape[1])]
    return new


def cluster(rows: DataFrame, clusters: int = 40, rounds: int = 5, size: int = 64, scale: float = 256.0, seed: int = 2,
            id_col: str = "vec_id", vector_col: str = "embedding", group: int = GROUP):
    """(assignment, centroids): vec_id, cluster, distance (squared) of every kept vector after
    ``rounds`` rounds and a last assignment, and the centroids as an integer matrix."""
    ship(__name__)
    kind = rows.schema[id_col].dataType.simpleString()
    sc = rows.sparkSession.sparkContext
    vectors = integer_vectors(rows, id_col, vector_col, size, scale)
    start = start_centroids(vectors, clusters, seed)
    if not len(start):
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint"), start.reshape(0, size)
    history, state = [start], vectors
    for t in range(rounds + 1):
        past = sc.broadcast(history)
        state = materialize(state.mapInArrow(_assigned(past, t == 0, group, kind), STATE.format(kind=kind)), f"round-{t}")
        if t < rounds:
            history = [*history, moved_centroids(state, history[-1])]
    return state.mapInArrow(_measured(past), f"vec_id {kind}, cluster int, distance bigint"), history[-1]


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
