"""Choice of pivots: repeatable samples, and the classical selectors on a bounded sample held by the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distances import DISTANCES
from nearfield.operators.search import distances_between, matrix


def sample_order(seed: str, id: str) -> list[Column]:
    """An order of rows by a checksum of seed and id: the same in every run and engine."""
    return [F.md5(F.concat(F.lit(seed), F.col(id).cast("string"))), F.col(id)]


def random_pivots(objects: DataFrame, n: int, id: str = "id", seed: str = "pivot:", among: DataFrame | None = None, exclude: list[int] | None = None) -> DataFrame:
    """n rows without replacement; of the ids in among, where given, and without those of exclude."""
    rows = objects.join(among.select(id).distinct(), id, "left_semi") if among is not None else objects
    if exclude:
        rows = rows.where(~F.col(id).isin(list(map(int, exclude))))
    return rows.orderBy(*sample_order(seed, id)).limit(n)


def first_pivots(objects: DataFrame, n: int, id: str = "id") -> DataFrame:
    return objects.orderBy(id).limit(n)


def fixed_pivots(objects: DataFrame, ids: list[int], id: str = "id") -> DataFrame:
    return objects.where(F.col(id).isin(ids))


def collected(pivots: DataFrame, id: str = "id", vector: str = "v", seed: str = "pivot:") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of chosen pivots in sample order; their number is the caller's parameter."""
    rows = pivots.orderBy(*sample_order(seed, id)).select(id, vector).collect()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def with_pivot_distances(objects: DataFrame, pivots: np.ndarray, distance: str = "l1", vector: str = "v", name: str = "tuple") -> DataFrame:
    """Adds the distances to all pivots as an array; rows without a vector leave."""
    kind = DISTANCES[distance].kernel
    sent = objects.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances_between(matrix(batch.column(vector)), sent.value, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(d), pa.list_(pa.float64()))], [*batch.schema.names, name])

    kept = objects.where(F.col(vector).isNotNull())
    return kept.mapInArrow(run, kept.select("*", F.lit(None).cast("array<double>").alias(name)).schema)


def sparse_spatial(x: np.ndarray, n: int, alpha: float = 0.0, kind: str = "l1", histogram: int = 100) -> list[int]:
    """Rows at least mean + alpha * std apart, in row order.

    The moments start with all pairs of the first histogram rows and take in every distance that a candidate is compared by, as
    the choice goes on. Each row is a candidate once, so fewer than n rows may come back.
    """
    d = distances_between(x, x, kind)
    first = d[:histogram, :histogram]
    known = first[~np.eye(len(first), dtype=bool)]
    count, total, squares = known.size, float(known.sum()), float((known * known).sum())
    chosen: list[int] = []
    for i in range(len(x)):
        if len(chosen) == n:
            break
        for j in chosen:
            own = float(d[i, j])
            count, total, squares = count + 1, total + own, squares + own * own
            spread = max(0.0, squares - total * total / count) / max(1, count - 1)
            if own < total / count + alpha * spread**0.5:
                break
        else:
            chosen.append(i)
    return chosen


def incremental(x: np.ndarray, n: int, candidates: int = 50, pairs: int = 200, kind: str = "l1", seed: int = 0) -> list[int]:
    """Each step adds the candidate with the largest mean lower bound over random pairs."""
    rng = np.random.default_rng(seed)
    d = distances_between(x, x, kind)
    left, right = rng.integers(len(x), size=pairs), rng.integers(len(x), size=pairs)
    best, chosen = np.zeros(pairs), []
    for _ in range(min(n, len(x))):
        rest = np.setdiff1d(np.arange(len(x)), chosen)
        tried = rng.choice(rest, min(candidates, len(rest)), replace=False)
        bounds = np.maximum(best[None], np.abs(d[tried][:, left] - d[tried][:, right]))
        k = int(bounds.mean(1).argmax())
        best = bounds[k]
        chosen.append(int(tried[k]))
    return chosen


def kmeans_plus_plus(objects: DataFrame, n: int, retries: int = 3, distance: str = "l1", id: str = "id", vector: str = "v", seed: str = "centre", usable: Column | None = None) -> list[int]:
    """Centres drawn with weight by their distance to the nearest centre, over the whole table.

    A draw is the row of the smallest -log(u) / weight, with u from a checksum: one aggregate for each try, no sort and no
    cumulative sum. Of the tries the one that leaves the least total distance is kept. usable tells which rows may be centres.
    """
    kind = DISTANCES[distance].kernel
    rows = objects.where(F.col(vector).isNotNull()).where(usable if usable is not None else F.lit(True))
    first = rows.orderBy(*sample_order(seed, id)).select(id, vector).first()
    if first is None:
        raise ValueError("no row may be a centre")
    ids, centres = [first[0]], [list(map(float, first[1]))]

    def tries(step: int) -> list[tuple]:
        sent = objects.sparkSession.sparkContext.broadcast(np.array(centres))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = distances_between(matrix(batch.column(vector)), sent.value, kind).min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], [*batch.schema.names, "_d"])

        own = rows.select(id, vector)
        weighed = own.mapInArrow(near, own.select("*", F.lit(0.0).alias("_d")).schema).where("_d > 0")
        keys = [(-F.log((F.pmod(F.xxhash64(F.lit(f"{seed}{step}.{t}"), F.col(id)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)) / F.col("_d")) for t in range(retries)]
        found = weighed.agg(*[F.min_by(F.struct(id, vector), F.struct(k, F.col(id))).alias(f"t{i}") for i, k in enumerate(keys)]).first()
        return [f for f in found if f is not None]

    def potential(vectors: list[list[float]]) -> float:
        sent = objects.sparkSession.sparkContext.broadcast(np.array(vectors))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([float(distances_between(matrix(batch.column(vector)), sent.value, kind).min(1).sum())])], ["s"])

        return rows.select(vector).mapInArrow(near, "s double").agg(F.sum("s")).first()[0]

    while len(ids) < n:
        found = tries(len(ids))
        if not found:
            break
        best = min(found, key=lambda r: (potential([*centres, list(map(float, r[1]))]), r[0]))
        ids.append(best[0])
        centres.append(list(map(float, best[1])))
    return ids


def permutation_pivots(x: np.ndarray, n: int, candidates: int = 50, pairs: int = 200, kind: str = "l1", seed: int = 0) -> list[int]:
    """Each step adds the candidate that makes permutations of random pairs differ most (mean footrule)."""
    rng = np.random.default_rng(seed)
    d = distances_between(x, x, kind)
    left, right = rng.integers(len(x), size=pairs), rng.integers(len(x), size=pairs)
    chosen: list[int] = []
    for _ in range(min(n, len(x))):
        rest = np.setdiff1d(np.arange(len(x)), chosen)
        tried = rng.choice(rest, min(candidates, len(rest)), replace=False)

        def spread(c: int) -> float:
            places = np.argsort(np.argsort(d[:, [*chosen, int(c)]], axis=1, kind="stable"), axis=1, kind="stable")
            return float(np.abs(places[left] - places[right]).sum(1).mean())

        chosen.append(int(max(tried.tolist(), key=lambda c: (spread(c), -c))))
    return chosen


def _parted(d: np.ndarray, a: np.ndarray, b: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of pivots (a, b): the side of every row, the distinct sketches once the pair's bit joins groups, and distortion.

    A row's bit is set where it is at least as near to a as to b. Distortion is the difference of the two sides' sizes as a share.
    """
    side = d[a] <= d[b]
    member = groups[:, None] == np.unique(groups)[None]
    inside = side.astype(np.float32) @ member.astype(np.float32)
    distinct = (inside > 0).sum(1) + (inside < member.sum(0)).sum(1)
    return side, distinct, np.abs(2 * side.sum(1) - d.shape[1]) / d.shape[1]


def _joined(groups: np.ndarray, side: np.ndarray) -> np.ndarray:
    return np.unique(2 * groups + side, return_inverse=True)[1]


def random_pairs(x: np.ndarray, n: int, method: str = "spread", tries: int = 4000, kind: str = "l1", seed: int = 0, spread: float = 0.5, distortion: float = 0.10) -> list[tuple[int, int]]:
    """Pivot pairs from random trials over the rows of a sample; each row is in one pair at most.

    spread of a pair: distinct sketches of all pairs so far and this one, as a share of min(2 ** pairs, rows). 'spread' asks for at
    least spread and at most distortion, and prefers more spread, less distortion, more mean distance to the hyperplane;
    'distortion' prefers less distortion, then more mean distance. Where none of the tries is valid the best of them is taken.
    """
    rng = np.random.default_rng(seed)
    d, used, out = distances_between(x, x, kind), set(), []
    groups = np.zeros(len(x), np.int64)
    for step in range(1, n + 1):
        rest = np.setdiff1d(np.arange(len(x)), sorted(used))
        if len(rest) < 2:
            break
        a = rng.integers(len(rest), size=tries)
        b = (a + 1 + rng.integers(len(rest) - 1, size=tries)) % len(rest)
        a, b = rest[a], rest[b]
        best = None
        for low in range(0, tries, 1000):
            p, q = a[low : low + 1000], b[low : low + 1000]
            side, distinct, apart = _parted(d, p, q, groups)
            share = distinct / min(2.0**step, len(x))
            bound = np.abs(d[p] - d[q]).mean(1) / 2
            valid = (share >= spread) & (apart <= distortion)
            keys = zip(~valid, -share, apart, -bound, strict=True) if method == "spread" else zip(apart, -bound, strict=True)
            found = min((tuple(map(float, k)), low + i) for i, k in enumerate(keys))
            if best is None or found < best[0]:
                best = found, side[found[1] - low]
        at = best[0][1]
        groups = _joined(groups, best[1])
        used |= {int(a[at]), int(b[at])}
        out.append((int(a[at]), int(b[at])))
    return out


def exhaustive_pairs(x: np.ndarray, n: int, kind: str = "l1", spread_weight: float = 10.0) -> list[tuple[int, int]]:
    """Of all pairs of the sample, round by round, the one of the largest (1 - normalised distance) + spread_weight * spread.

    spread counts the distinct sketches of the pairs so far and this one, as in random_pairs; of equal pairs the later one in order
    of rows is taken; rows of a pair leave the later rounds.
    """
    d = distances_between(x, x, kind)
    left = np.ones(len(x), bool)
    groups, out = np.zeros(len(x), np.int64), []
    while len(out) < n and left.sum() >= 2:
        rows = np.flatnonzero(left)
        a, b = (rows[i] for i in np.triu_indices(len(rows), 1))
        best, side = (-np.inf, -1), None
        for low in range(0, len(a), 20_000):
            p, q = a[low : low + 20_000], b[low : low + 20_000]
            own, distinct, _ = _parted(d, p, q, groups)
            value = 1 - d[p, q] / max(d.max(), 1e-12) + spread_weight * (distinct / min(2.0 ** (len(out) + 1), len(x)))
            at = len(value) - 1 - int(value[::-1].argmax())
            if value[at] >= best[0]:
                best, side = (value[at], low + at), own[at]
        i, j = int(a[best[1]]), int(b[best[1]])
        groups = _joined(groups, side)
        left[[i, j]] = False
        out.append((i, j))
    return out


def separated(x: np.ndarray, n: int, least: float, kind: str = "l1") -> list[int]:
    """Up to n rows in row order, all more than least apart."""
    d = distances_between(x, x, kind)
    chosen: list[int] = []
    for i in range(len(x)):
        if len(chosen) < n and all(d[i, j] > least for j in chosen):
            chosen.append(i)
    return chosen
