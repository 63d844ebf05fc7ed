"""Exact nearest neighbours by elimination over a full matrix of distances (AESA), block by block.

Objects come in blocks of bounded size. The task that holds a block computes all distances inside it once; each query then takes the
object of the smallest lower bound as its next pivot, and every distance that it computes raises the lower bounds of the others by
the triangle inequality, until no bound is below the k-th distance of the task so far. Many queries take their pivots at once, in
array operations. A query whose last pivots left most of its open objects open computes the distances to these in one go, since
another pivot costs more than it saves. Answers are exact for metrics; blocks are merged by a ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distances import DISTANCES
from nearfield.operators.search import QUERIES_AT_ONCE, blocks_of, distances_between, in_steps, matrix, ranked

#: Objects of one matrix: 1,024 x 1,024 doubles are 8 MB.
OBJECTS = 1024
MET = "qid long, id long, distance double, computations long"
COSTS = "qid long, nearest double, nearest_other double, computations long, others long"
#: Pivots that a query takes before it looks how many objects they left open.
SPAN = 4
#: Bounds are compared with this slack, so that rounding never drops an answer.
SLACK = 1e-9


def eliminate(q: np.ndarray, o: np.ndarray, between: np.ndarray, near: np.ndarray | None, radius: float, kind: str) -> np.ndarray:
    """The distances of each row of q to the rows of o that it computed; infinity for those that bounds left out.

    near has the k smallest distances of each query so far in ascending order, and takes in those found here; without it only the
    radius eliminates.
    """
    d, bound = np.full((len(q), len(o)), np.inf), np.zeros((len(q), len(o)))  # a bound of infinity: computed
    rows, left, taken = np.arange(len(q)), np.full(len(q), len(o)), 0

    def limit(at: np.ndarray) -> np.ndarray:
        return np.full(len(at), radius) if near is None else np.minimum(radius, near[at, -1])

    while len(rows) and taken < len(o) and (near is None or near.shape[1] < len(o)) and (near is not None or radius < np.inf):
        own, low, lines = q[rows], bound[rows], np.arange(len(rows))
        for _ in range(min(SPAN, len(o) - taken)):
            at = low.argmin(1)
            x = np.zeros(len(rows))
            for j in range(q.shape[1]):
                gap = np.abs(own[:, j] - o[at, j])
                x = np.maximum(x, gap) if kind == "linf" else x + (gap * gap if kind == "l2" else gap)
            x = np.sqrt(x) if kind == "l2" else x
            d[rows, at] = x
            np.maximum(low, np.abs(between[at] - x[:, None]), out=low)
            low[lines, at] = np.inf
            taken += 1
            if near is not None:
                near[rows] = np.sort(np.c_[near[rows], x], axis=1)[:, :-1]
        bound[rows] = low
        still = (low <= limit(rows)[:, None] + SLACK).sum(1)
        goes_on = (still > 0) & (4 * still <= 3 * left[rows])
        left[rows] = still
        rows = rows[goes_on]
    open_ = (bound <= limit(np.arange(len(q)))[:, None] + SLACK) & (bound < np.inf)
    if 4 * open_.sum() > open_.size:  # a matrix of all distances takes less time than some of its cells
        d, fresh = distances_between(q, o, kind), bound < np.inf
    else:
        i, j = np.nonzero(open_)
        x = np.zeros(len(i))
        for c in range(q.shape[1]):
            gap = np.abs(q[i, c] - o[j, c])
            x = np.maximum(x, gap) if kind == "linf" else x + (gap * gap if kind == "l2" else gap)
        d[i, j], fresh = np.sqrt(x) if kind == "l2" else x, open_
    if near is not None:
        near[:] = np.sort(np.c_[near, np.where(fresh, d, np.inf)], axis=1)[:, : near.shape[1]]
    return d


def elimination_hits(objects: DataFrame, queries: DataFrame, k: int, radius: float = float("inf"), distance: str = "l1", id: str = "id", vector: str = "v", only_costs: bool = False) -> DataFrame:
    """(qid, id, distance, computations): of every block its objects among the k nearest so far of each query, and the distances it took.

    A block without such an object gives a row of null id and distance, so that its computations count.
    """
    kind = DISTANCES[distance].kernel
    rows = objects.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("qid"), F.col(vector).alias("v"))

    def found(batches: Iterator[pa.RecordBatch], sent) -> Iterator[tuple]:
        """Of each block of objects and some queries: ids of both, distances, and the largest distance that can count."""
        qids, q = sent.value
        near = np.full((len(q), k), np.inf) if k <= OBJECTS else None
        for batch in batches:
            for start in range(0, len(batch), OBJECTS):
                part = batch.slice(start, OBJECTS)
                own, o = np.asarray(part.column("id")), matrix(part.column("v"))
                between = distances_between(o, o, kind)
                for low in range(0, len(q), QUERIES_AT_ONCE):
                    some = slice(low, low + QUERIES_AT_ONCE)
                    held = None if near is None else near[some]
                    d = eliminate(q[some], o, between, held, radius, kind)
                    yield qids[some], own, d, np.full(len(d), radius) if held is None else np.minimum(radius, held[:, -1])

    def hits(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        for qid, own, d, reach in found(batches, sent):
            keep = (d <= reach[:, None]) & (d < np.inf)
            i, j = np.nonzero(keep)
            order = np.lexsort((own[j], d[i, j], i))
            i, j = i[order], j[order]
            ends = np.cumsum(keep.sum(1))
            place = np.arange(len(i)) - np.repeat(ends - keep.sum(1), keep.sum(1))
            i, j, place = i[place < k], j[place < k], place[place < k]
            n = (d < np.inf).sum(1)
            none = np.flatnonzero(~keep.any(1))
            nulls = pa.nulls(len(none))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[qid[i], qid[none]]), pa.concat_arrays([pa.array(own[j], pa.int64()), nulls.cast(pa.int64())]), pa.concat_arrays([pa.array(d[i, j]), nulls.cast(pa.float64())]), pa.array(np.r_[np.where(place == 0, n[i], 0), n[none]])], ["qid", "id", "distance", "computations"])

    def costs(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
        for qid, _, d, _ in found(batches, sent):
            computed, other = d < np.inf, np.where(d > 0, d, np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(d.min(1)), pa.array(other.min(1)), pa.array(computed.sum(1)), pa.array((other < np.inf).sum(1))], ["qid", "nearest", "nearest_other", "computations", "others"])

    def meet(sent) -> DataFrame:
        return rows.mapInArrow(lambda batches: (costs if only_costs else hits)(batches, sent), COSTS if only_costs else MET)

    def send(block: list[tuple]):
        return objects.sparkSession.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block], float)))

    met = in_steps(blocks_of(asked, ["qid", "v"]), send, meet)
    return reduce(DataFrame.unionByName, met) if met else objects.sparkSession.createDataFrame([], COSTS if only_costs else MET)


def elimination_costs(objects: DataFrame, queries: DataFrame, k: int, radius: float = float("inf"), **names) -> DataFrame:
    """(qid, nearest, nearest_other, computations, others): what each query computed, and how many distances of these were above 0.

    nearest_other is the smallest distance above 0. The hits stay in the tasks, so k may be as large as the table.
    """
    met = elimination_hits(objects, queries, k, radius, only_costs=True, **names)
    out = met.groupBy("qid").agg(F.min("nearest").alias("nearest"), F.min("nearest_other").alias("nearest_other"), F.sum("computations").alias("computations"), F.sum("others").alias("others"))
    return out.select("qid", *(F.when(F.col(c) < float("inf"), F.col(c)).alias(c) for c in ("nearest", "nearest_other")), "computations", "others")


def elimination_search(objects: DataFrame, queries: DataFrame, k: int, radius: float = float("inf"), **names) -> DataFrame:
    """Exact top k within a radius: (qid, id, distance, rank)."""
    hits = elimination_hits(objects, queries, k, radius, **names).where("id is not null").select("qid", "id", "distance")
    return ranked(hits, k)


def search_costs(hits: DataFrame) -> DataFrame:
    """(qid, nearest, computations) of a search that reports computations: the rows of the cost histogram."""
    return hits.groupBy("qid").agg(F.min("distance").alias("nearest"), F.sum("computations").alias("computations"))
