"""k nearest neighbours within a range, exact: the queries are the small side and come in blocks of bounded size.

Results are (qid, id, distance, rank) in the total order (distance, id). Two ways give the same rows: an array kernel for vectors,
which keeps only k rows of each batch and query, and a join with any distance expression. Either way each block of queries meets
all objects in one scan, without a shuffle of the objects; the last step ranks at most k rows of each task and query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.functions.distances import DISTANCES
from nearfield.operators.counters import Counters
from nearfield.operators.filters import Filter
from nearfield.sources.stores import settled

#: Queries sent to the executors at once.
BLOCK = 4096
HITS = "qid long, id long, distance double"
OBJECTS_AT_ONCE = 1024
QUERIES_AT_ONCE = 256
#: Blocks of queries in one plan.
STEP = 16


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, without nulls."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances_between(q: np.ndarray, o: np.ndarray, kind: str) -> np.ndarray:
    """All distances, each summed from left to right in double, as the column expressions do."""
    out = np.zeros((len(q), len(o)))
    for j in range(q.shape[1]):
        d = np.abs(q[:, j, None] - o[None, :, j])
        if kind == "linf":
            np.maximum(out, d, out=out)
        else:
            out += d * d if kind == "l2" else d
    return np.sqrt(out) if kind == "l2" else out


def blocks_of(queries: DataFrame, columns: list[str], size: int = BLOCK) -> Iterator[list[tuple]]:
    """The queries in blocks; the driver holds one at a time."""
    block = []
    for row in queries.select(*columns).toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def in_steps(blocks: Iterator[list[tuple]], send, meet) -> list[DataFrame]:
    """Hits of all blocks of queries. send makes a block's broadcast, meet the hits from it.

    After every STEP blocks their hits are written and the broadcasts freed, so that neither the plan nor the driver's memory grows
    with the number of queries.
    """
    done, sent = [], []
    for block in blocks:
        if len(sent) == STEP:
            done.append(settled(reduce(DataFrame.unionByName, map(meet, sent)), "hits"))
            for own in sent:
                own.destroy()
            sent = []
        sent.append(send(block))
    return done + [meet(own) for own in sent]


def ranked(hits: DataFrame, k: int | None, largest: bool = False) -> DataFrame:
    """The first k hits of each query; rows beyond k leave before the shuffle (window group limit)."""
    order = Window.partitionBy("qid").orderBy(F.col("distance").desc() if largest else F.col("distance"), "id")
    out = hits.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k is not None else out


def vector_hits(objects: DataFrame, queries: DataFrame, distance: str = "l1", k: int | None = None, radius: float | str | None = None, id: str = "id", vector: str = "v", skip_equal: bool = False, largest: bool = False) -> DataFrame:
    """Unranked hits of the array kernel; at most k of each query and batch, within the radius. Null vectors never match.

    A radius is one number or the name of a column of queries.
    """
    kind = DISTANCES[distance].kernel
    if kind is None:
        raise ValueError(f"{distance} has no array kernel")
    rows = objects.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    within = F.col(radius) if isinstance(radius, str) else F.lit(float("inf") if radius is None else float(radius))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("qid"), F.col(vector).alias("v"), within.cast("double").alias("r"))

    def send(block: list[tuple]):
        return objects.sparkSession.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block], float), np.array([b[2] for b in block], float)))

    def meet(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q_all, reach = sent.value
            for batch in batches:
                for start in range(0, len(batch), OBJECTS_AT_ONCE):
                    part = batch.slice(start, OBJECTS_AT_ONCE)
                    own, o = np.asarray(part.column("id")), matrix(part.column("v"))
                    for low in range(0, len(ids), QUERIES_AT_ONCE):
                        q, qid = q_all[low : low + QUERIES_AT_ONCE], ids[low : low + QUERIES_AT_ONCE]
                        d = distances_between(q, o, kind)
                        keep = d <= reach[low : low + QUERIES_AT_ONCE, None]
                        if skip_equal:
                            keep &= d > 0
                        if k is not None and len(many := np.flatnonzero(keep.sum(1) > k)):
                            cost = np.where(keep[many], -d[many] if largest else d[many], np.inf)
                            order = np.lexsort((np.broadcast_to(own, cost.shape), cost), axis=1)[:, :k]
                            near = np.zeros(cost.shape, bool)
                            np.put_along_axis(near, order, True, axis=1)
                            keep[many] &= near
                        i, j = np.nonzero(keep)
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(own[j]), pa.array(d[i, j])], ["qid", "id", "distance"])

        return rows.mapInArrow(run, HITS)

    found = in_steps(blocks_of(asked, ["qid", "v", "r"]), send, meet)
    return reduce(DataFrame.unionByName, found) if found else objects.sparkSession.createDataFrame([], HITS)


def refined(objects: DataFrame, queries: DataFrame, first: DataFrame, k: int, distance: str = "l1", skip_equal: bool = False) -> DataFrame:
    """Exact top k after an approximate first pass: its k-th distance is the radius of one scan of all objects."""
    near = first.groupBy("qid").agg(F.max("distance").alias("reach"), F.count("*").alias("n")).where(F.col("n") >= k)
    known = queries.select("id", "v").join(near, F.col("id") == F.col("qid"), "left").select("id", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    return vector_search(objects, known, distance, k, "reach", skip_equal=skip_equal)


def vector_search(objects: DataFrame, queries: DataFrame, distance: str = "l1", k: int | None = None, radius: float | str | None = None, **names) -> DataFrame:
    """Top k within a radius by the array kernel."""
    return ranked(vector_hits(objects, queries, distance, k, radius, **names), k, names.get("largest", False))


def search(objects: DataFrame, queries: DataFrame, distance: str, payload: str, k: int | None = None, radius: Column | float | None = None, filter: Filter | None = None, id: str = "id", largest: bool = False, bound: Column | None = None) -> DataFrame:
    """Top k within a radius by any distance expression, over objects that pass the filter.

    The filter stands in the join condition, so it runs before the distance; the distance is computed once, in a struct that a
    later test reads. Queries go to every executor in blocks of BLOCK rows, one scan of the objects for each block. bound is a
    further condition over objects and queries (columns of queries have the prefix q_), as pivot filters give it.
    """
    schema, spark = queries.schema, queries.sparkSession
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    if queries.limit(BLOCK + 1).count() <= BLOCK:
        blocks = [named]
    else:
        blocks = [spark.createDataFrame(b, schema).toDF(*named.columns) for b in blocks_of(queries, queries.columns, BLOCK)]
    condition = F.col(payload).isNotNull() & F.col(f"q_{payload}").isNotNull()
    if filter is not None:
        condition &= filter(F.col, lambda c: F.col(f"q_{c}"))
    if bound is not None:
        condition &= bound
    d = DISTANCES[distance].of(F.col(f"q_{payload}"), F.col(payload)).cast("double")

    def meet(asked: DataFrame) -> DataFrame:
        both = objects.join(F.broadcast(asked), condition)
        if radius is None:
            return both.select(F.col(f"q_{id}").alias("qid"), F.col(id).alias("id"), d.alias("distance"))
        r = radius if isinstance(radius, Column) else F.lit(radius)
        held = F.array(F.struct(d.alias("d"), r.alias("r")))
        # explode keeps the optimizer from computing the distance once for the test and once for the result.
        pairs = both.select(F.col(f"q_{id}").alias("qid"), F.col(id).alias("id"), F.explode(held).alias("x")).where("x.d <= x.r")
        return pairs.select("qid", "id", F.col("x.d").alias("distance"))

    return ranked(reduce(DataFrame.unionByName, map(meet, blocks)), k, largest)


def full_match(objects: DataFrame, queries: DataFrame, distance: str = "l1", id: str = "id", vector: str = "v", filter_same: bool = False, largest: float = 1.7976931348623157e308) -> DataFrame:
    """All distances of each query in ascending order: (qid, rank, distance); with filter_same, equal objects move to the end."""
    hits = vector_hits(objects, queries, distance, id=id, vector=vector)
    value = F.when(F.col("distance") == 0, F.lit(largest)).otherwise(F.col("distance")) if filter_same else F.col("distance")
    return ranked_all(hits.withColumn("distance", value)).select("qid", "rank", "distance")


def ranked_all(hits: DataFrame) -> DataFrame:
    """All hits with their rank in (distance, id) for each query, without one task for a whole query.

    The hits are dealt into ranges of (qid, distance, id) and written; a rank is the place inside the range and query plus the
    number of the query's hits in earlier ranges.
    """
    dealt = settled(hits.repartitionByRange("qid", "distance", "id").withColumn("part", F.spark_partition_id()), "ranked")
    inside = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part", "qid").orderBy("distance", "id")))
    earlier = F.sum("n").over(Window.partitionBy("qid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = dealt.groupBy("qid", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(earlier, F.lit(0)))
    # One row for each query and range that holds hits of it.
    placed = inside.join(before.select("qid", "part", "before"), ["qid", "part"])
    return placed.withColumn("rank", (F.col("before") + F.col("at")).cast("int")).drop("part", "at", "before")


def knn_graph(objects: DataFrame, k: int, radius: float | None = None, distance: str = "l1", id: str = "id", vector: str = "v") -> DataFrame:
    """The k nearest other objects of every object (equal values excluded), block by block."""
    return vector_search(objects, objects, distance, k, radius, id=id, vector=vector, skip_equal=True)


def pivot_bounds(tuple_columns: list[str], radius: Column | float, slack: float = 1e-6) -> Column:
    """What d(q, o) <= radius implies for each pivot column, in the two-sided form that files can skip rows by. Metrics only."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    tests = [(F.col(c) >= F.col(f"q_{c}") - r - slack) & (F.col(c) <= F.col(f"q_{c}") + r + slack) for c in tuple_columns]
    return reduce(Column.__and__, tests)


def single_query_pivot_range(objects: DataFrame, pivots: dict[str, float], radius: float, slack: float = 1e-6) -> DataFrame:
    """Objects that one query's pivot distances allow; the literals reach the file scan as pushed filters."""
    tests = [F.col(c).between(d - radius - slack, d + radius + slack) for c, d in pivots.items()]
    return objects.where(reduce(Column.__and__, tests))


def nearest_by_projection(objects: DataFrame, queries: DataFrame, buckets: DataFrame, projected: Column, reads: int, k: int, distance: str = "l1", radius: float | None = None, id: str = "id", vector: str = "v", skip_equal: bool = False, counters: Counters | None = None, kind: str | None = None) -> DataFrame:
    """Approximate search: objects of the `reads` buckets nearest to the query's projection, by true distance.

    objects and queries have the columns bucket and vector; buckets holds the distinct ones. projected is the distance of q_bucket
    and bucket; ties go to the smaller bucket. Candidates are joined on the bucket, so only rows of chosen buckets are compared.
    kind tells that projected is the Hamming distance of sketches ('sketch') or the footrule of permutations ('permutation').
    """
    near = candidate_buckets(queries.select(F.col(id).alias("qid"), F.col("bucket").alias("q_bucket")), buckets, projected, reads, kind)
    asked = queries.select(F.col(id).alias("qid"), F.col(vector).alias("q_v"))
    if counters is not None:
        near = counters.watch(near, buckets_read=F.lit(1))
        asked = counters.watch(asked, queries=F.lit(1), pivot_vectors=F.lit(1))
    if counters is None and kind and DISTANCES[distance].kernel:
        return ranked(_picked_hits(objects, asked, near, k, distance, float("inf") if radius is None else float(radius), skip_equal, id, vector), k)
    picked = objects.select(F.col(id).alias("id"), F.col(vector).alias("v"), "bucket").join(near, "bucket").join(asked, "qid")
    if counters is not None:
        picked = counters.watch(picked, distances=F.lit(1))
    pairs = picked.select("qid", "id", DISTANCES[distance].of(F.col("q_v"), F.col("v")).alias("distance"))
    if radius is not None or skip_equal:
        pairs = pairs.select("qid", "id", F.explode(F.array("distance")).alias("distance"))  # computes it once
        pairs = pairs.where((F.col("distance") <= radius) if radius is not None else F.lit(True)).where((F.col("distance") > 0) if skip_equal else F.lit(True))
    return ranked(pairs, k)


def _first(i: np.ndarray, keys: list[np.ndarray], most: int) -> np.ndarray:
    """Places of the first entries of each i in the order of keys, the leading one first."""
    order = np.lexsort((*keys[::-1], i))
    own = i[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)]))
    return order[place < most]


def _bucket_keys(column: pa.Array) -> list:
    return [tuple(b) if isinstance(b, list) else b for b in column.to_pylist()]


def _picked_hits(objects: DataFrame, asked: DataFrame, near: DataFrame, k: int, distance: str, radius: float, skip_equal: bool, id: str, vector: str) -> DataFrame:
    """(qid, id, distance): of each task and query the k nearest objects in the query's chosen buckets.

    Blocks of queries meet all objects in one scan; only pairs of a query and an object of its buckets are compared.
    """
    kind = DISTANCES[distance].kernel
    rows = objects.where(F.col(vector).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), "bucket")
    chosen = near.groupBy("qid").agg(F.collect_list("bucket").alias("chosen"))  # a bounded number of reads
    queries = asked.where("q_v is not null").join(chosen, "qid").select(F.col("qid").cast("long").alias("qid"), "q_v", "chosen")

    def send(block: list[tuple]):
        of: dict = {}
        for i, (_, _, buckets) in enumerate(block):
            for b in buckets:
                of.setdefault(tuple(b) if isinstance(b, list) else b, []).append(i)
        return objects.sparkSession.sparkContext.broadcast((np.array([b[0] for b in block]), np.array([b[1] for b in block], float), {b: np.array(i) for b, i in of.items()}))

    def meet(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, of = sent.value
            reach = np.full(len(qids), radius)
            held: tuple = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.slice(start, 256)
                    own, o = np.asarray(part.column("id")), matrix(part.column("v"))
                    lists = [of.get(b, held[0][:0]) for b in _bucket_keys(part.column("bucket"))]
                    i_all = np.concatenate(lists)
                    j_all = np.repeat(np.arange(len(own)), [len(x) for x in lists])
                    for low in range(0, len(i_all), 100_000):
                        i, j = i_all[low : low + 100_000], j_all[low : low + 100_000]
                        d = np.zeros(len(i))
                        for c in range(q.shape[1]):
                            gap = np.abs(q[i, c] - o[j, c])
                            d = np.maximum(d, gap) if kind == "linf" else d + (gap * gap if kind == "l2" else gap)
                        d = np.sqrt(d) if kind == "l2" else d
                        keep = (d <= reach[i]) & (d > 0) if skip_equal else d <= reach[i]
                        if not keep.any():
                            continue
                        i, d, ids = (np.concatenate([x, y]) for x, y in zip(held, (i[keep], d[keep], own[j[keep]]), strict=True))
                        best = _first(i, [d, ids], k)
                        held = i[best], d[best], ids[best]
                        last = np.flatnonzero(np.r_[held[0][1:] != held[0][:-1], True])
                        full = np.diff(np.r_[-1, last]) == k
                        reach[held[0][last[full]]] = held[1][last[full]]
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(qids[held[0]]), pa.array(held[2]), pa.array(held[1])], ["qid", "id", "distance"])

        return rows.mapInArrow(run, HITS)

    found = in_steps(blocks_of(queries, ["qid", "q_v", "chosen"]), send, meet)
    return reduce(DataFrame.unionByName, found) if found else objects.sparkSession.createDataFrame([], HITS)


#: Distinct buckets that go to every task as an array; with more of them the buckets are joined and ranked as rows.
BUCKETS = 100_000


def candidate_buckets(queries: DataFrame, buckets: DataFrame, projected: Column, reads: int, kind: str | None = None) -> DataFrame:
    """(qid, bucket) of the nearest buckets of each query: one pass over the queries without a shuffle, where the buckets are few."""
    held = buckets.select("bucket").limit(BUCKETS + 1).collect() if kind else []  # at most BUCKETS + 1 projections
    if held and len(held) <= BUCKETS:
        return _nearest_buckets(queries, sorted(r[0] for r in held), reads, kind)
    order = Window.partitionBy("qid").orderBy("p", "bucket")
    if kind == "sketch":
        pairs = _nearest_of_each_task(queries, buckets, reads)
        return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= reads).select("qid", "bucket")
    pairs = queries.join(buckets.select("bucket"), F.lit(True)).select("qid", "bucket", projected.alias("p"))
    return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= reads).select("qid", "bucket")


def _nearest_buckets(queries: DataFrame, buckets: list, reads: int, kind: str) -> DataFrame:
    """The first buckets in the order (distance, bucket) of each query; buckets ascend."""
    sent = queries.sparkSession.sparkContext.broadcast(np.array(buckets, np.int64).reshape(len(buckets), -1))
    target = queries.select("qid", F.col("q_bucket").alias("bucket"))
    schema = target.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        places = np.argsort(table, 1)
        for batch in batches:
            for start in range(0, len(batch), rows := max(1, 2_000_000 // (len(table) * table.shape[1]))):
                part = batch.slice(start, rows)
                own = part.column("bucket")
                q = np.asarray(own.flatten() if pa.types.is_list(own.type) else own).astype(np.int64).reshape(len(part), -1)
                if kind == "sketch":
                    d = np.bitwise_count(q[:, None] ^ table[None]).sum(2, dtype=np.int64)
                else:
                    d = np.abs(np.argsort(q, 1)[:, None] - places[None]).sum(2)
                best = np.argsort(d, axis=1, kind="stable")[:, :reads]
                found = table[best.ravel()]
                bucket = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * table.shape[1], pa.array(found.ravel(), own.type.value_type)) if pa.types.is_list(own.type) else pa.array(found[:, 0], own.type)
                yield pa.RecordBatch.from_arrays([part.column("qid").take(pa.array(np.repeat(np.arange(len(part)), best.shape[1]))), bucket], ["qid", "bucket"])

    return target.mapInArrow(run, schema)


def _nearest_of_each_task(queries: DataFrame, buckets: DataFrame, reads: int) -> DataFrame:
    """(qid, bucket, p): the first sketches of each task and query in the order (distance p, sketch), for any number of sketches."""
    table = buckets.select("bucket")
    made = queries.select("qid", F.col("q_bucket").alias("bucket"), F.lit(0).cast("long").alias("p")).schema

    def send(block: list[tuple]):
        return queries.sparkSession.sparkContext.broadcast(([b[0] for b in block], np.array([b[1] for b in block], np.int64).reshape(len(block), -1)))

    def meet(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            reach = np.full(len(q), 1 << 30)
            held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, q.shape[1]), np.int64)
            kind = None
            for batch in batches:
                column = batch.column("bucket")
                kind = column.type
                own = np.asarray(column.flatten() if pa.types.is_list(kind) else column).astype(np.int64).reshape(len(column), -1)
                for low in range(0, len(q), rows := max(1, 1_000_000 // max(1, own.size))):
                    d = np.bitwise_count(q[low : low + rows, None] ^ own[None]).sum(2, dtype=np.int64)
                    i, j = np.nonzero(d <= reach[low : low + rows, None])
                    if not len(i):
                        continue
                    mine = (held[0] >= low) & (held[0] < low + rows)
                    at, p, words = (np.concatenate([x[mine], y]) for x, y in zip(held, (i + low, d[i, j], own[j]), strict=True))
                    best = _first(at, [p, *words.T], reads)
                    at, p, words = at[best], p[best], words[best]
                    last = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
                    full = np.diff(np.r_[-1, last]) == reads
                    reach[at[last[full]]] = p[last[full]]
                    held = tuple(np.concatenate([x[~mine], y]) for x, y in zip(held, (at, p, words), strict=True))
            if len(held[0]):
                words = pa.array(held[2].ravel())
                found = pa.ListArray.from_arrays(np.arange(len(held[2]) + 1, dtype=np.int32) * q.shape[1], words) if pa.types.is_list(kind) else words
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in held[0].tolist()]), found, pa.array(held[1])], ["qid", "bucket", "p"])

        return table.mapInArrow(run, made)

    found = in_steps(blocks_of(queries, ["qid", "q_bucket"]), send, meet)
    return reduce(DataFrame.unionByName, found) if found else queries.sparkSession.createDataFrame([], made)


def edit_distance_join(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """(a, b, distance) of strings at most limit apart: an equi-join on length, over the lengths the limit allows."""
    left = a.select(F.col("text").alias("a"), F.explode(F.sequence(F.length("text") - limit, F.length("text") + limit)).alias("n"))
    right = b.select(F.col("text").alias("b"), F.length("text").alias("n"))
    d = F.explode(F.array(F.levenshtein("a", "b", limit))).alias("distance")
    return left.join(right, "n").where(F.col("a") < F.col("b")).select("a", "b", d).where("distance >= 0")


#: Queries of one table of term counts, and words of the queries that are sent at once.
TERM_QUERIES, TERM_WORDS = 64, 4_000_000


class TermCounts:
    """Counts of the terms of some queries: a row for each term, a column for each query."""

    def __init__(self, queries: list[tuple[int, str]]):
        self.ids = np.array([q for q, _ in queries], np.int64)
        split = [t.split(" ") for _, t in queries]
        self.totals = np.array([len(t) for t in split], np.int64)
        self.rows = {t: i for i, t in enumerate(dict.fromkeys(t for own in split for t in own))}
        self.counts = np.zeros((len(self.rows), len(queries)), np.int32)
        for c, own in enumerate(split):
            np.add.at(self.counts[:, c], [self.rows[t] for t in own], 1)

    def shared(self, terms: np.ndarray, documents: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """For each document and query the sum over terms of the smaller count; the triples ascend by document."""
        out = np.zeros((n, len(self.ids)), np.int64)
        for low in range(0, len(terms), 20_000):
            part = slice(low, low + 20_000)
            least = np.minimum(self.counts[terms[part]], times[part, None])
            starts = np.flatnonzero(np.r_[True, np.diff(documents[part]) != 0])
            np.add.at(out, documents[part][starts], np.add.reduceat(least, starts, axis=0))
        return out


def term_l1_search(documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k by L1 of term counts: both totals less twice the shared counts, in one scan of the documents for each block of queries.

    Both sides have (id, text); terms stand between single spaces; null texts match nothing. Every task counts a document's terms
    once and meets them with tables of the queries' counts; k rows of each batch and query go on to the ranking.
    """
    rows = documents.where("text is not null").select(F.col("id").cast("long").alias("id"), "text")
    asked = queries.where("text is not null").select(F.col("id").cast("long").alias("qid"), "text")

    def blocks() -> Iterator[list[tuple[int, str]]]:
        block, words = [], 0
        for row in asked.toLocalIterator():
            block.append(tuple(row))
            words += row[1].count(" ") + 1
            if len(block) == BLOCK or words >= TERM_WORDS:
                yield block
                block, words = [], 0
        if block:
            yield block

    def send(block: list[tuple[int, str]]):
        return documents.sparkSession.sparkContext.broadcast(block)  # at most TERM_WORDS words, or one query

    def meet(sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [TermCounts(sent.value[i : i + TERM_QUERIES]) for i in range(0, len(sent.value), TERM_QUERIES)]
            for batch in batches:
                for start in range(0, len(batch), 500):
                    part = batch.slice(start, 500)
                    own = np.asarray(part.column("id"))
                    lists = pc.split_pattern(part.column("text"), " ")
                    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
                    coded = pc.list_flatten(lists).dictionary_encode()
                    names = coded.dictionary.to_pylist()
                    width = max(1, len(names))
                    pairs, times = np.unique(np.repeat(np.arange(len(own)), sizes) * width + np.asarray(coded.indices), return_counts=True)
                    document, term = pairs // width, pairs % width
                    for table in tables:
                        place = np.array([table.rows.get(t, -1) for t in names], np.int64)[term]
                        known = place >= 0
                        met = table.shared(place[known], document[known], times[known], len(own))
                        d = (table.totals[:, None] + sizes[None] - 2 * met.T).astype(np.int64)
                        order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :k]
                        i = np.repeat(np.arange(len(d)), order.shape[1])
                        j = order.ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(table.ids[i]), pa.array(own[j]), pa.array(d[i, j])], ["qid", "id", "distance"])

        return rows.mapInArrow(run, "qid long, id long, distance long")

    found = in_steps(blocks(), send, meet)
    return ranked(reduce(DataFrame.unionByName, found), k) if found else ranked(documents.sparkSession.createDataFrame([], "qid long, id long, distance long"), k)
