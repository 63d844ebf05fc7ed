"""Registered queries of the similarity operators over the benchmark tables, and SQL that gives the same rows.

Where a search has a query set it is every row whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import projections, trees, values
from nearfield.operators import aesa, filters, metrics, mutation, pivots, search, sketches, stats
from nearfield.plans.index import Index, bucket_order
from nearfield.sources.stores import KeyedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BITS, PIVOTS, READS = 8, 4, 6


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _asked(objects: DataFrame, id: str = "id") -> DataFrame:
    return objects.where(F.col(id) % 100 == 0)


def _hits(found: DataFrame) -> DataFrame:
    return found.select("qid", "id", "distance", F.col("rank").cast("long").alias("rank"))


# ---- SQL building blocks ---------------------------------------------------------------------------------------------


def _l1(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE)), lambda s, y: s + y)"


PAIRS = f"p AS (SELECT q.vec_id AS qid, o.vec_id AS id, q.label AS ql, o.label AS ol, {_l1('q.embedding', 'o.embedding')} AS distance FROM embeddings q, embeddings o WHERE q.vec_id % 100 = 0)"


def _top(source: str, k: int | None, where: str = "true", order: str = "distance, id") -> str:
    limit = f"WHERE rank <= {k}" if k else ""
    return f"SELECT qid, id, distance, rank FROM (SELECT qid, id, distance, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM {source} WHERE {where}) {limit}"


def _pivot_sql(n: int) -> str:
    return f"""piv AS (SELECT * FROM (SELECT vec_id AS pid, embedding, row_number() OVER (ORDER BY md5('pivot:' || vec_id::VARCHAR), vec_id) - 1 AS i FROM embeddings) WHERE i < {n}),
        pd AS (SELECT o.vec_id AS id, p.i, {_l1('o.embedding', 'p.embedding')} AS d FROM embeddings o, piv p)"""


SKETCH = f"""{_pivot_sql(2 * BITS)},
        sk AS (SELECT a.id, sum(CASE WHEN a.d > b.d THEN 1 << (a.i // 2)::INT ELSE 0 END)::BIGINT AS bucket FROM pd a JOIN pd b ON a.id = b.id AND b.i = a.i + 1 WHERE a.i % 2 = 0 GROUP BY a.id)"""
PERMUTED = f"""{_pivot_sql(PIVOTS)},
        sk AS (SELECT id, string_agg(i::VARCHAR, ',' ORDER BY d, i) AS bucket FROM pd GROUP BY id)"""
FOOTRULE = f"list_sum(list_transform(range(0, {PIVOTS}), lambda i: abs(list_position(string_split(a.bucket, ','), i::VARCHAR) - list_position(string_split(b.bucket, ','), i::VARCHAR))))::BIGINT"
HAMMING = "bit_count(xor(a.bucket, b.bucket))::BIGINT"


def _order_sql(projected: str, asked: str = "a.id % 100 = 0") -> str:
    return f"""bk AS (SELECT bucket, count(*) AS n FROM sk GROUP BY bucket),
        ord AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY projected, bucket) AS place FROM (SELECT a.id AS qid, b.bucket, b.n, {projected} AS projected FROM sk a, bk b WHERE {asked}))"""


def _found_sql(reads: int, k: int, where: str = "true") -> str:
    return f"""cand AS (SELECT o.qid, s.id, {_l1('q.embedding', 'e.embedding')} AS distance FROM ord o JOIN sk s USING (bucket) JOIN embeddings q ON q.vec_id = o.qid JOIN embeddings e ON e.vec_id = s.id WHERE o.place <= {reads}),
        found AS ({_top('cand', k, where)})"""


# ---- Searches --------------------------------------------------------------------------------------------------------


@_query(f"WITH {PAIRS} {_top('p', 5)}")
def exact_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.vector_search(v, _asked(v), "l1", 5))


@_query(f"WITH {PAIRS} {_top('p', None, 'distance <= 8.5')}")
def exact_range(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.vector_search(v, _asked(v), "l1", None, 8.5))


@_query(f"WITH {PAIRS} {_top('p', 3, 'distance <= 8.0')}")
def exact_range_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.vector_search(v, _asked(v), "l1", 3, 8.0))


@_query(f"WITH {PAIRS} {_top('p', 5, '(ol > ql OR ol + 2 = ql) AND distance > 0')}")
def filtered_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    higher = filters.any_of(filters.where(lambda o, q: o > q, "label"), filters.where(lambda o, q: o + 2 == q, "label"))
    return _hits(search.search(v, _asked(v), "l1", "v", 5, filter=filters.all_of(higher, filters.not_equal("v"))))


@_query(f"WITH {PAIRS} {_top('p', 5, 'true', 'distance DESC, id')}")
def farthest_k(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.vector_search(v, _asked(v), "l1", 5, largest=True))


@_query(f"""WITH {PAIRS} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id) - count(*) FILTER (distance = 0) OVER (PARTITION BY qid) AS rank, distance
        FROM p QUALIFY distance > 0""")
def full_match_sorted(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    found = search.full_match(v, _asked(v))
    same = found.where("distance = 0").groupBy("qid").agg(F.count("*").alias("n"))
    return found.where("distance > 0").join(same, "qid").select("qid", (F.col("rank") - F.col("n")).alias("rank"), "distance")


@_query(f"WITH p AS (SELECT q.vec_id AS qid, o.vec_id AS id, {_l1('q.embedding', 'o.embedding')} AS distance FROM embeddings q, embeddings o) {_top('p', 3, 'distance > 0')}")
def knn_graph_exact(spark, sf_dir):
    return _hits(search.knn_graph(_vectors(spark, sf_dir), 3))


@_query("""WITH n AS (SELECT DISTINCT p_name AS t FROM part)
        SELECT a.t AS a, b.t AS b, levenshtein(a.t, b.t)::INT AS distance FROM n a, n b WHERE a.t < b.t AND levenshtein(a.t, b.t) <= 6""")
def levenshtein_range_join(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    return search.edit_distance_join(names, names, 6)


@_query(f"""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
        s AS (SELECT doc_id, len(string_split(text, ' ')) AS total FROM documents),
        sh AS (SELECT a.doc_id AS qid, b.doc_id AS id, sum(least(a.n, b.n)) AS met FROM c a JOIN c b USING (term) WHERE a.doc_id % 100 = 0 GROUP BY ALL),
        p AS (SELECT q.doc_id AS qid, o.doc_id AS id, (q.total + o.total - 2 * coalesce(met, 0))::BIGINT AS distance FROM s q CROSS JOIN s o LEFT JOIN sh ON sh.qid = q.doc_id AND sh.id = o.doc_id WHERE q.doc_id % 100 = 0)
        {_top('p', 5)}""")
def term_l1_knn(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return _hits(search.term_l1_search(docs, _asked(docs), 5))


@_query(f"""WITH p AS (SELECT q.vec_id AS qid, o.vec_id AS id, sqrt(list_reduce(list_transform(list_zip(q.embedding, o.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)), lambda s, y: s + y)) AS distance
        FROM embeddings q, embeddings o WHERE q.vec_id % 100 = 0) {_top('p', 5)}""")
def l2_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.vector_search(v, _asked(v), "l2", 5))


@_query(f"""WITH p AS (SELECT q.vec_id AS qid, o.vec_id AS id, list_max(list_transform(list_zip(q.embedding, o.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS distance
        FROM embeddings q, embeddings o WHERE q.vec_id % 100 = 0) {_top('p', 5)}""")
def linf_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(search.vector_search(v, _asked(v), "linf", 5))


# ---- Pivots and projections ------------------------------------------------------------------------------------------


def _with_tuple(v: DataFrame, n: int) -> DataFrame:
    _, x = pivots.collected(pivots.random_pivots(v, n))
    return pivots.with_pivot_distances(v, x)


def _sketched(v: DataFrame) -> DataFrame:
    return _with_tuple(v, 2 * BITS).withColumn("bucket", projections.bit_sketch(F.col("tuple"), BITS))


def _permuted(v: DataFrame) -> DataFrame:
    return _with_tuple(v, PIVOTS).withColumn("bucket", projections.permutation(F.col("tuple")))


def _spelled(bucket: str = "bucket"):
    return F.concat_ws(",", F.col(bucket)).alias(bucket)


@_query(f"WITH {_pivot_sql(PIVOTS)} SELECT id, i, d FROM pd")
def pivot_tuple(spark, sf_dir):
    return _with_tuple(_vectors(spark, sf_dir), PIVOTS).select("id", F.posexplode("tuple").alias("i", "d")).select("id", F.col("i").cast("long").alias("i"), "d")


POINTS = "pt AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"


def _points(spark, sf_dir) -> DataFrame:
    """Points of two dimensions with the distances to two pivots."""
    points = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("v"))
    return _with_tuple(points, 2).select("id", "v", F.col("tuple")[0].alias("p0"), F.col("tuple")[1].alias("p1"))


@_query(f"WITH {POINTS} SELECT q.id AS qid, o.id, abs(q.x - o.x) + abs(q.y - o.y) AS distance, row_number() OVER (PARTITION BY q.id ORDER BY abs(q.x - o.x) + abs(q.y - o.y), o.id) AS rank FROM pt q, pt o WHERE q.id % 100 = 0 AND abs(q.x - o.x) + abs(q.y - o.y) <= 10")
def pivot_filtered_range(spark, sf_dir):
    points = _points(spark, sf_dir)
    return _hits(search.search(points, _asked(points), "l1", "v", None, 10.0, bound=search.pivot_bounds(["p0", "p1"], 10.0)))


@_query(f"""WITH {POINTS}, piv AS (SELECT x, y FROM pt ORDER BY md5('pivot:' || id::VARCHAR), id LIMIT 1), k AS (SELECT pt.id, abs(pt.x - piv.x) + abs(pt.y - piv.y) AS p0 FROM pt, piv)
        SELECT q.id AS qid, count(*) AS n_candidates FROM k q JOIN k o ON o.p0 BETWEEN q.p0 - 10.000001 AND q.p0 + 10.000001 WHERE q.id % 100 = 0 GROUP BY q.id""")
def secondary_pivot_range(spark, sf_dir):
    keys = _points(spark, sf_dir).select("id", "p0")
    asked = _asked(keys).select(F.col("id").alias("qid"), F.col("p0").alias("q_p0"))
    return keys.join(asked, search.pivot_bounds(["p0"], 10.0)).groupBy("qid").agg(F.count("*").alias("n_candidates"))


@_query(f"""WITH {_pivot_sql(PIVOTS)} SELECT qid, count(*) AS n_candidates FROM (SELECT q.id AS qid, o.id FROM pd q JOIN pd o USING (i) WHERE q.id % 100 = 0
        GROUP BY q.id, o.id HAVING bool_and(greatest(q.d - 2.0::DOUBLE, 0) <= o.d AND o.d <= q.d + 2.0::DOUBLE)) GROUP BY qid""")
def pivot_rectangle_overlap(spark, sf_dir):
    t = _with_tuple(_vectors(spark, sf_dir), PIVOTS).select("id", "tuple")
    low, high = projections.rectangle(F.col("q_tuple"), 2.0)
    asked = _asked(t).select(F.col("id").alias("qid"), F.col("tuple").alias("q_tuple"))
    return t.join(asked, projections.overlaps(low, high, F.col("tuple"), F.col("tuple"))).groupBy("qid").agg(F.count("*").alias("n_candidates"))


@_query(f"WITH {SKETCH} SELECT id, bucket FROM sk")
def bit_sketch(spark, sf_dir):
    return _sketched(_vectors(spark, sf_dir)).select("id", "bucket")


@_query(f"WITH {SKETCH} SELECT bucket, bit_count(bucket)::BIGINT AS ones, count(*) AS n FROM sk GROUP BY bucket")
def sketch_distinct(spark, sf_dir):
    return stats.bucket_sizes(_sketched(_vectors(spark, sf_dir))).select("bucket", F.bit_count("bucket").cast("long").alias("ones"), "n")


def _orders(v: DataFrame, projected) -> DataFrame:
    asked = _asked(v).select(F.col("id").alias("qid"), F.col("bucket").alias("q_bucket"))
    return bucket_order(asked, stats.bucket_sizes(v), projected)


def _by_hamming(v: DataFrame) -> DataFrame:
    return _orders(v, projections.hamming(F.col("q_bucket"), F.col("bucket")))


@_query(f"WITH {SKETCH}, {_order_sql(HAMMING)} SELECT qid, bucket, projected, place FROM ord WHERE place <= {READS}")
def hamming_rank(spark, sf_dir):
    return _by_hamming(_sketched(_vectors(spark, sf_dir))).where(F.col("place") <= READS).select("qid", "bucket", "projected", "place")


def _approximate(v: DataFrame, asked: DataFrame, k: int, reads: int, permuted: bool = False, **options) -> DataFrame:
    of = projections.footrule if permuted else projections.hamming
    return search.nearest_by_projection(v, asked, stats.bucket_sizes(v), of(F.col("q_bucket"), F.col("bucket")), reads, k, kind="permutation" if permuted else "sketch", **options)


@_query(f"WITH {SKETCH}, {_order_sql(HAMMING)}, {_found_sql(READS, 3)} SELECT * FROM found")
def sketch_first_pass(spark, sf_dir):
    """The first pass of sketch_knn alone: objects of the READS nearest buckets, by true distance."""
    v = _sketched(_vectors(spark, sf_dir))
    return _hits(_approximate(v, _asked(v), 3, READS))


@_query(f"WITH {PAIRS} {_top('p', 3)}")
def sketch_knn(spark, sf_dir):
    """Exact through the index: the first pass bounds the radius of the second, so recall is 1 at any size."""
    v = _sketched(_vectors(spark, sf_dir))
    return _hits(search.refined(v, _asked(v), _approximate(v, _asked(v), 3, READS), 3))


LONG_BITS = 128
LONG_SKETCH = f"""{_pivot_sql(2 * LONG_BITS)},
        bits AS (SELECT a.id, a.i // 2 AS bit, a.d > b.d AS held FROM pd a JOIN pd b ON a.id = b.id AND b.i = a.i + 1 WHERE a.i % 2 = 0),
        sk AS (SELECT id, list_value({', '.join(f'sum(CASE WHEN held AND bit // 62 = {w} THEN 1::BIGINT << (bit % 62)::INT ELSE 0 END)::BIGINT' for w in range(3))}) AS bucket FROM bits GROUP BY id)"""
LONG_HAMMING = "list_sum(list_transform(list_zip(a.bucket, b.bucket), lambda x: bit_count(xor(x[1], x[2]))))::BIGINT"


@_query(f"WITH {LONG_SKETCH}, {_order_sql(LONG_HAMMING)}, {_found_sql(40, 3)} SELECT * FROM found")
def sketch_knn_128(spark, sf_dir):
    """The first pass with sketches of three words."""
    v = _with_tuple(_vectors(spark, sf_dir), 2 * LONG_BITS).withColumn("bucket", projections.bit_sketch(F.col("tuple"), LONG_BITS))
    of = projections.hamming(F.col("q_bucket"), F.col("bucket"), LONG_BITS)
    return _hits(search.nearest_by_projection(v, _asked(v), stats.bucket_sizes(v), of, 40, 3, kind="sketch"))


@_query(f"WITH p AS (SELECT q.vec_id AS qid, o.vec_id AS id, {_l1('q.embedding', 'o.embedding')} AS distance FROM embeddings q, embeddings o) {_top('p', 3, 'distance > 0')}")
def sketch_knn_graph(spark, sf_dir):
    """The exact graph through the index: each object's first pass bounds its radius."""
    v = _sketched(_vectors(spark, sf_dir))
    return _hits(search.refined(v, v, _approximate(v, v, 3, READS, skip_equal=True), 3, skip_equal=True))


@_query(f"WITH {PAIRS} {_top('p', None, 'distance <= 8.5')}")
def sketch_range(spark, sf_dir):
    """Exact range through the sketches: hyperplane bounds leave out buckets."""
    v = _vectors(spark, sf_dir)
    ids, x = pivots.collected(pivots.random_pivots(v, 2 * BITS))
    objects = _sketched(v).select("id", "v", "bucket")
    return _hits(Index("sketch", objects, ids.tolist(), x, BITS, {}).range_search(_asked(objects).select("id", "v"), 8.5))


@_query(f"WITH {PAIRS} {_top('p', 5)}")
def elimination_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(aesa.elimination_search(v, _asked(v), 5))


@_query(f"WITH {PAIRS} SELECT qid, min(distance) AS nearest, count(*) AS n_objects FROM p WHERE distance > 0 GROUP BY qid")
def elimination_nearest(spark, sf_dir):
    """The nearest other object of each query, and how many others it computes the distance of when nothing is eliminated."""
    v = _vectors(spark, sf_dir)
    costs = aesa.elimination_costs(v, _asked(v), 1 << 30).where("others > 0")
    return costs.select("qid", F.col("nearest_other").alias("nearest"), F.col("others").alias("n_objects"))


@_query(f"WITH {SKETCH}, s AS (SELECT DISTINCT bucket AS sketch FROM sk), d AS (SELECT a.id AS qid, s.sketch, bit_count(xor(a.bucket, s.sketch))::BIGINT AS distance FROM sk a, s WHERE a.id % 100 = 0) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, sketch) AS rank FROM d")
def sketch_set_full(spark, sf_dir):
    v = _sketched(_vectors(spark, sf_dir))
    return sketches.search_sketches(sketches.sketch_set(v), _asked(v).select(F.col("id").alias("qid"), F.col("bucket").alias("sketch")))


@_query(f"WITH {PERMUTED} SELECT id, bucket FROM sk")
def permutation(spark, sf_dir):
    return _permuted(_vectors(spark, sf_dir)).select("id", _spelled())


@_query(f"WITH {PERMUTED}, {_order_sql(FOOTRULE)} SELECT qid, bucket, projected, place FROM ord WHERE place <= {READS}")
def footrule_rank(spark, sf_dir):
    v = _permuted(_vectors(spark, sf_dir))
    return _orders(v, projections.footrule(F.col("q_bucket"), F.col("bucket"))).where(F.col("place") <= READS).select("qid", _spelled(), "projected", "place")


@_query(f"WITH {PERMUTED}, {_order_sql(FOOTRULE)}, {_found_sql(READS, 3)} SELECT * FROM found")
def permutation_first_pass(spark, sf_dir):
    """The first pass of permutation_knn alone."""
    v = _permuted(_vectors(spark, sf_dir))
    return _hits(_approximate(v, _asked(v), 3, READS, True))


@_query(f"WITH {PAIRS} {_top('p', 3)}")
def permutation_knn(spark, sf_dir):
    """Exact through the index, as sketch_knn."""
    v = _permuted(_vectors(spark, sf_dir))
    return _hits(search.refined(v, _asked(v), _approximate(v, _asked(v), 3, READS, True), 3))


@_query(f"WITH {SKETCH} SELECT (i * 1)::INT AS bit, count(*) FILTER ((bucket >> i::INT) & 1 = 1) AS ones, count(*) FILTER ((bucket >> i::INT) & 1 = 0) AS zeros, abs(count(*) - 2 * count(*) FILTER ((bucket >> i::INT) & 1 = 1)) AS imbalance FROM sk, range({BITS}) r(i) GROUP BY i")
def sketch_balance(spark, sf_dir):
    return stats.sketch_balance(_sketched(_vectors(spark, sf_dir)), BITS)


# ---- Statistics ------------------------------------------------------------------------------------------------------


@_query(f"WITH {PERMUTED} SELECT bucket, count(*) AS n FROM sk GROUP BY bucket")
def bucket_sizes(spark, sf_dir):
    return stats.bucket_sizes(_permuted(_vectors(spark, sf_dir))).select(_spelled(), "n")


@_query(f"WITH {SKETCH}, b AS (SELECT count(*)::DOUBLE AS n FROM sk GROUP BY bucket) SELECT count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS low, max(n) AS high FROM b")
def bucket_size_stats(spark, sf_dir):
    out = stats.bucket_size_stats(_sketched(_vectors(spark, sf_dir)))
    return out.select("n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


@_query(f"""WITH {SKETCH}, p AS (SELECT {HAMMING} AS hamming, {_l1('q.embedding', 'o.embedding')} AS d FROM sk a JOIN embeddings q ON q.vec_id = a.id, sk b JOIN embeddings o ON o.vec_id = b.id WHERE a.id % 100 = 0)
        SELECT hamming, count(*) AS n, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, min(d) AS low, max(d) AS high FROM p GROUP BY hamming""")
def distance_by_hamming(spark, sf_dir):
    v = _sketched(_vectors(spark, sf_dir))
    hits = search.vector_hits(v, _asked(v))
    b = v.select("id", "bucket")
    both = hits.join(b, "id").join(b.select(F.col("id").alias("qid"), F.col("bucket").alias("q_bucket")), "qid")
    both = both.withColumn("hamming", projections.hamming(F.col("q_bucket"), F.col("bucket")).cast("long"))
    return stats.moments(both, F.col("distance"), ["hamming"]).select("hamming", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


NEEDED = f"WITH {SKETCH}, {_order_sql(HAMMING)}, c AS (SELECT qid, place, sum(n) OVER (PARTITION BY qid ORDER BY place) AS seen FROM ord), nd AS (SELECT qid, k, min(place) AS needed FROM c, (VALUES (1), (3), (10), (50)) t(k) WHERE seen >= k GROUP BY qid, k)"


@_query(f"{NEEDED} SELECT qid, k::INT AS k, needed FROM nd")
def buckets_needed_per_k(spark, sf_dir):
    return stats.buckets_needed(_by_hamming(_sketched(_vectors(spark, sf_dir))), [1, 3, 10, 50])


@_query(f"{NEEDED} SELECT k::INT AS k, greatest(round(avg(needed) + 3 * coalesce(stddev_samp(needed), 0)), 1)::BIGINT AS buckets FROM nd GROUP BY k")
def estimate_k(spark, sf_dir):
    return stats.estimate_k(buckets_needed_per_k(spark, sf_dir))


@_query(f"WITH {PAIRS} SELECT round(pow(avg(distance), 2) / (2 * var_samp(distance)), 4) AS dimension FROM p WHERE distance > 0")
def intrinsic_dimension(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return stats.intrinsic_dimension(search.vector_hits(v, _asked(v), skip_equal=True)).select(F.round("dimension", 4).alias("dimension"))


@_query(f"WITH {PAIRS} SELECT floor(distance / 0.5::DOUBLE)::BIGINT AS cell, count(*) AS n FROM p GROUP BY cell")
def distance_histogram(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return stats.distance_histogram(search.vector_hits(v, _asked(v)), 0.5)


@_query("WITH c AS (SELECT user_id, count(*) AS times FROM events GROUP BY user_id) SELECT times, count(*) AS n_values FROM c GROUP BY times")
def multiset_distribution(spark, sf_dir):
    return stats.multiset_distribution(_table(spark, sf_dir, "events"), "user_id")


@_query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS middle FROM lineitem GROUP BY l_returnflag")
def middle_value(spark, sf_dir):
    return values.middle(_table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])


@_query("SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def bloom_semi_join(spark, sf_dir):
    """Customers with orders: the filter drops most others, an exact semi join the rest."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    words = values.bloom_filter(orders, "id")
    near = values.bloom_candidates(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", words)
    return near.join(orders, "id", "left_semi")


@_query("SELECT o_orderkey AS id, o_custkey AS whole, o_totalprice AS price, lower(right(concat('0000000000000000', to_hex(o_custkey)), 16)) AS spelled FROM orders")
def bytes_round_trip(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), values.to_bytes(F.col("o_custkey"), "long").alias("whole"), values.to_bytes(F.col("o_totalprice"), "double").alias("price"))
    return rows.select("id", values.from_bytes(F.col("whole"), "long").alias("whole"), values.from_bytes(F.col("price"), "double").alias("price"), F.lower(F.hex("whole")).alias("spelled"))


# ---- Quality of results ----------------------------------------------------------------------------------------------

QUALITY = f"WITH {SKETCH}, {_order_sql(HAMMING)}, {_found_sql(40, 10)}, {PAIRS}, fullm AS ({_top('p', None)}), truth AS (SELECT * FROM fullm WHERE rank <= 10)"
PLACED = "nf AS (SELECT qid, count(*) AS n_found FROM found GROUP BY qid), na AS (SELECT qid, count(*) AS n_full FROM fullm GROUP BY qid), pl AS (SELECT qid, distance, min(rank) AS place FROM fullm GROUP BY qid, distance), pf AS (SELECT f.*, place, n_found, n_full FROM found f JOIN pl USING (qid, distance) JOIN nf USING (qid) JOIN na USING (qid))"


def _results(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = _sketched(_vectors(spark, sf_dir))
    asked = _asked(v)
    full = search.vector_search(v, asked, "l1")
    return _approximate(v, asked, 10, 40), full.where("rank <= 10"), full


def _rounded(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("qid", F.round(name, 6).alias(name))


@_query(f"{QUALITY}, t AS (SELECT qid, distance, count(*) AS n FROM truth GROUP BY ALL), f AS (SELECT qid, distance, count(*) AS m FROM found GROUP BY ALL) SELECT qid, round(coalesce(sum(least(n, coalesce(m, 0))), 0) / sum(n), 6)::DOUBLE AS recall FROM t LEFT JOIN f USING (qid, distance) GROUP BY qid")
def recall(spark, sf_dir):
    found, truth, _ = _results(spark, sf_dir)
    return _rounded(metrics.recall(found, truth), "recall")


@_query(f"{QUALITY}, {PLACED}, t AS (SELECT *, place + row_number() OVER (PARTITION BY qid, distance ORDER BY rank) - 1 AS spot FROM pf) SELECT qid, round(sum(spot - rank) / max(n_found * n_full)::DOUBLE, 6) AS ep FROM t GROUP BY qid")
def ep(spark, sf_dir):
    found, _, full = _results(spark, sf_dir)
    return _rounded(metrics.error_on_position(found, full), "ep")


@_query(f"{QUALITY} SELECT f.qid, round(coalesce(max(CASE WHEN f.rank = 10 THEN CASE WHEN t.distance = 0 AND f.distance = 0 THEN 1 ELSE f.distance / t.distance END END), 1), 6)::DOUBLE AS approx FROM found f LEFT JOIN truth t USING (qid, rank) GROUP BY f.qid")
def approx_ratio(spark, sf_dir):
    found, truth, _ = _results(spark, sf_dir)
    return _rounded(metrics.approximation_ratio(found, truth, 10), "approx")


@_query(f"{QUALITY} SELECT qid, round(avg(f.distance / t.distance - 1), 6) AS rde FROM found f JOIN truth t USING (qid, rank) WHERE t.distance <> 0 GROUP BY qid")
def rde(spark, sf_dir):
    found, truth, _ = _results(spark, sf_dir)
    return _rounded(metrics.relative_distance_error(found, truth), "rde")


@_query(f"{QUALITY} SELECT qid, round(sum(t.distance) / sum(f.distance), 6) AS tdr FROM found f JOIN truth t USING (qid, rank) GROUP BY qid")
def total_distance_ratio(spark, sf_dir):
    found, truth, _ = _results(spark, sf_dir)
    return _rounded(metrics.total_distance_ratio(found, truth), "tdr")


@_query(f"{QUALITY}, {PLACED} SELECT qid, round(avg(CASE WHEN place <= n_found THEN 1.0::DOUBLE ELSE 0 END), 6) AS precision FROM pf GROUP BY qid")
def precision(spark, sf_dir):
    found, _, full = _results(spark, sf_dir)
    return _rounded(metrics.precision(found, full), "precision")


@_query(f"{QUALITY}, {PLACED} SELECT qid, round(avg(CASE WHEN pf.distance = 0 THEN 1::DOUBLE ELSE t.distance / pf.distance * (1 - (place - rank) / n_full::DOUBLE) END), 6) AS compound FROM pf JOIN (SELECT qid, rank, distance FROM fullm) t USING (qid, rank) GROUP BY qid")
def compound(spark, sf_dir):
    found, _, full = _results(spark, sf_dir)
    return _rounded(metrics.compound(found, full), "compound")


# ---- Mutation and keyed tables ---------------------------------------------------------------------------------------


def _order_values(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("payload"))


def _customer_values(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("payload"), F.col("c_mktsegment").alias("segment"))


HELD = "h AS (SELECT o_custkey AS payload, min(o_orderkey) AS first FROM orders GROUP BY o_custkey)"


@_query(f"WITH {HELD} SELECT c_custkey AS id, CASE WHEN first IS NULL THEN 'NOT_EXISTS' ELSE 'EXISTS' END AS status, first AS found_id FROM customer LEFT JOIN h ON payload = c_custkey")
def exists_status(spark, sf_dir):
    return mutation.exists(_order_values(spark, sf_dir), _customer_values(spark, sf_dir), "payload").select("id", "status", "found_id")


@_query(f"""WITH {HELD}, n AS (SELECT c_custkey AS payload, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS fresh FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
        SELECT c_custkey AS id, CASE WHEN fresh IS NULL THEN 'EXISTS' ELSE 'OK' END AS status, coalesce(first, fresh) AS stored_id FROM customer LEFT JOIN h ON h.payload = c_custkey LEFT JOIN n ON n.payload = c_custkey""")
def insert_status(spark, sf_dir):
    return mutation.insert(_order_values(spark, sf_dir), _customer_values(spark, sf_dir).drop("segment"), "payload")[1].select("id", "status", "stored_id")


@_query("SELECT o_orderkey AS id, o_custkey AS payload FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_remaining(spark, sf_dir):
    gone = _customer_values(spark, sf_dir).where("segment = 'BUILDING'")
    return mutation.delete(_order_values(spark, sf_dir), gone, "payload")[0].select("id", "payload")


@_query("SELECT o_custkey AS payload, min(o_orderkey) AS id FROM orders GROUP BY o_custkey")
def dedupe_first_id(spark, sf_dir):
    return mutation.first_of_equals(_order_values(spark, sf_dir), "payload").select("payload", "id")


def _order_table(spark, sf_dir) -> KeyedTable:
    return KeyedTable(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000")
def kv_range(spark, sf_dir):
    return _order_table(spark, sf_dir).range(100, 5000)


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 5000 ORDER BY o_orderkey DESC")
def kv_range_reverse(spark, sf_dir):
    return _order_table(spark, sf_dir).range(100, 5000, reverse=True)


@_query("SELECT l_orderkey, min(l_extendedprice) AS l_extendedprice FROM lineitem WHERE l_orderkey BETWEEN 100 AND 5000 GROUP BY l_orderkey")
def kv_range_nodup(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    return KeyedTable(lines, "l_orderkey", "l_extendedprice", duplicates=True).range_no_duplicates(100, 5000)


@_query("SELECT l_orderkey, list_sort(list(l_linenumber)) AS values FROM lineitem GROUP BY l_orderkey")
def kv_multimap(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return KeyedTable(lines, "l_orderkey", "l_linenumber", duplicates=True).multimap()


# ---- Pivot selection and trees ---------------------------------------------------------------------------------------


@_query("SELECT vec_id AS id FROM embeddings ORDER BY md5('pivot:' || vec_id::VARCHAR), vec_id LIMIT 16")
def random_pivots_md5(spark, sf_dir):
    return pivots.random_pivots(_vectors(spark, sf_dir), 16).select("id")


@_query("SELECT vec_id AS id FROM embeddings ORDER BY vec_id LIMIT 16")
def first_n_pivots(spark, sf_dir):
    return pivots.first_pivots(_vectors(spark, sf_dir), 16).select("id")


@_query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (3, 33, 333)")
def fixed_pivots(spark, sf_dir):
    return pivots.fixed_pivots(_vectors(spark, sf_dir), [3, 33, 333]).select("id", "label")


def _chosen(spark, sf_dir, choose, sample: int = 200) -> DataFrame:
    """The choice on a sample of bounded size, as these selectors are defined; the sample is the feature."""
    v = _vectors(spark, sf_dir)
    ids, x = pivots.collected(pivots.random_pivots(v, sample))
    rows = [(n, *(int(ids[i]) for i in (c if isinstance(c, tuple) else (c,)))) for n, c in enumerate(choose(x))]
    return spark.createDataFrame(rows, "place int, id long" if len(rows[0]) == 2 else "place int, a long, b long")


@_query(f"""WITH {_pivot_sql(60)}, dd AS (SELECT a.i AS a, b.i AS b, {_l1('a.embedding', 'b.embedding')} AS d FROM piv a, piv b), m AS (SELECT max(d) AS top FROM dd),
        s AS (SELECT p.a, p.b, p.d, count(DISTINCT x.d <= y.d) AS sketches FROM dd p JOIN dd x ON x.a = p.a JOIN dd y ON y.a = p.b AND y.b = x.b WHERE p.a < p.b GROUP BY ALL),
        v AS (SELECT a, b, 1 - d / top + 10 * (sketches / 2) AS worth FROM s, m ORDER BY worth DESC, a DESC, b DESC LIMIT 1)
        SELECT 0::INT AS place, x.pid AS a, y.pid AS b FROM v JOIN piv x ON x.i = v.a JOIN piv y ON y.i = v.b""")
def rf04_first_pair(spark, sf_dir):
    """The first pair of a small sample, which SQL can try exhaustively too."""
    return _chosen(spark, sf_dir, lambda x: pivots.exhaustive_pairs(x, 1), 60)


@_query()
def rf04_pairs(spark, sf_dir):
    return _chosen(spark, sf_dir, lambda x: pivots.exhaustive_pairs(x, 8), 500)


@_query()
def rf02_pairs(spark, sf_dir):
    return _chosen(spark, sf_dir, lambda x: pivots.random_pairs(x, 4, "spread"), 4000)


@_query()
def rf03_pairs(spark, sf_dir):
    return _chosen(spark, sf_dir, lambda x: pivots.random_pairs(x, 4, "distortion"), 4000)


@_query()
def sss_pivots(spark, sf_dir):
    return _chosen(spark, sf_dir, lambda x: pivots.sparse_spatial(x, 16))


@_query()
def bustos_pivots(spark, sf_dir):
    return _chosen(spark, sf_dir, lambda x: pivots.incremental(x, 8))


@_query()
def perm_pivots(spark, sf_dir):
    return _chosen(spark, sf_dir, lambda x: pivots.permutation_pivots(x, 8))


@_query()
def kmeanspp_pivots(spark, sf_dir):
    return spark.createDataFrame([(n, i) for n, i in enumerate(pivots.kmeans_plus_plus(_vectors(spark, sf_dir), 4))], "place int, id long")


def _trees(spark, sf_dir) -> DataFrame:
    """One tree for each region: its nations, and under each the market segments of its customers."""
    label = lambda c: F.regexp_replace(c, "[^A-Za-z]", "")
    held = _table(spark, sf_dir, "customer").select("c_nationkey", label(F.col("c_mktsegment")).alias("s")).distinct()
    nations = _table(spark, sf_dir, "nation").join(held, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    own = nations.groupBy("n_regionkey", label(F.col("n_name")).alias("n")).agg(F.array_join(F.sort_array(F.collect_set("s")), ",").alias("s"))
    own = own.select("n_regionkey", F.when(F.col("s") == "", F.col("n")).otherwise(F.concat("n", F.lit("("), "s", F.lit(")"))).alias("t"))
    region = own.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("t")), ",").alias("t"))
    named = region.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("r_regionkey", F.concat(label(F.col("r_name")), F.lit("("), "t", F.lit(")")).alias("tree"))


def _tree_pairs(spark, sf_dir, distance) -> DataFrame:
    t = _trees(spark, sf_dir)
    a, b = t.select(F.col("r_regionkey").alias("a"), F.col("tree").alias("x")), t.select(F.col("r_regionkey").alias("b"), F.col("tree").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", distance("x", "y").alias("distance"))


@_query()
def tree_multiset_distance(spark, sf_dir):
    return _tree_pairs(spark, sf_dir, trees.tree_multiset)


@_query()
def tree_edit_distance(spark, sf_dir):
    return _tree_pairs(spark, sf_dir, trees.tree_edit)
