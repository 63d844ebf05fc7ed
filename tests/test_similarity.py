from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances, projections, trees
from nearfield.operators import filters, metrics, mutation, pivots, search, stats
from nearfield.plans import experiments, index
from nearfield.sources import loaders, stores

COLUMNS = "id long, v array<double>"


def points(spark, n=60, d=4, seed=1, first=0):
    x = np.random.default_rng(seed).random((n, d)).round(3)
    return spark.createDataFrame([(i + first, r.tolist()) for i, r in enumerate(x)], COLUMNS), x


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def brute(x, q, k, radius=None, order=1):
    out = set()
    for i, a in enumerate(q):
        d = [(order * reduce(add, [abs(float(s) - float(t)) for s, t in zip(a, b)]), j) for j, b in enumerate(x)]
        d = sorted(p for p in d if radius is None or p[0] <= radius)[:k]
        out |= {(i, j, round(order * p, 9), r + 1) for r, (p, j) in enumerate(d)}
    return out


def as_set(rows):
    return {(r.qid, r.id, round(r.distance, 9), r["rank"]) for r in rows.collect()}


@pytest.mark.parametrize(("k", "radius"), [(1, None), (3, None), (3, 0.7), (None, 1.1), (100, None)])
def test_search_equals_a_scan(spark, k, radius):
    objects, x = points(spark)
    queries, q = points(spark, 5, seed=2)
    want = brute(x, q, k, radius)
    assert as_set(search.vector_search(objects, queries, "l1", k, radius)) == want
    assert as_set(search.search(objects, queries, "l1", "v", k, radius)) == want


def test_search_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "STEP", 2)
    objects, x = points(spark)
    queries, q = points(spark, 10, seed=2)
    assert as_set(search.search(objects, queries, "l1", "v", 3)) == brute(x, q, 3)
    assert as_set(search.search(objects, queries, "l1", "v", None, 1.1)) == brute(x, q, None, 1.1)
    monkeypatch.setattr(search.blocks_of, "__defaults__", (4,))
    assert as_set(search.vector_search(objects, queries, "l1", 3)) == brute(x, q, 3)


def test_farthest_and_ties_go_by_id(spark):
    objects = spark.createDataFrame([(3, [1.0]), (1, [1.0]), (2, [0.0]), (4, None)], COLUMNS)
    queries = spark.createDataFrame([(0, [0.0])], COLUMNS)
    assert [r.id for r in search.vector_search(objects, queries, "l1", 2, largest=True).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in search.vector_search(objects, queries, "l1", 2).orderBy("rank").collect()] == [2, 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    some, _ = points(spark, 3)
    assert search.vector_search(none, some, "l1", 2).count() == 0
    assert search.vector_search(some, none, "l1", 2).count() == 0


def test_filters(spark):
    objects, x = points(spark, 20)
    near = search.search(objects, objects, "l1", "v", 1, filter=filters.not_equal("v"))
    assert near.where("qid = id").count() == 0 and near.count() == 20
    assert search.search(objects, objects, "l1", "v", 1, filter=filters.any_of()).count() == 0
    assert search.search(objects, objects, "l1", "v", 1, filter=filters.all_of()).count() == 20


def test_pivot_filter_keeps_every_answer_and_reaches_the_scan(spark, tmp_path):
    objects, x = points(spark, 80)
    t = pivots.with_pivot_distances(objects, x[:2]).select("id", "v", F.col("tuple")[0].alias("p0"), F.col("tuple")[1].alias("p1"))
    t.write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    found = search.search(t, t.where("id < 5"), "l1", "v", None, 0.6, bound=search.pivot_bounds(["p0", "p1"], 0.6))
    assert {r[:2] for r in as_set(found)} == {r[:2] for r in brute(x, x[:5], None, 0.6)}
    plan = search.single_query_pivot_range(t, {"p0": 1.0}, 0.2)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p0" in plan and "LessThanOrEqual(p0" in plan


def test_distance_is_computed_once(spark):
    objects, _ = points(spark, 5)
    plan = search.search(objects, objects, "l1", "v", 1, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("zip_with") <= 2  # one expression, shown in the node and in its details


def test_distances(spark):
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    assert value(spark, distances.l1(lit(1, 5), lit(4, 1))) == 7
    assert value(spark, distances.l2(lit(0, 0), lit(3, 4))) == 5
    assert value(spark, distances.l_infinity(lit(1, 5), lit(4, 1))) == 4
    assert value(spark, distances.edit_distance(F.lit("abcde"), F.lit("abxde"))) == 1
    assert value(spark, distances.edit_distance(F.lit("abcdejklsel"), F.lit("abxdek"))) == 6
    sparse = lambda **m: F.create_map(*[F.lit(x) for p in m.items() for x in p])
    assert value(spark, distances.sparse_l1(sparse(a=3, b=1), sparse(b=4, c=2))) == 8
    assert value(spark, distances.tanimoto(sparse(a=1), sparse(a=1))) == 0
    spelled = lambda s: distances.position_map(F.lit(s))
    assert value(spark, distances.closest_positions(spelled("abc"), spelled("abc"))) == 0
    with pytest.raises(Exception, match="over 3"):
        value(spark, distances.l1_integer(lit(1), lit(9), 3))


#: Golden pairs (a, b, edit distance, multiset distance); the last two are our own.
TREES = [("a(b,c(e(f),d))", "a(b(c(e(f),d)))", 2, 2), ("a(b,c(e(f),d))", "a(b,c(e(f),e))", 1, 4), ("a(b(e(f)),c(e(f),d))", "a(b(e(f),c(e(f),d)))", 2, 2), ("a(b(c(e,d)), f)", "a(b,c(e,d(f)))", 4, 4), ("a(b(c(e(f),d)))", "a(b(c(e(f),e)))", 1, 5), ("a", "c(a)", 1, 1), ("x", "x", 0, 0), ("p(q,r)", "p(r,q)", 2, 1)]


@pytest.mark.parametrize(("a", "b", "edit", "bag"), TREES)
def test_trees(a, b, edit, bag):
    assert trees.edit_distance(a, b) == trees.edit_distance(b, a) == edit
    assert trees.multiset_distance(a, b) == bag and trees.multiset_distance(a, a) == 0


@pytest.mark.parametrize("bad", ["", "a(", "a)b", "a(b", "a,b", "(a)", "a b", "a(b))"])
def test_terms_that_are_no_trees(bad):
    with pytest.raises(ValueError, match="not a tree"):
        trees.parse(bad)


def test_projections(spark):
    t = F.array(*[F.lit(float(x)) for x in (3, 1, 2, 2)])
    assert value(spark, projections.bit_sketch(t, 2)) == 1
    assert value(spark, projections.permutation(t)) == [1, 2, 3, 0]
    assert value(spark, projections.footrule(F.array(*map(F.lit, (0, 1, 2))), F.array(*map(F.lit, (2, 1, 0))))) == 4
    assert value(spark, projections.hamming(F.lit(19), F.lit(272))) == 3


@pytest.mark.parametrize(("kind", "size"), [("sketch", 5), ("sketch", 70), ("permutation", 5)])
def test_buckets_as_an_array_and_as_rows(spark, monkeypatch, kind, size):
    objects, _ = points(spark, 120, 3)
    made = index.Builder(objects, kind, size).freeze(ks=(1,), sample=5)
    queries = objects.where("id < 9")
    want = as_set(made.search(queries, 4, reads=5))
    monkeypatch.setattr(search, "BUCKETS", 1)
    assert as_set(made.search(queries, 4, reads=5)) == want


@pytest.mark.parametrize("kind", ["sketch", "permutation"])
def test_index_lifecycle(spark, kind, tmp_path):
    objects, x = points(spark, 80)
    builder = index.Builder(objects, kind, 4)
    made = builder.freeze(ks=(1, 3), sample=10)
    with pytest.raises(ValueError, match="already frozen"):
        builder.freeze()
    with pytest.raises(ValueError, match="wrong k"):
        made.search(objects, 2)
    queries = objects.where("id < 6")
    exact = as_set(search.vector_search(objects, queries, "l1", 3))
    assert as_set(made.search(queries, 3, reads=10_000)) == exact  # all buckets: exact
    assert as_set(made.refine(queries, 3)) == exact
    assert {r[:2] for r in as_set(made.search(queries, 3))} <= {(q, i) for q in range(6) for i in range(80)}
    after, status = made.insert(spark.createDataFrame([(0, x[0].tolist()), (1, [9.0, 9.0, 9.0, 9.0])], COLUMNS))
    assert {(r.id, r.status, r.stored_id) for r in status.collect()} == {(0, "EXISTS", 0), (1, "OK", 80)}
    left, gone = after.delete(spark.createDataFrame([(0, x[5].tolist()), (1, [7.0] * 4)], COLUMNS))
    assert left.size() == 80 and [r.status for r in gone.orderBy("id").collect()] == ["OK", "NOT_EXISTS"]
    made.save(f"{tmp_path}/i")
    again = index.load(spark, f"{tmp_path}/i")
    assert as_set(again.search(queries, 3, reads=10_000)) == exact and again.reads == made.reads
    report = experiments.run_grid(again, queries, experiments.parse_grid("9,1:9,3"), reads=10_000)
    assert [r.recall for r in report.collect()] == [1.0, 1.0]
    stores.append_report(report, f"{tmp_path}/r")
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/r").columns == stores.REPORT


def test_calibrated_reads_reach_the_recall(spark):
    objects, x = points(spark, 150, 8)
    made = index.Builder(objects, "sketch", 6).freeze(ks=(3,), alpha=0.0, sample=150)
    found, exact = as_set(made.search(objects, 3)), brute(x, x, 3)
    assert len({r[:2] for r in found} & {r[:2] for r in exact}) >= 0.9 * len(exact)


def test_stream_answers_as_the_index_does(spark, tmp_path):
    from nearfield.streaming.search import answer_stream

    objects, _ = points(spark, 40)
    made = index.Builder(objects, "sketch", 4).freeze(ks=(2,), sample=5)
    objects.where("id < 4").write.parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/q")
    answer_stream(made, stream, 2, f"{tmp_path}/out", f"{tmp_path}/c", reads=99).awaitTermination(120)
    assert as_set(spark.read.parquet(f"{tmp_path}/out")) == as_set(made.search(objects.where("id < 4"), 2, reads=99))


def test_selectors():
    x = np.random.default_rng(3).random((60, 5))
    for chosen in (pivots.sparse_spatial(x, 8), pivots.incremental(x, 8), pivots.permutation_pivots(x, 5)):
        assert len(set(chosen)) == len(chosen) > 1
    for pairs in (pivots.exhaustive_pairs(x, 6), pivots.random_pairs(x, 4), pivots.random_pairs(x, 4, "distortion")):
        flat = [i for p in pairs for i in p]
        assert len(set(flat)) == len(flat)


def test_kmeans_plus_plus_spreads(spark):
    rows = [(i, [float(i // 10) * 100 + i % 10]) for i in range(30)]
    ids = pivots.kmeans_plus_plus(spark.createDataFrame(rows, COLUMNS), 3)
    assert {i // 10 for i in ids} == {0, 1, 2}
    with pytest.raises(ValueError, match="centre"):
        pivots.kmeans_plus_plus(spark.createDataFrame([], COLUMNS), 3)


def test_metrics_of_a_perfect_result(spark):
    objects, _ = points(spark, 30)
    full = search.vector_search(objects, objects.where("id < 3"), "l1")
    truth = full.where("rank <= 5")
    row = metrics.validate(truth, truth, full, 5).first()
    assert (row.recall, row.ep, row.approx, row.rde, row.tdr, row.precision, row.compound) == (1, 0, 1, 0, 1, 1, 1)
    worse = full.where("rank between 2 and 6").withColumn("rank", F.col("rank") - 1)
    row = metrics.validate(worse, truth, full, 5).first()
    assert 0 < row.recall < 1 and row.ep > 0 and row.approx > 1
    kinds = {r.outcome: r.n for r in metrics.outcome_counts(truth, truth, objects.where("id < 3").select(F.col("id").alias("qid")), 5).collect()}
    assert kinds == {"exact": 3}


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("// c\n\nx\nx\ny\nbad\nz\n")
    lines = loaders.test_lines(loaders.read_lines(spark, str(tmp_path / "a.txt")))
    assert [r.object for r in loaders.load_objects(lines, F.col("value"), F.col("value") != "bad", 2).orderBy("line_no").collect()] == ["x", "y"]
    assert value(spark, loaders.parse_vector(F.lit("1 2,3|4"))) == [1, 2, 3, 4]
    assert value(spark, loaders.parse_sparse(F.lit("t\t1,2\t5,1"))).terms[1].cnt == 1
    with pytest.raises(Exception, match="not a document"):
        value(spark, loaders.parse_sparse(F.lit("t\t5,2\t1,1")))
    assert value(spark, loaders.parse_protein(F.lit("P1<<:)>>MKV"))).seq == "MKV"
    with pytest.raises(Exception, match="3 long"):
        loaders.fixed_records(lines, 3).collect()
    ids = loaders.dense_ids(spark.range(100, 150).withColumnRenamed("id", "x"), ["x"], 7).orderBy("x").collect()
    assert [r.id for r in ids] == list(range(7, 57))
    a, b = (loaders.random_vectors(spark, 5, 3, 10.0).collect() for _ in range(2))
    assert a == b and all(0 <= x < 10 for r in a for x in r.v)


def test_keyed_table(spark):
    t = stores.KeyedTable(spark.createDataFrame([(1, "a"), (2, "b"), (5, "c")], "k long, x string"), "k", "x")
    assert [r.k for r in t.range(1, 2, reverse=True).collect()] == [2, 1]
    t = t.put(spark.createDataFrame([(2, "z"), (9, "n")], "k long, x string"))
    assert t.get(2).first().x == "z" and t.next_id() == 10 and t.size() == 4
    assert t.delete(spark.createDataFrame([(9,)], "k long")).size() == 3 and t.clear().size() == 0
    d = stores.KeyedTable(spark.createDataFrame([(1, "b"), (1, "a")], "k long, x string"), "k", "x", duplicates=True)
    assert d.range_no_duplicates(0, 9).first().x == "a" and d.multimap().first()["values"] == ["a", "b"]
    with pytest.raises(ValueError, match="duplicate"):
        d.get(1)


def test_mutation_with_ids(spark):
    t = spark.createDataFrame([(1, "a")], "id long, x string")
    assert mutation.insert_with_ids(t, spark.createDataFrame([(2, "a")], "id long, x string")).count() == 2
    with pytest.raises(ValueError, match="in use"):
        mutation.insert_with_ids(t, spark.createDataFrame([(1, "z")], "id long, x string"))


def test_estimates(spark):
    order = spark.createDataFrame([(1, 2, 1), (1, 5, 2), (2, 4, 1)], "qid long, n long, place long")
    assert {tuple(r) for r in stats.buckets_needed(order, [3, 9]).collect()} == {(1, 3, 2), (2, 3, 1)}


def test_entry_has_sql_for_registered_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_ids_over_many_ranges(spark, adaptive):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        wide = spark.range(20_000).select((F.lit(20_000) - F.col("id")).alias("x"), F.repeat(F.md5(F.col("id").cast("string")), 12).alias("payload"))
        got = loaders.dense_ids(wide, ["x"], 5).select("x", "id").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r.x, r.id) for r in got) == [(x, x + 4) for x in range(1, 20_001)]


def brute_spread(d, pairs):
    sketches = {tuple(bool(d[a, r] <= d[b, r]) for a, b in pairs) for r in range(len(d))}
    return len(sketches) / min(2 ** len(pairs), len(d))


def test_exhaustive_pairs_equal_brute_force():
    x = np.random.default_rng(4).random((30, 6))
    d = search.distances_between(x, x, "l1")
    want = []
    for _ in range(4):
        free = [r for r in range(30) if r not in {i for p in want for i in p}]
        best = None
        for i, a in enumerate(free):
            for b in free[i + 1 :]:
                value = 1 - d[a, b] / d.max() + 10 * brute_spread(d, [*want, (a, b)])
                if best is None or value >= best[0]:
                    best = value, (a, b)
        want.append(best[1])
    assert pivots.exhaustive_pairs(x, 4) == want


@pytest.mark.parametrize("method", ["spread", "distortion"])
def test_random_pairs_equal_brute_force(method):
    x = np.random.default_rng(9).random((30, 6))
    d = search.distances_between(x, x, "l1")
    got = pivots.random_pairs(x, 3, method, tries=20_000)  # so many that every pair turns up in both orders
    want = []
    for _ in range(3):
        free = [r for r in range(30) if r not in {i for p in want for i in p}]
        scores = {}
        for a in free:
            for b in free:
                if a != b:
                    apart = abs(2 * int((d[a] <= d[b]).sum()) - 30) / 30
                    spread, bound = brute_spread(d, [*want, (a, b)]), round(float(np.abs(d[a] - d[b]).mean()), 9)
                    scores[a, b] = (not (spread >= 0.5 and apart <= 0.1), -spread, apart, -bound) if method == "spread" else (apart, -bound)
        best = min(scores.values())
        want.append(got[len(want)])
        assert scores[want[-1]] == best


def test_sparse_spatial_equals_the_definition():
    x = np.random.default_rng(2).random((120, 3))
    got = pivots.sparse_spatial(x, 6)
    d = search.distances_between(x, x, "l1")
    seen = [float(d[i, j]) for i in range(100) for j in range(100) if i != j]
    want = []
    for i in range(120):
        if len(want) == 6:
            break
        good = True
        for j in want:
            seen.append(float(d[i, j]))
            if d[i, j] < sum(seen) / len(seen):
                good = False
                break
        if good:
            want.append(i)
    assert got == want and len(want) > 1
    assert pivots.separated(np.array([[0.0], [1.0], [1.5], [3.0]]), 4, 1.0) == [0, 2, 3]


def test_pivots_of_chosen_ids(spark):
    objects, _ = points(spark, 30)
    among = objects.where("id < 6").select("id")
    assert {r.id for r in pivots.random_pivots(objects, 10, among=among, exclude=[2]).collect()} == {0, 1, 3, 4, 5}


def test_elimination_equals_a_scan_and_computes_less(spark, monkeypatch, tmp_path):
    from nearfield.operators import aesa

    monkeypatch.setattr(aesa, "OBJECTS", 25)
    objects, x = points(spark, 60, 2)
    queries, q = points(spark, 6, 2, seed=2)
    assert as_set(aesa.elimination_search(objects, queries, 3)) == brute(x, q, 3)
    assert as_set(aesa.elimination_search(objects, queries, 3, 0.2)) == brute(x, q, 3, 0.2)
    costs = aesa.search_costs(aesa.elimination_hits(objects, queries, 1)).collect()
    assert len(costs) == 6 and sum(r.computations for r in costs) < 6 * 60
    stores.write_cost_histogram(aesa.search_costs(aesa.elimination_hits(objects, queries, 1)), f"{tmp_path}/costs")
    assert spark.read.option("header", True).csv(f"{tmp_path}/costs").columns == ["nearest", "computations"]
    assert {r.qid: round(r.nearest, 9) for r in costs} == {i: p for i, _, p, _ in brute(x, q, 1)}


def test_elimination_with_copies_and_many_queries(spark, monkeypatch, tmp_path):
    """Copies of a query aren't others: the count of others was the number of objects less one."""
    from nearfield import queries as similarity
    from nearfield.operators import aesa

    monkeypatch.setattr(aesa, "OBJECTS", 40)
    rng = np.random.default_rng(5)
    x = np.tile(rng.random((100, 6)).round(1), (3, 1))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    own = np.float32(x).astype(float)
    d = {q: np.abs(own - own[q]).sum(1) for q in (0, 100, 200)}
    got = {r.qid: (round(r.nearest, 9), r.n_objects) for r in similarity.elimination_nearest(spark, str(tmp_path)).collect()}
    assert got == {q: (round(float(v[v > 0].min()), 9), int((v > 0).sum())) for q, v in d.items()}
    assert as_set(similarity.elimination_knn(spark, str(tmp_path))) == as_set(similarity.exact_knn(spark, str(tmp_path)))


def test_first_pass_compares_arrays_and_any_number_of_sketches(spark, monkeypatch, tmp_path):
    """The rows of pairs and the cross join of queries and sketches were joined and ranked one by one."""
    from nearfield import queries as similarity

    sf = "/root/testdata/sf0.001"
    few = as_set(similarity.sketch_knn_128(spark, sf))
    monkeypatch.setattr(search, "BUCKETS", 10)
    assert as_set(similarity.sketch_knn_128(spark, sf)) == few
    assert hasattr(search, "_picked_hits") and as_set(similarity.sketch_knn_graph(spark, sf)) == as_set(similarity.knn_graph_exact(spark, sf))


def test_index_of_long_sketches_and_its_counters(spark, tmp_path):
    from nearfield.operators.counters import Counters

    objects, x = points(spark, 150)
    made = index.Builder(objects, "sketch", 64).freeze(ks=(3,), sample=10)
    assert made.bits == 64
    queries = objects.where("id < 6")
    exact = as_set(search.vector_search(objects, queries, "l1", 3))
    assert as_set(made.search(queries, 3, reads=10_000)) == exact == as_set(made.refine(queries, 3))
    assert made.knn_graph(2, reads=20).count() == 300
    assert as_set(made.range_search(queries, 0.7)) == brute(x, x[:6], None, 0.7)
    made.save(f"{tmp_path}/i")
    again = index.load(spark, f"{tmp_path}/i")
    counters = Counters()
    assert as_set(again.search(queries, 3, reads=10_000, counters=counters)) == exact
    assert counters.totals()["queries"] == 6 and counters.totals()["distances"] == 6 * 150 and "distances: 900" in counters.summary()
    assert again.get_object(7) == x[7].tolist() and [r.id for r in again.in_order().take(3)] == [0, 1, 2]
    assert again.statistics()["size"] == 150
    with pytest.raises(KeyError, match="no object"):
        again.get_object(999)
    made.close()


def test_ids_of_the_caller(spark):
    objects, _ = points(spark, 40)
    builder = index.Builder(objects.limit(0))
    builder.set_auto_ids(False)
    builder.stage(objects)
    with pytest.raises(ValueError, match="empty index"):
        builder.set_auto_ids(True)
    made = builder.freeze(ks=(1,), sample=5)
    new = spark.createDataFrame([(900, [5.0] * 4)], COLUMNS)
    with pytest.raises(ValueError, match="caller"):
        made.insert(new)
    after = made.insert_with_ids(new)
    assert after.size() == 41 and after.get_object(900) == [5.0] * 4


def test_insert_stream_enters_a_value_once(spark, tmp_path):
    from nearfield.streaming.search import insert_stream

    objects, x = points(spark, 30)
    made = index.Builder(objects, "sketch", 4).freeze(ks=(1,), sample=5)
    for rows in ([(50, [7.0] * 4), (51, [7.0] * 4), (52, x[3].tolist())], [(60, [7.0] * 4), (61, [8.0] * 4), (62, None)]):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
        stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
        insert_stream(made, stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [50, 61]


def test_full_ranking_and_equal_objects_last(spark):
    objects, x = points(spark, 40)
    queries = objects.where("id < 3")
    got = search.full_match(objects, queries).orderBy("qid", "rank").collect()
    want = sorted((q, r, d) for q, _, d, r in brute(x, x[:3], None))
    assert [(r.qid, r["rank"], round(r.distance, 9)) for r in got] == want
    last = search.full_match(objects, queries, filter_same=True).where("rank = 40").collect()
    assert len(last) == 3 and all(r.distance > 1e300 for r in last)


def test_term_counts_equal_brute_force(spark):
    from collections import Counter

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 40))) for _ in range(90)] + ["", "a  a", "a"]
    docs = spark.createDataFrame([*enumerate(texts), (500, None)], "id long, text string")
    bags = [Counter(t.split(" ")) for t in texts]
    want = set()
    for q in range(0, 93, 3):
        d = sorted(((bags[q] - bags[o]).total() + (bags[o] - bags[q]).total(), o) for o in range(93))[:4]
        want |= {(q, o, n, r + 1) for r, (n, o) in enumerate(d)}
    got = search.term_l1_search(docs, docs.where("id % 3 = 0"), 4)
    assert {(r.qid, r.id, r.distance, r["rank"]) for r in got.collect()} == want
    assert search.term_l1_search(docs.limit(0), docs, 3).count() == 0 == search.term_l1_search(docs, docs.limit(0), 3).count()


def test_more_tree_functions(spark):
    t = "r(a(x,y),b(c(d,e,f)),g)"
    assert trees.heavy_path(t) == ["r", "b", "c", "d"]
    assert trees.top_light(t) == ["a(x,y)", "e", "f", "g"]
    assert trees.first_match(t, "c") == "c(d,e,f)" and trees.first_match(t, "q") is None
    codes = [trees.comparison_code(*p) for p in (("a(b)", "a(b)"), ("a(b)", "z(b)"), ("a(b)", "a(c)"), ("a(b)", "z(c)"), ("a(b)", "a(b,c)"), ("a", "b"), ("a", "a"))]
    assert codes == [1, 2, 3, 0, 3, 0, 1]
    rows = spark.createDataFrame([("a(b,c)",), ("a",), (t,)], "tree string")
    assert {r.tree for r in trees.within_size(rows, "tree", 3).collect()} == {"a(b,c)", "a"}
    assert rows.where("tree = 'a'").select(trees.tree_heavy_path("tree").alias("p"), trees.tree_top_light("tree").alias("l")).first() == (["a"], [])


def test_bytes_and_filters(spark):
    from nearfield.functions import values

    rows = spark.createDataFrame([(1, -1.5), (-2, 2.25), (None, None), (300, 0.0)], "n long, x double")
    for kind, source in (("short", "n"), ("int", "n"), ("long", "n"), ("float", "x"), ("double", "x")):
        got = rows.select(F.col(source).alias("a"), values.to_bytes(F.col(source), kind).alias("b")).withColumn("c", values.from_bytes(F.col("b"), kind)).collect()
        assert all((r.a is None and r.c is None) or (r.a == r.c and len(r.b) == values.WIDTHS[kind]) for r in got)
    assert bytes(rows.where("n = -2").select(values.to_bytes(F.col("n"), "short")).first()[0]) == b"\xff\xfe"
    words = values.bloom_filter(spark.range(0, 1000, 10), "id", 14)
    near = {r.id for r in values.bloom_candidates(spark.range(1000), "id", words, 14).collect()}
    assert near >= set(range(0, 1000, 10)) and len(near) < 120
    assert values.middle(spark.createDataFrame([(1,), (2,), (9,), (10,)], "x int"), "x").first().middle == 2


def test_command_line(spark, tmp_path):
    from nearfield import cli

    rng = np.random.default_rng(3)
    for name, n in (("a", 60), ("b", 2), ("q", 4)):
        (tmp_path / f"{name}.txt").write_text("".join(" ".join(map(str, v)) + "\n" for v in rng.random((n, 3)).round(4)))
    at = lambda *a: cli.run(spark, ["-db", f"{tmp_path}/db", *a]).collect()
    assert at("-m", "create", "-l", f"{tmp_path}/a.txt", "-p", "4")[0].size == 60
    assert {r.status for r in at("-m", "add", "-l", f"{tmp_path}/b.txt")} == {"OK"}
    assert {r.status for r in at("-m", "add", "-l", f"{tmp_path}/b.txt")} == {"EXISTS"}
    assert len(at("-m", "search", "-q", f"{tmp_path}/q.txt", "-k", "3")) == 12
    assert len(at("-m", "x", "-q", f"{tmp_path}/q.txt", "-es", "9,1:9,3", "-rf", f"{tmp_path}/r")) == 2
    reads = at("-m", "approxEvalRecall", "-q", f"{tmp_path}/q.txt", "-k", "3", "-evalRecall", "0.9")[0].reads
    assert 1 <= reads <= 16
