"""Rankings, closures and samplers against plain Python, and their properties."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import aggregate, graph, judge, linear, pairs
from rankloom.streaming import decisions as stream


def reach_of(n, edges):
    r = np.zeros((n, n), bool)
    for a, b in edges:
        r[a, b] = True
    for k in range(n):
        r |= r[:, [k]] & r[[k], :]
    return r


graphs = st.integers(2, 9).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=25)))


@settings(max_examples=60, deadline=None)
@given(graphs)
def test_components_are_mutual_reachability(g):
    n, edges = g
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    r = reach_of(n, edges)
    of = {v: k for k, group in enumerate(graph.components_of(list(range(n)), out)) for v in group}
    assert sorted(of) == list(range(n))
    for a in range(n):
        for b in range(n):
            assert (of[a] == of[b]) == (a == b or (r[a, b] and r[b, a]))


@settings(max_examples=60, deadline=None)
@given(graphs)
def test_gold_order_is_a_permutation_and_honours_what_is_acyclic(g):
    n, edges = g
    order, figures = aggregate.gold_order(list(range(n)), {k: -k for k in range(n)}, edges)
    assert sorted(order) == list(range(n))
    r = reach_of(n, edges)
    pos = {v: k for k, v in enumerate(order)}
    for a, b in edges:
        if not r[b, a]:
            assert pos[a] < pos[b]
    if not any(r[k, k] for k in range(n)):
        assert figures == {"fidelity": 1.0, "in_cycles": 0}


def test_gold_on_a_cycle_with_a_tail():
    order, figures = aggregate.gold_order(["a", "b", "c", "d"], {"a": 0.0, "b": 2.0, "c": 1.0, "d": 9.0}, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")])
    assert order == ["b", "c", "a", "d"]
    assert figures["in_cycles"] == 3 and figures["fidelity"] == 3 / 5 or figures["fidelity"] == 2 / 5


@settings(max_examples=40, deadline=None)
@given(graphs)
def test_incremental_closure(g):
    n, edges = g
    c = pairs.Closure(n)
    done = []
    for a, b in edges:
        if a != b and not c.ordered(a, b):
            c.add(a, b)
            done.append((a, b))
    r = reach_of(n, done)
    assert c.pairs() == {(a, b) for a in range(n) for b in range(n) if r[a, b]}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 24, 40])
def test_gated_sampler_ends_and_never_asks_what_follows(n):
    asked = []

    def ask(batch):
        asked.extend(batch)
        return [a < b for a, b in batch]

    got = pairs.gated_sampling(list(range(n)), ask, per_item=12, batch=4)
    assert len({tuple(sorted(p)) for p in asked}) == len(asked)
    assert all(first == (a < b) for a, b, first in got)
    again = []
    pairs.gated_sampling(list(range(n)), lambda b: again.extend(b) or [x < y for x, y in b], per_item=12, log=[(k, k + 1, True) for k in range(n - 1)])
    assert not again  # a whole order is known


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 31])
def test_merge_sort_finds_the_order_and_asks_no_pair_twice(n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    asked = []

    def ask(batch):
        asked.extend(batch)
        return [a < b for a, b in batch]

    assert pairs.merge_sort([*ids, *ids], ask) == list(range(n))
    assert len({tuple(sorted(p)) for p in asked}) == len(asked)


def decided(spark, rows):
    return spark.createDataFrame(rows, "a_id long, b_id long, winner string")


def test_closure_and_components_as_tables(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(28)]
    df = spark.createDataFrame(edges, "src long, dst long")
    r = reach_of(20, edges)
    assert {(x["src"], x["dst"]) for x in graph.closure(df).collect()} == {(a, b) for a in range(20) for b in range(20) if r[a, b]}
    small = {x["id"]: x["component"] for x in graph.strong_components(df).collect()}
    large = {x["id"]: x["component"] for x in graph.strong_components(df, driver_edges=0).collect()}
    assert small == large


def test_bradley_terry_as_tables_and_on_the_driver(spark):
    rng = random.Random(1)
    d = decided(spark, [(a, b, rng.choice("AB")) for a in range(8) for b in range(a + 1, 8)])
    x = {r["id"]: r["strength"] for r in aggregate.bradley_terry(d, iterations=12).collect()}
    y = {r["id"]: r["strength"] for r in aggregate.bradley_terry(d, iterations=12, driver_edges=1).collect()}
    assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-9 for k in x)


def test_fusion_as_tables_and_on_the_driver(spark):
    d = decided(spark, [(0, 1, "A"), (1, 2, "B"), (2, 0, "A")])
    prior = spark.createDataFrame([(0, 0.5), (1, 0.0), (2, -0.5), (3, 1.0)], "id long, s double")
    t = {r["id"]: r["theta"] for r in aggregate.fuse_tables(prior, d, iterations=11).collect()}
    want = aggregate.fuse_driver(np.array([0.5, 0, -0.5, 1]), np.array([0, 1, 2]), np.array([1, 2, 0]), np.array([1.0, 0, 1]), iterations=11)
    assert np.allclose([t[k] for k in range(4)], want)


def test_bt_rank_appends_uncompared_and_keeps_foreign_ids(spark):
    c = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "id long, title string")
    got = aggregate.bt_rank(c, decided(spark, [(0, 1, "A"), (9, 0, "A")])).orderBy("rank").collect()
    assert [r["id"] for r in got] == [9, 0, 1, 5]
    assert got[0]["title"] is None and got[3]["bt_strength"] is None and not got[3]["compared"]


def vectors(spark, n, d, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x, spark.createDataFrame([(k, v.tolist(), float(k % 2)) for k, v in enumerate(x)] + [(n, None, 0.0)], "id long, v array<double>, y double")


def test_ridge_and_components(spark):
    x, df = vectors(spark, 40, 6)
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    y = np.arange(40) % 2
    assert np.allclose(linear.ridge(df, "v", "y", 2.0), np.linalg.solve(u.T @ u + 2 * np.eye(6), u.T @ y))
    m = linear.principal(df, "v", 64)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert m.V.shape == (6, 6) and np.allclose(np.abs(m.V.T @ vt.T), np.eye(6), atol=1e-6)
    assert np.allclose(m.zsd, s / np.sqrt(40), atol=1e-6)


def test_preference_model_on_the_driver_and_as_steps(spark):
    x, df = vectors(spark, 10, 4, 2)
    d = decided(spark, [(a, b, "A" if x[a, 0] > x[b, 0] else "B") for a in range(10) for b in range(a)] + [(0, 10, "A")])
    model = linear.fit_preference(df, d, "id", "v", k=64, steps=60)
    got = {r["id"]: r["model_score"] for r in linear.preference_scores(model, df, "v").collect()}
    assert got[10] == 0.0
    want = model.features(x) @ model.w[:-1]
    assert np.allclose([got[k] for k in range(10)], want)
    diffs = linear.edge_diff(d, df, "id", "v")
    assert np.allclose(linear.pairwise_logistic(diffs, 5), linear.pairwise_logistic(diffs, 5, driver_bytes=0))


def test_model_file(spark, tmp_path):
    from rankloom.sources import files

    m = linear.LinearModel(np.arange(3.0), np.eye(3)[:, :2], np.zeros(2), np.ones(2), np.array([1.0, 2.0, 0.0]), 1.0)
    files.save_model(spark, m, str(tmp_path / "m"))
    n = files.load_model(spark, str(tmp_path / "m"))
    assert np.array_equal(n.V, m.V) and np.array_equal(n.w, m.w)


def test_memo_answers_both_orientations(spark):
    asked = spark.createDataFrame([(2, 1), (1, 2), (3, 4)], "a_id long, b_id long")
    found, rest = judge.with_memo(asked, decided(spark, [(1, 2, "A")]))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "A"), (2, 1, "B")]
    assert [tuple(r) for r in rest.collect()] == [(3, 4)]


def test_judged_merge_sort_and_replay(spark):
    c = spark.createDataFrame([(k, "c", "t", float(k * 7 % 5)) for k in range(5)], "id long, company string, title string, utility double")
    memo = {}
    ask = pairs.ask_with(lambda t: judge.decide(t, judge.UtilityJudge()), c, memo)
    order = pairs.merge_sort(range(5), ask)
    assert order == sorted(range(5), key=lambda k: (-(k * 7 % 5), -k))
    replay = judge.ReplayJudge({p: "A" if first else "B" for p, first in memo.items()})
    a, b = next(iter(memo))
    assert replay("", {"id": b}, {"id": a}) == ("B" if memo[a, b] else "A")


def test_fit_scores_and_failures(spark):
    class Odd:
        def __call__(self, resume, job):
            if job["id"] == 1:
                raise RuntimeError("no answer")
            return judge.OverlapFit()(resume, job)

    c = spark.createDataFrame([(k, "c", "t", "u", ["python"], " " if k == 3 else "jd") for k in range(5)], "id long, company string, title string, url string, skills array<string>, jd_markdown string")
    done = spark.createDataFrame([(4,)], "id long")
    got = {r["id"]: r for r in judge.score_fits(c, Odd(), "python " * 20, done).collect()}
    assert sorted(got) == [0, 1, 2] and got[0]["verdict"] == "strong" and got[1]["error"] == "no answer" and got[1]["match_score"] is None
    with pytest.raises(ValueError):
        judge.score_fits(c, Odd(), "short")


def test_retries():
    tries, waits = [], []

    def call():
        tries.append(1)
        raise OSError

    with pytest.raises(OSError):
        judge.patient(call, tries=4, sleep=waits.append)()
    assert len(tries) == 4 and waits == [1.0, 2.0, 4.0]


def test_random_pairs_repeat(spark):
    ids = spark.range(30)
    one, two = (sorted(tuple(r) for r in pairs.random_pairs(ids, 3, seed=1).collect()) for _ in range(2))
    assert one == two and len(set(one)) == len(one) and all(a < b for a, b in one)
    assert pairs.random_pairs(ids, 3, most=5).count() == 5
    assert pairs.random_pairs(spark.range(1), 3).count() == 0


def test_streamed_log(spark, tmp_path):
    decided(spark, [(1, 2, "A"), (2, 1, "B"), (3, 1, "A")]).write.json(str(tmp_path / "log"))
    log = stream.read_log(spark, str(tmp_path / "log"), "a_id long, b_id long, winner string")
    got = []
    stream.each_round(stream.first_decisions(log), lambda df, k: got.extend(tuple(r) for r in df.select("lo", "hi").collect()), str(tmp_path / "c")).awaitTermination()
    assert sorted(got) == [(1, 2), (1, 3)]
    q = stream.degrees(log).writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["id"]: r["comparisons"] for r in spark.sql("select * from degrees").collect()} == {1: 3, 2: 2, 3: 1}


def some_vectors(spark, n, d, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(n, None)], "id long, v array<float>")


def test_wide_vectors(spark):
    """1,536 coordinates: unit vectors in time proportional to the width, Gram matrices, ridge, components and projections as numpy has them."""
    import time

    from rankloom.functions import vectors as V

    x, df = some_vectors(spark, 200, 1536)
    x = x.astype(np.float32).astype(float)
    began = time.perf_counter()
    got = {r["id"]: r["u"] for r in df.select("id", V.unit(V.doubles(F.col("v"))).alias("u")).collect()}
    assert time.perf_counter() - began < 10 and got[200] is None
    unit = x / (np.linalg.norm(x, axis=1)[:, None] + 1e-9)
    assert np.allclose([got[k] for k in range(200)], unit)
    xx, xy, total, n = linear.gram(df.withColumn("y", F.col("id").cast("double")), "v", "y", normalise=True)
    assert n == 200 and np.allclose(xx, unit.T @ unit) and np.allclose(xy, unit.T @ np.arange(200)) and np.allclose(total, unit.sum(0))
    w = linear.ridge(df.withColumn("y", F.col("id").cast("double")), "v", "y")
    assert np.allclose(w, np.linalg.solve(unit.T @ unit + np.eye(1536), unit.T @ np.arange(200)))
    scored = {r["id"]: r["score"] for r in linear.linear_score(df, "v", w, 0.5, normalise=True).collect()}
    assert np.allclose([scored[k] for k in range(200)], unit @ w + 0.5) and scored[200] is None
    model = linear.principal(df, "v", 64)
    z = {r["id"]: r["projected"] for r in linear.projected(df, "id", "v", model).collect()}
    assert len(z) == 200 and np.allclose([z[k] for k in range(200)], model.features(x), atol=1e-6)


def test_sums_over_many_partitions(spark):
    x, df = some_vectors(spark, 90, 7)
    for parts in (1, 3, 40):
        xx, _, total, n = linear.gram(df.repartition(parts), "v")
        assert n == 90 and np.allclose(xx, x.T @ x, atol=1e-4) and np.allclose(total, x.sum(0), atol=1e-4)
    summed = linear._total(spark.range(64).repartition(64), lambda batches: iter([linear.pa.RecordBatch.from_arrays([linear.pa.array([np.array([float(sum(b.num_rows for b in batches))]).tobytes()], linear.pa.binary())], ["part"])]), fan_in=2)
    assert summed.tolist() == [64.0]


def test_preferences_without_decisions_or_on_the_executors(spark):
    x, df = some_vectors(spark, 30, 5)
    none = decided(spark, [])
    assert {r["model_score"] for r in linear.preference_scores(linear.fit_preference(df, none, "id", "v"), df, "v").collect()} == {0.0}
    rng = random.Random(2)
    some = decided(spark, [(a, b, rng.choice("AB")) for a in range(30) for b in rng.sample(range(30), 3) if a != b])
    diffs = linear.edge_diff(some, df, "id", "v")
    assert np.allclose(linear.pairwise_logistic(diffs, steps=5), linear.pairwise_logistic(diffs, steps=5, driver_bytes=0))


def test_fuse_rank_beyond_the_driver(spark):
    c = spark.createDataFrame([(k, f"t{k}", (k * 37 % 11) / 5 - 1) for k in range(12)], "id long, title string, model_score double")
    d = decided(spark, [(a, (a * 5 + 3) % 12, "AB"[a % 2]) for a in range(12) if a != (a * 5 + 3) % 12] + [(0, 99, "A")])
    here, agree = aggregate.fuse_rank(c, d, iterations=8)
    there, also = aggregate.fuse_rank(c, d, iterations=8, most=3)
    assert agree == also and sorted(map(tuple, here.select(*sorted(here.columns)).collect())) == sorted(map(tuple, there.select(*sorted(here.columns)).collect()))


def test_gold_rank_refuses_what_is_too_long(spark):
    c = spark.createDataFrame([(k, 0.0) for k in range(5)], "id long, model_score double")
    with pytest.raises(ValueError, match="bounded"):
        aggregate.gold_rank(c, decided(spark, []), most=4)


def test_random_pairs_leave_out_what_is_decided(spark):
    ids = spark.range(40).unionByName(spark.range(5))
    every = {tuple(r) for r in pairs.random_pairs(ids, 3).collect()}
    log = [(b, a, "A") if k % 2 else (a, b, "B") for k, (a, b) in enumerate(sorted(every)[:20])]
    left = {tuple(r) for r in pairs.random_pairs(ids, 3, log=decided(spark, log)).collect()}
    assert left == every - {(min(a, b), max(a, b)) for a, b, _ in log}
    assert len(pairs.random_pairs(ids, 3, most=7, log=decided(spark, log)).collect()) == 7
    for n in (0, 1, 2, 3, 100):
        rows = pairs.numbered(spark.range(n).select((F.col("id") * 3).alias("id")), [F.desc("id")]).collect()
        assert sorted((r["k"], r["id"]) for r in rows) == [(k, 3 * (n - 1 - k)) for k in range(n)]


def test_asking_a_shortlist(spark):
    import threading
    import time

    people = spark.createDataFrame([(k, float(k * 7 % 10)) for k in range(10)], "id long, utility double")
    now, most, lock, asked = [0], [0], threading.Lock(), []

    def slow(resume, a, b):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            asked.append(frozenset((a["id"], b["id"])))
        time.sleep(0.01)
        with lock:
            now[0] -= 1
        return judge.UtilityJudge()(resume, a, b)

    order = pairs.merge_sort(list(range(10)), pairs.ask_here(slow, people, workers=3))
    assert [k * 7 % 10 for k in order] == list(range(9, -1, -1)) and most[0] <= 3 and len(set(asked)) == len(asked)
    with pytest.raises(ValueError, match="over 9"):
        pairs.ask_here(slow, people, most=9)
    rows, each = judge._bounded(people.repartition(30), 3)
    assert rows.rdd.getNumPartitions() * each <= 3


def test_match_records(spark):
    resume = "a text that names red and blue things, long enough to be scored by any judge that reads it, and more words"
    c = spark.createDataFrame([(1, "c", "t", "u", ["red", "green"], "jd", 0.25), (2, "c", "t", "u", ["red"], "jd", None), (3, "c", "t", "u", ["blue"], " ", 1.0)], "id long, company string, title string, url string, skills array<string>, jd_markdown string, score float")
    got = {r["id"]: r for r in judge.score_fits(c, judge.OverlapFit(), resume).collect()}
    assert {k: (r["match_score"], r["embed_score"]) for k, r in got.items()} == {1: (50, 0.25), 2: (100, None)}
    assert judge.score_fits(c.drop("score"), judge.OverlapFit(), resume).where("embed_score is not null").count() == 0
    log = spark.createDataFrame([(1, 40, 1), (1, 60, 2), (2, 90, 1), (9, 99, 1), (3, None, 1)], "id long, match_score int, at int")
    assert [(r["id"], r["match_score"]) for r in judge.matched(c, log).collect()] == [(2, 90), (1, 60)]
