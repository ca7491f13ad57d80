"""Edge rows, properties and brute-force versions of the operators."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskline.operators import aggregates as ag
from duskline.operators import cleaning as cl
from duskline.operators import dispatch as dp
from duskline.operators import estimate as es
from duskline.operators import evaluate as ev
from duskline.operators import fixed_effects as fx
from duskline.operators import matching as mt
from duskline.operators import quality_checks as qc
from duskline.operators import scores as sc
from duskline.operators import spatial as sp
from duskline.operators import windows as wi
from duskline.operators.components import connected_components

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def ts(day, hour=0):
    return f"2024-01-{day:02d} {hour:02d}:00:00"


def intervals(spark, rows):
    return spark.createDataFrame(rows, "id long, x_m double, y_m double, s string, e string").selectExpr("id", "x_m", "y_m", "cast(s as timestamp_ntz) as start_ts", "cast(e as timestamp_ntz) as end_ts")


def test_distance_and_time_bounds_are_closed(spark):
    iv = intervals(spark, [(1, 0.0, 0.0, ts(1), ts(2))])
    pts = spark.createDataFrame([(100.0, 0.0, ts(1)), (0.0, 250.0, ts(2)), (0.0, 250.0001, ts(1)), (0.0, 1.0, ts(2, 1)), (None, 0.0, ts(1))], "x_m double, y_m double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    assert tuple(sp.count_in_zone_during(pts, iv, 100, 250).first()) == (1, 1, 1)


def test_salted_join_gives_the_same_pairs(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.random() * 30, rng.random() * 30) for i in range(80)], "i int, x_m double, y_m double")
    b = spark.createDataFrame([(i, rng.random() * 30, rng.random() * 30) for i in range(60)], "j int, bx double, by double")
    plain = {(r.i, r.j) for r in sp.radius_join(a, b, 4).collect()}
    assert plain == {(r.i, r.j) for r in sp.radius_join(a, b, 4, salt=5).collect()}
    assert plain == {(p.i, q.j) for p in a.collect() for q in b.collect() if math.hypot(p.x_m - q.bx, p.y_m - q.by) <= 4}


@SLOW
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=0, max_size=40))
def test_components_equal_union_find(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    for last in (0, 5, None):
        got = connected_components(spark.createDataFrame(edges, "src long, dst long"), last_edges=last, early=last == 0)
        assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in parent}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 60)] + [(None, 3)]
    for last in (0, 20, None):
        assert {r.component for r in connected_components(spark.createDataFrame(path, "src long, dst long"), last_edges=last).collect()} == {0, 100}


def test_window_counts_equal_brute_force(spark):
    """Shared places, all kinds of bounds, reversed and null windows, rows without coordinates, points on the bounds."""
    rng = random.Random(4)
    hour = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    units = [(i, float(rng.randrange(4) * 10), float(rng.randrange(3) * 10), rng.randrange(240), rng.choice([None, *range(240)])) for i in range(60)] + [(90, None, 1.0, 5, 9)]
    points = [(float(rng.randrange(40)), float(rng.randrange(30)), rng.randrange(240)) for _ in range(300)]
    u = spark.createDataFrame([(i, x, y, hour(s), hour(e) if e is not None else None) for i, x, y, s, e in units], "id int, x_m double, y_m double, s string, e string").selectExpr("id", "x_m", "y_m", "cast(s as timestamp_ntz) s", "cast(e as timestamp_ntz) e")
    p = spark.createDataFrame([(x, y, hour(t)) for x, y, t in points], "x_m double, y_m double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    kinds = {"cc": "[]", "co": "[)", "oc": "(]", "oo": "()"}
    got = {r.id: r for r in sp.count_in_windows(u, p, {k: ("s", "e", b) for k, b in kinds.items()} | {"day": ("s - interval 24 hours", "s", "[)")}, [8, 15], days=2).collect()}
    assert len(got) == len(units)
    for i, x, y, s, e in units:
        for ring in (0, 1):
            near = [t for a, b, t in points if x is not None and (math.hypot(a - x, b - y) <= 8) == (ring == 0) and math.hypot(a - x, b - y) <= 15]
            inside = lambda b, lo, hi: sum((lo <= t if b[0] == "[" else lo < t) and (t <= hi if b[1] == "]" else t < hi) for t in near)  # noqa: B023, E731
            for k, b in kinds.items():
                assert got[i][f"{k}_{ring}"] == (inside(b, s, e) if e is not None else 0), (i, k)
            assert got[i][f"day_{ring}"] == inside("[)", s - 24, s)


def test_overlapping_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, float(rng.randrange(30)), float(rng.randrange(30)), rng.randrange(1, 25), rng.randrange(0, 6)) for i in range(120)]
    iv = intervals(spark, [(i, x, y, ts(s), ts(min(s + d, 28), 5)) for i, x, y, s, d in rows] + [(500, 1.0, 1.0, ts(2), None)])
    b = iv.selectExpr("id as b", "x_m as bx", "y_m as by", "start_ts as bs", "end_ts as be")
    got = [(r.id, r.b) for r in sp.radius_join_overlapping(iv, b, 5, days=3).collect()]
    ends = {i: (s * 24, min(s + d, 28) * 24 + 5) for i, x, y, s, d in rows}
    at = {i: (x, y) for i, x, y, *_ in rows}
    want = {(i, j) for i in at for j in at if math.dist(at[i], at[j]) <= 5 and ends[i][0] <= ends[j][1] and ends[j][0] <= ends[i][1]}
    assert len(got) == len(set(got)) and set(got) == want


def sequential(rows, reuse, occupied=()):
    taken, out = list(occupied), {}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[3])), key=lambda r: r[1]):
        for t, _, site, _, a, b in group:
            if all(s != site or (reuse and (a > d or b < c)) for s, c, d in taken):
                taken.append((site, a, b))
                out[t] = site
                break
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("reuse", [True, False])
def test_greedy_match_equals_a_sequential_pass(spark, seed, reuse):
    rng = random.Random(seed)
    rows = []
    for t in range(25):
        a = rng.randrange(20)
        b = a + rng.randrange(8)
        rows += [(t, (t * 7) % 25, s, k, a, b) for k, s in enumerate(rng.sample(range(8), rng.randrange(1, 6)))]
    held = [(s, a, a + rng.randrange(5)) for s in range(0, 8, 3) for a in (rng.randrange(20),)]
    candidates = spark.createDataFrame(rows, "treatment int, ord int, site int, pref int, w_start int, w_end int")
    occupied = spark.createDataFrame(held, "site int, w_start int, w_end int")
    for last in (0, 12, 10**6):  # all in rounds, the end in one task, all in one task
        got = mt.greedy_match(candidates, reuse, width=3, last_rows=last).collect()
        assert {r.treatment: r.site for r in got} == sequential(rows, reuse)
        got = mt.greedy_match(candidates, reuse, occupied, width=4, last_rows=last).collect()
        assert {r.treatment: r.site for r in got} == sequential(rows, reuse, held)
    assert mt.greedy_match(candidates.limit(0), reuse).count() == 0


def test_match_reasons_by_hand(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "treatment int")
    side = lambda r: spark.createDataFrame(r, "treatment int, site int, pref int")
    band = side([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1), (3, 7, 1), (5, 9, 1)])
    clean = side([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1), (5, 9, 1)])
    caliper = side([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1)])
    got = mt.match_reasons(rows, [("band", band), ("clean", clean), ("caliper", caliper)], spark.createDataFrame([(1, 8)], "treatment int, site int")).collect()
    assert {tuple(r) for r in got} == {(1, 3, 3, 3, 1, "matched"), (2, 1, 1, 1, 1, "all_blocked"), (3, 1, 0, 0, 0, "no_clean"), (4, 0, 0, 0, 0, "no_band"), (5, 1, 1, 0, 0, "no_caliper")}


@pytest.mark.parametrize("seed", range(2))
def test_caliper_by_profiles_and_by_pairs_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(2), float(rng.randrange(6)), rng.choice([0.0, 1.0, 4.5])) for i in range(60)] + [(99, 7, 1.0, 1.0)]
    units = spark.createDataFrame(rows, "id long, region int, n double, k double")
    sd = [float(np.std([math.log1p(r[c]) for r in rows], ddof=1)) for c in (2, 3)]
    want = {}
    for t in rows:
        for c in rows:
            d = [abs(math.log1p(t[x]) - math.log1p(c[x])) / s for x, s in zip((2, 3), sd, strict=True)]
            if t[0] != c[0] and t[1] == c[1] and max(d) <= 0.5:
                want[t[0], c[0]] = math.hypot(*d)
    got = {(r.t, r.c): r.z for r in mt.caliper_candidates(units, units, ["n", "k"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for r in mt.caliper_best(units, ["n", "k"]).collect():
        own = sorted((round(z, 9), c) for (t, c), z in want.items() if t == r.id)
        assert (r.n, r.c) == (len(own), own[0][1] if own else None) and (not own or abs(r.z - own[0][0]) < 1e-8)


@pytest.mark.parametrize("seed", range(3))
def test_fifo_equals_a_day_loop(spark, seed):
    rng = random.Random(seed)
    jobs = [(i, f"2024-01-{rng.randrange(1, 20):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00") for i in range(90)] + [(100, "2024-01-05 08:00:00")]
    got = wi.fifo_schedule(spark.createDataFrame(jobs, "id int, a string").selectExpr("id", "cast(a as timestamp_ntz) as arrival"), 4, "2024-01-01 08:00:00", buckets=5)
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1, 8)
    queue, want, day = sorted((datetime.fromisoformat(a), i) for i, a in jobs), {}, 0
    while queue:
        known = [q for q in queue if q[0] < t0 + timedelta(days=day)][:4]
        for q in known:
            want[q[1]] = day
            queue.remove(q)
        day += 1
    assert {r.id: r.service_day for r in got.collect()} == want


@SLOW
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30), st.sampled_from([0.0, 0.1, 0.5, 0.75, 0.999, 1.0]))
def test_quantile_higher_and_ranks(spark, values, q):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)], "id int, v double")
    assert ag.quantile_higher(df, "v", q).first()[0] == np.quantile(values, q, method="higher")
    import pandas as pd

    want = pd.Series(values).rank(method="average").tolist()
    got = {r.id: r.r for r in ag.average_rank(df, "v", "r").collect()}
    assert [got[i] for i in range(len(values))] == want and got[-1] is None


def test_running_total_equals_a_global_window(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i * 3 + rng.randrange(3), rng.randrange(9)) for i in range(500)], "k long, v long")
    got = {r.k: r.c for r in ag.running_total(df, "k", "v", "c", buckets=16).collect()}
    total = 0
    for r in sorted(df.collect()):
        total += r.v
        assert got[r.k] == total


def test_ties_nulls_and_constants(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None), (3, "z"), (3, "z"), (3, "a")], "k int, label string")
    assert {r.k: (r.modal, r.labels) for r in ag.modal_value(df, "k", "label").collect()} == {1: ("a", 2), 3: ("z", 2)}
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id int, v double")
    assert [r.s for r in ag.min_max(flat, "v", "s").orderBy("id").collect()] == [0.0, 0.0, None]
    score = sc.weighted_components(spark.createDataFrame([(1, 0.5, None), (2, None, None), (3, 1.0, 0.0)], "id int, a double, b double"), {"a": 3.0, "b": 1.0})
    assert [r.score for r in score.orderBy("id").collect()] == [0.5, None, 0.75]


def test_rules_and_guards(spark):
    df = spark.createDataFrame([(1, 5, None), (2, -1, "x"), (3, 9, "y")], "id int, v int, s string")
    rules = [("positive", "v > 0"), ("labelled", "s is not null")]
    assert [(r.id, r.reason_code, r.reason_step) for r in cl.first_failing_rule(df, rules).orderBy("id").collect()] == [(1, "labelled", 2), (2, "positive", 1), (3, None, None)]
    assert [(r.dropped, r.remaining) for r in cl.attrition(df, rules).orderBy("step").collect()] == [(1, 2), (1, 1)]
    with pytest.raises(ValueError, match="missing columns: z"):
        cl.require_columns(df, ["id", "z"])
    with pytest.raises(ValueError, match="forbidden"):
        cl.forbid_columns(df, ["s"])
    with pytest.raises(ValueError, match="repeat"):
        ag.validated_join(df, df.union(df).withColumnRenamed("s", "t"), "id")
    with pytest.raises(ValueError, match="check dup"):
        qc.assert_empty(qc.repeated_keys(df.union(df), ["id"]), "dup")


def test_quota_larger_than_group_and_budget(spark):
    rows = [(1, 5.0, "a"), (2, 4.0, "a"), (3, 0.0, "b"), (4, 9.0, "c"), (5, 8.0, "c"), (6, -1.0, "c")]
    df = spark.createDataFrame(rows, "id int, score double, region string")
    chosen = lambda budget, quota: {r.id for r in dp.quota_topk(df, "id", "score", "region", budget, quota).where("selected").collect()}
    assert chosen(4, 1) == {1, 3, 4, 5} and chosen(100, 1) == {1, 2, 3, 4, 5} and chosen(3, 0) == {4, 5, 1} and chosen(6, 9) == {1, 2, 3, 4, 5, 6}


def test_ols_matches_direct_algebra(spark):
    rng = np.random.default_rng(0)
    n = 200
    x, c, d = rng.normal(size=n), rng.integers(0, 12, n), rng.integers(0, 5, n)
    y = 1 + 2 * x + rng.normal(size=n) + c * 0.1
    df = spark.createDataFrame([(float(a), float(b), int(p), int(q)) for a, b, p, q in zip(x, y, c, d, strict=True)], "x double, y double, c int, d int")
    beta, cov, m = es.ols_cluster(df, "y", ["1", "x"], [["c"], ["d"], ["c", "d"]])
    X = np.column_stack((np.ones(n), x))
    inv = np.linalg.inv(X.T @ X)
    want = inv @ X.T @ y
    e = y - X @ want

    def part(groups):
        s = np.array([(X[groups == g] * e[groups == g, None]).sum(0) for g in np.unique(groups)])
        g = len(s)
        return g / (g - 1) * (n - 1) / (n - 2) * inv @ s.T @ s @ inv

    assert m == n and beta == pytest.approx(want) and cov == pytest.approx(part(c) + part(d) - part(c * 10 + d))


def test_poisson_with_fixed_effects_equals_dummies(spark):
    rng = np.random.default_rng(3)
    rows = [(u, t, float(rng.normal()), int(u % 4)) for u in range(8) for t in range(6)]
    data = [(u, t, x, c, int(rng.poisson(np.exp(0.3 * x + 0.1 * u + 0.2 * t)) + 1)) for u, t, x, c in rows]
    df = spark.createDataFrame(data, "u int, t int, x double, c int, y int")
    beta, cov, n = fx.ppml_two_fe(df, "y", ["x"], ("u", "t"), "c", tol=1e-7)
    X = np.array([[x] + [u == i for i in range(8)] + [t == j for j in range(1, 6)] for u, t, x, _, _ in data], float)
    y = np.array([r[4] for r in data], float)
    b = np.zeros(X.shape[1])
    for _ in range(100):
        mu = np.exp(X @ b)
        b = b + np.linalg.solve(X.T @ (mu[:, None] * X), X.T @ (y - mu))
    assert n == len(data) and beta[0] == pytest.approx(b[0], abs=1e-5) and cov[0, 0] > 0


def test_auc_with_ties(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(6) / 5, "g") for _ in range(80)]
    r = ev.ranking_metrics(spark.createDataFrame(rows, "y int, p double, g string"), "y", "p", ["g"]).first()
    pos, neg = [p for y, p, _ in rows if y], [p for y, p, _ in rows if not y]
    assert r.auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))


def test_negative_offsets_and_nights(spark):
    iv = intervals(spark, [(1, 0.0, 0.0, "2023-12-31 22:00:00", ts(2)), (2, 0.0, 0.0, ts(3), ts(3)), (3, 0.0, 0.0, ts(30, 5), "2024-02-09 00:00:00")])
    got = {(r.id, r.night) for r in ag.explode_nights(iv, "2024-01-01 00:00:00", 31).collect()}
    assert got == {(1, 0), (3, 29), (3, 30)}


def test_profile_and_different_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    assert {r.column_name: r.nulls for r in qc.profile(df).collect()} == {"id": 0, "s": 1}
    assert qc.different_rows(df, df).count() == 0 and qc.different_rows(df.union(df), df).count() == 2


def test_hash_order_is_one_permutation(spark):
    from hashlib import md5

    from duskline.plans import catalog

    sf = "/root/testdata/sf0.001"
    ids = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    ids.sort(key=lambda i: md5(f"11|{i}".encode()).hexdigest())
    got = {r.c_custkey: r.place for r in catalog.queries()["hash_order"](spark, sf).collect()}
    assert got == {c: i for i, c in enumerate(ids, 1)}


def test_quantiles_and_running_totals_by_group_with_nulls(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(30))])) for _ in range(400)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in ag.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.99, 1.0], ["g"]).collect()}
    for g in ("a", "b", None, "c"):
        assert np.allclose(got[g], np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.1, 0.5, 0.99, 1.0])), g
    assert "d" not in got
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("c"))
    for r in ag.running_totals(counts, "v", {"t": "c"}, ["g"], buckets=7).collect():
        assert r.t == sum(v is not None and v <= r.v for k, v in rows if k == r.g)


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from duskline import session

    nothing = SimpleNamespace(isDefined=lambda: False)
    conf = SimpleNamespace(get=lambda key, default="": default)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)), getConf=lambda: conf, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_ppml_equals_a_regression_with_dummies(spark):
    """The fixed-effects Poisson coefficient solves the equations of a Poisson regression with a dummy for each group."""
    rng = np.random.default_rng(4)
    rows = [(u, t, float(rng.poisson(np.exp(0.3 * (u % 3) + 0.2 * t + 0.4 * x))), x, u % 4) for u in range(14) for t in range(4) for x in [float(rng.integers(0, 3))]]
    df = es.drop_zero_groups(spark.createDataFrame(rows, "u int, t int, y double, x double, c int"), "y", ["u", "t"])
    beta, cov, n = fx.ppml_two_fe(df, "y", ["x"], ("u", "t"), "c")
    kept = [tuple(r) for r in df.select("u", "t", "y", "x").collect()]
    us, times = sorted({r[0] for r in kept}), sorted({r[1] for r in kept})
    design = np.array([[r[3], *[float(r[0] == u) for u in us], *[float(r[1] == t) for t in times[1:]]] for r in kept])
    y, b = np.array([r[2] for r in kept]), np.zeros(design.shape[1])
    for _ in range(60):
        mu = np.exp(design @ b)
        b = b + np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (y - mu))
    assert n == len(kept) and abs(beta[0] - b[0]) < 1e-5 and cov[0, 0] > 0


def test_candidates_importance_and_folds(spark):
    """A feature that decides the outcome is found by every classifier, noise is not; folds never see the group they predict."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from duskline.operators import features as fe

    rng = random.Random(8)
    rows = [(i, float(i % 10), rng.random() * 100, rng.choice("ab"), float(i % 10 > 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, good double, noise double, kind string, label double")
    weighted = fe.class_weights(df, "label")
    sums = {r.label: r.w for r in weighted.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums[0.0] == pytest.approx(sums[1.0]) and sum(sums.values()) == pytest.approx(400)
    every = fe.candidates(weight="weight")
    assert len(every) == 11
    some = {k: every[k] for k in ("logistic_weak", "forest_4_5", "boosted_2_0.3")}
    fitted, table_ = fe.fit_candidates(weighted, df, fe.preprocessing(["good", "noise"], ["kind"], logged=("good",)), some)
    assert all(r.auc == pytest.approx(1.0) for r in table_.collect()) and [r.model for r in table_.collect() if r.chosen] == ["boosted_2_0.3"]
    model = Pipeline(stages=[*fe.preprocessing(["good", "noise"], ["kind"]), LogisticRegression(regParam=0.01)]).fit(df)
    lost = {r.feature: r.importance for r in fe.permutation_importance(model, df, ["good", "noise"], "id").collect()}
    assert lost["good"] > 0.2 > 0.02 > abs(lost["noise"])
    counts = spark.createDataFrame([(g, float(rng.randrange(1, 4) + 3 * (g % 2)), float(g % 2)) for g in range(60)], "g int, n double, odd double").withColumn("days", F.lit(2.0))
    out = fe.group_kfold_predict(counts, "g", "n", "days", ["odd"]).collect()
    fold = {r.g: r.f for r in counts.select("g", F.pmod(F.xxhash64("g"), F.lit(3)).cast("int").alias("f")).collect()}
    assert len(out) == 60
    for r in out:  # two kinds of groups: the rate of the other folds' groups of its kind, about
        others = [x.n / 2 for x in out if fold[x.g] != fold[r.g] and x.odd == r.odd]
        assert r.predicted_rate == pytest.approx(sum(others) / len(others), rel=0.1)


def test_pairs_and_unmatched_by_hand(spark):
    matches = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "treatment int, site int")
    treatments = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0), (4, 8.0)], "treatment int, t_x double")
    sites = spark.createDataFrame([(7, 70.0), (8, 80.0), (9, 90.0)], "site int, c_x double")
    got = {tuple(r) for r in mt.assemble_pairs(matches, treatments, sites).select("treatment", "site", "control_uses", "t_x", "c_x").collect()}
    assert got == {(1, 7, 2, 5.0, 70.0), (2, 7, 2, 6.0, 70.0), (3, 8, 1, 7.0, 80.0)}
    reasons = spark.createDataFrame([(1, "matched"), (4, "all_blocked")], "treatment int, reason string")
    early = spark.createDataFrame([(10, "open")], "treatment int, reason string")
    assert {tuple(r) for r in mt.build_unmatched(reasons, early).collect()} == {(4, "all_blocked"), (10, "open")}
    own = spark.createDataFrame([(1, 9), (2, 9), (3, 7), (4, 8)], "treatment int, site int")
    assert {tuple(r) for r in mt.site_roles(sites, matches, own).collect()} == {(7, 1, 2), (8, 0, 1), (9, 2, 0)}
