"""Places instead of rows, counts of meeting intervals, runs, gaps and exact rounding, against loops and the SQL."""

import datetime as dt
import math
import random

import duckdb
import pytest

from duskline.plans import catalog

T0 = dt.datetime(2024, 1, 1)


def rows_of(sf, name):
    """The SQL's rows over the parquet files of a folder."""
    c = duckdb.connect()
    for f in sf.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return sorted(c.execute(catalog.oracle_sql()[name]).fetchall(), key=repr)


def test_display_fields_rounds_ties_of_tenths(spark, tmp_path):
    balances = [-759.6, -752.4, -735.6, 759.6, 6.0, 3.6, 12.34]
    spark.createDataFrame([(k, f"S{k}", 0, b) for k, b in enumerate(balances)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "NORTH")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r.s_suppkey: r.days for r in catalog.queries()["display_fields"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    want = dict(enumerate(c.execute(f"SELECT round_even(b / 24.0, 1) FROM (SELECT unnest({balances}::DOUBLE[]) AS b)").fetchnumpy().popitem()[1].tolist()))
    assert got == want


def test_trailing_mean_is_computed_once(spark, small):
    q = catalog.queries()["trailing_mean_level"](spark, small)
    # Two scans of the events would be two sums, of which one may differ from the other in the last bit.
    assert "events" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert "value" not in q._jdf.queryExecution().optimizedPlan().toString()


def scattered(spark, seed, n, spots=40):
    """``n`` rows at few places, some without one, and their list."""
    rng = random.Random(seed)
    at = [(float(rng.randrange(60)), float(rng.randrange(60))) for _ in range(spots)]
    rows = [(i, *(rng.choice(at) if i % 19 else (None, None)), i % 3, rng.randrange(25)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, x_m double, y_m double, city int, cust int"), rows


def far(a, b):
    return math.inf if a[1] is None or b[1] is None else math.hypot(a[1] - b[1], a[2] - b[2])


def test_counts_in_bands_meet_by_place(spark):
    from duskline.operators import spatial as sp

    (u, us), (p, ps) = scattered(spark, 1, 150), scattered(spark, 2, 300)
    for by in (None, ["city"]):
        got = {(r.id, r.band): r.n for r in sp.count_in_bands(u, p, [8, 20], by=by).collect()}
        want = {}
        for a in us:
            for b in ps:
                d = far(a, b)
                if d <= 20 and (not by or a[3] == b[3]):
                    want[a[0], int(d > 8)] = want.get((a[0], int(d > 8)), 0) + 1
        assert got == want
    # 2,000 rows on each side at one place are one pair of places; they were 4,000,000 pairs.
    heap = spark.range(2000).selectExpr("id", "0.0D as x_m", "0.0D as y_m")
    n = sp.count_in_bands(heap, heap, [1])
    assert n.agg({"n": "sum"}).first()[0] == 4_000_000
    joined = [m for m in n._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in m]
    assert len(joined) >= 3


def test_distinct_values_around_places(spark):
    from duskline.operators import spatial as sp

    (u, us), (p, ps) = scattered(spark, 3, 60), scattered(spark, 4, 200, 150)
    ps = [(*r[:4], r[4] if r[0] % 2 else r[0] + 1000) for r in ps]  # half of the values are at one place only
    p = spark.createDataFrame(ps, "id long, x_m double, y_m double, city int, cust int")
    got = {(r.x_m, r.y_m): r.n for r in sp.distinct_within(u, p, "cust", 15).collect()}
    want = {(a[1], a[2]): len({b[4] for b in ps if far(a, b) <= 15}) for a in us if a[1] is not None}
    assert got == {k: v for k, v in want.items() if v}


def test_nearest_of_many_at_one_place(spark):
    from duskline.operators import spatial as sp

    (a, xs), (b, ys) = scattered(spark, 5, 120), scattered(spark, 6, 400)
    right = b.selectExpr("id as bid", "x_m as bx", "y_m as by")
    got = {r.id: (round(r.distance, 9), r.bid) for r in sp.nearest_join(a, right, 50, 60, "id", "bid").collect()}
    want = {x[0]: min((round(far(x, y), 9), y[0]) for y in ys) for x in xs if x[1] is not None}
    assert got == {k: v for k, v in want.items() if v[0] <= 60}


def timed(spark, seed, n):
    rng = random.Random(seed)
    at = [(float(rng.randrange(40)), float(rng.randrange(40))) for _ in range(12)]
    rows = [(i, *rng.choice(at), s, s + rng.randrange(12)) for i in range(n) for s in [rng.randrange(200)]]
    day = lambda x: T0 + dt.timedelta(hours=6 * x)
    df = spark.createDataFrame([(i, x, y, day(s), day(e) if i % 23 else None) for i, x, y, s, e in rows], "id long, x_m double, y_m double, start_ts timestamp_ntz, end_ts timestamp_ntz")
    return df, rows


def test_meeting_counts_equal_loops(spark):
    from duskline.operators import spatial as sp

    (u, us), (b, bs) = timed(spark, 7, 80), timed(spark, 8, 200)
    got = {r.id: (r.a_0, r.a_1, r.b_0, r.b_1) for r in sp.count_meeting(u, b, {"a": ("start_ts", "end_ts", "[]"), "b": ("start_ts", "end_ts", "()")}, [6, 15], days=3).collect()}
    for i, x, y, s, e in us:
        want = [0, 0, 0, 0]
        for j, bx, by, c, d in bs:
            away = math.hypot(x - bx, y - by)
            if i % 23 and j % 23 and away <= 15:
                want[int(away > 6)] += c <= e and d >= s
                want[2 + int(away > 6)] += c < e and d > s
        if s < e:  # a window without length that is open on both sides holds nothing to compare
            assert got[i] == tuple(want), i


def test_runs_make_the_same_episodes_and_torn_links(spark):
    from duskline.operators import matching as mt
    from duskline.operators.components import connected_components

    iv = timed(spark, 9, 150)[0].where("end_ts is not null")
    links = mt.link_pairs(iv, 8).cache()
    comp = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    of = mt.episodes(iv, 8).cache()
    assert {r.id: r.episode for r in of.collect()} == {r.id: comp.get(r.id, r.id) for r in iv.collect()}
    for torn in ("case when id % 7 = 0 then -id else episode end", "case when id % 2 = 0 then -1 else episode end", "-cast(x_m as long)"):
        spoilt = of.join(iv.select("id", "x_m"), "id").selectExpr("id", f"{torn} as episode").cache()
        want = sorted(map(tuple, mt.torn_links(links, spoilt).collect()))
        assert sorted(map(tuple, mt.torn_pairs(iv, spoilt, 8).collect())) == want and want


def test_open_candidates_are_those_without_a_taken_window(spark):
    from duskline.operators import matching as mt

    rng = random.Random(11)
    taken = [(rng.randrange(6), s, s + rng.randrange(9)) for s in (rng.randrange(120) for _ in range(50))]
    treated = [(i, rng.randrange(4), s, s + rng.randrange(12)) for i, s in enumerate(rng.randrange(120) for _ in range(80))]
    near = [(o, s) for o in range(4) for s in range(8) if (o + s) % 3]  # sites 6 and 7 are never taken
    frames = spark.createDataFrame(treated, "treatment long, own long, w_start long, w_end long"), spark.createDataFrame(near, "own long, site long"), spark.createDataFrame(taken, "site long, w_start long, w_end long")
    got = sorted((r.treatment, r.site) for r in mt.open_candidates(*frames, width=10).collect())
    assert got == sorted((t, s) for t, o, a, z in treated for p, s in near if p == o and not any(q == s and a <= d and z >= c for q, c, d in taken))


def test_recheck_recounts_every_interval(spark):
    from duskline.operators import quality_checks as qc
    from duskline.operators import spatial as sp

    iv, _ = timed(spark, 12, 3000)
    pts = timed(spark, 13, 200)[0].selectExpr("x_m", "y_m", "start_ts as t")
    right = sp.count_in_zone_during(pts, iv, 10, 20).cache()
    assert qc.recheck_counts(right, iv, pts, 10, 20).collect() == []
    # A sample of 2,000 would miss some.
    spoilt = right.withColumn("n_ring", right.n_ring + 1)
    assert qc.recheck_counts(spoilt, iv, pts, 10, 20).count() == 3000


@pytest.mark.parametrize("most", [7, 200_000])
def test_recheck_deals_crowded_cells_and_equals_loops(spark, most):
    from duskline.operators import quality_checks as qc

    iv, _ = timed(spark, 21, 150)
    pts = timed(spark, 22, 120)[0].selectExpr("x_m", "y_m", "start_ts as t")
    pts = pts.unionByName(pts.where("x_m > 10")).cache()  # some points several times
    none = iv.selectExpr("id", "-1L as n_disc", "-1L as n_ring")
    got = {r.id: (r.n_disc, r.n_ring) for r in qc.recheck_counts(none, iv, pts, 10, 20, most=most).collect()}
    seen = [p for p in pts.collect() if None not in p]
    want = {}
    for i in iv.collect():
        known = None not in (i.x_m, i.y_m, i.start_ts, i.end_ts)
        d = [math.sqrt((p.x_m - i.x_m) ** 2 + (p.y_m - i.y_m) ** 2) for p in seen if i.start_ts <= p.t <= i.end_ts] if known else []
        want[i.id] = (sum(v <= 10 for v in d), sum(10 < v <= 20 for v in d))
    assert got == want and any(a for a, _ in want.values()) and any(b for _, b in want.values())


def test_radius_join_by_place_equals_loops(spark):
    from duskline.operators import spatial as sp

    (a, xs), (b, ys) = scattered(spark, 14, 80), scattered(spark, 15, 200)
    right = b.selectExpr("id as bid", "x_m as bx", "y_m as by")
    got = sorted((r.id, r.bid, r.distance) for r in sp.radius_join_by_place(a, right, 12, digits=6).select("id", "bid", "distance").collect())
    assert got == sorted((x[0], y[0], round(far(x, y), 6)) for x in xs for y in ys if far(x, y) <= 12)


def test_kinds_meet_instead_of_rows(spark):
    from duskline.operators import quality_checks as qc

    rows = [(i, i % 3 if i % 10 else None) for i in range(60)]
    left, left_kinds = qc.kinds_of(spark.createDataFrame(rows, "id long, v int"), "id", "k")
    right, right_kinds = qc.kinds_of(spark.createDataFrame([(i, i % 4) for i in range(50)], "rid long, w int"), "rid", "l")
    assert (left_kinds.count(), right_kinds.count()) == (4, 4)  # 60 and 50 rows
    broken = left_kinds.crossJoin(right_kinds).where("v <> w").selectExpr("k", "l", "'differs' as rule")
    got = sorted((r.id, r.rid) for r in qc.each_of(broken, right, left).collect())
    assert got == sorted((i, j) for i, v in rows for j in range(50) if v is not None and v != j % 4)


def test_links_are_compared_once(spark):
    from duskline.operators import matching as mt

    df, rows = timed(spark, 16, 150)
    rows = [r for r in rows if r[0] % 23]
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and far(a, b) <= 8 and a[3] <= b[4] and b[3] <= a[4])
    for days in (1, 5):
        assert sorted((r.a, r.b) for r in mt.link_pairs(df, 8, days=days).collect()) == want


def test_parameter_sets_share_one_count(spark, monkeypatch):
    from duskline.operators import exposure as ex

    iv, _ = timed(spark, 17, 60)
    pts = timed(spark, 18, 300)[0].selectExpr("x_m", "y_m", "start_ts as t")
    pairs = iv.where("end_ts is not null").selectExpr("id as pair", "id % 5 as cluster", "x_m as t_x", "y_m as t_y", "x_m + 6 as c_x", "y_m as c_y", "start_ts", "end_ts")
    specs = {"base": (8, 3, 2), "wide": (15, 3, 2), "long": (8, 3, 5), "none": (8, 0, 2)}
    want = {name: {r.pair: round(r.d, 9) for r in ex.pair_effects(ex.build_pair_panel(pairs, pts, [s[0]], *s[1:]), f"y_{s[0]}", "cluster").collect()} for name, s in specs.items()}
    got = ex.spec_effects(pairs, pts, specs, "cluster").collect()
    assert {n: {r.pair: round(r[n], 9) for r in got if r[n] is not None} for n in specs} == want and want["base"] and not want["none"]
    calls, count = [], ex.count_in_windows
    monkeypatch.setattr(ex, "count_in_windows", lambda *a, **k: calls.append(1) or count(*a, **k))
    ex.robustness_grid(pairs, pts, {k: v for k, v in specs.items() if k != "none"}, "cluster")
    assert len(calls) == 1  # one a set before


def test_counts_in_bands_are_a_band_join(spark, monkeypatch):
    from duskline.operators import spatial as sp

    (u, us), (p, ps) = scattered(spark, 23, 60), scattered(spark, 24, 90)
    right = u.selectExpr("id as uid", "x_m as bx", "y_m as by", "id % 3 as kind")
    pairs = sp.band_join(p.selectExpr("id", "x_m", "y_m", "id % 3 as kind"), right, [6, 15], by=["kind"]).collect()
    want = sorted((y[0], x[0], 0 if far(x, y) <= 6 else 1) for x in us for y in ps if x[0] % 3 == y[0] % 3 and far(x, y) <= 15)
    assert sorted((r.id, r.uid, r.band) for r in pairs) == want and want
    calls, join = [], sp.band_join
    monkeypatch.setattr(sp, "band_join", lambda *a, **k: calls.append(1) or join(*a, **k))
    got = {(r.id, r.band): r.n for r in sp.count_in_bands(u, p, [6, 15]).collect()}
    assert len(calls) == 1  # none before: the rings were told apart beside the join
    assert sum(got.values()) == sum(far(x, y) <= 15 for x in us for y in ps)  # every pair of rows


@pytest.mark.parametrize("most", [(500_000, 2_000_000), (9, 30)])
def test_windows_and_meetings_are_read_in_cells(spark, most):
    """Counts in cells, also where crowded cells are dealt to several tasks, against loops; no row a pair of place and point is moved."""
    from duskline.operators import spatial as sp

    (u, us), (b, _) = timed(spark, 25, 70), timed(spark, 26, 160)
    pts = b.selectExpr("x_m", "y_m", "start_ts as t").unionByName(spark.createDataFrame([(None, 1.0, T0)], "x_m double, y_m double, t timestamp_ntz"))
    u = u.unionByName(spark.createDataFrame([(-1, None, 2.0, T0, T0)], u.schema))
    windows = {"a": ("start_ts", "end_ts", "[]"), "b": ("start_ts - interval 2 days", "start_ts", "[)"), "c": ("end_ts", "end_ts + interval 1 day", "(]")}
    counted = sp.count_in_windows(u, pts, windows, [6, 15], most=most)
    got = {r.id: tuple(r)[1:] for r in counted.collect()}
    met = {r.id: tuple(r)[1:] for r in sp.count_meeting(u, b, {"n": windows["c"]}, [6, 15], most=most).collect()}
    seen, rows, day = [p for p in pts.collect() if p.x_m is not None], b.collect(), dt.timedelta(days=1)
    want, meets = {}, {}
    for r in u.collect():
        away = lambda p: math.inf if r.x_m is None else math.hypot(p.x_m - r.x_m, p.y_m - r.y_m)  # noqa: B023, E731
        s, e = r.start_ts, r.end_ts
        tests = (lambda t: e and s <= t <= e, lambda t: s - 2 * day <= t < s, lambda t: e and e < t <= e + day)  # noqa: B023
        want[r.id] = tuple(sum(bool(ok(p.t)) and lo < away(p) <= hi for p in seen) for ok in tests for lo, hi in ((-1, 6), (6, 15)))
        meets[r.id] = tuple(sum(bool(e and p.end_ts and p.start_ts <= e + day and p.end_ts > e) and lo < away(p) <= hi for p in rows) for lo, hi in ((-1, 6), (6, 15)))
    assert got == want and all(any(w[i] for w in want.values()) for i in range(6)) and got[-1] == (0,) * 6
    assert met == meets and any(w[0] for w in meets.values())
    assert "SortMergeJoin" not in (plan := counted._jdf.queryExecution().toString()) and "Window" not in plan  # pairs went through both before


def test_parameter_sets_are_not_joined_back(spark):
    from duskline.operators import exposure as ex

    iv, _ = timed(spark, 27, 40)
    pairs = iv.where("end_ts is not null").selectExpr("id as pair", "id % 5 as cluster", "x_m as t_x", "y_m as t_y", "x_m + 6 as c_x", "y_m as c_y", "start_ts", "end_ts")
    e = ex.spec_effects(pairs, iv.selectExpr("x_m", "y_m", "start_ts as t"), {"base": (8, 3, 2), "wide": (15, 3, 5)}, "cluster")
    assert "Join" not in e._jdf.queryExecution().optimizedPlan().toString() and e.count() == pairs.count()


@pytest.mark.parametrize("few", [200_000, 3])
def test_links_move_an_interval_few_times(spark, monkeypatch, few):
    from duskline.operators import matching as mt

    monkeypatch.setattr(mt, "NEAR_ROWS", few)
    df, rows = timed(spark, 28, 120)
    rows = [r for r in rows if r[0] % 23]
    links = mt.link_pairs(df, 8)
    assert sorted((r.a, r.b) for r in links.collect()) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and far(a, b) <= 8 and a[3] <= b[4] and b[3] <= a[4])
    # Few pairs of places go to the intervals; intervals were dealt out by place first, and once a day they are open.
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (few > 3) and "86400" not in plan and "/ 4" in plan
