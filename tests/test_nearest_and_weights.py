"""Weighted nearest centres, weight sensitivity and the sampled recheck against brute force."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskline.operators import quality_checks as qc
from duskline.operators import scores as sc
from duskline.operators import spatial as sp


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_in_sigmas_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    centres = [(i, rng.uniform(0, 100) if seed > 1 else 5.0, rng.uniform(0, 100) if seed > 1 else 5.0, rng.choice([0.1, 1.0, 1.0, 30.0]), rng.randrange(3)) for i in range(25)]
    centres += [(90, None, 1.0, 1.0, 0), (91, 1.0, 1.0, 0.0, 0), (92, 1.0, 1.0, None, 1), (93, 1.0, 1.0, 1.0, None)]
    points = [(i, rng.uniform(-50, 200), rng.uniform(0, 100), rng.randrange(4)) for i in range(60)] + [(98, 1e6, 0.0, 0), (97, None, 1.0, 0), (96, 1.0, 1.0, None)]
    got = sp.assign_region(spark.createDataFrame(points, "id int, x_m double, y_m double, city int"), spark.createDataFrame(centres, "rid int, rx double, ry double, sigma double, city int"), "id")
    want = {}
    for i, x, y, c in points:
        near = [(math.hypot(x - rx, y - ry) / s, r) for r, rx, ry, s, k in centres if k == c and c is not None and None not in (x, rx, s) and s > 0] if x is not None else []
        if near:
            want[i] = min(near)[1]
    assert {r.id: r.rid for r in got.collect()} == want
    assert sp.assign_region(spark.createDataFrame(points, "id int, x_m double, y_m double, city int"), spark.createDataFrame(centres, "rid int, rx double, ry double, sigma double, city int").limit(0), "id").collect() == []


def test_weight_sensitivity_equals_pandas(spark):
    rng = random.Random(4)
    frame = pd.DataFrame({"id": range(200), "a": [rng.choice([None, *[k / 7 for k in range(8)]]) for _ in range(200)], "b": [rng.choice([None, rng.random()]) for _ in range(200)]})
    weights, variants = {"a": 0.7, "b": 0.3}, sc.weight_variants({"a": 0.7, "b": 0.3}, 3, "s")
    assert all(0.6 * weights[c] <= v <= 1.4 * weights[c] for n, w in variants.items() if n.startswith("scaled") for c, v in w.items()) and len(variants) == 5

    def score(w):
        total = sum(frame[c].notna() * v for c, v in w.items())
        return (sum(frame[c].fillna(0) * v for c, v in w.items()) / total.where(total > 0)).round(9)

    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)], "id long, a double, b double")
    got = {r.variant: r for r in sc.weight_sensitivity(df, "id", weights, variants, top=20).collect()}
    base = score(weights)
    best = lambda s: set(pd.DataFrame({"s": s, "id": frame.id}).dropna().sort_values(["s", "id"], ascending=[False, True]).id[:20])
    for name, w in variants.items():
        s = score(w)
        both = base.notna() & s.notna()
        assert got[name].rows == both.sum() and got[name].overlap == len(best(base) & best(s)) / 20
        assert got[name].spearman == pytest.approx(base[both].rank().corr(s[both].rank()))


def test_sampled_recheck_finds_what_is_spoilt_and_nothing_else(spark):
    rng = random.Random(5)
    hour = lambda h: f"2024-01-01 00:00:00' + make_dt_interval(0, {h}, 0, 0)"
    iv = spark.createDataFrame([(i, rng.uniform(0, 50), rng.uniform(0, 50), h, h + rng.randrange(20)) for i in range(300) for h in [rng.randrange(60)]], "id long, x_m double, y_m double, a int, b int")
    iv = iv.select("id", "x_m", "y_m", F.expr(f"timestamp_ntz '{hour('a')}").alias("start_ts"), F.expr(f"timestamp_ntz '{hour('b')}").alias("end_ts")).cache()
    pts = spark.createDataFrame([(rng.uniform(0, 50), rng.uniform(0, 50), rng.randrange(80)) for _ in range(400)], "x_m double, y_m double, h int").select("x_m", "y_m", F.expr(f"timestamp_ntz '{hour('h')}").alias("t")).cache()
    right = sp.count_in_zone_during(pts, iv, 10, 20).cache()
    assert qc.sampled_recheck(right, iv, pts, 10, 20, 300).collect() == []
    spoilt = right.withColumn("n_ring", F.col("n_ring") + (F.col("id") % 3 == 0).cast("int"))
    some = {r.id for r in qc.sampled_recheck(spoilt, iv, pts, 10, 20, 100).collect()}
    assert 15 <= len(some) <= 60 and all(i % 3 == 0 for i in some)
    assert {r.id for r in qc.sampled_recheck(spoilt, iv, pts, 10, 20, 300).collect()} == {i for i in range(300) if i % 3 == 0}
    assert {r.id for r in qc.sampled_recheck(right.where("id <> 7"), iv, pts, 10, 20, 300).collect()} == {7}  # a count that is missing
