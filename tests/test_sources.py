"""Sources, sinks, scalar functions and features on edge rows."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from duskline import functions as fn
from duskline import sources as so
from duskline.operators import exposure as ex
from duskline.operators import features as fe


def test_csv_types_and_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,when,v,skip\n0012,2024-01-05,1.25,x\n7,not a date,,y\n")
    got = so.read_csv_typed(spark, str(tmp_path / "a.csv"), "v double, id string, when date").collect()
    assert [(r.id, r.v, str(r.when)) for r in got] == [("0012", 1.25, "2024-01-05"), ("7", None, "None")]


def test_absent_columns_are_null_and_writes_are_ordered(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    so.write_parquet(df, str(tmp_path / "p"), "s string, id long")
    assert spark.read.parquet(str(tmp_path / "p")).dtypes == [("s", "string"), ("id", "bigint")]
    assert tuple(so.read_parquet_cols(spark, str(tmp_path / "p"), "id int, later double").first()) == (1, None)


def test_json_document_has_no_nan(spark, tmp_path):
    so.write_json_doc(spark.createDataFrame([(1, float("nan"), 2.5)], "n int, bad double, good double"), str(tmp_path / "j"))
    text = next((tmp_path / "j").glob("part-*")).read_text()
    assert json.loads(text) == {"n": 1, "bad": None, "good": 2.5}


def test_union_reconciles_counts(spark):
    df = spark.range(3)
    assert so.union_sources([("a", df, 3), ("b", df, None)]).count() == 6
    with pytest.raises(ValueError, match="b: 4 rows expected, 3 found"):
        so.union_sources([("a", df, 3), ("b", df, 4)])


def test_backup_only_without_the_column(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "old"))
    assert so.backup_if_legacy(spark, str(tmp_path / "old"), str(tmp_path / "copy"), "new") and spark.read.parquet(str(tmp_path / "copy")).count() == 2
    assert not so.backup_if_legacy(spark, str(tmp_path / "old"), str(tmp_path / "none"), "id")


def test_scalars(spark):
    df = spark.createDataFrame([(-7, 2.5, "2024-12-30 10:00:00"), (7, 3.5, "2023-01-01 00:00:00")], "a int, v double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = df.select(fn.floor_div(F.col("a"), 3).alias("q"), fn.half_even(F.col("v")).alias("r"), fn.iso_week("t").alias("w"), fn.finite(F.lit(float("inf"))).alias("f")).collect()
    assert [tuple(r) for r in got] == [(-3, 2.0, "2025-W01", None), (2, 4.0, "2022-W52", None)]
    assert fn.normal_p(1.959963984540054) == pytest.approx(0.05)


def test_features_never_look_ahead(spark):
    rows = [(1, 1, "2024-01-06 10:00:00"), (2, 1, "2024-01-06 10:00:00"), (3, 1, "2024-01-07 09:59:59"), (4, 2, "2024-01-07 10:00:00")]
    df = spark.createDataFrame(rows, "id int, k int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.id: (r.prior_1d, r.since_previous_s, r.weekend) for r in fe.engineer_features(df, "k", "t").collect()}
    assert got == {1: (0, None, 1), 2: (0, None, 1), 3: (2, 86399, 1), 4: (0, None, 1)}
    folded = fe.fold_rare(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string"), "c", 2)
    assert sorted(str(r.c) for r in folded.collect()) == ["None", "a", "a", "other"]


def test_permuted_keeps_the_values(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 2)
    out = fe.permuted(df, "v", "id", 3)
    assert sorted(r.v for r in out.collect()) == [2 * i for i in range(500)]
    assert sum(r.v == 2 * r.id for r in out.collect()) < 50


def test_scenarios_and_zero_cells(spark):
    iv = spark.createDataFrame([(0.0, 0.0, "2024-01-02 00:00:00", "2024-01-03 00:00:00"), (0.0, 0.0, "2024-01-05 00:00:00", "2024-01-05 12:00:00")], "x_m double, y_m double, s string, e string")
    iv = iv.selectExpr("x_m", "y_m", "cast(s as timestamp_ntz) start_ts", "cast(e as timestamp_ntz) end_ts")
    nights = lambda s: sorted(r.night for r in ex.scenario_nights(iv, s, "2024-01-01 00:00:00", 14).collect())
    assert (nights("base"), nights("gap2"), nights("half"), nights("early")) == ([1, 4], [1, 2, 3, 4], [1, 4], [0, 1, 2, 3, 4])
    pts = spark.createDataFrame([(10.0, 10.0, "2024-01-09 00:00:00"), (900.0, 10.0, "2024-01-01 00:00:00")], "x_m double, y_m double, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    panel = ex.exposure_panel(pts, ex.open_nights(iv, "2024-01-01 00:00:00", 14), 100, [80, 200], "2024-01-01 00:00:00", 2)
    assert {(r.gx, r.week): (r.y, r.x_0, r.x_1) for r in panel.collect()} == {(0, 0): (0, 2, 0), (0, 1): (1, 0, 0), (9, 0): (1, 0, 0), (9, 1): (0, 0, 0)}


@pytest.mark.parametrize("most", [2000, 5])
def test_trailing_counts_equal_loops(spark, most):
    """One pass for usual keys and ranges for crowded ones give what loops give; before, every event was probed for each window."""
    from duskline.operators import windows as wi

    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 1, 1, 2, 3]), None if i % 17 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=250 * rng.randrange(8_000_000))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k int, t timestamp_ntz")
    out = wi.trailing_counts(df, "k", "t", {"a": 7, "b": 1}, "since", most)
    got = {r.id: (r.a, r.b, r.since) for r in out.collect()}
    sec = lambda t: None if t is None else int((t - dt.datetime(1970, 1, 1)).total_seconds())
    want = {}
    for i, k, t in rows:
        before = [sec(u) - sec(t) for _, q, u in rows if t and u and q == k and sec(u) < sec(t)]
        want[i] = (sum(b >= -7 * 86400 for b in before), sum(b >= -86400 for b in before), -max(before) if before else None)
    assert got == want and out.columns == ["id", "k", "t", "a", "b", "since"]
    if most == 2000:
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_share_their_stages(spark, monkeypatch):
    """Stages are fitted once for all models and scores ranked once; both were done for every model."""
    from pyspark.ml.feature import Imputer

    calls, fit, rank = [], Imputer._fit, fe.ranking_metrics
    monkeypatch.setattr(Imputer, "_fit", lambda self, df: calls.append("fit") or fit(self, df))
    monkeypatch.setattr(fe, "ranking_metrics", lambda *a: calls.append("rank") or rank(*a))
    rows = [(float(i % 7), "ab"[i % 2], float(i * 37 % 11 > 4), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, kind string, label double, weight double")
    models = {k: v for k, v in fe.candidates(weight="weight").items() if k.startswith("logistic") or k == "forest_4_5"}
    fitted, table = fe.fit_candidates(df, df, fe.preprocessing(["x"], ["kind"]), models)
    assert calls == ["fit", "rank"]
    got = {r.model: r.auc for r in table.collect()}
    alone = {n: rank(fe.with_probability(m, df), "label", "p").first().auc for n, m in fitted.items()}  # whole pipelines, on raw rows
    assert got == pytest.approx(alone) and set(got) == set(models)
