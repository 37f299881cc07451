"""Forecasts, searches, splits, encodings and logs against plain loops."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import LinearRegression  # noqa: F401  (the scorer reads one)
from pyspark.sql import functions as F

from careflow.functions.calendar import format_minute
from careflow.operators import features as FE
from careflow.operators import forecast as FO
from careflow.operators import kpi as K
from careflow.operators import metrics as ME
from careflow.operators import models as MO
from careflow.operators import quality as Q
from careflow.operators import search as MS
from careflow.operators import split as SP
from careflow.sources import io as IO

START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def table(spark):
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((300, 4))
    y = np.maximum(x[:, 0] * 3 + np.where(x[:, 1] > 0.3, 4, -1) + x[:, 2] * x[:, 3] + 5, 0)
    rows = [(i, *map(float, a), float(b), int(b > 6)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, label int").repartition(3).cache()


COLS = ["a", "b", "c", "d"]


def test_scorers_score_as_their_models(table):
    x = np.array(table.orderBy("id").select(*COLS).collect(), float)
    for model in (MO.fit_gbt_regressor(table, COLS, "y", {"n_estimators": 5, "max_depth": 4, "subsample": 0.8}),
                  MO.linear_baseline(table, COLS, "y")):
        want = [r[0] for r in model.transform(table).orderBy("id").select("prediction").collect()]
        assert np.allclose(FO.scorer(model)(x), want, atol=1e-9)


def plain_forecast(weights, intercept, values, last, horizon):
    """The recursion by hand for one series, over lag 1, lag 30, a window, a difference and the hour."""
    values, out = list(values), []
    for h in range(1, horizon + 1):
        t = last + timedelta(hours=h)
        lag = lambda k: values[-k] if len(values) >= k else math.nan
        window = values[-5:]
        std = float(np.std(window, ddof=1)) if len(window) > 1 else 0.0
        x = [lag(1), lag(30), sum(window) / len(window), std, lag(1) - lag(25), math.sin(2 * math.pi * t.hour / 24),
             int(t.weekday() >= 5), 0.0, 2.5]
        y = sum(w * v for w, v in zip(weights, x)) + intercept
        values.append(max(y, 0.0) if not math.isnan(y) else math.nan)
        out.append((t, h, values[-1]))
    return out


def test_recursive_forecast_of_many_series(spark):
    names = ["lag_1h", "lag_30h", "roll_mean_5h", "roll_std_5h", "diff_24h", "hour_sin", "is_weekend", "triage_A", "beds"]
    weights = [0.4, 0.2, 0.3, -0.1, 0.05, 1.0, -0.5, 9.0, 0.1]
    rnd = random.Random(3)
    series = {s: [rnd.random() * 9 for _ in range(n)] for s, n in (("x", 60), ("y", 31), ("short", 3))}
    rows = [(s, START + timedelta(hours=i), v) for s, vs in series.items() for i, v in enumerate(vs)]
    rows.append(("x", None, 5.0))
    frame = spark.createDataFrame(rows, "s string, ts timestamp_ntz, y double").repartition(4)
    got = FO.recursive_forecast(FO.LinearScorer(names, weights, 0.7), frame, "y", "ts", 30, ["s"], constants={"beds": 2.5})
    found = {(r["s"], r["step"]): (r["timestamp"], r["forecast"]) for r in got.collect()}
    assert len(found) == 90
    for s, values in series.items():
        for t, h, y in plain_forecast(weights, 0.7, values, START + timedelta(hours=len(values) - 1), 30):
            assert found[s, h][0] == t
            assert (found[s, h][1] is None) == math.isnan(y) and (math.isnan(y) or found[s, h][1] == pytest.approx(y, abs=1e-9))
    one = FO.recursive_forecast(FO.LinearScorer(names, weights, 0.7), frame.where("s = 'x'").drop("s"), "y", "ts", 30,
                                constants={"beds": 2.5})
    assert [r["forecast"] for r in one.orderBy("step").collect()] == pytest.approx([found["x", h][1] for h in range(1, 31)])


def test_forecast_of_nothing_and_of_unknown_features(spark):
    none = spark.createDataFrame([], "ts timestamp_ntz, y double")
    assert FO.recursive_forecast(FO.LinearScorer(["lag_1h"], [1.0]), none, "y", "ts").collect() == []
    with pytest.raises(ValueError, match="beds"):
        FO.next_features(["beds"], np.ones((1, 1)), np.ones((1, 1)), pd.Series([pd.Timestamp(START)]), {})
    assert FO.history_needed(["lag_48h", "roll_std_12h", "diff_1h", "hour"]) == 48
    assert FO.history_needed(["diff_24h"]) == 25


def test_first_trees_are_the_smaller_model(table):
    big, small = (MO.fit_gbt_regressor(table, COLS, "y", {"n_estimators": n, "max_depth": 3, "subsample": 0.7,
                                                          "colsample_bytree": 0.5}) for n in (6, 2))
    x = np.array(table.orderBy("id").select(*COLS).collect(), float)
    want = [r[0] for r in small.transform(table).orderBy("id").select("prediction").collect()]
    assert np.allclose(FO.scorer(big).stages(x)[:, 1], want)


def test_grid_and_out_of_fold(table):
    folds = MS.Folds(SP.expanding_folds(table, ["id"], 3), COLS, "y", ["id"])
    grid = {"n_estimators": [1, 3], "learning_rate": [0.1, 0.3], "max_depth": [2]}
    found = MS.grid_search(folds, grid).collect()
    assert sorted((r["n_estimators"], r["learning_rate"], r["folds"]) for r in found) == [
        (1.0, 0.1, 3), (1.0, 0.3, 3), (3.0, 0.1, 3), (3.0, 0.3, 3)]
    oof, trees = MS.out_of_fold(folds, {"n_estimators": 3, "learning_rate": 0.3, "max_depth": 2})
    rows = oof.collect()
    assert sorted(r["id"] for r in rows) == list(range(75, 300)) and len(trees) == 3
    by_fold = {f: np.mean([abs(r["y"] - r["prediction"]) for r in rows if r["fold"] == f]) for f in (1, 2, 3)}
    same = next(r for r in found if r["n_estimators"] == 3 and r["learning_rate"] == 0.3)
    assert same["cv_mae_mean"] == pytest.approx(np.mean(list(by_fold.values())))
    assert same["cv_mae_std"] == pytest.approx(np.std(list(by_fold.values())))


def test_halving(table):
    assert MS.halving_rungs(30) == [(30, 1 / 9), (10, 1 / 3), (4, 1.0)] and MS.halving_rungs(3) == [(3, 1.0)]
    rows = MS.written(table, COLS, ["id", "label"])
    train, valid = rows.where("id % 4 <> 0"), rows.where("id % 4 = 0")
    space = MO.NOSHOW_SPACE | {"n_estimators": (1, 3, "int"), "max_depth": (1, 3, "int")}
    log = MS.halving_search(train, valid, "features", "label", "id", 7, space, 1.5).collect()
    assert [r["number"] for r in log] == list(range(7))
    assert Counter((r["state"], r["rung"]) for r in log) == {("COMPLETE", 1): 4, ("PRUNED", 0): 3}
    assert all(0 <= r[m] <= 1 for r in log for m in ("value", "pr_auc", "precision", "recall", "f1_score", "accuracy"))
    best = max((r for r in log if r["state"] == "COMPLETE"), key=lambda r: (r["value"], -r["number"]))
    params = MO.sample_params(space, 7)[best["number"]]
    weighted = train.withColumn("w", F.when(F.col("label") == 1, 1.5).otherwise(1.0))
    model = MO.gbt_classifier(params, "features", "label", "w").fit(weighted)
    scored = MO.probability_of_positive(model.transform(valid))
    assert ME.roc_auc(scored, "label", "prob").first()[0] == pytest.approx(best["value"])


def test_metrics_of_groups(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.randrange(2), round(rnd.random(), 1)) for g in ("a", "b", None) for _ in range(60)]
    rows += [("one", 1, 0.3), ("one", 1, 0.7)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r["g"]: r for r in ME.grouped_binary_metrics(df, ["g"], "y", "p", 0.5).collect()}
    assert len(got) == 4 and got["one"]["roc_auc"] is None and got["one"]["pr_auc"] == 1.0
    for g in ("a", "b", None):
        own = df.where(F.col("g").eqNullSafe(F.lit(g)))
        assert got[g]["roc_auc"] == pytest.approx(ME.roc_auc(own, "y", "p").first()[0])
        assert got[g]["pr_auc"] == pytest.approx(ME.average_precision(own, "y", "p").first()[0])
        want = ME.binary_metrics(own, "y", "p", 0.5).first().asDict()
        assert {k: got[g][k] for k in want} == pytest.approx(want)


def test_stratified_split_with_ties_and_hot_classes(spark):
    rows = [("hot", i % 7) for i in range(700)] + [("rare", i) for i in range(9)] + [(None, 1)] * 20 + [("one", 5)]
    df = spark.createDataFrame(rows, "label string, id long").repartition(5)
    split = SP.stratified_split(df, "label", ["id"], 0.2, 7)
    n = Counter((r["label"], r["is_test"]) for r in split.collect())
    assert n == {("hot", True): 140, ("hot", False): 560, ("rare", True): 2, ("rare", False): 7,
                 (None, True): 4, (None, False): 16, ("one", False): 1}
    unique = spark.range(2000).withColumn("label", F.col("id") % 3)
    sets = [{r["id"] for r in SP.stratified_split(unique.repartition(k), "label", ["id"]).where("is_test").collect()} for k in (1, 6)]
    assert sets[0] == sets[1] and len(sets[0]) == 399
    by_hash = unique.withColumn("h", F.xxhash64("id", F.lit(42))).orderBy("h").collect()
    assert sets[0] == {r["id"] for c in range(3) for r in [x for x in by_hash if x["label"] == c][:round(0.2 * sum(
        x["label"] == c for x in by_hash))]}


def test_masks_of_values_seen_once(spark):
    rules = {"c": (3, "OTHER", {"NA": "UNKNOWN"}), "e": (2, "MASK", None)}
    rows = [("1", "1", 0), ("001", "2", 0), ("2", "2", 0), ("NA", "3", 1), (None, None, 1), ("7.0", "4", 1), ("UNKNOWN", "4", 1)]
    df = spark.createDataFrame(rows, "c string, e string, y int").repartition(3)
    got = Counter(map(tuple, FE.clean_and_mask(df, rules).collect()))
    assert got == Counter([("001", "MASK", 0), ("001", "02", 0), ("OTHER", "02", 0), ("UNKNOWN", "MASK", 1),
                           ("OTHER", "MASK", 1), ("OTHER", "04", 1), ("UNKNOWN", "04", 1)])
    part = spark.createDataFrame([("1", "4", 0), ("2", "2", 0), ("2", "2", 0)], df.schema)
    got = Counter((r["c"], r["e"]) for r in FE.clean_and_mask(df, rules, part).collect())
    assert got == Counter([("OTHER", "01"), ("OTHER", "02"), ("002", "02"), ("UNKNOWN", "03"), ("<NA>", "<NA>"),
                           ("007", "MASK"), ("UNKNOWN", "MASK")])


def test_sparse_one_hot(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, "é", "x"), (4, "a", "y")]
    df = spark.createDataFrame(rows, "id int, p string, q string")
    book = FE.category_dictionary(df, ["q", "p"], ["p_b"])
    assert sorted((r["index"], r["column"], r["level"]) for r in book.collect()) == [
        (0, "q", "x"), (1, "q", "y"), (2, "p", "a"), (3, "p", "é")]
    other = df.unionByName(spark.createDataFrame([(5, "new", "y")], df.schema))
    got = sorted((r["id"], r["index"]) for r in FE.one_hot_long(other, "id", ["p", "q"], book).collect())
    assert got == [(1, 0), (2, 2), (3, 0), (3, 3), (4, 1), (4, 2), (5, 1)]
    assert FE.named_levels(df, ["p"]).keys() == {"p"}
    with pytest.raises(ValueError, match="one_hot_long"):
        FE.named_levels(df, ["p"], most=2)


def test_counts_at_many_thresholds(spark):
    rnd = random.Random(5)
    values = [round(rnd.random(), 2) for _ in range(500)] + [None]
    limits = [round(rnd.random(), 2) for _ in range(3000)] + [None, 0.0, 1.0]
    v = spark.createDataFrame([(x,) for x in values], "p double")
    t = spark.createDataFrame(list(enumerate(limits)), "id int, threshold double")
    got = {r["id"]: r["n"] for r in K.count_at_least(v, "p", t, "threshold", "n").collect()}
    assert got == {i: None if x is None else sum(p is not None and p >= x for p in values) for i, x in enumerate(limits)}


def test_staffing_alerts(spark):
    rows = [(h, a) for h, a in ((2, 10), (3, 13), (12, 10), (13, 1), (14, 9))]
    plan = K.staffing_plan(spark.createDataFrame(rows, "hour int, pacientes_llegando int"))
    got = [(r["hour"], r["severity"], r["needed_doctors"]) for r in K.staffing_alerts(plan).collect()]
    assert got == [("02:00", "warning", 4), ("03:00", "critical", 5), ("12:00", "warning", 4)]


def test_minutes_in_a_daylight_saving_gap(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:15.5' AS ts")
        assert df.select(format_minute("ts")).first()[0] == "2024-03-10 02:30"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_reports_order_and_missing_counts(spark):
    df = spark.createDataFrame([("A", "x", "1"), ("B", "x", "x"), (None, "X", None)], "p string, q string, n string")
    rep = [(r["column"], r["possible_text_inconsistency"]) for r in Q.text_inconsistency(df, ["p", "q"]).collect()]
    assert rep == [("q", 1), ("p", 0)]
    r = Q.numeric_profile(df, ["n"]).first()
    assert (r["count"], r["missing"]) == (1, 1)


def test_baseline_keeps_rows_without_a_feature(spark, table):
    model = MO.linear_baseline(table, COLS, "y")
    gap = table.withColumn("a", F.when(F.col("id") != 3, F.col("a")))
    pred = {r["id"]: r["prediction"] for r in model.transform(gap).collect()}
    assert len(pred) == 300 and math.isnan(pred[3]) and not math.isnan(pred[4])


def test_prediction_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for day in range(1, 9):
        rows = spark.createDataFrame([(day, i, 0.5) for i in range(4)], "day int, k int, prob double")
        for _ in range(1 + (day == 3)):  # the third batch is written again
            IO.append_predictions(rows, path, "ann" if day % 2 else "bob", batch_id=f"day-{day}", at=f"2024-01-0{day} 08:00:00")
    log = IO.read_predictions(spark, path)
    assert log.count() == 32 and log.select("batch").distinct().count() == 8
    got = IO.prediction_history(log, "ann", 5, id_col="k", date_col="date")
    assert [(r["day"], r["k"]) for r in got.collect()] == [(7, 3), (7, 2), (7, 1), (7, 0), (5, 3)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "2024-01-05" in plan
    assert IO.prediction_history(log, "bob", 99, id_col="k", date_col="date").count() == 16
    with pytest.raises(ValueError):
        IO.append_predictions(log, path, "ann", batch_id="../x")


def test_model_report(spark, tmp_path):
    IO.write_json(spark.createDataFrame([(0.5, 3)], "MAE double, n int"), str(tmp_path / "a"))
    rows = IO.model_report(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}).collect()
    assert {(r["model"], r["MAE"], r["n"]) for r in rows} == {("a", 0.5, 3), ("b", None, None)}
