"""Quantiles by selection against pandas, on values that make rounds hard."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from careflow.operators import quality as Q
from careflow.operators.selection import select_quantiles

QS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _column(kind: str, rng: random.Random, n: int = 2000) -> list:
    near = 1.0
    if kind == "near":  # neighbouring doubles
        out = []
        for _ in range(n):
            out.append(near)
            near = float(np.nextafter(near, 2.0))
        return out
    return [{"uniform": rng.random() * 100, "signed": rng.gauss(0, 1), "ties": float(rng.randint(0, 3)),
             "wide": rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300), "nulls": rng.choice([None, rng.random()]),
             "hot": 7.0 if rng.random() < 0.9 else rng.random() * 14, "none": None}[kind] for _ in range(n)]


KINDS = ["uniform", "signed", "ties", "wide", "nulls", "hot", "near", "none"]


def test_quantiles_match_pandas(spark):
    rng = random.Random(5)
    pdf = pd.DataFrame({k: pd.Series(_column(k, rng), dtype="float64") for k in KINDS})
    rows = [tuple(None if math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in KINDS)).repartition(5)
    got = select_quantiles(df, {k: F.col(k) for k in KINDS}, QS)
    assert got.pop("none") == [None] * len(QS)
    for k, values in got.items():
        assert values == pytest.approx([pdf[k].quantile(q) for q in QS], rel=1e-12, abs=0), k


def test_extreme_values_and_empty_table(spark):
    vals = [float("-inf"), -0.0, 0.0, 5e-324, 1.7e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = select_quantiles(df, {"x": F.col("x")}, [0.0, 1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6, 1.0])["x"]
    assert got[:6] == vals[:6] and math.isnan(got[6])
    assert select_quantiles(df.limit(0), {"x": F.col("x")}, [0.5]) == {"x": [None]}
    assert Q.numeric_profile(df.limit(0), ["x"]).collect() == []


def test_profile_plan_keeps_no_copy(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    rep = {r["column"]: r for r in Q.numeric_profile(df, ["x", "y"]).collect()}
    assert (rep["x"]["q1"], rep["x"]["median"], rep["x"]["q3"], rep["x"]["iqr_outliers"]) == (249.75, 499.5, 749.25, 0)
    assert (rep["y"]["count"], rep["y"]["missing"], rep["y"]["median"], rep["y"]["iqr_outliers"]) == (0, 1000, None, 0)
    plan = Q.numeric_profile(df, ["x", "y"])._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan and "RDDScan" not in plan
