"""Recursive forecasts (M20): every series advances all its steps in one pass.

The state of a series is its last values (as many as the longest lag or
window asks for); each predicted hour becomes the newest value of the next.
Series share no rows, so the state is built with one shuffle and a task
advances its series together, as columns of arrays: no job per step and no
checkpoint, whatever the horizon. A fitted Spark model is turned into arrays
once (:func:`scorer`), which score the same as the model itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.operators.ordering import top_n

_LAG, _MEAN, _STD = (re.compile(p) for p in (r"lag_(\d+)h", r"roll_mean_(\d+)h", r"roll_std_(\d+)h"))
_WAIT, _DIFF = re.compile(r"lag_wait_(\d+)h"), re.compile(r"diff_(\d+)h")
#: Columns that a future hour has no value for yet count as none, like every ``triage_`` column.
NOT_YET = ("valid_wait_proxy", "wait_proxy_valid_count")


# ---------------------------------------------------------------- models as arrays

@dataclass
class LinearScorer:
    """``intercept + coefficients . features`` over named features."""

    features: list[str]
    coefficients: np.ndarray
    intercept: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ np.asarray(self.coefficients, float) + self.intercept


@dataclass
class Tree:
    """A decision tree: inner nodes name a feature and a threshold (or the categories that go left)."""

    feature: list[int] = field(default_factory=list)
    test: list = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(x)), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = self.value[node]
                continue
            column, test = x[rows, self.feature[node]], self.test[node]
            goes = np.isin(column, test) if isinstance(test, list) else column <= test
            todo += [(n, r) for n, r in ((self.left[node], rows[goes]), (self.right[node], rows[~goes])) if len(r)]
        return out


@dataclass
class TreesScorer:
    """Weighted sum of trees over named features."""

    features: list[str]
    trees: list[Tree]
    weights: list[float]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.stages(x)[:, -1]

    def stages(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the first tree, the first two, and so on, a column each."""
        return np.cumsum(np.column_stack([w * t(x) for t, w in zip(self.trees, self.weights)]), axis=1)


_IF = re.compile(r"If \(feature (\d+) (<=|in) (.+)\)$")


def _read_tree(text: str) -> Tree:
    """A tree from the model's printed form (numbers are printed in full)."""
    lines = iter([x.strip() for x in text.splitlines() if x.strip().startswith(("If", "Else", "Predict"))])
    tree = Tree()

    def node() -> int:
        at, line = len(tree.feature), next(lines)
        for part in (tree.feature, tree.test, tree.left, tree.right, tree.value):
            part.append(-1)
        if line.startswith("Predict"):
            tree.value[at] = float(line.split(":")[1])
            return at
        found = _IF.match(line)
        tree.feature[at] = int(found[1])
        tree.test[at] = (float(found[3]) if found[2] == "<="
                         else [float(v) for v in found[3].strip("{}").split(",") if v])
        tree.left[at] = node()
        next(lines)  # the Else that mirrors the If
        tree.right[at] = node()
        return at

    node()
    return tree


def scorer(model):
    """A fitted pipeline of an assembler and a tree ensemble, tree or linear regression, as arrays."""
    if callable(model) and hasattr(model, "features"):
        return model
    names, last = list(model.stages[0].getInputCols()), model.stages[-1]
    if hasattr(last, "coefficients"):
        return LinearScorer(names, last.coefficients.toArray(), float(last.intercept))
    trees = getattr(last, "trees", [last])
    weights = list(getattr(last, "treeWeights", [1.0] * len(trees)))
    if "Regressor" not in type(last).__name__ and "Regression" not in type(last).__name__:
        raise ValueError("only regression models are advanced")
    if type(last).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    return TreesScorer(names, [_read_tree(t.toDebugString) for t in trees], weights)


# ---------------------------------------------------------------- features of the next hour

def history_needed(features: Sequence[str]) -> int:
    """Past values that some feature of the list reaches back to."""
    out = [1]
    for name in features:
        for pattern, more in ((_LAG, 0), (_MEAN, 0), (_STD, 0), (_WAIT, 0), (_DIFF, 1)):
            if found := pattern.fullmatch(name):
                out.append(int(found[1]) + more)
        if _DIFF.fullmatch(name):
            out.append(2)
    return max(out)


def _calendar(name: str, hours: pd.Series) -> np.ndarray | None:
    dt = hours.dt
    plain = {"hour": lambda: dt.hour, "hour_of_day": lambda: dt.hour, "day_of_week": lambda: dt.dayofweek,
             "day": lambda: dt.day, "month": lambda: dt.month, "is_weekend": lambda: dt.dayofweek >= 5,
             "week_of_year": lambda: dt.isocalendar().week}
    if name in plain:
        return plain[name]().to_numpy(float)
    for c, wave in (("sin", np.sin), ("cos", np.cos)):
        for base, column in (("hour", "hour"), ("hour_of_day", "hour"), ("dow", "dayofweek"), ("day_of_week", "dayofweek"),
                             ("month", "month")):
            if name == f"{base}_{c}":
                period = {"hour": 24.0, "dayofweek": 7.0, "month": 12.0}[column]
                return wave(2 * math.pi * getattr(dt, column).to_numpy(float) / period)
    return None


def next_features(names: Sequence[str], past: np.ndarray, waits: np.ndarray, hours: pd.Series,
                  constants: dict[str, float]) -> np.ndarray:
    """One row of features for each series, from its values before the hour (newest last, NaN: none).

    Differences look back only (``lag 1 - lag 2``, ``lag 1 - lag k+1``), as the
    training features do. Standard deviations of fewer than two values are 0.
    """
    out = np.empty((len(past), len(names)))
    for j, name in enumerate(names):
        if name in constants:
            out[:, j] = constants[name]
        elif found := _LAG.fullmatch(name):
            out[:, j] = past[:, -int(found[1])]
        elif found := _WAIT.fullmatch(name):
            out[:, j] = waits[:, -int(found[1])]
        elif found := _DIFF.fullmatch(name):
            out[:, j] = past[:, -1] - past[:, -int(found[1]) - 1]
        elif found := _MEAN.fullmatch(name) or _STD.fullmatch(name):
            window = past[:, -int(found[1]):]
            known = ~np.isnan(window)
            n = known.sum(axis=1)
            mean = np.where(known, window, 0.0).sum(axis=1) / np.maximum(n, 1)
            if _MEAN.fullmatch(name):
                out[:, j] = np.where(n > 0, mean, np.nan)
            else:
                square = np.where(known, (window - mean[:, None]) ** 2, 0.0).sum(axis=1)
                out[:, j] = np.where(n > 1, np.sqrt(square / np.maximum(n - 1, 1)), 0.0)
        elif name.startswith("triage_") or name in NOT_YET:
            out[:, j] = 0.0
        else:
            column = _calendar(name, hours)
            if column is None:
                raise ValueError(f"no value is known for the future of feature {name!r}; give it in constants")
            out[:, j] = column
    return out


def advance(score, past: np.ndarray, waits: np.ndarray, last: pd.Series, horizon: int, step: pd.Timedelta,
            constants: dict[str, float]) -> np.ndarray:
    """Forecasts of ``horizon`` steps for each series, clipped at 0, fed back as they come."""
    n, depth = past.shape
    values = np.concatenate([past, np.full((n, horizon), np.nan)], axis=1)
    unknown = np.concatenate([waits, np.full((n, horizon), np.nan)], axis=1)  # later waits are not known
    for h in range(horizon):
        x = next_features(score.features, values[:, h:depth + h], unknown[:, h:depth + h], last + (h + 1) * step, constants)
        values[:, depth + h] = np.maximum(score(x), 0.0)
    return values[:, depth:]


def recursive_forecast(model, series: DataFrame, value: str, ts: str, horizon: int = 24,
                       series_cols: Sequence[str] = (), wait: str | None = None,
                       constants: dict[str, float] | None = None, step: str = "1h") -> DataFrame:
    """(series columns, timestamp, step, forecast) for ``horizon`` steps after each series' last row.

    ``model`` is a fitted pipeline (assembler, then a regression) or a scorer;
    the features are those it was trained on, named as ``ts_features`` names
    them: lags, rolling means and deviations and differences of any reach,
    calendar terms and their waves, ``triage_*`` (0), lagged waits (``wait``
    is their column; null for hours still to come). Any other feature needs a
    value in ``constants``. Missing history is null. Rows with a null
    timestamp take no part; an empty table gives an empty result.
    """
    score = scorer(model)
    depth = history_needed(score.features)
    rows = series.where(F.col(ts).isNotNull()).select(
        *series_cols, F.col(ts).alias("__t"), F.col(value).cast("double").alias("__v"),
        (F.col(wait).cast("double") if wait else F.lit(None).cast("double")).alias("__w"))
    if series_cols:
        newest = Window.partitionBy(*series_cols).orderBy(F.desc("__t"), "__v", "__w")
        rows = rows.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= depth).drop("__k")
    else:
        rows = top_n(rows, depth, [F.desc("__t"), F.col("__v"), F.col("__w")])
    state = rows.groupBy(*series_cols).agg(
        F.array_sort(F.collect_list(F.struct("__t", "__v", "__w"))).alias("__s"), F.max("__t").alias("__last"))
    state = state.where("__last is not null").select(
        *series_cols, "__last", F.transform("__s", lambda r: r["__v"]).alias("__v"),
        F.transform("__s", lambda r: r["__w"]).alias("__w"))
    fixed, gap = dict(constants or {}), pd.Timedelta(step)

    def padded(lists: pd.Series) -> np.ndarray:
        out = np.full((len(lists), depth), np.nan)
        for i, values in enumerate(lists):
            out[i, depth - len(values):] = np.array(values, float)
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            last = f["__last"].reset_index(drop=True)
            found = advance(score, padded(f["__v"]), padded(f["__w"]), last, horizon, gap, fixed)
            steps = np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(f))
            out = f[list(series_cols)].loc[f.index.repeat(horizon)].reset_index(drop=True)
            out["timestamp"] = last.repeat(horizon).reset_index(drop=True) + steps * gap
            out["step"], out["forecast"] = steps, found.ravel()
            yield out

    fields = "".join(f"`{c}` {series.schema[c].dataType.simpleString()}, " for c in series_cols)
    kind = series.schema[ts].dataType.simpleString()
    return state.mapInPandas(run, f"{fields}timestamp {kind}, step int, forecast double")
