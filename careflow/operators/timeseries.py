"""Time-series window operators.

Offsets count rows, not hours (the hourly master holds active hours
only); apply A16 first for a regular hourly series. Every operator
accepts ``series_cols``. Windows run over fixed-size row blocks with a
halo (numbered by :func:`careflow.operators.ordering.global_index`), so no
window partition is larger than one block, with or without series.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.operators.ordering import BLK, HOME, RN, global_index, halo_blocks, ranged

# Reference defaults for the demand features.
DEFAULT_LAGS = (1, 2, 3, 6, 12, 24)
DEFAULT_WINDOWS = (3, 6, 12, 24)


def windowed(df: DataFrame, order: Sequence[str], series: Sequence[str], back: int, ahead: int,
             build: Callable[[DataFrame, Window], DataFrame], block_rows: int = 1 << 16,
             keep_index: bool = False) -> DataFrame:
    """Run ``build(df, window)`` where ``window`` is partitioned by
    (series, block) and ordered by the global row number; frames may reach
    ``back`` rows before and ``ahead`` rows after the current row.
    """
    x = halo_blocks(df, order, back, series, block_rows, ahead)
    w = Window.partitionBy(*series, BLK).orderBy(RN)
    out = build(x, w).filter(F.col(HOME)).drop(BLK, HOME)
    return out if keep_index else out.drop(RN)


def add_lags(df: DataFrame, value: str, lags: Sequence[int], order: Sequence[str],
             series: Sequence[str] = (), name: str = "lag_{k}h", block_rows: int = 1 << 16) -> DataFrame:
    """``lag(value, k)`` for each k."""
    def build(x, w):
        return x.withColumns({name.format(k=k): F.lag(value, k).over(w) for k in lags})
    return windowed(df, order, series, max(lags), 0, build, block_rows)


def _rolling_cols(value: str, windows: Sequence[int], w: Window, mean_name: str, std_name: str) -> dict:
    out = {}
    for k in windows:
        frame = w.rowsBetween(-k, -1)
        out[mean_name.format(k=k)] = F.avg(F.col(value).cast("double")).over(frame)
        out[std_name.format(k=k)] = F.coalesce(F.stddev_samp(F.col(value).cast("double")).over(frame), F.lit(0.0))
    return out


def add_rolling(df: DataFrame, value: str, windows: Sequence[int], order: Sequence[str],
                series: Sequence[str] = (), mean_name: str = "roll_mean_{k}h",
                std_name: str = "roll_std_{k}h", block_rows: int = 1 << 16) -> DataFrame:
    """Mean and sample std over the previous k rows (current row
    excluded); std of fewer than two values is 0."""
    def build(x, w):
        return x.withColumns(_rolling_cols(value, windows, w, mean_name, std_name))
    return windowed(df, order, series, max(windows), 0, build, block_rows)


def _diff_cols(value: str, w: Window, leaky: bool) -> dict:
    y = F.col(value).cast("double")
    if leaky:
        return {"diff_1h": y - F.lag(value, 1).over(w), "diff_24h": y - F.lag(value, 24).over(w)}
    return {"diff_1h": F.lag(value, 1).over(w) - F.lag(value, 2).over(w),
            "diff_24h": F.lag(value, 1).over(w) - F.lag(value, 25).over(w)}


def add_diffs(df: DataFrame, value: str, order: Sequence[str], series: Sequence[str] = (),
              leaky: bool = False, block_rows: int = 1 << 16) -> DataFrame:
    """Differences. Default is leak-free (``lag1 - lag2``,
    ``lag1 - lag25``); ``leaky=True`` gives the reference's ``y - lag``,
    which lets ``lag_1h + diff_1h`` reproduce the target."""
    def build(x, w):
        return x.withColumns(_diff_cols(value, w, leaky))
    return windowed(df, order, series, 25, 0, build, block_rows)


def running_max(df: DataFrame, value: str, order: Sequence[str], out: str = "best_so_far",
                flag: str | None = "is_best", num_partitions: int | None = None) -> DataFrame:
    """Cumulative maximum in ``order`` (and a flag for new bests).

    Inside each range partition a window gives the running max; the max of
    all earlier partitions comes from a table with one row per partition.
    """
    x = ranged(df, order, num_partitions)
    top = x.groupBy("__pid").agg(F.max(value).alias("__top"))
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    before = top.select("__pid", F.max("__top").over(earlier).alias("__before"))
    w = Window.partitionBy("__pid").orderBy("__mid")
    x = x.join(F.broadcast(before), "__pid", "left")
    x = x.withColumn(out, F.greatest(F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__before"))
    if flag:
        x = x.withColumn("__prev", F.greatest(
            F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__before"))
        x = x.withColumn(flag, (F.col(value).isNotNull()
                                & (F.col("__prev").isNull() | (F.col(value) > F.col("__prev")))).cast("int")).drop("__prev")
    return x.drop("__pid", "__mid", "__before")


def sequences(df: DataFrame, value: str, order: Sequence[str], n_back: int, n_ahead: int = 1,
              series: Sequence[str] = (), x_col: str = "x_seq", y_col: str = "y_seq",
              block_rows: int = 1 << 16) -> DataFrame:
    """The previous ``n_back`` values as an array and the next
    ``n_ahead`` values (current row first) as the label array; rows
    without complete arrays are dropped."""
    def build(x, w):
        past = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(-n_back, -1))
        fut = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(0, n_ahead - 1))
        return x.withColumns({x_col: F.transform(past, lambda s: s["v"]),
                              y_col: F.transform(fut, lambda s: s["v"])})
    out = windowed(df, order, series, n_back, n_ahead, build, block_rows)
    return out.filter((F.size(x_col) == n_back) & (F.size(y_col) == n_ahead))


def time_index(df: DataFrame, order: Sequence[str], out: str = "time_idx",
               group_col: str | None = "group_id", group_value: str = "0") -> DataFrame:
    """Continuous 0-based time index (and a constant group id)."""
    x = global_index(df, order, "__i").withColumn(out, F.col("__i") - 1).drop("__i")
    return x.withColumn(group_col, F.lit(group_value)) if group_col else x


def seasonal_decompose(df: DataFrame, value: str, order: Sequence[str], period: int = 24,
                       series: Sequence[str] = (), block_rows: int = 1 << 16) -> DataFrame:
    """Additive decomposition with a centred moving-average trend.

    Even period p: weights 1/2p at both ends and 1/p inside a p+1 row
    frame; odd p: plain p-row centred mean. Trend is null where the frame
    is incomplete. Seasonal = mean detrended value per phase (row position
    mod p) minus the mean over phases; residual = value - trend - seasonal.
    """
    half = period // 2

    def build(x, w):
        y = F.col(value).cast("double")
        full = w.rowsBetween(-half, half)
        cnt = F.count(y).over(full)
        if period % 2 == 0:
            s = F.sum(y).over(full)
            ends = F.lag(y, half).over(w) + F.lead(y, half).over(w)
            trend = (s - F.lit(0.5) * ends) / F.lit(float(period))
            trend = F.when(cnt == period + 1, trend)
        else:
            trend = F.when(cnt == period, F.avg(y).over(full))
        return x.withColumn("trend", trend)

    out = windowed(df, order, series, half, half, build, block_rows, keep_index=True)
    if series:
        out = out.join(out.groupBy(*series).agg(F.min(RN).alias("__first")), list(series), "left")
    else:
        out = out.withColumn("__first", F.lit(1))  # rows are numbered from 1
    out = out.withColumn("phase", ((F.col(RN) - F.col("__first")) % period).cast("int"))
    det = F.col(value).cast("double") - F.col("trend")
    ph = out.groupBy(*series, "phase").agg(F.avg(det).alias("__pm"))
    # a window over the ``period`` phases of a series
    centre = F.avg("__pm").over(Window.partitionBy(*series))
    ph = ph.select(*series, "phase", (F.col("__pm") - centre).alias("seasonal"))
    # without series ph has ``period`` rows
    out = out.join(ph if series else F.broadcast(ph), [*series, "phase"], "left")
    out = out.withColumn("resid", F.col(value).cast("double") - F.col("trend") - F.col("seasonal"))
    return out.drop(RN, "__first")


def ts_features(master: DataFrame, target: str = "pacientes_llegando", ts: str = "timestamp",
                lags: Sequence[int] = DEFAULT_LAGS, windows: Sequence[int] = DEFAULT_WINDOWS,
                series: Sequence[str] = (), wait_col: str = "tiempo_espera",
                leaky_diff: bool = False, drop_incomplete: bool = True,
                block_rows: int = 1 << 16) -> DataFrame:
    """C9 (W1-W6, P11, P22): demand features in one windowed pass.

    Lags, rolling mean/std, differences, cyclical calendar terms and
    lagged wait over the hourly table; rows with any missing feature are
    dropped (W6) unless ``drop_incomplete`` is False.
    """
    df = master
    if "hour_of_day" not in df.columns:
        df = df.withColumn("hour_of_day", F.hour(ts))
    if "day_of_week" not in df.columns:
        df = df.withColumn("day_of_week", F.weekday(ts))
    if "month" not in df.columns:
        df = df.withColumn("month", F.month(ts))
    if "is_weekend" not in df.columns:
        df = df.withColumn("is_weekend", (F.col("day_of_week") >= 5).cast("int"))
    if "week_of_year" not in df.columns:
        df = df.withColumn("week_of_year", F.weekofyear(ts))
    has_wait = wait_col in df.columns
    back = max(max(lags), max(windows), 25 if not leaky_diff else 24, 24 if has_wait else 0)

    def build(x, w):
        cols = {f"lag_{k}h": F.lag(target, k).over(w) for k in lags}
        cols.update(_rolling_cols(target, windows, w, "roll_mean_{k}h", "roll_std_{k}h"))
        cols.update(_diff_cols(target, w, leaky_diff))
        if has_wait:
            cols["lag_wait_1h"] = F.lag(wait_col, 1).over(w)
            cols["lag_wait_24h"] = F.lag(wait_col, 24).over(w)
        return x.withColumns(cols)

    df = windowed(df, [ts], series, back, 0, build, block_rows)
    two_pi = 2 * math.pi
    df = df.withColumns({
        "hour_sin": F.sin(F.lit(two_pi) * F.col("hour_of_day") / 24.0),
        "hour_cos": F.cos(F.lit(two_pi) * F.col("hour_of_day") / 24.0),
        "dow_sin": F.sin(F.lit(two_pi) * F.col("day_of_week") / 7.0),
        "dow_cos": F.cos(F.lit(two_pi) * F.col("day_of_week") / 7.0),
        "month_sin": F.sin(F.lit(two_pi) * F.col("month") / 12.0),
        "month_cos": F.cos(F.lit(two_pi) * F.col("month") / 12.0),
    })
    cols = feature_columns(df.columns, lags, windows, has_wait)
    out = df.select(*series, ts, target, *cols)
    return out.dropna(subset=[ts, target, *cols]) if drop_incomplete else out


def feature_columns(columns: Sequence[str], lags: Sequence[int] = DEFAULT_LAGS,
                    windows: Sequence[int] = DEFAULT_WINDOWS, has_wait: bool = True) -> list[str]:
    """The reference's feature list order."""
    temporal = ["hour_of_day", "day_of_week", "month", "is_weekend", "week_of_year",
                "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
    lag_cols = [f"lag_{k}h" for k in lags]
    roll = [f"roll_mean_{k}h" for k in windows] + [f"roll_std_{k}h" for k in windows]
    triage = [c for c in columns if c.startswith("triage_")]
    wait = ["lag_wait_1h", "lag_wait_24h"] if has_wait else []
    return temporal + lag_cols + roll + ["diff_1h", "diff_24h"] + triage + wait
