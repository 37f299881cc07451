"""Exact order statistics of many columns by selection.

No value is sorted or shuffled: each round is one scan that counts the rows of
every column in buckets whose order is the values' order, combined map-side,
and keeps for each wanted rank the bucket that holds it. The next round looks
only at values inside that bucket. Shuffled are at most ``BUCKETS`` rows per
task and open bucket, whatever the number of rows.

The first buckets are sixteenths of an octave (powers of two), later ones are
equal parts of the last bucket's own minimum and maximum. Both ends of a
bucket are values of the column, so they always part, and a bucket's width
shrinks by ``BUCKETS`` a round: five rounds, one more where rounding parts
unevenly, tell any two doubles apart, and a bucket of one value ends its
search at once.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def _octaves(x: Column) -> Column:
    """Bucket number by sign and sixteenths of an octave; NaN comes last."""
    part = F.floor(F.least(F.log2(F.abs(x)) * 16, F.lit(17000.0))) + 20000
    return F.when(F.isnan(x), F.lit(99999)).when(x == 0, F.lit(0)).when(x > 0, part).otherwise(-part).cast("long")


def _counted(df: DataFrame, items: Sequence[Column]) -> DataFrame:
    """Rows (t, b) with the count and the ends of the values in bucket b of t,
    and ``before``: the count of t's smaller values."""
    rows = df.select(F.explode(F.array(*items)).alias("p")).where("p is not null").select("p.*")
    hist = rows.groupBy("t", "b").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = Window.partitionBy("t").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _one_value(lo: float, hi: float) -> bool:
    return lo == hi or math.isnan(lo)


def select_quantiles(df: DataFrame, values: Mapping[str, Column], quantiles: Sequence[float]) -> dict[str, list]:
    """Exact quantiles (linear interpolation) of each column of ``values``
    (name -> double expression; nulls don't count), in the order of
    ``quantiles``; None for a column without values.

    ``df`` is scanned once a round, so it should be a table, not a costly plan. To the driver come two rows at most for each
    column and quantile in a round.
    """
    names, qs = list(values), [float(q) for q in quantiles]
    # round 1: one histogram per column, which also gives the ranks wanted
    items = [F.when(x.isNotNull(), F.struct(F.lit(i).alias("t"), _octaves(x).alias("b"), x.alias("x")))
             for i, x in enumerate(values.values())]
    n = F.sum("n").over(Window.partitionBy("t"))
    at = F.array(*[f((F.col("all") - 1) * F.lit(q)) for q in qs for f in (F.floor, F.ceil)])
    first = (_counted(df, items).withColumn("all", n).withColumn("r", F.explode(F.array_distinct(at)))
             .where("before <= r and r < before + n").select("t", "r", "lo", "hi", "before", "all"))
    open_, done, total = {}, {}, {}
    for t, r, lo, hi, before, count in first.collect():
        total[t] = count
        open_[t, r] = (lo, hi, before)
    while open_:
        done |= {k: lo for k, (lo, hi, _) in open_.items() if _one_value(lo, hi)}
        open_ = {k: v for k, v in open_.items() if k not in done}
        if not open_:
            break
        inside = sorted({(t, *v) for (t, _), v in open_.items()})  # buckets, each maybe of several ranks
        items = []
        for i, (t, lo, hi, _) in enumerate(inside):
            x = values[names[t]]
            b = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BUCKETS), F.lit(BUCKETS - 1)).cast("long")
            items.append(F.when(x.between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("t"), b.alias("b"), x.alias("x"))))
        number = {v: i for i, v in enumerate(inside)}
        want = F.array(*[F.struct(F.lit(number[t, *v]).alias("i"), F.lit(t).alias("c"), F.lit(r).cast("long").alias("r"),
                                  F.lit(v[2]).cast("long").alias("off")) for (t, r), v in open_.items()])
        found = (_counted(df, items).withColumn("w", F.explode(want))
                 .where("w.i = t and w.off + before <= w.r and w.r < w.off + before + n")
                 .select("w.c", "w.r", "lo", "hi", F.col("w.off") + F.col("before")))
        open_ = {(t, r): (lo, hi, before) for t, r, lo, hi, before in found.collect()}
    out = {}
    for t, name in enumerate(names):
        out[name] = [None] * len(qs)
        if t in total:
            for i, q in enumerate(qs):
                h = (total[t] - 1) * q
                lo, hi = done[t, math.floor(h)], done[t, math.ceil(h)]
                out[name][i] = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
    return out
