"""Order-dependent building blocks that stay distributed.

Several reference operators depend on row order over a whole table
(lags, rolling frames, block means, chronological splits, exact
quantiles). A bare ``Window.orderBy(...)`` without ``partitionBy`` moves
the whole table into one task; these helpers avoid that:

* :func:`global_index` numbers rows 1..N in a total order: parts with bounds
  on the full, unique ordering (balanced even when one key holds a third of
  the rows), a position in each part, and the counts of the parts before it.
  Nothing is persisted or written.
* :func:`prefix_sums` gives running totals from range partitions and a table
  of per-partition offsets whose size is the number of partitions (bounded,
  so it is broadcast).
* :func:`halo_blocks` cuts the numbered rows into blocks of fixed size and
  copies the last ``halo`` rows of each block into the next one, so a window
  partitioned by block sees every row its frame reaches back to.
* :func:`exact_quantiles` gives exact, interpolated quantiles per group
  from running totals of value counts (no per-group value buffer).
* :func:`top_n` / :func:`attach_scalars` are the bounded helpers for
  top-k and one-row aggregates.
"""

from __future__ import annotations

import json
import math
from itertools import accumulate
from typing import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.session import checkpoint_dir

RN = "_rn"
BLK = "_blk"
HOME = "_home"


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _order_exprs(order_cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_cols]


def ranged(df: DataFrame, order_cols: Sequence, num_partitions: int | None = None) -> DataFrame:
    """Rows in range partitions of ``order_cols``, sorted inside each, written
    once: ``__pid`` is the partition, ``__mid`` grows with the order.

    Checkpointed because range bounds come from sampling, so two independent
    evaluations could cut the data differently. The input is persisted only
    while the bounds are sampled and the checkpoint written.
    """
    checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    order = _order_exprs(order_cols)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = (src.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("__pid", F.spark_partition_id())
              .withColumn("__mid", F.monotonically_increasing_id())).checkpoint(eager=True)
    src.unpersist()
    return out


#: Rows of the sample for each part, and the formats that keep its timestamps' microseconds.
SAMPLE_ROWS = 100
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the checkpoint folder: for a costly
    plan that several operators read, or one scanned several times."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def part_of(df: DataFrame, order: Sequence[Column], parts: int) -> Column:
    """Number of the part that a row falls in: parts follow ``order`` and are
    about equally large.

    The bounds are quantiles of a sample of ``SAMPLE_ROWS * parts`` rows, whatever
    the number of rows, and become a literal, so that each evaluation cuts alike;
    a row finds its group of bounds, then its place in the group. Bounds are cut to the first columns of
    ``order`` that tell them all apart: no values of these then stand in more
    than about two parts' rows, and the columns after them need not be read.
    Any bounds give right results, a poor sample only uneven parts.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = df.select(key.alias("k"))
    total = df.count()
    if not total or parts < 2:
        return F.lit(0)
    sample = keys.sample(min(1.0, SAMPLE_ROWS * parts / total), 7) if total > SAMPLE_ROWS * parts else keys
    tops = sample.select("k", F.ntile(parts).over(Window.orderBy("k")).alias("t")).groupBy("t").agg(F.max("k").alias("k"))
    found = [json.loads(r[0]) for r in
             tops.where(F.col("t") < parts).orderBy("t").select(F.to_json("k", _JSON)).collect()]
    if not found:
        return F.lit(0)
    firsts = [{json.dumps([f.get(f"o{i}") for i in range(n)]) for f in found} for n in range(1, len(order) + 1)]
    used = 1 + next(n for n, first in enumerate(firsts) if len(first) == len(firsts[-1]))
    kind = T.StructType(keys.schema["k"].dataType.fields[:used])
    own = order[0] if used == 1 else F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order[:used])])

    def literal(bounds: list[dict]) -> Column:
        text = json.dumps([{f"o{i}": f.get(f"o{i}") for i in range(used)} for f in bounds])
        column = F.from_json(F.lit(text), T.ArrayType(kind), _JSON)
        return column["o0"] if used == 1 else column

    def below(bounds: Column) -> Column:
        """How many bounds come before the row (built-in functions, as lambdas don't compile)."""
        return F.coalesce(F.array_position(F.sort_array(F.array_append(bounds, own)), own).cast("int") - 1, F.lit(0))

    width = math.isqrt(len(found)) + 1
    group = below(literal(found[width - 1::width])) * width
    return group + below(F.slice(literal(found), group + 1, F.lit(width)))


def global_index(df: DataFrame, order_cols: Sequence, index_col: str = RN,
                 num_partitions: int | None = None) -> DataFrame:
    """Add ``index_col`` = 1-based position of each row in ``order_cols``
    (names or expressions, ascending, nulls first).

    ``order_cols`` should be a total order (add a unique tie-break);
    rows that tie completely get an arbitrary relative order.

    At once, ``df`` is scanned for the number of rows, a sample of the order
    columns, and the rows in each part (:func:`part_of`). The result is a plan
    with one shuffle, by part, and nothing is persisted or written. So ``df``
    should be a table, or :func:`written`, and must give the same rows each time.
    """
    order = _order_exprs(order_cols)
    part = part_of(df, order, _num_partitions(df, num_partitions))
    # one row per part: bounded by the number of partitions, not the data
    sizes = {r[0]: r[1] for r in df.groupBy(part.alias("__pid")).count().collect()}
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    place = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    offsets = F.from_json(F.lit(str(before)), "array<bigint>")
    rows = df.withColumn("__pid", part)
    return rows.withColumn(index_col, F.get(offsets, F.col("__pid")) + place).drop("__pid")


def halo_blocks(df: DataFrame, order_cols: Sequence, halo: int, series_cols: Sequence[str] = (),
                block_rows: int = 1 << 16, ahead: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Number rows (series first, then ``order_cols``) and assign blocks.

    Adds ``_rn`` (global position), ``_blk`` and ``_home``. Rows within
    ``halo`` of the end of their block are also emitted (``_home`` false)
    into the next block, and rows within ``ahead`` of its start into the
    previous one. Window specs use
    ``Window.partitionBy(*series_cols, "_blk").orderBy("_rn")``; afterwards
    keep ``_home`` rows. Each window partition holds at most
    ``block_rows + halo + ahead`` rows whatever the skew.
    """
    b = max(int(block_rows), 4 * (int(halo) + int(ahead)) + 1)
    idx = global_index(df, [*series_cols, *order_cols], RN, num_partitions)
    zero_based = F.col(RN) - F.lit(1)
    blk = F.floor(zero_based / F.lit(b)).cast("long")
    pos = zero_based - blk * F.lit(b)
    targets = F.array(blk)
    if halo > 0:
        targets = F.when(pos >= F.lit(b - halo), F.array_append(targets, blk + 1)).otherwise(targets)
    if ahead > 0:
        targets = F.when(pos < F.lit(ahead), F.array_append(targets, blk - 1)).otherwise(targets)
    out = idx.withColumn("__home_blk", blk).withColumn(BLK, F.explode(targets))
    return out.withColumn(HOME, F.col(BLK) == F.col("__home_blk")).drop("__home_blk")


def exact_quantiles(df: DataFrame, group_cols: Sequence[str], value_col: str,
                    quantiles: Iterable[float], num_partitions: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas/numpy default).

    For a group with n non-null values sorted v_0..v_{n-1}, quantile q is
    ``v_lo + (h - lo) * (v_hi - v_lo)`` with ``h = (n-1)q``.

    Rows are first counted per (group, value) with map-side combine; the
    running totals of these counts (:func:`prefix_sums`, range partitions,
    so a hot group is split across tasks) say which value holds a rank.
    Output: group cols, ``q``, ``value``.
    """
    qs = [float(q) for q in quantiles]
    v = df.select(*group_cols, F.col(value_col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    counts = v.groupBy(*group_cols, "__v").agg(F.count(F.lit(1)).alias("__c"))
    found = count_quantiles(counts, group_cols, "__v", "__c", qs, num_partitions=num_partitions)
    return found.filter(F.col("q0").isNotNull()).select(*group_cols, F.explode(F.array(*[
        F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("value")) for i, q in enumerate(qs)])).alias("__q")
    ).select(*group_cols, "__q.q", "__q.value")


def count_quantiles(counts: DataFrame, group_cols: Sequence[str], value: str, count: str, qs: Sequence[float],
                    aggs: Sequence[Column] = (), num_partitions: int | None = None) -> DataFrame:
    """Quantiles ``q0``, ``q1``, ... of a table of (group, value, count) rows,
    one row per group, beside any other aggregates ``aggs`` of these rows.

    The table is ordered and written once; the running totals, the groups'
    totals and ``aggs`` all come from there. Rows of count 0 (such as a null
    value's) hold no rank.
    """
    runs = prefix_sums(counts.withColumns({"__v": F.col(value), "__c": F.col(count)}), [*group_cols, value], ["__c"],
                       num_partitions)
    runs = runs.withColumn("__end", F.col("cum___c")).withColumn("__start", F.col("cum___c") - F.col("__c"))
    stats = runs.groupBy(*group_cols).agg(F.min("__start").alias("__first"), F.sum("__c").alias("__n"), *aggs)
    kept = [c for c in stats.columns if c not in group_cols and c not in ("__first", "__n")]
    runs = runs.select(*group_cols, "__v", "__start", "__end")
    if group_cols:
        same = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group_cols]
        placed = runs.alias("r").join(stats.alias("s"), same).select("r.*", "__first", "__n", *kept)
    else:
        placed = attach_scalars(runs, stats)

    def at(rank: Column) -> Column:
        r = F.col("__first") + rank
        return F.max(F.when((F.col("__start") <= r) & (r < F.col("__end")), F.col("__v")))

    picked = []
    for i, q in enumerate(qs):
        h = (F.col("__n") - 1) * F.lit(q)
        picked += [at(F.floor(h)).alias(f"__lo{i}"), at(F.ceil(h)).alias(f"__hi{i}"),
                   F.max(h - F.floor(h)).alias(f"__f{i}")]
    found = placed.groupBy(*group_cols).agg(*picked, *[F.first(c).alias(c) for c in kept])
    return found.select(*group_cols, *kept, *[
        (F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias(f"q{i}")
        for i in range(len(qs))])


def exact_median(df: DataFrame, group_cols: Sequence[str], value_col: str,
                 out: str = "median", num_partitions: int | None = None) -> DataFrame:
    """Exact median per group (null-free values), one row per group with values."""
    q = exact_quantiles(df, group_cols, value_col, [0.5], num_partitions)
    return q.select(*group_cols, F.col("value").alias(out))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Distributed top-k (TakeOrderedAndProject: k rows kept per task)."""
    return df.orderBy(*order).limit(int(n))


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a one-row aggregate (global totals, means) to every row.

    The right side is a global aggregate, so it always has exactly one
    row; broadcasting it is a proven-size broadcast.
    """
    return df.join(F.broadcast(one_row), how="inner")


def prefix_sums(df: DataFrame, order_cols: Sequence, values: Sequence[str],
                num_partitions: int | None = None, inclusive: bool = True) -> DataFrame:
    """Running totals of ``values`` in ``order_cols`` order, distributed.

    Range partitions (checkpointed once, :func:`ranged`), running sums inside each partition by a window over that
    partition only, plus per-partition offsets from a table whose size is
    the partition count. Adds ``cum_<value>`` columns (``inclusive``:
    current row counted).
    """
    rows = ranged(df, order_cols, num_partitions)
    tot = rows.groupBy("__pid").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__pid", *[F.coalesce(F.sum(f"__t_{v}").over(w), F.lit(0)).alias(f"__o_{v}") for v in values])
    wp = Window.partitionBy("__pid").orderBy("__mid").rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.join(F.broadcast(offs), "__pid")
    out = out.withColumns({f"cum_{v}": F.coalesce(F.sum(v).over(wp), F.lit(0)) + F.col(f"__o_{v}") for v in values})
    return out.drop("__pid", "__mid", *[f"__o_{v}" for v in values])
