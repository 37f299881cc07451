"""Train/test splits and time-series folds (M2-M4).

The stratified split selects each class's cut among its hashes; the others
number rows in a global order with
:func:`careflow.operators.ordering.global_index` (parts of the order and the
counts before each), so no class or fold is ranked inside one task.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.operators.ordering import attach_scalars, global_index, written
from careflow.session import checkpoint_dir

#: First bits of the hashes that a class's histogram is over.
BUCKET_BITS = 16


def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str], test_fraction: float = 0.2,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """M2: exact stratified split. Within each class rows are ordered by
    ``xxhash64(id, seed)``, and the first ``round(test_fraction * n_class)``
    are test rows: per-class sizes are exact and the split is reproducible
    for any partitioning.

    The last test row's hash is selected, not sorted for: a histogram of each
    class over the hashes' first bits says which bucket it is in, and the
    counts of that bucket's hashes which hash it is. Only rows that tie on it
    while some of them are test rows and some not (rows with equal ids) are
    numbered.
    """
    h = F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed))
    hashed = df.select(F.col(label).alias("__label"), h.alias("__h"))
    bucket = F.shiftright("__h", 64 - BUCKET_BITS)
    below = Window.partitionBy("__label").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)

    def reached(counts: DataFrame, wanted: Column) -> DataFrame:
        """The place in each class where the running count reaches what is wanted."""
        x = counts.withColumn("__below", F.coalesce(F.sum("__c").over(below), F.lit(0))).withColumn("__k", wanted)
        return x.where((F.col("__below") < F.col("__k")) & (F.col("__k") <= F.col("__below") + F.col("__c"))).select(
            "__label", "__at", (F.col("__k") - F.col("__below")).alias("__need"), F.col("__c").alias("__size"))

    hist = hashed.groupBy("__label", bucket.alias("__at")).agg(F.count(F.lit(1)).alias("__c"))
    total = F.sum("__c").over(Window.partitionBy("__label"))
    first = reached(hist, F.round(total * F.lit(float(test_fraction)))).select(
        "__label", F.col("__at").alias("__b"), F.col("__need").alias("__want"))
    inner = hashed.alias("x").join(first.alias("f"), F.col("x.__label").eqNullSafe(F.col("f.__label"))
                                   & (F.shiftright("x.__h", 64 - BUCKET_BITS) == F.col("f.__b")))
    inner = inner.groupBy(F.col("x.__label").alias("__label"), F.col("__h").alias("__at")).agg(
        F.count(F.lit(1)).alias("__c"), F.first("__want").alias("__want"))
    checkpoint_dir(df.sparkSession)
    edge = reached(inner, F.col("__want")).checkpoint(eager=True)  # one row for each class
    x = df.withColumn("__h", h).alias("x").join(edge.alias("e"), F.col(f"x.{label}").eqNullSafe(F.col("e.__label")), "left")
    x = x.select("x.*", "__at", "__need", "__size")
    clear = x.withColumn(out, F.coalesce(F.col("__h") <= F.col("__at"), F.lit(False)))
    if edge.where("__need < __size").isEmpty():
        return clear.drop("__h", "__at", "__need", "__size")
    tied = (F.col("__h") == F.col("__at")) & (F.col("__need") < F.col("__size"))
    tied = F.coalesce(tied, F.lit(False))
    split = global_index(written(x.where(tied)), [label, "__h", *id_cols], "__r")
    start = split.groupBy(label).agg(F.min("__r").alias("__first"))
    split = split.alias("x").join(start.alias("s"), F.col(f"x.{label}").eqNullSafe(F.col(f"s.{label}"))).select("x.*", "__first")
    split = split.withColumn(out, F.col("__r") - F.col("__first") < F.col("__need")).drop("__r", "__first")
    return clear.where(~tied).unionByName(split).drop("__h", "__at", "__need", "__size")


def stratified_split_by_hash(df: DataFrame, label: str, id_cols: Sequence[str], test_fraction: float = 0.2,
                             seed: int = 42, out: str = "is_test") -> DataFrame:
    """M2 (large-data option): test when the hash falls below the fraction;
    no sort, sizes approximate."""
    u = (F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed)).cast("decimal(20,0)") + F.lit(2 ** 63)) / F.lit(2 ** 64)
    return df.withColumn(out, u < F.lit(test_fraction))


def chronological_split(df: DataFrame, order: Sequence[str], train_fraction: float = 0.8,
                        out: str = "is_train") -> DataFrame:
    """M3: the first ``int(n * train_fraction)`` rows in time order train."""
    idx = global_index(df, order, "__r")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    x = attach_scalars(idx, n)
    return x.withColumn(out, F.col("__r") <= F.floor(F.col("__n") * F.lit(train_fraction))).drop("__r", "__n")


def expanding_folds(df: DataFrame, order: Sequence[str], k: int = 5, out: str = "fold",
                    position: str = "position") -> DataFrame:
    """M4: expanding-window folds (as time-series cross-validation):
    fold size ``n // (k+1)``; the last ``k`` blocks are validation folds
    1..k; rows before them are fold 0. Fold f trains on positions before
    its block (see :func:`fold_frames`)."""
    idx = global_index(df, order, "__r")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    x = attach_scalars(idx, n)
    size = F.floor(F.col("__n") / (k + 1))
    start = F.col("__n") - size * k
    p = F.col("__r") - 1
    fold = F.when(p >= start, F.floor((p - start) / size) + 1).otherwise(F.lit(0)).cast("int")
    return (x.withColumn(position, p).withColumn(out, fold)
             .withColumn("fold_size", size.cast("long")).drop("__r", "__n"))


def fold_frames(folded: DataFrame, fold: int, out: str = "fold", position: str = "position"):
    """(train, validation) DataFrames of one expanding fold."""
    val = folded.filter(F.col(out) == fold)
    first = val.agg(F.min(position).alias("__start"))
    train = attach_scalars(folded, first).filter(F.col(position) < F.col("__start")).drop("__start")
    return train, val
