"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.session import checkpoint_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared checkpoint folder.

    Lineage ends there, so a lost executor costs no recomputation, and every
    later reader sees the same rows.
    """
    tidy(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets go of files that nothing refers to any more.

    Files of finished shuffles and old checkpoints go when the driver's JVM
    collects its garbage, which between two steps of a long query it is asked to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def tokenizer(path: str):
    """The tokenizer of a file, loaded once for each Python worker."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``size`` bytes in a column, one row at least.

    After the last one the worker gives free memory back, as it lives on
    beside the JVM and the workers of other stages.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            done = ends[a - 1] if a else 0
            b = max(int(np.searchsorted(ends, done + size, "right")), a + 1)
            yield batch.slice(a, b - a)
            a = b
    give_back()


def give_back() -> None:
    """Returns what the allocators hold free to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and each row's start (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the splitmix generator, by element."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def edge_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges.

    Alternates large-star and small-star steps until nothing changes, so the
    number of rounds grows with the logarithm of a component's size. A hub is
    only ever aggregated with a map-side combine, never gathered.
    """
    now = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
              .where("u < v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if large:
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return (both.where("v > u").join(low, "u")
                    .select(F.col("m").alias("u"), "v").where("u < v").distinct())
        down = both.where("v < u")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = (down.join(low, "u").where("v <> m")
                 .select(F.col("m").alias("u"), "v"))
        kept = low.select(F.col("m").alias("u"), F.col("u").alias("v"))
        return moved.unionByName(kept).where("u < v").distinct()

    digest = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(digest).first()
    for _ in range(rounds):
        now = cut(star(star(now, True), False))
        after = now.agg(digest).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return (now.select(F.col("v").alias("node"), F.col("u").alias("component"))
            .unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")))
            .distinct())
