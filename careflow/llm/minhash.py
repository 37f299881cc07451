"""Near-duplicate documents by circulant MinHash.

Two permutations give every signature coordinate: the first scatters the
shingles over a universe of places, the second, shifted circularly by one
place more for each coordinate, is minimised over them. Bands of coordinates
make candidate buckets; every link is confirmed on full shingle sets.

Texts with equal shingle sets are one class, of which only the smallest
document goes on. In a bucket each member is first compared with the smallest
one only. Members that this leaves in different components are then compared
across components, behind an exact filter on their rarest shingles, so no
candidate link is lost while a group of copies costs a comparison for each
member and not for each pair.
Candidates themselves are probabilistic: with 50 bands of 5 rows a pair at a
similarity of 0.75 is missed with a probability of about 1e-6, and less above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import cut, edge_components, mix64, slices
from careflow.llm.shingles import WORDS, shingle_sets

BANDS, ROWS = 50, 5
UNIVERSE_BITS = 20
#: A shingle set of more than one of SHARE rows is joined by broadcast (fewer than SHARE sets).
SHARE = 1000


@lru_cache(maxsize=2)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and every circular shift of the second as a view."""
    size = 1 << UNIVERSE_BITS
    scatter = np.random.default_rng(1).permutation(size).astype(np.int32)
    ranks = np.random.default_rng(2).permutation(size).astype(np.int32)
    wrapped = np.concatenate([ranks, ranks[:coordinates - 1]])
    return scatter, np.lib.stride_tricks.sliding_window_view(wrapped, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least rank at k places after the scattered shingles."""
    scatter, shifted = permutations(coordinates)
    places = scatter[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    out = shifted[places[:2048]].min(axis=0)
    for a in range(2048, len(places), 2048):
        np.minimum(out, shifted[places[a:a + 2048]].min(axis=0), out=out)
    return out


def features(docs: DataFrame, key: str, text: str, bands: int, rows: int, words: int) -> DataFrame:
    """(key, n_shingles, set_key, bands): set_key names the shingle set, bands its buckets."""
    kind = docs.schema[key].dataType.simpleString()
    weights = mix64(np.arange(rows, dtype=np.uint64)) | np.uint64(1)
    salt = mix64(np.arange(bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            names, out = [], []
            for s in sets:
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    with np.errstate(over="ignore"):
                        sig = signature(s, bands * rows).astype(np.uint64).reshape(bands, rows)
                        out.append(mix64((sig * weights).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                else:
                    out.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out) if out else [], pa.int64()))],
                names=[key, "n_shingles", "set_key", "bands"])

    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_shingles long, set_key binary, bands array<long>")


def sets_of(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(node, shingles) with the sorted full set of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            sets = shingle_sets(part.column(1), words)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))],
                names=["node", "shingles"])

    return docs.select(key, text).mapInArrow(run, f"node {kind}, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, words: int,
              num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have den * intersection >= num * union."""
    ids = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    sets = sets_of(docs.select(key, text).join(ids, key, "left_semi"), key, text, words)
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(a, "a").join(b, "b").withColumn("common", common)
            .where(den * F.col("common") >= num * (F.size("sa") + F.size("sb") - F.col("common")))
            .select("a", "b"))


def between_components(nodes: DataFrame, docs: DataFrame, key: str, text: str, words: int,
                       num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that may be linked.

    An exact filter: in an order of shingles common to all, sets similar enough
    share one of their first few shingles, at places that leave room for the
    overlap needed. Shingles of a single component come first in that order
    (they can't link two), then the rarer before the more frequent, so that
    the edits that keep copies apart fill their first places.
    """
    sets = sets_of(docs.select(key, text).join(nodes.select(F.col("node").alias(key)), key, "left_semi"),
                   key, text, words)
    # repeated rows only make the filter wider
    shingles = sets.select("node", F.explode("shingles").alias("shingle")).join(nodes, "node")
    shared = (shingles.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                              F.count("*").alias("df")).where("lo < hi").select("shingle", "df"))
    own = Window.partitionBy("node")
    first = (shingles.join(shared, "shingle")
             .withColumn("place", F.col("n") - F.count("*").over(own)
                         + F.row_number().over(own.orderBy("df", "shingle")))
             .where(den * (F.col("n") - F.col("place") + 1) >= num * F.col("n"))
             .withColumn("room", F.col("n") - F.col("place") + 1)
             .select("shingle", "node", "n", "component", "room"))
    first = cut(first)
    one, two = first.alias("x"), first.alias("y")
    overlap = F.least("x.room", "y.room")
    return (one.join(two, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component"))
                     & ((num + den) * overlap >= num * (F.col("x.n") + F.col("y.n")))
                     & (den * F.least("x.n", "y.n") >= num * F.greatest("x.n", "y.n")))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the component_id of their set_key; none for those without a set.

    Sets of more than a thousandth of the rows are fewer than a thousand, so
    they are broadcast; only the others' rows are dealt out by set_key, and no
    task gets more than such a share at once.
    """
    rows_in_sets = label.agg(F.sum("copies")).first()[0] or 0
    hot = label.where(F.col("copies") * SHARE > rows_in_sets).drop("copies")
    placed = rows.join(F.broadcast(hot), "set_key", "left")
    waits = F.col("set_key").isNotNull() & F.col("component_id").isNull()
    rest = placed.where(waits).drop("component_id").join(label.drop("copies"), "set_key")
    return placed.where(~waits).unionByName(rest)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: tuple[int, int] = (75, 100),
                    words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    ``similarity`` is a fraction (num, den) of shared to all shingles.
    component_id is the smallest key reachable over links, its own included;
    kept says whether it is the row's own. A null or empty text has no
    shingles and no link. Rows with one key count as one document and are all
    returned; rows with a null key are classed by no component (null, null).
    Other columns are not read; an empty table gives an empty result.
    """
    num, den = similarity
    keyed = docs.where(F.col(key).isNotNull())
    rows_of = cut(features(keyed, key, text, bands, rows, words))
    classes = (rows_of.where("set_key is not null").groupBy("set_key")
               .agg(F.min(key).alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
                    F.count("*").alias("copies")))
    classes = cut(classes)
    sizes = classes.groupBy("node").agg(F.max("n").alias("n"))
    # a bucket's name is salted with its band
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    members = cut(buckets.join(shared.where("first < last").drop("last"), "bucket")
                  .where("node <> first").join(sizes, "node"))

    def sized(pairs: DataFrame) -> DataFrame:
        """Without the pairs whose set sizes alone rule a link out."""
        return (pairs.where(den * F.least("na", "nb") >= num * F.greatest("na", "nb"))
                .select("a", "b").distinct())

    stars = sized(members.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("first").alias("b"))
                  .distinct().join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b"))
    # a key that stands in several classes ties them together
    own = rows_of.where("set_key is not null").select(key, "set_key")
    several = own.groupBy(key).agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi")
    tied = own.join(several.select(key), key).join(classes.select("set_key", F.col("node").alias("_node")), "set_key")
    least = tied.groupBy(key).agg(F.min("_node").alias("a"))
    repeated = tied.join(least, key).where("_node <> a").select("a", F.col("_node").alias("b")).distinct()
    edges = cut(confirmed(stars, keyed, key, text, words, num, den).unionByName(repeated))
    found = edge_components(edges)
    # every member has been held against its bucket's first: only the others are left
    placed = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    left = placed.join(mixed.where("lo < hi"), "bucket").select("node", "n", "component").distinct()
    more = between_components(cut(left), keyed, key, text, words, num, den)
    edges = edges.unionByName(confirmed(more, keyed, key, text, words, num, den))
    found = edge_components(edges)
    label = classes.join(found, "node", "left").select(
        "set_key", "copies", F.coalesce("component", "node").alias("component_id"))
    out = labelled(rows_of.select(key, "n_shingles", "set_key"), label)
    out = out.select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))
    lost = features(docs.where(F.col(key).isNull()), key, text, bands, rows, words).select(
        key, "n_shingles", F.lit(None).cast(docs.schema[key].dataType).alias("component_id"))
    return out.unionByName(lost).withColumn("kept", F.col(key) == F.col("component_id"))
