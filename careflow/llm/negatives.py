"""Hard negatives by threshold joins over an inverted index with norm bounds.

Every block of rows holds an inverted index: for each dimension the rows'
values in it. A row leaves out its last dimensions from where the norm of the
rest, times any anchor's, stays under the threshold: alone they can't reach
it. An anchor walks the dimensions, adds up partial scores over the postings,
and drops a row as soon as its partial score plus the product of the norms of
what remains falls under the threshold. Scores of survivors are completed from
whole vectors. Thresholds start high and are lowered, only for anchors whose
windows are not full, until each window is full or its lower end is reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.llm.common import cut

BLOCK_ROWS = 16_384
TURN_ANCHORS = 2_048
#: Thresholds tried in turn before a window's own lower end: shares of the
#: largest possible score for positives, of the positive's score for negatives.
POSITIVE_STEPS = (0.5, 0.3)
NEGATIVE_STEPS = (0.9,)
#: Dimensions between two prunings.
STRIDE = 8
#: Scores stay exact in double precision under this.
EXACT = 2.0 ** 53


def rest_norms(rows: np.ndarray) -> np.ndarray:
    """Norm of each row's components from every dimension on (dimensions + 1 columns)."""
    out = np.zeros((len(rows), rows.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum((rows * rows)[:, ::-1], axis=1)[:, ::-1])
    return out * (1 + 1e-12)


class Postings:
    """Inverted index of a block for pairs whose score over the anchor's norm is ``floor`` at least."""

    def __init__(self, rows: np.ndarray, floor: float):
        rest = rest_norms(rows)
        held = (rest[:, :-1] >= floor).sum(axis=1)
        #: rows with the most postings first, so that a dimension's postings are a prefix
        self.order = np.argsort(-held, kind="stable")
        self.rows, held = rows[self.order], held[self.order]
        self.held = held
        self.columns = np.ascontiguousarray(self.rows.T)
        self.lengths = np.searchsorted(-held, -np.arange(rows.shape[1]), "left")
        self.rest = np.ascontiguousarray(rest[self.order].T)

    def above(self, anchor: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of every row that scores at least ``least``."""
        own = rest_norms(anchor[None])[0]
        live = np.arange(self.lengths[0] if len(self.lengths) else 0)
        partial = np.zeros(len(live))
        for start in range(0, len(anchor), STRIDE):
            for k in range(start, min(start + STRIDE, len(anchor))):
                n = int(np.searchsorted(live, self.lengths[k]))
                if n:
                    partial[:n] += anchor[k] * self.columns[k][live[:n]]
            # what a row has not yet added: from here on, or from where its postings end
            seen = np.minimum(self.held[live], min(start + STRIDE, len(anchor)))
            keep = partial + own[seen] * self.rest[seen, live] * (1 + 1e-9) + 1e-6 >= least
            live, partial = live[keep], partial[keep]
        score = self.rows[live] @ anchor
        good = score >= least
        return self.order[live[good]], score[good]


def best_in_window(ids: np.ndarray, scores: np.ndarray, low: float, high: float, k: int) -> np.ndarray:
    """Places of the k highest scores between two bounds, ties to smaller ids."""
    at = np.flatnonzero((scores >= low) & (scores <= high))
    if len(at) > 4 * k:  # only what ties with the k-th best or beats it is sorted
        at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


class Rows:
    """The table in blocks, and threshold joins of anchors against it."""

    def __init__(self, points: DataFrame):
        self.spark = points.sparkSession
        n, self.dim, self.reach = points.agg(
            F.count("*"), F.max(F.size("v")),
            F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
        self.blocks = -(-n // BLOCK_ROWS)
        if n and self.reach * self.reach >= EXACT:
            raise ValueError(f"components are too large for exact scores: norms must stay under {math.sqrt(EXACT):.0f}")
        points = points.where(F.size("v") == F.lit(self.dim))
        mass = {r["k"]: r["mass"] for r in points.select("v").mapInPandas(_mass, "k int, mass double")
                .groupBy("k").agg(F.sum("mass").alias("mass")).collect()}
        #: the heaviest dimensions come first, so that rests are light
        self.axes = sorted(mass, key=lambda k: (-mass[k], k))
        self.points = cut(points.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(self.blocks, 1))).cast("int")))

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """Best k rows (anchor, w, id, score) of every window.

        ``asked`` has (anchor, a, label, same, least, windows): rows of the
        anchor's label or of others, scores of at least ``least``, windows as
        array<struct<w, low, high>>.
        """
        axes = self.axes

        def one(points: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(points) and len(asking):
                rows = np.vstack(points["v"])[:, axes]
                ids, labels = points["id"].to_numpy(), points["label"].to_numpy()
                anchors = np.vstack(asking["a"])[:, axes]
                norms = np.sqrt((anchors * anchors).sum(axis=1))
                least = asking["least"].to_numpy()
                with np.errstate(divide="ignore", invalid="ignore"):
                    floors = np.where((norms > 0) & (least > 0), least / norms * (1 - 1e-9), 0.0)
                index = Postings(rows, float(floors.min()))
                for n, (own, label, same, windows) in enumerate(
                        zip(asking["anchor"], asking["label"], asking["same"], asking["windows"])):
                    at, scores = index.above(anchors[n], least[n])
                    fit = ((labels[at] == label) == same) & (ids[at] != own)
                    at, scores = at[fit], scores[fit]
                    for w in windows:
                        for i in best_in_window(ids[at], scores, w["low"], w["high"], k):
                            out.append((own, w["w"], int(ids[at[i]]), int(scores[i])))
            return pd.DataFrame(out, columns=["anchor", "w", "id", "score"])

        # so many anchors meet a block at once that a group stays within bounds
        asked = cut(asked)
        turns = -(-asked.count() // TURN_ANCHORS)
        blocks = F.sequence(F.lit(0), F.lit(max(self.blocks - 1, 0)))
        asking = (asked.withColumn("turn", F.pmod(F.xxhash64("anchor"), F.lit(max(turns, 1))).cast("int"))
                  .withColumn("block", F.explode(blocks)))
        held = self.points.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max(turns - 1, 0)))))
        found = (held.groupBy("block", "turn").cogroup(asking.groupBy("block", "turn"))
                 .applyInPandas(one, "anchor long, w long, id long, score long"))
        best = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def fill(self, anchors: DataFrame, windows: DataFrame, same: bool, k: int, steps: tuple[float, ...]) -> DataFrame:
        """(anchor, w, rank, id, score): the best k of every window (anchor, w, low, high, scale).

        The threshold is ``scale`` times each step in turn, at last ``low``;
        a window leaves once it is full or the threshold is at its lower end.
        """
        out, todo = [], windows
        for n, step in enumerate([*steps, None]):
            aim = F.col("low") if step is None else F.greatest("low", F.lit(step) * F.col("scale"))
            asked = (todo.groupBy("anchor").agg(F.min(aim).alias("least"),
                                                F.collect_list(F.struct("w", "low", "high")).alias("windows"))
                     .join(anchors, "anchor").withColumn("same", F.lit(same)))
            found = cut(self.search(asked, k))
            out.append(found)
            if step is None:
                break
            full = found.groupBy("anchor", "w").agg(F.count("*").alias("n")).where(F.col("n") >= k)
            least = todo.groupBy("anchor").agg(F.min(aim).alias("least"))
            ended = todo.join(least, "anchor").where("least <= low").select("anchor", "w")
            todo = cut(todo.join(full.select("anchor", "w").union(ended).distinct(), ["anchor", "w"], "left_anti"))
            if todo.isEmpty():
                break
        # a later round's rows hold an earlier one's of the same window
        tagged = [d.withColumn("round", F.lit(n)) for n, d in enumerate(out)]
        every = tagged[0]
        for d in tagged[1:]:
            every = every.unionByName(d)
        last = Window.partitionBy("anchor", "w")
        return (every.withColumn("last", F.max("round").over(last)).where("round = last")
                .select("anchor", "w", "rank", "id", "score"))


def _mass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for f in frames:
        if len(f):
            v = np.vstack(f["v"])
            total = (v * v).sum(axis=0) + (0 if total is None else total)
    if total is not None:
        yield pd.DataFrame({"k": np.arange(len(total), dtype=np.int32), "mass": total})


def usable(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(id, label, v): one row for each key whose row has a label and a finite vector."""
    v = F.col("v")
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
            .groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.label", "r.v"))


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", label: str = "label",
                   vector: str = "embedding", positives: int = 5, negatives: int = 5, least: int = 80,
                   most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors hold whole numbers; a score is the inner product with the anchor,
    higher first, ties to the smaller key. ``anchor`` is a condition on the
    column ``id``. An anchor's positives are its best other rows of the same
    label; for each of them the best rows of other labels come back whose
    score lies between ``least`` and ``most`` percent of the positive's.
    Fewer rows than asked for give all there are.

    Rows take no part if their key, label or vector is null, if the vector is
    empty, holds a null or non-finite component or is of another dimension
    than the largest. Of rows that repeat a key, the least vector, then label,
    stands for it. Equal vectors under different keys are different rows.
    Other columns are not read; an empty table gives an empty result. Scores
    must stay under 2^53; larger components raise an error.
    """
    points = cut(usable(rows, key, label, vector))
    table = Rows(points)
    anchors = cut(table.points.where(anchor).select(F.col("id").alias("anchor"), F.col("v").alias("a"), "label"))
    norm = F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))
    every = anchors.select("anchor", F.lit(0).cast("long").alias("w"), F.lit(-math.inf).alias("low"),
                           F.lit(math.inf).alias("high"), (norm * F.lit(float(table.reach or 0))).alias("scale"))
    pairs = cut(table.fill(anchors, every, True, positives, POSITIVE_STEPS)
                .select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("w")))

    def whole(percent: int, up: bool) -> Column:
        x = F.col("w") * F.lit(percent)
        down = F.expr(f"(w * {percent} - pmod(w * {percent}, 100)) div 100")
        return (down + (F.pmod(x, F.lit(100)) > 0).cast("long") if up else down).cast("double")

    windows = (pairs.select("anchor", "w").distinct()
               .select("anchor", "w", whole(least, True).alias("low"), whole(most, False).alias("high"),
                       F.col("w").cast("double").alias("scale")).where("low <= high"))
    found = table.fill(anchors, windows, False, negatives, NEGATIVE_STEPS)
    return (pairs.join(found, ["anchor", "w"])
            .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"),
                    F.col("w").alias("positive_score"), F.col("score").alias("negative_score")))


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth embedding, in 256ths, with every seventh label off by one."""
    old = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (old + 1) % 10).otherwise(old)
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(256.0)))
    finite = ~F.exists(F.col("embedding").cast("array<double>"),
                       lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(finite).select("vec_id", label.alias("label"), vector.alias("embedding"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS other, v.label = a.label AS same,
         CAST(list_dot_product(a.v, v.v) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 5
"""
