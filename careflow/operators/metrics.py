"""Exact evaluation metrics as aggregations.

Predictions stay distributed: regression metrics are sums; confusion
counts are conditional sums; ROC-AUC and average precision work on the
histogram of distinct scores (map-side combined) with distributed prefix
sums, so they are exact (no binning) at any scale.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.operators.ordering import attach_scalars, prefix_sums


def regression_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 (1 - SS_res/SS_tot), overall or per group.

    Two passes (group mean, then centred sums) keep SS_tot numerically
    stable; the mean table has one row per group.
    """
    y, p = F.col(actual).cast("double"), F.col(pred).cast("double")
    x = df.select(*by, y.alias("__y"), p.alias("__p"))
    means = (x.groupBy(*by) if by else x.groupBy()).agg(F.avg("__y").alias("__ybar"))
    x = x.join(means, list(by), "left") if by else attach_scalars(x, means)
    e = F.col("__y") - F.col("__p")
    d = F.col("__y") - F.col("__ybar")
    g = x.groupBy(*by) if by else x.groupBy()
    s = g.agg(F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
              F.sum(e * e).alias("__ssr"), F.sum(d * d).alias("__sst"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("R2", F.lit(1.0) - F.col("__ssr") / F.col("__sst")).drop("__ssr", "__sst")


def fold_summary(per_fold: DataFrame, metrics: Sequence[str] = ("MAE", "RMSE", "R2")) -> DataFrame:
    """Mean and sample std of each metric over folds."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"cv_{m}_mean"), F.stddev_samp(m).alias(f"cv_{m}_std")]
    return per_fold.agg(F.count(F.lit(1)).alias("cv_folds"), *aggs)


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy at ``score >= threshold``."""
    y = F.col(label).cast("int")
    yhat = (F.col(score) >= F.lit(float(threshold))).cast("int")
    c = df.agg(F.sum(((y == 0) & (yhat == 0)).cast("long")).alias("tn"),
               F.sum(((y == 0) & (yhat == 1)).cast("long")).alias("fp"),
               F.sum(((y == 1) & (yhat == 0)).cast("long")).alias("fn"),
               F.sum(((y == 1) & (yhat == 1)).cast("long")).alias("tp"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return c.select("tn", "fp", "fn", "tp", prec.alias("precision"), rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1_score"),
                    ((tp + tn) / (tp + tn + fp + fn)).alias("accuracy"))


def class_report(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Per-class precision, recall, F1 and support, plus macro and
    weighted averages (rows ``macro avg`` / ``weighted avg``)."""
    y = F.col(label).cast("int")
    yhat = (F.col(score) >= F.lit(float(threshold))).cast("int")
    cm = df.groupBy(y.alias("y"), yhat.alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    per = cm.groupBy().agg(*[
        F.sum(F.when((F.col("y") == c) & (F.col("yhat") == c), F.col("n")).otherwise(0)).alias(f"tp{c}") for c in (0, 1)
    ], *[F.sum(F.when(F.col("yhat") == c, F.col("n")).otherwise(0)).alias(f"pp{c}") for c in (0, 1)],
        *[F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"s{c}") for c in (0, 1)])
    rows = []
    for c in (0, 1):
        p = F.when(F.col(f"pp{c}") > 0, F.col(f"tp{c}") / F.col(f"pp{c}")).otherwise(F.lit(0.0))
        r = F.when(F.col(f"s{c}") > 0, F.col(f"tp{c}") / F.col(f"s{c}")).otherwise(F.lit(0.0))
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
        rows.append(F.struct(F.lit(str(c)).alias("class"), p.alias("precision"), r.alias("recall"),
                             f.alias("f1_score"), F.col(f"s{c}").cast("long").alias("support")))
    x = per.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    tot = x.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                F.avg("f1_score").alias("f1_score"), F.sum("support").alias("support"))
    wt = x.agg(F.lit("weighted avg").alias("class"),
               *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in ("precision", "recall", "f1_score")],
               F.sum("support").alias("support"))
    return x.unionByName(tot).unionByName(wt)


def _score_histogram(df: DataFrame, label: str, score: str) -> DataFrame:
    y = F.col(label).cast("long")
    return df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney with tied scores counted half).

    AUC = sum_s pos(s) * (neg below s + neg(s)/2) / (P * N), over the
    distinct scores; the "below" counts are distributed prefix sums.
    """
    hist = _score_histogram(df, label, score)
    cum = prefix_sums(hist, ["s"], ["neg"], inclusive=False)
    return cum.agg((F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") * 0.5))
                    / (F.sum("pos").cast("double") * F.sum("neg"))).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision as the step sum sum_i (R_i - R_{i-1}) P_i over
    thresholds at each distinct score (highest first); not trapezoidal."""
    hist = _score_histogram(df, label, score).withColumn("__neg_s", -F.col("s"))
    cum = prefix_sums(hist, ["__neg_s"], ["pos", "neg"], inclusive=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return cum.agg((F.sum(F.col("pos") * prec) / F.sum("pos")).alias("pr_auc"))


def grouped_binary_metrics(df: DataFrame, by: Sequence[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """M15-M17 of many groups (trials, models) at once: exact ROC-AUC, average
    precision and the metrics at ``score >= threshold`` of each.

    Scores are reduced to (group, score) counts; one distributed prefix sum
    over all groups gives the counts below each score. Groups without both
    classes have null areas.
    """
    y = F.col(label).cast("long")
    hist = df.groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"))
    cum = prefix_sums(hist, [*by, "s"], ["pos", "neg"], inclusive=False)
    # a group's first score has the totals of the groups before it
    ends = cum.groupBy(*by).agg(F.min("cum_pos").alias("__p0"), F.min("cum_neg").alias("__n0"),
                                F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"e.{g}")) for g in by]
    x = cum.alias("c").join(ends.alias("e"), same).select("c.*", "__p0", "__n0", "P", "N")
    below = F.col("cum_neg") - F.col("__n0")
    tp, fp = F.col("P") - (F.col("cum_pos") - F.col("__p0")), F.col("N") - below
    high = F.col("s") >= F.lit(float(threshold))
    g = x.groupBy(*by).agg(
        F.sum(F.col("pos") * (below + F.col("neg") * 0.5)).alias("__a"), F.sum(F.col("pos") * (tp / (tp + fp))).alias("__ap"),
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(F.when(high, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(high, F.col("neg")).otherwise(0)).alias("fp"))
    g = g.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    t = {c: F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")}
    prec = F.when(t["tp"] + t["fp"] > 0, t["tp"] / (t["tp"] + t["fp"])).otherwise(F.lit(0.0))
    rec = F.when(t["tp"] + t["fn"] > 0, t["tp"] / (t["tp"] + t["fn"])).otherwise(F.lit(0.0))
    return g.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                F.col("__a") / (F.col("P").cast("double") * F.col("N"))).alias("roc_auc"),
                    F.when(F.col("P") > 0, F.col("__ap") / F.col("P")).alias("pr_auc"), prec.alias("precision"),
                    rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1_score"),
                    ((t["tp"] + t["tn"]) / (F.col("P") + F.col("N"))).alias("accuracy"), "tn", "fp", "fn", "tp")


def evaluation_document(binary: DataFrame, auc: DataFrame, ap: DataFrame, sizes: DataFrame,
                        params: dict | None = None, threshold: float = 0.5) -> DataFrame:
    """One row with metrics, confusion matrix, sizes and parameters
    as structs (written with :func:`careflow.sources.io.write_json`)."""
    one = attach_scalars(attach_scalars(attach_scalars(binary, auc), ap), sizes)
    p = params or {}
    return one.select(
        F.struct("roc_auc", "pr_auc", "precision", "recall", "f1_score", "accuracy").alias("metrics"),
        F.struct("tn", "fp", "fn", "tp").alias("confusion_matrix"),
        F.struct(*[F.col(c) for c in sizes.columns], F.lit(float(threshold)).alias("threshold")).alias("training_info"),
        F.struct(*[F.lit(v).alias(k) for k, v in p.items()] or [F.lit(None).cast("string").alias("none")]).alias("best_params"))
