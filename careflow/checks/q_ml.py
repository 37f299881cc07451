"""Checked queries: feature prep, splits, metrics and models (P20, P24, C8, M1-M21,
C10, T5, T6, K6, S2, S4-S7, S9).

Scores of boosted trees have no SQL restatement. Where a query emits rows of
predictions, its oracle states what must hold of them (which rows, which fold,
loaded equals fitted); the recursive forecast and the linear baseline are
restated whole for a planted and a one-feature model. The searches (M9, M12, C10)
are the reference's: its grid of 48 combinations over 5 folds, its 30 trials of 50
to 300 trees. Checks of a single fit use a few small trees.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from careflow.checks import sqlkit as S
from careflow.checks.q_agg import MASTER_CTES, hours, master
from careflow.checks.q_clean import RAW, appts, base
from careflow.checks.q_kpi import PROB_SQL, scored
from careflow.checks.q_ts import FEATURES_SQL
from careflow.checks.registry import ORACLE, query
from careflow.operators import features as FE
from careflow.operators import forecast as FO
from careflow.operators import metrics as ME
from careflow.operators import models as MO
from careflow.operators import projection as PR
from careflow.operators import ranking as RK
from careflow.operators import search as MS
from careflow.operators import split as SP
from careflow.operators import timeseries as TS
from careflow.operators.ordering import global_index, written
from careflow.plans import modelling as MD
from careflow.session import checkpoint_dir
from careflow.sources import io as IO

BASE = f"{RAW}, {S.NO_SHOW_BASE}"
Y = "pacientes_llegando"


def scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/careflow-out/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- P20, P24, C8, M1

KEEP = [c for c in ["area", "med", "esp", "tpo_cita", "conflicto", "agregada", "ultimahora", "buffer", "duration_min",
                    "appointment_hour", "appointment_day_of_week", "appointment_day", "appointment_month",
                    "appointment_is_weekend", "lead_time_days", "p_sexo", "m_ciu", "m_col", "m_cp", "m_edo", "m_pai",
                    "no_show"]]


@query("p20_drop_columns", S.wrap(f"WITH {BASE} SELECT {', '.join(KEEP)} FROM base", ["duration_min", "lead_time_days"]))
def p20_drop_columns(spark, sf):
    """P20: leakage/redundant columns dropped (absent ones ignored)."""
    return PR.drop_if_present(base(spark, sf), FE.DROP_COLUMNS + ["not_there"])


@query("p24_rare_mask", f"""WITH {BASE}, c AS (SELECT med, count(*) AS n FROM base GROUP BY med)
SELECT CASE WHEN c.n = 1 THEN 'OTHERS' ELSE b.med END AS med, b.no_show FROM base b JOIN c ON b.med IS NOT DISTINCT FROM c.med""")
def p24_rare_mask(spark, sf):
    """Doctors seen once -> OTHERS."""
    return PR.mask_rare(base(spark, sf).select("med", "no_show"), "med", "OTHERS")


def _code_sql(c: str, pad: int, rep: dict | None) -> str:
    s = f"regexp_replace({S.trim_u(f'coalesce(CAST({c} AS VARCHAR), {chr(39)}<NA>{chr(39)})')}, '\\.0$', '')"
    if rep:
        s = "CASE " + " ".join(f"WHEN {s} = '{k}' THEN '{v}'" for k, v in rep.items()) + f" ELSE {s} END"
    return f"(CASE WHEN {s} <> 'UNKNOWN' AND length({s}) < {pad} THEN lpad({s}, {pad}, '0') ELSE {s} END)"


C8_CODES = ", ".join(f"{_code_sql(c, pad, rep)} AS {c}" for c, (pad, _, rep) in FE.CODE_RULES.items())
C8_MASKED = ", ".join(
    f"CASE WHEN count(*) OVER (PARTITION BY {c}) = 1 THEN '{mask}' ELSE {c} END AS {c}"
    for c, (_, mask, _) in FE.CODE_RULES.items())
CYC_COLS = [f"{c}_{f}" for c in FE.CYCLICAL for f in ("sin", "cos")]
C8_SQL = f"""WITH {BASE},
f1 AS (SELECT area, esp, buffer, tpo_cita, p_sexo, duration_min, lead_time_days, appointment_is_weekend, no_show,
         CASE WHEN conflicto = 'C' THEN 1 ELSE 0 END AS conflicto, CASE WHEN agregada = 'A' THEN 1 ELSE 0 END AS agregada,
         CASE WHEN ultimahora = 'U' THEN 1 ELSE 0 END AS ultimahora,
         {", ".join(f"sin(2 * pi() * {c} / {float(p)}) AS {c}_sin, cos(2 * pi() * {c} / {float(p)}) AS {c}_cos"
                    for c, p in FE.CYCLICAL.items())},
         {C8_CODES} FROM base)
SELECT * EXCLUDE ({", ".join(FE.CODE_RULES)}), {C8_MASKED} FROM f1"""


@query("c8_no_show_features", S.wrap(C8_SQL, ["duration_min", "lead_time_days"] + CYC_COLS))
def c8_no_show_features(spark, sf):
    """Drop, flags, cyclical encodings, code cleaning and rare masking."""
    return MD.no_show_features(base(spark, sf))


ONE_HOT_LEVELS = ["tpo_cita", "p_sexo", "area"]


@query("m1_one_hot", f"""WITH {BASE} SELECT no_show, {", ".join(
    [f"CASE WHEN tpo_cita = '{v}' THEN 1 ELSE 0 END AS tpo_cita_{v}" for v in ['S']]
    + [f"CASE WHEN p_sexo = '{v}' THEN 1 ELSE 0 END AS p_sexo_{v}" for v in ['F', 'M', 'UNKNOWN']]
    + [f"CASE WHEN area = '{v}' THEN 1 ELSE 0 END AS area_{v}" for v in [str(i) for i in range(10)]])} FROM base""")
def m1_one_hot(spark, sf):
    """M1: named one-hot columns for levels found in the data; p_sexo_N and
    tpo_cita_P dropped as in the reference."""
    b = base(spark, sf)
    return FE.one_hot_named(b.select("no_show", *ONE_HOT_LEVELS), FE.named_levels(b, ONE_HOT_LEVELS), FE.DROP_DUMMIES)


#: The driver's tables give no patient type (``p_tpo_pac``): eleven of the twelve.
HOT = [c for c in FE.ONE_HOT if c in KEEP]
HOT_LONG = " UNION ALL ".join(f"SELECT row_id, {i} AS o, '{c}' AS \"column\", {c} AS level FROM rows" for i, c in enumerate(HOT))


@query("m1_one_hot_long", f"""WITH {BASE},
rows AS (SELECT row_number() OVER (ORDER BY {", ".join(f"{c} NULLS FIRST" for c in HOT)}) AS row_id, * FROM base),
long AS ({HOT_LONG}),
d AS (SELECT o, "column", level, row_number() OVER (ORDER BY o, level) - 1 AS index
      FROM (SELECT DISTINCT o, "column", level FROM long WHERE level IS NOT NULL
            AND "column" || '_' || level NOT IN ({", ".join(repr(x) for x in FE.DROP_DUMMIES)})))
SELECT row_id, long."column", long.level, index FROM long JOIN d ON long.o = d.o AND long.level = d.level""")
def m1_one_hot_long(spark, sf):
    """M1: sparse encoding of all categoricals through a dictionary table."""
    rows = written(global_index(written(base(spark, sf).select(*HOT)), HOT, "row_id"))
    return FE.one_hot_long(rows, "row_id", HOT, FE.category_dictionary(rows, HOT, FE.DROP_DUMMIES))


# ---------------------------------------------------------------- M2-M7

@query("m2_stratified_split_sizes", f"""WITH {BASE}, c AS (SELECT no_show, count(*) AS n FROM base GROUP BY 1)
SELECT no_show, true AS is_test, CAST(round(n * 0.2) AS BIGINT) AS rows FROM c UNION ALL
SELECT no_show, false, n - CAST(round(n * 0.2) AS BIGINT) FROM c""")
def m2_stratified_split_sizes(spark, sf):
    """M2: exact per-class test/train sizes of the stratified split."""
    b = written(base(spark, sf))
    s = SP.stratified_split(b, "no_show", b.columns, 0.2, 42)
    return s.groupBy("no_show", "is_test").agg(F.count(F.lit(1)).alias("rows"))


@query("m2_stratified_split", None)
def m2_stratified_split(spark, sf):
    """M2: the split rows themselves (hash order, reproducible)."""
    b = written(base(spark, sf))
    return SP.stratified_split(b, "no_show", b.columns, 0.2, 42)


TRAIN_SQL = f"""{MASTER_CTES},
ms AS (SELECT *, row_number() OVER (ORDER BY timestamp) AS rn, count(*) OVER () AS n FROM master),
tr AS (SELECT * FROM ms WHERE rn <= floor(n * 0.8))"""


@query("m3_chronological_split", f"WITH {TRAIN_SQL} SELECT timestamp, rn <= floor(n * 0.8) AS is_train FROM ms")
def m3_chronological_split(spark, sf):
    """M3: first 80% of hours train, the rest test."""
    return SP.chronological_split(hours(spark, sf, "timestamp"), ["timestamp"], 0.8)


FOLD_SQL = f"""{MASTER_CTES},
ms AS (SELECT timestamp, {Y}, row_number() OVER (ORDER BY timestamp) - 1 AS position, count(*) OVER () AS n FROM master),
fo AS (SELECT *, n // 6 AS fold_size, n - (n // 6) * 5 AS start FROM ms)"""


@query("m4_expanding_folds", f"""WITH {FOLD_SQL} SELECT timestamp, position,
  CAST(CASE WHEN position >= start THEN (position - start) // fold_size + 1 ELSE 0 END AS INTEGER) AS fold, fold_size FROM fo""")
def m4_expanding_folds(spark, sf):
    """M4: expanding time-series folds, k=5."""
    return SP.expanding_folds(hours(spark, sf, "timestamp"), ["timestamp"], 5)


def _split_master(spark, sf):
    m = hours(spark, sf, "timestamp", "hour", Y, "tiempo_espera")
    s = SP.chronological_split(m, ["timestamp"], 0.8)
    return s, s.filter("is_train")


@query("m5_mean_impute", S.wrap(f"""WITH {TRAIN_SQL}
SELECT timestamp, coalesce(tiempo_espera, (SELECT avg(tiempo_espera) FROM tr)) AS tiempo_espera FROM ms""",
                                ["tiempo_espera"]))
def m5_mean_impute(spark, sf):
    """M5: missing mean waits filled with the training mean."""
    s, tr = _split_master(spark, sf)
    return FE.apply_fill(s, FE.fit_mean(tr, ["tiempo_espera"]), ["tiempo_espera"]).select("timestamp", "tiempo_espera")


@query("m6_standardize", S.wrap(f"""WITH {TRAIN_SQL}, st AS (SELECT avg({Y}) AS mu1, stddev_pop({Y}) AS sd1,
  avg(tiempo_espera) AS mu2, stddev_pop(tiempo_espera) AS sd2 FROM tr)
SELECT timestamp, ({Y} - mu1) / sd1 AS {Y}, (tiempo_espera - mu2) / sd2 AS tiempo_espera FROM ms CROSS JOIN st""",
                                [Y, "tiempo_espera"]))
def m6_standardize(spark, sf):
    """M6: standardisation fitted on train (population std)."""
    s, tr = _split_master(spark, sf)
    cols = [Y, "tiempo_espera"]
    return FE.apply_standard(s, FE.fit_standard(tr, cols), cols).select("timestamp", *cols)


@query("m7_median_mode", S.wrap(f"""WITH {TRAIN_SQL}
SELECT (SELECT quantile_cont(tiempo_espera, 0.5) FROM tr) AS tiempo_espera__fill,
       (SELECT arg_min(hour, (-n, hour)) FROM (SELECT hour, count(*) AS n FROM tr GROUP BY hour)) AS hour__fill""",
                                ["tiempo_espera__fill"]))
def m7_median_mode(spark, sf):
    """M7: exact training median (waits) and mode (hour, smallest on ties)."""
    _, tr = _split_master(spark, sf)
    from careflow.operators.ordering import attach_scalars
    return attach_scalars(FE.fit_median(tr, ["tiempo_espera"]), FE.fit_mode(tr, ["hour"]))


# ---------------------------------------------------------------- M14-M18, T6

NAIVE_SQL = f"""{FOLD_SQL},
pr AS (SELECT timestamp, {Y}, CAST(coalesce(lag({Y}, 24) OVER (ORDER BY timestamp), {Y}) AS DOUBLE) AS prediction,
       CAST(CASE WHEN position >= start THEN (position - start) // fold_size + 1 ELSE 0 END AS INTEGER) AS fold FROM fo),
pm AS (SELECT fold, avg({Y}) AS ybar FROM pr GROUP BY fold),
pf AS (SELECT pr.fold, avg(abs({Y} - prediction)) AS MAE, sqrt(avg(({Y} - prediction) * ({Y} - prediction))) AS RMSE,
       count(*) AS n, 1 - sum(({Y} - prediction) * ({Y} - prediction)) / sum(({Y} - ybar) * ({Y} - ybar)) AS R2
       FROM pr JOIN pm ON pr.fold = pm.fold WHERE pr.fold > 0 GROUP BY pr.fold)"""


def _naive_folds(spark, sf):
    m = hours(spark, sf, "timestamp", Y)
    m = TS.add_lags(m, Y, [24], ["timestamp"], name="prediction")
    m = m.withColumn("prediction", F.coalesce("prediction", Y).cast("double"))
    return SP.expanding_folds(m, ["timestamp"], 5)


def _naive_per_fold(spark, sf):
    f = _naive_folds(spark, sf).filter(F.col("fold") > 0)
    return ME.regression_metrics(f, Y, "prediction", by=["fold"])


@query("m14_regression_metrics", S.wrap(f"WITH {NAIVE_SQL} SELECT * FROM pf", ["MAE", "RMSE", "R2"]))
def m14_regression_metrics(spark, sf):
    """MAE, RMSE, R2 per fold for the seasonal-naive forecast."""
    return _naive_per_fold(spark, sf)


@query("m14_fold_summary", S.wrap(f"""WITH {NAIVE_SQL} SELECT count(*) AS cv_folds,
  avg(MAE) AS cv_MAE_mean, stddev_samp(MAE) AS cv_MAE_std, avg(RMSE) AS cv_RMSE_mean, stddev_samp(RMSE) AS cv_RMSE_std,
  avg(R2) AS cv_R2_mean, stddev_samp(R2) AS cv_R2_std FROM pf""",
                                  ["cv_MAE_mean", "cv_MAE_std", "cv_RMSE_mean", "cv_RMSE_std", "cv_R2_mean", "cv_R2_std"]))
def m14_fold_summary(spark, sf):
    """Mean and sample std of the fold metrics."""
    return ME.fold_summary(_naive_per_fold(spark, sf))


@query("t6_best_fold", S.wrap(f"WITH {NAIVE_SQL} SELECT * FROM pf ORDER BY MAE, fold LIMIT 1", ["MAE", "RMSE", "R2"]))
def t6_best_fold(spark, sf):
    """The best row by minimum MAE."""
    return RK.best_row(_naive_per_fold(spark, sf), "MAE", maximize=False, tie="fold")


SCORED_SQL = f"{BASE}, sc AS (SELECT no_show, {PROB_SQL} AS prob FROM base)"


@query("m15_binary_metrics", S.wrap(f"""WITH {SCORED_SQL},
c AS (SELECT CAST(sum(CASE WHEN no_show = 0 AND prob < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN no_show = 0 AND prob >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN no_show = 1 AND prob < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN no_show = 1 AND prob >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM sc),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score,
  (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM d""", ["precision", "recall", "f1_score", "accuracy"]))
def m15_binary_metrics(spark, sf):
    """Confusion counts and threshold metrics."""
    return ME.binary_metrics(scored(spark, sf), "no_show", "prob", 0.5)


@query("m15_class_report", S.wrap(f"""WITH {SCORED_SQL},
k AS (SELECT c, sum(CASE WHEN no_show = c AND CAST(prob >= 0.5 AS INTEGER) = c THEN 1 ELSE 0 END) AS tp,
             sum(CASE WHEN CAST(prob >= 0.5 AS INTEGER) = c THEN 1 ELSE 0 END) AS pp,
             sum(CASE WHEN no_show = c THEN 1 ELSE 0 END) AS s FROM sc CROSS JOIN (VALUES (0), (1)) v(c) GROUP BY c),
r AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS precision,
             CASE WHEN s > 0 THEN tp / s ELSE 0 END AS recall, CAST(s AS BIGINT) AS support FROM k),
r2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM r)
SELECT class, precision, recall, f1_score, support FROM r2 UNION ALL
SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support) FROM r2 UNION ALL
SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
       sum(f1_score * support) / sum(support), sum(support) FROM r2""", ["precision", "recall", "f1_score"]))
def m15_class_report(spark, sf):
    """Per-class report with macro and weighted averages."""
    return ME.class_report(scored(spark, sf), "no_show", "prob", 0.5)


@query("m16_roc_auc", S.wrap(f"""WITH {SCORED_SQL},
h AS (SELECT prob AS s, sum(no_show) AS pos, sum(1 - no_show) AS neg FROM sc GROUP BY 1),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)
SELECT sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) AS roc_auc FROM c""", ["roc_auc"]))
def m16_roc_auc(spark, sf):
    """Exact ROC-AUC over distinct scores (ties half)."""
    return ME.roc_auc(scored(spark, sf), "no_show", "prob")


@query("m17_average_precision", S.wrap(f"""WITH {SCORED_SQL},
h AS (SELECT prob AS s, sum(no_show) AS pos, sum(1 - no_show) AS neg FROM sc GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM h)
SELECT sum(pos * (tp / (tp + fp))) / sum(pos) AS pr_auc FROM c""", ["pr_auc"]))
def m17_average_precision(spark, sf):
    """Average precision (step sum) over distinct scores."""
    return ME.average_precision(scored(spark, sf), "no_show", "prob")


@query("m18_evaluation_document", None)
def m18_evaluation_document(spark, sf):
    """One-row evaluation document (metrics, confusion, sizes)."""
    s = written(scored(spark, sf).select("no_show", "prob"))
    return ME.evaluation_document(ME.binary_metrics(s, "no_show", "prob"), ME.roc_auc(s, "no_show", "prob"),
                                  ME.average_precision(s, "no_show", "prob"),
                                  s.agg(F.count(F.lit(1)).alias("test_size")), {"threshold_source": "score"})


@query("k6_model_report", f"""SELECT *, 'demand' AS model FROM ({ORACLE["m14_fold_summary"]})
UNION ALL BY NAME SELECT *, 'no_show' AS model FROM ({ORACLE["m15_binary_metrics"]})
UNION ALL BY NAME SELECT 'not_there' AS model""")
def k6_model_report(spark, sf):
    """K6: the stored demand and no-show metric documents in one report;
    a document that isn't there leaves a row of nulls."""
    demand, no_show = scratch(spark, "demand"), scratch(spark, "no_show")
    IO.write_json(ME.fold_summary(_naive_per_fold(spark, sf)), demand)
    IO.write_json(ME.binary_metrics(scored(spark, sf), "no_show", "prob"), no_show)
    return IO.model_report(spark, {"demand": demand, "no_show": no_show, "not_there": scratch(spark, "none")})


# ---------------------------------------------------------------- models

def _demand(spark, sf):
    feats = TS.ts_features(hours(spark, sf))
    cols = [c for c in feats.columns if c not in ("timestamp", Y)]
    return feats, cols


def _folds(spark, sf):
    feats, cols = _demand(spark, sf)
    return MS.Folds(SP.expanding_folds(written(feats), ["timestamp"], 5), cols, Y, ["timestamp"])


@query("m8_gbt_regressor", None)
def m8_gbt_regressor(spark, sf):
    """M8: GBT regressor with validation-based stopping; last-fold predictions."""
    feats, cols = _demand(spark, sf)
    folded = SP.expanding_folds(feats, ["timestamp"], 5)
    tr, va = SP.fold_frames(folded, 5)
    m = MO.fit_gbt_regressor(tr, cols, Y, {"n_estimators": 20, "max_depth": 4}, validation=va)
    return m.transform(va).select("timestamp", Y, "prediction")


FEATURE_FOLDS = f"""fe AS ({FEATURES_SQL}),
fp AS (SELECT timestamp, {Y}, row_number() OVER (ORDER BY timestamp) - 1 AS position, count(*) OVER () AS n FROM fe),
ff AS (SELECT *, CASE WHEN position >= n - (n // 6) * 5 THEN (position - (n - (n // 6) * 5)) // (n // 6) + 1 ELSE 0 END AS fold FROM fp)"""


@query("m9_grid_search", "SELECT *, CAST(5 AS BIGINT) AS folds, true AS scored FROM " + " CROSS JOIN ".join(
    f"(SELECT CAST(unnest([{', '.join(map(str, v))}]) AS DOUBLE) AS {k})" for k, v in MO.DEMAND_GRID.items()))
def m9_grid_search(spark, sf):
    """M9: all 48 combinations x 5 expanding folds; every combination has a
    mean error over all folds (its value is a model's)."""
    found = MS.grid_search(_folds(spark, sf))
    ok = (F.col("cv_mae_mean") >= 0) & (F.col("cv_mae_std") >= 0)
    return found.select(*MO.DEMAND_GRID, "folds", ok.alias("scored"))


@query("m13_oof_predictions", f"""WITH {FEATURE_FOLDS}
SELECT timestamp, CAST(fold AS BIGINT) AS fold, {Y}, true AS predicted FROM ff WHERE fold > 0""")
def m13_oof_predictions(spark, sf):
    """One out-of-fold prediction, clipped at 0, for every row of every fold."""
    oof, _ = MS.out_of_fold(_folds(spark, sf), {"n_estimators": 4, "max_depth": 3})
    return oof.select("timestamp", "fold", Y, (F.col("prediction") >= 0).alias("predicted"))


@query("c10_train_demand", None)
def c10_train_demand(spark, sf):
    """Grid, folds, tuned tree count and final refit; fold summary."""
    feats, cols = _demand(spark, sf)
    r = MD.train_demand(feats, cols, Y)
    return r["summary"].withColumn("final_trees", F.lit(r["params"]["n_estimators"]))


@query("t5_top_importances", None)
def t5_top_importances(spark, sf):
    """T5: top-10 feature importances of the demand model."""
    feats, cols = _demand(spark, sf)
    m = MO.fit_gbt_regressor(feats, cols, Y, {"n_estimators": 10})
    imp = m.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(cols, [float(v) for v in imp])), "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(10)


def _no_show_model(spark, sf, params: dict, weight: float):
    """Held-out rows and a model over all twelve categoricals and the numeric features."""
    data = MD.prepared_no_show(base(spark, sf))
    weights = F.when(F.col("no_show") == 1, F.lit(weight)).otherwise(F.lit(1.0))
    model = MO.gbt_classifier(params, "features", "no_show", "__w").fit(data["train"].withColumn("__w", weights))
    return data, model


HELD_OUT = f"""{BASE}, n AS (SELECT no_show, CAST(round(count(*) * 0.2) AS BIGINT) AS rows FROM base GROUP BY 1)"""


@query("m11_gbt_classifier", f"WITH {HELD_OUT} SELECT no_show, rows, true AS probabilities FROM n")
def m11_gbt_classifier(spark, sf):
    """Weighted GBT classifier on numeric features and all categoricals;
    probabilities of the held-out rows, exactly a fifth of each class."""
    data, model = _no_show_model(spark, sf, {"n_estimators": 6, "max_depth": 3}, 2.0)
    scored_rows = MO.probability_of_positive(model.transform(data["test"]))
    return scored_rows.groupBy("no_show").agg(F.count(F.lit(1)).alias("rows"),
                                              F.min(F.col("prob").between(0, 1)).alias("probabilities"))


@query("m12_halving_search", None)
def m12_halving_search(spark, sf):
    """30 seeded trials by successive halving on a validation part of train; the trial log."""
    data = MD.prepared_no_show(base(spark, sf))
    inner = SP.stratified_split(data["train"], "no_show", [MD.ROW], 0.2, 43)
    fit, valid = (inner.filter(c).drop("is_test") for c in (~F.col("is_test"), F.col("is_test")))
    return MS.halving_search(fit, valid, "features", "no_show", MD.ROW, pos_weight=2.0)


@query("c10_train_no_show", None)
def c10_train_no_show(spark, sf):
    """No-show flow end to end; the evaluation document."""
    return MD.train_no_show(base(spark, sf))["evaluation"]


@query("m19_batch_scoring", f"WITH {HELD_OUT} SELECT no_show, rows, true AS flagged_right FROM n")
def m19_batch_scoring(spark, sf):
    """Held-out rows scored in a batch, flagged above a probability of 0.6."""
    data, model = _no_show_model(spark, sf, {"n_estimators": 4, "max_depth": 3}, 1.0)
    out = MO.batch_score(model, data["test"], 0.6)
    right = (F.col("prediccion_noshow") == 1) == (F.col("prob") > 0.6)
    return out.groupBy("no_show").agg(F.count(F.lit(1)).alias("rows"), F.min(right).alias("flagged_right"))


@query("m20_recursive_forecast", None)
def m20_recursive_forecast(spark, sf):
    """24-hour recursive forecast by boosted trees over the full demand features, lags 48 and 168 included."""
    m = hours(spark, sf)
    feats = TS.ts_features(m, lags=(*TS.DEFAULT_LAGS, 48, 168))
    cols = [c for c in feats.columns if c not in ("timestamp", Y)]
    model = MO.fit_gbt_regressor(feats, cols, Y, {"n_estimators": 6, "max_depth": 4})
    return FO.recursive_forecast(model, m, Y, "timestamp", 24, wait="tiempo_espera")


#: A planted model over lags, windows, differences, calendar and triage features, with its SQL over a history ``v``.
PLANTED = {
    "lag_1h": (0.3, "v[len(v)]"), "lag_24h": (0.15, "v[len(v) - 23]"), "lag_48h": (0.1, "v[len(v) - 47]"),
    "lag_168h": (0.05, "v[len(v) - 167]"), "roll_mean_24h": (0.25, "list_avg(v[len(v) - 23:])"),
    "roll_std_6h": (-0.1, "list_stddev_samp(v[len(v) - 5:])"), "diff_1h": (0.05, "v[len(v)] - v[len(v) - 1]"),
    "diff_24h": (0.04, "v[len(v)] - v[len(v) - 24]"), "hour_of_day": (0.01, "hour(last + to_hours(step + 1))"),
    "hour_sin": (0.6, "sin(2 * pi() * hour(last + to_hours(step + 1)) / 24)"),
    "dow_cos": (0.2, "cos(2 * pi() * (isodow(last + to_hours(step + 1)) - 1) / 7)"),
    "month_sin": (0.1, "sin(2 * pi() * month(last + to_hours(step + 1)) / 12)"),
    "is_weekend": (-0.2, "CAST(isodow(last + to_hours(step + 1)) >= 6 AS INTEGER)"),
    "week_of_year": (0.002, "weekofyear(last + to_hours(step + 1))"), "triage_A": (5.0, "0")}


@query("m20_planted_forecast", S.wrap(f"""WITH RECURSIVE {MASTER_CTES},
h AS (SELECT list(y ORDER BY timestamp) AS v, max(timestamp) AS last
      FROM (SELECT timestamp, CAST({Y} AS DOUBLE) AS y FROM master ORDER BY timestamp DESC LIMIT 168)),
f AS (SELECT 0 AS step, v, last FROM h UNION ALL
      SELECT step + 1, list_append(v, greatest(0.0, 0.4 + {" + ".join(f"{c} * ({x})" for c, x in PLANTED.values())})), last
      FROM f WHERE step < 24)
SELECT last + to_hours(step) AS timestamp, step, v[len(v)] AS forecast FROM f WHERE step > 0""", ["forecast"]))
def m20_planted_forecast(spark, sf):
    """The recursion itself, with a planted linear model over every kind of feature."""
    model = FO.LinearScorer(list(PLANTED), [c for c, _ in PLANTED.values()], 0.4)
    return FO.recursive_forecast(model, master(spark, sf), Y, "timestamp", 24)


HOLD_OUT = f"""fe AS ({FEATURES_SQL}),
fp AS (SELECT timestamp, {Y}, CAST(lag_1h AS DOUBLE) AS x, row_number() OVER (ORDER BY timestamp) AS rn, count(*) OVER () AS n FROM fe),
tr AS (SELECT regr_slope({Y}, x) AS b, regr_intercept({Y}, x) AS a FROM fp WHERE rn <= floor(n * 0.8)),
te AS (SELECT {Y} AS y, a + b * x AS p FROM fp CROSS JOIN tr WHERE rn > floor(n * 0.8)),
tm AS (SELECT avg(y) AS ybar FROM te)"""


def _baseline(spark, sf, cols):
    feats, _ = _demand(spark, sf)
    split = SP.chronological_split(feats, ["timestamp"], 0.8)
    model = MO.linear_baseline(split.filter("is_train"), cols, Y)
    return ME.regression_metrics(model.transform(split.filter(~F.col("is_train"))), Y, "prediction")


@query("m21_naive_autoregression", S.wrap(f"""WITH {HOLD_OUT}
SELECT avg(abs(y - p)) AS MAE, sqrt(avg((y - p) * (y - p))) AS RMSE, count(*) AS n,
       1 - sum((y - p) * (y - p)) / sum((y - ybar) * (y - ybar)) AS R2 FROM te CROSS JOIN tm""", ["MAE", "RMSE", "R2"]))
def m21_naive_autoregression(spark, sf):
    """First-order autoregression fitted on the first 80% of hours, scored on the rest."""
    return _baseline(spark, sf, ["lag_1h"])


@query("m21_linear_baseline", None)
def m21_linear_baseline(spark, sf):
    """Autoregression on all default lags, fitted on the first 80% of hours, scored on the rest."""
    return _baseline(spark, sf, [f"lag_{k}h" for k in TS.DEFAULT_LAGS])


# ---------------------------------------------------------------- sinks

@query("s2_parquet_roundtrip", S.wrap(f"WITH {MASTER_CTES} SELECT * FROM master", ["tiempo_espera", "tiempo_espera_mediana"]))
def s2_parquet_roundtrip(spark, sf):
    """The hourly master written as parquet and read back."""
    path = scratch(spark, "master")
    IO.write_table(master(spark, sf), path)
    return IO.read_table(spark, path)


@query("s3_guarded_scan", "SELECT * FROM orders")
def s3_guarded_scan(spark, sf):
    """S3: guarded scan of an existing table (a missing path gives an
    empty frame with the declared schema)."""
    o = IO.read_if_exists(spark, f"{sf}/orders.parquet", None)
    missing = IO.read_if_exists(spark, f"{sf}/no_such_table.parquet", o.schema)
    return o.unionByName(missing)


@query("s4_json_roundtrip", S.wrap(f"WITH {NAIVE_SQL} SELECT * FROM pf", ["MAE", "RMSE", "R2"]))
def s4_json_roundtrip(spark, sf):
    """Fold metrics written as JSON and read back with a schema."""
    path = scratch(spark, "metrics")
    pf = _naive_per_fold(spark, sf)
    IO.write_json(pf, path)
    return IO.read_json(spark, path, pf.schema)


@query("s5_csv_roundtrip", S.wrap(f"WITH {NAIVE_SQL} SELECT * FROM pf", ["MAE", "RMSE", "R2"]))
def s5_csv_roundtrip(spark, sf):
    """A trial-style log written as CSV (header) and read back."""
    path = scratch(spark, "trials")
    pf = _naive_per_fold(spark, sf)
    IO.write_csv(pf, path)
    return IO.read_csv(spark, path, pf.schema)


@query("s6_append_predictions", S.wrap(f"""WITH {SCORED_SQL.replace("SELECT no_show,", "SELECT med, esp,")}
SELECT med, esp, prob, 'analyst' AS username, b AS batch, TIMESTAMP '2024-03-01 10:00:00' AS timestamp
FROM sc CROSS JOIN (VALUES ('b-first'), ('b-second')) v(b)""", ["prob"]))
def s6_append_predictions(spark, sf):
    """Scored rows appended in two batches, one of them written twice, read back."""
    path = scratch(spark, "log")
    s = written(scored(spark, sf).select("med", "esp", "prob"))
    for batch in ("first", "second", "first"):
        IO.append_predictions(s, path, "analyst", batch_id=batch, at="2024-03-01 10:00:00")
    return IO.read_predictions(spark, path).select("med", "esp", "prob", "username", "batch", "timestamp")


@query("s7_log_history", f"""WITH {RAW}, {S.CLEAN_APPOINTMENTS}
SELECT cve_num, appointment_datetime AS timestamp FROM appt WHERE area = '3'
ORDER BY appointment_datetime DESC, cve_num DESC LIMIT 40""")
def s7_log_history(spark, sf):
    """Newest rows of one user from a log partitioned by date, reading the newest dates only."""
    path = scratch(spark, "history")
    a = appts(spark, sf).select("cve_num", F.col("appointment_datetime").alias("timestamp"), F.col("area").alias("username"))
    # a partition for each date, but few rows of the check's tables: years stand for dates
    a = a.withColumn("date", F.make_date(F.year("timestamp"), F.lit(1), F.lit(1)))
    IO.write_table(a, path, partition_by=["date"])
    log = IO.read_predictions(spark, path)
    return IO.prediction_history(log, "3", 40, "timestamp", "cve_num", date_col="date").select("cve_num", "timestamp")


@query("s7_prediction_history", S.wrap(f"""WITH {RAW}, {S.CLEAN_APPOINTMENTS}
SELECT cve_num, appointment_datetime AS timestamp, area AS username, {PROB_SQL} AS prob FROM appt
WHERE area = '3' ORDER BY appointment_datetime DESC, cve_num DESC LIMIT 10""", ["prob"]))
def s7_prediction_history(spark, sf):
    """Newest ten predictions of one user (a top-k)."""
    a = appts(spark, sf).select("cve_num", F.col("appointment_datetime").alias("timestamp"),
                                F.col("area").alias("username"),
                                ((F.col("med").try_cast("bigint") * 7919) % 1000).cast("double") / 1000.0)
    a = a.withColumnRenamed(a.columns[-1], "prob")
    return IO.prediction_history(a, "3", 10, "timestamp", "cve_num")


@query("s9_model_roundtrip", f"WITH fe AS ({FEATURES_SQL}) SELECT timestamp, true AS same FROM fe")
def s9_model_roundtrip(spark, sf):
    """A fitted pipeline saved and loaded scores every row as before."""
    feats, cols = _demand(spark, sf)
    m = MO.fit_gbt_regressor(feats, cols, Y, {"n_estimators": 5})
    path = scratch(spark, "model")
    IO.save_model(m, path)
    before = m.transform(feats).select(*feats.columns, F.col("prediction").alias("before"))
    return IO.load_model(path).transform(before).select("timestamp", (F.col("prediction") == F.col("before")).alias("same"))


@query("p30_minmax_scale", S.wrap(f"""WITH {MASTER_CTES},
mm AS (SELECT min({Y}) AS lo, max({Y}) AS hi FROM master)
SELECT timestamp, CASE WHEN hi = lo THEN 0.0 ELSE ({Y} - lo) / (hi - lo) END AS {Y} FROM master CROSS JOIN mm""", [Y]))
def p30_minmax_scale(spark, sf):
    """Hourly arrivals scaled to [0, 1]."""
    m = master(spark, sf).select("timestamp", Y)
    return FE.apply_minmax(m, FE.fit_minmax(m, [Y]), [Y])
