"""M*: model queries. Evaluation operators are checked against DuckDB on a deterministic
stand-in score; training/inference with Spark ML are rows-only (no SQL twin exists)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

from pyspark.sql import functions as F

from ..operators import ml as M
from ..operators import model_store
from ..session import cut_lineage, scratch_path, stored
from ..sources.fixtures import AS_OF, fleet
from .feature_queries import panel, panel_sql
from .registry import BODY, register

SPLIT_SQL = f"""(SELECT p.*, row_number() OVER (PARTITION BY horizonte_dias ORDER BY fecha_corte, activo_id)
    <= floor(count(*) OVER (PARTITION BY horizonte_dias) * 0.7) AS is_train FROM ({panel_sql()}) p)"""
SCORE_SQL = "least(1.0, (greatest(count_ot_90d, 0) * 0.125 + greatest(count_correctivas_30d, 0) * 0.25) / 4.0)"
TEST_SQL = f"(SELECT horizonte_dias, target, {SCORE_SQL} AS score FROM {SPLIT_SQL} WHERE NOT is_train)"


def split_frame(spark, d):
    return M.chrono_panel(panel(spark, d))


def test_scored(spark, d):
    s = split_frame(spark, d)
    return s.filter(~F.col("is_train")).select("horizonte_dias", "target", M.stand_in_score(s).alias("score"))


@register("M4_chrono_split", f"SELECT * FROM {SPLIT_SQL}")
def m4(spark, d):
    return split_frame(spark, d)


@register("M3_class_weights", f"""
SELECT horizonte_dias, count(CASE WHEN target = 0 THEN 1 END) AS n_neg, count(CASE WHEN target = 1 THEN 1 END) AS n_pos,
  count(CASE WHEN target = 0 THEN 1 END) / greatest(count(CASE WHEN target = 1 THEN 1 END), 1) AS peso_positivo
FROM {SPLIT_SQL} WHERE is_train GROUP BY horizonte_dias""")
def m3(spark, d):
    return M.class_weights(split_frame(spark, d).filter("is_train"))


CURVE_SQL = f"""(SELECT *, 2 * precision * recall / (precision + recall + 1e-10) AS f1 FROM (
  SELECT c.horizonte_dias, c.score,
    CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
    CASE WHEN t.P > 0 THEN tp / t.P ELSE 1.0 END AS recall
  FROM (SELECT horizonte_dias, score,
          sum(pos) OVER (PARTITION BY horizonte_dias ORDER BY score DESC) AS tp,
          sum(neg) OVER (PARTITION BY horizonte_dias ORDER BY score DESC) AS fp
        FROM (SELECT horizonte_dias, score, count(CASE WHEN target = 1 THEN 1 END) AS pos,
                count(CASE WHEN target = 0 THEN 1 END) AS neg FROM {TEST_SQL} GROUP BY 1, 2)) c
  JOIN (SELECT horizonte_dias, count(CASE WHEN target = 1 THEN 1 END) AS P FROM {TEST_SQL} GROUP BY 1) t
    ON c.horizonte_dias = t.horizonte_dias))"""

THR_SQL = f"""(SELECT f.horizonte_dias, coalesce(v.thr, f.thr) AS threshold_optimo
  FROM (SELECT horizonte_dias, arg_max(score, struct_pack(a := f1, b := -score)) AS thr FROM {CURVE_SQL} GROUP BY 1) f
  LEFT JOIN (SELECT horizonte_dias, arg_max(score, struct_pack(a := precision, b := -score)) AS thr FROM {CURVE_SQL}
             WHERE recall >= 0.7 GROUP BY 1) v ON f.horizonte_dias = v.horizonte_dias)"""


@register("M5_best_threshold", f"SELECT * FROM {THR_SQL}")
def m5(spark, d):
    return M.best_threshold(test_scored(spark, d))


@register("M6_auc", f"""
SELECT horizonte_dias, CASE WHEN p > 0 AND q > 0 THEN round(n2 / (2.0 * p * q), 12) END AS auc FROM (
  SELECT horizonte_dias, sum(pos * (2 * (cneg - neg) + neg)) AS n2, sum(pos) AS p, sum(neg) AS q FROM (
    SELECT *, sum(neg) OVER (PARTITION BY horizonte_dias ORDER BY score) AS cneg FROM (
      SELECT horizonte_dias, score, count(CASE WHEN target = 1 THEN 1 END) AS pos, count(CASE WHEN target = 0 THEN 1 END) AS neg
      FROM {TEST_SQL} GROUP BY 1, 2)) GROUP BY 1)""")
def m6(spark, d):
    return M.auc(test_scored(spark, d))


@register("M7_precision_recall_f1", f"""
SELECT horizonte_dias, tp, fp, fn,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 12) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 12) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 12) AS f1
FROM (SELECT t.horizonte_dias, count(CASE WHEN score >= threshold_optimo AND target = 1 THEN 1 END) AS tp,
        count(CASE WHEN score >= threshold_optimo AND target = 0 THEN 1 END) AS fp,
        count(CASE WHEN score < threshold_optimo AND target = 1 THEN 1 END) AS fn
      FROM {TEST_SQL} t JOIN {THR_SQL} h ON t.horizonte_dias = h.horizonte_dias GROUP BY 1)""")
def m7(spark, d):
    s = test_scored(spark, d)
    return M.prf(s, M.best_threshold(s))


@register("M12_model_precision", """
WITH reg AS (SELECT modelo_version AS version, min(fecha_scoring) AS fecha_entrenamiento FROM scoring_resultados GROUP BY 1)
SELECT reg.version AS modelo_version, reg.fecha_entrenamiento, count(f.feedback_id) AS total_predicciones,
  CAST(sum(CASE WHEN f.falla_confirmada = TRUE THEN 1 ELSE 0 END) AS BIGINT) AS aciertos,
  round(100.0 * sum(CASE WHEN f.falla_confirmada = TRUE THEN 1 ELSE 0 END) / nullif(count(f.feedback_id), 0), 2) AS precision_porcentaje
FROM reg LEFT JOIN scoring_resultados s ON reg.version = s.modelo_version LEFT JOIN feedback_taller f ON s.scoring_id = f.scoring_id
GROUP BY reg.version, reg.fecha_entrenamiento""")
def m12(spark, d):
    f = fleet(spark, d)
    reg = f.scoring_resultados.groupBy(F.col("modelo_version").alias("version")).agg(
        F.min("fecha_scoring").alias("fecha_entrenamiento"))
    return M.model_precision(reg, f.scoring_resultados, f.feedback_taller)


# ------------------------------------------------ real models (rows-only: no SQL twin of tree ensembles)
@lru_cache(maxsize=4)
def _trained(spark, d, kind):
    # the split panel is read by every fit and by inference: materialise it once in the shared checkpoint folder
    s = cut_lineage(M.to_short(split_frame(spark, d)))
    feats = M.feature_columns(s)
    train = s.filter("is_train")
    if kind == "gbt":
        # one model per horizon; the three fits are independent Spark jobs, submitted concurrently
        with ThreadPoolExecutor(max_workers=3) as pool:
            fits = {h: pool.submit(M.train_gbt, train.filter(F.col("horizonte_dias") == h), feats) for h in (7, 30, 90)}
            models = {h: f.result() for h, f in fits.items()}
    else:
        # a fitted forest carries its training summary, which would travel (and has to be serialised) with every task that
        # predicts; what is read back from the store is the trees alone
        base = scratch_path(spark, f"models-{uuid.uuid4().hex}")
        record = M.metadata(spark, "rf_v1.0", 0, feats, {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 3}, 0, 0, 0.5, {})
        model_store.save(spark, base, "rf_v1.0", M.train_rf(train, feats), record)
        model_store.register(spark, base, {"rf_v1.0": {}})
        models = {0: model_store.load(spark, base, "rf_v1.0").pipeline}
    return s, feats, models


def _test_predictions(spark, d, kind):
    s, feats, models = _trained(spark, d, kind)
    test = s.filter(~F.col("is_train"))
    if kind == "gbt":
        out = None
        for h, m in models.items():
            p = M.predict(m, M.dealt(test.filter(F.col("horizonte_dias") == h), M.BOOST_TASK_ROWS), feats)
            out = p if out is None else out.unionByName(p)
    else:
        out = M.predict(models[0], M.dealt(test, M.FOREST_TASK_ROWS), feats)
    return out.select("activo_id", "fecha_corte", "horizonte_dias", "target", "probabilidad_falla")


@register("M1_gbt_test_predictions")
def m1(spark, d):
    return _test_predictions(spark, d, "gbt")


@register("M2_rf_test_predictions")
def m2(spark, d):
    return _test_predictions(spark, d, "rf")


@register("M1_M5_M7_gbt_evaluation")
def m1eval(spark, d):
    # threshold, AUC and rates read the scores several times: the trees score every test row once
    p = stored(_test_predictions(spark, d, "gbt").withColumnRenamed("probabilidad_falla", "score"))
    thr = M.best_threshold(p)
    return M.auc(p).join(thr, "horizonte_dias").join(M.prf(p, thr), "horizonte_dias")


@register("M8_feature_importance")
def m8(spark, d):
    s, feats, models = _trained(spark, d, "gbt")
    return M.importance(spark, models[30], feats)


@register("M9_M10_registry")
def m10(spark, d):
    ev = m1eval(spark, d).collect()  # three rows, one per horizon
    s, feats, _ = _trained(spark, d, "gbt")
    reg = spark.createDataFrame([], M.REGISTRY_SCHEMA)
    for r in ev:
        reg = M.registry_register(reg, {
            "modelo_id": f"gbt_v1.0_h{r['horizonte_dias']}", "version": "v1.0", "nombre_archivo": f"gbt_h{r['horizonte_dias']}",
            "fecha_entrenamiento": AS_OF, "fecha_creacion": None, "auc_score": r["auc"], "precision": r["precision"],
            "recall": r["recall"], "f1_score": r["f1"], "n_samples_train": None, "n_features": len(feats),
            "features_utilizadas": feats, "hiperparametros": '{"maxDepth": 5, "maxIter": 200, "stepSize": 0.1}'})
    return M.registry_activate(reg, "gbt_v1.0_h30")


@register("K28_active_model_recall_precision")
def k28(spark, d):
    return M.recall_precision_active(m10(spark, d))


# ------------------------------------------------ models read back through the registry
REGISTRY_SQL = f"""(SELECT 'reglas_v1.0_h' || CAST(e.horizonte_dias AS VARCHAR) AS modelo_id, 'reglas_v1.0' AS version,
    DATE '{AS_OF}' AS fecha_entrenamiento,
    TIMESTAMP '{AS_OF} 00:00:00' + to_seconds(CAST(row_number() OVER (ORDER BY e.horizonte_dias) - 1 AS BIGINT)) AS fecha_creacion,
    a.auc AS auc_score, e.precision, e.recall, e.f1 AS f1_score, 'entrenado' AS estado, e.horizonte_dias = 30 AS es_activo
  FROM ({BODY['M7_precision_recall_f1']}) e JOIN ({BODY['M6_auc']}) a ON e.horizonte_dias = a.horizonte_dias)"""


@register("M10_registry_list", f"SELECT * FROM {REGISTRY_SQL}")
def m10_list(spark, d):
    return M.registry_list(fleet(spark, d).modelos_registro)


@register("K28_saved_model_recall_precision", f"SELECT recall * 100 AS recall_pct, precision * 100 AS precision_pct FROM {REGISTRY_SQL} WHERE es_activo")
def k28_saved(spark, d):
    return M.recall_precision_active(fleet(spark, d).modelos_registro)


@register("M11_predictions_of_saved_model", f"""
SELECT activo_id, fecha_corte, horizonte_dias, target, {SCORE_SQL} AS probabilidad_falla FROM {SPLIT_SQL} WHERE NOT is_train""")
def m11(spark, d):
    """The active model, read back through the registry, on the test part of the panel."""
    f = fleet(spark, d)
    s = split_frame(spark, d)
    model = model_store.load(spark, f.model_base)
    return model.predict(s.filter(~F.col("is_train"))).select("activo_id", "fecha_corte", "horizonte_dias", "target", "probabilidad_falla")


@register("M11_saved_trees_predict_the_same", f"""
SELECT activo_id, fecha_corte, horizonte_dias, TRUE AS igual, TRUE AS en_rango, TRUE AS columnas_exigidas FROM {SPLIT_SQL} WHERE NOT is_train""")
def m11_trees(spark, d):
    """The boosted trees of M1, saved, registered and read back: on every test row the same probability as before, from the
    feature columns that their record names; a panel without one of them is refused."""
    s, feats, models = _trained(spark, d, "gbt")
    base = scratch_path(spark, f"models-{uuid.uuid4().hex}")
    for h, model in models.items():
        record = M.metadata(spark, "v1.0", h, feats, {"maxDepth": 5, "maxIter": 200, "stepSize": 0.1}, 0, 0, 0.5, {})
        model_store.save(spark, base, f"gbt_v1.0_h{h}", model, record)
    model_store.register(spark, base, {f"gbt_v1.0_h{h}": {} for h in models})
    test = s.filter(~F.col("is_train"))
    out = None
    for h in models:
        loaded = model_store.load(spark, base, f"gbt_v1.0_h{h}")
        try:
            loaded.predict(test.drop(loaded.features[0]))
            refused = False
        except ValueError as e:
            refused = loaded.features[0] in str(e)
        p = loaded.predict(test.filter(F.col("horizonte_dias") == h)).withColumn("columnas_exigidas", F.lit(refused))
        out = p if out is None else out.unionByName(p)
    key = ["activo_id", "fecha_corte", "horizonte_dias"]
    before = _test_predictions(spark, d, "gbt").select(*key, F.col("probabilidad_falla").alias("_before"))
    p = F.col("probabilidad_falla")
    return out.join(before, key, "left").select(*key, F.coalesce(p == F.col("_before"), F.lit(False)).alias("igual"), p.between(0, 1).alias("en_rango"), "columnas_exigidas")
