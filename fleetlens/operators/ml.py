"""Model training, evaluation and registry (M1-M12) with Spark ML.

Training and inference are Spark ML pipelines (``VectorAssembler`` +
``GBTClassifier`` / ``RandomForestClassifier``). The evaluation operators
(threshold search, AUC, precision/recall/F1) are plain aggregations over
(score, label) so they are exact, distributed and SQL-checkable: per distinct
score the positive/negative counts, then running totals in score order.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .windows import chrono_split, running_totals  # noqa: F401  (running_totals re-exported)

#: Panel rows of one task: where there are more, the forest's training and all inference deal them evenly over the cores, up to
#: TASK_ROWS_MOST a task.
FOREST_TASK_ROWS, BOOST_TASK_ROWS, TASK_ROWS_MOST = 20_000, 100_000, 1_000_000

ID_COLS = ("target", "activo_id", "fecha_corte", "horizonte_dias", "patente", "marca", "modelo", "tipo_vehiculo",
           "fecha_alta_flota", "is_train")


def short_names(cols: Sequence[str]) -> dict[str, str]:
    """long -> short feature names (count_ot_7d -> ot_7d, count_correctivas_7d -> corr_7d, costo_total_7d -> costo_7d)."""
    out = {}
    for c in cols:
        if c.startswith("count_ot_"):
            out[c] = "ot_" + c.split("_")[-1]
        elif c.startswith("count_correctivas_"):
            out[c] = "corr_" + c.split("_")[-1]
        elif c.startswith("costo_total_"):
            out[c] = "costo_" + c.split("_")[-1]
    return out


def feature_columns(panel: DataFrame) -> list[str]:
    return [c for c in panel.columns if c not in ID_COLS]


def to_short(panel: DataFrame) -> DataFrame:
    return panel.withColumnsRenamed(short_names(panel.columns))


def chrono_panel(panel: DataFrame, train_frac: float = 0.7) -> DataFrame:
    """``is_train`` = first int(n * 0.7) rows per horizon in (cut-off, asset) order."""
    return chrono_split(panel, "horizonte_dias", "fecha_corte", "activo_id", train_frac)


def class_weights(train: DataFrame) -> DataFrame:
    """M3: per horizon n_neg / max(1, n_pos) on the training rows."""
    return train.groupBy("horizonte_dias").agg(
        F.count(F.when(F.col("target") == 0, 1)).alias("n_neg"),
        F.count(F.when(F.col("target") == 1, 1)).alias("n_pos"),
    ).withColumn("peso_positivo", F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)))


def _weighted(train: DataFrame) -> DataFrame:
    w = class_weights(train).select("horizonte_dias", "peso_positivo")
    return train.join(F.broadcast(w), "horizonte_dias").withColumn(
        "w", F.when(F.col("target") == 1, F.col("peso_positivo")).otherwise(F.lit(1.0)))


def dealt(data: DataFrame, task_rows: int) -> DataFrame:
    """Panel rows in even tasks. The chronological split leaves a horizon's training or test rows in a few of its ranges, and
    a fit passes over them once for every level of its trees. What one task can hold stays where it is. The order inside
    a task is told, since the trees' samples are drawn along it."""
    n = data.count()
    if n <= task_rows:
        return data
    cores = data.sparkSession.sparkContext.defaultParallelism
    tasks = -(-n // task_rows)
    if tasks > cores:  # a whole number of tasks for each core: one task over would leave the others idle in every pass
        tasks = cores * max(1, -(-n // (TASK_ROWS_MOST * cores)))
    return data.repartition(tasks, "activo_id", "fecha_corte", "horizonte_dias").sortWithinPartitions(*data.columns)


def _assembler(cols: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def train_gbt(train: DataFrame, features: Sequence[str], max_iter: int = 200, seed: int = 42) -> PipelineModel:
    """M1: boosted trees (depth 5, step .1, subsample .8, feature subset .8, positive weight n_neg/n_pos,
    NULL -> -1). Checkpoints go to the session's shared checkpoint folder."""
    checkpoint_dir(train.sparkSession)
    data = _weighted(train.fillna(-1, subset=list(features)))
    gbt = GBTClassifier(labelCol="target", featuresCol="features", weightCol="w", maxIter=max_iter, maxDepth=5,
                        stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
                        checkpointInterval=10, cacheNodeIds=False)
    return Pipeline(stages=[_assembler(features), gbt]).fit(data)


def train_rf(train: DataFrame, features: Sequence[str], num_trees: int = 200, seed: int = 42) -> PipelineModel:
    """M2: random forest (200 trees, depth 15, leaf 3, balanced class weights). Every row's nodes are kept between the
    passes, which would else walk each row down all trees again; the trees are the same."""
    checkpoint_dir(train.sparkSession)
    data = dealt(_weighted(train.fillna(-1, subset=list(features))), FOREST_TASK_ROWS)
    rf = RandomForestClassifier(labelCol="target", featuresCol="features", weightCol="w", numTrees=num_trees,
                                maxDepth=15, minInstancesPerNode=3, seed=seed, cacheNodeIds=True)
    return Pipeline(stages=[_assembler(features), rf]).fit(data)


def predict(model: PipelineModel, panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Check the feature columns, NULL -> -1, P(class 1) as ``probabilidad_falla``."""
    missing = [c for c in features if c not in panel.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    out = model.transform(panel.fillna(-1, subset=list(features)))
    if "probability" not in out.columns:  # a rule pipeline names its result itself
        return out
    return out.withColumn("probabilidad_falla", vector_to_array("probability")[1]).drop("features", "rawPrediction",
                                                                                         "probability", "prediction")


# ---------------------------------------------------------------- evaluation
def score_counts(scored: DataFrame, group: str = "horizonte_dias", score: str = "score", label: str = "target") -> DataFrame:
    """Per (group, distinct score): positives and negatives (a partial aggregate: skew-safe)."""
    return scored.groupBy(group, score).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))


def best_threshold(scored: DataFrame, target_recall: float = 0.70, group: str = "horizonte_dias",
                   score: str = "score") -> DataFrame:
    """M5: the PR-curve threshold: among thresholds with recall >= target the highest precision (lowest
    threshold on ties); if none qualifies, the highest F1 (+1e-10 in the denominator)."""
    c = score_counts(scored, group, score)
    r = running_totals(c, group, score, ["pos", "neg"], descending=True)
    totals = c.groupBy(group).agg(F.sum("pos").alias("P"))  # one row per group
    r = r.join(F.broadcast(totals), group)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(F.col("P") > 0, tp / F.col("P")).otherwise(F.lit(1.0))
    r = r.withColumn("precision", prec).withColumn("recall", rec).withColumn(
        "f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-10)))
    valid = r.filter(F.col("recall") >= target_recall).groupBy(group).agg(
        F.max_by(F.col(score), F.struct(F.col("precision"), -F.col(score))).alias("thr_recall"))
    f1 = r.groupBy(group).agg(F.max_by(F.col(score), F.struct(F.col("f1"), -F.col(score))).alias("thr_f1"))
    return f1.join(valid, group, "left").select(group, F.coalesce("thr_recall", "thr_f1").alias("threshold_optimo"))


def auc(scored: DataFrame, group: str = "horizonte_dias", score: str = "score") -> DataFrame:
    """M6: ROC AUC with average ranks for ties: sum over scores of pos x (negatives below + half the tied)."""
    c = score_counts(scored, group, score)
    r = running_totals(c, group, score, ["neg"], descending=False)
    num2 = F.sum(F.col("pos") * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")))
    return r.groupBy(group).agg(num2.alias("_n2"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q")).select(
        group, F.when((F.col("_p") > 0) & (F.col("_q") > 0),
                      F.round(F.col("_n2") / (2.0 * F.col("_p") * F.col("_q")), 12)).alias("auc"))


def prf(scored: DataFrame, thresholds: DataFrame | float, group: str = "horizonte_dias", score: str = "score") -> DataFrame:
    """M7: precision / recall / F1 at a threshold (0 on zero division)."""
    if isinstance(thresholds, DataFrame):
        s = scored.join(F.broadcast(thresholds), group)
        thr = F.col("threshold_optimo")
    else:
        s, thr = scored, F.lit(float(thresholds))
    pred = F.col(score) >= thr
    y = F.col("target") == 1
    g = s.groupBy(group).agg(F.count(F.when(pred & y, 1)).alias("tp"), F.count(F.when(pred & ~y, 1)).alias("fp"),
                             F.count(F.when(~pred & y, 1)).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(group, "tp", "fp", "fn",
                    F.round(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), 12).alias("precision"),
                    F.round(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0), 12).alias("recall"),
                    F.round(F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0), 12).alias("f1"))


def importance(spark: SparkSession, model: PipelineModel, features: Sequence[str], n: int = 10) -> DataFrame:
    """M8: top-``n`` feature importances (the vector has one entry per feature: bounded)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda x: (-x[1], x[0]))[:n]
    return spark.createDataFrame(rows, "feature string, importance double")


def metadata(spark: SparkSession, version: str, horizon: int, features: Sequence[str], params: dict, n_train: int,
             n_test: int, threshold: float, metrics: dict) -> DataFrame:
    """M9: the training record as a one-row frame (JSON columns for the nested parts)."""
    row = (version, horizon, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), n_train, n_test, len(features),
           list(features), json.dumps(params, sort_keys=True), float(threshold), json.dumps(metrics, sort_keys=True))
    return spark.createDataFrame([row], "version string, horizonte_dias int, fecha_entrenamiento timestamp, n_train bigint, "
                                        "n_test bigint, n_features int, feature_cols array<string>, hiperparametros string, "
                                        "threshold_optimo double, metricas string")


# ---------------------------------------------------------------- registry
REGISTRY_SCHEMA = ("modelo_id string, version string, nombre_archivo string, fecha_entrenamiento date, "
                   "fecha_creacion timestamp, auc_score double, precision double, recall double, f1_score double, "
                   "n_samples_train int, n_features int, features_utilizadas array<string>, hiperparametros string, "
                   "estado string, es_activo boolean")


def registry_register(reg: DataFrame, row: dict) -> DataFrame:
    """M10 register: append a new, inactive model row."""
    new = reg.sparkSession.createDataFrame([{**row, "estado": "entrenado", "es_activo": False}], REGISTRY_SCHEMA)
    return reg.unionByName(new.select(*reg.columns))


def registry_activate(reg: DataFrame, modelo_id: str) -> DataFrame:
    """M10 activate: exactly this model active. An unknown id is refused (the source would leave no model active)."""
    if reg.filter(F.col("modelo_id") == F.lit(modelo_id)).isEmpty():
        raise ValueError(f"no registered model {modelo_id}")
    return reg.withColumn("es_activo", F.col("modelo_id") == F.lit(modelo_id))


def registry_list(reg: DataFrame) -> DataFrame:
    """M10 list: every model's id, version, dates, scores and state, the newest first by ``fecha_creacion``."""
    return reg.select("modelo_id", "version", "fecha_entrenamiento", "fecha_creacion", "auc_score", "precision", "recall",
                      "f1_score", "estado", "es_activo").orderBy(F.col("fecha_creacion").desc_nulls_last(), F.col("modelo_id"))


def registry_active(reg: DataFrame) -> DataFrame:
    """M10 active: the latest active model."""
    a = reg.filter(F.col("es_activo"))
    return a.orderBy(F.col("fecha_creacion").desc(), F.col("modelo_id").desc()).limit(1)


def model_precision(reg: DataFrame, sr: DataFrame, fb: DataFrame) -> DataFrame:
    """Per registered version: feedback rows, confirmed hits and precision %."""
    j = reg.select(F.col("version").alias("modelo_version"), "fecha_entrenamiento") \
        .join(sr.select("modelo_version", "scoring_id"), "modelo_version", "left") \
        .join(fb.select("scoring_id", "feedback_id", "falla_confirmada"), "scoring_id", "left")
    hits = F.sum(F.when(F.col("falla_confirmada") == F.lit(True), 1).otherwise(0))
    n = F.count("feedback_id")
    return j.groupBy("modelo_version", "fecha_entrenamiento").agg(
        n.alias("total_predicciones"), hits.cast("bigint").alias("aciertos"),
        F.round(F.lit(100.0) * hits / F.nullif(n, F.lit(0)), 2).alias("precision_porcentaje"))


def recall_precision_active(reg: DataFrame) -> DataFrame:
    """Recall and precision (%) of the active model."""
    return registry_active(reg).select((F.col("recall") * 100).alias("recall_pct"), (F.col("precision") * 100).alias("precision_pct"))


#: A deterministic baseline over two features, exact in binary floating point, and the features it needs.
RULE = "least(1.0D, (greatest(count_ot_90d, 0) * 0.125D + greatest(count_correctivas_30d, 0) * 0.25D) / 4.0D)"
RULE_FEATURES = ("count_ot_90d", "count_correctivas_30d")


def stand_in_score(panel: DataFrame) -> Column:
    """The baseline rule as a column, which SQL reproduces."""
    return F.expr(RULE)
