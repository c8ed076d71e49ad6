"""Models that outlive their session.

A store is a shared folder. A saved model is a Spark ML pipeline with its training record, which names the feature
columns that it must be given. The registry is a small table, written whole into a new version folder and published by one
pointer, so a reader sees all of a registration or activation, or nothing. A model is always read back through it.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession

from ..sources.ingest import metadata_json, point_to, pointed
from . import ml

PROBABILITY = "probabilidad_falla"


def rule_model(spark: SparkSession, expression: str) -> PipelineModel:
    """A pipeline that computes ``probabilidad_falla`` by a SQL expression over the features: the baseline that trained models
    are compared with, stored and served as they are."""
    stage = SQLTransformer(statement=f"SELECT *, {expression} AS {PROBABILITY} FROM __THIS__")
    return Pipeline(stages=[stage]).fit(spark.range(0))


def _folder(base: str, modelo_id: str) -> str:
    return f"{base}/modelos/{modelo_id}"


def save(spark: SparkSession, base: str, modelo_id: str, model: PipelineModel, record: DataFrame) -> str:
    """M9: the pipeline and its one-row training record (``ml.metadata``) under the model's folder. A model id is written once."""
    document = json.loads(metadata_json(record)) | {"modelo_id": modelo_id}  # refuses anything but one row
    path = _folder(base, modelo_id)
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    model.save(f"{path}/pipeline")
    return path


def registry(spark: SparkSession, base: str) -> DataFrame:
    """The registry as last published; without one, an empty table."""
    version = pointed(spark, base)
    if version is None:
        return spark.createDataFrame([], ml.REGISTRY_SCHEMA)
    return spark.read.schema(ml.REGISTRY_SCHEMA).json(f"{base}/{version}")


def _publish(spark: SparkSession, base: str, rows: DataFrame) -> None:
    version = f"registro/{uuid.uuid4().hex}"
    rows.coalesce(1).write.json(f"{base}/{version}")
    point_to(spark, base, version)


def register(spark: SparkSession, base: str, models: Mapping[str, Mapping[str, float | None]], created: dt.datetime | None = None) -> None:
    """M10 register: the rows of saved models (id -> auc, precision, recall, f1), inactive, from their own training records.

    The n-th of them is created n seconds after ``created`` (now), so their order is told."""
    created = created or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    records = {r["modelo_id"]: r for line in spark.read.text([f"{_folder(base, m)}/metadata" for m in models]).collect() for r in [json.loads(line[0])]}
    reg = registry(spark, base)
    for i, (modelo_id, quality) in enumerate(models.items()):
        r = records[modelo_id]
        reg = ml.registry_register(reg, {
            "modelo_id": modelo_id, "version": r["version"], "nombre_archivo": f"modelos/{modelo_id}/pipeline", "fecha_entrenamiento": created.date(),
            "fecha_creacion": created + dt.timedelta(seconds=i), "auc_score": quality.get("auc"), "precision": quality.get("precision"),
            "recall": quality.get("recall"), "f1_score": quality.get("f1"), "n_samples_train": int(r["n_train"]), "n_features": int(r["n_features"]),
            "features_utilizadas": list(r["feature_cols"]), "hiperparametros": r["hiperparametros"]})
    _publish(spark, base, reg)


def activate(spark: SparkSession, base: str, modelo_id: str) -> None:
    """M10 activate: this model and no other; an unknown id is refused."""
    _publish(spark, base, ml.registry_activate(registry(spark, base), modelo_id))


@dataclass(frozen=True)
class Loaded:
    """A model read back through the registry, with its feature contract."""

    modelo_id: str
    version: str
    features: Sequence[str]
    pipeline: PipelineModel
    hyperparameters: dict

    def predict(self, panel: DataFrame) -> DataFrame:
        """P(failure) of each panel row. Missing feature columns are refused by name, NULL features are -1."""
        return ml.predict(self.pipeline, panel, self.features)


def load(spark: SparkSession, base: str, modelo_id: str | None = None) -> Loaded:
    """A registered model, the active one unless its id is given; an id that is not registered is refused."""
    reg = registry(spark, base)
    row = (ml.registry_active(reg) if modelo_id is None else reg.filter(reg.modelo_id == modelo_id)).first()
    if row is None:
        raise LookupError("no active model" if modelo_id is None else f"no registered model {modelo_id}")
    return Loaded(row["modelo_id"], row["version"], list(row["features_utilizadas"]), PipelineModel.load(f"{base}/{row['nombre_archivo']}"),
                  json.loads(row["hiperparametros"]))
