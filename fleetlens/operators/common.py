"""Shared fleet building blocks (J*/W* specialisations used by many operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import latest_per_key


def latest_score(sr: DataFrame, horizon: int | None = None) -> DataFrame:
    """Latest score per asset (ties: higher scoring_id), optionally of one horizon."""
    s = sr if horizon is None else sr.filter(F.col("horizonte_dias") == horizon)
    return latest_per_key(s, "activo_id", [F.col("fecha_scoring").desc(), F.col("scoring_id").desc()])


def latest_order(ot: DataFrame) -> DataFrame:
    """Latest opened order per asset (ties: higher ot_id)."""
    return latest_per_key(ot, "activo_id", [F.col("fecha_apertura").desc(), F.col("ot_id").desc()])


def events_with_system(ev: DataFrame, tax: DataFrame, ot: DataFrame | None = None) -> DataFrame:
    """J1 + J6: events joined to the taxonomy; with ``ot``, asset/date fall back to the order's."""
    e = ev.join(tax.select("taxonomia_id", "sistema", "componente"), "taxonomia_id")
    if ot is None:
        return e
    o = ot.select("ot_id", F.col("activo_id").alias("_ot_asset"), F.col("fecha_apertura").alias("_ot_open"))
    return (
        e.join(o, "ot_id", "left")
        .withColumn("activo_ef", F.coalesce("activo_id", "_ot_asset"))
        .withColumn("fecha_ef", F.coalesce(F.to_timestamp_ntz(F.col("fecha_evento")), F.col("_ot_open")))
        .drop("_ot_asset", "_ot_open")
    )


def latest_event_system(ev: DataFrame, tax: DataFrame, key: str = "activo_id") -> DataFrame:
    """System of the latest event per ``key`` by event date, NULL dates last.

    Ties: higher id_evento, then higher taxonomia_id (event ids repeat when
    an order line is duplicated)."""
    e = events_with_system(ev, tax).filter(F.col(key).isNotNull())
    return latest_per_key(e, key, event_order()).select(key, "sistema")


def event_order(date_col: str = "fecha_evento"):
    return [F.col(date_col).desc_nulls_last(), F.col("id_evento").desc(), F.col("taxonomia_id").desc()]


EVENT_ORDER_SQL = "fecha_evento DESC NULLS LAST, id_evento DESC, taxonomia_id DESC"
