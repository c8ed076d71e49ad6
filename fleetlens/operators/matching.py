"""Feedback matching (B1-B7): label corrective orders against prior scores.

The reference indexes scores in a Python dict of sorted lists and scans it
per order; here that is the bucketed as-of join of ``joins.py``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import lower_in
from .joins import asof_join


def order_systems(ot: DataFrame, ev: DataFrame, tax: DataFrame, as_of: dt.date, days: int = 365) -> DataFrame:
    """B1: corrective orders of the window with the (sorted) set of their lower-cased event systems."""
    o = ot.filter(lower_in("tipo_ot", vocab.CORRECTIVE)
                  & (F.col("fecha_apertura") >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")))
    e = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id").select(
        "ot_id", F.lower(F.nullif(F.trim("sistema"), F.lit(""))).alias("s"))
    j = o.select("ot_id", "activo_id", F.to_date("fecha_apertura").alias("fecha_apertura")).join(e, "ot_id", "left")
    return j.groupBy("ot_id", "activo_id", "fecha_apertura").agg(F.sort_array(F.collect_set("s")).alias("sistemas"))


def prior_score(orders: DataFrame, sr: DataFrame, days: int = 30, horizon: int = 30) -> DataFrame:
    """Per order, the latest score of the horizon with ``fecha_ot - days <= fecha_scoring < fecha_ot``."""
    s = sr.filter(F.col("horizonte_dias") == horizon).select("activo_id", "scoring_id", "fecha_scoring", "prioridad",
                                                             "sistema_en_riesgo")
    return asof_join(orders, s, "activo_id", "fecha_apertura", "fecha_scoring", -days, 0, True, False, "last",
                     ["scoring_id", "fecha_scoring", "prioridad", "sistema_en_riesgo"], tie=["scoring_id"])


def match_class(systems: str = "sistemas", predicted: str = "sistema_en_riesgo"):
    """sin_clasificar (no systems) / sistema_match / sistema_mismatch."""
    sp = F.lower(F.trim(F.coalesce(F.col(predicted), F.lit(""))))
    return (F.when(F.size(systems) == 0, "sin_clasificar")
            .when((sp != "") & F.array_contains(F.col(systems), sp), "sistema_match").otherwise("sistema_mismatch"))


def label_orders(os_: DataFrame, sr: DataFrame, days: int = 30) -> DataFrame:
    """B2 + B3: TP (prior score P1/P2), FN (P3/P4) or no prior score, with the match class."""
    j = prior_score(os_, sr, days)
    label = (F.when(F.col("scoring_id").isNull(), "sin_scoring_previo")
             .when(F.col("prioridad").isin(*vocab.URGENT), "TP").otherwise("FN"))
    return j.select("ot_id", "activo_id", "fecha_apertura", "scoring_id", "prioridad", "sistema_en_riesgo",
                    label.alias("etiqueta"), F.when(F.col("scoring_id").isNotNull(), match_class()).alias("tipo_match"))


def real_frontier(sr: DataFrame, as_of: dt.date, days: int = 14) -> DataFrame:
    """Earliest score date within the last ``days`` days."""
    return sr.filter(F.col("fecha_scoring") >= F.lit(as_of - dt.timedelta(days=days))).agg(
        F.min("fecha_scoring").alias("primer_real"))


def open_alerts(sr: DataFrame, labels: DataFrame, as_of: dt.date, review_age: int = 2, horizon: int = 30) -> DataFrame:
    """P1/P2 scores from the frontier on that no order claimed, with age and review state."""
    used = labels.filter(F.col("scoring_id").isNotNull()).select("scoring_id").distinct()
    s = sr.filter((F.col("horizonte_dias") == horizon) & F.col("prioridad").isin(*vocab.URGENT))
    s = s.crossJoin(F.broadcast(real_frontier(sr, as_of))).filter(F.col("fecha_scoring") >= F.col("primer_real"))
    s = s.join(used, "scoring_id", "left_anti")
    age = F.datediff(F.lit(as_of), F.col("fecha_scoring"))
    return s.select("scoring_id", "activo_id", "fecha_scoring", age.alias("edad_dias"),
                    F.when(age > review_age, "FP_revisada").otherwise("pendiente").alias("estado"))


def label_metrics(labels: DataFrame, alerts: DataFrame) -> DataFrame:
    """recall = TP / (TP + FN), precision = TP / (TP + reviewed false positives)."""
    l = labels.agg(F.count(F.when(F.col("etiqueta") == "TP", 1)).alias("tp"),
                   F.count(F.when(F.col("etiqueta") == "FN", 1)).alias("fn"))
    a = alerts.agg(F.count(F.when(F.col("estado") == "FP_revisada", 1)).alias("fp"),
                   F.count(F.when(F.col("estado") == "pendiente", 1)).alias("pendientes"))
    j = l.crossJoin(a)
    return j.select("tp", "fn", "fp", "pendientes",
                    F.round(F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))), 9).alias("recall"),
                    F.round(F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))), 9).alias("precision"))


def next_corrective(days_df: DataFrame, ot: DataFrame, day_col: str, days: int = 30) -> DataFrame:
    """Per (asset, day) row, the first corrective order opened in (day, day + days]."""
    o = ot.filter(lower_in("tipo_ot", vocab.CORRECTIVE)).select(
        "activo_id", F.col("ot_id").alias("ot_siguiente"), F.to_date("fecha_apertura").alias("fecha_ot_siguiente"))
    return asof_join(days_df, o, "activo_id", day_col, "fecha_ot_siguiente", 0, days, False, True, "first",
                     ["ot_siguiente", "fecha_ot_siguiente"], tie=["ot_siguiente"])


def load_feedback(fb: DataFrame, sr: DataFrame, ot: DataFrame, days: int = 30) -> DataFrame:
    """B7 (spec only in the reference): link feedback to its order when missing - the first corrective
    order of the asset in (alert, alert + days] - keeping existing links (S6-style coalesce)."""
    linked = next_corrective(fb, ot, "fecha_alerta", days)
    return linked.withColumn("ot_id", F.coalesce("ot_id", "ot_siguiente")).drop("ot_siguiente", "fecha_ot_siguiente")
