"""Scoring post-process (F4-F6, R1-R7): system at risk, post-intervention decay,
horizon coherence and the end-to-end daily scoring run.

All of it is joins and ``when`` chains on ``activo_id``; the reference's
row-wise ``apply`` and Python loop over assets become column expressions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.columns import binary_prediction, norm, priority
from .windows import latest_per_key


def thresholds_for(th: DataFrame, version: str, as_of: dt.date | None = None) -> DataFrame:
    """the latest active threshold row of a model version (1 row), else the defaults.

    Returns one row (p1, p2, p3); it is tiny by construction and is
    cross-joined (broadcast) onto the scores.
    """
    t = th.filter((F.col("modelo_version") == version) & (F.col("activo") == F.lit(True)))
    if as_of is not None:
        t = t.filter(F.col("fecha_vigencia") <= F.lit(as_of))
    best = t.agg(F.max_by(F.struct("p1_critica", "p2_alta", "p3_media"), F.col("fecha_vigencia")).alias("b"))
    d = vocab.DEFAULT_THRESHOLDS
    return best.select(
        F.coalesce(F.col("b.p1_critica"), F.lit(d["p1"])).alias("p1"),
        F.coalesce(F.col("b.p2_alta"), F.lit(d["p2"])).alias("p2"),
        F.coalesce(F.col("b.p3_media"), F.lit(d["p3"])).alias("p3"),
    )


def with_thresholds(df: DataFrame, th_row: DataFrame | Mapping[str, float] | None) -> tuple[DataFrame, dict]:
    """Attach threshold columns (from a 1-row frame) or return literal thresholds."""
    if isinstance(th_row, DataFrame):
        return df.crossJoin(F.broadcast(th_row)), {"p1": F.col("p1"), "p2": F.col("p2"), "p3": F.col("p3")}
    return df, dict(th_row or vocab.DEFAULT_THRESHOLDS)


def risk_system(ev: DataFrame, tax: DataFrame, ot: DataFrame, as_of: dt.date) -> DataFrame:
    """Per asset, the system of the latest classified event with effective date <= as_of.

    Asset and date fall back to the event's order (J6): only events that lack one of them meet the orders; the others are
    filtered by date in the scan."""
    systems = tax.select("taxonomia_id", "sistema").filter(F.col("sistema").isNotNull() & (F.trim("sistema") != ""))
    own = F.col("activo_id").isNotNull() & F.col("fecha_evento").isNotNull()
    kept = ["activo_id", "fecha_ef", "taxonomia_id", "id_evento"]
    whole = ev.filter(own & (F.col("fecha_evento") <= F.lit(as_of))).withColumn("fecha_ef", F.col("fecha_evento")).select(*kept)
    o = ot.select("ot_id", F.col("activo_id").alias("_oa"), F.to_date("fecha_apertura").alias("_od"))
    rest = ev.filter(~own & (F.col("fecha_evento").isNull() | (F.col("fecha_evento") <= F.lit(as_of)))).join(o, "ot_id").select(
        F.coalesce("activo_id", "_oa").alias("activo_id"), F.coalesce("fecha_evento", "_od").alias("fecha_ef"), "taxonomia_id", "id_evento")
    rest = rest.filter(F.col("activo_id").isNotNull() & F.col("fecha_ef").isNotNull() & (F.col("fecha_ef") <= F.lit(as_of)))
    e = whole.unionByName(rest).join(systems, "taxonomia_id")
    latest = latest_per_key(e, "activo_id", [F.col("fecha_ef").desc(), F.col("id_evento").desc(), F.col("taxonomia_id").desc()])
    return latest.select("activo_id", F.col("sistema").alias("sistema_en_riesgo"))


def dominant_type(ot: DataFrame, ev: DataFrame, as_of: dt.date) -> DataFrame:
    """R2: per order closed on or before ``as_of``: predictiva > correctiva > preventiva (from its events)."""
    closed = ot.filter(F.col("fecha_cierre").isNotNull() & (F.to_date("fecha_cierre") <= F.lit(as_of))
                       & F.col("activo_id").isNotNull()).select("ot_id", "activo_id", F.to_date("fecha_cierre").alias("fecha_cierre"))
    e = ev.select("ot_id", norm("tipo_mantenimiento").alias("t")).join(closed.select("ot_id"), "ot_id")
    g = e.groupBy("ot_id").agg(
        F.bool_or(F.col("t").isin(*vocab.PREDICTIVE)).alias("_pred"),
        F.bool_or(F.col("t").isin(*vocab.CORRECTIVE)).alias("_corr"),
        F.bool_or(F.col("t").isin(*vocab.PREVENTIVE_WITH_INSPECTION)).alias("_prev"),
    )
    tipo = (F.when(F.col("_pred"), "predictiva").when(F.col("_corr"), "correctiva")
            .when(F.col("_prev"), "preventiva"))
    return g.join(closed, "ot_id").select("ot_id", "activo_id", "fecha_cierre", tipo.alias("tipo_dominante"))


def last_intervention(ot: DataFrame, ev: DataFrame, as_of: dt.date) -> DataFrame:
    """Latest closed order per asset whose dominant type is corrective or predictive;
    on the same close date predictive wins (then higher ot_id)."""
    d = dominant_type(ot, ev, as_of).filter(F.col("tipo_dominante").isin("correctiva", "predictiva"))
    rank = F.when(F.col("tipo_dominante") == "predictiva", 1).when(F.col("tipo_dominante") == "correctiva", 2).otherwise(9)
    return latest_per_key(d, "activo_id", [F.col("fecha_cierre").desc(), rank.asc(), F.col("ot_id").desc()])


def apply_decay(scores: DataFrame, last: DataFrame, thresholds: DataFrame | Mapping[str, float] | None = None) -> DataFrame:
    """P1/P2 scores of assets with a corrective/predictive order closed 0..window days before the
    score date get probability x factor; priority re-bucketed; 4 trace columns. ``prediccion`` is kept."""
    li = last.select("activo_id", F.col("fecha_cierre").alias("_fc"), F.col("tipo_dominante").alias("_tipo"))
    s, th = with_thresholds(scores.join(li, "activo_id", "left"), thresholds)
    days = F.datediff(F.col("fecha_scoring"), F.col("_fc"))
    window = F.lit(None).cast("int")
    factor = F.lit(None).cast("double")
    for tipo in ("predictiva", "correctiva"):
        window = F.when(F.col("_tipo") == tipo, F.lit(vocab.DECAY_WINDOW_DAYS[tipo])).otherwise(window)
        factor = F.when(F.col("_tipo") == tipo, F.lit(vocab.DECAY_FACTOR[tipo])).otherwise(factor)
    applies = (F.col("prioridad").isin(*vocab.URGENT) & F.col("_fc").isNotNull() & window.isNotNull()
               & (days >= 0) & (days <= window))
    applies = F.coalesce(applies, F.lit(False))
    p = F.when(applies, F.col("probabilidad_falla") * factor).otherwise(F.col("probabilidad_falla"))
    out = (s.withColumn("prioridad_pre_decay", F.col("prioridad"))
            .withColumn("ajuste_intervencion_reciente", applies)
            .withColumn("tipo_mant_atenuacion", F.when(applies, F.col("_tipo")))
            .withColumn("dias_desde_intervencion", F.when(applies, days))
            .withColumn("probabilidad_falla", p))
    out = out.withColumn("prioridad", priority("probabilidad_falla", th))
    return out.drop("_fc", "_tipo", "p1", "p2", "p3")


def horizon_coherence(scores: DataFrame) -> DataFrame:
    """When p7 > p30 (strictly) for an asset and date, h30 takes h7's probability, priority and system."""
    h7 = scores.filter(F.col("horizonte_dias") == 7).select(
        "activo_id", "fecha_scoring", F.col("probabilidad_falla").alias("_p7"), F.col("prioridad").alias("_pr7"),
        F.col("sistema_en_riesgo").alias("_s7"))
    j = scores.join(h7, ["activo_id", "fecha_scoring"], "left")
    swap = (F.col("horizonte_dias") == 30) & F.col("_p7").isNotNull() & (F.col("_p7") > F.col("probabilidad_falla"))
    return (j.withColumn("prioridad", F.when(swap, F.col("_pr7")).otherwise(F.col("prioridad")))
             .withColumn("sistema_en_riesgo", F.when(swap, F.col("_s7")).otherwise(F.col("sistema_en_riesgo")))
             .withColumn("probabilidad_falla", F.when(swap, F.col("_p7")).otherwise(F.col("probabilidad_falla")))
             .drop("_p7", "_pr7", "_s7"))


def score_day(panel_at_date: DataFrame, predict: Callable[[DataFrame], DataFrame], ev: DataFrame, tax: DataFrame,
              ot: DataFrame, date: dt.date, thresholds: DataFrame | Mapping[str, float] | None = None,
              class_threshold: float | Mapping[int, float] = 0.5, version: str = "v1.0") -> DataFrame:
    """One day's scores for all horizons: predict -> F4/F6 -> R1 -> R4 -> R5.

    ``predict(features)`` returns (activo_id, horizonte_dias, probabilidad_falla); it is a Spark ML
    model's transform in production (``ml.predict``) and a deterministic formula in the oracle test.
    """
    p = predict(panel_at_date)
    if isinstance(class_threshold, Mapping):
        thr = F.lit(None).cast("double")
        for h, v in class_threshold.items():
            thr = F.when(F.col("horizonte_dias") == h, F.lit(float(v))).otherwise(thr)
    else:
        thr = F.lit(float(class_threshold))
    s, th = with_thresholds(p, thresholds)
    s = s.select(
        "activo_id", F.lit(date).alias("fecha_scoring"), "horizonte_dias", "probabilidad_falla",
        binary_prediction("probabilidad_falla", thr).alias("prediccion"),
        priority("probabilidad_falla", th).alias("prioridad"),
        F.lit(version).alias("modelo_version"),
    )
    s = s.join(risk_system(ev, tax, ot, date), "activo_id", "left").withColumn(
        "sistema_en_riesgo", F.coalesce("sistema_en_riesgo", F.lit(vocab.NO_HISTORY_SYSTEM)))
    s = apply_decay(s, last_intervention(ot, ev, date), thresholds)
    return horizon_coherence(s)


def score_summary(scores: DataFrame) -> DataFrame:
    """R6 summary: per horizon and priority: count and % of the horizon."""
    tot = scores.groupBy("horizonte_dias").agg(F.count(F.lit(1)).alias("_t"))
    g = scores.groupBy("horizonte_dias", "prioridad").agg(F.count(F.lit(1)).alias("n"))
    return g.join(tot, "horizonte_dias").select(
        "horizonte_dias", "prioridad", "n", F.round(F.col("n") * 100.0 / F.col("_t"), 6).alias("pct"))


def stand_in_probability(panel: DataFrame) -> DataFrame:
    """A deterministic, SQL-expressible probability used to test R6 without a trained model."""
    # dyadic weights: exact in binary floating point, so every engine gets identical values
    x = (F.greatest(F.col("count_ot_90d"), F.lit(0)) * 0.125 + F.greatest(F.col("count_correctivas_90d"), F.lit(0)) * 0.1875
         + F.col("horizonte_dias") / 256.0)
    return panel.select("activo_id", "horizonte_dias", F.least(x, F.lit(1.0)).alias("probabilidad_falla"))


def score_day_simple(panel_at_date: DataFrame, predict: Callable[[DataFrame], DataFrame], date: dt.date,
                     version: str = "v1.0") -> DataFrame:
    """Legacy scoring: predict + F4 with the .85/.65/.40 thresholds, no post-process."""
    p = predict(panel_at_date)
    return p.select("activo_id", F.lit(date).alias("fecha_scoring"), "horizonte_dias", "probabilidad_falla",
                    priority("probabilidad_falla", vocab.LEGACY_THRESHOLDS).alias("prioridad"),
                    F.lit(version).alias("modelo_version"))

