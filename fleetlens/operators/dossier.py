"""Asset dossier (G1-G4) for all assets at once: one grouped pass per source
table instead of one query per asset and per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import latest_order
from .windows import latest_per_key, top_n_per_key


def asset_status(a: DataFrame, sr: DataFrame, ot: DataFrame) -> DataFrame:
    """G1 (+W18): latest score (date desc, shortest horizon first), the three horizon probabilities of
    that date, the latest order and the maximum odometer, for every asset."""
    ls = latest_per_key(sr, "activo_id", [F.col("fecha_scoring").desc(), F.col("horizonte_dias").asc(),
                                          F.col("scoring_id").desc()]).select(
        "activo_id", "fecha_scoring", "probabilidad_falla", "prioridad", "sistema_en_riesgo", "horizonte_dias")
    multi = sr.join(ls.select("activo_id", F.col("fecha_scoring").alias("_f")), "activo_id") \
        .filter(F.col("fecha_scoring") == F.col("_f")) \
        .groupBy("activo_id").pivot("horizonte_dias", [7, 30, 90]).agg(F.max("probabilidad_falla"))
    multi = multi.select("activo_id", *[F.col(str(h)).alias(f"p{h}") for h in (7, 30, 90)])
    lo = latest_order(ot).select("activo_id", "ot_id", "fecha_apertura", "fecha_cierre", "tipo_ot", "costo_total_clp")
    odo = ot.groupBy("activo_id").agg(F.max("odometro_km").alias("_odo"))
    return (a.select("activo_id", "patente").join(ls, "activo_id", "left").join(multi, "activo_id", "left")
            .join(lo, "activo_id", "left").join(odo, "activo_id", "left")
            .withColumn("odometro_actual", F.coalesce("_odo", F.lit(0.0))).drop("_odo"))


def asset_stats(ot: DataFrame) -> DataFrame:
    """Orders, preventive, corrective, cost, span days, mean days between orders, MTBF days."""
    t = F.lower("tipo_ot")
    g = ot.groupBy("activo_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(t == "preventiva", 1)).alias("preventivas"),
        F.count(F.when(t == "correctiva", 1)).alias("correctivas"),
        F.coalesce(F.sum(F.col("costo_total_clp").cast("decimal(38,2)")).cast("double"), F.lit(0.0)).alias("costo_total"),
        F.coalesce(F.datediff(F.max(F.to_date("fecha_apertura")), F.min(F.to_date("fecha_apertura"))), F.lit(0)).alias("dias_periodo"),
    )
    ok = (F.col("total") > 1) & (F.col("dias_periodo") > 0)
    return g.select("*",
                    F.when(ok, F.round(F.col("dias_periodo") / (F.col("total") - 1), 9)).alias("promedio_dias_entre_ot"),
                    F.when(ok, F.when(F.col("correctivas") > 0, F.round(F.col("dias_periodo") / F.col("correctivas"), 9))
                           .otherwise(F.lit(0.0))).alias("mtbf_dias"))


def asset_top_parts(ot: DataFrame, rc: DataFrame, n: int = 10) -> DataFrame:
    """Per asset the ``n`` SKUs with the highest quantity over its orders (IN-subquery -> join)."""
    j = rc.join(ot.select("ot_id", "activo_id"), "ot_id")
    g = j.groupBy("activo_id", "sku").agg(F.sum(F.col("cantidad").cast("decimal(38,4)")).cast("double").alias("total_qty"))
    return top_n_per_key(g, "activo_id", [F.col("total_qty").desc(), F.col("sku")], n, "rank")


def asset_top_systems(ev: DataFrame, tax: DataFrame, ot: DataFrame, n: int = 5) -> DataFrame:
    """Per asset (event's own, else its order's) the ``n`` systems with the most distinct events."""
    e = ev.join(tax.select("taxonomia_id", "sistema"), "taxonomia_id") \
        .join(ot.select("ot_id", F.col("activo_id").alias("_oa")), "ot_id", "left") \
        .withColumn("_asset", F.coalesce("activo_id", "_oa")).filter(F.col("_asset").isNotNull())
    g = e.groupBy(F.col("_asset").alias("activo_id"), "sistema").agg(
        F.count_distinct("id_evento").alias("eventos"), F.count_distinct("ot_id").alias("ots"))
    return top_n_per_key(g, "activo_id", [F.col("eventos").desc(), F.col("sistema")], n, "rank")


def asset_history(ot: DataFrame, ev: DataFrame, tax: DataFrame, rc: DataFrame) -> DataFrame:
    """One row per order (newest first per asset) with arrays of its events and parts.

    Arrays are built per order (bounded by the order's lines), never per asset."""
    evs = ev.join(tax.select("taxonomia_id", "sistema", "componente"), "taxonomia_id", "left").groupBy("ot_id").agg(
        F.sort_array(F.collect_list(F.struct("id_evento", "taxonomia_id", "sistema", "componente", "severidad",
                                             "tipo_mantenimiento", "fecha_evento"))).alias("eventos"))
    parts = rc.groupBy("ot_id").agg(
        F.sort_array(F.collect_list(F.struct("sku", "cantidad", "costo_unitario_clp"))).alias("repuestos"))
    o = ot.select("activo_id", "ot_id", "fecha_apertura", "fecha_cierre", "tipo_ot", "costo_total_clp")
    return o.join(evs, "ot_id", "left").join(parts, "ot_id", "left") \
        .withColumn("eventos", F.coalesce("eventos", F.array().cast("array<struct<id_evento:bigint,taxonomia_id:string,sistema:string,componente:string,severidad:string,tipo_mantenimiento:string,fecha_evento:date>>"))) \
        .withColumn("repuestos", F.coalesce("repuestos", F.array().cast("array<struct<sku:string,cantidad:double,costo_unitario_clp:double>>")))
