"""G* (asset dossier) and B*/J8/J9 (feedback matching) queries and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import dossier as G
from ..operators import matching as B
from ..sources.fixtures import AS_OF, fleet
from .registry import register

CORR = "('correctiva', 'correctivo', 'emergency')"


def F_(spark, d):
    return fleet(spark, d)


@register("G1_asset_status", """
WITH ls AS (SELECT activo_id, fecha_scoring, probabilidad_falla, prioridad, sistema_en_riesgo, horizonte_dias
            FROM scoring_resultados QUALIFY row_number() OVER (PARTITION BY activo_id
              ORDER BY fecha_scoring DESC, horizonte_dias ASC, scoring_id DESC) = 1),
mh AS (SELECT s.activo_id, max(CASE WHEN s.horizonte_dias = 7 THEN s.probabilidad_falla END) AS p7,
         max(CASE WHEN s.horizonte_dias = 30 THEN s.probabilidad_falla END) AS p30,
         max(CASE WHEN s.horizonte_dias = 90 THEN s.probabilidad_falla END) AS p90
       FROM scoring_resultados s JOIN ls ON s.activo_id = ls.activo_id AND s.fecha_scoring = ls.fecha_scoring GROUP BY 1),
lo AS (SELECT activo_id, ot_id, fecha_apertura, fecha_cierre, tipo_ot, costo_total_clp FROM ordenes_trabajo
       QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_apertura DESC, ot_id DESC) = 1),
od AS (SELECT activo_id, max(odometro_km) AS odo FROM ordenes_trabajo GROUP BY 1)
SELECT a.activo_id, a.patente, ls.fecha_scoring, ls.probabilidad_falla, ls.prioridad, ls.sistema_en_riesgo, ls.horizonte_dias,
  mh.p7, mh.p30, mh.p90, lo.ot_id, lo.fecha_apertura, lo.fecha_cierre, lo.tipo_ot, lo.costo_total_clp,
  coalesce(od.odo, 0.0) AS odometro_actual
FROM activos a LEFT JOIN ls ON a.activo_id = ls.activo_id LEFT JOIN mh ON a.activo_id = mh.activo_id
LEFT JOIN lo ON a.activo_id = lo.activo_id LEFT JOIN od ON a.activo_id = od.activo_id""")
def g1(spark, d):
    f = F_(spark, d)
    return G.asset_status(f.activos, f.scoring_resultados, f.ordenes_trabajo)


@register("G2_asset_stats", """
SELECT activo_id, count(*) AS total, count(CASE WHEN lower(tipo_ot) = 'preventiva' THEN 1 END) AS preventivas,
  count(CASE WHEN lower(tipo_ot) = 'correctiva' THEN 1 END) AS correctivas,
  coalesce(CAST(sum(CAST(costo_total_clp AS DECIMAL(38,2))) AS DOUBLE), 0.0) AS costo_total,
  CAST(coalesce(date_diff('day', min(CAST(fecha_apertura AS DATE)), max(CAST(fecha_apertura AS DATE))), 0) AS INTEGER) AS dias_periodo,
  CASE WHEN count(*) > 1 AND date_diff('day', min(CAST(fecha_apertura AS DATE)), max(CAST(fecha_apertura AS DATE))) > 0
       THEN round(date_diff('day', min(CAST(fecha_apertura AS DATE)), max(CAST(fecha_apertura AS DATE))) / (count(*) - 1), 9) END AS promedio_dias_entre_ot,
  CASE WHEN count(*) > 1 AND date_diff('day', min(CAST(fecha_apertura AS DATE)), max(CAST(fecha_apertura AS DATE))) > 0
       THEN CASE WHEN count(CASE WHEN lower(tipo_ot) = 'correctiva' THEN 1 END) > 0
                 THEN round(date_diff('day', min(CAST(fecha_apertura AS DATE)), max(CAST(fecha_apertura AS DATE)))
                            / count(CASE WHEN lower(tipo_ot) = 'correctiva' THEN 1 END), 9) ELSE 0.0 END END AS mtbf_dias
FROM ordenes_trabajo GROUP BY activo_id""")
def g2(spark, d):
    return G.asset_stats(F_(spark, d).ordenes_trabajo)


@register("G3_asset_top_parts", """
SELECT * FROM (SELECT ot.activo_id, rc.sku, CAST(sum(CAST(rc.cantidad AS DECIMAL(38,4))) AS DOUBLE) AS total_qty
               FROM repuestos_consumidos rc JOIN ordenes_trabajo ot ON rc.ot_id = ot.ot_id GROUP BY 1, 2)
QUALIFY (row_number() OVER (PARTITION BY activo_id ORDER BY total_qty DESC, sku)) <= 10""")
def g3a(spark, d):
    f = F_(spark, d)
    return G.asset_top_parts(f.ordenes_trabajo, f.repuestos_consumidos).drop("rank")


@register("G3_asset_top_systems", """
SELECT activo_id, sistema, eventos, ots FROM (
  SELECT coalesce(e.activo_id, ot.activo_id) AS activo_id, t.sistema, count(DISTINCT e.id_evento) AS eventos,
    count(DISTINCT e.ot_id) AS ots
  FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  LEFT JOIN ordenes_trabajo ot ON e.ot_id = ot.ot_id
  WHERE coalesce(e.activo_id, ot.activo_id) IS NOT NULL GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY eventos DESC, sistema) <= 5""")
def g3b(spark, d):
    f = F_(spark, d)
    return G.asset_top_systems(f.ot_falla_evento, f.taxonomia_fallas, f.ordenes_trabajo).drop("rank")


@register("G4_asset_history")
def g4(spark, d):
    f = F_(spark, d)
    return G.asset_history(f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas, f.repuestos_consumidos)


@register("G4_asset_history_lines", """
SELECT o.activo_id, o.ot_id, o.fecha_apertura, 'evento' AS clase, CAST(e.id_evento AS VARCHAR) AS id, e.taxonomia_id AS detalle, t.sistema AS sistema,
  CAST(NULL AS DOUBLE) AS cantidad
FROM ordenes_trabajo o JOIN ot_falla_evento e ON e.ot_id = o.ot_id LEFT JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
UNION ALL SELECT o.activo_id, o.ot_id, o.fecha_apertura, 'repuesto', r.sku, NULL, NULL, CAST(r.cantidad AS DOUBLE)
FROM ordenes_trabajo o JOIN repuestos_consumidos r ON r.ot_id = o.ot_id
UNION ALL SELECT o.activo_id, o.ot_id, o.fecha_apertura, 'orden', o.ot_id, o.tipo_ot, NULL, o.costo_total_clp FROM ordenes_trabajo o""")
def g4_lines(spark, d):
    """G4 with its arrays laid out: a line for each order, event and part."""
    from pyspark.sql import functions as F

    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    line = lambda kind, i, what, system, n: F.struct(F.lit(kind).alias("clase"), i.cast("string").alias("id"), what.alias("detalle"), system.alias("sistema"), n.cast("double").alias("cantidad"))
    events = F.transform("eventos", lambda e: line("evento", e["id_evento"], e["taxonomia_id"], e["sistema"], number))
    parts = F.transform("repuestos", lambda r: line("repuesto", r["sku"], text, text, r["cantidad"]))
    own = F.array(line("orden", F.col("ot_id"), F.col("tipo_ot"), text, F.col("costo_total_clp")))
    return g4(spark, d).select("activo_id", "ot_id", "fecha_apertura", F.inline(F.concat(own, events, parts)))


OS_SQL = f"""(SELECT ot.ot_id, ot.activo_id, CAST(ot.fecha_apertura AS DATE) AS fecha_apertura,
    coalesce(list_sort(list_distinct(list(lower(nullif(trim(t.sistema), ''))) FILTER (WHERE lower(nullif(trim(t.sistema), '')) IS NOT NULL))),
             CAST([] AS VARCHAR[])) AS sistemas
  FROM ordenes_trabajo ot LEFT JOIN ot_falla_evento e ON e.ot_id = ot.ot_id
  LEFT JOIN taxonomia_fallas t ON t.taxonomia_id = e.taxonomia_id
  WHERE lower(coalesce(ot.tipo_ot, '')) IN {CORR} AND ot.fecha_apertura >= TIMESTAMP '{AS_OF - dt.timedelta(days=365)} 00:00:00'
  GROUP BY 1, 2, 3)"""

LABELS_SQL = f"""(SELECT o.ot_id, o.activo_id, o.fecha_apertura, ps.scoring_id, ps.prioridad, ps.sistema_en_riesgo,
    CASE WHEN ps.scoring_id IS NULL THEN 'sin_scoring_previo' WHEN ps.prioridad IN ('P1_critica', 'P2_alta') THEN 'TP' ELSE 'FN' END AS etiqueta,
    CASE WHEN ps.scoring_id IS NOT NULL THEN
      CASE WHEN len(coalesce(o.sistemas, [])) = 0 THEN 'sin_clasificar'
           WHEN lower(trim(coalesce(ps.sistema_en_riesgo, ''))) <> '' AND list_contains(o.sistemas, lower(trim(coalesce(ps.sistema_en_riesgo, ''))))
           THEN 'sistema_match' ELSE 'sistema_mismatch' END END AS tipo_match
  FROM {OS_SQL} o LEFT JOIN (
    SELECT o2.ot_id, s.scoring_id, s.prioridad, s.sistema_en_riesgo FROM {OS_SQL} o2
    JOIN scoring_resultados s ON s.activo_id = o2.activo_id AND s.horizonte_dias = 30
      AND s.fecha_scoring >= o2.fecha_apertura - 30 AND s.fecha_scoring < o2.fecha_apertura
    QUALIFY row_number() OVER (PARTITION BY o2.ot_id ORDER BY s.fecha_scoring DESC, s.scoring_id DESC) = 1) ps
  ON o.ot_id = ps.ot_id)"""


def labels_frame(spark, d):
    f = F_(spark, d)
    os_ = B.order_systems(f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas, AS_OF)
    return B.label_orders(os_, f.scoring_resultados)


@register("B1_order_systems", f"SELECT * FROM {OS_SQL}")
def b1(spark, d):
    f = F_(spark, d)
    return B.order_systems(f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas, AS_OF)


@register("B2_B3_label_orders", f"SELECT * FROM {LABELS_SQL}")
def b2(spark, d):
    return labels_frame(spark, d)


ALERTS_SQL = f"""(SELECT s.scoring_id, s.activo_id, s.fecha_scoring, CAST(date_diff('day', s.fecha_scoring, DATE '{AS_OF}') AS INTEGER) AS edad_dias,
    CASE WHEN date_diff('day', s.fecha_scoring, DATE '{AS_OF}') > 2 THEN 'FP_revisada' ELSE 'pendiente' END AS estado
  FROM scoring_resultados s
  WHERE s.horizonte_dias = 30 AND s.prioridad IN ('P1_critica', 'P2_alta')
    AND s.fecha_scoring >= (SELECT min(fecha_scoring) FROM scoring_resultados WHERE fecha_scoring >= DATE '{AS_OF - dt.timedelta(days=14)}')
    AND s.scoring_id NOT IN (SELECT scoring_id FROM {LABELS_SQL} l WHERE scoring_id IS NOT NULL))"""


def alerts_frame(spark, d):
    return B.open_alerts(F_(spark, d).scoring_resultados, labels_frame(spark, d), AS_OF)


@register("B4_open_alerts", f"SELECT * FROM {ALERTS_SQL}")
def b4(spark, d):
    return alerts_frame(spark, d)


@register("B5_real_frontier", f"""
SELECT min(fecha_scoring) AS primer_real FROM scoring_resultados WHERE fecha_scoring >= DATE '{AS_OF - dt.timedelta(days=14)}'""")
def b5(spark, d):
    return B.real_frontier(F_(spark, d).scoring_resultados, AS_OF)


@register("B6_label_metrics", f"""
WITH l AS (SELECT count(CASE WHEN etiqueta = 'TP' THEN 1 END) AS tp, count(CASE WHEN etiqueta = 'FN' THEN 1 END) AS fn FROM {LABELS_SQL}),
a AS (SELECT count(CASE WHEN estado = 'FP_revisada' THEN 1 END) AS fp, count(CASE WHEN estado = 'pendiente' THEN 1 END) AS pendientes FROM {ALERTS_SQL})
SELECT tp, fn, fp, pendientes, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 9) AS precision FROM l, a""")
def b6(spark, d):
    return B.label_metrics(labels_frame(spark, d), alerts_frame(spark, d))


@register("J9_next_corrective_after_score", f"""
SELECT s.*, n.ot_siguiente, n.fecha_ot_siguiente FROM scoring_resultados s LEFT JOIN (
  SELECT s2.scoring_id, o.ot_id AS ot_siguiente, CAST(o.fecha_apertura AS DATE) AS fecha_ot_siguiente
  FROM scoring_resultados s2 JOIN ordenes_trabajo o ON o.activo_id = s2.activo_id
    AND CAST(o.fecha_apertura AS DATE) > s2.fecha_scoring AND CAST(o.fecha_apertura AS DATE) <= s2.fecha_scoring + 30
    AND lower(coalesce(o.tipo_ot, '')) IN {CORR}
  QUALIFY row_number() OVER (PARTITION BY s2.scoring_id ORDER BY CAST(o.fecha_apertura AS DATE), o.ot_id) = 1) n
ON s.scoring_id = n.scoring_id""")
def j9(spark, d):
    f = F_(spark, d)
    return B.next_corrective(f.scoring_resultados, f.ordenes_trabajo, "fecha_scoring")


@register("B7_load_feedback", f"""
WITH fbu AS (SELECT * REPLACE (CASE WHEN falla_confirmada IS NOT NULL THEN ot_id END AS ot_id) FROM feedback_taller)
SELECT fb.* REPLACE (coalesce(fb.ot_id, n.ot_siguiente) AS ot_id) FROM fbu fb LEFT JOIN (
  SELECT f2.feedback_id, o.ot_id AS ot_siguiente FROM fbu f2 JOIN ordenes_trabajo o ON o.activo_id = f2.activo_id
    AND CAST(o.fecha_apertura AS DATE) > f2.fecha_alerta AND CAST(o.fecha_apertura AS DATE) <= f2.fecha_alerta + 30
    AND lower(coalesce(o.tipo_ot, '')) IN {CORR}
  QUALIFY row_number() OVER (PARTITION BY f2.feedback_id ORDER BY CAST(o.fecha_apertura AS DATE), o.ot_id) = 1) n
ON fb.feedback_id = n.feedback_id""")
def b7(spark, d):
    f = F_(spark, d)
    fb = f.feedback_taller
    # the fixture links every alert to the asset's latest order; unlink alerts without a confirmed outcome first
    fb = fb.withColumn("ot_id", F.when(F.col("falla_confirmada").isNotNull(), F.col("ot_id")))
    return B.load_feedback(fb, f.scoring_resultados, f.ordenes_trabajo)
