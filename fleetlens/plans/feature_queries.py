"""P*: feature-panel queries and their DuckDB oracles (as_of = 2000-01-31, 180 days back, step 30)."""

from __future__ import annotations

from ..operators import features as P
from ..operators import quality as q
from ..sources.fixtures import AS_OF, fleet
from .registry import register

CORR = "('correctiva', 'correctivo', 'emergency')"


def panel_sql(back=180, step=30, windows=(7, 30, 90), horizons=(7, 30, 90), corrective=CORR, closed="right"):
    n = len(range(0, back, step))
    cuts = " UNION ALL ".join(f"SELECT DATE '{AS_OF}' - {k * step} AS fecha_corte" for k in range(n))
    w_cols = []
    for w in windows:
        inw = f"o.fecha_apertura >= sp.cts - INTERVAL {w} DAY"
        w_cols += [f"count(CASE WHEN {inw} THEN 1 END) AS n{w}",
                   f"count(CASE WHEN {inw} AND lower(coalesce(o.tipo_ot, '')) IN {corrective} THEN 1 END) AS c{w}",
                   f"CAST(sum(CASE WHEN {inw} THEN CAST(coalesce(o.costo_total_clp, 0.0) AS DECIMAL(38,2)) END) AS DOUBLE) AS m{w}"]
    hz = ", ".join(f"({h})" for h in horizons)
    if closed == "right":
        fwd = "o.fecha_apertura > sp.cts AND o.fecha_apertura <= sp.cts + to_days(hz.h)"
    else:
        fwd = "o.fecha_apertura >= sp.cts AND o.fecha_apertura < sp.cts + to_days(hz.h)"
    sel = []
    for w in windows:
        sel += [f"CAST(coalesce(nullif(n{w}, 0), -1) AS INTEGER) AS count_ot_{w}d"]
    for w in windows:
        sel += [f"CAST(coalesce(nullif(c{w}, 0), -1) AS INTEGER) AS count_correctivas_{w}d"]
    for w in windows:
        sel += [f"CASE WHEN n{w} > 0 THEN m{w} ELSE CAST(-1.0 AS DOUBLE) END AS costo_total_{w}d"]
    return f"""
WITH cuts AS ({cuts}),
sp AS (SELECT a.activo_id, a.fecha_alta_flota, c.fecha_corte, CAST(c.fecha_corte AS TIMESTAMP) AS cts
       FROM activos a, cuts c WHERE upper(coalesce(a.estado_actual, 'Activo')) = 'ACTIVO'),
agg AS (
  SELECT sp.activo_id, sp.fecha_corte, any_value(sp.fecha_alta_flota) AS fecha_alta_flota, any_value(sp.cts) AS cts,
    {', '.join(w_cols)},
    max(o.fecha_apertura) AS last_t,
    arg_max(o.odometro_km, struct_pack(t := o.fecha_apertura, i := o.ot_id)) FILTER (WHERE o.odometro_km IS NOT NULL) AS odo,
    arg_max(o.horometro_h, struct_pack(t := o.fecha_apertura, i := o.ot_id)) FILTER (WHERE o.horometro_h IS NOT NULL) AS hor
  FROM sp LEFT JOIN ordenes_trabajo o ON o.activo_id = sp.activo_id AND o.fecha_apertura < sp.cts
  GROUP BY sp.activo_id, sp.fecha_corte),
tg AS (
  SELECT sp.activo_id, sp.fecha_corte, hz.h AS horizonte_dias, max(CASE WHEN o.ot_id IS NOT NULL THEN 1 ELSE 0 END) AS target
  FROM sp CROSS JOIN (VALUES {hz}) hz(h)
  LEFT JOIN ordenes_trabajo o ON o.activo_id = sp.activo_id AND {fwd}
    AND lower(coalesce(o.tipo_ot, '')) IN {corrective}
  GROUP BY 1, 2, 3)
SELECT agg.activo_id, agg.fecha_corte, CAST(tg.horizonte_dias AS INTEGER) AS horizonte_dias,
  CAST(coalesce(date_diff('day', fecha_alta_flota, agg.fecha_corte), -1) AS INTEGER) AS edad_dias,
  coalesce(date_diff('day', fecha_alta_flota, agg.fecha_corte), -1) / 365.25 AS edad_anos,
  coalesce(odo, CAST(-1.0 AS DOUBLE)) AS odometro_actual, coalesce(hor, CAST(-1.0 AS DOUBLE)) AS horometro_actual,
  CAST(-1.0 AS DOUBLE) AS km_dia_promedio, CAST(-1.0 AS DOUBLE) AS horas_dia_promedio,
  CAST(coalesce(floor((epoch(cts) - epoch(last_t)) / 86400), -1) AS INTEGER) AS dias_desde_ultima_ot,
  {', '.join(sel)},
  CAST(-1.0 AS DOUBLE) AS mtbf_{max(windows)}d, CAST(-1.0 AS DOUBLE) AS dias_ult_correctiva_motor,
  CAST(-1.0 AS DOUBLE) AS dias_ult_correctiva_frenos, CAST(-1.0 AS DOUBLE) AS dias_ult_correctiva_transmision,
  CAST(tg.target AS INTEGER) AS target
FROM agg JOIN tg ON agg.activo_id = tg.activo_id AND agg.fecha_corte = tg.fecha_corte"""


def panel(spark, d, **kw):
    f = fleet(spark, d)
    return P.feature_panel(f.activos, f.ordenes_trabajo, AS_OF, **kw)


@register("P6_feature_panel", panel_sql())
def p6(spark, d):
    return panel(spark, d)


LEGACY = dict(back=84, step=7, windows=(30, 90, 180), horizons=(30,), corrective=("correctiva",), target_closed="left")


@register("P8_legacy_feature_panel", panel_sql(back=84, step=7, windows=(30, 90, 180), horizons=(30,),
                                               corrective="('correctiva')", closed="left"))
def p8(spark, d):
    return panel(spark, d, **LEGACY)


@register("Q15_target_distribution", f"""
WITH p AS ({panel_sql()}), t AS (SELECT horizonte_dias, count(*) AS total FROM p GROUP BY 1)
SELECT p.horizonte_dias, p.target, count(*) AS n, round(100.0 * CAST(count(*) AS DOUBLE) / any_value(t.total), 6) AS pct
FROM p JOIN t ON p.horizonte_dias = t.horizonte_dias GROUP BY p.horizonte_dias, p.target""")
def q15(spark, d):
    return q.target_distribution(panel(spark, d))


@register("P7_days_since_corrective_by_system", f"""
WITH cuts AS ({" UNION ALL ".join(f"SELECT DATE '{AS_OF}' - {k * 30} AS fecha_corte" for k in range(6))}),
so AS (SELECT DISTINCT e.ot_id, t.sistema FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
       WHERE e.ot_id IS NOT NULL),
o AS (SELECT o.activo_id, so.sistema, o.fecha_apertura FROM ordenes_trabajo o JOIN so ON o.ot_id = so.ot_id
      WHERE lower(coalesce(o.tipo_ot, '')) IN {CORR})
SELECT o.activo_id, c.fecha_corte, o.sistema,
  CAST(floor((epoch(CAST(c.fecha_corte AS TIMESTAMP)) - epoch(max(o.fecha_apertura))) / 86400) AS INTEGER) AS dias_ult_correctiva
FROM o JOIN cuts c ON o.fecha_apertura < CAST(c.fecha_corte AS TIMESTAMP)
GROUP BY o.activo_id, c.fecha_corte, o.sistema""")
def p7(spark, d):
    f = fleet(spark, d)
    return P.days_since_corrective_by_system(f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas, AS_OF)


@register("P7_mtbf_window_90d", f"""
WITH cuts AS ({" UNION ALL ".join(f"SELECT DATE '{AS_OF}' - {k * 30} AS fecha_corte" for k in range(6))}),
up AS (SELECT dd.activo_id, c.fecha_corte, CAST(sum(CAST(dd.horas_operativas AS DECIMAL(38,2))) AS DOUBLE) AS h_up
       FROM disponibilidad_diaria dd JOIN cuts c ON dd.fecha < c.fecha_corte AND dd.fecha >= c.fecha_corte - 90 GROUP BY 1, 2),
fl AS (SELECT o.activo_id, c.fecha_corte, count(*) AS n_corr FROM ordenes_trabajo o
       JOIN cuts c ON CAST(o.fecha_apertura AS DATE) < c.fecha_corte AND CAST(o.fecha_apertura AS DATE) >= c.fecha_corte - 90
       WHERE lower(coalesce(o.tipo_ot, '')) IN {CORR} GROUP BY 1, 2)
SELECT up.activo_id, up.fecha_corte, CASE WHEN fl.n_corr > 0 THEN round(up.h_up / fl.n_corr, 6) ELSE -1.0 END AS mtbf_90d
FROM up LEFT JOIN fl ON up.activo_id = fl.activo_id AND up.fecha_corte = fl.fecha_corte""")
def p7b(spark, d):
    f = fleet(spark, d)
    return P.mtbf_window(f.disponibilidad_diaria, f.ordenes_trabajo, AS_OF)
