"""D* and K30: spare-parts queries and their DuckDB oracles."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import parts as D
from ..operators.panels import latest_snapshot
from ..operators.windows import rows_at_max
from ..session import scratch_path
from ..sources import ingest as S
from ..sources.fixtures import AS_OF, fleet
from .registry import register

CORR = "('correctiva', 'correctivo', 'emergency')"
SPLIT = AS_OF - dt.timedelta(days=365)


def HU(x: str, s: int) -> str:
    """Half-up rounding of the decimal value of ``x`` (as Spark's decimal round / PostgreSQL numeric)."""
    return f"CAST(round(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,10)), {s}) AS DOUBLE)"


def DSUM(x: str, s: int = 4) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(38,{s}))) AS DOUBLE)"


def d1_sql(order_filter: str = "TRUE") -> str:
    return f"""(SELECT a.marca, a.modelo, t.sistema, rc.sku, {DSUM('rc.cantidad')} AS cantidad_total,
    count(*) AS num_registros_analizados, count(DISTINCT e.ot_id) AS frecuencia_fallos_historico,
    {DSUM('rc.cantidad')} / count(*) AS cantidad_promedio
  FROM ordenes_trabajo ot JOIN ot_falla_evento e ON ot.ot_id = e.ot_id
  JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  JOIN repuestos_consumidos rc ON ot.ot_id = rc.ot_id
  JOIN activos a ON ot.activo_id = a.activo_id
  WHERE a.marca IS NOT NULL AND a.modelo IS NOT NULL AND t.sistema IS NOT NULL AND trim(t.sistema) <> ''
    AND rc.sku IS NOT NULL AND trim(rc.sku) <> '' AND rc.cantidad IS NOT NULL AND {order_filter}
  GROUP BY a.marca, a.modelo, t.sistema, rc.sku)"""


D3_SQL = f"""(SELECT sku, CAST(tot AS DOUBLE) AS consumo_total, num_transacciones, fecha_primera, fecha_ultima,
    greatest(CAST(ceil(date_diff('day', fecha_primera, fecha_ultima) / 30.0) AS INTEGER), 1) AS num_meses,
    {HU("CAST(tot AS DOUBLE) / greatest(CAST(ceil(date_diff('day', fecha_primera, fecha_ultima) / 30.0) AS INTEGER), 1)", 2)} AS consumo_promedio_mensual
  FROM (SELECT sku, sum(CAST(cantidad AS DECIMAL(38,4))) AS tot, count(*) AS num_transacciones,
          min(CAST(created_at AS DATE)) AS fecha_primera, max(CAST(created_at AS DATE)) AS fecha_ultima
        FROM repuestos_consumidos WHERE sku IS NOT NULL AND trim(sku) <> '' AND cantidad IS NOT NULL GROUP BY sku))"""


def d4_sql(mapping: str = "mapeo_sistemas", dedupe: bool = False) -> str:
    ev = f"""(SELECT {'DISTINCT' if dedupe else ''} e.ot_id, lower(m.sistema_repuestos) AS sistema_rep
      FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
      JOIN {mapping} m ON lower(t.sistema) = lower(m.sistema_fallas))"""
    return f"""(SELECT ev.sistema_rep AS sistema, rc.sku,
    {DSUM('rc.cantidad')} / count(DISTINCT rc.ot_id) AS cantidad_promedio_por_intervencion
  FROM repuestos_consumidos rc JOIN ordenes_trabajo ot ON rc.ot_id = ot.ot_id JOIN {ev} ev ON ot.ot_id = ev.ot_id
  WHERE ot.fecha_apertura >= TIMESTAMP '{AS_OF - dt.timedelta(days=180)} 00:00:00' AND rc.sku IS NOT NULL
  GROUP BY ev.sistema_rep, rc.sku)"""


D5_SQL = f"""(SELECT cs.sistema, rc.sku, {DSUM('rc.cantidad')} / count(DISTINCT cs.ot_id) AS cantidad_media_por_ot
  FROM (SELECT DISTINCT ot.ot_id, lower(t.sistema) AS sistema FROM ot_falla_evento e
        JOIN ordenes_trabajo ot ON e.ot_id = ot.ot_id JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
        WHERE lower(ot.tipo_ot) IN {CORR}) cs
  JOIN repuestos_consumidos rc ON cs.ot_id = rc.ot_id WHERE rc.sku IS NOT NULL GROUP BY cs.sistema, rc.sku)"""

COST_SQL = f"""(SELECT lower(t.sistema) AS sistema, {DSUM('ot.costo_total_clp', 2)} / count(*) AS costo_correctivo_medio
  FROM ot_falla_evento e JOIN ordenes_trabajo ot ON e.ot_id = ot.ot_id JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  WHERE lower(ot.tipo_ot) IN {CORR} AND ot.costo_total_clp IS NOT NULL GROUP BY t.sistema)"""

D6_SQL = f"""(SELECT cp.sku, rm.descripcion, rm.stock_actual, {HU('cp.tot', 2)} AS demanda_prediccion,
    h.consumo_promedio_mensual AS demanda_historico, rm.lead_time_dias_promedio, rm.criticidad
  FROM (SELECT c.sku, sum(CAST(c.cantidad_promedio AS DECIMAL(38,6))) AS tot
        FROM (SELECT DISTINCT sr.activo_id, a.marca, a.modelo, sr.sistema_en_riesgo, sr.prioridad
              FROM scoring_resultados sr JOIN activos a ON sr.activo_id = a.activo_id
              WHERE sr.prioridad IN ('P1_critica', 'P2_alta')) ap
        JOIN {d1_sql()} c ON ap.marca = c.marca AND ap.modelo = c.modelo AND ap.sistema_en_riesgo = c.sistema
        GROUP BY c.sku) cp
  LEFT JOIN repuestos_maestro rm ON cp.sku = rm.sku LEFT JOIN {D3_SQL} h ON cp.sku = h.sku)"""

D7_SQL = f"""(SELECT sku, descripcion, stock_actual, demanda_prediccion AS demanda_30d_prediccion,
    demanda_historico AS demanda_30d_historico, lt AS lead_time_dias, round(cov, 9) AS cobertura_dias, criticidad,
    CASE WHEN demanda_prediccion = 0 THEN 'N/A' WHEN cov IS NULL THEN '🔴 Comprar urgente'
         WHEN cov < lt THEN '🔴 Comprar urgente' WHEN cov < lt + 7 THEN '🟡 Comprar' ELSE '✅ OK' END AS accion,
    round(CASE WHEN demanda_historico > 0 THEN (demanda_prediccion - demanda_historico) / demanda_historico * 100.0 ELSE 0.0 END, 9) AS delta_demanda
  FROM (SELECT sku, descripcion, coalesce(stock_actual, 0.0) AS stock_actual, coalesce(demanda_prediccion, 0.0) AS demanda_prediccion,
          coalesce(demanda_historico, 0.0) AS demanda_historico, coalesce(lead_time_dias_promedio, 0.0) AS lt, criticidad,
          CASE WHEN coalesce(demanda_prediccion, 0.0) > 0 THEN coalesce(stock_actual, 0.0) / coalesce(demanda_prediccion, 0.0) * 30.0 END AS cov
        FROM {D6_SQL}))"""

D8_SQL = f"""(SELECT * FROM {D7_SQL} WHERE lower(accion) LIKE '%urgente%'
  UNION ALL SELECT * FROM {D7_SQL} WHERE lower(accion) LIKE '%comprar%' AND lower(accion) NOT LIKE '%urgente%'
  UNION ALL (SELECT * FROM {D7_SQL} WHERE accion = '✅ OK' ORDER BY demanda_30d_prediccion DESC, sku LIMIT 10))"""


def inter_sql() -> str:
    per_h = " UNION ALL ".join(f"""
  SELECT a.patente, a.activo_id, {h} AS h, us.prioridad AS urgencia, us.probabilidad_falla,
    coalesce(us.sistema_en_riesgo, 'Sin clasificar') AS sistema,
    CASE WHEN us.sistema_en_riesgo = 'sin_historial_ot' THEN 'Inspección inicial' WHEN us.prioridad = 'P1_critica'
         THEN 'Correctivo programado' WHEN us.prioridad = 'P2_alta' THEN 'Preventivo anticipado' ELSE 'Inspección' END AS tipo
  FROM (SELECT * FROM scoring_resultados WHERE horizonte_dias = {h}
        QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_scoring DESC, scoring_id DESC) = 1) us
  JOIN activos a ON us.activo_id = a.activo_id
  WHERE us.prioridad IN ('P1_critica', 'P2_alta')
    AND coalesce(lower(a.estado_actual), 'operativo') NOT IN ('baja', 'fuera_servicio', 'inactivo')""" for h in (7, 30, 90))
    osys = """(SELECT e.ot_id, t.sistema FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  WHERE e.ot_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY e.ot_id ORDER BY e.fecha_evento DESC NULLS LAST, e.id_evento DESC, e.taxonomia_id DESC) = 1)"""
    return f"""(WITH ph AS ({per_h}),
  m AS (SELECT patente, arg_min(activo_id, h) AS activo_id, arg_min(tipo, h) AS tipo, arg_min(sistema, h) AS sistema,
          arg_min(urgencia, h) AS urgencia, arg_min(probabilidad_falla, h) AS probabilidad_falla,
          max(CASE WHEN h = 7 THEN 1 ELSE 0 END) AS h7, max(CASE WHEN h = 30 THEN 1 ELSE 0 END) AS h30,
          max(CASE WHEN h = 90 THEN 1 ELSE 0 END) AS h90 FROM ph GROUP BY patente),
  c AS (SELECT lower(coalesce(os.sistema, 'sin_sistema')) AS sk,
          {HU(f"{DSUM('coalesce(ot.costo_total_clp, 0.0)', 2)} / count(*)", 0)} AS cost
        FROM ordenes_trabajo ot LEFT JOIN {osys} os ON ot.ot_id = os.ot_id
        WHERE ot.fecha_cierre IS NOT NULL AND lower(coalesce(ot.tipo_ot, '')) IN {CORR} GROUP BY 1)
  SELECT m.patente, m.activo_id, m.tipo, m.sistema, m.urgencia, m.probabilidad_falla,
    CASE WHEN c.cost > 0 THEN c.cost END AS costo_estimado,
    round(CASE WHEN c.cost > 0 THEN c.cost END * m.probabilidad_falla * 3, 6) AS costo_no_intervenir, m.h7, m.h30, m.h90
  FROM m LEFT JOIN c ON lower(coalesce(m.sistema, 'sin_sistema')) = c.sk)"""


D9_SQL = f"""(SELECT lower(ms.sistema_repuestos) AS sistema, count(*) AS n_intervenciones_proximas
  FROM {inter_sql()} i JOIN mapeo_sistemas ms ON lower(i.sistema) = lower(ms.sistema_fallas)
  WHERE i.h30 = 1 AND i.sistema IS NOT NULL GROUP BY 1)"""

PLAN_SQL = f"""(WITH s AS (
    SELECT activo_id, coalesce(probabilidad_falla, 0.0) AS p, prioridad, x.sistema
    FROM (SELECT * FROM scoring_resultados WHERE fecha_scoring = (SELECT max(fecha_scoring) FROM scoring_resultados)) sr,
      unnest(list_filter(list_transform(string_split(coalesce(sr.sistema_en_riesgo, ''), '|'), lambda y: lower(trim(y))),
                         lambda y: y NOT IN ('', 'general', 'nan', 'none'))) AS x(sistema)),
  sc AS (SELECT s.*, c.costo_correctivo_medio,
           CASE WHEN coalesce(c.costo_correctivo_medio, 0.0) <> 0 THEN s.p * c.costo_correctivo_medio END AS ev
         FROM s LEFT JOIN {COST_SQL} c ON s.sistema = c.sistema),
  mm AS (SELECT sku, descripcion, lower(sistema) AS sistema, lead_time_dias_promedio, costo_unitario_clp, stock_actual
         FROM repuestos_maestro WHERE activo = TRUE),
  w AS (SELECT sc.*, mm.sku, mm.descripcion, mm.lead_time_dias_promedio, mm.costo_unitario_clp, mm.stock_actual,
          sc.p * coalesce(u.cantidad_media_por_ot, 1.0) AS dem
        FROM sc JOIN mm ON sc.sistema = mm.sistema LEFT JOIN {D5_SQL} u ON u.sistema = sc.sistema AND u.sku = mm.sku)
  SELECT activo_id, sistema, sku, descripcion, round_even(p, 4) AS probabilidad_falla, prioridad,
    round_even(dem, 3) AS demanda_esperada, coalesce(stock_actual, 0.0) AS stock_actual,
    round_even(coalesce(stock_actual, 0.0) - dem, 3) AS holgura_stock, coalesce(lead_time_dias_promedio, 30.0) AS lead_time_dias,
    costo_unitario_clp, costo_correctivo_medio AS costo_correctivo_est, round_even(ev, 0) AS costo_evitado_est,
    CASE WHEN prioridad IN ('P1_critica', 'P2_alta') AND coalesce(stock_actual, 0.0) - dem < 0 THEN 'REORDENAR_URGENTE'
         WHEN prioridad IN ('P1_critica', 'P2_alta') AND (coalesce(stock_actual, 0.0) - dem < dem
              OR coalesce(lead_time_dias_promedio, 30.0) >= 15.0) THEN 'PREPARAR' ELSE 'MONITOREAR' END AS accion
  FROM w
  UNION ALL
  SELECT activo_id, sistema, NULL, NULL, round_even(p, 4), prioridad, NULL, NULL, NULL, NULL, NULL,
    costo_correctivo_medio, ev, 'SIN_MAESTRO'
  FROM sc WHERE sistema NOT IN (SELECT sistema FROM mm))"""


def F_(spark, d):
    return fleet(spark, d)


def d1_frame(spark, d):
    f = F_(spark, d)
    return D.consumption_map(f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas, f.repuestos_consumidos, f.activos)


def d5_frame(spark, d):
    f = F_(spark, d)
    return D.use_per_corrective(f.repuestos_consumidos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas)


def d7_frame(spark, d):
    # the demand job reads the stored consumption map and SKU history, as the source pipeline does
    f = F_(spark, d)
    demand = D.projected_demand(f.scoring_resultados, f.activos, f.consumo_sistema_modelo, f.repuestos_maestro,
                                f.consumo_sku_historico)
    return D.coverage_action(demand)


def inter_frame(spark, d):
    f = F_(spark, d)
    return D.interventions(f.scoring_resultados, f.activos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas)


def plan_frame(spark, d):
    f = F_(spark, d)
    snap = rows_at_max(f.scoring_resultados, [], "fecha_scoring")
    cost = D.corrective_cost_by_system(f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas)
    return D.parts_plan(snap, f.repuestos_maestro, cost, d5_frame(spark, d))


@register("D1_consumption_map", f"SELECT * FROM {d1_sql()}")
def d1(spark, d):
    return d1_frame(spark, d)


@register("D2_merge_consumption", f"""
SELECT marca, modelo, sistema, sku, cantidad_total, num_registros_analizados, frecuencia_fallos_historico,
  {HU('cantidad_total / num_registros_analizados', 2)} AS cantidad_promedio FROM {d1_sql()}""")
def d2(spark, d):
    f = F_(spark, d)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    old_ot = f.ordenes_trabajo.filter(F.col("fecha_apertura") < split)
    new_ot = f.ordenes_trabajo.filter(F.col("fecha_apertura") >= split)

    def cm(o):
        return D.consumption_map(o, f.ot_falla_evento, f.taxonomia_fallas, f.repuestos_consumidos, f.activos)

    return D.merge_consumption(cm(old_ot), cm(new_ot))


@register("D3_monthly_sku", f"SELECT * FROM {D3_SQL}")
def d3(spark, d):
    return D.monthly_sku(F_(spark, d).repuestos_consumidos)


@register("D4_use_per_intervention_180d", f"SELECT * FROM {d4_sql()}")
def d4(spark, d):
    f = F_(spark, d)
    return D.use_per_intervention(f.repuestos_consumidos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas,
                                  f.mapeo_sistemas, AS_OF)


@register("D4_use_per_intervention_prefixed_map", f"SELECT * FROM {d4_sql('mapeo_sistemas_prefijo')}")
def d4b(spark, d):
    f = F_(spark, d)
    return D.use_per_intervention(f.repuestos_consumidos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas,
                                  f.mapeo_sistemas_prefijo, AS_OF)


@register("D4_use_per_intervention_dedupe", f"SELECT * FROM {d4_sql(dedupe=True)}")
def d4c(spark, d):
    f = F_(spark, d)
    return D.use_per_intervention(f.repuestos_consumidos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas,
                                  f.mapeo_sistemas, AS_OF, dedupe=True)


@register("D5_use_per_corrective", f"SELECT * FROM {D5_SQL}")
def d5(spark, d):
    return d5_frame(spark, d)


@register("D6_projected_demand", f"SELECT * FROM {D6_SQL}")
def d6(spark, d):
    f = F_(spark, d)
    return D.projected_demand(f.scoring_resultados, f.activos, f.consumo_sistema_modelo, f.repuestos_maestro,
                              f.consumo_sku_historico)


@register("D7_coverage_action", f"SELECT * FROM {D7_SQL}")
def d7(spark, d):
    return d7_frame(spark, d)


@register("D8_critical_panel", f"SELECT * FROM {D8_SQL}")
def d8(spark, d):
    return D.critical_panel(d7_frame(spark, d))


@register("K30_stock_coverage", f"""
SELECT round(CASE WHEN count(*) > 0 THEN CAST(count(CASE WHEN cobertura_dias >= lead_time_dias THEN 1 END) AS DOUBLE)
  / count(*) * 100.0 END, 9) AS valor FROM {D8_SQL} WHERE demanda_30d_prediccion > 0""")
def k30(spark, d):
    # the metric reads the stored critical-parts panel written by the daily demand job
    return D.stock_coverage(F_(spark, d).repuestos_panel_criticos)


@register("D11_interventions", f"SELECT * FROM {inter_sql()}")
def d11(spark, d):
    return inter_frame(spark, d)


@register("D9_upcoming_by_system", f"SELECT * FROM {D9_SQL}")
def d9(spark, d):
    return D.upcoming_by_system(inter_frame(spark, d), F_(spark, d).mapeo_sistemas)


@register("D10_required_stock", f"""
WITH m AS (SELECT sku, descripcion, lower(sistema) AS sistema, stock_actual, criticidad, lead_time_dias_promedio,
             costo_unitario_clp FROM repuestos_maestro WHERE sku IS NOT NULL),
j AS (SELECT m.*, coalesce(u.cantidad_promedio_por_intervencion, 0.0) AS cp,
        CAST(coalesce(up.n_intervenciones_proximas, 0) AS INTEGER) AS ni
      FROM m LEFT JOIN {d4_sql()} u ON m.sistema = u.sistema AND m.sku = u.sku LEFT JOIN {D9_SQL} up ON m.sistema = up.sistema)
SELECT sku, descripcion, sistema, coalesce(stock_actual, 0.0) AS stock_actual, cp AS cantidad_promedio_por_intervencion,
  ni AS n_intervenciones_proximas, round(cp * ni, 9) AS stock_requerido, round(coalesce(stock_actual, 0.0) - cp * ni, 9) AS brecha,
  criticidad, lead_time_dias_promedio AS lead_time_dias, costo_unitario_clp
FROM j WHERE cp > 0 OR ni > 0""")
def d10(spark, d):
    f = F_(spark, d)
    use = D.use_per_intervention(f.repuestos_consumidos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas,
                                 f.mapeo_sistemas, AS_OF)
    return D.required_stock(f.repuestos_maestro, use, D.upcoming_by_system(inter_frame(spark, d), f.mapeo_sistemas))


@register("D12_parts_plan", f"SELECT * FROM {PLAN_SQL}")
def d12(spark, d):
    return plan_frame(spark, d)


@register("W11_plan_in_order", f"""
SELECT *, row_number() OVER (ORDER BY CASE accion WHEN 'REORDENAR_URGENTE' THEN 0 WHEN 'PREPARAR' THEN 1 WHEN 'SIN_MAESTRO' THEN 2
    WHEN 'MONITOREAR' THEN 3 ELSE 9 END, probabilidad_falla DESC, costo_evitado_est DESC NULLS LAST, activo_id, sistema, sku NULLS FIRST) AS orden
FROM {PLAN_SQL}""")
def w11(spark, d):
    return D.in_plan_order(plan_frame(spark, d))


@register("S11_exported_plan", f"SELECT * FROM {PLAN_SQL}")
def s11(spark, d):
    """The plan written to CSV and Parquet, stamped with its day; the CSV, read back with the Parquet's types."""
    csv, pq = S.export_plan(plan_frame(spark, d), scratch_path(spark, f"io-{uuid.uuid4().hex}"), f"{AS_OF:%Y%m%d}")
    return spark.read.options(**S.EXPORT).schema(spark.read.parquet(pq).schema).csv(csv)


@register("D13_plan_summary", f"""
SELECT count(CASE WHEN accion = 'REORDENAR_URGENTE' THEN 1 END) AS lineas_urgentes,
  coalesce(round(sum(costo_evitado_est), 2), 0.0) AS costo_evitado_total, count(DISTINCT activo_id) AS activos
FROM {PLAN_SQL}""")
def d13(spark, d):
    return D.plan_summary(plan_frame(spark, d))


@register("D14_interventions_with_parts", f"""
WITH i AS (SELECT * FROM {inter_sql()} WHERE h30 = 1),
j AS (SELECT i.patente, rm.descripcion, rm.sku, c.cantidad_promedio FROM i JOIN activos a ON lower(i.patente) = lower(a.patente)
      JOIN {d1_sql()} c ON lower(a.marca) = lower(c.marca) AND lower(a.modelo) = lower(c.modelo) AND lower(i.sistema) = lower(c.sistema)
      JOIN repuestos_maestro rm ON c.sku = rm.sku WHERE rm.descripcion IS NOT NULL),
t AS (SELECT patente, string_agg(descripcion, ', ' ORDER BY rn) AS rep FROM (
        SELECT *, row_number() OVER (PARTITION BY patente ORDER BY cantidad_promedio DESC, descripcion, sku) AS rn FROM j)
      WHERE rn <= 3 GROUP BY patente)
SELECT i.patente, i.tipo, i.sistema, i.urgencia, i.costo_estimado, i.costo_no_intervenir,
  coalesce(nullif(t.rep, ''), 'N/A') AS repuestos_sugeridos,
  CASE i.urgencia WHEN 'P1_critica' THEN 1 WHEN 'P2_alta' THEN 2 WHEN 'P3_media' THEN 3 WHEN 'P4_baja' THEN 4 ELSE 9 END AS _orden
FROM i LEFT JOIN t ON i.patente = t.patente""")
def d14(spark, d):
    f = F_(spark, d)
    return D.interventions_with_parts(inter_frame(spark, d), f.activos, f.consumo_sistema_modelo, f.repuestos_maestro, 30)


@register("D15_stock_view", f"""
WITH j AS (SELECT rc.sku, rc.cantidad, CAST(ot.fecha_apertura AS DATE) AS d FROM repuestos_consumidos rc
           JOIN ordenes_trabajo ot ON rc.ot_id = ot.ot_id),
u AS (SELECT sku, sum(CASE WHEN d >= DATE '{AS_OF - dt.timedelta(days=30)}' THEN CAST(cantidad AS DECIMAL(38,4)) ELSE 0 END) AS d30,
        sum(CASE WHEN d >= DATE '{AS_OF - dt.timedelta(days=30)}' THEN CAST(cantidad AS DECIMAL(38,4)) END) AS s30,
        count(CASE WHEN d >= DATE '{AS_OF - dt.timedelta(days=30)}' THEN cantidad END) AS n30 FROM j GROUP BY sku),
al AS (SELECT sku, sum(CAST(cantidad AS DECIMAL(38,4))) AS s, count(cantidad) AS n FROM repuestos_consumidos GROUP BY sku),
m AS (SELECT rm.*, u.d30, u.s30, u.n30, al.s, al.n FROM repuestos_maestro rm LEFT JOIN u ON rm.sku = u.sku
      LEFT JOIN al ON rm.sku = al.sku WHERE rm.criticidad IN ('alta', 'media') AND rm.activo = TRUE),
o AS (SELECT sku, descripcion, sistema, componente, stock_actual, coalesce({HU('CAST(d30 AS DOUBLE)', 0)}, 0.0) AS demanda_30d,
        lead_time_dias_promedio AS lead_time_dias,
        CAST(CASE WHEN {HU('CAST(s30 AS DOUBLE) / n30', 2)} > 0 THEN {HU('stock_actual / (CAST(s AS DOUBLE) / n)', 0)}
             ELSE stock_actual END AS INTEGER) AS dias_cobertura, criticidad,
        CASE WHEN stock_actual < lead_time_dias_promedio * coalesce(CAST(s AS DOUBLE) / n, 1.0) THEN '⚠️ Comprar urgente'
             WHEN stock_actual < stock_minimo THEN '⚠️ Comprar' ELSE 'OK' END AS accion FROM m)
SELECT * FROM o ORDER BY dias_cobertura ASC NULLS LAST, criticidad DESC, sku LIMIT 30""")
def d15(spark, d):
    f = F_(spark, d)
    return D.stock_view(f.repuestos_maestro, f.repuestos_consumidos, f.ordenes_trabajo, AS_OF)


@register("D16_coverage_recent", f"""
WITH q AS (SELECT rc.sku, {DSUM('rc.cantidad')} AS q FROM repuestos_consumidos rc JOIN ordenes_trabajo ot ON rc.ot_id = ot.ot_id
           WHERE ot.fecha_apertura >= TIMESTAMP '{AS_OF - dt.timedelta(days=30)} 00:00:00' GROUP BY rc.sku)
SELECT rm.sku, rm.descripcion, rm.stock_actual, rm.lead_time_dias_promedio AS lead_time, rm.criticidad, rm.costo_unitario_clp,
  round(rm.stock_actual / greatest(1.0, coalesce(q.q, 0.0)) * 30.0, 9) AS cobertura_dias
FROM repuestos_maestro rm LEFT JOIN q ON rm.sku = q.sku""")
def d16(spark, d):
    f = F_(spark, d)
    return D.coverage_recent(f.repuestos_maestro, f.repuestos_consumidos, f.ordenes_trabajo, AS_OF)


D17_DATE = dt.date(2000, 1, 30)


@register("D17_recommendations_v1", f"""
WITH osys AS (SELECT e.ot_id, t.sistema FROM ot_falla_evento e JOIN taxonomia_fallas t ON e.taxonomia_id = t.taxonomia_id
  WHERE e.ot_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY e.ot_id ORDER BY e.fecha_evento DESC NULLS LAST, e.id_evento DESC, e.taxonomia_id DESC) = 1),
ots AS (SELECT ot.*, osys.sistema FROM ordenes_trabajo ot LEFT JOIN osys ON ot.ot_id = osys.ot_id),
last AS (SELECT activo_id, sistema AS sistema_prob FROM ots
         QUALIFY row_number() OVER (PARTITION BY activo_id ORDER BY fecha_apertura DESC, ot_id DESC) = 1),
cly AS (SELECT sistema, {HU(f"{DSUM('costo_total_clp', 2)} / count(costo_total_clp)", 0)} AS cly FROM ots
        WHERE year(fecha_apertura) = {D17_DATE.year - 1} GROUP BY sistema),
cc AS (SELECT sistema, {DSUM('costo_total_clp', 2)} / count(costo_total_clp) AS cc FROM ots
       WHERE lower(tipo_ot) = 'correctiva' GROUP BY sistema),
parts AS (SELECT ot.activo_id, array_to_string(list_sort(list_distinct(list(rc.sku))), ', ') AS rep
          FROM repuestos_consumidos rc JOIN ordenes_trabajo ot ON rc.ot_id = ot.ot_id GROUP BY ot.activo_id),
j AS (SELECT s.*, a.patente, a.marca, a.modelo, last.sistema_prob, cly.cly, cc.cc, parts.rep
      FROM scoring_resultados s JOIN activos a ON s.activo_id = a.activo_id LEFT JOIN last ON s.activo_id = last.activo_id
      LEFT JOIN cly ON last.sistema_prob = cly.sistema LEFT JOIN cc ON last.sistema_prob = cc.sistema
      LEFT JOIN parts ON s.activo_id = parts.activo_id
      WHERE s.fecha_scoring = DATE '{D17_DATE}' AND s.horizonte_dias = 30 AND s.prioridad IN ('P1_critica', 'P2_alta'))
SELECT patente, marca, modelo, activo_id,
  CASE WHEN probabilidad_falla >= 0.85 THEN 'Correctivo programado' WHEN probabilidad_falla >= 0.6 THEN 'Preventivo anticipado'
       ELSE 'Inspección' END AS tipo_intervencion,
  coalesce(sistema_prob, 'Sistema general') AS sistema,
  '{(D17_DATE + dt.timedelta(days=3)).strftime('%d %b')} - {(D17_DATE + dt.timedelta(days=7)).strftime('%d %b')}' AS ventana_optima,
  prioridad AS urgencia, CAST(coalesce(cly, 450000.0) AS BIGINT) AS costo_estimado_intervencion,
  CAST({HU('probabilidad_falla * coalesce(cc, 1200000.0)', 0)} AS BIGINT) AS costo_no_intervenir,
  rep AS repuestos_sugeridos, {HU('probabilidad_falla * 100', 1)} AS probabilidad_30d
FROM j ORDER BY probabilidad_30d DESC, activo_id LIMIT 20""")
def d17(spark, d):
    f = F_(spark, d)
    return D.recommendations_v1(f.scoring_resultados, f.activos, f.ordenes_trabajo, f.ot_falla_evento, f.taxonomia_fallas,
                                f.repuestos_consumidos, D17_DATE)


@register("D18_critical_panel_today", f"SELECT * FROM {D8_SQL} WHERE regexp_full_match(sku, '^REP-[0-9]{{4,}}$')")
def d18(spark, d):
    # the derived SKUs are padded to four digits and longer from part 10,000 on
    return D.critical_panel_today(D.critical_panel(d7_frame(spark, d)), r"^REP-[0-9]{4,}$")


__all__ = ["latest_snapshot"]


@register("Q12_demand_join_coverage", f"""
SELECT ap.marca, ap.modelo, ap.sistema, count(DISTINCT ap.activo_id) AS activos, count(DISTINCT c.sku) AS skus_candidatos
FROM (SELECT sr.activo_id, a.marca, a.modelo, sr.sistema_en_riesgo AS sistema FROM scoring_resultados sr
      JOIN activos a ON sr.activo_id = a.activo_id WHERE sr.prioridad IN ('P1_critica', 'P2_alta')) ap
LEFT JOIN {d1_sql()} c ON ap.marca = c.marca AND ap.modelo = c.modelo AND ap.sistema = c.sistema
GROUP BY ap.marca, ap.modelo, ap.sistema""")
def q12(spark, d):
    from ..operators import quality as Q
    f = F_(spark, d)
    return Q.demand_coverage(f.scoring_resultados, f.activos, f.consumo_sistema_modelo)
